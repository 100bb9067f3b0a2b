"""Site findings: one scan for the rules about single pages, joins for the others."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import urls

from . import dups, site, store

HIGH, MED, LOW = "HIGH", "MED", "LOW"
URL_LIMIT = 200


@dataclass(frozen=True)
class Rule:
    """severity, category and issue are fixed values that name the finding; when is SQL over the page table."""

    severity: str
    category: str
    issue: str
    when: str
    why: str


#: In report order, which breaks ties of severity, count and issue.
RULES = [
    Rule(HIGH, "indexability", "Server errors (5xx)", "status >= 500", "The server failed; such pages drop out of the index."),
    Rule(MED, "indexability", "Request failures", "status is null or error is not null", "No answer came, so nothing is known about the page."),
    Rule(HIGH, "indexability", "Noindex on internally linked pages", "noindex and status = 200 and inlinks > 0", "Links lead to pages that ask not to be found."),
    Rule(HIGH, "canonical", "Canonical points to another domain", "canonical_state = 'cross-domain' and status = 200", "Another site gets the credit for the page."),
    Rule(MED, "canonical", "Missing canonical tag", "canonical_state = 'missing' and status = 200", "Variants of the URL compete with each other."),
    Rule(HIGH, "ecommerce", "Product price signals disagree", "is_product and not price_consistent and status = 200", "Feeds and search results may show the wrong price."),
    Rule(HIGH, "ecommerce", "Product currency signals disagree", "is_product and not currency_consistent and status = 200", "A price in the wrong currency is a wrong price."),
    Rule(MED, "ecommerce", "Verify review schema grouping (Google review snippet policy risk)", "is_product and review_suspicious and status = 200", "More reviews are claimed than are shown."),
    Rule(MED, "ecommerce", "Product pages without Product schema", "url like '%/products/%' and status = 200 and not arrays_overlap(schema_types, array('Product', 'ProductGroup'))", "Rich results need the markup."),
    Rule(MED, "redirects", "Redirect chains longer than one hop", "redirect_hops > 1", "Each hop costs time and crawl budget."),
    Rule(HIGH, "redirects", "Redirect loops", "redirect_loop", "The page can't be reached."),
    Rule(MED, "hreflang", "Missing x-default", "indexable and size(hreflang) > 0 and not hreflang_x_default", "Visitors of other languages have no page."),
    Rule(MED, "hreflang", "hreflang set missing a self-reference", "indexable and size(hreflang) > 0 and not hreflang_self", "A set that leaves out its own page is ignored."),
    Rule(MED, "hreflang", "Invalid hreflang language codes", "indexable and size(hreflang_invalid) > 0", "Unknown codes are ignored."),
    Rule(HIGH, "performance", "Hero image is lazy-loaded", "hero_lazy and status = 200", "The largest image comes last."),
    Rule(LOW, "performance", 'Hero image without fetchpriority="high"', "hero_image is not null and not fetchpriority_present and not hero_lazy and status = 200", "The browser can't know what matters most."),
    Rule(MED, "performance", "Below-fold images load eagerly", "imgs_eager_belowfold_count > 0 and status = 200", "What isn't seen yet delays what is."),
    Rule(LOW, "images", "Large images served without srcset", "size(imgs_large_no_srcset) > 0 and status = 200", "Phones load images meant for desktops."),
    Rule(HIGH, "on-page", "Missing title tag", "indexable and title_issue = 'missing'", "The title is the strongest signal of a page."),
    Rule(LOW, "on-page", "Title too long for the SERP", "indexable and title_issue = 'too long'", "The end is cut off."),
    Rule(LOW, "on-page", "Title too short", "indexable and title_issue = 'too short'", "It leaves room unused."),
    Rule(MED, "on-page", "Missing meta description", "indexable and meta_description_issue = 'missing'", "The snippet is left to chance."),
    Rule(LOW, "on-page", "Meta description too long", "indexable and meta_description_issue = 'too long'", "The end is cut off."),
    Rule(MED, "on-page", "Missing H1", "indexable and h1_count = 0", "The page doesn't say what it is about."),
    Rule(LOW, "on-page", "Multiple H1 tags", "indexable and h1_count > 1", "Several topics compete."),
    Rule(LOW, "on-page", "Heading order violations", "indexable and size(heading_issues) > 0", "The outline has holes."),
    Rule(MED, "on-page", "Content sections carry no headings", "unmarked_content_sections and status = 200", "The headings describe the template only."),
    Rule(MED, "content", "Typos in title or meta description", "indexable and size(spelling_title) + size(spelling_meta) > 0", "Searchers see them first."),
    Rule(MED, "content", "Typos in H1", "indexable and size(spelling_h1) > 0", "Visitors see them first."),
    Rule(LOW, "content", "Typos in body content", "indexable and spelling_body_count > 0", "Many of them cost trust."),
    Rule(MED, "content", "Thin content", "indexable and thin_content and word_count > 0", "There is little to rank."),
    Rule(LOW, "images", "Images missing alt text", "indexable and images_missing_alt > 0", "Nobody who can't see them knows what they show."),
    Rule(MED, "images", "Oversized images", "size(images_oversized) > 0", "They make the page slow."),
    Rule(HIGH, "mobile", "Missing viewport meta tag", "indexable and viewport is null", "Phones show the page as a desktop would."),
    Rule(LOW, "social", "Missing og:image", "indexable and array_contains(missing_social, 'og:image')", "Shared links have no picture."),
    Rule(MED, "urls", "URLs with a -copy suffix", "array_contains(url_flags, 'copy-suffix')", "A copy was left behind."),
    Rule(LOW, "urls", "Uppercase characters in URLs", "array_contains(url_flags, 'uppercase')", "Two spellings are two pages."),
    Rule(LOW, "urls", "URLs more than four levels deep", "array_contains(url_flags, 'deep-path')", "Deep pages are crawled less."),
    Rule(MED, "urls", "Query-string URLs without a canonical", "array_contains(url_flags, 'query-params-no-canonical')", "Every combination is a page of its own."),
]
JOINED = {
    "dead": (None, "indexability", "Dead URLs (4xx)", "Visitors and crawlers end there."),
    "title": (HIGH, "duplication", "Duplicate title tags", "Pages with one title compete for one query."),
    "description": (MED, "duplication", "Duplicate meta descriptions", "A text for all pages describes none."),
    "content": (HIGH, "duplication", "Identical page content", "Equal pages divide their links."),
    "near": (MED, "duplication", "Near-duplicate content", "Only one of them is shown."),
    "broken": (HIGH, "links", "Broken internal links", "They lead nowhere."),
    "moved": (LOW, "links", "Internal links pointing at redirects", "They take a detour."),
    "orphans": (MED, "structure", "Orphan pages (in sitemap, no internal links)", "Nothing on the site leads there."),
    "ghosts": (MED, "structure", "Ghost pages (linked, missing from sitemap)", "The sitemap is incomplete."),
    "hreflang": (HIGH, "hreflang", "hreflang reciprocity failures", "One-sided alternates are ignored."),
    "pool": (HIGH, "ecommerce", "Merged review pool across distinct products", "One pool of reviews stands for different products."),
    "anchors": (MED, "links", "Anchor text promises a destination it does not deliver", "Who clicks finds the home page."),
}
#: Columns that other steps add, and what stands for them until then.
OPTIONAL = {
    "spelling_title": "array()", "spelling_meta": "array()", "spelling_h1": "array()", "spelling_body_count": "0", "images_oversized": "array()", "inlinks": "0",
    "largest_image_kb": "0", "images_sized": "false", "robots_directive_source": "cast(null as string)",
}



def severity_rank(severity: Column) -> Column:
    return F.when(severity == HIGH, 0).when(severity == MED, 1).otherwise(2)


def page_details(pages: DataFrame) -> DataFrame:
    """(issue, more): what a finding's detail says beyond the number of its pages, from one aggregate over the pages.

    Sums over the pages of a finding, and its worst page; at equal worth the first url is the worst.
    """
    p = completed(pages)
    when = {r.issue: F.expr(r.when) for r in RULES}
    size = lambda c: F.size(c)
    worst = lambda c, measure: F.min(F.when(c, F.struct((-measure).alias("m"), "url")))
    hops, typos, alts, eager = "Redirect chains longer than one hop", "Typos in body content", "Images missing alt text", "Below-fold images load eagerly"
    heavy, reviews, thin, no, titles = "Oversized images", RULES[7].issue, "Thin content", "Noindex on internally linked pages", "Typos in title or meta description"
    kb = F.col("largest_image_kb")
    header = F.contains(F.coalesce("robots_directive_source", F.lit("")), F.lit("header"))
    one = p.agg(
        worst(when[hops], F.col("redirect_hops")).alias("hops"), worst(when[typos], F.col("spelling_body_count")).alias("typos"), F.sum(F.when(when[typos], F.col("spelling_body_count"))).alias("n_typos"),
        F.sum(F.when(when[alts], F.col("images_missing_alt"))).alias("alts"), F.sum(F.when(when[eager], F.col("imgs_eager_belowfold_count"))).alias("eager"),
        worst(when[heavy], kb).alias("heavy"), F.sum(F.when(when[heavy], size("images_oversized"))).alias("n_heavy"), F.count_if(F.expr("status = 200 and images_sized")).alias("sized"), F.count_if(F.expr("status = 200 and not images_sized")).alias("skipped"),
        F.floor(F.sum(F.when(when[thin], F.col("word_count"))) / F.greatest(F.lit(1), F.count_if(when[thin]))).alias("thin"), F.count_if(when[no] & header).alias("by_header"),
        F.sum(F.when(when[titles], size("spelling_title") + size("spelling_meta"))).alias("n_titles"), worst(when[reviews], F.col("review_schema_count")).alias("reviews"),
    )
    said = {
        hops: F.concat(F.lit("the longest is "), -F.col("hops.m"), F.lit(" hops: "), "hops.url"),
        typos: F.concat("n_typos", F.lit(" words; the most, "), -F.col("typos.m"), F.lit(", on "), "typos.url"),
        titles: F.concat("n_titles", F.lit(" words")),
        alts: F.concat("alts", F.lit(" images")), eager: F.concat("eager", F.lit(" images")),
        heavy: F.concat("n_heavy", F.lit(" images; the heaviest, "), -F.col("heavy.m"), F.lit(" KB, on "), "heavy.url", F.when(F.col("skipped") > 0, F.concat(F.lit("; "), "sized", F.lit(" pages measured, "), "skipped", F.lit(" like them not"))).otherwise("")),
        thin: F.concat("thin", F.lit(" words on average")),
        no: F.when(F.col("by_header") > 0, F.concat("by_header", F.lit(" of them by the X-Robots-Tag header"))),
        reviews: F.concat(-F.col("reviews.m"), F.lit(" reviews claimed on "), "reviews.url"),
    }
    pairs = F.array(*(F.struct(F.lit(k).alias("issue"), v.alias("more")) for k, v in said.items()))
    return one.select(F.explode(pairs).alias("d")).select("d.*").filter("more is not null")


def joined_details(pages: DataFrame, links: DataFrame) -> DataFrame:
    """(issue, more) of the findings that need joins: groups and the largest, example links, the commonest anchors."""

    def groups(column: str, key: str) -> DataFrame:
        sizes = site.duplicate_groups(pages, column).groupBy("value").agg(F.max("group_size").alias("n"))
        return sizes.agg(F.count("*").alias("groups"), F.max("n").alias("most")).filter("groups > 0").select(F.lit(JOINED[key][2]).alias("issue"), F.concat("groups", F.lit(" groups, the largest of "), "most").alias("more"))

    def examples(rows: DataFrame, key: str, line: Column, order: list, top: int) -> DataFrame:
        few = rows.orderBy(*order).limit(top).select(line.alias("line"), F.struct(*order_keys(order)).alias("o"))
        return few.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o", "line"))), lambda x: x["line"]), "; ").alias("more")).filter("more <> ''").select(F.lit(JOINED[key][2]).alias("issue"), "more")

    def order_keys(order: list) -> list[Column]:
        return [F.col(c) for c in order]

    broken = site.broken_links(pages, links).groupBy("source").agg(F.count("*").alias("n"), F.min(F.struct("target", F.coalesce(F.col("status").cast("string"), F.lit("failed")).alias("status"))).alias("first")).withColumn("less", -F.col("n"))
    shown = F.concat("source", F.lit(" -> "), "first.target", F.lit(" ("), "first.status", F.lit(")"), F.when(F.col("n") > 1, F.concat(F.lit(" and "), F.col("n") - 1, F.lit(" more"))).otherwise(""))
    anchors = site.anchor_mismatch(pages, links).groupBy("anchor").agg(F.countDistinct("source").alias("n")).withColumn("less", -F.col("n"))
    parts = [
        groups("title", "title"), groups("meta_description", "description"), groups("content_hash", "content"),
        examples(broken, "broken", shown, ["source"], 5), examples(anchors, "anchors", F.concat(F.lit("'"), "anchor", F.lit("' on "), "n", F.lit(" pages")), ["less", "anchor"], 4),
    ]
    return reduce(DataFrame.unionByName, parts)


def gather(hits: DataFrame, details: DataFrame | None = None) -> DataFrame:
    """hits (severity, category, issue, part, why, url) as findings; details: (issue, more).

    A finding keeps its first URL_LIMIT urls and the number of all; row_number under
    a limit is cut before the shuffle too, so no task holds a finding's every url.
    """
    key = ["severity", "category", "issue", "part", "why"]
    rows = hits.distinct()
    totals = rows.groupBy(*key).agg(F.count("*").alias("total_count"))
    w = Window.partitionBy(*key).orderBy("url")
    some = rows.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= URL_LIMIT).groupBy(*key).agg(F.sort_array(F.collect_list("url")).alias("urls"))
    out = totals.join(some, key)
    detail = F.concat(F.format_string("%d pages", "total_count"), F.when(F.col("part") != "", F.concat(F.lit(", "), F.col("part"))).otherwise(""), F.when(F.col("total_count") > URL_LIMIT, F.format_string(" (showing first %d)", F.lit(URL_LIMIT))).otherwise(""))
    out = out.select("severity", "category", "issue", "urls", F.size("urls").alias("count"), "total_count", detail.alias("detail"), F.col("why").alias("why_it_matters"))
    if details is None:
        return out
    told = out.join(F.broadcast(details), "issue", "left")  # one row an issue
    return told.withColumn("detail", F.concat("detail", F.when(F.col("more").isNotNull(), F.concat(F.lit("; "), "more")).otherwise(""))).select(*out.columns)


def completed(pages: DataFrame) -> DataFrame:
    have = set(pages.columns)
    out = pages.withColumns({k: F.expr(v) for k, v in OPTIONAL.items() if k not in have})
    return out.withColumn("redirect_loop", site.is_redirect_loop(F.col("url"), F.col("status"), F.col("redirect_chain")))


def page_hits(pages: DataFrame) -> DataFrame:
    """Each rule's pages, in one scan."""
    struct = lambda r: F.struct(F.lit(r.severity).alias("severity"), F.lit(r.category).alias("category"), F.lit(r.issue).alias("issue"), F.lit("").alias("part"), F.lit(r.why).alias("why"))
    hits = F.array_compact(F.array(*(F.when(F.expr(r.when), struct(r)) for r in RULES)))
    return completed(pages).select("url", F.explode(hits).alias("r")).select("r.*", "url")


def joined_hits(pages: DataFrame, links: DataFrame) -> DataFrame:
    """The pages of findings that need other pages or the links."""

    def named(df: DataFrame, key: str, part: Column | None = None, severity: Column | None = None, url: str = "url") -> DataFrame:
        s, category, issue, why = JOINED[key]
        return df.select((severity if severity is not None else F.lit(s)).alias("severity"), F.lit(category).alias("category"), F.lit(issue).alias("issue"), (part if part is not None else F.lit("")).alias("part"), F.lit(why).alias("why"), F.col(url).alias("url"))

    dead = pages.filter("status between 400 and 499").select("url", "in_sitemap")
    worst = dead.agg(F.coalesce(F.bool_or("in_sitemap"), F.lit(False)).alias("listed"))
    exact = site.duplicate_groups(pages, "content_hash")
    parts = [
        named(dead.crossJoin(F.broadcast(worst)), "dead", severity=F.when(F.col("listed"), HIGH).otherwise(MED)),
        named(site.duplicate_groups(pages, "title"), "title"),
        named(site.duplicate_groups(pages, "meta_description"), "description"),
        named(exact, "content"),
        named(site.broken_links(pages, links), "broken", url="source"),
        named(site.links_to_redirects(pages, links), "moved", url="source"),
        named(site.orphans(pages), "orphans"),
        named(site.ghosts(pages), "ghosts"),
        named(site.hreflang_failures(pages.filter("indexable")), "hreflang"),
        named(site.merged_review_pools(pages).select("reviews", F.explode("urls").alias("url")), "pool", part=F.format_string("%d reviews each", "reviews")),
        named(site.anchor_mismatch(pages, links), "anchors", url="source"),
    ]
    if "simhash" in pages.columns:
        rest = pages.filter("indexable and simhash <> 0 and word_count >= 50").select("url", "simhash").join(exact.select("url"), "url", "left_anti")
        parts.append(named(dups.near_clusters(rest.withColumnRenamed("url", "id")), "near", url="id"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def findings(pages: DataFrame, links: DataFrame) -> DataFrame:
    """All findings, the gravest and largest first."""
    hits = store.written(page_hits(pages).unionByName(joined_hits(pages, links)), "hits")
    return gather(hits, page_details(pages).unionByName(joined_details(pages, links))).orderBy(severity_rank(F.col("severity")), F.desc("count"), "issue")


def status_class(status: Column) -> Column:
    return F.when(status > 0, F.concat(F.floor(status / 100).cast("int").cast("string"), F.lit("xx"))).otherwise("failed")


def site_stats(pages: DataFrame) -> DataFrame:
    """One row of totals."""
    listed = pages.agg(F.max(F.col("in_sitemap").cast("int")).alias("any"))
    return pages.crossJoin(F.broadcast(listed)).agg(
        F.count("*").alias("total_urls"), F.count_if("indexable").alias("indexable"), F.count_if(~F.col("indexable")).alias("non_indexable"), F.count_if("is_product").alias("products"),
        F.count_if(F.expr("in_sitemap and inlinks = 0 and status = 200 and discovered_by <> 'start'")).alias("orphans"),
        F.count_if(F.expr("any = 1 and not in_sitemap and indexable and inlinks > 0")).alias("ghosts"),
        F.floor(F.coalesce(F.sum(F.when(F.col("indexable"), F.col("word_count"))), F.lit(0)) / F.greatest(F.lit(1), F.count_if("indexable"))).alias("avg_word_count"),
    )


def status_counts(pages: DataFrame) -> DataFrame:
    return pages.groupBy(status_class(F.col("status")).alias("status_class")).agg(F.count("*").alias("n"))


def category_share(found: DataFrame, total: Column | int) -> DataFrame:
    """(category, pages, rate): how many pages a category's findings name."""
    n = found.select("category", F.explode("urls").alias("url")).groupBy("category").agg(F.countDistinct("url").alias("pages"))
    t = total if isinstance(total, Column) else F.lit(total)
    return n.withColumn("rate", F.when(t > 0, F.concat(F.bround(F.col("pages") * 100 / t).cast("bigint").cast("string"), F.lit("%"))).otherwise("0%"))


def diff(now: DataFrame, before: DataFrame) -> DataFrame:
    """(change, severity, label, was, now) between two audits' findings; one row a finding key that changed."""
    key = lambda df, n: df.select(F.concat_ws("|", "category", "issue").alias("label"), "severity", F.col("count").alias(n)).groupBy("label").agg(F.max_by("severity", n).alias(f"severity_{n}"), F.max(n).alias(n))
    both = key(now, "now").join(key(before, "was"), "label", "full")
    change = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "fixed").when(F.col("now") > F.col("was"), "worsened").when(F.col("now") < F.col("was"), "improved")
    return both.select(change.alias("change"), F.coalesce("severity_now", "severity_was").alias("severity"), "label", F.coalesce("was", F.lit(0)).alias("was"), F.coalesce("now", F.lit(0)).alias("now")).filter("change is not null")


def diff_urls(now: DataFrame, before: DataFrame) -> DataFrame:
    """(change, label) for urls that one crawl has and the other has not."""
    a, b = now.select("url"), before.select("url")
    return a.subtract(b).select(F.lit("new url").alias("change"), F.col("url").alias("label")).unionByName(b.subtract(a).select(F.lit("removed url").alias("change"), F.col("url").alias("label")))


def psi_findings(psi: DataFrame) -> DataFrame:
    """Findings from field and lab metrics; a field value of 0 counts as missing."""
    v = lambda field, lab: F.coalesce(F.when(F.col(field) != 0, F.col(field)), F.col(lab))
    rules = [
        (HIGH, "LCP above 2.5s", v("field_lcp_ms", "lcp_ms") > 2500), (MED, "CLS above 0.1", v("field_cls", "cls") > 0.1), (MED, "INP above 200ms (field data)", F.col("field_inp_ms") > 200),
        (MED, "Total Blocking Time above 200ms", F.col("tbt_ms") > 200), (MED, "Low PageSpeed performance score", F.col("performance_score") < 0.9), (HIGH, "Failing Core Web Vitals with real users", F.col("field_overall") == "SLOW"),
    ]
    struct = lambda s, i: F.struct(F.lit(s).alias("severity"), F.lit("performance").alias("category"), F.lit(i).alias("issue"))
    hits = psi.filter("error is null").select("url", F.explode(F.array_compact(F.array(*(F.when(c, struct(s, i)) for s, i, c in rules)))).alias("r"))
    return hits.select("r.*", "url")


def psi_details(psi: DataFrame) -> DataFrame:
    """(issue, more): the worst page of each metric; at equal values the first url."""
    lcp, cls = (F.coalesce(F.when(F.col(f) != 0, F.col(f)), F.col(lab)) for f, lab in (("field_lcp_ms", "lcp_ms"), ("field_cls", "cls")))
    worst = {"LCP above 2.5s": (-lcp, "%.0f ms"), "CLS above 0.1": (-cls, "%.3f"), "Total Blocking Time above 200ms": (-F.col("tbt_ms"), "%.0f ms"), "Low PageSpeed performance score": (F.col("performance_score"), "%.2f")}
    one = psi.filter("error is null").agg(*(F.min(F.when(m.isNotNull(), F.struct(m.alias("m"), "url"))).alias(f"w{i}") for i, (m, _) in enumerate(worst.values())))
    pairs = F.array(*(F.struct(F.lit(k).alias("issue"), F.concat(F.lit("the worst, "), F.format_string(f, F.abs(f"w{i}.m")), F.lit(", on "), f"w{i}.url").alias("more")) for i, (k, (_, f)) in enumerate(worst.items())))
    return one.select(F.explode(pairs).alias("d")).select("d.*").filter("more is not null")


def psi_targets(pages: DataFrame, top: int = 10) -> DataFrame:
    """The pages to measure: the most linked, then the shallowest."""
    return pages.filter("indexable").orderBy(F.desc("inlinks"), F.size(urls.segments(F.col("url"))), "url").select("url", "inlinks").limit(top)
