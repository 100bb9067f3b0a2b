"""From raw pages to the page table and the link table.

One Arrow pass parses each page once and returns what is on it (facts); everything
that judges those facts is Column expressions, so that unused judgements are pruned
and thresholds stay parameters of the plan.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import dom, text, urls

from . import store

# Where the main content is looked for, what a rendered review looks like, headings of templates.
REVIEW_TOKENS = {"jdgm-rev", "spr-review", "review-item", "review__item", "review-card", "loox-review", "yotpo-review", "okendo-review", "stamped-review", "r--review"}
REVIEW_PREFIXES = ("jdgm-rev--", "review-item--", "review__item--")
REVIEW_WIDGET = re.compile(r"(jdgm|spr-review|spr-content|loox|yotpo|okendo|stamped|reviews?-(widget|list|section|container)|product-reviews)", re.I)
FURNITURE = ["featured collections", "you may also like", "related products", "recently viewed", "customer reviews", "share", "newsletter", "follow us", "shop the look", "you might also like", "more like this"]
LIST_PRICES = {"strikethroughprice", "listprice", "msrp", "recommendedretailprice"}
HREFLANG = r"(?i)^(x-default|[a-z]{2,3}(-[a-z]{4})?(-([a-z]{2}|\d{3}))?)$"
TITLE_RANGE, DESCRIPTION_RANGE, THIN_WORDS = (30, 60), (70, 155), 250
THUMBNAIL_PX, LARGE_PX, LARGE_SRCSET, VIEWPORT_PX = 120, 300, 800, 1280

MAIN = (
    lambda e: e.tag == "main",
    lambda e: e.attrs.get("id") == "MainContent",
    lambda e: e.attrs.get("id") == "main",
    lambda e: e.attrs.get("role") == "main",
    lambda e: "shopify-section--main-product" in e.classes(),
    lambda e: e.tag == "article",
    lambda e: e.attrs.get("id") == "content",
)
CHROME = frozenset(["nav", "header", "footer", "aside", "form"])


def main_content(root: dom.Element) -> tuple[dom.Element, frozenset[str]]:
    """The element with the page's own content, and tags in it that are not."""
    everything = list(root.walk())
    for test in MAIN:
        first = next((e for e in everything if test(e)), None)
        if first is not None and len(first.text("")) > 100:
            return first, frozenset()
    return next((e for e in everything if e.tag == "body"), root), CHROME


def _as_list(x: object) -> list:
    return x if isinstance(x, list) else [] if x is None else [x]


def _types(node: dict) -> list[str]:
    return [str(t).rsplit("/", 1)[-1] for t in _as_list(node.get("@type") or node.get("type"))]


def price_of(x: object) -> str | None:
    if x is None or isinstance(x, bool):
        return None
    if not isinstance(x, (int, float)):
        m = re.search(r"\d+(?:\.\d+)?", str(x).replace(",", ""))
        if not m:
            return None
        x = float(m[0])
    return re.sub(r"\.?0+$", "", f"{x:.2f}") if "." in f"{x:.2f}" else f"{x:.2f}"


def linked_data(root: dom.Element) -> list[dict]:
    """JSON-LD nodes: arrays and graphs flattened, blocks that don't parse left out."""
    out: list[dict] = []
    for script in root.find_all("script"):
        if "ld+json" not in script.attrs.get("type", "").lower():
            continue
        try:
            todo = [json.loads("".join(c for c in script.children if isinstance(c, str)))]
        except (ValueError, RecursionError):
            continue
        while todo:
            x = todo.pop(0)
            if isinstance(x, list):
                todo[:0] = x
            elif isinstance(x, dict):
                if any(k != "@graph" for k in x):
                    out.append(x)
                todo[:0] = _as_list(x.get("@graph"))
    return out


def product_facts(nodes: list[dict]) -> dict:
    named = lambda *t: [n for n in nodes if {x.lower() for x in _types(n)} & set(t)]
    todo, products = named("product") + named("productgroup"), []
    while todo:
        n = todo.pop(0)
        if not any(n is p for p in products):
            products.append(n)
            todo += [v for v in _as_list(n.get("hasVariant")) if isinstance(v, dict)]
    now: dict[str, None] = {}
    listed: dict[str, None] = {}
    out: dict = {"currency": None, "availability": None, "rating": None, "reviews": None, "name": None, "group_id": None, "variants": 0}
    for g in named("productgroup"):
        for k in ("productGroupID", "@id"):
            if out["group_id"] is None and isinstance(g.get(k), str) and g[k].strip():
                out["group_id"] = g[k].strip()
    for p in products:
        if out["name"] is None and isinstance(p.get("name"), str):
            out["name"] = p["name"].strip()
        out["variants"] += len(_as_list(p.get("hasVariant")))
        for offer in _as_list(p.get("offers")):
            if not isinstance(offer, dict):
                continue
            now.update(dict.fromkeys(x for k in ("price", "lowPrice", "highPrice") if (x := price_of(offer.get(k)))))
            currency = None
            for spec in _as_list(offer.get("priceSpecification")):
                if isinstance(spec, dict) and (x := price_of(spec.get("price"))):
                    (listed if str(spec.get("priceType") or "").rsplit("/", 1)[-1].lower() in LIST_PRICES else now)[x] = None
                    currency = currency or (spec["priceCurrency"] if isinstance(spec.get("priceCurrency"), str) else None)
            if currency is None and isinstance(offer.get("priceCurrency"), str):
                currency = offer["priceCurrency"]
            out["currency"] = out["currency"] or currency
            if isinstance(offer.get("availability"), str):
                out["availability"] = out["availability"] or offer["availability"].rsplit("/", 1)[-1]
        for a in _as_list(p.get("aggregateRating")):
            if isinstance(a, dict):
                out["rating"] = out["rating"] or price_of(a.get("ratingValue"))
                for k in ("reviewCount", "ratingCount"):
                    if (x := price_of(a.get(k))) is not None:
                        out["reviews"] = max(out["reviews"] or 0, int(float(x)))
    return out | {"types": list(dict.fromkeys(t for n in nodes for t in _types(n))), "prices": list(now), "list_prices": list(listed)}


def is_review(e: dom.Element) -> bool:
    return any(c in REVIEW_TOKENS or c.startswith(REVIEW_PREFIXES) for c in map(str.lower, e.classes())) or e.attrs.get("itemprop", "").lower() == "review"


def _source(img: dom.Element) -> str:
    a = img.attrs
    srcset = a.get("srcset") or a.get("data-srcset") or ""
    return (a.get("src") or a.get("data-src") or srcset.split(",")[0].strip().split(" ")[0]).strip()


def facts(url: str, html: str) -> dict:
    """What is on a page, unjudged; references are made absolute."""
    root = dom.parse(html)
    content, apart = main_content(root)
    at = lambda ref: urljoin(url, ref.strip())
    head = {e.tag: e for e in reversed(list(root.walk())) if e.tag in ("html", "title")}
    metas: dict[str, str] = {}
    for m in root.find_all("meta"):
        for k in ("property", "name"):
            if m.attrs.get(k) and m.attrs.get("content", "").strip():
                metas.setdefault(f"{k}:{m.attrs[k].strip().lower()}", m.attrs["content"].strip())
    links = [(e.attrs.get("rel", "").lower().split(), e.attrs) for e in root.find_all("link")]
    inner = [e for e in content.walk() if not any(p.tag in apart for p in _up_to(e, content))]
    headings = [(e, int(e.tag[1])) for e in root.walk() if e.tag in ("h1", "h2", "h3", "h4", "h5", "h6")]
    anchors = []
    for a in root.find_all("a"):
        href = a.attrs.get("href", "").strip()
        if not href or href.startswith("#") or href.lower().startswith(("mailto:", "tel:", "javascript:")):
            continue
        anchor = a.text() or next((i.attrs.get("alt", "").strip() for i in a.find_all("img")), "")
        anchors.append({"href": at(href), "anchor": anchor[:200], "rel": a.attrs.get("rel", "").lower()})
    item = next((p for e in root.walk() if e.attrs.get("itemprop", "").lower() == "price" and (p := price_of(e.attrs.get("content") or e.text()))), None)
    widget = lambda e: is_review(e) or bool(REVIEW_WIDGET.search(f"{' '.join(e.classes())} {e.attrs.get('id', '')}"))
    skip = dom.RAW | apart
    body = " ".join(content.text(skip=skip).split())
    return {
        "html_lang": head["html"].attrs.get("lang", "").strip().lower() or None if "html" in head else None,
        "title": head["title"].text() or None if "title" in head else None,
        "metas": [{"k": k, "v": v} for k, v in metas.items()],
        "canonicals": [at(a["href"]) if a.get("href", "").strip() else "" for rel, a in links if "canonical" in rel],
        "alternates": [{"lang": a["hreflang"].strip(), "href": at(a["href"])} for rel, a in links if "alternate" in rel and "hreflang" in a and "href" in a],
        "headings": [{"level": n, "text": e.text()} for e, n in headings],
        "subheadings": [t for e in inner if e.tag in ("h2", "h3") and (t := e.text())],
        "body": body,
        "spell_text": " ".join(content.text(skip=skip, drop=widget).split()),
        "images": [
            {"src": at(s) if (s := _source(e)) else None, "alt": e.attrs.get("alt"), "loading": e.attrs.get("loading", "").strip().lower(), "priority": e.attrs.get("fetchpriority", "").strip().lower(),
             "srcset": e.attrs.get("srcset") or e.attrs.get("data-srcset"), "sizes": e.attrs.get("sizes"), "width": e.attrs.get("width")}
            for e in inner if e.tag == "img"
        ],
        "anchors": anchors,
        "item_price": item,
        "review_blocks": sum(is_review(e) for e in root.walk()),
        "product": product_facts(linked_data(root)),
    }


def _up_to(e: dom.Element, top: dom.Element) -> Iterator[dom.Element]:
    while e is not None and e is not top:
        yield e
        e = e.parent


FACTS = (
    "struct<html_lang:string,title:string,metas:array<struct<k:string,v:string>>,canonicals:array<string>,alternates:array<struct<lang:string,href:string>>,"
    "headings:array<struct<level:int,text:string>>,subheadings:array<string>,body:string,spell_text:string,"
    "images:array<struct<src:string,alt:string,loading:string,priority:string,srcset:string,sizes:string,width:string>>,anchors:array<struct<href:string,anchor:string,rel:string>>,"
    "item_price:string,review_blocks:int,product:struct<currency:string,availability:string,rating:string,reviews:int,name:string,group_id:string,variants:int,types:array<string>,prices:array<string>,list_prices:array<string>>>"
)


def read_facts(pages: DataFrame) -> DataFrame:
    """pages (url, html and any others) with f, the facts, and parse_error, in place of columns of these names; both null for other content."""
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    store.prepare(pages.sparkSession)
    pages = pages.drop("f", "parse_error")
    u, h = pages.columns.index("url"), pages.columns.index("html")
    kind = to_arrow_type(_parse_datatype_string(FACTS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, errors = [], []
            for url, html in zip(batch.column(u).to_pylist(), batch.column(h).to_pylist(), strict=True):
                try:
                    found.append(None if html is None else facts(url or "", html))
                    errors.append(None)
                except Exception as e:  # a page that breaks the parser is a row with an error
                    found.append(None)
                    errors.append(f"parse error: {e}")
            yield pa.record_batch([*batch.columns, pa.array(found, kind), pa.array(errors, pa.string())], names=[*batch.schema.names, "f", "parse_error"])

    fields = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in pages.schema)
    return pages.mapInArrow(run, f"{fields}, f {FACTS}, parse_error string")


# judgements


def meta(*keys: str) -> Column:
    """The first of these metas that is there; a key is name:... or property:..."""

    def first(k: str) -> Column:
        return F.get(F.filter("f.metas", lambda m: m["k"] == k), F.lit(0))["v"]

    return F.coalesce(*map(first, keys))


def length_issue(value: Column, limits: tuple[int, int]) -> Column:
    n = F.length(value)
    return F.when(F.coalesce(n, F.lit(0)) == 0, "missing").when(n < limits[0], "too short").when(n > limits[1], "too long").otherwise("")


def robots_words(*sources: Column) -> Column:
    return F.flatten(F.array(*(F.split(F.lower(F.coalesce(s, F.lit(""))), r"[,\s]+") for s in sources)))


def heading_issues(headings: Column) -> Column:
    """Levels that skip a rank, in order, each once; first of all a page that begins with no h1."""
    levels = F.transform(headings, lambda h: h["level"])
    walked = F.aggregate(
        levels,
        F.struct(F.lit(0).alias("deepest"), F.array().cast("array<string>").alias("found")),
        lambda a, n: F.struct(
            F.greatest(a["deepest"], n).alias("deepest"),
            F.when((a["deepest"] > 0) & (n > a["deepest"] + 1), F.array_append(a["found"], F.format_string("h%d appears before any h%d", n, n - 1))).otherwise(a["found"]).alias("found"),
        ),
    )["found"]
    first = F.get(levels, F.lit(0))
    begin = F.when(first != 1, F.array(F.format_string("first heading is h%d, not h1", first))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(begin, walked))


def sizes_width(sizes: Column) -> Column:
    """struct<px, relative>: the largest width of a sizes attribute, and whether any depends on the viewport."""
    clauses = F.transform(F.split(sizes, ","), lambda c: F.trim(F.element_at(F.split(c, r"\)"), -1)))
    number = lambda c: F.regexp_extract(c, r"(?i)([\d.]+)\s*(px|vw|em|rem)\b", 1).try_cast("double")
    unit = lambda c: F.lower(F.regexp_extract(c, r"(?i)([\d.]+)\s*(px|vw|em|rem)\b", 2))
    px = F.transform(clauses, lambda c: F.when(unit(c) == "vw", number(c) / 100 * VIEWPORT_PX).when(unit(c).isin("em", "rem"), number(c) * 16).when(unit(c) == "px", number(c)))
    return F.struct(F.array_max(px).alias("px"), F.coalesce(F.exists(clauses, lambda c: unit(c) == "vw"), F.lit(False)).alias("relative"))


def srcset_width(srcset: Column) -> Column:
    return F.array_max(F.regexp_extract_all(srcset, F.lit(r"(\d+)w"), F.lit(1)).cast("array<int>"))


def image_roles(images: Column) -> Column:
    """The images with their place, width and role: the first large one is the hero."""
    def judged(i: Column, n: Column) -> Column:
        given = sizes_width(i["sizes"])
        width = F.coalesce(given["px"], F.when(i["width"].rlike(r"^\s*\d+(px)?\s*$"), F.regexp_extract(i["width"], r"(\d+)", 1).try_cast("double")))
        widest = srcset_width(i["srcset"])
        small = F.coalesce(width <= THUMBNAIL_PX, F.lit(False))
        large = ~small & ((given["px"].isNotNull() & given["relative"]) | F.coalesce(width >= LARGE_PX, F.lit(False)) | (width.isNull() & F.coalesce(widest >= LARGE_SRCSET, F.lit(False))))
        return F.struct(
            n.alias("place"), i["src"].alias("src"), width.alias("px"), large.alias("large"), (i["loading"] == "lazy").alias("lazy"), i["priority"].alias("priority"), F.coalesce(i["srcset"] != "", F.lit(False)).alias("has_srcset"),
            F.when(small, "thumbnail").when(large, "large").when(width.isNull(), "unknown").otherwise("thumbnail").alias("role"),
        )

    return F.transform(images, judged)


def hero_place(roles: Column) -> Column:
    return F.array_min(F.transform(F.filter(roles, lambda r: r["large"]), lambda r: r["place"]))


def price_signals() -> tuple[Column, dict[str, Column]]:
    """array<struct<source, price>> of what a page says it costs, and the parts."""
    parts = {p: text.price_text(meta(f"property:{p}", f"name:{p}")) for p in ("og:price:amount", "og:price:standard_amount", "product:price:amount", "product:sale_price:amount")}
    parts["itemprop:price"] = F.col("f.item_price")
    prices = F.col("f.product.prices")
    order = F.array_sort(prices, lambda a, b: F.when(a.cast("double") < b.cast("double"), -1).when(a.cast("double") > b.cast("double"), 1).otherwise(0))
    parts["jsonld:offers.price"] = F.when(F.size(prices) == 1, prices[0]).when(F.size(prices) > 1, F.concat(order[0], F.lit("-"), F.element_at(order, -1)))
    parts["jsonld:listPrice"] = F.get(F.col("f.product.list_prices"), F.lit(0))
    return F.array_compact(F.array(*(F.when(v.isNotNull() & (v != ""), F.struct(F.lit(k).alias("source"), v.alias("price"))) for k, v in parts.items()))), parts


def price_consistent(current: Column, offers: Column, standard: Column, sale: Column) -> Column:
    """current: the prices that metas and microdata give as today's; offers: those of JSON-LD."""
    now = F.array_distinct(F.filter(current, lambda p: p.isNotNull()))
    agree = F.size(now) <= 1
    met = agree & ((F.size(now) == 0) | (F.size(offers) == 0) | F.arrays_overlap(now, offers))
    live = F.array_union(now, offers)
    odd = standard.isNotNull() & (F.size(live) > 0) & ~F.array_contains(live, F.coalesce(standard, F.lit(""))) & sale.isNull()
    return met & ~odd


def review_suspicious(claimed: Column, shown: Column, ratio: float = 3.0, least: int = 10) -> Column:
    return F.when(claimed.isNull() | (claimed < least), False).when(shown == 0, True).otherwise(claimed / shown >= ratio)


def review_reason(claimed: Column, shown: Column, ratio: float = 3.0, least: int = 10) -> Column:
    """Why reviews are suspicious; null where they are not."""
    times = F.format_string("%d reviews claimed, %d on the page (%.1f times)", claimed, shown, claimed / shown)
    return F.when(review_suspicious(claimed, shown, ratio, least), F.when(shown == 0, F.format_string("%d reviews claimed, none on the page", claimed)).otherwise(times))


def is_furniture(heading: Column, phrases: list[str] = FURNITURE) -> Column:
    t = F.regexp_replace(F.lower(F.trim(F.regexp_replace(heading, r"\s+", " "))), ":+$", "")
    return F.exists(F.array(*map(F.lit, phrases)), lambda p: (t == p) | F.startswith(t, F.concat(p, F.lit(" "))))


#: Names that the page table uses on the way.
STEPS = {"html", "f", "parse_error", "roles", "alternates", "subheads", "robots_source", "hero"}


def page_table(pages: DataFrame, lang: str = "en", furniture: list[str] = FURNITURE) -> DataFrame:
    """The page table of (url, html) with whatever the crawl knows.

    Columns that a crawl gives are used if there: status, x_robots_tag, in_sitemap,
    discovered_by, depth, redirect_chain, error, size_bytes, response_ms.  Other columns
    are kept, but for those whose names (in any case) the table makes itself or its steps use.
    """
    have = set(pages.columns)
    given = lambda name, default: F.col(name) if name in have else default
    p = read_facts(pages)
    url = F.col("url")
    canonical = F.get("f.canonicals", F.lit(0))
    target = F.when(canonical != "", urls.normalize(canonical))
    robots, header = meta("name:robots", "name:googlebot"), given("x_robots_tag", F.lit(None).cast("string"))
    words = robots_words(robots, header)
    alternates = F.transform("f.alternates", lambda a: F.struct(a["lang"].alias("lang"), urls.normalize(a["href"]).alias("href")))
    roles = image_roles(F.col("f.images"))
    signals, parts = price_signals()
    h1 = F.filter("f.headings", lambda h: h["level"] == 1)
    content = text.content_words(F.col("f.body"))
    og, viewport = meta("property:og:image", "name:og:image"), meta("name:viewport")
    social = {"viewport": viewport, "og:title": meta("property:og:title", "name:og:title"), "og:image": og, "twitter:card": meta("name:twitter:card", "property:twitter:card")}
    currencies = F.array_distinct(F.array_compact(F.array(*(F.upper(c) for c in (meta("property:og:price:currency", "name:og:price:currency"), meta("property:product:price:currency", "name:product:price:currency"), F.col("f.product.currency"))))))
    links = F.transform("f.anchors", lambda a: F.struct(urls.normalize(a["href"]).alias("target"), a["anchor"].alias("anchor"), a["rel"].rlike("nofollow|sponsored|ugc").alias("nofollow")))
    links = F.filter(links, lambda a: urls.is_crawlable(a["target"]))
    p = p.withColumns({
        "status": given("status", F.lit(200)), "error": F.coalesce(given("error", F.lit(None).cast("string")), F.col("parse_error")),
        "in_sitemap": given("in_sitemap", F.lit(False)), "discovered_by": given("discovered_by", F.lit("link")), "depth": given("depth", F.lit(0)),
        "redirect_chain": given("redirect_chain", F.array().cast("array<string>")),
        "roles": roles, "links": links, "alternates": alternates, "content": content, "subheads": F.col("f.subheadings"),
        "title": F.col("f.title"), "meta_description": meta("name:description"),
        "canonical": target, "noindex": F.arrays_overlap(words, F.array(F.lit("noindex"), F.lit("none"))), "nofollow": F.arrays_overlap(words, F.array(F.lit("nofollow"), F.lit("none"))),
        "robots_source": F.concat_ws("+", F.when(robots.isNotNull(), "meta"), F.when(F.coalesce(header, F.lit("")) != "", "header")),
        "prices": signals,
    })
    hero = hero_place(F.col("roles"))
    p = p.withColumn("hero", hero).withColumn("h1", F.get(h1, F.lit(0))["text"])
    state = F.when(F.col("canonical").isNull(), "missing").when(~urls.same_site(F.col("canonical"), url), "cross-domain").when(urls.dedupe_key(F.col("canonical")) == urls.dedupe_key(url), "self").otherwise("other")
    made = [
        "status", "error", "in_sitemap", "discovered_by", "depth", "redirect_chain", F.size("redirect_chain").alias("redirect_hops"),
        "title", F.coalesce(F.length("title"), F.lit(0)).alias("title_length"), length_issue(F.col("title"), TITLE_RANGE).alias("title_issue"),
        "meta_description", F.coalesce(F.length("meta_description"), F.lit(0)).alias("meta_description_length"), length_issue(F.col("meta_description"), DESCRIPTION_RANGE).alias("meta_description_issue"),
        "canonical", state.alias("canonical_state"), "noindex", "nofollow", F.when(F.col("robots_source") != "", F.col("robots_source")).alias("robots_directive_source"),
        viewport.alias("viewport"), og.alias("og_image"), F.array_compact(F.array(*(F.when(v.isNull(), F.lit(k)) for k, v in social.items()))).alias("missing_social"),
        F.col("alternates").alias("hreflang"), F.exists("alternates", lambda a: F.lower(a["lang"]) == "x-default").alias("hreflang_x_default"),
        F.exists("alternates", lambda a: a["href"] == urls.normalize(url)).alias("hreflang_self"), F.transform(F.filter("alternates", lambda a: ~a["lang"].rlike(HREFLANG)), lambda a: a["lang"]).alias("hreflang_invalid"),
        F.size(h1).alias("h1_count"), "h1", F.size(F.filter("f.headings", lambda h: h["level"] == 2)).alias("h2_count"), heading_issues(F.col("f.headings")).alias("heading_issues"),
        F.size("content").alias("word_count"), (F.size("content") < THIN_WORDS).alias("thin_content"), text.content_hash(F.col("content")).alias("content_hash"), "content",
        F.size("f.images").alias("image_count"), F.size(F.filter("f.images", lambda i: i["alt"].isNull())).alias("images_missing_alt"),
        F.array_distinct(F.transform(F.filter("f.images", lambda i: i["src"].isNotNull()), lambda i: urls.normalize(i["src"]))).alias("image_sources"),
        F.get("roles", F.col("hero"))["src"].alias("hero_image"), F.coalesce(F.get("roles", F.col("hero"))["lazy"], F.lit(False)).alias("hero_lazy"),
        F.coalesce(F.get("roles", F.col("hero"))["priority"] == "high", F.lit(False)).alias("fetchpriority_present"), F.size(F.filter("roles", lambda r: r["lazy"])).alias("imgs_lazy_count"),
        F.when(F.col("hero").isNull(), 0).otherwise(F.size(F.filter("roles", lambda r: (r["place"] > F.col("hero")) & ~r["lazy"]))).alias("imgs_eager_belowfold_count"),
        F.transform(F.filter("roles", lambda r: r["large"] & ~r["has_srcset"] & r["src"].isNotNull()), lambda r: r["src"]).alias("imgs_large_no_srcset"),
        F.filter("subheads", lambda h: is_furniture(h, furniture)).alias("furniture_headings"), F.filter("subheads", lambda h: ~is_furniture(h, furniture)).alias("content_headings"),
        "links", F.size(F.filter("links", lambda a: urls.same_site(a["target"], url))).alias("internal_links"), F.size(F.filter("links", lambda a: ~urls.same_site(a["target"], url))).alias("external_links"), F.size(F.filter("links", lambda a: a["nofollow"])).alias("nofollow_links"),
        urls.hygiene(url, F.col("canonical").isNotNull()).alias("url_flags"), F.size(urls.segments(url)).alias("path_depth"), urls.page_type(url).alias("page_type"),
        F.col("f.product.types").alias("schema_types"), F.col("f.product.name").alias("product_name"), "prices",
        price_consistent(F.array(parts["og:price:amount"], parts["product:price:amount"], parts["product:sale_price:amount"], parts["itemprop:price"]), F.col("f.product.prices"), parts["og:price:standard_amount"], parts["product:sale_price:amount"]).alias("price_consistent"),
        (F.size(currencies) <= 1).alias("currency_consistent"), (F.arrays_overlap("f.product.types", F.array(F.lit("Product"), F.lit("ProductGroup"))) | (F.size("prices") > 0)).alias("is_product"),
        F.col("f.product.availability").alias("availability"), F.col("f.product.group_id").alias("product_group_id"), F.col("f.product.rating").alias("rating_value"),
        F.col("f.product.reviews").alias("review_schema_count"), F.col("f.review_blocks").alias("review_onpage_count"), review_suspicious(F.col("f.product.reviews"), F.col("f.review_blocks")).alias("review_suspicious"), review_reason(F.col("f.product.reviews"), F.col("f.review_blocks")).alias("review_reason"),
        (F.coalesce(F.substring_index("f.html_lang", "-", 1), F.lit(lang)) != lang).alias("spellcheck_skipped"), F.col("f.spell_text").alias("spell_text"), F.col("f.body").alias("body"),
    ]
    own = {c.lower() for c in p.select(*made).columns} | STEPS
    out = p.select(*(f"`{c}`" for c in pages.columns if c.lower() not in own), *made)
    total, furnished = F.size("furniture_headings") + F.size("content_headings"), F.size("furniture_headings")
    unmarked = (total > 0) & (furnished / total >= 0.5) & (total <= 3) & (F.size("content_headings") < 5)
    indexable = (F.col("status") == 200) & ~F.coalesce("noindex", F.lit(False)) & F.col("canonical_state").isin("self", "missing") & F.col("error").isNull()
    return out.withColumns({"unmarked_content_sections": F.coalesce(unmarked, F.lit(False)), "indexable": F.coalesce(indexable, F.lit(False))})


def link_table(pages: DataFrame) -> DataFrame:
    """(source, target, anchor, internal, nofollow): one row for each link, repeats kept."""
    return pages.select(F.col("url").alias("source"), F.explode("links").alias("l")).select("source", "l.target", "l.anchor", urls.same_site(F.col("l.target"), F.col("source")).alias("internal"), "l.nofollow")
