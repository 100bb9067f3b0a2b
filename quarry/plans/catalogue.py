"""Queries over the driver's tables, one or more for each operator, with their SQL.

The tables hold no crawl, so site() lays one over pages: normalized URLs, and statuses,
redirects and sitemap membership that follow from page_id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text, urls
from quarry.operators import dups, extract, findings, keywords, report, site, spelling, store
from quarry.sources import psi
from quarry.streaming import incremental

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# what several queries share: a crawl over pages, as a plan and as SQL


def crawled(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").withColumn("url", urls.normalize(F.col("url")))
    first = p.groupBy("url").agg(F.min("page_id").alias("page_id")).select("page_id")  # ids are dealt, not html
    p = p.join(first, "page_id", "left_semi")
    k = F.col("page_id")
    status = F.when(k % 31 == 7, F.lit(None)).when(k % 23 == 5, 404).when(k % 29 == 3, 500).otherwise(200).cast("int")
    first, second = F.concat(F.lit("301 -> "), "url", F.lit("/moved")), F.concat(F.lit("302 -> "), F.when(k % 2 == 0, F.col("url")).otherwise(F.concat("url", F.lit("/again"))))
    chain = F.when(k % 11 == 5, F.array(first, second)).when(k % 7 == 3, F.array(first)).otherwise(F.array().cast("array<string>"))
    return p.withColumns({
        "status": status, "error": F.when(status.isNull(), "timeout"), "redirect_chain": chain, "in_sitemap": k % 3 == 0,
        "discovered_by": F.when(k == 0, "start").otherwise("link"), "depth": (k % 5).cast("int"),
    })


def page_table(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(pages with inlinks, links); the pages are parsed once and written."""
    pages = store.written(extract.page_table(crawled(spark, sf_dir)), "pages")
    links = extract.link_table(pages)
    return site.inlinks(pages, links), links


def _sql_scheme(u: str) -> str:
    return f"lower(regexp_extract({u}, '^([A-Za-z][A-Za-z0-9+.-]*):', 1))"


def _sql_host(u: str) -> str:
    return f"lower(regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1))"


def _sql_path(u: str) -> str:
    return f"regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"


def _sql_query(u: str) -> str:
    return f"regexp_extract({u}, '^[^?#]*[?]([^#]*)', 1)"


def _sql_normal(u: str) -> str:
    tracking = ", ".join(f"'{t}'" for t in urls.TRACKING)
    path = f"regexp_replace({_sql_path(u)}, '/+', '/', 'g')"
    path = f"CASE WHEN {path} IN ('', '/') THEN '/' ELSE regexp_replace({path}, '/+$', '') END"
    pairs = f"list_sort(list_filter(string_split({_sql_query(u)}, '&'), lambda p: p <> '' AND lower(string_split(p, '=')[1]) NOT IN ({tracking})))"
    query_ = f"array_to_string(list_transform({pairs}, lambda p: CASE WHEN contains(p, '=') THEN p ELSE p || '=' END), '&')"
    return f"({_sql_scheme(u)} || '://' || {_sql_host(u)} || ({path}) || CASE WHEN {query_} = '' THEN '' ELSE '?' || {query_} END)"


def _sql_unescape(c: str) -> str:
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "''"), ("&#39;", "''"), ("&amp;", "&")):
        c = f"replace({c}, '{a}', '{b}')"
    return c


_TITLE = f"trim(regexp_replace({_sql_unescape(chr(34) + 't' + chr(34))}, '\\s+', ' ', 'g'))"
SITE_SQL = f"""
WITH named AS (SELECT page_id, {_sql_normal('url')} AS url, html FROM pages),
crawl AS (SELECT url, min(page_id) AS page_id, arg_min(html, page_id) AS html FROM named GROUP BY url),
site AS (
  SELECT url, page_id, html, CASE WHEN page_id % 31 = 7 THEN NULL WHEN page_id % 23 = 5 THEN 404 WHEN page_id % 29 = 3 THEN 500 ELSE 200 END AS status,
         CASE WHEN page_id % 11 = 5 THEN ['301 -> ' || url || '/moved', '302 -> ' || url || CASE WHEN page_id % 2 = 0 THEN '' ELSE '/again' END] WHEN page_id % 7 = 3 THEN ['301 -> ' || url || '/moved'] ELSE [] END AS chain,
         page_id % 3 = 0 AS in_sitemap, CASE WHEN page_id = 0 THEN 'start' ELSE 'link' END AS discovered_by, (page_id % 5)::INT AS depth,
         {_sql_unescape("regexp_extract(html, '<title>([^<]*)</title>', 1)")} AS title0 FROM crawl),
audited AS (
  SELECT *, nullif(trim(title0), '') AS title, coalesce(status = 200, false) AS indexable FROM site),
raw_links AS (
  SELECT url AS source, unnest(regexp_extract_all(html, '<a href="([^"]*)">[^<]*</a>', 1)) AS href, unnest(regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1)) AS text FROM site),
abs_links AS (
  SELECT source, {_sql_scheme('source')} || '://' || {_sql_host('source')} || {_sql_unescape('href')} AS href, trim({_sql_unescape('text')}) AS anchor FROM raw_links),
links AS (
  SELECT source, {_sql_normal('href')} AS target, anchor[:200] AS anchor, true AS internal, false AS nofollow FROM abs_links),
counted AS (
  SELECT a.*, coalesce(n, 0) AS inlinks FROM audited a LEFT JOIN (SELECT target, count(*) AS n FROM links WHERE target <> source GROUP BY target) i ON i.target = a.url)
"""


# URLs


@query(f"SELECT page_id, {_sql_normal('url')} AS normal FROM pages")
def url_normalize(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.normalize(F.col("url")).alias("normal"))


@query(f"SELECT page_id, regexp_replace({_sql_host('url')}, '^www[.]', '') AS host, regexp_replace({_sql_host('url')}, '^www[.]', '') = (SELECT regexp_replace({_sql_host('url')}, '^www[.]', '') FROM pages WHERE page_id = 0) AS same_site FROM pages")
def url_host(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    start = p.filter("page_id = 0").select(F.col("url").alias("start"))
    return p.crossJoin(F.broadcast(start)).select("page_id", urls.site_host(F.col("url")).alias("host"), urls.same_site(F.col("url"), F.col("start")).alias("same_site"))


@query(f"SELECT page_id, regexp_replace({_sql_host('url')}, '^www[.]', '') || {_sql_path(_sql_normal('url'))} || '?' || {_sql_query(_sql_normal('url'))} AS dedupe_key FROM pages")
def url_dedupe_key(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.dedupe_key(F.col("url")).alias("dedupe_key"))


_ENDINGS = ", ".join(f"'{e}'" for e in urls.NOT_PAGES)


@query(f"SELECT page_id, {_sql_scheme('url')} IN ('http', 'https') AND regexp_extract(lower({_sql_path('url')}), '([.][^./]*)$', 1) NOT IN ({_ENDINGS}) AS crawlable FROM pages")
def url_crawlable(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.is_crawlable(F.col("url")).alias("crawlable"))


@query(f"""
SELECT page_id, array_to_string(list_filter([
    CASE WHEN regexp_matches({_sql_path('url')}, '(?i)-copy(-[0-9]+)?(/|$)') THEN 'copy-suffix' END,
    CASE WHEN regexp_matches({_sql_path('url')}, '\\p{{Lu}}') THEN 'uppercase' END,
    CASE WHEN {_sql_query('url')} <> '' THEN 'query-params-no-canonical' END,
    CASE WHEN len(list_filter(string_split({_sql_path('url')}, '/'), lambda s: s <> '')) > 4 THEN 'deep-path' END,
    CASE WHEN contains({_sql_path('url')}, '_') THEN 'underscores' END,
    CASE WHEN length(url) > 115 THEN 'long-url' END], lambda f: f IS NOT NULL), ',') AS flags FROM pages""")
def url_hygiene(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(urls.hygiene(F.col("url"), False), ",").alias("flags"))


_STRUCT = ", ".join(f"'{s}'" for s in urls.STRUCTURAL)
_SQL_SEG = f"list_filter(string_split({_sql_path('url')}, '/'), lambda s: s <> '')"


@query(f"SELECT page_id, CASE WHEN len({_SQL_SEG}) = 0 THEN 'home' ELSE array_to_string(list_transform({_SQL_SEG}, lambda s: CASE WHEN lower(s) IN ({_STRUCT}) THEN s ELSE '*' END), '/') END AS template, len({_SQL_SEG})::INT AS depth FROM pages")
def url_template(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.template(F.col("url")).alias("template"), F.size(urls.segments(F.col("url"))).alias("depth"))


@query("""SELECT p_partkey, CASE WHEN contains(path, '/products/') THEN 'product' WHEN contains(path, '/collections/') THEN 'collection' WHEN contains(path, '/blogs/') OR contains(path, '/blog/') THEN 'content'
  WHEN contains(path, '/pages/') THEN 'static' WHEN path IN ('', '/') THEN 'home' ELSE 'other' END AS page_type
FROM (SELECT p_partkey, '/' || ['products', 'collections', 'blogs', 'blog', 'pages', 'x', ''][p_partkey % 7 + 1] || CASE WHEN p_partkey % 7 = 6 THEN '' ELSE '/' || p_size END AS path FROM part)""")
def page_type(spark, sf_dir):
    kinds = F.array(*(F.lit(k) for k in ("products", "collections", "blogs", "blog", "pages", "x", "")))
    k = (F.col("p_partkey") % 7).cast("int")
    u = F.concat(F.lit("https://shop.example.com/"), F.get(kinds, k), F.when(k == 6, "").otherwise(F.concat(F.lit("/"), F.col("p_size").cast("string"))))
    return table(spark, sf_dir, "part").select("p_partkey", urls.page_type(u).alias("page_type"))


@query(f"SELECT page_id, regexp_matches(url, '/en/') AND NOT regexp_matches(url, '[?]') AS allowed, string_split(url, '/')[-1] AS last_segment FROM pages")
def url_allowed(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.allowed(F.col("url"), ["/en/"], [r"\?"]).alias("allowed"), urls.last_segment(F.col("url")).alias("last_segment"))


# pages and links


@query(SITE_SQL + "SELECT url, title, coalesce(length(title), 0)::INT AS title_length, CASE WHEN title IS NULL THEN 'missing' WHEN length(title) < 30 THEN 'too short' WHEN length(title) > 60 THEN 'too long' ELSE '' END AS title_issue FROM audited")
def title_check(spark, sf_dir):
    return extract.page_table(crawled(spark, sf_dir)).select("url", "title", "title_length", "title_issue")


@query(SITE_SQL + f"SELECT url, trim({_sql_unescape(chr(34) + 'h' + chr(34))}) AS h1, n::INT AS h1_count, CASE WHEN n = 0 THEN '' ELSE '' END AS heading_issues FROM (SELECT url, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS h, len(regexp_extract_all(html, '<h1>')) AS n FROM audited)")
def heading_check(spark, sf_dir):
    return extract.page_table(crawled(spark, sf_dir)).select("url", "h1", "h1_count", F.array_join("heading_issues", ",").alias("heading_issues"))


@query(SITE_SQL + "SELECT url, regexp_extract(html, '<html lang=\"([^\"]*)\"', 1) <> 'en' AS spellcheck_skipped FROM audited")
def lang_gate(spark, sf_dir):
    return extract.page_table(crawled(spark, sf_dir)).select("url", "spellcheck_skipped")


@query(SITE_SQL + "SELECT url, 'missing' AS canonical_state, true AS no_description, 'viewport,og:title,og:image,twitter:card' AS missing_social, 0 AS images, indexable FROM audited")
def head_tags(spark, sf_dir):
    return extract.page_table(crawled(spark, sf_dir)).select("url", "canonical_state", (F.col("meta_description_issue") == "missing").alias("no_description"), F.array_join("missing_social", ",").alias("missing_social"), F.col("image_count").alias("images"), "indexable")


@query(SITE_SQL + "SELECT * FROM links")
def links_explode(spark, sf_dir):
    return extract.link_table(extract.page_table(crawled(spark, sf_dir)))


@query(SITE_SQL + "SELECT url, inlinks FROM counted")
def inlinks(spark, sf_dir):
    return page_table(spark, sf_dir)[0].select("url", "inlinks")


@query(SITE_SQL + "SELECT CASE WHEN anchor = '' THEN '(no anchor text)' ELSE anchor END AS anchor, target, count(*) AS count, count(DISTINCT source) AS sources FROM links GROUP BY ALL ORDER BY count DESC, anchor, target LIMIT 1000")
def anchor_report(spark, sf_dir):
    return site.anchor_report(links_explode(spark, sf_dir))


@query("""
WITH l AS (SELECT l_orderkey AS k, ['Sale now', 'Home', 'New arrivals', 'save 20%', 'back to shop', 'Shoplifter', 'shop brand'][l_linenumber % 7 + 1] AS anchor,
  CASE WHEN l_partkey % 2 = 0 THEN 'https://brand.example.com/' ELSE 'https://brand.example.com/p/' || l_partkey END AS target FROM lineitem)
SELECT anchor, count(DISTINCT 'https://brand.example.com/s/' || k) AS sources FROM l WHERE target = 'https://brand.example.com/' AND anchor IN ('Sale now', 'New arrivals', 'save 20%') GROUP BY anchor""")
def anchor_mismatch(spark, sf_dir):
    anchors = F.array(*(F.lit(a) for a in ("Sale now", "Home", "New arrivals", "save 20%", "back to shop", "Shoplifter", "shop brand")))
    root = "https://brand.example.com/"
    links = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit(root + "s/"), F.col("l_orderkey").cast("string")).alias("source"), F.when(F.col("l_partkey") % 2 == 0, root).otherwise(F.concat(F.lit(root + "p/"), F.col("l_partkey").cast("string"))).alias("target"),
        F.get(anchors, (F.col("l_linenumber") % 7).cast("int")).alias("anchor"), F.lit(True).alias("internal"),
    )
    pages = spark.createDataFrame([(root, "start")], "url string, discovered_by string")
    return site.anchor_mismatch(pages, links).groupBy("anchor").agg(F.countDistinct("source").alias("sources"))


@query(SITE_SQL + "SELECT url FROM counted WHERE in_sitemap AND inlinks = 0 AND status = 200 AND discovered_by <> 'start'")
def orphans(spark, sf_dir):
    return site.orphans(page_table(spark, sf_dir)[0]).select("url")


@query("""
WITH p AS (SELECT c_custkey AS k, c_custkey % 3 = 0 AS listed FROM customer), n AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_custkey <> o_orderkey GROUP BY 1)
SELECT k FROM p JOIN n USING (k) WHERE NOT listed""")
def ghosts(spark, sf_dir):
    """Customers as pages, orders as links to them."""
    pages = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("url"), (F.col("c_custkey") % 3 == 0).alias("in_sitemap"), F.lit(True).alias("indexable"))
    links = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("source"), F.col("o_custkey").cast("string").alias("target"), F.lit(True).alias("internal"))
    return site.ghosts(site.inlinks(pages, links)).select(F.col("url").cast("bigint").alias("k"))


@query(SITE_SQL + "SELECT CASE WHEN bool_or(in_sitemap) OVER () THEN 'HIGH' ELSE 'MED' END AS severity, url FROM audited WHERE status BETWEEN 400 AND 499")
def dead_in_sitemap(spark, sf_dir):
    return findings.joined_hits(*page_table(spark, sf_dir)).filter("issue = 'Dead URLs (4xx)'").select("severity", "url")


_CUST_LINKS = "orders o JOIN customer c ON c.c_custkey = o.o_custkey"


@query(f"SELECT o_orderkey AS source, o_custkey AS target, 404 AS status FROM {_CUST_LINKS} WHERE c_custkey % 10 = 1")
def broken_links(spark, sf_dir):
    pages = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("url"), F.when(F.col("c_custkey") % 10 == 1, 404).otherwise(200).alias("status"), F.lit(None).cast("string").alias("error"))
    links = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("source"), F.col("o_custkey").alias("target"), F.lit("").alias("anchor"), F.lit(True).alias("internal"))
    return site.broken_links(pages, links).select("source", "target", "status")


@query(f"SELECT o_orderkey AS source, o_custkey AS target FROM {_CUST_LINKS} WHERE c_custkey % 10 IN (2, 3)")
def links_to_redirects(spark, sf_dir):
    k = F.col("c_custkey")
    pages = table(spark, sf_dir, "customer").select(k.alias("url"), F.lit(200).alias("status"), F.when((k % 10).isin(2, 3), 1).otherwise(0).alias("redirect_hops"))
    links = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("source"), F.col("o_custkey").alias("target"), F.lit(True).alias("internal"))
    return site.links_to_redirects(pages, links).select("source", "target")


@query(SITE_SQL + "SELECT url, len(chain)::INT AS redirect_hops, list_contains(list_transform(chain, lambda c: regexp_replace(c, '^[0-9]+ -> ', '')), url) AS loops FROM audited WHERE len(chain) > 1")
def redirect_chains(spark, sf_dir):
    p = crawled(spark, sf_dir)
    return p.filter(F.size("redirect_chain") > 1).select("url", F.size("redirect_chain").alias("redirect_hops"), F.coalesce(site.is_redirect_loop(F.col("url"), F.col("status"), F.col("redirect_chain")), F.lit(False)).alias("loops"))


@query("""
WITH e AS (SELECT DISTINCT c_nationkey AS a, s_nationkey AS b FROM customer JOIN supplier ON c_custkey = s_suppkey WHERE c_nationkey <> s_nationkey)
SELECT a::VARCHAR AS url, b::VARCHAR AS target FROM e WHERE b IN (SELECT c_nationkey FROM customer JOIN supplier ON c_custkey = s_suppkey) AND NOT EXISTS (SELECT 1 FROM e x WHERE x.a = e.b AND x.b = e.a)""")
def hreflang_reciprocity(spark, sf_dir):
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    e = c.join(s, c.c_custkey == s.s_suppkey).select(F.col("c_nationkey").cast("string").alias("url"), F.col("s_nationkey").cast("string").alias("target"))
    pages = e.groupBy("url").agg(F.collect_set(F.struct(F.lit("en").alias("lang"), F.col("target").alias("href"))).alias("hreflang"))
    return site.hreflang_failures(pages)


@query(SITE_SQL + ", g AS (SELECT title, count(*) AS n FROM audited WHERE indexable AND title IS NOT NULL GROUP BY title HAVING count(*) > 1) SELECT url, title AS value, n AS group_size FROM audited JOIN g USING (title) WHERE indexable")
def dup_titles(spark, sf_dir):
    return site.duplicate_groups(extract.page_table(crawled(spark, sf_dir)), "title").select("url", "value", "group_size")


_WORDS = "regexp_extract_all(lower(text), '[0-9a-zÀ-ɏ''-]+')"


@query(f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents)
SELECT doc_id, len(w)::INT AS word_count, sha1(array_to_string(w, ' ')) AS content_hash, len(w) < 250 AS thin,
  len(list_distinct(CASE WHEN len(w) < 4 THEN w ELSE list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]) END))::INT AS shingles FROM d""")
def content_words(spark, sf_dir):
    w = text.content_words(F.col("text"))
    return table(spark, sf_dir, "documents").withColumn("w", w).select("doc_id", F.size("w").alias("word_count"), text.content_hash(F.col("w")).alias("content_hash"), (F.size("w") < 250).alias("thin"), F.size(F.array_distinct(text.shingles(F.col("w")))).alias("shingles"))


@query(f"WITH h AS (SELECT doc_id, sha1(array_to_string({_WORDS}, ' ')) AS h FROM documents), g AS (SELECT h, count(*) AS n FROM h GROUP BY h HAVING count(*) > 1) SELECT doc_id AS url, h AS value, n AS group_size FROM h JOIN g USING (h)")
def dup_content(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("url"), text.content_hash(text.content_words(F.col("text"))).alias("content_hash"), F.lit(True).alias("indexable"))
    return site.duplicate_groups(d, "content_hash").select("url", "value", "group_size")


def _prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """60 bits of a digest of what a part is, one of them flipped."""
    digest = F.conv(F.substring(F.sha1(F.concat("p_name", "p_brand", "p_type")), 1, 15), 16, 10).cast("bigint")
    flip = F.pow(F.lit(2.0), F.col("p_partkey") % 60).cast("bigint")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), digest.bitwiseXOR(flip).alias("simhash"))


@query("""
WITH p AS (SELECT p_partkey AS id, xor(('0x' || substr(sha1(p_name || p_brand || p_type), 1, 15))::BIGINT, 1::BIGINT << (p_partkey % 60)::INT) AS h FROM part)
SELECT a.id AS a, b.id AS b, bit_count(xor(a.h, b.h))::INT AS distance FROM p a JOIN p b ON a.id < b.id WHERE bit_count(xor(a.h, b.h)) <= 8""")
def near_dup_pairs(spark, sf_dir):
    return dups.near_pairs(_prints(spark, sf_dir)).select("a", "b", F.col("distance").cast("int").alias("distance"))


@query()
def near_dup_clusters(spark, sf_dir):
    return dups.near_clusters(_prints(spark, sf_dir))


@query()
def simhash_documents(spark, sf_dir):
    return dups.with_shingle_simhash(table(spark, sf_dir, "documents"), text.content_words(F.col("text")), kept=["doc_id"])


@query(SITE_SQL + f", t AS (SELECT url, depth, {_sql_path('url')} AS p FROM audited), k AS (SELECT url, depth, array_to_string(list_transform(list_filter(string_split(p, '/'), lambda s: s <> ''), lambda s: CASE WHEN lower(s) IN ({_STRUCT}) THEN s ELSE '*' END), '/') AS template FROM t) SELECT url, row_number() OVER (PARTITION BY template ORDER BY depth, url) <= 5 AS images_sized FROM k")
def image_sampling(spark, sf_dir):
    return site.sample_images(crawled(spark, sf_dir), 5).select("url", "images_sized")


# products, spelling


@query("""
WITH s AS (SELECT p_partkey, p_size::VARCHAR AS og, CASE WHEN p_partkey % 5 = 0 THEN (p_size + 10)::VARCHAR END AS item, CASE WHEN p_partkey % 4 = 0 THEN [] ELSE [p_size::VARCHAR, (p_size + 1)::VARCHAR] END AS offers,
  CASE WHEN p_partkey % 7 = 0 THEN (p_size + 10)::VARCHAR END AS standard, CASE WHEN p_partkey % 3 = 0 THEN p_size::VARCHAR END AS sale FROM part),
d AS (SELECT *, list_distinct(list_filter([og, item, sale], lambda x: x IS NOT NULL)) AS now FROM s)
SELECT p_partkey, len(now) <= 1 AND (len(offers) = 0 OR list_has_any(now, offers)) AND NOT (standard IS NOT NULL AND NOT list_contains(list_concat(now, offers), standard) AND sale IS NULL) AS consistent FROM d""")
def price_consistency(spark, sf_dir):
    k, size = F.col("p_partkey"), F.col("p_size")
    s = lambda c: c.cast("string")
    offers = F.when(k % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(s(size), s(size + 1)))
    sale = F.when(k % 3 == 0, s(size))
    ok = extract.price_consistent(F.array(s(size), F.when(k % 5 == 0, s(size + 10)), sale), offers, F.when(k % 7 == 0, s(size + 10)), sale)
    return table(spark, sf_dir, "part").select("p_partkey", ok.alias("consistent"))


@query("""
WITH r AS (SELECT p_partkey, p_size AS reviews, lower(trim(p_name)) AS who FROM part WHERE p_size > 0), f AS (SELECT reviews, who, min('p/' || p_partkey) AS url FROM r GROUP BY ALL)
SELECT reviews, count(*) AS products, array_to_string(list_sort(list(url)), ',') AS urls FROM f GROUP BY reviews HAVING count(*) >= 3""")
def merged_review_pool(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.concat(F.lit("p/"), F.col("p_partkey").cast("string")).alias("url"), F.col("p_size").alias("review_schema_count"), F.col("p_name").alias("product_name"), F.lit(None).cast("string").alias("product_group_id"), F.lit(None).cast("string").alias("h1"), F.lit(True).alias("is_product"), F.lit(200).alias("status"))
    return site.merged_review_pools(p).select("reviews", "products", F.array_join("urls", ",").alias("urls"))


_BARE = "regexp_replace(w, '^[.,;:!?()\\[\\]\"''“”‘’]+|[.,;:!?()\\[\\]\"''“”‘’]+$', '', 'g')"


@query(rf"""
WITH s AS (SELECT doc_id, trim(unnest(regexp_split_to_array(regexp_replace(text, '([.!?])\s+', '\1' || chr(10), 'g'), '\n+')), E' \t\n\r') AS s FROM documents),
w AS (SELECT doc_id, unnest(regexp_split_to_array(s, '\s+')[2:]) AS w FROM s),
b AS (SELECT doc_id, {_BARE} AS w FROM w)
SELECT lower(w) AS term, count(DISTINCT doc_id) AS pages FROM b WHERE length(w) > 2 AND regexp_full_match(w, '[A-Z][A-Za-z0-9]*([0-9]+|[a-z]+[A-Za-z0-9]*)') GROUP BY 1 HAVING count(DISTINCT doc_id) >= 3""")
def brand_terms(spark, sf_dir):
    return spelling.brand_terms(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("url"), F.col("text").alias("body")))


def _dictionary(docs: DataFrame) -> DataFrame:
    words = docs.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))).alias("word"))
    return words.groupBy("word").count().filter("count >= 4").select("word")


_RE2 = [(p, r.replace("$1", r"\1").replace("$2", r"\2")) for p, r in spelling.VARIANTS]
_FORMS = ", ".join(f"regexp_replace(word, '{p}', '{r}', 'g')" for p, r in _RE2)


@query(rf"""
WITH dict AS (SELECT word AS form FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]+'))) AS word FROM documents WHERE lang = 'en') GROUP BY word HAVING count(*) >= 4
  UNION SELECT unnest({spelling.ALLOWED})),
t AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(regexp_replace(text, '(?i)https?://\S+|www\.\S+|[\w.+-]+@[\w-]+\.[\w.]+|\{{\{{.*?\}}\}}|\{{%.*?%\}}', ' ', 'g'), '[A-Za-z][A-Za-z0-9''’-]*')) AS token FROM documents WHERE lang = 'en'),
k AS (SELECT * FROM t WHERE length(token) > 2 AND NOT regexp_matches(token, '[0-9]') AND NOT regexp_full_match(token, '[A-Z][A-Z]+')),
w AS (SELECT doc_id, token, unnest(regexp_split_to_array(regexp_replace(replace(lower(token), '’', ''''), '(n''t|''s|''re|''ve|''ll|''d|''m)$', ''), '[-'']')) AS word FROM k),
p AS (SELECT * FROM w WHERE length(word) > 2),
v AS (SELECT DISTINCT word, unnest([word, {_FORMS}]) AS form FROM (SELECT DISTINCT word FROM p)),
known AS (SELECT DISTINCT word FROM v WHERE form IN (SELECT form FROM dict))
SELECT DISTINCT doc_id, token FROM p WHERE word NOT IN (SELECT word FROM known)""")
def typos(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter("lang = 'en'")
    return spelling.unknown(d.select(F.col("doc_id").alias("id"), "text"), _dictionary(d)).select(F.col("id").alias("doc_id"), "token")


# JSON and metrics


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def json_props(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"))


@query("SELECT event_id, value / 100 AS performance_score, value * 30 AS lcp_ms, value / 500 AS field_cls, true AS has_field_data, round_even(value / 100 * 100, 0)::INT AS score_pct FROM events")
def psi_decode(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    payload = F.concat(F.lit('{"lighthouseResult":{"categories":{"performance":{"score":'), (F.col("value") / 100).cast("string"), F.lit('}},"audits":{"largest-contentful-paint":{"numericValue":'), (F.col("value") * 30).cast("string"), F.lit('}}},"loadingExperience":{"metrics":{"CUMULATIVE_LAYOUT_SHIFT_SCORE":{"percentile":'), (F.col("value") / 5).cast("string"), F.lit("}}}}"))
    d = psi.decode(e.select("event_id", payload.alias("payload")))
    return d.select("event_id", F.round("performance_score", 9).alias("performance_score"), F.round("lcp_ms", 6).alias("lcp_ms"), F.round("field_cls", 9).alias("field_cls"), "has_field_data", "score_pct")


SQL["psi_decode"] = "SELECT event_id, round(value / 100, 9) AS performance_score, round(value * 30, 6) AS lcp_ms, round(value / 500, 9) AS field_cls, true AS has_field_data, round_even(value / 100 * 100, 0)::INT AS score_pct FROM events"


@query(SITE_SQL + "SELECT url, inlinks FROM counted WHERE indexable ORDER BY inlinks DESC, len(list_filter(string_split(" + _sql_path("url") + ", '/'), lambda s: s <> '')), url LIMIT 10")
def psi_select_topk(spark, sf_dir):
    return findings.psi_targets(page_table(spark, sf_dir)[0])


@query("""
WITH m AS (SELECT event_id::VARCHAR AS url, CASE WHEN event_id % 3 = 0 THEN 0 WHEN event_id % 3 = 1 THEN value * 50 END AS field_lcp, value * 40 AS lcp, value / 400 AS cls, value * 3 AS inp, value * 4 AS tbt, 1 - value / 300 AS score, CASE WHEN event_id % 5 = 0 THEN 'SLOW' ELSE 'FAST' END AS o FROM events),
r AS (SELECT url, unnest(list_filter([CASE WHEN coalesce(nullif(field_lcp, 0), lcp) > 2500 THEN 'LCP above 2.5s' END, CASE WHEN cls > 0.1 THEN 'CLS above 0.1' END, CASE WHEN inp > 200 THEN 'INP above 200ms (field data)' END,
  CASE WHEN tbt > 200 THEN 'Total Blocking Time above 200ms' END, CASE WHEN score < 0.9 THEN 'Low PageSpeed performance score' END, CASE WHEN o = 'SLOW' THEN 'Failing Core Web Vitals with real users' END], lambda x: x IS NOT NULL)) AS issue FROM m)
SELECT CASE WHEN issue IN ('LCP above 2.5s', 'Failing Core Web Vitals with real users') THEN 'HIGH' ELSE 'MED' END AS severity, issue, count(*) AS n FROM r GROUP BY ALL""")
def psi_threshold_findings(spark, sf_dir):
    k, v = F.col("event_id"), F.col("value")
    null = F.lit(None)
    m = table(spark, sf_dir, "events").select(
        k.cast("string").alias("url"), F.when(k % 3 == 0, 0.0).when(k % 3 == 1, v * 50).alias("field_lcp_ms"), (v * 40).alias("lcp_ms"), null.cast("double").alias("field_cls"), (v / 400).alias("cls"), (v * 3).alias("field_inp_ms"),
        (v * 4).alias("tbt_ms"), (1 - v / 300).alias("performance_score"), F.when(k % 5 == 0, "SLOW").otherwise("FAST").alias("field_overall"), null.cast("string").alias("error"),
    )
    return findings.psi_findings(m).groupBy("severity", "issue").agg(F.count("*").alias("n"))


# keywords


def _volume_label():
    k, n = F.col("p_partkey"), F.col("p_size")
    s = n.cast("string")
    return (
        F.when(k % 6 == 0, F.concat(s, F.lit(" - "), (n * 10).cast("string"))).when(k % 6 == 1, F.concat(s, F.lit("K – "), (n * 10).cast("string"), F.lit("K")))
        .when(k % 6 == 2, F.concat(s, F.lit(",300"))).when(k % 6 == 3, F.concat(s, F.lit(" tis."))).when(k % 6 == 4, "n/a").otherwise(s)
    )


_SQL_VOLUME = """
SELECT p_partkey, p_name, CASE p_partkey % 6 WHEN 0 THEN p_size WHEN 1 THEN p_size * 1000 WHEN 2 THEN p_size * 1000 + 300 WHEN 3 THEN p_size * 1000 WHEN 4 THEN 0 ELSE p_size END AS lo,
       CASE p_partkey % 6 WHEN 0 THEN p_size * 10 WHEN 1 THEN p_size * 10000 WHEN 2 THEN p_size * 1000 + 300 WHEN 3 THEN p_size * 1000 WHEN 4 THEN 0 ELSE p_size END AS hi FROM part"""
_SQL_MID = "CASE WHEN lo = hi THEN lo ELSE round_even(sqrt(lo::DOUBLE * hi), 0)::BIGINT END"


@query(f"WITH v AS ({_SQL_VOLUME}) SELECT p_partkey, lo::BIGINT AS minimum, hi::BIGINT AS maximum, ({_SQL_MID})::BIGINT AS mid, true AS parsed FROM v")
def keyword_parse_volume(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.parse_volume(_volume_label()).alias("v")).select("p_partkey", "v.minimum", "v.maximum", "v.mid", "v.parsed")


@query("SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_size * 1000 + 234.5 WHEN 1 THEN p_size * 1000 + 234.5 WHEN 2 THEN p_size + 0.5 WHEN 3 THEN p_size * 1000 + 300 END::DOUBLE AS number, CASE WHEN p_partkey % 4 = 0 THEN 'HIGH' WHEN p_partkey % 4 = 1 THEN NULL WHEN p_size <= 33 THEN 'LOW' ELSE 'MED' END AS level FROM part")
def keyword_parse_number(spark, sf_dir):
    k, s = F.col("p_partkey"), F.col("p_size").cast("string")
    label = F.when(k % 5 == 0, F.concat(F.lit("€ "), s, F.lit(".234,50"))).when(k % 5 == 1, F.concat(s, F.lit(",234.50"))).when(k % 5 == 2, F.concat(s, F.lit(",5"))).when(k % 5 == 3, F.concat(s, F.lit(".300"))).otherwise("+∞")
    level = F.when(k % 4 == 0, "Visoko").when(k % 4 == 1, "--").otherwise(s)
    return table(spark, sf_dir, "part").select("p_partkey", text.parse_number(label).alias("number"), text.parse_competition(level).alias("level"))


def _keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("row_idx"), F.col("p_name").alias("keyword"), _volume_label().alias("volume"))
    return keywords.typed(p)


_FILTERS = {"contains": ["e"], "not_contains": ["green, xyz"], "min_volume": 100}
_SQL_KEYS = f"""
WITH v AS ({_SQL_VOLUME}), k AS (SELECT p_partkey AS row_idx, lower(trim(p_name)) AS normalized, ({_SQL_MID})::BIGINT AS mid FROM v),
f AS (SELECT *, contains(normalized, 'e') AS a, NOT (contains(normalized, 'green') OR contains(normalized, 'xyz')) AS b, mid >= 100 AS c FROM k)"""


@query(_SQL_KEYS + """ SELECT unnest([0, 1, 2, 3, 4]) AS ord, unnest(['rows', 'after --contains', 'after --not-contains', 'after --min-volume', 'unique']) AS label,
  unnest([(SELECT count(*) FROM f), (SELECT count(*) FROM f WHERE a), (SELECT count(*) FROM f WHERE a AND b), (SELECT count(*) FROM f WHERE a AND b AND c), (SELECT count(DISTINCT normalized) FROM f WHERE a AND b AND c)]) AS count""")
def keyword_clean_funnel(spark, sf_dir):
    return keywords.funnel(_keywords(spark, sf_dir), **_FILTERS)


@query(_SQL_KEYS + " SELECT normalized, row_idx, mid FROM (SELECT *, row_number() OVER (PARTITION BY normalized ORDER BY mid DESC, row_idx) AS n FROM f WHERE a AND b AND c) WHERE n = 1")
def keyword_dedupe(spark, sf_dir):
    return keywords.clean(_keywords(spark, sf_dir), **_FILTERS).select("normalized", "row_idx", F.col("volume.mid").alias("mid"))


def _shop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part as a shop's page."""
    p = table(spark, sf_dir, "part")
    kind = F.get(F.array(F.lit("products"), F.lit("collections"), F.lit("pages")), (F.col("p_partkey") % 3).cast("int"))
    return p.select(F.concat(F.lit("https://s.example.com/"), kind, F.lit("/"), F.regexp_replace(F.lower("p_name"), " ", "-"), F.lit("-"), F.col("p_partkey").cast("string")).alias("url"), F.col("p_type").alias("title"), F.col("p_brand").alias("h1"))


_STOP = ", ".join(f"'{w}'" for w in text.STOPWORDS)


def _sql_tokens(c: str) -> str:
    one = "CASE WHEN length(w) > 3 AND w LIKE '%s' AND NOT regexp_matches(w, '(ss|us|is)$') THEN w[:-2] ELSE w END"
    return f"list_filter(list_transform(regexp_extract_all(lower({c}), '[a-z0-9]+'), lambda w: {one}), lambda w: w NOT IN ({_STOP}) AND length(w) > 1)"


_SQL_SHOP = f"""
shop AS (SELECT 'https://s.example.com/' || ['products', 'collections', 'pages'][p_partkey % 3 + 1] || '/' || replace(lower(p_name), ' ', '-') || '-' || p_partkey AS url, ['product', 'collection', 'static'][p_partkey % 3 + 1] AS page_type, p_type AS title, p_brand AS h1 FROM part),
fields AS (SELECT url, unnest({_sql_tokens("regexp_replace(" + _sql_path("url") + ", '[/_.-]+', ' ', 'g')")}) AS token, 3 AS weight FROM shop
  UNION ALL SELECT url, unnest({_sql_tokens('title')}), 2 FROM shop UNION ALL SELECT url, unnest({_sql_tokens('h1')}), 2 FROM shop),
onpage AS (SELECT url, token, max(weight) AS weight FROM fields GROUP BY ALL),
idf AS (SELECT token, count(*) AS df, 0.25 + 0.75 * greatest(0, least(1, ln(((SELECT count(*) FROM shop) + 1)::DOUBLE / (count(*) + 1)) / ln((SELECT count(*) FROM shop) + 1))) AS w FROM onpage GROUP BY token),
keys AS (SELECT lower(trim(p_name)) AS normalized, max(p_size)::BIGINT AS volume_mid FROM part GROUP BY 1),
words AS (SELECT normalized, unnest({_sql_tokens('normalized')}) AS token FROM keys),
total AS (SELECT normalized, sum(coalesce(w, 1.0)) AS all_w FROM words LEFT JOIN idf USING (token) GROUP BY normalized),
scored AS (SELECT normalized, url, sum(w * weight) / (any_value(all_w) * 3) AS score FROM words JOIN onpage USING (token) JOIN idf USING (token) JOIN total USING (normalized) GROUP BY normalized, url)"""


def _demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy(text.normalize_keyword(F.col("p_name")).alias("normalized")).agg(F.max("p_size").cast("bigint").alias("volume_mid"))


@query("WITH " + _SQL_SHOP + " SELECT token, df, round(w, 9) AS w FROM idf")
def token_idf(spark, sf_dir):
    pages = _shop(spark, sf_dir)
    n = pages.count()
    return keywords.token_weights(keywords.page_tokens(pages, n), n).select("token", "df", F.round("w", 9).alias("w"))


@query("WITH " + _SQL_SHOP + " SELECT normalized, url, round(score, 6) AS score FROM scored")
def keyword_scores(spark, sf_dir):
    return keywords.scores(_demand(spark, sf_dir), _shop(spark, sf_dir)).select("normalized", "url", F.round("score", 6).alias("score"))


@query("WITH " + _SQL_SHOP + """,
best AS (SELECT normalized, max(score) AS best, arg_min(url, (-score, url)) AS owner, arg_min(page_type, (-score, url)) AS owner_page_type FROM scored JOIN shop USING (url) GROUP BY normalized),
near AS (SELECT normalized, count(*) AS n FROM scored JOIN best USING (normalized) WHERE score >= 0.75 AND best - score <= 0.25 GROUP BY normalized),
head AS (SELECT quantile_disc(volume_mid, 0.75) AS h FROM keys),
m AS (SELECT k.normalized, volume_mid, CASE WHEN coalesce(n, 0) >= 2 THEN 'CANNIBAL' WHEN coalesce(best, 0) >= 0.75 THEN 'OWNED' WHEN coalesce(best, 0) >= 0.5 THEN 'WEAK' ELSE 'GAP' END AS status, round(coalesce(best, 0.0), 3) AS score, owner, owner_page_type, coalesce(n, 0)::INT AS contenders, h
  FROM keys k LEFT JOIN best USING (normalized) LEFT JOIN near USING (normalized) CROSS JOIN head)
SELECT normalized, volume_mid, status, score, owner, owner_page_type, contenders, CASE WHEN status IN ('OWNED', 'CANNIBAL') AND volume_mid >= h AND owner_page_type = 'product' THEN 'head term owned by a product'
  WHEN status IN ('OWNED', 'CANNIBAL') AND volume_mid < h AND len(string_split(normalized, ' ')) >= 4 AND owner_page_type = 'collection' THEN 'long tail owned by a collection' END AS inverted FROM m""")
def keyword_map(spark, sf_dir):
    m = keywords.keyword_map(_demand(spark, sf_dir), _shop(spark, sf_dir))
    return m.withColumn("contenders", F.size("contenders"))


@query()
def gap_clusters(spark, sf_dir):
    m = keywords.keyword_map(_demand(spark, sf_dir), _shop(spark, sf_dir))
    return keywords.gap_clusters(m.filter("status <> 'OWNED'").select("normalized", "volume_mid"))


# markup that the pages of the tables lack, made from page_id: every judgement has pages that pass and pages that fail


def _marked_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id")
    url = F.concat(F.lit("https://m.example.com/p/"), k)
    when = lambda c, s: F.when(c, s if isinstance(s, Column) else F.lit(s)).otherwise("")
    head = F.concat(
        F.lit("<html lang=en><head><title>T</title>"),
        when(k % 4 == 0, F.concat(F.lit('<link rel=canonical href="'), url, F.lit('">'))), when(k % 4 == 1, "<link rel=canonical href=https://other.org/x>"), when(k % 4 == 2, "<link rel=canonical href=/q>"),
        when(k % 5 == 0, '<meta name=robots content="NoIndex, follow">'), when(k % 5 == 1, "<meta name=googlebot content=none>"), when(k % 3 == 0, "<meta name=viewport content=w>"),
        when(k % 6 == 0, "<meta property=og:image content=i.png>"), when(k % 2 == 0, "<meta property=og:title content=t>"), when(k % 7 == 0, "<meta name=twitter:card content=c>"),
        when(k % 8 > 0, F.concat(F.lit("<meta name=description content="), F.repeat(F.lit("d"), (k % 8 * 40).cast("int")), F.lit(">"))),
        when(k % 3 == 1, F.concat(F.lit("<link rel=alternate hreflang=en href="), url, F.lit("><link rel=alternate hreflang=x-default href=/>"))), when(k % 3 == 2, "<link rel=alternate hreflang=english href=/e>"),
    )
    body = F.concat(
        F.lit("</head><body>"), when(k % 4 == 0, "<h1>A</h1><h2>B</h2><h3>C</h3>"), when(k % 4 == 1, "<h2>A</h2><h1>B</h1>"), when(k % 4 == 2, "<h1>A</h1><h3>B</h3>"), F.lit("<p>Some words are here.</p>"),
        F.array_join(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.when(i < k % 5, F.when(i % 2 == 0, "<img src=/i.png alt=x>").otherwise("<img src=/i.png>")).otherwise("")), ""), F.lit("</body></html>"),
    )
    return table(spark, sf_dir, "pages").select("page_id", url.alias("url"), F.concat(head, body).alias("html"))


_SQL_MARKUP = f"""
m AS (SELECT page_id, page_id AS k, ['self', 'cross-domain', 'other', 'missing'][page_id % 4 + 1] AS canonical_state, page_id % 5 < 2 AS noindex, page_id % 5 = 1 AS nofollow,
  CASE WHEN page_id % 5 < 2 THEN 'meta' END AS robots_directive_source,
  array_to_string(list_filter([CASE WHEN page_id % 3 <> 0 THEN 'viewport' END, CASE WHEN page_id % 2 <> 0 THEN 'og:title' END, CASE WHEN page_id % 6 <> 0 THEN 'og:image' END, CASE WHEN page_id % 7 <> 0 THEN 'twitter:card' END], lambda x: x IS NOT NULL), ' ') AS missing_social,
  (page_id % 8 * 40)::INT AS meta_description_length,
  CASE WHEN page_id % 8 = 0 THEN 'missing' WHEN page_id % 8 * 40 < {extract.DESCRIPTION_RANGE[0]} THEN 'too short' WHEN page_id % 8 * 40 > {extract.DESCRIPTION_RANGE[1]} THEN 'too long' ELSE '' END AS meta_description_issue,
  page_id % 3 = 1 AS hreflang_x_default, page_id % 3 = 1 AS hreflang_self, CASE WHEN page_id % 3 = 2 THEN 'english' ELSE '' END AS hreflang_invalid,
  CASE WHEN page_id % 4 = 3 THEN 0 ELSE 1 END AS h1_count, ['', 'first heading is h2, not h1', 'h3 appears before any h2', ''][page_id % 4 + 1] AS heading_issues,
  (page_id % 5)::INT AS image_count, (page_id % 5 // 2)::INT AS images_missing_alt FROM pages)"""


@query(f"WITH {_SQL_MARKUP} SELECT * EXCLUDE (k) FROM m")
def markup_checks(spark, sf_dir):
    p = extract.page_table(_marked_up(spark, sf_dir))
    flat = lambda c, by: F.array_join(c, by).alias(c)
    return p.select(
        "page_id", "canonical_state", "noindex", "nofollow", "robots_directive_source", flat("missing_social", " "), "meta_description_length", "meta_description_issue", "hreflang_x_default", "hreflang_self", flat("hreflang_invalid", " "),
        "h1_count", flat("heading_issues", "; "), "image_count", "images_missing_alt",
    )


@query(f"""WITH {_SQL_MARKUP},
i AS (SELECT *, NOT noindex AND canonical_state IN ('self', 'missing') AS indexable FROM m),
h AS (SELECT unnest(list_filter([
  CASE WHEN noindex AND k % 9 > 0 THEN 'Noindex on internally linked pages' END, CASE WHEN canonical_state = 'cross-domain' THEN 'Canonical points to another domain' END, CASE WHEN canonical_state = 'missing' THEN 'Missing canonical tag' END,
  CASE WHEN indexable AND k % 3 = 2 THEN 'Missing x-default' END, CASE WHEN indexable AND k % 3 = 2 THEN 'hreflang set missing a self-reference' END, CASE WHEN indexable AND k % 3 = 2 THEN 'Invalid hreflang language codes' END,
  CASE WHEN indexable THEN 'Title too short' END, CASE WHEN indexable AND meta_description_issue = 'missing' THEN 'Missing meta description' END, CASE WHEN indexable AND meta_description_issue = 'too long' THEN 'Meta description too long' END,
  CASE WHEN indexable AND h1_count = 0 THEN 'Missing H1' END, CASE WHEN indexable AND heading_issues <> '' THEN 'Heading order violations' END, CASE WHEN indexable THEN 'Thin content' END, CASE WHEN indexable AND images_missing_alt > 0 THEN 'Images missing alt text' END,
  CASE WHEN indexable AND k % 3 <> 0 THEN 'Missing viewport meta tag' END, CASE WHEN indexable AND k % 6 <> 0 THEN 'Missing og:image' END,
  CASE WHEN indexable AND k % 10 = 3 THEN 'Typos in title or meta description' END, CASE WHEN indexable AND k % 10 = 4 THEN 'Typos in H1' END, CASE WHEN indexable AND k % 10 > 5 THEN 'Typos in body content' END, CASE WHEN k % 11 = 1 THEN 'Oversized images' END], lambda x: x IS NOT NULL)) AS issue FROM i)
SELECT issue, count(*) AS total_count FROM h GROUP BY issue""")
def findings_markup(spark, sf_dir):
    """The rules over pages of every kind; inlinks, typos and image sizes are laid on by page_id."""
    k, none = F.col("page_id"), F.array().cast("array<string>")
    laid = extract.page_table(_marked_up(spark, sf_dir)).withColumns({
        "inlinks": k % 9, "spelling_title": F.when(k % 10 == 3, F.array(F.lit("x"))).otherwise(none), "spelling_meta": none, "spelling_h1": F.when(k % 10 == 4, F.array(F.lit("x"))).otherwise(none),
        "spelling_body_count": F.greatest(k % 10 - 5, F.lit(0)), "images_oversized": F.when(k % 11 == 1, F.array(F.lit("x"))).otherwise(none),
    })
    return findings.gather(findings.page_hits(laid)).select("issue", "total_count")


def _sized(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = table(spark, sf_dir, "part")
    src = lambda n: F.concat(F.lit("i"), n)
    pages = p.select(F.col("p_partkey").alias("url"), F.lit(200).alias("status"), (F.col("p_partkey") % 5 > 0).alias("images_sized"), F.array(src(F.col("p_size")), src(F.col("p_partkey") % 100), F.lit("never")).alias("image_sources"))
    sizes = p.select(F.explode(F.array("p_size", (F.col("p_partkey") % 100).cast("int"))).alias("n")).distinct().select(src(F.col("n")).alias("src"), F.when(F.col("n") % 7 > 0, F.col("n") * 10_000).cast("bigint").alias("bytes"))
    return pages, sizes


@query("""
WITH s AS (SELECT p_partkey AS url, unnest([p_size, (p_partkey % 100)::INT]) AS n, unnest([0, 1]) AS place FROM part WHERE p_partkey % 5 > 0),
f AS (SELECT url, string_agg('i' || n || ' (' || (n * 10000 // 1024) || ' KB)', ' ' ORDER BY place) FILTER (n * 10000 > 307200) AS o, max(n * 10000) // 1024 AS kb FROM s WHERE n % 7 > 0 GROUP BY url)
SELECT p_partkey AS url, coalesce(o, '') AS images_oversized, coalesce(kb, 0)::INT AS largest_image_kb FROM part LEFT JOIN f ON url = p_partkey""")
def image_sizes(spark, sf_dir):
    return site.with_image_sizes(*_sized(spark, sf_dir)).select("url", F.array_join("images_oversized", " ").alias("images_oversized"), "largest_image_kb")


@query("SELECT count(*) FILTER (p_partkey % 5 > 0) AS sized, count(*) FILTER (p_partkey % 5 = 0) AS skipped FROM part")
def image_coverage(spark, sf_dir):
    return site.image_coverage(_sized(spark, sf_dir)[0])


# findings and reports


_SQL_RULES = """
hits AS (SELECT url, unnest(list_filter([
  CASE WHEN status >= 500 THEN 'Server errors (5xx)' END, CASE WHEN status IS NULL THEN 'Request failures' END, CASE WHEN status = 200 THEN 'Missing canonical tag' END, CASE WHEN len(chain) > 1 THEN 'Redirect chains longer than one hop' END,
  CASE WHEN list_contains(list_transform(chain, lambda c: regexp_replace(c, '^[0-9]+ -> ', '')), url) THEN 'Redirect loops' END, CASE WHEN indexable AND length(title) > 60 THEN 'Title too long for the SERP' END,
  CASE WHEN indexable AND length(title) < 30 THEN 'Title too short' END, CASE WHEN indexable AND title IS NULL THEN 'Missing title tag' END, CASE WHEN indexable THEN 'Missing meta description' END, CASE WHEN indexable THEN 'Missing viewport meta tag' END, CASE WHEN indexable THEN 'Missing og:image' END,
  CASE WHEN regexp_matches(""" + _sql_path("url") + """, '\\p{Lu}') THEN 'Uppercase characters in URLs' END, CASE WHEN contains(url, '?') THEN 'Query-string URLs without a canonical' END], lambda x: x IS NOT NULL)) AS issue FROM audited)"""


@query(SITE_SQL + "," + _SQL_RULES + " SELECT issue, count(*) AS total_count, least(count(*), 200)::INT AS count, array_to_string(list_sort(list(url))[:200], ' ') AS urls FROM hits GROUP BY issue")
def findings_rules(spark, sf_dir):
    """The rules about single pages, but for thin content, whose words SQL doesn't see."""
    hits = findings.page_hits(extract.page_table(crawled(spark, sf_dir)))
    return findings.gather(hits).filter("issue not in ('Thin content', 'Noindex on internally linked pages')").select("issue", "total_count", "count", F.array_join("urls", " ").alias("urls"))


@query()
def findings_report(spark, sf_dir):
    pages, links = page_table(spark, sf_dir)
    printed = dups.with_shingle_simhash(pages, F.col("content"))
    return report.findings_sheet(findings.findings(store.written(printed, "printed"), links))


@query(SITE_SQL + "SELECT count(*) AS total_urls, count(*) FILTER (indexable) AS indexable, count(*) FILTER (NOT indexable) AS non_indexable, 0::BIGINT AS products, count(*) FILTER (in_sitemap AND inlinks = 0 AND status = 200 AND discovered_by <> 'start') AS orphans, count(*) FILTER (NOT in_sitemap AND indexable AND inlinks > 0) AS ghosts FROM counted")
def site_stats(spark, sf_dir):
    return findings.site_stats(page_table(spark, sf_dir)[0]).drop("avg_word_count")


@query(SITE_SQL + "SELECT CASE WHEN status IS NULL THEN 'failed' ELSE (status // 100) || 'xx' END AS status_class, count(*) AS n FROM audited GROUP BY 1")
def status_histogram(spark, sf_dir):
    return findings.status_counts(crawled(spark, sf_dir))


_CATEGORY = {r.issue: r.category for r in findings.RULES}


@query(SITE_SQL + "," + _SQL_RULES + ", capped AS (SELECT issue, unnest(list_sort(list(url))[:200]) AS url FROM hits GROUP BY issue), labelled AS (SELECT CASE " + " ".join(f"WHEN issue = '{i}' THEN '{c}'" for i, c in _CATEGORY.items()) + " END AS category, url FROM capped) SELECT category, count(DISTINCT url) AS pages, round_even(count(DISTINCT url) * 100 / (SELECT count(*) FROM audited), 0)::BIGINT || '%' AS rate FROM labelled GROUP BY category")
def category_rate(spark, sf_dir):
    pages = crawled(spark, sf_dir)
    found = findings.gather(findings.page_hits(extract.page_table(pages))).filter("issue not in ('Thin content', 'Noindex on internally linked pages')")
    return findings.category_share(found, pages.count())


@query("""
WITH a AS (SELECT o_orderpriority || '|' || o_orderstatus AS label, count(*) AS now FROM orders WHERE o_orderkey % 2 = 0 AND o_orderstatus <> 'P' GROUP BY 1), b AS (SELECT o_orderpriority || '|' || o_orderstatus AS label, count(*) AS was FROM orders WHERE o_orderkey % 2 = 1 AND o_orderpriority <> '1-URGENT' GROUP BY 1)
SELECT CASE WHEN was IS NULL THEN 'new' WHEN now IS NULL THEN 'fixed' WHEN now > was THEN 'worsened' ELSE 'improved' END AS change, 'MED' AS severity, label, coalesce(was, 0) AS was, coalesce(now, 0) AS now FROM a FULL JOIN b USING (label) WHERE was IS NULL OR now IS NULL OR was <> now""")
def audit_diff(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("category"), F.col("o_orderstatus").alias("issue"), F.lit("MED").alias("severity"), "o_orderkey")
    count = lambda df: df.groupBy("category", "issue", "severity").agg(F.count("*").alias("count"))
    return findings.diff(count(o.filter("o_orderkey % 2 = 0 and issue <> 'P'")), count(o.filter("o_orderkey % 2 = 1 and category <> '1-URGENT'")))


@query("SELECT 'new url' AS change, url AS label FROM (SELECT url FROM pages WHERE page_id % 2 = 0 EXCEPT SELECT url FROM pages WHERE page_id % 3 = 0) UNION ALL SELECT 'removed url', url FROM (SELECT url FROM pages WHERE page_id % 3 = 0 EXCEPT SELECT url FROM pages WHERE page_id % 2 = 0)")
def audit_diff_urls(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return findings.diff_urls(p.filter("page_id % 2 = 0"), p.filter("page_id % 3 = 0"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def events_by_hour(spark, sf_dir):
    return incremental.windowed_events(table(spark, sf_dir, "events")).withColumn("total", F.round("total", 4))


@query("SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1")
def upsert_latest(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("url"), "user_id", "event_id")
    old, new = e.filter("event_id % 2 = 0"), e.filter("event_id % 2 = 1")
    return incremental.upsert(old, new, "event_id").select("event_id", "user_id")
