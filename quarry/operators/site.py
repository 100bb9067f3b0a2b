"""What needs the whole site: the link graph, the sitemap, alternates, duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text, urls


def inlinks(pages: DataFrame, links: DataFrame) -> DataFrame:
    """pages with inlinks: internal links from other pages, 0 where there are none."""
    n = links.filter("internal and target <> source").groupBy(F.col("target").alias("url")).agg(F.count("*").alias("inlinks"))
    return pages.drop("inlinks").join(n, "url", "left").withColumn("inlinks", F.coalesce("inlinks", F.lit(0)))


def flag_sitemap(pages: DataFrame, sitemap: DataFrame) -> DataFrame:
    """pages with in_sitemap from the sitemap's urls."""
    s = sitemap.select("url").distinct().withColumn("in_sitemap", F.lit(True))
    return pages.drop("in_sitemap").join(s, "url", "left").withColumn("in_sitemap", F.coalesce("in_sitemap", F.lit(False)))


def orphans(pages: DataFrame) -> DataFrame:
    return pages.filter("in_sitemap and inlinks = 0 and status = 200 and discovered_by <> 'start'")


def ghosts(pages: DataFrame) -> DataFrame:
    """Linked, indexable, not in the sitemap; none where no page is in it."""
    any_listed = pages.filter("in_sitemap").select(F.lit(1).alias("one")).limit(1)
    return pages.filter("not in_sitemap and indexable and inlinks > 0").join(F.broadcast(any_listed), F.lit(True), "left_semi")


def broken_links(pages: DataFrame, links: DataFrame) -> DataFrame:
    """Internal links to pages of status 400 and above, or that failed: (source, target, anchor, status)."""
    dead = pages.filter("status >= 400 or status is null or error is not null").select(F.col("url").alias("target"), "status")
    return links.filter("internal").join(dead, "target").select("source", "target", "anchor", "status")


def links_to_redirects(pages: DataFrame, links: DataFrame) -> DataFrame:
    moved = pages.filter("redirect_hops > 0 and status < 400").select(F.col("url").alias("target"))
    return links.filter("internal").join(moved, "target", "left_semi")


def redirect_targets(chain: Column) -> Column:
    return F.transform(chain, lambda c: F.regexp_replace(c, r"^\d+ -> ", ""))


def is_redirect_loop(url: Column, status: Column, chain: Column) -> Column:
    """It comes back to where it began, or ends unresolved after a target met twice."""
    t = redirect_targets(chain)
    return F.array_contains(t, url) | (status.between(300, 399) & (F.size(t) != F.size(F.array_distinct(t))))


def hreflang_failures(pages: DataFrame) -> DataFrame:
    """(url, target): an alternate that a page declares and that declares alternates, but not this page."""
    edges = pages.select("url", F.explode("hreflang.href").alias("target")).filter("url <> target").distinct()
    declaring = pages.filter(F.size("hreflang") > 0).select(F.col("url").alias("target"))
    back = edges.select(F.col("target").alias("url"), F.col("url").alias("target"))
    return edges.join(declaring, "target", "left_semi").join(back, ["url", "target"], "left_anti")


def duplicate_groups(pages: DataFrame, column: str) -> DataFrame:
    """(url, value, group_size) of indexable pages that share a non-empty value.

    Group sizes come from a partial aggregate; no group is gathered in a task.
    """
    rows = pages.filter("indexable").filter(F.coalesce(F.col(column), F.lit("")) != "").select("url", F.col(column).alias("value"))
    sizes = rows.groupBy("value").agg(F.count("*").alias("group_size")).filter("group_size > 1")
    return rows.join(sizes, "value")


def anchor_report(links: DataFrame, limit: int | None = 1000) -> DataFrame:
    """(anchor, target, count, sources), the most used first."""
    anchor = F.trim("anchor")
    out = links.filter("internal").groupBy(F.when(anchor == "", "(no anchor text)").otherwise(anchor).alias("anchor"), "target").agg(F.count("*").alias("count"), F.countDistinct("source").alias("sources"))
    return out.orderBy(F.desc("count"), "anchor", "target").limit(limit) if limit else out


def anchor_mismatch(pages: DataFrame, links: DataFrame) -> DataFrame:
    """(anchor, source): anchors that promise more than the home page they lead to."""
    roots = pages.filter(urls.is_root(F.col("url")) | (F.col("discovered_by") == "start")).select(F.col("url").alias("target")).distinct()
    brand = roots.agg(F.lower(F.substring_index(urls.site_host(F.min("target")), ".", 1)).alias("brand"))
    at_home = links.filter("internal").join(roots.withColumn("home", F.lit(True)), "target", "left")
    at_home = at_home.filter(F.coalesce("home", F.lit(False)) | F.endswith("target", F.lit("#")) | urls.is_root(F.col("target")))
    named = at_home.crossJoin(F.broadcast(brand))  # one row
    return named.filter(F.col("brand").isNotNull() & text.promises_destination(F.col("anchor"), F.col("brand"))).select(F.trim("anchor").alias("anchor"), "source").distinct()


def sample_images(pages: DataFrame, per_template: int = 25) -> DataFrame:
    """pages with images_sized: the first of each URL template in crawl order; 0 takes all."""
    if per_template == 0:
        return pages.withColumn("images_sized", F.lit(True))
    w = Window.partitionBy("template").orderBy("depth", "url")
    first = pages.select("url", "depth", urls.template(F.col("url")).alias("template")).withColumn("n", F.row_number().over(w)).filter(F.col("n") <= per_template)
    return pages.join(first.select("url", F.lit(True).alias("images_sized")), "url", "left").withColumn("images_sized", F.coalesce("images_sized", F.lit(False)))


def wanted_images(pages: DataFrame, head: int = 5) -> DataFrame:
    """(url, place, src) of the first images of each page that is sampled."""
    return pages.filter("images_sized and status = 200").select("url", F.posexplode(F.slice("image_sources", 1, head)).alias("place", "src"))


def with_image_sizes(pages: DataFrame, sizes: DataFrame, limit: int = 307_200, head: int = 5) -> DataFrame:
    """pages with images_oversized ("src (N KB)", in page order) and largest_image_kb; sizes: (src, bytes), null where unknown."""
    known = sizes.groupBy("src").agg(F.max("bytes").alias("bytes"))
    met = wanted_images(pages, head).join(known, "src").filter("bytes is not null")
    kb = F.floor(F.col("bytes") / 1024)
    heavy = F.sort_array(F.collect_list(F.when(F.col("bytes") > limit, F.struct("place", F.concat("src", F.lit(" ("), kb, F.lit(" KB)")).alias("text")))))
    found = met.groupBy("url").agg(F.transform(heavy, lambda x: x["text"]).alias("images_oversized"), F.floor(F.max("bytes") / 1024).cast("int").alias("largest_image_kb"))
    out = pages.drop("images_oversized", "largest_image_kb").join(found, "url", "left")
    return out.withColumns({"images_oversized": F.coalesce("images_oversized", F.array().cast("array<string>")), "largest_image_kb": F.coalesce("largest_image_kb", F.lit(0))})


def image_coverage(pages: DataFrame) -> DataFrame:
    """(sized, skipped): how many good pages had their images measured."""
    return pages.filter("status = 200").agg(F.count_if("images_sized").alias("sized"), F.count_if(~F.col("images_sized")).alias("skipped"))


def merged_review_pools(pages: DataFrame) -> DataFrame:
    """(reviews, products, urls): distinct products that claim the same number of reviews, three or more."""
    who = F.coalesce("product_group_id", F.lower(F.trim(F.coalesce("product_name", "h1", "url"))))
    rows = pages.filter("is_product and status = 200 and coalesce(review_schema_count, 0) > 0").select("url", F.col("review_schema_count").alias("reviews"), who.alias("who"))
    first = rows.groupBy("reviews", "who").agg(F.min("url").alias("url"))
    return first.groupBy("reviews").agg(F.count("*").alias("products"), F.sort_array(F.collect_list("url")).alias("urls")).filter("products >= 3")
