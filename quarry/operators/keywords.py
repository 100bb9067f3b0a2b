"""Keywords: cleaning, and the map from keywords to the pages that target them."""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text, urls

from . import store
from .dups import merged

OWN, WEAK, MARGIN = 0.75, 0.50, 0.25
#: Pages that one task takes on.
SHARE = 50_000
SLUG_WEIGHT, FIELD_WEIGHT = 3, 2
LONG_TAIL = 4


def split_terms(values: list[str]) -> list[str]:
    return [t.strip().lower() for v in values or () for t in str(v).split(",") if t.strip()]


def typed(raw: DataFrame) -> DataFrame:
    """keyword rows from text cells: keyword, volume, competition, bids; rows without a keyword go."""
    have = set(raw.columns)
    cell = lambda c: F.col(c) if c in have else F.lit(None).cast("string")
    out = raw.select(
        *([F.col("row_idx")] if "row_idx" in have else []), F.trim("keyword").alias("keyword"), text.normalize_keyword(F.col("keyword")).alias("normalized"), text.parse_volume(cell("volume")).alias("volume"),
        text.parse_competition(cell("competition")).alias("competition"), text.parse_number(cell("competition_index")).alias("competition_index"),
        text.parse_number(cell("bid_low")).alias("top_bid_low"), text.parse_number(cell("bid_high")).alias("top_bid_high"),
    )
    return out.filter("normalized <> ''")


def stages(contains: list[str] = (), not_contains: list[str] = (), brands: list[str] = (), min_volume: int = 0) -> list[tuple[str, Column]]:
    """The filters in their fixed order, with the names under which they are counted."""
    some = lambda terms: reduce(lambda a, b: a | b, (F.contains("normalized", F.lit(t)) for t in terms))
    out = []
    if keep := split_terms(contains):
        out.append(("after --contains", some(keep)))
    if drop := split_terms(not_contains):
        out.append(("after --not-contains", ~some(drop)))
    if brand := split_terms(brands):
        out.append(("after --brand", ~some(brand)))
    if min_volume:
        out.append(("after --min-volume", F.col("volume.mid") >= min_volume))
    return out


def clean(rows: DataFrame, **filters) -> DataFrame:
    """Filtered rows, of each normalized keyword the one of most volume (the first of those)."""
    for _, keep in stages(**filters):
        rows = rows.filter(keep)
    order = [F.desc("volume.mid"), "row_idx"] if "row_idx" in rows.columns else [F.desc("volume.mid"), "keyword"]
    w = Window.partitionBy("normalized").orderBy(*order)
    return rows.withColumn("_place", F.row_number().over(w)).filter("_place = 1").drop("_place")


def funnel(rows: DataFrame, **filters) -> DataFrame:
    """(ord, label, count) of every stage, in one pass."""
    steps = stages(**filters)
    passed, sums = F.lit(True), [F.count("*").alias("0")]
    for n, (_, keep) in enumerate(steps, 1):
        passed = passed & keep
        sums.append(F.count_if(passed).alias(str(n)))
    sums.append(F.countDistinct(F.when(passed, F.col("normalized"))).alias(str(len(steps) + 1)))
    names = ["rows", *(n for n, _ in steps), "unique"]
    one = rows.agg(*sums)
    pairs = F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(n).alias("label"), F.col(str(i)).alias("count")) for i, n in enumerate(names)))
    return one.select(F.explode(pairs).alias("s")).select("s.*")


def page_tokens(pages: DataFrame, n_pages: int) -> DataFrame:
    """(url, token, weight): the strongest field of a page that has the token.

    The n_pages pages are dealt by url first: however few files they come from, no task
    takes on many, and their tokens need not be moved.
    """
    slug = text.target_tokens(F.regexp_replace(urls.path(F.col("url")), r"[/_\-.]+", " "))
    weighed = lambda tokens, w: F.transform(tokens, lambda t: F.struct(t.alias("token"), F.lit(w).alias("weight")))
    fields = F.flatten(F.array(weighed(slug, SLUG_WEIGHT), weighed(text.target_tokens(F.col("title")), FIELD_WEIGHT), weighed(text.target_tokens(F.col("h1")), FIELD_WEIGHT)))
    few = pages.select("url", "title", "h1").repartition(n_pages // SHARE + 1, "url")
    return few.select("url", F.explode(fields).alias("t")).groupBy("url", "t.token").agg(F.max("t.weight").alias("weight"))


def token_weights(tokens: DataFrame, n_pages: int, idf: bool = True) -> DataFrame:
    """(token, df, w): rare tokens weigh up to 1, those on every page 0.25."""
    import math

    df = tokens.groupBy("token").agg(F.count("*").alias("df"))
    if not idf or n_pages == 0:
        return df.withColumn("w", F.lit(1.0))
    most = math.log(n_pages + 1) or 1.0
    return df.withColumn("w", 0.25 + 0.75 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.log(F.lit(float(n_pages + 1)) / (F.col("df") + 1)) / most)))


def scores(keywords: DataFrame, pages: DataFrame, idf: bool = True) -> DataFrame:
    """(normalized, url, score > 0): an equi-join by token in place of keywords times pages.

    Every occurrence of a token counts, and tokens that no page has count below the
    line with the weight of a token that no page has.

    The pages of a common token are dealt by url into shares, to each of which its keywords
    go; what meets is dealt by its number.  So no task grows with the pages, and nothing
    that does is sent to the driver.
    """
    n = pages.count()
    on = page_tokens(pages, n)
    weights = store.written(token_weights(on, n, idf), "token-weights")
    tokens = keywords.select("normalized", F.posexplode(text.target_tokens(F.col("normalized"))).alias("place", "token"))
    words = merged(tokens, weights, "token", "left").withColumn("w", F.coalesce("w", F.lit(1.0)))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("place", "w"))), lambda x: x["w"])
    total = words.groupBy("normalized").agg(F.aggregate(ordered, F.lit(0.0), lambda a, b: a + b).alias("all"))
    shares = (F.col("df") / SHARE).cast("int") + 1
    common = F.broadcast(weights.filter(F.col("df") >= SHARE).select("token", shares.alias("shares")))  # few: each has so many pages
    dealt = on.join(common, "token", "left").withColumn("share", F.coalesce(F.pmod(F.xxhash64("url"), "shares"), F.lit(0)).cast("int"))
    asked = merged(words.filter("df is not null"), total, "normalized").withColumn("share", F.explode(F.sequence(F.lit(0), shares - 1)))
    meet = words.agg(F.sum("df")).first()[0] or 0
    met = merged(dealt, asked, ["token", "share"]).select("normalized", "url", "place", "w", "weight", "all").repartition(meet // (4 * SHARE) + 1, "normalized", "url")
    parts = F.transform(F.sort_array(F.collect_list(F.struct("place", "w", "weight"))), lambda x: x["w"] * x["weight"])
    hit = met.groupBy("normalized", "url").agg(F.aggregate(parts, F.lit(0.0), lambda a, b: a + b).alias("hit"), F.max("all").alias("all"))
    return hit.select("normalized", "url", (F.col("hit") / (F.col("all") * SLUG_WEIGHT)).alias("score"))


def keyword_map(keywords: DataFrame, pages: DataFrame, idf: bool = True) -> DataFrame:
    """Each keyword's owner, status and contenders; keywords: normalized and volume_mid.

    The scores are aggregated once, where they are made; a keyword's contenders are kept as one list.
    """
    s = scores(keywords, pages, idf).withColumn("page_type", urls.page_type(F.col("url")))
    if "product_group_id" in pages.columns:
        s = merged(s, pages.groupBy("url").agg(F.max("product_group_id").alias("gid")), "url", "left")
    else:
        s = s.withColumn("gid", F.lit(None).cast("string"))
    owns = F.when(F.col("score") >= OWN, F.struct((-F.col("score")).alias("s"), "url", "page_type", "gid"))
    best = s.groupBy("normalized").agg(F.max("score").alias("best"), F.min_by(F.struct("url", "page_type"), F.struct(-F.col("score"), F.col("url"))).alias("top"), F.collect_list(owns).alias("owns"))
    near = best.withColumn("near", F.sort_array(F.filter("owns", lambda c: F.col("best") + c["s"] <= MARGIN))).drop("owns")
    grouped = F.filter("near", lambda c: c["gid"].isNotNull())
    rated = near.select(
        "normalized", "best", "top", F.size("near").alias("n"), F.size(grouped).alias("n_gid"), F.size(F.array_distinct(F.transform(grouped, lambda c: c["gid"]))).alias("gids"),
        F.transform("near", lambda c: F.struct(c["url"].alias("url"), c["page_type"].alias("page_type"), F.round(-c["s"], 3).alias("score"))).alias("contenders"),
    )
    head = keywords.agg(F.expr("percentile_disc(0.75) WITHIN GROUP (ORDER BY volume_mid)").alias("head_volume"))
    k = merged(keywords.select("normalized", "volume_mid"), rated, "normalized", "left").crossJoin(F.broadcast(head))
    one_group = (F.col("gids") == 1) & (F.col("n_gid") == F.col("n"))
    score = F.coalesce("best", F.lit(0.0))
    status = F.when((F.coalesce("n", F.lit(0)) >= 2) & ~one_group, "CANNIBAL").when(score >= OWN, "OWNED").when(score >= WEAK, "WEAK").otherwise("GAP")
    k = k.withColumn("status", status)
    owned = F.col("status").isin("OWNED", "CANNIBAL")
    kind, length = F.col("top.page_type"), F.size(F.split("normalized", " "))
    inverted = F.when(owned & (F.col("volume_mid") >= F.col("head_volume")) & (kind == "product"), "head term owned by a product").when(owned & (F.col("volume_mid") < F.col("head_volume")) & (length >= LONG_TAIL) & (kind == "collection"), "long tail owned by a collection")
    return k.select("normalized", "volume_mid", "status", F.round(score, 3).alias("score"), F.col("top.url").alias("owner"), kind.alias("owner_page_type"), F.coalesce("contenders", F.array().cast("array<struct<url:string,page_type:string,score:double>>")).alias("contenders"), inverted.alias("inverted"))


def ranked(mapped: DataFrame) -> DataFrame:
    rank = F.when(F.col("status") == "GAP", 0).when(F.col("status") == "CANNIBAL", 1).when(F.col("status") == "WEAK", 2).otherwise(3)
    return mapped.orderBy(rank, F.desc("volume_mid"), "normalized")


def gap_clusters(gaps: DataFrame) -> DataFrame:
    """(head, keywords, size, volume, action): the commonest two-word run takes all that hold it, again and again.

    A run that is the commonest of all runs of each keyword that holds it will be taken
    with just these keywords whatever is taken before, so each round takes all such runs
    at once; what shares no run at the end stands alone.  Ties go to the first run.
    """
    spark = gaps.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(store.shared_dir(spark))
    words = text.target_tokens(F.col("normalized"))
    runs = F.when(F.size(words) >= 2, F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.array_join(F.slice(words, i, F.lit(2)), " ")))).otherwise(F.array().cast("array<string>"))
    gaps = store.written(gaps.select("normalized", "volume_mid"), "gaps")  # read in each round and at the end, made once
    left = gaps.select("normalized").distinct().select("normalized", F.explode(runs).alias("run")).checkpoint()
    taken: DataFrame | None = None
    for n in count(1):
        sizes = left.groupBy("run").agg(F.count("*").alias("n")).filter("n >= 2")
        best = left.join(sizes, "run").groupBy("normalized").agg(F.min(F.struct((-F.col("n")).alias("n"), "run")).alias("b")).select("normalized", "b.run", (-F.col("b.n")).alias("n"))
        whole = best.groupBy("run", "n").agg(F.count("*").alias("have")).filter("have = n").select("run")
        got = best.join(whole, "run").select("normalized", F.col("run").alias("head")).checkpoint()
        if got.isEmpty():
            break
        taken = got if taken is None else taken.unionByName(got)
        taken = taken if n % 20 else taken.checkpoint()
        left = left.join(got.select("normalized"), "normalized", "left_anti").checkpoint()
    rows = gaps.select("normalized", "volume_mid")
    every = rows.withColumn("head", F.col("normalized")) if taken is None else rows.join(taken, "normalized", "left").withColumn("head", F.coalesce("head", "normalized"))
    members = F.transform(F.sort_array(F.collect_list(F.struct((-F.col("volume_mid")).alias("v"), "normalized"))), lambda m: m["normalized"])
    out = every.groupBy("head").agg(members.alias("keywords"), F.count("*").alias("size"), F.sum("volume_mid").alias("volume"))
    return out.withColumn("action", action()).orderBy(F.desc("volume"), F.desc("size"), "head")


def action() -> Column:
    """What to do about a cluster, in a line."""
    number = F.concat(F.col("size"), F.when(F.col("size") == 1, " keyword").otherwise(" keywords"))
    return F.concat(number, F.lit(" with "), F.format_number(F.col("volume").cast("bigint"), 0), F.lit(" searches and no page of their own: consider a collection or landing page for '"), "head", F.lit("'"))


def page_targets(pages: DataFrame, indexable_only: bool = True) -> DataFrame:
    """(url, title, h1, product_group_id, inlinks) from a live page table or a stored sheet of pages.

    Columns are found by name, in any case, as the table or the sheet has them; what isn't
    there is lenient: a page without a status or a word on being indexable may be a target.
    """
    have = {c.strip().lower(): c for c in pages.columns}

    def cell(*names: str) -> Column:
        return next((F.col(f"`{have[n]}`") for n in names if n in have), F.lit(None).cast("string"))

    if "url" not in have:
        raise ValueError("the pages have no url column")
    rows = pages.filter(F.coalesce(cell("url").cast("string"), F.lit("")) != "")
    if indexable_only:
        said = F.lower(F.coalesce(cell("indexable").cast("string"), F.lit("yes")))
        rows = rows.filter(F.coalesce(cell("status").try_cast("int"), F.lit(200)) == 200).filter(~said.isin("no", "false"))
    blank = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    group = F.trim(blank(cell("product_group_id", "product group", "product group id")))
    return rows.select(
        cell("url").cast("string").alias("url"), blank(cell("title")).alias("title"), blank(cell("h1")).alias("h1"),
        F.when(group != "", group).alias("product_group_id"), F.coalesce(cell("inlinks").try_cast("int"), F.lit(0)).alias("inlinks"),
    )


def status_counts(mapped: DataFrame) -> DataFrame:
    """(status, n) of all four, 0 where there are none."""
    every = mapped.sparkSession.createDataFrame([(s,) for s in ("OWNED", "WEAK", "GAP", "CANNIBAL")], "status string")
    return every.join(mapped.groupBy("status").agg(F.count("*").alias("n")), "status", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def sheets(mapped: DataFrame, clusters: DataFrame) -> dict[str, DataFrame]:
    """The keyword sheets: the map by urgency, the gaps by cluster, and who competes."""
    pages = F.array_join(F.transform("contenders", lambda c: F.format_string("%s (%.2f)", c["url"], c["score"])), "\n")
    rival = F.explode("contenders").alias("c")
    return {
        "keyword_map": ranked(mapped).select("normalized", "volume_mid", "status", "score", "owner", "owner_page_type", F.size("contenders").alias("rivals"), pages.alias("contenders"), "inverted"),
        "gaps": clusters.select("head", "size", "volume", "action", F.array_join("keywords", ", ").alias("keywords")),
        "cannibalization": mapped.filter("status = 'CANNIBAL'").select("normalized", "volume_mid", "owner", rival).select("normalized", "volume_mid", "owner", "c.url", "c.page_type", "c.score").orderBy(F.desc("volume_mid"), "normalized", F.desc("score"), "url"),
    }
