"""Sheets of a report as DataFrames, and its sinks: Parquet, CSV and one HTML page."""

from __future__ import annotations

import html
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import urls

from . import findings

EXAMPLES, CARD_URLS = 25, 100


def flat(c: Column, kind: str) -> Column:
    """Arrays as a | b, pairs as k=v."""
    if kind.startswith("array<struct<source"):
        return F.array_join(F.transform(c, lambda p: F.concat(p["source"], F.lit("="), p["price"])), ", ")
    if kind.startswith("array<struct<lang"):
        return F.array_join(F.transform(c, lambda p: F.concat(p["lang"], F.lit(" "), p["href"])), " | ")
    return F.array_join(c, " | ") if kind == "array<string>" else c


def pages_sheet(pages: DataFrame) -> DataFrame:
    """The page table for readers: flat columns, the most linked pages first."""
    hidden = {"content", "body", "links", "spell_text", "image_sources"}
    kinds = dict(pages.dtypes)
    cols = [flat(F.col(c), kinds[c]).alias(c) for c in pages.columns if c not in hidden and not kinds[c].startswith("array<struct<place")]
    return pages.select(*cols).withColumn("indexable", F.when(F.col("indexable"), "yes").otherwise("no")).orderBy(F.desc("inlinks"), "path_depth", "url")


def findings_sheet(found: DataFrame) -> DataFrame:
    return found.select("severity", "category", "issue", "count", "detail", F.array_join(F.slice("urls", 1, EXAMPLES), "\n").alias("examples"), "why_it_matters")


def anchors_sheet(anchors: DataFrame) -> DataFrame:
    return anchors.select("anchor", "target", "count", "sources", F.when(F.col("anchor") == "(no anchor text)", "empty").alias("flag"))


#: Cells of the page sheet that call for attention, as SQL.
CELLS = {
    "status": ("HIGH", "status >= 400 or status is null"), "indexable": ("MED", "not indexable"), "title": ("HIGH", "title_issue = 'missing'"), "title_length": ("LOW", "title_issue in ('too long', 'too short')"),
    "meta_description": ("MED", "meta_description_issue = 'missing'"), "canonical_state": ("HIGH", "canonical_state = 'cross-domain'"), "redirect_hops": ("MED", "redirect_hops > 1"), "h1_count": ("MED", "h1_count <> 1"),
    "heading_issues": ("LOW", "size(heading_issues) > 0"), "word_count": ("MED", "thin_content"), "images_missing_alt": ("LOW", "images_missing_alt > 0"), "hero_lazy": ("HIGH", "hero_lazy"),
    "viewport": ("HIGH", "viewport is null"), "price_consistent": ("HIGH", "is_product and not price_consistent"), "currency_consistent": ("HIGH", "is_product and not currency_consistent"), "review_suspicious": ("MED", "review_suspicious"),
}


def marked_cells(pages: DataFrame) -> DataFrame:
    """(url, cells): array<struct<column, severity>> of the cells to mark, in the sheet's order."""
    mark = lambda c, s, when: F.when(F.expr(when), F.struct(F.lit(c).alias("column"), F.lit(s).alias("severity")))
    return pages.select("url", F.array_compact(F.array(*(mark(c, *rule) for c, rule in CELLS.items()))).alias("cells"))


def severity_counts(found: DataFrame) -> DataFrame:
    """(severity, n) of all three, 0 where there are none."""
    levels = found.sparkSession.createDataFrame([("HIGH",), ("MED",), ("LOW",)], "severity string")
    return levels.join(found.groupBy("severity").agg(F.count("*").alias("n")), "severity", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def summary_sheet(pages: DataFrame, found: DataFrame, top: int = 10) -> DataFrame:
    """(part, ord, label, value, note): totals, severities, statuses, categories by their share of pages, and the first findings."""
    row = lambda part, ord_, label, value, note=None: F.struct(F.lit(part).alias("part"), ord_.cast("int").alias("ord"), label.alias("label"), value.cast("string").alias("value"), (note if note is not None else F.lit(None)).cast("string").alias("note")).alias("r")
    stats = findings.site_stats(pages)
    totals = stats.select(F.explode(F.array(*(row("total", F.lit(i), F.lit(c), F.col(c)) for i, c in enumerate(stats.columns)))).alias("r"))
    total = stats.first()["total_urls"]
    by = lambda *cols: F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*cols))  # noqa: E731  # over a few dozen rows
    severity = severity_counts(found).select(row("severity", findings.severity_rank(F.col("severity")), F.col("severity"), F.col("n")))
    status = findings.status_counts(pages).select(row("status", by("status_class"), F.col("status_class"), F.col("n")))
    share = findings.category_share(found, total).select(row("category", by(F.desc("pages"), "category"), F.col("category"), F.col("pages"), F.col("rate")))
    order = (findings.severity_rank(F.col("severity")), F.desc("count"), F.col("issue"))
    first = found.orderBy(*order).limit(top).select(row("finding", by(*order), F.col("issue"), F.col("count"), F.concat("severity", F.lit(": "), "why_it_matters")))
    return reduce(DataFrame.unionByName, (totals, severity, status, share, first)).select("r.*")


#: The largest good value of each metric, and what exceeding it counts as.
PSI_LIMITS = {
    "lcp_ms": (2500, "HIGH"), "cls": (0.1, "MED"), "tbt_ms": (200, "MED"), "fcp_ms": (1800, "MED"), "field_lcp_ms": (2500, "HIGH"), "field_cls": (0.1, "MED"), "field_inp_ms": (200, "MED"),
}


def psi_sheet(psi: DataFrame) -> DataFrame:
    """The PageSpeed metrics rounded for readers, and the cells that fail."""
    score = F.bround(F.col("performance_score") * 100).cast("int")
    metrics = ["lcp_ms", "cls", "tbt_ms", "fcp_ms", "speed_index_ms", "field_lcp_ms", "field_cls", "field_inp_ms"]
    mark = lambda c, s, when: F.when(when, F.struct(F.lit(c).alias("column"), s.alias("severity")))
    cells = [mark("score_pct", F.when(score < 50, "HIGH").otherwise("MED"), score < 90), *(mark(c, F.lit(s), F.col(c) > limit) for c, (limit, s) in PSI_LIMITS.items()), mark("field_overall", F.lit("HIGH"), F.col("field_overall") == "SLOW")]
    inlinks = F.col("inlinks") if "inlinks" in psi.columns else F.lit(None).cast("bigint")
    return psi.select("url", inlinks.alias("inlinks"), score.alias("score_pct"), *(F.bround(c, 3).alias(c) for c in metrics), "field_overall", "error", F.array_compact(F.array(*cells)).alias("cells"))


def diff_sheet(now: DataFrame, before: DataFrame, urls_now: DataFrame, urls_before: DataFrame, limit: int = findings.URL_LIMIT) -> DataFrame:
    """(change, severity, label, was, now): issues that came, went or moved, then urls that came and went, so many of each."""
    issues = findings.diff(now, before)
    w = Window.partitionBy("change").orderBy("label")
    pages = findings.diff_urls(urls_now, urls_before).withColumn("n", F.row_number().over(w)).filter(F.col("n") <= limit)
    order = F.array_position(F.array(*map(F.lit, ("new", "worsened", "improved", "fixed", "new url", "removed url"))), F.col("change"))
    none = F.lit(None).cast("bigint")
    return issues.unionByName(pages.select("change", F.lit("").alias("severity"), "label", none.alias("was"), none.alias("now"))).orderBy(order, findings.severity_rank(F.col("severity")), "label")


def read_sheet(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A sheet that write_sheets() stored, as Parquet or as CSV."""
    at = f"{folder}/{name}"
    first = spark.read.format("binaryFile").load(at).select("path").first()
    if first is None or not first.path.endswith(".csv"):
        return spark.read.parquet(at)
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(at)


def read_previous(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(findings, pages) of an earlier audit's sheets, for diff_sheet().

    A sheet of findings without urls, as older audits or hand-made ones have it, still counts by its count.
    """
    found = read_sheet(spark, folder, "findings").select("severity", "category", "issue", F.col("count").cast("int").alias("count"))
    return found.filter("severity is not null"), read_sheet(spark, folder, "pages").select("url").filter("url is not null")


def report_path(folder: str, url: str, ending: str, day: date | None = None) -> str:
    host = url.split("//", 1)[-1].split("/", 1)[0].removeprefix("www.")
    return f"{folder.rstrip('/')}/audit_{host}_{(day or date.today()).isoformat()}{ending}"


def write_sheets(sheets: dict[str, DataFrame], folder: str, kind: str = "parquet") -> None:
    for name, df in sheets.items():
        w = df.write.mode("overwrite")
        (w.option("header", True).option("escape", '"').csv if kind == "csv" else w.parquet)(f"{folder}/{name}")


def html_page(found: DataFrame, title: str, psi: DataFrame | None = None, changes: DataFrame | None = None) -> str:
    """One page without outside resources; findings are a few dozen rows, PageSpeed rows and changes bounded."""
    e = lambda x: html.escape("" if x is None else str(x))
    cards = []
    for r in found.toLocalIterator():
        items = "".join(f"<li>{e(u)}</li>" for u in r.urls[:CARD_URLS])
        cards.append(f'<section class="{e(r.severity)}"><h2>{e(r.issue)}</h2><p>{e(r.severity)} · {e(r.category)} · {r["count"]}</p><p>{e(r.detail)}</p><p>{e(r.why_it_matters)}</p><ul>{items}</ul></section>')

    def block(name: str, df: DataFrame | None, columns: list[str]) -> str:
        if df is None:
            return ""
        head_ = "".join(f"<th>{e(c)}</th>" for c in columns)
        rows = "".join("<tr>" + "".join(f"<td>{e(v)}</td>" for v in r) + "</tr>" for r in df.select(*columns).toLocalIterator())
        return f"<section><h2>{e(name)}</h2><table><tr>{head_}</tr>{rows}</table></section>"

    cards.append(block("PageSpeed", psi, ["url", "score_pct", "lcp_ms", "cls", "tbt_ms", "field_overall"]))
    cards.append(block("Changes", changes, ["change", "severity", "label", "was", "now"]))
    style = "body{font:15px sans-serif;max-width:60em;margin:auto}section{border-left:4px solid #ccc;padding:0 1em}.HIGH{border-color:#c00}.MED{border-color:#e90}td,th{padding:2px 8px;text-align:left}"
    return f"<!DOCTYPE html><html><head><meta charset=utf-8><title>{e(title)}</title><style>{style}</style></head><body><h1>{e(title)}</h1>{''.join(cards)}</body></html>"


def product_pages(pages: DataFrame) -> DataFrame:
    return pages.filter("is_product").select("url", urls.last_segment(F.col("url")).alias("name"), "prices", "price_consistent", "review_schema_count")
