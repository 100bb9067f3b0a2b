"""A whole audit, from the crawl to the sheets; and a keyword map over one."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass
from datetime import UTC, datetime
from urllib.parse import urlencode

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.config import Config
from quarry.operators import dups, extract, findings, keywords, report, site, spelling, store
from quarry.sources import crawl, psi


@dataclass
class Audit:
    pages: DataFrame
    links: DataFrame
    findings: DataFrame
    changes: DataFrame | None
    blocked: bool


def analyse(spark: SparkSession, crawled: DataFrame, config: Config, sizes: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """(pages, links) with all that the findings read; sizes: (src) to (src, bytes), or none to leave images unmeasured."""
    table = extract.page_table(crawled, config.lang, config.furniture())
    pages = store.written(dups.with_shingle_simhash(table, F.col("content")), "pages")
    links = extract.link_table(pages)
    out = site.sample_images(site.inlinks(pages, links), config.image_sample_per_template)
    if sizes is not None and config.image_head_limit:
        found = store.written(sizes(site.wanted_images(out, config.image_head_limit).select("src")), "image-sizes")
        out = site.with_image_sizes(out, found, config.oversized_image_bytes, config.image_head_limit)
    if config.spelling()[0]:
        words = spark.read.text(config.dictionary).select(F.trim("value").alias("word"))
        whitelist = [*spelling.site_words(config.start_url), *config.spellcheck_whitelist]
        out = spelling.with_spelling(out, words, whitelist, config.brand_term_min_pages)
    return store.written(out, "audited"), links


def pagespeed(pages: DataFrame, config: Config, ask: Callable[[str], tuple[int, str]] | None = None) -> DataFrame:
    """The metrics of the most linked pages; ask(url) gives status and body."""
    service = "https://www.googleapis.com/pagespeedonline/v5/runPagespeed"

    def call(url: str) -> tuple[int, str]:
        query = urlencode({"url": url, "strategy": config.psi_strategy, "category": "performance", **({"key": config.psi_api_key} if config.psi_api_key else {})})
        a = crawl.http(f"{service}?{query}", crawl.Options(timeout=90))
        return a.status, a.body.decode("utf-8", "replace")

    targets = findings.psi_targets(pages, config.psi_top)
    got = psi.decode(psi.request(targets, ask or call, config.psi_delay))
    return store.written(got.join(F.broadcast(targets), "url"), "psi")  # psi_top rows


def run(spark: SparkSession, config: Config, get=crawl.http, head=crawl.head, stop: Callable[[], bool] = lambda: False, ask: Callable[[str], tuple[int, str]] | None = None) -> Audit:
    """Crawl, judge and write: sheets under output_dir/sheets, a page if wanted, and _meta.json with the time of the run."""
    options = config.crawl_options()
    fetched, _ = crawl.crawl(spark, config.start_url, options, get, config.cache_dir or None, stop, config.recrawl)
    pages, links = analyse(spark, fetched, config, lambda s: crawl.probe(s, options, head))
    found, speed, changes = findings.findings(pages, links), None, None
    if config.psi:
        speed = pagespeed(pages, config, ask)
        more = findings.gather(findings.psi_findings(speed).withColumns({"part": F.lit(""), "why": F.lit("Measured by PageSpeed.")}), findings.psi_details(speed))
        found = found.unionByName(more)
    found = store.written(found.orderBy(findings.severity_rank(F.col("severity")), F.desc("count"), "issue"), "findings")
    if config.diff_against:
        before, urls_before = report.read_previous(spark, config.diff_against)
        changes = report.diff_sheet(found, before, pages, urls_before)
    sheets = {"pages": report.pages_sheet(pages), "cells": report.marked_cells(pages).withColumn("cells", F.to_json("cells")), "findings": report.findings_sheet(found), "anchors": report.anchors_sheet(site.anchor_report(links)), "summary": report.summary_sheet(pages, found)}
    if changes is not None:
        sheets["diff"] = changes
    if speed is not None:
        sheets["psi"] = report.psi_sheet(speed).withColumn("cells", F.to_json("cells"))
    report.write_sheets(sheets, f"{config.output_dir}/sheets")
    if config.html_report:
        with open(report.report_path(config.output_dir, config.start_url, ".html"), "w", encoding="utf-8") as f:
            f.write(report.html_page(found, config.start_url, None if speed is None else report.psi_sheet(speed), changes))
    with open(f"{config.output_dir}/_meta.json", "w", encoding="utf-8") as f:
        json.dump({"start_url": config.start_url, "last_run": datetime.fromtimestamp(time.time(), UTC).isoformat()}, f)
    return Audit(pages, links, found, changes, crawl.was_blocked(fetched))


def keyword_audit(rows: DataFrame, pages: DataFrame, idf: bool = True, indexable_only: bool = True, **filters) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(funnel, map, gap clusters) of an export's typed rows over the pages of an audit."""
    wanted = keywords.clean(rows, **filters).select("normalized", F.coalesce("volume.mid", F.lit(0)).alias("volume_mid"))
    mapped = store.written(keywords.keyword_map(wanted, keywords.page_targets(pages, indexable_only), idf), "keyword-map")
    return keywords.funnel(rows, **filters), mapped, keywords.gap_clusters(mapped.filter("status = 'GAP'").select("normalized", "volume_mid"))
