"""The command line: quarry URL, and quarry keywords.

Exit codes: 0 done; 1 refused by the site, or nothing was left to work on; 2 wrong usage,
settings or file; 130 interrupted.
"""

from __future__ import annotations

import argparse
import os
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry import audit
from quarry.config import AGENT, ConfigError, read_file, resolve
from quarry.operators import findings, keywords, report
from quarry.sources import exports

DEFAULT_FILE = "quarry.toml"
ROWS, CLUSTERS = 15, 5


def audit_parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quarry", description="Audit a website. 'quarry keywords --help' tells of keyword maps.")
    p.add_argument("start_url", nargs="?")
    p.add_argument("-c", "--config")
    for name, kind in (("max-urls", int), ("max-depth", int), ("delay", float), ("timeout", float), ("user-agent", str), ("image-head-limit", int), ("image-sample-per-template", int), ("near-duplicate-distance", int),
                       ("lang", str), ("dictionary", str), ("psi-top", int), ("psi-strategy", str), ("cache-dir", str)):
        p.add_argument(f"--{name}", type=kind)
    for name in ("include", "exclude"):
        p.add_argument(f"--{name}", action="append", metavar="REGEX")
    p.add_argument("--whitelist", dest="spellcheck_whitelist", action="append", metavar="WORD")
    p.add_argument("--spellcheck-engine", choices=("auto", "dictionary", "off"))
    p.add_argument("--psi-key", dest="psi_api_key")
    p.add_argument("--diff", dest="diff_against", metavar="FOLDER")
    p.add_argument("-o", "--output-dir")
    for flag, dest, value in (("--no-sitemap", "use_sitemap", False), ("--sitemap-only", "follow_links", False), ("--ignore-robots", "respect_robots", False), ("--no-spellcheck", "spellcheck", False), ("--psi", "psi", True), ("--html", "html_report", True), ("--recrawl", "recrawl", True)):
        p.add_argument(flag, dest=dest, action="store_const", const=value)
    p.add_argument("-q", "--quiet", action="store_true")
    return p


def keyword_parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quarry keywords", description="Map the keywords of a planner's export to the pages of an audit.")
    p.add_argument("--gkp", required=True, help="the export")
    p.add_argument("--crawl", help="the folder of sheets of an audit")
    p.add_argument("--url", help="crawl this instead")
    p.add_argument("--max-urls", type=int, default=500)
    p.add_argument("--delay", type=float)
    for name in ("contains", "not-contains", "brand"):
        p.add_argument(f"--{name}", action="append", default=[])
    p.add_argument("--min-volume", type=int, default=0)
    p.add_argument("--no-idf", dest="idf", action="store_false")
    p.add_argument("--include-non-indexable", dest="indexable_only", action="store_false")
    p.add_argument("--output", "-o", default=".")
    p.add_argument("--geo-note", default="")
    return p


def table(df: DataFrame, n: int) -> str:
    """The first n rows as lines of text."""
    rows = [df.columns, *([("" if v is None else str(v)) for v in r] for r in df.limit(n).collect())]
    wide = [min(60, max(len(r[i]) for r in rows)) for i in range(len(df.columns))]
    return "\n".join("  ".join(v[:60].ljust(w) for v, w in zip(r, wide, strict=True)).rstrip() for r in rows)


def run_audit(argv: list[str], spark: Callable[[], SparkSession], say: Callable[[str], None], **fetch) -> int:
    args = vars(audit_parser().parse_args(argv))
    path = args.pop("config") or (DEFAULT_FILE if os.path.isfile(DEFAULT_FILE) else None)
    quiet = args.pop("quiet")
    given, unknown = read_file(path) if path else ({}, [])
    config = resolve({"psi_api_key": os.environ.get("PSI_API_KEY")}, given, args)
    if not config.start_url:
        raise ConfigError("name the URL to start from")
    if not quiet:
        for k in unknown:
            say(f"unknown setting: {k}")
        if config.user_agent == AGENT:
            say("the user agent names nobody: set user_agent to an address of yours")
        if warning := config.spelling()[1]:
            say(warning)
    done = audit.run(spark(), config, **fetch)
    if done.pages.isEmpty():
        say("nothing was fetched")
        return 1
    say(table(report.severity_counts(done.findings).orderBy(findings.severity_rank(F.col("severity"))), 3))
    if not quiet:
        say(table(done.findings.select("severity", "category", "issue", "count"), ROWS))
        if done.changes is not None:
            say(table(done.changes, ROWS))
    if done.blocked:
        say("the site refused too many requests in a row: the audit covers what came before")
    return 1 if done.blocked else 0


def run_keywords(argv: list[str], spark: Callable[[], SparkSession], say: Callable[[str], None], **fetch) -> int:
    args = keyword_parser().parse_args(argv)
    if not (args.crawl or args.url):
        raise ConfigError("name --crawl or --url")
    s = spark()
    if not os.path.exists(args.gkp):
        raise FileNotFoundError(f"{args.gkp} is not there")
    raw = exports.read_keywords(s, args.gkp)
    if args.crawl:
        pages = report.read_sheet(s, args.crawl, "pages")
    else:
        pages = audit.run(s, resolve({"start_url": args.url, "max_urls": args.max_urls, "delay": args.delay, "output_dir": args.output, "spellcheck": False, "image_head_limit": 0}), **fetch).pages
    funnel, mapped, clusters = audit.keyword_audit(raw, pages, args.idf, args.indexable_only, contains=args.contains, not_contains=args.not_contains, brands=args.brand, min_volume=args.min_volume)
    if mapped.isEmpty():
        say("no keyword is left")
        return 1
    report.write_sheets(keywords.sheets(mapped, clusters), f"{args.output}/sheets")
    say("volumes are ranges of the planner" + (f"; {args.geo_note}" if args.geo_note else ""))
    say(table(funnel.orderBy("ord").select("label", "count"), ROWS))
    say(table(keywords.status_counts(mapped).orderBy("status"), 4))
    say(table(clusters.filter("size > 1").select("head", "size", "volume", "action"), CLUSTERS))
    by_volume = mapped.orderBy(F.desc("volume_mid"), "normalized")
    say(table(by_volume.filter("status = 'CANNIBAL'").select("normalized", "volume_mid", F.array_join("contenders.url", " ").alias("pages")), CLUSTERS))
    say(table(by_volume.filter("inverted is not null").select("normalized", "inverted", "owner"), CLUSTERS))
    return 0


def main(argv: list[str] | None = None, spark: Callable[[], SparkSession] = lambda: SparkSession.builder.appName("quarry").getOrCreate(), say: Callable[[str], None] = print, **fetch) -> int:
    argv = sys.argv[1:] if argv is None else argv
    try:
        return run_keywords(argv[1:], spark, say, **fetch) if argv[:1] == ["keywords"] else run_audit(argv, spark, say, **fetch)
    except (ConfigError, exports.KeywordFileError, FileNotFoundError) as e:
        say(f"error: {e}")
        return 2
    except SystemExit as e:  # argparse: 0 for help, 2 for wrong usage
        return int(e.code or 0)
    except KeyboardInterrupt:
        return 130


if __name__ == "__main__":
    sys.exit(main())
