"""The crawl: robots, sitemaps and pages, level by level.

Each level is one job: the frontier is what links and sitemaps name, less what was
seen (anti-join); its hosts are fetched each within one task, so the interval between
requests holds for a host however many executors there are.  Every level is written
to the crawl's folder with the interval and the refusals that it ended with: a crawl
that is called again on its folder goes on from there, and one that is stopped or
refused returns what it has.
"""

from __future__ import annotations

import time
import urllib.error
import urllib.request
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from urllib.parse import urljoin, urlsplit
from urllib.robotparser import RobotFileParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import urls
from quarry.operators import store

FETCHED = "url string, status int, final_url string, redirect_chain array<string>, content_type string, x_robots_tag string, html string, size_bytes bigint, response_ms int, error string"
BLOCKED = "blocked"


class CrawlBlocked(RuntimeError):
    """The site refused too many requests in a row."""


@dataclass(frozen=True)
class Options:
    max_urls: int = 10_000
    max_depth: int = 0
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    use_sitemap: bool = True
    follow_links: bool = True
    delay: float = 0.7
    timeout: float = 20.0
    user_agent: str = "quarry/1.0"
    respect_robots: bool = True
    max_retries: int = 3
    forbidden_limit: int = 10
    max_hops: int = 10
    headers: dict = field(default_factory=dict)


@dataclass
class Answer:
    status: int
    headers: dict[str, str]
    body: bytes


def head(url: str, o: Options) -> Answer:
    """The headers alone."""
    return http(url, o, "HEAD")


def http(url: str, o: Options, method: str = "GET") -> Answer:
    """One request without following redirects."""

    class Stay(urllib.request.HTTPRedirectHandler):
        def redirect_request(self, *args):  # noqa: ANN002
            return None

    request = urllib.request.Request(url, headers={"User-Agent": o.user_agent, **o.headers}, method=method)
    try:
        with urllib.request.build_opener(Stay).open(request, timeout=o.timeout) as r:
            return Answer(r.status, {k.lower(): v for k, v in r.headers.items()}, r.read())
    except urllib.error.HTTPError as e:
        return Answer(e.code, {k.lower(): v for k, v in e.headers.items()}, e.read())


class Fetcher:
    """Polite requests: an interval, retries that back off, a breaker for refusals."""

    def __init__(self, options: Options, get: Callable[[str, Options], Answer] = http, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic, refused: int = 0):
        self.o, self.get, self.sleep, self.clock = options, get, sleep, clock
        self.interval, self.due, self.refused = options.delay, None, refused

    def pace(self) -> None:
        """Begin no request within the interval of the last one."""
        now = self.clock()
        if self.due is not None and (early := self.due - now) > 0:
            self.sleep(early)
            now = self.due
        self.due = now + self.interval

    def request(self, url: str) -> Answer:
        for n in range(self.o.max_retries + 1):
            self.pace()
            try:
                a = self.get(url, self.o)
            except OSError:
                if n == self.o.max_retries:
                    raise
                self.sleep(min(2**n, 15))
                continue
            self.refused = self.refused + 1 if a.status == 403 else 0
            if self.refused >= self.o.forbidden_limit:
                raise CrawlBlocked(f"{self.refused} refusals in a row")
            if a.status != 429 and a.status < 500 or n == self.o.max_retries:
                return a
            if a.status == 429:  # twice as slow from now on, half a minute at most
                self.interval = min(30.0, 2 * max(self.interval, 0.1))
            after = a.headers.get("retry-after", "")
            self.sleep(min(float(after), 60) if after.isdigit() else min(2**n, 15))
        raise AssertionError

    def follow(self, url: str) -> tuple[str, Answer, list[str]]:
        """The last URL, its answer and the chain of redirects before it."""
        chain: list[str] = []
        at, a = url, self.request(url)
        while 300 <= a.status < 400 and len(chain) < self.o.max_hops:
            to = a.headers.get("location")
            if not to:
                break
            to = urljoin(at, to)
            chain.append(f"{a.status} -> {to}")
            if to == at:
                break
            at = to
            a = self.request(to)
        return at, a, chain

    def row(self, url: str) -> tuple:
        began = time.monotonic()
        try:
            final, a, chain = self.follow(url)
        except CrawlBlocked:
            return (url, 403, None, [], None, None, None, None, None, BLOCKED)
        except OSError as e:
            return (url, None, None, [], None, None, None, None, None, f"{type(e).__name__}: {e}")
        kind = a.headers.get("content-type", "")
        html = a.body.decode("utf-8", "replace") if "html" in kind and a.status == 200 else None
        return (url, a.status, final, chain, kind, a.headers.get("x-robots-tag"), html, len(a.body), int(1000 * (time.monotonic() - began)), None)


def read_robots(fetcher: Fetcher, site: str) -> tuple[RobotFileParser, list[str]]:
    """The site's rules, and the sitemaps that they name."""
    rules = RobotFileParser()
    try:
        a = fetcher.request(urljoin(site, "/robots.txt"))
        status, body = a.status, a.body.decode("utf-8", "replace")
    except OSError:
        status, body = 404, ""
    if status >= 500:
        rules.disallow_all = True
    elif status >= 400:
        rules.allow_all = True
    else:
        rules.parse(body.splitlines())
    return rules, rules.site_maps() or []


def parse_sitemap(xml: str) -> tuple[list[str], list[str]]:
    """(pages, sitemaps) that a sitemap names; nothing where it is broken."""
    try:
        root = ElementTree.fromstring(xml.encode())
    except ElementTree.ParseError:
        return [], []
    locs = [e.text.strip() for e in root.iter() if e.tag.rsplit("}", 1)[-1] == "loc" and e.text and e.text.strip()]
    return ([], locs) if root.tag.rsplit("}", 1)[-1] == "sitemapindex" else (locs, [])


def read_sitemaps(fetcher: Fetcher, site: str, named: list[str]) -> list[str]:
    todo, seen, pages = list(named) or [urljoin(site, "/sitemap.xml")], set(), []
    while todo:
        at = todo.pop(0)
        if at in seen:
            continue
        seen.add(at)
        try:
            a = fetcher.request(at)
        except OSError:
            continue
        if a.status == 200:
            found, more = parse_sitemap(a.body.decode("utf-8", "replace"))
            pages += found
            todo += more
    return pages


STATE = ", seq bigint, interval double, refused int"


def fetch(frontier: DataFrame, options: Options, get: Callable[[str, Options], Answer] = http, refused: int = 0) -> DataFrame:
    """(url ..) fetched; a host's pages in one task, the most important first (rank, depth, url).

    seq, interval and refused say in what state a host's requests ended.  Once a host
    refuses, its other pages are not asked for and have no row.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fetchers: dict[str, Fetcher] = {}
        stopped: set[str] = set()
        seq = 0
        for b in batches:
            rows = []
            for u in b["url"]:
                host = urlsplit(u).netloc
                if host in stopped:
                    continue
                f = fetchers.setdefault(host, Fetcher(options, get, refused=refused))
                row = f.row(u)
                if row[-1] == BLOCKED:
                    stopped.add(host)
                rows.append((*row, seq, f.interval, f.refused))
                seq += 1
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in (FETCHED + STATE).split(", ")])

    order = [*(["rank"] if "rank" in frontier.columns else []), F.size(urls.segments(F.col("url"))), "url"]
    store.prepare(frontier.sparkSession)
    placed = frontier.repartition(urls.host(F.col("url"))).sortWithinPartitions(*order)
    return placed.select("url").mapInPandas(run, FETCHED + STATE)


def probe(sources: DataFrame, options: Options, get: Callable[[str, Options], Answer] = head) -> DataFrame:
    """(src, bytes): the Content-Length of each distinct src, asked for once; null where it can't be had."""

    def size(f: Fetcher, src: str) -> int | None:
        try:
            return int(f.request(src).headers.get("content-length") or 0)
        except (OSError, ValueError, CrawlBlocked):
            return None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fetchers: dict[str, Fetcher] = {}
        for b in batches:
            found = [size(fetchers.setdefault(urlsplit(s).netloc, Fetcher(options, get)), s) for s in b["src"]]
            yield pd.DataFrame({"src": b["src"], "bytes": pd.array(found, dtype="Int64")})

    store.prepare(sources.sparkSession)
    return sources.select("src").filter("src is not null").distinct().repartition(urls.host(F.col("src"))).sortWithinPartitions("src").mapInPandas(run, "src string, bytes bigint")


def _levels(spark: SparkSession, folder: str) -> int:
    """How many levels a folder holds in full."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    n = 0
    while True:
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{n:05d}/_SUCCESS")
        if not path.getFileSystem(conf).exists(path):
            return n
        n += 1


def was_blocked(pages: DataFrame) -> bool:
    return not pages.filter(F.col("error") == BLOCKED).isEmpty()


def crawl(
    spark: SparkSession, start: str, options: Options = Options(), get: Callable[[str, Options], Answer] = http, folder: str | None = None, stop: Callable[[], bool] = lambda: False, recrawl: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(pages, sitemap): fetched pages with depth, discovered_by and in_sitemap; the sitemap's urls.

    folder: where the levels are; those that are there already are kept, but for recrawl.
    stop is asked before each level; what there is until then is the result.  A level in
    which the site refused is the last one (see was_blocked); the refused pages are asked
    for again when the crawl goes on.
    """
    from quarry.operators import extract, store

    folder = (folder or f"{store.shared_dir(spark)}/crawl-{uuid.uuid4().hex}") + (f"/again-{uuid.uuid4().hex}" if recrawl else "")
    fetcher = Fetcher(options, get)
    rules, named = read_robots(fetcher, start)
    if delay := rules.crawl_delay(options.user_agent):
        fetcher.interval = max(fetcher.interval, float(delay))
    listed = read_sitemaps(fetcher, start, named) if options.use_sitemap else []
    u = F.col("url")
    sitemap = spark.createDataFrame([(x,) for x in listed], "url string").select(urls.normalize(u).alias("url")).filter(urls.same_site(u, F.lit(start)) & urls.is_crawlable(u)).distinct()

    def crawlable(df: DataFrame) -> DataFrame:
        scoped = df.filter(urls.same_site(u, F.lit(start)) & urls.is_crawlable(u) & urls.allowed(u, list(options.include), list(options.exclude)))
        if not options.respect_robots:
            return scoped
        agent = options.user_agent

        def permitted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield b[[rules.can_fetch(agent, x) for x in b["url"]]]

        return scoped.mapInPandas(permitted, scoped.schema)

    def fetched(n: int) -> DataFrame:
        return spark.read.parquet(*(f"{folder}/{i:05d}" for i in range(n)))

    first = spark.createDataFrame([(start,)], "url string").select(urls.normalize(u).alias("url"), F.lit(0).alias("rank"), F.lit("start").alias("discovered_by"))
    first = first.unionByName(sitemap.select("url", F.lit(2).alias("rank"), F.lit("sitemap").alias("discovered_by")))
    depth = _levels(spark, folder)
    interval, refused = fetcher.interval, 0
    while not stop():
        frontier, taken = first, 0
        if depth:
            done = fetched(depth)
            if not options.follow_links and done.filter(F.col("error") == BLOCKED).isEmpty():
                break
            back = 2 if was_blocked(done) else 1  # a refused level leaves pages that the one before names
            links = extract.link_table(extract.page_table(done.filter(F.col("depth") >= depth - back).select("url", "html")))
            frontier = first.unionByName(links.filter("internal").select(F.col("target").alias("url"), F.lit(1).alias("rank"), F.lit("link").alias("discovered_by")).distinct())
            # what was refused, and what was left when it was, comes again
            again = done.filter(F.col("error") == BLOCKED).select("url", F.lit(0).alias("rank"), "discovered_by")
            frontier = frontier.unionByName(again)
            known = done.filter(F.coalesce(F.col("error") != BLOCKED, F.lit(True))).select("url")
            last = done.filter(F.col("depth") == depth - 1).agg(F.count("*").alias("n"), F.max("interval").alias("interval"), F.max_by("refused", "seq").alias("refused")).first()
            taken = known.count()
            interval, refused = max(interval, last.interval or 0.0), 0 if was_blocked(done) else last.refused or 0
        if taken >= options.max_urls or (options.max_depth and depth > options.max_depth):
            break
        todo = crawlable(frontier).groupBy("url").agg(F.min_by("discovered_by", "rank").alias("discovered_by"), F.min("rank").alias("rank"))
        if depth:
            todo = todo.join(known, "url", "left_anti")
        todo = store.written(todo.orderBy("rank", F.size(urls.segments(u)), "url").limit(options.max_urls - taken), "frontier")
        if todo.isEmpty():
            break
        level = fetch(todo, replace(options, delay=interval), get, refused).join(todo, "url").withColumn("depth", F.lit(depth)).drop("rank")
        level.write.mode("overwrite").parquet(f"{folder}/{depth:05d}")
        depth += 1
        if was_blocked(spark.read.parquet(f"{folder}/{depth - 1:05d}")):
            break
    if not depth:
        pages = spark.createDataFrame([], FETCHED + STATE + ", discovered_by string, depth int")
    else:
        w = Window.partitionBy("url").orderBy(F.desc("depth"))  # of a page that was refused, then fetched, the last
        pages = fetched(depth).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
    flags = sitemap.withColumn("in_sitemap", F.lit(True))
    return pages.drop("seq", "interval", "refused").join(flags, "url", "left").withColumn("in_sitemap", F.coalesce("in_sitemap", F.lit(False))), sitemap
