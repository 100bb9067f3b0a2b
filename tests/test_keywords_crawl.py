import json

from pyspark.sql import functions as F

from quarry.operators import dups, keywords, spelling
from quarry.sources import crawl, exports, psi
from quarry.streaming import incremental

PAGES = [
    ("https://s.com/collections/card-holders", "Leather Card Holders", "Card Holders"), ("https://s.com/collections/bifold-wallets", "Bifold Wallets", "Bifold Wallets"),
    ("https://s.com/products/traditional-bifold-leather-wallet", "Traditional Bifold Leather Wallet", "Traditional Bifold"), ("https://s.com/", "Shop", "Home"),
]


def test_export_in_two_locales(spark, tmp_path):
    english = "Report\n2024\nKeyword,Avg. monthly searches,Three month change,Competition,Competition (indexed value),Top of page bid (low range)\nLeather Wallet,1K - 10K,+∞,High,90,1.20\nleather wallet,\"1,300\",0%,Low,3,\n"
    (tmp_path / "e.csv").write_bytes(b"\xef\xbb\xbf" + english.encode())
    local = "Poročilo\nKljučna beseda\tPovpr. mesečna iskanja\tKonkurenca\tKonkurenca (indeksirana vrednost)\nLeather Wallet\t1 tis. – 10 tis.\tVisoko\t90\n"
    (tmp_path / "s.csv").write_bytes(local.encode("utf-16"))
    a, b = (exports.read_keywords(spark, str(tmp_path / f)).orderBy("row_idx").collect() for f in ("e.csv", "s.csv"))
    assert (a[0].normalized, a[0].volume.mid, a[0].competition, a[0].competition_index) == (b[0].normalized, b[0].volume.mid, b[0].competition, b[0].competition_index) == ("leather wallet", 3162, "HIGH", 90.0)
    rows = exports.read_keywords(spark, str(tmp_path / "e.csv"))
    assert [r.volume.mid for r in keywords.clean(rows).collect()] == [3162]
    assert [(r.label, r["count"]) for r in keywords.funnel(rows, contains=["leather"], min_volume=2000).orderBy("ord").collect()] == [("rows", 2), ("after --contains", 2), ("after --min-volume", 1), ("unique", 1)]


def test_map(spark):
    pages = spark.createDataFrame(PAGES, "url string, title string, h1 string")
    k = spark.createDataFrame([("leather card holder", 500), ("unknown thing", 10), ("unknown thing two", 5)], "normalized string, volume_mid bigint")
    got = {r.normalized: r for r in keywords.keyword_map(k, pages).collect()}
    assert got["leather card holder"].status == "OWNED" and got["leather card holder"].owner.endswith("card-holders")
    assert got["unknown thing"].status == "GAP"
    gaps = keywords.gap_clusters(keywords.keyword_map(k, pages).filter("status = 'GAP'")).collect()
    assert [(g.head, g.size, g.volume) for g in gaps] == [("unknown thing", 2, 15)]


def test_gaps_of_the_whole_shop_against_brute_force(spark, tmp_path):
    import math
    import random
    from collections import Counter

    from quarry.plans import catalogue

    r = random.Random(4)
    colours = "almond azure beige coral cream forest ivory khaki lemon linen maroon navy".split()
    parts = [(k, " ".join(r.sample(colours, 5)), f"Brand{k % 7}", f"STANDARD {('TIN', 'STEEL')[k % 2]}", 1 + k % 50) for k in range(20, 140, 2)]
    spark.createDataFrame(parts, "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    kinds, on = ("products", "collections", "pages"), {}
    for k, name, brand, kind, _ in parts:
        slug = dict.fromkeys([kinds[k % 3], *name.split(), str(k)], 3)
        slug = {t[:-1] if t in ("products", "collections", "pages") else t: w for t, w in slug.items() if len(t) > 1}
        on[k] = dict.fromkeys([brand.lower(), *kind.lower().split()], 2) | slug
    df = Counter(t for x in on.values() for t in x)
    w = lambda t: 0.25 + 0.75 * max(0, min(1, math.log((len(on) + 1) / (df[t] + 1)) / math.log(len(on) + 1)))
    left = {}
    for name in {p[1] for p in parts}:
        s = [sum(w(t) * x.get(t, 0) for t in name.split()) / sum(w(t) * 3 for t in name.split()) for x in on.values()]
        if sum(v >= 0.75 and max(s) - v <= 0.25 for v in s) >= 2 or max(s) < 0.75:  # not owned
            left[name] = max(p[4] for p in parts if p[1] == name)
    assert 0 < len(left) < len({p[1] for p in parts})
    want = set()
    runs = {n: {f"{a} {b}" for a, b in zip(n.split(), n.split()[1:], strict=False)} for n in left}
    while runs:
        c = Counter(x for v in runs.values() for x in v)
        head = min(c, key=lambda x: (-c[x], x))
        took = [n for n, v in runs.items() if head in v] if c[head] > 1 else []
        want |= {(head, tuple(sorted(took, key=lambda n: (-left[n], n))))} if took else {(n, (n,)) for n in runs}
        runs = {n: v for n, v in runs.items() if took and n not in took}
    assert {(g.head, tuple(g.keywords)) for g in catalogue.gap_clusters(spark, str(tmp_path)).collect()} == want


def test_near_pairs_against_brute_force(spark):
    import random

    r = random.Random(3)
    base = [r.getrandbits(63) for _ in range(20)]
    prints = [(i, b ^ sum(1 << p for p in r.sample(range(63), r.randint(0, 10)))) for i, b in enumerate(base * 4)]
    want = {(a, b) for a, x in prints for b, y in prints if a < b and (x ^ y).bit_count() <= 8}
    pairs = dups.near_pairs(spark.createDataFrame(prints, "id bigint, simhash bigint"))
    assert {(p.a, p.b) for p in pairs.collect()} == want
    lead: dict[int, int] = {}
    near = lambda a, b: (min(a, b), max(a, b)) in want
    for i, _ in prints:
        if i not in lead:
            members = [j for j, _ in prints if j > i and j not in lead and near(i, j)]
            if members:
                lead.update({i: i} | dict.fromkeys(members, i))
    got = {x.id: x.leader for x in dups.leaders(pairs).collect()}
    assert {k: v for k, v in got.items() if k in lead} == lead


def test_leaders_of_a_long_chain(spark):
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:  # each id is near the next alone: a round settles two of them
        pairs = spark.createDataFrame([(i, i + 1) for i in range(209)], "a bigint, b bigint").coalesce(1)
        assert {x.id: x.leader for x in dups.leaders(pairs).collect()} == {i: i // 2 * 2 for i in range(210)}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)


def test_spelling(spark):
    t = spark.createDataFrame([(1, "The diffrence in colour is Ritza25 and USB well-made"), (2, None)], "id int, text string")
    d = spark.createDataFrame([(w,) for w in ("the", "in", "color", "and", "well", "made", "difference")], "word string")
    assert [r.token for r in spelling.unknown(t, d).collect()] == ["diffrence"]


SITE = {
    "/robots.txt": (200, {}, b"User-agent: *\nDisallow: /admin\nSitemap: https://t.com/map.xml"),
    "/map.xml": (200, {}, b"<urlset xmlns='http://www.sitemaps.org/schemas/sitemap/0.9'><url><loc>https://t.com/</loc></url><url><loc>https://t.com/orphan</loc></url></urlset>"),
    "/": (200, {"content-type": "text/html"}, b"<a href=/about>a</a><a href=/old>o</a><a href=/admin/x>no</a><a href=/gone>g</a>"),
    "/about": (200, {"content-type": "text/html"}, b"<a href=/ghost>g</a>"), "/ghost": (200, {"content-type": "text/html"}, b"x"), "/orphan": (200, {"content-type": "text/html"}, b"x"),
    "/old": (301, {"location": "/older"}, b""), "/older": (302, {"location": "/about"}, b""),
}


def answer(url, options):
    status, headers, body = SITE.get(url.removeprefix("https://t.com") or "/", (404, {}, b""))
    return crawl.Answer(status, headers, body)


def test_crawl(spark, tmp_path):
    pages, sitemap = crawl.crawl(spark, "https://t.com/", crawl.Options(delay=0.0, max_retries=0), answer, str(tmp_path / "c"))
    got = {r.url.removeprefix("https://t.com"): r for r in pages.collect()}
    assert set(got) == {"/", "/orphan", "/about", "/old", "/gone", "/ghost"}
    assert got["/old"].redirect_chain == ["301 -> https://t.com/older", "302 -> https://t.com/about"] and got["/gone"].status == 404
    assert got["/orphan"].in_sitemap and not got["/ghost"].in_sitemap and got["/ghost"].depth == 2
    assert crawl.parse_sitemap("<broken") == ([], [])


def test_breaker_and_interval():
    slept: list[float] = []
    f = crawl.Fetcher(crawl.Options(delay=0.5, forbidden_limit=3), lambda u, o: crawl.Answer(403, {}, b""), slept.append, lambda: 0.0)
    f.request("a"), f.request("b")
    try:
        f.request("c")
        raise AssertionError
    except crawl.CrawlBlocked:
        assert slept == [0.5, 1.0]


def test_psi(spark):
    p = json.dumps({"lighthouseResult": {"categories": {"performance": {"score": 0.855}}, "audits": {"total-blocking-time": {"numericValue": 210}}}, "loadingExperience": {"overall_category": "SLOW", "metrics": {"CUMULATIVE_LAYOUT_SHIFT_SCORE": {"percentile": 15}}}})
    r = psi.decode(spark.createDataFrame([("u", p), ("v", "no json")], "url string, payload string")).orderBy("url").collect()
    assert (r[0].performance_score, r[0].tbt_ms, r[0].field_cls, r[0].field_overall, r[0].has_field_data) == (0.855, 210.0, 0.15, "SLOW", True) and r[1].lcp_ms is None


def test_stream(spark, tmp_path):
    for n, rows in enumerate([[("u", 1, "a"), ("v", 1, "b")], [("u", 2, "c")]]):
        df = spark.createDataFrame(rows, "url string, fetched_at int, html string")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        incremental.run_available(spark, df.schema, str(tmp_path / "in"), str(tmp_path / "out"))
        state = spark.read.parquet(str(tmp_path / f"out/state-{n}")).filter(F.col("url") == "u").first()
    assert (state.fetched_at, state.html) == (2, "c")
