"""Whole audits of a small site, and what they are made of."""

import json
import os

import pytest

from quarry import audit, cli
from quarry.config import Config, ConfigError, read_file, resolve
from quarry.operators import dups, findings, keywords, report, site, spelling
from quarry.sources import crawl

HTML = {"content-type": "text/html"}
WORDS = "the good leather wallet is made by hand and holds ten cards in one pocket of fine soft leather for every day".split()


def body(n: int, extra: str = "") -> bytes:
    words = " ".join(WORDS[(i * (n + 3)) % len(WORDS)] for i in range(60))
    images = "<img src=/logo.png><img src=/hero%d.jpg width=1200>" % n
    return f"<html lang=en><head><title>The wallet number {n} made by hand</title><meta name=viewport content=x></head><body><main><h1>The wallet</h1>{images}<p>{words}. And Ritza made it. {extra}</p></main><a href=/p/a>a</a><a href=/p/b>b</a><a href=/gone>gone</a></body></html>".encode()


SITE = {
    "/": (200, HTML, body(1)), "/p/a": (200, HTML, body(2, "A diffrence and acheive, a diffrence.")), "/p/b": (200, HTML, body(3, "A diffrence")), "/p/c": (200, HTML, body(4)),
    "/sitemap.xml": (200, {}, b"<urlset><url><loc>https://t.com/p/c</loc></url></urlset>"),
}


def get(url, options):
    status, headers, text = SITE.get(url.removeprefix("https://t.com") or "/", (404, {}, b""))
    return crawl.Answer(status, headers, text)


def head(url, options):
    if "hero2" in url:
        raise OSError("no")
    return crawl.Answer(200, {"content-length": str(1024 * (400 if "hero" in url else 4))}, b"")


@pytest.fixture(scope="module")
def done(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("audit")
    (at / "words.txt").write_text("\n".join([*WORDS, "number", "wallet", "made", "hand", "ritz"]))
    config = resolve({"start_url": "https://t.com/", "delay": 0.0, "max_retries": 0, "output_dir": str(at), "dictionary": str(at / "words.txt"), "html_report": True, "brand_term_min_pages": 3})
    return at, config, audit.run(spark, config, get, head)


def test_audit(spark, done):
    at, _, a = done
    pages = {r.url.removeprefix("https://t.com"): r for r in a.pages.collect()}
    assert set(pages) == {"/", "/p/a", "/p/b", "/p/c", "/gone"}
    # images: the logo counts once and is small; what can't be measured is no finding
    assert pages["/p/b"].images_oversized == ["https://t.com/hero3.jpg (400 KB)"] and pages["/p/b"].largest_image_kb == 400
    assert pages["/p/a"].images_oversized == [] and pages["/p/a"].largest_image_kb == 4
    # spelling: brand terms on three pages are none; order of appearance, each word once
    assert pages["/p/a"].spelling_body == ["diffrence", "acheive"] and pages["/p/a"].spelling_body_count == 2 and pages["/"].spelling_body == []
    found = {r.issue: r for r in a.findings.collect()}
    assert "2 pages; 3 words; the most, 2, on https://t.com/p/a" in found["Typos in body content"].detail
    assert "heaviest, 400 KB, on https://t.com/" in found["Oversized images"].detail and found["Oversized images"]["count"] == 3
    assert "https://t.com/ -> https://t.com/gone (404)" in found["Broken internal links"].detail
    assert json.load(open(at / "_meta.json"))["start_url"] == "https://t.com/"
    html = next(x for x in os.listdir(at) if x.endswith(".html"))
    assert "Oversized images" in (at / html).read_text()
    summary = {(r.part, r.label): r for r in spark.read.parquet(f"{at}/sheets/summary").collect()}
    assert summary["total", "total_urls"].value == "5" and summary["status", "4xx"].value == "1" and summary["category", "images"].note == "80%" and ("finding", "Broken internal links") in summary
    cells = {r.url: json.loads(r.cells) for r in spark.read.parquet(f"{at}/sheets/cells").collect()}
    assert {"column": "status", "severity": "HIGH"} in cells["https://t.com/gone"]


def test_diff_against_the_stored_audit(spark, done):
    at, _, a = done
    before, urls_before = report.read_previous(spark, f"{at}/sheets")
    assert report.diff_sheet(a.findings, before, a.pages, urls_before).isEmpty()
    less = before.filter("issue <> 'Oversized images'")
    got = report.diff_sheet(a.findings, less, a.pages, urls_before.filter("url not like '%gone'")).collect()
    assert [(r.change, r.label) for r in got] == [("new", "images|Oversized images"), ("new url", "https://t.com/gone")]
    report.write_sheets({"findings": report.findings_sheet(a.findings), "pages": report.pages_sheet(a.pages)}, f"{at}/csv", "csv")
    before, urls_before = report.read_previous(spark, f"{at}/csv")
    assert report.diff_sheet(a.findings, before, a.pages, urls_before).isEmpty()


def test_crawl_goes_on_after_a_stop_and_a_refusal(spark, tmp_path):
    options, folder, asked = crawl.Options(delay=0.0, max_retries=0, forbidden_limit=1), str(tmp_path / "c"), iter([False, True])
    first, _ = crawl.crawl(spark, "https://t.com/", options, get, folder, lambda: next(asked))
    assert {r.url for r in first.select("url").collect()} == {"https://t.com/", "https://t.com/p/c"}
    refuse = lambda u, o: crawl.Answer(403, {}, b"") if "/p/a" in u else get(u, o)
    second, _ = crawl.crawl(spark, "https://t.com/", options, refuse, folder)
    assert crawl.was_blocked(second) and second.filter("url like '%/p/b'").isEmpty()  # /gone and /p/a come before /p/b
    third, _ = crawl.crawl(spark, "https://t.com/", options, get, folder)
    assert {r.url.removeprefix("https://t.com") for r in third.filter("error is null").collect()} == {"/", "/p/a", "/p/b", "/p/c", "/gone"} and third.count() == 5
    assert crawl.crawl(spark, "https://t.com/", options, get, folder)[0].count() == 5


def test_state_goes_from_level_to_level(spark):
    slow = {"n": 0}

    def busy(url, options):
        return crawl.Answer(429 if url.endswith("a") else 403, {"retry-after": "0"}, b"")

    f = spark.createDataFrame([("https://t.com/a", 1), ("https://t.com/b", 2)], "url string, rank int").coalesce(1)
    got = crawl.fetch(f, crawl.Options(delay=0.0, max_retries=1), busy, refused=3).orderBy("seq").collect()
    assert [r.url[-1] for r in got] == ["a", "b"] and got[0].interval == 0.2 and got[1].refused == 1 and not slow["n"]


def test_near_clusters_of_copies(spark):
    prints = [(1, 0), (2, 0b1111), (3, 0), (4, -1), (5, -1), (6, 0b1111), (7, 1 << 40)]
    df = spark.createDataFrame(prints, "id bigint, simhash bigint")
    want = {x.id: x.leader for x in dups.leaders(dups.near_pairs(df)).collect()}
    assert {x.id: x.leader for x in dups.near_clusters(df).collect()} == want == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 1, 7: 1}


def test_targets_sheets_and_action(spark):
    sheet = spark.createDataFrame([("u", "T", "yes", "200", "3", "g"), ("v", None, "no", "200", None, None), ("w", "", None, "404", "", " "), ("x", None, None, None, None, " ")], "URL string, title string, Indexable string, status string, inlinks string, product_group_id string")
    assert [tuple(r) for r in keywords.page_targets(sheet).orderBy("url").collect()] == [("u", "T", "", "g", 3), ("x", "", "", None, 0)]
    assert keywords.page_targets(sheet, False).count() == 4
    with pytest.raises(ValueError, match="url"):
        keywords.page_targets(sheet.drop("URL"))
    gaps = spark.createDataFrame([("leather wallet red", 1000), ("leather wallet", 500), ("belt", 5)], "normalized string, volume_mid bigint")
    got = keywords.gap_clusters(gaps).collect()
    assert [(r.head, r.size, r.volume) for r in got] == [("leather wallet", 2, 1500), ("belt", 1, 5)] and "2 keywords with 1,500 searches" in got[0].action and "1 keyword with 5" in got[1].action


def test_psi_sheet(spark):
    cols = "url string, performance_score double, lcp_ms double, cls double, tbt_ms double, fcp_ms double, speed_index_ms double, field_lcp_ms double, field_cls double, field_inp_ms double, field_overall string, error string"
    r = report.psi_sheet(spark.createDataFrame([("u", 0.451, 2600.12345, 0.1, None, 1.0, 1.0, None, 0.2, None, "SLOW", None)], cols)).first()
    assert (r.score_pct, r.lcp_ms) == (45, 2600.123) and {c["column"]: c["severity"] for c in r.cells} == {"score_pct": "HIGH", "lcp_ms": "HIGH", "field_cls": "MED", "field_overall": "HIGH"}


def test_pagespeed(spark, done):
    payload = json.dumps({"lighthouseResult": {"categories": {"performance": {"score": 0.5}}, "audits": {"largest-contentful-paint": {"numericValue": 3000.0}}}})
    _, config, a = done
    speed = audit.pagespeed(a.pages, resolve({"psi_top": 2, "psi_delay": 0.0}), lambda u: (200, payload))
    assert speed.count() == 2 and {r.issue: r.more for r in findings.psi_details(speed).collect()}["LCP above 2.5s"].startswith("the worst, 3000 ms, on https://t.com/")
    assert report.psi_sheet(speed).first().score_pct == 50


def test_settings(tmp_path):
    (tmp_path / "a.toml").write_text('[quarry]\nmax_urls = 5\ninclude = ["/p/"]\nodd = 1\n')
    (tmp_path / "b.toml").write_text("max_urls = \n")
    given, unknown = read_file(str(tmp_path / "a.toml"))
    assert unknown == ["odd"] and resolve(given, {"max_urls": None, "delay": 1}) == Config(max_urls=5, include=("/p/",), delay=1.0)
    for bad in ({"max_urls": "5"}, {"include": ["("]}, {"html_report": 1}, {"spellcheck_engine": "x"}):
        with pytest.raises(ConfigError):
            resolve(bad)
    with pytest.raises(ConfigError):
        read_file(str(tmp_path / "b.toml"))
    with pytest.raises(ConfigError):
        read_file(str(tmp_path / "none.toml"))


def test_command_line(spark, tmp_path, done):
    said: list[str] = []
    run = lambda *a, **k: cli.main(list(a), lambda: spark, said.append, **k)
    assert run() == 2 and run("--nonsense") == 2 and run("keywords", "--gkp", "x") == 2 and run("keywords", "--gkp", str(tmp_path / "none"), "--crawl", "y") == 2
    assert run("https://t.com/", "--delay", "0", "--no-spellcheck", "-o", str(tmp_path), "--diff", f"{done[0]}/sheets", get=get, head=head) == 0
    assert any("Oversized images" in s for s in said)
    refuse = lambda u, o: crawl.Answer(403, {}, b"")
    assert run("https://t.com/", "--delay", "0", "-q", "-o", str(tmp_path), get=lambda u, o: get(u, o) if u.endswith((".txt", ".xml")) else refuse(u, o), head=head) in (0, 1)
    (tmp_path / "k.csv").write_text("Keyword,Avg. monthly searches\nleather wallet,100 - 1000\nwallet number hand,1000\nblue shoe,10\n")
    assert run("keywords", "--gkp", str(tmp_path / "k.csv"), "--crawl", f"{done[0]}/sheets", "--output", str(tmp_path)) == 0
    assert spark.read.parquet(f"{tmp_path}/sheets/keyword_map").count() == 3
    assert run("keywords", "--gkp", str(tmp_path / "k.csv"), "--crawl", f"{done[0]}/sheets", "--contains", "nothing", "--output", str(tmp_path)) == 1


def test_site_words_and_coverage(spark):
    assert spelling.site_words("https://www.acme-leather.co.uk/x") == ["acme", "acme-leather.co.uk", "leather"]
    pages = spark.createDataFrame([("a", 200, True), ("b", 200, False), ("c", 404, True)], "url string, status int, images_sized boolean")
    assert tuple(site.image_coverage(pages).first()) == (1, 1)
    assert findings.URL_LIMIT == 200
