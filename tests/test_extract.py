from pyspark.sql import functions as F

from quarry.operators import dups, extract, findings, site

GOOD = """<html lang="en-GB"><head><title>A title that is neither short nor long</title>
<meta name="description" content="short"><link rel="canonical" href="/products/x?utm_source=a"><meta name="viewport" content="w">
<meta property="og:price:amount" content="169.00"><meta name="robots" content="noindex, follow">
<link rel="alternate" hreflang="de" href="/de"><link rel="alternate" hreflang="english" href="/e"><link rel="alternate" type="application/rss+xml" href="/feed">
<script type="application/ld+json">{"@graph":[{"@type":"ProductGroup","name":"X","productGroupID":"T","hasVariant":[{"@type":"Product","offers":{"price":"179","priceCurrency":"EUR"}}],
"aggregateRating":{"ratingValue":4.5,"reviewCount":"1,417"}}]}</script><script type="application/ld+json">{broken</script></head>
<body><nav><a href="/">Home</a></nav><main><h1>Wallet</h1><h3>Deep</h3><p>""" + "good words here " * 20 + """<a rel="nofollow" href="b/../c">see</a><a href="#x">no</a><a href="mailto:a@b">no</a></p>
<img src="/h.jpg" sizes="100vw" loading="lazy" alt=""><img src="/g.jpg" width="600"><img src="/t.jpg" width="80px" alt="t"><div class="review-item">bad</div></main></body></html>"""


def test_page(spark):
    pages = spark.createDataFrame([("https://x.com/products/x", GOOD), ("https://x.com/broken", None), ("https://x.com/empty", "")], "url string, html string")
    rows = {r.url: r for r in extract.page_table(pages).collect()}
    r = rows["https://x.com/products/x"]
    assert (r.title_issue, r.meta_description_issue, r.canonical_state, r.noindex, r.nofollow) == ("", "too short", "self", True, False)
    assert r.hreflang_invalid == ["english"] and [a.lang for a in r.hreflang] == ["de", "english"]
    assert r.heading_issues == ["h3 appears before any h2"] and r.h1 == "Wallet"
    assert (r.image_count, r.images_missing_alt, r.hero_lazy, r.imgs_eager_belowfold_count) == (3, 1, True, 2)
    assert r.imgs_large_no_srcset == ["https://x.com/h.jpg", "https://x.com/g.jpg"]
    assert r.is_product and not r.price_consistent and r.product_group_id == "T" and r.review_schema_count == 1417 and r.review_suspicious
    assert not r.indexable and r.page_type == "product" and r.spellcheck_skipped is False
    assert [(a.target, a.nofollow) for a in r.links] == [("https://x.com/", False), ("https://x.com/products/c", True)]
    assert rows["https://x.com/broken"].title is None and rows["https://x.com/empty"].h1_count == 0


def test_clashing_columns(spark):
    """Columns that the table makes are its own; others stay, whatever their names."""
    rows = [("https://x.com/a", GOOD, "mine", 7, 8, 9, "kept", 3), ("https://x.com/b", None, None, None, None, None, None, None)]
    pages = spark.createDataFrame(rows, "url string, html string, Title string, f int, parse_error int, roles int, `a b` string, simhash int")
    table = extract.page_table(pages)
    assert len({c.lower() for c in table.columns}) == len(table.columns) and not {"f", "roles", "parse_error"} & set(table.columns)
    got = {r["url"]: r for r in table.collect()}
    assert got["https://x.com/a"]["title"] == "A title that is neither short nor long" and got["https://x.com/a"]["a b"] == "kept"
    assert got["https://x.com/b"]["a b"] is None and got["https://x.com/b"]["title"] is None
    printed = dups.with_simhash(table, "content").collect()
    assert {r["url"] for r in printed} == set(got) and all(isinstance(r["simhash"], int) for r in printed)


def test_sizes(spark):
    df = spark.createDataFrame([("(max-width: 768px) 100vw, 50vw",), ("90px",), ("10em",), (None,)], "s string")
    got = [(r.w.px, r.w.relative) for r in df.select(extract.sizes_width(F.col("s")).alias("w")).collect()]
    assert got == [(1280.0, True), (90.0, False), (160.0, False), (None, False)]


def healthy(url, **over):
    base = {
        "url": url, "status": 200, "error": None, "canonical_state": "self", "title": f"title of {url}", "title_issue": "", "meta_description": f"d {url}", "meta_description_issue": "", "h1_count": 1, "word_count": 500,
        "thin_content": False, "content_hash": url, "viewport": "w", "missing_social": ["none"], "noindex": False, "indexable": True, "in_sitemap": True, "discovered_by": "link", "inlinks": 3, "redirect_hops": 0,
        "redirect_chain": ["x"][:0] or None, "is_product": False, "price_consistent": True, "currency_consistent": True, "review_suspicious": False, "schema_types": ["x"], "hreflang_x_default": True, "hreflang_self": True,
        "hreflang_invalid": None, "hero_lazy": False, "hero_image": None, "fetchpriority_present": True, "imgs_eager_belowfold_count": 0, "imgs_large_no_srcset": None, "heading_issues": None,
        "unmarked_content_sections": False, "images_missing_alt": 0, "url_flags": None, "product_group_id": None, "product_name": None, "review_schema_count": 0, "h1": "h",
    }
    return base | over


SCHEMA = (
    "url string, status int, error string, canonical_state string, title string, title_issue string, meta_description string, meta_description_issue string, h1_count int, word_count int, thin_content boolean, content_hash string, viewport string, "
    "missing_social array<string>, noindex boolean, indexable boolean, in_sitemap boolean, discovered_by string, inlinks int, redirect_hops int, redirect_chain array<string>, is_product boolean, price_consistent boolean, currency_consistent boolean, "
    "review_suspicious boolean, schema_types array<string>, hreflang_x_default boolean, hreflang_self boolean, hreflang_invalid array<string>, hero_lazy boolean, hero_image string, fetchpriority_present boolean, imgs_eager_belowfold_count int, "
    "imgs_large_no_srcset array<string>, heading_issues array<string>, unmarked_content_sections boolean, images_missing_alt int, url_flags array<string>, product_group_id string, product_name string, review_schema_count int, h1 string"
)


def test_findings(spark):
    rows = [healthy("https://x.com/"), healthy("https://x.com/a", title="same"), healthy("https://x.com/b", title="same"), healthy("https://x.com/gone", status=404, indexable=False), healthy("https://x.com/o", inlinks=0), healthy("https://x.com/g", in_sitemap=False)]
    rows += [healthy(f"https://x.com/p{i}", is_product=True, product_name=f"P{i}", review_schema_count=1417) for i in range(3)]
    rows = [[r[c.split()[0]] for c in SCHEMA.split(", ")] for r in rows]
    pages = spark.createDataFrame(rows, SCHEMA).withColumn("hreflang", F.array().cast("array<struct<lang:string,href:string>>"))
    for c in ("redirect_chain", "hreflang_invalid", "imgs_large_no_srcset", "heading_issues", "url_flags"):
        pages = pages.withColumn(c, F.coalesce(c, F.array().cast("array<string>")))
    links = spark.createDataFrame([("https://x.com/", "https://x.com/gone", "x", True, False), ("https://x.com/a", "https://x.com/", "Sale", True, False)], "source string, target string, anchor string, internal boolean, nofollow boolean")
    got = {(r.severity, r.issue): r for r in findings.findings(pages, links).collect()}
    assert set(got) == {
        ("HIGH", "Dead URLs (4xx)"), ("HIGH", "Duplicate title tags"), ("HIGH", "Broken internal links"), ("MED", "Orphan pages (in sitemap, no internal links)"), ("MED", "Ghost pages (linked, missing from sitemap)"),
        ("HIGH", "Merged review pool across distinct products"), ("MED", "Anchor text promises a destination it does not deliver"),
    }
    assert got[("HIGH", "Duplicate title tags")].urls == ["https://x.com/a", "https://x.com/b"]
    assert got[("HIGH", "Merged review pool across distinct products")].total_count == 3
    assert site.orphans(pages).count() == 1
