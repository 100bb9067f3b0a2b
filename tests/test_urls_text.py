import pytest
from pyspark.sql import functions as F

from quarry.functions import text, urls


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("HTTPS://Shop.Example.com/A/?b=2&a=1#top", "https://shop.example.com/A?a=1&b=2"),
        ("http://x.com:80//a//b/", "http://x.com/a/b"),
        ("https://x.com:443", "https://x.com/"),
        ("https://x.com:8443/", "https://x.com:8443/"),
        ("https://x.com/?utm_source=f&REF=1&q=a%20b", "https://x.com/?q=a+b"),
        ("https://user:pw@x.com/p?k=", "https://x.com/p?k="),
        ("mailto:a@b.c", "mailto:a@b.c"),
        (None, None),
    ],
)
def test_normalize(spark, url, want):
    assert one(spark, url, urls.normalize) == want


def test_sites_types_templates(spark):
    assert one(spark, "https://www.x.com/a", urls.site_host) == "x.com"
    assert one(spark, "http://www.x.com:8080/a?b=1", urls.dedupe_key) == "x.com/a?b=1"
    assert one(spark, "https://x.com/a.PDF", urls.is_crawlable) is False
    assert one(spark, "https://x.com/a.b/c", urls.is_crawlable) is True
    assert one(spark, "ftp://x.com/", urls.is_crawlable) is False
    assert one(spark, "https://x.com/Products/bifold", urls.template) == "Products/*"
    assert one(spark, "https://x.com/", urls.template) == "home"
    assert one(spark, "https://x.com/blogs/n/p", urls.page_type) == "content"
    flags = one(spark, "https://x.com/A_b-copy-2/c/d/e/f?x=1", lambda u: urls.hygiene(u, False))
    assert flags == ["copy-suffix", "uppercase", "query-params-no-canonical", "deep-path", "underscores"]


@pytest.mark.parametrize(
    ("label", "want"),
    [("1,300", 1300), ("1.300", 1300), ("1,5", 1.5), ("1.5", 1.5), ("1.234,56", 1234.56), ("1,234.56", 1234.56), ("€ 1,20", 1.2), ("+∞", None), ("-", None), ("n/a", None), ("abc", None), (None, None)],
)
def test_numbers(spark, label, want):
    assert one(spark, label, text.parse_number) == want


@pytest.mark.parametrize(
    ("label", "want"),
    [
        ("10 – 100", (10, 100, 32, True)), ("100 - 1 tis.", (100, 1000, 316, True)), ("1 mio. - 10 mio.", (1_000_000, 10_000_000, 3_162_278, True)), ("1K - 10K", (1000, 10_000, 3162, True)),
        ("2.5K", (2500, 2500, 2500, True)), ("", (0, 0, 0, True)), ("0", (0, 0, 0, True)), ("lots", (0, 0, 0, False)),
    ],
)
def test_volumes(spark, label, want):
    v = one(spark, label, text.parse_volume)
    assert (v.minimum, v.maximum, v.mid, v.parsed) == want


def test_words(spark):
    assert one(spark, "Shop the Leather Wallets glasses bus", text.target_tokens) == ["leather", "wallet", "glasse", "bus"]
    assert one(spark, "  Leather \t Card ", text.normalize_keyword) == "leather card"
    assert one(spark, "Visoko", text.parse_competition) == "HIGH"
    assert one(spark, "50", text.parse_competition) == "MED"
    assert one(spark, "€1,179.50", text.price_text) == "1179.5"
    assert one(spark, "179,00", text.price_text) == "17900"
