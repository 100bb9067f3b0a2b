"""URL functions as Column expressions, for absolute http(s) URLs and for odd ones alike.

Everything here stays in whole-stage codegen; only resolve(), which joins relative
references to a base, is an Arrow UDF.
"""

from __future__ import annotations

from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# They decide which URLs are equal, crawled or sampled together.
TRACKING = [
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id", "gclid", "fbclid",
    "msclkid", "mc_cid", "mc_eid", "_ga", "_gl", "ref", "srsltid", "gad_source",
]
NOT_PAGES = [
    ".jpg", ".jpeg", ".png", ".gif", ".webp", ".svg", ".ico", ".bmp", ".avif", ".pdf", ".zip", ".gz", ".rar", ".7z", ".dmg", ".exe",
    ".mp4", ".webm", ".mp3", ".wav", ".css", ".js", ".json", ".xml", ".rss", ".atom", ".woff", ".woff2", ".ttf", ".eot", ".txt",
]
STRUCTURAL = [
    "products", "collections", "blogs", "blog", "pages", "policies", "account", "cart", "search", "category",
    "categories", "shop", "product", "tag", "tags", "author",
]
MAX_DEPTH, MAX_LENGTH = 4, 115

SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
AUTHORITY = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)"
PATH = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)"
QUERY = r"^[^?#]*\?([^#]*)"


def _let(value: Column, use) -> Column:
    """use(value) with value computed once, however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, SCHEME, 1))


def _host_port(url: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(url, AUTHORITY, 1), "^.*@", "")


def host(url: Column) -> Column:
    return F.lower(F.regexp_replace(_host_port(url), r":\d*$", ""))


def site_host(url: Column) -> Column:
    """The host without a leading www."""
    return F.regexp_replace(host(url), r"^www\.", "")


def path(url: Column) -> Column:
    return F.regexp_extract(url, PATH, 1)


def query(url: Column) -> Column:
    return F.regexp_extract(url, QUERY, 1)


def _quoted(x: Column) -> Column:
    """Percent-encoding with + for blanks; ~ stays, * goes."""
    return F.regexp_replace(F.regexp_replace(F.url_encode(x), r"\*", "%2A"), "%7E", "~")


def _unquoted(x: Column) -> Column:
    return F.coalesce(F.try_url_decode(x), x)


def clean_query(url: Column) -> Column:
    """The query's parameters without tracking, in order of name and value."""
    pairs = F.transform(
        F.filter(F.split(query(url), "&"), lambda p: p != ""),
        lambda p: F.struct(_unquoted(F.substring_index(p, "=", 1)).alias("k"), _unquoted(F.when(F.contains(p, F.lit("=")), F.regexp_replace(p, "^[^=]*=", "")).otherwise(F.lit(""))).alias("v")),
    )
    kept = F.array_sort(F.filter(pairs, lambda p: ~F.lower(p["k"]).isin(TRACKING)))
    return F.array_join(F.transform(kept, lambda p: F.concat(_quoted(p["k"]), F.lit("="), _quoted(p["v"]))), "&")


def clean_path(url: Column) -> Column:
    """One slash for several, none at the end, / for nothing."""
    p = F.regexp_replace(F.concat(F.regexp_replace(path(url), "/+", "/"), F.lit("/")), "/+$", "")
    return F.coalesce(F.nullif(p, F.lit("")), F.lit("/"))


def normalize(url: Column, keep_query: bool = True) -> Column:
    """The form by which URLs are compared; what has no host stays as it is, less its fragment."""

    def whole(u: Column) -> Column:
        s = F.coalesce(F.nullif(scheme(u), F.lit("")), F.lit("https"))
        port = F.regexp_replace(F.regexp_extract(_host_port(u), r"(:\d+)$", 1), "^:$", "")
        origin = F.regexp_replace(F.concat(s, F.lit("://"), host(u), port), "^(http://.*):80$|^(https://.*):443$", "$1$2")
        q = F.when(F.contains(u, F.lit("?")), F.regexp_replace(F.concat(F.lit("?"), clean_query(u)), r"^\?$", "")).otherwise("") if keep_query else F.lit("")
        return F.when(host(u) == "", u).otherwise(F.concat(origin, clean_path(u), q))

    return _let(F.regexp_replace(F.trim(url), "#.*$", ""), whole)


def same_site(a: Column, b: Column) -> Column:
    return site_host(a) == site_host(b)


def dedupe_key(url: Column) -> Column:
    """Host, path and query: http and https, www and none, and all ports are one."""
    return F.concat(site_host(url), _let(normalize(url), lambda n: F.concat(path(n), F.lit("?"), query(n))))


def is_crawlable(url: Column) -> Column:
    ending = F.regexp_extract(F.lower(path(url)), r"(\.[^./]*)$", 1)
    return scheme(url).isin("http", "https") & ~ending.isin(NOT_PAGES)


def segments(url: Column) -> Column:
    return F.filter(F.split(path(url), "/"), lambda s: s != "")


def last_segment(url: Column) -> Column:
    return F.element_at(F.split(url, "/"), -1)


def hygiene(url: Column, has_canonical: Column | bool = True, max_depth: int = MAX_DEPTH) -> Column:
    """The flags of a URL, in a fixed order."""
    canonical = has_canonical if isinstance(has_canonical, Column) else F.lit(has_canonical)
    p = path(url)
    rules = [
        ("copy-suffix", p.rlike(r"(?i)-copy(-\d+)?(/|$)")),
        ("uppercase", p.rlike(r"\p{Lu}")),
        ("query-params-no-canonical", (query(url) != "") & ~canonical),
        ("deep-path", F.size(segments(url)) > max_depth),
        ("underscores", F.contains(p, F.lit("_"))),
        ("long-url", F.length(url) > MAX_LENGTH),
    ]
    return F.array_compact(F.array(*(F.when(c, F.lit(name)) for name, c in rules)))


def template(url: Column) -> Column:
    """Structural segments as they are, others as *; the root is home."""
    s = F.transform(segments(url), lambda x: F.when(F.lower(x).isin(STRUCTURAL), x).otherwise(F.lit("*")))
    return F.when(F.size(s) == 0, "home").otherwise(F.array_join(s, "/"))


def page_type(url: Column) -> Column:
    p = F.lower(path(url))
    return (
        F.when(F.contains(p, F.lit("/products/")), "product")
        .when(F.contains(p, F.lit("/collections/")), "collection")
        .when(F.contains(p, F.lit("/blogs/")) | F.contains(p, F.lit("/blog/")), "content")
        .when(F.contains(p, F.lit("/pages/")), "static")
        .when(p.isin("", "/"), "home")
        .otherwise("other")
    )


def is_root(url: Column) -> Column:
    return path(url).isin("", "/")


def allowed(url: Column, include: list[str] = (), exclude: list[str] = ()) -> Column:
    """No exclude pattern is found in it, and an include pattern is if there are any."""
    out = F.lit(True)
    for pattern in exclude:
        out = out & ~url.rlike(pattern)
    if include:
        hit = F.lit(False)
        for pattern in include:
            hit = hit | url.rlike(pattern)
        out = out & hit
    return out


@F.pandas_udf(T.StringType())
def resolve(base: pd.Series, ref: pd.Series) -> pd.Series:
    """A reference made absolute by its page's URL."""
    return pd.Series([None if b is None or r is None else urljoin(b, r) for b, r in zip(base, ref, strict=True)], dtype=object)
