"""Spelling: unknown words of a site's texts, less its own names."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import store

# Rewrites from British to American spelling, each tried by itself, and trade words that count as known.
VARIANTS = [
    (r"our(s|ed|ing|ite)?$", "or$1"),
    (r"ise(s|d|r|rs)?$", "ize$1"),
    (r"isation(s)?$", "ization$1"),
    (r"yse(s|d)?$", "yze$1"),
    (r"([bcdfgklmnprstvz])re(s)?$", "$1er$2"),
    (r"ogue(s)?$", "og$1"),
    (r"ll(ing|ed|er|ers)$", "l$1"),
    (r"ou", "o"),
    (r"ae|oe", "e"),
    (r"^(.*)mme$", "$1m"),
]
ALLOWED = [
    "ecommerce", "checkout", "sku", "skus", "upsell", "dropship", "backorder", "preorder", "prepaid", "unboxing", "restock", "restocked", "giftable",
    "url", "urls", "html", "css", "js", "cdn", "seo", "faq", "faqs", "api", "sitemap", "canonical", "noindex", "hreflang", "webp", "svg", "og",
    "veg", "tanned", "tannage", "burnished", "burnishing", "saddle", "stitched", "stitching", "topstitch", "grommet", "rivet", "rivets",
    "patina", "full-grain", "fullgrain", "hardwearing", "handstitched", "cardholder", "bifold", "trifold", "crossbody", "carryall", "everyday",
    "keychain", "keychains", "lockstitch", "gifter", "sitewide", "storewide", "colorway", "colorways",
    "cm", "mm", "oz", "lb", "lbs", "ml", "xl", "xxl", "gsm", "etc", "eg", "ie", "vs", "approx", "diy", "usb", "rfid", "airtag",
]
BODY_LIMIT = 50


def tokens(text: Column) -> Column:
    """Words worth checking: no addresses, template code, numbers, short or all-capital words."""
    plain = F.regexp_replace(text, r"(?i)https?://\S+|www\.\S+|[\w.+-]+@[\w-]+\.[\w.]+|\{\{.*?\}\}|\{%.*?%\}", " ")
    words = F.regexp_extract_all(plain, F.lit(r"[A-Za-z][A-Za-z0-9'’-]*"), F.lit(0))
    return F.filter(words, lambda w: (F.length(w) > 2) & ~w.rlike(r"\d") & ~w.rlike("^[A-Z]{2,}$"))


def subwords(word: Column) -> Column:
    lowered = F.regexp_replace(F.regexp_replace(F.lower(word), "’", "'"), "(n't|'s|'re|'ve|'ll|'d|'m)$", "")
    return F.filter(F.split(lowered, "[-']"), lambda w: F.length(w) > 2)


def variants(word: Column) -> Column:
    return F.array_distinct(F.filter(F.array(*(F.regexp_replace(word, p, r) for p, r in VARIANTS)), lambda v: v != word))


def unknown_at(texts: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(id, place, token): tokens of (id, text) any part of which is neither in the dictionary (word) nor has a variant there.

    place counts a text's distinct tokens from 0.  The texts are read once: their parts are written.
    """
    placed = texts.select("id", F.posexplode(F.array_distinct(tokens(F.col("text")))).alias("place", "token"))
    parts = store.written(placed.select("id", "place", "token", F.explode(subwords(F.col("token"))).alias("word")), "spelling")
    distinct = parts.select("word").distinct()
    forms = distinct.select("word", F.explode(F.array_append(variants(F.col("word")), F.col("word"))).alias("form"))
    trade = texts.sparkSession.createDataFrame([(w,) for w in ALLOWED], "form string")
    words = dictionary.select(F.lower("word").alias("form")).unionByName(trade).distinct()
    known = forms.join(words, "form", "left_semi").select("word").distinct()
    return parts.join(known, "word", "left_anti").select("id", "place", "token").distinct()


def unknown(texts: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(id, token) of unknown_at()."""
    return unknown_at(texts, dictionary).select("id", "token").distinct()


def site_words(url: str) -> list[str]:
    """A site's own name and its parts: never typos there."""
    host = url.split("//", 1)[-1].split("/", 1)[0].split(":", 1)[0].lower().removeprefix("www.")
    return sorted({host, *(p for p in re.split(r"[._-]", host) if len(p) > 2)} - {""})


def with_spelling(pages: DataFrame, dictionary: DataFrame, whitelist: list[str] = (), min_pages: int = 3, limit: int = BODY_LIMIT) -> DataFrame:
    """pages with spelling_title, _meta, _h1, _body (in order of appearance, the first limit of the body) and _body_count.

    Words of the whitelist never count; brand terms (see brand_terms) are taken out after
    the body's limit.  Pages in other languages (spellcheck_skipped) have no typos.
    """
    fields = {"title": "title", "meta": "meta_description", "h1": "h1", "body": "spell_text"}
    part = F.explode(F.array(*(F.struct(F.lit(k).alias("field"), F.col(c).alias("text")) for k, c in fields.items()))).alias("p")
    texts = pages.filter("not coalesce(spellcheck_skipped, false)").select("url", part).select(F.struct("url", "p.field").alias("id"), "p.text").filter("text is not null")
    allow = pages.sparkSession.createDataFrame([(w.lower(),) for w in whitelist], "term string")
    found = without_brands(unknown_at(texts, dictionary), allow).select("id.url", "id.field", "place", "token")
    w = Window.partitionBy("url", "field").orderBy("place", "token")
    first = found.withColumn("n", F.row_number().over(w)).filter((F.col("field") != "body") | (F.col("n") <= limit))
    kept = without_brands(first, brand_terms(pages.select("url", "body"), min_pages))
    names = [f"spelling_{k}" for k in fields]
    of = lambda k: F.transform(F.sort_array(F.collect_list(F.when(F.col("field") == k, F.struct("n", "token")))), lambda x: x["token"]).alias(f"spelling_{k}")
    lists = kept.groupBy("url").agg(*map(of, fields))
    out = pages.drop(*names, "spelling_body_count").join(lists, "url", "left").withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in names})
    return out.withColumn("spelling_body_count", F.size("spelling_body"))


def brand_terms(pages: DataFrame, min_pages: int = 3) -> DataFrame:
    """(term, pages): capitalized words within sentences on so many pages, in lower case; pages: (url, body)."""
    sentences = F.split("body", r"(?<=[.!?])\s+|\n+")
    inner = F.flatten(F.transform(sentences, lambda s: F.slice(F.split(F.trim(s), r"\s+"), 2, 1 << 30)))
    bare = F.transform(inner, lambda w: F.regexp_replace(w, r"""^[.,;:!?()\[\]"'“”‘’]+|[.,;:!?()\[\]"'“”‘’]+$""", ""))
    named = F.array_distinct(F.filter(bare, lambda w: (F.length(w) > 2) & w.rlike("^[A-Z][A-Za-z0-9]*([0-9]+|[a-z]+[A-Za-z0-9]*)$")))
    return pages.select("url", F.explode(named).alias("w")).groupBy(F.lower("w").alias("term")).agg(F.countDistinct("url").alias("pages")).filter(F.col("pages") >= min_pages)


def without_brands(found: DataFrame, brands: DataFrame) -> DataFrame:
    return found.withColumn("_term", F.lower("token")).join(brands.select(F.col("term").alias("_term")), "_term", "left_anti").drop("_term")
