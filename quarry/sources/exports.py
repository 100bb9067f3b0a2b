"""Keyword-planner exports: encoding, separator and header are found, not assumed."""

from __future__ import annotations

import csv
import io
import re

from pyspark.sql import DataFrame, SparkSession

from quarry.operators import keywords

# Header texts of exports in two languages, by field.
HEADERS = {
    "keyword": ["keyword", "keywords", "keyword (by relevance)", "search term", "ključna beseda", "kljucna beseda", "ključne besede", "iskalni izraz"],
    "volume": [
        "avg. monthly searches", "avg monthly searches", "average monthly searches", "monthly searches", "searches", "povpr. mesečna iskanja",
        "povpr. mesecna iskanja", "povprečna mesečna iskanja", "povprecna mesecna iskanja", "mesečna iskanja", "mesecna iskanja",
    ],
    "competition": ["competition", "competition (indexed value)", "konkurenca", "konkurenčnost", "konkurencnost"],
    "competition_index": ["competition (indexed value)", "competition index", "konkurenca (indeksirana vrednost)"],
    "bid_low": [
        "top of page bid (low range)", "top of page bid low range", "low top of page bid", "ponudba na vrhu strani (nizko območje)",
        "ponudba na vrhu strani (nizki razpon)", "ponudba na vrhu strani (spodnji razpon)",
    ],
    "bid_high": [
        "top of page bid (high range)", "top of page bid high range", "high top of page bid", "ponudba na vrhu strani (visoko območje)",
        "ponudba na vrhu strani (visoki razpon)", "ponudba na vrhu strani (zgornji razpon)",
    ],
}
HEADER_ROWS = 30


class KeywordFileError(ValueError):
    """The file is no keyword export."""


def decode(raw: bytes) -> tuple[str, str]:
    """The text and the encoding that gave it."""
    order = ["utf-16", "utf-8-sig", "utf-8", "cp1252", "latin-1"]
    if raw[:2] in (b"\xff\xfe", b"\xfe\xff"):
        order.insert(0, "utf-16")
    elif raw[:3] == b"\xef\xbb\xbf":
        order.insert(0, "utf-8-sig")
    elif raw and raw[:4096].count(0) > 0.25 * len(raw[:4096]):
        order[:0] = ["utf-16-le", "utf-16-be"] if raw[1:2] == b"\0" else ["utf-16-be", "utf-16-le"]
    else:
        order.remove("utf-16")
    for e in order:
        try:
            return raw.decode(e), e
        except UnicodeError:
            continue
    raise KeywordFileError("no encoding fits")


def separator(text: str) -> str:
    lines = [x for x in text.splitlines() if x.strip()][:20]
    return max((sum(x.count(c) for x in lines), c) for c in "\t,;")[1]


def header(rows: list[list[str]]) -> tuple[int, dict[str, int]]:
    """The header's row and the column of each field."""
    for n, row in enumerate(rows[:HEADER_ROWS]):
        cells = [re.sub(r"\s+", " ", c.strip().strip("﻿").lower()) for c in row]
        if not any(c in HEADERS["keyword"] for c in cells):
            continue
        found = {name: next((i for i, c in enumerate(cells) if c in known and not (name == "competition" and "index" in c)), None) for name, known in HEADERS.items()}
        found = {name: i for name, i in found.items() if i is not None}
        return n, found
    raise KeywordFileError(f"no keyword column; the first row holds: {rows[0] if rows else []}")


def read_keywords(spark: SparkSession, path: str) -> DataFrame:
    """Keyword rows of an export; the file is read by Spark and is as small as a spreadsheet."""
    raw = bytes(spark.read.format("binaryFile").load(path).select("content").first().content)
    text, _ = decode(raw)
    rows = [r for r in csv.reader(io.StringIO(text), delimiter=separator(text)) if any(c.strip() for c in r)]
    at, fields = header(rows)
    names = ["row_idx", *fields]
    body = [(n, *(r[i] if i < len(r) else None for i in fields.values())) for n, r in enumerate(rows[at + 1 :])]
    schema = ", ".join(["row_idx bigint", *(f"{f} string" for f in names[1:])])
    return keywords.typed(spark.createDataFrame(body, schema))
