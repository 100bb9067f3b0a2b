"""Quality rules: how far a text's histograms lie from those of a language.

Each language gets two reference histograms over all of its documents: one of
character classes (the mean over documents) and one of its common words (those
that make at least COMMON_SHARE of all words, plus one bin for the rest).  A text
is compared with every language by the Jensen-Shannon distance (base 2, 0 to 1)
of both; the language with the smallest sum decides.  A text is rejected if
either distance exceeds its threshold, or by the base rules: fewer than 50 words,
or over half of the words within 3-word windows found twice or more.

A word histogram's distance shrinks with a text's length even where the text is good
(its noise falls with the square root), so the word limit of a text of n words is
WORD_FLOOR + WORD_NOISE / sqrt(n), but never over WORD_LIMIT.  The length guard: below
MIN_WORDS words both distances must exceed their limit by GUARD to reject.

Defined results: a null text has no words; null languages add nothing to the
references (unless no row has a language; then all rows make one reference);
without any reference only base rules count; at equal sums the first language in
order is the nearest; null ids are kept; repeated rows count each time; a text of
many MB is counted whole, alone in its batch; extra columns are ignored by assess(),
whatever their names, and kept by keep_good(); an empty table gives an empty one.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, prepare, table

COMMON_SHARE = 0.002
CHAR_LIMIT = 0.31
WORD_LIMIT, WORD_FLOOR, WORD_NOISE = 0.445, 0.3, 1.45
MIN_WORDS, GUARD = 80, 0.03
CLASSES = 10

SYMBOLS = b"#*$%&|<>"
PUNCTUATION = b'.,;:!?"()'
UPPER, LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
FOLD = bytes.maketrans(UPPER + PUNCTUATION, LOWER + b" " * len(PUNCTUATION))


def _classes() -> np.ndarray:
    """The class of each UTF-8 byte; bytes that continue a sign are in class 10, which is dropped."""
    of = np.full(256, 9, np.uint8)
    for n, chars in enumerate((LOWER, UPPER, b"0123456789", b" \t\r\x0b\x0c", b"\n", b".,;:?'\"()-", b"!", SYMBOLS)):
        of[list(chars)] = n
    of[128:192], of[192:] = CLASSES, 8
    return of


CLASS_OF = _classes()


def char_histogram(text: bytes) -> np.ndarray:
    return np.bincount(CLASS_OF[np.frombuffer(text, np.uint8)], minlength=CLASSES + 1)[:CLASSES].astype(float)


def repeated_words(words: list[bytes]) -> int:
    """How many words stand in a 3-word window that occurs twice or more."""
    if len(words) < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    v = len(number)
    if v < 2_000_000:
        key = (ids[:-2] * v + ids[1:-1]) * v + ids[2:]
    else:
        pair = np.unique(ids[:-2] * v + ids[1:-1], return_inverse=True)[1]
        key = pair * v + ids[2:]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(key) + 2, bool)
    at = order[np.append(same, False) | np.append(False, same)]
    twice[at] = twice[at + 1] = twice[at + 2] = True
    return int(twice.sum())


def base_counts(text: str | None) -> tuple[int, int, int, int, int, bool]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    spaces = len(raw) - len(raw.translate(None, b" \t\n\r\x0b\x0c"))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if not x.isspace() and x]
    repeat = repeated_words(words)
    return n, len(text) - spaces, symbols, len(lines) - len(set(lines)), repeat, n < 50 or 100 * repeat > 50 * n


def distances(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of p to each row of q; all sum to 1."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(p > 0, p * np.log2(p / m), 0).sum(-1)
        b = np.where(q > 0, q * np.log2(q / m), 0).sum(-1)
    return np.sqrt(np.maximum(0, (a + b) / 2))


class References:
    """Per language: a mean character histogram and the shares of common words."""

    def __init__(self, chars: dict[str, list[float]], words: dict[str, dict[bytes, float]]):
        self.langs = sorted(chars)
        self.chars = np.array([chars[x] for x in self.langs]).reshape(len(self.langs), CLASSES)
        number: dict[bytes, int] = {}
        for lang in self.langs:
            for w in sorted(words.get(lang, {})):
                number.setdefault(w, len(number))
        self.number = number
        self.words = np.zeros((len(self.langs), len(number) + 1))
        self.mask = np.zeros((len(self.langs), len(number) + 1), bool)
        self.mask[:, -1] = True
        for i, lang in enumerate(self.langs):
            for w, share in words.get(lang, {}).items():
                self.words[i, number[w]] = share
                self.mask[i, number[w]] = True
        self.words[:, -1] = np.maximum(0, 1 - self.words[:, :-1].sum(1))

    def judge(self, raw: bytes) -> tuple[str | None, float, float]:
        """The nearest language and the two distances to it."""
        if not self.langs or not raw:
            return None, 0.0, 0.0
        chars = char_histogram(raw)
        tokens = raw.translate(FOLD).split()
        get, counts = self.number.get, np.zeros(len(self.number) + 1)
        ids = [i for i in map(get, tokens) if i is not None]
        if ids:
            counts[:-1] = np.bincount(ids, minlength=len(self.number))
        own = np.where(self.mask, counts, 0)
        own[:, -1] = len(tokens) - own[:, :-1].sum(1)
        c = distances(chars / max(1, chars.sum()), self.chars)
        w = distances(own / max(1, len(tokens)), self.words)
        best = int(np.argmin(c + w))
        return self.langs[best], float(c[best]), float(w[best])


def _heavy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words with at least half the share that makes a word common, by language, and totals ('')."""
    counts: dict[str, Counter] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if text:
                counts.setdefault(lang, Counter()).update(text.encode().translate(FOLD).split())
    rows = []
    for lang, c in counts.items():
        total = sum(c.values())
        rows += [(lang, None, total)] + [(lang, w, n) for w, n in c.items() if n >= COMMON_SHARE / 2 * total]
    if rows:
        yield pa.record_batch([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.int64())], names=["lang", "word", "n"])


def references(df: DataFrame, lang_col: str = "lang", text_col: str = "text") -> References:
    """Fit the references on all rows, in two passes.

    Pass 1 finds candidates: a word that makes COMMON_SHARE of a language makes
    at least half of it within partitions that hold at least that share of the
    words, so the words that partitions report contain every common word, and
    their summed counts bound how many can qualify (2 / COMMON_SHARE a language).
    Pass 2 counts the candidates exactly.
    """
    spark = prepare(df.sparkSession)
    rows = df.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    known = rows.filter("lang is not null")
    first = known.mapInArrow(_heavy, "lang string, word binary, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    totals = first.filter("word is null").select("lang", F.col("n").alias("total"))
    found = first.filter("word is not null").join(F.broadcast(totals), "lang").filter(F.col("n") >= F.lit(COMMON_SHARE / 2) * F.col("total"))
    candidates: dict[str, set[bytes]] = {}
    for r in found.select("lang", "word").collect():
        candidates.setdefault(r.lang, set()).add(bytes(r.word))
    sent = spark.sparkContext.broadcast(candidates)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = {}
        chars: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not text:
                    continue
                raw = text.encode()
                tokens = raw.translate(FOLD).split()
                c = words.setdefault(lang, Counter())
                c.update(filter(sent.value.get(lang, set()).__contains__, tokens))
                c[None] += len(tokens)
                h = char_histogram(raw)
                s = chars.setdefault(lang, np.zeros(CLASSES))
                s += h / h.sum()
        out = [(lang, w, float(n)) for lang, c in words.items() for w, n in c.items()]
        out += [(lang, b"\x00%d" % i, float(x)) for lang, s in chars.items() for i, x in enumerate(s)]
        if out:
            yield pa.record_batch([pa.array([r[0] for r in out]), pa.array([r[1] for r in out], pa.binary()), pa.array([r[2] for r in out], pa.float64())], names=["lang", "word", "n"])

    chars: dict[str, list[float]] = {}
    words: dict[str, dict[bytes, float]] = {}
    total: dict[str, float] = {}
    for r in known.mapInArrow(count, "lang string, word binary, n double").groupBy("lang", "word").agg(F.sum("n").alias("n")).collect():
        if r.word is None:
            total[r.lang] = r.n
        elif bytes(r.word[:1]) == b"\x00":
            chars.setdefault(r.lang, [0.0] * CLASSES)[int(r.word[1:])] = round(r.n, 6)
        else:
            words.setdefault(r.lang, {})[bytes(r.word)] = r.n
    if not chars and df.filter(F.col(text_col) != "").limit(1).count():
        return references(rows.withColumn("lang", F.lit("und")))
    shares = {lang: {w: n / total[lang] for w, n in c.items() if n >= COMMON_SHARE * total[lang]} for lang, c in words.items()}
    return References({lang: [x / sum(h) for x in h] for lang, h in chars.items() if sum(h)}, shares)


RESULT = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, nearest_lang string, char_distance double, word_distance double"


def limits(n_words: int) -> tuple[float, float]:
    """The largest distances of characters and of words that a text of this length may have."""
    guard = GUARD if n_words < MIN_WORDS else 0.0
    return CHAR_LIMIT + guard, min(WORD_LIMIT, WORD_FLOOR + WORD_NOISE / math.sqrt(max(n_words, 1))) + guard


def verdict(text: str | None, refs: References) -> tuple:
    counts = base_counts(text)
    lang, c, w = refs.judge((text or "").encode())
    most_chars, most_words = limits(counts[0])
    passed = not counts[5] and c <= most_chars and w <= most_words
    return *counts, passed, lang, round(c, 6), round(w, 6)


def assess(df: DataFrame, refs: References | None = None) -> DataFrame:
    """One row per row of df: the counts, the verdict and what it rests on."""
    spark = prepare(df.sparkSession)
    rows = df.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    sent = spark.sparkContext.broadcast(refs or references(df))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = list(zip(*(verdict(t, sent.value) for t in batch.column(1).to_pylist()), strict=True))
        kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.string()] + [pa.float64()] * 2
        return pa.record_batch([batch.column(0), *(pa.array(x, k) for x, k in zip(out, kinds, strict=True))], names=[x.split()[0] for x in RESULT.split(", ")])

    return map_batches(rows, run, RESULT)


def keep_good(df: DataFrame) -> DataFrame:
    """The rows whose text passes; all columns stay as they are."""
    spark = prepare(df.sparkSession)
    sent = spark.sparkContext.broadcast(references(df))
    at = df.columns.index("text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array([verdict(t, sent.value)[6] for t in batch.column(at).to_pylist()], pa.bool_()))

    return map_batches(df, run, df.schema)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assess(table(spark, sf_dir, "documents"))
