"""Language identification: unigram pieces, marginalised over segmentations.

Each language has a probability for every piece of a fixed public vocabulary.  A
word's probability is the sum over all ways of cutting it into pieces, which the
forward algorithm computes; a text's score in a language is the product over its
words (runs of letters, in lower case, with the vocabulary's word mark in front).
The posterior under equal priors gives the prediction and its score.

Fitting: expected piece counts by forward-backward, ITERATIONS times from a uniform
start, over the words of a sample of labelled rows.  The sample is bounded by the
parameter fit_docs: each language takes part with fit_docs rows in expectation,
picked by a hash of the id (all rows of smaller languages).

Words over fit_letters letters (runs of letters of scripts without blanks) are not
learned from; prediction takes words of any length whole, in time proportional to it.

Defined results: null texts and texts without letters are "und" with score 0, as is
everything if nothing could be learned; signs outside the vocabulary cost the same
in every language; ties go to the first language in order; null ids are kept and
count as not held out; rows without a language are not learned from; repeated rows
are each learned from and answered; only doc_id, text and lang are read, other columns
are ignored (keep_known() keeps them); an empty table gives an empty one.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, prepare, remainder, table

VOCABULARY = "piece_bpe_32k.model"
MARK = "▁"
FIT_DOCS = 2000
FIT_LETTERS = 64
ITERATIONS = 3
PRIOR_COUNT = 0.01
UNKNOWN = 1e-8
UNDETERMINED = "und"
#: Words that a worker remembers.
REMEMBER = 400_000
#: Words that are computed at once.
STEP = 20_000
#: In the pipeline: documents below this posterior are rejected.
MIN_SCORE = 0.5

LETTERS = re.compile(r"[^\W\d_]+")
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def _mix(codes: np.ndarray) -> np.ndarray:
    """Spread sign codes over 64 bits."""
    x = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(31)
    return x * np.uint64(0x94D049BB133111EB)


def _codes(words: list[str]) -> np.ndarray:
    """The code points of words of one length, a row each."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1)


class Pieces:
    """The vocabulary's pieces, found by a rolling hash of their signs."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.names = sorted(dict.fromkeys(n for n in names if n and n == n.lower()))
        self.longest = max(map(len, self.names))
        codes = np.array([self._hash(_codes([n]))[0, -1] for n in self.names], np.uint64)
        order = np.argsort(codes)
        self.codes, self.ids = codes[order], order
        self.power = BASE ** np.arange(self.longest + 1, dtype=np.uint64)

    @staticmethod
    def _hash(codes: np.ndarray) -> np.ndarray:
        """Of each prefix, from the empty one on."""
        mixed = _mix(codes)
        out = np.zeros((len(codes), codes.shape[1] + 1), np.uint64)
        for j in range(codes.shape[1]):
            out[:, j + 1] = out[:, j] * BASE + mixed[:, j]
        return out

    def edges(self, words: list[str]) -> Iterator[tuple[int, int, np.ndarray]]:
        """For words of one length: (i, j, of each word the piece from i to j, or -1), by j, then i."""
        h = self._hash(_codes(words))
        for j in range(1, h.shape[1]):
            for i in range(max(0, j - self.longest), j):
                code = h[:, j] - h[:, i] * self.power[j - i]
                at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
                found = np.where(self.codes[at] == code, self.ids[at], -1)
                if j - i == 1 or (found >= 0).any():
                    yield i, j, found


@lru_cache(maxsize=1)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def by_length(words: list[str]) -> Iterator[list[int]]:
    """Indexes of words of one length, STEP at most at once."""
    groups: dict[int, list[int]] = {}
    for n, w in enumerate(words):
        groups.setdefault(len(w), []).append(n)
    for length, group in groups.items():
        step = max(1, STEP // max(1, length // 16))
        for at in range(0, len(group), step):
            yield group[at : at + step]


def forward(p: Pieces, words: list[str], probability: np.ndarray) -> np.ndarray:
    """log10 of each word's probability by language; probability: (pieces, languages)."""
    langs = probability.shape[1]
    table_ = np.vstack((probability, np.zeros((1, langs))))  # -1 finds the last row
    out = np.zeros((len(words), langs))
    for group in by_length(words):
        marked = [MARK + words[n] for n in group]
        length = len(marked[0])
        alpha = np.zeros((length + 1, len(group), langs))
        alpha[0] = 1
        shift = np.zeros((len(group), langs))
        last = 0
        for i, j, found in p.edges(marked):
            if j != last and last and last % 8 == 0:  # keep the numbers in range: all that is still read is scaled alike
                low = np.maximum(alpha[last], 1e-300)
                window = slice(max(0, last - p.longest), last + 1)
                alpha[window] /= low
                shift += np.log10(low)
            last = j
            q = table_[found]
            if j - i == 1:
                q = np.where((found < 0)[:, None], UNKNOWN, q)
            alpha[j] += alpha[i] * q
        out[group] = np.log10(np.maximum(alpha[length], 1e-300)) + shift
    return out


def fit(p: Pieces, counts: dict[str, int], iterations: int = ITERATIONS, fit_letters: int = FIT_LETTERS) -> np.ndarray:
    """Piece probabilities that the words' expected counts give, for one language."""
    words = [w for w in counts if len(w) <= fit_letters]
    weight = np.array([counts[w] for w in words], float)
    prob = np.full(len(p.names), 1 / len(p.names))
    groups = [(g, list(p.edges([MARK + words[n] for n in g])), len(words[g[0]]) + 1) for g in by_length(words)]
    for _ in range(iterations):
        total = np.zeros(len(p.names))
        padded = np.append(prob, 0.0)
        for group, edges, length in groups:
            qs = [np.where(found < 0, UNKNOWN if j - i == 1 else 0, padded[found]) for i, j, found in edges]
            alpha = np.zeros((length + 1, len(group)))
            beta = np.zeros_like(alpha)
            alpha[0] = beta[length] = 1
            for (i, j, _), q in zip(edges, qs, strict=True):
                alpha[j] += alpha[i] * q
            for (i, j, _), q in zip(reversed(edges), reversed(qs), strict=True):
                beta[i] += beta[j] * q
            scale = weight[group] / np.maximum(alpha[length], 1e-300)
            for (i, j, found), q in zip(edges, qs, strict=True):
                have = found >= 0
                total += np.bincount(found[have], (alpha[i] * q * beta[j] * scale)[have], len(total))
        prob = (total + PRIOR_COUNT) / (total.sum() + PRIOR_COUNT * len(total))
    return prob


class Model:
    def __init__(self, langs: list[str], probability: np.ndarray, path: str):
        self.langs, self.probability, self.path = langs, probability, path
        self._reset()

    def _reset(self) -> None:
        self.number: dict[str, int] = {}
        self.rows = np.zeros((0, len(self.langs)))

    def __getstate__(self) -> tuple:
        return self.langs, self.probability, self.path

    def __setstate__(self, state: tuple) -> None:
        self.__init__(*state)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        if len(self.number) > REMEMBER:
            self._reset()
        words = [LETTERS.findall(t.lower()) if t else [] for t in texts]
        new = list(dict.fromkeys(w for ws in words for w in ws if w not in self.number)) if self.langs else []
        if new:
            self.number.update(zip(new, range(len(self.number), len(self.number) + len(new)), strict=True))
            self.rows = np.vstack((self.rows, forward(pieces(self.path), new, self.probability)))
        out = []
        for ws in words:
            if not ws or not self.langs:
                out.append((UNDETERMINED, 0.0))
                continue
            total = self.rows[list(map(self.number.__getitem__, ws))].sum(0)
            best = int(np.argmax(total))
            out.append((self.langs[best], float(1 / (10.0 ** np.maximum(total - total[best], -300)).sum())))
        return out


def train(df: DataFrame, fit_docs: int = FIT_DOCS, path: str | None = None, fit_letters: int = FIT_LETTERS) -> Model:
    """Fit on rows of (doc_id, text, lang) that are not held out."""
    spark = prepare(df.sparkSession)
    path = path or default_path()
    rows = df.select("doc_id", "text", "lang").filter("lang is not null and text is not null")
    sizes = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return Model([], np.zeros((0, 0)), path)
    place = F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(1 << 20))
    rate = F.lit(0)
    for lang, n in sizes.items():
        rate = F.when(F.col("lang") == lang, int(min(1.0, fit_docs / n) * (1 << 20))).otherwise(rate)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                c.setdefault(lang, Counter()).update(LETTERS.findall(text.lower()))
        found = [(lang, w, n) for lang, ws in c.items() for w, n in ws.items()]
        if found:
            yield pa.record_batch([pa.array(x) for x in zip(*found, strict=True)], names=["lang", "word", "n"])

    def learn(key: tuple, words: pd.DataFrame) -> pd.DataFrame:
        p = pieces(path)
        counts = words.groupby("word")["n"].sum().sort_index()
        return pd.DataFrame({"lang": [key[0]], "p": [fit(p, counts.to_dict(), fit_letters=fit_letters).tobytes()]})

    counted = rows.filter(place < rate).select("lang", "text").mapInArrow(count, "lang string, word string, n bigint")
    got = sorted((r.lang, np.frombuffer(r.p)) for r in counted.groupBy("lang").applyInPandas(learn, "lang string, p binary").collect())
    return Model([lang for lang, _ in got], np.stack([x for _, x in got], 1) if got else np.zeros((0, 0)), path)


RESULT = "doc_id bigint, lang_pred string, score double"


def predict(df: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score); reads nothing but the text."""
    sent = prepare(df.sparkSession).sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        lang, score = zip(*sent.value.predict(batch.column(1).to_pylist()), strict=True)
        return pa.record_batch([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return map_batches(df.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), run, RESULT)


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(remainder(F.col(doc_id), 3) == 1, F.lit(False))


def keep_known(df: DataFrame) -> DataFrame:
    """The rows of documents whose language is determined with a posterior of MIN_SCORE; columns stay."""
    spark = prepare(df.sparkSession)
    sent = spark.sparkContext.broadcast(train(df.filter(~held_out())))
    at = df.columns.index("text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array([lang != UNDETERMINED and s >= MIN_SCORE for lang, s in sent.value.predict(batch.column(at).to_pylist())], pa.bool_()))

    return map_batches(df, run, df.schema)


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.filter(~held_out()))
    found = predict(docs, model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
