"""A Katz backoff language model: counted, smoothed and applied in Spark.

Tokens are words (lower case A-Z) and one end a text; the model is of bigrams over
the start of a text.  Counts up to GT_MAX are discounted by Good-Turing,

    d(r) = ((r+1) n(r+1) / (r n(r)) - A) / (1 - A),   A = (k+1) n(k+1) / n(1),

(1 where that is not within 0 to 1), and what a context saves is spread over the
words not seen after it, in proportion to the lower order:

    p(w | v) = d c(v,w) / c(v)  if c(v,w) > 0, else  alpha(v) p(w)
    alpha(v) = (1 - sum of d c(v,w) / c(v)) / (1 - sum of p(w)), over w seen after v,

so each context's probabilities sum to 1.  A context that saves nothing counts one
more in c(v), which then is what it saves.  The unigrams are discounted in the same
way; what they save is the probability of a word that was never seen.  A token's
probability is found by going down the orders until one has seen it.

How it runs.  Texts are read once, in blocks of some MB; a block numbers its words,
and sends each distinct word, and then each distinct pair, once to the bucket that
counts it.  Bucket tables hold the counts of each order and, for each context, the
weight; they are written to the shared folder by bucket, and answer each block with
what it needs for its own words and pairs.  What moves is distinct items by block, packed as
sorted columns, not tokens.  A context is counted in one bucket, or in several by its
next word once its count exceeds a bucket's fair share, so a word that is a third of
all tokens makes no large task.  To the driver come only counts of counts.

The number of buckets grows with the bytes of text (BUCKET_BYTES), so the largest task does
not.  Scores are rounded to 6 decimals, which evens out the order of summing.

Defined results: a null or empty text is one end token; a text of many MB is one block; rows without an id are
trained on; repeated rows count each time; without training rows every word is
unseen and has probability 1; other columns are ignored, whatever their names; the empty table gives the empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F

from .common import prepare, remainder, shuffle_partitions, stored, table

GT_MAX = 5
BLOCK_BYTES = 16 << 20
#: Bytes of text for each bucket: the number of buckets, and of tasks, grows with the input.
BUCKET_BYTES = 16 << 20
END, START = b"", b" "
HOME = 40  # a word's id: its bucket above this bit, its number there below


# packed columns: byte planes, compressed


def pack(a: np.ndarray, rising: bool = False) -> bytes:
    """An array of whole numbers from 0 on; rising: in rising order."""
    a = a.astype(np.uint64)
    if rising and len(a):
        a = np.diff(a, prepend=np.uint64(0))
    width = max(1, (int(a.max()).bit_length() + 7) // 8) if len(a) else 1
    planes = a.view(np.uint8).reshape(-1, 8)[:, :width].T if len(a) else np.zeros((1, 0), np.uint8)
    return bytes([width, rising]) + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(b: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(b[2:], max_output_size=1 << 31), np.uint8).reshape(b[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : b[0]] = planes.T
    a = out.view(np.uint64).reshape(-1).astype(np.int64)
    return np.cumsum(a) if b[1] else a


# blocks


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


BLOCKS = "kind string, block bigint, bucket int, ids array<bigint>, a binary, b binary, c binary"
NAMES = [x.split()[0] for x in BLOCKS.split(", ")]


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=NAMES)


class _Block:
    def __init__(self) -> None:
        self.number, self.bytes = _Numbers(), 0
        self.docs: list[tuple[int | None, bool, int]] = []
        self.tokens: list[np.ndarray] = []

    def add(self, doc_id: int | None, held: bool, text: str | None) -> None:
        raw = (text or "").encode()
        words = raw.lower().split()
        words.append(END)
        self.docs.append((doc_id, held, len(words)))
        self.tokens.append(np.fromiter(map(self.number.__getitem__, words), np.uint32, len(words)))
        self.bytes += len(raw)

    def rows(self, block: int, buckets: int) -> list[tuple]:
        """seq: the texts as numbers of words; words: for each bucket its words, their numbers and training counts."""
        tokens = np.concatenate(self.tokens)
        lengths = np.array([n for _, _, n in self.docs])
        held = np.array([h for _, h, _ in self.docs])
        order = np.argsort(-np.bincount(tokens, minlength=len(self.number)), kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        tokens = rank[tokens]
        names = list(self.number)
        names = [names[i] for i in order] + [START]
        counts = np.append(np.bincount(tokens[np.repeat(~held, lengths)], minlength=len(order)), (~held).sum())
        out = [("seq", block, None, [d for d, _, _ in self.docs], pack(tokens), pack(lengths), pack(held))]
        home = np.fromiter((xxhash.xxh64_intdigest(w) % buckets for w in names), np.int64, len(names))
        by = np.argsort(home, kind="stable")
        cut = np.searchsorted(home[by], np.arange(buckets + 1))
        for b in range(buckets):
            own = by[cut[b] : cut[b + 1]]
            if len(own):
                out.append(("words", block, b, None, b"\n".join([names[i] for i in own]), pack(own, True), pack(counts[own])))
        return out


def _cut(rows: DataFrame, buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        place, block = TaskContext.get().partitionId() << 24, _Block()
        for batch in batches:
            for x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                block.add(*x)
                if block.bytes >= BLOCK_BYTES:
                    yield _rows(block.rows(place, buckets))
                    place, block = place + 1, _Block()
        if block.docs:
            yield _rows(block.rows(place, buckets))

    return rows.mapInArrow(run, BLOCKS)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["kind", "block", "bucket", "a", "b", "c"])


ANSWERS = "kind string, block bigint, bucket int, a binary, b binary, c binary"


def _counts_of_counts(counts: np.ndarray) -> np.ndarray:
    """Tokens, types, and n(1) .. n(k+1)."""
    return np.array([counts.sum(), (counts > 0).sum(), *np.bincount(np.minimum(counts, GT_MAX + 2), minlength=GT_MAX + 3)[1 : GT_MAX + 2]])


def _count_words(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """A bucket of words: each block learns of its words the ids and counts."""
    number, found = _Numbers(), []
    for r in rows.sort_values("block").itertuples():
        words = bytes(r.a).split(b"\n")
        found.append((r.block, np.fromiter(map(number.__getitem__, words), np.int64, len(words)), r.b, unpack(bytes(r.c))))
    total = np.zeros(len(number), np.int64)
    for _, n, _, c in found:
        total[n] += c
    out = [("word", block, key[0], local, pack(n), pack(total[n])) for block, n, local, _ in found]
    plain = total.copy()
    if START in number:
        plain[number[START]] = 0
    out.append(("unigrams", None, key[0], b"\n".join(number), pack(total), None))
    out.append(("stat", None, key[0], pack(_counts_of_counts(plain)), None, None))
    return _frame(out)


class Discounts:
    """The order's totals and d(r)."""

    def __init__(self, stat: np.ndarray):
        self.tokens, self.types = int(stat[0]), int(stat[1])
        self.d = discounts(stat[2:])

    def spared(self, counts: np.ndarray) -> np.ndarray:
        """Discounted counts."""
        return counts * self.d[np.minimum(counts, GT_MAX + 1)]


def discounts(n: np.ndarray) -> np.ndarray:
    """d by count, from counts of counts n(1) .. n(k+1); the last holds for all above."""
    d = np.ones(GT_MAX + 2)
    if n[0] and (a := (GT_MAX + 1) * n[GT_MAX] / n[0]) < 1:
        for r in range(1, GT_MAX + 1):
            if n[r - 1]:
                x = ((r + 1) * n[r] / (r * n[r - 1]) - a) / (1 - a)
                if 0 < x <= 1:
                    d[r] = x
    return d


class Unigrams(Discounts):
    """The lowest order: discounted shares, and what they leave to any unseen word."""

    def __init__(self, stat: np.ndarray):
        super().__init__(stat)
        spared = sum(r * int(n) * (1 - d) for r, n, d in zip(range(1, GT_MAX + 1), stat[2:], self.d[1:], strict=False))
        self.total = self.tokens if spared > 0 else self.tokens + 1
        self.unseen = (spared if spared > 0 else 1) / self.total

    def p(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > 0, self.spared(counts) / self.total, self.unseen)


class _Pairs:
    """A block's texts with what the word buckets answered, and its distinct pairs by bucket."""

    def __init__(self, seq: pd.DataFrame, answers: pd.DataFrame, buckets: int, fair: int):
        row = seq.iloc[0]
        self.ids = row["ids"]
        self.tokens, self.lengths, self.held = unpack(bytes(row["a"])), unpack(bytes(row["b"])), unpack(bytes(row["c"])).astype(bool)
        words = [(r.bucket, unpack(bytes(r.a)), unpack(bytes(r.b)), unpack(bytes(r.c))) for r in answers[answers["kind"] == "word"].itertuples()]
        n = sum(len(x[1]) for x in words)
        self.word, self.count = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for bucket, local, number, count in words:
            self.word[local] = (int(bucket) << HOME) + number
            self.count[local] = count
        start = n - 1
        self.first = np.cumsum(self.lengths) - self.lengths
        before = np.empty_like(self.tokens)
        before[1:] = self.tokens[:-1]
        before[self.first] = start
        code, self.pair = np.unique(before * n + self.tokens, return_inverse=True)
        left, right = code // n, code % n
        trained = np.repeat(~self.held, self.lengths)
        seen = np.bincount(self.pair[trained], minlength=len(code))
        home = self.word[left] >> HOME
        spread = np.clip(-(-self.count[left] // fair), 1, buckets)
        mixed = (self.word[right].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
        bucket = (home + (mixed % spread.astype(np.uint64)).astype(np.int64)) % buckets
        self.order = np.lexsort((self.word[right], self.word[left], bucket))
        self.left, self.right, self.seen, self.bucket = left[self.order], right[self.order], seen[self.order], bucket[self.order]
        self.cut = np.searchsorted(self.bucket, np.arange(buckets + 1))


PAIRS = "block bigint, bucket int, v binary, w binary, n binary, low binary"


def _send_pairs(buckets: int, fair: int):
    def run(seq: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        p, out = _Pairs(seq, answers, buckets, fair), []
        for b in range(buckets):
            own = slice(p.cut[b], p.cut[b + 1])
            if p.cut[b] < p.cut[b + 1]:
                out.append((seq["block"].iloc[0], b, pack(p.word[p.left[own]], True), pack(p.word[p.right[own]]), pack(p.seen[own]), pack(p.count[p.right[own]])))
        return pd.DataFrame(out, columns=["block", "bucket", "v", "w", "n", "low"])

    return run


def _count_pairs(unigrams: Unigrams):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        """A bucket of pairs: their counts for each block, and for each context what its weight needs."""
        rows = rows.sort_values("block")
        parts = [tuple(unpack(bytes(x)) for x in (r.v, r.w, r.n, r.low)) for r in rows.itertuples()]
        v, w, n, low = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((w, v))
        new = np.append(True, (v[order][1:] != v[order][:-1]) | (w[order][1:] != w[order][:-1]))
        start = np.nonzero(new)[0]
        total = np.add.reduceat(n[order], start)
        back = np.empty(len(order), np.int64)
        back[order] = np.cumsum(new) - 1
        out, at = [], 0
        for block, part in zip(rows["block"], parts, strict=True):
            out.append(("pair", block, key[0], pack(total[back[at : at + len(part[0])]]), None, None))
            at += len(part[0])
        v, w, low = v[order][start], w[order][start], low[order][start]
        seen = total > 0
        out.append(("bigrams", None, key[0], pack(v[seen], True), pack(w[seen]), pack(total[seen])))
        out.append(("stat", None, key[0], pack(_counts_of_counts(total)), None, None))
        if seen.any():
            v, low, total = v[seen], low[seen], total[seen]
            first = np.nonzero(np.append(True, v[1:] != v[:-1]))[0]
            home = v[first] >> HOME
            held = np.concatenate((np.add.reduceat(unigrams.p(low), first)[:, None], np.stack([np.add.reduceat(np.where(np.minimum(total, GT_MAX + 1) == r, total, 0), first) for r in range(1, GT_MAX + 2)], 1)), 1)
            for h in np.unique(home):
                own = home == h
                out.append(("context", None, int(h), pack(v[first][own], True), np.ascontiguousarray(held[own]).tobytes(), None))
        return _frame(out)

    return run


def _weigh(bigrams: Discounts):
    def run(words: pd.DataFrame, contexts: pd.DataFrame) -> pd.DataFrame:
        """A bucket's contexts: their weights and divisors, for each block that has them."""
        if not len(words):
            return _frame([])
        home = int(words["bucket"].iloc[0]) << HOME
        numbers = [unpack(bytes(b)) for b in words["b"]]
        size = max(int(n.max()) for n in numbers) + 1
        held = np.zeros((size, GT_MAX + 2))
        for r in contexts.itertuples():
            held[unpack(bytes(r.a)) - home] += np.frombuffer(bytes(r.b)).reshape(-1, GT_MAX + 2)
        count = held[:, 1:].sum(1)
        spent = held[:, 1:] @ bigrams.d[1:]
        more = (count > 0) & (count - spent <= 0)
        divisor = np.maximum(count + more, 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            alpha = np.where(count > 0, (divisor - spent) / divisor / (1 - held[:, 0]), 1.0)
        out = [("weight", block, words["bucket"].iloc[0], local, alpha[n].tobytes(), pack(divisor[n])) for block, local, n in zip(words["block"], words["a"], numbers, strict=True)]
        every = np.arange(size)
        out.append(("weights", None, words["bucket"].iloc[0], pack(every, True), alpha.tobytes(), pack(divisor)))
        return _frame(out)

    return run


RESULT = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def _apply(buckets: int, fair: int, unigrams: Unigrams, bigrams: Discounts):
    def run(seq: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(seq):
            return pd.DataFrame({x.split()[0]: [] for x in RESULT.split(", ")})
        p = _Pairs(seq, answers, buckets, fair)
        count = np.zeros(len(p.order), np.int64)
        for r in answers[answers["kind"] == "pair"].itertuples():
            count[p.cut[r.bucket] : p.cut[r.bucket + 1]] = unpack(bytes(r.a))
        alpha, divisor = np.ones(len(p.word)), np.ones(len(p.word))
        for r in answers[answers["kind"] == "weight"].itertuples():
            local = unpack(bytes(r.a))
            alpha[local], divisor[local] = np.frombuffer(bytes(r.b)), unpack(bytes(r.c))
        # down the orders: the pair if it was seen, else the context's weight times the word
        low = unigrams.p(p.count)
        pair = np.where(count > 0, bigrams.spared(count) / divisor[p.left], alpha[p.left] * low[p.right])
        logs = np.empty(len(pair))
        logs[p.order] = np.log10(pair)
        score = logs[p.pair].tolist()
        base = np.log10((p.count + 1) / (unigrams.tokens + 1 * (unigrams.types + 1)))[p.tokens].tolist()
        known = np.add.reduceat((p.count > 0)[p.tokens].astype(np.int64), p.first)
        spans = list(zip(p.first.tolist(), (p.first + p.lengths).tolist(), strict=True))
        return pd.DataFrame({
            "doc_id": pd.array([None if i is None or i != i else int(i) for i in p.ids], dtype="Int64"), "held_out": p.held, "n_tokens": p.lengths, "n_known": known, "train_tokens": unigrams.tokens,
            "base_score": [round(math.fsum(base[a:b]), 6) for a, b in spans], "score": [round(math.fsum(score[a:b]), 6) for a, b in spans],
        })

    return run


def _stat(df: DataFrame) -> np.ndarray:
    """Summed counts of counts: a few numbers a bucket."""
    rows = [unpack(bytes(r.a)) for r in df.filter("kind = 'stat'").select("a").toLocalIterator()]
    return np.sum(rows, axis=0) if rows else np.zeros(GT_MAX + 3, np.int64)


class Katz:
    """The tables of a fitted model together with the blocks they were fitted on."""

    def __init__(self, docs: DataFrame, held_out):
        """docs: (doc_id, text); held_out: a boolean column, false for rows to learn from."""
        spark = prepare(docs.sparkSession)
        # a bucket, and a task, holds what BUCKET_BYTES of text give, whatever the size of the table
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        self.buckets = max(shuffle_partitions(spark), -(-size // BUCKET_BYTES))
        rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held"), "text")
        blocks = stored(_cut(rows, self.buckets), "katz-blocks", ["kind"])
        self.seq = blocks.filter("kind = 'seq'").select("block", "ids", "a", "b", "c")
        words = blocks.filter("kind = 'words'").select("block", "bucket", "a", "b", "c")
        self.unigram_tables = stored(self._dealt(words, "bucket").applyInPandas(_count_words, ANSWERS), "katz-unigrams", ["kind", "bucket"])
        self.unigrams = Unigrams(_stat(self.unigram_tables))
        self.fair = max(1000, self.unigrams.tokens // (8 * self.buckets))
        self.words = self.unigram_tables.filter("kind = 'word'").select(*NAMES[:3], "a", "b", "c")
        pairs = self._dealt(self.seq, "block").cogroup(self._dealt(self.words, "block")).applyInPandas(_send_pairs(self.buckets, self.fair), PAIRS)
        self.bigram_tables = stored(self._dealt(pairs, "bucket").applyInPandas(_count_pairs(self.unigrams), ANSWERS), "katz-bigrams", ["kind"])
        self.bigrams = Discounts(_stat(self.bigram_tables))
        contexts = self.bigram_tables.filter("kind = 'context'").select("bucket", "a", "b")
        weights = self._dealt(self.words, "bucket").cogroup(self._dealt(contexts, "bucket")).applyInPandas(_weigh(self.bigrams), ANSWERS)
        self.weight_tables = stored(weights, "katz-weights", ["kind"])

    def _dealt(self, df: DataFrame, key: str) -> GroupedData:
        """df grouped by key over as many tasks as there are buckets."""
        return df.repartition(self.buckets, key).groupBy(key)

    def scores(self) -> DataFrame:
        """A row for each text: the base model's and this model's log10 probability."""
        answers = self.words
        for t, kind in ((self.bigram_tables, "pair"), (self.weight_tables, "weight")):
            answers = answers.unionByName(t.filter(F.col("kind") == kind).select(*NAMES[:3], "a", "b", "c"))
        return self._dealt(self.seq, "block").cogroup(self._dealt(answers, "block")).applyInPandas(_apply(self.buckets, self.fair, self.unigrams, self.bigrams), RESULT)


def op1_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return Katz(docs, remainder(F.col("doc_id"), 7) == 2).scores()


#: crc32 of a text's bytes; the model, its discounts and weights as in the module's head.
CRC32_SQL = """list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length({0}) + 1), lambda i: ascii(substr({0}, i, 1))::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)::BIGINT[]), lambda x, i: xor(x >> 1, 3988292384 * (x & 1))))"""
OP1_SQL = f"""
WITH docs AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce(xor({CRC32_SQL.format("doc_id::VARCHAR")}, 4294967295) % 7 = 2, false) AS held,
         list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'), '') AS words
  FROM documents),
tokens AS (
  SELECT row, held, unnest(words) AS w, unnest(list_prepend(' ', words[:-2])) AS v FROM docs),
uni AS (SELECT w, count(*) AS c FROM tokens WHERE NOT held GROUP BY w),
bi AS (SELECT v, w, count(*) AS c FROM tokens WHERE NOT held GROUP BY v, w),
coc AS (
  SELECT 1 AS o, least(c, {GT_MAX + 2}) AS r, count(*) AS n FROM uni GROUP BY ALL
  UNION ALL SELECT 2, least(c, {GT_MAX + 2}), count(*) FROM bi GROUP BY ALL),
raw AS (
  SELECT o, r, n, ({GT_MAX + 1} * coalesce((SELECT n FROM coc x WHERE x.o = coc.o AND x.r = {GT_MAX + 1}), 0)) / (SELECT n FROM coc x WHERE x.o = coc.o AND x.r = 1) AS a,
         (r + 1) * coalesce((SELECT n FROM coc x WHERE x.o = coc.o AND x.r = coc.r + 1), 0) / (r * n) AS q
  FROM coc WHERE r <= {GT_MAX}),
disc AS (
  SELECT o, r, n, CASE WHEN a < 1 AND (q - a) / (1 - a) > 0 AND (q - a) / (1 - a) <= 1 THEN (q - a) / (1 - a) ELSE 1 END AS d FROM raw),
totals AS (
  SELECT coalesce((SELECT sum(c) FROM uni), 0)::BIGINT AS n, (SELECT count(*) FROM uni) AS v, coalesce((SELECT sum(r * n * (1 - d)) FROM disc WHERE o = 1), 0) AS spared),
low AS (
  SELECT uni.w, uni.c, uni.c * coalesce(d, 1) / (totals.n + CASE WHEN spared > 0 THEN 0 ELSE 1 END) AS p
  FROM uni CROSS JOIN totals LEFT JOIN disc ON o = 1 AND r = uni.c),
unseen AS (SELECT CASE WHEN spared > 0 THEN spared / n ELSE 1 / (n + 1) END AS p FROM totals),
pairs AS (
  SELECT bi.v, bi.w, bi.c, bi.c * coalesce(d, 1) AS s, low.p FROM bi JOIN low USING (w) LEFT JOIN disc ON o = 2 AND r = bi.c),
ctx AS (
  SELECT v, sum(c) AS c, fsum(s) AS s, fsum(p) AS p, sum(c) + CASE WHEN sum(c) - fsum(s) <= 0 THEN 1 ELSE 0 END AS div FROM pairs GROUP BY v),
each AS (
  SELECT t.row, (low.c IS NOT NULL)::INT AS known, log10((coalesce(low.c, 0) + 1) / (n + 1 * (totals.v + 1))) AS base,
         log10(CASE WHEN pairs.c IS NOT NULL THEN pairs.s / ctx.div
                    ELSE coalesce((ctx.div - ctx.s) / ctx.div / (1 - ctx.p), 1) * coalesce(low.p, unseen.p) END) AS kz
  FROM tokens t CROSS JOIN totals CROSS JOIN unseen LEFT JOIN low USING (w) LEFT JOIN pairs ON pairs.v = t.v AND pairs.w = t.w LEFT JOIN ctx ON ctx.v = t.v)
SELECT doc_id, held AS held_out, count(*) AS n_tokens, sum(known)::BIGINT AS n_known, (SELECT n FROM totals) AS train_tokens,
       round(fsum(base), 6) AS base_score, round(fsum(kz), 6) AS score
FROM each JOIN docs USING (row) GROUP BY row, doc_id, held
"""
