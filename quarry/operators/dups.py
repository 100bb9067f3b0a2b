"""Near-duplicate pages by 64-bit fingerprints within a Hamming distance."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from itertools import count, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store

DISTANCE = 8


def simhash(tokens: Iterable[bytes | memoryview | str]) -> int:
    """Bits that most tokens' digests have set, as a signed number; 0 for no tokens."""
    digests = [hashlib.blake2b(t.encode() if isinstance(t, str) else t, digest_size=8).digest() for t in tokens]
    if not digests:
        return 0
    raw = np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 8)
    votes = np.unpackbits(raw, axis=1).sum(0, dtype=np.int64) * 2 - len(digests)
    return int.from_bytes(np.packbits(votes > 0).tobytes(), "big", signed=True)


def windows(words: bytes, n: int) -> Iterator[memoryview]:
    """Every n words in a row of words with one blank between, uncopied; the words themselves where there are fewer."""
    if not words:
        return iter(())
    blanks = np.flatnonzero(np.frombuffer(words, np.uint8) == ord(" ")).tolist()
    starts, ends, at = [0, *(i + 1 for i in blanks)], [*blanks, len(words)], memoryview(words)
    return (at[i:j] for i, j in zip(starts, ends[n - 1 if len(ends) >= n else 0 :], strict=False))


def _printed(df: DataFrame, given: str, kept: list[str], of: Callable[[pa.Array], list[int]]) -> DataFrame:
    """kept columns of df with simhash, which of() gives for a batch of the column given."""
    store.prepare(df.sparkSession)
    at, keep = df.columns.index(given), [df.columns.index(c) for c in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([*(b.column(i) for i in keep), pa.array(of(b.column(at)), pa.int64())], names=[*kept, "simhash"])

    return df.mapInArrow(run, ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept), "simhash bigint"]))


def with_simhash(df: DataFrame, tokens_col: str) -> DataFrame:
    """df with simhash, in place of a column of that name."""
    df = df.drop("simhash")
    return _printed(df, tokens_col, df.columns, lambda x: [simhash(t or []) for t in x.to_pylist()])


def with_shingle_simhash(df: DataFrame, words: Column, n: int = 4, kept: list[str] | None = None) -> DataFrame:
    """df (of it the columns kept) with simhash of text.shingles(words, n), in place of a column of that name.

    Words without blanks in them: they go to Python once, joined, and their windows are cut
    there, where the shingles themselves are n times the text.
    """
    kept = [c for c in kept or df.columns if c != "simhash"]
    laid = df.select(*(F.col(f"`{c}`") for c in kept), F.array_join(words, " ").cast("binary").alias("_words"))
    return _printed(laid, "_words", kept, lambda x: [simhash(windows(t or b"", n)) for t in x.to_pylist()])


def near_pairs(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(a, b, distance) for every two ids whose prints differ in at most so many bits.

    prints: (id, simhash).  The bits are cut into so many blocks that two prints within
    the distance differ in two bits at most in one of them.  A print has a key for each
    block as it is and with each one bit flipped; two blocks two bits apart share a key,
    so an equi-join finds all pairs, and chance brings few others together (blocks of 21
    bits at the usual distance).  A pair that meets under several keys counts under one:
    in the first block that is near enough, the smaller print's own block, with the lowest
    odd bit flipped where two differ.  Equal prints are one before that; all their pairs
    are in the result, which near_clusters() does without.

    Sizes are guessed from the files, which know nothing of the keys; merged() keeps what
    looks small away from the driver.
    """
    blocks = distance // 3 + 1
    cut = [64 * i // blocks for i in range(blocks + 1)]

    def part(print_: Column | str, a: int, b: int) -> Column:
        return F.shiftrightunsigned(print_, a).bitwiseAND(F.lit((1 << (b - a)) - 1 if b - a < 64 else -1))

    def keys(a: int, b: int) -> Column:
        own = part("simhash", a, b)
        flips = [0, *((1 << i) - (1 << 64 if i == 63 else 0) for i in range(b - a))]
        return F.transform(F.array(*(F.lit(m).cast("bigint") for m in flips)), lambda m: own.bitwiseXOR(m))

    distinct = prints.select("simhash").distinct()
    keyed = distinct.select("simhash", F.posexplode(F.array(*(keys(*x) for x in pairwise(cut)))).alias("block", "keys")).select("simhash", "block", F.explode("keys").alias("key"))
    x, y = keyed.select(F.col("simhash").alias("x"), "block", "key"), keyed.select(F.col("simhash").alias("y"), "block", "key")
    apart = F.bit_count(F.col("x").bitwiseXOR(F.col("y")))
    once = F.lit(False)
    for n, (i, j) in reversed(list(enumerate(pairwise(cut)))):
        own, odd = part(F.col("x"), i, j), part(F.col("x").bitwiseXOR(F.col("y")), i, j)
        two = F.when(F.bit_count(odd) == 2, odd.bitwiseAND(F.negative(odd))).otherwise(F.lit(0))
        once = F.when(F.bit_count(odd) <= 2, (F.col("block") == n) & (F.col("key") == own.bitwiseXOR(two))).otherwise(once)
    met = merged(x, y, ["block", "key"]).filter((F.col("x") < F.col("y")) & (apart <= distance) & once).select("x", "y", apart.alias("distance"))
    a, b = prints.select(F.col("id").alias("a"), F.col("simhash").alias("x")), prints.select(F.col("id").alias("b"), F.col("simhash").alias("y"))
    far = merged(merged(met, a, "x"), b, "y").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "distance")
    same = merged(a, b.withColumnRenamed("y", "x"), "x").filter("a < b").select("a", "b", F.lit(0).alias("distance"))
    return far.unionByName(same)


def merged(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """left joined with right, sorted and merged: never sent whole to the driver and every executor, however small it looks."""
    return left.join(right.hint("merge"), on, how)


def near_clusters(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(id, leader) of every id that is near another: as leaders() of near_pairs() gives them.

    Ids of one print stand or fall together under the least of them, so only that one is
    compared, however many copies there are.
    """
    rows = prints.select("id", "simhash")
    prime = rows.groupBy("simhash").agg(F.min("id").alias("prime"), F.count("*").alias("n"))
    led = leaders(near_pairs(prime.select(F.col("prime").alias("id"), "simhash"), distance)).select(F.col("id").alias("prime"), "leader")
    return merged(merged(rows, prime, "simhash"), led, "prime", "left").select("id", F.coalesce("leader", F.when(F.col("n") > 1, F.col("prime"))).alias("leader")).filter("leader is not null")


def leaders(pairs: DataFrame) -> DataFrame:
    """(id, leader): each id in order leads those near it that no earlier one has taken.

    A node without an undecided smaller neighbour leads; its neighbours are its
    members; the two are taken out, until no pair is left.  Each round is checkpointed,
    and so is what is found, now and then, so that its plan stays small.
    """
    spark = pairs.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(store.shared_dir(spark))
    left, out = pairs.select("a", "b").checkpoint(), None
    for n in count(1):
        heads = merged(left.select("a").distinct(), left.select(F.col("b").alias("a")), "a", "left_anti")
        got = merged(left, heads, "a").groupBy("b").agg(F.min("a").alias("leader")).select(F.col("b").alias("id"), "leader").unionByName(heads.select(F.col("a").alias("id"), F.col("a").alias("leader")))
        got = got.checkpoint()
        out = got if out is None else out.unionByName(got)
        out = out if n % 50 else out.checkpoint()
        gone = got.select("id")
        left = merged(merged(left, gone, left["a"] == gone["id"], "left_anti"), gone, left["b"] == gone["id"], "left_anti").checkpoint()
        if left.isEmpty():
            return out
