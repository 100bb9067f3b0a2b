"""Conflict-constrained best-fit packing.

Documents are packed into bins of capacity tokens (words and an end token).  A bin
holds no two documents of one source and no two of one duplicate cluster.  Within a
shard, pieces come in falling length; the open bins stand in order of their free
space and carry a bitmap of sources and one of clusters; the search begins at the
first bin with room enough and goes on through its successors until one is
compatible, which is the tightest; else a new bin is opened.

A document longer than a bin is cut: whole pieces fill bins of their own, what is
left is packed.  Shards come from a hash of the id and hold SHARD pieces on average,
so a hot source or cluster is spread evenly and no task sees more than its shards;
a bin never crosses shards, and its constraints hold wherever the bin is made.

Defined results: a null or empty text is one end token; a null source or cluster
conflicts with nothing; the cluster is the digest of the text's words in lower case
unless a column gives it (texts without words: none); repeated rows are packed each;
the result is the same for any partitioning.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, prepare, table

CAPACITY = 2048
SHARD = 8192
#: Successors that are looked at in one step.
LOOK = 128


def _bits(values: list) -> tuple[np.ndarray, int]:
    """A number from 0 for each value that occurs twice or more, else -1."""
    codes, uniques = pd.factorize(np.array(values, dtype=object), use_na_sentinel=True)
    n = np.bincount(codes[codes >= 0], minlength=len(uniques))
    number = np.cumsum(n > 1) - 1
    return np.where((codes >= 0) & (n[codes] > 1), number[codes], -1) if len(uniques) else np.full(len(values), -1), int((n > 1).sum())


def best_fit(lengths: np.ndarray, sources: list, clusters: list, capacity: int = CAPACITY) -> np.ndarray:
    """The bin of each item, in the order given; lengths are at most capacity."""
    n = len(lengths)
    source, n_source = _bits(sources)
    cluster, n_cluster = _bits(clusters)
    out = np.empty(n, np.int64)
    size = 1024
    maps = [np.zeros((max(1, -(-m // 64)), size), np.uint64) for m in (n_source, n_cluster)]
    free, order, bins = np.empty(0, np.int64), np.empty(0, np.int64), 0  # open bins by free space, then number
    for item in range(n):
        need, found = int(lengths[item]), -1
        marks = [(k, int(b) >> 6, np.uint64(1 << (int(b) & 63))) for k, b in enumerate((source[item], cluster[item])) if b >= 0]
        at = int(np.searchsorted(free, need))
        while at < len(free):
            these = order[at : at + LOOK]
            bad = np.zeros(len(these), bool)
            for k, word, bit in marks:
                bad |= (maps[k][word, these] & bit) != 0
            if not bad.all():
                found = at + int(np.argmin(bad))
                break
            at += LOOK
        if found >= 0:
            b, left = int(order[found]), int(free[found]) - need
            free, order = np.delete(free, found), np.delete(order, found)
        else:
            b, left = bins, capacity - need
            bins += 1
            if bins > size:
                size *= 2
                maps = [np.hstack((m, np.zeros_like(m))) for m in maps]
        for k, word, bit in marks:
            maps[k][word, b] |= bit
        if left:
            lo, hi = np.searchsorted(free, [left, left + 1])
            to = int(lo + np.searchsorted(order[lo:hi], b))
            free, order = np.insert(free, to, left), np.insert(order, to, b)
        out[item] = b
    return out


def measure(df: DataFrame, cluster_col: str | None = None) -> DataFrame:
    """(doc_id, source, n_tokens, cluster) of each document."""
    prepare(df.sparkSession)
    rows = df.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), (F.col(cluster_col) if cluster_col else F.lit(None)).cast("string").alias("cluster"), "text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = [(t or "").encode().lower().split() for t in batch.column(3).to_pylist()]
        cluster = batch.column(2) if cluster_col else pa.array([hashlib.blake2b(b" ".join(w), digest_size=16).hexdigest() if w else None for w in words], pa.string())
        return pa.record_batch([batch.column(0), batch.column(1), pa.array([len(w) + 1 for w in words], pa.int64()), cluster], names=["doc_id", "source", "n_tokens", "cluster"])

    return map_batches(rows, run, "doc_id bigint, source string, n_tokens bigint, cluster string")


RESULT = "bin_id bigint, doc_id bigint, piece int, start bigint, n_tokens bigint, source string, cluster string"


def pack(items: DataFrame, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """One row for each piece of (doc_id, source, n_tokens, cluster): the bin it lies in."""
    spark = prepare(items.sparkSession)
    shards = max(1, -(-items.count() // shard))

    def fill(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "source", "cluster", "n_tokens"], na_position="first", kind="stable").reset_index(drop=True)
        whole = (rows["n_tokens"] // capacity).astype(int).to_numpy()
        rest = (rows["n_tokens"] % capacity).to_numpy()
        left = np.nonzero(rest)[0]
        left = left[np.argsort(-rest[left], kind="stable")]
        bins = best_fit(rest[left], rows["source"].iloc[left].tolist(), rows["cluster"].iloc[left].tolist(), capacity)
        owner = np.concatenate((left, np.repeat(np.arange(len(rows)), whole)))
        piece = np.concatenate((whole[left], np.arange(whole.sum()) - np.repeat(np.cumsum(whole) - whole, whole)))
        number = np.concatenate((bins, np.arange(whole.sum()) + (bins.max() + 1 if len(bins) else 0)))
        out = rows.iloc[owner]
        return pd.DataFrame({
            "bin_id": (int(key[0]) << 32) + number, "doc_id": out["doc_id"].to_numpy(), "piece": piece.astype(np.int32), "start": piece * capacity,
            "n_tokens": np.concatenate((rest[left], np.full(whole.sum(), capacity))), "source": out["source"].to_numpy(), "cluster": out["cluster"].to_numpy(),
        })

    sharded = items.withColumn("shard", F.pmod(F.xxhash64(F.lit(6), "doc_id"), F.lit(shards)))
    return sharded.repartition(min(shards, max(1, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))), "shard").groupBy("shard").applyInPandas(fill, RESULT)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(measure(table(spark, sf_dir, "documents")))
