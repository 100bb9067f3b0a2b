"""Near-duplicate documents by DartMinHash signatures and a banded join.

A text's elements are its five-word shingles, weighted by how often each occurs: the
element's region is a strip for every occurrence.  Darts are thrown at a strip by a
Poisson process that the shingle's hash drives (a dart's rank is a sum of
exponentials), each dart lands on one of K coordinates, and a coordinate keeps its
earliest dart.  Two texts agree on a coordinate with the probability of their
weighted Jaccard similarity.  A text of weight n needs darts only up to the rank
(K ln K + 2K) / n, so the work is the number of strips plus K ln K, not K times the
strips; texts with an empty coordinate are thrown again to twice the rank.

Texts that share a band of ROWS coordinates meet in a bucket (recall at similarity
0.8: 0.9999).  Copies are one node from the start; of buckets with the same members
one is kept; within a bucket similarities are computed exactly, from the strips.  No
pair list is built: a leader is compared with all members at once, those of
similarity 0.8 join it, and only members between 0.6 and 0.8 must be leaders as well.
That loses no link: 1 - similarity is a metric, so if a is within 0.2 of its leader
and of b, then b is within 0.4 of that leader, hence joined to it or a leader itself.
Buckets over HOT nodes or HOT_STRIPS strips are worked on by pairs of blocks, exactly and
in bounded tasks.  Texts meet the candidates' ids by a shuffle at every size.  A text is named by 128 bits of a digest, a strip by 64.  Classes are the connected components of these links, found by passing the least
label along stars; neither links nor labels reach the driver.

Defined results: class_id is the least doc_id of the class; texts without words
(null, empty) are classes of their own; texts of one to four words have one element,
all words; words are compared in lower case (A-Z); at equal leaders the text with the
least digest leads; rows without an id have a null class; rows that repeat an id share
its fate in keep_one(); a text of many MB is one node and one row of strips; only doc_id
and text are read, other columns are ignored (keep_one() keeps them); an empty table
gives an empty one.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, map_batches, prepare, stored, table

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 5
K = BANDS * ROWS
HOT, HOT_STRIPS = 1024, 1 << 21
REMEMBER = 500_000

GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The finishing steps of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Words:
    """Word hashes that a worker remembers."""

    number: dict[bytes, int] = {}

    @classmethod
    def hashes(cls, words: list[bytes]) -> np.ndarray:
        known = cls.number
        try:
            return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        except KeyError:
            if len(known) > REMEMBER:
                known.clear()
            known.update((w, xxhash.xxh64_intdigest(w)) for w in set(words) if w not in known)
            return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def words_of(text: str | None) -> list[bytes]:
    return text.encode().lower().split() if text else []


def strips(words: list[bytes]) -> np.ndarray:
    """A sorted hash for each occurrence of each shingle; no two are equal."""
    if not words:
        return np.zeros(0, np.uint64)
    h = _Words.hashes(words)
    width = min(SHINGLE, len(words))
    s = np.full(len(h) - width + 1, width, np.uint64)
    for i in range(width):
        s = mix(s * GOLDEN + h[i : len(s) + i])
    s.sort()
    new = np.append(True, s[1:] != s[:-1])
    if not new.all():  # the second occurrence is another strip than the first, which is the same in every text
        at = np.arange(len(s))
        s = np.where(new, s, mix(s + (at - np.maximum.accumulate(np.where(new, at, 0))).astype(np.uint64) * GOLDEN))
        s.sort()
    return s


def node_of(words: list[bytes]) -> bytes:
    """128 bits of a digest of the words: copies have the same."""
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def signatures(sets: list[np.ndarray], k: int = K) -> np.ndarray:
    """The earliest dart of each coordinate, for each set of strips (none empty)."""
    out = np.zeros((len(sets), k), np.uint32)
    todo, reach = np.arange(len(sets)), k * np.log(k) + 2 * k
    while len(todo):
        sizes = np.array([len(sets[n]) for n in todo])
        owner = np.repeat(np.arange(len(todo)), sizes)
        state = mix(np.concatenate([sets[n] for n in todo]) + GOLDEN)
        limit = (reach / sizes)[owner]
        rank = np.zeros(len(state))
        found: list[tuple[np.ndarray, np.ndarray]] = []
        while len(state):
            state = mix(state + GOLDEN)
            rank = rank - np.log(((state >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53)
            hit = np.nonzero(rank <= limit)[0]
            if not len(hit):
                break
            state, rank, limit, owner = state[hit], rank[hit], limit[hit], owner[hit]
            dart = mix(state ^ np.uint64(0xD6E8FEB86659FD93))
            place = owner * k + ((dart >> np.uint64(32)) % np.uint64(k)).astype(np.int64)
            found.append((place, rank.astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32) | dart & np.uint64(0xFFFFFFFF)))
        place, dart = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(place, kind="stable")
        place, dart = place[order], dart[order]
        first = np.nonzero(np.append(True, place[1:] != place[:-1]))[0]
        best = np.minimum.reduceat(dart, first)
        part = np.zeros(len(todo) * k, np.uint32)
        have = np.zeros(len(todo) * k, bool)
        part[place[first]] = (best & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        have[place[first]] = True
        whole = have.reshape(-1, k).all(1)
        out[todo[whole]] = part.reshape(-1, k)[whole]
        todo, reach = todo[~whole], reach * 2
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """One hash for each band of each row, different for each band."""
    rows = signature.reshape(len(signature), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), rows.shape[:2]).copy()
    for i in range(ROWS):
        key = mix(key * GOLDEN + rows[:, :, i])
    return key.view(np.int64)


def sketch(df: DataFrame) -> DataFrame:
    """(doc_id, node, size, bands) of (doc_id, text); null for texts without words; size: the number of strips."""
    prepare(df.sparkSession)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = [words_of(t) for t in batch.column(1).to_pylist()]
        some = [n for n, w in enumerate(words) if w]
        nodes: list[bytes | None] = [None] * len(words)
        sizes = [max(len(w) - SHINGLE + 1, 1) if w else None for w in words]
        bands: list[np.ndarray | None] = [None] * len(words)
        if some:
            own: dict[bytes, int] = {}
            for n in some:
                nodes[n] = node_of(words[n])
                own.setdefault(nodes[n], n)
            keys = band_keys(signatures([strips(words[n]) for n in own.values()]))
            at = {node: k for node, k in zip(own, keys, strict=True)}
            for n in some:
                bands[n] = at[nodes[n]]
        return pa.record_batch([batch.column(0), pa.array(nodes, pa.binary()), pa.array(sizes, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "node", "size", "bands"])

    return map_batches(df.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), run, "doc_id bigint, node binary, size bigint, bands array<bigint>")


def link(nodes: np.ndarray, sets: list[np.ndarray], similarity: float = SIMILARITY) -> list[tuple]:
    """Links that connect every two sets joined by a chain of similar ones: at most one fewer than sets."""
    n = len(nodes)
    order = np.argsort(nodes, kind="stable")
    sizes = np.array([len(sets[i]) for i in order])
    values, number = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)
    ends = np.concatenate(([0], np.cumsum(sizes)))
    group = np.arange(n)  # the component of each
    joined, led = np.zeros(n, bool), np.zeros(n, bool)
    near: list[list[int]] = [[] for _ in range(n)]  # leaders whose members may be similar although the leader is not
    mark = np.zeros(len(values), bool)
    out: list[tuple] = []

    def lead(i: int) -> None:
        own = number[ends[i] : ends[i + 1]]
        mark[own] = True
        common = np.add.reduceat(mark[number].astype(np.int64), ends[:-1])
        mark[own] = False
        alike = common / (sizes + sizes[i] - common)
        led[i] = True
        for j in np.nonzero(alike >= similarity)[0]:
            joined[j] = True
            if group[j] != group[i]:
                group[group == group[j]] = group[i]
                out.append((nodes[order[i]], nodes[order[j]]))
        for j in np.nonzero((alike >= 2 * similarity - 1 - 1e-9) & (alike < similarity))[0]:
            near[j].append(i)

    for i in range(n):
        if not joined[i]:
            lead(i)
    again = True
    while again:
        again = False
        for i in range(n):
            if not led[i] and any(group[j] != group[i] for j in near[i]):
                lead(i)
                again = True
    return out


def links(docs: DataFrame, sketches: DataFrame, hot: int = HOT, hot_strips: int = HOT_STRIPS) -> DataFrame:
    """(a, b): links between nodes that connect every two similar ones."""
    reps = sketches.filter("node is not null and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("size").alias("size"), F.first("bands").alias("bands"))
    keys = reps.select("node", "size", F.explode("bands").alias("key"))
    buckets = keys.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("strips"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("y")).filter("n > 1")
    kept = buckets.groupBy("n", "strips", "x", "y").agg(F.min("key").alias("key")).select("key", "n", "strips")
    members = stored(keys.select("node", "key").join(kept, "key"), "neardup-members")
    wanted = members.select("node").distinct().join(reps.select("node", "doc_id"), "node")

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = [words_of(t) for t in batch.column(1).to_pylist()]
        node = pa.array([node_of(w) if w else None for w in words], pa.binary())
        own = pa.array([strips(w).tobytes() for w in words], pa.binary())
        out = pa.record_batch([batch.column(0), own], names=["node", "strips"])
        return out.filter(pc.equal(node, batch.column(0)))

    texts = docs.select("doc_id", "text").join(wanted.hint("merge"), "doc_id").select("node", "text")
    sets = map_batches(texts, cut, "node binary, strips binary").groupBy("node").agg(F.first("strips").alias("strips"))
    # a hot bucket becomes a bucket for every two of its blocks, so that no task holds more than two
    blocks = F.ceil(F.greatest(F.col("n") / hot, F.col("strips") / hot_strips)).cast("int")
    block = F.pmod(F.xxhash64(F.lit(2), "node"), blocks).cast("int")
    split = members.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    split = split.select("node", F.col("key"), F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")).distinct()

    def connect(rows: pd.DataFrame) -> pd.DataFrame:
        found = link(rows["node"].to_numpy(), [np.frombuffer(s, np.uint64) for s in rows["strips"]])
        return pd.DataFrame(found, columns=["a", "b"])

    return split.join(sets, "node").groupBy("key", "i", "j").applyInPandas(connect, "a binary, b binary")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node on an edge: root is the least node of its component.

    Large and small stars by turns (each node links its neighbours to the least one
    among them) until nothing changes; every round is written to the shared folder.
    """
    now = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "neardup-star")
    seen = before = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        down = large.join(small, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").unionByName(small.select("a", F.col("m").alias("b")))
        if before is not None:
            discard(before)
        before, now = now, stored(down.distinct(), "neardup-star")
        mark = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.count_if(F.col("a") <= F.col("b"))).first()
        if mark == seen:
            return now.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
        seen = mark


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id) for each row of (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    sketches = stored(sketch(rows), "neardup-sketch")
    parts = components(links(rows, sketches))
    roots = parts.select("node", "root").unionByName(parts.select(F.col("root").alias("node"), "root").distinct()).distinct()
    nodes = sketches.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("first"))
    rooted = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    names = rooted.groupBy("root").agg(F.min("first").alias("class_id"))
    named = rooted.join(names, "root").select("node", "class_id")
    one = sketches.select("doc_id", "node").join(named, "node", "left")
    return one.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows whose id is the least of their class; columns stay."""
    drop = classes(docs).filter("doc_id <> class_id").select(F.col("doc_id").alias("_dropped_id")).distinct()
    return docs.join(drop, docs["doc_id"] == drop["_dropped_id"], "left_anti")


def op10_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))
