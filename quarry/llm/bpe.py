"""Byte-level BPE, encoded and decoded by DuckDB inside each task.

Encoding: a text is cut by the tokenizer's pattern; each distinct piece of a batch
becomes token-position rows (one a byte), a recursive query joins neighbouring rows
with the merge table and contracts each word's leftmost pair of minimum rank until
no pair of it merges.  Decoding: an ordered aggregation joins the tokens' bytes.

A recursive query costs a word's length times its merges.  So every piece is first cut
at boundaries that no token of the vocabulary can span where it lies (no token of two or
three bytes, and no four bytes of a longer one, lies across): no merge crosses such a
boundary, so what lies between two of them is a word of its own, with the same merges.
Words that are still over LONG_WORD bytes (periodic text) are contracted by a query that
takes, in one round, all places of the minimum rank, from the left and without overlap,
in place of the first; so text without blanks, or a line of a million dashes, costs a
number of rounds, not one for each merge.

Units of text and words are encoded once while a worker remembers them (a bounded
memory; results do not depend on it).

Defined results: a null or empty text has no tokens; repeated rows repeat; ties of
rank go to the leftmost pair; a text of many MB is one batch, its words are queried in
parts of QUERY_BYTES; ids that the vocabulary lacks raise an error in decoding; ids
are nullable; encode() reads doc_id and text, other columns are ignored; decode()
takes over all columns, but for one named decoded, which it replaces; an empty table
gives an empty one.
"""

from __future__ import annotations

import base64
from bisect import bisect_right
from functools import lru_cache
from itertools import chain, pairwise

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, prepare, table

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Words over this many bytes take all places of a rank in one round.
LONG_WORD = 64
#: A worker remembers this many words, and units of text between blanks, and about as many
#: that came lately before them; longer ones are not kept.
REMEMBER = 150_000
LONG_UNIT = 48
#: Bytes in one recursive query (or one word): bounds its memory.
QUERY_BYTES = 250_000
#: Slots of the filter before a search among the fours of bytes.
FOURS_BITS = 20
#: Ids in one decoding query.
QUERY_IDS = 1 << 18
END_SIGNS = frozenset(".,;:!?")
#: White space as the tokenizer's own library has it (U+001C to U+001F are none).
SPACE = r"[\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"

#: A row's key k is its piece and its place there; a pair's is its rank, then its place.
ENCODE_SQL = """
WITH RECURSIVE s(k, t, live) AS (
  SELECT w::BIGINT << 16 | p, t, true FROM bytes
  UNION ALL
  (WITH pairs AS (
     SELECT k, t, lead(t) OVER o AS u, lead(k) OVER o AS q FROM s WHERE live WINDOW o AS (ORDER BY k)),
   ranked AS (
     SELECT a.k, a.t, a.q, m.id, m.id::BIGINT << 16 | (a.k & 65535) AS key
     FROM pairs a LEFT JOIN merges m ON a.t = m.l AND a.u = m.r AND a.k >> 16 = a.q >> 16),
   best AS (SELECT k >> 16 AS w, min(key) AS key, arg_min(q, key) AS q FROM ranked GROUP BY ALL)
   SELECT r.k, CASE WHEN r.key = b.key THEN r.id ELSE r.t END, b.key IS NOT NULL
   FROM ranked r JOIN best b ON r.k >> 16 = b.w WHERE b.q IS NULL OR r.k <> b.q))
SELECT (k >> 16)::INT AS w, t FROM s WHERE NOT live ORDER BY k
"""
#: The same, but each round takes all places of a word's minimum rank: in a run of places that
#: overlap, every other one from its first.  A round's place in a run is counted by its row n.
ENCODE_MANY_SQL = """
WITH RECURSIVE s(k, t, live) AS (
  SELECT w::BIGINT << 32 | p, t, true FROM bytes
  UNION ALL
  (WITH pairs AS (
     SELECT k, k >> 32 AS w, t, lead(t) OVER o AS u, lead(k) OVER o AS q, row_number() OVER o AS n FROM s WHERE live WINDOW o AS (ORDER BY k)),
   ranked AS (
     SELECT a.k, a.w, a.t, a.n, m.id FROM pairs a LEFT JOIN merges m ON a.t = m.l AND a.u = m.r AND a.w = a.q >> 32),
   best AS (SELECT w, min(id) AS id FROM ranked GROUP BY ALL),
   hits AS (SELECT r.k, r.t, r.n, b.id, r.id IS NOT DISTINCT FROM b.id AND b.id IS NOT NULL AS hit FROM ranked r JOIN best b ON r.w = b.w),
   taken AS (SELECT k, t, id, hit AND (n - max(CASE WHEN hit THEN 0 ELSE n END) OVER (ORDER BY k)) & 1 = 1 AS taken FROM hits)
   SELECT k, CASE WHEN taken THEN id ELSE t END, id IS NOT NULL FROM (SELECT *, lag(taken) OVER (ORDER BY k) AS gone FROM taken) WHERE gone IS NOT TRUE))
SELECT (k >> 32)::INT AS w, t FROM s WHERE NOT live ORDER BY k
"""
#: Bytes as the 256 first signs of Unicode, so that a string can be aggregated.
DECODE_SQL = """
SELECT d, string_agg(v.signs, '' ORDER BY p) AS signs
FROM tokens JOIN vocabulary v USING (id) GROUP BY d ORDER BY d
"""


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def differ(a: pa.Array, b: pa.Array) -> np.ndarray:
    return pc.not_equal(a, b).to_numpy(zero_copy_only=False)


class Remembered(dict):
    """A dict that lets go of what was not asked for lately."""

    def __init__(self) -> None:
        super().__init__()
        self.old: dict = {}

    def missing(self, keys: set) -> set:
        """Those of keys that must be learned; the others are now in the dict."""
        if len(self) > REMEMBER:
            self.old = dict(self)
            self.clear()
        keys = keys.difference(self)
        back = keys.intersection(self.old)
        self.update(zip(back, map(self.old.__getitem__, back), strict=True))
        return keys.difference(back)


class Codec:
    """A vocabulary with its DuckDB connection; one for each worker."""

    def __init__(self, path: str):
        import public_tokenizers

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern = regex.compile(public_tokenizers.PATTERN.replace(r"[^\s", r"[^" + SPACE[1:-1]).replace(r"\S", "[^" + SPACE[1:]).replace(r"\s", SPACE))
        merges = [(self.ranks[t[:i]], self.ranks[t[i:]], n) for t, n in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "1GB", "temp_directory": "", "preserve_insertion_order": False})
        m = pa.table([pa.array(x, pa.int32()) for x in zip(*merges, strict=True)], names=["l", "r", "id"])  # noqa: F841
        v = pa.table([pa.array(list(self.ranks.values()), pa.int32()), pa.array([t.decode("latin-1") for t in self.ranks])], names=["id", "signs"])  # noqa: F841
        self.db.execute("CREATE TABLE merges AS SELECT * FROM m")
        self.db.execute("CREATE TABLE vocabulary AS SELECT * FROM v")
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        # what can span a boundary: tokens of two and of three bytes, fours of bytes in longer ones
        self.twos, self.threes = np.zeros(1 << 16, bool), np.zeros(1 << 24, bool)
        for size, seen in ((2, self.twos), (3, self.threes)):
            seen[[int.from_bytes(t) for t in self.ranks if len(t) == size]] = True
        self.fours = np.unique(np.array([int.from_bytes(t[i : i + 4]) for t in self.ranks for i in range(len(t) - 3)], np.uint32))
        self.maybe = np.zeros(1 << FOURS_BITS, bool)
        self.maybe[self._slot(self.fours)] = True
        # ids as 4-byte words; units: what follows a blank, without it
        self.words, self.units = Remembered(), Remembered()

    # encoding

    @staticmethod
    def _slot(fours: np.ndarray) -> np.ndarray:
        return (fours * np.uint32(2654435769)) >> np.uint32(32 - FOURS_BITS)

    def _cut(self, pieces: list[bytes]) -> tuple[list[bytes], np.ndarray]:
        """The words of all pieces, and how many each piece (none is empty) has."""
        joined = b"".join(pieces)
        n = len(joined)
        text = np.frombuffer(joined + bytes(4), np.uint8).astype(np.uint32)
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        begins = np.zeros(n + 4, bool)
        begins[np.cumsum(lengths) - lengths] = begins[n:] = True
        # spanned[i]: a token may lie across the boundary before i
        spanned = np.zeros(n + 4, bool)
        inside = ~begins
        two = text[:n] << 8 | text[1 : n + 1]
        spanned[1 : n + 1] |= self.twos[two] & inside[1 : n + 1]
        three = two << 8 | text[2 : n + 2]
        pair = inside[1 : n + 1] & inside[2 : n + 2]
        at = np.flatnonzero(self.threes[three] & pair)
        spanned[at + 1] = spanned[at + 2] = True
        four = three << 8 | text[3 : n + 3]
        at = np.flatnonzero(self.maybe[self._slot(four)] & pair & inside[3 : n + 3])
        place = np.searchsorted(self.fours, four[at])
        place[place == len(self.fours)] = 0
        at = at[self.fours[place] == four[at]] if len(self.fours) else at[:0]
        spanned[at + 1] = spanned[at + 2] = spanned[at + 3] = True
        cuts = np.flatnonzero(~spanned[:n] | begins[:n])
        counts = np.diff(np.append(np.flatnonzero(begins[cuts]), len(cuts)))
        return [joined[a:b] for a, b in pairwise([*cuts.tolist(), n])], counts

    def _query(self, words: list[bytes], sql: str) -> list[bytes]:
        lengths = np.fromiter(map(len, words), np.int32, len(words))
        first = np.repeat(np.cumsum(lengths) - lengths, lengths)
        text = np.frombuffer(b"".join(words), np.uint8)
        bytes = pa.table([np.repeat(np.arange(len(words), dtype=np.int32), lengths), (np.arange(len(text)) - first).astype(np.int32), self.byte_ids[text]], names=["w", "p", "t"])  # noqa: A001, F841
        found = self.db.sql(sql).to_arrow_table()
        flat, counts = found.column("t").to_numpy().astype(np.int32).tobytes(), np.bincount(found.column("w").to_numpy(), minlength=len(words))
        return [flat[a:b] for a, b in pairwise([0, *(4 * np.cumsum(counts)).tolist()])]

    def contract(self, words: list[bytes]) -> dict[bytes, bytes]:
        """The ids of each distinct word, by recursive queries over words of like length."""
        out: dict[bytes, bytes] = {}
        words = sorted(words, key=len)
        size = np.cumsum([len(w) for w in words])
        at = 0
        while at < len(words):
            many = len(words[at]) > LONG_WORD
            end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + QUERY_BYTES, "right")))
            if not many:  # both kinds are never in one query
                end = min(end, bisect_right(words, LONG_WORD, lo=at, key=len))
            out.update(zip(words[at:end], self._query(words[at:end], ENCODE_MANY_SQL if many else ENCODE_SQL), strict=True))
            at = end
        return out

    def _pieces(self, pieces: set[str]) -> dict[str, bytes]:
        """The ids of each piece: a token's own, or those of its words."""
        out: dict[str, bytes] = {}
        rest: list[tuple[str, bytes]] = []
        for s in pieces:
            raw = s.encode()
            if (r := self.ranks.get(raw)) is not None:
                out[s] = r.to_bytes(4, "little")
            else:
                rest.append((s, raw))
        if not rest:
            return out
        words, counts = self._cut([raw for _, raw in rest])
        missing = self.words.missing(set(words))
        self.words.update(self.contract(list(missing)))
        ids = list(map(self.words.__getitem__, words))
        ends = np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))[np.cumsum(counts) - 1]
        flat = b"".join(ids)
        out.update((s, flat[a:b]) for (s, _), (a, b) in zip(rest, pairwise([0, *ends.tolist()]), strict=True))
        for w in [w for w in missing if len(w) > LONG_UNIT]:
            del self.words[w]
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and how many each has.

        A single blank between two signs that are no white space begins a piece, so
        what lies between such blanks is a unit, encoded apart; other texts are cut whole.
        """
        n = len(texts)
        if not n:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        split = pc.split_pattern(pc.fill_null(texts, ""), " ")
        ends = split.offsets.to_numpy().astype(np.int64)
        ends = ends - ends[0]
        coded = split.flatten().dictionary_encode()
        at, names = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        # a unit that is empty or has white space at an end spoils its text, a first one if it ends in it
        spoils = differ(coded.dictionary, pc.utf8_trim_whitespace(coded.dictionary)) | (pc.utf8_length(coded.dictionary).to_numpy() == 0)
        ends_blank = differ(coded.dictionary, pc.utf8_rtrim_whitespace(coded.dictionary))
        so_far = np.concatenate(([0], np.cumsum(spoils[at])))
        firsts = at[ends[:-1]]
        plain = (so_far[ends[1:]] == so_far[ends[:-1] + 1]) & ~ends_blank[firsts]
        first = np.zeros(len(at), bool)
        first[ends[:-1]] = True
        used = first | np.repeat(plain, np.diff(ends))
        needed = np.zeros(len(names), bool)
        needed[at[used & ~first]] = True
        wanted = [names[i] for i in np.flatnonzero(needed).tolist()]
        new = self.units.missing(set(wanted))
        # letters, and letters with one end sign, need no search by the pattern
        words = [u for u in new if u.isalpha()]
        ended = [u for u in new.difference(words) if u[-1] in END_SIGNS and u[:-1].isalpha()]
        found = {u: self.pattern.findall(" " + u) for u in new.difference(words, ended)}
        alone = [self.pattern.findall(names[i]) if p else () for i, p in zip(firsts.tolist(), plain.tolist(), strict=True)]
        for i in np.flatnonzero(~plain).tolist():
            alone[i] = self.pattern.findall(texts[i].as_py())
        inner = [" " + u for u in words], [" " + u[:-1] for u in ended]
        pieces = set(chain(*inner, (u[-1] for u in ended)))
        pieces.update(chain.from_iterable(found.values()))
        pieces.update(chain.from_iterable(alone))
        piece = self._pieces(pieces).__getitem__
        self.units.update(zip(words, map(piece, inner[0]), strict=True))
        self.units.update((u, piece(w) + piece(u[-1])) for u, w in zip(ended, inner[1], strict=True))
        self.units.update((u, b"".join(map(piece, p))) for u, p in found.items())
        parts = [*map(self.units.__getitem__, wanted), *(b"".join(map(piece, a)) for a in alone)]
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        flat = np.frombuffer(b"".join(parts), np.int32)
        place = np.cumsum(needed) - 1
        order = np.where(first, len(wanted) + np.cumsum(first) - 1, place[at])[used]
        long = sizes[order]
        shift = (np.cumsum(sizes) - sizes)[order] - (np.cumsum(long) - long)
        ids = flat[np.repeat(shift, long) + np.arange(int(long.sum()))]
        counts = np.add.reduceat(long, np.flatnonzero(first[used]))
        for u in [u for u in new if len(u) > LONG_UNIT]:
            del self.units[u]
        return ids, counts

    # decoding

    def decode(self, ids: pa.ListArray) -> list[bytes]:
        """The bytes of each list of ids; null or empty lists give b""."""
        flat, owner = ids.flatten(), pc.list_parent_indices(ids)
        if len(flat) and (flat.null_count or pc.min(flat).as_py() < 0 or pc.max(flat).as_py() >= len(self.ranks)):
            raise ValueError("an id is not in the vocabulary")
        more: list[list[bytes]] = [[] for _ in range(len(ids))]
        for at in range(0, len(flat), QUERY_IDS):  # a list may go on in the next query, in order
            part = flat.slice(at, QUERY_IDS)
            tokens = pa.table([owner.slice(at, QUERY_IDS).cast(pa.int64()), np.arange(len(part), dtype=np.int32), part.cast(pa.int32())], names=["d", "p", "id"])  # noqa: F841
            for d, signs in self.db.sql(DECODE_SQL).fetchall():
                more[d].append(signs.encode("latin-1"))
        return [b"".join(m) for m in more]


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode(df: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids) for (doc_id, text)."""
    prepare(df.sparkSession)
    path = path or default_path()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, counts = codec(path).encode(batch.column(1))
        ends = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
        return pa.record_batch([batch.column(0), pa.array(counts), pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))], names=["doc_id", "n_tokens", "ids"])

    return map_batches(df.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), run, "doc_id bigint, n_tokens bigint, ids array<int>")


def decode(df: DataFrame, path: str | None = None) -> DataFrame:
    """df (with ids) plus decoded: the bytes that the ids stand for."""
    prepare(df.sparkSession)
    path = path or default_path()
    df = df.drop("decoded")
    at = df.columns.index("ids")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.record_batch([*batch.columns, pa.array(codec(path).decode(batch.column(at)), pa.binary())], names=[*batch.schema.names, "decoded"])

    return map_batches(df, run, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema)}, decoded binary")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = decode(encode(table(spark, sf_dir, "documents")))
    return done.select("doc_id", "n_tokens", F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
