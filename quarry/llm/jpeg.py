"""Media columns: a baseline JPEG codec in numpy.

Reading parses the markers, Huffman-decodes the scan (all restart intervals of a
batch in step, so that the work per code is a few numpy operations), and rebuilds
a luminance thumbnail from the DC coefficients alone, one sample a block.

Writing stores bytes losslessly as a greyscale JPEG: the unit is the quantised
coefficient, one byte each, 64 to a block.  Coefficients of size category 8 take
exactly 256 values (-255..-128 and 128..255), whose amplitude bits are the byte.
The quantisation table is all ones and every block is its own restart interval,
so the DC prediction is 0 and the file decodes in parallel.  A comment segment
keeps the payload's length; the picture's last row is filled up with zeros.

Defined results: a null text is stored as an empty one (one block of zeros);
equal texts give equal files; progressive, arithmetic and lossless files, and
files that are cut off, raise JpegError in decode() and give null features in
describe().
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, prepare, table

BLOCK = 64
#: A row has this many blocks at most, unless the rows would exceed 65,535 samples.
ROW_BLOCKS = 64
MAX_SIDE = 8191
#: Blocks that are decoded at once: bounds the working memory.
STEP_BLOCKS = 1 << 15


class JpegError(ValueError):
    pass


# writing


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _huffman(kind: int, codes: dict[int, list[int]]) -> bytes:
    """A table from code length to symbols, both in canonical order."""
    return bytes([kind, *(len(codes.get(n, [])) for n in range(1, 17)), *(s for n in range(1, 17) for s in codes.get(n, []))])


#: One bit says "size 8", so a coefficient takes nine bits; AC also knows the end of a block.
HEAD = b"\xff\xd8" + _segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0")
TABLES = _segment(0xDB, b"\0" + b"\1" * BLOCK) + _segment(0xC4, _huffman(0x00, {1: [8]})) + _segment(0xC4, _huffman(0x10, {1: [8], 2: [0]}))
TAIL = _segment(0xDD, struct.pack(">H", 1)) + _segment(0xDA, b"\1\1\0\0\x3f\0")


def pad(data: bytes) -> bytes:
    """Bytes 0 up to a positive multiple of 64."""
    return data + bytes(-len(data) % BLOCK if data else BLOCK)


def encode(payload: bytes) -> bytes:
    """A grey baseline JPEG that holds payload, whose length divides by 64."""
    n = len(payload) // BLOCK
    down = min(-(-n // ROW_BLOCKS), MAX_SIDE)
    across = -(-n // down)
    blocks = np.frombuffer(payload + bytes((across * down - n) * BLOCK), np.uint8).reshape(-1, 8)
    # nine bits a byte: eight bytes become nine
    packed = np.zeros((len(blocks), 9), np.uint8)
    for k in range(8):
        packed[:, k] |= blocks[:, k] >> (k + 1)
        packed[:, k + 1] |= (blocks[:, k].astype(np.uint16) << (7 - k)).astype(np.uint8)
    rows = np.empty((across * down, 74), np.uint8)
    rows[:, :72] = packed.reshape(-1, 72)
    rows[:, 72] = 0xFF
    rows[:, 73] = 0xD0 + np.arange(across * down) % 8
    stuffed = np.nonzero(rows[:, :72] == 0xFF)
    flat = rows.reshape(-1)[:-2]
    if len(stuffed[0]):
        flat = np.insert(flat, stuffed[0] * 74 + stuffed[1] + 1, 0)
    frame = _segment(0xC0, struct.pack(">BHHB", 8, down * 8, across * 8, 1) + b"\1\x11\0")
    return b"".join((HEAD, _segment(0xFE, b"payload %d" % len(payload)), TABLES, frame, TAIL, flat.tobytes(), b"\xff\xd9"))


# reading


@dataclass
class Header:
    width: int = 0
    height: int = 0
    components: list[tuple[int, int, int, int]] = field(default_factory=list)  # id, across, down, quantisation table
    quant: dict[int, tuple[int, ...]] = field(default_factory=dict)
    huffman: dict[int, bytes] = field(default_factory=dict)
    scan: list[tuple[int, int, int]] = field(default_factory=list)  # component, DC table, AC table
    restart: int = 0
    comments: list[bytes] = field(default_factory=list)
    at: int = 0  # where the scan's data begin


def parse(data: bytes) -> Header:
    """The segments up to the scan."""
    if data[:2] != b"\xff\xd8":
        raise JpegError("no start of image")
    h, at = Header(), 2
    while True:
        if at + 4 > len(data) or data[at] != 0xFF:
            raise JpegError("marker expected")
        if (marker := data[at + 1]) == 0xFF:
            at += 1
            continue
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + size]
        if len(body) != size - 2:
            raise JpegError("cut off")
        at += 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                n = BLOCK << wide
                h.quant[body[0] & 15] = struct.unpack(f">{BLOCK}{'BH'[wide]}", body[1 : 1 + n])
                body = body[1 + n :]
        elif marker == 0xC4:
            while body:
                n = 17 + sum(body[1:17])
                h.huffman[body[0]] = body[1:n]
                body = body[n:]
        elif marker in (0xC0, 0xC1):
            if body[0] != 8:
                raise JpegError("not 8 bits a sample")
            h.height, h.width = struct.unpack(">HH", body[1:5])
            h.components = [(c[0], c[1] >> 4, c[1] & 15, c[2]) for c in (body[6 + 3 * i : 9 + 3 * i] for i in range(body[5]))]
        elif 0xC2 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
            raise JpegError("not baseline")
        elif marker == 0xDD:
            h.restart = int.from_bytes(body[:2], "big")
        elif marker == 0xFE:
            h.comments.append(body)
        elif marker == 0xDA:
            ids = [c[0] for c in h.components]
            for i in range(body[0]):
                c, t = body[1 + 2 * i], body[2 + 2 * i]
                if c not in ids:
                    raise JpegError("unknown component")
                h.scan.append((ids.index(c), t >> 4, 16 | t & 15))
            h.at = at
            if not h.width or not h.height:
                raise JpegError("no frame")
            return h


def lookup(table: bytes) -> tuple[np.ndarray, np.ndarray]:
    """For each 16 bits that may come next: the code's length (0: none) and its symbol."""
    length, symbol = np.zeros(1 << 16, np.uint8), np.zeros(1 << 16, np.uint8)
    code, at = 0, 16
    for n in range(1, 17):
        for _ in range(table[n - 1]):
            span = 1 << (16 - n)
            length[code * span : (code + 1) * span] = n
            symbol[code * span : (code + 1) * span] = table[at]
            code += 1
            at += 1
        code <<= 1
    return length, symbol


def intervals(data: bytes, at: int) -> tuple[np.ndarray, np.ndarray]:
    """The scan's bytes without stuffing and markers, and where each restart interval begins."""
    end = at
    for m in re.finditer(rb"\xff[^\x00\xd0-\xd7\xff]", data[at:] if at else data):
        end = at + m.start()
        break
    else:
        end = len(data)
    a = np.frombuffer(data, np.uint8)[at:end]
    ff = np.nonzero(a[:-1] == 0xFF)[0] if len(a) else np.zeros(0, np.int64)
    after = a[ff + 1] if len(ff) else a[:0]
    marks = ff[(after >= 0xD0) & (after <= 0xD7)]
    keep = np.ones(len(a), bool)
    keep[ff[after == 0] + 1] = False
    keep[marks] = keep[marks + 1] = False
    before = np.cumsum(keep)
    return a[keep], np.concatenate(([0], before[marks]))


class _Reader:
    """Reads codes at many bit positions at once."""

    def __init__(self, data: np.ndarray):
        d = np.concatenate((data, np.zeros(8, np.uint8))).astype(np.uint32)
        self.words = (d[:-3] << 24) | (d[1:-2] << 16) | (d[2:-1] << 8) | d[3:]
        self.last = (len(self.words) - 1) << 3

    def peek(self, pos: np.ndarray) -> np.ndarray:
        """32 bits from pos on, of which 25 are sure."""
        pos = np.minimum(pos, self.last)
        return self.words[pos >> 3] << (pos & 7).astype(np.uint32)


def _extend(bits: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The value that amplitude bits stand for."""
    v = bits.astype(np.int32)
    return np.where((size > 0) & (v < (1 << np.maximum(size, 1) - 1)), v - (1 << size) + 1, v)


def _block(reader: _Reader, pos: np.ndarray, dc: tuple, ac: tuple, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One block's coefficients (DC as a difference) at each position, in zigzag order."""
    n = len(pos)
    out = np.zeros((n, BLOCK), np.int16)
    pos = pos.copy()
    live, k, first = np.arange(n), np.zeros(n, np.int64), True
    while len(live):
        whole = len(live) == n
        p = pos if whole else pos[live]
        length, symbol = dc if first else ac
        x = reader.peek(p) >> 16
        used, s = length[x], symbol[x]
        if not used.all():
            raise JpegError("bad code")
        p = p + used
        size = (s & 15).astype(np.int32)
        run = np.zeros(len(s), np.int64) if first else (s >> 4).astype(np.int64)
        bits = (reader.peek(p).astype(np.uint64) >> (32 - size).astype(np.uint64)).astype(np.int32)
        value = _extend(bits, size)
        p = p + size
        at = k + run
        if (at >= BLOCK).any() and (at[(size > 0)] >= BLOCK).any():
            raise JpegError("too many coefficients")
        if size.all():
            out[live, at] = value
        else:
            some = size > 0
            out[live[some], at[some]] = value[some]
        at += 1
        if not first:
            at[(size == 0) & (run != 15)] = BLOCK  # end of block
        if whole:
            pos = p
        else:
            pos[live] = p
        if (pos > ends).any():
            raise JpegError("cut off")
        first = False
        if at.max() < BLOCK:
            k = at
        else:
            going = at < BLOCK
            live, k = live[going], at[going]
    return out, pos


def _sides(h: Header, n_scan: int) -> tuple[list[tuple[int, int]], int, int]:
    """Of each component in the scan the blocks of an MCU across and down; MCUs across and down."""
    most_h, most_v = max(c[1] for c in h.components), max(c[2] for c in h.components)
    if n_scan == 1:
        _, a, d, _ = h.components[h.scan[0][0]]
        return [(1, 1)], -(-h.width * a // (8 * most_h)), -(-h.height * d // (8 * most_v))
    return [h.components[c][1:3] for c, _, _ in h.scan], -(-h.width // (8 * most_h)), -(-h.height // (8 * most_v))


def decode_many(files: list[bytes]) -> list[tuple[Header, np.ndarray] | None]:
    """Of each file its header and the first component's coefficients.

    The coefficients come as (blocks down, blocks across, 64), in zigzag order.
    Files with the same tables are decoded together.  None: not decodable.
    """
    out: list[tuple[Header, np.ndarray] | None] = [None] * len(files)
    alike = defaultdict(list)
    for i, data in enumerate(files):
        try:
            h = parse(data)
            key = (tuple(sorted(h.huffman.items())), tuple(h.components), tuple(h.scan), h.restart)
            alike[key].append((i, h, *intervals(data, h.at)))
        except (JpegError, IndexError, struct.error, KeyError):
            continue
    for group in alike.values():
        part: list = []
        blocks = 0
        for x in group:
            if part and blocks + len(x[3]) > STEP_BLOCKS:
                _decode_alike(part, out)
                part, blocks = [], 0
            part.append(x)
            blocks += len(x[3])
        _decode_alike(part, out)
    return out


def _decode_alike(group: list, out: list) -> None:
    try:
        for (i, h, *_), c in zip(group, _coefficients(group), strict=True):
            out[i] = (h, c)
    except (JpegError, IndexError, KeyError, ValueError):
        if len(group) > 1:  # one of them is broken: each on its own
            for x in group:
                _decode_alike([x], out)


def _coefficients(group: list) -> list[np.ndarray]:
    head = group[0][1]
    tables = {k: lookup(v) for k, v in head.huffman.items()}
    sizes = [len(x[2]) for x in group]
    offset = np.concatenate(([0], np.cumsum(sizes)))
    reader = _Reader(np.concatenate([x[2] for x in group]))
    starts = np.concatenate([x[3] + o for x, o in zip(group, offset, strict=False)])
    ends = np.concatenate([np.append(x[3][1:], s) + o for x, s, o in zip(group, sizes, offset, strict=False)]) * 8
    counts = []
    for _, h, _, begins in group:
        per, across, down = _sides(h, len(h.scan))
        total = across * down
        each = h.restart or total
        if len(begins) != -(-total // each):
            raise JpegError("restart intervals are missing")
        counts.append(np.minimum(each, total - each * np.arange(len(begins))))
    owner = np.repeat(np.arange(len(group)), [len(x[3]) for x in group])
    mcus = np.concatenate(counts)
    per = _sides(head, len(head.scan))[0]
    luma = next(n for n, (c, _, _) in enumerate(head.scan) if c == 0)
    pos, live = starts * 8, np.arange(len(starts))
    pred = np.zeros((len(head.scan), len(starts)), np.int32)
    kept: list[np.ndarray] = []  # per MCU step: coefficients of the first component's blocks
    for step in range(int(mcus.max())):
        live = live[mcus[live] > step]
        got = []
        for n, (_, d, a) in enumerate(head.scan):
            for _ in range(per[n][0] * per[n][1]):
                c, moved = _block(reader, pos[live], tables[d], tables[a], ends[live])
                pos[live] = moved
                pred[n, live] += c[:, 0]
                c[:, 0] = pred[n, live]
                if n == luma:
                    got.append(c)
        kept.append((live, np.stack(got, 1)))
    result = []
    first = np.concatenate(([0], np.cumsum([len(x[3]) for x in group])))
    if len(kept) == 1:
        whole = kept[0][1]
        flat = [whole[first[g] : first[g + 1]] for g in range(len(group))]
    else:
        index = np.concatenate([x[0] for x in kept])
        step = np.concatenate([np.full(len(x[0]), s) for s, x in enumerate(kept)])
        order = np.lexsort((step, index))
        whole = np.concatenate([x[1] for x in kept])[order]
        owners = owner[index[order]]
        cut = np.searchsorted(owners, np.arange(len(group) + 1))
        flat = [whole[cut[g] : cut[g + 1]] for g in range(len(group))]
    for (_, h, _, _), c in zip(group, flat, strict=True):
        _, across, down = _sides(h, len(h.scan))
        a, d = per[luma]
        grid = c.reshape(down, across, d, a, BLOCK).transpose(0, 2, 1, 3, 4).reshape(down * d, across * a, BLOCK)
        result.append(grid)
    return result


def decode(data: bytes) -> tuple[Header, np.ndarray]:
    """One file's header and first component; JpegError where it is no baseline JPEG."""
    try:
        h = parse(data)
    except (IndexError, struct.error, KeyError) as e:
        raise JpegError(str(e)) from e
    if (got := decode_many([data])[0]) is None:
        raise JpegError(f"the scan of {h.width} x {h.height} can't be decoded")
    return got


def payload_of(h: Header, coefficients: np.ndarray) -> bytes:
    """What encode() stored."""
    n = next((int(m[1]) for c in h.comments if (m := re.fullmatch(rb"payload (\d+)", c))), None)
    if n is None:
        raise JpegError("holds no payload")
    flat = coefficients.reshape(-1)
    return np.where(flat < 0, flat + 255, flat).astype(np.uint8)[:n].tobytes()


def thumbnail(h: Header, coefficients: np.ndarray) -> np.ndarray:
    """Luminance from DC alone: one sample for each block of 8 x 8."""
    q = h.quant[h.components[0][3]][0]
    _, a, d, _ = h.components[0]
    most_h, most_v = max(c[1] for c in h.components), max(c[2] for c in h.components)
    down, across = -(-h.height * d // (8 * most_v)), -(-h.width * a // (8 * most_h))
    dc = coefficients[:down, :across, 0].astype(np.int32) * q
    return np.clip((dc + 4 >> 3) + 128, 0, 255).astype(np.uint8)


def difference_hash(thumb: np.ndarray) -> int:
    """64 bits: whether each of 8 x 8 sampled points is darker than its right neighbour."""
    rows = np.arange(8) * thumb.shape[0] // 8
    cols = np.arange(9) * thumb.shape[1] // 9
    at = thumb[np.ix_(rows, cols)]
    return int.from_bytes(np.packbits(at[:, :-1] < at[:, 1:]).tobytes(), "big")


# on DataFrames


def store(df: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media) for (doc_id, text): each text as a JPEG."""
    prepare(df.sparkSession)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw = [(t or "").encode() for t in batch.column(1).to_pylist()]
        return pa.record_batch([batch.column(0), pa.array([len(r) for r in raw], pa.int64()), pa.array([encode(pad(r)) for r in raw], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return map_batches(df.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), run, "doc_id bigint, n_bytes bigint, media binary")


DESCRIBED = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, width int, height int, thumbnail_hash bigint"


def describe(media: DataFrame) -> DataFrame:
    """Read each stored file back: its payload's digests, dimensions and thumbnail hashes."""
    prepare(media.sparkSession)
    names = [x.split()[0] for x in DESCRIBED.split(", ")]
    types = {"bigint": pa.int64(), "string": pa.string(), "int": pa.int32()}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        files = batch.column(2).to_pylist()
        rows = []
        for data, got in zip(files, decode_many([f or b"" for f in files]), strict=True):
            if got is None:
                rows.append((None, None, None, None if data is None else len(data), None if data is None else hashlib.sha256(data).hexdigest(), None, None, None, None))
                continue
            h, c = got
            payload, thumb = payload_of(h, c), thumbnail(h, c)
            look = difference_hash(thumb)
            exact = hashlib.blake2b(thumb.tobytes(), digest_size=8).hexdigest()
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(data), hashlib.sha256(data).hexdigest(), f"{h.width}x{h.height}:{look:016x}:{exact}", h.width, h.height, look - (look >> 63 << 64)))
        cols = list(zip(*rows, strict=True))
        return pa.record_batch([batch.column(0), batch.column(1), *(pa.array(c, types[x.split()[1]]) for c, x in zip(cols, DESCRIBED.split(", ")[2:], strict=True))], names=names)

    return map_batches(media.select("doc_id", "n_bytes", "media"), run, DESCRIBED)


def op7_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return describe(store(table(spark, sf_dir, "documents")))
