"""Personal data: patterns propose spans, checksums confirm, context scores.

Four base kinds are always reported as found by their pattern and their check
(email, ip, card by Luhn, phone by its digit count).  Four further kinds are
reported only where their score, raised by context words near the span, reaches
a threshold: iban (confirmed by mod-97), card13 (13 digits passing Luhn),
localphone (a number without country code) and secret (a long run of letters and
digits of high entropy, such as a key or a token).  Matching is leftmost and
non-overlapping within a kind; a match that fails its check is dropped and not
tried again in part.  A span of a further kind that overlaps a base one goes.

Defined results: a null or empty text has no spans; positions are code points,
end exclusive; spans at one place are in the order of KINDS; repeated rows give
repeated results; null ids are kept; an empty table gives an empty one; report()
and detect() read two columns and ignore the others, redact() takes over all.  The
time is in proportion to a text's length, whatever it holds (runs of digits too).
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, prepare, table

KINDS = ("email", "ip", "card", "phone", "iban", "card13", "localphone", "secret")
BASE = KINDS[:4]
#: What a kind scores by its pattern and its checksum alone; context adds CONTEXT_BONUS.
PRIOR = {"email": 0.9, "ip": 0.8, "card": 0.9, "phone": 0.8, "iban": 0.9, "card13": 0.45, "localphone": 0.3, "secret": 0.45}
CONTEXT_BONUS = 0.4
THRESHOLD = 0.7
CONTEXT_CHARS = 40
CONTEXT = {
    "email": ("mail", "contact", "write"),
    "ip": ("ip", "host", "server", "address", "login"),
    "card": ("card", "visa", "credit", "payment", "karte", "carte", "tarjeta"),
    "phone": ("phone", "call", "tel", "mobile", "fax", "telefon"),
    "iban": ("iban", "bank", "account", "konto", "compte", "cuenta"),
    "card13": ("card", "visa", "credit", "payment", "karte", "carte", "tarjeta"),
    "localphone": ("phone", "call", "tel", "mobile", "fax", "telefon"),
    "secret": ("token", "secret", "key", "apikey", "password", "passwd", "pwd", "bearer", "credentials"),
}

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: As `[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)`: a match begins where its run of digits does.
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
LOCAL_PHONE = re.compile(r"(?<![\w+.-])(?:\([0-9]{2,4}\)\x20?)?[0-9]{3,4}[ -][0-9]{3,4}(?:[ -][0-9]{2,4})?(?![\w-])")
SECRET = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}(?![=])")
WORD = re.compile(r"[^\W\d_]+")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        if i % 2:
            n *= 2
            n -= 9 * (n > 9)
        total += n
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """ISO 13616: the first four signs go last, letters count 10 to 35."""
    code = iban.replace(" ", "")
    if not 15 <= len(code) <= 34:
        return False
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def random_looking(s: str) -> bool:
    """Letters and digits, in a mix of 3 bits a sign or more."""
    s = s.rstrip("=")
    if s.isalpha() or s.isdigit() or not (any(map(str.isdigit, s)) and any(map(str.isalpha, s))):
        return False
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values()) >= 3


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """EMAIL's leftmost matches, tried only where an @ stands.

    A match holds exactly one @, and begins where the run of allowed signs
    before it begins (or where the last match ended), so the search may jump.
    """
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > end and text[begin - 1] in LOCAL_CHARS:
            begin -= 1
        if begin < at and (m := EMAIL.match(text, begin)):
            out.append(m.span())
            end = m.end()
        at = text.find("@", max(at + 1, end))
    return out


def base_spans(text: str) -> list[tuple[int, int, str]]:
    found = [(a, b, "email") for a, b in emails(text)]
    for m in IP.finditer(text):
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in (p.lstrip("0") for p in m[0].split("."))):
            found.append((*m.span(), "ip"))
    for m in CARD.finditer(text):
        if 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            found.append((*m.span(), "card"))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= len(_digits(m[0])) <= 15:
                found.append((*m.span(), "phone"))
    return found


def more_spans(text: str) -> list[tuple[int, int, str]]:
    """Proposals of the further kinds that pass their checksum."""
    found = [(*m.span(), "iban") for m in IBAN.finditer(text) if mod97(m[0])]
    for m in CARD.finditer(text):
        if len(d := _digits(m[0])) == 13 and luhn(d):
            found.append((*m.span(), "card13"))
    found += [(*m.span(), "localphone") for m in LOCAL_PHONE.finditer(text)]
    found += [(*m.span(), "secret") for m in SECRET.finditer(text) if random_looking(m[0])]
    return found


def score(text: str, start: int, end: int, kind: str) -> float:
    near = f"{text[max(0, start - CONTEXT_CHARS) : start]} {text[end : end + CONTEXT_CHARS]}".lower()
    hit = not set(WORD.findall(near)).isdisjoint(CONTEXT[kind])
    return min(1.0, PRIOR[kind] + CONTEXT_BONUS * hit)


def find(text: str | None) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans, and all spans, each by start, then kind as listed."""
    if not text:
        return [], []
    base = sorted(base_spans(text), key=lambda s: (s[0], KINDS.index(s[2])))
    more = more_spans(text)
    if not more:
        return base, base
    begins, reach = [a for a, _, _ in base], list(accumulate((b for _, b, _ in base), max))
    free = lambda a, b: not (i := bisect_left(begins, b)) or reach[i - 1] <= a
    kept = [s for s in more if free(*s[:2]) and score(text, *s) >= THRESHOLD]
    return base, sorted(base + kept, key=lambda s: (s[0], KINDS.index(s[2])))


def as_string(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def mask(text: str | None) -> str | None:
    """Replace each span by its kind in brackets; overlapping spans become one."""
    if not text or not (spans := find(text)[1]):
        return text
    out, at = [], 0
    for a, b, kind in spans:
        if a < at:
            if b > at:
                at = b
            continue
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


SPANS = "doc_id bigint, base array<struct<start:int,end:int,kind:string>>, spans array<struct<start:int,end:int,kind:string,score:double>>"


def detect(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, spans): the spans of each text with their scores."""
    prepare(df.sparkSession)
    kind = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())])
    scored = pa.struct([*kind, ("score", pa.float64())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        base, spans = [], []
        for text in batch.column(1).to_pylist():
            b, s = find(text)
            base.append([dict(zip(("start", "end", "kind"), x, strict=True)) for x in b])
            spans.append([{"start": x[0], "end": x[1], "kind": x[2], "score": score(text, *x)} for x in s])
        return pa.record_batch([batch.column(0), pa.array(base, pa.list_(kind)), pa.array(spans, pa.list_(scored))], names=["doc_id", "base", "spans"])

    return map_batches(df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")), run, SPANS)


def redact(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with each text's spans replaced by their kinds; all columns stay."""
    prepare(df.sparkSession)
    at = df.columns.index(text_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        masked = pa.array([mask(t) for t in batch.column(at).to_pylist()], batch.schema.field(at).type)
        return pa.record_batch([masked if i == at else c for i, c in enumerate(batch.columns)], schema=batch.schema)

    return map_batches(df, run, df.schema)


RESULT = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_spans bigint"


def report(df: DataFrame) -> DataFrame:
    """The digest of detect(): counts by base kind, a hash, and all spans as text."""
    found = detect(df)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{k}")
    line = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", *map(count, BASE), F.sha2(line("base"), 256).alias("base_sha256"), line("spans").alias("spans"), F.size("spans").cast("bigint").alias("n_spans"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents").select("doc_id", "text"))
