"""Each operator against brute force, an exact round trip or held-out accuracy, and on odd tables."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quarry.llm import bpe, chat, htmltext, jpeg, katz, langid, neardup, packing, pii, quality

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, kept string"
LEXICON = {"en": "the of and to in is that for house river", "de": "der die und von ist nicht haus fluss über"}


def sentence(r: random.Random, lang: str, n: int) -> str:
    return " ".join(r.choice(LEXICON[lang].split()) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    out = [(i, sentence(r, ("en", "de")[i % 3 == 0], r.randint(60, 120)), ("en", "de")[i % 3 == 0], f"s{i % 4}", 0, "x", "y") for i in range(60)]
    out += [(100, None, "en", None, None, None, None), (101, "", None, "s1", 0, "", ""), (None, "no id here", "en", "s1", 1, "", ""), (102, "12 34 !!", "en", "s2", 8, "", "")]
    return [*out, out[0], (103, out[1][1], "en", "s0", 0, "", "")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def test_katz_is_normalised_and_matches_brute_force(spark, docs, rows, nothing):
    from pyspark.sql import functions as F

    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    got = katz.Katz(docs, F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 2).scores().collect()
    assert len(got) == len(rows)
    uni, bi = Counter(), Counter()
    for i, t, *_ in rows:
        if not held(i):
            w = [*(t or "").encode().lower().split(), b""]
            uni.update(w)
            bi.update(zip([b" ", *w], w, strict=False))
    n, v = sum(uni.values()), len(uni)
    coc = lambda c: np.array([sum(x == r for x in c.values()) for r in range(1, katz.GT_MAX + 2)])
    d1, d2 = katz.discounts(coc(uni)), katz.discounts(coc(bi))
    cut = katz.GT_MAX + 1
    spared = sum(c * (1 - d1[min(c, cut)]) for c in uni.values())
    total, left = (n, spared) if spared > 0 else (n + 1, 1)
    p1 = lambda w: uni[w] * d1[min(uni[w], cut)] / total if uni[w] else left / total
    after: dict[bytes, list[bytes]] = {}
    for a, b in bi:
        after.setdefault(a, []).append(b)

    def p2(a: bytes, b: bytes) -> float:
        if a not in after:
            return p1(b)
        c = sum(bi[a, x] for x in after[a])
        spent = sum(bi[a, x] * d2[min(bi[a, x], cut)] for x in after[a])
        c += c - spent <= 0
        if bi[a, b]:
            return bi[a, b] * d2[min(bi[a, b], cut)] / c
        return (c - spent) / c / (1 - sum(p1(x) for x in after[a])) * p1(b)

    for a in [b" ", *after, b"never"]:  # all words, and the one that stands for every unseen word
        assert math.isclose(sum(p2(a, b) for b in [*uni, b"\xff"]), 1, abs_tol=1e-9)
    want = []
    for i, t, *_ in rows:
        w = [*(t or "").encode().lower().split(), b""]
        want.append((i, held(i), len(w), sum(uni[x] > 0 for x in w), n, round(sum(math.log10((uni[x] + 1) / (n + v + 1)) for x in w), 4), round(sum(math.log10(p2(a, b)) for a, b in zip([b" ", *w], w, strict=False)), 4)))
    assert sorted([(*r[:5], round(r[5], 4), round(r[6], 4)) for r in got], key=repr) == sorted(want, key=repr)
    assert katz.Katz(nothing, F.lit(False)).scores().count() == 0


def test_bpe_is_tiktoken(spark, docs, rows, nothing):
    import public_tokenizers
    import tiktoken

    c = bpe.Codec(bpe.default_path())
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=c.ranks, special_tokens={})
    r = random.Random(2)
    texts = ["", None, "  a  b ", "it's we'll 's", "x\n\n y", "\x1c a\x1d", "z" * 900, "ab" * 400, "日本語 १२", "<|endoftext|>", *("".join(r.choice(" \n\t'sabZé1!\xa0") for _ in range(80)) for _ in range(100))]
    # without blanks: random letters, words run together, runs of signs, other scripts; one of a MB
    known = [t.decode() for t in list(c.ranks)[300:5000] if t.isalpha()]
    texts += ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(250)) for _ in range(200)]
    texts += ["".join(r.choice(known) for _ in range(5000)), "-" * 30_000, "=-" * 10_001, "abc" * 7000, "".join(chr(r.randint(0x4E00, 0x9000)) for _ in range(350_000))]
    ids, counts = c.encode(pa.array(texts, pa.string()))
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [enc.encode_ordinary(t or "") for t in texts]
    got = bpe.decode(bpe.encode(docs)).collect()
    assert sorted((g.doc_id is None, g.doc_id or 0, bytes(g.decoded)) for g in got) == sorted((i is None, i or 0, (t or "").encode()) for i, t, *_ in rows)
    assert bpe.decode(bpe.encode(nothing)).count() == 0
    clash = spark.createDataFrame([(1, [100, 200], "x", "y")], "doc_id bigint, ids array<int>, decoded string, `a b` string")
    assert [x.asDict() for x in bpe.decode(clash).collect()] == [{"doc_id": 1, "ids": [100, 200], "a b": "y", "decoded": b"".join(t for n in (100, 200) for t, k in c.ranks.items() if k == n)}]
    ids = spark.createDataFrame([([99_999_999],)], "ids array<int>")
    with pytest.raises(Exception, match="not in the vocabulary"):
        bpe.decode(ids).collect()


def test_html():
    trees = htmltext.model()
    right = 0
    for seed in range(50_000, 50_060):  # seeds that the model was not fitted on
        nodes, y = htmltext.generated(seed)
        want = htmltext.render(nodes, [i == 0 or bool(v) for i, v in enumerate(y)])
        odds = trees.log_odds(htmltext.features(nodes))
        kept = htmltext.decode(nodes, odds)
        assert all(kept[x.parent.n] for x in nodes if x.parent is not None and kept[x.n])
        right += htmltext.render(nodes, kept) == want
    assert right >= 55
    page = "<nav><a href=/>Home</a></nav><article><h1>A&amp;B</h1><p>One  <b>two</b>three.<br>Four<p>Five six seven, and so on.<script>no</script></article><div class='cookie-notice'>We use cookies.</div><section id=comments><p>First! What a fine text.</p></section><footer>&copy; x</footer>"
    assert htmltext.extract([page, None, "", "<div>" * 3000 + "x"], trees)[:3] == ["A&B One twothree. Four Five six seven, and so on.", "", ""]


@pytest.mark.parametrize("before", [
    "<form><select><option>A<option>B</select></form>", "<select><optgroup label=x><option>A<optgroup label=y><option>B<option>C</select>", "<datalist><option>A<option>B</datalist>", "<select><option>A<select>", "<div><option>A</div>",
    "<head><title>x</title><body>", "<head><meta charset=utf-8><title>x</title>", "<head><title>x</title><noscript><img src=x><body>", "<button>A<svg><path></button>", "<head><title>x</title></head><body>", "<select><option>A</option></select>",
])
def test_html_silent_elements_without_end_tags(before):
    article = "<article><h1>T</h1><p>Some text, in a sentence.</p></article>"
    nodes = htmltext.build(before + article)
    own = [x for x in nodes if x.tag == "article"]
    assert len(own) == 1 and [y.tag for y in own[0].children] == ["h1", "p"]
    assert htmltext.render(nodes, [True] * len(nodes)) == "T Some text, in a sentence."


def test_html_text_ends_a_head():
    nodes = htmltext.build("<head><title>x</title> Some text.<p>More.")
    assert htmltext.render(nodes, [True] * len(nodes)) == "Some text. More."


def test_html_on_pages_written_by_hand():
    """Expected texts are written out here; nothing of the module makes them."""
    words = "The river rose in the night, and by morning the lower fields were under water."
    cases = [
        (f"<html><head><title>t</title><body><nav><ul><li><a href=/>Home</a><li><a href=/x>News</a></ul></nav><article><h1>Flood</h1><p>{words}<p>{words}</article><footer>Imprint</footer>", f"Flood {words} {words}"),
        (f"<body><header><a href=/>Logo</a></header><main><article><h2>A &lt; B</h2><p>{words}</p><ul><li>One point, made.<li>Another point, made.</ul><table><tr><td>12<td>13</table></article><aside><a href=/a>More</a></aside></main>", f"A < B {words} One point, made. Another point, made. 12 13"),
        (f"<article><h1>Sum</h1><p>{words} Let <math><mi>x</mi> <mo>=</mo> <mn>1</mn></math> be so.</p><noscript><p>{words}</p></noscript><script>var a = '<p>no</p>';</script><style>p {{}}</style></article>", f"Sum {words} Let x = 1 be so. {words}"),
        (f"<div class=page><div class='cookie-notice'>We use cookies, as all do.</div><article><p>{words}</p><div class=advert>Buy now!</div><p>{words}</p></article><section class=comments><p>First! {words}</p></section></div>", f"{words} {words}"),
        (f"<form><select><option>a<option>b</select></form><article><h1>T</h1><p>{words}<br>{words}</article>", f"T {words} {words}"),
    ]
    assert htmltext.extract([h for h, _ in cases], htmltext.model()) == [w for _, w in cases]
    assert htmltext.extract([f"<article><p>{words}" + f" {words}" * 20_000 + "</article>"], htmltext.model()) == [" ".join([words] * 20_001)]


def test_html_frame(spark):
    df = spark.createDataFrame([(1, "u", "<article><h1>T</h1><p>Some text, in a sentence.</p></article>"), (None, None, None), (1, "u", "")], "page_id bigint, url string, html string")
    assert sorted((r.text, r.n_chars) for r in htmltext.extract_text(df).collect()) == [("", 0), ("", 0), ("T Some text, in a sentence.", 27)]
    assert htmltext.extract_text(df.limit(0)).count() == 0
    clash = df.selectExpr("*", "1 AS text", "2 AS n_chars", "3 AS h")
    assert sorted(r.n_chars for r in htmltext.extract_text(clash).collect()) == [0, 0, 27]


def test_quality(spark, docs, rows, nothing):
    assert quality.base_counts("a b c a b c\n\na b c\n x") == (10, 10, 0, 0, 9, True)
    assert quality.base_counts("l m\n l\nl m\nl m")[3] == 2 and quality.base_counts("#a $%")[2] == 3 and quality.base_counts(None) == (0, 0, 0, 0, 0, True)
    r = random.Random(1)
    for _ in range(50):
        w = [r.choice("abc") for _ in range(r.randint(0, 30))]
        windows = Counter(zip(w, w[1:], w[2:]))
        covered = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        assert quality.repeated_words([x.encode() for x in w]) == len(covered)
    p, q = np.array([0.5, 0.5, 0]), np.array([[0.5, 0.5, 0], [0, 0, 1.0]])
    assert quality.distances(p, q) == pytest.approx([0, 1])
    junk = [(200 + i, " ".join(f"{sentence(r, 'en', 1)}###" for _ in range(40)) + " x1 $$$ %%% &&&" * 20, "en", "s", 0, "", "") for i in range(3)]
    got = {x.doc_id: x for x in quality.assess(spark.createDataFrame([*rows, *junk], DOCS)).collect()}
    assert not any(got[j[0]].kept for j in junk) and not got[100].kept and got[101].n_words == 0
    assert quality.assess(nothing).count() == 0 and quality.keep_good(nothing).columns == docs.columns
    no_lang = docs.withColumn("lang", docs.lang.substr(9, 1)).replace("", None, "lang")
    assert quality.references(no_lang).langs == ["und"]


def test_language(spark, docs, nothing):
    model = langid.train(docs.filter(~langid.held_out()))
    got = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    assert all(got[i].lang_pred == ("en", "de")[i % 3 == 0] and got[i].score > 0.9 for i in range(60))
    assert got[100].lang_pred == got[101].lang_pred == got[102].lang_pred == "und" and got[100].score == 0
    assert langid.predict(docs, langid.train(nothing)).filter("lang_pred <> 'und'").count() == 0


def test_forward_sums_all_segmentations():
    p = langid.pieces(langid.default_path())
    r = np.random.default_rng(0)
    prob = r.random((len(p.names), 2))
    prob /= prob.sum(0)
    number = {n: i for i, n in enumerate(p.names)}

    def brute(w: str) -> np.ndarray:
        if not w:
            return np.ones(2)
        out = np.zeros(2)
        for j in range(1, len(w) + 1):
            if w[:j] in number:
                out += prob[number[w[:j]]] * brute(w[j:])
            elif j == 1:
                out += langid.UNKNOWN * brute(w[1:])
        return out

    words = ["the", "house", "ж", "überaus", "a", "segmentation"]
    assert langid.forward(p, words, prob) == pytest.approx(np.log10([brute(langid.MARK + w) for w in words]), abs=1e-9)


def test_best_fit_against_brute_force(spark, docs, nothing):
    r = random.Random(7)
    for _ in range(20):
        items = sorted(((r.randint(1, 60), r.choice(["a", "b", "c", None]), r.choice(["x", "y", "z", "w", None])) for _ in range(120)), key=lambda x: -x[0])
        bins: list[list] = []
        want = []
        for n, s, c in items:
            fits = [(b[0], k) for k, b in enumerate(bins) if b[0] >= n and not (s and s in b[1]) and not (c and c in b[2])]
            k = min(fits)[1] if fits else len(bins)
            if not fits:
                bins.append([100, set(), set()])
            bins[k][0] -= n
            bins[k][1].add(s)
            bins[k][2].add(c)
            want.append(k)
        got = packing.best_fit(np.array([x[0] for x in items]), [x[1] for x in items], [x[2] for x in items], 100)
        assert got.tolist() == want
    packed = packing.pack(packing.measure(docs), capacity=100).collect()
    size, held = Counter(), {}
    for p in packed:
        size[p.bin_id] += p.n_tokens
        held.setdefault(p.bin_id, []).append((p.source, p.cluster))
    assert max(size.values()) <= 100 and sum(size.values()) == packing.measure(docs).groupBy().sum("n_tokens").first()[0]
    for h in held.values():
        for k in (0, 1):
            known = [x[k] for x in h if x[k] is not None]
            assert len(known) == len(set(known))
    assert packing.pack(packing.measure(nothing)).count() == 0


def test_jpeg_round_trip(spark, docs, rows, nothing):
    r = np.random.default_rng(1)
    for n in (0, 1, 64, 65, 4097, 300_000):
        p = jpeg.pad(r.integers(0, 256, n, dtype=np.uint8).tobytes())
        h, c = jpeg.decode(jpeg.encode(p))
        assert jpeg.payload_of(h, c) == p and len(p) % 64 == 0 and p
    got = jpeg.describe(jpeg.store(docs)).collect()
    want = sorted((hashlib.sha256(jpeg.pad((t or "").encode())).hexdigest(), len((t or "").encode())) for _, t, *_ in rows)
    assert sorted((g.payload_sha256, g.n_bytes) for g in got) == want
    assert jpeg.describe(jpeg.store(nothing)).count() == 0
    bad = jpeg.encode(jpeg.pad(b"abc"))
    assert jpeg.decode_many([bad[:80], b"", bad[:-30]]) == [None, None, None]


def test_jpeg_reads_any_baseline_scan():
    """Two components with subsampling, standard-like codes, no restarts: built here bit by bit."""
    codes = {0: "00", 1: "01", 2: "10", 3: "110"}  # DC sizes
    ac = {0x00: "00", 0x01: "01", 0x02: "100", 0xF0: "101", 0x11: "110"}
    dht = lambda kind, t: jpeg._segment(0xC4, jpeg._huffman(kind, {n: [s for s, c in t.items() if len(c) == n] for n in range(1, 9)}))
    amp = lambda v: "" if not v else format(v if v > 0 else v + (1 << abs(v).bit_length()) - 1, f"0{abs(v).bit_length()}b")
    blocks, bits, pred = [], "", [0, 0]
    r = random.Random(4)
    for _ in range(2):  # MCUs: 2 x 1 luminance, 1 other
        for comp in (0, 0, 1):
            dc, a1, a18 = r.randint(-3, 3), r.choice([-1, 1, 2, 3]), r.choice([-1, 1])
            d = dc - pred[comp]
            if abs(d).bit_length() > 3:
                d = 0
            pred[comp] += d
            bits += codes[abs(d).bit_length()] + amp(d) + ac[abs(a1).bit_length()] + amp(a1) + ac[0xF0] + ac[0x01] + amp(a18) + ac[0x00]
            if comp == 0:
                c = np.zeros(64, int)
                c[0], c[1], c[18] = pred[0], a1, a18
                blocks.append(c)
    bits += "1" * (-len(bits) % 8)
    scan = int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00")
    import struct

    frame = jpeg._segment(0xC0, struct.pack(">BHHB", 8, 8, 32, 2) + b"\1\x21\0\2\x11\0")
    data = b"\xff\xd8" + jpeg._segment(0xDB, b"\0" + b"\x10" * 64) + dht(0, codes) + dht(0x10, ac) + frame + jpeg._segment(0xDA, b"\2\1\0\2\0\0\x3f\0") + scan + b"\xff\xd9"
    h, got = jpeg.decode(data)
    assert (h.width, h.height, got.shape) == (32, 8, (1, 4, 64)) and np.array_equal(got[0], np.array(blocks))
    assert jpeg.thumbnail(h, got).tolist() == [[(int(c[0]) * 16 + 4 >> 3) + 128 for c in blocks]]


def test_chat(spark):
    turns = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "a"), (3, 0, "user", "a"), (3, 5, "assistant", "b"), (3, 9, None, None), (4, 0, "user", "a"), (4, 1, "assistant", ""), (5, 0, "user", "a"), (None, 0, "user", "z"), (6, 0, "user", "q"), (7, 0, "user", "q")]
    df = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string")
    got = {r.conv_id: r for r in chat.render(chat.collapse(df)).collect()}
    assert set(got) == {3, 4, None, 6, 7} and got[3].n_turns == 3
    assert got[4].rendered == "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    assert chat.render(chat.collapse(df.limit(0))).count() == 0


def test_pii(spark, docs, nothing):
    text = "mail Jo.e+x@a-b.example.org, 300.1.1.1 10.0.0.255 by 4539 1488 0343 6467 and +1 (171) 555-2028; call 555-2028, 555-2028 plain. IBAN GB82 WEST 1234 5698 7654 32 bad GB83 WEST 1234 5698 7654 32"
    base, spans = pii.find(text)
    assert [text[a:b] for a, b, _ in base] == ["Jo.e+x@a-b.example.org", "10.0.0.255", "4539 1488 0343 6467", "+1 (171) 555-2028"]
    assert set(base) <= set(spans) and [text[a:b] for a, b, k in spans if k == "iban"] == ["GB82 WEST 1234 5698 7654 32"]
    assert pii.luhn("4539148803436467") and not pii.luhn("4539148803436468") and pii.mod97("GB82WEST12345698765432")
    r = random.Random(9)
    for _ in range(3000):  # the jumping search is the plain one
        s = "".join(r.choice("ab.@-_ 1") for _ in range(25))
        assert pii.emails(s) == [m.span() for m in pii.EMAIL.finditer(s)]
    sign = r"24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
    assert [k for *_, k in pii.find(f'token = "{sign}"')[1]] == ["secret"] and not pii.find(f"commit {sign}")[1] and not pii.find(f"token {'a' * 40}")[1]
    assert pii.mask("x a@b.c y") == "x [EMAIL] y" and pii.mask(None) is None
    assert pii.report(docs).count() == docs.count() and pii.report(nothing).count() == 0
    assert pii.redact(docs).columns == docs.columns


def test_pii_base_spans_against_the_plain_patterns(spark):
    import re

    ok = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(d := re.sub(r"\D", "", m)) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(re.sub(r"\D", "", m)) <= 15),
    }
    r = random.Random(4)
    bits = ["+", "1", "0", "22", "255", "256", ".", ".", " ", "-", "@", "a", "b.c", "(", ")", "4539148803436467", "é", "9" * 16, "0" * 4400]
    texts = ["".join(r.choice(bits[: 18 + (k % 50 == 0)]) for _ in range(r.randint(0, 60))) for k in range(4000)]
    texts += ["0" * 5000 + ".1.1.1", "1" * 5000 + ".1.1.1", None, ""]
    want = []
    for t in texts:
        spans = []
        for n, (kind, (pattern, check)) in enumerate(ok.items()):
            spans += [(m.start(), n, m.end(), kind) for m in re.finditer(pattern, t or "") if check(m[0])]
        spans.sort()
        line = ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)
        counts = Counter(k for *_, k in spans)
        want.append((*(counts[k] for k in ok), hashlib.sha256(line.encode()).hexdigest()))
    got = pii.report(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).orderBy("doc_id").collect()
    assert [tuple(g[1:6]) for g in got] == want
    long = "7" * 2_000_000 + " " + "1.2." * 200_000 + "@" + "x" * 1_000_000 + "+1(" * 200_000
    assert pii.find(long)[0] is not None  # in seconds


def test_near_duplicates_against_brute_force(spark, nothing):
    r = random.Random(11)
    words = [f"w{i}" for i in range(3000)]
    base = [[r.choice(words) for _ in range(r.randint(5, 120))] for _ in range(25)]
    texts: list = [None, "", " ", "one", "ONE", "one two", *(" ".join(b) for b in base)]
    for b in base * 4:
        c = list(b)
        for _ in range(r.randint(0, max(1, len(c) // 40))):
            c[r.randrange(len(c))] = r.choice(words)
        texts.append(" ".join(c))
    rows = [*enumerate(texts), (None, texts[8]), (8, texts[8])]
    got = neardup.classes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    sets = [set(neardup.strips(neardup.words_of(t)).tolist()) for t in texts]
    root = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and len(a & sets[j]) / len(a | sets[j]) >= 0.8:
                x, y = sorted((root[i], root[j]))
                root = [x if z == y else z for z in root]
    assert len(got) == len(rows)
    assert {(g.doc_id, g.class_id) for g in got} == {(i, root[i]) for i in range(len(texts))} | {(None, None)}
    assert neardup.classes(nothing).count() == 0
    kept = neardup.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert {k.doc_id for k in kept.collect()} == {*root, None}


def test_strips_are_the_shingle_counts_whether_a_text_repeats_or_not(spark):
    r = random.Random(8)
    runs = lambda t: Counter(tuple(t[i : i + neardup.SHINGLE]) for i in range(len(t) - neardup.SHINGLE + 1))
    texts = []
    for k in range(20):  # each with a copy that repeats the opening or a passage; the first has no repeat
        own = [b"w%d" % n for n in r.sample(range(10**6), 150)]
        at = 0 if k % 2 else r.randrange(100)
        texts += [own, own + own[at : at + 5 + k % 4]]
    for a, b in zip(texts[::2], texts[1::2], strict=True):
        assert max(runs(a).values()) == 1 and max(runs(b).values()) == 2
    for a in texts:
        for b in texts:
            s, t, x, y = set(neardup.strips(a).tolist()), set(neardup.strips(b).tolist()), runs(a), runs(b)
            assert (len(s & t), len(s | t)) == ((x & y).total(), (x | y).total())
    rows = spark.createDataFrame([(i, b" ".join(t).decode()) for i, t in enumerate(texts)], "doc_id bigint, text string")
    assert {x.doc_id: x.class_id for x in neardup.classes(rows).collect()} == {i: i // 2 * 2 for i in range(len(texts))}


def test_signatures_agree_as_often_as_sets_do():
    r = np.random.default_rng(3)
    a = r.integers(0, 2**63, 400).astype(np.uint64)
    b = np.concatenate((a[:300], r.integers(0, 2**63, 100).astype(np.uint64)))
    s = neardup.signatures([np.sort(a), np.sort(b), a[:1]], 2000)
    assert abs((s[0] == s[1]).mean() - 300 / 500) < 0.05


def test_links_within_a_bucket():
    r = random.Random(5)
    for _ in range(30):
        base = [r.randrange(10_000) for _ in range(40)]
        sets = [np.array(sorted({*(x for x in base if r.random() > 0.12), *(r.randrange(10_000, 20_000) for _ in range(r.randint(0, 6)))}), np.uint32) for _ in range(25)]
        found = neardup.link(np.arange(25), sets)
        root, want = list(range(25)), list(range(25))
        for i, j in found:
            x, y = sorted((root[i], root[j]))
            root = [x if z == y else z for z in root]
        for i in range(25):
            for j in range(i):
                a, b = set(sets[i].tolist()), set(sets[j].tolist())
                if len(a & b) / len(a | b) >= 0.8:
                    x, y = sorted((want[i], want[j]))
                    want = [x if z == y else z for z in want]
        assert root == want and len(found) < 25
