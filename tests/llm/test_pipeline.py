"""The pipeline on a small folder, against brute force over the same rows."""

import random

import corpus_pipeline
from quarry.llm import langid, neardup, pii, quality


def test_pipeline(spark, tmp_path):
    r = random.Random(3)
    # enough words that texts share few runs of five
    common, rare = "the of and to in is that for".split(), [f"{a}{b}{c}" for a in ("ther", "ing", "ou") for b in ("na", "re", "st", "ble") for c in ("nd", "ea", "ly", "sh")]
    text = lambda n: " ".join(r.choice(common) if r.random() < 0.5 else r.choice(rare) for _ in range(n))
    rows = [(i, text(r.randint(80, 200)), "en", f"s{i % 5}", 0) for i in range(80)]
    rows += [(100, rows[3][1], "en", "s1", 0), (101, rows[4][1] + " mail a.b@c.example.com", "en", "s1", 0), (102, "short", "en", "s", 0), (103, None, None, None, None), (104, ("again and again " * 60), "en", "s", 0)]
    rows.append((105, " ".join(x + "###$$$" for x in text(90).split()), "en", "s2", 0))
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / f"stage{len(seen)}"))
        docs = spark.read.parquet(str(tmp_path / f"stage{len(seen)}"))
        seen.append(docs)
    refs = quality.references(spark.read.parquet(str(tmp_path / "documents.parquet")))
    good = {i for i, t, *_ in rows if quality.verdict(t, refs)[6]}
    assert {x.doc_id for x in seen[0].collect()} == good and good == {*range(80), 100, 101}
    model = langid.train(seen[0].filter(~langid.held_out()))
    assert {x.doc_id for x in seen[1].collect()} == {i for i in good if model.predict([dict((x[0], x[1]) for x in rows)[i]])[0][1] >= langid.MIN_SCORE}
    sets = {i: set(neardup.strips(neardup.words_of(t)).tolist()) for i, t, *_ in rows if i in good}
    copies = {i for i in good for j in good if j < i and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8}
    assert copies == {100, 101} and {x.doc_id for x in seen[2].collect()} == good - copies
    assert {(x.doc_id, x.text) for x in seen[3].collect()} == {(i, pii.mask(t)) for i, t, *_ in rows if i in good - copies}
    assert all(s.columns == ["doc_id", "text", "lang", "source", "n_chars"] for s in seen[:4])
    assert {x.doc_id for x in seen[4].collect()} == good - copies
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == seen[4].count()
