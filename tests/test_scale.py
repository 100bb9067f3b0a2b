"""Plans and work that must not change with the size of the tables."""

import random

from quarry.operators import dups, keywords


def stored(spark, tmp_path, rows, schema):
    """rows as a file, since Spark guesses sizes from files."""
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/t.parquet")
    return spark.read.parquet(f"{tmp_path}/t.parquet")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_near_clusters_send_no_table_to_the_driver(spark, tmp_path):
    prints = stored(spark, tmp_path, [(i, (i % 50) << 40 ^ 1 << i % 7) for i in range(400)], "id bigint, simhash bigint")
    steps = []
    merged = dups.merged
    dups.merged = lambda *a, **k: steps.append(merged(*a, **k)) or steps[-1]
    try:
        got = dups.near_clusters(prints)
    finally:
        dups.merged = merged
    assert len(steps) > 6 and not [s for s in [*steps, got] if "Broadcast" in plan(s)]
    assert got.count() == 400


def test_near_pairs_meet_once_without_a_broadcast(spark, tmp_path):
    r = random.Random(5)
    base = [r.getrandbits(64) - (1 << 63) for _ in range(12)]
    bit = lambda p: (1 << p) - (1 << 64 if p == 63 else 0)
    rows = [(i, b ^ sum(bit(p) for p in r.sample(range(64), r.choice([0, 1, 1, 2, 5, 9])))) for i, b in enumerate(base * 6)]
    prints = stored(spark, tmp_path, rows, "id bigint, simhash bigint")
    for distance in (0, 2, 8):
        pairs = dups.near_pairs(prints, distance)
        assert "Broadcast" not in plan(pairs)
        want = sorted((a, b, ((x ^ y) & (1 << 64) - 1).bit_count()) for a, x in rows for b, y in rows if a < b and ((x ^ y) & (1 << 64) - 1).bit_count() <= distance)
        assert sorted((p.a, p.b, p.distance) for p in pairs.collect()) == want


def test_page_tokens_are_dealt_by_the_number_of_pages(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(keywords, "SHARE", 10)
    rows = [(f"https://s.com/{i % 95}/red-bolts", "Red bolt", f"B {i} red") for i in range(100)]
    pages = stored(spark, tmp_path, rows, "url string, title string, h1 string").coalesce(1)
    on = keywords.page_tokens(pages, 100)
    assert on.rdd.getNumPartitions() == 11
    got = {(t.url, t.token): t.weight for t in on.collect()}
    want = {(u, t): 3 for u, *_ in rows for t in ("red", "bolt")} | {(u, u.split("/")[3]): 3 for u, *_ in rows if len(u.split("/")[3]) > 1}
    assert got == {**{(u, h.split()[1]): 2 for u, _, h in rows if len(h.split()[1]) > 1}, **want}


def test_scores_are_dealt_by_what_meets(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    r = random.Random(6)
    words = "amber bolt cork dune elm fern".split()
    rows = [(f"https://s.com/{i}/{r.choice(words)}-{r.choice(words)}", r.choice(words), "bolt") for i in range(200)]
    asked = [(f"{a} {b}", 1) for a in words for b in [*words, "unseen"]]
    pages, k = stored(spark, tmp_path / "p", rows, "url string, title string, h1 string"), stored(spark, tmp_path / "k", asked, "normalized string, volume_mid bigint")
    want = {(x.normalized, x.url): x.score for x in keywords.scores(k, pages).collect()}
    assert len(want) > 2000 and all(score > 0 for score in want.values())
    monkeypatch.setattr(keywords, "SHARE", 10)
    got = keywords.scores(k, pages).cache()
    assert {(x.normalized, x.url): x.score for x in got.collect()} == want and got.count() == len(want)
    per_task = [x[0] for x in got.groupBy(F.spark_partition_id()).agg(F.count("*")).select("count(1)").collect()]
    assert len(per_task) > 40 and max(per_task) < 150


def test_keyword_map_makes_the_scores_once(spark, tmp_path):
    rows = [(f"https://s.com/products/red-bolt-{i % 3 + 10}", "Red bolt", "B", None if i % 2 else f"g{i % 3}") for i in range(6)]
    k = stored(spark, tmp_path / "k", [("red bolt", 5), ("blue gear", 3)], "normalized string, volume_mid bigint")
    pages = stored(spark, tmp_path / "p", rows, "url string, title string, h1 string, product_group_id string")
    for p, n in ((pages, 3), (pages.drop("product_group_id").filter("url like '%-10'"), 1)):  # a url is one contender, in how many rows it may be
        mapped = keywords.keyword_map(k, p)
        assert plan(mapped).count("REPARTITION_BY_NUM") == 2  # pages, and what meets
        got = {m.normalized: m for m in mapped.collect()}
        assert (got["red bolt"].status, len(got["red bolt"].contenders), got["blue gear"].status, got["blue gear"].contenders) == ("CANNIBAL" if n > 1 else "OWNED", n, "GAP", [])


def test_gaps_are_made_once(spark):
    from pyspark.sql import functions as F

    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def said(x):
        made.add(1)
        return x

    gaps = spark.createDataFrame([("red bolt", 5), ("red bolt set", 3), ("gear", 1)], "k string, volume_mid bigint").select(said.asNondeterministic()("k").alias("normalized"), "volume_mid")
    got = keywords.gap_clusters(gaps).collect()
    assert {(g.head, g.size, g.volume) for g in got} == {("red bolt", 2, 8), ("gear", 1, 1)} and made.value == 3


def test_shingles_are_cut_in_python(spark):
    from pyspark.sql import functions as F

    from quarry.functions import text

    texts = [None, "", "!?", "one", "one two three", "One two, three four", "zwölf Boxkämpfer jagen Viktor quer über den großen Sylter Deich", "a " * 900, "it's a b-c d e " * 3]
    d = spark.createDataFrame(list(enumerate(texts)), "id int, text string").withColumn("simhash", F.lit("old"))
    words = text.content_words(F.col("text"))
    got = dups.with_shingle_simhash(d, words)
    assert got.columns == ["id", "text", "simhash"] and dups.with_shingle_simhash(d, words, kept=["id"]).columns == ["id", "simhash"]
    want = dups.with_simhash(d.withColumn("s", text.shingles(words)), "s")
    assert {r.id: r.simhash for r in got.collect()} == {r.id: r.simhash for r in want.collect()}
    assert "sequence(" not in plan(got)  # no window is made before Python


def test_report_meets_near_pages_without_a_broadcast(spark, tmp_path, monkeypatch):
    import re

    from quarry.plans import catalogue

    r = random.Random(7)
    word = lambda: "".join(r.choices("abcdefghij", k=5))
    base = [[word() for _ in range(90)] for _ in range(2)]
    bodies = [b if n == 0 else [*b[:-n], *(word() for _ in range(n))] for n in range(5) for b in base]
    rows = [(n, f"https://s.example.com/p{n}", f"<html><head><title>T{n}</title></head><body><p>{' '.join(b)}</p></body></html>") for n, b in enumerate(bodies, 10)]
    stored(spark, tmp_path / "p", rows, "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    plans, near_pairs = [], dups.near_pairs
    monkeypatch.setattr(dups, "near_pairs", lambda *a: plans.append(plan(p := near_pairs(*a))) or p)
    got = {x.issue: x["count"] for x in catalogue.findings_report(spark, str(tmp_path)).collect()}
    assert plans and not [p for p in plans if re.search(r"Broadcast\w+Join \[(block|x|y)#", p)]
    prints = [dups.simhash(" ".join(b[i : i + 4]) for i in range(87)) for b in bodies]
    near = lambda a, b: ((prints[a] ^ prints[b]) & (1 << 64) - 1).bit_count() <= dups.DISTANCE
    taken = set()
    for i in range(len(bodies)):
        if i not in taken and (met := [j for j in range(i + 1, len(bodies)) if j not in taken and near(i, j)]):
            taken |= {i, *met}
    assert got["Near-duplicate content"] == len(taken) > 2
