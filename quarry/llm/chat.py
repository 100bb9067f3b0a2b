"""Chat formatting: collapse cumulative snapshots, then render.

A log that is written after every turn holds each conversation many times, each
time one turn longer.  Every turn prefix of a conversation gets a rolling hash
(128 bits: two running XORs of hashes that include the turn's position); a
conversation whose whole hash is the hash of a proper prefix of another is that
one's snapshot and goes (anti-join).  What is left is rendered, one row each.

Turns are numbered 1.. by (turn, role, text), nulls first, so gaps and repeated
turn numbers are in order.  Equal conversations do not prefix each other: all
stay, and removing copies is left to deduplication.  However many conversations are
equal, their prefixes meet the anti-join as one row each.  Rows without conv_id are
one conversation.  Texts of any length are hashed whole; repeated rows are turns of
their own; other columns of the input are ignored, whatever their names.  A null role is rendered as "unknown", a null text as empty;
both differ from those strings in the hash.  An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

#: Parts that the equal conversations of one anti-join key are dealt to.
SALTS = 16
BEGIN, END = "<|im_start|>", "<|im_end|>"


def prefixes(turns: DataFrame) -> DataFrame:
    """turns with k (its place), p1 and p2 (the prefix hash up to it) and whole (it is the last)."""
    rows = turns.select("conv_id", "turn", "role", "text")
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    code = lambda seed: F.xxhash64(F.lit(seed), "k", F.col("role").isNull(), "role", F.col("text").isNull(), "text")
    return (
        rows.withColumn("k", F.row_number().over(order))
        .withColumns({"p1": F.bit_xor(code(1)).over(so_far), "p2": F.bit_xor(code(2)).over(so_far), "whole": F.lead("k").over(order).isNull()})
    )


def collapse(turns: DataFrame) -> DataFrame:
    """The turns of conversations that prefix no longer one, with k and n_turns."""
    p = prefixes(turns)
    # each prefix once, before the shuffle to its key: is it a proper prefix, and is it a whole conversation
    seen = p.groupBy("k", "p1", "p2").agg(F.bool_or(~F.col("whole")).alias("inner"), F.bool_or("whole").alias("ends"))
    gone = seen.filter("inner and ends").select("k", "p1", "p2")
    # the ids by salted key: a conversation that thousands log alike is dealt to many tasks
    salt = F.pmod(F.xxhash64("conv_id"), F.lit(SALTS)).cast("int")
    ends = p.filter("whole").select("conv_id", "k", "p1", "p2", salt.alias("salt"))
    salted = gone.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    kept = ends.join(salted, ["k", "p1", "p2", "salt"], "left_anti")
    ids = kept.select(F.col("conv_id").alias("kept_id"), F.col("k").alias("n_turns"))
    return p.select("conv_id", "k", "role", "text").join(ids, F.col("conv_id").eqNullSafe(F.col("kept_id"))).drop("kept_id")


def render(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, rendered) from turns in order k.

    A conversation is one row of the result, so its turns meet in one task.
    """
    line = F.concat(F.lit(BEGIN), F.coalesce("role", F.lit("unknown")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit(END + "\n"))
    parts = F.sort_array(F.collect_list(F.struct("k", line.alias("line"))))
    return (
        turns.groupBy("conv_id")
        .agg(F.max("n_turns").cast("bigint").alias("n_turns"), F.array_join(F.transform(parts, lambda t: t["line"]), "").alias("rendered"))
        .withColumn("n_chars", F.length("rendered").cast("bigint"))
    )


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render(collapse(table(spark, sf_dir, "conversations")))


OP8_SQL = f"""
WITH t AS (
  SELECT conv_id, role, text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS k,
         '{BEGIN}' || coalesce(role, 'unknown') || chr(10) || coalesce(text, '') || '{END}' || chr(10) AS line,
         md5(coalesce('r' || role, 'n') || chr(0) || coalesce('t' || text, 'n')) AS code
  FROM conversations),
p AS (
  SELECT conv_id, k, string_agg(code, '') OVER (PARTITION BY conv_id ORDER BY k) AS prefix,
         count(*) OVER (PARTITION BY conv_id) AS n FROM t),
kept AS (
  SELECT conv_id, n FROM p WHERE k = n
    AND prefix NOT IN (SELECT prefix FROM p WHERE k < n))
SELECT t.conv_id, max(kept.n)::BIGINT AS n_turns, string_agg(line, '' ORDER BY k) AS rendered,
       length(string_agg(line, '' ORDER BY k))::BIGINT AS n_chars
FROM t JOIN kept ON t.conv_id IS NOT DISTINCT FROM kept.conv_id
GROUP BY t.conv_id
"""
