"""The corpus pipeline: quality rules, language, near duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next stage's docs.  The first four return the columns of
documents; the last returns the packed bins.

Defined results, in every stage: extra columns are kept, whatever their names, by the
first four and ignored by the last; an empty table gives an empty one; texts of many MB
are handled whole; ties are settled as each operator's module says.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import langid, neardup, packing, pii, quality
from quarry.llm.common import prepare, stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; the references are those of this input.

    A null or empty text has no words and goes; repeated rows are judged alike and each count in the references.
    """
    return quality.keep_good(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is determined.

    A null text, or one without letters, goes; null languages are not learned from; repeated rows are answered alike.
    """
    return langid.keep_known(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the least id.

    Rows without an id, or without words, stay; rows that repeat an id stay or go together.
    """
    return neardup.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind; n_chars follows the text.

    A null text stays null, and so does its n_chars; repeated rows are masked alike.
    """
    masked = pii.redact(docs)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bin of each document, or of each piece of one that is longer than a bin.

    A null text counts as one end; null sources conflict with none; repeated rows are one cluster, so each has a bin of its own.
    """
    return packing.pack(packing.measure(docs))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is stored in the shared folder and read again."""
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: The fitted language model and the dart signatures have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None
