"""What the operators of this subpackage share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.store import prepare


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    Only where a session on one machine names none is one set; on a cluster a folder
    of one machine would lose what other machines need, so that is an error.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = os.path.join(tempfile.gettempdir(), "checkpoints")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def stored(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back.

    This cuts the lineage: a lost executor costs a reread, not a recomputation.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Remove a table that stored() wrote; nothing may read it any more."""
    spark = df.sparkSession
    at = shared_dir(spark)
    for file in df.inputFiles()[:1]:
        name = file.split(at.split(":", 1)[-1].lstrip("/") + "/", 1)[-1].split("/", 1)[0]
        if len(name) <= 33 or "-" not in name:  # not one of stored()'s
            raise ValueError(f"not a stored table: {file}")
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{at}/{name}")
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table | None], schema: str) -> DataFrame:
    """Apply fn to each Arrow batch; fn sees one batch at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := fn(batch)) is not None:
                yield from out.to_batches() if isinstance(out, pa.Table) else [out]

    return df.mapInArrow(run, schema)


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo a number; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
