"""Incremental audits: fetched pages arrive as files and are merged by URL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def latest(pages: DataFrame, order: str = "fetched_at") -> DataFrame:
    """Of each url the last fetch."""
    w = Window.partitionBy("url").orderBy(F.desc(order))
    return pages.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def upsert(old: DataFrame | None, new: DataFrame, order: str = "fetched_at") -> DataFrame:
    return latest(new if old is None else old.unionByName(new), order)


def replace_links(old: DataFrame, new: DataFrame) -> DataFrame:
    """The links of the sources in new take the place of theirs in old."""
    return old.join(new.select("source").distinct(), "source", "left_anti").unionByName(new)


def run_available(spark: SparkSession, schema: StructType, arrivals: str, folder: str) -> int:
    """Merge what has arrived since the last run into folder/state-N; the number of batches.

    The stream remembers its files in a checkpoint, so a run that was cut off goes on;
    each batch writes a new state beside the old one.
    """
    stream = spark.readStream.schema(schema).parquet(arrivals)
    done: list[int] = []

    def merge(batch: DataFrame, n: int) -> None:
        s = batch.sparkSession
        old = s.read.schema(schema).parquet(f"{folder}/state-{n - 1}") if n else None
        upsert(old, batch).write.mode("overwrite").parquet(f"{folder}/state-{n}")
        done.append(n)

    q = stream.writeStream.foreachBatch(merge).option("checkpointLocation", f"{folder}/_stream").trigger(availableNow=True).start()
    q.awaitTermination()
    return len(done)


def windowed_events(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by type and window; works on streams and tables."""
    source = events.withWatermark("ts", late) if events.isStreaming else events
    return source.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
