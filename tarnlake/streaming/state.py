"""Resumable state over arriving rows. An extension: the batch semantics are those of the upsert and the frontier."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlake.functions import rules
from tarnlake.operators.evidence import best_status


def retryable(error, blocked, status):
    """Worth another try: an error, not blocked, without a status or with one that passes."""
    return error.isNotNull() & ~F.coalesce(blocked, F.lit(False)) & (status.isNull() | status.isin(408, 425, 429) | status.between(500, 599))


def until_first(df: DataFrame, keys: list[str], order: str, flag: str) -> DataFrame:
    """Rows of each key before the first one with the flag."""
    first = df.where(F.col(flag)).groupBy(*keys).agg(F.min(order).alias("_stop"))
    return df.join(first, keys, "left").where(F.col("_stop").isNull() | (F.col(order) < F.col("_stop"))).drop("_stop")


def windowed_counts(events: DataFrame, time: str = "ts", kind: str = "event_type", width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums per window and kind; on a stream, rows later than the watermark are dropped."""
    plain = dict(events.dtypes)[time]
    timed = events.withColumn(time, F.col(time).cast("timestamp"))  # watermarks need the type with a zone
    return timed.withWatermark(time, late).groupBy(F.window(time, width), kind).agg(F.count("*").alias("events"), F.sum(F.floor(F.col("value") * 100).cast("long")).alias("cents")).select(F.col("window.start").cast(plain).alias("start"), kind, "events", "cents")


def frontier(path: str, key: str, status: str):
    """A foreachBatch function that keeps the best status of each key in a table at path."""

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v{number - 1}")
        there = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
        rows = batch.select(key, status)
        if there:
            rows = rows.union(spark.read.parquet(f"{path}/v{number - 1}").select(key, status))
        best_status(rows, [key], status, rules.PAGE_STATUSES).write.mode("overwrite").parquet(f"{path}/v{number}")

    return apply
