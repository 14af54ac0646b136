"""Tables written to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}
#: Rows of some ten numbers up to which the side of a join is sent to all, and rows of a single number.
SENT_ROWS, SENT_IDS = 1 << 16, 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else one of our own (local sessions only).

    On a cluster without that setting this is an error: executors would each write to their own disks.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = f"file://{tempfile.mkdtemp(prefix='tarnlake-')}"
    return _own[app]


def _home(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/tarnlake-{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def clear(spark: SparkSession) -> None:
    """Deletes all that this application stashed: for when the results have been written."""
    _delete(spark, _home(spark))


def stash(df: DataFrame, label: str) -> DataFrame:
    """df written as Parquet into the shared folder and read again: cuts the lineage and outlives lost executors."""
    spark = df.sparkSession
    path = f"{_home(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stash_path = path
    return out


def side(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df as the right side of a join: sent to all if it has few enough rows (rows: a bound that is known), else sorted and merged.

    Spark goes by the bytes of compressed files and takes an array for one element, so after an explode or over columns
    that compress well it would send tables that the driver cannot hold.
    """
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= (SENT_ROWS if len(df.columns) > 1 else SENT_IDS) else df.hint("merge")


def drop_stash(df: DataFrame) -> None:
    """Deletes what stash() wrote, once nothing lazy reads it any more."""
    path = getattr(df, "_stash_path", None)
    if path:
        _delete(df.sparkSession, path)
