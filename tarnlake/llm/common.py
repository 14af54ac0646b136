"""What several operators share: tables, the corpus split, storage and graph steps."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake.operators.graph import components
from tarnlake.operators.storage import drop_stash, shared_dir, side, stash

__all__ = ["PIECE_BYTES", "arrow", "components", "crc_mod", "drop_stash", "give_back", "joined_by_size", "shared_dir", "side", "stash", "table"]

#: Text columns are cut into pieces of about so many bytes before numpy sees them.
PIECE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def crc_mod(column, n: int):
    """crc32 of the id as text, mod n; null ids have no remainder."""
    return F.pmod(F.crc32(column.cast("string").cast("binary")), F.lit(n))


#: Rows of a key from which it may be joined by broadcast.
LARGE = 64


def joined_by_size(rows: DataFrame, sizes: DataFrame, keys: list[str], n: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined with sizes (one row per key; n: how many of rows have it) on keys, n left out.

    Keys that hold a thousandth of all rows or more are at most a thousand: those are joined by broadcast, so no task gathers
    the rows of a frequent key; all others are merged. rows is read twice. how: inner, or left for rows whose key sizes lacks.
    """
    large = max(LARGE, total // 1000)
    hot, cold = sizes.where(F.col(n) > large).drop(n), sizes.where(F.col(n) <= large).drop(n)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold.hint("merge"), keys, how)
    return rows.join(F.broadcast(hot), keys).unionByName(rest)  # at most 1,000 rows, or total / 64


def give_back() -> None:
    """Returns freed memory to the system, so that idle Python workers stay small beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another libc


def arrow(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow(run, schema), giving memory back at the end of each task."""

    def tidied(batches):
        yield from run(batches)
        give_back()

    return df.mapInArrow(tidied, schema)
