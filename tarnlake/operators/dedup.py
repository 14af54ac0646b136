"""Keeping one or some rows of each key. Ties are decided by the given order to its end, so orders should end in a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def keep_best(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return top_k(df, keys, order, 1)


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str | None = None) -> DataFrame:
    """The first k rows of each key; rank names a column for their place. Spark cuts groups to k before it shuffles."""
    name = rank or "_r"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= k)
    return out if rank else out.drop(name)


def latest(df: DataFrame, keys: list[str], values: list[str], order: list[str]) -> DataFrame:
    """The values of each key's last row by `order`, as an aggregate that combines before the shuffle."""
    last = F.max_by(F.struct(*values), F.struct(*order)).alias("_v")
    return df.groupBy(*keys).agg(last).select(*keys, *(F.col("_v")[v].alias(v) for v in values))


def single_owner(df: DataFrame, key: str, owner: str) -> DataFrame:
    """Rows whose key has one owner; keys of several owners are rejected for all."""
    shared = df.groupBy(key).agg(F.min(owner).alias("_a"), F.max(owner).alias("_b")).where("_a <> _b").select(key)
    return df.join(shared, key, "left_anti")


def disambiguate(df: DataFrame, id_column: str, order: list[Column]) -> DataFrame:
    """Repeated ids get the first free ones of _2, _3 and so on in the given order; what is an id already is not free.

    An id that is repeated k times, while t ids look like it with a number, has its suffixes among the first k + t numbers.
    """
    ids = df.groupBy(F.col(id_column).alias("_id")).agg(F.count("*").alias("_k"))
    numbered = ids.select(F.regexp_extract("_id", "^(.*)_[0-9]+$", 1).alias("_base")).groupBy("_base").agg(F.count("*").alias("_t"))
    repeated = ids.where("_k > 1").join(numbered, F.col("_id") == F.col("_base"), "left")
    tries = repeated.select("_id", F.explode(F.sequence(F.lit(2), (F.col("_k") + F.coalesce("_t", F.lit(0))).cast("int"))).alias("_n")).withColumn("_new", F.concat("_id", F.lit("_"), "_n"))
    free = tries.join(ids.select(F.col("_id").alias("_new")), "_new", "left_anti").withColumn("_place", F.row_number().over(Window.partitionBy("_id").orderBy("_n")) + 1)
    placed = df.withColumn("_r", F.row_number().over(Window.partitionBy(id_column).orderBy(*order)))
    out = placed.join(free, (F.col(id_column) == F.col("_id")) & (F.col("_r") == F.col("_place")), "left")
    return out.withColumn(id_column, F.coalesce("_new", id_column)).select(*df.columns)


def batches(df: DataFrame, keys: list[str], order: list[Column], size: int) -> DataFrame:
    """batch_no and batch_pos of each row: bounded chunks of each key, in the given order."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    return df.withColumn("_n", n).withColumn("batch_no", F.floor(F.col("_n") / size).cast("long")).withColumn("batch_pos", F.pmod("_n", F.lit(size)).cast("int")).drop("_n")


def global_position(df: DataFrame, order: list[str], name: str = "position") -> DataFrame:
    """Dense positions from 0 over the whole order: rows are sorted in ranges, each range's place follows from the counts before it."""
    from tarnlake.operators.storage import stash

    ranged = stash(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()), "ranges")
    w = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("_p").count().select("_p", F.coalesce(F.sum("count").over(w), F.lit(0)).alias("_s"))  # one row per range
    local = F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1
    return ranged.withColumn("_l", local).join(starts, "_p").withColumn(name, F.col("_s") + F.col("_l")).drop("_p", "_s", "_l")


def running_total(df: DataFrame, order: list[Column], value: str, name: str) -> DataFrame:
    """The sum of `value` over all rows before each one in the whole order: summed within sorted ranges, which start where the ranges before end."""
    from tarnlake.operators.storage import stash

    ranged = stash(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()), "ranges")
    earlier = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("_p").agg(F.sum(value).alias("_t")).select("_p", F.coalesce(F.sum("_t").over(earlier), F.lit(0)).alias("_b"))  # one row per range
    within = F.coalesce(F.sum(value).over(Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranged.withColumn("_w", within).join(starts, "_p").withColumn(name, F.col("_b") + F.col("_w")).drop("_p", "_w", "_b")


def even_sample(df: DataFrame, order: list[str], k: int) -> DataFrame:
    """k rows at evenly spaced positions of the order (all, if there are no more): the i-th at round(i * (n - 1) / (k - 1)), halves to even."""
    placed = global_position(df, order)
    n = placed.count()
    if n <= k:
        return placed
    wanted = df.sparkSession.createDataFrame([(round(i * (n - 1) / (k - 1)),) for i in range(k)], "position long").distinct()
    return placed.join(F.broadcast(wanted), "position")  # k rows


def select_urls(rows: DataFrame, owner: str, url: str, score: str, fingerprint: Column, title: Column, k: int = 3) -> DataFrame:
    """Up to k urls of each owner: fingerprints of several owners go for all, of one fingerprint and of one catalogue title (null: none) the best stays; by score, https first, shorter first."""
    order = [F.col(score).desc(), F.startswith(url, F.lit("https:")).desc(), F.length(url), F.col(url)]
    known = rows.withColumns({"_f": fingerprint, "_t": F.lower(F.trim(F.regexp_replace(title, r"\s+", " ")))})
    own = keep_best(single_owner(known, "_f", owner), [owner, "_f"], order)
    # Rows without a title are told apart by their fingerprint.
    titled = keep_best(own.withColumn("_t", F.coalesce(F.concat(F.lit("t:"), "_t"), F.concat(F.lit("f:"), "_f"))), [owner, "_t"], order)
    return top_k(titled, [owner], order, k).drop("_f", "_t")


def unambiguous(pairs: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value): a map turned round; keys of several values are left out."""
    return pairs.groupBy(key).agg(F.min(value).alias(value), F.max(value).alias("_b")).where(F.col(value) == F.col("_b")).drop("_b")
