"""Ranking over one or several boards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnlake.operators.dedup import global_position, running_total


def competition_rank(df: DataFrame, score: str, name: str = "rank") -> DataFrame:
    """Ranks by falling score, equal scores sharing the first place, null scores last. A score's rank is one more than the rows
    above it: distinct scores are counted and added up range by range, so no task sees them all."""
    counts = df.groupBy(F.col(score).alias("_s")).count()
    places = running_total(counts, [F.col("_s").desc_nulls_last()], "count", "_above").select("_s", (F.col("_above") + 1).alias(name))
    return df.join(places, df[score].eqNullSafe(F.col("_s"))).drop("_s")


def sequential_rank(df: DataFrame, order: list[str], name: str = "rank") -> DataFrame:
    return global_position(df, order, name).withColumn(name, F.col(name) + 1)


def first_n(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first n rows; a partial top-n in each task, no full sort."""
    return df.orderBy(*order).limit(n)


def order_breaks(df: DataFrame, keys: list[str], order: list[Column], rank: str, score: str) -> DataFrame:
    """Rows whose rank falls below the row before, or whose score rises above the last one known."""
    w = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumns({"previous_rank": F.lag(rank).over(w), "last_score": F.last(score, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))})
    return out.where((F.col(rank) < F.col("previous_rank")) | (F.col(score) > F.col("last_score")))


def mean_rank(boards: list[DataFrame], key: str, least: int) -> DataFrame:
    """key, boards, mean_rank over boards (columns key and rank) for keys on at least `least` of them."""
    every = boards[0].select(key, "rank")
    for b in boards[1:]:
        every = every.unionByName(b.select(key, "rank"))
    return every.groupBy(key).agg(F.count("*").alias("boards"), F.avg("rank").alias("mean_rank")).where(F.col("boards") >= least)


def featured(ranks: DataFrame, names: DataFrame, key: str, least: int, n: int, name_key: Column) -> DataFrame:
    """The n keys of best mean rank on at least `least` boards, of those with one name key the first. ranks: key, rank. names: key, name."""
    from tarnlake.operators.dedup import keep_best

    means = ranks.groupBy(key).agg(F.count("*").alias("boards"), F.avg("rank").alias("mean_rank")).where(F.col("boards") >= least)
    named = means.join(names, key).withColumn("_n", name_key)
    order = [F.col("mean_rank"), F.col(key)]
    return first_n(keep_best(named, ["_n"], order).drop("_n"), order, n)


def universities(rankings: DataFrame, order: list[str], region: Column) -> DataFrame:
    """(id, name, country, region, sources): one row per institution of the boards, in order: the first name, the first country that is not empty, its boards. rankings: source, id, name, country."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("source"))
    known = rankings.where("id <> '' AND name <> ''").withColumn("_p", place)
    one = known.groupBy("id").agg(
        F.min_by("name", F.struct("_p", "name")).alias("name"), F.min_by(F.nullif("country", F.lit("")), F.when(F.col("country") != "", F.struct("_p", "country"))).alias("country"), F.array_sort(F.collect_set(F.struct("_p", "source"))).alias("_s"),
    )
    out = one.withColumn("country", F.coalesce("country", F.lit(""))).withColumn("sources", F.transform("_s", lambda s: s["source"])).drop("_s")
    return out.withColumn("region", region)
