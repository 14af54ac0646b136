"""Sinks: JSON, status lists, append with resumption, small reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlake.operators.joins import remaining


def write_json(df: DataFrame, path: str, force: bool = False) -> None:
    """Line-delimited JSON; refuses a folder that is there unless forced."""
    df.write.mode("overwrite" if force else "errorifexists").json(path)


def write_status_lists(df: DataFrame, path: str, status: str, line: str) -> None:
    """Lists by status in three forms: path/json, path/csv (arrays joined by bars) and path/txt (the text in column `line`), one folder for each status."""
    flat = [F.concat_ws("|", c).alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes]
    df.write.mode("overwrite").partitionBy(status).json(f"{path}/json")
    df.select(*flat).write.mode("overwrite").option("header", True).partitionBy(status).csv(f"{path}/csv")
    df.select(status, line).write.mode("overwrite").partitionBy(status).text(f"{path}/txt")


def write_package(tables: dict[str, DataFrame], path: str, raw: DataFrame | None = None, force: bool = False) -> None:
    """A package: one folder of JSON for each table, columns in order of their names, the raw text beside them; refuses a folder that is there unless forced."""
    spark = next(iter(tables.values())).sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if system.exists(folder):
        if not force:
            raise FileExistsError(path)
        system.delete(folder, True)
    for name, df in tables.items():
        df.select(*sorted(df.columns)).write.json(f"{path}/{name}")
    if raw is not None:
        raw.write.text(f"{path}/raw")


def keep_settings(df: DataFrame, path: str, key: str, defaults: dict) -> DataFrame:
    """Settings of users as a small table: df over what path holds, missing values from defaults; written as the next version and returned.

    Versions are folders v0, v1 and so on; a writer that dies leaves the last whole one (with its _SUCCESS file) in force.
    """
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    system = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    n = 0
    while system.exists(hadoop(f"{path}/v{n}/_SUCCESS")):
        n += 1
    rows = df
    if n:
        old = spark.read.schema(df.schema).parquet(f"{path}/v{n - 1}")
        rows = old.join(df, key, "left_anti").unionByName(df)
    rows = rows.na.fill({k: v for k, v in defaults.items() if not isinstance(v, list)})
    for k, v in defaults.items():
        if isinstance(v, list):
            rows = rows.withColumn(k, F.coalesce(k, F.array(*map(F.lit, v)).cast(df.schema[k].dataType)))
    rows.write.mode("overwrite").parquet(f"{path}/v{n}")
    return spark.read.schema(df.schema).parquet(f"{path}/v{n}")


def append_new(df: DataFrame, path: str, key: str) -> int:
    """Appends the rows whose key is not there yet; how many."""
    spark = df.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    new = remaining(df, spark.read.schema(df.schema).parquet(path), key) if there else df
    n = new.count()
    new.write.mode("append").parquet(path)
    return n


def pivot_ranks(df: DataFrame, key: str, source: str, rank: str, sources: list[str]) -> DataFrame:
    """One column of ranks per source, and the sources joined by bars."""
    wide = df.groupBy(key).pivot(source, sources).agg(F.min(rank))
    return wide.withColumn("sources", F.concat_ws("|", *(F.when(F.col(s).isNotNull(), s) for s in sources)))


def markdown(df: DataFrame, most: int = 200) -> str:
    """A table for people: the first rows of a small result."""
    rows = df.limit(most).collect()
    line = lambda cells: "| " + " | ".join("" if c is None else str(c) for c in cells) + " |"
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *map(line, rows)])
