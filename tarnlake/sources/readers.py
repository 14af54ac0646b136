"""Sources: JSON payloads, snapshots, manifests, raw bodies, CSV, sectioned text."""

from __future__ import annotations

import gzip
import zlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException
from pyspark.sql.window import Window


def parquet(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def json_table(spark: SparkSession, path: str, schema: T.StructType, multiline: bool = True) -> DataFrame:
    """Whole-file JSON (a list of objects) by schema; an empty table where there is no file. Broken files give no rows but are
    seen in `_corrupt_record` if the schema has it."""
    try:
        return spark.read.schema(schema).option("multiLine", multiline).option("mode", "PERMISSIVE").json(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


# The tables that pages are served from, with their forms.
SCHEMAS = {
    "universities": "id string, name struct<en:string,zh:string>, country string, region string, website string, subjects array<string>, sources array<string>",
    "rankings": "rank int, universityId string, name string, country string, score double, year int",
    "programs": "id string, universityId string, subject string, dept string, program string, deadlines array<struct<round:string,date:string,applicantGroup:string>>, materials array<string>, "
    "requirements struct<gpa:string,ielts:string,toefl:string,language:string,academic:string>, sourceUrl string, verified boolean, updatedAt string, deadlineReviewed boolean, evidenceUrls array<string>",
    "aliases": "canonicalById map<string,string>, reasonById map<string,string>",
    "coverage": "universityId string, coverageStatus string, urls array<string>, completeness int",
    "official_coverage": "schools array<struct<canonicalId:string,name:string,coverageStatus:string,urls:array<string>,rankingUniversityIds:array<string>>>",
    "captures": "schools array<struct<canonicalId:string,name:string,country:string,captureStatus:string,mainlandChina:boolean>>",
}


def typed(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """One of the published JSON tables by its form; an empty one where there is no file."""
    schema = spark.createDataFrame([], SCHEMAS[kind]).schema
    return json_table(spark, path, schema)


def register(spark: SparkSession, root: str, files: dict[str, str]) -> None:
    """Temporary views of the published tables under root: file name -> kind."""
    for name, kind in files.items():
        typed(spark, f"{root}/{name}", kind).createOrReplaceTempView(name.rsplit(".", 1)[0])


def captured_text(bodies: DataFrame, pages: DataFrame) -> DataFrame:
    """pages (path, status) that were captured, with the text of their body: strings of JSON captures, what is visible of HTML."""
    from tarnlake.functions import extract, text

    both = pages.where("status = 'captured'").join(bodies.select("path", F.col("text").alias("_t")), "path")
    is_json = F.col("path").rlike(r"\.json(\.gz)?$")
    return both.withColumn("text", F.when(is_json, extract.json_text(F.when(is_json, F.col("_t")))).otherwise(text.visible_text(F.col("_t")))).drop("_t")


def payload_items(df: DataFrame, column: str, item: str, keys: tuple[str, ...] = ("items", "data", "value", "results")) -> DataFrame:
    """Rows of a payload that is a list, or an object that holds the list under one of several keys."""
    held = F.coalesce(*(F.get_json_object(column, f"$.{k}") for k in keys))
    found = F.from_json(F.when(F.startswith(F.ltrim(column), F.lit("[")), F.col(column)).otherwise(held), f"array<{item}>")
    return df.withColumn("_i", F.explode(found)).select("_i.*")


def latest_partition(df: DataFrame, partition: str) -> DataFrame:
    """The rows of the last value of a partition column: one scalar, then partition pruning."""
    last = df.agg(F.max(partition)).first()[0]
    return df.where(F.col(partition) == F.lit(last))


def live_or_archive(live: DataFrame, archive: DataFrame) -> DataFrame:
    return archive if live.isEmpty() else live


def manifests(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    """All manifest.json below root with their path; quarantined folders are left out."""
    found = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "manifest.json").json(root)
    return found.withColumn("manifest", F.input_file_name()).where(~F.contains("manifest", F.lit("/_quarantine")))


@F.pandas_udf(T.StringType())
def gunzip_text(body: pd.Series) -> pd.Series:
    """Bytes as text, gunzipped where they are compressed; null where they cannot be."""

    def text(b):
        if b is None:
            return None
        try:
            return (gzip.decompress(b) if b[:2] == b"\x1f\x8b" else b).decode("utf-8", "replace")
        except (OSError, EOFError, zlib.error):
            return None

    return body.map(text)


def raw_bodies(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """path, bytes, sha256 (of what is stored) and text of each file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(root)
    return files.select("path", F.length("content").alias("bytes"), F.sha2("content", 256).alias("sha256"), gunzip_text("content").alias("text"))


def csv_table(spark: SparkSession, path: str, columns: int) -> DataFrame:
    """A CSV with a header; rows shorter than the given number of columns are left out, empty cells are empty texts."""
    names = spark.read.option("header", True).csv(path).columns
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*names, "_corrupt_record"]])
    df = spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").option("enforceSchema", True).csv(path)
    cells = F.size(F.split("_corrupt_record", ',(?=(?:[^"]*"[^"]*")*[^"]*$)'))
    return df.where(F.col("_corrupt_record").isNull() | (cells >= columns)).na.fill("").drop("_corrupt_record")


def sections(lines: DataFrame) -> DataFrame:
    """(file, line, kind, ids, key, value) of `key = value` lines below `[kind id ...]` headers; # and ; begin comments.

    lines: file, line, text. The header in force is the last one above within the file.
    """
    named = lines.withColumn("t", F.trim("text")).where("t <> '' AND NOT t RLIKE '^[#;]'")
    head = F.nullif(F.regexp_extract("t", r"^\[([^\]]+)\]$", 1), F.lit(""))
    w = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    known = named.withColumn("h", F.last(head, ignorenulls=True).over(w)).where("NOT t RLIKE '^\\\\[' AND t LIKE '%=%'")
    parts = F.split("h", r"\s+")
    return known.select("file", "line", parts[0].alias("kind"), F.slice(parts, 2, 100).alias("ids"), F.trim(F.regexp_extract("t", "^([^=]*)=", 1)).alias("key"), F.trim(F.regexp_extract("t", "^[^=]*=(.*)$", 1)).alias("value"))


def repeated_keys(found: DataFrame) -> DataFrame:
    """Keys that a section gives more than once, with their lines: an error of the file."""
    return found.groupBy("file", "kind", "ids", "key").agg(F.array_sort(F.collect_list("line")).alias("lines")).where("size(lines) > 1")
