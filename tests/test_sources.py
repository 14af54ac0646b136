"""Sources and sinks on small files."""

import gzip
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tarnlake.functions import extract
from tarnlake.sources import readers, sinks


def put(path, data):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data if isinstance(data, bytes) else data.encode())


def test_tolerant_json(spark, tmp_path):
    schema = spark.createDataFrame([], "id string, n int, _corrupt_record string").schema
    put(tmp_path / "good.json", "﻿" + json.dumps([{"id": "a", "n": 1}, {"id": "b"}]))
    put(tmp_path / "bad.json", "{broken")
    assert {(r["id"], r["n"]) for r in readers.json_table(spark, f"{tmp_path}/good.json", schema).collect()} == {("a", 1), ("b", None)}
    assert [r["id"] for r in readers.json_table(spark, f"{tmp_path}/bad.json", schema).collect()] == [None]
    assert readers.json_table(spark, f"{tmp_path}/none.json", schema).count() == 0
    put(tmp_path / "universities.json", json.dumps([{"id": "u_x", "name": {"en": "X"}, "country": "Italy"}]))
    readers.register(spark, str(tmp_path), {"universities.json": "universities", "rankings.json": "rankings"})
    assert spark.sql("SELECT name.en FROM universities").first()[0] == "X" and spark.table("rankings").count() == 0


def test_manifests_and_bodies(spark, tmp_path):
    put(tmp_path / "u_a/manifest.json", json.dumps({"universityId": "u_a", "status": "done"}))
    put(tmp_path / "_quarantine/u_b/manifest.json", json.dumps({"universityId": "u_b"}))
    put(tmp_path / "u_a/page.html.gz", gzip.compress(b"<html><body>Hello <b>you</b></body></html>"))
    put(tmp_path / "u_a/page.json", json.dumps({"raw": {"documentTitle": "T", "mainText": ["one", " two"], "links": "no"}}))
    put(tmp_path / "u_a/broken.html.gz", b"\x1f\x8bxx")
    found = readers.manifests(spark, str(tmp_path), spark.createDataFrame([], "universityId string, status string").schema)
    assert [r["universityId"] for r in found.collect()] == ["u_a"]
    bodies = readers.raw_bodies(spark, f"{tmp_path}/u_a", "page*")
    by_name = {r["path"].rsplit("/", 1)[1]: r for r in bodies.collect()}
    assert by_name["page.json"]["sha256"] == hashlib.sha256((tmp_path / "u_a/page.json").read_bytes()).hexdigest()
    pages = bodies.select("path", F.when(F.col("path").rlike("html"), "captured").otherwise("captured").alias("status"))
    texts = {r["path"].rsplit("/", 1)[1]: r["text"] for r in readers.captured_text(bodies, pages).collect()}
    assert texts == {"page.html.gz": "Hello you", "page.json": "T one two"}
    assert readers.captured_text(bodies, pages.withColumn("status", F.lit("error"))).count() == 0
    broken = readers.raw_bodies(spark, f"{tmp_path}/u_a", "broken*").first()
    assert broken["text"] is None and broken["bytes"] == 4


def test_partitions_fallback_csv(spark, tmp_path):
    rows = spark.createDataFrame([("a", "20240101T00"), ("b", "20250101T00")], "v string, captured_at string")
    rows.write.partitionBy("captured_at").parquet(f"{tmp_path}/raw")
    assert [r["v"] for r in readers.latest_partition(spark.read.parquet(f"{tmp_path}/raw"), "captured_at").collect()] == ["b"]
    assert readers.live_or_archive(rows.where("v = 'z'"), rows).count() == 2 and readers.live_or_archive(rows.where("v = 'a'"), rows).count() == 1
    put(tmp_path / "i.csv", "institution,region,countryabbrv,homepage\nA,eu,,http://a\nB,eu\nC,us,us,http://c\n")
    assert [r["institution"] for r in readers.csv_table(spark, f"{tmp_path}/i.csv", 4).collect()] == ["A", "C"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", "captured", ["x", "y"]), ("b", "pending", ["z"])], "id string, status string, sources array<string>").withColumn("line", F.concat_ws(" ", "id", "status"))
    sinks.write_status_lists(df, f"{tmp_path}/lists", "status", "line")
    assert spark.read.text(f"{tmp_path}/lists/txt/status=captured").first()[0] == "a captured"
    assert {r["sources"] for r in spark.read.option("header", True).csv(f"{tmp_path}/lists/csv").collect()} == {"x|y", "z"}
    assert spark.read.json(f"{tmp_path}/lists/json").count() == 2
    sinks.write_package({"projects": df.drop("line")}, f"{tmp_path}/p", df.select("line"))
    with pytest.raises(FileExistsError):
        sinks.write_package({"projects": df}, f"{tmp_path}/p")
    sinks.write_package({"projects": df}, f"{tmp_path}/p", force=True)
    assert spark.read.json(f"{tmp_path}/p/projects").columns == ["id", "line", "sources", "status"]
    one = spark.createDataFrame([("u", None, None)], "user string, lang string, likes array<string>")
    sinks.keep_settings(one, f"{tmp_path}/s", "user", {"lang": "zh", "likes": []})
    two = sinks.keep_settings(spark.createDataFrame([("v", "en", ["x"])], one.schema), f"{tmp_path}/s", "user", {"lang": "zh", "likes": []})
    assert {(r["user"], r["lang"], tuple(r["likes"])) for r in two.collect()} == {("u", "zh", ()), ("v", "en", ("x",))}
    n = sinks.append_new(df.select("id", "status"), f"{tmp_path}/log", "id")
    assert n == 2 and sinks.append_new(df.select("id", "status"), f"{tmp_path}/log", "id") == 0


def test_charsets(spark):
    rows = [("é".encode("cp1252"), None), ("é".encode(), "utf-8"), ("<meta charset='iso-8859-1'>é".encode("latin-1"), None), (None, None), (b"\xe9\x81", "ascii")]
    got = [r[0] for r in spark.createDataFrame(rows, "b binary, c string").select(extract.decoded("b", "c")).collect()]
    assert got == ["é", "é", "<meta charset='iso-8859-1'>é", None, "é\x81"]
