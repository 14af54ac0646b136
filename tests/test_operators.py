import gzip

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnlake.operators import dedup, evidence, graph, joins, packages, ranking, resolve
from tarnlake.sources import readers, sinks
from tarnlake.streaming import state


def pairs(df):
    return sorted(tuple(r) for r in df.collect())


def test_competition_rank_shares_first_places(spark):
    df = spark.createDataFrame([("a", 9), ("b", 9), ("c", 5), ("d", None)], "k string, s int")
    assert pairs(ranking.competition_rank(df, "s").select("k", "rank")) == [("a", 1), ("b", 1), ("c", 3), ("d", 4)]


def test_order_of_input_does_not_matter(spark):
    rows = [(k % 3, k, (k * 7) % 5) for k in range(30)]
    one, two = (spark.createDataFrame(r, "g int, k int, v int") for r in (rows, rows[::-1]))
    for f in (lambda d: dedup.batches(d, ["g"], [F.col("v"), F.col("k")], 4), lambda d: dedup.global_position(d, ["v", "k"]), lambda d: dedup.even_sample(d, ["k"], 7)):
        assert pairs(f(one)) == pairs(f(two))


def test_chains(spark):
    df = spark.createDataFrame([(1, 2), (2, 3), (3, None), (4, 3), (7, 8), (8, 7), (9, 7)], "id long, next long")
    assert pairs(graph.flatten_chains(df)) == [(1, 3), (2, 3), (3, 3), (4, 3), (7, 7), (8, 7), (9, 7)]


def test_climb_has_no_bound(spark):
    up = [(i, i - 1) for i in range(1, 41)] + [(0, None), (50, 51), (51, 52), (52, 51), (60, None), (61, 60), (70, 71)]
    stops = spark.createDataFrame([(0,), (20,), (71,)], "s long")
    got = evidence.climb(spark.createDataFrame(up, "p long, up long"), "p", "up", stops, "s")
    assert pairs(got) == [(i, 0 if i < 20 else 20) for i in range(41)] + [(70, 71)]


def test_components(spark):
    df = spark.createDataFrame([(5, 4), (4, 3), (9, 8), (3, 5)], "a long, b long")
    assert pairs(graph.components(df, "t")) == [(3, 3), (4, 3), (5, 3), (8, 8), (9, 8)]
    assert graph.components(df.where("a < 0"), "t").count() == 0


def test_protected_pairs_stay_apart(spark):
    rows = spark.createDataFrame([("x", i) for i in range(4)], "c string, id int")
    merges = spark.createDataFrame([("x", 0, 1, 0), ("x", 1, 2, 1), ("x", 2, 3, 2)], "c string, a int, b int, step int")
    apart = spark.createDataFrame([("x", 0, 2)], "c string, a int, b int")
    assert pairs(resolve.constrained_components(rows, merges, apart, "c").select("id", "component")) == [(0, 0), (1, 0), (2, 2), (3, 2)]


def test_upsert_and_lookup(spark):
    old = spark.createDataFrame([(1, ["a"], "x"), (2, None, "y")], "k int, u array<string>, v string")
    new = spark.createDataFrame([(2, ["b"], None), (3, ["c"], "z")], "k int, u array<string>, v string")
    assert pairs(joins.upsert(old, new, "k", ["u"], ["v"])) == [(1, ["a"], "x"), (2, ["b"], "y"), (3, ["c"], "z")]


def test_sections_and_package(spark):
    text = packages.EXAMPLE + "[manifest]\nschema_version = 2\n"
    lines = spark.createDataFrame([("f", i, t) for i, t in enumerate(text.splitlines())], "file string, line int, text string")
    found = readers.sections(lines)
    assert readers.repeated_keys(found).select("key").first()[0] == "schema_version"
    assert found.where("kind = 'fee'").select("value").first()[0] == "1500.00"


def test_sources_and_sinks(spark, tmp_path):
    schema = T.StructType([T.StructField("a", T.LongType())])
    assert readers.json_table(spark, str(tmp_path / "none.json"), schema).count() == 0
    (tmp_path / "x.json").write_text('[{"a": 1}, {"a": 2}]')
    assert readers.json_table(spark, str(tmp_path / "x.json"), schema).count() == 2
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "p.gz").write_bytes(gzip.compress("größe".encode()))
    assert readers.raw_bodies(spark, str(tmp_path / "raw")).select("text").first()[0] == "größe"
    df = spark.createDataFrame([(1, "x"), (2, "y")], "k int, s string")
    assert sinks.append_new(df, str(tmp_path / "log"), "k") == 2
    assert sinks.append_new(df.union(spark.createDataFrame([(3, "z")], df.schema)), str(tmp_path / "log"), "k") == 1
    payload = spark.createDataFrame([('{"items": [{"a": 1}]}',), ('[{"a": 2}]',)], "j string")
    assert pairs(readers.payload_items(payload, "j", "struct<a:int>").where("a IS NOT NULL")) == [(1,), (2,)]


def test_frontier_keeps_best_status(spark, tmp_path):
    step = state.frontier(str(tmp_path), "u", "s")
    step(spark.createDataFrame([("a", "error"), ("b", "captured")], "u string, s string"), 0)
    step(spark.createDataFrame([("a", "captured"), ("b", "error")], "u string, s string"), 1)
    assert pairs(spark.read.parquet(str(tmp_path / "v1")).select("u", "s")) == [("a", "captured"), ("b", "captured")]


def test_windows_on_a_stream(spark, tmp_path):
    """The same counts from a stream as from the table."""
    from tests.conftest import SF

    events = spark.read.parquet(f"{SF}/events.parquet")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(SF)
    q = state.windowed_counts(stream).writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert pairs(spark.table("windows")) == pairs(state.windowed_counts(events)) and spark.table("windows").count() > 0
