"""Queries without SQL against brute force on their own rows, and the constraints of merges."""

import difflib
import re

import pytest
from pyspark.sql import functions as F

from tarnlake.functions import rules
from tarnlake.operators import dedup, joins, ladders, merge, resolve
from tarnlake.plans import catalog
from tests.conftest import SF


def test_fuzzy_pairs(spark):
    names = {}
    for r in spark.read.parquet(f"{SF}/part.parquet").collect():
        names.setdefault(r["p_brand"], []).append((r["p_partkey"], f"{r['p_name']} {r['p_type']}"))
    want = {}
    for brand, rows in names.items():
        rows.sort()
        for i, (a, x) in enumerate(rows):
            for b, y in rows[i + 1 :]:
                ratio = difflib.SequenceMatcher(None, x, y).ratio()
                if ratio >= 0.9 and min(len(x), len(y)) >= 5:
                    want[brand, a, b] = ratio
    got = {(r["p_brand"], r["a"], r["b"]): r["ratio"] for r in catalog.QUERIES["fuzzy_pairs"](spark, SF).collect()}
    assert got == pytest.approx(want)
    odd = spark.createDataFrame([("x", 1, "abcdefghij"), ("x", 2, "abcdefghij"), ("x", 3, "abcdefghik"), ("x", 4, "abcd"), ("y", 5, "abcdefghij"), ("x", 6, None), ("x", 7, "é" * 10), ("x", 8, "é" * 9 + "è")], "k string, id int, name string")
    pairs = {(r["a"], r["b"]) for r in resolve.fuzzy_pairs(odd, "k", "id", "name").collect()}
    assert pairs == {(1, 2), (1, 3), (2, 3), (7, 8)}


def test_constrained_resolution(spark):
    s = sorted((r["s_nationkey"], r["s_suppkey"], r["s_acctbal"]) for r in spark.read.parquet(f"{SF}/supplier.parquet").collect())
    comp = {i: i for _, i, _ in s}
    steps = sorted((n, int(abs(x - y) // 1), i, j) for n, i, x in s for m, j, y in s if n == m and i < j and abs(x - y) < 2500)
    apart = {(i, j) for n, i, _ in s for m, j, _ in s if n == m and j - i == 25}
    for _, _, i, j in steps:
        a, b = comp[i], comp[j]
        if a == b or any((min(p, q), max(p, q)) in apart for p in comp if comp[p] == a for q in comp if comp[q] == b):
            continue
        for k in comp:
            if comp[k] in (a, b):
                comp[k] = min(a, b)
    got = {r["id"]: r["component"] for r in catalog.QUERIES["constrained_resolution"](spark, SF).collect()}
    assert got == comp


def test_admission_signals(spark):
    def visible(page):
        found = re.search(r"(?is)<body\b[^>]*>(.*?)</body\s*>", page)
        t = found[1] if found else page
        for tag in ("script", "style", "noscript", "svg", "template"):
            t = re.sub(rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", " ", t)
        return re.sub(r"[ \t\n\x0b\f\r]+", " ", re.sub("<[^>]+>", " ", t)).strip(" ")

    rows = {r["page_id"]: r for r in catalog.QUERIES["admission_signals"](spark, SF).collect()}
    for p in spark.read.parquet(f"{SF}/pages.parquet").collect():
        t, r = visible(p["html"]), rows[p["page_id"]]
        assert all(r[k] == bool(re.search(v, t, re.I | re.A)) for k, v in rules.EVIDENCE_PATTERNS.items())
        assert r["weight"] == sum(w for _, term, w in rules.DISCIPLINE_TERMS if re.search(rf"(?<![a-z0-9]){term}(?![a-z0-9])", t.lower()))


def test_package_violations(spark):
    got = {(r["rule"], r["key"]) for r in catalog.QUERIES["package_flatten"](spark, SF).collect()}
    assert ("date-type", "timeline:msc-data/2026/opening") in got and ("unknown-source", "timeline:msc-data/2026/opening") in got and len(got) == 2


def test_merge_constraints(spark):
    rows = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id string")
    assert merge.merge_shards([rows("a"), rows("b")], rows("a", "b"), "id").count() == 2
    for shards, rule in (([rows("a"), rows("a", "b")], "duplicate"), ([rows("a")], "missing"), ([rows("a", "b", "c")], "unexpected")):
        with pytest.raises(merge.ConstraintError, match=rule):
            merge.merge_shards(shards, rows("a", "b"), "id")
    with pytest.raises(merge.ConstraintError, match="exhaustive"):
        merge.partition_by(rows("a", "b"), {"x": F.col("id") == "a", "y": F.col("id") == "a"})
    with pytest.raises(merge.ConstraintError, match="overlapping"):
        merge.attach_proposals(rows("a"), spark.createDataFrame([("g", ["a"]), ("h", ["a"])], "group string, members array<string>"), "id")
    for ids, rule in ((("b",), "0 rows"), (("a", "a"), "2 rows")):
        with pytest.raises(merge.ConstraintError, match=rule):
            merge.update_one(rows(*ids), "id", "a", F.lit(True), {})
    with pytest.raises(merge.ConstraintError, match="not as expected"):
        merge.update_one(rows("a"), "id", "a", F.lit(False), {})


def test_frontier_budget(spark):
    links = spark.createDataFrame([("g", 0, i) for i in range(1, 8)] + [("g", 1, 20), ("g", 20, 21), ("h", 0, 5)], "group string, src int, dst int")
    seeds = spark.createDataFrame([("g", 0), ("h", 9)], "group string, page int")
    got = {(r["group"], r["page"], r["depth"]) for r in merge.frontier(links, seeds, depth=2, pages=5).collect()}
    assert got == {("g", 0, 0), ("g", 1, 1), ("g", 2, 1), ("g", 3, 1), ("g", 4, 1), ("h", 9, 0)}
    deep = {(r["page"], r["depth"]) for r in merge.frontier(links, seeds, depth=3).where("group = 'g'").collect()}
    assert (21, 3) in deep and (20, 2) in deep


def test_free_suffixes(spark):
    rows = [("a", 1), ("a", 2), ("a", 3), ("a_2", 4), ("a_2", 5), ("b", 6), ("a_2_2", 7)]
    got = {r["n"]: r["id"] for r in dedup.disambiguate(spark.createDataFrame(rows, "id string, n int"), "id", [F.col("n")]).collect()}
    assert got == {1: "a", 2: "a_3", 3: "a_4", 4: "a_2", 5: "a_2_3", 6: "b", 7: "a_2_2"}


def test_most_alike_and_overlaps(spark):
    import random

    r = random.Random(3)
    sets = {i: {min(int(r.expovariate(0.15)), 40) for _ in range(r.randint(1, 12))} for i in range(60)}
    other = {i: {min(int(r.expovariate(0.15)), 40) for _ in range(r.randint(1, 12))} for i in range(25)}
    rows = lambda s: spark.createDataFrame([(o, m) for o, ms in s.items() for m in ms] + [(0, next(iter(s[0])))], "o int, m int")
    got = {x["a"]: (x["b"], x["shared"], x["every"]) for x in joins.most_alike(rows(other), rows(sets)).collect()}
    for a, x in other.items():
        score, b = max((len(x & y) / len(x | y), -i) for i, y in sets.items())
        assert score == 0 and a not in got or got[a] == (-b, len(x & sets[-b]), len(x | sets[-b]))
    for least in (1, 3):
        pairs = {(x["a"], x["b"], x["shared"]) for x in joins.overlaps(rows(sets), "o", "m", least).collect()}
        assert pairs == {(i, j, len(sets[i] & sets[j])) for i in sets for j in sets if i < j and len(sets[i] & sets[j]) >= least}


def test_overlaps_count_in_blocks(spark):
    import random

    r = random.Random(4)
    sets = {i: {min(int(r.expovariate(0.15)), 40) for _ in range(r.randint(1, 25))} | set(range(50, 50 + i % 6)) for i in range(80)}
    rows = spark.createDataFrame([(o, m) for o, ms in sets.items() for m in ms] + [(0, next(iter(sets[0]))), (None, 1), (1, None)], "o long, m long")
    for least, often in ((1, 6), (3, 30), (6, 0), (6, 1000)):
        true = {(i, j, len(sets[i] & sets[j])) for i in sets for j in sets if i < j and len(sets[i] & sets[j]) >= least}
        got = [(x["a"], x["b"], x["shared"]) for x in joins.overlaps(rows, "o", "m", least, 40, often).collect()]
        assert len(got) == len(true) and set(got) == true
    plan = joins.overlaps(rows, "o", "m", 3)._jdf.queryExecution().toString()
    assert "Join" not in plan  # no set is sent along with a pair


def test_overlaps_count_nan_as_a_value(spark):
    nan = float("nan")
    rows = spark.createDataFrame([(o, m) for o in (1.0, 2.0, nan) for m in (3.0, nan, nan)] + [(None, 3.0), (5.0, None)], "o double, m double")
    for often in (0, 1000):
        got = sorted((str(x["a"]), str(x["b"]), x["shared"]) for x in joins.overlaps(rows, "o", "m", 2, often=often).collect())
        assert got == [("1.0", "2.0", 2), ("1.0", "nan", 2), ("2.0", "nan", 2)]


def test_registry_score_with_sequence(spark):
    row = spark.range(1).select(ladders.registry_score(F.lit(False), F.lit(True), F.lit(0.9), F.lit(1.0), F.lit(True), F.lit(True)).alias("x")).first()["x"]
    assert row["score"] == round(0.38 + 0.22 * 0.9 + 0.16 + 0.08 + 0.02, 4) and row["confidence"] == "review"
