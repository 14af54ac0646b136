"""Sectioned package texts as tables (projects, cycles, timelines, requirements, fees, sources, reviews), with constraints."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The identifiers' grammar, kinds of dates, and how many ids each section's header has.
IDENTIFIER = "^[a-z0-9]+(?:[_-][a-z0-9]+)*$"
DATE_TYPES = ("exact", "month", "range", "rolling", "tba", "unknown")
SECTION_IDS = {"manifest": 0, "source": 1, "project": 1, "cycle": 2, "timeline": 3, "requirements": 2, "fee": 3, "review": 1}
AMOUNT = r"^(unknown|\d+(\.\d+)?)$"

EXAMPLE = """[manifest]
schema_version = 1
university = u_demo
[source home]
url = https://demo.example.org/
[project msc-data]
name = Data Science
source_id = home
[cycle msc-data 2026]
current = true
[timeline msc-data 2026 deadline]
date_type = exact
date = 2026-05-31
source_id = home
[timeline msc-data 2026 opening]
date_type = someday
source_id = nowhere
[fee msc-data 2026 tuition]
amount = 1500.00
"""


def tables(found: DataFrame) -> dict[str, DataFrame]:
    """One table per kind of section: file, ids and a map of values. found: rows of sections()."""
    rows = found.groupBy("file", "kind", "ids").agg(F.min("line").alias("line"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("v"))
    return {kind: rows.where(F.col("kind") == kind).drop("kind") for kind in SECTION_IDS}


def violations(t: dict[str, DataFrame]) -> DataFrame:
    """(rule, key, detail) for all that a package may not have."""
    name = F.array_join("ids", "/")

    def bad(kind, rule, wrong, detail):
        return t[kind].where(wrong).select(F.lit(rule).alias("rule"), F.concat(F.lit(f"{kind}:"), name).alias("key"), detail.cast("string").alias("detail"))

    v = F.col("v")
    out = [bad(kind, "header", (F.size("ids") != n) | F.exists("ids", lambda i: ~i.rlike(IDENTIFIER)), name) for kind, n in SECTION_IDS.items()]
    out.append(bad("manifest", "schema-version", F.coalesce(v["schema_version"] != "1", F.lit(True)), v["schema_version"]))
    out.append(bad("timeline", "date-type", ~F.coalesce(v["date_type"].isin(*DATE_TYPES), F.lit(False)), v["date_type"]))
    exact = v["date_type"] == "exact"
    out.append(bad("timeline", "date", exact & F.try_to_date(v["date"], "yyyy-MM-dd").isNull(), v["date"]))
    out.append(bad("timeline", "range", (v["date_type"] == "range") & ~F.coalesce(v["date_end"] >= v["date"], F.lit(False)), v["date_end"]))
    out.append(bad("fee", "amount", ~F.coalesce(v["amount"].rlike(AMOUNT), F.lit(False)), v["amount"]))
    sources = t["source"].select("file", F.col("ids")[0].alias("source_id"))
    for kind in ("project", "cycle", "timeline", "requirements", "fee"):
        named = t[kind].withColumn("source_id", v["source_id"]).where("source_id IS NOT NULL").join(sources, ["file", "source_id"], "left_anti")
        out.append(named.select(F.lit("unknown-source").alias("rule"), F.concat(F.lit(f"{kind}:"), name).alias("key"), F.col("source_id").alias("detail")))
    projects = t["project"].select("file", F.col("ids")[0].alias("p"))
    out.append(t["cycle"].withColumn("p", F.col("ids")[0]).join(projects, ["file", "p"], "left_anti").select(F.lit("unknown-project"), F.concat(F.lit("cycle:"), name), F.col("p")))
    current = t["cycle"].where(v["current"] == "true").groupBy("file", F.col("ids")[0].alias("p")).count().where("count > 1")
    out.append(current.select(F.lit("several-current-cycles"), F.concat(F.lit("project:"), F.col("p")), F.col("count").cast("string")))
    return reduce(DataFrame.union, out)
