"""Data-quality constraints as rows of violations(rule, key, detail)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def failing(df: DataFrame, rule: str, key: str, good: Column, detail: str) -> DataFrame:
    """Rows for which `good` is not true."""
    return df.where(~F.coalesce(good, F.lit(False))).select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("key"), F.col(detail).cast("string").alias("detail"))


def orphans(df: DataFrame, rule: str, key: str, reference: str, parents: DataFrame, parent: str) -> DataFrame:
    p = parents.select(F.col(parent).alias("_p")).distinct()
    return df.join(p, F.col(reference) == F.col("_p"), "left_anti").select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("key"), F.col(reference).cast("string").alias("detail"))


def duplicates(df: DataFrame, rule: str, key: str) -> DataFrame:
    return df.groupBy(key).count().where("count > 1").select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("key"), F.col("count").cast("string").alias("detail"))


def summary(violations: list[DataFrame]) -> DataFrame:
    every = violations[0]
    for v in violations[1:]:
        every = every.union(v)
    return every.groupBy("rule").agg(F.count("*").alias("violations"), F.min("key").alias("first_key"))


# Hosts that official urls never have, hosts that institutions share by right, groups of applicants.
AGGREGATORS = ("mastersportal", "studyportals", "findamasters", "topuniversities", "wikipedia")
SHARED_HOSTS = ("dauphine.psl.eu",)
APPLICANT_GROUPS = ("EU", "Non-EU", "All", "Unknown")


def status_sums(rows: DataFrame, status: str, known: list[str], summary: DataFrame) -> DataFrame:
    """(status, rows, said, ok): counts of each status against a summary (status, n); statuses that are not known, or differ, are not ok."""
    mine = rows.groupBy(F.col(status).alias("status")).agg(F.count("*").alias("rows"))
    said = summary.groupBy(F.col("status").alias("_s")).agg(F.sum("n").alias("said"))
    both = mine.join(said, F.col("status") == F.col("_s"), "full").select(F.coalesce("status", "_s").alias("status"), F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("said", F.lit(0)).alias("said"))
    return both.withColumn("ok", (F.col("rows") == F.col("said")) & F.coalesce(F.col("status").isin(*known), F.lit(False)))


def url_audit(urls: DataFrame) -> DataFrame:
    """One row per kind of url: how many, not by http, of aggregators, repeated, and shared by several owners (those of hosts that may be shared apart). urls: kind, owner, url."""
    u = F.col("url")
    host = F.lower(F.regexp_extract(u, "^[a-z]+://([^/]*)", 1))
    flags = urls.groupBy("kind").agg(
        F.count("*").alias("urls"), F.count_if(~F.coalesce(F.startswith(u, F.lit("http")), F.lit(False))).alias("not_http"), F.count_if(F.coalesce(u.rlike("|".join(AGGREGATORS)), F.lit(False))).alias("aggregator"),
    )
    each = urls.where("url <> ''").groupBy("kind", "url").agg(F.count("*").alias("n"), (F.min("owner") != F.max("owner")).alias("several"), F.first(host).isin(*SHARED_HOSTS).alias("may"))
    per = each.groupBy("kind").agg(F.count_if(F.col("n") > 1).alias("repeated"), F.count_if(F.col("several") & ~F.col("may")).alias("collisions"), F.count_if(F.col("several") & F.col("may")).alias("shared"))
    return flags.join(per, "kind", "left").na.fill(0, ["repeated", "collisions", "shared"])


def deadline_audit(lists: DataFrame, columns: list[str], as_of: Column) -> DataFrame:
    """One row: entries of all lists of deadlines, those that are no ISO dates, past, or of an unknown group, and how many of each group. Items: struct with date and applicantGroup."""
    every = lists.select(F.explode(F.concat(*(F.coalesce(c, F.array().cast(lists.schema[c].dataType)) for c in columns))).alias("x")).select("x.*")
    day = F.when(F.col("date").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date("date", "yyyy-MM-dd"))
    group = F.coalesce("applicantGroup", F.lit("Unknown"))
    good = day.isNotNull()
    return every.agg(
        F.count("*").alias("entries"), F.count_if(~good).alias("not_iso"), F.count_if(good & (day < as_of)).alias("past"), F.count_if(good & ~group.isin(*APPLICANT_GROUPS)).alias("bad_group"),
        *(F.count_if(good & (group == g)).alias(f"group_{g.lower().replace('-', '_')}") for g in APPLICANT_GROUPS),
    )


def consistency(detail: DataFrame, measures: dict[str, Column], summary: DataFrame) -> DataFrame:
    """(measure, computed, said, ok): aggregates of the detail against the one row of the summary."""
    got = detail.agg(*(c.cast("long").alias(k) for k, c in measures.items())).unpivot([], list(measures), "measure", "computed")
    said = summary.select(*(F.col(k).cast("long").alias(k) for k in measures)).unpivot([], list(measures), "_m", "said")
    return got.join(said, F.col("measure") == F.col("_m"), "left").select("measure", "computed", "said", F.coalesce(F.col("computed") == F.col("said"), F.lit(False)).alias("ok"))


def inventory(files: DataFrame, references: DataFrame) -> DataFrame:
    """(state, n): referenced files that are there with the digest given, with another one, or missing, and files that nothing refers to. files: path, sha256. references: path, sha256 (null: not given)."""
    f, r = files.select("path", F.col("sha256").alias("_is")), references.select("path", F.col("sha256").alias("_said")).distinct()
    both = f.withColumn("_f", F.lit(True)).join(r.withColumn("_r", F.lit(True)), "path", "full")
    state = F.when(F.col("_f").isNull(), "missing").when(F.col("_r").isNull(), "unreferenced").when(F.col("_said").isNull() | (F.col("_said") == F.col("_is")), "verified").otherwise("mismatched")
    return both.groupBy(state.alias("state")).agg(F.count("*").alias("n"))


def queue_audit(tasks: DataFrame, manifests: DataFrame) -> DataFrame:
    """(country, kind, status, tasks, with_manifest, missing_manifest, hash_checked, hash_matched). tasks: country, kind, status, manifest (null: none), sha256. manifests: manifest, sha256."""
    m = manifests.select(F.col("manifest").alias("_m"), F.col("sha256").alias("_said"))
    both = tasks.join(m, tasks["manifest"] == F.col("_m"), "left")
    there = F.col("_m").isNotNull()
    checked = there & F.col("_said").isNotNull() & F.col("sha256").isNotNull()
    return both.groupBy("country", "kind", "status").agg(
        F.count("*").alias("tasks"), F.count_if(there).alias("with_manifest"), F.count_if(~there & F.col("manifest").isNotNull()).alias("missing_manifest"), F.count_if(checked).alias("hash_checked"), F.count_if(checked & (F.col("sha256") == F.col("_said"))).alias("hash_matched"),
    )


def scope_check(appearances: DataFrame, per_source: int) -> DataFrame:
    """(source, rows, ids, ok): rows and distinct ids of each board against the number expected."""
    return appearances.groupBy("source").agg(F.count("*").alias("rows"), F.count_distinct("id").alias("ids"), (F.count("*") == per_source).alias("ok"))


def manifest_coverage(targets: DataFrame, pages: DataFrame, key: str, kinds: list[str], statuses: list[str]) -> DataFrame:
    """One row per target: whether it has a manifest (any page), its candidates, and pages by kind and status (other kinds as `other`). pages: key, kind, status, candidate."""
    kind = F.when(F.col("kind").isin(*kinds), F.col("kind")).otherwise("other")
    counts = [F.count_if((kind == k) & (F.col("status") == s)).alias(f"{k}_{s}") for k in [*kinds, "other"] for s in statuses]
    per = pages.groupBy(F.col(key).alias("_k")).agg(F.count_if("candidate").alias("candidates"), *counts)
    names = [c for c in per.columns if c != "_k"]
    out = targets.join(per, targets[key] == per["_k"], "left").withColumn("manifest", F.when(F.col("_k").isNull(), "missing").otherwise("found")).drop("_k")
    return out.na.fill(0, names)


def pages_complete(pages: DataFrame, key: str) -> DataFrame:
    """(key, strict, closed): strict if all pages are captured, closed if none is left to be tried again."""
    return pages.groupBy(key).agg(F.bool_and(F.col("outcome") == "captured").alias("strict"), (F.count_if(F.col("outcome").isin("pending", "retryableError")) == 0).alias("closed"))


def store_gate(programs: DataFrame, institutions: DataFrame, reason: Column, official: Column, as_of: Column) -> list[DataFrame]:
    """The rules that a store of programmes must keep, as violations: unknown institution, no programme by title, url off the institution's domains, deadlines that are no ISO dates or past, repeated ids, no detail.

    programs: id, university_id, title, url, deadlines (array of text), details (number of them). institutions: id. official: whether the url is on the institution's domains.
    """
    p = programs.withColumn("_bad", F.filter("deadlines", lambda d: F.when(d.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(d, "yyyy-MM-dd")).isNull()))
    past = F.exists("deadlines", lambda d: F.coalesce(F.try_to_date(d, "yyyy-MM-dd") < as_of, F.lit(False)))
    named = p.withColumn("_reason", reason)
    return [
        orphans(p, "orphan", "id", "university_id", institutions, "id"),
        failing(named, "non-program", "id", F.col("_reason") == "", "_reason"),
        failing(p, "domain-mismatch", "id", official, "url"),
        failing(p, "non-iso-deadline", "id", F.size("_bad") == 0, "title"),
        failing(p, "past-deadline", "id", ~past, "title"),
        failing(p, "warning-no-detail", "id", F.col("details") > 0, "title"),
        duplicates(p, "duplicate-id", "id"),
    ]


def rankings_check(rows: DataFrame, expected: int) -> DataFrame:
    """(source, rows, missing_ids, shared_ranks, ok): as many rows as expected and no row without an id; ranks that several share are told, not wrong."""
    per = rows.groupBy("source", "rank").agg(F.count("*").alias("n"), F.count_if(F.coalesce("id", F.lit("")) == "").alias("m"))
    return per.groupBy("source").agg(F.sum("n").alias("rows"), F.sum("m").alias("missing_ids"), F.count_if(F.col("n") > 1).alias("shared_ranks"), ((F.sum("n") == expected) & (F.sum("m") == 0)).alias("ok"))


def dedup_check(boards: DataFrame, goal: DataFrame, key: str) -> DataFrame:
    """One row: rows and distinct keys of all boards, keys on several, and the keys that only the boards or only the goal have."""
    per = boards.groupBy(key).agg(F.count_distinct("source").alias("s"), F.count("*").alias("n"))
    g = goal.select(key).distinct().withColumn("_g", F.lit(True))
    both = per.withColumn("_b", F.lit(True)).join(g, key, "full")
    return both.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count("_b").alias("keys"), F.count_if(F.col("s") > 1).alias("on_several"), F.count_if(F.col("_g").isNull()).alias("only_boards"), F.count_if(F.col("_b").isNull()).alias("only_goal"),
    )
