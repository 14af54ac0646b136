"""Coverage by evidence: of programmes and institutions, direct or shared, by board, and what follows for queues.

programs: entity, program and one boolean for each category of direct evidence.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnlake.operators.evidence import best_status

ESSENTIAL = ("requirements", "deadline", "documents")
BUNDLE = "essentialBundle"


def shared_by_entity(programs: DataFrame, entity: str, shared: DataFrame, categories: list[str]) -> DataFrame:
    """programs with shared_<category>: what pages of the whole institution prove. shared: entity and one boolean per category, any number of rows."""
    s = shared.groupBy(F.col(entity).alias("_e")).agg(*(F.bool_or(c).alias(f"shared_{c}") for c in categories))
    out = programs.join(s, programs[entity] == s["_e"], "left").drop("_e")
    return out.withColumns({f"shared_{c}": F.coalesce(f"shared_{c}", F.lit(False)) for c in categories})


def by_mode(programs: DataFrame, entity: str, categories: list[str], essential: list[str]) -> DataFrame:
    """(entity, mode, category, programs, covered, rate, any, full) for both modes, direct and includingShared, and the bundle of the essential categories."""
    has = lambda c, mode: F.col(c) if mode == "direct" else F.col(c) | F.col(f"shared_{c}")
    flags = [F.struct(F.lit(m).alias("mode"), F.lit(c).alias("category"), has(c, m).alias("has")) for m in ("direct", "includingShared") for c in categories]
    flags += [F.struct(F.lit(m).alias("mode"), F.lit(BUNDLE).alias("category"), reduce(lambda a, b: a & b, (has(c, m) for c in essential)).alias("has")) for m in ("direct", "includingShared")]
    each = programs.select(entity, F.explode(F.array(*flags)).alias("x")).select(entity, "x.*")
    n, c = F.count("*"), F.count_if("has")
    return each.groupBy(entity, "mode", "category").agg(n.alias("programs"), c.alias("covered"), F.bround(c / n, 4).alias("rate"), F.bool_or("has").alias("any"), F.bool_and("has").alias("full"))


def by_source(entities: DataFrame, entity: str, sources: DataFrame) -> DataFrame:
    """(source, mode, category, programs, covered, any, full): by_mode() rows added up for each board; an institution counts once on every board it is on. sources: entity, source."""
    on = sources.select(F.col(entity), "source").distinct()
    rows = entities.join(on, entity).groupBy("source", "mode", "category")
    return rows.agg(F.sum("programs").alias("programs"), F.sum("covered").alias("covered"), F.count_if("any").alias("any"), F.count_if("full").alias("full"))


def priority(entities: DataFrame, entity: str, rates: list[str]) -> DataFrame:
    """entities with mean_rate, the plain mean of the rates (null counts 0)."""
    total = reduce(lambda a, b: a + b, (F.coalesce(r, F.lit(0.0)) for r in rates))
    return entities.withColumn("mean_rate", total / len(rates))


def merged_observations(rows: DataFrame, keys: list[str], sets: list[str], score: str, group: str) -> DataFrame:
    """One row per key: sets of values (sorted), the highest score, the groups but `none`, how many rows."""
    united = [F.array_sort(F.collect_set(c)).alias(c) for c in sets]
    return rows.groupBy(*keys).agg(*united, F.max(score).alias(score), F.array_sort(F.collect_set(F.when(F.col(group) != "none", F.col(group)))).alias("groups"), F.count("*").alias("n"))


def scope_summary(programs: DataFrame, scope: str, status: str, precedence: dict[str, int], categories: list[str]) -> DataFrame:
    """Per scope: programmes (best status of each), captured ones, how many have each category, and how many all."""
    best = best_status(programs.select(scope, "entity", "program", status), [scope, "entity", "program"], status, precedence)
    flags = programs.groupBy(scope, "entity", "program").agg(*(F.bool_or(c).alias(c) for c in categories))
    both = best.join(flags, [scope, "entity", "program"])
    every = reduce(lambda a, b: a & b, (F.col(c) for c in categories))
    return both.groupBy(scope).agg(F.count("*").alias("programs"), F.count_if(F.col(status) == "captured").alias("captured"), *(F.count_if(c).alias(c) for c in categories), F.count_if(every).alias("complete"))


def gaps(programs: DataFrame, entity: str, categories: list[str], order: list[Column]) -> DataFrame:
    """Programmes that lack something, with the categories they lack in order."""
    lacks = F.array_compact(F.array(*(F.when(~F.col(c), F.lit(c)) for c in categories)))
    return programs.withColumn("missing", lacks).where("size(missing) > 0").orderBy(*order)
