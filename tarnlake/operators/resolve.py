"""Resolving labels to canonical entities."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlake.functions.scores import sequence_ratio
from tarnlake.operators.storage import stash


_BINS = 32


def _letter_bins(name: str):
    """How many characters of the name fall into each of some bins."""
    at = F.transform(F.split(name, ""), lambda c: F.pmod(F.ascii(c), F.lit(_BINS)))
    return F.aggregate(F.filter(at, lambda i: i.isNotNull()), F.array_repeat(F.lit(0), _BINS), lambda acc, i: F.transform(acc, lambda v, k: F.when(k == i, v + 1).otherwise(v)))


def fuzzy_pairs(df: DataFrame, block: str, key: str, name: str, least: float = 0.9, shortest: int = 5) -> DataFrame:
    """(block, a, b, ratio): rows of one block whose names are at least that alike, a before b.

    Distinct names are compared once. What two names have in common is at most what they have of each letter, bin by bin: pairs whose lengths
    or bins cannot reach the ratio (2 * common / total length) are left out before Python sees them. The work is quadratic in the names of a block.
    """
    rows = df.where(F.length(name) >= shortest).select(F.col(block).alias("_block"), F.col(key).alias("_key"), F.col(name).alias("x"))
    names = stash(rows.select("_block", "x").distinct().withColumn("n", F.length("x")).withColumn("bx", _letter_bins("x")), "names")
    other = names.select(F.col("_block").alias("_b"), F.col("x").alias("y"), F.col("n").alias("m"), F.col("bx").alias("by"))
    met = names.join(other, (F.col("_block") == F.col("_b")) & (F.col("x") != F.col("y"))).where(2 * F.least("n", "m") >= least * (F.col("n") + F.col("m")))
    common = F.aggregate(F.zip_with("bx", "by", lambda p, q: F.least(p, q)), F.lit(0), lambda acc, v: acc + v)
    likely = met.where(2 * common >= least * (F.col("n") + F.col("m"))).select("_block", "x", "y")
    alike = likely.select("_block", "x", "y", sequence_ratio("x", "y").alias("ratio")).where(F.col("ratio") >= least)
    same = names.select("_block", "x", F.col("x").alias("y"), F.lit(1.0).alias("ratio"))
    pairs = stash(alike.union(same), "alike-names")
    out = pairs.join(rows.withColumnRenamed("_key", "a"), ["_block", "x"]).join(rows.select("_block", F.col("_key").alias("b"), F.col("x").alias("y")), ["_block", "y"])
    return out.where("a < b").select(F.col("_block").alias(block), "a", "b", "ratio")


def constrained_components(rows: DataFrame, merges: DataFrame, protected: DataFrame, block: str) -> DataFrame:
    """(block, id, component): ids of each block joined by merges in their order, but never two ids of a protected pair.

    rows: block, id. merges: block, a, b, step. protected: block, a, b. A merge that would bring the two ids of a
    protected pair into one component is refused. The order matters, so a block is worked through by one task, which holds the
    block's ids, merges and pairs; blocks (a country, say) are independent.
    """
    tagged = rows.select(block, F.lit(0).alias("kind"), F.col("id").alias("a"), F.col("id").alias("b"), F.lit(0).cast("long").alias("step"))
    tagged = tagged.union(merges.select(block, F.lit(1), "a", "b", F.col("step").cast("long"))).union(protected.select(block, F.lit(2), "a", "b", F.lit(0).cast("long")))
    kind = rows.schema["id"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = sorted(set(pdf.loc[pdf["kind"] == 0, "a"]))
        members = {i: {i} for i in ids}
        at = {i: i for i in ids}
        apart: dict = {}
        for a, b in pdf.loc[pdf["kind"] == 2, ["a", "b"]].itertuples(index=False):
            apart.setdefault(a, set()).add(b)
            apart.setdefault(b, set()).add(a)
        for a, b in pdf[pdf["kind"] == 1].sort_values(["step", "a", "b"])[["a", "b"]].itertuples(index=False):
            if a not in at or b not in at or at[a] == at[b]:
                continue
            x, y = sorted((at[a], at[b]))
            if any(apart.get(i, set()) & members[y] for i in members[x]):
                continue
            for i in members[y]:
                at[i] = x
            members[x] |= members.pop(y)
        return pd.DataFrame({block: [pdf[block].iloc[0]] * len(ids), "id": ids, "component": [at[i] for i in ids]})

    return tagged.groupBy(block).applyInPandas(run, f"{block} {rows.schema[block].dataType.simpleString()}, id {kind}, component {kind}")


def canonical(df: DataFrame, entity: str, label: str, order: str) -> DataFrame:
    """The most frequent label of each entity, the earliest of equally frequent ones."""
    counts = df.groupBy(entity, label).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return counts.groupBy(entity).agg(F.min_by(label, F.struct(-F.col("n"), F.col("first"))).alias(label))


def canonical_id(members: DataFrame, entity: str, member: str, overrides: DataFrame, roots: DataFrame, manual: DataFrame, order: str) -> DataFrame:
    """(entity, canonical): an override among the members, else an alias root, else a member of a reviewed group, else the earliest of the most frequent.

    overrides, roots, manual: one column named as member. members: entity, member and order, one row for each appearance.
    """
    at = members.groupBy(entity, member).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    for i, side in enumerate((overrides, roots, manual)):
        at = at.join(side.select(F.col(member)).distinct().withColumn(f"_{i}", F.lit(0)), member, "left")
    place = F.struct(*(F.coalesce(f"_{i}", F.lit(1)) for i in range(3)), -F.col("n"), F.col("first"), F.col(member))
    return at.groupBy(entity).agg(F.min_by(member, place).alias("canonical"))


def relationship_conflicts(groups: DataFrame) -> DataFrame:
    """(a, b): pairs of members, a < b, that one relationship merges and another keeps apart. groups: members (array), merge (boolean)."""
    ids = groups.select("merge", F.array_sort(F.array_distinct("members")).alias("m"))
    pairs = ids.select("merge", F.posexplode("m").alias("i", "a"), "m").select("merge", "a", F.explode(F.slice("m", F.col("i") + 2, F.size("m"))).alias("b"))
    return pairs.groupBy("a", "b").agg(F.bool_or("merge").alias("x"), F.bool_or(~F.col("merge")).alias("y")).where("x AND y").select("a", "b")
