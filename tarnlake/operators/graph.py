"""Graph steps: connected components, alias chains, walks to a stop set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlake.operators.storage import drop_stash, side, stash


def components(edges: DataFrame, label: str, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component_id) of every id that an edge links to another; component_id is the smallest id reachable.

    Alternating large-star and small-star rounds until the edge set stays as it is. Each round is a few
    aggregations over the edges with map-side minima, so a hub with any number of edges is never gathered in
    one task, and each round's edges are written to the shared folder.
    """
    now = stash(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), label)
    seen = None
    while True:
        n, total = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if (n, total) == seen:
            break
        seen = (n, total)
        both = now.select("u", "v").union(now.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # Large star: every larger neighbour of u is linked to u's smallest neighbour.
        large = now.join(side(least.withColumnRenamed("u", "k"), 2 * n), F.col("v") == F.col("k")).select("u", F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        # Small star: u and its smaller neighbours are linked to the smallest of them.
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(side(small_least, n), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(small_least.select("u", F.col("m")))
        after = stash(small.toDF("u", "v").where("u <> v").distinct(), label)
        drop_stash(now)
        now = after
    stars = now.groupBy("u").agg(F.min("v").alias("v")).union(now.select("v", F.col("v")).distinct())
    return stars.toDF("id", "component_id")


def flatten_chains(edges: DataFrame, label: str = "chains") -> DataFrame:
    """(id, root) for rows (id, next): pointers are followed to the id without a next, doubling the reach each round.

    An id on a cycle, or leading into one, has the cycle's smallest id as root. Null pointers and pointers to
    unknown ids end a chain; repeated rows of an id count once, with the smallest pointer.
    """
    once = stash(edges.groupBy("id").agg(F.min("next").alias("next")), label)
    ends = F.col("next").isNull() | (F.col("next") == F.col("id"))
    now = stash(once.select("id", F.coalesce("next", "id").alias("to"), ends.alias("done")), label)
    n, reach = now.count(), 1
    while reach <= n and not now.where("NOT done").isEmpty():
        there = now.select(F.col("id").alias("_k"), F.col("to").alias("_to"), F.col("done").alias("_done"))
        step = now.join(there, F.col("to") == F.col("_k"), "left")
        after = stash(step.select("id", F.coalesce("_to", "to").alias("to"), (F.col("done") | F.coalesce("_done", F.lit(True))).alias("done")), label)
        drop_stash(now)
        now, reach = after, 2 * reach
    # What is left has reached a cycle: the cycles are components of the pointers among the ids reached.
    on_cycle = now.where("NOT done").select(F.col("to").alias("id")).distinct()
    loops = components(once.join(on_cycle, "id").select(F.col("id").alias("a"), F.col("next").alias("b")), label)
    loops = loops.select(F.col("id").alias("_on"), F.col("component_id").alias("_loop"))
    return now.join(loops, ~F.col("done") & (F.col("to") == F.col("_on")), "left").select("id", F.coalesce("_loop", "to").alias("root"))
