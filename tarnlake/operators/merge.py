"""Merging pools, shards and queues, with the constraints that make a merge an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnlake.operators.dedup import keep_best
from tarnlake.operators.storage import stash


class ConstraintError(ValueError):
    """A merge that may not be: the rule and some of the keys that break it."""


def require(df: DataFrame, rule: str, key: str) -> None:
    """Raises if there are rows; names up to five keys."""
    bad = [r[0] for r in df.select(key).limit(5).collect()]
    if bad:
        raise ConstraintError(f"{rule}: {', '.join(map(str, bad))}")


def set_differences(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(side, key) of keys that only one side has; no rows if the sets are equal."""
    l, r = left.select(key).distinct(), right.select(key).distinct()
    only = lambda a, b, side: a.join(b, key, "left_anti").select(F.lit(side).alias("side"), F.col(key).cast("string").alias("key"))
    return only(l, r, "left").union(only(r, l, "right"))


def seeded(seed: DataFrame, crawled: DataFrame, ids: str, keys: list[str], order: list[Column]) -> DataFrame:
    """All of seed, then the rows of crawled whose id and key are new: neither seed's nor of a crawled row before.

    A row before takes its id and its key at once; as ids are made of keys, the first of each id and then of each key is the same.
    """
    new = crawled.join(seed.select(ids).distinct(), ids, "left_anti").join(seed.select(*keys).distinct(), keys, "left_anti")
    first = keep_best(keep_best(new, [ids], order), keys, order)
    return seed.unionByName(first.select(*seed.columns))


def merge_pools(base: DataFrame, pool: DataFrame, keys: list[str], order: list[Column], deadlines: Column, new_deadlines: Column) -> DataFrame:
    """base with the pool's rows: the first of each key counts; verified ones stay; others are replaced by reviewed rows or ones with more deadlines, keeping their id; unknown keys are added.

    base: id, verified and the columns of pool. pool: reviewed, too. action: kept, replaced or added. New rows have no id yet.
    """
    first = keep_best(pool, keys, order)
    fields = [c for c in base.columns if c not in ("id", "verified", *keys)]
    f = first.select(*keys, *(F.col(c).alias(f"_{c}") for c in fields), F.col("reviewed").alias("_reviewed"), new_deadlines.alias("_theirs"), F.lit(True).alias("_new"))
    both = base.withColumns({"_ours": deadlines, "_old": F.lit(True)}).join(f, keys, "full")
    replaced = F.coalesce(F.col("_old") & ~F.col("verified") & F.col("_new") & (F.col("_reviewed") | (F.col("_theirs") > F.col("_ours"))), F.lit(False))
    action = F.when(F.col("_old").isNull(), "added").when(replaced, "replaced").otherwise("kept")
    taken = [F.when(action == "kept", F.col(c)).otherwise(F.col(f"_{c}")).alias(c) for c in fields]
    return both.select("id", *keys, F.coalesce("verified", F.lit(False)).alias("verified"), *taken, action.alias("action"))


def partition_by(df: DataFrame, parts: dict[str, Column]) -> dict[str, DataFrame]:
    """df in parts, each row in exactly one of them: in several or none is an error, found by one pass."""
    n = df.agg(F.count("*").alias("n"), *(F.count_if(c).alias(k) for k, c in parts.items()), F.count_if(sum((F.coalesce(c, F.lit(False)).cast("int") for c in parts.values()), F.lit(0)) != 1).alias("bad")).first()
    if n["bad"]:
        raise ConstraintError(f"queue partition is not exhaustive: {n['bad']} of {n['n']} rows")
    return {k: df.where(c) for k, c in parts.items()}


def merge_shards(shards: list[DataFrame], expected: DataFrame, key: str) -> DataFrame:
    """The shards' rows; keys that occur twice, are missing or not expected are an error."""
    every = shards[0]
    for s in shards[1:]:
        every = every.unionByName(s)
    every = stash(every, "shards")
    require(every.groupBy(key).count().where("count > 1"), "duplicate record across shards", key)
    only = stash(set_differences(every, expected, key), "shard-keys")
    require(only.where("side = 'right'"), "missing records", "key")
    require(only.where("side = 'left'"), "unexpected records", "key")
    return every


def merge_fields(pages: DataFrame, key: str, order: str, lists: dict[str, Column], scalars: list[str], source: str) -> DataFrame:
    """One row per key of what its pages say: lists united in order of the pages (lists: the column and what its items are told apart by), the first value of each scalar, and for each field the pages that gave something.

    Bounded by what one key's pages say.
    """
    packed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.col(source).alias("_s"), *lists, *scalars)))
    one = pages.groupBy(key).agg(packed.alias("p"))

    def united(c: str, by) -> list[Column]:
        empty = F.array().cast(pages.schema[c].dataType)
        flat = F.flatten(F.transform("p", lambda x: F.coalesce(x[c], empty)))
        first = F.aggregate(flat, empty, lambda acc, v: F.when(F.exists(acc, lambda a: by(a) == by(v)), acc).otherwise(F.array_append(acc, v)))
        return [first.alias(c), F.transform(F.filter("p", lambda x: F.coalesce(F.size(x[c]) > 0, F.lit(False))), lambda x: x["_s"]).alias(f"{c}_sources")]

    def given(c: str) -> Column:
        known = F.filter("p", lambda x: F.coalesce(x[c].cast("string") != "", F.lit(False)))
        return F.try_element_at(F.transform(known, lambda x: x[c]), F.lit(1)).alias(c)

    return one.select(key, *(x for c, by in lists.items() for x in united(c, by)), *map(given, scalars))


def last_writer(files: list[DataFrame], key: str) -> DataFrame:
    """One row per key: of the last file that has it, in the order in which keys were first seen (column first_file)."""
    every = None
    for i, f in enumerate(files):
        f = f.withColumn("_f", F.lit(i))
        every = f if every is None else every.unionByName(f)
    values = [c for c in every.columns if c not in (key, "_f")]
    one = every.groupBy(key).agg(F.max_by(F.struct(*values), F.struct("_f", *values)).alias("_v"), F.min("_f").alias("first_file"))
    return one.select(key, *(F.col("_v")[v].alias(v) for v in values), "first_file")


def attach_proposals(queue: DataFrame, proposals: DataFrame, key: str) -> DataFrame:
    """queue with the group that a proposal would put each key in, binding nothing; a key in two proposals is an error. proposals: group, members (array)."""
    each = stash(proposals.select(F.col("group").alias("proposal_group"), F.explode(F.array_distinct("members")).alias(key)), "proposals")
    require(each.groupBy(key).count().where("count > 1"), "overlapping alias proposal", key)
    return queue.join(each, key, "left").withColumn("binding", F.when(F.col("proposal_group").isNotNull(), F.lit(False)))


def update_one(queue: DataFrame, key: str, value, expected: Column, changes: dict[str, Column]) -> DataFrame:
    """queue with changes to the one row of that key; none, several, or a row that is not as expected (its hash, say) is an error."""
    n = queue.where(F.col(key) == value).agg(F.count("*").alias("n"), F.count_if(expected).alias("good")).first()
    if n["n"] != 1:
        raise ConstraintError(f"{key} {value}: {n['n']} rows")
    if n["good"] != 1:
        raise ConstraintError(f"{key} {value}: not as expected")
    hit = F.col(key) == value
    return queue.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in changes.items()})


def sequential_fill(wanted: DataFrame, key: str, stages: list[tuple[str, DataFrame]]) -> DataFrame:
    """(key, stage, rows of the stage): each stage serves the keys that no stage before it did; keys that none has are left out."""
    out, served = None, None
    for name, df in stages:
        left = wanted.select(key).distinct()
        left = left if served is None else left.join(served, key, "left_anti")
        mine = df.join(left, key, "left_semi").withColumn("stage", F.lit(name))
        out = mine if out is None else out.unionByName(mine)
        served = df.select(key).distinct() if served is None else served.union(df.select(key)).distinct()
    return out


def frontier(links: DataFrame, seeds: DataFrame, depth: int = 4, pages: int = 350, allowed: Column | None = None) -> DataFrame:
    """(group, page, depth): pages reached from the seeds over links, breadth first, up to a depth and a number of pages a group; of a level that does not fit the first in order of page.

    links: group, src, dst. seeds: group, page. Depth and pages are the crawl's own budgets. Each level is written, so lost executors cost one level.
    """
    edges = links if allowed is None else links.where(allowed)
    edges = edges.select("group", "src", "dst").distinct()
    level = keep_first(seeds.select("group", "page").distinct(), None, pages)
    reached = stash(level.withColumn("depth", F.lit(0)), "frontier")
    for k in range(1, depth + 1):
        last = reached.where(F.col("depth") == k - 1)
        new = edges.join(last.select("group", F.col("page").alias("src")), ["group", "src"]).select("group", F.col("dst").alias("page")).distinct().join(reached.select("group", "page"), ["group", "page"], "left_anti")
        more = stash(keep_first(new, reached, pages).withColumn("depth", F.lit(k)), "frontier")
        if more.isEmpty():
            break
        reached = stash(reached.union(more), "frontier")
    return reached


def keep_first(new: DataFrame, reached: DataFrame | None, pages: int) -> DataFrame:
    """As many of the new pages as a group's budget has room for."""
    from pyspark.sql.window import Window

    placed = new.withColumn("_n", F.row_number().over(Window.partitionBy("group").orderBy("page"))).where(F.col("_n") <= pages)
    if reached is None:
        return placed.drop("_n")
    room = reached.groupBy("group").agg((F.lit(pages) - F.count("*")).alias("_room"))
    return placed.join(room, "group").where(F.col("_n") <= F.col("_room")).drop("_n", "_room")


def worker_share(df: DataFrame, order: list[str], workers: int, worker: int, offset: int = 0, limit: int | None = None) -> DataFrame:
    """The rows whose place in the order is the worker's, then an offset and a limit among those."""
    from tarnlake.operators.dedup import global_position

    mine = global_position(df, order).where(F.pmod("position", F.lit(workers)) == worker).drop("position").orderBy(*order).offset(offset)
    return mine.limit(limit) if limit is not None else mine
