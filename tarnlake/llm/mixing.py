"""Mixing sources to target weights by pivotal dependent rounding. Native columns only.

Every document of a source should be copied target / source size times. The whole part is taken as it is; the
fractional parts are rounded together: two fractional documents exchange mass (words), in a random direction
whose odds keep each one's expectation, until one of them is whole. So the words taken from a source stay the
same at each step, and only the last residual of a source is rounded on its own, to the nearer side. Folds
take large documents first, so that what remains is a small one.

The exchanges form a reduction tree: documents are dealt into blocks of about `block` by a hash, a fold rounds
each block down to one residual, the residuals are dealt into blocks again, until each source has one block.
No block grows with its source. Random numbers are hashes of what meets, so reruns agree.

Equal rows (k of them) exchange among themselves first: with equal masses p that leaves floor(k * p) whole ones and
one residual, so a group of any size enters the tree as one document, and how many of it are taken once more is
a number beside its count.

Defined results: a null text has size 0; null sources are one source, last in the order; documents of size 0
are taken 0 times; of equal rows some may be taken once more than the others, and each is returned; null ids are
like any other; an empty table gives no rows. The table of sources (one small row each) is worked through by one
task; it holds some millions of sources.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnlake.llm.common import stash, table

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)


def _size(text: str = "text"):
    return F.size(F.expr(f"regexp_extract_all(coalesce({text}, ''), r'{WORD}', 0)")).cast("long")


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words of the whole text) and row, a hash of all columns, of every document."""
    return docs.select("doc_id", "source", _size().alias("size"), F.xxhash64(*(f"`{c}`" for c in docs.columns)).alias("row"))


def targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row per source: source_size, target. `share` of all words is dealt out by weight, at most `most` times a source's own.

    Dealing again what is above the caps, until nothing is, has a closed form: sources in order of cap per
    weight are capped as long as their cap is below their part of what is then left. The windows run over
    the table of sources, which has one small row each.
    """
    by_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    weighed = by_source.withColumn("w", pick.cast("double")).withColumn("cap", most * F.col("source_size"))
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    left = weighed.select("*", (share * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))).alias("left"), F.sum("w").over(filled.rowsBetween(0, Window.unboundedFollowing)).alias("w_left"))
    capped = left.withColumn("capped", F.col("cap") * F.col("w_left") <= F.col("left") * F.col("w"))
    free = F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("w"), F.col("left"), F.col("w_left")))).over(every)
    return capped.select("source", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(free["left"] * F.col("w") / free["w_left"]).alias("target"))


def _coin(a: str, b: str, seed: int) -> str:
    return f"((xxhash64({a}, {b}, {seed}) & 4503599627370495L) / 4503599627370496D)"


_ITEM = "struct<o:double,h:bigint,row:bigint,size:bigint,w:double,m:double>"
_OUT = "array<struct<row:bigint,size:bigint,up:int>>"
#: Equal rows that one step numbers; more are dealt into blocks first.
_NUMBERED = 4096


def _fold(seed: int) -> str:
    """SQL: the items of a block, in order, to one residual (null once all are whole) and the decided ones.

    An item has weight w (its words) and mass m, of which 0 < m < w. a is what can move from
    the new item to the residual, b the other way round; moving a with odds b / (a + b), else b back, keeps
    both expectations, and makes one of the two whole.
    """
    eps = "1e-9"
    decide = lambda item, m: f"named_struct('row', {item}.row, 'size', {item}.size, 'up', if({m} > {item}.w / 2, 1, 0))"
    whole = lambda item, m: f"({m} <= {eps} * {item}.w OR {m} >= (1 - {eps}) * {item}.w)"
    hold = lambda item, m: f"named_struct('o', {item}.o, 'h', {item}.h, 'row', {item}.row, 'size', {item}.size, 'w', {item}.w, 'm', {m})"
    none = f"cast(null AS {_ITEM})"
    settled = f"""CASE
        WHEN {whole("s.r", "s.rm")} AND {whole("s.x", "s.xm")} THEN named_struct('r', {none}, 'out', array_append(array_append(s.out, {decide("s.r", "s.rm")}), {decide("s.x", "s.xm")}))
        WHEN {whole("s.r", "s.rm")} THEN named_struct('r', {hold("s.x", "s.xm")}, 'out', array_append(s.out, {decide("s.r", "s.rm")}))
        ELSE named_struct('r', {hold("s.r", "s.rm")}, 'out', array_append(s.out, {decide("s.x", "s.xm")})) END"""
    moved = f"transform(array(named_struct('a', least(acc.r.w - acc.r.m, x.m), 'b', least(acc.r.m, x.w - x.m))), t -> CASE WHEN {_coin('acc.r.h', 'x.h', seed)} * (t.a + t.b) < t.b THEN t.a ELSE -t.b END)[0]"
    met = f"transform(transform(array({moved}), d -> named_struct('out', acc.out, 'r', acc.r, 'x', x, 'rm', acc.r.m + d, 'xm', x.m - d)), s -> {settled})[0]"
    return f"""aggregate(items, named_struct('r', {none}, 'out', cast(array() AS {_OUT})), (acc, x) -> CASE WHEN acc.r IS NULL THEN named_struct('r', {hold("x", "x.m")}, 'out', acc.out) ELSE {met} END)"""


def groups(docs: DataFrame, block: int = 64, seed: int = 11, **shares) -> DataFrame:
    """One row for each group of equal rows: doc_id, source, size, row, rows, source_size, target, whole (copies of each), ups (how many of them are taken once more)."""
    rows = stash(sizes(docs).groupBy("doc_id", "source", "size", "row").agg(F.count("*").alias("rows")), "mix-sizes")
    total = rows.select("source", (F.col("size") * F.col("rows")).alias("size"))
    goal = stash(targets(total, **shares), "mix-targets")  # one row per source
    planned = rows.join(goal, rows["source"].eqNullSafe(goal["source"])).drop(goal["source"])
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    planned = planned.withColumn("each", F.when(F.col("size") > 0, each).otherwise(F.lit(0.0))).withColumn("whole", F.floor("each"))
    planned = planned.withColumn("part", F.col("rows") * (F.col("each") - F.col("whole"))).withColumn("sure", F.floor(F.col("part") + 1e-9))
    open_ = planned.where(F.col("part") - F.col("sure") > 1e-9)
    weight = F.col("size").cast("double")
    item = F.struct((-weight).alias("o"), F.xxhash64("row", F.lit(seed)).alias("h"), "row", "size", weight.alias("w"), (weight * (F.col("part") - F.col("sure"))).alias("m"))
    items = open_.select("source", item.alias("x"))
    n = open_.groupBy("source").count().agg(F.max("count")).first()[0] or 0
    decided, level = None, 0
    while n:
        n = -(-n // block) if n > block else 1
        dealt = items.withColumn("block", F.pmod(F.xxhash64("x.h", F.lit(seed + level)), F.lit(n)))
        # Sources smaller than the largest have emptier blocks at first; the tree is as deep for all.
        folded = dealt.groupBy("source", "block").agg(F.array_sort(F.collect_list("x")).alias("items")).select("source", F.expr(_fold(seed + level)).alias("f"))
        folded = stash(folded.select("source", "f.r", "f.out"), "mix-level")
        done = folded.select("source", F.explode("out").alias("o")).select("source", "o.*")
        decided = done if decided is None else decided.union(done)
        items = folded.where("r IS NOT NULL").select("source", F.col("r").alias("x"))
        level += 1
        if n == 1:
            decided = decided.union(items.select("source", "x.row", "x.size", F.expr("if(2 * x.m >= x.w, 1, 0)")))
            break
    if decided is None:
        decided = items.select("source", "x.row", "x.size", F.lit(0).alias("up"))
    d = decided.toDF("d_source", "d_row", "d_size", "up")
    same = planned["source"].eqNullSafe(d["d_source"]) & (planned["row"] == d["d_row"]) & (planned["size"] == d["d_size"])
    ups = F.col("sure") + F.coalesce("up", F.lit(0))
    return planned.join(d, same, "left").select("doc_id", "source", "size", "row", "rows", "source_size", "target", "whole", ups.alias("ups"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source, source_size, target, copies, taken: one row for each row of docs."""
    found = groups(docs, **options)
    blocks = found.withColumn("first", F.explode(F.expr(f"sequence(0L, rows - 1, {_NUMBERED}L)")))
    each = blocks.withColumn("i", F.explode(F.expr(f"sequence(first, least(first + {_NUMBERED}, rows) - 1)")))
    copies = (F.col("whole") + F.when(F.col("i") < F.col("ups"), 1).otherwise(0)).cast("int")
    return each.select("doc_id", "size", "source", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, each as many times as the mix takes it, with their columns."""
    n = stash(groups(docs, **options).select(F.col("source").alias("m_source"), F.col("size").alias("m_size"), F.col("row").alias("m_row"), "rows", "whole", "ups").where("whole > 0 OR ups > 0"), "mix-copies")
    columns = [f"`{c}`" for c in docs.columns]
    known = docs.withColumns({"_size": _size(), "_row": F.xxhash64(*columns)})

    def joined(some: DataFrame) -> DataFrame:
        return known.join(some, known["source"].eqNullSafe(some["m_source"]) & (known["_size"] == some["m_size"]) & (known["_row"] == some["m_row"]))

    def times(rows: DataFrame, copies) -> DataFrame:
        return rows.withColumn("_c", copies.cast("int")).where("_c > 0").withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_c")))).select(*columns)

    out = times(joined(n), F.col("whole") + F.when(F.col("rows") == 1, F.col("ups")).otherwise(0))
    repeated = n.where("rows > 1 AND ups > 0")
    if repeated.isEmpty():
        return out
    # Which of some equal rows is taken once more makes no difference: one of them stands for all that are.
    extra = joined(repeated).dropDuplicates(docs.columns)
    blocks = extra.withColumn("_f", F.explode(F.expr(f"sequence(0L, ups - 1, {_NUMBERED}L)")))
    return out.union(times(blocks, F.least(F.col("ups") - F.col("_f"), F.lit(_NUMBERED))))


def op3(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents", "doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", "taken", "source")
