"""Embedding near-dedup by lattice hashing.

Each of `tables` tables projects a unit vector at random onto `blocks` groups of 8 coordinates and decodes each
group to the nearest point of the lattice E8 and the second nearest of the candidates at hand. The points are a
cell; a vector is filed under its own cell and under the neighbouring cells that second points give. Vectors
that share a cell are compared by cosine in double precision.

A cell is compared as a matrix, not as a list of pairs: what comes out is one row for each vector of the cell,
with the number of links counted there and the smallest vector that links lead to within the cell. A pair that
meets in several cells is counted in the first of them only. Large cells are dealt into blocks of bounded size
and blocks are compared two by two, so no task gathers a cell. Equal vectors are one class from the start. As links are
counted, the work in a cell of m different vectors grows with m * m; what is sent to tasks grows with m * m / 8192.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with nothing, as
do rows with a null id; equal vectors of different ids link; vectors of different length never link; rows of
one id are one vertex of components; repeated rows are returned each; labels and extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlake.llm.common import arrow, components, drop_stash, stash, table

TABLES = 10
BLOCKS = 2
SCALE = 0.5
CELL_ROWS = 8192  # rows of a block of a cell: a cell of m rows sends each of them to m / 8192 tasks
TILE = 1024  # rows compared at a time
_SEED = 20240


def _d8(x: np.ndarray) -> np.ndarray:
    """The nearest point of D8 (whole coordinates with an even sum) to each row."""
    near = np.rint(x)
    off = x - near
    odd = np.flatnonzero(near.sum(1) % 2)
    worst = np.abs(off[odd]).argmax(1)
    near[odd, worst] += np.where(off[odd, worst] >= 0, 1.0, -1.0)
    return near


def e8_two(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest point of E8 to each row, and a near neighbour of it: the nearest point seen from past the closest face.

    E8 is D8 and D8 shifted by one half. Reflecting the row at its nearest point and decoding the point a bit
    farther along the residual gives the cell across the face that the row is closest to.
    """

    def nearest(y):
        a, b = _d8(y), _d8(y - 0.5) + 0.5
        return np.where(((y - a) ** 2).sum(1, keepdims=True) <= ((y - b) ** 2).sum(1, keepdims=True), a, b)

    first = nearest(x)
    out = x - first
    length = np.sqrt((out**2).sum(1, keepdims=True))
    second = first.copy()
    open_ = np.arange(len(x))
    for reach in (0.75, 0.9, 1.05, 1.25, 1.5):
        there = nearest(first[open_] + out[open_] / np.maximum(length[open_], 1e-12) * reach)
        moved = (there != first[open_]).any(1)
        second[open_[moved]] = there[moved]
        open_ = open_[~moved]
        if not len(open_):
            break
    return first, second


def _hash(points: np.ndarray, salt: int) -> np.ndarray:
    h = np.full(len(points), salt * 0x9E3779B97F4A7C15 % (1 << 64), np.uint64)
    for c in range(points.shape[1]):
        h = (h ^ (2 * points[:, c]).astype(np.int64).astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    return h


def cells(unit: np.ndarray, tables: int, blocks: int, scale: float) -> np.ndarray:
    """The cells of each row: for each table its own and the neighbouring ones (2**blocks in all), as 64-bit keys."""
    out = np.zeros((len(unit), tables, 2**blocks), np.uint64)
    for t in range(tables):
        plan = np.random.default_rng(_SEED + t).standard_normal((unit.shape[1], 8 * blocks))
        y = unit @ plan * scale
        keys = [[_hash(p, t * 64 + b) for p in e8_two(y[:, 8 * b : 8 * b + 8])] for b in range(blocks)]
        for combination in range(2**blocks):
            key = np.zeros(len(unit), np.uint64)
            for b in range(blocks):
                key = (key ^ keys[b][combination >> b & 1]) * np.uint64(0x9E3779B97F4A7C15)
                key ^= key >> np.uint64(29)
            out[:, t, combination] = key
    return out.reshape(len(unit), -1)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of an array column that all have `width` elements, in double precision."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def usable(column: str):
    """Not null, not empty, all finite, not all zero."""
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(F.col(column).isNotNull() & (F.size(column) > 0) & ~bad & F.exists(column, lambda x: x != 0), F.lit(False))


def _file(tables: int, blocks: int, scale: float):
    def run(batches):
        for batch in batches:
            width = np.asarray(batch.column("width"))
            for w in np.unique(width):
                part = batch.filter(pa.array(width == w))
                x = matrix(part.column("embedding"), int(w))
                x = x / np.abs(x).max(1, keepdims=True)
                keys = cells(x / np.linalg.norm(x, axis=1, keepdims=True), tables, blocks, scale).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, keys.shape[1], dtype=np.int32)), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("cid"), lists], names=["cid", "cells"])

    return run


def runs_of(batches, columns: list[str]):
    """Consecutive rows with equal values in `columns` (input sorted by them), each run as one table."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [np.asarray(batch.column(c)) for c in columns]
        new = np.zeros(batch.num_rows, bool)
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
        cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            key = tuple(k[a] for k in keys)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (the smallest row of each component) after linking rows a with rows b."""
    p, q = label[a], label[b]
    apart = p != q
    if not apart.any():
        return label
    p, q = p[apart], q[apart]
    pairs = np.unique(np.minimum(p, q) * len(label) + np.maximum(p, q))
    up = np.arange(len(label))

    def root(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for pair in pairs.tolist():
        x, y = map(root, divmod(pair, len(label)))
        up[max(x, y)] = min(x, y)
    while (up[up] != up).any():
        up = up[up]
    return up[label]


def _compare(least: float, tables: int):
    """Per cell (or two blocks of one): cid, links, lead. The rows are compared tile by tile, so memory is that of two blocks and a tile."""

    def run(batches):
        for group in runs_of(batches, ["cell", "i", "j", "width"]):
            group = group.combine_chunks()
            n = group.num_rows
            if n < 2:
                continue
            x = matrix(group.column("embedding").combine_chunks(), group.column("width")[0].as_py())
            cid, size, block = (np.asarray(group.column(c)) for c in ("cid", "copies", "block"))
            keys = matrix_of_keys(group.column("cells").combine_chunks(), n)
            per, mine = keys.shape[1] // tables, group.column("cell")[0].as_py()
            x = x / np.abs(x).max(1, keepdims=True)
            norm = np.sqrt((x * x).sum(1))
            links, label = np.zeros(n, np.int64), np.arange(n)
            one_block = group.column("i")[0].as_py() == group.column("j")[0].as_py()
            sides = [np.arange(n)] if one_block else [np.flatnonzero(block == block[0]), np.flatnonzero(block != block[0])]
            tiles = [[side[k : k + TILE] for k in range(0, len(side), TILE)] for side in sides]
            for p, left in enumerate(tiles[0]):
                for q, right in enumerate(tiles[-1]):
                    if one_block and q < p:
                        continue
                    whole = one_block and n <= TILE
                    u, v = (x, x) if whole else (x[left], x[right])
                    a, b = np.nonzero(u @ v.T / (norm if whole else norm[right]) / (norm if whole else norm[left])[:, None] >= least)
                    if one_block and q == p:
                        a, b = a[b > a], b[b > a]
                    if not len(a):
                        continue
                    a, b = left[a], right[b]
                    first = np.ones(len(a), bool)
                    open_ = np.ones(len(a), bool)
                    for t in range(tables):  # the first table in which the two share a cell, and there the smallest such cell
                        of_a, of_b = keys[a, t * per : t * per + per], keys[b, t * per : t * per + per]
                        least_shared = np.where((of_a[:, :, None] == of_b[:, None, :]).any(2), of_a, np.iinfo(np.int64).max).min(1)
                        there = open_ & (least_shared != np.iinfo(np.int64).max)
                        first[there] = least_shared[there] == mine
                        open_ &= ~there
                    for u, v in ((a[first], b[first]), (b[first], a[first])):
                        links += np.bincount(u, size[v], n).astype(np.int64)
                    label = _joined(label, a, b)
            if not links.any() and (label == np.arange(n)).all():
                continue
            smallest = np.full(n, np.iinfo(np.int64).max)
            np.minimum.at(smallest, label, cid)
            lead = smallest[label]
            some = np.flatnonzero((links > 0) | (lead != cid))
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array(cid[some]), pa.array(links[some]), pa.array(lead[some])], names=["cid", "links", "lead"])

    return run


def matrix_of_keys(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def near_copies(vectors: DataFrame, least: float = 0.95, tables: int = TABLES, blocks: int = BLOCKS, scale: float = SCALE, cell_rows: int = CELL_ROWS) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").withColumn("ok", usable("embedding") & F.col("vec_id").isNotNull())
    good = rows.where("ok").select("vec_id", "embedding", F.xxhash64("embedding").alias("h"))
    same = stash(good.distinct().groupBy("h", "embedding").agg(F.min("vec_id").alias("cid"), F.count("*").alias("copies")).withColumn("width", F.size("embedding")), "vectors")
    filed = stash(same.select("cid", "embedding", "width").transform(arrow, _file(tables, blocks, scale), "cid long, cells array<long>"), "cells")
    each = filed.select("cid", F.explode(F.array_distinct("cells")).alias("cell"))
    full = each.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1").withColumn("parts", F.ceil(F.col("n") / cell_rows).cast("int"))
    placed = each.join(full.select("cell", "parts"), "cell").withColumn("block", F.pmod(F.xxhash64("cid", "cell"), F.col("parts")).cast("int"))
    pairs = placed.withColumn("other", F.explode(F.expr("sequence(0, parts - 1)"))).select("cid", "cell", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    loaded = pairs.join(same.select("cid", "copies", "width", "embedding"), "cid").join(filed, "cid")
    found = loaded.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j", "width").select("cell", "i", "j", "width", "block", "cid", "copies", "embedding", "cells")
    met = stash(found.transform(arrow, _compare(least, tables), "cid long, links long, lead long"), "cell-links")
    counts = met.groupBy("cid").agg(F.sum("links").alias("links"))
    ids = good.select("vec_id", "h", "embedding").join(same.select("h", "embedding", "cid", "copies"), ["h", "embedding"]).select("vec_id", "cid", "copies").distinct()
    ids = stash(ids.join(counts, "cid", "left").select("vec_id", "cid", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "vector-links")
    edges = ids.select(F.col("vec_id").alias("a"), F.col("cid").alias("b")).union(met.select("cid", "lead"))
    label = components(edges, "lattice-components").withColumnRenamed("id", "vec_id")
    drop_stash(filed)
    # A row of an id without a usable vector has no links even if another row of the id has.
    per_id = ids.groupBy("vec_id").agg(F.max("n_links").alias("n_links")).join(label, "vec_id", "left").withColumn("ok", F.lit(True))
    out = rows.select("vec_id", "ok").join(per_id, ["vec_id", "ok"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))


def op4(spark, sf_dir: str) -> DataFrame:
    return near_copies(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
g AS (SELECT vec_id, x, sqrt(list_dot_product(x, x)) AS norm FROM v WHERE x IS NOT NULL AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(x, lambda c: c <> 0)) > 0),
e AS (SELECT p.vec_id AS a, q.vec_id AS b FROM g p JOIN g q ON p.vec_id <> q.vec_id WHERE list_dot_product(p.x, q.x) / (p.norm * q.norm) >= 0.95),
r(vec_id, c) AS (SELECT vec_id, vec_id FROM v UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.vec_id WHERE r.c < e.b),
m AS (SELECT vec_id, min(c) AS component_id FROM r GROUP BY vec_id),
k AS (SELECT a AS vec_id, count(*) AS n FROM e GROUP BY a)
SELECT v.vec_id, coalesce(k.n, 0) AS n_links, m.component_id, v.vec_id = m.component_id AS kept FROM v LEFT JOIN k USING (vec_id) JOIN m USING (vec_id)
"""
