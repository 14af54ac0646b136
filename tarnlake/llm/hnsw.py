"""Approximate nearest neighbours by inner product: one hierarchical navigable small-world graph per shard.

Vectors are dealt into shards by a hash; a shard has at most about `shard_rows` vectors. Each shard's graph is
stored as flat arrays (one row per shard): ids, vectors, and for each level its nodes and their neighbour
numbers, `links` a node, padded with -1. Queries go to every shard in blocks, walk down its levels and search
the lowest by best-first search with a beam of `beam`; the shards' results are merged by score. A task holds one
shard (32,768 vectors, about 25 MB at 64 dimensions) and one block of queries.

A graph is built in bulk, level by level. A node's neighbours come from the nearest nodes among ever larger
prefixes of the shard (as if nodes were inserted one by one: early nodes give the long links), thinned by the
usual diversity rule; links are made mutual. Distances are Euclidean after adding a coordinate that makes all
norms in the shard equal, which turns largest inner product into smallest distance.

Equal vectors share a node, with the `k` + 1 smallest ids: no other of their ids can be among a query's k best
when ties go to smaller ids, so every row is indexed. Scores are inner products in double precision of the
vectors as given. recall() compares with brute force.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do
rows with a null id; a query sees every row but those with its own id; vectors of another length than the query
are no candidates; repeated rows count once; fewer candidates than k give fewer rows; an empty table gives none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnlake.llm.common import arrow, stash, table
from tarnlake.llm.lattice import matrix, runs_of, usable

SHARD_ROWS = 32768
LEAST_SHARDS = 8
LINKS = 24
BEAM = 96
QUERY_BLOCK = 8192  # queries that one copy of a graph is sent out for: about as many bytes as the graph
_STEP = 256  # rows handled together inside a worker


def _nearest(x: np.ndarray, half: np.ndarray, rows: np.ndarray, among: np.ndarray, k: int) -> np.ndarray:
    """For each of rows its k nearest of among (itself left out), by squared distance; half: half the squared norms."""
    score = x[rows] @ x[among].T - half[among]
    score[rows[:, None] == among[None, :]] = -np.inf
    k = min(k, len(among))
    best = np.argpartition(-score, k - 1, axis=1)[:, :k]
    return among[best]


def _diverse(x: np.ndarray, rows: np.ndarray, found: np.ndarray, links: int) -> np.ndarray:
    """Of the candidates of each row up to `links` that are nearer to the row than to any one taken before; -1 pads."""
    padded = found < 0
    c = np.where(padded, 0, found)
    d = ((x[c] - x[rows][:, None, :]) ** 2).sum(2)
    d[padded | (c == rows[:, None])] = np.inf
    order = np.argsort(d, axis=1, kind="stable")
    c, d = np.take_along_axis(c, order, 1), np.take_along_axis(d, order, 1)
    v = x[c]
    norm = (v * v).sum(2)
    between = norm[:, :, None] + norm[:, None, :] - 2 * v @ v.transpose(0, 2, 1)
    taken = np.zeros(c.shape, bool)
    count = np.zeros(len(rows), np.int64)
    for j in range(c.shape[1]):
        good = np.isfinite(d[:, j]) & (count < links) & ~(taken & (between[:, j] < d[:, j, None])).any(1)
        taken[:, j] = good
        count += good
    # Room that diversity leaves goes to the nearest of the others.
    rest = np.isfinite(d) & ~taken
    taken |= rest & (np.cumsum(rest, 1) <= (links - count)[:, None])
    out = np.full((len(rows), links), -1, np.int32)
    place = np.cumsum(taken, 1) - 1
    i, j = np.nonzero(taken)
    out[i, place[i, j]] = c[i, j]
    return out


def _level(x: np.ndarray, nodes: np.ndarray, links: int) -> np.ndarray:
    """Neighbour numbers (positions in x) of each of the nodes, which are in order of insertion."""
    half = (x * x).sum(1) / 2
    out = np.full((len(nodes), links), -1, np.int32)
    if len(nodes) < 2:
        return out
    at = np.full(len(x), -1)
    at[nodes] = np.arange(len(nodes))
    scales = [m for m in (len(nodes) // 256, len(nodes) // 16) if m >= 2 * links] + [len(nodes)]
    for begin in range(0, len(nodes), _STEP):
        rows = nodes[begin : begin + _STEP]
        found = np.concatenate([_nearest(x, half, rows, nodes[:m], 2 * links if m == len(nodes) else links) for m in scales], 1)
        found.sort(axis=1)
        found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
        out[begin : begin + _STEP] = _diverse(x, rows, found, links)
    # Mutual links: who names me joins my own choice, then thinned again where there are too many.
    i, j = np.nonzero(out >= 0)
    target, source = at[out[i, j]], i
    order = np.argsort(target, kind="stable")
    target, source = target[order], source[order]
    starts = np.searchsorted(target, np.arange(len(nodes) + 1))
    most = 2 * links
    for begin in range(0, len(nodes), _STEP):
        end = min(begin + _STEP, len(nodes))
        back = np.full((end - begin, most), -1, np.int64)
        for r in range(begin, end):
            named = source[starts[r] : starts[r + 1]]
            if len(named) > most:
                named = named[np.argsort(((x[nodes[named]] - x[nodes[r]]) ** 2).sum(1), kind="stable")[:most]]
            back[r - begin, : len(named)] = nodes[named]
        both = np.concatenate([out[begin:end].astype(np.int64), back], 1)
        both.sort(axis=1)
        both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
        out[begin:end] = _diverse(x, nodes[begin:end], both, links)
    return out


class Graph:
    """x: vectors; levels: from the lowest, (nodes, links) with links[i] the neighbours of nodes[i]."""

    def __init__(self, x: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray]]):
        self.x, self.levels = x.astype(np.float32), levels

    @classmethod
    def build(cls, x: np.ndarray, links: int = LINKS) -> Graph:
        norm = (x * x).sum(1)
        level_x = np.concatenate([x, np.sqrt(np.maximum(norm.max() - norm, 0))[:, None]], 1).astype(np.float32)
        order = np.random.default_rng(7).permutation(len(x))
        levels, m, base = [], len(x), links
        while True:
            nodes = order[:m]
            levels.append((nodes.astype(np.int32), _level(level_x, nodes, 2 * links if not levels else links)))
            if m <= 4 * base:
                return cls(x, levels)
            m //= base

    def _beam(self, q: np.ndarray, entry: np.ndarray, level: int, beam: int, wide: int = 4) -> np.ndarray:
        """Best-first search of one level for all rows of q together: the beam's nodes, best first, -1 pads."""
        nodes, links = self.levels[level]
        n = len(self.x)
        where = np.full(n + 1, len(nodes), np.int64)
        where[nodes] = np.arange(len(nodes))
        links = np.concatenate([np.where(links < 0, n, links), np.full((1, links.shape[1]), n, links.dtype)])
        x = np.concatenate([self.x, np.zeros((1, self.x.shape[1]), np.float32)])
        rows = np.arange(len(q))[:, None]
        seen = np.zeros((len(q), n + 1), bool)
        seen[:, n] = True
        ids = np.where(entry < 0, n, entry)

        def scored(new):
            s = np.einsum("qd,qkd->qk", q, x[new], optimize=True)
            s[new == n] = -np.inf
            return s

        seen[rows, ids] = True
        score = scored(ids)
        done = ids == n
        while True:
            order = np.argsort(-score, axis=1, kind="stable")[:, :beam]
            ids, score, done = (np.take_along_axis(v, order, 1) for v in (ids, score, done))
            todo = ~done
            pick = todo & (np.cumsum(todo, 1) <= wide)
            if not pick.any():
                return np.where(np.isfinite(score), ids, -1)
            chosen = np.full((len(q), wide), n)
            i, j = np.nonzero(pick)
            chosen[i, (np.cumsum(pick, 1) - 1)[i, j]] = ids[i, j]
            done |= pick
            new = np.sort(links[where[chosen]].reshape(len(q), -1), axis=1)
            new[:, 1:][new[:, 1:] == new[:, :-1]] = n
            new = np.where(seen[rows, new], n, new)
            seen[rows, new] = True
            ids = np.concatenate([ids, new], 1)
            score = np.concatenate([score, scored(new)], 1)
            done = np.concatenate([done, new == n], 1)

    def search(self, q: np.ndarray, beam: int = BEAM) -> np.ndarray:
        """Nodes near each row of q, best first."""
        q = q.astype(np.float32)
        out = np.full((len(q), beam), -1, np.int64)
        for begin in range(0, len(q), _STEP):
            part = q[begin : begin + _STEP]
            entry = np.tile(self.levels[-1][0].astype(np.int64), (len(part), 1))  # the top level is small: all of it
            for level in range(len(self.levels) - 1, 0, -1):
                entry = self._beam(part, entry, level, 12)
            got = self._beam(part, entry, 0, beam)
            out[begin : begin + len(part), : got.shape[1]] = got
        return out


_GRAPH = "shard int, width int, ids array<binary>, vectors binary, level_nodes array<binary>, level_links array<binary>"


def _build(links: int):
    def run(batches):
        for group in runs_of(batches, ["shard", "width"]):
            width = group.column("width")[0].as_py()
            x = matrix(group.column("embedding").combine_chunks(), width)
            g = Graph.build(x, links)
            ids = [np.sort(np.array(i.as_py(), np.int64)).tobytes() for i in group.column("ids")]
            yield pa.RecordBatch.from_arrays([
                pa.array([group.column("shard")[0].as_py()], pa.int32()), pa.array([width], pa.int32()), pa.array([ids], pa.list_(pa.binary())), pa.array([x.tobytes()], pa.binary()),
                pa.array([[n.tobytes() for n, _ in g.levels]], pa.list_(pa.binary())), pa.array([[k.tobytes() for _, k in g.levels]], pa.list_(pa.binary())),
            ], names=["shard", "width", "ids", "vectors", "level_nodes", "level_links"])

    return run


def index(vectors: DataFrame, k: int, shard_rows: int = SHARD_ROWS, links: int = LINKS) -> DataFrame:
    """One row per shard and vector length: the graph as flat arrays."""
    good = vectors.where(usable("embedding") & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").withColumn("h", F.xxhash64("embedding"))
    # The k + 1 smallest ids of each distinct vector; Spark limits the groups before it shuffles them.
    copies = good.dropDuplicates(["vec_id", "embedding"]).withColumn("r", F.row_number().over(Window.partitionBy("h", "embedding").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    nodes = copies.groupBy("h", "embedding").agg(F.collect_list("vec_id").alias("ids"))
    nodes = stash(nodes, "nodes")
    shards = max(LEAST_SHARDS, -(-nodes.count() // shard_rows))
    dealt = nodes.select(F.pmod("h", F.lit(shards)).cast("int").alias("shard"), F.size("embedding").alias("width"), "embedding", "ids")
    return stash(dealt.repartition(shards, "shard").sortWithinPartitions("shard", "width", "ids").transform(arrow, _build(links), _GRAPH), "graphs")


def _search(k: int, beam: int):
    def run(graphs, queries):
        import pandas as pd

        if not len(graphs) or not len(queries):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        g = graphs.iloc[0]
        x = np.frombuffer(g["vectors"], np.float64).reshape(-1, g["width"])
        levels = [(n := np.frombuffer(a, np.int32), np.frombuffer(b, np.int32).reshape(len(n), -1)) for a, b in zip(g["level_nodes"], g["level_links"], strict=True)]
        ids = [np.frombuffer(i, np.int64) for i in g["ids"]]
        q = np.stack(queries["embedding"].to_list()).astype(np.float64)
        found = Graph(x, levels).search(q, beam)
        out: list[tuple[int, int, float]] = []
        for row, (query, nodes) in enumerate(zip(queries["query_id"], found, strict=True)):
            nodes = nodes[nodes >= 0]
            score = x[nodes] @ q[row]
            near = [(-s, i, query) for s, n in zip(score.tolist(), nodes.tolist(), strict=True) for i in ids[n].tolist() if i != query]
            out += [(query, i, -s) for s, i, _ in sorted(near)[:k]]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    return run


def search(graphs: DataFrame, queries: DataFrame, k: int, beam: int = BEAM, block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all shards for each query (columns vec_id and embedding)."""
    asked = queries.where(usable("embedding") & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("query_id"), "embedding", F.size("embedding").alias("width")).dropDuplicates(["query_id", "embedding"])
    blocks = max(1, -(-asked.count() // block))
    at = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")
    last = graphs.agg(F.max("shard")).first()[0]
    each = asked.withColumn("qblock", at).withColumn("shard", F.explode(F.expr(f"sequence(0, {last or 0})")))
    spread = graphs.withColumn("qblock", F.explode(F.expr(f"sequence(0, {blocks - 1})")))
    keys = ["shard", "width", "qblock"]
    found = spread.groupBy(*keys).cogroup(each.groupBy(*keys)).applyInPandas(_search(k, beam), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.dropDuplicates(["query_id", "vec_id"]).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of exact's (query_id, vec_id) that found has."""
    n = exact.count()
    return exact.join(found, ["query_id", "vec_id"], "left_semi").count() / n if n else 1.0


def op2(spark, sf_dir: str, k: int = 20) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return search(index(vectors, k), vectors.where("vec_id % 20 = 0"), k)


ORACLE = """
WITH v AS (SELECT DISTINCT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE embedding IS NOT NULL),
g AS (SELECT vec_id, x FROM v WHERE len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(x, lambda c: c <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.x, c.x) AS score FROM g q JOIN g c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s QUALIFY rank <= 20
"""
