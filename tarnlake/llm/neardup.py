"""MinHash near-dedup with tensored banding.

Two small collections of `m` band keys each, every key made of `r` minhashes, are combined pair by pair: each
of the m * m combinations of a key of the first and one of the second collection is a table key. So 2 * m * r
minhash values (32 by default) serve 64 tables of 4 values each; a pair of similarity s shares a table with
probability (1 - (1 - s**r)**m)**2: 0.99993 at 0.85, 0.9994 at 0.8.

A combination can only be shared by documents that share both of its keys, so keys that just one document has
are dropped before combining. Documents with equal sets are one class from the start. In each bucket every
class is compared with the bucket's smallest id, in small buckets with all others. Larger buckets of which that
leaves more than one component are dealt into blocks of bounded size, and the classes outside the bucket's largest
component are compared with all others, two blocks at a time; a pair that meets in several buckets is compared in one
of them, unless it is in one component by then. What comes out of two blocks is at most one link for each
component that goes, however many pairs there are: sets are compared all with all by a product of incidence matrices.
Every link is confirmed on the full sets, which are sets of 64-bit hashes
of shingles; pairs with fewer equal signature values than all but one in a million pairs at the threshold have are not
looked at.

Defined results: a null or empty text, or one of white space, has no shingles and links with nothing; a text of
fewer words than a shingle is one shingle; rows with a null id link with nothing and have a null component_id;
rows of one id are one document; repeated rows are returned each; ties go to the smaller id.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlake.llm.common import arrow, components, drop_stash, joined_by_size, side, stash, table
from tarnlake.llm.lattice import runs_of
from tarnlake.llm.textscan import LOWER, Runs, U, Words, distinct_per_text, mix, pieces, texts

SHINGLE = 5
TABLES = 8  # keys in each of the two collections
VALUES = 2  # minhashes in a key
SMALL = 6  # buckets up to this size are compared pair by pair
SCREEN_ROWS = 4096  # rows in a block of a larger bucket, by signatures
BLOCK_ROWS = 512  # rows and shingles in a block of it, by sets
BLOCK_SHINGLES = 1 << 18
INCIDENCE = 1 << 13  # columns of a matrix of sets
_MULT = mix(np.arange(1, 2 * TABLES * VALUES + 1, dtype=U)) | U(1)
_XOR = mix(np.arange(101, 2 * TABLES * VALUES + 101, dtype=U))


def shingles(piece: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Text index and hash of the distinct k-word shingles of each text, sorted by both; the number of texts."""
    buf, offs = texts(piece.column("text"))
    w = Words(LOWER[buf], offs)
    runs = Runs(w.hashes())
    at, end = np.arange(len(w.start)), np.repeat(w.first[1:], w.per_text)
    whole = at[at + k <= end]
    few = np.flatnonzero((w.per_text > 0) & (w.per_text < k))
    value = np.concatenate([runs.hash(whole, whole + k), runs.hash(w.first[few], w.first[few + 1])])
    doc = np.concatenate([np.searchsorted(w.first, whole, side="right") - 1, few])
    d, v, _ = distinct_per_text(doc, value, len(w.per_text))
    return d, v, len(w.per_text)


_SIGNATURE = "doc_id long, n_shingles long, s1 long, s2 long, keys array<long>, sig binary"


def _signatures(k: int):
    def run(batches):
        for batch in batches:
            for piece in pieces(batch):
                d, v, n = shingles(piece, k)
                size = np.bincount(d, minlength=n)
                some = np.flatnonzero(size)
                starts = np.cumsum(size[some]) - size[some]
                low = np.zeros((n, len(_MULT)), U)
                sums = np.zeros((n, 2), U)
                if len(v):
                    for j, (a, x) in enumerate(zip(_MULT, _XOR, strict=True)):
                        low[some, j] = np.minimum.reduceat((v ^ x) * a, starts)
                    for j in range(2):
                        sums[some, j] = np.add.reduceat(mix(v ^ _XOR[j]), starts)
                band = np.zeros((n, 2 * TABLES), U)
                for j in range(2 * TABLES):
                    key = np.full(n, j, U)
                    for t in range(VALUES):
                        key = mix(key * U(31) ^ low[:, j * VALUES + t])
                    band[:, j] = key
                keys = pa.ListArray.from_arrays(pa.array(np.arange(0, band.size + 1, band.shape[1], dtype=np.int32)), pa.array(band.view(np.int64).ravel()))
                sig = pa.array([x.tobytes() for x in (mix(low) >> U(56)).astype(np.uint8)], pa.binary())
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(size.astype(np.int64)), *(pa.array(sums[:, j].copy().view(np.int64)) for j in range(2)), keys, sig], names=["doc_id", "n_shingles", "s1", "s2", "keys", "sig"])

    return run


def _sets(k: int):
    def run(batches):
        for batch in batches:
            for piece in pieces(batch):
                d, v, n = shingles(piece, k)
                ends = np.searchsorted(d, np.arange(1, n + 1))
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array([x.tobytes() for x in np.split(v, ends[:-1])], pa.binary())], names=["doc_id", "set"])

    return run


def _confirmed(percent: int):
    """Pairs whose sets reach the similarity, from rows a, b, set_a, set_b."""

    def run(batches):
        for batch in batches:
            keep = []
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(c)[i].as_buffer(), U) for c in ("set_a", "set_b"))
                both = np.concatenate([x, y])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(100 * shared >= percent * (len(both) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _cut(percent: int) -> int:
    """The most equal signature values that all but one in 10^6 pairs at the threshold have (a binomial tail)."""
    n, p = len(_MULT), percent / 100
    below, least = 0.0, 0
    while (below := below + math.comb(n, least) * p**least * (1 - p) ** (n - least)) <= 1e-6:
        least += 1
    return least


def _bytes(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), len(_MULT))


def _alike(percent: int):
    """Pairs that sizes and signatures do not rule out, from rows a, b, n_a, n_b, sig_a, sig_b."""
    least = _cut(percent)

    def run(batches):
        for batch in batches:
            n, m = np.asarray(batch.column("n_a")), np.asarray(batch.column("n_b"))
            good = 100 * np.minimum(n, m) >= percent * np.maximum(n, m)
            if len(good):
                good &= (_bytes(batch.column("sig_a")) == _bytes(batch.column("sig_b"))).sum(1) >= least
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def _likely(batches, percent: int):
    """Pairs to test of two blocks of a bucket, its rows on side 0 and those outside its largest component on side 1: the group and two row numbers.

    A pair makes its rows open in one bucket only: the first of the tables i = j that it shares, else the first of all.
    """
    least = _cut(percent)
    for group in runs_of(batches, ["bucket", "p", "q"]):
        group = group.combine_chunks()
        side = np.asarray(group.column("side"))
        x, y = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if not len(x) or not len(y):
            continue
        rep, size, comp, main = (np.asarray(group.column(c)) for c in ("rep", "n_shingles", "comp", "main"))
        one, two = divmod(group.column("table")[0].as_py(), TABLES)
        sig = _bytes(group.column("sig"))
        keys = group.column("keys").combine_chunks().flatten().to_numpy().reshape(-1, 2 * TABLES)
        found = []
        for j in y:
            i = x[(comp[x] != comp[j]) & ((comp[x] == main[j]) | (rep[x] < rep[j])) & (100 * np.minimum(size[x], size[j]) >= percent * np.maximum(size[x], size[j]))]
            equal = (sig[i] == sig[j]).sum(1)
            i = i[equal >= least]
            same = keys[i] == keys[j]
            both = same[:, :TABLES] & same[:, TABLES:]
            if one == two:
                here = both.argmax(1) == one
            else:
                here = ~both.any(1) & (same[:, :TABLES].argmax(1) == one) & (same[:, TABLES:].argmax(1) == two)
            found.append((np.full(here.sum(), j), i[here]))
        j, i = (np.concatenate(c) for c in zip(*found, strict=True))
        if len(j):
            yield group, j, i


def _open(percent: int):
    """Rows of a bucket that have a pair to test."""

    def run(batches):
        for group, j, i in _likely(batches, percent):
            some = pa.array(np.union1d(i, j))
            yield from group.select(["bucket", "rep", "n_shingles", "comp", "main"]).take(some).to_batches()

    return run


def _shared(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """The sizes of the intersections of sets, all left with all right: a product of incidence matrices over the values of both sides, some thousands at a time."""
    at = [np.repeat(np.arange(len(side)), [len(v) for v in side]) for side in (left, right)]
    values = [np.concatenate(side) for side in (left, right)]
    known = np.intersect1d(np.unique(values[0]), np.unique(values[1]), assume_unique=True)
    out = np.zeros((len(left), len(right)), np.float32)
    if not len(known):
        return out
    place = [np.searchsorted(known, v) for v in values]
    here = [known[np.minimum(k, len(known) - 1)] == v for k, v in zip(place, values, strict=True)]
    rows, cols = ([x[h] for x, h in zip(xs, here, strict=True)] for xs in (at, place))
    for begin in range(0, len(known), INCIDENCE):
        width = min(INCIDENCE, len(known) - begin)
        one = []
        for n, r, c in zip((len(left), len(right)), rows, cols, strict=True):
            some = (c >= begin) & (c < begin + width)
            m = np.zeros((n, width), np.float32)
            m[r[some], c[some] - begin] = 1
            one.append(m)
        out += one[0] @ one[1].T
    return out


def _blocks(percent: int):
    """Links that join two components, of two blocks of a bucket: all pairs of different components by their full sets."""

    def run(batches):
        for group in runs_of(batches, ["bucket", "p", "q"]):
            group = group.combine_chunks()
            side = np.asarray(group.column("side"))
            x, y = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            if not len(x) or not len(y):
                continue
            rep, comp = (np.asarray(group.column(c)) for c in ("rep", "comp"))
            sets = [np.frombuffer(b.as_buffer(), U) for b in group.column("set")]
            size = np.array([len(v) for v in sets], np.float32)
            shared = _shared([sets[i] for i in x], [sets[j] for j in y])
            good = 100 * shared >= percent * (size[x][:, None] + size[y][None, :] - shared)
            i, j = np.nonzero(good & (comp[x][:, None] != comp[y][None, :]))
            i, j = x[i], y[j]
            label, links = comp.copy(), []
            while len(i):  # one link for each component that goes
                a, b = i[0], j[0]
                links.append((min(rep[a], rep[b]), max(rep[a], rep[b])))
                label[label == label[a]] = label[b]
                apart = label[i] != label[j]
                i, j = i[apart], j[apart]
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links, strict=True)], names=["a", "b"])

    return run


def classes(docs: DataFrame, percent: int, k: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id of every row: components of links with 100 * shared >= percent * all."""
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = stash(known.transform(arrow, _signatures(k), _SIGNATURE), "signatures")
    real = rows.where("doc_id IS NOT NULL AND n_shingles > 0")
    same = stash(real.groupBy("s1", "s2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.count("*").alias("rows")), "equal-sets")
    first = same.select(*(F.col(c).alias(f"_{c}") for c in ("s1", "s2", "n_shingles", "rep")))
    is_first = (F.col("doc_id") == F.col("_rep")) & (F.col("s1") == F.col("_s1")) & (F.col("s2") == F.col("_s2")) & (F.col("n_shingles") == F.col("_n_shingles"))
    reps = stash(real.join(side(first), is_first).dropDuplicates(["doc_id", "s1", "s2"]).select(F.col("doc_id").alias("rep"), "n_shingles", "keys", "sig"), "classes")
    # Ids that more than one set has (an empty one counts) are vertices beside the classes' own smallest ids.
    several = known_ids(rows)
    n_several = several.count()
    own = real.join(side(several, n_several), "doc_id").select("doc_id", "s1", "s2", "n_shingles").distinct().join(side(same), ["s1", "s2", "n_shingles"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    own = stash(own, "ids-of-several")
    # Band keys that more than one class has, and their combinations.
    n_reps = reps.count()
    bands = reps.select("rep", F.posexplode("keys").alias("band", "key"))
    shared = bands.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    mine = bands.join(side(shared, n_reps * TABLES), "key").groupBy("rep").agg(F.collect_list(F.when(F.col("band") < TABLES, F.struct("key", "band"))).alias("one"), F.collect_list(F.when(F.col("band") >= TABLES, F.struct("key", "band"))).alias("two"))
    mine = mine.where("size(one) > 0 AND size(two) > 0").join(side(reps.select("rep", "n_shingles", "sig"), n_reps), "rep")
    met = mine.withColumn("one", F.explode("one")).withColumn("two", F.explode("two")).select("rep", "n_shingles", "sig", F.xxhash64("one.key", "two.key").alias("bucket"), (F.col("one.band") * TABLES + F.col("two.band") - TABLES).alias("table"))
    sizes = stash(met.groupBy("bucket").agg(F.count("*").alias("members"), F.min("rep").alias("least")).where("members > 1"), "bucket-sizes")
    # One row for each class and bucket that it shares; as sizes is a table of its own, Spark can split a hot bucket in the join.
    in_bucket = stash(met.join(side(sizes), "bucket"), "buckets")
    alike = stash(in_bucket.select("rep", "n_shingles", "sig").distinct(), "alike")
    n_alike = alike.count()
    sets = stash(known.join(side(alike.select(F.col("rep").alias("doc_id")).distinct(), n_alike), "doc_id").transform(arrow, _sets(k), "doc_id long, set binary").dropDuplicates(["doc_id", "set"]), "sets")

    def likely(pairs: DataFrame) -> DataFrame:
        sides = {s: side(alike.select(F.col("rep").alias(s), F.col("n_shingles").alias(f"n_{s}"), F.col("sig").alias(f"sig_{s}")), n_alike) for s in "ab"}
        return pairs.where("a < b").distinct().join(sides["a"], "a").join(sides["b"], "b").transform(arrow, _alike(percent), "a long, b long")

    def confirm(pairs: DataFrame) -> DataFrame:
        each = {s: sets.withColumnsRenamed({"doc_id": s, "set": f"set_{s}"}).hint("merge") for s in "ab"}  # sets have no bound
        full = pairs.join(each["a"], "a").join(each["b"], "b")
        return full.select("a", "b", "set_a", "set_b").transform(arrow, _confirmed(percent), "a long, b long")

    star = in_bucket.where("least < rep").select(F.col("least").alias("a"), F.col("rep").alias("b"))
    small = in_bucket.where((F.col("members") <= SMALL) & (F.col("members") > 2)).groupBy("bucket").agg(F.array_sort(F.collect_set("rep")).alias("x"))
    each = small.select(F.posexplode("x").alias("i", "a"), "x").select("a", F.explode(F.slice("x", F.col("i") + 2, SMALL)).alias("b"))
    links = stash(confirm(likely(star.union(each))), "links")
    merged = stash(components(own.union(links), "near-components"), "near-merged")
    large = in_bucket.where(F.col("members") > SMALL)
    in_buckets = in_bucket.count()
    diagonal = F.col("table") % (TABLES + 1) == 0

    def dealt(rows: DataFrame, most: int, weight: int) -> DataFrame:
        """Rows of buckets, block by block: all on side 0, those outside the largest component on side 1."""
        minor = F.col("comp") != F.col("main")
        blocks = lambda n, w: F.ceil(F.greatest(n / most, w / weight)).cast("int")
        per = rows.groupBy("bucket").agg(blocks(F.count("*"), F.sum("n_shingles")).alias("ps"), blocks(F.count_if(minor), F.sum(F.when(minor, F.col("n_shingles")))).alias("qs"), F.count("*").alias("n"))
        block = lambda n: F.pmod(F.xxhash64("rep", "bucket"), F.col(n)).cast("int")
        placed = joined_by_size(rows, per, ["bucket"], "n", in_buckets).withColumn("p", block("ps")).withColumn("q", block("qs"))
        every = placed.withColumn("q", F.explode(F.expr("sequence(0, qs - 1)"))).withColumn("side", F.lit(0))
        rest = placed.where(minor).withColumn("p", F.explode(F.expr("sequence(0, ps - 1)"))).withColumn("side", F.lit(1))
        return every.unionByName(rest).drop("ps", "qs")

    def grouped(rows: DataFrame) -> DataFrame:
        return rows.repartition("bucket", "p", "q").sortWithinPartitions("bucket", "p", "q")

    for turn in (large.where(diagonal), large.where(~diagonal)):
        now = turn.join(side(merged.select(F.col("id").alias("rep"), F.col("component_id").alias("c"))), "rep", "left").select("bucket", "table", "rep", "n_shingles", "sig", F.coalesce("c", "rep").alias("comp"))
        now = stash(now, "bucket-components")
        parts = now.groupBy("bucket", "comp").agg(F.count("*").alias("n"))
        split = stash(parts.groupBy("bucket").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.count("*").alias("comps"), F.sum("n").alias("members")).where("comps > 1").drop("comps"), "open-buckets")
        rows_ = stash(joined_by_size(now, split, ["bucket"], "members", in_buckets).join(reps.select("rep", "n_shingles", "sig", "keys").hint("merge"), ["rep", "n_shingles", "sig"]), "open-rows")
        some = stash(grouped(dealt(rows_, SCREEN_ROWS, 1 << 62)).transform(arrow, _open(percent), "bucket long, rep long, n_shingles long, comp long, main long").distinct(), "open-pairs")
        if some.isEmpty():
            drop_stash(rows_)
            continue
        dealt_ = grouped(dealt(some, BLOCK_ROWS, BLOCK_SHINGLES).join(sets.withColumnRenamed("doc_id", "rep").hint("merge"), "rep").where("octet_length(set) = 8 * n_shingles"))
        more = stash(dealt_.transform(arrow, _blocks(percent), "a long, b long"), "links")
        drop_stash(rows_)
        if not more.isEmpty():
            merged = stash(components(merged.select(F.col("id").alias("a"), F.col("component_id").alias("b")).union(more), "near-components"), "near-merged")
    for done in (in_bucket, alike, sets):
        drop_stash(done)
    label = same.join(side(merged.withColumnRenamed("id", "rep")), "rep", "left").select("s1", "s2", "n_shingles", "rep", "rows", F.coalesce("component_id", "rep").alias("component_id"))
    out = classed(rows.select("doc_id", "n_shingles", "s1", "s2"), label)
    if n_several:
        theirs = side(own.select(F.col("a").alias("doc_id")).distinct(), n_several)
        out = out.join(side(merged.select(F.col("id").alias("doc_id"), F.col("component_id").alias("_own")).join(theirs, "doc_id"), n_several), "doc_id", "left")
        out = out.withColumn("component_id", F.coalesce("_own", "component_id"))
    return out.select("doc_id", "n_shingles", "component_id")


def known_ids(rows: DataFrame) -> DataFrame:
    """The ids that rows with different sets share."""
    return stash(rows.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("s1").alias("a"), F.max("s1").alias("b"), F.min("s2").alias("c"), F.max("s2").alias("d")).where("a <> b OR c <> d").select("doc_id"), "ids-of-several")


def classed(rows: DataFrame, label: DataFrame) -> DataFrame:
    """rows (doc_id, n_shingles, s1, s2) with component_id, the class's where it has other rows or links, else the row's own id.

    Large groups of copies are joined by broadcast of their classes, so no task gathers one.
    """
    keys = ["s1", "s2", "n_shingles"]
    label = stash(label.where("rows > 1 OR component_id <> rep").select(*keys, "rows", "component_id"), "labels")
    named, unnamed = rows.where("doc_id IS NOT NULL"), rows.where("doc_id IS NULL")
    out = joined_by_size(named, label, keys, "rows", rows.count(), "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.union(unnamed.select("doc_id", "n_shingles", F.col("doc_id")))


def dedup(docs: DataFrame, percent: int = 85, k: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id, kept."""
    return classes(docs, percent, k).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def first_of_each(docs: DataFrame, percent: int = 80, k: int = SHINGLE) -> DataFrame:
    """The rows of docs but for those with a smaller id among their near-duplicates.

    0.8 is the similarity of stages on word shingles in general; the query op5 has a contract of its own, with 0.85.
    """
    gone = classes(docs, percent, k).where("component_id < doc_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")


def op5(spark, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents", "doc_id", "text"))


ORACLE = rf"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + {SHINGLE - 1}], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {SHINGLE - 2}, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y USING (g) WHERE x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id),
e AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 85 * (p.n + q.n - k)),
l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.doc_id WHERE r.c < l.b),
m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept FROM d LEFT JOIN n USING (doc_id) JOIN m USING (doc_id)
"""
