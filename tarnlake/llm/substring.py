"""Substring dedup: spans of 50 or more words that repeat across documents, by compacting a de Bruijn graph.

The graph's edges are the windows of `window` consecutive words, its nodes the k-mers in them. Walking along a
document, consecutive windows that share their smallest k-mer form a path; such a path is one compact row (k-mer,
hash of its words, document, coordinates) in place of up to window - k + 1 edges. A join by k-mer finds the
paths that meet at a node of several documents. The node does not branch if all that meet there hold the same
words around it: each path then has a source, the same path of the smallest document. Neighbouring paths of one
document with one source at the same distance are joined to a long span. Paths at branching nodes are taken apart
into their edges, which are compared one by one. Equal windows always share their smallest k-mer, so no repeat is
lost.

What the graph says by 64-bit hashes is verified at the source coordinates: the words of each span and of its source
are read again and compared by 128-bit BLAKE2 digests of the exact words; edges are compared by such digests in the
first place. Should one span fail (a collision of hashes), all repeated nodes are taken apart into edges.

Defined results: a null text has no words; documents with a null id neither remove nor lose words; rows of one
id count as one document, each with its own text; windows are judged on the input; repeats within one document
stay; extra columns are ignored by dedup() and kept by without_repeats(). A text is one row of work; the longest one
bounds a task's memory.
"""

from __future__ import annotations

import hashlib
from hashlib import blake2b
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnlake.llm.common import arrow, drop_stash, stash, table
from tarnlake.llm.textscan import Runs, U, Words, pieces, texts

WINDOW = 50
KMER = 10
_TOP = np.iinfo(np.uint64).max


def smallest(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each run of `width` values (doubling: about log2(width) passes)."""
    out, have = values, 1
    while 2 * have <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


class Paths:
    """The paths of a piece: word positions in the piece (start of first and last window), k-mer, text."""

    def __init__(self, words: Words, window: int, kmer: int):
        self.runs = Runs(h := words.hashes())
        n, end = len(h), np.repeat(words.first[1:], words.per_text)
        at = np.arange(n)
        self.start = self.last = self.key = self.text = np.zeros(0, np.int64)
        if n < window:
            return
        g = np.full(n, _TOP, U)
        ok = at + kmer <= end
        g[ok] = self.runs.hash(at[ok], at[ok] + kmer)
        bits = U(max(24, int(n).bit_length()))
        low = smallest(((g >> bits) << bits) | at.astype(U), window - kmer + 1)
        whole = np.flatnonzero(at[: len(low)] + window <= end[: len(low)])
        if not len(whole):
            return
        anchor = (low[whole] & ((U(1) << bits) - U(1))).astype(np.int64)
        new = np.ones(len(whole), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (whole[1:] != whole[:-1] + 1)
        begin = np.flatnonzero(new)
        self.start, self.last = whole[begin], whole[np.append(begin[1:], len(whole)) - 1]
        self.key = g[anchor[begin]].view(np.int64)
        self.text = np.searchsorted(words.first, self.start, side="right") - 1

    def content(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return self.runs.hash(start, end).view(np.int64)


def _text_ids(words: Words, runs: Runs) -> np.ndarray:
    return runs.hash(words.first[:-1], words.first[1:]).view(np.int64)


_PATHS = "doc_id long, tid long, paths array<struct<key:long,s:int,e:int,h:long>>"


def _paths(window: int, kmer: int):
    def run(batches):
        for batch in batches:
            for piece in pieces(batch):
                w = Words(*texts(piece.column("text")))
                p = Paths(w, window, kmer)
                base = w.first[p.text]
                rows = pa.StructArray.from_arrays([pa.array(p.key), pa.array((p.start - base).astype(np.int32)), pa.array((p.last - base).astype(np.int32)), pa.array(p.content(p.start, p.last + window))], ["key", "s", "e", "h"])
                ends = np.searchsorted(p.text, np.arange(len(w.per_text) + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(_text_ids(w, p.runs)), pa.ListArray.from_arrays(pa.array(ends), rows)], names=["doc_id", "tid", "paths"])

    return run


#: What is read again of a document's text: the edges of the windows that start from s to e, the words from s to e
#: of a span with its source's coordinates, the words from s to e of a source.
_EDGES, _SPAN, _SOURCE = range(3)
_PARTS = "array<struct<kind:int,tid:long,s:int,e:int,src:long,src_s:int,src_e:int>>"
_DIGESTS = "kind int, doc_id long, tid long, s int, e int, src long, src_s int, src_e int, h1 long, h2 long"


def _digests(window: int):
    """BLAKE2 digests of the exact words of edges, spans and sources, from rows doc_id, text, parts."""

    def run(batches):
        for batch in batches:
            for piece in pieces(batch):
                w = Words(*texts(piece.column("text")))
                tid = _text_ids(w, Runs(w.hashes()))
                out: list[tuple] = []
                read: list[bytes] = []
                for i, parts in enumerate(piece.column("parts").to_pylist()):
                    words = w.buf[w.offs[i] : w.offs[i + 1]].tobytes().split()
                    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
                    at = (np.cumsum(size) - size).tolist() + [int(size.sum())]
                    exact = memoryview(b" ".join(words) + b" ")
                    doc = piece.column("doc_id")[i].as_py()
                    for x in parts:
                        if x["kind"] != _SOURCE and x["tid"] != tid[i]:
                            continue  # of another text with this id
                        if x["kind"] == _EDGES:
                            for s in range(x["s"], x["e"] + 1):
                                out.append((_EDGES, doc, x["tid"], s, s + window, None, None, None))
                                read.append(blake2b(exact[at[s] : at[s + window]], digest_size=16).digest())
                        elif x["e"] <= len(words):
                            out.append((x["kind"], doc, x["tid"], x["s"], x["e"], x["src"], x["src_s"], x["src_e"]))
                            read.append(blake2b(exact[at[x["s"]] : at[x["e"]]], digest_size=16).digest())
                h = np.frombuffer(b"".join(read), np.int64).reshape(-1, 2)
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32())
                columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * len(kinds), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy())], names=[c.split()[0] for c in _DIGESTS.split(", ")])

    return run


def spans(claims: DataFrame, window: int) -> DataFrame:
    """Neighbouring paths (doc_id, tid, s, e, src, src_s) with one source at one distance joined: word ranges, end exclusive, with the source's."""
    w = Window.partitionBy("doc_id", "tid", "src", "off").orderBy("s", "e")
    off = claims.withColumn("off", F.col("s") - F.col("src_s"))
    before = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = off.withColumn("new", F.coalesce(F.col("s") > before + 1, F.lit(True)).cast("int")).withColumn("span", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    joined = new.groupBy("doc_id", "tid", "src", "off", "span").agg(F.min("s").alias("s"), (F.max("e") + window).alias("e"))
    return joined.select("doc_id", "tid", "s", "e", "src", (F.col("s") - F.col("off")).alias("src_s"), (F.col("e") - F.col("off")).alias("src_e"))


def repeats(docs: DataFrame, window: int = WINDOW, kmer: int = KMER) -> DataFrame:
    """doc_id, gone: for each document with repeats, (tid, s, e) word ranges, end exclusive, that a smaller doc_id holds too."""
    known = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = stash(known.transform(arrow, _paths(window, kmer), _PATHS), "paths")
    paths = rows.select("doc_id", "tid", F.explode("paths").alias("p")).select("doc_id", "tid", "p.*")
    nodes = paths.groupBy("key").agg(F.min("doc_id").alias("src"), F.max("doc_id").alias("last"), F.min_by("s", "doc_id").alias("src_s"), F.min("h").alias("low"), F.max("h").alias("high")).where("src < last")
    # A table of its own on one side of the join: Spark can then split a hot node's paths on the other.
    nodes = stash(nodes.select(F.col("key").alias("k"), "src", "src_s", F.expr("low <> high").alias("branching")), "repeated-nodes")

    def decided(branching: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        met = stash(paths.join(nodes, F.col("key") == F.col("k")).where(f"({branching}) OR doc_id > src").select("doc_id", "tid", "s", "e", "src", "src_s", F.expr(branching).alias("branching")), "paths-met")
        sure = spans(met.where("NOT branching"), window)
        none = [F.lit(None).cast(t).alias(n) for n, t in (("src", "long"), ("src_s", "int"), ("src_e", "int"))]
        edges = met.where("branching").select(F.lit(_EDGES).alias("kind"), "doc_id", "tid", "s", "e", *none)
        sources = sure.select(F.lit(_SOURCE).alias("kind"), F.col("src").alias("doc_id"), F.lit(None).cast("long").alias("tid"), F.col("src_s").alias("s"), F.col("src_e").alias("e"), *none).distinct()
        every = edges.union(sure.select(F.lit(_SPAN), "doc_id", "tid", "s", "e", "src", "src_s", "src_e")).union(sources)
        open_ = every.groupBy(F.col("doc_id").alias("o")).agg(F.collect_list(F.struct("kind", "tid", "s", "e", "src", "src_s", "src_e")).alias("parts"))
        read = stash(known.join(open_, F.col("doc_id") == F.col("o")).select("doc_id", "text", "parts").transform(arrow, _digests(window), _DIGESTS), "digests")
        found = read.where(f"kind = {_SPAN}")
        # Each of a source's spans once, however many documents hold it.
        said = found.select("src", "src_s", "src_e", "h1", "h2").distinct()
        held = read.where(f"kind = {_SOURCE}").select(F.col("doc_id").alias("src"), F.col("s").alias("src_s"), F.col("e").alias("src_e"), "h1", "h2").distinct()
        return read.where(f"kind = {_EDGES}"), found.select("doc_id", "tid", "s", "e"), said.join(held, ["src", "src_s", "src_e", "h1", "h2"], "left_anti")

    edges, sure, failed = decided("branching")
    if not failed.isEmpty():
        edges, sure, _ = decided("true")
    drop_stash(rows)
    first = edges.groupBy("h1", "h2").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc")).where("first_doc < last_doc")
    first = stash(first.drop("last_doc"), "repeated-edges")
    found = edges.join(first, ["h1", "h2"]).where("doc_id > first_doc").select("doc_id", "tid", "s", "e")
    return sure.union(found).groupBy("doc_id").agg(F.collect_list(F.struct("tid", "s", "e")).alias("gone"))


def _kept(piece: pa.RecordBatch):
    """For each row its words and a mask of those that stay (None: all)."""
    w = Words(*texts(piece.column("text")))
    tid = _text_ids(w, Runs(w.hashes()))
    for i, (text, gone) in enumerate(zip(piece.column("text").to_pylist(), piece.column("gone").to_pylist(), strict=True)):
        words = (text or "").encode().split()
        ranges = [x for x in gone or () if x["tid"] == tid[i]]
        if not ranges:
            yield words, None
            continue
        step = np.zeros(len(words) + 1, np.int64)
        np.add.at(step, [x["s"] for x in ranges], 1)
        np.add.at(step, [x["e"] for x in ranges], -1)
        yield words, np.cumsum(step)[:-1] == 0


def _digest(batches):
    for batch in batches:
        for piece in pieces(batch):
            out = []
            for words, stay in _kept(piece):
                left = words if stay is None else list(compress(words, stay))
                out.append((len(words), len(words) - len(left), hashlib.sha256(b" ".join(left)).hexdigest()))
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), *(pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string())))], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def _joined(docs: DataFrame, found: DataFrame) -> DataFrame:
    f = found.withColumnRenamed("doc_id", "_g")
    return docs.join(f, docs["doc_id"] == f["_g"], "left").drop("_g")


def dedup(docs: DataFrame, window: int = WINDOW, kmer: int = KMER) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _joined(rows, repeats(docs, window, kmer)).transform(arrow, _digest, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def without_repeats(docs: DataFrame, window: int = WINDOW, kmer: int = KMER) -> DataFrame:
    """The rows of docs; texts with repeats are what is left of their words, joined by single spaces."""
    at, schema = docs.columns.index("text"), docs.schema

    def run(batches):
        for batch in batches:
            for piece in pieces(batch):
                old = piece.column("text").to_pylist()
                new = [old[i] if stay is None else b" ".join(compress(words, stay)).decode() for i, (words, stay) in enumerate(_kept(piece))]
                columns = [piece.column(c) for c in schema.names]
                columns[at] = pa.array(new, columns[at].type)
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return _joined(docs, repeats(docs, window, kmer)).transform(arrow, run, schema)


def op7(spark, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents", "doc_id", "text"))


ORACLE = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS n, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents),
p AS (SELECT doc_id, n, words, unnest(range(1, len(words) - {WINDOW - 2})) AS s FROM d WHERE len(words) >= {WINDOW}),
w AS (SELECT doc_id, n, s, md5(array_to_string(words[s:s + {WINDOW - 1}], ' ')) AS h FROM p),
f AS (SELECT h, min(doc_id) AS first_doc FROM w GROUP BY h HAVING min(doc_id) < max(doc_id)),
r AS (SELECT n, list(DISTINCT s) AS ss FROM w JOIN f USING (h) WHERE doc_id > first_doc GROUP BY n),
g AS (SELECT n, i FROM (SELECT n, unnest(ss) AS s FROM r), range(0, {WINDOW}) AS o(k), LATERAL (SELECT s + k AS i) GROUP BY n, i),
gone AS (SELECT n, count(*) AS n_removed, list(i) AS gone FROM g GROUP BY n)
SELECT doc_id, len(words) AS n_words, coalesce(n_removed, 0) AS n_removed,
    sha256(array_to_string(CASE WHEN gone IS NULL THEN words ELSE list_transform(list_filter(list_zip(words, range(1, len(words) + 1)), lambda x: NOT list_contains(gone, x[2])), lambda x: x[1]) END, ' ')) AS kept_sha256
FROM d LEFT JOIN gone USING (n)
"""
