"""Quality classifier: a generalised additive model with pairwise interactions.

Per-feature lookup tables are learnt by cyclic boosting of shallow trees (each step adds one two-split tree
of one feature, feature after feature); tables of feature pairs are learnt the same way on what is left.
A score is the sigmoid of a sum of table entries, so scoring is binning plus additions, vectorised per batch.

Features come from the whole text alone. Training uses at most `max_rows` labelled rows, those with the
smallest hash of their id; everything else covers all rows.

Defined results: a null or empty text has the features of zero bytes and gets a score like any other; a null
id counts as not held out and is never a training row; repeated rows are scored each; several labels of one
id count as several training rows; labels other than 0 and 1 are left out; without usable training rows of
both classes every score is the prior (0.5 without any). Extra columns of the input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnlake.llm.common import arrow, crc_mod, table
from tarnlake.llm.textscan import SPACE, U, Words, distinct_per_text, mix, per_text, pieces, texts

FEATURES = (
    "log_bytes", "upper", "symbols", "exclaim", "bars", "digits", "spaces", "lines", "high_bytes", "word_length",
    "distinct_words", "same_as_last", "sentence_ends", "short_words", "repeated_lines", "top_word", "distinct_pairs", "upper_words",
)


def _set(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_UPPER = _set(bytes(range(65, 91)))
_DIGIT = _set(b"0123456789")
_SYMBOL = _set(b"#$%&*+<=>@[\\]^_`{}~/")
_END = _set(b".?!:;,")


def features(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each text."""
    n = len(offs) - 1
    size = np.diff(offs)
    some = np.maximum(size, 1)
    w = Words(buf, offs)
    words, doc = w.per_text, w.text_of()
    any_words = np.maximum(words, 1)
    h = w.hashes()
    by_text = lambda flag: np.bincount(doc, flag, n)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    d, _, count = distinct_per_text(doc, h, n)
    top = np.zeros(n)
    np.maximum.at(top, d, count)
    pair = mix(h[:-1] ^ (h[1:] * U(3)))[doc[1:] == doc[:-1]] if len(h) else h
    pair_doc = doc[:-1][doc[1:] == doc[:-1]] if len(h) else doc
    pairs = np.bincount(pair_doc, minlength=n)
    d2, _, _ = distinct_per_text(pair_doc, pair, n)
    # Lines: runs of bytes between line feeds, by the hash of what they hold.
    last = np.zeros(len(buf), bool)
    last[buf == 10] = True
    last[offs[1:][size > 0] - 1] = True
    ends = np.flatnonzero(last) + 1
    begins = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    line_doc = np.searchsorted(offs, begins, side="right") - 1
    before = np.searchsorted(w.start, begins)
    after = np.searchsorted(w.start, ends)
    total = np.zeros(len(h) + 1, U)
    np.cumsum(mix(h), out=total[1:])  # word order within a line does not matter here
    full = after > before
    lines = np.bincount(line_doc[full], minlength=n)
    d3, _, _ = distinct_per_text(line_doc[full], (total[after] - total[before])[full], n)
    long_ = w.end - w.start
    out = [
        np.log1p(size), per_text(_UPPER[buf], offs) / some, per_text(_SYMBOL[buf], offs) / some, per_text(buf == 33, offs) / some, per_text(buf == 124, offs) / some,
        per_text(_DIGIT[buf], offs) / some, per_text(SPACE[buf], offs) / some, per_text(buf == 10, offs) / some, per_text(buf > 127, offs) / some, by_text(long_) / any_words,
        np.bincount(d, minlength=n) / any_words, by_text(same) / any_words, by_text(_END[buf[w.end - 1]] if len(h) else same) / any_words, by_text(long_ <= 3) / any_words,
        1 - np.bincount(d3, minlength=n) / np.maximum(lines, 1) * (lines > 0) - (lines == 0), top / any_words, np.bincount(d2, minlength=n) / np.maximum(pairs, 1), by_text(_UPPER[buf[w.start]] if len(h) else same) / any_words,
    ]
    return np.stack(out, 1)


@dataclass
class Gam:
    """Bin edges, one table for each feature, and tables of feature pairs on coarser bins."""

    edges: list[np.ndarray]
    tables: list[np.ndarray]
    base: float
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for k, (edges, values) in enumerate(zip(self.edges, self.tables, strict=True)):
            out += values[np.searchsorted(edges, x[:, k], side="right")]
        for i, j, values in self.pairs:
            out += values[np.searchsorted(self.coarse[i], x[:, i], side="right"), np.searchsorted(self.coarse[j], x[:, j], side="right")]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.arange(1, bins) / bins, method="higher"))


def _tree(g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    """Leaf values, bin by bin, of the best tree with two splits on ordered bins."""
    out = np.zeros(len(g))
    parts = [(0, len(g))]
    for _ in range(2):
        best = (1e-9, None)
        for p, (a, b) in enumerate(parts):
            if b - a < 2:
                continue
            cg, ch = np.cumsum(g[a:b]), np.cumsum(h[a:b])
            gain = cg[:-1] ** 2 / (ch[:-1] + ridge) + (cg[-1] - cg[:-1]) ** 2 / (ch[-1] - ch[:-1] + ridge) - cg[-1] ** 2 / (ch[-1] + ridge)
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (gain[k], (p, a + k + 1))
        if best[1] is None:
            break
        p, cut = best[1]
        a, b = parts[p]
        parts[p : p + 1] = [(a, cut), (cut, b)]
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + ridge)
    return out


def fit(x: np.ndarray, y: np.ndarray, bins: int = 64, coarse_bins: int = 8, rounds: int = 150, pair_rounds: int = 40, pairs: int = 12, rate: float = 0.15, ridge: float = 2.0) -> Gam:
    """Cyclic boosting of the log loss, first one feature at a time, then the pairs that explain most of the rest."""
    n, k = x.shape
    if n == 0 or y.min() == y.max():
        prior = (y.sum() + 0.5) / (n + 1)
        return Gam([np.zeros(0)] * k, [np.zeros(1)] * k, float(np.log(prior / (1 - prior))))
    prior = y.mean()
    model = Gam([_edges(x[:, f], bins) for f in range(k)], [], float(np.log(prior / (1 - prior))))
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    model.coarse = [_edges(x[:, f], coarse_bins) for f in range(k)]
    binned = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(model.edges)]
    margin = np.full(n, model.base)
    for _ in range(rounds):
        for f in range(k):
            p = 1 / (1 + np.exp(-margin))
            m = len(model.tables[f])
            step = rate * _tree(np.bincount(binned[f], y - p, m), np.bincount(binned[f], p * (1 - p), m), ridge)
            model.tables[f] += step
            margin += step[binned[f]]
    small = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(model.coarse)]
    width = [len(e) + 1 for e in model.coarse]
    p = 1 / (1 + np.exp(-margin))
    gains = []
    for i in range(k):
        for j in range(i + 1, k):
            cell = small[i] * width[j] + small[j]
            g, h = np.bincount(cell, y - p, width[i] * width[j]), np.bincount(cell, p * (1 - p), width[i] * width[j])
            gains.append((float((g**2 / (h + ridge)).sum()), i, j))
    for _, i, j in sorted(gains, reverse=True)[:pairs]:
        model.pairs.append((i, j, np.zeros((width[i], width[j]))))
    for _ in range(pair_rounds):
        for i, j, values in model.pairs:
            cell = small[i] * width[j] + small[j]
            p = 1 / (1 + np.exp(-margin))
            g, h = np.bincount(cell, y - p, values.size), np.bincount(cell, p * (1 - p), values.size)
            # A tree on the first feature, each leaf split again by a tree on the second.
            step = np.zeros(values.shape)
            g2, h2 = g.reshape(values.shape), h.reshape(values.shape)
            first = _tree(g2.sum(1), h2.sum(1), ridge)
            for leaf in np.unique(first):
                rows = first == leaf
                step[rows] = _tree(g2[rows].sum(0), h2[rows].sum(0), ridge)
            values += rate * step
            margin += rate * step.ravel()[cell]
    return model


_FEATURE_SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("x", T.ArrayType(T.DoubleType()))])


def _feature_rows(batches):
    for batch in batches:
        for piece in pieces(batch):
            x = features(*texts(piece.column("text")))
            flat = pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), flat], names=["doc_id", "x"])


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 24000) -> Gam:
    """Fits on the labelled rows whose crc32(doc_id) mod 3 is not 1, at most max_rows of them."""
    usable = labels.select("doc_id", "quality").where(F.col("quality").isin(0, 1) & (crc_mod(F.col("doc_id"), 3) != 1))
    picked = usable.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(max_rows)
    chosen = F.broadcast(picked.select("doc_id").distinct())  # at most max_rows ids
    rows = docs.select("doc_id", "text").join(chosen, "doc_id", "left_semi").transform(arrow, _feature_rows, _FEATURE_SCHEMA)
    got = rows.join(F.broadcast(picked), "doc_id").orderBy("doc_id", "quality").toPandas()
    x = np.stack(got["x"].to_list()) if len(got) else np.zeros((0, len(FEATURES)))
    return fit(x, got["quality"].to_numpy(dtype=float))


def score(docs: DataFrame, model: Gam) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs."""

    def run(batches):
        for batch in batches:
            for piece in pieces(batch):
                s = model.score(features(*texts(piece.column("text"))))
                yield pa.RecordBatch.from_arrays([*(piece.column(k) for k in ("doc_id", "held_out")), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "text")
    return rows.transform(arrow, run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: Gam, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, with their columns, whose score is at least threshold."""
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            for piece in pieces(batch):
                good = model.score(features(*texts(piece.column(at)))) >= threshold
                yield piece.filter(pa.array(good))

    return docs.transform(arrow, run, docs.schema)


def op8(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
