"""LM scoring by context-tree weighting over binary-decomposed bytes.

A byte is eight binary decisions (the node of a binary tree over bytes), each in the context of the `DEPTH`
bytes before it. At every context and node the Krichevsky-Trofimov estimate of what training texts had there
competes with what longer contexts say: P = KT / 2 + (product over one byte more of context) / 2. Scoring uses
the tree as training left it: the probability of a decision mixes the estimates of all depths, each context
weighted by its share KT / (2 P) of its subtree's probability. The sum over a text's bytes and an end symbol
(byte 0xFF, which UTF-8 never has) is the log10 probability of the text; contexts begin with zero bytes.
Texts are scored with A-Z lower-cased, as are the tokens of the unigram base.

How it is spread: a byte with its context is one number, so the tree is built from counts of (DEPTH + 1)-grams.
Texts are dealt into chunks of about `chunk_bytes`. A chunk asks for the values of the distinct words and grams
it holds: it sends packed arrays of sorted keys with its own counts to buckets of the key space (the more, the more
text; a bucket holds whole contexts of three bytes). The chunks' arrays of a bucket are added up by a tree, `FAN`
at a time, so that no task holds more than that many of them however common a context is; the answers come
back down the same tree, each array as long as what was asked. What buckets of one two-byte context have in common,
its nodes of depth 2, is added up by an aggregation over all buckets and sent back to them. Only depths 0 and 1, at
most 256 * 256 nodes, and two totals pass through the driver. No vocabulary is broadcast or collected.

Scores do not depend on how many chunks and buckets there are. Words are told apart by 63-bit hashes. Defined results:
a null text is empty (one end token); a null id is not held out; repeated rows are trained on and scored each (rows
equal in id and text are in one chunk); without training texts N and V are 0 and the model gives one half to each
decision; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlake.llm.common import arrow, crc_mod, stash, table
from tarnlake.llm.lattice import runs_of
from tarnlake.llm.textscan import LOWER, U, Words, pieces, texts

DEPTH = 5
CHUNK_BYTES = 32 << 20
LEAST_CHUNKS = 8
#: Bytes of text for each bucket of words and each of grams.
BUCKET_BYTES = 4 << 20
TASK_BUCKETS = 8
#: Arrays of one bucket that a task adds up at a time.
FAN = 64
#: A bucket of grams is told by at most these bits of the key: the three last bytes of context.
_MOST_BITS = 24
_END_TOKEN = 0
_WORD_BITS = 63
#: The last two context bytes times this, mod 2**16, are a gram's bucket bits: frequent pairs lie apart.
_SPREAD = 40503


def _pack(values: np.ndarray, sorted_keys: bool = False) -> bytes:
    """64-bit values with like bytes side by side (differences, where they are sorted keys), compressed."""
    v = np.diff(values, prepend=values.dtype.type(0)) if sorted_keys else values
    planes = np.ascontiguousarray(v.view(np.uint8).reshape(-1, 8).T).tobytes()
    return len(v).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def _unpack(data: bytes, kind, sorted_keys: bool = False) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.decompress(data[8:], 8 * n, codec="zstd"), np.uint8).reshape(8, n)
    v = np.ascontiguousarray(planes.T).view(kind).ravel()
    return np.cumsum(v) if sorted_keys else v


def word_keys(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """63-bit keys of the words and the end token of each text, and where each text's begin (one more entry)."""
    w = Words(buf, offs)
    keys = ((w.hashes() >> U(1)) | U(1)).view(np.int64)
    first = w.first + np.arange(len(w.first))
    out = np.full(first[-1], _END_TOKEN, np.int64)
    inside = np.ones(len(out), bool)
    inside[first[1:] - 1] = False
    out[inside] = keys
    return out, first


def gram_keys(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each byte and the end of each text, DEPTH bytes of context and the byte itself as one number."""
    n, size = len(offs) - 1, np.diff(offs)
    pad = DEPTH + 1
    wide = np.zeros(len(buf) + pad * n, np.int64)
    at = np.arange(len(buf)) + np.repeat(pad * np.arange(n) + DEPTH, size)
    wide[at] = buf
    ends = offs[1:] + pad * np.arange(1, n + 1) - 1
    wide[ends] = 255
    code = np.zeros(len(wide), np.int64)
    for k in range(3, DEPTH + 1):  # the bytes before the last two, the oldest in front
        code[k:] |= wide[: len(wide) - k] << (8 * (k - 2))
    code |= wide
    pair = np.zeros(len(wide), np.int64)
    pair[1:] = wide[:-1]
    pair[2:] |= wide[:-2] << 8
    code |= (pair * _SPREAD & 0xFFFF) << (8 * (DEPTH - 1))
    real = np.ones(len(wide), bool)
    starts = offs[:-1] + pad * np.arange(n)
    for k in range(DEPTH):
        real[starts + k] = False
    return code[real], offs + np.arange(n + 1)


_KINDS = ((word_keys, _WORD_BITS), (gram_keys, 8 * (DEPTH + 1)))
_ASKED = "chunk int, bucket int, keys binary, counts binary"


def _merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys of several lists, and their counts added up."""
    keys, counts = (np.concatenate([h[k] for h in held]) for k in range(2))
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]]))
    return keys[at], np.add.reduceat(counts, at) if len(at) else counts


class Places:
    """Where each of some 64-bit keys is in their array: open addressing, at most half full. Of equal keys, any."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, (2 * len(keys)).bit_length())
        self.keys, self.shift, self.mask = keys, U(64 - bits), (1 << bits) - 1
        self.slots = np.full(1 << bits, -1, np.int32 if len(keys) < 1 << 31 else np.int64)
        todo, at = np.arange(len(keys), dtype=self.slots.dtype), self._first(keys)
        while len(todo):
            free = self.slots[at] < 0
            self.slots[at[free]] = todo[free]
            on = self.slots[at] != todo
            todo, at = todo[on], at[on] + 1 & self.mask

    def _first(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * U(0x9E3779B97F4A7C15)) >> self.shift).view(np.int64)

    def of(self, keys: np.ndarray) -> np.ndarray:
        """The place of each of these keys, which must all be there."""
        at = self._first(keys)
        out = self.slots[at]
        open_ = np.flatnonzero(self.keys[out] != keys) if len(keys) else at
        at = at[open_]
        while len(open_):
            if (out[open_] < 0).any():
                raise KeyError("a key without an answer")
            at = at + 1 & self.mask
            out[open_] = self.slots[at]
            on = self.keys[out[open_]] != keys[open_]
            open_, at = open_[on], at[on]
        return out


def _asked(bits: int):
    """Per chunk and bucket (2**bits of words, then as many of grams) its distinct keys with how often training texts of the chunk have them."""

    def rows(chunk, held):
        out = []
        for kind, (_, width) in enumerate(_KINDS):
            keys, counts = _merged(held[kind])
            cuts = np.searchsorted(keys, np.arange(1, 1 << bits) << (width - bits))
            for bucket, (k, n) in enumerate(zip(np.split(keys, cuts), np.split(counts, cuts), strict=True)):
                if len(k):
                    out.append((int(chunk), bucket + (kind << bits), _pack(k, True), _pack(n.astype(np.int64))))
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names=["chunk", "bucket", "keys", "counts"])

    def run(batches):
        held: tuple[list, list] = ([], [])
        chunk = None
        for batch in batches:
            for piece in pieces(batch):
                chunks = np.asarray(piece.column("chunk"))
                cuts = [0, *(np.flatnonzero(chunks[1:] != chunks[:-1]) + 1).tolist(), len(chunks)]
                for a, b in zip(cuts, cuts[1:], strict=False):
                    part = piece.slice(a, b - a)
                    if held[0] and chunks[a] != chunk:
                        yield rows(chunk, held)
                        held = ([], [])
                    chunk = chunks[a]
                    buf, offs = texts(part.column("text"))
                    low = LOWER[buf]
                    train = part.column("train").to_numpy(zero_copy_only=False).astype(bool)
                    for mine, (kind, _) in zip(held, _KINDS, strict=True):
                        keys, first = kind(low, offs)
                        learnt = np.repeat(train, np.diff(first))
                        other = np.unique(keys[~learnt])
                        mine += [np.unique(keys[learnt], return_counts=True), (other, np.zeros(len(other), np.int64))]
                        if len(mine) > 32:
                            mine[:] = [_merged(mine)]
        if held[0]:
            yield rows(chunk, held)

    return run


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln gamma for x > 0: Stirling's series after shifting x by 8."""
    y = x + 8
    shift = np.log(x * (x + 1) * (x + 2) * (x + 3)) + np.log((x + 4) * (x + 5) * (x + 6) * (x + 7))
    r = 1 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r / 1680))) / y - shift


def kt_log(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of n0 zeros and n1 ones."""
    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - log_gamma(n0 + n1 + 1.0) - math.log(math.pi)


def _shorter(context: np.ndarray, extra: int) -> np.ndarray:
    return context >> (8 * extra) << (8 * extra - 8) | context & ((1 << (8 * extra - 8)) - 1)


class Layer:
    """Nodes of one depth: sorted keys (context * 256 + binary node), counts, ln KT and ln P."""

    def __init__(self, key: np.ndarray, n0: np.ndarray, n1: np.ndarray, below: np.ndarray | None):
        self.key, self.n0, self.n1, self.below = key, n0, n1, below
        self.kt = kt_log(n0, n1)
        self.p = self.kt if below is None else np.logaddexp(self.kt, below) - math.log(2)

    def up(self, extra: int) -> Layer:
        """The layer of contexts without their oldest byte, the highest of `extra` ones below the rest of the key's context."""
        key, at = np.unique(_shorter(self.key >> 8, extra) << 8 | (self.key & 255), return_inverse=True)
        add = lambda v: np.bincount(at, v, len(key))
        return Layer(key, add(self.n0), add(self.n1), add(self.p))

    def mixed(self, key: np.ndarray, bit: np.ndarray, deeper: np.ndarray | None) -> np.ndarray:
        """The probability of `bit` at each node in key, given what longer contexts say."""
        at = np.searchsorted(self.key, key)
        own = (np.where(bit == 1, self.n1[at], self.n0[at]) + 0.5) / (self.n0[at] + self.n1[at] + 1)
        if deeper is None:
            return own
        share = np.exp(self.kt[at] - self.p[at] - math.log(2))
        return share * own + (1 - share) * deeper


def _layers(code: np.ndarray, n: np.ndarray) -> tuple[list[Layer], np.ndarray, np.ndarray, np.ndarray]:
    """Layers of depths DEPTH to 2 of a bucket's grams (depth 2 only as far as the bucket goes); node, bit and context of each gram's decisions."""
    x = code & 255
    j = np.arange(8)
    node = (1 << j) | (x[:, None] >> (8 - j))
    bit = (x[:, None] >> (7 - j)) & 1
    context = code >> 8
    keys, at = np.unique((context[:, None] << 8 | node).ravel(), return_inverse=True)
    weight = np.repeat(n.astype(float), 8)
    flat = bit.ravel()
    layers = [Layer(keys, np.bincount(at, weight * (flat == 0), len(keys)), np.bincount(at, weight * flat, len(keys)), None)]
    for extra in range(DEPTH - 2, 0, -1):
        layers.append(layers[-1].up(extra))
    return layers, node, bit, context


def _last_byte(pair: np.ndarray) -> np.ndarray:
    return pair * pow(_SPREAD, -1, 1 << 16) & 255


def _batch(names: list[str], types, columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def _added(batches):
    """The arrays of each (bucket, up) added up: one row each."""
    for group in runs_of(batches, ["bucket", "up"]):
        keys, counts = _merged([(_unpack(k.as_py(), np.int64, True), _unpack(n.as_py(), np.int64)) for k, n in zip(group.column("keys"), group.column("counts"), strict=True)])
        yield _batch(["slot", "bucket", "keys", "counts"], (pa.int64(), pa.int32(), pa.binary(), pa.binary()), ([group.column("up")[0].as_py()], [group.column("bucket")[0].as_py()], [_pack(keys, True)], [_pack(counts)]))


_SUMS = "pair int, node int, n0 double, n1 double, below double"


def _sums(bits: int):
    """From buckets of grams the counts and what lies below of their nodes of depth 2; from buckets of words (pair = -1) the sum and number of counts."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                keys, n = _unpack(batch.column("keys")[i].as_py(), np.int64, True), _unpack(batch.column("counts")[i].as_py(), np.int64)
                if batch.column("bucket")[i].as_py() >> bits:
                    layer = _layers(keys, n)[0][-1]
                    columns = [layer.key >> 8, layer.key & 255, layer.n0, layer.n1, layer.below]
                else:
                    columns = [np.array([v]) for v in (-1, 0, n.sum(), (n > 0).sum(), 0)]
                yield _batch(["pair", "node", "n0", "n1", "below"], (pa.int32(), pa.int32(), *[pa.float64()] * 3), [v.astype(t) for v, t in zip(columns, (np.int32, np.int32, float, float, float), strict=True)])

    return run


def _depth2(rows) -> Layer:
    """The layer of depth 2 of some pairs, from Arrow rows of the sums."""
    pair, node, n0, n1, below = (np.asarray(rows.column(c)) for c in ("pair", "node", "n0", "n1", "below"))
    key = pair.astype(np.int64) << 8 | node
    order = np.argsort(key, kind="stable")
    return Layer(key[order], *(v[order].astype(float) for v in (n0, n1, below)))


def _depth1(batches):
    """Nodes of depth 1, in parts: the last context byte, counts and ln P of what lies below."""
    for batch in batches:
        if batch.num_rows:
            layer = _depth2(batch)
            yield _batch(["c", "node", "n0", "n1", "p"], (pa.int32(), pa.int32(), *[pa.float64()] * 3), (_last_byte(layer.key >> 8).astype(np.int32), (layer.key & 255).astype(np.int32), layer.n0, layer.n1, layer.p))


_ANSWERS = "slot long, bucket int, keys binary, answers binary"


def _valued(bits: int, one: Layer, none: Layer):
    """From a bucket's keys with their totals (left) and its nodes of depth 2 (right) the value of each key: a word's total, or log10 of a gram's last byte given its context."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for row in left.to_pylist():
            keys, n = _unpack(row["keys"], np.int64, True), _unpack(row["counts"], np.int64)
            value = n.astype(float)
            if row["bucket"] >> bits:
                layers, node, bit, context = _layers(keys, n)
                layers[-1] = _depth2(right.combine_chunks())
                p = None
                for k, layer in enumerate(layers):
                    p = layer.mixed((context[:, None] << 8 | node).ravel(), bit.ravel(), p)
                    if k < len(layers) - 1:
                        context = _shorter(context, DEPTH - 2 - k)
                p = one.mixed((_last_byte(context)[:, None] << 8 | node).ravel(), bit.ravel(), p)
                p = none.mixed(node.ravel(), bit.ravel(), p)
                value = np.log10(p).reshape(-1, 8).sum(1)
            out.append((row["slot"], row["bucket"], row["keys"], _pack(value)))
        return pa.table([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.binary(), pa.binary()))], names=["slot", "bucket", "keys", "answers"])

    return run


def _answered(left: pa.Table, right: pa.Table) -> pa.Table:
    """What the parts (left) of one array (right) asked for, from its answers."""
    keys, values = _unpack(right.column("keys")[0].as_py(), np.int64, True), _unpack(right.column("answers")[0].as_py(), np.float64)
    mine = [_pack(values[np.searchsorted(keys, _unpack(k.as_py(), np.int64, True))]) for k in left.column("keys")]
    return pa.table([left.column("slot"), left.column("bucket"), left.column("keys"), pa.array(mine, pa.binary())], names=["slot", "bucket", "keys", "answers"])


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long"


def _scores(bits: int, n_all: int, n_distinct: int):
    """Scores of the texts of each chunk, from rows in order of chunk: answers (in order of bucket), then texts."""
    names = [c.split()[0] for c in _SCORES.split(", ")]
    types = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64()]

    def values(held: list) -> list:
        """Places of keys and their answers, of words and of grams; parts of one chunk and bucket may repeat keys."""
        out = []
        for kind in range(2):
            mine = [h for h in held if h[0] >> bits == kind]
            keys, got = (np.concatenate([m[k] for m in mine] or [np.zeros(0, t)]) for k, t in ((1, np.int64), (2, np.float64)))
            out += [Places(keys), got]
        return out

    def scored(piece, words_at, counts, grams_at, logs):
        buf, offs = texts(piece.column("text"))
        low = LOWER[buf]
        words, first = word_keys(low, offs)
        count = counts[words_at.of(words)]
        base = np.add.reduceat(np.log10(count + 1) - math.log10(n_all + n_distinct + 1), first[:-1])
        known = np.add.reduceat((count > 0).astype(np.int64), first[:-1])
        grams, start = gram_keys(low, offs)
        total = np.add.reduceat(logs[grams_at.of(grams)], start[:-1])
        return _batch(names, types, [piece.column("doc_id"), piece.column("held_out"), np.diff(first), known, np.full(piece.num_rows, n_all), base, total, np.diff(offs)])

    def run(batches):
        chunk, held, ready = None, [], None
        for batch in batches:
            at, text = np.asarray(batch.column("chunk")), np.asarray(batch.column("side")) == 1
            cuts = [0, *(np.flatnonzero((at[1:] != at[:-1]) | (text[1:] != text[:-1])) + 1).tolist(), len(at)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if at[a] != chunk:
                    chunk, held, ready = at[a], [], None
                part = batch.slice(a, b - a)
                if not text[a]:
                    held += [(k, _unpack(x.as_py(), np.int64, True), _unpack(y.as_py(), np.float64)) for k, x, y in zip(part.column("bucket").to_pylist(), part.column("keys"), part.column("answers"), strict=True)]
                    continue
                if ready is None:
                    ready, held = values(held), []
                for piece in pieces(part):
                    yield scored(piece, *ready)

    return run


def score(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES, bucket_bytes: int = BUCKET_BYTES, fan: int = FAN) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte of every row."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(LEAST_CHUNKS, -(-total // chunk_bytes))
    bits = min(_MOST_BITS, max(5, int(-(-total // bucket_bytes)).bit_length()))
    tasks = max(LEAST_CHUNKS, (2 << bits) // TASK_BUCKETS)
    held_out = F.coalesce(crc_mod(F.col("doc_id"), 7) == 2, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out.alias("held_out"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int").alias("chunk"))
    learnt = rows.select("chunk", (~F.col("held_out")).alias("train"), "text").repartitionById(chunks, F.col("chunk"))  # a chunk is a task
    asked = stash(learnt.transform(arrow, _asked(bits), _ASKED), "asked").withColumnRenamed("chunk", "slot")
    levels, slots = [asked.withColumn("slot", F.col("slot").cast("long"))], chunks
    while True:  # up the tree, until each bucket has one array
        slots = -(-slots // fan)
        part = levels[-1].withColumn("up", F.floor(F.col("slot") / fan))
        levels.append(stash(part.repartition(tasks, "bucket", "up").sortWithinPartitions("bucket", "up").select("bucket", "up", "keys", "counts").transform(arrow, _added, "slot long, bucket int, keys binary, counts binary"), "added"))
        if slots == 1:
            break
    top = levels.pop()
    sums = top.transform(arrow, _sums(bits), _SUMS).groupBy("pair", "node").agg(*(F.sum(v).alias(v) for v in ("n0", "n1", "below")))
    sums = stash(sums, "depth-2")
    words = sums.where("pair < 0").first()
    n_all, n_distinct = (int(words["n0"]), int(words["n1"])) if words else (0, 0)
    two = sums.where("pair >= 0")
    got = two.transform(arrow, _depth1, "c int, node int, n0 double, n1 double, p double").groupBy("c", "node").agg(*(F.sum(v).alias(v) for v in ("n0", "n1", "p"))).orderBy("c", "node").toPandas()  # at most 256 * 255 rows
    depth1 = Layer(got["c"].to_numpy(np.int64) << 8 | got["node"].to_numpy(np.int64), *(got[v].to_numpy(float) for v in ("n0", "n1", "p")))
    # The nodes of a pair of context bytes go to each bucket that has some of it.
    within = F.shiftright("pair", 16 - bits) if bits <= 16 else F.explode(F.expr(f"sequence(shiftleft(pair, {bits - 16}), shiftleft(pair, {bits - 16}) + {(1 << max(0, bits - 16)) - 1})"))
    two = two.withColumn("bucket", within).withColumn("bucket", (F.col("bucket") + (1 << bits)).cast("int"))
    answers = top.repartition(tasks, "bucket").groupBy("bucket").cogroup(two.repartition(tasks, "bucket").groupBy("bucket")).applyInArrow(_valued(bits, depth1, depth1.up(1)), _ANSWERS)
    for level in reversed(levels):  # and down again
        parts = level.select("slot", "bucket", "keys", F.floor(F.col("slot") / fan).alias("up")).repartition(tasks, "bucket", "up")
        above = answers.withColumnRenamed("slot", "up").repartition(tasks, "bucket", "up")
        answers = parts.groupBy("bucket", "up").cogroup(above.groupBy("bucket", "up")).applyInArrow(_answered, _ANSWERS)
    none = lambda kind: F.lit(None).cast(kind)
    values = answers.select(F.col("slot").cast("int").alias("chunk"), F.lit(0).alias("side"), "bucket", "keys", "answers", none("long").alias("doc_id"), none("boolean").alias("held_out"), none("string").alias("text"))
    both = values.unionByName(rows.select("chunk", F.lit(1).alias("side"), F.lit(0).alias("bucket"), none("binary").alias("keys"), none("binary").alias("answers"), "doc_id", "held_out", "text"))
    out = both.repartitionById(chunks, F.col("chunk")).sortWithinPartitions("chunk", "side", "bucket").transform(arrow, _scores(bits, n_all, n_distinct), _SCORES)
    per_byte = -F.col("score") * math.log2(10) / (F.col("n_bytes") + 1)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", per_byte.alias("bits_per_byte"))


def op1(spark, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents", "doc_id", "text"))
