"""Byte-level BPE encoding and decoding with a rank queue over hierarchical bitmaps.

A pre-token (a match of the split pattern) is merged pair by pair: of the adjacent pairs that have a rank, the
lowest rank first, at its leftmost place. The queue has one bucket per rank holding positions of a linked
list of parts. Three levels of bitmaps, 64 bits a word, mark the buckets in use, so the next rank is found by
three find-first-set steps whatever the length. Entries whose parts have changed since they were queued are
stale and skipped when they come up. Work is near linear in the length, so a single very long pre-token does
no harm.

The pre-tokens of a batch that have not been met lately share one queue: parts never cross pre-tokens, so one
pop serves, with array operations, all pre-tokens that have a pair of that rank: of each its leftmost one,
while its other places of the rank stay queued, so each pre-token sees the order it would see alone.
Pre-tokens beyond `LONG` bytes have a queue of their own.

Ids come from a rank file (lines of base64 token and rank, as the public tokenizer files have them), whose
path is a parameter; the file is read by the driver and sent to the workers with the job.

Defined results: a null text is encoded as an empty one (no ids); repeated rows are encoded each; null ids
are kept; text is never cut.
"""

from __future__ import annotations

import array
import base64
import collections
import hashlib
import heapq
import itertools

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tarnlake.llm.common import PIECE_BYTES, arrow, give_back, table
from tarnlake.llm.textscan import pieces

LONG = 64
#: Pre-tokens remembered by a worker; beyond it the memory is emptied.
REMEMBER = 250_000
#: Pre-tokens that are merged in one queue at a time.
TOGETHER = 20_000


class RankQueue:
    """Positions by rank; pop_rank() is the lowest rank in use, found by find-first-set on three bitmap levels."""

    def __init__(self, ranks: int):
        self.levels = [[0] * (-(-ranks // 64**k)) for k in (1, 2, 3)]
        self.buckets: dict[int, object] = {}

    def mark(self, rank: int) -> None:
        for level in self.levels:
            word, bit = rank >> 6, 1 << (rank & 63)
            had, level[word] = level[word], level[word] | bit
            if had:
                return
            rank = word

    def clear(self, rank: int) -> None:
        for level in self.levels:
            word = rank >> 6
            level[word] &= ~(1 << (rank & 63))
            if level[word]:
                return
            rank = word

    def lowest(self) -> int:
        """The lowest marked rank, or -1."""
        at = 0
        for word, value in enumerate(self.levels[2]):
            if value:
                at = word
                break
        else:
            return -1
        for level in reversed(self.levels):
            value = level[at]
            at = (at << 6) + (value & -value).bit_length() - 1
        return at


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.split = regex.compile(pattern).findall
        self.ranks = ranks
        self.tokens: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
        for t, r in ranks.items():
            self.tokens[r] = t
        self.byte_id = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int64)
        if (self.byte_id < 0).any():
            raise ValueError("the rank file lacks single bytes")
        self.pair: dict[int, int] = {}
        for t, r in ranks.items():
            for k in range(1, len(t)):
                a, b = ranks.get(t[:k]), ranks.get(t[k:])
                if a is not None and b is not None:
                    self.pair[a << 32 | b] = r
        keys = np.fromiter(self.pair, np.int64, len(self.pair))
        order = np.argsort(keys)
        # An open-addressed table of the pairs: one or two array look-ups find most of them.
        self.keys, self.values = keys[order], np.fromiter(self.pair.values(), np.int64, len(self.pair))[order]
        self._table()
        self.forget()

    def _table(self) -> None:
        self.bits = max(4, int(len(self.keys) * 4).bit_length())
        size = 1 << self.bits
        self.slot_key = np.full(size, -1, np.int64)
        self.slot_rank = np.full(size, -1, np.int64)
        todo, step = np.arange(len(self.keys)), 0
        while len(todo):
            at = (self._hash(self.keys[todo]) + step) & (size - 1)
            free = self.slot_key[at] == -1
            at_free, who = at[free], todo[free]
            self.slot_key[at_free] = self.keys[who]
            won = self.slot_key[at_free] == self.keys[who]
            self.slot_rank[at_free[won]] = self.values[who[won]]
            todo = np.concatenate([todo[~free], who[~won]])
            step += 1
        self.steps = step

    def _hash(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids, -1 for none."""
        key = a << 32 | b
        at = self._hash(key)
        out = np.full(len(key), -1, np.int64)
        open_ = np.arange(len(key))
        for _ in range(self.steps):
            there = self.slot_key[at]
            hit = there == key[open_]
            out[open_[hit]] = self.slot_rank[at[hit]]
            on = ~hit & (there != -1)
            if not on.any():
                break
            open_, at = open_[on], (at[on] + 1) & (len(self.slot_key) - 1)
        return out

    def one(self, token: bytes) -> list[int]:
        """The ids of one pre-token, by a queue of its own."""
        n = len(token)
        part = self.byte_id[np.frombuffer(token, np.uint8)].tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue, get = RankQueue(len(self.tokens)), self.pair.get

        def add(i: int) -> None:
            j = after[i]
            if j < n and (r := get(part[i] << 32 | part[j])) is not None:
                bucket = queue.buckets.get(r)
                if bucket:
                    heapq.heappush(bucket, i)
                else:
                    queue.buckets[r] = [i]
                    queue.mark(r)

        for i in range(n - 1):
            add(i)
        while (r := queue.lowest()) >= 0:
            bucket = queue.buckets[r]
            i = heapq.heappop(bucket)
            if not bucket:
                queue.clear(r)
            if part[i] < 0 or (j := after[i]) >= n or get(part[i] << 32 | part[j]) != r:
                continue  # stale
            part[i], part[j] = r, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            if before[i] >= 0:
                add(before[i])
            add(i)
        return [p for p in part if p >= 0]

    def many(self, tokens: list[bytes]) -> list[bytes]:
        """The ids (as in `ids`) of each of several short pre-tokens, by one queue."""
        size = np.fromiter(map(len, tokens), np.int64, len(tokens))
        part = self.byte_id[np.frombuffer(b"".join(tokens), np.uint8)]
        n = len(part)
        owner = np.repeat(np.arange(len(tokens)), size)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        last = np.cumsum(size) - 1
        after[last[size > 0]] = n
        first = np.concatenate([[0], last[:-1] + 1])[size > 0]
        before[first] = -1
        queue = RankQueue(len(self.tokens))

        def add(at: np.ndarray) -> None:
            at = at[after[at] < n]
            r = self.rank_of(part[at], part[after[at]])
            at, r = at[r >= 0], r[r >= 0]
            order = np.argsort(r, kind="stable")
            at, r = at[order], r[order]
            cuts = np.flatnonzero(r[1:] != r[:-1]) + 1
            begin = 0
            for end in [*cuts.tolist(), len(r)]:
                if end > begin:
                    rank = int(r[begin])
                    bucket = queue.buckets.setdefault(rank, [])
                    if not bucket:
                        queue.mark(rank)
                    bucket.append(at[begin:end])
                begin = end

        add(np.arange(n))
        while (rank := queue.lowest()) >= 0:
            bucket = queue.buckets[rank]
            at = np.unique(np.concatenate(bucket)) if len(bucket) > 1 else np.sort(bucket[0])
            bucket.clear()
            queue.clear(rank)
            at = at[(part[at] >= 0) & (after[at] < n)]
            at = at[self.rank_of(part[at], part[after[at]]) == rank]  # the others are stale
            if not len(at):
                continue
            lead = np.ones(len(at), bool)
            lead[1:] = owner[at[1:]] != owner[at[:-1]]
            if not lead.all():
                bucket.append(at[~lead])
                queue.mark(rank)
                at = at[lead]
            gone = after[at]
            part[at], part[gone] = rank, -1
            follow = after[gone]
            after[at] = follow
            inner = follow < n
            before[follow[inner]] = at[inner]
            lead_in = before[at]
            add(np.concatenate([lead_in[lead_in >= 0], at]))
        alive = part >= 0
        ids = part[alive].astype("<u4").tobytes()
        ends = [0, *(4 * np.cumsum(np.bincount(owner[alive], minlength=len(tokens)))).tolist()]
        return [ids[a:b] for a, b in zip(ends, ends[1:], strict=False)]

    def _learn(self) -> None:
        """Adds the ids of the pre-tokens numbered since the last call."""
        at, short = len(self.ids), []
        for t in itertools.islice(self.number, at, None):
            b = t.encode()
            if len(b) > LONG:
                self.ids.append(np.array(self.one(b), "<u4").tobytes())
            else:
                short.append((len(self.ids), b))
                self.ids.append(b"")
        for k in range(0, len(short), TOGETHER):
            part = short[k : k + TOGETHER]
            for (i, _), ids in zip(part, self.many([b for _, b in part]), strict=True):
                self.ids[i] = ids

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text."""
        if len(self.ids) > REMEMBER:
            self.forget()
        number = self.number.__getitem__
        found = [array.array("i", map(number, self.split(t) if t else [])) for t in texts]  # the pre-tokens of one text at a time
        self._learn()
        get = self.ids.__getitem__
        return [np.frombuffer(b"".join(map(get, f)), "<u4") for f in found]

    def forget(self) -> None:
        """Empties the memory of pre-tokens."""
        self.number: dict[str, int] = collections.defaultdict(itertools.count().__next__)  # in order of the numbers
        self.ids: list[bytes] = []  # by number; ids as little-endian unsigned 32-bit integers

    def decode(self, ids: np.ndarray) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in ids.tolist()])


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


_encoders: dict[str, Encoder] = {}


def encoder(name: str, ranks: dict[bytes, int], pattern: str) -> Encoder:
    """One encoder per worker process and rank file."""
    if name not in _encoders:
        _encoders[name] = Encoder(ranks, pattern)
    return _encoders[name]


def tokenize(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """The rows of docs with n_tokens, `ids` (array of int) and decoded_sha256 in place of the text."""

    def columns(ids, raw):
        return [pa.array([len(i) for i in ids], pa.int64()), pa.array([i.astype(np.int32) for i in ids], pa.list_(pa.int32())), pa.array([hashlib.sha256(b).hexdigest() for b in raw], pa.string())]

    return _coded(docs, ranks_path, pattern, ["n_tokens long", "ids array<int>", "decoded_sha256 string"], columns)


def digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """The rows of docs with n_tokens, ids_sha256 and decoded_sha256."""

    def columns(ids, raw):
        sha = [hashlib.sha256(i.astype("<u4").tobytes()).hexdigest() for i in ids]
        return [pa.array([len(i) for i in ids], pa.int64()), pa.array(sha, pa.string()), pa.array([hashlib.sha256(b).hexdigest() for b in raw], pa.string())]

    return _coded(docs, ranks_path, pattern, ["n_tokens long", "ids_sha256 string", "decoded_sha256 string"], columns)


def _coded(docs: DataFrame, ranks_path: str, pattern: str, added: list[str], columns) -> DataFrame:
    spark = docs.sparkSession
    names = [a.split()[0] for a in added]
    kept = [c for c in docs.columns if c not in ("text", *names)]
    sent = spark.sparkContext.broadcast(read_ranks(ranks_path))  # one vocabulary: its size does not depend on the corpus

    def run(batches):
        coder = encoder(ranks_path, sent.value, pattern)
        for batch in batches:
            for piece in pieces(batch, most=PIECE_BYTES * 3):
                ids = coder.encode(piece.column("text").to_pylist())
                raw = [coder.decode(i) for i in ids]
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in kept), *columns(ids, raw)], names=[*kept, *names])
                give_back()

    schema = T.StructType([docs.schema[c] for c in kept] + list(T._parse_datatype_string(", ".join(added)).fields))
    return docs.select(*(f"`{c}`" for c in kept), "text").transform(arrow, run, schema)


def op6(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
