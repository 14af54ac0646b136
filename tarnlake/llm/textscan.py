"""Vectorised scans of Arrow text columns: bytes, words, word hashes and hashes of word runs.

Words are maximal runs of bytes other than space and 0x09-0x0D. A null text counts as an empty one. All
functions work on a piece of a record batch (about PIECE_BYTES, or one text that is longer), so memory is
bounded by the longest single text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tarnlake.llm.common import PIECE_BYTES

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = [0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F]  # odd multipliers
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the splitmix64 finaliser)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


BYTE_CODE = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))


def powers(n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i mod 2**64 for i < n; kept for reuse, dropped again when a long text made them large."""
    have = _powers.get(which)
    if have is None or len(have[0]) < n:
        base = _BASE[which]
        m = max(n, 1 << 16)
        one = np.ones(1, U)
        have = tuple(np.concatenate([one, np.cumprod(np.full(m - 1, b, U))]) for b in (base, pow(base, -1, 1 << 64)))
        if m <= 8 * PIECE_BYTES:
            _powers[which] = have
    return have


def texts(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes, and where each row's text begins (one more entry: where the last ends)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, at, data = column.buffers()
    offs = np.frombuffer(at, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None and offs[-1] > offs[0] else np.zeros(0, np.uint8)
    return buf, offs - offs[0]


def pieces(batch: pa.RecordBatch, column: str = "text", most: int = PIECE_BYTES):
    """The batch in consecutive slices of about `most` bytes of text; a longer text is a slice of its own."""
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(size)
    begin = 0
    while begin < batch.num_rows:
        before = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(begin, end - begin)
        begin = end


class Words:
    """Words of a piece: byte spans, first word of each text (one more entry: the number of words), hashes."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray):
        self.buf, self.offs = buf, offs
        n = len(buf)
        inside = ~SPACE[buf]
        edge = np.zeros(n + 1, bool)
        edge[offs] = True
        begins, ends = inside.copy(), inside.copy()
        if n:
            begins[1:] &= ~inside[:-1] | edge[1:n]
            ends[:-1] &= ~inside[1:] | edge[1:n]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offs)
        self.per_text = np.diff(self.first)

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offs) - 1), self.per_text)

    def hashes(self) -> np.ndarray:
        up, down = powers(len(self.buf) + 1, 0)
        total = np.zeros(len(self.buf) + 1, U)
        np.cumsum(BYTE_CODE[self.buf] * up[: len(self.buf)], out=total[1:])
        return mix((total[self.end] - total[self.start]) * down[self.start] ^ (self.end - self.start).astype(U))


class Runs:
    """Hashes of runs of consecutive items from their 64-bit hashes, for any run, in constant time each."""

    def __init__(self, item: np.ndarray, which: int = 1):
        self.up, self.down = powers(len(item) + 1, which)
        self.total = np.zeros(len(item) + 1, U)
        np.cumsum(item * self.up[: len(item)], out=self.total[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.total[end] - self.total[start]) * self.down[start] ^ (end - start).astype(U))


def distinct_per_text(doc: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct (text, value) pairs, sorted, with their counts."""
    order = np.lexsort((value, doc))
    d, v = doc[order], value[order]
    new = np.ones(len(v), bool)
    if len(v):
        new[1:] = (d[1:] != d[:-1]) | (v[1:] != v[:-1])
    at = np.flatnonzero(new)
    return d[at], v[at], np.diff(np.append(at, len(v)))


def per_text(flag: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sums of flag between consecutive offsets."""
    total = np.zeros(len(flag) + 1, np.int64)
    np.cumsum(flag, out=total[1:])
    return total[offs[1:]] - total[offs[:-1]]
