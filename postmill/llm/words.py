"""Words of whole texts as numpy arrays, many documents at a time.

Tasks receive Arrow batches; a batch is walked in slices of whole documents so that memory
depends on the slice and on the longest single document, never on the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
U64 = np.uint64

# Bytes that are not part of a word.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
PUNCTUATION = np.zeros(256, bool)
PUNCTUATION[:0x30] = PUNCTUATION[0x3A:0x61] = PUNCTUATION[0x7B:0x80] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_SEEDS = (U64(0x9E3779B97F4A7C15), U64(0xD1B54A32D192ED03))
_JOIN = (U64(0xA24BAED4963EE407), U64(0x9FB21C651E98DF25))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit over all bits (the finaliser of splitmix64)."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class Spans:
    """Hashes of spans of any length over one sequence, by joining hashes of powers of two.

    Every join is mixed, so unlike a sum of powers no sequence cancels out another one.
    """

    def __init__(self, values: np.ndarray, which: int = 0):
        self.which = which
        self.levels = [mix(values ^ _SEEDS[which])]

    def join(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix((a ^ (a >> U64(29))) * _JOIN[self.which] + b)

    def level(self, k: int) -> np.ndarray:
        """Hashes of the ``2**k`` values from each place on that has as many."""
        while len(self.levels) <= k:
            half, last = 1 << (len(self.levels) - 1), self.levels[-1]
            self.levels.append(self.join(last[:-half], last[half:]) if len(last) > half else last[:0])
        return self.levels[k]


def prefix_hash(values: np.ndarray, which: int = 0) -> Spans:
    """Prepare :func:`span_hash`; the two choices of ``which`` are independent."""
    return Spans(values, which)


def span_hash(spans: Spans, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """Hashes of the spans ``start..end`` of the values given to :func:`prefix_hash`."""
    size = np.asarray(end - start)
    at, out = np.array(start), (size.astype(U64) + U64(1)) * U64(0xA0761D6478BD642F)
    for k in reversed(range(int(size.max(initial=0)).bit_length())):
        some = np.flatnonzero(size >> k & 1)
        if len(some):
            out[some] = spans.join(out[some], spans.level(k)[at[some]])
            at[some] += 1 << k
    return out


def byte_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """Hashes of the byte spans ``start..end``, eight bytes a step."""
    padded = np.append(data, np.zeros(8, np.uint8))
    eights = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    out = (end - start).astype(U64) * _JOIN[which] + _SEEDS[which]
    some, at, left = np.arange(len(start)), np.array(start), end - start
    while len(some):
        chunk = eights[at] & (U64(0xFFFFFFFFFFFFFFFF) >> (U64(8) * (U64(8) - np.minimum(left, 8).astype(U64))))
        out[some] = mix((out[some] ^ mix(chunk + _SEEDS[which])) * _JOIN[which])
        more = left > 8
        some, at, left = some[more], at[more] + 8, left[more] - 8
    return out


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets from 0) of whole texts; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, data = column.buffers()
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(where, np.int64 if large else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        last = max(int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1, row + 1)
        last = min(last, n)
        yield row, last, raw[offsets[row] : offsets[last]], offsets[row : last + 1] - offsets[row]
        row = last


class Words:
    """Words of a slice: byte spans, number of words before each document, hashes.

    ``start`` and ``end`` are byte positions, ``first[d]:first[d + 1]`` are the words of
    document ``d``. Words never reach over documents.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = SPACES, lower: bool = False):
        if lower:
            data = LOWER[data]
        self.data, self.offsets = data, offsets
        inside = ~breaks[data]
        begin = inside.copy()
        begin[1:] &= ~inside[:-1]
        finish = inside.copy()
        finish[:-1] &= ~inside[1:]
        full = offsets[:-1][np.diff(offsets) > 0]
        begin[full] = inside[full]
        if len(full):
            stops = np.append(full[1:], len(data)) - 1
            finish[stops] = inside[stops]
        self.start = np.flatnonzero(begin)
        self.end = np.flatnonzero(finish) + 1
        self.first = np.searchsorted(self.start, offsets)
        self._hash: dict[int, np.ndarray] = {}

    def __len__(self) -> int:
        return len(self.start)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, which: int = 0) -> np.ndarray:
        if which not in self._hash:
            self._hash[which] = byte_hash(self.data, self.start, self.end, which)
        return self._hash[which]

    def spelled(self, which: np.ndarray) -> list[bytes]:
        """The bytes of some of the words."""
        raw = self.data.tobytes()
        return [raw[a:b] for a, b in zip(self.start[which].tolist(), self.end[which].tolist())]

    def doc_of(self) -> np.ndarray:
        """The document of every word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def grams(self, n: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(hash of the n words from each word on, True where they lie in one document)."""
        total = len(self)
        if total < n:
            return np.zeros(0, U64), np.zeros(0, bool)
        prefix = prefix_hash(self.hashes(which), which)
        at = np.arange(total - n + 1)
        return span_hash(prefix, at, at + n, which), self.whole(n)

    def whole(self, n: int) -> np.ndarray:
        """True where n words from here on lie in one document."""
        left = np.repeat(self.first[1:], self.counts()) - np.arange(len(self))
        return left[: max(len(self) - n + 1, 0)] >= n
