"""Vectorised words, shingles and hashes over the buffers of Arrow string columns.

Everything here works on slices of a few megabytes of UTF-8, so memory is bounded by
the longest single text. Nulls count as empty texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes and rows handled at once; a longer text is handled alone.
SLICE_BYTES, SLICE_ROWS = 1 << 20, 2048

#: Longer spans are hashed by BLAKE2 one by one, and compared one by one.
LONG_SPAN = 256

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
#: Of eight bytes those of a span's last so many.
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=_U)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, elementwise on uint64."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: The white space that ends a word: \x20 and \x09 to \x0D.
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def slices(col: pa.Array | pa.ChunkedArray, most: int = SLICE_ROWS) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first row, bytes, row offsets into them) for runs of rows of about SLICE_BYTES, at most so many."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    if not len(col):
        return
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    bounds = np.frombuffer(col.buffers()[1], dtype=np.int64 if wide else np.int32)
    bounds = bounds[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = col.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < len(col):
        last = int(np.searchsorted(bounds, bounds[first] + SLICE_BYTES, "right")) - 1
        last = min(max(last, first + 1), first + most, len(col))
        yield first, data[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first]
        first = last


class Spans:
    """Byte spans of one buffer, read eight bytes at a time."""

    def __init__(self, data: np.ndarray):
        self.data = data
        padded = np.zeros(len(data) + 8, dtype=np.uint8)
        padded[: len(data)] = data
        self._eights = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))

    def eight(self, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The first eight bytes of each span as a number, zeros after its end."""
        return self._eights[starts] & _MASKS[np.clip(sizes, 0, 8)]

    def hash(self, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
        """64-bit hashes, each eight bytes mixed into those before; of one length, different spans of up to eight bytes never share one."""
        size = ends - starts
        h = mix(self.eight(starts, size) + size.astype(_U) * _U(0xD6E8FEB86659FD93) + _U(seed))
        more, at = np.flatnonzero(size > 8), 8
        while more.size and at < LONG_SPAN:
            h[more] = mix(h[more] + self.eight(starts[more] + at, size[more] - at) * _U(_BASE))
            at += 8
            more = more[size[more] > at]
        if more.size:
            raw, key = memoryview(np.ascontiguousarray(self.data)), seed.to_bytes(8, "little")
            digests = (hashlib.blake2b(raw[a:b], digest_size=8, key=key).digest() for a, b in zip(starts[more].tolist(), ends[more].tolist(), strict=True))
            h[more] = np.frombuffer(b"".join(digests), dtype="<u8")
        return h

    def same(self, starts: np.ndarray, sizes: np.ndarray, other: Spans, at_other: np.ndarray) -> np.ndarray:
        """Whether each span equals the one of the same size that starts there in another buffer, byte by byte."""
        same = np.ones(len(starts), dtype=bool)
        open_, at = np.flatnonzero(sizes > 0), 0
        while open_.size and at < LONG_SPAN:
            left = sizes[open_] - at
            same[open_] = self.eight(starts[open_] + at, left) == other.eight(at_other[open_] + at, left)
            at += 8
            open_ = open_[same[open_] & (sizes[open_] > at)]
        for k in open_.tolist():
            n = int(sizes[k])
            same[k] = np.array_equal(self.data[starts[k] : starts[k] + n], other.data[at_other[k] : at_other[k] + n])
        return same


class Words:
    """The words of a slice: maximal runs of bytes other than white space.

    start, end: byte positions; doc: row of the slice; first: for each row the index of its
    first word, with the total at the end; hash: of the word with A-Z lower-cased if lower,
    by a seed.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = True, seed: int = 0):
        n = len(data)
        space = _SPACE[data]
        word = ~space
        edge = np.zeros(n + 1, dtype=bool)
        edge[offsets] = True
        before = np.ones(n, dtype=bool)
        before[1:] = space[:-1]
        after = np.ones(n, dtype=bool)
        after[:-1] = space[1:]
        self.start = np.flatnonzero(word & (before | edge[:n]))
        self.end = np.flatnonzero(word & (after | edge[1:])) + 1
        self.doc = np.searchsorted(offsets, self.start, "right") - 1
        self.first = np.searchsorted(self.start, offsets)
        self.space = space
        self._data, self._lower, self._seed = data, lower, seed
        self._spans: Spans | None = None
        self._hash: np.ndarray | None = None

    @property
    def spans(self) -> Spans:
        if self._spans is None:
            self._spans = Spans(_LOWER[self._data] if self._lower else self._data)
        return self._spans

    @property
    def hash(self) -> np.ndarray:
        if self._hash is None:
            self._hash = self.spans.hash(self.start, self.end, self._seed)
        return self._hash

    def same(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether words a and b (by index) are equal, byte by byte."""
        size = self.end[a] - self.start[a]
        found = size == self.end[b] - self.start[b]
        at = np.flatnonzero(found)
        found[at] = self.spans.same(self.start[a[at]], size[at], self.spans, self.start[b[at]])
        return found


def windows(words: Words, size: int) -> np.ndarray:
    """Hash of the window of so many words at each word; meaningless where it leaves the text."""
    h = words.hash
    total = np.zeros(max(0, len(h) - size + 1), dtype=_U)
    for k in range(size):
        total += mix(h[k : k + len(total)] + _U(k * 0x632BE59BD9B4E019 & (2**64 - 1))) * _U((2 * k + 1) * _BASE & (2**64 - 1))
    return mix(total)


def shingle_sets(words: Words, size: int) -> Iterator[np.ndarray]:
    """For each row of the slice, its distinct shingle hashes in ascending order.

    A text of fewer words than size has one shingle, the whole sequence; one without words none.
    """
    grams, h = windows(words, size), words.hash
    none = np.zeros(0, dtype=_U)
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= size:
            yield np.unique(grams[a : b - size + 1])
        elif b > a:
            own = mix(h[a:b] + _U(b - a)) * (np.arange(b - a, dtype=_U) * _U(2) + _U(1))
            yield mix(np.array([own.sum(dtype=_U) + _U(b - a)], dtype=_U))
        else:
            yield none
