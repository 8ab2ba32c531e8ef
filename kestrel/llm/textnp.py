"""Words and rolling hashes of whole Arrow text columns, in numpy.

A word is a maximal run of ASCII letters and digits and of non-ASCII bytes of
the lower-cased UTF-8 text. A null text is treated as an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_C1, _C2 = U(0xFF51AFD7ED558CCD), U(0xC4CEB9FE1A85EC53)
_WORD = np.zeros(256, np.bool_)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer; returns a new array."""
    h = h ^ (h >> U(33))
    h *= _C1
    h ^= h >> U(33)
    h *= _C2
    h ^= h >> U(33)
    return h


class Powers:
    """Powers of an odd base modulo 2^64, and of its inverse."""

    def __init__(self, base: int):
        self.base, self.inverse = U(base), U(pow(base, -1, 1 << 64))
        self.up = self.down = np.ones(1, U)

    def to(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            for name, base in (("up", self.base), ("down", self.inverse)):
                row = np.full(n, base, U)
                row[0] = 1
                setattr(self, name, np.multiply.accumulate(row))


_BYTES, _WORDS = Powers(0x9E3779B97F4A7C15), Powers(0xD1B54A32D192ED03)


def slices(column: pa.Array | pa.ChunkedArray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about `most` bytes of text; a longer text is a range of its own."""
    if len(column) == 0:
        return
    size = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(size)
    start = 0
    while start < len(size):
        base = ends[start] - size[start]
        stop = max(start + 1, int(np.searchsorted(ends, base + most, "right")))
        yield start, stop
        start = stop


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column and its n + 1 offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]] if body is not None and body.size else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


class Words:
    """Words of a slice of texts: byte spans, 64-bit hashes, and each text's range of words."""

    def __init__(self, column: pa.Array, lower: bool = True):
        low = pc.utf8_lower(column.cast(pa.large_string())) if lower else column
        self.data, self.offsets = raw(low)
        data, offsets = self.data, self.offsets
        word = _WORD[data]
        edge = np.zeros(len(data) + 1, np.bool_)
        edge[offsets] = True
        before = np.empty_like(word)
        before[:1] = False
        before[1:] = word[:-1]
        after = np.empty_like(word)
        after[-1:] = False
        after[:-1] = word[1:]
        self.start = np.flatnonzero(word & (~before | edge[:-1]))
        self.end = np.flatnonzero(word & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, offsets)  # text i has the words first[i] to first[i + 1]
        _BYTES.to(len(data) + 1)
        total = np.zeros(len(data) + 1, U)
        np.cumsum((data.astype(U) + U(1)) * _BYTES.up[: len(data)], out=total[1:])
        self.hash = mix((total[self.end] - total[self.start]) * _BYTES.down[self.start])
        self._sums: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.start)

    @property
    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.first))

    def spans(self, at: np.ndarray, n: int | np.ndarray) -> np.ndarray:
        """Hash of the n words from each word `at` on; the caller keeps them inside a text."""
        if self._sums is None:
            _WORDS.to(len(self) + 1)
            self._sums = np.zeros(len(self) + 1, U)
            np.cumsum(self.hash * _WORDS.up[: len(self)], out=self._sums[1:])
        return mix((self._sums[at + n] - self._sums[at]) * _WORDS.down[at])

    def starts(self, n: int) -> np.ndarray:
        """Words from which n words follow in the same text, themselves included."""
        last = np.repeat(self.first[1:], np.diff(self.first))
        i = np.arange(len(self))
        return i[i + n <= last]
