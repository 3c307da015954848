"""Vectorised helpers over batches of texts: bytes, words, word hashes, shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_tables = np.random.default_rng(20240229).integers(1, 2**63 - 1, 256, dtype=np.uint64) * U(2) + U(1)
_up = np.ones(1, U)
_down = np.ones(1, U)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every bit over all others."""
    high = h >> U(30)
    h = h ^ high
    h *= U(0xBF58476D1CE4E5B9)
    h ^= np.right_shift(h, U(27), out=high)
    h *= U(0x94D049BB133111EB)
    h ^= np.right_shift(h, U(31), out=high)
    return h


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _up, _down
    if len(_up) < n:
        size = 1 << max(20, (n - 1).bit_length())
        _up = np.full(size, _BASE, U)
        _up[0] = 1
        np.multiply.accumulate(_up, out=_up)
        _down = np.full(size, pow(_BASE, -1, 2**64), U)
        _down[0] = 1
        np.multiply.accumulate(_down, out=_down)
    return _up, _down


class Ranges:
    """Polynomial hashes (mod 2**64) of any byte ranges of one buffer."""

    def __init__(self, buf: np.ndarray):
        up, self.down = _powers(len(buf) + 1)
        self.sums = np.zeros(len(buf) + 1, U)
        byte = _tables.take(buf)
        byte *= up[: len(buf)]
        np.cumsum(byte, out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums.take(end) - self.sums.take(start)) * self.down.take(start))

    def every(self, width: int) -> np.ndarray:
        """Of the ranges of one width, from each start on."""
        return mix((self.sums[width:] - self.sums[:-width]) * self.down[: len(self.sums) - width])


def binary(array: pa.Array) -> pa.Array:
    """Strings as bytes; null is empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    kind = pa.large_binary()
    if array.null_count:
        array = array.fill_null("" if pa.types.is_string(array.type) or pa.types.is_large_string(array.type) else b"")
    return array.cast(kind)


def pieces(array: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) over runs of whole texts of about limit bytes."""
    array = binary(array)
    off = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
    data = array.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(array):
        end = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
        yield at, end, data[off[at] : off[end]], off[at : end + 1] - off[at]
        at = end


def words(buf: np.ndarray, off: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words in buf, and the first word of each text (one more at the end).

    apart: 256 booleans, which bytes separate words; no word crosses from one text to the next.
    """
    inside = ~apart[buf]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    edge = off[1:-1]
    edge = edge[(edge > 0) & (edge < len(buf))]
    begins[edge] = inside[edge]
    ends[edge - 1] = inside[edge - 1]
    start = np.flatnonzero(begins)
    end = np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(start, off)


def shingles(h: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of every n words of each text, in order, and where each text's begin and how many words it has.

    A text of fewer words, but not none, has one: the whole sequence.
    """
    count = np.diff(first)
    made = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    begin = np.zeros(len(count) + 1, np.int64)
    np.cumsum(made, out=begin[1:])
    at = np.arange(begin[-1]) - np.repeat(begin[:-1] - first[:-1], made)
    length = np.repeat(np.minimum(count, n), made)
    padded = np.concatenate([h, np.zeros(n, U)])
    out = length.astype(U) * U(0xD6E8FEB86659FD93)
    for i in range(n):
        part = padded[at + i]
        if i:
            part[length <= i] = 0
        out += part * U(((0xA0761D6478BD642F * (2 * i + 3)) | 1) & (2**64 - 1))
    return mix(out), begin, count


def table_of(chars: bytes) -> np.ndarray:
    apart = np.zeros(256, bool)
    apart[list(chars)] = True
    return apart


#: Space and U+0009 to U+000D separate words.
SPACES = table_of(b" \t\n\x0b\x0c\r")
#: A-Z in lower case.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
