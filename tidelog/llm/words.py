"""Words and word-sequence hashes of many texts at once, in numpy.

A word is a run of bytes outside space and 09-0D of the UTF-8 text, so no text is
ever decoded or split into Python strings. Null texts count as empty.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[65:91] += 32
#: Odd multipliers, 3 modulo 4, of the byte hash and the two sequence hashes.
BYTE, SEQ = 0x9E3779B97F4A7C17, (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept and grown in doubling steps."""
    p = _powers.get(base)
    if p is None or len(p) < n:
        size = max(1024, 1 << (n - 1).bit_length())
        p = np.full(size, U(base))
        p[0] = 1
        with np.errstate(over="ignore"):
            p = np.multiply.accumulate(p)
        _powers[base] = p
    return p[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> U(32))
        x = x * U(0xE9846AF9B1A615D5)
        x ^= x >> U(29)
        x *= U(0xC2B2AE3D27D4EB4F)
        return x ^ (x >> U(32))


@dataclass
class Words:
    """Words of n texts: text number, byte range in data, 64-bit hash; first[i]
    is the number of the first word of text i (first[n]: all)."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray
    hash: np.ndarray


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, n + 1 offsets) of a string column; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.fill_null("").cast(pa.large_string())
    _, off, data = col.buffers()
    off = np.frombuffer(off, np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def words(col: pa.Array, lower: bool = False, separator: np.ndarray = SEPARATOR) -> Words:
    """Words between bytes that `separator` marks, which are below 128."""
    data, off = text_bytes(col)
    n = len(off) - 1
    if lower:
        data = LOWERED[data]
    inside = ~separator[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    at = off[:-1][off[:-1] < len(data)]
    begins[at] = inside[at]
    start = np.flatnonzero(begins)
    if not len(start):
        z = np.zeros(0, np.int64)
        return Words(data, z, z, z, np.zeros(n + 1, np.int64), np.zeros(0, U))
    # Every inside byte belongs to the word that began last.
    bytes_ = data[inside]
    first_byte = np.flatnonzero(begins[inside])
    size = np.diff(first_byte, append=len(bytes_))
    place = np.arange(len(bytes_)) - np.repeat(first_byte, size)
    with np.errstate(over="ignore"):
        value = (bytes_.astype(U) + U(1)) * powers(BYTE, int(size.max()))[place]
        h = mix(np.add.reduceat(value, first_byte) ^ (size.astype(U) * U(0x94D049BB133111EB)))
    doc = np.searchsorted(off, start, side="right") - 1
    return Words(data, start, start + size, doc, np.searchsorted(start, off).astype(np.int64), h)


class Spans:
    """Hashes of word ranges from prefix sums: the same words give the same hash."""

    def __init__(self, h: np.ndarray, base: int):
        self.base = base
        inverse = pow(base, -1, 1 << 64)
        n = len(h)
        with np.errstate(over="ignore"):
            self.sum = np.concatenate([np.zeros(1, U), np.cumsum(h * powers(base, n), dtype=U)])
        self.back = powers(inverse, n + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = (self.sum[end] - self.sum[start]) * self.back[start]
            return mix(x ^ ((end - start).astype(U) * U(0x8EBC6AF09C88C6E3)))

    def grams(self, k: int) -> np.ndarray:
        """Of the k words at every place, across texts too."""
        n = len(self.sum) - 1 - k + 1
        if n <= 0:
            return np.zeros(0, U)
        with np.errstate(over="ignore"):
            x = (self.sum[k:] - self.sum[:-k]) * self.back[:n]
            return mix(x ^ U(k * 0x8EBC6AF09C88C6E3 & 0xFFFFFFFFFFFFFFFF))


def sliding(x: np.ndarray, w: int, f) -> np.ndarray:
    """f (np.minimum or np.maximum) over every w neighbours, by doubling."""
    if len(x) < w:
        return x[:0]
    have = 1
    while have * 2 <= w:
        x, have = f(x[: len(x) - have], x[have:]), have * 2
    return x if have == w else f(x[: len(x) - (w - have)], x[w - have :])
