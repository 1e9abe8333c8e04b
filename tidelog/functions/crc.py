"""CRC-32C (Castagnoli) of many byte strings at once, its chaining, and columns."""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

#: The reversed Castagnoli polynomial.
POLYNOMIAL = 0x82F63B78
#: Long strings are cut into pieces of so many bytes, which are hashed side by side.
PIECE = 512


def _table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = (c >> np.uint32(1)) ^ np.where(c & np.uint32(1), np.uint32(POLYNOMIAL), np.uint32(0))
    return c


TABLE = _table()


def _times(rows: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The 32 x 32 bit matrix (images of single bits) applied to every x."""
    out = np.zeros_like(x)
    for bit in range(32):
        out ^= np.where((x >> np.uint32(bit)) & np.uint32(1), rows[bit], np.uint32(0))
    return out


@functools.lru_cache(None)
def _power(k: int) -> np.ndarray:
    """The matrix that 2**k zero bytes apply to a register."""
    if k:
        half = _power(k - 1)
        return _times(half, half)
    x = np.uint32(1) << np.arange(32, dtype=np.uint32)
    return TABLE[x & 255] ^ (x >> np.uint32(8))


def shifted(c: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """Registers c after so many zero bytes each."""
    c, zeros = c.copy(), zeros.astype(np.int64)
    for k in range(int(zeros.max(initial=0)).bit_length()):
        hit = (zeros >> k & 1).astype(bool)
        if hit.any():
            c[hit] = _times(_power(k), c[hit])
    return c


def combine(first: np.ndarray, second: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The CRC of a + b from those of a and b and the size of b."""
    return shifted(first, size) ^ second


def crc_of(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRCs of byte ranges of data. Pieces of all ranges go forward together, one
    byte a step, and are then combined."""
    count = np.maximum(-(-size // PIECE), 1)
    of = np.repeat(np.arange(len(size)), count)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    # The first piece takes what is left over, so all later ones are of one size.
    short = size - (count - 1) * PIECE
    length = np.where(nth == 0, short[of], PIECE)
    begin = start[of] + np.where(nth == 0, 0, short[of] + (nth - 1) * PIECE)
    order = np.argsort(-length, kind="stable")
    begin, left = begin[order], length[order]
    c = np.full(len(of), 0xFFFFFFFF, np.uint32)
    for i in range(int(left[0]) if len(left) else 0):
        m = int(np.searchsorted(-left, -i, side="left"))  # those longer than i
        x = c[:m]
        c[:m] = TABLE[(x ^ data[begin[:m] + i]) & 255] ^ (x >> np.uint32(8))
    part = np.empty_like(c)
    part[order] = c ^ np.uint32(0xFFFFFFFF)
    # Neighbouring pieces of a range join in pairs, until one is left of each.
    while len(part) > len(size):
        right = (nth % 2 == 1).nonzero()[0]
        part[right - 1] = combine(part[right - 1], part[right], length[right])
        length[right - 1] += length[right]
        left = nth % 2 == 0
        part, length, nth = part[left], length[left], nth[left] // 2
    return part


def crc32c_all(values: pa.Array) -> np.ndarray:
    """CRC of each binary value; that of a null is 0."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    values = values.cast(pa.large_binary()).fill_null(b"")
    off = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1] if len(values) else np.zeros(1, np.int64)
    buffer = values.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None and buffer.size else np.zeros(1, np.uint8)
    return crc_of(data, off[:-1], np.diff(off))


def crc32c(data: bytes, seed: int = 0) -> int:
    """The CRC of one byte string; seed continues an earlier one."""
    one = crc_of(np.frombuffer(data or b"\0", np.uint8), np.zeros(1, np.int64), np.array([len(data)]))
    return int(combine(np.array([seed], np.uint32), one, np.array([len(data)]))[0])


def chained(crcs: np.ndarray, size: np.ndarray, seed: int = 0) -> np.ndarray:
    """The running CRC after each record, from the records' own: neighbours are joined
    by doubling, so the fold takes log2(records) steps."""
    run, length, step = crcs.copy(), size.astype(np.int64).copy(), 1
    while step < len(run):
        run[step:] = combine(run[:-step], run[step:], length[step:])
        length[step:] = length[step:] + length[:-step]
        step *= 2
    return combine(np.full(len(run), seed, np.uint32), run, length)


@F.pandas_udf(LongType())
def _crc(values: pd.Series) -> pd.Series:
    out = crc32c_all(pa.array(values, pa.binary(), from_pandas=True)).astype(np.int64)
    return pd.Series(out).where(values.notna().to_numpy())


def crc32c_column(value: Column) -> Column:
    """CRC-32C of a binary or string column (UTF-8), null for null."""
    return _crc(value.cast("binary"))


def block_checksum(data: Column, kind: Column) -> Column:
    """The checksum of a stored block: that of its bytes and one byte for its kind."""
    return crc32c_column(F.concat(data.cast("binary"), F.unhex(F.lpad(F.hex(kind), 2, "0"))))
