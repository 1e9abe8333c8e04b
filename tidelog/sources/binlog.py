"""Binary log segments `wal-<number>.log`: a frame codec and a distributed scan.

A frame is a little-endian length field (see functions.codec), a record message
(1: type, 2: crc, 3: data) and zero padding up to eight bytes. The CRC-32C runs on
from record to record; a record of type CRC, at a segment's head, gives its seed.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.functions import crc

CRC, SNAPSHOT, DATA = 1, 2, 3
#: Largest record; sectors that a torn write leaves as zeros.
MOST, SECTOR = 64 << 20, 512
RECORDS = "segment long, offset long, type long, crc long, data binary"


class CorruptLog(ValueError):
    """A record that is neither whole nor the torn end of the last segment."""


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _read_varint(b: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        n |= (b[at] & 127) << shift
        at += 1
        if b[at - 1] < 128:
            return n, at
        shift += 7


def record(kind: int, crc: int, data: bytes) -> bytes:
    """A framed record; fields that are 0 or empty are left out."""
    parts = [(b"\x08", _varint(kind), kind), (b"\x10", _varint(crc), crc), (b"\x1a", _varint(len(data)) + data, data)]
    body = b"".join(tag + value for tag, value, there in parts if there)
    pad = -len(body) % 8
    return (len(body) | (0x80 | pad if pad else 0) << 56).to_bytes(8, "little") + body + bytes(pad)


def segment(payloads: Iterable[bytes], seed: int = 0) -> tuple[bytes, int]:
    """(bytes of a segment, seed of the next one)"""
    payloads = list(payloads)
    crcs = _running(payloads, seed)
    frames = [record(CRC, seed, b"")] + [record(DATA, c, d) for c, d in zip(crcs, payloads)]
    return b"".join(frames), crcs[-1] if crcs else seed


def _running(payloads: list[bytes], seed: int) -> list[int]:
    """The running CRC after each payload."""
    own = crc.crc32c_all(pa.array(payloads, pa.large_binary()))
    return crc.chained(own, np.array([len(p) for p in payloads]), seed).tolist() if payloads else []


def _message(body: bytes) -> tuple[int, int, bytes]:
    kind, crc, data, at = 0, 0, b"", 0
    while at < len(body):
        tag, at = _read_varint(body, at)
        value, at = _read_varint(body, at)
        if tag == 0x08:
            kind = value
        elif tag == 0x10:
            crc = value
        elif tag == 0x1A and at + value <= len(body):
            data, at = body[at : at + value], at + value
        else:
            raise ValueError(tag)
    return kind, crc, data


def _torn(raw: bytes, offset: int, size: int) -> bool:
    """Whether a whole sector's share of the frame body is zero."""
    cuts = [offset, *range(offset - offset % SECTOR + SECTOR, offset + size, SECTOR), offset + size]
    return any(not any(raw[a:b]) for a, b in zip(cuts, cuts[1:]))


def _frames(raw: bytes) -> Iterator[tuple[int, int, int, tuple[int, int, bytes] | None]]:
    """(offset, body size, padding, message or None if it can't be read) of the frames
    up to the first that is no frame; the last one may reach beyond the end."""
    at = 0
    while at + 8 <= len(raw):
        field = int.from_bytes(raw[at : at + 8], "little")
        if not field:
            return
        n, pad = field & (1 << 56) - 1, (field >> 56 & 7 if field >> 63 else 0)
        message = None
        if n <= MOST and at + 8 + n + pad <= len(raw):
            try:
                message = _message(raw[at + 8 : at + 8 + n])
            except (IndexError, ValueError):
                pass
        yield at, n, pad, message
        if message is None:
            return
        at += 8 + n + pad


def parse(raw: bytes, number: int, last: bool) -> list[tuple[int, int, int, int, bytes]]:
    """The records (segment, offset, type, crc, data) of one segment. Only the last
    segment may end in a torn record."""
    found = list(_frames(raw))
    whole = [f for f in found if f[3] is not None]
    kinds = np.array([f[3][0] for f in whole], np.int64)
    want = np.array([f[3][1] for f in whole], np.uint32)
    own = crc.crc32c_all(pa.array([f[3][2] for f in whole], pa.large_binary()))
    size = np.array([len(f[3][2]) for f in whole], np.int64)
    # CRC records begin a chain anew with their own value; the others go on from it.
    bad, heads = len(whole), [0, *np.flatnonzero(kinds == CRC).tolist(), len(whole)]
    for a, b in zip(heads, heads[1:]):
        if a == b:
            continue
        seeded = kinds[a] == CRC
        first = a + 1 if seeded else a
        run = crc.chained(own[first:b], size[first:b], int(want[a]) if seeded else 0)
        off = np.flatnonzero(run != want[first:b])
        if len(off):
            bad = first + int(off[0])
            break
    end = found[-1] if found and found[-1][3] is None else None
    wrong = found[bad] if bad < len(whole) else end
    if wrong is not None:
        at, n, pad, message = wrong
        if message is None and n > MOST:
            raise CorruptLog(f"segment {number}, offset {at}: {n} bytes")
        torn = at + 8 + n + pad > len(raw) or _torn(raw, at + 8, n + pad)
        if not (torn and last):
            raise CorruptLog(f"segment {number}, offset {at}: {'torn' if torn else 'corrupt'} record")
    elif not last:
        at = found[-1][0] + 8 + found[-1][1] + found[-1][2] if found else 0
        if any(raw[at:]):
            raise CorruptLog(f"segment {number}, offset {at}: torn record")
    return [(number, f[0], *f[3]) for f in whole[:bad]]


def _files(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "wal-*.log").load(path)
    number = F.regexp_extract("path", r"/wal-(\d+)\.log$", 1)
    return files.where(number != "").withColumn("segment", number.cast("long"))


def segments(spark: SparkSession, path: str) -> DataFrame:
    """(segment, bytes) of the log's files by number; files with other names are skipped."""
    return _files(spark, path).select("segment", F.col("length").alias("bytes")).orderBy("segment")


def scan(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the log, in tasks of one segment or more, by Spark's own
    reader, so the log can lie in any store. Files with other names are skipped."""
    files = _files(spark, path)
    # The newest number comes from the listing; no content is read for it.
    newest = files.agg(F.max("segment")).first()[0]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["segment", "offset", "type", "crc", "data"]
        for frame in frames:
            for n, raw in zip(frame["segment"], frame["content"]):
                got = parse(raw, int(n), n == newest)
                for i in range(0, len(got), 10_000):
                    yield pd.DataFrame(got[i : i + 10_000], columns=names)

    return files.select("segment", "content").mapInPandas(run, RECORDS)


def read_all(spark: SparkSession, path: str) -> DataFrame:
    """payloads() of a log whose segments follow each other: a seed that is not the
    final CRC of the segment before stops the read."""
    records = scan(spark, path)
    if broken := broken_chain(records).select("segment").take(1):
        raise CorruptLog(f"segment {broken[0][0]} does not follow the one before")
    return payloads(records)


def payloads(records: DataFrame) -> DataFrame:
    """Data records in log order."""
    return records.where(F.col("type") == DATA).select("segment", "offset", "data").orderBy("segment", "offset")


def broken_chain(records: DataFrame) -> DataFrame:
    """Segments whose seed is not the final CRC of the segment before; one row a
    segment is compared, so the ordered window is small."""
    ends = records.groupBy("segment").agg(F.min_by("crc", "offset").alias("seed"), F.max_by("crc", "offset").alias("final"))
    w = Window.orderBy("segment")
    return ends.withColumn("before", F.lag("final").over(w)).where("before is not null and before <> seed")


def running_crc(records: DataFrame) -> DataFrame:
    """(segment, offset, type, crc): the decoder's offset and running CRC after each
    record, as columns."""
    return records.select("segment", "offset", "type", "crc")
