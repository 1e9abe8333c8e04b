"""Appending to a binary log: segments, rotation, snapshot markers, repair."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidelog.functions import crc
from tidelog.sources import binlog, shared


class Closed(ValueError):
    """The log is closed."""


@dataclass(frozen=True)
class Options:
    """Bytes from which a segment is followed by a new one (0: never), and those that
    are written at once."""

    segment_bytes: int = 64 << 20
    buffer_bytes: int = 128 << 10


#: Profiles: of any log, of schema events (few, one segment), of resources.
PLAIN, SCHEMA, RESOURCE = Options(), Options(0, 4 << 10), Options(64 << 20, 128 << 10)


def name_of(number: int) -> str:
    return f"wal-{number:016}.log"


def frame_sizes(sizes: np.ndarray, crcs: np.ndarray) -> np.ndarray:
    """Bytes of the frames of data records with these payload sizes and running CRCs."""
    def varint(x):
        return sum((x >> (7 * k) > 0).astype(np.int64) for k in range(1, 6)) + 1

    body = 2 + np.where(crcs > 0, 1 + varint(crcs.astype(np.int64)), 0) + np.where(sizes > 0, 1 + varint(sizes) + sizes, 0)
    return 8 + body + -body % 8


def rotate(sizes: np.ndarray, limit: int, held: int = 0, number: int = 0) -> tuple[np.ndarray, int, int]:
    """(segment of each record, bytes held, segment) when records of these sizes come
    after `held` bytes of a segment: a record that finds `limit` bytes or more opens
    the next segment. One step a segment, not a record."""
    out, i = np.empty(len(sizes), np.int64), 0
    total = np.concatenate([[0], np.cumsum(sizes)])
    while i < len(sizes):
        if limit and held >= limit:
            number, held = number + 1, 0
        # The last record of this segment is the one that brings it to the limit.
        j = int(np.searchsorted(total, total[i] + limit - held)) if limit else len(sizes)
        j = min(max(j, i + 1), len(sizes))
        out[i:j] = number
        held, i = held + int(total[j] - total[i]), j
    return out, held, number


def assign_segments(rows: DataFrame, order: str, size: str, limit: int) -> DataFrame:
    """(order, size, segment): the segment of each record by the bytes before it. Which
    record opens a segment depends on all before it, so the narrow rows of one log
    (a log has one writer) go through one task in order, which keeps two numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = number = 0
        for b in batches:
            segment, held, number = rotate(b.column(1).to_numpy().astype(np.int64), limit, held, number)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(segment)], [order, size, "segment"])

    r = rows.select(F.col(order).cast("long"), F.col(size).cast("long")).repartition(1).sortWithinPartitions(order)
    return r.mapInArrow(run, f"{order} long, {size} long, segment long")


class Log:
    """A log in a folder. One writer at a time; readers use binlog.scan().

    Segments never change: an append writes new ones, at least one a task, under
    temporary names and then renames them in order, so what a crash leaves is a log
    that ends earlier. Opening cuts the torn end off the last segment. Executors
    write with Arrow's file systems, so the folder must be a path that those know
    (local or mounted, s3, hdfs, ...).
    """

    def __init__(self, spark: SparkSession, path: str, options: Options = PLAIN):
        self.spark, self.path, self.options, self.closed = spark, path.rstrip("/"), options, False
        self.fs, self.folder = pa.fs.FileSystem.from_uri(self.path) if "://" in self.path else (pa.fs.LocalFileSystem(), self.path)
        self.fs.create_dir(self.folder, recursive=True)
        self.number, self.seed = -1, 0
        numbers = self._numbers()
        if numbers:
            self.number = numbers[-1]
            self._repair()

    def _numbers(self) -> list[int]:
        names = [f.base_name for f in self.fs.get_file_info(pa.fs.FileSelector(self.folder))]
        return sorted(int(n[4:-4]) for n in names if n.startswith("wal-") and n.endswith(".log") and n[4:-4].isdigit())

    def _repair(self) -> None:
        """Read the last segment, take up its CRC and leave out a torn end."""
        name = f"{self.folder}/{name_of(self.number)}"
        with self.fs.open_input_file(name) as f:
            raw = f.read()
        got = binlog.parse(raw, self.number, True)
        self.seed = got[-1][3] if got else 0
        whole = b"".join(binlog.record(k, c, d) for _, _, k, c, d in got)
        if raw[: len(whole)] != whole or any(raw[len(whole) :]):
            self._write(name, whole)

    def _write(self, name: str, data: bytes) -> None:
        temp = f"{self.folder}/_{uuid.uuid4().hex}"
        with self.fs.open_output_stream(temp, buffer_size=self.options.buffer_bytes) as f:
            f.write(data)
        self.fs.move(temp, name)

    def _open(self) -> None:
        if self.closed:
            raise Closed(self.path)

    def append(self, rows: DataFrame, order: str) -> int:
        """Append the rows' `data` in the order of a column; the number of segments
        made. When this returns, all of them are there. Rows of equal order go by data."""
        self._open()
        held = rows.select(F.col(order).alias("at"), F.col("data").cast("binary").alias("data"))
        held = shared.written(held.repartitionByRange("at", "data").sortWithinPartitions("at", "data").withColumn("part", F.spark_partition_id()))

        def total(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                for p, g in f.groupby("part", sort=False):
                    data = pa.array(g["data"], pa.large_binary(), from_pandas=True)
                    size = np.array([len(x or b"") for x in g["data"]], np.int64)
                    last = crc.chained(crc.crc32c_all(data), size)[-1]
                    yield pd.DataFrame({"part": [p], "crc": [int(last)], "size": [int(size.sum())]})

        by_part = held.repartitionByRange("part").sortWithinPartitions("part", "at", "data").mapInPandas(total, "part int, crc long, size long")
        # One row a batch of a part, in order within the part; the seed of each part follows.
        seeds, seed = {}, self.seed
        at = F.monotonically_increasing_id()
        for r in by_part.withColumn("nth", at).orderBy("part", "nth").collect():
            seeds.setdefault(r.part, seed)
            seed = int(crc.combine(np.array([seed], np.uint32), np.array([r["crc"]], np.uint32), np.array([r["size"]]))[0])
        fs_path, limit, mark = self.path, self.options.segment_bytes, uuid.uuid4().hex
        buffer = self.options.buffer_bytes

        def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            fs, folder = pa.fs.FileSystem.from_uri(fs_path) if "://" in fs_path else (pa.fs.LocalFileSystem(), fs_path)
            part = out = None
            made, seed, size, nth, rows_ = [], 0, 0, 0, 0

            def end():
                if out is not None:
                    out.close()
                    fs.move(temp, f"{folder}/_{mark}-{part}-{nth}")
                    made.append((part, nth, rows_, seed))

            for f in frames:
                for p, g in f.groupby("part", sort=False):
                    payloads = [x or b"" for x in g["data"]]
                    if p != part:
                        end()
                        part, out, seed, nth = p, None, seeds[p], -1
                    for data, c in zip(payloads, binlog._running(payloads, seed)):
                        if out is None or limit and size >= limit:
                            end()
                            nth, rows_, size, temp = nth + 1, 0, 0, f"{folder}/_{uuid.uuid4().hex}"
                            out = fs.open_output_stream(temp, buffer_size=buffer)
                            size += out.write(binlog.record(binlog.CRC, seed, b""))
                        size += out.write(binlog.record(binlog.DATA, c, data))
                        rows_, seed = rows_ + 1, c
            end()
            yield pd.DataFrame(made, columns=["part", "nth", "rows", "seed"])

        done = held.repartitionByRange("part").sortWithinPartitions("part", "at", "data").mapInPandas(write, "part int, nth int, rows long, seed long")
        made = sorted({(r.part, r.nth): r.seed for r in done.collect()}.items())  # one row a segment
        for (part, nth), last in made:
            self.number, self.seed = self.number + 1, int(last)
            self.fs.move(f"{self.folder}/_{mark}-{part}-{nth}", f"{self.folder}/{name_of(self.number)}")
        shared.dropped(held)
        return len(made)

    def save_snapshot(self, data: bytes | None) -> None:
        """Append a marker, at once durable."""
        if data is None:
            raise ValueError("a snapshot marker needs data")
        self._open()
        seed = crc.crc32c(data, self.seed)
        self._write(f"{self.folder}/{name_of(self.number + 1)}", binlog.record(binlog.CRC, self.seed, b"") + binlog.record(binlog.SNAPSHOT, seed, data))
        self.number, self.seed = self.number + 1, seed

    def read_all(self) -> DataFrame:
        self._open()
        return binlog.read_all(self.spark, self.path)

    def prune(self, below: int) -> list[int]:
        """Remove the segments with numbers below one; those removed."""
        self._open()
        gone = [n for n in self._numbers() if n < min(below, self.number)]
        for n in gone:
            self.fs.delete_file(f"{self.folder}/{name_of(n)}")
        return gone

    def sink(self, changes: DataFrame, order: str, checkpoint: str, available: bool = False) -> StreamingQuery:
        """Append a stream; all rows of a micro-batch share one commit. After a crash
        between a batch's commit and its checkpoint the batch is appended again."""
        writer = changes.writeStream.foreachBatch(lambda rows, _: self.append(rows, order) and None).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available else writer).start()

    def close(self) -> None:
        """Nothing is left to write; closing again does no harm."""
        self.closed = True
