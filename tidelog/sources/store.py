"""A change log kept as Parquet runs under numbered manifests.

Every write is a new run, sorted by key and falling seq, and a new manifest that
lists the runs; a manifest is published by one rename that fails if its number is
taken, so of two writers at one version one gets an error and can try again.
Readers hold the runs of one manifest. A store whose rename is not atomic needs a
committer of its own.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.operators import manifest
from tidelog.operators import versions as V

LOG = "k string, seq long, kind int, v string"
FILES = "file_num long, level int, size long, min_key string, max_key string, min_seq long, max_seq long, rows long, folder string"


class StoreError(Exception):
    """Base of the errors below."""


class Closed(StoreError): ...


class NotFound(StoreError): ...


class Conflict(StoreError):
    """A key has another newest seq than the writer named."""


@dataclass(frozen=True)
class Options:
    """Level-0 runs that call for a compaction, bytes of a row group (the share of a
    scan that one key costs), and keys a run's Bloom filters are made for (0: none)."""

    trigger: int = manifest.TRIGGER
    block_bytes: int = 128 << 20
    bloom_keys: int = 1_000_000

    def writer(self) -> dict[str, str]:
        """Parquet options of a run: sorted runs compress well with zstd; pages carry
        checksums, which reads verify."""
        out = {"compression": "zstd", "parquet.block.size": str(self.block_bytes), "parquet.page.write-checksum.enabled": "true"}
        if self.bloom_keys:
            out |= {"parquet.bloom.filter.enabled#k": "true", "parquet.bloom.filter.expected.ndv#k": str(self.bloom_keys)}
        return out


VERIFY = {"parquet.page.verify-checksum.enabled": "true"}


class Snapshot:
    """The store as it was: one manifest and one seq, whatever is written later."""

    def __init__(self, store: Store, seq: int | None):
        self.store, self.at = store, store.version()
        self.seq = store.last_seq(self.at) if seq is None else seq
        self.closed = False
        store.pins.append(self.at)

    def _log(self) -> DataFrame:
        if self.closed:
            raise Closed("snapshot")
        return self.store.log(version=self.at).where(F.col("seq") <= self.seq)

    def get(self, key: str) -> DataFrame:
        return V.point_get(self._log(), key)

    def list(self, prefix: str = "") -> DataFrame:
        return V.prefix_scan(self._log(), prefix)

    def close(self) -> None:
        """Let go of the manifest; again: no harm."""
        if not self.closed:
            self.closed = True
            self.store.pins.remove(self.at)


class Store:
    def __init__(self, spark: SparkSession, path: str, options: Options = Options()):
        self.spark, self.path, self.options = spark, path.rstrip("/"), options
        self.closed, self.pins = False, []
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        root = self._path(self.path)
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = root.getFileSystem(conf)
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), conf)
        self._fs.mkdirs(self._path(f"{self.path}/manifest"))
        # Appends and compactions write to folders of their own: a watch reads the first.
        self._fs.mkdirs(self._path(f"{self.path}/runs"))

    def _open(self) -> None:
        if self.closed:
            raise Closed(self.path)

    def close(self) -> None:
        """Every accepted write is durable already; closing twice is an error."""
        self._open()
        self.closed = True

    def version(self) -> int:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.path}/manifest"))]
        return max((int(n) for n in names if n.isdigit()), default=0)

    def runs(self, version: int | None = None) -> list[dict]:
        version = self.version() if version is None else version
        if not version:
            return []
        rows = self.spark.read.text(f"{self.path}/manifest/{version}").collect()  # one row a run
        return [json.loads(r[0]) for r in rows]

    def _publish(self, runs: list[dict], version: int) -> None:
        temp = self._path(f"{self.path}/manifest/_{uuid.uuid4().hex}")
        out = self._fs.create(temp)
        out.write(bytearray("\n".join(map(json.dumps, runs)).encode()))
        out.close()
        jvm, gateway = self.spark.sparkContext._jvm, self.spark.sparkContext._gateway
        none = gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        self._context.rename(temp, self._path(f"{self.path}/manifest/{version}"), none)

    def _write_run(self, log: DataFrame, folder: str, level: int, file_num: int, parts: int | None = None) -> dict | None:
        where = f"{self.path}/{folder}"
        log.select("k", "seq", "kind", "v").repartitionByRange(*([parts] if parts else []), "k").sortWithinPartitions("k", F.desc("seq"), F.desc("kind")).write.options(**self.options.writer()).parquet(where)
        stats = self.spark.read.schema(LOG).parquet(where).agg(F.min("seq"), F.max("seq"), F.count("*"), F.min("k"), F.max("k")).first()
        size = self._fs.getContentSummary(self._path(where)).getLength()
        return {"file_num": file_num, "level": level, "size": size, "min_key": stats[3], "max_key": stats[4], "min_seq": stats[0], "max_seq": stats[1], "rows": stats[2], "folder": folder} if stats[2] else None

    def files(self, version: int | None = None) -> DataFrame:
        """The runs of a manifest, one row each."""
        self._open()
        rows = [tuple(r[c.split()[0]] for c in FILES.split(", ")) for r in self.runs(version)]
        return self.spark.createDataFrame(rows, FILES)

    def stats(self) -> DataFrame:
        """Rows, keys and bounds of each run, read from the runs themselves."""
        self._open()
        log = self.log().select("k", "seq", F.regexp_extract(F.input_file_name(), r"/(runs|compacted)/([^/]+)/", 2).alias("run"))
        return log.groupBy("run").agg(F.count("*").alias("rows"), F.countDistinct("k").alias("keys"), F.min("k").alias("min_key"), F.max("k").alias("max_key"))

    def last_seq(self, version: int | None = None) -> int:
        return max((r["max_seq"] for r in self.runs(version)), default=0)

    def _append(self, rows: DataFrame) -> int:
        """Give every row the next seq and publish; the new newest seq."""
        self._open()
        version = self.version()
        runs = self.runs(version)
        base = self.last_seq(version)
        staged = f"{self.path}/staged/{uuid.uuid4().hex}"
        at = F.monotonically_increasing_id()
        # Its low 33 bits number the rows of a partition; the partitions follow in turn.
        rows.withColumn("part", F.shiftright(at, 33)).withColumn("place", at.bitwiseAND((1 << 33) - 1)).write.parquet(staged)
        held = self.spark.read.parquet(staged)
        offset, starts = base, []
        for part, n in held.groupBy("part").count().orderBy("part").collect():  # one row a partition
            starts.append((part, offset))
            offset += n
        if starts:
            start = self.spark.createDataFrame(starts, "part long, start long")
            rows = held.join(F.broadcast(start), "part").withColumn("seq", F.col("start") + F.col("place") + 1)
            run = self._write_run(rows, f"runs/{uuid.uuid4().hex}", 0, self._next_file(runs))
            self._publish([*runs, run], version + 1)
        self._fs.delete(self._path(staged), True)
        return offset

    def _next_file(self, runs: list[dict]) -> int:
        """Above every number that this or any earlier manifest has."""
        return max([r["file_num"] for r in runs] + [self.version() * 1_000_000]) + 1

    def put(self, rows: DataFrame) -> int:
        """Set (k, v) rows."""
        return self._append(rows.select(F.col("k").cast("string"), F.lit(V.SET).alias("kind"), F.col("v").cast("string")))

    def delete(self, keys: DataFrame) -> int:
        """Delete the keys k, there or not."""
        return self._append(keys.select(F.col("k").cast("string"), F.lit(V.DELETE).alias("kind"), F.lit(None).cast("string").alias("v")))

    def put_if(self, rows: DataFrame) -> int:
        """Set (k, v, expect) rows if every key has the newest live seq that its writer
        expects (0: absent); else Conflict, and nothing is written."""
        self._open()
        refused = V.admit(self.log(), rows).where("not admitted").select("k").take(1)
        if refused:
            raise Conflict(refused[0][0])
        return self.put(rows)

    def log(self, after: int = 0, version: int | None = None) -> DataFrame:
        """Rows with seq > after; runs that end before are not opened."""
        self._open()
        paths = [f"{self.path}/{r['folder']}" for r in self.runs(version) if r["max_seq"] > after]
        if not paths:
            return self.spark.createDataFrame([], LOG)
        return self.spark.read.schema(LOG).options(**VERIFY).parquet(*paths).where(F.col("seq") > after)

    def get(self, key: str) -> DataFrame:
        return V.point_get(self.log(), key)

    def value(self, key: str) -> str | None:
        """The live value of one key; NotFound for an absent or deleted one."""
        found = self.get(key).select("v").take(1)
        if not found:
            raise NotFound(key)
        return found[0][0]

    def list(self, prefix: str = "") -> DataFrame:
        return V.prefix_scan(self.log(), prefix)

    def snapshot(self, seq: int | None = None) -> Snapshot:
        """A pinned view at a seq (the newest, if not given)."""
        self._open()
        return Snapshot(self, seq)

    def read(self, min_seq: int = 0, bound: int | None = None) -> DataFrame:
        """Live rows: strong (bound None: all that is written) or as of a lagging bound;
        refused if the view ends before min_seq."""
        seq = self.last_seq() if bound is None else min(bound, self.last_seq())
        if seq < min_seq:
            raise StoreError(f"seq {seq} is below {min_seq}")
        return V.as_of(self.log(), seq)

    def _replace(self, runs: list[dict], gone: list[dict], log: DataFrame, level: int, version: int) -> None:
        """One edit: runs less those gone, and the log's rows as one run of a level, split
        by the level's file size. A run's files are ranges of keys, so none is split."""
        target = manifest.FILE << level
        parts = max(1, -(-sum(r["size"] for r in gone) // target))
        run = self._write_run(log, f"compacted/{uuid.uuid4().hex}", level, self._next_file(runs), parts)
        numbers = {r["file_num"] for r in gone}
        self._publish([r for r in runs if r["file_num"] not in numbers] + ([run] if run else []), version + 1)

    def compact(self, horizon: int) -> None:
        """One run of all rows that a read at or above the horizon can see. Old runs
        stay for the readers of older manifests, until vacuum()."""
        self._open()
        version = self.version()
        runs = self.runs(version)
        self._replace(runs, runs, V.retained(self.log(version=version), horizon), 1, version)

    def compact_step(self, horizon: int = 0) -> list[int]:
        """Compact what manifest.pick() picks, if anything, into the next level, with
        the versions a read at or above the horizon can see where nothing older lies
        deeper; the numbers of the runs that went."""
        self._open()
        version = self.version()
        runs = self.runs(version)
        picked = {r.file_num: r.target for r in manifest.pick(self.files(version), self.options.trigger).select("file_num", "target").collect()}  # rows of a manifest
        gone = [r for r in runs if r["file_num"] in picked]
        if gone:
            log = self.spark.read.schema(LOG).options(**VERIFY).parquet(*[f"{self.path}/{r['folder']}" for r in gone])
            whole = len(gone) == len(runs)
            self._replace(runs, gone, V.retained(log, horizon) if whole else log, next(iter(picked.values())), version)
        return sorted(picked)

    def vacuum(self) -> list[str]:
        """Remove runs that neither the newest manifest nor a snapshot's lists."""
        self._open()
        keep = {r["folder"] for v in {self.version(), *self.pins} for r in self.runs(v)}
        gone = []
        for top in ("runs", "compacted"):
            if self._fs.exists(self._path(f"{self.path}/{top}")):
                gone += [f"{top}/{s.getPath().getName()}" for s in self._fs.listStatus(self._path(f"{self.path}/{top}"))]
        gone = sorted(set(gone) - keep)
        for folder in gone:
            self._fs.delete(self._path(f"{self.path}/{folder}"), True)
        return gone
