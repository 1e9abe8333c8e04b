"""Queries that write the change log to a binary log, a store or a stream, and read it
back, in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidelog.operators import versions as V
from tidelog.plans.catalogue import LIVE, LOG_SQL, NEWEST_SQL, log
from tidelog.plans.scalars import crc_sql
from tidelog.sources import binlog, shared, wal
from tidelog.sources.registry import Registry
from tidelog.sources.store import LOG, Options, Store
from tidelog.streaming import watch

#: Bytes of a segment and rows of a batch in these queries.
SEGMENT, HALF = 64 << 10, 5000


def _path(spark, name: str) -> str:
    return f"{shared.folder(spark)}/{name}-{uuid.uuid4().hex}".removeprefix("file:")


def _records(spark, sf_dir):
    """seq and value as one payload, so that the order shows."""
    data = F.concat(F.lpad(F.col("seq").cast("string"), 9, "0"), F.lit(":"), "v")
    return log(spark, sf_dir).where("v is not null").select("seq", data.alias("data"))


def _written(spark, sf_dir) -> wal.Log:
    held = wal.Log(spark, _path(spark, "wal"), wal.Options(SEGMENT))
    rows = _records(spark, sf_dir)
    held.append(rows.where(F.col("seq") <= HALF), "seq")
    held.save_snapshot(b"half")
    again = wal.Log(spark, held.path, wal.Options(SEGMENT))  # opened anew: it goes on
    again.append(rows.where(F.col("seq") > HALF), "seq")
    return again


def log_roundtrip(spark, sf_dir):
    """Payloads of two appends with a marker between, read back in log order."""
    rows = _written(spark, sf_dir).read_all()
    data = F.col("data").cast("string")
    rows = rows.select("segment", "offset", F.substring(data, 1, 9).cast("long").alias("seq"), F.substring(data, 11, 1 << 30).alias("v"))
    before = F.lag("seq").over(Window.partitionBy("segment").orderBy("offset"))
    return rows.select("seq", "v", F.coalesce(before < F.col("seq"), F.lit(True)).alias("in_order"))


def log_types(spark, sf_dir):
    """Records by type, less the CRC records at the segments' heads."""
    rows = binlog.scan(spark, _written(spark, sf_dir).path)
    return rows.where(F.col("type") != binlog.CRC).groupBy("type").agg(F.count("*").alias("n"), F.sum(F.length("data")).alias("bytes"))


def log_crcs(spark, sf_dir):
    """The running CRC after the last record of an append that is one chain: that of all
    payloads in a row."""
    held = wal.Log(spark, _path(spark, "wal"), wal.Options(SEGMENT))
    held.append(log(spark, sf_dir).where("v is not null").select("seq", F.col("v").alias("data")), "seq")
    rows = binlog.running_crc(binlog.scan(spark, held.path))
    return rows.agg(F.max_by("crc", F.struct("segment", "offset")).alias("crc"))


def log_after_prune(spark, sf_dir):
    """A log without its first segments still reads, from where they end."""
    held = _written(spark, sf_dir)
    held.prune(held.number)
    data = F.col("data").cast("string")
    return held.read_all().agg(F.max(F.substring(data, 1, 9).cast("long")).alias("last_seq"), F.countDistinct("segment").alias("segments"))


def segment_assignment(spark, sf_dir):
    """The segment of each record where one of 16 KiB or more is followed by a new one."""
    rows = _records(spark, sf_dir).select("seq", F.octet_length("data").cast("long").alias("size"))
    return wal.assign_segments(rows, "seq", "size", 16 << 10)


def catalog_registry(spark, sf_dir):
    """A registry that was written, closed, opened again and changed."""
    path = _path(spark, "registry")
    types = [r[0] for r in log(spark, sf_dir).select("event_type").distinct().orderBy("event_type").collect()]  # five
    one = Registry(spark, path)
    for t in types:
        one.register(t, "id", ["p1", "p2"])
    one.remove_index(types[0], "p1")
    one.close()
    two = Registry(spark, path)
    two.add_index(types[0], "p1")
    two.add_index(types[1], "p9")
    two.remove_index(types[2], "p2")
    return two.types().select("type", "primary_key", F.array_join("secondary_indexes", ",").alias("paths"))


def _quarters(spark, sf_dir):
    """The log in four batches of equal length."""
    x = log(spark, sf_dir)
    return x.join(F.broadcast(x.agg(F.max("seq").alias("newest")))).withColumn("batch", F.floor((F.col("seq") - 1) * 4 / F.col("newest")).cast("long"))


def _store(spark, sf_dir, batches: int = 4) -> Store:
    """A store that gets each batch's newest versions: its sets, then its deletes."""
    held = Store(spark, _path(spark, "store"), Options(trigger=4, bloom_keys=10_000))
    x = _quarters(spark, sf_dir)
    for b in range(batches):
        rows = V.newest(x.where(F.col("batch") == b))
        held.put(rows.where("kind = 1").select("k", "v"))
        held.delete(rows.where("kind = 0").select("k"))
    return held


def store_list(spark, sf_dir):
    return _store(spark, sf_dir).list("/users/").select("k", "v")


def store_get(spark, sf_dir):
    return _store(spark, sf_dir).get("/users/000042").select("k", "v")


def store_snapshot(spark, sf_dir):
    """A snapshot taken after two batches, read after two more and a compaction."""
    held = _store(spark, sf_dir, 2)
    pinned = held.snapshot()
    held.put(V.live(_quarters(spark, sf_dir).where("batch >= 2")).select("k", "v"))
    held.compact(held.last_seq())
    held.vacuum()
    return pinned.list().select("k", "v")


def store_compacted(spark, sf_dir):
    """Live rows after the picked compaction, which moves all runs to level 1."""
    held = _store(spark, sf_dir)
    assert held.compact_step() and not held.compact_step()
    return held.list().select("k", "v")


def store_levels(spark, sf_dir):
    """Runs and rows by level after a compaction at the horizon 0: all versions stay."""
    held = _store(spark, sf_dir)
    held.compact_step()
    return held.files().groupBy("level").agg(F.count("*").alias("runs"), F.sum("rows").alias("rows"))


def store_stats(spark, sf_dir):
    """Rows and keys of the runs of each batch."""
    return _store(spark, sf_dir).stats().select("rows", "keys", "min_key", "max_key")


def store_gc(spark, sf_dir):
    """What is left after a compaction to the newest versions: each key's last write."""
    held = _store(spark, sf_dir)
    held.compact(held.last_seq())
    return held.log().select("k", "kind", "v")


def _changes(spark, sf_dir) -> str:
    """The log as Parquet files in ranges of seq."""
    path = _path(spark, "changes")
    log(spark, sf_dir).select("k", "seq", "kind", "v").repartitionByRange(4, "seq").write.parquet(path)
    return path


def watch_events(spark, sf_dir):
    """A watch from 0: the snapshot at HALF, then the deltas."""
    path, out = _changes(spark, sf_dir), _path(spark, "watched")
    emit = lambda rows, n: rows.select("k", "seq", "kind", "v", F.lit("snapshot" if n < 0 else "delta").alias("phase")).write.parquet(f"{out}/{n + 1}")
    query = watch.watch(spark.read.parquet(path), watch.stream(spark, path), _path(spark, "checkpoint"), emit, at=HALF, available=True)
    query.awaitTermination()
    return spark.read.schema(f"{LOG}, phase string").option("recursiveFileLookup", "true").parquet(out)


def watch_latest(spark, sf_dir):
    """The newest version of each key, kept by a stream of one file a batch."""
    path, out = _changes(spark, sf_dir), _path(spark, "latest")
    changes = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(path)
    watch.keep_latest(changes, out, _path(spark, "checkpoint"), available=True).awaitTermination()
    return watch.latest(spark, out).select("k", "seq", "kind", "v")


def commit_loop(spark, sf_dir):
    """Rows and index entries applied by a commit loop whose mark stays at 7000."""
    path, out = _changes(spark, sf_dir), _path(spark, "applied")
    changes = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(path)
    watch.apply_committed(changes, lambda: 7000, out, _path(spark, "checkpoint"), "k", available=True).awaitTermination()
    rows = spark.read.schema(LOG).option("recursiveFileLookup", "true").parquet(f"{out}/rows")
    entries = spark.read.schema("k string, seq long, sub_key string, sk string").option("recursiveFileLookup", "true").parquet(f"{out}/index")
    return rows.select("k", "seq", "kind").join(entries.select("k", "seq", "sk"), ["k", "seq"], "left")


QUERIES = {f.__name__: f for f in (log_roundtrip, log_types, log_crcs, log_after_prune, segment_assignment, catalog_registry, store_list, store_get, store_snapshot, store_compacted, store_levels, store_stats, store_gc, watch_events, watch_latest, commit_loop)}

_QUARTERS = "(SELECT *, (seq - 1) * 4 // (SELECT max(seq) FROM log) AS batch FROM log)"
_VERSIONS = f"(SELECT batch, k, seq, kind, v FROM (SELECT *, row_number() OVER (PARTITION BY batch, k ORDER BY seq DESC, kind DESC) AS rn FROM {_QUARTERS}) WHERE rn = 1)"
_LIVE = f"SELECT k, v FROM ({LIVE})"
SQL = {
    "log_roundtrip": "SELECT seq, v, true AS in_order FROM log WHERE v IS NOT NULL",
    "log_types": "SELECT CAST(3 AS BIGINT) AS type, count(*) AS n, CAST(sum(strlen(v) + 10) AS BIGINT) AS bytes FROM log WHERE v IS NOT NULL UNION ALL SELECT 2, 1, 4",
    "log_crcs": f"SELECT {crc_sql('t')} AS crc FROM (SELECT string_agg(v, '' ORDER BY seq) AS t FROM log)",
    "log_after_prune": "SELECT max(seq) AS last_seq, CAST(1 AS BIGINT) AS segments FROM log WHERE v IS NOT NULL",
    "segment_assignment": """SELECT seq, size, max(n) FILTER (n IS NOT NULL) OVER (ORDER BY seq) AS segment FROM (SELECT x.seq, x.size, s.n FROM sized x LEFT JOIN starts s ON x.seq = s.seq)""",
    "catalog_registry": f"SELECT type, 'id' AS primary_key, CASE WHEN i = 2 THEN 'p1,p2,p9' WHEN i = 3 THEN 'p1' ELSE 'p1,p2' END AS paths FROM (SELECT event_type AS type, row_number() OVER (ORDER BY event_type) AS i FROM log GROUP BY event_type)",
    "store_list": _LIVE,
    "store_get": f"SELECT * FROM ({_LIVE}) WHERE k = '/users/000042'",
    "store_snapshot": f"SELECT k, v FROM ({NEWEST_SQL.format(src=f'(SELECT * FROM {_QUARTERS} WHERE batch < 2)')})",
    "store_compacted": _LIVE,
    "store_levels": f"SELECT CAST(1 AS INTEGER) AS level, CAST(1 AS BIGINT) AS runs, count(*) AS rows FROM {_VERSIONS}",
    "store_stats": f"SELECT count(*) AS rows, count(DISTINCT k) AS keys, min(k) AS min_key, max(k) AS max_key FROM {_VERSIONS} GROUP BY batch, kind",
    "store_gc": "SELECT k, kind, v FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC, kind DESC) AS rn FROM log) WHERE rn = 1",
    "watch_events": f"SELECT k, seq, kind, v, 'snapshot' AS phase FROM ({NEWEST_SQL.format(src=f'(SELECT * FROM log WHERE seq <= {HALF})')}) UNION ALL SELECT k, seq, kind, v, 'delta' FROM log WHERE seq > {HALF}",
    "watch_latest": "SELECT k, seq, kind, v FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC, kind DESC) AS rn FROM log) WHERE rn = 1",
    "commit_loop": "SELECT k, seq, kind, json_extract_string(v, '$.k') AS sk FROM log WHERE seq <= 7000",
}
SQL = {k: f"WITH {LOG_SQL} {v}" for k, v in SQL.items()}
# A record opens a segment if the ones since the last opening have the bytes.
SQL["segment_assignment"] = SQL["segment_assignment"].replace("WITH log AS", "WITH RECURSIVE log AS").replace("  FROM events)", """  FROM events),
sized AS MATERIALIZED (SELECT seq, CAST(strlen(v) + 10 AS BIGINT) AS size, CAST(coalesce(sum(strlen(v) + 10) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM log WHERE v IS NOT NULL),
starts AS (
  SELECT min(seq) AS seq, CAST(0 AS BIGINT) AS before, CAST(0 AS BIGINT) AS n FROM sized
  UNION ALL
  SELECT s.seq, s.before, t.n + 1 FROM starts t, LATERAL (SELECT seq, before FROM sized WHERE before >= t.before + 16384 ORDER BY seq LIMIT 1) s)""", 1)
