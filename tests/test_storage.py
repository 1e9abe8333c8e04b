"""The binary log, the Parquet store and the watch, each by its rules."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelog.functions import scalars
from tidelog.operators import catalog, commit, manifest
from tidelog.operators import versions as V
from tidelog.plans import catalogue
from tidelog.sources import binlog, wal
from tidelog.sources.registry import Registry
from tidelog.sources.store import LOG, Closed, Conflict, NotFound, Options, Store, StoreError
from tidelog.streaming import watch

SF = "/root/testdata/sf0.001"


def test_binlog(spark, tmp_path):
    first, seed = binlog.segment([b"a", b"", b"x" * 1000])
    second, _ = binlog.segment([b"b" * 7], seed)
    torn = second + binlog.record(binlog.DATA, 1, b"y" * 2000)[:-1200]
    (tmp_path / "wal-0000000000000000.log").write_bytes(first)
    (tmp_path / "wal-0000000000000001.log").write_bytes(torn)
    (tmp_path / "wal-x.log").write_bytes(b"junk")
    got = binlog.scan(spark, str(tmp_path))
    assert [bytes(r.data or b"") for r in binlog.payloads(got).collect()] == [b"a", b"", b"x" * 1000, b"b" * 7]
    assert binlog.broken_chain(got).count() == 0
    assert binlog.parse(first + bytes(4096), 0, False) == binlog.parse(first, 0, True)
    with pytest.raises(binlog.CorruptLog):
        list(binlog.parse(torn, 0, False))
    spoilt = bytearray(first)
    spoilt[first.index(b"xxx")] ^= 1
    with pytest.raises(binlog.CorruptLog):
        list(binlog.parse(bytes(spoilt), 0, True))
    holed = bytearray(first)
    holed[512:1024] = bytes(512)
    assert len([*binlog.parse(bytes(holed), 0, True)]) == 3


def test_store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    assert s.list().count() == 0 and s.compact(0) is None
    frame = spark.createDataFrame([(f"/a/{i:03}", str(i)) for i in range(100)], "k string, v string")
    assert s.put(frame.repartition(3)) == 100
    assert s.delete(frame.where("k < '/a/010'")) == 110
    assert s.put(spark.createDataFrame([("/a/000", "new"), ("/b", None)], "k string, v string")) == 112
    assert sorted(r.seq for r in s.log().collect()) == list(range(1, 113))
    assert s.get("/a/000").first().v == "new" and s.get("/a/001").count() == 0
    assert s.list("/a/").count() == 91 and s.snapshot(100).list().count() == 100
    assert s.log(after=110).count() == 2
    version = s.version()
    s.compact(112)
    assert s.list("/a/").count() == 91 and len(s.runs()) == 1 and s.log(version=version).count() == 112
    with pytest.raises(Exception, match="exist"):
        s._publish([], version)


def test_watch(spark, tmp_path):
    log = catalogue.log(spark, SF).select("k", "seq", "kind", "v")
    log = spark.createDataFrame(log.collect(), LOG)
    log.repartitionByRange(3, "seq").write.parquet(str(tmp_path / "log"))
    held = spark.read.parquet(str(tmp_path / "log"))
    got = {}
    query = watch.watch(held, watch.stream(spark, str(tmp_path / "log")), str(tmp_path / "c1"), lambda rows, n: got.update({n: rows.collect()}), at=500, available=True)
    query.awaitTermination()
    assert sorted(got[-1]) == sorted(V.as_of(log, 500).collect())
    assert sorted(r.seq for n, rows in got.items() if n >= 0 for r in rows) == sorted(r.seq for r in log.where("seq > 500").collect())
    with pytest.raises(watch.Expired):
        watch.watch(held, held, "", print, from_seq=3, oldest=9)
    changes = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    watch.keep_latest(changes, str(tmp_path / "state"), str(tmp_path / "c2"), available=True).awaitTermination()
    assert len([*(tmp_path / "state").iterdir()]) > 1
    assert sorted(watch.latest(spark, str(tmp_path / "state")).collect(), key=str) == sorted(V.newest(log).collect(), key=str)


def test_log(spark, tmp_path):
    """Appends, rotation, a marker, a torn end, the chain, pruning and closing."""
    r = random.Random(2)
    data = [r.randbytes(r.choice([0, 1, 7, 300, 5000])) for _ in range(200)]
    frame = spark.createDataFrame([(i, bytearray(x)) for i, x in enumerate(data)], "at int, data binary")
    log = wal.Log(spark, str(tmp_path), wal.Options(20_000))
    assert log.append(frame.where("at < 120").repartition(3), "at") > 2
    with pytest.raises(ValueError):
        log.save_snapshot(None)
    log.save_snapshot(b"mark")
    log.close()
    log.close()
    with pytest.raises(wal.Closed):
        log.append(frame, "at")
    last = sorted(tmp_path.glob("wal-*.log"))[-1]
    whole = last.read_bytes()
    last.write_bytes(whole + binlog.record(binlog.DATA, 5, b"z" * 900)[:-600] + bytes(512))
    log = wal.Log(spark, str(tmp_path), wal.Options(20_000))
    assert last.read_bytes() == whole
    log.append(frame.where("at >= 120"), "at")
    assert [bytes(x.data or b"") for x in log.read_all().collect()] == data
    records = binlog.scan(spark, str(tmp_path))
    assert [bytes(x.data) for x in records.where("type = 2").collect()] == [b"mark"]
    sizes = binlog.segments(spark, str(tmp_path)).collect()
    assert all(20_000 <= x.bytes < 26_000 for x in sizes[:2]) and log.append(frame.where("false"), "at") == 0
    gone = log.prune(2)
    assert gone == [0, 1] and binlog.segments(spark, str(tmp_path)).first().segment == 2 and log.read_all().count() < 200
    (tmp_path / wal.name_of(3)).write_bytes(binlog.segment([b"other"], 9)[0])
    with pytest.raises(binlog.CorruptLog, match="follow"):
        log.read_all()


def test_log_many_parts(spark, tmp_path):
    """More parts than tasks, so that one batch holds several."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        log = wal.Log(spark, str(tmp_path))
        rows = spark.range(500).selectExpr("id", "cast(concat('r', id) as binary) as data")
        held = rows.repartitionByRange(9, "id")
        spark.conf.set("spark.sql.shuffle.partitions", "2")
        assert log.append(held, "id") >= 2
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert [bytes(x.data) for x in log.read_all().collect()] == [b"r%d" % i for i in range(500)]


def test_rotate():
    r = np.random.default_rng(3)
    for limit in (0, 1, 50, 1000):
        sizes = r.integers(1, 120, 300)
        want, held, number = [], 0, 0
        for x in sizes:
            if limit and held >= limit:
                held, number = 0, number + 1
            want.append(number)
            held += x
        got = [wal.rotate(sizes[:130], limit)]
        got.append(wal.rotate(sizes[130:], limit, *got[0][1:]))
        assert [*got[0][0], *got[1][0]] == want


def test_store_model(spark, tmp_path):
    """Random writes against a dict, with compactions, snapshots and vacuums between."""
    r = random.Random(4)
    s, model, kept = Store(spark, str(tmp_path / "m"), Options(trigger=3)), {}, []
    for step in range(8):
        keys = [f"/k/{r.randrange(30):02}" for _ in range(12)]
        rows = {k: str(r.random()) for k in keys}
        if step % 3 == 2:
            s.delete(spark.createDataFrame([(k,) for k in rows], "k string"))
            model = {k: v for k, v in model.items() if k not in rows}
        else:
            s.put(spark.createDataFrame([*rows.items()], "k string, v string"))
            model |= rows
        if step in (1, 4):
            kept.append((s.snapshot(), dict(model)))
        if step % 2:
            s.compact_step()
        assert {x.k: x.v for x in s.list().collect()} == model
    s.compact(s.last_seq())
    s.vacuum()
    for snap, want in kept:
        assert {x.k: x.v for x in snap.list().collect()} == want
        snap.close()
        snap.close()
        with pytest.raises(Closed):
            snap.get("x")
    assert s.vacuum() and {x.k: x.v for x in s.list().collect()} == model
    key = min(model)
    seq = s.get(key).first().seq
    with pytest.raises(Conflict):
        s.put_if(spark.createDataFrame([(key, "x", seq - 1)], "k string, v string, expect long"))
    s.put_if(spark.createDataFrame([(key, "x", seq), ("/new", "y", 0)], "k string, v string, expect long"))
    assert s.value(key) == "x" and s.read(s.last_seq()).count() == len(model) + 1
    with pytest.raises(StoreError):
        s.read(s.last_seq(), bound=seq)
    with pytest.raises(NotFound):
        s.value("/none")
    s.close()
    for f in (s.close, s.log, s.snapshot):
        with pytest.raises(Closed):
            f()


def test_durable_registry(spark, tmp_path):
    one = Registry(spark, str(tmp_path / "r"))
    one.register("pods", "name", ["node"])
    one.add_index("pods", "zone")
    for error, f in ((catalog.TypeExists, lambda: one.register("pods", "name")), (catalog.InvalidSchema, lambda: one.register("", "x")), (catalog.IndexExists, lambda: one.add_index("pods", "zone")), (catalog.TypeNotFound, lambda: one.remove_index("x", "y")), (catalog.InvalidSchema, lambda: one.add_index("pods", "name"))):
        with pytest.raises(error):
            f()
    one.close()
    one.close()
    with pytest.raises(catalog.Closed):
        one.get("pods")
    two = Registry(spark, str(tmp_path / "r"))
    assert two.get("pods") == ("name", ["node", "zone"]) and two.list_types() == ["pods"]
    assert [tuple(r) for r in two.types().collect()] == [("pods", "name", ["node", "zone"])]
    bad = spark.createDataFrame([(1, 9, "t", None, None, None)], "seq long, op int, type string, index_path string, primary_key string, secondary_indexes array<string>")
    with pytest.raises(Exception, match="unknown operation 9"):
        catalog.replay_indexes(bad).collect()


def test_ties(spark):
    """At one seq a set is newer than a delete; equal keys go to the earlier run; an add
    outlives a delete of its edit."""
    x = spark.createDataFrame([("a", 5, 0, None), ("a", 5, 1, "v"), ("b", 5, 1, "v"), ("b", 6, 0, None)], LOG)
    assert [(r.k, r.v) for r in V.live(x).collect()] == [("a", "v")]
    y = spark.createDataFrame([("a", 5, 1, "later")], LOG)
    for order, want in (((x, y), "v"), ((y, x), "later")):
        assert [r.v for r in V.merge_runs(*order).where("k = 'a' and kind = 1").collect()] == [want]
    edits = spark.createDataFrame([(1, 1, "add", 9), (1, 1, "delete", 9), (2, 1, "delete", 9), (1, 2, "add", 8), (1, 2, "add", 7), (3, 1, "add", 1), (3, 2, "delete", 1)], "file_num long, edit long, op string, size long")
    assert sorted((r.file_num, r.size) for r in manifest.live_files(edits).collect()) == [(1, 7)]


def test_pick(spark):
    rows = [(1, 0, 10, "a", "m"), (2, 1, 9 << 20, "b", "c"), (3, 1, 9 << 20, "d", "k"), (4, 2, 1, "a", "b"), (5, 2, 1, "c", "z"), (6, 6, 1 << 60, "a", "z")]
    files = spark.createDataFrame(rows, "file_num long, level int, size long, min_key string, max_key string")
    got = lambda df: sorted((r.file_num, r.target) for r in df.collect())
    assert got(manifest.pick(files)) == [(2, 2), (4, 2), (5, 2)]
    assert got(manifest.pick(files, 1)) == [(1, 1), (2, 1), (3, 1)]
    assert got(manifest.pick(files.where("level = 6"))) == []


def test_bloom(spark):
    keys = spark.range(1000).selectExpr("concat('k', id) as k")
    probes, lines = spark.range(1).select(scalars.bloom_probes(F.lit(10)), scalars.bloom_lines(F.lit(1000), F.lit(10))).first()
    held = scalars.bloom_filter(keys, "k", lines, probes)
    assert scalars.may_contain(keys, "k", held, lines, probes).where("not maybe").count() == 0
    asks = spark.range(10_000).selectExpr("concat('x', id) as k")
    assert scalars.may_contain(asks, "k", held, lines, probes).where("maybe").count() < 500


def test_commit_marks(spark):
    x = spark.createDataFrame([([5, 9, 3],), ([7],), ([],)], "a array<long>")
    assert [r[0] for r in x.select(commit.high_water_mark(F.col("a"), F.lit(3))).collect()] == [5, 0, 0]
