"""The query catalogue over the driver's tables, with the SQL each one equals.

`events` is the change log: seq = event_id + 1, the key is the user, and the type
'error' deletes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.operators import versions as V

LOG_SQL = """log AS (
  SELECT concat('/users/', lpad(CAST(user_id AS VARCHAR), 6, '0')) AS k, event_id + 1 AS seq,
         CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS kind,
         CASE WHEN event_type = 'error' THEN NULL ELSE props END AS v, event_type
  FROM events)"""
NEWEST_SQL = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC, kind DESC) AS rn FROM {src}) WHERE rn = 1 AND kind = 1"


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    gone = F.col("event_type") == "error"
    key = F.concat(F.lit("/users/"), F.lpad(F.col("user_id").cast("string"), 6, "0"))
    return e.select(key.alias("k"), (F.col("event_id") + 1).alias("seq"), F.when(gone, 0).otherwise(1).alias("kind"), F.when(~gone, F.col("props")).alias("v"), "event_type")


def live_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.live(log(spark, sf_dir)).select("k", "seq", "v")


HORIZON, FEED_FROM, AS_OF = 5000, 9000, 5000
LIVE = f"SELECT k, seq, v FROM ({NEWEST_SQL.format(src='log')})"


def _history(order: str = "seq, kind") -> str:
    return f"OVER (PARTITION BY k ORDER BY {order})"


def snapshot_asof(spark, sf_dir):
    return V.as_of(log(spark, sf_dir), AS_OF).select("k", "seq", "v")


def point_get(spark, sf_dir):
    return V.point_get(log(spark, sf_dir), "/users/000042").select("k", "seq", "v")


def prefix_scan(spark, sf_dir):
    return V.prefix_scan(log(spark, sf_dir), "/users/00001").select("k", "seq", "v")


def seek_range(spark, sf_dir):
    return V.range_scan(log(spark, sf_dir), "/users/000020", "/users/000060").select("k", "seq", "v")


def keyset_page(spark, sf_dir):
    """A page of the ordered scan: the limit is the feature."""
    return V.page(log(spark, sf_dir), 25, "/users/000030").select("k", "seq", "v")


def change_feed(spark, sf_dir):
    return V.change_feed(log(spark, sf_dir), FEED_FROM).select("k", "seq", "kind", "v", "prev_v")


def version_gc(spark, sf_dir):
    return V.retained(log(spark, sf_dir), HORIZON).select("k", "seq", "kind", "v")


def validity(spark, sf_dir):
    return V.validity(log(spark, sf_dir)).select("k", "seq", "kind", "next_seq")


def occ_expected_seq(spark, sf_dir):
    return V.expected_seq(log(spark, sf_dir)).select("k", "seq", "expected_seq")


def incarnation(spark, sf_dir):
    rows = V.incarnations(log(spark, sf_dir))
    return rows.groupBy("k", "create_seq").agg(F.max("seq").alias("update_seq"), F.count("*").alias("n"))


def merge_dedup(spark, sf_dir):
    x = log(spark, sf_dir)
    return V.merge_runs(x.where("seq <= 6000"), x.where("seq > 4000")).select("k", "seq", "kind", "v")


def admission(spark, sf_dir):
    x = log(spark, sf_dir)
    base = V.as_of(x, AS_OF).select(F.col("k").alias("bk"), F.col("seq").alias("bseq"))
    first = x.where(F.col("seq") > AS_OF).groupBy("k").agg(F.min("seq").alias("seq"))
    out = first.join(base, F.col("k") == F.col("bk"), "left")
    op = F.when(F.col("bk").isNull(), "create").otherwise("update")
    return out.select("k", "seq", op.alias("op"), F.coalesce("bseq", F.lit(0).cast("long")).alias("base"))


def index_lookup(spark, sf_dir):
    from tidelog.operators import index

    x = log(spark, sf_dir)
    return index.lookup(x, index.build(x, "k"), "k", ["42", "43", "44"]).select("k", "seq", "sk")


def wildcard_index(spark, sf_dir):
    from tidelog.operators import index

    return index.entries(V.live(log(spark, sf_dir)), "*").select("k", "sub_key", "sk")


def json_path(spark, sf_dir):
    from tidelog.operators import index

    x = log(spark, sf_dir).where("v is not null")
    return x.select("k", "seq", index.extract(F.col("v"), "k").alias("field"))


def segment_stats(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    seg = F.floor(F.col("event_id") / 1024).cast("long").alias("segment")
    return e.groupBy(seg).agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


def sequence_bounds(spark, sf_dir):
    x = log(spark, sf_dir)
    return x.agg(F.min("seq").alias("min_seq"), F.max("seq").alias("max_seq"), F.min("k").alias("min_key"), F.max("k").alias("max_key"))


def high_water_mark(spark, sf_dir):
    """Majority offset of five replicas, each having acknowledged one event type."""
    x = log(spark, sf_dir).groupBy("event_type").agg(F.max("seq").alias("ack"))
    acks = x.agg(F.sort_array(F.collect_list("ack"), asc=False).alias("a"))
    return acks.select(F.element_at("a", F.expr("cast(size(a) / 2 as int) + 1")).alias("hwm"))


def internal_key_codec(spark, sf_dir):
    from tidelog.functions import codec

    x = log(spark, sf_dir).withColumn("trailer", codec.trailer(F.col("seq"), F.col("kind")))
    return x.select("k", "trailer", codec.trailer_seq(F.col("trailer")).alias("seq"), codec.trailer_kind(F.col("trailer")).alias("kind"))


def frame_codec(spark, sf_dir):
    from tidelog.functions import codec

    x = log(spark, sf_dir).where("v is not null").select("seq", F.octet_length("v").cast("long").alias("n"))
    return x.withColumn("pad", codec.frame_pad(F.col("n"))).withColumn("frame", codec.frame_length(F.col("n")))


def level_targets(spark, sf_dir):
    from tidelog.operators import manifest

    levels = spark.range(1, 7).withColumnRenamed("id", "level")
    return levels.select("level", manifest.level_bytes(F.col("level")).alias("level_bytes"), manifest.file_bytes(F.col("level")).alias("file_bytes"))


def manifest_live_files(spark, sf_dir):
    """Newest edit of each file; here a file is a run of 1024 events of one type and
    the run's parity tells adding from deleting."""
    from tidelog.operators import manifest

    return manifest.live_files(_edits(spark, sf_dir)).select("file_num", "level", "size", "min_key", "max_key")


def _edits(spark, sf_dir):
    e = log(spark, sf_dir).withColumn("edit", F.floor((F.col("seq") - 1) / 1024).cast("long"))
    g = e.groupBy("edit", "event_type").agg(F.count("*").alias("size"), F.min("k").alias("min_key"), F.max("k").alias("max_key"))
    op = F.when((F.col("edit") + F.length("event_type")) % 5 == 0, "delete").otherwise("add")
    # Types differ in their first letter, so a file has one edit at a time.
    return g.select("edit", ((F.col("edit") % 7) * 1000 + F.ascii("event_type")).alias("file_num"), (F.length("event_type") % 3).cast("int").alias("level"), "size", "min_key", "max_key", op.alias("op"))


def compaction_pick(spark, sf_dir):
    from tidelog.operators import manifest

    return manifest.pick_l0(manifest.live_files(_edits(spark, sf_dir)), trigger=4).select("file_num", "level")


def schema_events(spark, sf_dir):
    """Schema events drawn from the log: error removes, others add an index path. Users
    with a number divisible by 7 are never registered, the others at seq 200, each with
    the paths p3 and q; so early operations and those on unknown types are skipped."""
    from tidelog.operators import catalog

    x = log(spark, sf_dir)
    none = F.lit(None).cast("array<string>")
    path = F.concat(F.lit("p"), (F.col("seq") % 11).cast("string"))
    ops = x.where("seq <> 200").select("seq", F.when(F.col("kind") == 0, catalog.REMOVE_INDEX).otherwise(catalog.ADD_INDEX).alias("op"), F.col("k").alias("type"), path.alias("index_path"), F.lit(None).cast("string").alias("primary_key"), none.alias("secondary_indexes"))
    types = x.select(F.col("k").alias("type")).distinct().where(F.substring("type", 8, 6).cast("int") % 7 != 0)
    types = types.select(F.lit(200).cast("long").alias("seq"), F.lit(catalog.REGISTER).alias("op"), "type", F.lit(None).cast("string").alias("index_path"), F.lit("id").alias("primary_key"), F.array(F.lit("p3"), F.lit("q")).alias("secondary_indexes"))
    return types.unionByName(ops)


def catalog_replay(spark, sf_dir):
    from tidelog.operators import catalog

    return catalog.replay_indexes(schema_events(spark, sf_dir)).select("type", "index_path")


def catalog_types(spark, sf_dir):
    """Every registered type with its paths; a catalog scan lists them in order."""
    from tidelog.operators import catalog

    x = catalog.replay_types(schema_events(spark, sf_dir))
    return x.select("type", "primary_key", F.array_join("secondary_indexes", ",").alias("paths")).orderBy("type")


def index_membership(spark, sf_dir):
    from tidelog.operators import catalog

    x = catalog.replay_types(schema_events(spark, sf_dir))
    return x.select("type", catalog.has_index(F.lit("p3")).alias("has_p3"), catalog.has_index(F.lit("nowhere")).alias("has_nowhere"))


def schema_event_codec(spark, sf_dir):
    """Schema events to bytes and back."""
    from tidelog.operators import catalog

    x = schema_events(spark, sf_dir)
    data = catalog.to_bytes(F.struct("op", "type", "primary_key", "secondary_indexes", "index_path"))
    y = x.select("seq", data.alias("data")).select("seq", catalog.from_bytes(F.col("data")).alias("e"))
    return y.select("seq", "e.op", "e.type", "e.primary_key", F.array_join("e.secondary_indexes", ",").alias("paths"), "e.index_path")


def schema_evolution(spark, sf_dir):
    """May a type take up the paths of its state and one more, or another key?"""
    from tidelog.operators import catalog

    x = catalog.replay_types(schema_events(spark, sf_dir))
    key = F.when(F.substring("type", 8, 6).cast("int") % 2 == 0, "id").otherwise("uid")
    more = F.concat("secondary_indexes", F.array(F.lit("p3")))
    return x.select("type", catalog.evolution_problem(key, more).alias("problem"))


def schema_versions(spark, sf_dir):
    from tidelog.operators import catalog

    return catalog.schema_versions(schema_events(spark, sf_dir)).select("type", "version", "seq", "op", "index_path")


#: (type, primary key, secondary indexes): schemas that hold and that don't.
SCHEMAS = [
    ("users", "id", []),
    ("users", "id", ["email", "team.name"]),
    ("users", "profile.id", ["profile.tags.*"]),
    (None, "id", []),
    ("users", None, []),
    ("users", "tags.*", []),
    ("users", "a.*.b", []),
    ("users", "id", ["email", ""]),
    ("users", "id", ["email", "id"]),
    ("users", "id", ["team.*.name"]),
    ("users", "id", ["x.*.y.*"]),
    ("users", "id", ["email", "email"]),
]


def schema_validate(spark, sf_dir):
    from tidelog.operators import catalog

    rows = [(str(i), *r) for i, r in enumerate(SCHEMAS)]
    df = spark.createDataFrame(rows, "n string, type string, primary_key string, secondary_indexes array<string>")
    return df.select("n", catalog.problem().isNull().alias("valid"))


def all_versions(spark, sf_dir):
    """The ordered scan of all versions, with each one's age in its key."""
    from pyspark.sql import Window

    x = V.all_versions(log(spark, sf_dir))
    age = F.row_number().over(Window.partitionBy("k").orderBy(F.desc("seq"), F.desc("kind"))).cast("long")
    return x.select("k", "seq", "kind", "v", age.alias("age"))


def merge_ties(spark, sf_dir):
    """Runs that hold the same internal keys with other values: the first run wins."""
    x = log(spark, sf_dir).select("k", "seq", "kind", "v")
    tag = lambda n: F.concat(F.lit(n), F.coalesce("v", F.lit("")))
    a, b = x.where("seq % 3 <> 0").withColumn("v", tag("a")), x.where("seq % 2 = 0").withColumn("v", tag("b"))
    return V.merge_runs(a, b, x).select("k", "seq", "kind", "v")


def set_before_delete(spark, sf_dir):
    """Live rows where seqs tie: every 50 changes share one, and at one seq a set is
    newer than a delete (of several sets the greatest value)."""
    x = log(spark, sf_dir).select("k", (F.floor(F.col("seq") / 50) + 1).cast("long").alias("seq"), "kind", "v")
    x = x.groupBy("k", "seq", "kind").agg(F.max("v").alias("v"))
    return V.live(x).select("k", "seq", "v")


def asof_join(spark, sf_dir):
    """For each sign-up, what the next user's key held at that seq."""
    x = log(spark, sf_dir)
    asks = x.where("event_type = 'signup'").select(F.concat(F.lit("/users/"), F.lpad((F.substring("k", 8, 6).cast("int") + 1).cast("string"), 6, "0")).alias("k"), F.col("seq").alias("at"))
    return V.as_of_join(asks, x).select("k", "at", "found_seq", "found_v")


def level_sizes(spark, sf_dir):
    from tidelog.operators import manifest

    return manifest.level_stats(manifest.live_files(_edits(spark, sf_dir))).select("level", "files", F.col("bytes").cast("long").alias("bytes"), "min_key", "max_key")


def file_order(spark, sf_dir):
    """Each file with the place that reads of its level give it."""
    from pyspark.sql import Window

    from tidelog.operators import manifest

    f = manifest.in_order(manifest.live_files(_edits(spark, sf_dir)))
    by = [F.when(F.col("level") > 0, F.col("min_key")), F.when(F.col("level") == 0, -F.col("file_num")), "file_num"]
    return f.select("level", "file_num", F.row_number().over(Window.partitionBy("level").orderBy(*by)).cast("long").alias("place"))


def compaction_deeper(spark, sf_dir):
    from tidelog.operators import manifest

    return manifest.pick_deeper(manifest.live_files(_edits(spark, sf_dir)), 1).select("file_num", "level")


def compaction_next(spark, sf_dir):
    """The pick where level 0 has too few files and level 1 is beyond its size."""
    from tidelog.operators import manifest

    files = manifest.live_files(_edits(spark, sf_dir)).withColumn("size", F.shiftleft("size", 14))
    return manifest.pick(files, trigger=1000).select("file_num", "level", "target")


def manifest_apply(spark, sf_dir):
    """One edit: level-1 files of even number go, deleted files' ranges come back."""
    from tidelog.operators import manifest

    files = manifest.live_files(_edits(spark, sf_dir)).select("file_num", "level", "size", "min_key", "max_key")
    gone = files.where("level = 1 and file_num % 2 = 0")
    added = files.where("level = 0").withColumn("file_num", F.col("file_num") + 100_000).withColumn("level", F.lit(1))
    return manifest.applied(files, gone, added).select("file_num", "level", "size")


QUERIES = {f.__name__: f for f in (live_latest, snapshot_asof, point_get, prefix_scan, seek_range, keyset_page, change_feed, version_gc, validity, occ_expected_seq, incarnation, merge_dedup, admission, index_lookup, wildcard_index, json_path, segment_stats, sequence_bounds, high_water_mark, internal_key_codec, frame_codec, level_targets, manifest_live_files, compaction_pick, catalog_replay, catalog_types, index_membership, schema_event_codec, schema_evolution, schema_versions, schema_validate, all_versions, merge_ties, set_before_delete, asof_join, level_sizes, file_order, compaction_deeper, compaction_next, manifest_apply)}

_EDITS = """edits AS (
  SELECT edit, (edit % 7) * 1000 + ascii(event_type) AS file_num, CAST(length(event_type) % 3 AS INTEGER) AS level, size, min_key, max_key,
         CASE WHEN (edit + length(event_type)) % 5 = 0 THEN 'delete' ELSE 'add' END AS op
  FROM (SELECT CAST(floor((seq - 1) / 1024) AS BIGINT) AS edit, event_type, count(*) AS size, min(k) AS min_key, max(k) AS max_key FROM log GROUP BY ALL)),
files AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_num ORDER BY edit DESC, op) AS rn FROM edits) WHERE rn = 1 AND op = 'add')"""
_TYPES = """types AS (SELECT DISTINCT k AS type FROM log WHERE CAST(substr(k, 8, 6) AS INT) % 7 <> 0),
paths AS (
  SELECT type, p FROM (SELECT *, row_number() OVER (PARTITION BY type, p ORDER BY seq DESC) AS rn FROM (
    SELECT k AS type, concat('p', seq % 11) AS p, kind, seq FROM log WHERE seq > 200 AND k IN (SELECT type FROM types)
    UNION ALL SELECT type, unnest(['p3', 'q']), 1, 200 FROM types)) WHERE rn = 1 AND kind = 1)"""
_PICK = "SELECT file_num, min_key, max_key FROM files WHERE level = 1 ORDER BY size DESC, file_num LIMIT 1"
_BASE = NEWEST_SQL.format(src=f"(SELECT * FROM log WHERE seq <= {AS_OF})")
SQL = {
    "live_latest": LIVE,
    "snapshot_asof": f"SELECT k, seq, v FROM ({_BASE})",
    "point_get": f"SELECT * FROM ({LIVE}) WHERE k = '/users/000042'",
    "prefix_scan": f"SELECT * FROM ({LIVE}) WHERE starts_with(k, '/users/00001')",
    "seek_range": f"SELECT * FROM ({LIVE}) WHERE k >= '/users/000020' AND k < '/users/000060'",
    "keyset_page": f"SELECT * FROM ({LIVE}) WHERE k > '/users/000030' ORDER BY k LIMIT 25",
    "change_feed": f"SELECT * FROM (SELECT k, seq, kind, v, lag(v) {_history()} AS prev_v FROM log) WHERE seq > {FEED_FROM}",
    "version_gc": f"SELECT k, seq, kind, v FROM (SELECT *, lead(seq) {_history()} AS nx FROM log) WHERE nx IS NULL OR nx > {HORIZON}",
    "validity": f"SELECT k, seq, kind, lead(seq) {_history()} AS next_seq FROM log",
    "occ_expected_seq": f"SELECT k, seq, coalesce(lag(seq) {_history()}, 0) AS expected_seq FROM log",
    "incarnation": "SELECT k, min(seq) AS create_seq, max(seq) AS update_seq, count(*) AS n FROM (SELECT *, sum(CASE WHEN kind = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY seq ROWS UNBOUNDED PRECEDING) AS inc FROM log) WHERE kind = 1 GROUP BY k, inc",
    "merge_dedup": "SELECT DISTINCT k, seq, kind, v FROM (SELECT * FROM log WHERE seq <= 6000 UNION ALL SELECT * FROM log WHERE seq > 4000)",
    "admission": f"SELECT w.k, w.seq, CASE WHEN b.k IS NULL THEN 'create' ELSE 'update' END AS op, coalesce(b.seq, 0) AS base FROM (SELECT k, min(seq) AS seq FROM log WHERE seq > {AS_OF} GROUP BY k) w LEFT JOIN ({_BASE}) b ON w.k = b.k",
    "index_lookup": f"SELECT live.k, live.seq, idx.sk FROM (SELECT DISTINCT k, json_extract_string(v, '$.k') AS sk FROM log WHERE kind = 1) idx JOIN ({LIVE}) live ON live.k = idx.k WHERE idx.sk IN ('42', '43', '44') AND json_extract_string(live.v, '$.k') = idx.sk",
    "wildcard_index": f"SELECT live.k, e.key AS sub_key, json_extract_string(e.value, '$') AS sk FROM ({LIVE}) live, json_each(live.v) e",
    "json_path": "SELECT k, seq, json_extract_string(v, '$.k') AS field FROM log WHERE v IS NOT NULL",
    "segment_stats": "SELECT event_id // 1024 AS segment, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM events GROUP BY 1",
    "sequence_bounds": "SELECT min(seq) AS min_seq, max(seq) AS max_seq, min(k) AS min_key, max(k) AS max_key FROM log",
    "high_water_mark": "SELECT a[len(a) // 2 + 1] AS hwm FROM (SELECT list(ack ORDER BY ack DESC) AS a FROM (SELECT event_type, max(seq) AS ack FROM log GROUP BY event_type))",
    "internal_key_codec": "SELECT k, ~((seq << 8) | kind) AS trailer, (seq << 8 | kind) >> 8 AS seq, kind FROM log",
    "frame_codec": "SELECT seq, n, pad, CASE WHEN pad = 0 THEN n ELSE n + ((128 + pad) - 256) * 72057594037927936 END AS frame FROM (SELECT seq, n, (8 - n % 8) % 8 AS pad FROM (SELECT seq, CAST(strlen(v) AS BIGINT) AS n FROM log WHERE v IS NOT NULL))",
    "level_targets": "SELECT CAST(i AS BIGINT) AS level, CAST(4194304 * power(10, i - 1) AS BIGINT) AS level_bytes, CAST(2097152 * power(2, i) AS BIGINT) AS file_bytes FROM range(1, 7) t(i)",
    "manifest_live_files": "SELECT file_num, level, size, min_key, max_key FROM files",
    "compaction_pick": "SELECT file_num, level FROM files WHERE (SELECT count(*) FROM files WHERE level = 0) >= 4 AND (level = 0 OR level = 1 AND max_key >= (SELECT min(min_key) FROM files WHERE level = 0) AND min_key <= (SELECT max(max_key) FROM files WHERE level = 0))",
    "catalog_replay": "SELECT type, p AS index_path FROM paths",
    "catalog_types": "SELECT type, 'id' AS primary_key, coalesce(string_agg(p, ',' ORDER BY p), '') AS paths FROM types LEFT JOIN paths USING (type) GROUP BY type",
    "index_membership": "SELECT type, coalesce(bool_or(p = 'p3'), false) AS has_p3, false AS has_nowhere FROM types LEFT JOIN paths USING (type) GROUP BY type",
    "schema_event_codec": "SELECT seq, CASE WHEN kind = 0 THEN 3 ELSE 2 END AS op, k AS type, NULL AS primary_key, NULL AS paths, concat('p', seq % 11) AS index_path FROM log WHERE seq <> 200 UNION ALL SELECT 200, 1, type, 'id', 'p3,q', NULL FROM types",
    "schema_evolution": "SELECT type, CASE WHEN CAST(substr(type, 8, 6) AS INT) % 2 = 1 THEN 'primary key can''t change' WHEN EXISTS (SELECT * FROM paths WHERE paths.type = types.type AND p = 'p3') THEN 'index is repeated' END AS problem FROM types",
    "schema_versions": "SELECT type, row_number() OVER (PARTITION BY type ORDER BY seq) AS version, seq, op, index_path FROM (SELECT type, CAST(200 AS BIGINT) AS seq, 1 AS op, NULL AS index_path FROM types UNION ALL SELECT k, seq, CASE WHEN kind = 0 THEN 3 ELSE 2 END, concat('p', seq % 11) FROM log WHERE seq > 200 AND k IN (SELECT type FROM types))",
    "all_versions": "SELECT k, seq, kind, v, row_number() OVER (PARTITION BY k ORDER BY seq DESC, kind DESC) AS age FROM log",
    "merge_ties": "SELECT k, seq, kind, concat(CASE WHEN seq % 3 <> 0 THEN 'a' WHEN seq % 2 = 0 THEN 'b' ELSE '' END, CASE WHEN v IS NULL AND seq % 3 = 0 AND seq % 2 = 1 THEN NULL ELSE coalesce(v, '') END) AS v FROM log WHERE NOT (seq % 3 = 0 AND seq % 2 = 1) UNION ALL SELECT k, seq, kind, v FROM log WHERE seq % 3 = 0 AND seq % 2 = 1",
    "set_before_delete": "SELECT k, seq, v FROM (SELECT k, seq, kind, v, row_number() OVER (PARTITION BY k ORDER BY seq DESC, kind DESC) AS rn FROM (SELECT k, seq // 50 + 1 AS seq, kind, max(v) AS v FROM log GROUP BY ALL)) WHERE rn = 1 AND kind = 1",
    "asof_join": "SELECT a.k, a.at, CASE WHEN l.kind = 1 THEN l.seq END AS found_seq, CASE WHEN l.kind = 1 THEN l.v END AS found_v FROM (SELECT concat('/users/', lpad(CAST(CAST(substr(k, 8, 6) AS INT) + 1 AS VARCHAR), 6, '0')) AS k, seq AS at FROM log WHERE event_type = 'signup') a ASOF LEFT JOIN log l ON a.k = l.k AND a.at >= l.seq",
    "level_sizes": "SELECT level, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes, min(min_key) AS min_key, max(max_key) AS max_key FROM files GROUP BY level",
    "file_order": "SELECT level, file_num, row_number() OVER (PARTITION BY level ORDER BY CASE WHEN level > 0 THEN min_key END NULLS FIRST, CASE WHEN level = 0 THEN -file_num END NULLS FIRST, file_num) AS place FROM files",
    "compaction_deeper": f"SELECT f.file_num, f.level FROM files f, ({_PICK}) p WHERE f.file_num = p.file_num OR f.level = 2 AND f.max_key >= p.min_key AND f.min_key <= p.max_key",
    "compaction_next": f"SELECT f.file_num, f.level, CAST(2 AS INTEGER) AS target FROM files f, ({_PICK}) p WHERE (SELECT sum(size) * 16384 FROM files WHERE level = 1) > 4194304 AND (f.file_num = p.file_num OR f.level = 2 AND f.max_key >= p.min_key AND f.min_key <= p.max_key)",
    "manifest_apply": "SELECT file_num, level, size FROM files WHERE NOT (level = 1 AND file_num % 2 = 0) UNION ALL SELECT file_num + 100000, 1, size FROM files WHERE level = 0",
}
_PARTS = (("FROM files", _EDITS), ("FROM types", _TYPES), ("FROM paths", _TYPES))
SQL = {k: f"WITH {', '.join([LOG_SQL, *dict.fromkeys(p for mark, p in _PARTS if mark in v)])} {v}" for k, v in SQL.items()}
SQL["schema_validate"] = "SELECT CAST(i AS VARCHAR) AS n, i < 3 AS valid FROM range(12) t(i)"
