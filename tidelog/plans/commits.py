"""Queries of commit order, reads that wait, replay, pruning and index upkeep."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelog.operators import commit
from tidelog.operators import versions as V
from tidelog.plans.catalogue import LIVE, LOG_SQL, NEWEST_SQL, log

APPLIED, MARK, BATCH = 4000, 7000, 500


def commit_batch(spark, sf_dir):
    """What a commit loop at APPLIED applies when the mark is MARK."""
    return commit.committed(log(spark, sf_dir), APPLIED, MARK).select("k", "seq", "kind", "v")


def _batches(spark, sf_dir):
    return log(spark, sf_dir).withColumn("batch", F.floor((F.col("seq") - 1) / BATCH).cast("long"))


def batch_winners(spark, sf_dir):
    return commit.winners(_batches(spark, sf_dir)).select("batch", "k", "seq", "kind")


def batch_bases(spark, sf_dir):
    """Each admitted write with the live seq it replaces (0: it creates)."""
    return commit.batched_expect(_batches(spark, sf_dir), log(spark, sf_dir))


def replica_marks(spark, sf_dir):
    """For each batch, the mark of five replicas, each of which acknowledges the rows of
    one event type, and how many are in sync."""
    acks = _batches(spark, sf_dir).groupBy("batch", "event_type").agg(F.max("seq").alias("seq"))
    near = commit.in_sync(acks, 0, 0).withColumn("near", F.col("seq") >= (F.col("batch") + 1) * BATCH - 3)
    out = near.groupBy("batch").agg(F.collect_list("seq").alias("acks"), F.sum(F.col("near").cast("long")).alias("in_sync"))
    return out.select("batch", commit.high_water_mark(F.col("acks"), F.lit(5)).alias("mark"), "in_sync")


def epoch_fence(spark, sf_dir):
    """Writes of a leader of epoch seq / 1000, every seventh from one epoch before."""
    epoch = F.floor(F.col("seq") / 1000) - F.when(F.col("seq") % 7 == 0, 1).otherwise(0)
    x = log(spark, sf_dir).select(F.col("event_type").alias("type"), epoch.cast("long").alias("epoch"), "seq")
    return commit.fenced(x).select("type", "epoch", "seq")


def index_upkeep(spark, sf_dir):
    """Index entries gained and lost when (APPLIED, MARK] is committed."""
    return commit.index_changes(log(spark, sf_dir), "k", APPLIED, MARK).select("k", "sk", "seq", "change")


def index_catch_up(spark, sf_dir):
    """An index fed by sets alone against its primary."""
    x = log(spark, sf_dir)
    return commit.caught_up(x, x.where("kind = 1"))


def prune_segments(spark, sf_dir):
    x = log(spark, sf_dir).withColumn("segment", F.floor((F.col("seq") - 1) / 1024).cast("long"))
    segments = x.groupBy("segment").agg(F.max("seq").alias("max_seq"))
    applied = x.where(F.col("seq") <= MARK).groupBy(F.col("event_type").alias("consumer")).agg(F.max("seq").alias("seq"))
    return commit.prunable(segments, applied).select("segment", "max_seq")


def replay_ranges(spark, sf_dir):
    """What each consumer replays after a crash: from its last applied seq to the mark."""
    x = log(spark, sf_dir)
    applied = F.broadcast(x.where(F.col("seq") <= APPLIED).groupBy(F.col("event_type").alias("consumer")).agg(F.max("seq").alias("applied")))
    todo = commit.committed(x, 0, MARK).join(applied, (F.col("event_type") == F.col("consumer")) & (F.col("seq") > F.col("applied")))
    return todo.groupBy("consumer", "applied").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


def checkpoint_restore(spark, sf_dir):
    """The live rows from a checkpoint at APPLIED and the log after it."""
    x = log(spark, sf_dir)
    return commit.restored(V.newest(x.where(F.col("seq") <= APPLIED)), x, APPLIED).select("k", "seq", "v")


QUERIES = {f.__name__: f for f in (commit_batch, batch_winners, batch_bases, replica_marks, epoch_fence, index_upkeep, index_catch_up, prune_segments, replay_ranges, checkpoint_restore)}


def _entries(seq: int) -> str:
    rows = NEWEST_SQL.format(src=f"(SELECT * FROM log WHERE seq <= {seq})")
    return f"SELECT k, json_extract_string(v, '$.k') AS sk, seq FROM ({rows}) WHERE k IN (SELECT k FROM log WHERE seq > {APPLIED} AND seq <= {MARK})"


_WINNERS = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY (seq - 1) // {BATCH}, k ORDER BY seq, kind DESC) AS rn FROM log) WHERE rn = 1)"
SQL = {
    "commit_batch": f"SELECT k, seq, kind, v FROM log WHERE seq BETWEEN {APPLIED + 1} AND {MARK}",
    "batch_winners": f"SELECT (seq - 1) // {BATCH} AS batch, k, seq, kind FROM {_WINNERS}",
    "batch_bases": f"SELECT w.k, w.seq, CASE WHEN l.kind = 1 THEN l.seq ELSE 0 END AS base FROM {_WINNERS} w ASOF LEFT JOIN log l ON w.k = l.k AND w.seq > l.seq",
    "replica_marks": f"SELECT batch, CASE WHEN count(*) >= 3 THEN list(ack ORDER BY ack DESC)[3] ELSE 0 END AS mark, CAST(count(*) FILTER (ack >= (batch + 1) * {BATCH} - 3) AS BIGINT) AS in_sync FROM (SELECT (seq - 1) // {BATCH} AS batch, event_type, max(seq) AS ack FROM log GROUP BY ALL) GROUP BY batch",
    "epoch_fence": "SELECT type, epoch, seq FROM (SELECT *, max(epoch) OVER (PARTITION BY type ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM (SELECT event_type AS type, seq // 1000 - CASE WHEN seq % 7 = 0 THEN 1 ELSE 0 END AS epoch, seq FROM log)) WHERE seen IS NULL OR epoch >= seen",
    "index_upkeep": f"SELECT k, sk, seq, CAST(1 AS INTEGER) AS change FROM ({_entries(MARK)}) a WHERE sk IS NOT NULL AND NOT EXISTS (SELECT * FROM ({_entries(APPLIED)}) b WHERE a.k = b.k AND a.sk = b.sk) UNION ALL SELECT k, sk, seq, -1 FROM ({_entries(APPLIED)}) a WHERE sk IS NOT NULL AND NOT EXISTS (SELECT * FROM ({_entries(MARK)}) b WHERE a.k = b.k AND a.sk = b.sk)",
    "index_catch_up": "SELECT max(seq) AS primary_seq, max(seq) FILTER (kind = 1) AS derived_seq, max(seq) FILTER (kind = 1) >= max(seq) AS caught_up FROM log",
    "prune_segments": f"SELECT segment, max_seq FROM (SELECT (seq - 1) // 1024 AS segment, max(seq) AS max_seq FROM log GROUP BY 1) WHERE max_seq <= (SELECT min(m) FROM (SELECT max(seq) AS m FROM log WHERE seq <= {MARK} GROUP BY event_type)) AND segment < (SELECT max((seq - 1) // 1024) FROM log)",
    "replay_ranges": f"SELECT event_type AS consumer, applied, count(*) AS n, min(seq) AS first_seq, max(seq) AS last_seq FROM log JOIN (SELECT event_type, max(seq) AS applied FROM log WHERE seq <= {APPLIED} GROUP BY 1) USING (event_type) WHERE seq > applied AND seq <= {MARK} GROUP BY ALL",
    "checkpoint_restore": LIVE,
}
SQL = {k: f"WITH {LOG_SQL} {v}" for k, v in SQL.items()}
