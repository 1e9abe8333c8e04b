"""Commit order over a change log: applying up to a mark, admission by batch, reads
that wait, replay, pruning, checkpoints and index upkeep. All are plans over narrow
predicates on seq, so a batch touches only its own part of the log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import index
from . import versions as V


def high_water_mark(acks: Column, replicas: Column) -> Column:
    """The newest seq that a majority of the replicas have acknowledged, of an array of
    their seqs; replicas without one count as 0."""
    majority = F.floor(replicas / 2).cast("int") + 1
    return F.when(F.size(acks) >= majority, F.element_at(F.sort_array(acks, asc=False), majority)).otherwise(F.lit(0).cast("long"))


def in_sync(acks: DataFrame, newest: int, lag: int) -> DataFrame:
    """acks (replica, seq) with whether each is at most `lag` behind the newest seq."""
    return acks.withColumn("in_sync", F.col("seq") >= newest - lag)


def committed(log: DataFrame, applied: int, mark: int) -> DataFrame:
    """What a commit loop applies next: the rows above applied up to the mark. The same
    range is what a store replays after a crash."""
    return log.where((F.col("seq") > applied) & (F.col("seq") <= mark))


def fenced(writes: DataFrame) -> DataFrame:
    """writes (replica epoch, seq, ...) without those of an epoch that a lower seq had
    already left behind: an old leader's."""
    w = Window.partitionBy("type").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return writes.withColumn("seen", F.max("epoch").over(w)).where("seen is null or epoch >= seen").drop("seen")


def winners(writes: DataFrame, batch: str = "batch") -> DataFrame:
    """The write of each key that a batch admits: its first by seq. The others have to
    name the new seq and come again."""
    w = Window.partitionBy(batch, "k").orderBy("seq", F.desc("kind"))
    return writes.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def index_changes(log: DataFrame, path: str, applied: int, mark: int) -> DataFrame:
    """What the index of a path gains and loses when (applied, mark] is committed:
    (k, sub_key, sk, seq, change), change 1 for an entry of the new live row, -1 for
    one of the row before that it no longer has."""
    touched = committed(log, applied, mark).select("k").distinct()
    part = log.where(F.col("seq") <= mark).join(touched, "k", "left_semi")
    new = index.entries(V.live(part), path).select("k", "sub_key", "sk", "seq", F.lit(1).alias("change"))
    old = index.entries(V.as_of(part, applied), path).select("k", "sub_key", "sk", "seq", F.lit(-1).alias("change"))
    same = Window.partitionBy("k", "sub_key", "sk")
    both = new.unionByName(old).withColumn("net", F.sum("change").over(same))
    return both.where("net <> 0").drop("net")


def caught_up(primary: DataFrame, derived: DataFrame) -> DataFrame:
    """One row: the newest seq of each side and whether the derived one has caught up."""
    a = primary.agg(F.coalesce(F.max("seq"), F.lit(0).cast("long")).alias("primary_seq"))
    b = derived.agg(F.coalesce(F.max("seq"), F.lit(0).cast("long")).alias("derived_seq"))
    return a.join(F.broadcast(b)).withColumn("caught_up", F.col("derived_seq") >= F.col("primary_seq"))


def prunable(segments: DataFrame, applied: DataFrame) -> DataFrame:
    """Segments (segment, max_seq) that every consumer (consumer, seq) has applied, the
    newest always kept."""
    low = F.broadcast(applied.agg(F.min("seq").alias("low")))
    newest = F.broadcast(segments.agg(F.max("segment").alias("newest")))
    return segments.join(low, F.col("max_seq") <= F.col("low"), "left_semi").join(newest, F.col("segment") == F.col("newest"), "left_anti")


def restored(checkpoint: DataFrame, log: DataFrame, at: int) -> DataFrame:
    """The live rows from a checkpoint (the newest versions at seq `at`, tombstones
    included) and the log after it; the log before is not read."""
    return V.live(checkpoint.select("k", "seq", "kind", "v").unionByName(log.where(F.col("seq") > at).select("k", "seq", "kind", "v")))


def batched_expect(writes: DataFrame, log: DataFrame, batch: str = "batch") -> DataFrame:
    """Each admitted write of winners() with the seq it replaces, by an as-of join."""
    asks = winners(writes, batch).select("k", (F.col("seq") - 1).alias("at"), "seq")
    return V.as_of_join(asks, log).select("k", "seq", F.coalesce("found_seq", F.lit(0).cast("long")).alias("base"))
