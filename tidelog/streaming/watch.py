"""Watching a change log: a snapshot first, then the deltas in seq order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidelog.operators import index
from tidelog.operators import versions as V
from tidelog.sources.store import LOG


class Expired(ValueError):
    """The changes after the wanted seq are no longer all kept."""


def stream(spark: SparkSession, path: str) -> DataFrame:
    """A directory of Parquet log files as a stream; each file is read once."""
    return spark.readStream.schema(LOG).option("recursiveFileLookup", "true").parquet(path)


def watch(log: DataFrame, changes: DataFrame, checkpoint: str, emit: Callable[[DataFrame, int], None], from_seq: int = 0, oldest: int = 0, at: int | None = None, available: bool = False) -> StreamingQuery:
    """Start a watch that hands (rows, batch number) to emit.

    from_seq 0: batch -1 is the live rows of `log` at seq `at` (its newest, if not
    given), then come the changes after that. Else come those after from_seq,
    and Expired is raised if it is below `oldest`, the horizon of the last garbage
    collection. Rows of a batch are sorted by seq within partitions of a key. A
    restart from the checkpoint goes on with the same from_seq; a batch may be
    handed over twice, with the same number.
    """
    if from_seq:
        if from_seq < oldest:
            raise Expired(f"{from_seq} < {oldest}")
    else:
        from_seq = log.agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0] if at is None else at
        emit(V.as_of(log, from_seq), -1)

    def batch(rows: DataFrame, number: int) -> None:
        emit(rows.repartition("k").sortWithinPartitions("seq"), number)

    writer = changes.where(F.col("seq") > from_seq).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available else writer).start()


def keep_latest(changes: DataFrame, folder: str, checkpoint: str, available: bool = False) -> StreamingQuery:
    """Keep the newest version of every key, tombstones too, in the state store. A batch
    writes the keys it changed to folder/<batch>, so a repeated one writes the same and
    no batch rewrites the others. Rows may come in any order of seq."""

    def batch(rows: DataFrame, number: int) -> None:
        rows.select("k", "x.seq", "x.kind", "x.v").write.mode("overwrite").parquet(f"{folder}/{number}")

    state = changes.groupBy("k").agg(F.max(F.struct("seq", "kind", "v")).alias("x"))
    writer = state.writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available else writer).start()


def latest(spark: SparkSession, folder: str) -> DataFrame:
    """What keep_latest() has kept so far, tombstones included."""
    return V.newest(spark.read.schema(LOG).option("recursiveFileLookup", "true").parquet(folder))


def apply_committed(changes: DataFrame, mark: Callable[[], int], folder: str, checkpoint: str, path: str = "*", available: bool = False) -> StreamingQuery:
    """The commit loop: each batch is applied up to the mark, the rest waits in
    folder/waiting. One batch writes the rows and their index entries together, as
    folder/rows/<batch> and folder/index/<batch>, so a repeated one changes nothing."""

    def batch(rows: DataFrame, number: int) -> None:
        spark, now = rows.sparkSession, mark()
        if number:
            rows = rows.unionByName(spark.read.schema(LOG).parquet(f"{folder}/waiting/{number - 1}"))
        ready = rows.where(F.col("seq") <= now)
        ready.sortWithinPartitions("seq").write.mode("overwrite").parquet(f"{folder}/rows/{number}")
        index.entries(ready.where(F.col("kind") == V.SET), path).write.mode("overwrite").parquet(f"{folder}/index/{number}")
        rows.where(F.col("seq") > now).write.mode("overwrite").parquet(f"{folder}/waiting/{number}")

    writer = changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available else writer).start()
