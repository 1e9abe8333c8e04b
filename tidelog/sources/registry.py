"""The schema registry over a durable log of schema events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.operators import catalog
from tidelog.sources import binlog, wal


class Registry:
    """Types with a primary key and index paths. Each change is checked against the
    state, appended to the log, and only then in force. Opening replays the log."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.closed = spark, False
        self.log = wal.Log(spark, path, wal.SCHEMA)
        self.held = catalog.Registry()
        if self.log.number >= 0:
            # Schema events are few (one a change of a schema) and read in log order.
            for r in events(spark, path).orderBy("seq").collect():
                self.held.apply((r.op, r.type, *([r.primary_key, r.secondary_indexes or []] if r.op == catalog.REGISTER else [r.index_path])))

    def _commit(self, op: int, name: str, change: Callable[[catalog.Registry], None], **fields) -> None:
        """Try a change on a copy of the state; if it stands, make it durable, and only
        then let it hold."""
        if self.closed:
            raise catalog.Closed
        trial = catalog.Registry(self.held.events)
        change(trial)
        row = (op, name, fields.get("primary_key"), fields.get("secondary_indexes"), fields.get("index_path"))
        event = self.spark.createDataFrame([row], catalog.EVENT)
        self.log.append(event.select(F.lit(0).alias("at"), catalog.to_bytes(F.struct("*")).alias("data")), "at")
        self.held = trial

    def register(self, name: str, primary_key: str, indexes: list[str] = ()) -> None:
        catalog.check(name, primary_key, list(indexes))
        self._commit(catalog.REGISTER, name, lambda r: r.register(name, primary_key, list(indexes)), primary_key=primary_key, secondary_indexes=list(indexes))

    def add_index(self, name: str, path: str) -> None:
        if not path:
            raise catalog.InvalidSchema("index path is required")
        self._commit(catalog.ADD_INDEX, name, lambda r: r.add_index(name, path), index_path=path)

    def remove_index(self, name: str, path: str) -> None:
        self._commit(catalog.REMOVE_INDEX, name, lambda r: r.remove_index(name, path), index_path=path)

    def get(self, name: str) -> tuple[str, list[str]]:
        if self.closed:
            raise catalog.Closed
        return self.held.get(name)

    def list_types(self) -> list[str]:
        if self.closed:
            raise catalog.Closed
        return self.held.list_types()

    def types(self) -> DataFrame:
        """(type, primary_key, secondary_indexes), replayed from the log by a plan."""
        if self.closed:
            raise catalog.Closed
        return catalog.replay_types(events(self.spark, self.log.path))

    def close(self) -> None:
        self.closed = True
        self.log.close()


def events(spark: SparkSession, path: str) -> DataFrame:
    """The schema events of a log with their places: seq, op, type, primary_key,
    secondary_indexes, index_path. A record that holds none has a null op, which
    replays refuse."""
    rows = binlog.read_all(spark, path)
    seq = F.shiftleft(F.col("segment"), 36) + F.col("offset")
    return rows.select(seq.alias("seq"), catalog.from_bytes(F.col("data")).alias("e")).select("seq", "e.*")
