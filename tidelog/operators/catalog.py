"""The schema catalog: validation, replay of schema events, and the registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REGISTER, ADD_INDEX, REMOVE_INDEX = 1, 2, 3


class CatalogError(Exception):
    """Base of the errors below."""


class TypeNotFound(CatalogError): ...


class TypeExists(CatalogError): ...


class IndexExists(CatalogError): ...


class IndexNotFound(CatalogError): ...


class InvalidSchema(CatalogError): ...


class Closed(CatalogError): ...


def problem() -> Column:
    """What is wrong with a row (type, primary_key, secondary_indexes); null: valid."""
    x = F.col("secondary_indexes")
    star = lambda p: F.coalesce(F.regexp_replace(p, r"\.\*$", "").contains("*"), F.lit(False))
    return (
        F.when(F.coalesce(F.col("type"), F.lit("")) == "", "type is required")
        .when(F.coalesce(F.col("primary_key"), F.lit("")) == "", "primary key is required")
        .when(F.col("primary_key").contains("*"), "primary key can't have a wildcard")
        .when(F.exists(x, lambda p: p == ""), "index path is required")
        .when(F.exists(x, lambda p: p == F.col("primary_key")), "index equals the primary key")
        .when(F.exists(x, star), "wildcard only at the end")
        .when(F.size(F.array_distinct(x)) < F.size(x), "index is repeated")
    )


def check(name: str, primary_key: str, indexes: list[str]) -> None:
    """problem() for one schema, raising InvalidSchema."""
    bad = not name or not primary_key or "*" in primary_key or len(set(indexes)) < len(indexes)
    if bad or any(not p or p == primary_key or "*" in p.removesuffix(".*") for p in indexes):
        raise InvalidSchema(f"{name!r}: {primary_key!r}, {indexes!r}")


def replay_indexes(events: DataFrame) -> DataFrame:
    """(type, index_path) in force after events (seq, op, type, index_path,
    secondary_indexes): a type begins with the paths of its REGISTER event, and the
    newest later operation on a path decides; those on a type that is not yet, or
    never, registered are skipped. An unknown operation stops the job."""
    known = F.col("op").isin(REGISTER, ADD_INDEX, REMOVE_INDEX)
    op = F.when(known, F.col("op")).otherwise(F.raise_error(F.concat(F.lit("unknown operation "), F.coalesce(F.col("op").cast("string"), F.lit("null")))))
    e = events.select("seq", op.alias("op"), "type", "index_path", "secondary_indexes")
    # The registration of a type is its newest one; later ones replace the paths.
    at = F.max(F.when(F.col("op") == REGISTER, F.col("seq"))).over(Window.partitionBy("type"))
    e = e.withColumn("at", at).where("at is not null and seq >= at and (op <> 1 or seq = at)")
    path = F.when(F.col("op") == REGISTER, F.coalesce("secondary_indexes", F.array().cast("array<string>"))).otherwise(F.array("index_path"))
    e = e.select("type", "seq", "op", F.explode(path).alias("index_path"))
    last = e.groupBy("type", "index_path").agg(F.max(F.struct("seq", "op")).alias("x"))
    return last.where(F.col("x.op") != REMOVE_INDEX).select("type", "index_path")


def replay_types(events: DataFrame) -> DataFrame:
    """(type, primary_key, secondary_indexes, sorted) of each registered type."""
    paths = replay_indexes(events).groupBy("type").agg(F.sort_array(F.collect_list("index_path")).alias("secondary_indexes"))
    keys = events.where(F.col("op") == REGISTER).groupBy("type").agg(F.max_by("primary_key", "seq").alias("primary_key"))
    none = F.array().cast("array<string>")
    return keys.join(paths, "type", "left").select("type", "primary_key", F.coalesce("secondary_indexes", none).alias("secondary_indexes"))


def has_index(path: Column) -> Column:
    """Whether secondary_indexes has a path."""
    return F.coalesce(F.array_contains("secondary_indexes", path), F.lit(False))


#: A schema event as a struct, which to_bytes() and from_bytes() carry as JSON.
EVENT = "op int, type string, primary_key string, secondary_indexes array<string>, index_path string"


def to_bytes(event: Column) -> Column:
    """A schema event (a struct like EVENT) as bytes of a log record; fields that are
    null are left out."""
    return F.to_json(event).cast("binary")


def from_bytes(data: Column) -> Column:
    """The struct that to_bytes() was given; null for bytes that hold none."""
    return F.from_json(data.cast("string"), EVENT)


def evolution_problem(new_key: Column, new_indexes: Column) -> Column:
    """Why a row (primary_key, secondary_indexes) may not become (new_key,
    new_indexes); null: it may. Paths can come and go (they hold for rows written
    from then on), the primary key stays, and the outcome must be valid."""
    return (
        F.when(F.coalesce(new_key, F.lit("")) != F.coalesce("primary_key", F.lit("")), "primary key can't change")
        .when(F.exists(new_indexes, lambda p: p == new_key), "index equals the primary key")
        .when(F.size(F.array_distinct(new_indexes)) < F.size(new_indexes), "index is repeated")
    )


def schema_versions(events: DataFrame) -> DataFrame:
    """Every state a type has had, numbered from 1: (type, version, seq, op,
    index_path), by the operations that took part in replay order."""
    at = F.max(F.when(F.col("op") == REGISTER, F.col("seq"))).over(Window.partitionBy("type").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = events.withColumn("at", at).where("at is not null")
    version = F.row_number().over(Window.partitionBy("type").orderBy("seq")).cast("long")
    return rows.select("type", version.alias("version"), "seq", "op", "index_path")


class Registry:
    """Types with a primary key and index paths, kept as a list of schema events."""

    def __init__(self, events: list[tuple] | None = None):
        self.events: list[tuple] = []
        self.types: dict[str, tuple[str, list[str]]] = {}
        self.closed = False
        for e in events or []:
            self.apply(e)

    def apply(self, event: tuple) -> None:
        op, name, *more = event
        if op == REGISTER:
            self.types[name] = (more[0], list(more[1]))
        elif op in (ADD_INDEX, REMOVE_INDEX):
            if name in self.types:
                paths = self.types[name][1]
                if op == ADD_INDEX and more[0] not in paths:
                    paths.append(more[0])
                elif op == REMOVE_INDEX and more[0] in paths:
                    paths.remove(more[0])
        else:
            raise CatalogError(f"unknown operation {op}")
        self.events.append(event)

    def _open(self) -> None:
        if self.closed:
            raise Closed

    def register(self, name: str, primary_key: str, indexes: list[str] = ()) -> None:
        check(name, primary_key, list(indexes))
        self._open()
        if name in self.types:
            raise TypeExists(name)
        self.apply((REGISTER, name, primary_key, list(indexes)))

    def add_index(self, name: str, path: str) -> None:
        if not path:
            raise InvalidSchema("index path is required")
        primary_key, indexes = self.get(name)
        if path in indexes:
            raise IndexExists(path)
        check(name, primary_key, [*indexes, path])
        self.apply((ADD_INDEX, name, path))

    def remove_index(self, name: str, path: str) -> None:
        if path not in self.get(name)[1]:
            raise IndexNotFound(path)
        self.apply((REMOVE_INDEX, name, path))

    def get(self, name: str) -> tuple[str, list[str]]:
        """A copy of (primary key, indexes)."""
        self._open()
        if name not in self.types:
            raise TypeNotFound(name)
        primary_key, indexes = self.types[name]
        return primary_key, list(indexes)

    def list_types(self) -> list[str]:
        self._open()
        return sorted(self.types)

    def close(self) -> None:
        self.closed = True
