"""Version algebra over a change log with the columns k, seq, kind and v.

kind 1 sets and kind 0 deletes; at one seq a set comes before a delete, as the
newer of the two. Every function is one declarative plan: predicates on k and seq
reach the scan, and the newest-version reduction combines before its shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SET, DELETE = 1, 0


def newest(log: DataFrame) -> DataFrame:
    """The newest version of each key, tombstones included.

    row_number() = 1 becomes a WindowGroupLimit, which keeps one row a key and task
    before the shuffle, so a key with many versions costs one row a task.
    """
    w = Window.partitionBy("k").orderBy(F.desc("seq"), F.desc("kind"))
    return log.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def live(log: DataFrame) -> DataFrame:
    """The newest version of each key that is not deleted."""
    return newest(log).where(F.col("kind") == SET)


def as_of(log: DataFrame, seq: int) -> DataFrame:
    """live() at a sequence number; the filter lies below the reduction."""
    return live(log.where(F.col("seq") <= seq))


def point_get(log: DataFrame, key: str) -> DataFrame:
    return live(log.where(F.col("k") == key))


def successor(prefix: str) -> str | None:
    """The least string above all strings that start with prefix; None: no bound."""
    for i in range(len(prefix) - 1, -1, -1):
        c = ord(prefix[i])
        if c < 0x10FFFF:
            return prefix[:i] + chr(0xE000 if c == 0xD7FF else c + 1)
    return None


def range_scan(log: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """live() of start <= k < end; None leaves a side open."""
    if start is not None:
        log = log.where(F.col("k") >= start)
    if end is not None:
        log = log.where(F.col("k") < end)
    return live(log)


def prefix_scan(log: DataFrame, prefix: str) -> DataFrame:
    return range_scan(log, prefix, successor(prefix))


def page(log: DataFrame, size: int, after: str | None = None) -> DataFrame:
    """One page of the ordered live scan, by keyset."""
    rows = live(log if after is None else log.where(F.col("k") > after))
    return rows.orderBy("k").limit(size)


#: Seqs of a key's history that one window sorts: a key, however hot, is cut into
#: stretches of 2 ** STRETCH seqs, which windows over one row a stretch then join.
STRETCH = 20
ORDER = ["seq", "kind"]


def _stretched(rows: DataFrame) -> DataFrame:
    return rows.withColumn("_s", F.shiftright("seq", STRETCH))


def _beside(log: DataFrame, value: str, name: str, after: bool = False) -> DataFrame:
    """log with the value that the version before (or after) each has of its key."""
    step, end = (F.lead, F.min_by) if after else (F.lag, F.max_by)
    rows = _stretched(log)
    held = F.struct(F.col(value).alias("x"))  # null only where there is no neighbour
    ends = rows.groupBy("k", "_s").agg(end(held, F.struct(*ORDER)).alias("_e"))
    ends = ends.withColumn("_e", step("_e").over(Window.partitionBy("k").orderBy("_s"))).where("_e is not null")
    rows = rows.withColumn("_n", step(held).over(Window.partitionBy("k", "_s").orderBy(*ORDER)))
    out = rows.join(ends, ["k", "_s"], "left").withColumn(name, F.coalesce("_n", "_e")["x"])
    return out.select(*log.columns, name)


def _carried(rows: DataFrame, value: str, name: str, order: list[str]) -> DataFrame:
    """rows with the newest value that is not null at or before each, by key and order
    (seq first)."""
    s = _stretched(rows)
    ends = s.where(F.col(value).isNotNull()).groupBy("k", "_s").agg(F.max_by(value, F.struct(*order)).alias("_e"))
    all_ = s.select("k", "_s").distinct().join(ends, ["k", "_s"], "left")
    before = Window.partitionBy("k").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    all_ = all_.withColumn("_e", F.last("_e", ignorenulls=True).over(before)).where("_e is not null")
    inside = Window.partitionBy("k", "_s").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    s = s.withColumn("_n", F.last(value, ignorenulls=True).over(inside))
    return s.join(all_, ["k", "_s"], "left").withColumn(name, F.coalesce("_n", "_e")).select(*rows.columns, name)


def change_feed(log: DataFrame, after: int) -> DataFrame:
    """Changes above a seq with the value they replace.

    Of the versions at or below the bound only the newest of each key matters, so
    the windows sort the changes and one row a key besides, not the whole log.
    """
    base = newest(log.where(F.col("seq") <= after)).withColumn("old", F.lit(True))
    rows = log.where(F.col("seq") > after).withColumn("old", F.lit(False)).unionByName(base)
    return _beside(rows, "v", "prev_v").where("not old").drop("old")


def validity(log: DataFrame) -> DataFrame:
    """Each version with the seq at which it ends (null: still newest)."""
    return _beside(log, "seq", "next_seq", after=True)


def retained(log: DataFrame, horizon: int) -> DataFrame:
    """Versions that a reader at horizon or later can still see: those above it, and
    the newest of each key at or below it. Nothing above the horizon is shuffled."""
    return log.where(F.col("seq") > horizon).unionByName(newest(log.where(F.col("seq") <= horizon)))


def all_versions(log: DataFrame) -> DataFrame:
    """Every version, tombstones too, by key and then newest first."""
    return log.orderBy("k", F.desc("seq"), F.desc("kind"))


def expected_seq(log: DataFrame) -> DataFrame:
    """Each write with the seq an optimistic writer must have named (0: absent)."""
    return _beside(log, "seq", "expected_seq").withColumn("expected_seq", F.coalesce("expected_seq", F.lit(0).cast("long")))


def incarnations(log: DataFrame) -> DataFrame:
    """Sets with the seq at which the present life of their key began: that of the
    newest set up to them whose version before is a delete or none."""
    rows = _beside(log, "kind", "_before")
    first = (F.col("kind") == SET) & (F.coalesce("_before", F.lit(DELETE)) == DELETE)
    rows = _carried(rows.withColumn("_first", F.when(first, F.col("seq"))), "_first", "create_seq", ORDER)
    return rows.where(F.col("kind") == SET).drop("_before", "_first")


def merge_runs(*runs: DataFrame) -> DataFrame:
    """Union of sorted runs in which an internal key (k, seq, kind) counts once; of
    equal ones the row of the earliest run given wins, the least by value in a run."""
    value = [c for c in runs[0].columns if c not in ("k", "seq", "kind")]
    out = None
    for i, r in enumerate(runs):
        r = r.select("k", "seq", "kind", F.struct(F.lit(i).alias("run"), *value).alias("x"))
        out = r if out is None else out.unionByName(r)
    best = out.groupBy("k", "seq", "kind").agg(F.min("x").alias("x"))
    return best.select("k", "seq", "kind", *[F.col(f"x.{c}").alias(c) for c in value])


def as_of_join(asks: DataFrame, log: DataFrame) -> DataFrame:
    """asks (k, at, ...) each with the version visible at its own seq `at`: found_seq
    and found_v, null where the key is absent or deleted then.

    Both sides are one sorted history a key: the newest version so far is carried to
    the asks behind it, so nothing is paired by ranges. A version at seq `at` counts.
    """
    extra = [c for c in asks.columns if c not in ("k", "at")]
    kinds = asks.schema
    a = asks.select("k", F.col("at").alias("seq"), F.lit(2).alias("order"), F.struct(*[F.col(c) for c in extra], F.lit(1).alias("is_ask")).alias("ask"), F.lit(None).cast(f"struct<seq:bigint,kind:int,v:{log.schema['v'].dataType.simpleString()}>").alias("x"))
    none = F.lit(None).cast(a.schema["ask"].dataType)
    rows = log.select("k", "seq", F.col("kind").alias("order"), none.alias("ask"), F.struct(F.col("seq").cast("long").alias("seq"), F.col("kind").cast("int").alias("kind"), "v").alias("x"))
    # At one seq a delete (0) comes before a set (1), which wins, and asks come last.
    both = _carried(rows.unionByName(a), "x", "now", ["seq", "order"]).where("ask is not null")
    alive = F.col("now.kind") == SET
    return both.select("k", F.col("seq").cast(kinds["at"].dataType).alias("at"), *[F.col(f"ask.{c}").alias(c) for c in extra], F.when(alive, F.col("now.seq")).alias("found_seq"), F.when(alive, F.col("now.v")).alias("found_v"))


def admit(log: DataFrame, writes: DataFrame) -> DataFrame:
    """writes (k, expect) with the newest live seq and whether each is admitted:
    expect 0 asks that the key be absent, another that it be the newest seq."""
    now = live(log).select(F.col("k").alias("live_k"), F.col("seq").alias("live_seq"))
    out = writes.join(now, F.col("k") == F.col("live_k"), "left").drop("live_k")
    held: Column = F.coalesce("live_seq", F.lit(0).cast("long"))
    return out.withColumn("live_seq", held).withColumn("admitted", held == F.col("expect"))
