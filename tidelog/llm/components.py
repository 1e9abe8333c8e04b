"""Connected components of narrow edges by alternating stars, on any skew."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written


def _stars(e: DataFrame) -> bool:
    """Whether every u of the edges (u > v) has one v, which is no u itself."""
    ends = e.select(F.explode(F.array(F.struct(F.col("u").alias("id"), F.lit(1).alias("up")), F.struct(F.col("v").alias("id"), F.lit(0).alias("up")))).alias("x")).select("x.*")
    seen = ends.groupBy("id").agg(F.sum("up").alias("ups"), F.min("up").alias("low"))
    return seen.where("ups > 1 or ups = 1 and low = 0").limit(1).count() == 0


def _step(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over edges (u > v), which are dropped: neighbours move to their
    least common one.

    The least neighbours are written first, so the join that follows shuffles both
    sides itself and Spark can split the rows of a hub among tasks.
    """
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = written(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("at"), F.least("m", "u").alias("m")))
    out = both.join(least, F.col("u") == F.col("at"))
    if large:
        pairs = out.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
    else:
        ends = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))
        pairs = out.select(F.explode(ends).alias("x")).select("x.*").where("u > v").distinct()
    pairs = written(pairs)
    dropped(edges, least)
    return pairs


def components(edges: DataFrame) -> DataFrame:
    """(id, component_id) of every id in edges (a, b) with a <> b, component_id the
    smallest id that is reachable. Loops and repeated edges do no harm. Nothing but
    one flag a round comes to the driver; each step is a table in the shared folder,
    and edges that are stars already, each around its least id, need no step."""
    e = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct())
    while not _stars(e):
        e = _step(_step(e, True), False)
    ids = F.explode(F.array("u", "v")).alias("id")
    return e.select(ids, F.col("v").alias("component_id")).distinct()
