"""Secondary indexes on JSON paths: dot paths, and a trailing .* over a map."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import versions


def json_expr(path: str) -> str:
    """The JSONPath of a dot path; quotes keep unusual names literal."""
    return "$" + "".join(f"['{p}']" if not p.isidentifier() else f".{p}" for p in path.split(".") if p)


def extract(value: Column, path: str) -> Column:
    """The text at a dot path; null where it is missing or the JSON is broken."""
    return F.get_json_object(value, json_expr(path))


def entries(rows: DataFrame, path: str) -> DataFrame:
    """(k, seq, sub_key, sk) index entries; `a.b.*` gives one for each map key."""
    if path == "*" or path.endswith(".*"):
        inner = F.col("v") if path == "*" else extract(F.col("v"), path[:-2])
        return rows.select("k", "seq", F.explode(F.from_json(inner, "map<string,string>")).alias("sub_key", "sk"))
    return rows.select("k", "seq", F.lit(None).cast("string").alias("sub_key"), extract(F.col("v"), path).alias("sk")).where("sk is not null")


def build(log: DataFrame, path: str) -> DataFrame:
    """The index over all set versions; entries of overwritten ones stay."""
    rows = entries(log.where(F.col("kind") == versions.SET), path)
    return rows.groupBy("k", "sub_key", "sk").agg(F.max("seq").alias("index_seq"))


def lookup(log: DataFrame, index: DataFrame, path: str, values: list[str]) -> DataFrame:
    """Live rows whose path has one of the values: candidates from the index, then
    a recheck against the live row, for the index may be stale."""
    hits = index.where(F.col("sk").isin(values)).select(F.col("k").alias("hit_k"), "sk")
    now = versions.live(log.join(hits.select(F.col("hit_k").alias("k")).distinct(), "k", "left_semi"))
    return now.join(hits, (F.col("k") == F.col("hit_k")) & (extract(F.col("v"), path) == F.col("sk"))).drop("hit_k")
