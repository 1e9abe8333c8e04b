"""Exact deduplication that no key's frequency can unbalance (DataFrame only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, hot_left_join, table, written

#: A digest's rows from different input partitions meet in so many groups first.
SALTS = 64


def exact_groups(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """(text_sha256, keep_id, group_size) of each distinct normalised text.

    1. Each task combines its own rows (partial aggregation on digest and text).
    2. What tasks have left meets by (digest, salt, text), the salt being of the
       task: no digest gets more than tasks / salts rows in one place.
    3. The winners of at most `salts` groups meet by (digest, text).
    The text is part of every grouping key, so equal digests never merge
    different texts. If two texts should share a SHA-256, the job stops with an
    error instead of giving one of them the other's result.
    """
    norm = F.regexp_replace(F.coalesce("text", F.lit("")), BLANKS, " ")
    d = docs.select("doc_id", norm.alias("norm")).select("doc_id", "norm", F.unhex(F.sha2("norm", 256)).alias("digest"))
    d = d.withColumn("salt", (F.spark_partition_id() % salts).cast("int"))
    salted = d.groupBy("digest", "salt", "norm").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    winners = salted.groupBy("digest", "norm").agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    one = winners.groupBy("digest").agg(F.count("*").alias("texts"), F.min("keep_id").alias("keep_id"), F.min("group_size").alias("group_size"))
    clash = F.when(F.col("texts") > 1, F.raise_error(F.lit("two texts with one SHA-256"))).otherwise(F.col("group_size"))
    return one.select("digest", "keep_id", clash.cast("long").alias("group_size"))


def exact_dedup(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """Every row of docs with its group: doc_id, keep_id (the smallest doc_id of the
    equal texts), group_size, kept, text_sha256.

    Null text counts as empty and equals an empty or all-blank-free text only if
    that is empty; runs of white space count as one space, and so a text of
    blanks equals ' '. A null doc_id is never the smallest unless all are null.
    Rows that repeat a doc_id and text are all returned; kept holds for each of
    those that have the smallest doc_id. Other columns of docs are ignored.
    """
    norm = F.regexp_replace(F.coalesce("text", F.lit("")), BLANKS, " ")
    rows = docs.select("doc_id", F.unhex(F.sha2(norm, 256)).alias("digest"))
    out = hot_left_join(rows, written(exact_groups(docs, salts)), ["digest"], "group_size", "doc_id")
    kept = F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull())
    return out.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


SQL = {
    "op2_exact_dedup": r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d"""
}
