"""The corpus pipeline: five stages, each over all that the one before it kept.

Filtering stages return the columns of documents; the last returns packed pieces.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import decontaminate, dedup, near, pack, toxicity
from tidelog.llm.common import table, written


def _keep(docs: DataFrame, judged: DataFrame, good) -> DataFrame:
    """The rows of docs whose doc_id is judged good.

    A doc_id names a document: rows that share one (null counts as one) stay or go
    together, and stay if any of them is judged good, so nothing clean is lost. All
    columns of docs stay as they are, whatever their names.
    """
    name = f"kept_{uuid.uuid4().hex}"
    ids = judged.where(good).select(F.col("doc_id").alias(name))
    return docs.join(ids, docs["doc_id"].eqNullSafe(F.col(name)), "left_semi")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = toxicity.toxicity(docs, table(spark, sf_dir, "labels"))
    return _keep(docs, judged, F.col("predicted") == 0)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _keep(docs, dedup.exact_dedup(docs), F.col("kept"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _keep(docs, near.near_dedup(docs), F.col("kept"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return _keep(docs, judged, ~F.col("contaminated"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("pack", pack_sequences),
]
#: The classifier and the tokenizer can't be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
