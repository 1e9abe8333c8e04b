"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """This application's folder in spark.checkpoint.dir, removed when it ends. Only a
    local master may leave that setting out; it gets a temporary folder."""
    context = spark.sparkContext
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if context.applicationId not in _local:
            _local[context.applicationId] = tempfile.mkdtemp(prefix="shared-")
        top = _local[context.applicationId]
    own = f"{top.rstrip('/')}/{context.applicationId}-log"
    if own not in _made:
        _made.add(own)
        fs, path = _store(spark, own)
        fs.mkdirs(path)
        fs.deleteOnExit(path)
    return own


_made: set[str] = set()
_local: dict[str, str] = {}


def _store(spark: SparkSession, where: str) -> tuple:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table of its own, which cuts its lineage."""
    path = f"{folder(df.sparkSession)}/t-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Remove tables of written() that no frame will read any more."""
    for t in tables:
        fs, path = _store(t.sparkSession, t.written_at)
        fs.delete(path, True)
