"""Session, storage and skew helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the text contracts: space and the five controls 09-0D.
BLANKS = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Groups that hot_left_join() broadcasts at most: every other group then has
#: fewer than one row in HOT_GROUPS of all rows, whatever the data are.
HOT_GROUPS = 1000


def shared_dir(spark: SparkSession) -> str:
    """This application's folder in the one that driver and executors share
    (spark.checkpoint.dir); it goes when the application ends. Only a local master
    may leave that setting out; it gets a temporary folder."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        held = context._jsc.sc().getCheckpointDir()
        if not held.isDefined():
            if not context.master.startswith("local[") and context.master != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="shared-"))
            held = context._jsc.sc().getCheckpointDir()
        folder = held.get()
    own = f"{folder.rstrip('/')}/{context.applicationId}"
    if own not in _owned:
        _owned.add(own)
        fs, path = _store(spark, own)
        fs.mkdirs(path)
        fs.deleteOnExit(path)
    return own


_owned: set[str] = set()


def _store(spark: SparkSession, folder: str) -> tuple:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def written(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Cut the lineage of df with a Parquet table in the shared folder, so that
    a lost executor costs no recomputation and later readers see one version."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/t-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Remove tables of written() that no frame will read any more."""
    for t in tables:
        fs, path = _store(t.sparkSession, t.written_at)
        fs.delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(c: Column) -> Column:
    """A-Z in lower case; all other characters stay. lower() is much faster than
    translate() and the same where all characters are ASCII."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def hot_left_join(left: DataFrame, groups: DataFrame, keys: list[str], size: str, spread: str, how: str = "left") -> DataFrame:
    """left joined with groups (one row for each value of keys, with its number of
    rows in the column size), safe against hot keys.

    The HOT_GROUPS largest groups, a bounded number of rows, are broadcast; rows
    that they serve are dealt out by the column spread, the others by the keys.
    A key that no broadcast row serves has less than one row in HOT_GROUPS.
    """
    cols = [c for c in groups.columns if c not in keys]
    hot = groups.where(F.col(size) > 1).orderBy(F.desc(size), *keys).limit(HOT_GROUPS)
    hot = hot.select(*[F.col(k).alias(f"hot_{k}") for k in keys], *[F.col(c).alias(f"hot_{c}") for c in cols], F.lit(True).alias("is_hot"))
    on = [left[k] == F.col(f"hot_{k}") for k in keys]
    a = left.join(F.broadcast(hot), on, "left").drop(*[f"hot_{k}" for k in keys])
    served = F.coalesce(F.col("is_hot"), F.lit(False))
    a = a.withColumn("join_salt", F.when(served, F.xxhash64(spread)).otherwise(F.lit(0)))
    b = groups.select(*[F.col(k).alias(f"g_{k}") for k in keys], *[F.col(c).alias(f"g_{c}") for c in cols])
    # Served rows get a salt that no group has; the salt is part of the equi-join.
    # It is always 0 here but no literal: a literal would be folded out of the
    # join's keys, and the served rows of a hot key would meet in one task.
    b = b.withColumn("g_salt", F.xxhash64(*[f"g_{k}" for k in keys]).bitwiseAND(F.lit(0).cast("long")))
    out = a.join(b, [a[k] == b[f"g_{k}"] for k in keys] + [F.col("join_salt") == F.col("g_salt")], "left")
    got = [F.when(served, F.col(f"hot_{c}")).otherwise(F.col(f"g_{c}")).alias(c) for c in cols]
    if how == "inner":
        out = out.where(served | F.col("g_salt").isNotNull())
    return out.select(*left.columns, *got)


def passing(rows: DataFrame, id_: str, ids: DataFrame, bits: int) -> DataFrame:
    """rows with the column `maybe`: true for all whose id is among the one column of
    ids, false for nearly all others while the ids are few against bits (a power of two).

    The filter is broadcast: bits / 64 rows at most, of two numbers, however many ids.
    """
    place = lambda c: F.pmod(F.xxhash64(c.cast("long")), F.lit(bits))
    at = ids.select(place(F.col(ids.columns[0])).alias("at"))
    held = at.select(F.shiftright("at", 6).alias("filter_word"), F.expr("shiftleft(1L, cast(at & 63 as int))").alias("bit"))
    held = held.groupBy("filter_word").agg(F.bit_or("bit").alias("filter_bits"))
    own = place(F.col(id_))
    hit = F.call_function("shiftright", F.col("filter_bits"), own.bitwiseAND(F.lit(63).cast("long")).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1
    out = rows.join(F.broadcast(held), F.shiftright(own, 6) == F.col("filter_word"), "left")
    return out.withColumn("maybe", F.coalesce(hit, F.lit(False))).drop("filter_word", "filter_bits")


def rows_of(batches: Iterator[pa.RecordBatch], text: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that the text column of each has about limit bytes,
    or one row where that row alone has more."""
    for batch in batches:
        col = batch.column(batch.schema.names.index(text))
        if batch.num_rows == 0:
            continue
        size = pa.compute.fill_null(pa.compute.binary_length(col), 0).to_pylist()
        at = total = 0
        for i, n in enumerate(size):
            if i > at and total + n > limit:
                yield batch.slice(at, i - at)
                at, total = i, 0
            total += n
        yield batch.slice(at)
