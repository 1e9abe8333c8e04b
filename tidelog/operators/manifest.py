"""File manifests: edits replayed to live files, and what to compact next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Level-0 files that call for a compaction, the deepest level, and the sizes that
#: levels and their files should have: BASE * 10 ** (level - 1), FILE * 2 ** level.
TRIGGER, DEEPEST = 4, 6
BASE, FILE = 4 << 20, 2 << 20


def level_bytes(level: Column) -> Column:
    """The size beyond which a level from 1 on is compacted."""
    return (F.lit(BASE) * F.pow(F.lit(10), level - 1)).cast("long")


def file_bytes(level: Column) -> Column:
    """The size at which a compaction begins a new file of a level."""
    return (F.lit(FILE) * F.pow(F.lit(2), level)).cast("long")


def live_files(edits: DataFrame) -> DataFrame:
    """Files whose newest edit adds them. Within one edit deletes come first, so an
    add wins; of several adds of a file in one edit the least row by content wins."""
    content = [c for c in edits.columns if c not in ("file_num", "edit", "op")]
    w = Window.partitionBy("file_num").orderBy(F.desc("edit"), "op", *content)
    return edits.withColumn("rn", F.row_number().over(w)).where("rn = 1 and op = 'add'").drop("rn")


def applied(files: DataFrame, deleted: DataFrame, added: DataFrame) -> DataFrame:
    """The files of the next version: less those deleted (level, file_num), and with
    those added."""
    return files.join(deleted.select("level", "file_num"), ["level", "file_num"], "left_anti").unionByName(added.select(*files.columns))


def in_order(files: DataFrame) -> DataFrame:
    """Files by level: level 0 newest first, which is how reads must go, the others,
    which don't overlap, by their smallest key."""
    return files.orderBy("level", F.when(F.col("level") > 0, F.col("min_key")), F.when(F.col("level") == 0, -F.col("file_num")), "file_num")


def level_stats(files: DataFrame) -> DataFrame:
    return files.groupBy("level").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), F.min("min_key").alias("min_key"), F.max("max_key").alias("max_key"))


def pick_l0(files: DataFrame, trigger: int = TRIGGER) -> DataFrame:
    """All level-0 files once there are `trigger` of them, and the level-1 files that
    their key range overlaps; else none. The range is one row."""
    top = level_stats(files).where((F.col("level") == 0) & (F.col("files") >= trigger)).select(F.col("min_key").alias("lo"), F.col("max_key").alias("hi"))
    near = (F.col("level") == 0) | (F.col("level") == 1) & (F.col("max_key") >= F.col("lo")) & (F.col("min_key") <= F.col("hi"))
    return files.join(F.broadcast(top), near).drop("lo", "hi")


def pick_deeper(files: DataFrame, level: int | None = None) -> DataFrame:
    """The largest file (then the least number) of a level and the files below that
    overlap it; the level is the first from 1 on that is over its size, unless given.
    The deepest level has nothing below it and is never picked."""
    some = level_stats(files).where((F.col("level") > 0) & (F.col("level") < DEEPEST))
    some = some.where(F.col("bytes") > level_bytes(F.col("level"))) if level is None else some.where(F.col("level") == level)
    first = some.agg(F.min("level").alias("from"))
    one = files.join(F.broadcast(first), F.col("level") == F.col("from")).orderBy(F.desc("size"), "file_num").limit(1)
    one = one.select("from", F.col("file_num").alias("pick"), F.col("min_key").alias("lo"), F.col("max_key").alias("hi"))
    below = (F.col("level") == F.col("from") + 1) & (F.col("max_key") >= F.col("lo")) & (F.col("min_key") <= F.col("hi"))
    return files.join(F.broadcast(one), (F.col("level") == F.col("from")) & (F.col("file_num") == F.col("pick")) | below).drop("from", "pick", "lo", "hi")


def pick(files: DataFrame, trigger: int = TRIGGER) -> DataFrame:
    """What to compact next, with the level it goes to (`target`): level 0 by its
    number of files, else the first level that is over its size; else nothing."""
    top, deeper = pick_l0(files, trigger), pick_deeper(files)
    due = F.broadcast(level_stats(files).where((F.col("level") == 0) & (F.col("files") >= trigger)).select(F.lit(1).alias("due")))
    target = F.lit(1).cast("int")
    deeper = deeper.join(due, how="left_anti")
    lowest = F.broadcast(deeper.agg((F.min("level") + 1).cast("int").alias("target")))
    return top.withColumn("target", target).unionByName(deeper.join(lowest))
