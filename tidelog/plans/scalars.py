"""Queries of the scalar functions: checksums, prefixes, varints, Bloom filters."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidelog.functions import crc
from tidelog.functions import scalars as S
from tidelog.plans.catalogue import LOG_SQL, log


def crc_column(spark, sf_dir):
    return log(spark, sf_dir).select("seq", crc.crc32c_column(F.col("v")).alias("crc"))


def block_checksum(spark, sf_dir):
    x = log(spark, sf_dir).where("v is not null")
    return x.select("seq", crc.block_checksum(F.col("v"), F.lit(1)).alias("checksum"))


def _neighbours(spark, sf_dir):
    """Values of each key with the next one in order."""
    x = log(spark, sf_dir).where("v is not null").select("k", F.col("v").alias("a")).distinct()
    return x.withColumn("b", F.lead("a").over(Window.partitionBy("k").orderBy("a"))).where("b is not null")


def shared_prefixes(spark, sf_dir):
    return _neighbours(spark, sf_dir).select("k", "a", "b", S.shared_prefix(F.col("a"), F.col("b")).cast("long").alias("n"))


def separators(spark, sf_dir):
    return _neighbours(spark, sf_dir).select("k", "a", "b", S.separator_column(F.col("a"), F.col("b")).cast("string").alias("s"))


def varints(spark, sf_dir):
    """seq * seq as a varint, its size, and read back."""
    x = log(spark, sf_dir).select("seq", (F.col("seq") * F.col("seq")).alias("n"))
    x = x.withColumn("hex", S.varint(F.col("n")))
    return x.select("seq", "hex", S.varint_size(F.col("n")).cast("long").alias("size"), S.read_varint(F.col("hex")).alias("n"))


def bloom_sizes(spark, sf_dir):
    x = log(spark, sf_dir).groupBy("k").agg(F.count("*").alias("n"))
    bits = F.col("n") % 50
    return x.select("k", S.bloom_probes(bits).cast("long").alias("probes"), S.bloom_lines(F.col("n"), bits).alias("lines"))


def bloom_lookup(spark, sf_dir):
    """Every key that was ever set passes the filter of set keys."""
    x = log(spark, sf_dir)
    held = S.bloom_filter(x.where("kind = 1").select("k").distinct(), "k", 301, 6)
    return S.may_contain(x.where("kind = 1").select("k").distinct(), "k", held, 301, 6)


QUERIES = {f.__name__: f for f in (crc_column, block_checksum, shared_prefixes, separators, varints, bloom_sizes, bloom_lookup)}


def crc_sql(text: str, more: str = "[]") -> str:
    """CRC-32C of a text's ASCII bytes and more, by the byte table. The register goes
    through a list of doubles' size, so all values stay below 2**53."""
    data = f"list_concat([CAST(4294967295 AS BIGINT)], list_transform(range(1, length({text}) + 1), lambda i: CAST(ascii(substr({text}, i, 1)) AS BIGINT)), {more})"
    table = f"[{', '.join(map(str, crc.TABLE.tolist()))}]"
    return f"xor(list_reduce({data}, lambda c, b: xor(CAST({table}[xor(c, b) % 256 + 1] AS BIGINT), c // 256)), 4294967295)"


_NEAR = "(SELECT * FROM (SELECT k, a, lead(a) OVER (PARTITION BY k ORDER BY a) AS b FROM (SELECT DISTINCT k, v AS a FROM log WHERE v IS NOT NULL)) WHERE b IS NOT NULL)"
_SAME = "(SELECT *, len(list_filter(range(1, least(length(a), length(b)) + 1), lambda i: substr(a, 1, i) = substr(b, 1, i))) AS n FROM " + _NEAR + ")"
SQL = {
    "crc_column": f"SELECT seq, CASE WHEN v IS NOT NULL THEN {crc_sql('v')} END AS crc FROM log",
    "block_checksum": f"SELECT seq, {crc_sql('v', '[CAST(1 AS BIGINT)]')} AS checksum FROM log WHERE v IS NOT NULL",
    "shared_prefixes": f"SELECT k, a, b, n FROM {_SAME}",
    "separators": f"SELECT k, a, b, CASE WHEN n < length(a) AND ascii(substr(a, n + 1, 1)) + 1 < ascii(substr(b, n + 1, 1)) THEN concat(substr(a, 1, n), chr(ascii(substr(a, n + 1, 1)) + 1)) ELSE a END AS s FROM {_SAME}",
    "varints": "SELECT seq, array_to_string(list_transform(range(0, size), lambda i: printf('%02X', n // CAST(power(128, i) AS BIGINT) % 128 + CASE WHEN i < size - 1 THEN 128 ELSE 0 END)), '') AS hex, size, n FROM (SELECT seq, seq * seq AS n, CAST(len(list_filter(range(1, 9), lambda i: seq * seq >= CAST(power(128, i) AS BIGINT))) + 1 AS BIGINT) AS size FROM log)",
    "bloom_sizes": "SELECT k, CAST(greatest(1, least(30, floor(n % 50 * ln(2)))) AS BIGINT) AS probes, CAST(l + CASE WHEN l % 2 = 0 THEN 1 ELSE 0 END AS BIGINT) AS lines FROM (SELECT k, n, greatest(1, CAST(ceil(n * (n % 50) / 512) AS BIGINT)) AS l FROM (SELECT k, count(*) AS n FROM log GROUP BY k))",
    "bloom_lookup": "SELECT DISTINCT k, true AS maybe FROM log WHERE kind = 1",
}
SQL = {k: f"WITH {LOG_SQL} {v}" for k, v in SQL.items()}
