"""URL filters: host-suffix and path-prefix expressions against a rule table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_ascii, table

#: (host, path, verdict); a rule fits its host and all subdomains.
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
#: Bytes of rules, each with its digest, up to which the rule table is broadcast; a
#: larger one is shuffled.
BROADCAST_BYTES = 32 << 20


def host_of(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "rule_host string, rule_path string, rule_verdict string")


def filter_urls(urls: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """Judge every row of urls (page_id, url; other columns stay out of it).

    Each url becomes the expressions host-suffix + NUL + path-prefix, of the path
    lengths, however many, that rules of that host have. They meet the rules in an
    equi-join on the first 32 bits of their SHA-256; the full digest then confirms,
    and of the rules that fit the longest wins, by host and path together (then the
    longer host, then block before allow). No rule: default. Null or a url without
    ``://`` has an empty host and path, which no rule fits. Rules with a null host or
    path fit nothing, repeated ones count once. Rows are judged one by one, so rows
    that repeat a url or a page_id are all returned, and no url is a hot key.
    """
    expr = lambda h, p: F.sha2(F.concat(h, F.lit("\0"), p), 256)
    r = rules.select("rule_host", "rule_path", "rule_verdict").where("rule_host is not null and rule_path is not null").distinct()
    size = r.agg(F.coalesce(F.sum(F.octet_length("rule_host") + F.octet_length("rule_path") + 100), F.lit(0))).first()[0]
    ready = F.broadcast if size <= BROADCAST_BYTES else (lambda x: x)
    lengths = r.select(F.col("rule_host").alias("of_host"), F.length("rule_path").alias("n")).distinct()
    lengths = lengths.groupBy("of_host").agg(F.collect_set("n").alias("lengths"))
    r = r.withColumn("rule_digest", expr(F.col("rule_host"), F.col("rule_path")))
    r = r.withColumn("rule_short", F.substring("rule_digest", 1, 8))
    u = urls.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).withColumn("row", F.monotonically_increasing_id())
    parts = F.split("host", r"\.")
    suffixes = F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), ".")))
    page = ["row", "page_id", "host", "path"]
    e = u.select(*page, F.explode(suffixes).alias("suffix"))
    e = e.join(ready(lengths), F.col("suffix") == F.col("of_host"), "left")
    e = e.select(*page, "suffix", F.explode_outer(F.filter("lengths", lambda n: n <= F.length("path"))).alias("n"))
    e = e.select(*page, expr(F.col("suffix"), F.col("path").substr(F.lit(1), F.col("n"))).alias("digest"))
    e = e.withColumn("short", F.substring("digest", 1, 8))
    hit = e.join(ready(r), F.col("short") == F.col("rule_short"), "left")
    name = F.concat("rule_host", "rule_path")
    rank = F.struct(F.length(name).alias("n"), F.length("rule_host").alias("h"), (F.col("rule_verdict") == "block").alias("b"), name.alias("rule"), F.col("rule_verdict").alias("verdict"))
    # A task has all expressions of its rows, so one row a page is left to shuffle.
    best = hit.groupBy(*page).agg(F.max(F.when(F.col("digest") == F.col("rule_digest"), rank)).alias("best"))
    return best.select("page_id", "host", "path", "best.rule", F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), rules_frame(spark, RULES))


def _sql() -> str:
    fits = lambda h, p: f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))"
    order = sorted(RULES, key=lambda r: (-len(r[0] + r[1]), -len(r[0])))
    rule = " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for h, p, _ in order)
    verdict = " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for h, p, v in order)
    return f"""
WITH u AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages)
SELECT page_id, host, path, CASE {rule} END AS rule, CASE {verdict} ELSE 'allow' END AS verdict FROM u"""


SQL = {"op5_url_filter": _sql()}
