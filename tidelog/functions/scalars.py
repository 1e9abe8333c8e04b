"""Scalar helpers of sorted tables: prefixes, separators, varints, Bloom parameters."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

#: Bytes of a cache line, all probes of a key of a Bloom filter being in one.
LINE = 64


def shared_prefix(a: Column, b: Column) -> Column:
    """Characters that two strings have in common at the start."""
    most = F.least(F.length(a), F.length(b))
    same = lambda n: F.substr(a, F.lit(1), n) == F.substr(b, F.lit(1), n)
    places = F.filter(F.sequence(F.lit(1), F.greatest(most, F.lit(1))), lambda i: F.substr(a, i, F.lit(1)) != F.substr(b, i, F.lit(1)))
    return F.when(most == 0, 0).when(same(most), most).otherwise(F.element_at(places, 1) - 1)


def separator(a: bytes, b: bytes) -> bytes:
    """A shortest byte string s with a <= s < b, for a < b; a itself if none is shorter."""
    n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), None)
    if n is not None and a[n] + 1 < b[n]:
        return a[:n] + bytes([a[n] + 1])
    return a


@F.pandas_udf(BinaryType())
def _separator(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else separator(x, y) for x, y in zip(a, b)])


def separator_column(a: Column, b: Column) -> Column:
    return _separator(a.cast("binary"), b.cast("binary"))


def varint_size(n: Column) -> Column:
    """Bytes of a number from 0 on, seven bits in each."""
    bits = F.length(F.bin(n.cast("long")))
    return F.ceil(bits / 7).cast("int")


def varint(n: Column) -> Column:
    """The number's varint as hex digits: seven bits a byte, the lowest first, the top
    bit set on all but the last."""
    n = n.cast("long")
    part = lambda i: F.call_function("shiftrightunsigned", n, i.cast("int") * 7).bitwiseAND(F.lit(127).cast("long"))
    more = lambda i: F.when(i < varint_size(n) - 1, 128).otherwise(0)
    return F.array_join(F.transform(F.sequence(F.lit(0), varint_size(n) - 1), lambda i: F.lpad(F.hex(part(i) + more(i)), 2, "0")), "")


def read_varint(data: Column) -> Column:
    """The number of a varint in hex digits, whole and alone."""
    digit = lambda i: F.conv(F.substr(data, i * 2 + 1, F.lit(2)), 16, 10).cast("long").bitwiseAND(F.lit(127).cast("long"))
    places = F.sequence(F.lit(0), (F.length(data) / 2).cast("int") - 1)
    return F.aggregate(places, F.lit(0).cast("long"), lambda acc, i: acc + digit(i) * F.pow(F.lit(2), 7 * i).cast("long"))


def bloom_probes(bits_a_key: Column) -> Column:
    """Probes of a Bloom filter: bits * ln 2, from 1 to 30."""
    return F.greatest(F.lit(1), F.least(F.lit(30), F.floor(bits_a_key * F.lit(float(np.log(2)))))).cast("int")


def bloom_lines(keys: Column, bits_a_key: Column) -> Column:
    """Cache lines of a Bloom filter: enough for all bits, odd, at least 1."""
    lines = F.ceil(keys * bits_a_key / (LINE * 8)).cast("long")
    lines = F.greatest(lines, F.lit(1).cast("long"))
    return F.when(lines % 2 == 0, lines + 1).otherwise(lines)


def bloom_place(key: Column, lines: Column) -> Column:
    """The line of a key, which is the upper part of its 64-bit hash modulo lines."""
    return F.pmod(F.shiftrightunsigned(F.xxhash64(key), 32), lines.cast("long"))


def bloom_bits(key: Column, probes: Column) -> Column:
    """The bits of a key in its line, by double hashing of the hash's lower part."""
    h = F.xxhash64(key).bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
    step = F.shiftright(h, 17).bitwiseOR(F.shiftleft(h, 15)).bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
    return F.array_distinct(F.transform(F.sequence(F.lit(0), probes - 1), lambda i: F.pmod(h + i.cast("long") * step, F.lit(LINE * 8)).cast("int")))


def bloom_filter(rows: DataFrame, key: str, lines: int, probes: int) -> DataFrame:
    """(line, bits): the lines of a Bloom filter over the keys, with their set bits."""
    x = rows.select(bloom_place(F.col(key), F.lit(lines)).alias("line"), F.explode(bloom_bits(F.col(key), F.lit(probes))).alias("bit"))
    return x.groupBy("line").agg(F.sort_array(F.collect_set("bit")).alias("bits"))


def may_contain(asks: DataFrame, key: str, held: DataFrame, lines: int, probes: int) -> DataFrame:
    """asks with `maybe`: whether the filter has all bits of the key; false is sure."""
    x = asks.withColumn("_line", bloom_place(F.col(key), F.lit(lines)))
    x = x.join(held.withColumnRenamed("line", "_at"), F.col("_line") == F.col("_at"), "left")
    bits = bloom_bits(F.col(key), F.lit(probes))
    return x.withColumn("maybe", F.coalesce(F.size(F.array_intersect(bits, "bits")) == F.size(bits), F.lit(False))).drop("_line", "_at", "bits")
