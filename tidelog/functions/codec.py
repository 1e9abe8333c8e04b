"""Scalar codecs as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trailer(seq: Column, kind: Column) -> Column:
    """The 8-byte trailer of an internal key as a bit pattern: newest sorts first."""
    return F.bitwise_not(F.shiftleft(seq.cast("long"), 8).bitwiseOR(kind.cast("long")))


def trailer_seq(t: Column) -> Column:
    return F.shiftrightunsigned(F.bitwise_not(t), 8)


def trailer_kind(t: Column) -> Column:
    return F.bitwise_not(t).bitwiseAND(F.lit(255).cast("long")).cast("int")


def frame_pad(n: Column) -> Column:
    """Bytes that fill a frame of n bytes up to a multiple of eight."""
    return (8 - n % 8) % 8


def frame_length(n: Column) -> Column:
    """The length field: n in 56 bits; with padding the top byte is 0x80 | pad."""
    pad = frame_pad(n)
    return F.when(pad == 0, n).otherwise(F.shiftleft((pad + 128).cast("long"), 56).bitwiseOR(n))
