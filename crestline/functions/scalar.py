"""Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def generated_weight(src: Column, dst: Column) -> Column:
    """The deterministic edge weight (fixed values: its three factors and the modulus)."""
    return (172475 * src + 8203 * dst + 308407) % 400009


def mask(flag: Column, value: Column) -> Column:
    """The value where the flag's lowest bit is set, else 0."""
    return F.when(flag.bitwiseAND(F.lit(1)) == 1, value).otherwise(F.lit(0).cast("long"))


def mux(condition: Column, a: Column, b: Column) -> Column:
    return F.when(condition, a).otherwise(b)


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def piecewise_sigmoid(x: Column) -> Column:
    """0 up to -0.5, x + 0.5 between, 1 from 0.5."""
    return F.when(x < -0.5, F.lit(0.0)).when(x > 0.5, F.lit(1.0)).otherwise(x + 0.5)


def fixed(x: Column, bits: int = 16) -> Column:
    """A number as a fixed-point integer."""
    return F.round(x * float(1 << bits)).cast("long")


def fixed_multiply(a: Column, b: Column, bits: int = 16) -> Column:
    """Product of fixed-point integers, cut back to their precision."""
    return F.floor(a.cast("decimal(38,0)") * b.cast("decimal(38,0)") / float(1 << bits)).cast("long")


def unfixed(x: Column, bits: int = 16) -> Column:
    return x / float(1 << bits)


def tuple_hash(*columns: str) -> Column:
    """64-bit hash of a row: a single column is its own hash, two of 32 bits are packed, more are mixed."""
    if len(columns) == 1:
        return F.col(columns[0]).cast("long")
    if len(columns) == 2:
        return F.shiftleft(F.col(columns[0]).cast("long"), 32).bitwiseOR(F.col(columns[1]).cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))
    return F.xxhash64(*columns)


def key_hash(key: Column) -> Column:
    """80-bit keyed digest of a key, as hexadecimal text."""
    return F.substring(F.sha2(key.cast("string").cast("binary"), 256), 1, 20)


def later(ts: Column, interval: str) -> Column:
    """A timestamp moved by an interval such as '3 days'."""
    return ts + F.expr(f"INTERVAL {interval}")
