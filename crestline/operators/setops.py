"""Set operations on keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def intersect(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Rows of ``a`` whose key is in ``b``."""
    return a.join(b.select(key).distinct(), key, "left_semi")


def right_union(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """All rows of ``b`` and those of ``a`` whose key isn't in ``b``."""
    return b.unionByName(a.join(b.select(key), key, "left_anti").select(*b.columns))


def threat_log(sets: list[DataFrame], key: str) -> DataFrame:
    """Right unions one after the other: each key's rows come from the last set that has it."""
    return reduce(lambda a, b: right_union(a, b, key), sets)


def cardinality(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Number of distinct keys in both, and their sum."""
    both = a.select(key).distinct().join(b.select(key).distinct(), key, "left_semi")
    return both.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(key), F.lit(0)).alias("key_sum"))
