"""Joins with flags, lookups, expansion, and the two-state register query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def many_to_many(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    return a.join(b, key, "inner")


def key_lookup(facts: DataFrame, dimension: DataFrame, key: list[str], keep_unmatched: bool = True) -> DataFrame:
    """Facts with the columns of the one dimension row under their key; unmatched facts stay (with nulls) unless asked not to."""
    return facts.join(dimension, key, "left" if keep_unmatched else "inner")


def unique_join(left: DataFrame, right: DataFrame, key: list[str], selects: list[Column]) -> DataFrame:
    """Inner join with a right side whose keys are unique, and a selection."""
    return left.join(right, key, "inner").select(*selects)


def left_join_flag(left: DataFrame, right: DataFrame, left_key: str, right_key: str, flag: str) -> DataFrame:
    """All rows of ``left`` with 1 or 0 for a match in ``right``; repeated keys on the right don't repeat rows."""
    keys = right.select(F.col(right_key).alias("_k")).distinct().withColumn("_hit", F.lit(1))
    return left.join(keys, F.col(left_key) == F.col("_k"), "left").withColumn(flag, F.coalesce("_hit", F.lit(0))).drop("_k", "_hit")


def full_join(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    return a.join(b, key, "full_outer")


def semi_join_sum(left: DataFrame, right: DataFrame, key: list[str], value: str, new: str) -> DataFrame:
    """``left`` with the sum of ``value`` over the right rows under each key (0 without any)."""
    return left.join(right.groupBy(*key).agg(F.sum(value).alias(new)), key, "left").withColumn(new, F.coalesce(new, F.lit(0)))


def expand(df: DataFrame, degree: str, position: str = "copy") -> DataFrame:
    """Every row as often as its ``degree`` says, numbered from 1; rows of degree 0 or less go."""
    return df.where(F.col(degree) > 0).withColumn(position, F.explode(F.sequence(F.lit(1).cast("long"), F.col(degree).cast("long"))))


def expand_range(df: DataFrame, low: int, high: int, position: str = "id") -> DataFrame:
    """Every row once for each number from low to high."""
    return df.withColumn(position, F.explode(F.sequence(F.lit(low).cast("long"), F.lit(high).cast("long")))) if low <= high else df.withColumn(position, F.lit(low).cast("long")).where("false")


def registered_twice(dmv1: DataFrame, voters1: DataFrame, dmv2: DataFrame, voters2: DataFrame) -> DataFrame:
    """Two states' licence tables (NA, AD, DL, SSN) and voter lists (DL): per person known to both, whose name each state should see.

    A name is shown if the person votes in both states, or votes in the state
    of the older address; 0 otherwise.
    """
    one = left_join_flag(dmv1, voters1, "DL", "DL", "reg").select("SSN", F.col("NA").alias("na1"), F.col("AD").alias("ad1"), F.col("reg").alias("reg1"))
    two = left_join_flag(dmv2, voters2, "DL", "DL", "reg").select("SSN", F.col("NA").alias("na2"), F.col("AD").alias("ad2"), F.col("reg").alias("reg2"))
    older = (F.col("ad1") < F.col("ad2")).cast("int")
    double = F.col("reg1").bitwiseAND(F.col("reg2"))
    show1 = double.bitwiseOR(older.bitwiseAND(F.col("reg1")))
    show2 = double.bitwiseOR((1 - older).bitwiseAND(F.col("reg2")))
    return one.join(two, "SSN").select("SSN", (F.col("na1") * show1).alias("NA1"), (F.col("na2") * show2).alias("NA2"))
