"""Running and per-segment operations over an explicit order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import materialise


def _running(order: list[str], key: list[str] | None = None):
    return (Window.partitionBy(*key) if key else Window.partitionBy(F.lit(0))).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def prefix_sum(df: DataFrame, value: str, order: list[str], new: str, buckets: int | None = None) -> DataFrame:
    """Inclusive running sum over the whole table, without one task that sees it all.

    Rows are dealt to ranges of all order columns and written, which fixes the
    ranges; these are summed up, and each range's running sum starts from the
    sum of those before it. There are as many ranges as shuffle partitions
    unless ``buckets`` says otherwise. Rows that agree on all order columns
    may lie on either side of each other.
    """
    buckets = max(2, buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = materialise(df.repartitionByRange(buckets, *order).withColumn("_r", F.spark_partition_id()), "ranges")
    before = ranged.groupBy("_r").agg(F.sum(value).alias("_s")).withColumn("_before", F.coalesce(F.sum("_s").over(Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_s")
    # one row a range, so it may be broadcast
    return ranged.withColumn(new, F.sum(value).over(_running(order, ["_r"]))).join(F.broadcast(before), "_r").withColumn(new, F.col(new) + F.col("_before")).select(*df.columns, new)


def segmented_prefix_sum(df: DataFrame, key: list[str], value: str, order: list[str], new: str) -> DataFrame:
    """Running sum that starts anew under each key."""
    return df.withColumn(new, F.sum(value).over(_running(order, key)))


def segmented_copy(df: DataFrame, key: list[str], value: str, order: list[str], new: str) -> DataFrame:
    """The value of a key's first row on all rows of the key."""
    return df.join(df.groupBy(*key).agg(F.min_by(value, F.struct(*order)).alias(new)), key)


def neighbour_equal(df: DataFrame, key: str, order: list[str], new: str) -> DataFrame:
    """1 where a row's key is that of the row before it in the order, under the same key; every key's first row has 0."""
    return df.withColumn(new, (F.row_number().over(Window.partitionBy(key).orderBy(*order)) > 1).cast("int"))


def unique_key_flag(df: DataFrame, key: list[str], order: list[str], new: str) -> DataFrame:
    """1 on the last row of each key in the order (the one that stands for the key), else 0."""
    last = Window.partitionBy(*key).orderBy(*[F.desc(c) for c in order])
    return df.withColumn(new, (F.row_number().over(last) == 1).cast("int"))


def rank_in_key(df: DataFrame, key: list[str], order: list[Column | str], new: str = "rnk", start: int = 1) -> DataFrame:
    return df.withColumn(new, F.row_number().over(Window.partitionBy(*key).orderBy(*order)) - 1 + start)


def compact(df: DataFrame, column: str, zero: bool = False) -> DataFrame:
    """Rows whose column isn't 0 (or, with ``zero``, is)."""
    return df.where(F.col(column) == 0 if zero else F.col(column) != 0)


def fill_forward(df: DataFrame, value: str, key: list[str], order: list[str], new: str) -> DataFrame:
    """The last value that isn't null, up to each row."""
    return df.withColumn(new, F.last(value, ignorenulls=True).over(_running(order, key)))


def alignment(df: DataFrame, key: list[str], order: list[str], degree: str, new: str = "slot") -> DataFrame:
    """Where each copy of a row goes when the other side of a join has ``degree`` copies under the same key: copies of one row stand apart by the number of rows."""
    return df.withColumn("_row", F.row_number().over(Window.partitionBy(*key).orderBy(*order)) - 1).withColumn("_rows", F.count(F.lit(1)).over(Window.partitionBy(*key))).withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col(degree).cast("long") - 1))).withColumn(new, F.col("_copy") * F.col("_rows") + F.col("_row")).drop("_row", "_rows", "_copy")


def pack_key(high: Column, low: Column) -> Column:
    """Two 32-bit numbers in one."""
    return F.shiftleft(high.cast("long"), 32).bitwiseOR(low.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))


def unpack_key(packed: Column) -> tuple[Column, Column]:
    return F.shiftright(packed, 32), packed.bitwiseAND(F.lit(0xFFFFFFFF))


def shuffled(df: DataFrame, seed: int, key: list[str]) -> DataFrame:
    """All rows in an order drawn by the seed; the same for the same rows."""
    return df.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]).cast("binary")), *key)


def permuted(df: DataFrame, positions: DataFrame, row: str, place: str) -> DataFrame:
    """Rows by the place that ``positions`` (row, place) gives them; a row with several places is repeated, one without goes."""
    return df.join(positions, row).orderBy(place)


def take_last(df: DataFrame, k: int, order: list[str]) -> DataFrame:
    return df.orderBy(*[F.desc(c) for c in order]).limit(k)


def append_tuples(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    return a.select(*columns).unionAll(b.select(*columns))
