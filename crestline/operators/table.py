"""Relational algebra on DataFrames, with columns named or given by position."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.semiring import ADD, MAX, MIN, MUL, Operator, Ranking
from ..plans.topk import best_k

Ref = int | str


def name(df: DataFrame, c: Ref) -> str:
    return df.columns[c] if isinstance(c, int) else c


def names(df: DataFrame, cs: list[Ref]) -> list[str]:
    return [name(df, c) for c in cs]


def column_ids(df: DataFrame, wanted: list[str]) -> list[int]:
    """Positions of columns by name."""
    return [df.columns.index(c) for c in wanted]


def from_rows(spark: SparkSession, columns: list[str], rows: list[tuple]) -> DataFrame:
    """A table of bigints given in place."""
    return spark.createDataFrame(rows, ", ".join(f"{c} long" for c in columns))


def add_suffix(df: DataFrame, suffix: str) -> DataFrame:
    return df.toDF(*[f"{c}{suffix}" for c in df.columns])


def project(df: DataFrame, cs: list[Ref]) -> DataFrame:
    """The given columns in this order; a repeated one gets a numbered name."""
    out, seen = [], {}
    for c in names(df, cs):
        seen[c] = seen.get(c, 0) + 1
        out.append(F.col(c).alias(c if seen[c] == 1 else f"{c}_{seen[c]}"))
    return df.select(*out)


def anti_project(df: DataFrame, cs: list[Ref]) -> DataFrame:
    return df.drop(*names(df, cs))


def append_column(df: DataFrame, new: str, value) -> DataFrame:
    return df.withColumn(new, F.lit(value).cast("long"))


def copy_column(df: DataFrame, c: Ref, new: str) -> DataFrame:
    return df.withColumn(new, F.col(name(df, c)))


def combine_columns(df: DataFrame, a: Ref, b: Ref, op: Operator, new: str) -> DataFrame:
    return df.withColumn(new, op.combine(F.col(name(df, a)), F.col(name(df, b))))


def select_rows(df: DataFrame, predicate: Column) -> DataFrame:
    return df.where(predicate)


def sort(df: DataFrame, cs: list[Ref], descending: bool = False) -> DataFrame:
    """One direction for all columns."""
    return df.orderBy(*[F.desc(c) if descending else F.asc(c) for c in names(df, cs)])


def select_k(df: DataFrame, k: int, cs: list[Ref], descending: bool = False) -> DataFrame:
    """The k first rows by these columns, then by all others, so ties have one outcome."""
    first = names(df, cs)
    rest = [c for c in df.columns if c not in first]
    return df.orderBy(*[F.desc(c) if descending else F.asc(c) for c in first], *rest).limit(k)


def select_k_with_ties(df: DataFrame, k: int, c: Ref, descending: bool = False) -> DataFrame:
    return best_k(df, name(df, c), k, Ranking(ADD, MAX if descending else MIN))


def kth_value(df: DataFrame, k: int, c: Ref, descending: bool = True) -> DataFrame:
    """The k-th value of a column (the last one if there are fewer): one row, or null for an empty table."""
    c = name(df, c)
    top = df.select(c).orderBy(F.desc(c) if descending else F.asc(c)).limit(k)
    return top.agg((F.min if descending else F.max)(c).alias("kth"))


def aggregate(df: DataFrame, op: Operator, c: Ref, new: str = "value") -> DataFrame:
    """A fold over all rows; the operation's neutral value for an empty table."""
    value = op.aggregate(F.col(name(df, c)))
    return df.agg(F.coalesce(value.cast("long"), F.lit(op.zero).cast("long")).alias(new))


def group_aggregate(df: DataFrame, keys: list[Ref], c: Ref, new: str, op: Operator) -> DataFrame:
    value = op.aggregate(F.col(name(df, c)))
    return df.groupBy(*names(df, keys)).agg((value.cast("long") if op is MUL else value).alias(new))


def union_all(a: DataFrame, b: DataFrame) -> DataFrame:
    """Bag union by position; the names are the left's, or the right's if the left has no columns."""
    return b if not a.columns else a.unionAll(b)


def cross(a: DataFrame, b: DataFrame) -> DataFrame:
    """The full product; Spark broadcasts the smaller side if it knows it to be small, else both sides are dealt to a grid of tasks."""
    return a.crossJoin(b)


def equi_join(a: DataFrame, a_keys: list[Ref], b: DataFrame, b_keys: list[Ref]) -> DataFrame:
    """Inner join on pairs of columns; the right keys are dropped."""
    left, right = names(a, a_keys), names(b, b_keys)
    keyed = b.withColumnsRenamed({r: f"_k{i}" for i, r in enumerate(right)})
    condition = reduce(lambda x, y: x & y, [F.col(x) == F.col(f"_k{i}") for i, x in enumerate(left)])
    return a.join(keyed, condition, "inner").drop(*[f"_k{i}" for i in range(len(right))])


def semi_annotated_join(a: DataFrame, a_key: list[Ref], a_weight: Ref, b: DataFrame, b_key: list[Ref], b_weight: Ref, op: Operator = ADD) -> DataFrame:
    """Rows of ``a`` with their weight joined with that of the one row of ``b`` under their key; others go.

    Fails if a key of ``b`` has several rows.
    """
    left, right = names(a, a_key), names(b, b_key)
    many = F.count(F.lit(1)) > 1
    weight = F.when(many, F.raise_error(F.lit("the right side must be unique on its key"))).otherwise(F.first(name(b, b_weight)))
    one = b.groupBy(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(right)]).agg(weight.alias("_w"))
    condition = reduce(lambda x, y: x & y, [F.col(x) == F.col(f"_k{i}") for i, x in enumerate(left)])
    w = name(a, a_weight)
    return a.join(one, condition, "inner").withColumn(w, op.combine(F.col(w), F.col("_w"))).select(*a.columns)


def table_hash(df: DataFrame, new: str = "hash") -> DataFrame:
    """An order-insensitive digest of 60 bits (from the MD5 of each row's values as text, nulls apart): pairs of equal rows cancel out."""
    row = F.concat_ws("|", *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null")) for c in df.columns])
    number = F.conv(F.substring(F.md5(row.cast("binary")), 1, 15), 16, 10).cast("long")
    return df.agg(F.coalesce(F.bit_xor(number), F.lit(0).cast("long")).alias(new))


def show(df: DataFrame, limit: int = 20) -> None:
    """Prints the first rows with their column names."""
    df.show(limit, truncate=False)


def best_row(df: DataFrame, keys: list[Ref], by: Ref, new: str = "best") -> DataFrame:
    """Under each key the row of the largest value (ties: the largest by all columns), as a struct."""
    rest = [c for c in df.columns if c not in names(df, keys)]
    by = name(df, by)
    return df.groupBy(*names(df, keys)).agg(F.max(F.struct(by, *[c for c in rest if c != by])).alias(new))
