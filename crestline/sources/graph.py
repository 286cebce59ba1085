"""Graph and table sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import generated_weight


def longs(columns: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.LongType()) for c in columns])


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """White-space separated integers under a header line; empty lines are skipped, bad ones fail.

    The header is the first line that isn't empty; only it is looked at on the driver.
    """
    lines = spark.read.text(path).select(F.trim(F.regexp_replace("value", "\\s+", " ")).alias("line")).where("line != ''")
    head = lines.first()
    columns = head["line"].split(" ") if head else []
    if not columns:
        raise ValueError("a header is needed")
    width = len(columns)
    parts = lines.where(F.col("line") != head["line"]).select(F.split("line", " ").alias("p"))
    checked = F.when(F.size("p") == width, F.col("p")).otherwise(F.raise_error(F.concat(F.lit("a row has other columns than the header: "), F.array_join("p", " "))).cast("array<string>"))
    return parts.select(checked.alias("p")).select(*[F.col("p")[i].cast("long").alias(c) for i, c in enumerate(columns)])


def read_graph(spark: SparkSession, path: str, delimiter: str = "|", columns: tuple[str, ...] = ("src", "dst", "rating")) -> DataFrame:
    """Delimited integers without a header; a row that doesn't fit fails."""
    return spark.read.schema(longs(list(columns))).option("sep", delimiter).option("mode", "FAILFAST").csv(path)


def read_triples(spark: SparkSession, path: str, delimiter: str = "|") -> DataFrame:
    return read_graph(spark, path, delimiter, ("node1", "node2", "node3"))


def read_weighted_edges(spark: SparkSession, path: str) -> DataFrame:
    """x,y,w lines; repeated lines count once."""
    return read_graph(spark, path, ",", ("x", "y", "w")).dropDuplicates()


def with_generated_weight(edges: DataFrame, name: str = "rating") -> DataFrame:
    return edges.withColumn(name, generated_weight(F.col("src"), F.col("dst")))


def write_table(df: DataFrame, path: str, delimiter: str = "|") -> None:
    df.write.mode("overwrite").option("sep", delimiter).csv(path)


def write_nothing(df: DataFrame) -> None:
    """Runs a query to its end and drops the rows."""
    df.write.format("noop").mode("overwrite").save()


def lineitem_graph(lineitem: DataFrame, src: str = "l_orderkey", dst: str = "l_partkey") -> DataFrame:
    """Distinct weighted edges between two numbers of all line items.

    The ids are declared free of nulls: else every join adds its own null
    filter below the aggregation, and self-joins can't share one scan and shuffle.
    """
    known = lineitem.where(F.col(src).isNotNull() & F.col(dst).isNotNull())
    ends = {n: F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")).alias(n) for n, c in (("src", src), ("dst", dst))}
    return with_generated_weight(known.select(*ends.values()).distinct())
