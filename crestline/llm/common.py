"""Shared pieces: tables, text expressions, the scratch folder, skew-safe joins."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as the contracts define it, for regular expressions.
WORD = "[^\\x20\\x09-\\x0D]+"
SPACES = "[\\x20\\x09-\\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test or production table by name; any path that Spark can read will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: spark.checkpoint.dir. In local mode, where it may be unset, a temporary folder; on a cluster executors share none, so it must be set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='crestline-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def packed(docs: DataFrame, **keys: Column) -> DataFrame:
    """Each row as one column ``row`` beside ``keys``, so that no column name of ``docs`` can clash; ``row.*`` unpacks it."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[c.alias(k) for k, c in keys.items()])


_SCOPE: ContextVar[list | None] = ContextVar("written", default=None)


@contextmanager
def swept() -> Iterator[None]:
    """Tables that ``stored`` writes inside go when the block ends; what reads them must have run by then."""
    written: list = []
    token = _SCOPE.set(written)
    try:
        yield
    finally:
        _SCOPE.reset(token)
        for system, path in written:
            system.delete(path, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as a table in the shared folder and read again.

    Cuts lineage, survives lost executors and lets several later passes read
    only the columns they need. The table goes with the ``swept`` block it is
    written in, or else when the application ends.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    scope = _SCOPE.get()
    if scope is None:
        system.deleteOnExit(place)
    else:
        scope.append((system, place))
    return spark.read.schema(df.schema).parquet(path)


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """True where crc32(doc_id as text) mod ``parts`` is ``part``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts == part


def joined_hot(rows: DataFrame, groups: DataFrame, on: list[str], how: str) -> DataFrame:
    """``rows`` joined with one-row-per-key ``groups`` so that a hot key can be split at run time.

    ``groups`` comes out of an aggregation by the same keys; dealing it anew
    keeps that exchange from being shared with the join, so that both inputs
    of the join are plain exchanges, whose large partitions adaptive execution
    splits (and replicates the one small row on the other side).
    """
    return rows.join(groups.hint("rebalance"), on, how)


#: Bytes of an Arrow batch that goes to a Python worker.
BATCH_BYTES = 8 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, after holding the session's Arrow batches to BATCH_BYTES, so long texts don't add up in a worker."""
    conf = df.sparkSession.conf
    now = conf.get("spark.sql.execution.arrow.maxBytesPerBatch", "64MB")
    if now != str(BATCH_BYTES):
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def word_count(text: Column) -> Column:
    """Number of words (runs of anything but 0x20 and 0x09-0x0D); 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
