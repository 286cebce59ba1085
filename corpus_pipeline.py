"""A training-corpus pipeline over ``documents``: five stages, each written as Parquet and read again by the next.

In all stages rows are documents of their own, whatever their ids: rows that
repeat an id, or have none, are judged by their texts. All columns of the input
are carried along, whatever their names. An empty table stays empty, but has
the last stage's columns. Texts are read whole, however long. Ties are settled
as each stage states.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from crestline.llm.common import scratch_dir, swept, table
from crestline.llm.decontaminate import drop_leaks
from crestline.llm.exact_dedup import drop_exact_duplicates
from crestline.llm.langid import fit, keep_identified
from crestline.llm.mixing import mixed_documents
from crestline.llm.near_dedup import drop_near_duplicates


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter (null and empty texts, too) and those whose language is ambiguous; equal texts share their fate."""
    return keep_identified(docs, fit(docs))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of equal texts: the one of most code points, then of the smallest id (null last); null texts count as empty."""
    return drop_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate component (five-word shingles, similarity 0.8): the one of the smallest id, then of the least text hash; texts without words all stay."""
    return drop_near_duplicates(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark passage; null and empty texts hold none."""
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix uses, with the words taken from each; those without words go, a null source is a source of its own."""
    return mixed_documents(docs)


STAGES = [("language", language), ("exact", exact), ("near", near), ("decontaminated", decontaminated), ("mixed", mixed)]

#: Language identification is a learned model, which SQL can't express; tests hold the pipeline against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{scratch_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        with swept():
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
