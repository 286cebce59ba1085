"""Exact duplicate detection by progressive refinement.

Rows are grouped by the length of the normalised text, the members of groups of
two or more by a hash of its first characters, and what survives that by a
SHA-256 of the whole of it. ``exact_duplicates`` shuffles narrow rows only (ids,
lengths, hashes); ``drop_exact_duplicates`` reads full content again only for
rows whose length and prefix occur more than once. Every grouping
pre-aggregates before its shuffle, and no group is ever collected, so one group
may hold any share of the rows.

Defined results: a null text counts as empty; empty texts equal each other; of
equal texts the row of most code points stays, then of the smallest id (a null
id comes after every other); rows that tie on both are all returned, and one of
them, whichever, is kept; an empty table gives no rows. Very long texts are
hashed whole; a text is one row, so it must fit a task. Columns other than the
two named are not read, or carried along as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import joined_hot, packed, stored

PREFIX_CHARS = 64
KEYS = ["length", "prefix", "sha"]


def _text(text_col: str) -> Column:
    return F.coalesce(F.col(text_col), F.lit(""))


def _normal(text: Column) -> Column:
    return F.regexp_replace(text, "[\\x20\\x09-\\x0D]+", "")


def _prefix(norm: Column, chars: int) -> Column:
    return F.xxhash64(F.substring(norm, 1, chars))


def _sha(norm: Column) -> Column:
    return F.sha2(norm.cast("binary"), 256)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """One row per input row: doc_id, n_chars, keep_id, group_size, kept, text_sha256.

    The digest of every row is part of the result, so the scan computes it for
    all; the grouping by it sees only the rows that length and prefix leave.
    """
    profile = docs.select(F.col(id_col).alias("doc_id"), F.length(_text(text_col)).cast("long").alias("n_chars"), _normal(_text(text_col)).alias("norm"))
    profile = profile.select("doc_id", "n_chars", F.length("norm").alias("length"), _prefix(F.col("norm"), prefix_chars).alias("prefix"), _sha(F.col("norm")).alias("sha"))
    # the written table fixes the row numbers, which tell equal rows apart
    rows = stored(profile.withColumn("row", F.monotonically_increasing_id()), "exact-rows")
    alive = rows
    for step in (["length"], ["length", "prefix"]):
        # written between the steps: a join that feeds a write can be split at a hot key, one that feeds the next grouping can't
        alive = stored(joined_hot(alive, alive.groupBy(*step).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*step), step, "left_semi"), "exact-alive")
    # fewest = most code points; then a known id before a null one; then the smallest id
    best = F.min(F.struct((-F.col("n_chars")).alias("fewest"), F.col("doc_id").isNull().alias("unknown"), F.col("doc_id").alias("id"), "row")).alias("best")
    groups = alive.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("group_size"), best).where("group_size > 1").select(*KEYS, "group_size", "best")
    found = joined_hot(rows, groups, KEYS, "left")
    single = F.col("group_size").isNull()
    return found.select(
        "doc_id", "n_chars", F.when(single, F.col("doc_id")).otherwise(F.col("best.id")).alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (single | (F.col("row") == F.col("best.row"))).alias("kept"), F.col("sha").alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """The documents that stay, with all their columns.

    One scan finds lengths, then prefixes that several rows share; in the
    second, only rows with such a length and prefix are hashed whole and
    grouped, each task sending at most one row of a group.
    """
    narrow = docs.select(_normal(_text(text_col)).alias("norm")).select(F.length("norm").alias("length"), _prefix(F.col("norm"), prefix_chars).alias("prefix"))
    counted = stored(narrow.groupBy("length", "prefix").agg(F.count(F.lit(1)).alias("n")), "exact-prefixes")
    lengths = counted.groupBy("length").agg(F.sum("n").alias("rows")).where("rows > 1").select("length")
    shared = stored(joined_hot(counted, lengths, ["length"], "left_semi").where("n > 1").select(F.col("length").alias("l"), F.col("prefix").alias("p")), "exact-shared")
    norm = _normal(_text(text_col))
    keyed = packed(docs, id=F.col(id_col), chars=F.length(_text(text_col)).cast("long"), length=F.length(norm), prefix=_prefix(norm, prefix_chars), text=_text(text_col))
    same = (F.col("length") == F.col("l")) & (F.col("prefix") == F.col("p"))
    # the order of the contract; a row that ties on both goes by whichever comes first
    first = F.min_by("row", F.struct((-F.col("chars")).alias("fewest"), F.col("id").isNull().alias("unknown"), F.col("id").alias("id"))).alias("row")
    survivors = keyed.join(shared.hint("rebalance"), same, "left_semi").withColumn("sha", _sha(_normal(F.col("text"))))
    alone = keyed.join(shared.hint("rebalance"), same, "left_anti")
    return alone.select("row.*").unionByName(survivors.groupBy(*KEYS).agg(first).select("row.*"))
