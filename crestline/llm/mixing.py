"""Mixing sources to target weights by Sainte-Lague apportionment.

Target words of a source: its weight's part of ``share`` times all words, no
more than ``most_passes`` times its own words, the excess dealt again by weight
(water filling, solved in one ordered pass over the sources). Targets are
bought in blocks of equal size: the blocks go to sources by the highest
quotients target/1, target/3, target/5, ..., each source's blocks to groups of
its shards and each group's to its shards by the same rule, so every shard has
an integer quota. A shard is a seeded hash class of a source's documents of
about ``shard_words`` words or ``shard_rows`` rows, and a source of n shards has
about the square root of n groups, so no ordered pass sees more than that; a shard's
documents lie in seeded order, cut into blocks, and the quota takes whole
passes over the shard and then a run of blocks that starts at a seeded block
and wraps around. What a document gives follows from its place by arithmetic;
no block is ever a row, and no task sees more than a shard.

Quotients are compared only around the rounded share of each source or shard:
rounding by a common divisor is off by at most half a seat for each claimant,
so the seats that can change hands are at most ``2 * claimants * share + 2``
from there. What is below is granted unseen.

Defined results: a null or empty text has size 0, gives nothing and takes no
place in a shard; a null source is a source of its own, after all others; rows
that repeat an id are each a document, placed by id and text; rows equal in both
lie side by side in one shard, where it is of no account which one gives what; a text
longer than a shard makes a longer shard; an empty table gives no rows; only
the three named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import packed, stored, word_count

WEIGHTS = (3, 1, 2)
SHARE_PERCENT = 150
MOST_PASSES = 2
SHARD_WORDS = 1 << 18
SHARD_ROWS = 1 << 16
MOST_BLOCK = 4096
SEED = "mix-1"


def _hash(*parts: Column | str) -> Column:
    return F.md5(F.concat_ws(":", *[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("null")) for p in parts]).cast("binary"))


def _number(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 7), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share_percent: int, most_passes: int) -> DataFrame:
    """source, source_size, source_rows, target, block, blocks: one row per source, water-filled."""
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy(F.lit(1))
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    listed = (
        sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum((F.col("size") > 0).cast("long")).alias("source_rows"))
        .withColumn("place", (F.row_number().over(ordered) - 1) % len(weights))
        .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") + 1).cast("int")))
        .withColumn("cap", F.col("source_size") * most_passes)
        .withColumn("ratio", F.col("cap").cast("double") / F.col("weight"))
        .withColumn("pool", F.sum("source_size").over(everything) * share_percent / 100.0)
        .withColumn("smallest", F.min(F.when(F.col("source_size") > 0, F.col("source_size"))).over(everything))
        .withColumn("caps_before", F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, 0)) - F.col("cap"))
        .withColumn("weight_left", F.sum("weight").over(everything) - F.sum("weight").over(by_ratio.rowsBetween(Window.unboundedPreceding, 0)) + F.col("weight"))
        .withColumn("level", (F.col("pool") - F.col("caps_before")) / F.col("weight_left"))
        .withColumn("open", F.col("ratio") > F.col("level"))
        # once a source stays below its cap, all later ones do, at the first one's level
        .withColumn("level", F.min(F.when(F.col("open"), F.struct("ratio", "source", "level"))).over(everything)["level"])
        .withColumn("target", F.when(F.col("open"), F.col("weight") * F.col("level")).otherwise(F.col("cap").cast("double")))
        .withColumn("block", F.greatest(F.lit(1), F.least(F.lit(MOST_BLOCK), F.floor(F.col("smallest") / 1024))).cast("long"))
        .withColumn("blocks", F.round(F.sum("target").over(everything) / F.col("block")).cast("long"))
    )
    return listed.select("source", "source_size", "source_rows", "target", F.coalesce("block", F.lit(1)).alias("block"), F.coalesce("blocks", F.lit(0)).alias("blocks"))


def sainte_lague(claims: DataFrame, within: list[str], name: str, claim: str, seats: str) -> DataFrame:
    """``claims`` with its seats in the column ``quota``; ``seats`` (a column) are dealt among the rows that agree on ``within``."""
    party = Window.partitionBy(*within) if within else Window.partitionBy(F.lit(1))
    ranked = (Window.partitionBy(*within) if within else Window.partitionBy(F.lit(1))).orderBy(F.desc("quotient"), F.col(name).asc_nulls_last())
    share = F.when(F.col("all_claims") > 0, F.col(claim) / F.col("all_claims")).otherwise(0.0)
    around = (
        claims.withColumn("all_claims", F.sum(claim).over(party).cast("double"))
        .withColumn("claimants", F.count(F.lit(1)).over(party))
        .withColumn("ideal", F.floor(F.col(seats) * share).cast("long"))
        .withColumn("reach", F.ceil(2 * F.col("claimants") * share).cast("long") + 2)
        .withColumn("granted", F.greatest(F.lit(0).cast("long"), F.col("ideal") - F.col("reach")))
        .withColumn("open_seats", F.col(seats) - F.sum("granted").over(party))
    )
    keys = [*within, name]
    won = (
        around.where(F.col(claim) > 0)
        .select(*keys, "open_seats", F.col(claim).alias("claim"), F.explode(F.sequence(F.col("granted") + 1, F.col("ideal") + F.col("reach"))).alias("seat"))
        .withColumn("quotient", F.col("claim") / (2 * F.col("seat") - 1))
        .withColumn("rank", F.row_number().over(ranked))
        .where(F.col("rank") <= F.col("open_seats"))
        .groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.count(F.lit(1)).alias("won"))
    )
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return around.join(won, same, "left").select(*claims.columns, (F.col("granted") + F.coalesce("won", F.lit(0))).alias("quota"))


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, weights: tuple[int, ...] = WEIGHTS, share_percent: int = SHARE_PERCENT,
    most_passes: int = MOST_PASSES, shard_words: int = SHARD_WORDS, shard_rows: int = SHARD_ROWS, seed: str = SEED, extra: dict[str, Column] | None = None,
) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (and ``extra`` columns, carried along)."""
    extra = extra or {}
    place = _hash(seed, F.col(id_col), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))
    sizes = stored(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), place.alias("place"), *[c.alias(k) for k, c in extra.items()]), "mix-sizes")
    sources = stored(sainte_lague(source_targets(sizes, weights, share_percent, most_passes), [], "source", "target", "blocks"), "mix-sources")
    n_shards = F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words), F.ceil(F.col("source_rows") / shard_rows)).cast("long")
    info = sources.select(F.col("source").alias("src"), "source_size", "target", "block", "quota", n_shards.alias("n_shards")).withColumn("n_groups", F.ceil(F.sqrt("n_shards")).cast("long")).hint("rebalance")
    every = sizes.join(info, F.col("source").eqNullSafe(F.col("src")), "inner").drop("src")
    rows = every.where("size > 0").withColumn("shard", _number(F.col("place")) % F.col("n_shards")).withColumn("part", F.col("shard") % F.col("n_groups"))
    totals = stored(rows.groupBy("source", "part", "shard", "block", F.col("quota").alias("source_quota")).agg(F.sum("size").alias("shard_size")), "mix-shards")
    parts = totals.groupBy("source", "part", "source_quota").agg(F.sum("shard_size").alias("part_size"))
    dealt = sainte_lague(parts, ["source"], "part", "part_size", "source_quota").select(F.col("source").alias("s"), F.col("part").alias("g"), F.col("quota").alias("part_quota"))
    claims = totals.join(dealt, F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("g")), "inner").drop("s", "g")
    shards = sainte_lague(claims, ["source", "part"], "shard", "shard_size", "part_quota").select(
        F.col("source").alias("s"), F.col("shard").alias("j"), "shard_size",
        F.least(F.col("quota") * F.col("block"), F.col("shard_size") * most_passes).alias("words"),
        (F.col("block") * (_number(_hash(seed, "start", F.col("source"), F.col("shard"))) % F.greatest(F.lit(1).cast("long"), F.ceil(F.col("shard_size") / F.col("block"))))).alias("start"),
    )
    in_order = Window.partitionBy("source", "shard").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("high", F.sum("size").over(in_order)).withColumn("low", F.col("high") - F.col("size"))
    full = placed.join(shards, F.col("source").eqNullSafe(F.col("s")) & (F.col("shard") == F.col("j")), "inner")
    rest = F.when(F.col("shard_size") > 0, F.col("words") % F.col("shard_size")).otherwise(0)
    end = F.col("start") + rest

    def overlap(a: Column, b: Column) -> Column:
        return F.greatest(F.lit(0).cast("long"), F.least(F.col("high"), b) - F.greatest(F.col("low"), a))

    passes = F.when(F.col("shard_size") > 0, F.floor(F.col("words") / F.col("shard_size"))).otherwise(0)
    taken = passes * F.col("size") + overlap(F.col("start"), F.least(end, F.col("shard_size"))) + overlap(F.lit(0).cast("long"), end - F.col("shard_size"))
    nothing = every.where("size = 0").withColumn("taken", F.lit(0).cast("long"))
    columns = ["doc_id", "size", "source_size", "target", "taken", *extra]
    return full.withColumn("taken", taken.cast("long")).select(*columns).unionByName(nothing.select(*columns))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of which the mix takes words, with all their columns and beside them ``size``, ``source_size``, ``target`` and ``taken`` (``mix_size`` and so on where a document's column has the name).

    Rows that repeat an id and a text share what they give evenly.
    """
    text = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    names = ["size", "source_size", "target", "taken"]
    dealt = mix(docs, extra={"text_hash": text}, **options).where("size > 0").groupBy("doc_id", "text_hash").agg(*[F.first(n).alias(n) for n in names[:3]], F.floor(F.avg("taken")).alias("taken")).where("taken > 0")
    keyed = packed(docs, id=F.col("doc_id"), hash=text)
    there = {c.lower() for c in docs.columns}
    added = []
    for n in names:
        new = n
        while new.lower() in there:
            new = f"mix_{new}"
        added.append(F.col(n).alias(new))
    return keyed.join(dealt, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("text_hash"))).select("row.*", *added)
