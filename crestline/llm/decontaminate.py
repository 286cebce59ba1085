"""Benchmark decontamination by spaced-seed hashing, DataFrame functions only.

Words are runs of letters, marks and digits, lower-cased. A fixed mask picks
five of the next few words and ignores the rest; its hash joins benchmark items
and documents. Around each hit, item and document are laid side by side at the
hit's offset and compared word by word; an overlap is confirmed where some
window of ``window`` words (the whole item if it is shorter) agrees in at least
``percent`` of its places, so substituted words do not hide a leak.

The two default masks find every window of 12 words or more that qualifies:
among 16 words with at most three substitutions two neighbouring runs have
seven or more matching words together, and these hold either five in a row or
three, a gap and two (the tests try all patterns). A shorter item that
tolerates s substitutions is cut into s + 1 runs, one of which is whole in any
overlap, and each run is a seed at its place; items of three and four words must
match whole. Items of fewer than ``least_words`` words are too common to tell a leak.

The benchmark is small next to the corpus, so its seeds and texts are broadcast when
their measured bytes are below ``broadcast_bytes``; beyond it the same joins
shuffle. Of a document, the words beside an item go into the comparison, not the
whole text.

Defined results: null and empty texts have no words and match nothing, as do
items of fewer than ``least_words`` words; rows that repeat an id are judged one
by one by their texts and reported once for each id, text and item (their best
overlap; of equally good ones the one with most equal words, then the first in
the text); null ids are kept as an id of their own; very long texts are searched
whole; other columns are not read; an empty table or benchmark gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import packed, stored

MASKS = ("11111", "111011")
WINDOW = 16
PERCENT = 80
LEAST_WORDS = 3
#: Items from this length on are found by the masks.
MASKED_WORDS = 12
BROADCAST_BYTES = 8 << 20


def words(text: Column) -> Column:
    """Lower-cased words of letters, marks and digits; an empty array for null."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{M}\\p{N}]+")
    return F.filter(parts, lambda w: w != "")


def runs(n_words: int, percent: int = PERCENT) -> list[tuple[int, int]]:
    """(place, length) of the runs of a short item, one of which every tolerated overlap leaves whole."""
    parts = n_words - -(-n_words * percent // 100) + 1
    ends = [n_words * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(ends, ends[1:], strict=False)]


def _seed(hashes: Column, mask: str, at: Column) -> Column:
    return F.xxhash64(F.lit(mask), *[F.get(hashes, at + i) for i, c in enumerate(mask) if c == "1"])


def seeds(hashes: Column, masks: tuple[str, ...] = MASKS) -> Column:
    """Array of (at, hash) of all masked places; ``hashes`` is an array of word hashes."""

    def one(mask: str) -> Column:
        last = F.size(hashes) - len(mask)
        places = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda p: F.struct(p.alias("at"), _seed(hashes, mask, p).alias("hash")))

    return F.concat(*[one(m) for m in masks])


def item_seeds_of(hashes: Column, masks: tuple[str, ...], percent: int, least_words: int) -> Column:
    """The seeds of an item, by its length."""
    found = F.when(F.size(hashes) >= MASKED_WORDS, seeds(hashes, masks))
    for n in range(least_words, MASKED_WORDS):
        short = [F.struct(F.lit(at).alias("at"), _seed(hashes, "1" * length, F.lit(at)).alias("hash")) for at, length in runs(n, percent)]
        found = found.when(F.size(hashes) == n, F.array(*short))
    return found


def _hashed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))


def _bytes(rows: DataFrame) -> int:
    """Measured size of a written table: its numbers, strings and arrays."""
    size = F.lit(16)
    for f in rows.schema:
        kind = f.dataType.typeName()
        size = size + (F.coalesce(F.octet_length(f.name), F.lit(0)) if kind in ("string", "binary") else F.coalesce(8 * F.size(f.name), F.lit(0)) if kind == "array" else F.lit(8))
    return rows.agg(F.coalesce(F.sum(size.cast("long")), F.lit(0))).first()[0]


def _small(rows: DataFrame, most: int) -> DataFrame:
    """``rows`` (a written table) marked for broadcast if its measured size is below ``most``; else dealt anew for a shuffle join."""
    return F.broadcast(rows) if _bytes(rows) <= most else rows.hint("rebalance")


def leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", *,
    masks: tuple[str, ...] = MASKS, window: int = WINDOW, percent: int = PERCENT, least_words: int = LEAST_WORDS, broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Confirmed overlaps, one row for each document and item (its best).

    doc_id, text_hash (of the document's text), item_id, doc_word (the word of
    the document beside the item's first word, may be negative), item_words,
    matched (equal places over the whole item), best (equal places in the best
    window), needed.
    """
    words_of = benchmark.select(F.col(item_col).alias("item_id"), words(F.col(item_text_col)).alias("words")).where(F.size("words") >= least_words)
    items = stored(_hashed(words_of).select(F.monotonically_increasing_id().alias("item_key"), "item_id", F.col("hashes").alias("item_hashes"), F.size("hashes").alias("item_words")), "leak-items")
    item_seeds = stored(items.select("item_key", "item_words", F.explode(item_seeds_of(F.col("item_hashes"), masks, percent, least_words)).alias("s")).select("item_key", "item_words", F.col("s.at").alias("item_at"), F.col("s.hash").alias("hash")), "leak-seeds")
    lengths = {r[0] for r in items.select(F.least("item_words", F.lit(MASKED_WORDS))).distinct().collect()}
    # the masks that some item's seeds have
    asked = (*(masks if MASKED_WORDS in lengths else ()), *sorted({"1" * length for n in lengths if n < MASKED_WORDS for _, length in runs(n, percent)}))

    named = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash"), F.col(text_col).alias("text"))
    hits = stored(
        _hashed(named.withColumn("words", words(F.col("text")))).select("doc_id", "text_hash", F.explode(seeds(F.col("hashes"), asked or masks)).alias("s"))
        .select("doc_id", "text_hash", F.col("s.at").alias("doc_at"), F.col("s.hash").alias("hash"))
        .join(_small(item_seeds, broadcast_bytes), "hash", "inner")
        .select("doc_id", "text_hash", "item_key", "item_words", (F.col("doc_at") - F.col("item_at")).alias("doc_word"))
        .distinct(),
        "leak-hits",
    )
    # the words of a document are looked at again only if it was hit
    hit_docs = stored(hits.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct(), "leak-docs")
    hit_rows = named.join(_small(hit_docs, broadcast_bytes), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "inner").dropDuplicates(["_id", "_hash"])
    found = _hashed(hit_rows.withColumn("words", words(F.col("text")))).select("_id", "_hash", "hashes")
    # of the document only the words beside the item go on
    first = F.greatest(F.col("doc_word"), F.lit(0))
    beside = F.slice("hashes", first + 1, F.greatest(F.lit(0), F.col("item_words") + F.least(F.col("doc_word"), F.lit(0))))
    windows = hits.join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "inner").select("doc_id", "text_hash", "item_key", "doc_word", beside.alias("beside"))
    laid = windows.join(_small(items, broadcast_bytes), "item_key", "inner")

    each = F.sequence(F.lit(0), F.size("item_hashes") - 1)
    ahead = F.greatest(-F.col("doc_word"), F.lit(0))
    equal = F.transform(each, lambda i: F.coalesce((F.get("beside", i - ahead) == F.get("item_hashes", i)).cast("int"), F.lit(0)))
    width = F.least(F.lit(window), F.size("item_hashes"))

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0), lambda a, x: a + x)

    judged = (
        laid.select("doc_id", "text_hash", "item_id", "doc_word", F.size("item_hashes").alias("item_words"), width.alias("width"), equal.alias("equal"))
        .withColumn("matched", total(F.col("equal")))
        .withColumn("needed", F.ceil(F.col("width") * percent / 100).cast("int"))
        .where("matched >= needed")
        .withColumn("best", F.array_max(F.transform(F.sequence(F.lit(1), F.col("item_words") - F.col("width") + 1), lambda a: total(F.slice("equal", a, F.col("width"))))))
        .where("best >= needed")
    )
    best = F.max(F.struct("best", "matched", (-F.col("doc_word")).alias("early"), "item_words", "needed")).alias("m")
    return judged.groupBy("doc_id", "text_hash", "item_id").agg(best).select("doc_id", "text_hash", "item_id", (-F.col("m.early")).alias("doc_word"), "m.item_words", "m.matched", "m.best", "m.needed")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without a confirmed overlap, with all their columns."""
    found = stored(leaks(docs, benchmark, **options).select("doc_id", "text_hash").distinct(), "leak-found")
    keyed = packed(docs, id=F.col(options.get("id_col", "doc_id")), hash=F.xxhash64(F.coalesce(F.col(options.get("text_col", "text")), F.lit(""))))
    small = _small(found, options.get("broadcast_bytes", BROADCAST_BYTES))
    return keyed.join(small, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("text_hash")), "left_anti").select("row.*")
