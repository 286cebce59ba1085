"""Token counts of documents and of their edited versions (see token_tree).

``build`` keeps each document's leaves, known by its id and a hash of its text.
``apply_edits`` joins documents, kept leaves and edits, and re-encodes only what
the edits touch; ``edit_kept`` does so without a shuffle where leaves and text
were kept side by side; ``count_edited`` builds and edits in one pass.

Defined results: null and empty texts have no leaves and no tokens; edits are
applied in their order, places count code points of the text as it then is and
are clipped to it, null replacements count as empty and edits with a null place
are skipped; leaves that were kept for another text, even of the same length and id, are not
used, and leaves are built anew; rows that repeat an id are documents of their
own, counted one by one, and edits of an id apply to each row of that id; a document
without edits keeps its count; very long texts are encoded leaf by leaf; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import joined_hot, small_batches
from .token_tree import TokenTree, counter

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
_EDITS = "array<struct<start:bigint,length:bigint,inserted:string>>"


def read_ranks(path: str = RANKS) -> bytes:
    """A public vocabulary's rank file, read where the driver runs and sent to the tasks (under 2 MB)."""
    with open(path, "rb") as f:
        return f.read()


def _edited(ranks, with_leaves: bool, keep_text: bool = False):
    """(id, text, edits[, leaf chars, leaf tokens]) to counts and leaves, before and after."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(ranks.value)
        for whole in batches:
            for at in range(0, len(whole), 256):
                batch = whole.slice(at, 256)
                out: dict[str, list] = {k: [] for k in ("n_tokens", "n_leaves", "edited_tokens", "reencoded_chars", "edited_chars", "leaf_chars", "leaf_tokens")}
                for i in range(len(batch)):
                    text, edits = batch.column(1)[i].as_py() or "", batch.column(2)[i].as_py() or []
                    kept = None
                    if with_leaves:
                        chars, counts = batch.column(3)[i].as_py(), batch.column(4)[i].as_py()
                        kept = None if chars is None or counts is None else list(zip(chars, counts, strict=True))
                    tree = TokenTree(text, count, kept)
                    out["n_tokens"].append(tree.tokens)
                    out["n_leaves"].append(tree.root.leaves if tree.root else 0)
                    tree.encoded = 0
                    for e in edits:
                        if e["start"] is not None:
                            tree.edit(e["start"], e["start"] + (e["length"] or 0), e["inserted"] or "")
                    out["edited_tokens"].append(tree.tokens)
                    out["reencoded_chars"].append(tree.encoded)
                    out["edited_chars"].append(len(tree.text))
                    leaves = tree.leaves()
                    out["leaf_chars"].append([c for c, _ in leaves])
                    out["leaf_tokens"].append([t for _, t in leaves])
                kinds = {"leaf_chars": pa.list_(pa.int32()), "leaf_tokens": pa.list_(pa.int32())}
                beside = [batch.column(1)] if keep_text else []
                yield pa.RecordBatch.from_arrays([batch.column(0), *beside, *[pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items()]], names=["doc_id", *(["text"] if keep_text else []), *out])

    return run


def _counted(rows: DataFrame, ranks: bytes, with_leaves: bool, keep_text: bool = False) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast(ranks)
    text = ", text string" if keep_text else ""
    return small_batches(rows).mapInArrow(
        _edited(sent, with_leaves, keep_text),
        f"doc_id {dict(rows.dtypes)['doc_id']}{text}, n_tokens long, n_leaves long, edited_tokens long, reencoded_chars long, edited_chars long, leaf_chars array<int>, leaf_tokens array<int>",
    )


def _text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def count_edited(docs: DataFrame, edits: Column, ranks: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts before and after ``edits`` (an array column of start, length, inserted), in one pass."""
    return _counted(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), edits.cast(_EDITS).alias("edits")), ranks, False)


def build(docs: DataFrame, ranks: bytes, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """doc_id, text_hash, n_tokens, leaf_chars, leaf_tokens of every document, to be kept beside it (with ``keep_text``, its text as well)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.array().cast(_EDITS).alias("edits"))
    built = _counted(rows, ranks, False, keep_text=True).withColumn("text_hash", _text_hash(F.col("text")))
    return built.select("doc_id", *(["text"] if keep_text else []), "text_hash", "n_tokens", "leaf_chars", "leaf_tokens")


def edit_kept(kept: DataFrame, edits: Column, ranks: bytes) -> DataFrame:
    """Counts and leaves after ``edits`` (an array column) of a table of ``build`` with its texts; nothing is shuffled."""
    fits = F.col("text_hash") == _text_hash(F.col("text"))
    rows = kept.select("doc_id", "text", edits.cast(_EDITS).alias("edits"), F.when(fits, F.col("leaf_chars")).alias("leaf_chars"), F.when(fits, F.col("leaf_tokens")).alias("leaf_tokens"))
    return _counted(rows, ranks, True)


def apply_edits(docs: DataFrame, trees: DataFrame, edits: DataFrame, ranks: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and leaves after ``edits`` (doc_id, seq, start, length, inserted), from kept ``trees``; documents without edits aren't touched.

    Returns doc_id, n_tokens (before), edited_tokens, reencoded_chars, edited_chars, leaf_chars, leaf_tokens for edited documents.
    """
    listed = edits.where("doc_id is not null").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "start", "length", "inserted"))).alias("e"))
    listed = listed.select("doc_id", F.transform("e", lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length"), x["inserted"].alias("inserted"))).cast(_EDITS).alias("edits"))
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), _text_hash(F.col(text_col)).alias("text_hash"))
    touched = joined_hot(named, listed, ["doc_id"], "inner")
    # rows of one id and text have the same leaves, so any one will do
    one = trees.groupBy("doc_id", "text_hash").agg(F.first(F.struct("leaf_chars", "leaf_tokens")).alias("leaves"))
    rows = joined_hot(touched, one, ["doc_id", "text_hash"], "left").select("doc_id", "text", "edits", "leaves.leaf_chars", "leaves.leaf_tokens")
    return _counted(rows, ranks, True).drop("n_leaves")
