"""Near-duplicate groups by an inverted join over MinHash signature coordinates.

Every document is its set of word shingles. Equal sets are one class from the
start, found by aggregation. Each class has a signature of ``coordinates``
minima and is posted under each (coordinate, value). A pair is a candidate when
it collides in at least ``least_matches`` postings; as in other count-threshold
joins, lists are skipped and prefixes merged: a class with fewer shared
postings than that is dropped, and of the others only the
``coordinates - least_matches + 1`` rarest postings are merged, since a pair
with enough collisions has one of them in common.

Groups are never expanded into all pairs. In each posting list the members are
held against one pivot. Links are confirmed on the full sets, and the
symmetric difference of member and pivot is kept. After the links' components
are known, only pivots whose members lie in several components go on: there,
members outside of the largest component are compared with all others through
an inverted index over those differences (sets x and y differ in
|Ex| + |Ey| - 2 |Ex & Ey| elements, which is exact), in blocks, and at most one
link for each member and component comes out. A block is bounded; the number
of blocks grows with the square of a pivot's unlinked members over ``block``
squared, which is what deciding each such pair exactly takes here. So all candidate pairs are
decided, and the components are those of the full link graph.

What can be lost is a link whose signatures collide in too few coordinates; at
the threshold itself the defaults lose one pair in three million, and only
if no other path joins the two documents. Shingles are known by 64-bit hashes.

Defined results: null, empty and blank texts have no shingles and link with
nothing (component: their own id); a text of fewer words than a shingle is one
shingle; rows that repeat an id are separate documents; a null id never names
a component unless no member has an id; very long texts are taken whole, in
slices; of kept rows of one group the one of the least text hash stays; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import joined_hot, packed, small_batches, stored
from .components import components
from .textvec import distinct, keyed, mix, row_reduce, shingles, slices, word_hashes

COORDINATES = 64
LEAST_MATCHES = 34
WIDTH = 5
PERCENT = 80
BLOCK = 2048
BLOCK_BYTES = 8 << 20


def _sets(column: pa.Array, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for first, end, data, offsets in slices(column):
        hashes, rows = word_hashes(data, offsets)
        yield first, end, *distinct(*shingles(hashes, rows, width))


def _binary(rows: np.ndarray) -> pa.Array:
    """Rows of a matrix as binary values."""
    rows = np.ascontiguousarray(rows)
    step = rows.shape[1] * rows.itemsize
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.arange(0, step * len(rows) + 1, step, dtype=np.int32).tobytes()), pa.py_buffer(rows.tobytes())])


def _signer(width: int, coordinates: int):
    """(id, text, text hash) to (id, text hash, n, a, b, signature): set size, two set hashes, minima as 32-bit numbers."""
    salts, factors = keyed(coordinates, 5), keyed(coordinates, 17)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, values, bounds in _sets(batch.column(1), width):
                found = np.zeros((end - first, coordinates), dtype=np.uint32)
                with np.errstate(over="ignore"):
                    for k in range(coordinates):
                        x = (values ^ salts[k]) * factors[k]
                        x ^= x >> np.uint64(32)
                        x *= np.uint64(0x81DADEF4BC2DD44D)
                        found[:, k] = row_reduce(np.minimum, x, bounds, 0) >> np.uint64(32)
                a = row_reduce(np.add, mix(values), bounds, 0).view(np.int64)
                b = row_reduce(np.bitwise_xor, mix(values ^ salts[0]), bounds, 0).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), batch.column(2).slice(first, end - first), pa.array(np.diff(bounds)), pa.array(a), pa.array(b), _binary(found)], names=["doc_id", "text_hash", "n", "a", "b", "signature"])

    return run


def _poster(coordinates: int):
    """(node, signature) to one row for each coordinate: (node, posting), the coordinate in the upper half."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        upper = np.arange(coordinates, dtype=np.int64) << 32
        for batch in batches:
            rows = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint32).reshape(len(batch), coordinates)
            nodes = batch.column(0).to_numpy()
            for at in range(0, len(batch), 4096):
                part = rows[at : at + 4096]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(nodes[at : at + 4096], coordinates)), pa.array((part.astype(np.int64) + upper).ravel())], names=["node", "posting"])

    return run


def _prober(width: int):
    """(pivot, node, pivot text, text) to (pivot, node, shared, total, difference): exact, on full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 64):
                batch = whole.slice(at, 64)
                names = pa.compute.dictionary_encode(batch.column(2).fill_null(""))
                pivots = [values[bounds[i] : bounds[i + 1]] for _, _, values, bounds in _sets(names.dictionary, width) for i in range(len(bounds) - 1)]
                which = names.indices.to_numpy()
                shared, total, differ = [], [], []
                row = 0
                for _, _, values, bounds in _sets(batch.column(3), width):
                    for i in range(len(bounds) - 1):
                        own, other = values[bounds[i] : bounds[i + 1]], pivots[which[row]]
                        d = np.setxor1d(own, other, assume_unique=True)
                        total.append((len(own) + len(other) + len(d)) // 2)
                        shared.append((len(own) + len(other) - len(d)) // 2)
                        differ.append(d.tobytes())
                        row += 1
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shared, pa.int64()), pa.array(total, pa.int64()), pa.array(differ, pa.binary())], names=["pivot", "node", "shared", "total", "difference"])

    return run


def _crosser(percent: int):
    """The links between the minor members of one block and all members of another, about one pivot."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        minor = rows["minor"].to_numpy()
        base, probe = rows.filter(pa.array(~minor)).combine_chunks(), rows.filter(pa.array(minor)).combine_chunks()
        hi, lo = [], []
        if len(probe) and len(base):
            parts = base["difference"].to_pylist()
            lengths = np.array([len(d) // 8 for d in parts])
            values = np.frombuffer(b"".join(parts), dtype=np.uint64)
            order = np.argsort(values, kind="stable")
            owner = np.repeat(np.arange(len(base), dtype=np.int32), lengths)[order]
            values = values[order]
            sizes, roots, nodes = (base[c].to_numpy() for c in ("n", "root", "node"))
            for node, n, root, difference in zip(*(probe[c].to_pylist() for c in ("node", "n", "root", "difference")), strict=True):
                own = np.frombuffer(difference, dtype=np.uint64)
                left, right = np.searchsorted(values, own, "left"), np.searchsorted(values, own, "right")
                lists = [owner[a:b] for a, b in zip(left, right, strict=True) if b > a]
                common = np.bincount(np.concatenate(lists), minlength=len(base)) if lists else np.zeros(len(base), np.int64)
                differ = len(own) + lengths - 2 * common
                both = n + sizes
                # shared / total >= percent / 100 with shared = (both - differ) / 2, total = (both + differ) / 2
                linked = np.flatnonzero((100 * (both - differ) >= percent * (both + differ)) & (roots != root))
                if len(linked):
                    _, one = np.unique(roots[linked], return_index=True)
                    for other in nodes[linked[one]].tolist():
                        hi.append(max(node, other))
                        lo.append(min(node, other))
        return pa.table({"hi": pa.array(hi, pa.int64()), "lo": pa.array(lo, pa.int64())})

    return run


def _with_roots(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    return joined_hot(nodes, roots, ["node"], "left").withColumn("root", F.coalesce("root", "node"))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, width: int = WIDTH, percent: int = PERCENT, coordinates: int = COORDINATES, least_matches: int = LEAST_MATCHES, block: int = BLOCK
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept, text_hash (of the text), and root (one number for each group; null without shingles)."""
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash"))
    signed = stored(small_batches(named).mapInArrow(_signer(width, coordinates), f"doc_id {docs.schema[id_col].dataType.simpleString()}, text_hash long, n long, a long, b long, signature binary"), "near-rows")
    key = ["n", "a", "b"]
    # one node for each distinct set; the written table fixes its number
    classes = stored(signed.where("n > 0").groupBy(*key).agg(F.min("doc_id").alias("first"), F.min("signature").alias("signature")).withColumn("node", F.monotonically_increasing_id()), "near-classes")

    postings = classes.select("node", "signature").mapInArrow(_poster(coordinates), "node long, posting long")
    shared = postings.groupBy("posting").agg(F.count(F.lit(1)).alias("listed")).where("listed > 1")
    hits = joined_hot(postings, shared, ["posting"], "inner")
    prefix = coordinates - least_matches + 1
    # of a class's shared postings (at most one for each coordinate): those among its `prefix` rarest, unshared ones first
    merged = stored(
        hits.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("listed", "posting"))).alias("p"))
        .where(F.size("p") >= least_matches)
        .select("node", F.explode(F.expr(f"slice(p, 1, greatest(0, {prefix} - ({coordinates} - size(p))))")).alias("q"))
        .select("node", F.col("q.posting").alias("posting")),
        "near-postings",
    )
    pivots = merged.groupBy("posting").agg(F.min("node").alias("pivot"), F.max("node").alias("last")).where("pivot < last").select("posting", "pivot")
    pairs = stored(joined_hot(merged, pivots, ["posting"], "inner").where("node > pivot").select("pivot", "node").distinct(), "near-pairs")

    wanted = pairs.select("node").unionByName(pairs.select(F.col("pivot").alias("node"))).distinct()
    known = joined_hot(classes.select("node", *key), wanted, ["node"], "left_semi")
    # the text of one document for each class that is part of a pair
    sources = joined_hot(signed.select("doc_id", "text_hash", *key), known, key, "inner")
    picked = sources.groupBy("node").agg(F.min(F.struct("doc_id", "text_hash")).alias("p")).select("node", F.col("p.doc_id").alias("_id"), F.col("p.text_hash").alias("_hash"))
    carried = named.join(picked.hint("rebalance"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "inner")
    texts = stored(carried.groupBy("node").agg(F.first("text").alias("text")), "near-texts")
    probes = joined_hot(joined_hot(pairs, texts.select(F.col("node").alias("pivot"), F.col("text").alias("pivot_text")), ["pivot"], "inner"), texts, ["node"], "inner")
    probed = stored(small_batches(probes.select("pivot", "node", "pivot_text", "text")).mapInArrow(_prober(width), "pivot long, node long, shared long, total long, difference binary"), "near-probed")
    links = probed.where(F.col("shared") * 100 >= F.col("total") * percent).select(F.col("node").alias("hi"), F.col("pivot").alias("lo"))
    roots = components(links)

    # pivots whose members lie in several components
    members = probed.select("pivot", "node", "difference").unionByName(pairs.select("pivot", F.col("pivot").alias("node"), F.lit(b"").alias("difference")).distinct())
    placed = _with_roots(joined_hot(members, classes.select("node", "n"), ["node"], "inner"), roots)
    placed = stored(placed, "near-placed")
    by_root = placed.groupBy("pivot", "root").agg(F.count(F.lit(1)).alias("c"), F.sum(F.octet_length("difference")).alias("bytes"))
    open_pivots = by_root.groupBy("pivot").agg(F.count(F.lit(1)).alias("roots"), F.sum("c").alias("members"), F.sum("bytes").alias("bytes"), F.max_by("root", F.struct("c", "root")).alias("major")).where("roots > 1").select("pivot", "members", "bytes", "major")
    blocks = F.ceil(F.greatest(F.col("members") / block, F.col("bytes") / BLOCK_BYTES)).cast("int")
    opened = joined_hot(placed, open_pivots, ["pivot"], "inner").withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    each = F.sequence(F.lit(0), F.col("blocks") - 1)
    base = opened.select("pivot", F.explode(each).alias("i"), F.col("own").alias("j"), "node", "n", "root", "difference", F.lit(False).alias("minor"))
    probe = opened.where("root != major").select("pivot", F.col("own").alias("i"), F.explode(each).alias("j"), "node", "n", "root", "difference", F.lit(True).alias("minor"))
    # dealt by block, not by pivot: a pivot's blocks are many tasks
    more = base.unionByName(probe).repartition("pivot", "i", "j").groupBy("pivot", "i", "j").applyInArrow(_crosser(percent), "hi long, lo long")
    # links found late join whole components: the edge between two roots says it all
    late = stored(more.distinct(), "near-late")
    every = links.unionByName(late)
    roots = components(every) if late.take(1) else roots

    placed_classes = _with_roots(classes.select(*key, "node", "first"), roots)
    smallest = placed_classes.groupBy("root").agg(F.min("first").alias("component_id"))
    answers = joined_hot(placed_classes.select(*key, "root"), smallest, ["root"], "inner").select(*key, "root", "component_id")
    found = joined_hot(signed.select("doc_id", "text_hash", *key), answers, key, "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "text_hash", "root")


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The documents that stay, one of each group, with all their columns."""
    found = near_duplicates(docs, **options)
    text_col, id_col = options.get("text_col", "text"), options.get("id_col", "doc_id")
    # ids can repeat or be null, so a group is known by its root; its kept rows share one id
    of_groups = found.where("kept and n_shingles > 0").groupBy("root").agg(F.min("doc_id").alias("doc_id"), F.min("text_hash").alias("text_hash"), F.count(F.lit(1)).alias("rows")).drop("root")
    # rows without shingles are groups of their own, and all stay
    alone = found.where("n_shingles = 0").select("doc_id", "text_hash", F.lit(1).cast("long").alias("rows")).distinct()
    stay = stored(of_groups.unionByName(alone), "near-kept")
    keyed = packed(docs, id=F.col(id_col), hash=F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    hit = keyed.join(stay, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("text_hash")))
    # kept rows of one group: the one with the least text hash stays, once
    many = hit.where("rows > 1").dropDuplicates(["id", "hash"])
    return hit.where("rows = 1").select("row.*").unionByName(many.select("row.*"))
