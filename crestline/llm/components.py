"""Connected components over an edge table, without collecting anything.

Each task first contracts its own edges to stars by union-find; the stars of
all tasks are then merged by alternating large-star and small-star steps
(minimum per vertex by aggregation, never a list of neighbours). Every round
is written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import joined_hot, stored

#: Edges that a task holds before it hands on their stars.
HELD = 1 << 20


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    root: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while (up := root.get(top, top)) != top:
            top = up
        while (up := root.get(x, x)) != top:
            root[x], x = top, up
        return top

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = find(x), find(y)
        if p != q:
            root[max(p, q)] = min(p, q)
    hi = np.fromiter(root, np.int64, len(root))
    return hi, np.fromiter((find(x) for x in root), np.int64, len(root))


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    n = 0

    def out() -> pa.RecordBatch:
        hi, lo = _stars(*(np.concatenate([x.column(i).to_numpy() for x in held]) for i in (0, 1)))
        return pa.RecordBatch.from_arrays([pa.array(hi), pa.array(lo)], names=["hi", "lo"])

    for batch in batches:
        held.append(batch)
        n += len(batch)
        if n >= HELD:
            yield out()
            held, n = [], 0
    if held:
        yield out()


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (hi, lo: bigint, no nulls) to (node, root): the smallest vertex reachable, for every vertex that is not its own."""
    stars = stored(edges.select("hi", "lo").mapInArrow(_contract, "hi long, lo long").distinct(), "stars")
    while True:
        both = stars.unionByName(stars.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least = both.groupBy("hi").agg(F.min("lo").alias("m")).select("hi", F.least("hi", "m").alias("m"))
        large = joined_hot(both, least, ["hi"], "inner").where("lo > hi and lo != m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).distinct()
        down = stored(large, "large-star")
        lowest = down.groupBy("hi").agg(F.min("lo").alias("m"))
        small = joined_hot(down, lowest, ["hi"], "inner").select(F.explode(F.array(F.struct("hi", F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e")).select("e.hi", "e.lo").where("hi != lo").distinct()
        after = stored(small, "small-star")
        digest = [F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("hi", "lo")), F.lit(0))]
        if tuple(after.agg(*digest).first()) == tuple(stars.agg(*digest).first()):
            return after.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        stars = after
