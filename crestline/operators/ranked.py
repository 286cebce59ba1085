"""Ranked enumeration: distinct end points of paths and stars by the sum of their ids, lexicographic order, unions."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.jointree import line
from ..plans.topk import LOCAL, product_k, settle
from ..scratch import materialise


def _steps(graph: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct edges from ``a`` to ``b``, along and against their direction."""
    along = graph.select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct()
    return along, along.select(F.col("b").alias("a"), F.col("a").alias("b"))


def dealt_join(left: DataFrame, right: DataFrame, key: str, degree: int | None, parts: int = 16) -> DataFrame:
    """left join right on one column; keys with more than ``degree`` rows on the right are heavy.

    A heavy key's right rows are dealt to ``parts`` tasks by hash, and the left
    rows of that key go to each of them, so that no task sees a whole hub.
    """
    if degree is None:
        return left.join(right, key)
    heavy = right.groupBy(key).agg(F.count(F.lit(1)).alias("_d")).where(F.col("_d") > degree).select(key, F.lit(True).alias("_heavy"))
    part = F.when(F.col("_heavy"), F.pmod(F.xxhash64(*right.columns), F.lit(parts))).otherwise(0).cast("int")
    copies = F.explode(F.when(F.col("_heavy"), F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0))))
    rights = right.join(heavy, key, "left").withColumn("_part", part).drop("_heavy")
    lefts = left.join(heavy, key, "left").withColumn("_part", copies).drop("_heavy")
    return lefts.join(rights, [key, "_part"]).drop("_part")


def _walk(edges: list[DataFrame], nodes: DataFrame, degree: int | None) -> DataFrame:
    """Distinct (x, a): the nodes a at the end of a path from one of ``nodes`` (their column is ``a``), written step by step, so that a step reads the edges of nodes that were reached alone."""
    met = edges[0].join(F.broadcast(nodes), "a", "left_semi")
    pairs = materialise(met.select(F.col("a").alias("x"), F.col("b").alias("a")), "walk")
    for step in edges[1:]:
        few = pairs.limit(LOCAL + 1).count() <= LOCAL
        reached = pairs.select("a") if few else pairs.select("a").distinct()
        small = few or reached.limit(LOCAL + 1).count() <= LOCAL
        met = step.join(F.broadcast(reached) if small else reached, "a", "left_semi")
        pairs = dealt_join(F.broadcast(pairs), met, "a", None) if few else dealt_join(pairs, met, "a", degree)
        pairs = materialise(pairs.select("x", F.col("b").alias("a")).distinct(), "walk")
    return pairs


def _least_ends(along: DataFrame, against: DataFrame, steps: list[bool], k: int, degree: int | None) -> DataFrame | None:
    """The k least pairs by (x + y, x, y), by walks from the least starts and ends that meet half-way.

    Pairs of the first starts and ends give a bar, their k-th least sum. Once
    no start or end beyond these can stay within it, no other pair can be among
    the k least; until then there are more of them, up to eight times as many:
    as the pairs within a sum grow with its square, those that are sure to be
    complete tell how many. None if that would be more than 2k, as where small
    starts reach large ends alone. Where the way back from the ends has the
    steps of the way there, as in a zigzag of even length, one walk is both.
    """
    most, half = 2 * k, (len(steps) + 1) // 2
    there, back = steps[:half], [not s for s in reversed(steps[half:])]
    edges = lambda of: [along if s else against for s in of]
    least = lambda of: edges(of)[0].select("a").where(F.col("a").isNotNull()).distinct().orderBy("a").limit(most + 1).toArrow()
    starts = least(there)
    ends = starts if there == back else least(back)
    if not starts.num_rows or not ends.num_rows:
        return None
    firsts, lasts = starts["a"].to_pylist(), ends["a"].to_pylist()
    walk = lambda of, nodes, n: _walk(edges(of), along.sparkSession.createDataFrame(nodes.slice(0, n)), degree)
    n, m = (2 * math.isqrt(k) + 1,) * 2
    while True:
        n, m = min(n, len(firsts)), min(m, len(lasts))
        if max(n, m) > most:
            return None
        left = walk(there, starts, n)
        right = (left if there == back else walk(back, ends, m)).withColumnRenamed("x", "y")
        pairs = dealt_join(left, right, "a", degree).select("x", "y").distinct()
        ordered = pairs.select("x", "y", (F.col("x") + F.col("y")).alias("s")).orderBy("s", "x", "y").limit(k).toArrow()
        found = ordered.num_rows
        bar = ordered["s"][found - 1].as_py() if found else None
        need = lambda of, other: len(of) if found < k else sum(v + other[0] <= bar for v in of)  # noqa: B023, E731
        more_starts, more_ends = need(firsts, lasts), need(lasts, firsts)
        if more_starts <= n and more_ends <= m:
            return along.sparkSession.createDataFrame(ordered.select(["x", "y"]), pairs.schema)
        beyond = min(of[i] + other[0] for of, i, other in ((firsts, n, lasts), (lasts, m, firsts)) if i < len(of))
        whole = sum(s < beyond for s in ordered["s"].to_pylist())
        grow = min(1.2 * math.sqrt(k / whole), 8) if whole else 8
        n, m = (min(max(a, b), math.ceil(a * grow)) for a, b in ((n, more_starts), (m, more_ends)))


def path_ends(graph: DataFrame, steps: list[bool], k: int | None = None, degree: int | None = None) -> DataFrame:
    """Distinct (x, y) joined by a path; each step goes along an edge (True) or against it.

    Only the pairs of start and current node are kept, and repeated ones are
    dropped after each step, so the paths themselves are never made. With
    ``k``, the pairs that can be among the k least sums x + y: those between
    the least starts and ends are looked for first, and they may be enough. Else
    every node learns the least end it reaches; each start has a pair with its
    least end, so the k-th least of these sums is a bar, and pairs that can't
    stay within it are never made.
    """
    along, against = _steps(graph)
    edges = [along if s else against for s in steps]
    if k is None:
        pairs = edges[0].select(F.col("a").alias("x"), F.col("b").alias("y"))
        for step in edges[1:]:
            pairs = dealt_join(pairs.withColumnRenamed("y", "a"), step, "a", degree).select("x", F.col("b").alias("y")).distinct()
        return pairs
    if len(steps) > 1 and k <= LOCAL:
        found = _least_ends(along, against, steps, k, degree)
        if found is not None:
            return found
    # least[i]: the least end for each node before step i
    least = [edges[-1].groupBy("a").agg(F.min("b").alias("least"))]
    for step in reversed(edges[:-1]):
        least.insert(0, step.join(least[0].withColumnRenamed("a", "b"), "b").groupBy("a").agg(F.min("least").alias("least")))
    sums = least[0].select((F.col("a") + F.col("least")).alias("s")).orderBy("s").limit(k)
    # with fewer than k starts, pairs beyond their least ends are needed
    bar = F.broadcast(sums.agg(F.when(F.count(F.lit(1)) >= k, F.max("s")).alias("_bar")))
    within = F.col("_bar").isNull() | (F.col("x") + F.col("least") <= F.col("_bar"))
    pairs = least[0].select(F.col("a").alias("x"), "a", "least").join(bar, within).select("x", "a")
    for i, step in enumerate(edges):
        if i + 1 < len(edges):
            step = step.join(least[i + 1].withColumnRenamed("a", "b"), "b")
        else:
            step = step.withColumn("least", F.col("b"))
        pairs = dealt_join(pairs, step, "a", degree).join(bar, within).select("x", F.col("b").alias("a")).distinct()
    return pairs.withColumnRenamed("a", "y")


def by_sum(df: DataFrame, k: int | None = None) -> DataFrame:
    """All columns' sum first (as ``weight``), then the columns, ascending; the first k if asked."""
    out = df.withColumn("weight", reduce(lambda a, b: a + b, map(F.col, df.columns))).orderBy("weight", *df.columns)
    return out.limit(k) if k else out


def by_columns(df: DataFrame, k: int | None = None) -> DataFrame:
    out = df.orderBy(*df.columns)
    return out.limit(k) if k else out


def zigzag(n: int) -> list[bool]:
    """Steps of a path over a bipartite relation: along, against, along, ..."""
    return [i % 2 == 0 for i in range(n)]


def path_projected(graph: DataFrame, n: int, k: int | None = None) -> DataFrame:
    return by_sum(path_ends(graph, zigzag(n), k), k)


def star_two(graph: DataFrame, k: int | None = None, degree: int | None = None) -> DataFrame:
    """Distinct (x, y) with a common right neighbour, by x + y; neighbours of more than ``degree`` edges are dealt to several tasks."""
    return by_sum(path_ends(graph, [True, False], k, degree), k)


def _hubs(graph: DataFrame, names: tuple[str, ...]) -> list[DataFrame]:
    edges = graph.select(F.col("src").alias("x"), F.col("dst").alias("m")).distinct()
    return [edges.select("m", F.col("x").alias(n)) for n in names]


def _least_per_hub(edges: DataFrame, name: str, k: int, rank: str, parts: int = 16) -> DataFrame:
    """The k least ``name`` of each hub ``m`` and their rank from 1; parts of a hub are cut first, so no task sees a whole one."""
    dealt = edges.withColumn("_part", F.pmod(F.xxhash64(name), F.lit(parts)))
    first = dealt.withColumn("_r", F.row_number().over(Window.partitionBy("m", "_part").orderBy(name))).where(F.col("_r") <= k).drop("_r", "_part")
    return first.withColumn(rank, F.row_number().over(Window.partitionBy("m").orderBy(name))).where(F.col(rank) <= k)


def _lexicographic(graph: DataFrame, names: tuple[str, ...], k: int | None, degree: int | None) -> DataFrame:
    """Distinct combinations with a common right neighbour in lexicographic order.

    After each column the k least prefixes are kept: each of them has a
    combination of its own, so no other prefix is needed. A prefix has as many
    combinations as its largest hub has edges, so prefixes after those that are
    sure to give k are of no use, either, and neither is an edge beyond the k
    least of its hub.
    """
    first, *others = _hubs(graph, names)
    found = first
    for i, side in enumerate(others, 1):
        held = list(names[:i])
        if k is not None:
            least = settle(found.select(*held).distinct().orderBy(*held).limit(k), k, "prefix")
            found = found.join(F.broadcast(least) if k <= LOCAL else least, held, "left_semi")
            met = side.join(found.select("m").distinct(), "m", "left_semi")
            sure = found.join(met.groupBy("m").agg(F.count(F.lit(1)).alias("_n")), "m").groupBy(*held).agg(F.max("_n").alias("_n"))
            before = F.sum("_n").over(Window.orderBy(*held).rowsBetween(Window.unboundedPreceding, -1))
            least = settle(sure.withColumn("_before", before).where(F.coalesce("_before", F.lit(0)) < k).select(*held), k, "prefix")
            found = found.join(F.broadcast(least) if k <= LOCAL else least, held, "left_semi")
            side = _least_per_hub(side.join(found.select("m").distinct(), "m", "left_semi"), names[i], k, "_rank").drop("_rank")
        found = dealt_join(found, side, "m", degree).distinct()
    return by_columns(found.select(*names).distinct(), k)


def star_two_lex(graph: DataFrame, k: int | None = None, degree: int | None = None) -> DataFrame:
    return _lexicographic(graph, ("x", "y"), k, degree)


def star_three(graph: DataFrame, k: int | None = None, degree: int | None = None) -> DataFrame:
    """Distinct (x1, x2, x3) with a common right neighbour, by their sum.

    With ``k``, each x has a triple with twice the least node of one of its
    neighbours, and a hub's c least nodes give c cubed triples; the k-th least
    of the former's sums and the least that one hub reaches k triples with are
    bars for all prefixes. In a hub, the k least triples are of nodes whose
    ranks' product is k at most. Of the pairs the k least by the sum they can
    still reach go on.
    """
    one, two, three = _hubs(graph, ("x1", "x2", "x3"))
    if k is None:
        return by_sum(dealt_join(dealt_join(one, two, "m", degree), three, "m", degree).select("x1", "x2", "x3").distinct())
    edges = materialise(one.withColumnRenamed("x1", "x"), "edges")
    least = edges.groupBy("m").agg(F.min("x").alias("least"))
    sums = edges.join(least, "m").groupBy("x").agg((F.col("x") + 2 * F.min("least")).alias("s")).select("s").orderBy("s").limit(k)
    side = next(c for c in range(1, k + 1) if c**3 >= k)
    full = _least_per_hub(edges, "x", side, "_r").where(F.col("_r") == side).agg(F.min(3 * F.col("x")).alias("_full"))
    # with fewer than k starts, triples beyond their least are needed
    bar = sums.agg(F.when(F.count(F.lit(1)) >= k, F.max("s")).alias("_starts")).crossJoin(full)
    bar = settle(bar.select(F.least("_starts", "_full").alias("_bar")), 1, "bar").first()[0]
    within = lambda s: F.lit(True) if bar is None else s <= F.lit(bar)
    near = edges.join(least, "m").where(within(F.col("x") + 2 * F.col("least")))
    near = materialise(_least_per_hub(near, "x", k, "r"), "near")
    nth = lambda i: near.select("m", F.col("x").alias(f"x{i}"), F.col("r").cast("long").alias(f"r{i}"))
    pairs = dealt_join(near.select("m", "least", F.col("x").alias("x1"), F.col("r").cast("long").alias("r1")), nth(2), "m", degree)
    pairs = pairs.where((F.col("r1") * F.col("r2") <= k) & within(F.col("x1") + F.col("x2") + F.col("least")))
    kept = pairs.groupBy("x1", "x2").agg((F.col("x1") + F.col("x2") + F.min("least")).alias("s")).orderBy("s", "x1", "x2").limit(k).select("x1", "x2")
    kept = settle(kept, k, "pairs")
    pairs = pairs.join(F.broadcast(kept) if k <= LOCAL else kept, ["x1", "x2"], "left_semi")
    triples = dealt_join(pairs, nth(3), "m", degree)
    triples = triples.where((F.col("r1") * F.col("r2") * F.col("r3") <= k) & within(F.col("x1") + F.col("x2") + F.col("x3")))
    return by_sum(triples.select("x1", "x2", "x3").distinct(), k)


def star_three_lex(graph: DataFrame, k: int | None = None, degree: int | None = None) -> DataFrame:
    """The same triples in lexicographic order."""
    return _lexicographic(graph, ("x1", "x2", "x3"), k, degree)


def union_2_4(graph: DataFrame, k: int | None = None) -> DataFrame:
    """Ends of two-step or four-step paths, each pair once, by x + y.

    A two-step path x - m - y is a four-step one as well, x - m - y - m - y, so
    with ``k`` the ends of four steps are all that is needed; x or y has to have
    an id for that, as no step leaves a null.
    """
    if k:
        return path_projected(graph, 4, k)
    return by_sum(path_ends(graph, zigzag(2)).union(path_ends(graph, zigzag(4))).distinct())


def full_paths(graph: DataFrame, n: int, k: int = 35000) -> DataFrame:
    """Whole paths of n edges by the sum of their weights, largest first."""
    return product_k(line(graph, n), k)


#: Enumerations by name; each takes a graph and how many results.
ENUMERATIONS: dict[str, Callable[..., DataFrame]] = {
    "path_three": lambda g, k=None: path_projected(g, 3, k),
    "path_four": lambda g, k=None: path_projected(g, 4, k),
    "path_two_full": lambda g, k=35000: full_paths(g, 2, k),
    "path_three_full": lambda g, k=35000: full_paths(g, 3, k),
    "path_four_full": lambda g, k=35000: full_paths(g, 4, k),
    "star_two": star_two,
    "star_two_lex": star_two_lex,
    "star_three": star_three,
    "star_three_lex": star_three_lex,
    "union_2_4": union_2_4,
}


def stepwise(df: DataFrame):
    """Rows of a ranked result one by one, in order, without holding them all."""
    return df.toLocalIterator()
