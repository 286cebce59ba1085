"""The K best results of an acyclic join without computing all of it.

Bottom-up, every relation's rows get a bound: the best score of any result of
the subtree they can take part in (their weight joined with the best bound of
each child under the same key, by aggregation). Top-down, children are joined
one after the other, and what can't be among the K best is cut:

* product-k joins the K best prefixes with the K best rows of a child;
* level-k ranks a child's rows under each key into bands (0, 1], (1, b],
  (b, b^2], ... and joins a band only with prefixes whose last result of the
  band before can still be among the K best.

The final order is score, then all variables in the order of the tree. A
prefix's variables come first in it, so cuts are exact: exactly K prefixes by
(bound, variables), exactly K rows of a child by (total, variables of the best
prefix, own variables). However many scores are equal, no step keeps more.

A step's K rows are at most ``LOCAL`` rows and go on as a local relation, which
Spark broadcasts without measuring; larger ones are written to the shared
folder. Only a child's rows that meet a kept key are given their bounds anew.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import materialise
from .jointree import JoinTree, Node, Relation
from .semiring import Ranking

#: Rows of a cut that the driver hands on from one step to the next.
LOCAL = 1 << 16


def best_k(df: DataFrame, score: str, k: int, ranking: Ranking) -> DataFrame:
    """The rows of the k best scores, ties kept: the k-th score is found by a partial limit, and rows that reach it stay where they are."""
    worst = F.min if ranking.largest else F.max
    bar = df.select(score).orderBy(ranking.order(score)).limit(k).agg(worst(score).alias("_bar"))
    return df.join(F.broadcast(bar), ranking.reaches(F.col(score), F.col("_bar"))).drop("_bar")


def settle(df: DataFrame, k: int, name: str) -> DataFrame:
    """``df``, of at most ``k`` rows, computed now."""
    if k > LOCAL:
        return materialise(df, name)
    return df.sparkSession.createDataFrame(df.toArrow(), df.schema)


def _small(df: DataFrame, k: int) -> DataFrame:
    """A table of at most k rows, broadcast if the driver may hold it."""
    return F.broadcast(df) if k <= LOCAL else df


class Reduced:
    """The relations with their bounds; rows that join nothing are gone from the parents.

    frames[name] has the variables, ``w`` (own weight), ``b_<child>`` (best of
    that child's subtree) and ``bound``; best[name] is the relation's best bound
    for each key of its parent. With ``keep``, those that a later step asks for
    again are cached until ``release``.
    """

    def __init__(self, tree: JoinTree, ranking: Ranking, keep: bool = False):
        self.tree, self.ranking = tree, ranking
        self.frames: dict[str, DataFrame] = {}
        self.best: dict[str, DataFrame] = {}
        self._kept: list[DataFrame] = []
        for node in reversed(tree.nodes):
            name = node.relation.name
            self.frames[name] = self.bounded(node, node.relation.frame.withColumnRenamed("weight", "w"))
            parent = next((p for p in tree.nodes if node in p.children), None)
            if parent:
                best = self.frames[name].groupBy(*parent.key(node)).agg(ranking.best.aggregate(F.col("bound")).alias(f"b_{name}"))
                if keep and parent is not tree.root:
                    self._kept.append(best.persist())
                self.best[name] = best

    def bounded(self, node: Node, rows: DataFrame) -> DataFrame:
        """Rows of a node (or some of them) with ``b_<child>`` and ``bound``."""
        for c in node.children:
            rows = rows.join(self.best[c.relation.name], node.key(c), "inner")
        return rows.withColumn("bound", self.ranking.times.all([F.col("w"), *[F.col(f"b_{c.relation.name}") for c in node.children]]))

    def release(self) -> None:
        for df in self._kept:
            df.unpersist()


def _others(ranking: Ranking, done: list[Node], child: Node) -> Column:
    """What a prefix row is worth beside ``child``: joined weights and the best of the other open subtrees."""
    pending = [c for n in done for c in n.children if c not in done and c is not child]
    return ranking.times.all([F.col("acc"), *[F.col(f"b_{n.relation.name}") for n in pending]])


def _held(done: list[Node]) -> list[str]:
    """Variables of the joined nodes, in the final order."""
    return list(dict.fromkeys(v for n in done for v in n.relation.variables))


def _best_first(ranking: Ranking, done: list[Node], weight: str = "acc") -> list[Column]:
    return [ranking.order("bound"), *[F.asc(v) for v in _held(done)], ranking.order(weight)]


def _final(df: DataFrame, tree: JoinTree, k: int, ranking: Ranking, score: str) -> DataFrame:
    out = df.select(*tree.variables, F.col("acc").alias(score))
    return out.orderBy(ranking.order(score), *tree.variables).limit(k)


def _joined(left: DataFrame, right: DataFrame, parent: Node, child: Node, done: list[Node], ranking: Ranking) -> DataFrame:
    """Prefix rows extended by rows of ``child``; ``bound`` is the best they can still reach."""
    total = ranking.times.combine(_others(ranking, done, child), F.col("bound"))
    joined = left.join(right, parent.key(child), "inner").withColumn("total", total)
    return joined.withColumn("acc", ranking.times.combine(F.col("acc"), F.col("w"))).drop("w", "bound", f"b_{child.relation.name}").withColumnRenamed("total", "bound")


def _parent(tree: JoinTree, child: Node) -> Node:
    return next(p for p in tree.nodes if child in p.children)


def truncate_child(left: DataFrame, right: DataFrame, key: list[str], worth: Column, k: int, ranking: Ranking) -> DataFrame:
    """The rows of ``right`` whose bound joined with the best of ``left`` under their key is among the k best, ties kept."""
    best = left.groupBy(*key).agg(ranking.best.aggregate(worth).alias("_best"))
    ranked = right.join(best, key, "inner").withColumn("_total", ranking.times.combine(F.col("_best"), F.col("bound")))
    return best_k(ranked, "_total", k, ranking).drop("_best", "_total")


def _cut_child(left: DataFrame, reduced: Reduced, parent: Node, child: Node, done: list[Node], k: int) -> DataFrame:
    """The k rows of ``child`` (fewer if there are) that can be part of the k best results."""
    ranking, key = reduced.ranking, parent.key(child)
    worth, held = _others(ranking, done, child), _held(done)
    # the best prefix of each key: its worth (smaller is better here), then its variables
    first = F.min(F.struct((-worth if ranking.largest else worth).alias("v"), *[F.col(v) for v in held])).alias("_first")
    best = left.groupBy(*key).agg(first, F.min(F.struct(*held)).alias("_least"))
    # the semi-join goes first, as Spark moves it below a derived relation's own aggregation
    met = child.relation.frame.join(_small(left.select(*key), k), key, "left_semi").withColumnRenamed("weight", "w").join(_small(best, k), key, "inner")
    value = F.col("_first.v")
    total = ranking.times.combine(-value if ranking.largest else value, F.col("bound"))
    rows = reduced.bounded(child, met).withColumn("_total", total)
    if not ranking.times.strict:
        return best_k(rows, "_total", k, ranking).drop("_first", "_least", "_total")
    before = [F.col(f"_first.{v}") for v in held]
    if ranking.times.absorbing is not None:  # every prefix is as good for such a row
        before = [F.when(F.col("bound") == ranking.times.absorbing, F.col(f"_least.{v}")).otherwise(b) for v, b in zip(held, before, strict=True)]
    own = [F.asc(v) for v in child.relation.variables if v not in key]
    return rows.orderBy(ranking.order("_total"), *before, *own, ranking.order("w")).limit(k).drop("_first", "_least", "_total")


def _start(reduced: Reduced, k: int) -> DataFrame:
    root = reduced.tree.root
    kept = reduced.frames[root.relation.name].orderBy(*_best_first(reduced.ranking, [root], "w")).limit(k)
    return kept.withColumn("acc", F.col("w")).drop("w", "bound")


def naive(tree: JoinTree, k: int, ranking: Ranking = Ranking(), score: str = "score") -> DataFrame:
    """The whole join, sorted and cut: the plan to compare with."""
    root = tree.root.relation
    df = root.frame.withColumnRenamed("weight", "acc")
    for node in tree.nodes[1:]:
        right = node.relation.frame.withColumnRenamed("weight", "w")
        df = df.join(right, [v for v in node.relation.variables if v in df.columns], "inner").withColumn("acc", ranking.times.combine(F.col("acc"), F.col("w"))).drop("w")
    return _final(df, tree, k, ranking, score)


def _stepwise(tree: JoinTree, k: int, ranking: Ranking, score: str, extend) -> DataFrame:
    """Joins child after child by ``extend``, keeping the k best prefixes; the last step is left to the caller's action."""
    reduced = Reduced(tree, ranking, keep=True)
    try:
        left, done = _start(reduced, k), [tree.root]
        for child in tree.nodes[1:]:
            left = settle(left, k, "prefix")
            found = extend(left, reduced, _parent(tree, child), child, done)
            done.append(child)
            left = found.orderBy(*_best_first(ranking, done)).limit(k).drop("bound")
        return _final(left, tree, k, ranking, score)
    finally:
        reduced.release()


def product_k(tree: JoinTree, k: int, ranking: Ranking = Ranking(), score: str = "score") -> DataFrame:
    """The k best results, joining at most the k best rows of both sides each time."""

    def extend(left: DataFrame, reduced: Reduced, parent: Node, child: Node, done: list[Node]) -> DataFrame:
        right = _cut_child(left, reduced, parent, child, done, k)
        return _joined(_small(left, k), right, parent, child, done, ranking)

    return _stepwise(tree, k, ranking, score, extend)


def levels(k: int, base: int) -> list[tuple[int, int]]:
    """Rank bands (after, up to): up to base, base squared, ..., the last up to k."""
    if base < 2:
        raise ValueError("the base must be at least 2")
    out, low, high = [], 0, base
    while low < k:
        out.append((low, min(high, k)))
        low, high = high, high * base
    return out


def level_k(tree: JoinTree, k: int, base: int = 32, ranking: Ranking = Ranking(), score: str = "score") -> DataFrame:
    """The k best results by rank bands; ``base`` sets their width.

    The row at the end of a band stands for all rows of the band: whatever
    prefix it joins, they give results as good. Summed up from the best such
    end, the end that completes k results is a bar that no result below needs
    to be made for, and a band is joined where the end before it reaches the
    bar, so at most about ``base`` times k pairs are made.
    """
    ends = [1, *[high for _, high in levels(k, base)]]
    steps = dict(zip(ends, [1, *[b - a for a, b in zip(ends, ends[1:], strict=False)]], strict=True))

    def extend(left: DataFrame, reduced: Reduced, parent: Node, child: Node, done: list[Node]) -> DataFrame:
        key = parent.key(child)
        in_key = Window.partitionBy(*key)
        by_rank = in_key.orderBy(ranking.order("bound"), *[v for v in child.relation.variables if v not in key], ranking.order("w"))
        cut = _cut_child(left, reduced, parent, child, done, k).withColumn("_rnk", F.row_number().over(by_rank))
        ended = F.when(F.col("_rnk").isin(ends), F.col("bound"))
        gate = F.last(ended, ignorenulls=True).over(in_key.orderBy("_rnk").rowsBetween(Window.unboundedPreceding, -1))
        right = settle(cut.withColumn("_gate", F.coalesce(gate, F.col("bound"))), k if ranking.times.strict else LOCAL + 1, "ranked")
        worth = _others(ranking, done, child)
        stands_for = reduce(lambda c, e: c.when(F.col("_rnk") == e, F.lit(steps[e])), ends[1:], F.when(F.col("_rnk") == ends[0], F.lit(steps[ends[0]])))
        marks = _small(left, k).join(right.where(F.col("_rnk").isin(ends)), key).select(ranking.times.combine(worth, F.col("bound")).alias("_mark"), stands_for.alias("_n"))
        reached = marks.withColumn("_sum", F.sum("_n").over(Window.orderBy(ranking.order("_mark")).rowsBetween(Window.unboundedPreceding, 0))).where(F.col("_sum") >= k)
        bar = reached.agg(ranking.best.aggregate(F.col("_mark")).alias("_bar"))
        gated = left.join(_small(right, k), key).join(F.broadcast(bar), F.col("_bar").isNull() | ranking.reaches(ranking.times.combine(worth, F.col("_gate")), F.col("_bar")))
        total = ranking.times.combine(worth, F.col("bound"))
        joined = gated.withColumn("total", total).withColumn("acc", ranking.times.combine(F.col("acc"), F.col("w")))
        return joined.drop("w", "bound", f"b_{child.relation.name}", "_rnk", "_gate", "_bar").withColumnRenamed("total", "bound")

    return _stepwise(tree, k, ranking, score, extend)


def reaching(tree: JoinTree, bar: DataFrame, ranking: Ranking = Ranking(), score: str = "score", output: list[str] | None = None) -> DataFrame:
    """All results whose score reaches ``bar`` (one row, one column; null: all results).

    Every prefix that is kept leads to such a result. With ``output``, only
    these variables are returned, each combination once with its best score,
    and variables go as soon as no later join needs them.
    """
    reduced = Reduced(tree, ranking)
    bar = F.broadcast(bar.toDF("_bar"))

    def reaches() -> Column:
        return F.col("_bar").isNull() | ranking.reaches(F.col("bound"), F.col("_bar"))

    def slim(df: DataFrame, done: list[Node]) -> DataFrame:
        if output is None:
            return df
        needed = {v for n in tree.nodes if n not in done for v in n.relation.variables}
        pending = [f"b_{c.relation.name}" for n in done for c in n.children if c not in done]
        keep = [v for v in _held(done) if v in output or v in needed]
        return df.groupBy(*keep, *pending).agg(ranking.best.aggregate(F.col("acc")).alias("acc"))

    done = [tree.root]
    left = reduced.frames[tree.root.relation.name].join(bar, reaches()).withColumn("acc", F.col("w")).drop("w", "bound", "_bar")
    left = slim(left, done)
    for child in tree.nodes[1:]:
        parent = _parent(tree, child)
        left = _joined(left, reduced.frames[child.relation.name], parent, child, done, ranking).join(bar, reaches()).drop("bound", "_bar")
        done.append(child)
        left = slim(left, done)
    return left.select(*(output if output is not None else tree.variables), F.col("acc").alias(score))


def projected_k(tree: JoinTree, output: list[str], k: int, ranking: Ranking = Ranking(), score: str = "score") -> DataFrame:
    """The k best distinct values of ``output`` by their best score.

    Variables outside of ``output`` that only one relation holds are projected
    away before the join, each row set keeping its best weight. If a join
    variable goes, too, the distinct output values of one relation give a bar
    (k of them have a result as good as the k-th best bound), and only results
    that reach it are made.
    """
    holders = {v: [n for n in tree.nodes if v in n.relation.variables] for v in tree.variables}
    relations = []
    for n in tree.nodes:
        kept = [v for v in n.relation.variables if v in output or len(holders[v]) > 1]
        if not kept:
            raise ValueError(f"nothing of {n.relation.name} is left")
        relations.append(Relation(n.relation.name, n.relation.frame.groupBy(*kept).agg(ranking.best.aggregate(F.col("weight")).alias("weight")), tuple(kept)))
    small = JoinTree.build(relations)
    if set(small.variables) == set(output):
        return product_k(small, k, ranking, score).select(*output, score).orderBy(ranking.order(score), *output)
    root = max(relations, key=lambda r: len(set(r.variables) & set(output)))
    small = JoinTree.build(relations, root.name)
    told = [v for v in root.variables if v in output]
    bar = Reduced(small, ranking).frames[root.name].groupBy(*told).agg(ranking.best.aggregate(F.col("bound")).alias("bound")).orderBy(ranking.order("bound")).limit(k)
    worst = F.min if ranking.largest else F.max
    # with fewer than k values, results beyond theirs are needed
    bar = bar.agg(F.when(F.count(F.lit(1)) >= k, worst("bound")).alias("_bar"))
    return reaching(small, bar, ranking, score, output).orderBy(ranking.order(score), *output).limit(k)


def digest(df: DataFrame, score: str = "score") -> DataFrame:
    """Smallest, largest and sum of the scores."""
    return df.agg(F.min(score).alias("min_score"), F.max(score).alias("max_score"), F.sum(score).alias("sum_score"), F.count(F.lit(1)).alias("n"))


def checksum(df: DataFrame, columns: list[str], name: str = "checksum") -> DataFrame:
    """Sum over all rows and the given columns."""
    return df.agg(F.sum(reduce(lambda a, b: a + b, map(F.col, columns))).alias(name))
