"""Aggregates over an acyclic join, pushed below it.

Every relation's rows carry the number of results of the subtree they take part
in, and partial aggregates over these; each edge is an aggregation by its key and
a join with one row per key, so the join's results are never made.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .jointree import JoinTree, Node
from .semiring import Ranking
from .topk import naive, product_k


@dataclass(frozen=True)
class Aggregate:
    """SUM, COUNT, AVG, MIN or MAX of a column of one relation (COUNT needs neither)."""

    function: str
    alias: str
    relation: str | None = None
    column: str = "weight"


@dataclass(frozen=True)
class Measure:
    """What is folded over all results: COUNT, SUM of a product with one factor of each named relation, MIN or MAX of a sum of such terms."""

    fold: str
    factors: dict[str, Column] = field(default_factory=dict)


_FOLD = {"MIN": F.min, "MAX": F.max}


def measured(tree: JoinTree, group: list[str], measures: list[Measure]) -> DataFrame:
    """``group`` (any variables) and the measures as _v0, _v1, ... over all results of the join.

    Partial results of a subtree are grouped by the key to its parent and by
    the group variables that the subtree holds. Without ``group`` there is one row.
    """
    missing = set(group) - set(tree.variables)
    if missing:
        raise ValueError(f"{sorted(missing)} are no variables of the join")

    def partial(node: Node) -> tuple[DataFrame, set[int], list[str]]:
        """Rows with _n (results of the subtree), _a<i> for the measures that have a factor in it, and the group variables in it."""
        name = node.relation.name
        here = {i for i, m in enumerate(measures) if name in m.factors}
        df = node.relation.frame.withColumns({"_n": F.lit(1).cast("long"), **{f"_a{i}": measures[i].factors[name] for i in here}})
        held = [v for v in group if v in node.relation.variables]
        for c in node.children:
            key = node.key(c)
            below, there, carried = partial(c)
            carried = [v for v in carried if v not in key]
            folds = [F.sum("_n").alias("_cn"), *[_FOLD.get(measures[i].fold, F.sum)(f"_a{i}").alias(f"_c{i}") for i in there]]
            df = df.join(below.groupBy(*key, *carried).agg(*folds), key, "inner")
            changed = {}
            for i in here | there:
                if measures[i].fold in _FOLD:
                    changed[f"_a{i}"] = F.col(f"_a{i}") + F.col(f"_c{i}") if i in here and i in there else F.col(f"_a{i}" if i in here else f"_c{i}")
                else:  # where one side has no factor, each of its results counts once
                    changed[f"_a{i}"] = (F.col(f"_a{i}") if i in here else F.col("_n")) * (F.col(f"_c{i}") if i in there else F.col("_cn"))
            df = df.withColumns({**changed, "_n": F.col("_n") * F.col("_cn")}).drop("_cn", *[f"_c{i}" for i in there])
            here |= there
            held += [v for v in carried if v not in held]
        return df, here, held

    df, _, _ = partial(tree.root)
    out = [(F.coalesce(F.sum("_n"), F.lit(0).cast("long")) if m.fold == "COUNT" else _FOLD.get(m.fold, F.sum)(f"_a{i}")).alias(f"_v{i}") for i, m in enumerate(measures)]
    if not group:
        return df.agg(*out)
    return df.groupBy(*group).agg(*out) if out else df.select(*group).distinct()


def aggregate_join(tree: JoinTree, group: list[str], aggregates: list[Aggregate]) -> DataFrame:
    """``group`` (any variables; empty for one row) and the aggregates over all results of the join."""
    measures, values = [], []
    for a in aggregates:
        at = len(measures)
        if a.function == "COUNT":
            measures.append(Measure("COUNT"))
        elif a.function == "AVG":
            measures += [Measure("SUM", {a.relation: F.col(a.column)}), Measure("SUM", {a.relation: F.when(F.col(a.column).isNotNull(), F.lit(1).cast("long"))})]
        else:
            measures.append(Measure(a.function, {a.relation: F.col(a.column)}))
        values.append((F.col(f"_v{at}") / F.col(f"_v{at + 1}") if a.function == "AVG" else F.col(f"_v{at}")).alias(a.alias))
    return measured(tree, group, measures).select(*group, *values)


def join_size(tree: JoinTree) -> int:
    """Number of results of the join, by aggregation alone."""
    return aggregate_join(tree, [], [Aggregate("COUNT", "n")]).first()["n"] or 0


def top_k(tree: JoinTree, k: int, ranking: Ranking = Ranking(), small: int = 1_000_000, score: str = "score") -> DataFrame:
    """The k best results by the plan that suits the join's measured size: whole joins of up to ``small`` results are just sorted."""
    method = naive if join_size(tree) <= small else product_k
    return method(tree, k, ranking, score)
