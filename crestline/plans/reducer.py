"""Semi-join reduction, inequality joins and enumeration for joins without a ranking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import materialise
from .jointree import JoinTree, Node, Relation, cyclic_part
from .semiring import ADD, Operator

_OPS = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "=": lambda a, b: a == b, "<>": lambda a, b: a != b}


def compare(op: str, a: Column, b: Column) -> Column:
    """A comparison by its sign."""
    return _OPS[op](a, b)


def semi_reduce(tree: JoinTree) -> JoinTree:
    """Full reduction: children into parents, then parents into children; every row left takes part in a result."""
    frames = {n.relation.name: n.relation.frame for n in tree.nodes}
    for node in reversed(tree.nodes):
        for c in node.children:
            key = node.key(c)
            frames[node.relation.name] = frames[node.relation.name].join(frames[c.relation.name].select(*key).distinct(), key, "left_semi")
    for node in tree.nodes:
        for c in node.children:
            key = node.key(c)
            frames[c.relation.name] = frames[c.relation.name].join(frames[node.relation.name].select(*key).distinct(), key, "left_semi")

    def copy(n: Node) -> Node:
        return Node(Relation(n.relation.name, frames[n.relation.name], n.relation.variables), [copy(c) for c in n.children])

    return JoinTree(copy(tree.root))


def enumerate_join(tree: JoinTree, weights: bool = True) -> DataFrame:
    """All results: variables and, if wanted, each relation's weight as w_<name>."""
    root = tree.root.relation
    df = root.frame.withColumnRenamed("weight", f"w_{root.name}")
    for node in tree.nodes[1:]:
        right = node.relation.frame.withColumnRenamed("weight", f"w_{node.relation.name}")
        df = df.join(right, [v for v in node.relation.variables if v in df.columns], "inner")
    return df if weights else df.select(*tree.variables)


def theta_path(left: DataFrame, middle: DataFrame, right: DataFrame, key_left: str, key_right: str, a: str, op: str, b: str) -> DataFrame:
    """left - middle - right with ``left.a op right.b``, reduced before it is joined.

    For each key the most promising value of either end (the least ``a`` for
    ``<``) goes to the middle, which keeps only rows that can meet the
    inequality; the ends then join the reduced middle, and the inequality is
    the residual condition of that join.
    """
    if op not in ("<", "<=", ">", ">="):
        raise ValueError("an inequality is needed")
    low, high = (F.min, F.max) if op[0] == "<" else (F.max, F.min)
    best_a = left.groupBy(key_left).agg(low(a).alias("_a"))
    best_b = right.groupBy(key_right).agg(high(b).alias("_b"))
    kept = middle.join(best_a, key_left).join(best_b, key_right).where(compare(op, F.col("_a"), F.col("_b")))
    reduced = kept.drop("_a")
    # a row of the left end stays if it meets the best of the other end through some middle row
    joined = left.join(reduced, key_left).where(compare(op, F.col(a), F.col("_b"))).drop("_b")
    return joined.join(right, key_right).where(compare(op, F.col(a), F.col(b)))


def theta_edge(left: DataFrame, right: DataFrame, key: list[str], a: str, op: str, b: str) -> DataFrame:
    """An equi-join with an inequality, both ends first reduced by the best value of the other under each key."""
    low, high = (F.min, F.max) if op[0] == "<" else (F.max, F.min)
    right_best = right.groupBy(*key).agg(high(b).alias("_b"))
    left_best = left.groupBy(*key).agg(low(a).alias("_a"))
    lefts = left.join(right_best, key).where(compare(op, F.col(a), F.col("_b"))).drop("_b")
    rights = right.join(left_best, key).where(compare(op, F.col("_a"), F.col(b))).drop("_a")
    return lefts.join(rights, key).where(compare(op, F.col(a), F.col(b)))


def theta_join(tree: JoinTree, comparisons: list[tuple[str, str, str, str, str]]) -> DataFrame:
    """All results that meet the comparisons (relation, column, sign, relation, column), whatever path lies between the relations.

    Bottom-up, every row learns the most promising value of either side that
    its subtree has (the least left side for ``<``, the largest right side), and
    goes if even these don't meet. Top-down, a prefix has the values themselves
    of joined relations and the promise of open ones, so with one comparison
    every prefix that is kept leads to a result.
    """
    for _, _, op, _, _ in comparisons:
        if op not in ("<", "<=", ">", ">="):
            raise ValueError("inequalities are needed")
    tree = semi_reduce(tree)
    ends: dict[str, list[tuple[str, str, bool]]] = {}
    for i, (x, a, op, y, b) in enumerate(comparisons):
        ends.setdefault(x, []).append((f"_a{i}", a, op[0] == "<"))
        ends.setdefault(y, []).append((f"_b{i}", b, op[0] == ">"))
    least = {name: low for found in ends.values() for name, _, low in found}

    def meets(df: DataFrame, known: set[str]) -> DataFrame:
        for i, (_, _, op, _, _) in enumerate(comparisons):
            if {f"_a{i}", f"_b{i}"} <= known:
                df = df.where(compare(op, F.col(f"_a{i}"), F.col(f"_b{i}")))
        return df

    def prepared(node: Node) -> tuple[DataFrame, set[str], set[str]]:
        """(rows with own and promised sides, names of own sides, names of all)."""
        own = {name: F.col(column) for name, column, _ in ends.get(node.relation.name, [])}
        df = node.relation.frame.drop("weight").withColumns(own) if own else node.relation.frame.drop("weight")
        known = set(own)
        for c in node.children:
            sides = held[c.relation.name][2]
            if sides:
                key = node.key(c)
                promise = held[c.relation.name][0].groupBy(*key).agg(*[(F.min if least[s] else F.max)(s).alias(s) for s in sorted(sides)])
                df = df.join(promise, key, "inner")
                known |= sides
        return meets(df, known), set(own), known

    held: dict[str, tuple[DataFrame, set[str], set[str]]] = {}
    for node in reversed(tree.nodes):
        held[node.relation.name] = prepared(node)
    df, _, known = held[tree.root.relation.name]
    for node in tree.nodes[1:]:
        right, _, sides = held[node.relation.name]
        # the child's values take the place of what was promised of its subtree
        df = df.drop(*sides).join(right, [v for v in node.relation.variables if v in df.columns], "inner")
        known = known | sides
        df = meets(df, known)
    return df.select(*tree.variables)


def _narrowed(relations: list[Relation], rounds: int = 4) -> list[Relation]:
    """The relations without rows that join nothing by the ranges of whole-number variables, as far as a few rounds get."""
    whole = {v for r in relations for v in r.variables} - {f.name for r in relations for f in r.frame.schema if not isinstance(f.dataType, T.IntegralType)}
    shared = [v for v in whole if sum(v in r.variables for r in relations) > 1]
    held = [[v for v in r.variables if v in shared] for r in relations]
    before: dict[str, tuple[int, int]] = {}
    narrow = relations
    for _ in range(rounds if shared else 0):
        # one row a relation, in one job, so that aliases of a table share its scan
        ends = [r.frame.agg(*[f(v).alias(f"{n}{i}_{v}") for v in vs for n, f in (("low", F.min), ("high", F.max))]) for i, (r, vs) in enumerate(zip(narrow, held, strict=True)) if vs]
        found = reduce(lambda a, b: a.crossJoin(b), ends).first()
        within: dict[str, tuple[int, int]] = {}
        for v in shared:
            of = [(found[f"low{i}_{v}"], found[f"high{i}_{v}"]) for i, vs in enumerate(held) if v in vs]
            within[v] = (1, 0) if any(low is None for low, _ in of) else (max(low for low, _ in of), min(high for _, high in of))
        narrow = [Relation(r.name, r.frame.where(reduce(lambda a, b: a & b, [F.col(v).between(*within[v]) for v in vs])) if vs else r.frame, r.variables) for r, vs in zip(relations, held, strict=True)]
        if within == before or any(low > high for low, high in within.values()):
            break
        before = within
    return narrow


def _reduced_core(core: list[Relation]) -> dict[str, Relation]:
    """The relations of a cyclic part without most rows that join nothing, each written once.

    They meet their neighbours by semi-joins in turn, those written before by
    what is left of them; ranges go first, so that little is shuffled.
    """
    now = _narrowed(core)
    for i, r in enumerate(now):
        frame = r.frame
        for other in [*now[:i], *now[i + 1 :]]:
            key = [v for v in r.variables if v in other.variables]
            if key:
                frame = frame.join(other.frame.select(*key).distinct(), key, "left_semi")
        now[i] = Relation(r.name, materialise(frame.select(*r.variables, "weight"), "core"), r.variables)
    return {r.name: r for r in now}


def acyclic(relations: list[Relation], root: str | None = None, times: Operator = ADD) -> JoinTree:
    """A join tree; while the join is cyclic, two relations of its cyclic part that share most variables become one bag.

    Of these pairs the one with the fewest variables is joined, so a cycle of
    four becomes two paths of two edges and not one of three. The relations of
    the cyclic part are reduced before, and the tree with its bags after it.
    """
    relations = list(relations)
    try:
        return JoinTree.build(relations, root)
    except ValueError:
        core = cyclic_part(relations)
        if not _mergeable(core):
            raise
    reduced = _reduced_core(core)
    relations = [reduced.get(r.name, r) for r in relations]
    while True:
        try:
            return semi_reduce(JoinTree.build(relations, root))
        except ValueError:
            core = cyclic_part(relations)
            found = _mergeable(core)
            if not found:
                raise
            a, b = core[found[0]], core[found[1]]
            merged = bag([a, b], a.name if root != b.name else b.name, times)
            relations = [merged if r is a else r for r in relations if r is not b]


def _mergeable(core: list[Relation]) -> tuple[int, int] | None:
    """The two relations of a cyclic part that share most variables, of these the ones with the fewest in all, then the first."""
    pairs = [(-len(set(a.variables) & set(b.variables)), len(set(a.variables) | set(b.variables)), i, j) for i, a in enumerate(core) for j, b in enumerate(core) if i < j and set(a.variables) & set(b.variables)]
    return min(pairs)[2:] if pairs else None


def written(tree: JoinTree) -> JoinTree:
    """The tree with its relations written once, for those who read them again and again."""

    def copy(n: Node) -> Node:
        return Node(Relation(n.relation.name, materialise(n.relation.frame, "relation"), n.relation.variables), [copy(c) for c in n.children])

    return JoinTree(copy(tree.root))


def ordered_view(df: DataFrame, key: list[str], by: str, descending: bool = False, name: str = "rn") -> DataFrame:
    """Rows numbered under each key by one column (ties by all other columns)."""
    rest = [c for c in df.columns if c not in (*key, by)]
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(by) if descending else F.asc(by), *rest)).cast("long"))


def systematic_sample(df: DataFrame, step: int = 100, rank: str = "rn") -> DataFrame:
    """Every ``step``-th row of an ordered view, from the first."""
    return df.where(F.col(rank) % step == 1 % step)


def bag(relations: list[Relation], name: str, times: Operator = ADD) -> Relation:
    """The join of several relations as one (the cyclic part of a query); weights are joined by ``times``."""
    df, variables = relations[0].frame, list(relations[0].variables)
    for r in relations[1:]:
        right = r.frame.withColumnRenamed("weight", "_w")
        df = df.join(right, [v for v in r.variables if v in variables], "inner").withColumn("weight", times.combine(F.col("weight"), F.col("_w"))).drop("_w")
        variables += [v for v in r.variables if v not in variables]
    return Relation(name, df.select(*variables, "weight"), tuple(variables))


def auxiliary(relation: Relation, variables: list[str], name: str, condition: Column | None = None) -> Relation:
    """A distinct projection of a relation that supports a join tree; it weighs nothing."""
    df = relation.frame if condition is None else relation.frame.where(condition)
    return Relation(name, df.select(*variables).distinct().withColumn("weight", F.lit(0).cast("long")), tuple(variables))


def table_agg(scan: DataFrame, sub: DataFrame, key: list[str], aggregates: dict[str, Column]) -> DataFrame:
    """A scan joined with a grouped aggregate of another relation."""
    return scan.join(sub.groupBy(*key).agg(*[c.alias(k) for k, c in aggregates.items()]), key, "inner")
