"""Relations, join trees over shared variables, and their validation."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Relation:
    """A bag of rows over variables with a weight; ``frame`` has the columns of ``variables`` and ``weight``."""

    name: str
    frame: DataFrame
    variables: tuple[str, ...]

    @classmethod
    def of(cls, name: str, df: DataFrame, columns: dict[str, str | Column], weight: str | Column | None = None) -> Relation:
        """``columns`` maps variables to columns of ``df``; without ``weight`` every row weighs 0."""
        as_column = lambda c: F.col(c) if isinstance(c, str) else c
        w = F.lit(0).cast("long") if weight is None else as_column(weight)
        return cls(name, df.select(*[as_column(c).alias(v) for v, c in columns.items()], w.alias("weight")), tuple(columns))


@dataclass
class Node:
    relation: Relation
    children: list[Node] = field(default_factory=list)

    def walk(self):
        """This node and all below, parents first, children in order."""
        yield self
        for c in self.children:
            yield from c.walk()

    def key(self, child: Node) -> list[str]:
        return [v for v in self.relation.variables if v in child.relation.variables]


def _ears(relations: list[Relation], root: str | None = None) -> tuple[set[str], list[tuple[str, str]]]:
    """Ear removal: the names that are left (one if the join is acyclic) and (ear, neighbour) of those removed."""
    left = {r.name: set(r.variables) for r in relations}
    edges: list[tuple[str, str]] = []
    while len(left) > 1:
        ear = next(
            ((a, b) for a in reversed(list(left)) if a != root or len(left) == 1 for b in left if a != b and {v for v in left[a] if any(v in left[c] for c in left if c != a)} <= left[b] and left[a] & left[b]),
            None,
        )
        if ear is None:
            break
        edges.append(ear)
        del left[ear[0]]
    return set(left), edges


def cyclic_part(relations: list[Relation]) -> list[Relation]:
    """The relations that no ear removal takes away."""
    left, _ = _ears(relations)
    return [r for r in relations if r.name in left]


class JoinTree:
    """A rooted tree of relations; neighbours join on the variables they share."""

    def __init__(self, root: Node):
        self.root = root
        self.nodes = list(root.walk())
        self._validate()

    def _validate(self) -> None:
        names = [n.relation.name for n in self.nodes]
        if len(set(names)) != len(names):
            raise ValueError("relation names must differ")
        for v in self.variables:
            # running intersection: the nodes that hold a variable are connected
            holders = [n for n in self.nodes if v in n.relation.variables]
            tops = [n for n in holders if not any(n in p.children and v in p.relation.variables for p in self.nodes)]
            if len(tops) > 1:
                raise ValueError(f"variable {v} is held by relations that aren't connected: the join isn't acyclic in this tree")
        for p in self.nodes:
            for c in p.children:
                if not p.key(c):
                    raise ValueError(f"{p.relation.name} and {c.relation.name} share no variable")

    @property
    def variables(self) -> list[str]:
        return list(dict.fromkeys(v for n in self.nodes for v in n.relation.variables))

    @classmethod
    def build(cls, relations: list[Relation], root: str | None = None) -> JoinTree:
        """The join tree of an acyclic join (ear removal); raises ValueError if it is cyclic. ``root`` names the relation on top (default: the first)."""
        left, edges = _ears(relations, root)
        if len(left) > 1:
            raise ValueError("the join is cyclic or not connected")
        by_name = {r.name: r for r in relations}
        near: dict[str, list[str]] = {r.name: [] for r in relations}
        for a, b in edges:
            near[a].append(b)
            near[b].append(a)
        order = [r.name for r in relations]

        def grow(name: str, above: str | None) -> Node:
            return Node(by_name[name], [grow(x, name) for x in sorted(near[name], key=order.index) if x != above])

        return cls(grow(root or order[0], None))


def line(graph: DataFrame, n: int, src: str = "src", dst: str = "dst", weight: str = "rating") -> JoinTree:
    """Paths of n edges: node1 - ... - node(n+1)."""
    nodes = [Node(Relation.of(f"E{i}", graph, {f"node{i}": src, f"node{i + 1}": dst}, weight)) for i in range(1, n + 1)]
    for a, b in zip(nodes, nodes[1:], strict=False):
        a.children.append(b)
    return JoinTree(nodes[0])


def star(graph: DataFrame, n: int, src: str = "src", dst: str = "dst", weight: str = "rating") -> JoinTree:
    """n edges from one source: node1 with node2 ... node(n+1)."""
    nodes = [Node(Relation.of(f"E{i}", graph, {"node1": src, f"node{i + 1}": dst}, weight)) for i in range(1, n + 1)]
    nodes[0].children += nodes[1:]
    return JoinTree(nodes[0])


def fork(graph: DataFrame, src: str = "src", dst: str = "dst", weight: str = "rating") -> JoinTree:
    """Four edges: end <- mid <- hub, hub -> left, hub -> right."""
    tail = Node(Relation.of("tail", graph, {"mid": src, "end": dst}, weight))
    stem = Node(Relation.of("stem", graph, {"hub": src, "mid": dst}, weight))
    stem.children += [Node(Relation.of(side, graph, {"hub": src, side: dst}, weight)) for side in ("left", "right")]
    tail.children.append(stem)
    return JoinTree(tail)
