"""A SQL front for ranked joins: SELECT ... FROM t A, t B WHERE ... ORDER BY sum of weights LIMIT k.

Equalities between relations become shared variables and a join tree (cyclic
parts are joined to bags first); conditions on one relation go to its scan.
Then, by what the query asks for:

* a ranking by a sum or product of terms of single relations, with a limit, is
  answered by product-k or level-k; further order keys are applied to all
  results that reach the k-th score;
* aggregates and DISTINCT are pushed below the join, whatever relations their
  columns and formulas come from;
* comparisons between relations are reduced by minima and maxima along the tree;
* all else enumerates the reduced join.

What this module doesn't understand goes to Spark as it is; nothing is dropped.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .eager import Measure, measured
from .jointree import JoinTree, Relation
from .reducer import acyclic, enumerate_join, semi_reduce, theta_join, written
from .semiring import ADD, MAX, MIN, MUL, Ranking
from .topk import level_k, naive, product_k, reaching

_TOKEN = re.compile(r"\s*('(?:[^']|'')*'|[A-Za-z_]\w*\.[A-Za-z_]\w*|[A-Za-z_]\w*|\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|<=|>=|<>|!=|\|\||[-+*/%(),<>=;])")
_REFERENCE = re.compile(r"([A-Za-z_]\w*)\.([A-Za-z_]\w*)")
_NAME = re.compile(r"[A-Za-z_]\w*")
_CLAUSES = ("select", "from", "where", "group by", "having", "order by", "limit")
_FOREIGN = {"union", "intersect", "except", "over", "with", "left", "right", "full", "outer", "cross", "natural", "using", "lateral", "offset", "nulls", "qualify", "window", "exists", "interval", "rollup", "cube", "filter"}
_WORDS = {"and", "or", "not", "between", "in", "like", "is", "null", "case", "when", "then", "else", "end", "as", "distinct", "true", "false", "asc", "desc"}
_FOLDS = ("sum", "count", "avg", "min", "max")
_COMPARE = ("<", "<=", ">", ">=")

Tokens = list[str]


class Unsupported(ValueError):
    """Valid SQL, perhaps, but nothing that this module plans."""


@dataclass
class Query:
    """A parsed query; expressions are lists of tokens."""

    items: list[tuple[Tokens, str]]
    tables: dict[str, str]
    where: list[Tokens] = field(default_factory=list)
    distinct: bool = False
    group: list[Tokens] = field(default_factory=list)
    having: list[Tokens] = field(default_factory=list)
    order: list[tuple[Tokens, bool]] = field(default_factory=list)
    limit: int | None = None


def tokens(text: str) -> Tokens:
    out, at, text = [], 0, text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise Unsupported(f"not understood: {text[at : at + 20]}")
        out.append(m[1])
        at = m.end()
    return out


def _split(ts: Tokens, separators: set[str]) -> list[tuple[str, Tokens]]:
    """(separator before, part) at the outermost level; the AND of a BETWEEN separates nothing."""
    out: list[tuple[str, Tokens]] = [("", [])]
    depth = between = 0
    for t in ts:
        low = t.lower()
        depth += (t == "(") + (low == "case") - (t == ")") - (low == "end")
        if depth == 0 and low == "between":
            between += 1
        if depth == 0 and low in separators and not (low == "and" and between):
            out.append((low, []))
            continue
        if depth == 0 and low == "and" and between:
            between -= 1
        out[-1][1].append(t)
    return out


def _parts(ts: Tokens, separator: str) -> list[Tokens]:
    parts = [p for _, p in _split(ts, {separator})]
    if not all(parts):
        raise Unsupported(f"something is missing beside {separator}")
    return parts


def _conjuncts(ts: Tokens) -> list[Tokens]:
    if any(t == "or" for t, _ in _split(ts, {"or"})):
        return [ts]
    out = []
    for p in _parts(ts, "and"):
        # a conjunction in parentheses is taken apart, too
        inner = p[1:-1]
        whole = p[0] == "(" and p[-1] == ")" and all(sum((x == "(") - (x == ")") for x in inner[: i + 1]) >= 0 for i in range(len(inner)))
        out += _conjuncts(inner) if whole and inner else [p]
    return out


def parse(sql: str) -> Query:
    ts = tokens(sql)
    if ts and ts[-1] == ";":
        ts = ts[:-1]
    if not ts or ts[0].lower() != "select":
        raise Unsupported("SELECT ... FROM ... is needed") if ts and ts[0].lower() == "with" else ValueError("SELECT ... FROM ... is needed")
    low = [t.lower() for t in ts]
    if low.count("select") > 1 or _FOREIGN & set(low) or ";" in ts:
        raise Unsupported("subqueries, set operations, outer joins and the like go to Spark")
    clauses: dict[str, Tokens] = {}
    depth, at, name = 0, 0, ""
    while at < len(ts):
        depth += (ts[at] == "(") - (ts[at] == ")")
        two = " ".join(low[at : at + 2])
        found = two if two in _CLAUSES else low[at] if low[at] in _CLAUSES else None
        if depth == 0 and found:
            if found in clauses or (name and _CLAUSES.index(found) < _CLAUSES.index(name)):
                raise Unsupported("clauses out of order")
            name = found
            clauses[name] = []
            at += len(found.split())
            continue
        clauses[name].append(ts[at])
        at += 1
    if "from" not in clauses or not all(clauses.values()):
        raise ValueError("SELECT ... FROM ... is needed")
    select = clauses["select"]
    distinct = select[0].lower() == "distinct"
    items = []
    for i, part in enumerate(_parts(select[1:] if distinct else select, ",")):
        if part == ["*"] or part[0].endswith(".*"):
            raise Unsupported("all columns")
        if len(part) > 2 and part[-2].lower() == "as":
            items.append((part[:-2], part[-1]))
        elif len(part) > 1 and _NAME.fullmatch(part[-1]) and part[-1].lower() not in _WORDS and (part[-2] == ")" or re.fullmatch(r"[\w.]+|'.*'", part[-2]) and part[-2].lower() not in _WORDS):
            items.append((part[:-1], part[-1]))
        else:
            items.append((part, part[0].split(".")[-1] if len(part) == 1 and _NAME.match(part[0]) else f"c{i}"))
    q = Query(items, {}, distinct=distinct)
    for part in _parts(clauses["from"], ","):
        for sign, one in _split(part, {"join"}):
            one = one[:-1] if one and one[-1].lower() == "inner" else one
            pieces = _split(one, {"on"})
            words = [w for w in pieces[0][1] if w.lower() != "as"]
            if not 1 <= len(words) <= 2 or not all(re.fullmatch(r"[\w.]+", w) for w in words) or len(pieces) > 2 or (sign == "" and len(pieces) > 1):
                raise Unsupported("relations are named by tables")
            if words[-1] in q.tables:
                raise ValueError(f"two relations are called {words[-1]}")
            q.tables[words[-1]] = words[0]
            q.where += _conjuncts(pieces[1][1]) if len(pieces) == 2 else []
    q.where += _conjuncts(clauses["where"]) if "where" in clauses else []
    q.group = _parts(clauses["group by"], ",") if "group by" in clauses else []
    q.having = _conjuncts(clauses["having"]) if "having" in clauses else []
    for part in _parts(clauses["order by"], ",") if "order by" in clauses else []:
        way = part[-1].lower()
        q.order.append((part[:-1] if way in ("asc", "desc") else part, way == "desc"))
    if "limit" in clauses:
        if len(clauses["limit"]) != 1 or not clauses["limit"][0].isdigit():
            raise Unsupported("a limit is a number")
        q.limit = int(clauses["limit"][0])
    every = [*[e for e, _ in q.items], *q.where, *q.group, *q.having, *[e for e, _ in q.order]]
    unknown = {a for e in every for a, _ in _references(e)} - set(q.tables)
    if unknown:
        raise ValueError(f"unknown relations: {sorted(unknown)}")
    return q


def _references(ts: Tokens) -> list[tuple[str, str]]:
    return [(m[1], m[2]) for m in (_REFERENCE.fullmatch(t) for t in ts) if m]


def _owners(ts: Tokens) -> set[str]:
    return {a for a, _ in _references(ts)}


def _column(ts: Tokens) -> tuple[str, str] | None:
    found = _references(ts) if len(ts) == 1 else []
    return found[0] if found else None


def _render(ts: Tokens, name: Callable[[str, str], str]) -> Column:
    """Tokens as a column; references are named by ``name``."""
    return F.expr(" ".join(f"`{name(*m.groups())}`" if (m := _REFERENCE.fullmatch(t)) else t for t in ts))


def _resolved(q: Query, tables: dict[str, DataFrame]) -> Query:
    """Bare column names get their relation; names of items stay as they are in ORDER BY and HAVING."""
    columns = {a: {c.lower() for c in tables[t].columns} for a, t in q.tables.items()}
    aliases = {alias.lower() for _, alias in q.items}

    def full(ts: Tokens, keep: bool = False) -> Tokens:
        out = []
        for i, t in enumerate(ts):
            bare = _NAME.fullmatch(t) and t.lower() not in _WORDS and not (i + 1 < len(ts) and ts[i + 1] == "(")
            if bare and not (keep and t.lower() in aliases):
                holders = [a for a, cs in columns.items() if t.lower() in cs]
                if len(holders) != 1:
                    raise Unsupported(f"whose column is {t}?")
                t = f"{holders[0]}.{t}"
            out.append(t)
        return out

    return Query([(full(e), n) for e, n in q.items], q.tables, [full(w) for w in q.where], q.distinct, [full(g) for g in q.group], [full(h, True) for h in q.having], [(full(e, True), d) for e, d in q.order], q.limit)


def _terms(ts: Tokens) -> list[tuple[str, Tokens]] | None:
    """Signed terms of a sum; None for an expression that starts with a sign."""
    parts = _split(ts, {"+", "-"})
    if not all(p for _, p in parts):
        return None
    return [(sign or "+", p) for sign, p in parts]


def _plain(ts: Tokens) -> bool:
    """Whether an expression is arithmetic alone at its outermost level."""
    return not any(t.lower() in ("and", "or", "not", "between", "in", "like", "is", "case") or t in ("<", ">", "=", "<=", ">=", "<>", "!=", "||", ",") for t in ts)


class Planner:
    """A query over given tables: its variables, relations and join tree."""

    def __init__(self, q: Query, tables: dict[str, DataFrame]):
        self.q, self.tables = q, tables
        self.frames = {a: tables[t] for a, t in q.tables.items()}
        self.theta: list[tuple[str, str, str, str, str]] = []
        self.rest: list[Tokens] = []
        equal: list[tuple[tuple[str, str], tuple[str, str]]] = []
        self.extra: dict[str, dict[str, Column]] = {a: {} for a in q.tables}
        own: dict[str, list[Tokens]] = {a: [] for a in q.tables}
        for w in q.where:
            owners = _owners(w)
            sides = _split(w, {"=", *_COMPARE, "<>", "!="})
            if len(owners) == 1:
                own[owners.pop()].append(w)
                continue
            if len(sides) == 2 and sides[1][0] == "=" and _column(sides[0][1]) and _column(sides[1][1]):
                equal.append((_column(sides[0][1]), _column(sides[1][1])))
            elif len(sides) == 2 and sides[1][0] in _COMPARE and _plain(sides[0][1]) and _plain(sides[1][1]) and all(len(_owners(s)) == 1 for _, s in sides) and len(owners) == 2:
                ends = []
                for _, s in sides:
                    (a,) = _owners(s)
                    ends += [a, self._computed(a, s)]
                self.theta.append((ends[0], ends[1], sides[1][0], ends[2], ends[3]))
            else:
                self.rest.append(w)
        for a, conditions in own.items():
            for w in conditions:
                self.frames[a] = self.frames[a].where(_render(w, lambda _, c: c))
        root: dict[tuple[str, str], tuple[str, str]] = {}

        def find(x: tuple[str, str]) -> tuple[str, str]:
            while root.get(x, x) != x:
                x = root[x]
            return x

        for x, y in equal:
            if find(x) != find(y):
                root[find(y)] = find(x)
        self.joined = [x for pair in equal for x in pair]
        self._find = find

    def variable(self, a: str, c: str) -> str:
        return "_".join(self._find((a, c)))

    def _computed(self, a: str, ts: Tokens) -> str:
        """A column of the relation that holds an expression of it."""
        name = f"_x{sum(map(len, self.extra.values()))}"
        self.extra[a][name] = _render(ts, lambda _, c: c)
        return name

    def relations(self, used: list[tuple[str, str]], weights: dict[str, Column] | None = None, times=ADD) -> list[Relation]:
        out = []
        for a, df in self.frames.items():
            columns: dict[str, Column] = {}
            for x in dict.fromkeys([*[u for u in used if u[0] == a], *[j for j in self.joined if j[0] == a]]):
                v = self.variable(*x)
                if v in columns:  # two columns of the relation are equal to the same one of another
                    df = df.where(columns[v] == F.col(x[1]))
                else:
                    columns[v] = F.col(x[1])
            columns |= self.extra[a]
            weight = (weights or {}).get(a)
            out.append(Relation.of(a, df, columns, F.lit(times.zero).cast("long") if weight is None else weight))
        return out

    def tree(self, relations: list[Relation], root: str | None = None, times=ADD) -> JoinTree:
        try:
            return acyclic(relations, root, times)
        except ValueError as e:
            raise Unsupported(str(e)) from e

    def _sum(self, ts: Tokens) -> dict[str, list[str]] | None:
        """A sum as the signed terms of each relation."""
        terms = _terms(ts)
        if not terms or not _plain(ts):
            return None
        out: dict[str, list[str]] = {}
        loose: list[str] = []
        for sign, t in terms:
            owners = _owners(t)
            if len(owners) > 1:
                return None
            (out.setdefault(owners.pop(), []) if owners else loose).append(f"{sign} {' '.join(t)}")
        if not out:
            return None
        next(iter(out.values())).extend(loose)
        return out

    def ranking(self) -> tuple[dict[str, Column], object] | None:
        """Each relation's weight and how they join, if the first order key ranks that way."""
        q = self.q
        if not q.order or not q.limit or q.group or q.having or q.distinct or self.theta or self.rest or any(self._folds(e) for e, _ in q.items):
            return None
        key = self._item(q.order[0][0])
        as_column = lambda text: _render(tokens(text), lambda _, c: c)
        found = self._sum(key)
        if found:
            return {a: as_column("0 " + " ".join(ts)) for a, ts in found.items()}, ADD
        factors = _split(key, {"*"})
        if _plain(key) and len(factors) > 1 and all(p and len(_owners(p)) == 1 for _, p in factors) and not any(t in ("+", "-", "/", "%") for s in factors for t in s[1]):
            of: dict[str, list[str]] = {}
            for _, p in factors:
                of.setdefault(_owners(p).pop(), []).append(" ".join(p))
            weights = {a: as_column(" * ".join(ts)) for a, ts in of.items()}
            # bounds of products need weights of at least 0
            if all((self.frames[a].agg(F.min(w)).first()[0] or 0) >= 0 for a, w in weights.items()):
                return weights, MUL
        return None

    def _item(self, ts: Tokens) -> Tokens:
        """An order key or condition that names an item, as the item's expression."""
        if len(ts) == 1:
            return next((e for e, n in self.q.items if n.lower() == ts[0].lower()), ts)
        return ts

    @staticmethod
    def _folds(ts: Tokens) -> list[tuple[int, int]]:
        """Where aggregate calls begin and end."""
        out, at = [], 0
        while at < len(ts):
            if ts[at].lower() in _FOLDS and ts[at + 1 : at + 2] == ["("]:
                depth, end = 1, at + 2
                while end < len(ts) and depth:
                    depth += (ts[end] == "(") - (ts[end] == ")")
                    end += 1
                out.append((at, end))
                at = end
            else:
                at += 1
        return out

    # the ways to answer

    def ranked(self, method: str, base: int) -> DataFrame | None:
        found = self.ranking()
        if not found:
            return None
        q, (weights, times) = self.q, found
        key, descending = q.order[0]
        score = self._item(key)
        others = [(self._item(e), d) for e, d in q.order[1:]]
        used = [r for e, _ in [*q.items, *others] if e != score for r in _references(e)]
        relations = self.relations(used, weights, times)
        tree = self.tree(relations, times=times)
        if len(tree.nodes) < len(relations):  # bags are not joined anew for each step
            tree = written(tree)
        ranking = Ranking(times, MAX if descending else MIN)
        best = {"product_k": product_k, "level_k": lambda t, k, r, s: level_k(t, k, base, r, s), "naive": naive}[method](tree, q.limit, ranking, "_score")
        if others:
            worst = F.min if ranking.largest else F.max
            bar = best.agg(F.when(F.count(F.lit(1)) >= q.limit, worst("_score")))
            best = reaching(tree, bar, ranking, "_score")
            keys = [ranking.order("_score"), *[(F.desc if d else F.asc)(_render(e, self.variable)) if e != score else ranking.order("_score") for e, d in others], *tree.variables]
            best = best.orderBy(*keys).limit(q.limit)
        return best.select(*[(F.col("_score") if e == score else _render(e, self.variable)).alias(n) for e, n in q.items])

    def _measure(self, call: Tokens) -> tuple[list[Measure], Callable[[list[Column]], Column], str | None]:
        """An aggregate call as measures, how they give its value, and the variable whose values it counts."""
        fold, inner = call[0].lower(), call[2:-1]
        as_column = lambda text: _render(tokens(text), lambda _, c: c)
        if fold == "count" and inner == ["*"]:
            return [Measure("COUNT")], lambda m: m[0], None
        if inner and inner[0].lower() == "distinct":
            column = _column(inner[1:])
            if fold != "count" or not column:
                raise LookupError
            return [], lambda m: m[0], self.variable(*column)
        if not inner or self._folds(inner):
            raise LookupError
        if len(_owners(inner)) == 1:
            (a,) = _owners(inner)
            value = {a: as_column(" ".join(inner))}
            terms = [value]
            parts = value
        else:
            if not _plain(inner):
                raise LookupError
            parts_of = self._sum(inner)
            if parts_of:
                parts = {a: as_column("0 " + " ".join(ts)) for a, ts in parts_of.items()}
                terms = [{a: c} for a, c in parts.items()]
            else:
                factors = _split(inner, {"*"})
                if fold in ("min", "max") or not all(p and len(_owners(p)) == 1 for _, p in factors) or any(t in ("/", "%", "+", "-") for t in inner):
                    raise LookupError
                of: dict[str, list[str]] = {}
                for _, p in factors:
                    of.setdefault(_owners(p).pop(), []).append(" ".join(p))
                parts = {a: as_column(" * ".join(ts)) for a, ts in of.items()}
                terms = [parts]
        there = {a: F.when(c.isNotNull(), F.lit(1).cast("long")) for a, c in parts.items()}
        if fold in ("min", "max"):
            return [Measure(fold.upper(), parts)], lambda m: m[0], None
        count = Measure("SUM", there)
        if fold == "count":
            return [count], lambda m: F.coalesce(m[0], F.lit(0).cast("long")), None
        # a term counts only where all others are there
        sums = [Measure("SUM", {**there, **t}) for t in terms]
        total = lambda m: sum(m[1 : len(sums)], m[0])
        if fold == "sum":
            return sums, total, None
        return [*sums, count], lambda m: total(m) / m[-1], None

    def aggregated(self) -> DataFrame | None:
        """Aggregates and distinct columns below the join; None if the query needs the joined rows."""
        q = self.q
        asked = [e for e, _ in q.items] + q.having + [self._item(e) for e, _ in q.order]
        calls = [tuple(e[a:b]) for e in asked for a, b in self._folds(e)]
        if not calls and not q.group and not q.distinct:
            return None
        group = q.group or ([e for e, _ in q.items] if q.distinct and not calls else [])
        if self.theta or self.rest or not all(_column(g) for g in group):
            return None
        keys = list(dict.fromkeys(self.variable(*_column(g)) for g in group))
        measures: list[Measure] = []
        values: dict[tuple, Callable[[list[Column]], Column]] = {}
        counted: list[str] = []
        places: dict[tuple, list[int]] = {}
        used = [_column(g) for g in group]
        try:
            for call in dict.fromkeys(calls):
                found, values[call], of = self._measure(list(call))
                if of:
                    counted.append(of)
                    used += _references(list(call))
                    values[call] = lambda m, of=of: F.count_distinct(F.col(of))
                places[call] = list(range(len(measures), len(measures) + len(found)))
                measures += found
        except LookupError:
            return None
        relations = self.relations(used)
        # factors are computed where their relation is scanned
        for i, m in enumerate(measures):
            for a, c in m.factors.items():
                self.extra[a][f"_m{i}"] = c
        relations = self.relations(used)
        named = [Measure(m.fold, {a: F.col(f"_m{i}") for a in m.factors}) for i, m in enumerate(measures)]
        tree = self.tree(relations, next((a for a, _ in used), None))
        below = measured(tree, list(dict.fromkeys([*keys, *counted])), named)
        outer = []
        for i, m in enumerate(measures):
            again = {"MIN": F.min, "MAX": F.max}.get(m.fold, F.sum)(f"_v{i}")
            outer.append(F.coalesce(again, F.lit(0).cast("long")) if m.fold == "COUNT" else again)
        if counted:
            done = below.groupBy(*keys).agg(*[values[c]([outer[p] for p in places[c]]).alias(f"_f{i}") for i, c in enumerate(values)]) if calls else below
        else:
            have = [F.col(f"_v{i}") for i in range(len(measures))]
            done = below.select(*keys, *[values[c]([have[p] for p in places[c]]).alias(f"_f{i}") for i, c in enumerate(values)])
        number = {c: i for i, c in enumerate(values)}

        def over(ts: Tokens) -> Column:
            out, at = [], 0
            for a, b in self._folds(ts):
                out += [*ts[at:a], f"_f{number[tuple(ts[a:b])]}"]
                at = b
            return _render([*out, *ts[at:]], self.variable)

        grouped = set(keys)
        if any(self.variable(*r) not in grouped for e in asked for r in _references([t for i, t in enumerate(e) if not any(a <= i < b for a, b in self._folds(e))])):
            raise Unsupported("a column is neither grouped nor aggregated")
        for h in q.having:
            done = done.where(over([t for x in h for t in (self._item([x]) if _NAME.fullmatch(x) else [x])]))
        found = self._ordered(done, over)
        return found.distinct() if q.distinct and calls and not q.order else found

    def _ordered(self, df: DataFrame, over: Callable[[Tokens], Column]) -> DataFrame:
        """Items, order and limit over joined or grouped rows; ties go by the items."""
        q = self.q
        keys = {f"_o{i}": over(self._item(e)) for i, (e, _) in enumerate(q.order)}
        out = df.select(*[over(e).alias(n) for e, n in q.items], *[c.alias(n) for n, c in keys.items()])
        if q.order:
            out = out.orderBy(*[(F.desc if d else F.asc)(n) for n, (_, d) in zip(keys, q.order, strict=True)], *[F.col(f"`{n}`") for _, n in q.items])
        if q.limit is not None:
            out = out.limit(q.limit)
        return out.drop(*keys)

    def enumerated(self) -> DataFrame:
        q = self.q
        every = [*[e for e, _ in q.items], *q.group, *q.having, *[self._item(e) for e, _ in q.order], *self.rest]
        tree = self.tree(self.relations(list(dict.fromkeys(r for e in every for r in _references(e)))))
        rows = theta_join(tree, self.theta) if self.theta else enumerate_join(semi_reduce(tree), weights=False)
        for w in self.rest:
            rows = rows.where(_render(w, self.variable))
        over = lambda ts: _render(ts, self.variable)
        calls = [tuple(e[a:b]) for e in every for a, b in self._folds(e)]
        if calls or q.group:
            number = {c: f"_f{i}" for i, c in enumerate(dict.fromkeys(calls))}
            keys = {f"_k{i}": over(g) for i, g in enumerate(q.group)}
            of_key = {tuple(g): k for g, k in zip(q.group, keys, strict=True)}
            grouped = rows.groupBy(*[c.alias(k) for k, c in keys.items()]).agg(*([over(list(c)).alias(n) for c, n in number.items()] or [F.count(F.lit(1)).alias("_n")]))

            def over(ts: Tokens) -> Column:  # noqa: F811
                if tuple(ts) in of_key:
                    return F.col(of_key[tuple(ts)])
                out, at = [], 0
                for a, b in self._folds(ts):
                    out += [*ts[at:a], number[tuple(ts[a:b])]]
                    at = b
                out += ts[at:]
                if any((t,) not in of_key for t in out if _REFERENCE.fullmatch(t)):
                    raise Unsupported("a column is neither grouped nor aggregated")
                return F.expr(" ".join(of_key.get((t,), t) for t in out))

            rows = grouped
            for h in q.having:
                rows = rows.where(over([t for x in h for t in (self._item([x]) if _NAME.fullmatch(x) else [x])]))
        elif q.having:
            raise Unsupported("HAVING without groups")
        if q.distinct:
            shown = rows.select(*[over(e).alias(n) for e, n in q.items]).distinct()
            by = []
            for e, d in q.order:
                name = next((n for i, n in q.items if i == self._item(e) or [n.lower()] == [t.lower() for t in e]), None)
                if name is None:
                    raise Unsupported("an order key isn't among the distinct items")
                by.append((F.desc if d else F.asc)(f"`{name}`"))
            shown = shown.orderBy(*by, *[F.col(f"`{n}`") for _, n in q.items]) if by else shown
            return shown.limit(q.limit) if q.limit is not None else shown
        return self._ordered(rows, over)


def run(spark: SparkSession, sql: str, tables: dict[str, DataFrame], method: str = "product_k", base: int = 32) -> DataFrame:
    """The query's result; ``method`` is product_k, level_k or naive."""
    try:
        q = _resolved(parse(sql), tables)
        planned = Planner(q, tables).ranked(method, base)
        if planned is None:
            planned = Planner(q, tables).aggregated()
        return Planner(q, tables).enumerated() if planned is None else planned
    except Unsupported:
        for name, df in tables.items():
            df.createOrReplaceTempView(name)
        return spark.sql(sql)
