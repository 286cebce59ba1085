"""Registered queries of the ranked-join engine and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalar
from .ml import regression
from .operators import joins, ranked, segmented, setops, table
from .plans import reducer
from .plans import sql as ranked_sql
from .plans.eager import Aggregate, aggregate_join, top_k
from .plans.jointree import JoinTree, Relation, fork, line, star
from .plans.semiring import ADD, MAX, MIN, MUL, Ranking
from .plans.topk import Reduced, checksum, digest, level_k, naive, product_k, projected_k, truncate_child
from .sources.graph import lineitem_graph

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

K = 1024
EDGES = """graph AS (SELECT src, dst, (172475 * src + 8203 * dst + 308407) % 400009 AS rating
    FROM (SELECT DISTINCT l_orderkey AS src, l_partkey AS dst FROM lineitem))"""


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineitem_graph(_read(spark, sf_dir, "lineitem"))


def _register(name: str, sql: str | None = None, edges: bool = True):
    def add(function: Callable[..., DataFrame]):
        QUERIES[name] = function
        if sql is not None:
            ORACLE_SQL[name] = f"WITH {EDGES} {sql}" if edges else sql
        return function

    return add


def _on_graph(name: str, function: Callable[[DataFrame], DataFrame], sql: str | None = None) -> None:
    """Registers a query of the edge relation."""
    _register(name, sql)(lambda spark, sf_dir: function(_graph(spark, sf_dir)))


def cents(c: str):
    return F.round(F.col(c) * 100).cast("long")


# Top-k over joins: each shape by the naive plan, product-k and level-k.

def _joined_sql(edges: list[tuple[str, str]], times: str = "+") -> tuple[str, str]:
    """The whole join of edges (their ends named by variables) as SQL, and its order of columns."""
    seen: dict[str, str] = {}
    source = ""
    for i, ends in enumerate(edges, 1):
        met = [f"{seen[v]} = e{i}.{c}" for v, c in zip(ends, ("src", "dst"), strict=True) if v in seen]
        source += f" JOIN {{graph}} e{i} ON {' AND '.join(met)}" if met else f"{{graph}} e{i}"
        for v, c in zip(ends, ("src", "dst"), strict=True):
            seen.setdefault(v, f"e{i}.{c}")
    columns = ", ".join(f"{c} AS {v}" for v, c in seen.items())
    score = f" {times} ".join(f"e{i}.rating" for i in range(1, len(edges) + 1))
    return f"SELECT {columns}, {score} AS score FROM {source}", ", ".join(seen)


SHAPES: dict[str, tuple[Callable[[DataFrame], JoinTree], list[tuple[str, str]]]] = {
    **{f"l{n}": (lambda g, n=n: line(g, n), [(f"node{i}", f"node{i + 1}") for i in range(1, n + 1)]) for n in (2, 3, 4)},
    "star": (lambda g: star(g, 3), [("node1", f"node{i}") for i in (2, 3, 4)]),
    "tree": (fork, [("mid", "\"end\""), ("hub", "mid"), ("hub", "\"left\""), ("hub", "\"right\"")]),
}


def _top(shape: str, k: int, descending: bool = True, times: str = "+", graph: str = "graph") -> str:
    sql, order = _joined_sql(SHAPES[shape][1], times)
    return f"{sql.replace('{graph}', graph)} ORDER BY score {'DESC' if descending else 'ASC'}, {order} LIMIT {k}"


for _shape, (_build, _) in SHAPES.items():
    _on_graph(f"topk_{_shape}_naive", lambda g, b=_build: naive(b(g), K), _top(_shape, K))
    _on_graph(f"topk_{_shape}_product_k", lambda g, b=_build: product_k(b(g), K), _top(_shape, K))
    _on_graph(f"topk_{_shape}_level_k", lambda g, b=_build: level_k(b(g), K, 32), _top(_shape, K))
    _on_graph(f"topk_{_shape}_ascending", lambda g, b=_build: product_k(b(g), 100, Ranking(ADD, MIN)), _top(_shape, 100, False))

for _shape in ("l2", "l4"):
    _on_graph(f"topk_{_shape}_auto", lambda g, b=SHAPES[_shape][0]: top_k(b(g), K), _top(_shape, K))
for _base in (8, 16, 64):
    _on_graph(f"topk_l4_level_k_base{_base}", lambda g, b=_base: level_k(line(g, 4), K, b), _top("l4", K))
for _k, _base in ((8, 4), (64, 32), (256, 32), (4096, 32), (16384, 32), (32768, 32)):
    _on_graph(f"topk_l3_k{_k}_product_k", lambda g, k=_k: product_k(line(g, 3), k), _top("l3", _k))
    _on_graph(f"topk_l3_k{_k}_level_k", lambda g, k=_k, b=_base: level_k(line(g, 3), k, b), _top("l3", _k))

for _best in (MAX, MIN):
    _on_graph(
        f"topk_l3_mul_{_best.name.lower()}",
        lambda g, b=_best: product_k(line(g.withColumn("rating", F.col("rating") % 1000), 3), 200, Ranking(MUL, b)),
        f", small AS (SELECT src, dst, rating % 1000 AS rating FROM graph) {_top('l3', 200, _best is MAX, '*', 'small')}",
    )

_on_graph(
    "topk_l3_projected",
    lambda g: projected_k(line(g, 3), ["node2", "node3", "node4"], K),
    f"SELECT node2, node3, node4, max(score) AS score FROM ({_joined_sql(SHAPES['l3'][1])[0].replace('{graph}', 'graph')}) GROUP BY ALL ORDER BY score DESC, node2, node3, node4 LIMIT {K}",
)
_on_graph("topk_digest", lambda g: digest(product_k(line(g, 4), K)), f"SELECT min(score) AS min_score, max(score) AS max_score, sum(score)::BIGINT AS sum_score, count(*) AS n FROM ({_top('l4', K)})")
_on_graph("topk_checksum", lambda g: checksum(level_k(line(g, 2), K), ["node1", "node2", "node3", "score"]), f"SELECT sum(node1 + node2 + node3 + score)::BIGINT AS checksum FROM ({_top('l2', K)})")


def _market(spark: SparkSession, sf_dir: str) -> JoinTree:
    c = Relation.of("customer", _read(spark, sf_dir, "customer"), {"c_custkey": "c_custkey"}, cents("c_acctbal"))
    o = Relation.of("orders", _read(spark, sf_dir, "orders"), {"c_custkey": "o_custkey", "o_orderkey": "o_orderkey"}, cents("o_totalprice"))
    li = Relation.of("lineitem", _read(spark, sf_dir, "lineitem"), {"o_orderkey": "l_orderkey", "p_partkey": "l_partkey"}, cents("l_extendedprice"))
    p = Relation.of("part", _read(spark, sf_dir, "part"), {"p_partkey": "p_partkey"}, cents("p_retailprice"))
    return JoinTree.build([c, o, li, p], "customer")


_MARKET = """SELECT c_custkey, o_orderkey, p_partkey, CAST(round(c_acctbal * 100) AS BIGINT) + CAST(round(o_totalprice * 100) AS BIGINT) + CAST(round(l_extendedprice * 100) AS BIGINT) + CAST(round(p_retailprice * 100) AS BIGINT) AS score
    FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey ORDER BY score DESC, c_custkey, o_orderkey, p_partkey LIMIT 500"""
_register("topk_market_product_k", _MARKET, edges=False)(lambda spark, sf_dir: product_k(_market(spark, sf_dir), 500))
_register("topk_market_level_k", _MARKET, edges=False)(lambda spark, sf_dir: level_k(_market(spark, sf_dir), 500, 16))


def _sql(name: str, sql: str, method: str = "product_k", oracle: str | None = None) -> None:
    _register(name, oracle or sql)(lambda spark, sf_dir: ranked_sql.run(spark, sql, {"graph": _graph(spark, sf_dir)}, method))


_SQL_L3 = "SELECT R.src AS n1, S.src AS n2, T.src AS n3, T.dst AS n4, R.rating + S.rating + T.rating AS total FROM graph R, graph S, graph T WHERE R.dst = S.src AND S.dst = T.src ORDER BY total DESC LIMIT 300"
for _method in ("product_k", "level_k", "naive"):
    _sql(f"sql_topk_{_method}", _SQL_L3, _method, _SQL_L3.replace("total DESC", "total DESC, n1, n2, n3, n4"))
_sql("sql_filtered", "SELECT R.src AS a, S.src AS b, S.dst AS c, R.rating + S.rating AS total FROM graph R, graph S WHERE R.dst = S.src AND R.rating < 200000 AND S.dst IN (1, 2, 3, 5, 8, 13, 21, 34) ORDER BY total ASC LIMIT 50", "product_k", "SELECT R.src AS a, S.src AS b, S.dst AS c, R.rating + S.rating AS total FROM graph R, graph S WHERE R.dst = S.src AND R.rating < 200000 AND S.dst IN (1, 2, 3, 5, 8, 13, 21, 34) ORDER BY total ASC, a, b, c LIMIT 50")
_sql("sql_theta", "SELECT R.src AS a, S.src AS b, T.src AS c, T.dst AS d FROM graph R, graph S, graph T WHERE R.dst = S.src AND S.dst = T.src AND R.rating < T.rating")
_sql("sql_aggregate", "SELECT R.src AS a, count(*) AS n, sum(S.rating) AS total, max(T.rating) AS top, min(R.rating) AS low, avg(T.rating) AS mean FROM graph R, graph S, graph T WHERE R.dst = S.src AND S.dst = T.src GROUP BY R.src", "product_k", "SELECT R.src AS a, count(*) AS n, sum(S.rating)::BIGINT AS total, max(T.rating) AS top, min(R.rating) AS low, avg(T.rating) AS mean FROM graph R, graph S, graph T WHERE R.dst = S.src AND S.dst = T.src GROUP BY R.src")
_sql("sql_cyclic", "SELECT R.src AS a, S.src AS b, T.src AS c FROM graph R, graph S, graph T WHERE R.dst = S.src AND S.dst = T.src AND T.dst = R.src")

_L2, _L4 = "FROM graph R, graph S WHERE R.dst = S.src", "FROM graph R, graph S, graph T, graph U WHERE R.dst = S.src AND S.dst = T.src AND T.dst = U.src"
_L3_FROM = "FROM graph R, graph S, graph T WHERE R.dst = S.src AND S.dst = T.src"
_sql("sql_having", f"SELECT R.src AS a, count(*) AS n, sum(S.rating) AS total {_L2} GROUP BY R.src HAVING count(*) >= 2 AND max(S.rating) > 100000", oracle=f"SELECT R.src AS a, count(*) AS n, sum(S.rating)::BIGINT AS total {_L2} GROUP BY R.src HAVING count(*) >= 2 AND max(S.rating) > 100000")
_sql("sql_order_two", f"SELECT R.src AS a, S.src AS b, S.dst AS c, R.rating % 10 + S.rating % 10 AS total {_L2} ORDER BY total DESC, c DESC, a, b LIMIT 200")
_sql("sql_distinct", f"SELECT DISTINCT R.src AS a, T.dst AS d {_L3_FROM}")
_sql("sql_between", f"SELECT R.src AS a, S.dst AS c {_L2} AND R.rating BETWEEN 1000 AND 150000 AND (S.rating > 300000 OR S.dst IN (1, 2, 3))")
_sql("sql_formula", f"SELECT R.src % 7 AS a, count(DISTINCT S.src) AS n, sum(R.rating * 2 - S.rating) AS total {_L2} GROUP BY R.src % 7", oracle=f"SELECT R.src % 7 AS a, count(DISTINCT S.src) AS n, sum(R.rating * 2 - S.rating)::BIGINT AS total {_L2} GROUP BY R.src % 7")
_sql("sql_group_many", f"SELECT R.src AS a, T.src AS c, count(*) AS n, sum(R.rating % 100 * (T.rating % 100) + S.rating % 10) AS total, max(R.rating - T.rating) AS top {_L3_FROM} GROUP BY R.src, T.src", oracle=f"SELECT R.src AS a, T.src AS c, count(*) AS n, sum((R.rating % 100) * (T.rating % 100) + S.rating % 10)::BIGINT AS total, max(R.rating - T.rating) AS top {_L3_FROM} GROUP BY R.src, T.src")
_sql("sql_theta_four", f"SELECT R.src AS a, S.src AS b, T.src AS c, U.src AS d, U.dst AS e {_L4} AND R.rating < U.rating AND S.rating >= T.rating + 50000")
_sql("sql_cyclic_topk", f"SELECT R.src AS a, S.src AS b, T.src AS c, R.rating + S.rating + T.rating AS total {_L3_FROM} AND T.dst = R.src ORDER BY total DESC, a, b, c LIMIT 100")
_sql("sql_cycle_four", f"SELECT R.src AS a, S.src AS b, T.src AS c, U.src AS d, R.rating + S.rating + T.rating + U.rating AS total {_L4} AND U.dst = R.src ORDER BY total, a, b, c, d LIMIT 50")
_sql("sql_subquery", "SELECT g.src AS a, g.dst AS b FROM graph g WHERE g.src IN (SELECT dst FROM graph)")
for _method, _name in ((product_k, "product_k"), (level_k, "level_k")):
    _on_graph(f"topk_ties_{_name}", lambda g, m=_method: m(line(g.withColumn("rating", F.lit(1).cast("long")), 3), 100), f", ties AS (SELECT src, dst, CAST(1 AS BIGINT) AS rating FROM graph) {_top('l3', 100, True, '+', 'ties')}")
_on_graph(
    "topk_l3_ends",
    lambda g: projected_k(line(g, 3), ["node1", "node4"], K),
    f"SELECT node1, node4, max(score) AS score FROM ({_joined_sql(SHAPES['l3'][1])[0].replace('{graph}', 'graph')}) GROUP BY ALL ORDER BY score DESC, node1, node4 LIMIT {K}",
)

_BOUNDS = "ends AS (SELECT src, max(rating) AS m FROM graph GROUP BY src)"
_on_graph("suffix_bounds", lambda g: Reduced(line(g, 2), Ranking()).frames["E1"].select("node1", "node2", "w", "bound"), f", {_BOUNDS} SELECT g.src AS node1, g.dst AS node2, g.rating AS w, g.rating + m AS bound FROM graph g JOIN ends ON g.dst = ends.src")
_on_graph(
    "truncate_next",
    lambda g: truncate_child(g.select(F.col("dst").alias("node2"), F.col("rating").alias("acc")), Reduced(line(g, 2), Ranking()).frames["E2"], ["node2"], F.col("acc"), 50, Ranking()).select("node2", "node3", "w"),
    """SELECT node2, node3, w FROM (SELECT g.src AS node2, g.dst AS node3, g.rating AS w, rank() OVER (ORDER BY b + g.rating DESC) AS p
        FROM graph g JOIN (SELECT dst AS k, max(rating) AS b FROM graph GROUP BY dst) ON g.src = k) WHERE p <= 50""",
)

# Aggregation, reduction, inequalities

_on_graph(
    "eager_aggregate",
    lambda g: aggregate_join(star(g, 3), ["node1"], [Aggregate("COUNT", "n"), Aggregate("SUM", "s", "E2"), Aggregate("MIN", "low", "E3"), Aggregate("MAX", "high", "E1"), Aggregate("AVG", "mean", "E3")]),
    "SELECT R.src AS node1, count(*) AS n, sum(S.rating)::BIGINT AS s, min(T.rating) AS low, max(R.rating) AS high, avg(T.rating) AS mean FROM graph R, graph S, graph T WHERE R.src = S.src AND R.src = T.src GROUP BY 1",
)
_on_graph("eager_count", lambda g: aggregate_join(line(g, 4), [], [Aggregate("COUNT", "n"), Aggregate("SUM", "s", "E4")]), "SELECT count(*) AS n, sum(U.rating)::BIGINT AS s FROM graph R, graph S, graph T, graph U WHERE R.dst = S.src AND S.dst = T.src AND T.dst = U.src")
_on_graph("semi_reduce", lambda g: reducer.semi_reduce(line(g, 3)).nodes[1].relation.frame.select("node2", "node3"), "SELECT S.src AS node2, S.dst AS node3 FROM graph S WHERE S.src IN (SELECT dst FROM graph) AND S.dst IN (SELECT src FROM graph)")
_on_graph("enumerate_full", lambda g: reducer.enumerate_join(reducer.semi_reduce(line(g, 3)), weights=False), "SELECT R.src AS node1, S.src AS node2, T.src AS node3, T.dst AS node4 FROM graph R, graph S, graph T WHERE R.dst = S.src AND S.dst = T.src")
_on_graph("count_distinct_ends", lambda g: reducer.enumerate_join(line(g, 2), weights=False).agg(F.count_distinct("node1", "node3").alias("n")), "SELECT count(*) AS n FROM (SELECT DISTINCT R.src, S.dst FROM graph R, graph S WHERE R.dst = S.src)")


def _ends(g: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    return g.toDF("a", "b", "wr"), g.toDF("b", "c", "ws").drop("ws"), g.toDF("c", "d", "wt")


for _name, _op in (("lt", "<"), ("le", "<="), ("gt", ">"), ("ge", ">=")):
    _on_graph(
        f"theta_path_{_name}",
        lambda g, op=_op: reducer.theta_path(*_ends(g), "b", "c", "wr", op, "wt").select("a", "b", "c", "d"),
        f"SELECT R.src AS a, S.src AS b, T.src AS c, T.dst AS d FROM graph R, graph S, graph T WHERE R.dst = S.src AND S.dst = T.src AND R.rating {_op} T.rating",
    )
_on_graph(
    "theta_edge",
    lambda g: reducer.theta_edge(g.toDF("a", "b", "wr"), g.toDF("b", "c", "ws"), ["b"], "wr", "<", "ws").select("a", "b", "c"),
    "SELECT R.src AS a, S.src AS b, S.dst AS c FROM graph R, graph S WHERE R.dst = S.src AND R.rating < S.rating",
)
_on_graph("ordered_view", lambda g: reducer.ordered_view(g, ["src"], "rating", True), "SELECT *, row_number() OVER (PARTITION BY src ORDER BY rating DESC, dst) AS rn FROM graph")
_on_graph("systematic_sample", lambda g: reducer.systematic_sample(reducer.ordered_view(g, ["src"], "rating"), 3), "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY rating, dst) AS rn FROM graph) WHERE rn % 3 = 1")


def _triangles(g: DataFrame) -> DataFrame:
    cycle = reducer.bag([Relation.of("R", g, {"a": "src", "b": "dst"}, "rating"), Relation.of("S", g, {"b": "src", "c": "dst"}, "rating"), Relation.of("T", g, {"c": "src", "a": "dst"}, "rating")], "cycle")
    return product_k(JoinTree.build([cycle, Relation.of("U", g, {"a": "src", "d": "dst"}, "rating")]), 100)


_on_graph("bag_cycle_topk", _triangles, "SELECT R.src AS a, R.dst AS b, S.dst AS c, U.dst AS d, R.rating + S.rating + T.rating + U.rating AS score FROM graph R, graph S, graph T, graph U WHERE R.dst = S.src AND S.dst = T.src AND T.dst = R.src AND U.src = R.src ORDER BY score DESC, a, b, c, d LIMIT 100")
_on_graph("auxiliary_view", lambda g: reducer.auxiliary(Relation.of("R", g, {"a": "src", "b": "dst"}, "rating"), ["a"], "aux", F.col("weight") >= 100000).frame, "SELECT DISTINCT src AS a, CAST(0 AS BIGINT) AS weight FROM graph WHERE rating >= 100000")
_on_graph("table_agg", lambda g: reducer.table_agg(g, g.select(F.col("src").alias("dst"), F.col("rating").alias("r")), ["dst"], {"n": F.count(F.lit(1)), "top": F.max("r")}).select("src", "dst", "n", "top"), "SELECT g.src, g.dst, n, top FROM graph g JOIN (SELECT src AS k, count(*) AS n, max(rating) AS top FROM graph GROUP BY src) ON g.dst = k")

# Table algebra

_on_graph("table_project", lambda g: table.project(g, [2, 0]), "SELECT rating, src FROM graph")
_on_graph("table_anti_project", lambda g: table.anti_project(g, [1]), "SELECT src, rating FROM graph")
_on_graph("table_append_copy", lambda g: table.copy_column(table.append_column(g, "one", 1), "src", "again"), "SELECT src, dst, rating, CAST(1 AS BIGINT) AS one, src AS again FROM graph")
_on_graph(
    "table_combine",
    lambda g: reduce(lambda df, x: table.combine_columns(df, "src", "dst", x[0], x[1]), [(ADD, "added"), (MUL, "times"), (MAX, "more"), (MIN, "less")], g),
    "SELECT src, dst, rating, src + dst AS added, src * dst AS times, greatest(src, dst) AS more, least(src, dst) AS less FROM graph",
)
_on_graph("table_filter", lambda g: table.select_rows(g, (F.col("rating") >= 100000) & ~F.col("src").isin(1, 2, 3)), "SELECT * FROM graph WHERE rating >= 100000 AND src NOT IN (1, 2, 3)")
_on_graph("table_suffix", lambda g: table.add_suffix(g, "_1"), "SELECT src AS src_1, dst AS dst_1, rating AS rating_1 FROM graph")
_on_graph("table_sort", lambda g: table.sort(g, ["rating", "src", "dst"], True).limit(500), "SELECT * FROM graph ORDER BY rating DESC, src DESC, dst DESC LIMIT 500")
_on_graph("table_select_k", lambda g: table.select_k(g, 100, ["rating"], True), "SELECT * FROM graph ORDER BY rating DESC, src, dst LIMIT 100")
_on_graph("table_select_k_ties", lambda g: table.select_k_with_ties(g.withColumn("rating", F.col("rating") % 50), 100, "rating", True), "SELECT src, dst, r AS rating FROM (SELECT src, dst, rating % 50 AS r, rank() OVER (ORDER BY rating % 50 DESC) AS p FROM graph) WHERE p <= 100")
_on_graph("table_kth", lambda g: table.kth_value(g, 77, "rating"), "SELECT min(rating) AS kth FROM (SELECT rating FROM graph ORDER BY rating DESC LIMIT 77)")
_on_graph("table_aggregate", lambda g: table.aggregate(g, ADD, "rating", "total").crossJoin(table.aggregate(g, MAX, "rating", "top")).crossJoin(table.aggregate(g.where("false"), MIN, "rating", "none")), "SELECT sum(rating)::BIGINT AS total, max(rating) AS top, CAST(9223372036854775807 AS BIGINT) AS none FROM graph")
_on_graph("table_group_aggregate", lambda g: table.group_aggregate(g, ["src"], "rating", "total", ADD).join(table.group_aggregate(g, ["src"], "dst", "top", MAX), "src"), "SELECT src, sum(rating)::BIGINT AS total, max(dst) AS top FROM graph GROUP BY src")
_on_graph("table_group_product", lambda g: table.group_aggregate(g.withColumn("d", F.col("dst") % 3 + 1), ["src"], "d", "product", MUL), "SELECT src, CAST(round(product(dst % 3 + 1)) AS BIGINT) AS product FROM graph GROUP BY src")
_on_graph("table_union_all", lambda g: table.union_all(g, g.select("dst", "src", "rating")), "SELECT src, dst, rating FROM graph UNION ALL SELECT dst, src, rating FROM graph")
_register("table_cross", "SELECT r_regionkey, n_nationkey FROM region, nation", edges=False)(lambda spark, d: table.cross(_read(spark, d, "region").select("r_regionkey"), _read(spark, d, "nation").select("n_nationkey")))
_on_graph("table_join", lambda g: table.equi_join(g, [1], g.toDF("s2", "d2", "r2"), [0]), "SELECT R.src, R.dst, R.rating, S.dst AS d2, S.rating AS r2 FROM graph R JOIN graph S ON R.dst = S.src")
_on_graph("table_join_two_columns", lambda g: table.equi_join(g, [0, 1], g.toDF("s2", "d2", "r2"), [1, 0]), "SELECT R.src, R.dst, R.rating, S.rating AS r2 FROM graph R JOIN graph S ON R.src = S.dst AND R.dst = S.src")
_on_graph("table_semi_annotated_join", lambda g: table.semi_annotated_join(g, ["dst"], "rating", table.group_aggregate(g, ["src"], "rating", "best", MAX), ["src"], "best"), "SELECT g.src, g.dst, g.rating + best AS rating FROM graph g JOIN (SELECT src AS k, max(rating) AS best FROM graph GROUP BY src) ON g.dst = k")
_on_graph("table_hash", lambda g: table.table_hash(g), "SELECT bit_xor(CAST('0x' || substr(md5('=' || src || '|=' || dst || '|=' || rating), 1, 15) AS BIGINT)) AS hash FROM graph")
_on_graph("tuple_hash", lambda g: g.select("src", "dst", scalar.tuple_hash("src").alias("one"), scalar.tuple_hash("src", "dst").alias("two")), "SELECT src, dst, src AS one, src * 4294967296 + dst AS two FROM graph")
_on_graph("generated_weight", lambda g: g.select("src", "dst", scalar.generated_weight(F.col("src"), F.col("dst")).alias("rating")), "SELECT src, dst, rating FROM graph")

# Joins with flags, lookups, expansion

_register("left_join_flag", "SELECT c_custkey, CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) THEN 1 ELSE 0 END AS has_order FROM customer", edges=False)(
    lambda spark, d: joins.left_join_flag(_read(spark, d, "customer").select("c_custkey"), _read(spark, d, "orders"), "c_custkey", "o_custkey", "has_order")
)
_register("key_lookup", "SELECT o_orderkey, o_custkey, c_nationkey FROM orders LEFT JOIN customer ON o_custkey = c_custkey", edges=False)(
    lambda spark, d: joins.key_lookup(_read(spark, d, "orders").select("o_orderkey", "o_custkey"), _read(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), ["o_custkey"]).select("o_orderkey", "o_custkey", "c_nationkey")
)
_register("unique_join", "SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey", edges=False)(
    lambda spark, d: joins.unique_join(_read(spark, d, "supplier").withColumnRenamed("s_nationkey", "k"), _read(spark, d, "nation").withColumnRenamed("n_nationkey", "k"), ["k"], [F.col("s_suppkey"), F.col("n_name")])
)
_on_graph("many_to_many_join", lambda g: joins.many_to_many(g.toDF("a", "b", "x"), g.toDF("b", "c", "y"), ["b"]), "SELECT R.src AS a, R.dst AS b, R.rating AS x, S.dst AS c, S.rating AS y FROM graph R JOIN graph S ON R.dst = S.src")
_register("full_join", "SELECT coalesce(a.k, b.k) AS k, n, m FROM (SELECT s_suppkey AS k, count(*) AS n FROM supplier GROUP BY 1) a FULL JOIN (SELECT o_custkey AS k, max(o_orderkey) AS m FROM orders GROUP BY 1) b ON a.k = b.k", edges=False)(
    lambda spark, d: joins.full_join(_read(spark, d, "supplier").groupBy(F.col("s_suppkey").alias("k")).agg(F.count(F.lit(1)).alias("n")), _read(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_orderkey").alias("m")), ["k"])
)
_on_graph("semi_join_sum", lambda g: joins.semi_join_sum(g, g.select(F.col("src").alias("dst"), F.col("rating").alias("r")), ["dst"], "r", "below"), "SELECT g.src, g.dst, g.rating, coalesce(s, 0)::BIGINT AS below FROM graph g LEFT JOIN (SELECT src AS k, sum(rating) AS s FROM graph GROUP BY src) ON g.dst = k")
_on_graph("expand", lambda g: joins.expand(g.select("src", "dst", (F.col("rating") % 4).alias("degree")), "degree"), "SELECT src, dst, rating % 4 AS degree, unnest(range(1, rating % 4 + 1)) AS copy FROM graph")
_on_graph("expand_range", lambda g: joins.expand_range(g, 2, 4), "SELECT src, dst, rating, unnest([2, 3, 4])::BIGINT AS id FROM graph")


@_register(
    "registered_twice",
    """WITH d1 AS (SELECT c_custkey AS ssn, c_custkey * 10 + 1 AS na, c_nationkey AS ad, c_custkey IN (SELECT o_custkey FROM orders) AS reg FROM customer),
    d2 AS (SELECT s_suppkey AS ssn, s_suppkey * 10 + 2 AS na, s_nationkey AS ad, s_suppkey IN (SELECT l_suppkey FROM lineitem) AS reg FROM supplier)
    SELECT d1.ssn AS SSN, CASE WHEN (d1.reg AND d2.reg) OR (d1.ad < d2.ad AND d1.reg) THEN d1.na ELSE 0 END AS NA1, CASE WHEN (d1.reg AND d2.reg) OR (NOT d1.ad < d2.ad AND d2.reg) THEN d2.na ELSE 0 END AS NA2 FROM d1 JOIN d2 ON d1.ssn = d2.ssn""",
    edges=False,
)
def registered_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and suppliers as two states' registers, those with orders or line items as their voters."""
    one = _read(spark, sf_dir, "customer").select((F.col("c_custkey") * 10 + 1).alias("NA"), F.col("c_nationkey").alias("AD"), F.col("c_custkey").alias("DL"), F.col("c_custkey").alias("SSN"))
    two = _read(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 10 + 2).alias("NA"), F.col("s_nationkey").alias("AD"), F.col("s_suppkey").alias("DL"), F.col("s_suppkey").alias("SSN"))
    return joins.registered_twice(one, _read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("DL")), two, _read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("DL")))


# Segments and windows

_on_graph("prefix_sum", lambda g: segmented.prefix_sum(g, "rating", ["src", "dst"], "running"), "SELECT src, dst, rating, sum(rating) OVER (ORDER BY src, dst ROWS UNBOUNDED PRECEDING)::BIGINT AS running FROM graph")
_on_graph("segmented_prefix_sum", lambda g: segmented.segmented_prefix_sum(g, ["src"], "rating", ["dst"], "running"), "SELECT src, dst, rating, sum(rating) OVER (PARTITION BY src ORDER BY dst ROWS UNBOUNDED PRECEDING)::BIGINT AS running FROM graph")
_on_graph("segmented_copy", lambda g: segmented.segmented_copy(g, ["src"], "rating", ["dst"], "head"), "SELECT src, dst, rating, first_value(rating) OVER (PARTITION BY src ORDER BY dst) AS head FROM graph")
_on_graph("neighbour_equal", lambda g: segmented.neighbour_equal(g, "src", ["dst"], "same"), "SELECT src, dst, rating, CAST(coalesce(lag(src) OVER (ORDER BY src, dst) = src, false) AS INT) AS same FROM graph")
_on_graph("unique_key_flag", lambda g: segmented.unique_key_flag(g, ["src"], ["rating", "dst"], "top"), "SELECT src, dst, rating, CAST(row_number() OVER (PARTITION BY src ORDER BY rating DESC, dst DESC) = 1 AS INT) AS top FROM graph")
_on_graph("rank_in_key", lambda g: segmented.rank_in_key(g, ["src"], [F.desc("rating"), "dst"], start=0), "SELECT src, dst, rating, CAST(row_number() OVER (PARTITION BY src ORDER BY rating DESC, dst) - 1 AS INT) AS rnk FROM graph")
_register("compact", "SELECT l_orderkey, CAST(round(l_discount * 100) AS BIGINT) AS discount FROM lineitem WHERE round(l_discount * 100) <> 0", edges=False)(
    lambda spark, d: segmented.compact(_read(spark, d, "lineitem").select("l_orderkey", cents("l_discount").alias("discount")), "discount")
)
_on_graph("fill_forward", lambda g: segmented.fill_forward(g.withColumn("mark", F.when(F.col("rating") % 4 == 0, F.col("rating"))), "mark", ["src"], ["dst"], "last_mark"), "SELECT *, last_value(mark IGNORE NULLS) OVER (PARTITION BY src ORDER BY dst ROWS UNBOUNDED PRECEDING) AS last_mark FROM (SELECT *, CASE WHEN rating % 4 = 0 THEN rating END AS mark FROM graph)")
_on_graph("pack_key", lambda g: g.select("src", "dst", segmented.pack_key(F.col("src"), F.col("dst")).alias("packed"), segmented.unpack_key(segmented.pack_key(F.col("src"), F.col("dst")))[1].alias("low")), "SELECT src, dst, src * 4294967296 + dst AS packed, dst AS low FROM graph")
_on_graph("alignment", lambda g: segmented.alignment(g.withColumn("degree", F.lit(2)), ["src"], ["dst"], "degree").select("src", "dst", "slot"), "SELECT src, dst, c * n + r AS slot FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) - 1 AS r, count(*) OVER (PARTITION BY src) AS n FROM graph), (SELECT unnest([0, 1]) AS c)")
_on_graph("permuted", lambda g: segmented.permuted(g, g.select(F.col("rating").alias("row_"), (-F.col("rating")).alias("place")).distinct().withColumnRenamed("row_", "rating"), "rating", "place"), "SELECT g.src, g.dst, g.rating, -g.rating AS place FROM graph g")
_on_graph("take_last", lambda g: segmented.take_last(segmented.append_tuples(g, g, ["src", "dst", "rating"]), 20, ["rating", "src", "dst"]), "SELECT * FROM (SELECT * FROM graph UNION ALL SELECT * FROM graph) ORDER BY rating DESC, src DESC, dst DESC LIMIT 20")
_on_graph("mask_and_mux", lambda g: g.select("src", "dst", scalar.mask(F.col("rating"), F.col("src")).alias("masked"), scalar.mux(F.col("src") < F.col("dst"), F.col("src"), F.col("dst")).alias("less")), "SELECT src, dst, CASE WHEN rating % 2 = 1 THEN src ELSE 0 END AS masked, least(src, dst) AS less FROM graph")
_on_graph("fixed_point", lambda g: g.select("src", "dst", scalar.fixed_multiply(scalar.fixed(F.col("src") / 8.0), scalar.fixed(F.col("dst") / 4.0)).alias("product")), "SELECT src, dst, src * dst * 2048 AS product FROM graph")
_on_graph("piecewise_sigmoid", lambda g: g.select("src", "dst", scalar.piecewise_sigmoid((F.col("src") - F.col("dst")) / 1024.0).alias("y")), "SELECT src, dst, CASE WHEN (src - dst) / 1024.0::DOUBLE < -0.5 THEN 0.0::DOUBLE WHEN (src - dst) / 1024.0::DOUBLE > 0.5 THEN 1.0::DOUBLE ELSE (src - dst) / 1024.0::DOUBLE + 0.5::DOUBLE END AS y FROM graph")
_on_graph("key_hash", lambda g: g.select("src", scalar.key_hash(F.col("src")).alias("digest")).distinct(), "SELECT DISTINCT src, substr(sha256(CAST(src AS VARCHAR)), 1, 20) AS digest FROM graph")
_on_graph("sigmoid", lambda g: g.select("src", "dst", (F.round(scalar.sigmoid((F.col("src") - F.col("dst")) / 1024.0) * 1e9).cast("long")).alias("y")), "SELECT src, dst, CAST(round(1.0::DOUBLE / (1.0::DOUBLE + exp(-((src - dst) / 1024.0::DOUBLE))) * 1e9) AS BIGINT) AS y FROM graph")
_on_graph("best_row", lambda g: table.best_row(g, ["src"], "rating").select("src", "best.rating", "best.dst"), "SELECT src, rating, dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY rating DESC, dst DESC) AS p FROM graph) WHERE p = 1")
_on_graph("shuffled", lambda g: segmented.shuffled(g, 7, ["src", "dst"]).limit(500), "SELECT * FROM graph ORDER BY md5('7|' || src || '|' || dst) LIMIT 500")
_on_graph("layers", lambda g: regression.layers(g, ["src", "dst"], [[[1.0, -1.0], [0.5, 0.5]], [[2.0, 1.0], [0.0, -1.0]]]).select("src", "dst", "out0", "out1"), "SELECT src, dst, greatest(src - dst, 0) * 2.0::DOUBLE + (src + dst) * 0.5::DOUBLE AS out0, -((src + dst) * 0.5::DOUBLE) AS out1 FROM graph")
_register("timestamp_interval", "SELECT event_id, ts + INTERVAL 3 DAY AS due FROM events", edges=False)(lambda spark, d: _read(spark, d, "events").select("event_id", scalar.later(F.col("ts"), "3 days").alias("due")))
_register("like_and_in", "SELECT c_custkey FROM customer WHERE c_name LIKE '%7' AND c_mktsegment NOT LIKE 'A%' AND c_nationkey IN (1, 2, 3, 5, 8)", edges=False)(
    lambda spark, d: _read(spark, d, "customer").where(F.col("c_name").like("%7") & ~F.col("c_mktsegment").like("A%") & F.col("c_nationkey").isin(1, 2, 3, 5, 8)).select("c_custkey")
)

# Sets

_KEYED = "WITH a AS (SELECT c_custkey AS k, CAST(1 AS BIGINT) AS v FROM customer), b AS (SELECT DISTINCT o_custkey AS k, CAST(2 AS BIGINT) AS v FROM orders), c AS (SELECT s_suppkey AS k, CAST(3 AS BIGINT) AS v FROM supplier)"


def _keyed(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Customers, customers with orders, and suppliers as sets of keys."""
    found = []
    for v, (name, key) in enumerate((("customer", "c_custkey"), ("orders", "o_custkey"), ("supplier", "s_suppkey")), 1):
        found.append(_read(spark, sf_dir, name).select(F.col(key).alias("k"), F.lit(v).cast("long").alias("v")).distinct())
    return found


_register("set_intersect", f"{_KEYED} SELECT * FROM a WHERE k IN (SELECT k FROM b)", edges=False)(lambda spark, d: setops.intersect(*_keyed(spark, d)[:2], "k"))
_register("set_right_union", f"{_KEYED} SELECT * FROM c UNION ALL SELECT * FROM b WHERE k NOT IN (SELECT k FROM c)", edges=False)(lambda spark, d: setops.right_union(*_keyed(spark, d)[1:], "k"))
_register("set_threat_log", f"{_KEYED} SELECT * FROM c UNION ALL SELECT * FROM b WHERE k NOT IN (SELECT k FROM c) UNION ALL SELECT * FROM a WHERE k NOT IN (SELECT k FROM b) AND k NOT IN (SELECT k FROM c)", edges=False)(lambda spark, d: setops.threat_log(_keyed(spark, d), "k"))
_register("set_cardinality", f"{_KEYED} SELECT count(*) AS n, coalesce(sum(k), 0)::BIGINT AS key_sum FROM a WHERE k IN (SELECT k FROM b)", edges=False)(lambda spark, d: setops.cardinality(*_keyed(spark, d)[:2], "k"))

# Ranked enumeration

_P2 = "SELECT DISTINCT a.src AS x, b.src AS y FROM supply a JOIN supply b ON a.dst = b.dst"
_P3 = "SELECT DISTINCT p.x, c.dst AS y FROM p2 p JOIN supply c ON p.y = c.src"
_P4 = "SELECT DISTINCT p.x, d.src AS y FROM p3 p JOIN supply d ON p.y = d.dst"
_S3 = "SELECT DISTINCT a.src AS x1, b.src AS x2, c.src AS x3 FROM supply a JOIN supply b ON a.dst = b.dst JOIN supply c ON a.dst = c.dst"


def _on_supply(name: str, function: Callable[[DataFrame], DataFrame], sql: str, dst: str = "l_partkey") -> None:
    """Registers a query of the two-sided relation of suppliers and parts (or line numbers)."""
    supply = f"WITH supply AS (SELECT DISTINCT l_suppkey AS src, {dst} AS dst FROM lineitem)" + ("" if "p2" not in sql and "p3" not in sql else f", p2 AS ({_P2}), p3 AS ({_P3})")
    _register(name, f"{supply} {sql}", edges=False)(lambda spark, sf_dir: function(lineitem_graph(_read(spark, sf_dir, "lineitem"), "l_suppkey", dst)))


for _name, _sql_text in (("path_three", _P3), ("path_four", _P4), ("star_two", _P2), ("union_2_4", f"SELECT * FROM p2 UNION {_P4}")):
    _on_supply(f"enumerate_{_name}", lambda g, n=_name: ranked.ENUMERATIONS[n](g, 2000), f"SELECT *, x + y AS weight FROM ({_sql_text}) ORDER BY weight, x, y LIMIT 2000")
_on_supply("enumerate_star_two_lex", lambda g: ranked.star_two_lex(g, 2000), f"{_P2} ORDER BY x, y LIMIT 2000")
_on_supply("enumerate_star_three", lambda g: ranked.star_three(g, 2000), f"SELECT *, x1 + x2 + x3 AS weight FROM ({_S3}) ORDER BY weight, x1, x2, x3 LIMIT 2000", "l_linenumber")
_on_supply("enumerate_star_three_lex", lambda g: ranked.star_three_lex(g, 2000), f"{_S3} ORDER BY x1, x2, x3 LIMIT 2000", "l_linenumber")
for _n, _shape in ((2, "l2"), (3, "l3"), (4, "l4")):
    _on_graph(f"enumerate_path_{_n}_full", lambda g, n=_n: ranked.full_paths(g, n), _top(_shape, 35000))

# Streams and models


def _priced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with two scaled features and two labels."""
    li = _read(spark, sf_dir, "lineitem")
    quantity, discount = F.col("l_quantity").cast("double") / 50, F.col("l_discount").cast("double") * 10
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", cents("l_extendedprice").alias("price"), F.lit(1.0).alias("x0"), quantity.alias("x1"), discount.alias("x2"), (F.col("l_extendedprice").cast("double") / 100000).alias("y"), (F.col("l_extendedprice") > 40000).cast("double").alias("high"))


def _descent_sql(label: str, guess: str, rate: float, seed: int) -> str:
    """Two epochs of two batches, step by step."""
    key = f"md5('{seed}|' || l_orderkey || '|' || l_linenumber || '|' || l_partkey || '|' || l_suppkey || '|' || CAST(round(l_extendedprice * 100) AS BIGINT))"
    sql = f"""WITH r AS (SELECT 1.0::DOUBLE AS x0, l_quantity::DOUBLE / 50 AS x1, l_discount::DOUBLE * 10 AS x2, l_extendedprice::DOUBLE / 100000 AS y, (l_extendedprice > 40000)::INT::DOUBLE AS high,
        (row_number() OVER (ORDER BY {key}, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1) % 2 AS batch FROM lineitem), w0 AS (SELECT 0.0::DOUBLE AS a, 0.0::DOUBLE AS b, 0.0::DOUBLE AS c)"""
    for i in range(4):
        error = f"({guess.format('(a * x0 + b * x1 + c * x2)')} - {label})"
        step = ", ".join(f"any_value({w}) - {rate} * avg({error} * {x}) AS {w}" for w, x in zip("abc", ("x0", "x1", "x2"), strict=True))
        sql += f", w{i + 1} AS (SELECT {step} FROM r, w{i} WHERE batch = {i % 2})"
    return f"{sql} SELECT CAST(round(a * 1e7) AS BIGINT) AS w0, CAST(round(b * 1e7) AS BIGINT) AS w1, CAST(round(c * 1e7) AS BIGINT) AS w2 FROM w4"


def _trained(spark: SparkSession, sf_dir: str, label: str, logistic: bool, rate: float) -> DataFrame:
    weights = regression.train(_priced(spark, sf_dir), ["x0", "x1", "x2"], label, logistic=logistic, rate=rate, epochs=2, count=2, seed=5, key=["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "price"])
    return spark.createDataFrame([tuple(round(w * 1e7) for w in weights)], "w0 long, w1 long, w2 long")


_register("regression_linear", _descent_sql("y", "{}", 0.5, 5), edges=False)(lambda spark, d: _trained(spark, d, "y", False, 0.5))
_register("regression_logistic", _descent_sql("high", "1 / (1 + exp(-{}))", 1.0, 5), edges=False)(lambda spark, d: _trained(spark, d, "high", True, 1.0))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return product_k(line(_graph(spark, sf_dir), 2), 100)


