"""product-k, level-k and the whole join give the same rows on random graphs with repeated edges and many ties."""

import itertools
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from crestline.operators.table import from_rows
from crestline.plans import topk
from crestline.plans.jointree import JoinTree, Relation, fork, line, star
from crestline.plans.semiring import ADD, MAX, MIN, MUL, Operator, Ranking
from crestline.plans.topk import level_k, levels, naive, product_k, projected_k


def graph(spark, seed, edges=40, nodes=6, weights=5):
    r = random.Random(seed)
    return from_rows(spark, ["src", "dst", "rating"], [(r.randrange(nodes), r.randrange(nodes), r.randrange(weights)) for _ in range(edges)]).cache()


def rows(df):
    return [tuple(r) for r in df.collect()]


TREES = {"l2": lambda g: line(g, 2), "l3": lambda g: line(g, 3), "star": lambda g: star(g, 3), "fork": fork}


@pytest.mark.parametrize("shape", TREES)
@pytest.mark.parametrize("k", [1, 7, 10**6])
def test_methods_agree(spark, shape, k):
    g = graph(spark, k)
    for ranking in (Ranking(), Ranking(ADD, MIN), Ranking(MUL, MAX)):
        tree = TREES[shape](g)
        want = rows(naive(tree, min(k, 5000), ranking))
        assert rows(product_k(tree, min(k, 5000), ranking)) == want
        if k < 100:
            for base in (2, 3):
                assert rows(level_k(tree, k, base, ranking)) == want


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 3), st.integers(-3, 3)), min_size=1, max_size=12), st.integers(1, 6))
def test_random_bags(spark, edges, k):
    tree = line(from_rows(spark, ["src", "dst", "rating"], edges), 3)
    want = sorted(((a, b, c, d, x + y + z) for (a, b, x), (b2, c, y), (c2, d, z) in itertools.product(edges, repeat=3) if b == b2 and c == c2), key=lambda t: (-t[4], t[:4]))[:k]
    assert rows(product_k(tree, k)) == want
    assert rows(level_k(tree, k, 2)) == want


def test_three_line_by_hand(spark):
    r = Relation.of("R", from_rows(spark, ["A", "B", "w"], [(1, 1, 3), (2, 2, 2), (3, 3, 1)]), {"A": "A", "B": "B"}, "w")
    s = Relation.of("S", from_rows(spark, ["B", "C", "w"], [(1, 1, 4), (1, 2, 3), (1, 3, 2), (2, 1, 5), (2, 2, 7), (3, 3, 1)]), {"B": "B", "C": "C"}, "w")
    t = Relation.of("T", from_rows(spark, ["C", "w"], [(1, 3), (2, 1), (3, 1000)]), {"C": "C"}, "w")
    tree = JoinTree.build([r, s, t], "R")
    assert [x[-1] for x in rows(product_k(tree, 10))] == [1005, 1002, 10, 10, 10, 7]
    assert rows(product_k(tree, 3)) == rows(level_k(tree, 3, 2)) == rows(product_k(tree, 10))[:3]


def test_star_by_hand(spark):
    g = from_rows(spark, ["src", "dst", "rating"], [(1, 1, 1), (1, 2, 10), (2, 3, 2), (2, 4, 4), (2, 5, 8), (3, 6, 9)])
    assert [r[-1] for r in rows(product_k(star(g, 3), 4))] == [30, 27, 24, 21]


def test_projected(spark):
    g = graph(spark, 5)
    edges = rows(g)
    best = {}
    for (_, b, x), (b2, c, y), (c2, d, z) in itertools.product(edges, repeat=3):
        if b == b2 and c == c2:
            best[b, c, d] = max(best.get((b, c, d), -1), x + y + z)
    want = sorted(((*key, w) for key, w in best.items()), key=lambda t: (-t[3], t[:3]))[:20]
    assert rows(projected_k(line(g, 3), ["node2", "node3", "node4"], 20)) == want


def test_empty_and_dangling(spark):
    g = from_rows(spark, ["src", "dst", "rating"], [(1, 2, 3)])
    for method in (product_k, level_k, naive):
        assert rows(method(line(g, 2), 5)) == []
        assert rows(method(line(g.where("false"), 3), 5)) == []


def test_choice_by_size(spark):
    from crestline.plans.eager import join_size, top_k

    tree = line(graph(spark, 3), 3)
    assert join_size(tree) == naive(tree, 10**6).count()
    assert rows(top_k(tree, 9)) == rows(top_k(tree, 9, small=0)) == rows(naive(tree, 9))
    assert join_size(line(graph(spark, 3).where("false"), 2)) == 0


def test_levels():
    assert levels(1024, 32) == [(0, 32), (32, 1024)]
    assert levels(8, 4) == [(0, 4), (4, 8)]
    assert levels(1, 2) == [(0, 1)]
    with pytest.raises(ValueError):
        levels(4, 1)


def test_bad_rankings_and_trees(spark):
    with pytest.raises(ValueError):
        Ranking(MAX, ADD)
    g = graph(spark, 1)
    cyclic = [Relation.of(n, g, {a: "src", b: "dst"}, "rating") for n, a, b in (("R", "a", "b"), ("S", "b", "c"), ("T", "c", "a"))]
    with pytest.raises(ValueError):
        JoinTree.build(cyclic)
    with pytest.raises(ValueError):
        JoinTree.build([Relation.of("R", g, {"a": "src"}, "rating"), Relation.of("S", g, {"z": "src"}, "rating")])


def test_cuts_are_partial_limits(spark):
    """No step ranks all rows in one task: cuts are limits in every task first, and what goes on is at most k rows."""
    for k in (5, 100_000):
        plan = product_k(line(graph(spark, 2), 2), k)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("TakeOrderedAndProject") >= 2 and "Window" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("times", [ADD, MUL])
def test_equal_weights_keep_k_rows_a_step(spark, monkeypatch, times):
    """All results tie, so variables alone decide; no step keeps more than k rows."""
    seen = []
    settle = topk.settle
    monkeypatch.setattr(topk, "settle", lambda df, k, name: seen.append(settle(df, k, name).count()) or settle(df, k, name))
    g = from_rows(spark, ["src", "dst", "rating"], [(a, b, times.zero) for a in range(12) for b in range(12)])
    want = rows(naive(line(g, 3), 10, Ranking(times, MAX)))
    for method in (product_k, lambda t, k, r: level_k(t, k, 2, r)):
        assert rows(method(line(g, 3), 10, Ranking(times, MAX))) == want
    assert seen and max(seen) <= 10


def test_zero_weights_of_a_product(spark):
    """A weight of 0 makes all prefixes equal, so the least variables win, not the best prefix."""
    r = random.Random(3)
    for seed in range(4):
        g = from_rows(spark, ["src", "dst", "rating"], [(r.randrange(4), r.randrange(4), r.choice([0, 0, 1, 2])) for _ in range(14)])
        for ranking in (Ranking(MUL, MAX), Ranking(MUL, MIN)):
            for k in (1, 3, 6):
                want = rows(naive(line(g, 3), k, ranking))
                assert rows(product_k(line(g, 3), k, ranking)) == want and rows(level_k(line(g, 3), k, 2, ranking)) == want


def test_user_operator(spark):
    """Bottleneck ranking: the largest least weight of a path, by the caller's own operation."""
    least = Operator.of("BOTTLENECK", 10**9, lambda a, b: F.least(a, b))
    for seed in (1, 2):
        tree = line(graph(spark, seed, weights=50), 3)
        want = rows(naive(tree, 12, Ranking(least)))
        assert rows(product_k(tree, 12, Ranking(least))) == want and rows(level_k(tree, 12, 2, Ranking(least))) == want
    assert from_rows(spark, ["a"], [(4,), (2,), (9,)]).agg(least.aggregate(F.col("a"))).first()[0] == 2


@pytest.mark.parametrize("k", [1, 8, 1000])
def test_projecting_a_join_variable_away(spark, k):
    g = graph(spark, 5)
    best = {}
    for (a, b, x), (b2, c, y), (c2, d, z) in itertools.product(rows(g), repeat=3):
        if b == b2 and c == c2:
            best[a, d] = max(best.get((a, d), -1), x + y + z)
    want = sorted(((*key, w) for key, w in best.items()), key=lambda t: (-t[2], t[:2]))[:k]
    assert rows(projected_k(line(g, 3), ["node1", "node4"], k)) == want


def test_all_results_that_reach_a_bar(spark):
    g = graph(spark, 8)
    whole = rows(naive(line(g, 3), 10**6))
    for bar in (whole[len(whole) // 2][-1], None):
        got = rows(topk.reaching(line(g, 3), spark.createDataFrame([(bar,)], "bar long")))
        assert sorted(got) == sorted(r for r in whole if bar is None or r[-1] >= bar)
