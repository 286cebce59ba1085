"""What the ranked and cyclic joins make on the way stays small, and their results stay whole."""

import random

import pytest
from crestline.operators import ranked
from crestline.operators.table import from_rows
from crestline.plans.jointree import Relation
from crestline.plans.reducer import acyclic
from crestline.plans.sql import run
from pyspark.sql import functions as F


def cycle(g, n=4):
    return [Relation.of(f"E{i}", g, {f"v{i}": "src", f"v{(i + 1) % n}": "dst"}, "rating") for i in range(n)]


def test_cycle_is_reduced_before_it_is_joined(spark):
    """A ring of four nodes beside a path's 40 edges into and 40 out of node 5: paths of two edges and no more, and none that closes no cycle."""
    ring = [(0, 1, 1), (1, 2, 1), (2, 3, 1), (3, 0, 1)]
    g = from_rows(spark, ["src", "dst", "rating"], [*ring, *[(100 + i, 5, 1) for i in range(40)], *[(5, 200 + i, 1) for i in range(40)]])
    tree = acyclic(cycle(g))
    assert sorted(len(n.relation.variables) for n in tree.nodes) == [3, 3]
    assert [n.relation.frame.count() for n in tree.nodes] == [4, 4]


@pytest.mark.parametrize("kind", ["long", "string"])
def test_cycles_by_brute_force(spark, kind):
    r = random.Random(3)
    edges = [(r.choice([*range(7), None]), r.choice([*range(3, 12), None]), r.randrange(9)) for _ in range(60)] + [(1, 1, 4), (4, 5, 0), (5, 4, 0)]
    g = from_rows(spark, ["src", "dst", "rating"], edges).withColumns({c: F.col(c).cast(kind) for c in ("src", "dst")})
    known = [(str(a), str(b), w) if kind == "string" else (a, b, w) for a, b, w in edges if a is not None and b is not None]
    sql = "SELECT R.src AS a, S.src AS b, T.src AS c, U.src AS d, R.rating + S.rating + T.rating + U.rating AS total FROM g R, g S, g T, g U WHERE R.dst = S.src AND S.dst = T.src AND T.dst = U.src AND U.dst = R.src ORDER BY total, a, b, c, d"
    after = {}
    for e in known:
        after.setdefault(e[0], []).append(e)
    paths = [[e] for e in known]
    for _ in range(3):
        paths = [[*p, e] for p in paths for e in after.get(p[-1][1], [])]
    want = sorted(((*[e[0] for e in p], sum(e[2] for e in p)) for p in paths if p[3][1] == p[0][0]), key=lambda t: (t[4], t))
    assert want
    for k in (5, 10**5):
        assert [tuple(x) for x in run(spark, f"{sql} LIMIT {k}", {"g": g}).collect()] == want[:k]
    assert run(spark, f"{sql} LIMIT 5", {"g": g.where("src > 5")}).count() == 0


@pytest.fixture
def made(monkeypatch):
    """Rows of each join with a hub's edges."""
    counts = []
    join = ranked.dealt_join

    def counted(*args, **named):
        out = join(*args, **named)
        counts.append(out.count())
        return out

    monkeypatch.setattr(ranked, "dealt_join", counted)
    return counts


def hubs(spark, n=400, m=3):
    """Every one of n nodes beside each of m hubs."""
    return from_rows(spark, ["src", "dst"], [(x, 1000 + h) for x in range(n) for h in range(m)])


def sides(r, n, m, edges):
    """Random edges of a two-sided relation, and all neighbours of each right node."""
    found = sorted({(r.randrange(n), 1000 + r.randrange(m)) for _ in range(edges)})
    return found, {h: [x for x, y in found if y == h] for _, h in found}


def test_lexicographic_stars_make_few_prefixes(spark, made):
    got = [tuple(x) for x in ranked.star_three_lex(hubs(spark), 50).collect()]
    assert got == [(0, 0, x) for x in range(50)]
    assert max(made) <= 3 * 50


@pytest.mark.parametrize("k", [1, 40, 2000])
def test_lexicographic_stars_by_brute_force(spark, k):
    found, at = sides(random.Random(k), 14, 9, 45)
    g = from_rows(spark, ["src", "dst"], found)
    assert [tuple(x) for x in ranked.star_three_lex(g, k, 3).collect()] == sorted({(a, b, c) for xs in at.values() for a in xs for b in xs for c in xs})[:k]
    assert [tuple(x) for x in ranked.star_two_lex(g, k).collect()] == sorted({(a, b) for xs in at.values() for a in xs for b in xs})[:k]


def test_stars_by_sum_make_few_pairs(spark, made):
    got = [tuple(x) for x in ranked.star_three(hubs(spark), 50).collect()]
    assert got == sorted(((a, b, c, a + b + c) for a in range(12) for b in range(12) for c in range(12)), key=lambda t: (t[3], t))[:50]
    assert max(made) <= 3 * 50 * 50


@pytest.mark.parametrize("k", [1, 40, 2000])
def test_stars_by_sum_by_brute_force(spark, k):
    found, at = sides(random.Random(k), 14, 9, 45)
    want = sorted({(a, b, c, a + b + c) for xs in at.values() for a in xs for b in xs for c in xs}, key=lambda t: (t[3], t))[:k]
    assert [tuple(x) for x in ranked.star_three(from_rows(spark, ["src", "dst"], found), k, 3).collect()] == want


def test_path_ends_make_few_pairs(spark, made):
    """60 nodes beside each of 40 hubs: 50 pairs are found from the 15 least starts."""
    want = sorted(((a, b, a + b) for a in range(12) for b in range(12)), key=lambda t: (t[2], t))[:50]
    assert [tuple(x) for x in ranked.path_projected(hubs(spark, 60, 40), 4, 50).collect()] == want
    assert max(made) <= 15 * 60 * 40


@pytest.mark.parametrize("k", [2, 30])
def test_path_ends_by_brute_force(spark, k):
    """Small starts that reach large ends alone, too."""
    r = random.Random(k)
    found, at = sides(r, 14, 9, 30)
    for turned in (False, True):
        edges = [(x if not turned or x % 2 else 5000 - x, y) for x, y in found]
        two = {(a, b) for h in at for a, y in edges if y == h for b, z in edges if z == h}
        four = {(a, d) for a, b in two for c, d in two if b == c}
        want = sorted(((a, b, a + b) for a, b in four), key=lambda t: (t[2], t))[:k]
        assert [tuple(x) for x in ranked.path_projected(from_rows(spark, ["src", "dst"], edges), 4, k).collect()] == want


def test_union_makes_few_pairs(spark, made):
    want = sorted(((a, b, a + b) for a in range(8) for b in range(8)), key=lambda t: (t[2], t))[:20]
    assert [tuple(x) for x in ranked.union_2_4(hubs(spark, 60, 40), 20).collect()] == want
    assert max(made) <= 9 * 60 * 40


def test_union_walks_once_for_both_lengths_and_ends(spark, made):
    """From the 9 least of 60 nodes beside each of 40 hubs: one walk's last step, and its pairs with themselves."""
    want = sorted(((a, b, a + b) for a in range(8) for b in range(8)), key=lambda t: (t[2], t))[:20]
    assert [tuple(x) for x in ranked.union_2_4(hubs(spark, 60, 40), 20).collect()] == want
    assert sum(made) <= 9 * 60 * 40 + 9 * 9 * 60


@pytest.mark.parametrize("local", [30, ranked.LOCAL])
@pytest.mark.parametrize("k", [1, 30, 2000])
def test_union_by_brute_force(spark, monkeypatch, k, local):
    """Nodes alone beside their hub, repeated edges and edges without a hub; walks that are broadcast and walks that aren't."""
    monkeypatch.setattr(ranked, "LOCAL", local)
    r = random.Random(k)
    found, at = sides(r, 14, 9, 25)
    found += [(x, 2000 + x) for x in (0, 3, 90)]
    g = from_rows(spark, ["src", "dst"], [*found, *found[:5], (4, None), (7, None)])
    two = {(a, b) for a, m in found for b, n in found if m == n}
    four = {(a, d) for a, b in two for c, d in two if b == c}
    assert two < four
    want = sorted(((a, b, a + b) for a, b in two | four), key=lambda t: (t[2], t))[:k]
    assert [tuple(x) for x in ranked.union_2_4(g, k).collect()] == want


def test_union_of_parted_nodes_looks_no_further_than_it_must(spark, made):
    """Nodes beside the hub of their remainder by 12: the pairs of the first 15 tell how many starts give 50."""
    want = sorted(((a, b, a + b) for a in range(80) for b in range(80) if a % 12 == b % 12), key=lambda t: (t[2], t))[:50]
    g = from_rows(spark, ["src", "dst"], [(x, 1000 + x % 12) for x in range(396)])
    assert [tuple(x) for x in ranked.union_2_4(g, 50).collect()] == want
    assert sum(made) <= 7000
