"""Exact and near duplicates, components, mixing, decontamination: against SQL and brute force."""

import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex
from nasty import nasty_rows
from pyspark.sql import functions as F

from crestline.llm.common import word_count
from crestline.llm.components import components
from crestline.llm.decontaminate import MASKED_WORDS, MASKS, drop_leaks, leaks, runs
from crestline.llm.exact_dedup import drop_exact_duplicates, exact_duplicates
from crestline.llm.mixing import mix, mixed_documents, sainte_lague
from crestline.llm.near_dedup import drop_near_duplicates, near_duplicates
from crestline.llm.queries import ORACLE_SQL
from crestline.llm.textvec import slices, word_hashes, words

LOWER = {i: i + 32 for i in range(65, 91)}


def same(df, rows, columns):
    key = lambda t: tuple((x is None, str(x)) for x in t)
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=key) == sorted(rows, key=key)


def test_words_match_the_contract():
    import pyarrow as pa

    texts = ["", None, " a\tb\x0bc ", "Aé x y", "\x1c z", "x" * 5000]
    for _, _, data, offsets in slices(pa.array(texts)):
        start, length, bounds = words(data, offsets)
        hashes, _ = word_hashes(data, offsets)
        for i, t in enumerate(texts):
            want = [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
            assert [data[s : s + n].tobytes() for s, n in zip(start[bounds[i] : bounds[i + 1]], length[bounds[i] : bounds[i + 1]], strict=True)] == want
    (_, _, d1, o1), (_, _, d2, o2) = (next(slices(pa.array([t]))) for t in ("One TWO", "x one two"))
    assert set(word_hashes(d1, o1)[0]) <= set(word_hashes(d2, o2)[0])
    assert len(np.unique(hashes)) == len(hashes)


def test_exact_against_sql(nasty, duck):
    columns = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    want = duck.sql(f"SELECT {', '.join(columns)} FROM ({ORACLE_SQL['op9_exact_dedup']})").fetchall()
    same(exact_duplicates(nasty), want, columns)


def test_exact_drop(nasty, empty):
    left = drop_exact_duplicates(nasty)
    assert left.columns == nasty.columns
    norm = [re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "") for r in left.collect()]
    assert len(norm) == len(set(norm)) == len({re.sub(r"[\x20\x09-\x0D]", "", x[1] or "") for x in nasty_rows()})
    assert exact_duplicates(empty).count() == 0 and drop_exact_duplicates(empty).count() == 0


def shingle_sets(rows, width):
    sets = []
    for row in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (row[1] or "").translate(LOWER))
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    return sets


def brute_components(rows, width, percent=80):
    sets = shingle_sets(rows, width)
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b]:
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                up[find(b)] = find(a)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(i)
    out = []
    for members in groups.values():
        ids = [rows[i][0] for i in members if rows[i][0] is not None]
        for i in members:
            component = min(ids) if ids else None
            out.append((rows[i][0], len(sets[i]), component, rows[i][0] == component))
    return out


@pytest.mark.parametrize("width", [4, 5])
def test_near_against_brute_force(nasty, width):
    same(near_duplicates(nasty, width=width), brute_components(nasty_rows(), width), ["doc_id", "n_shingles", "component_id", "kept"])


def test_near_groups_of_edits_in_small_blocks(spark):
    """Independent edits of one text: many pairs are just below the threshold, so several components share postings."""
    r = random.Random(9)
    base = " ".join(f"w{r.randrange(10**6)}" for _ in range(70))
    rows = []
    for i in range(150):
        w = base.split(" ")
        for _ in range(r.randrange(6)):
            w[r.randrange(len(w))] = f"e{r.randrange(40)}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    same(near_duplicates(docs, width=4, block=16), brute_components(rows, 4), ["doc_id", "n_shingles", "component_id", "kept"])


def test_unlinked_members_of_one_pivot(spark):
    """Texts that share two thirds of their words share postings but no link; copies among them still find their partners."""
    r = random.Random(13)
    base = " ".join(f"w{r.randrange(10**6)}" for _ in range(100))
    rows = [(i, f"{base} " + " ".join(f"own{i}x{j}" for j in range(45))) for i in range(600)]
    rows += [(600 + i, f"{base} " + " ".join(f"own{i}x{j}" for j in range(43)) + " z z") for i in range(20)]
    found = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {(x["doc_id"], x["component_id"]) for x in found.collect()} == {(i, i % 600) for i in range(620)}


def test_near_drop(nasty, empty, spark):
    left = drop_near_duplicates(nasty)
    assert left.columns == nasty.columns
    want = {c for _, n, c, _ in brute_components(nasty_rows(), 5)}
    assert {r["doc_id"] for r in left.collect()} == want
    assert near_duplicates(empty).count() == 0 and drop_near_duplicates(empty).count() == 0
    alone = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    assert drop_near_duplicates(alone).count() == 2


def test_near_drop_keeps_one_row_of_each_group(spark):
    """Null and repeated ids: groups that have an id in common, or none, stay apart."""
    r = random.Random(4)
    text = lambda: " ".join(f"w{r.randrange(10**6)}" for _ in range(40))
    base, other, third = text(), text(), text()
    # groups: four unlinked null ids; a null pair of copies; a null id linked with 7; unrelated texts of id 3, one with a partner; repeated rows; blanks
    rows = [(None, text()) for _ in range(4)] + [(None, base), (None, base), (None, base.upper()), (7, other), (None, other)]
    rows += [(3, text()), (3, text()), (3, third), (9, third), (3, third.replace(" ", "  ")), (5, "same row"), (5, "same row"), (None, None), (None, ""), (6, " "), (6, " ")]
    left = [tuple(x) for x in drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()]
    sets = shingle_sets(rows, 5)
    # texts are either unrelated or of one set, so that a set is a group
    groups = Counter((frozenset(s),) if s else (i,) for i, s in enumerate(sets))
    kept = shingle_sets(left, 5)
    assert Counter(frozenset(s) for s in kept if s) == Counter({g[0]: 1 for g in groups if g[0] in map(frozenset, sets)})
    assert len(left) == len(groups) and sum(not s for s in kept) == 4
    assert set(left) <= set(rows)
    for i, t in left:
        if shingle_sets([(i, t)], 5)[0]:
            ids = [x for (x, _), s in zip(rows, sets, strict=True) if s == shingle_sets([(i, t)], 5)[0] and x is not None]
            assert i == (min(ids) if ids else None)


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1100)]
    edges = [(max(e), min(e)) for e in edges if e[0] != e[1]]
    up = {}

    def find(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        p, q = find(a), find(b)
        up[max(p, q)] = min(p, q)
    want = sorted((x, find(x)) for x in {v for e in edges for v in e} if find(x) != x)
    got = components(spark.createDataFrame(edges, "hi long, lo long").repartition(5))
    assert sorted((x["node"], x["root"]) for x in got.collect()) == want


def test_mix_against_sql(nasty, duck):
    columns = ["doc_id", "size", "source_size", "target", "taken"]
    want = duck.sql(f"SELECT {', '.join(columns)} FROM ({ORACLE_SQL['op3_mixing']})").fetchall()
    same(mix(nasty), want, columns)


def test_mix_promises(nasty, empty):
    by = defaultdict(lambda: [0, 0.0])
    rows = mix(nasty, shard_words=500, extra={"origin": F.col("source")}).collect()
    for x in rows:
        assert 0 <= x["taken"] <= 2 * x["size"]
        by[x["origin"]][0] += x["taken"]
        by[x["origin"]][1] = x["target"]
    for taken, target in by.values():
        assert abs(taken - target) <= 0.01 * target + 2
    assert sorted(map(str, rows)) == sorted(map(str, mix(nasty.repartition(5), shard_words=500, extra={"origin": F.col("source")}).collect()))
    assert mix(empty).count() == 0
    kept = mixed_documents(nasty)
    # the table's own column keeps its name and values
    assert kept.columns == [*nasty.columns, "mix_size", "source_size", "target", "taken"]
    assert kept.where("taken <= 0").count() == 0 and kept.where("size = 7 or size is null").count() == kept.count() > 0
    assert mixed_documents(nasty, shard_rows=4).count() > 0


def test_sainte_lague_by_highest_quotients(spark):
    r = random.Random(5)
    claims = [(f"p{i}", float(r.randrange(0, 1000))) for i in range(12)]
    for seats in (0, 1, 7, 100, 997):
        quotients = sorted(((-(v / (2 * i - 1)), p) for p, v in claims if v > 0 for i in range(1, seats + 2)))[:seats]
        want = {p: sum(q[1] == p for q in quotients) for p, _ in claims}
        df = spark.createDataFrame([(p, v, seats) for p, v in claims], "party string, votes double, seats long")
        assert {x["party"]: x["quota"] for x in sainte_lague(df, [], "party", "votes", "seats").collect()} == want


def test_word_count(spark):
    df = spark.createDataFrame([(None,), ("",), (" a\tb\x0bc d ",)], "t string")
    assert [x[0] for x in df.select(word_count(F.col("t"))).collect()] == [0, 0, 3]


def test_seeds_find_every_tolerated_pattern():
    """All places that may differ, for all lengths: short items by their runs, others by the masks."""
    for n in range(3, 17):
        allowed = n - -(-n * 80 // 100)
        for count in range(allowed + 1):
            for gone in itertools.combinations(range(n), count):
                keeps = ["0" if i in gone else "1" for i in range(n)]
                if n < MASKED_WORDS:
                    assert any("0" not in keeps[a : a + length] for a, length in runs(n)), (n, gone)
                else:
                    assert any(all(keeps[a + j] == "1" for j, c in enumerate(m) if c == "1") for m in MASKS for a in range(n - len(m) + 1)), (n, gone)


def test_short_items_by_brute_force(spark):
    """Items of 2 to 13 words in texts with every number of substitutions, at the edges of the texts, too."""
    r = random.Random(12)
    vocabulary = [f"w{i}" for i in range(400)]
    items = {n: [r.choice(vocabulary) for _ in range(n)] for n in range(2, 14)}
    cases = []
    for w in items.values():
        for count in range(4):
            for _ in range(6):
                x = list(w)
                for at in r.sample(range(len(x)), min(count, len(x))):
                    x[at] = "zz"
                cases.append(r.choices(vocabulary, k=r.randrange(3)) + x + r.choices(vocabulary, k=r.randrange(3)))
    docs = spark.createDataFrame([(i, " ".join(c)) for i, c in enumerate(cases)], "doc_id long, text string")
    bench = spark.createDataFrame([(n, " ".join(w)) for n, w in items.items()], "item_id long, text string")
    want = set()
    for i, c in enumerate(cases):
        for n, w in items.items():
            best = max(sum(0 <= at + j < len(c) and c[at + j] == x for j, x in enumerate(w)) for at in range(-n, len(c)))
            if n >= 3 and best >= -(-n * 80 // 100):
                want.add((i, n))
    assert {(x["doc_id"], x["item_id"]) for x in leaks(docs, bench).collect()} == want and len(want) > 100


def test_leak_query_by_brute_force(spark):
    """All documents against all items, window by window."""
    import os

    from crestline.llm.queries import op6_decontaminate

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("test tables are needed")
    split = lambda t: [w for w in regex.split(r"[^\p{L}\p{M}\p{N}]+", (t or "").lower()) if w]
    docs = [(r["doc_id"], split(r["text"])) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r["item_id"], split(r["text"])) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = set()
    for d, words in docs:
        places = {}
        for i, w in enumerate(words):
            places.setdefault(w, []).append(i)
        for item, goal in items:
            starts = {i - j for j, w in enumerate(goal) for i in places.get(w, [])}
            width = min(16, len(goal))
            for at in starts:
                same = [0 <= at + j < len(words) and words[at + j] == w for j, w in enumerate(goal)]
                if max(sum(same[a : a + width]) for a in range(len(goal) - width + 1)) >= -(-width * 80 // 100):
                    want.add((d, item))
                    break
    assert {(x["doc_id"], x["item_id"]) for x in op6_decontaminate(spark, sf).collect()} == want and want


def test_leaks(spark, nasty, empty):
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(3000)]
    text = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = {i: text(30) for i in range(5)} | {5: text(12)}
    cases, want = [], set()
    for i, item in items.items():
        for kind in ("whole", "upper", "two edits", "half", "many edits", "none"):
            w = list(item)
            if kind == "two edits":
                w[3], w[9 if len(w) < 20 else 17] = "zzz", "yyy"
            if kind == "many edits":
                w = [x if j % 2 else "zz" for j, x in enumerate(w)]
            if kind == "half":
                w = w[: max(16, len(w) // 2)]
            if kind == "none":
                w = text(len(w))
            joined = (" , ".join(w)).upper() if kind == "upper" else " ".join(w)
            doc = len(cases)
            cases.append((doc, " ".join(text(20)) + ". " + joined + "\n" + " ".join(text(r.randrange(25)))))
            if kind in ("whole", "upper", "two edits", "half"):
                want.add((doc, i))
    cases += [cases[0], (None, cases[0][1]), (99, None), (98, "")]
    docs = spark.createDataFrame(cases, "doc_id long, text string")
    bench = spark.createDataFrame([*((i, " ".join(w)) for i, w in items.items()), (7, None), (8, "a b"), (None, "q q q")], "item_id long, text string")
    for limit in (8 << 20, 0):  # broadcast, and the shuffled way beyond the bound
        found = leaks(docs, bench, broadcast_bytes=limit).collect()
        assert {(x["doc_id"], x["item_id"]) for x in found} == want | {(None, 0)}
        assert len(found) == len(want) + 1
    left = drop_leaks(docs, bench)
    assert {x["doc_id"] for x in left.collect()} == {d for d, _ in cases} - {d for d, _ in want} - {None}
    assert leaks(empty, bench).count() == 0 and leaks(docs, bench.where("false")).count() == 0
    assert drop_leaks(nasty, bench).columns == nasty.columns
