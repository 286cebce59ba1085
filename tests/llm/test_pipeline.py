"""The pipeline, stage by stage on its own input, against brute force."""

import random
import re

import duckdb
import pytest
from nasty import SCHEMA, nasty_rows
from test_groups import brute_components

import corpus_pipeline
from crestline.llm.langid import fit, identify
from crestline.llm.queries import ORACLE_SQL

ITEM = "copper lantern drifts across seven quiet harbours while evening bells count every patient stone of autumn"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    r = random.Random(3)
    rows = nasty_rows()
    for i in range(6):
        words = ITEM.split()
        if i % 2:
            words[5] = "replaced"
        filler = " ".join(r.choice("abcdefghij") * 3 for _ in range(30))
        rows.append((500 + i, f"{filler} {' '.join(words)} {filler[::-1]}", "en", "leaky", 1, 1, "x", "y", "z"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def leaky(text):
    words, item = re.findall(r"\w+", (text or "").lower()), ITEM.split()
    return any(sum(0 <= o + j < len(words) and words[o + j] == w for j, w in enumerate(item[:16])) >= 13 for o in range(-16, len(words)))


def test_each_stage(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in docs.collect()]
        out = stage(spark, docs, folder)
        after = [tuple(r) for r in out.collect()]
        ids = lambda rows: sorted(str(r[0]) for r in rows)
        if name != "mixed":
            assert out.columns == columns
            assert set(map(str, after)) <= set(map(str, before))
        if name == "language":
            gone = [r["doc_id"] for r in identify(docs, fit(docs)).where("lang_pred = 'und' or ambiguous").collect()]
            assert ids(after) == sorted(map(str, (list_minus([r[0] for r in before], gone))))
        elif name == "exact":
            norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
            want = {}
            for r in sorted(before, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0)):
                want.setdefault(norm(r[1]), r)
            assert ids(after) == ids(want.values())
        elif name == "near":
            found = brute_components([r[:2] for r in before], 5)
            assert ids(after) == sorted(str(c) for c in {c for _, _, c, _ in found})
        elif name == "decontaminated":
            assert ids(after) == ids(r for r in before if not leaky(r[1]))
            assert len(after) < len(before)
        else:
            con = duckdb.connect()
            con.register("documents", docs.toArrow())
            want = con.sql(f"SELECT doc_id, size, taken FROM ({ORACLE_SQL['op3_mixing']}) WHERE taken > 0").fetchall()
            assert sorted(map(str, want)) == sorted(str((r["doc_id"], r["mix_size"], r["taken"])) for r in out.collect())
            # the input has a column named size, which stays
            assert out.columns[: len(columns)] == columns
        docs = spark.createDataFrame(out.toArrow(), out.schema) if after else out


def list_minus(a, b):
    left = list(a)
    for x in b:
        left.remove(x)
    return left


def test_run_is_the_stages_in_turn(spark, folder):
    got = corpus_pipeline.run(spark, folder)
    assert got.where("taken > 2 * size or taken <= 0").count() == 0 and got.count() > 20
    assert sorted(map(str, got.collect())) == sorted(map(str, corpus_pipeline.run(spark, folder).collect()))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "exact", "near", "decontaminated", "mixed"]


def test_run_on_nothing(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pairs_are_never_all_made(spark):
    """Copies collapse before any pairing: a thousand of them give one class and no pair."""
    from crestline.llm.near_dedup import near_duplicates

    texts = [" ".join(f"t{i}" for i in range(40))] * 1000
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = near_duplicates(docs)
    assert found.where("component_id = 0").count() == 1000 and found.where("kept").count() == 1
