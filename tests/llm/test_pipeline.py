"""The corpus pipeline stage by stage against plain computations on the same rows."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from clausework.llm import pii, quality

from .test_llm import DOCS, prose, shingles


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("sf")
    leak = prose(9000, 30)
    rows = [(i, prose(i, 50, 5000), "en", f"s{i % 3}", None) for i in range(60)]
    rows += [(100 + i, " ".join(w.upper() + "!!" for w in prose(100 + i, 50, 5000).split()), "en", "s0", 1) for i in range(30)]
    rows += [(200, rows[3][1] + " tail", "en", "s1", 1), (201, rows[3][1], "en", "s1", 1), (202, prose(7, 20, 5000) + " " + leak, "en", "s1", 1), (203, prose(888, 60, 5000) + " me@here.example", None, None, None), (5, rows[5][1], "en", "s2", None)]
    spark.createDataFrame(rows, DOCS).write.parquet(str(root / "documents.parquet"))
    spark.createDataFrame([(r[0], int(not 100 <= r[0] < 200), 0) for r in rows], "doc_id long, quality int, toxic int").write.parquet(str(root / "labels.parquet"))
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(str(root / "benchmark.parquet"))
    return str(root)


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = [docs.collect()]
    for name, stage in cp.STAGES:
        docs = cp.materialize(stage(spark, docs, sf), "stage")
        seen.append(docs.collect())
        assert docs.columns == cp.COLUMNS or name == cp.STAGES[-1][0]
    ids = [[r.doc_id for r in rows] for rows in seen]
    assert not [i for i in ids[1] if 100 <= i < 200] and set(ids[1]) == {i for i in ids[0] if not 100 <= i < 200}
    text = {r.doc_id: r.text for r in seen[1]}
    assert set(ids[1]) - set(ids[2]) == {200, 201} and len(ids[2]) == len(set(ids[2]))
    for i in (200, 201):
        a, b = shingles(text[i]), shingles(text[3])
        assert 100 * len(a & b) >= 75 * len(a | b)
    assert set(ids[2]) - set(ids[3]) == {202}
    assert set(ids[4]) == set(ids[3]) and {r.doc_id: r.text for r in seen[4]}[203].endswith("[EMAIL]")
    assert set(ids[5]) == set(ids[4]) and abs(sum(r.taken for r in seen[5]) - 1.5 * sum(r.size for r in seen[5])) <= 2
    assert sorted(r.doc_id for r in cp.run(spark, sf).collect()) == sorted(ids[5])


def test_different_texts_of_one_id_all_stay(spark, sf):
    a, b, c = prose(41, 40), prose(42, 40), prose(43, 40)
    rows = [(7, a), (7, b), (7, a), (8, b + " tail"), (9, c), (3, a + " x"), (None, a), (None, a), (10, ""), (10, None)]
    docs = spark.createDataFrame([(i, t, "en", f"s{k}", k) for k, (i, t) in enumerate(rows)], DOCS).withColumn("f1", F.lit("x")).withColumn("Group", F.lit(1))
    got = cp.near_duplicate(spark, docs, sf)
    assert got.columns == docs.columns
    assert sorted((str(r.doc_id), r.text or "") for r in got.collect()) == sorted((str(i), t or "") for i, t in [(7, b), (9, c), (3, a + " x"), (None, a), (None, a), (10, "")])


def test_stages_on_empty_and_odd_rows(spark, sf):
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "word", None, None, None)], DOCS)
    for _, stage in cp.STAGES:
        assert stage(spark, odd.limit(0), sf).count() == 0
        stage(spark, odd, sf).collect()
    assert cp.near_duplicate(spark, odd, sf).count() == 3
    assert pii.redact(odd).count() == 4 and quality.quality_scores(odd, spark.read.parquet(f"{sf}/labels.parquet")).count() == 4
