"""A batch in one scan against the general plan, and what it reads."""

import random

import pytest

from sparquill import queries as engine
from sparquill.functions.scoring import BM25
from sparquill.operators import build
from sparquill.plans import batch
from sparquill.plans import search as plan

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("k", [1, 3, 10])
def test_batch_equals_general_plan(spark, k):
    """With many equal documents, ids that sort as text, and documents without terms."""
    r = random.Random(5)
    texts = [" ".join(r.choice("abcdefgh") * r.randint(1, 2) for _ in range(r.randint(0, 9))) for _ in range(60)]
    docs = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts * 4)], "doc_id string, text string").repartition(3)
    asked = [(q, t, r.randint(1, 3)) for q in range(5) for t in r.sample(["a", "bb", "c", "dd", "h", "none"], 3)]
    frame = spark.createDataFrame(asked, "qid int, term string, qtf int")
    want = plan.search_batch(build.build(docs), frame, k, digits=6)
    rows = batch.counted(docs, sorted({t for _, t, _ in asked}))
    got = batch.search(rows, sorted({t for _, t, _ in asked}), asked, k, BM25(), 6, "int")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect()))


def test_held_runs(spark):
    docs = spark.createDataFrame([(1, "x a b c a b"), (2, "a b"), (3, "B, c! A"), (4, "a x b c")], "doc_id bigint, text string")
    rows = batch.counted(docs, ["a", "b", "c"], [("a", "b", "c"), ("b", "c", "a"), ("c", "c", "c")])
    assert {r.doc_id: list(r.held) for r in rows.collect()} == {1: [0, 1], 2: [], 3: [1], 4: []}


@pytest.mark.parametrize("name", ["batch_topk", "ndcg_mrr_recall_map", "mean_effectiveness"])
def test_texts_are_read_once(spark, name):
    assert not any("documents.parquet" in f for f in engine.queries()[name](spark, SF).inputFiles())


@pytest.mark.parametrize("name", ["batch_topk", "ndcg_mrr_recall_map"])
def test_batches_past_one_matrix(spark, monkeypatch, name):
    own = engine.queries()[name](spark, SF)
    want = sorted(map(tuple, own.select(*[c for c in own.columns]).collect()))
    monkeypatch.setattr(batch, "CELLS", 1)
    general = engine.queries()[name](spark, SF)
    assert sorted(map(tuple, general.select(*own.columns).collect())) == want
