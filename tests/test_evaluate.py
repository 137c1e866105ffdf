"""Effectiveness figures by plain loops, deltas against baselines, samples of queries."""

import math
import random

import pytest
from pyspark.sql import functions as F

from sparquill.operators import evaluate


def plain(run, qrels, k):
    own = {d: r for d, r in qrels}
    ideal = sorted(own.values(), reverse=True)[:k]
    idcg = sum((2**r - 1) / math.log2(i + 2) for i, r in enumerate(ideal))
    dcg = sum((2 ** own.get(d, 0) - 1) / math.log2(i + 2) for i, d in enumerate(run[:k]))
    hits = [i + 1 for i, d in enumerate(run[:k]) if own.get(d, 0) > 0]
    relevant = sum(r > 0 for r in own.values())
    ap = sum((n + 1) / place for n, place in enumerate(hits)) / relevant if relevant else 0.0
    return (dcg / idcg if idcg else 0.0, 1 / hits[0] if hits else 0.0, len(hits) / relevant if relevant else 0.0, ap)


def test_figures_of_queries(spark):
    rnd = random.Random(4)
    runs, judged, want = [], [], {}
    for q in range(30):
        run, rel = rnd.sample(range(50), rnd.randrange(15)), [(d, rnd.randrange(3)) for d in rnd.sample(range(50), rnd.randrange(1, 12))]
        runs += [(q, d, i + 1) for i, d in enumerate(run)]
        judged += [(q, d, r) for d, r in rel]
        want[q] = plain(run, rel, 10)
    got = evaluate.per_query(spark.createDataFrame(runs, "qid int, doc_id int, rank int"), spark.createDataFrame(judged, "qid int, doc_id int, rel int"), 10)
    rows = {r.qid: (r.ndcg, r.mrr, r.recall, r.ap) for r in got.collect()}
    assert rows.keys() == want.keys()
    assert any(0 < w[2] < 1 for w in want.values())
    for q, w in want.items():
        assert rows[q] == pytest.approx(w)
    m = evaluate.means(got).first()
    assert (m.ndcg, m.mrr, m.recall, m.map) == pytest.approx(tuple(sum(w[i] for w in want.values()) / 30 for i in range(4)))


def test_deltas_and_macro_average(spark):
    scores = spark.createDataFrame([("a", "ndcg", 0.5), ("b", "ndcg", 0.3), ("c", "ndcg", 0.1)], "dataset string, metric string, value double")
    base = spark.createDataFrame([("a", "ndcg", 0.4), ("b", "ndcg", 0.4)], "dataset string, metric string, value double")
    got = {r.dataset: (r.value, r.base, r.delta) for r in evaluate.against(scores, base).collect()}
    assert got["a"] == pytest.approx((0.5, 0.4, 0.1)) and got["b"] == pytest.approx((0.3, 0.4, -0.1)) and got["c"] == (0.1, None, None)
    assert got["mean"][:2] == pytest.approx((0.3, 0.4))


def test_samples(spark):
    asked = spark.range(200).select(F.col("id").alias("qid"))
    one, same, other = (sorted(r.qid for r in evaluate.sampled(asked, 20, seed).collect()) for seed in (1, 1, 2))
    assert one == same != other and len(set(one)) == 20


def test_latency(spark):
    got = evaluate.latency(spark.createDataFrame([(float(x),) for x in range(1, 101)], "ms double"), "ms").first()
    assert (got.p50, got.p95, got.p99, got.mean, got.n) == pytest.approx((50.5, 95.05, 99.01, 50.5, 100))
