"""Readers of files and generated documents, evaluation and fusion."""

import json

import numpy as np
import pytest

from sparquill.operators import evaluate, fusion
from sparquill.sources import readers
from sparquill.sources.readers import Mapping, detect_format, read_source


def got(df):
    return sorted((r.id, r.text, tuple(sorted(r.metadata.items()))) for r in df.collect())


def test_formats():
    assert [detect_format(x) for x in ("a.parquet", "a.jsonl", "a.ndjson", "a.JSON", "a.csv", "a", "a.bin")] == ["parquet", "jsonl", "jsonl", "json", "csv", "jsonl", "jsonl"]
    assert detect_format("a.csv", "json") == "json"


def test_json_lines_and_json(spark, tmp_path):
    own = [{"id": "1", "title": " T ", "text": "x", "k": "v"}, {"id": "2", "text": "  "}, {"text": "no id"}, {"id": "3", "text": "y"}]
    (tmp_path / "a.jsonl").write_text("\n".join([json.dumps(own[0]), "", "{broken", *map(json.dumps, own[1:])]))
    m = Mapping("id", ("title", "text"), ("k",))
    want = [("1", "T x", (("k", "v"),)), ("3", "y", ())]
    assert got(read_source(spark, f"{tmp_path}/a.jsonl", m)) == want
    (tmp_path / "b.json").write_text(json.dumps(own))
    assert got(read_source(spark, f"{tmp_path}/b.json", m)) == want
    (tmp_path / "c.json").write_text(json.dumps(own[3]))
    assert got(read_source(spark, f"{tmp_path}/c.json", m)) == want[1:]


def test_csv_and_parquet_number_rows_with_text(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,title,text\n, "A ""q""",x\n7,,\n,,y\nz,t,\n')
    m = Mapping("id", ("title", "text"))
    assert got(read_source(spark, f"{tmp_path}/a.csv", m)) == [("0", 'A "q" x', ()), ("1", "y", ()), ("z", "t", ())]
    rows = spark.createDataFrame([(None, "x", 5), ("", None, 6), ("", "y", 7), ("k", "z", None)], "id string, text string, n int").coalesce(1)
    rows.write.parquet(f"{tmp_path}/p.parquet")
    m = Mapping("id", ("text",), ("n", "absent"))
    assert got(read_source(spark, f"{tmp_path}/p.parquet", m)) == [("0", "x", (("n", "5"),)), ("1", "y", (("n", "7"),)), ("k", "z", ())]
    assert read_source(spark, f"{tmp_path}/p.parquet", m, limit=1).count() == 1
    with pytest.raises(ValueError):
        read_source(spark, f"{tmp_path}/p.parquet", Mapping("no", ("none",)))
    with pytest.raises(ValueError):
        read_source(spark, "x", fmt="xml")


def test_generated(spark):
    a, b, c = (read_source(spark, "gen://200", seed=s).collect() for s in (1, 1, 2))
    assert sorted(a) == sorted(b) != sorted(c)
    assert {r.id for r in a} == {f"doc-{i:010d}" for i in range(200)}
    sizes = [len(r.text.split()) for r in a]
    assert min(sizes) >= 20 and max(sizes) <= 150
    words = [w for r in a for w in r.text.split()]
    common = max(set(words), key=words.count)
    assert common == readers.VOCABULARY[0] and words.count(common) > 4 * len(words) / len(readers.VOCABULARY)
    with pytest.raises(ValueError):
        read_source(spark, "gen://many")


def test_benchmark_loaders(spark, tmp_path):
    (tmp_path / "q.jsonl").write_text("\n".join(json.dumps({"_id": str(i), "text": f"q {i}"}) for i in range(3)))
    (tmp_path / "r.tsv").write_text("query-id\tcorpus-id\tscore\n1\td1\t2\n1\td2\t0\n")
    queries, qrels = readers.load_queries_and_qrels(spark, f"{tmp_path}/q.jsonl", f"{tmp_path}/r.tsv")
    assert [tuple(r) for r in queries.collect()] == [("1", "q 1")]
    assert sorted(map(tuple, qrels.collect())) == [("1", "d1", 2), ("1", "d2", 0)]


def test_effectiveness_by_hand(spark):
    run = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3), (2, "x", 1)], "qid int, doc_id string, rank int")
    qrels = spark.createDataFrame([(1, "b", 2), (1, "c", 1), (1, "z", 1), (2, "y", 1), (3, "q", 0)], "qid int, doc_id string, rel int")
    r = {x.qid: x for x in evaluate.per_query(run, qrels, 10).collect()}
    dcg, ideal = 3 / np.log2(3) + 1 / np.log2(4), 3 + 1 / np.log2(3) + 1 / np.log2(4)
    assert r[1].ndcg == pytest.approx(dcg / ideal) and r[1].mrr == 0.5
    assert r[1].recall == pytest.approx(2 / 3) and r[1].ap == pytest.approx((1 / 2 + 2 / 3) / 3)
    assert tuple(r[2])[1:] == tuple(r[3])[1:] == (0, 0, 0, 0)
    times = spark.createDataFrame([(float(x),) for x in range(1, 12)], "ms double")
    t = evaluate.latency(times, "ms").first()
    assert (t.p50, t.p95, t.n) == (6.0, pytest.approx(np.percentile(range(1, 12), 95)), 11)
    assert evaluate.sampled(qrels, 2, 1).count() == 2


def test_fusion_by_hand(spark):
    lists = spark.createDataFrame([("a", 3.0, 1), ("b", 2.0, 2), ("b", 5.0, 1), ("c", 1.0, 2)], "doc_id string, score double, rank int")
    assert [(r.doc_id, r.score) for r in fusion.by_score(lists, 2).orderBy("rank").collect()] == [("b", 5.0), ("a", 3.0)]
    rrf = fusion.reciprocal_rank(lists, 3).orderBy("rank").collect()
    assert [(r.doc_id, round(r.score, 9)) for r in rrf] == [("b", round(1 / 62 + 1 / 61, 9)), ("a", round(1 / 61, 9)), ("c", round(1 / 62, 9))]
