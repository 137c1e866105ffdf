"""The command line, and the sweep over numbers of generations."""

import json

from sparquill.cli import main, sweep_segments
from sparquill.config import Config
from sparquill.operators.lifecycle import Index
from sparquill.sources.readers import dataset


def said(capsys, spark, *argv):
    code = main([str(a) for a in argv], spark)
    return code, [json.loads(x) for x in capsys.readouterr().out.splitlines()]


def test_commands(spark, tmp_path, capsys):
    at = f"file://{tmp_path}/i"
    assert said(capsys, spark, at, "index", "a", "red fish", "--meta", "k=v") == (0, [{"indexed": 1, "failed": 0}])
    assert said(capsys, spark, at, "index", "b", "")[0] == 1
    (tmp_path / "docs.ndjson").write_text('{"id": "c", "text": "blue fish"}\nbroken\n{"id": "d", "text": "red red sky"}\n')
    assert said(capsys, spark, at, "bulk", f"file://{tmp_path}/docs.ndjson")[1] == [{"indexed": 2, "failed": 1}]
    assert said(capsys, spark, at, "ingest", "gen://5")[1][0]["indexed"] == 5
    found = said(capsys, spark, at, "search", "red", "fish", "--top-k", 2)[1]
    assert found[0]["doc_id"] == "a" and found[0]["metadata"] == {"k": "v"} and len(found) == 2
    assert said(capsys, spark, at, "delete", "a")[0] == 0
    assert [h["doc_id"] for h in said(capsys, spark, at, "search", "fish", "--no-snippet")[1]] == ["c"]
    said(capsys, spark, at, "flush")
    assert sum(s["deleted_docs"] for s in said(capsys, spark, at, "segments")[1]) == 1 and said(capsys, spark, at, "health")[1][0]["status"] == "ok"
    assert said(capsys, spark, at, "merge")[1] == [{"segments": 1}]
    assert said(capsys, spark, at, "warm", "--terms", 5)[1][0]["postings"] > 0
    assert said(capsys, spark, at, "shards")[1][0]["docs"] == 7
    (tmp_path / "q.ndjson").write_text('{"qid": "1", "text": "red sky"}\n')
    said(capsys, spark, at, "batch", f"file://{tmp_path}/q.ndjson", f"file://{tmp_path}/run")
    assert spark.read.parquet(f"file://{tmp_path}/run").first().doc_id == "d"
    said(capsys, spark, at, "vacuum")
    assert said(capsys, spark, at, "reset")[0] == 0 and said(capsys, spark, at, "search", "red")[1] == []


def test_sweep(spark, tmp_path):
    index = Index(spark, f"file://{tmp_path}/i", Config(merge_after_flush=False))
    for i, t in enumerate(("red fish", "blue fish", "red sky")):
        index.upsert([{"id": str(i), "text": t}])
        index.flush()
    asked = spark.createDataFrame([("q", "red fish")], "qid string, text string")
    judged = spark.createDataFrame([("q", "0", 1), ("q", "2", 1)], "qid string, doc_id string, rel int")
    rows = sweep_segments(index, asked, judged, [1, 3])
    assert [r["segments"] for r in rows] == [3, 1] and all(r["recall"] == 1.0 and r["p95_ms"] > 0 for r in rows)
    assert len({(r["ndcg"], r["mrr"], r["map"]) for r in rows}) == 1


def test_paths_of_a_dataset(spark, tmp_path):
    for config in ("en", "de"):
        for split in ("train", "test"):
            spark.createDataFrame([(f"{config}-{split}",)], "id string").write.parquet(f"file://{tmp_path}/{config}/{split}")
    at = f"file://{tmp_path}"
    assert [r.id for r in spark.read.parquet(dataset(at, "en", "test")).collect()] == ["en-test"]
    assert spark.read.parquet(dataset(at, split="train")).count() == 2 and spark.read.parquet(dataset(at)).count() == 4
