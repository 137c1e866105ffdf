"""The index queries against their SQL over tables with documents without text and with equal scores."""

import shutil

import duckdb
import pytest

from sparquill import queries as engine
from sparquill.functions.analysis import Analyzer
from sparquill.operators import build

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """Documents without text, and copies with ids of more digits, so that equal scores have to be told apart by number."""
    at = tmp_path_factory.mktemp("odd")
    shutil.copy(f"{SF}/benchmark.parquet", at / "benchmark.parquet")
    duckdb.sql(f"""COPY (SELECT doc_id, text, lang FROM read_parquet('{SF}/documents.parquet')
        UNION ALL SELECT doc_id + 10000, text, lang FROM read_parquet('{SF}/documents.parquet') WHERE doc_id % 3 = 0
        UNION ALL SELECT 1000 + i, '', 'en' FROM range(40) AS t(i)) TO '{at}/documents.parquet' (FORMAT parquet)""")
    return str(at)


def same(spark, odd, name):
    got = engine.queries()[name](spark, odd)
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{odd}/{t}.parquet')")
    want = con.execute(engine.oracle_sql()[name])
    names = [c[0] for c in want.description]

    def rows(data):
        return sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in data), key=repr)

    assert rows(got.select(*names).collect()) == rows(want.fetchall())


def test_changelog_stream(spark, odd):
    same(spark, odd, "changelog_stream")


def test_compact_stats(spark, odd):
    same(spark, odd, "compact_stats")


def test_index_shard_counts(spark, odd):
    same(spark, odd, "index_shard_counts")


def test_index_log(spark, odd):
    same(spark, odd, "index_log")


def test_index_bm25f_topk(spark, odd):
    same(spark, odd, "index_bm25f_topk")


def test_index_per_shard_topk(spark, odd):
    same(spark, odd, "index_per_shard_topk")


def test_index_topk(spark, odd):
    same(spark, odd, "index_topk")


def test_index_pending_topk(spark, odd):
    same(spark, odd, "index_pending_topk")


@pytest.mark.parametrize("stemming", [False, True])
def test_document_terms(spark, stemming):
    """Terms counted by document are the postings, and no text is grouped for them."""
    docs = spark.createDataFrame([("a", "Red red, fishes fish", 1), ("b", "", 2), ("c", None, 3), ("d", "İΣ x", 4)], "doc_id string, text string, seq bigint")
    a = Analyzer(stemming=stemming, stop_words=stemming)
    counted = build.document_terms(docs, a, extra=("seq",))
    assert {r.doc_id: r.dl for r in counted.collect()} == {r.doc_id: r.dl for r in build.analyzed(docs, a).collect()}
    got = build.exploded(counted, extra=("seq",))
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, build.postings(docs, a, extra=("seq",)).collect()))
