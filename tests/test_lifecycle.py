"""The persistent index, its merge policy, and a replica that follows its log."""

import random

import pytest
from pyspark.sql import functions as F

from sparquill.config import Config
from sparquill.operators.lifecycle import Index
from sparquill.operators.policy import MB, TieredPolicy
from sparquill.operators.store import Conflict
from sparquill.streaming.follow import ATTEMPTS, Follower, Gap

DOCS = [
    {"id": "a", "text": "red fish and blue fish", "metadata": {"k": "1"}},
    {"id": "b", "text": "one red car"},
    {"id": "c", "text": "blue sky over the blue sea"},
    {"id": "d", "text": "a green tree"},
]


def hits(index, q, **kw):
    return [(h["doc_id"], round(h["score"], 6)) for h in index.search(q, snippet=False, **kw)]


def test_search_does_not_depend_on_layout(spark, tmp_path):
    index = Index(spark, f"file://{tmp_path}/i")
    assert index.upsert(DOCS[:2]) == {"indexed": 2, "failed": 0}
    fresh = hits(index, "red")
    assert [i for i, _ in fresh] == ["b", "a"]  # the shorter text first
    index.flush()
    assert index.pending() == 0 and hits(index, "red") == fresh
    index.upsert(DOCS[2:])
    index.upsert([{"id": "a", "text": "only green now"}])
    index.delete(["b"])
    before = {q: hits(index, q) for q in ("red", "blue", "green", "+blue sea", "green -tree", '"blue sky" tree')}
    assert before["red"] == [] and [i for i, _ in before["blue"]] == ["c"]
    assert [i for i, _ in before["green -tree"]] == ["a"]
    index.flush()
    assert {q: hits(index, q) for q in before} == before
    assert index.segments().count() == 2
    assert index.segments().agg(F.sum("deleted_docs")).first()[0] == 2
    assert index.force_merge(1) == 1
    assert {q: hits(index, q) for q in before} == before
    assert index.segments().agg(F.sum("deleted_docs")).first()[0] == 0
    assert index.vacuum() == 2 and {q: hits(index, q) for q in before} == before
    again = Index(spark, f"file://{tmp_path}/i")
    assert {q: hits(again, q) for q in before} == before
    seq = again.manifest["seq"]
    again.reset()
    assert hits(again, "green") == [] and again.manifest["seq"] == seq
    again.upsert(DOCS)
    assert again.manifest["seq"] == seq + 4 and len(hits(again, "blue")) == 2


def test_inputs_and_failures(spark, tmp_path):
    index = Index(spark, f"file://{tmp_path}/i")
    assert index.upsert([{"id": "", "text": "x"}, {"id": "n", "text": ""}, {"id": None, "text": "x"}, *DOCS]) == {"indexed": 4, "failed": 3}
    with pytest.raises(ValueError):
        index.upsert([{"id": "z", "text": None}, {"id": "y", "text": "word"}], strict=True)
    assert index.search("word") == []
    lines = spark.createDataFrame([('{"id": "j", "text": "from a line"}',), ("{broken",), ("",)], "value string")
    assert index.upsert_ndjson(lines) == {"indexed": 1, "failed": 1}
    assert [h["doc_id"] for h in index.search("line")] == ["j"]
    assert index.search("") == index.search("-red") == []
    assert len(index.search("red blue green", top_k=2)) == 2 and len(index.search("red blue green", top_k=0)) == 4
    first = index.search("fish")[0]
    assert first["metadata"] == {"k": "1"} and "fish" in first["snippet"] and first["rank"] == 1
    assert index.warm(5) > 0 and index.health()["status"] == "ok"
    batch = index.search_batch(spark.createDataFrame([(1, "red fish"), (2, "none here"), (3, "blue")], "qid int, text string"), 2)
    assert {(r.qid, r.doc_id) for r in batch.filter("rank = 1").collect()} >= {(1, "a"), (3, "c")}


@pytest.mark.parametrize("fusion", ["score", "rrf"])
def test_shards(spark, tmp_path, fusion):
    index = Index(spark, f"file://{tmp_path}/i", Config(num_shards=3, global_fusion=fusion))
    index.upsert(DOCS)
    assert sorted(h["doc_id"] for h in index.search("red blue", per_shard=True)) == ["a", "b", "c"]
    rows = index.shards().collect()
    assert len(rows) == 3 and sum(r.docs for r in rows) == 4


def test_fields(spark, tmp_path):
    index = Index(spark, f"file://{tmp_path}/i", Config(scorer="bm25f"))
    index.upsert([{"id": "t", "text": "x", "fields": {"title": "needle", "body": "hay hay"}}, {"id": "b", "text": "x", "fields": {"title": "hay", "body": "needle hay"}}, {"id": "p", "text": "needle in plain text"}])
    assert [h["doc_id"] for h in index.search("needle")][0] == "t"
    assert len(index.search("needle")) == 3


def test_format_is_checked(spark, tmp_path):
    index = Index(spark, f"file://{tmp_path}/i")
    index.manifests.save(index.manifest | {"format": 1, "version": 99})
    with pytest.raises(ValueError):
        Index(spark, f"file://{tmp_path}/i")
    index.files.create("old/manifest.json", "{}")
    with pytest.raises(ValueError):
        Index(spark, f"file://{tmp_path}/i/old")


def test_policy_as_list_and_as_table(spark):
    rnd = random.Random(3)
    for case in range(4):
        segments = [{"segment_id": k, "level": rnd.randrange(2), "doc_count": 100, "deleted_docs": rnd.randrange(60), "size_bytes": rnd.randrange(1, 20 * MB)} for k in range(30)]
        policy = TieredPolicy(max_merge_size_bytes=(0, 30 * MB, 1, 60 * MB)[case])
        frame = policy.select_merge_frame(spark.createDataFrame(segments)).orderBy("place").collect()
        picked = policy.select_merge(segments)
        assert [r.segment_id for r in frame] == [s["segment_id"] for s in picked] and len(picked) >= 2
    assert TieredPolicy().select_merge(segments[:5]) == []
    assert [s["segment_id"] for s in TieredPolicy().select_expunge([{"segment_id": 1, "doc_count": 4, "deleted_docs": 1}, {"segment_id": 2, "doc_count": 0, "deleted_docs": 0}, {"segment_id": 3, "doc_count": 5, "deleted_docs": 1}])] == [1]


CHANGE = "seq bigint, op string, doc_id string, text string, fields map<string,string>, metadata map<string,string>, ts timestamp"


def changes(spark, *rows):
    return spark.createDataFrame([(*r, None, None, None) for r in rows], CHANGE)


def test_replica(spark, tmp_path):
    main, copy = Index(spark, f"file://{tmp_path}/a"), Index(spark, f"file://{tmp_path}/b")
    main.upsert(DOCS)
    main.delete(["b"])
    follower = Follower(copy)
    follower.start(f"file://{tmp_path}/a/changelog", f"file://{tmp_path}/at").awaitTermination()
    assert follower.applied == 5 and hits(copy, "red blue") == hits(main, "red blue")
    main.upsert([{"id": "e", "text": "red again"}])
    follower.start(f"file://{tmp_path}/a/changelog", f"file://{tmp_path}/at").awaitTermination()
    assert follower.applied == 6 and hits(copy, "red") == hits(main, "red")


def test_order_gaps_and_dead_letters(spark, tmp_path):
    index = Index(spark, f"file://{tmp_path}/i")
    follower = Follower(index, f"file://{tmp_path}/dead")
    follower.batch(changes(spark, (1, "index", "x", "red"), (2, "index", "y", "blue"), (2, "index", "y", "blue")))
    assert follower.applied == 2
    follower.batch(changes(spark, (2, "index", "y", "blue")))  # once more: nothing happens
    assert follower.applied == 2 and index.documents().count() == 2
    with pytest.raises(Gap):
        follower.batch(changes(spark, (4, "index", "z", "red")))
    bad = changes(spark, (3, "index", "z", "red"), (4, "index", "", "red"), (5, "index", "w", "red"))
    for _ in range(ATTEMPTS - 1):
        with pytest.raises(ValueError):
            follower.batch(bad)
        assert follower.applied == 3
    follower.batch(bad)
    assert follower.applied == 5 and follower.set_aside == 1
    assert spark.read.json(f"file://{tmp_path}/dead").count() == 1
    assert sorted(h["doc_id"] for h in index.search("red", snippet=False)) == ["w", "x", "z"]
    follower.batch(changes(spark, (6, "reset", None, None), (7, "index", "n", "red")))
    assert [h["doc_id"] for h in index.search("red", snippet=False)] == ["n"]


def test_log_goes_on_after_a_stop_before_the_manifest(spark, tmp_path):
    path = f"file://{tmp_path}/i"
    index = Index(spark, path)
    index.upsert(DOCS[:1])

    class Stopped(Exception):
        pass

    def stop():
        raise Stopped

    index._save = stop
    with pytest.raises(Stopped):
        index.upsert([{"id": "x", "text": "red logged"}, {"id": "y", "text": "red too"}])
    again = Index(spark, path)
    assert again.manifest["seq"] == 3 and [i for i, _ in hits(again, "logged")] == ["x"]
    again.upsert([{"id": "z", "text": "red later"}])
    log = sorted((r.seq, r.doc_id) for r in again.changelog().collect())
    assert log == [(1, "a"), (2, "x"), (3, "y"), (4, "z")] and again.log_faults().count() == 0
    with pytest.raises(Conflict):  # the first writer goes on as if it were alone
        del index._save
        index.manifest["seq"] = 1
        index.upsert([{"id": "w", "text": "red"}])
    assert Index(spark, path).changelog().count() == 4


def test_a_reset_in_the_log_is_replayed(spark, tmp_path):
    index = Index(spark, f"file://{tmp_path}/i")
    index.upsert(DOCS[:2])
    index.flush()
    index._save = lambda: None
    index.apply(changes(spark, (3, "reset", None, None), (4, "index", "n", "red")))
    again = Index(spark, f"file://{tmp_path}/i")
    assert [i for i, _ in hits(again, "red")] == ["n"] and again.manifest["floor"] == 3


def test_a_stop_between_generation_and_manifest_loses_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/i"
    index = Index(spark, path)
    index.upsert(DOCS)
    index.flush()
    index.upsert([{"id": "a", "text": "only green now"}])
    index.delete(["b"])
    before = {q: hits(index, q) for q in ("red", "green", "blue")}
    index._save = lambda: None
    index.flush()
    again = Index(spark, path)
    assert again.pending() == 2 and {q: hits(again, q) for q in before} == before
    assert len(again.files.names("gen")) == 2
    (tmp_path / "i" / ".part-left").write_text("a manifest that was not named")
    again.flush()
    assert again.vacuum() == 1 and {q: hits(again, q) for q in before} == before
    assert not (tmp_path / "i" / ".part-left").exists() and not list((tmp_path / "i" / "staged").iterdir())
    assert {q: hits(Index(spark, path), q) for q in before} == before


def test_a_torn_manifest_is_passed_over(spark, tmp_path):
    path = f"file://{tmp_path}/i"
    index = Index(spark, path)
    index.upsert(DOCS)
    index.flush()
    index.files.create(f"manifest/{index.manifest['version'] + 1:012d}.json", '{"segments": [')
    again = Index(spark, path)
    assert again.manifest["segments"] == index.manifest["segments"] and len(hits(again, "red")) == 2
    assert again.vacuum() == 0


def test_faults_of_a_log_are_found(spark, tmp_path):
    index = Index(spark, f"file://{tmp_path}/i")
    index.apply(changes(spark, (1, "index", "a", "x"), (2, "index", "b", "x"), (2, "index", "b", "x"), (5, "index", "c", "x")))
    assert sorted(map(tuple, index.log_faults().collect())) == [(2, 2), (3, 0)]


def test_figures_of_the_manifest_are_those_of_the_live_view(spark, tmp_path):
    rnd = random.Random(9)
    index = Index(spark, f"file://{tmp_path}/i", Config(scorer="bm25f", merge_after_flush=False))
    now = {}
    for turn in range(4):
        docs = [{"id": str(rnd.randrange(12)), "text": " ".join(rnd.choice("red blue green sky".split()) for _ in range(rnd.randrange(1, 9)))} for _ in range(8)]
        docs = list({d["id"]: d for d in docs}.values())
        index.upsert(docs)
        now |= {d["id"]: d["text"] for d in docs}
        gone = [str(rnd.randrange(12))]
        index.delete(gone)
        now.pop(gone[0], None)
        if turn != 3:
            index.flush()
        v = index.view()
        assert (v.n, v.total, v.fields["body"]) == (len(now), sum(len(t.split()) for t in now.values()), (len(now), sum(len(t.split()) for t in now.values())))
        assert {r.doc_id: r.text for r in index.documents().collect()} == now
    plain = Index(spark, f"file://{tmp_path}/plain", Config(scorer="bm25f"))
    plain.upsert([{"id": i, "text": t} for i, t in now.items()])
    assert sorted(hits(index, "red sky")) == sorted(hits(plain, "red sky"))
    assert index.compact(index.manifest["segments"]) and sorted(hits(index, "red sky")) == sorted(hits(plain, "red sky"))


def test_a_search_reads_its_terms_and_a_warm_one_the_cache(spark, tmp_path):
    index = Index(spark, f"file://{tmp_path}/i")
    index.upsert(DOCS)
    index.flush()
    index.upsert([{"id": "b", "text": "a new red car"}])
    index.flush()
    cold = hits(index, "red blue")
    ranked, _ = index.ranked(index.parse("red blue"), 10)
    text = ranked._jdf.queryExecution().executedPlan().toString()
    assert "In(term, [" in text and "InMemoryTableScan" not in text.replace("InMemoryTableScan [doc_id", "")  # void documents are in memory
    assert index._texts(["a"], True)._jdf.queryExecution().executedPlan().toString().count("EqualTo(doc_id,a)") + index._texts(["a", "b"], True)._jdf.queryExecution().executedPlan().toString().count("In(doc_id, [a,b])") >= 1
    assert index.warm(3) > 0 and index.health()["warm"]
    common = sorted(index.warmed[1])
    ranked, _ = index.ranked(index.parse(common[0]), 10)
    assert "InMemoryTableScan [term" in ranked._jdf.queryExecution().executedPlan().toString()
    assert hits(index, "red blue") == cold
    index.upsert([{"id": "q", "text": "red"}])
    assert not index.health()["warm"] and "q" in [i for i, _ in hits(index, "red")]


def test_missing_generations_degrade_a_search(spark, tmp_path):
    index = Index(spark, f"file://{tmp_path}/i")
    for d in DOCS[:2]:
        index.upsert([d])
        index.flush()
    assert not index.search("red").degraded
    lost = index.manifest["segments"][0]["path"]
    index.files.delete(f"{lost}/postings/_SUCCESS")
    again = Index(spark, f"file://{tmp_path}/i")
    found = again.search("red")
    assert [h["doc_id"] for h in found] == ["b"] and found.degraded and again.health()["status"] == "degraded"
    again.files.delete(f"{index.manifest['segments'][1]['path']}/postings/_SUCCESS")
    with pytest.raises(OSError):
        again.search("red")


def test_flushes_and_merges_by_themselves(spark, tmp_path):
    index = Index(spark, f"file://{tmp_path}/i", Config(max_buffer_docs=2, segments_per_tier=2, idle_flush_seconds=60))
    index.upsert(DOCS[:2])
    assert index.pending() == 0 and len(index.manifest["segments"]) == 1
    index.delete(["a", "zz"])  # deletions fill it too
    assert index.pending() == 0 and index.manifest["segments"][0]["deleted_docs"] == 1
    index.upsert(DOCS[2:3])
    assert not index.flush_if_idle(index.manifest["changed_at"] + 59) and index.pending() == 1
    assert index.flush_if_idle(index.manifest["changed_at"] + 61) and index.pending() == 0
    index.upsert([DOCS[0], DOCS[3]])  # a third generation of the level: the policy merges
    assert [s["level"] for s in index.manifest["segments"]] == [1]
    assert sorted(r.doc_id for r in index.documents().collect()) == ["a", "b", "c", "d"]
    small = Index(spark, f"file://{tmp_path}/s", Config(max_buffer_mb=0))
    small.upsert(DOCS[:1])
    assert small.pending() == 0
    assert small.vacuum(log=True) == 0 and [i for i, _ in hits(small, "red")] == ["a"]


def test_attempts_add_up_over_restarts(spark, tmp_path):
    bad = changes(spark, (1, "index", "a", "red"), (2, "index", "", "red"))
    for n in range(ATTEMPTS):
        follower = Follower(Index(spark, f"file://{tmp_path}/i"), f"file://{tmp_path}/dead")
        if n < ATTEMPTS - 1:
            with pytest.raises(ValueError):
                follower.batch(bad)
        else:
            follower.batch(bad)
    assert follower.applied == 2 and follower.set_aside == 1
    assert Index(spark, f"file://{tmp_path}/i").manifest["seq"] == 2
