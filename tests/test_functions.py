"""Analysis, query grammar, scoring, routing, snippets: rules on small examples."""

import math

import pytest
from pyspark.sql import functions as F

from sparquill.config import Config
from sparquill.functions.analysis import Analyzer, Synonyms, tokenize, tokens, without_stop_words
from sparquill.functions.porter2 import stem
from sparquill.functions.query_text import preprocess, preprocess_column
from sparquill.functions.routing import Ring, ring_hash, ring_hash_column
from sparquill.functions.scoring import BM25, BM25F, TFIDF, scorer_for
from sparquill.functions.snippet import sentences, snippet
from sparquill.plans.query_parser import parse

TEXTS = ["", "Hello, World! x2", "don't—stop", "ΣΟΦΟΣ İstanbul", "日本語 テスト ٣٤", "áb é", "___ -- !", None]


def test_tokens_on_both_sides(spark):
    got = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string").select("i", tokens("t").alias("x")).orderBy("i").collect()
    for r, t in zip(got, TEXTS):
        assert (r.x or []) == tokenize(t or ""), t
    assert tokenize("Hello, World! x2") == ["hello", "world", "x2"]
    assert tokenize("don't—stop") == ["don", "t", "stop"]


def test_stop_words_keep_order_and_repeats(spark):
    df = spark.createDataFrame([(["the", "cat", "the", "cat", "7"],)], "t array<string>")
    assert df.select(without_stop_words(F.col("t"), ["the"]).alias("t")).first().t == ["cat", "cat", "7"]


@pytest.mark.parametrize(
    "word,want",
    [("running", "run"), ("flies", "fli"), ("generously", "generous"), ("happy", "happi"), ("cats", "cat"), ("agreed", "agre"), ("hopping", "hop"), ("nationality", "nation"), ("skies", "sky"), ("dying", "die"), ("by", "by"), ("licenses", "licens")],
)
def test_stems(word, want):
    assert stem(word) == want


def test_synonyms_are_not_transitive():
    s = Synonyms.parse("# note\ncar, auto\nauto, vehicle\nlone\n")
    assert s.of("car") == ["auto"]
    assert s.of("auto") == ["car", "vehicle"]
    assert s.of("lone") == []
    assert Analyzer().with_synonyms("car", s) == ["car", "auto"]


def test_preprocess(spark):
    for q in ("What's   up??", "I CAN'T go!", "  plain  words ", ""):
        got = spark.createDataFrame([(q,)], "q string").select(preprocess_column("q")).first()[0]
        assert got == preprocess(q), q
    assert preprocess("I CAN'T go!") == "I cannot go"
    assert preprocess("Don't they're  LET'S who's!?") == "do not they are let us who's"
    assert preprocess("ain't o'clock?") == "ain't o'clock"


def test_grammar():
    p = parse("+a b -c NOT d")
    assert (p.must, p.should, p.excluded) == (["a"], ["b"], ["c", "d"])
    p = parse("x AND y z")
    assert (p.must, p.should) == (["x", "y"], ["z"])
    p = parse("x OR y")
    assert (p.must, p.should) == ([], ["x", "y"])
    p = parse('"a b" c')
    assert p.phrases == [["a", "b"]] and p.should == ["a", "b", "c"]
    assert parse('NOT "a b"').excluded == ["a", "b"]
    assert parse("a a b").weights == {"a": 2, "b": 1}
    assert parse("").terms == []
    assert parse("A AND NOT B C").must == ["a", "c"]  # the AND outlives the NOT
    assert parse("x +a AND b").must == ["a", "x", "b"]  # the AND is bound to the last optional word
    p = parse("+car", Analyzer(), Synonyms([("car", "auto")]))
    assert p.must == ["car", "auto"]
    assert parse("-car", Analyzer(), Synonyms([("car", "auto")])).excluded == ["car", "auto"]
    assert parse("a -b").key() != parse("a b").key() != parse('"a b"').key()
    p = parse('"foo bar')
    assert "foo" in p.terms and "bar" in p.terms


def test_scores():
    n, df, tf, dl, avg = 10, 3, 2, 50, 40
    idf = math.log((n - df + 0.5) / (df + 0.5) + 1)
    assert BM25().score(tf, df, dl, avg, n) == pytest.approx(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg)))
    assert TFIDF().score(tf, df, dl, avg, n) == pytest.approx(math.log(n / df) * math.log(1 + tf))
    assert BM25F().score(1500, df, dl, avg, n) == pytest.approx(idf * 2.2 * 1.5 / (1.2 + 1.5))
    assert isinstance(scorer_for("tfidf"), TFIDF) and isinstance(scorer_for("bm25f"), BM25F) and isinstance(scorer_for("other"), BM25)


def _fnv_mix(s):
    h = 2166136261
    for b in s.encode():
        h = (h ^ b) * 16777619 % 2**32
    h = (h ^ h >> 16) * 0x85EBCA6B % 2**32
    h = (h ^ h >> 13) * 0xC2B2AE35 % 2**32
    return h ^ h >> 16


def test_ring(spark):
    keys = ["", "a", "doc-1", "ключ", "日本"] + [str(i) for i in range(500)]
    ring = Ring(4)
    got = spark.createDataFrame([(k,) for k in keys], "k string").select("k", ring_hash_column("k").alias("h"), ring.column("k").alias("s")).collect()
    for r in got:
        assert r.h == ring_hash(r.k) == _fnv_mix(r.k)
        assert r.s == ring.shard_for(r.k)
    assert {r.s for r in got} == {0, 1, 2, 3}
    more = Ring(5)
    assert sum(ring.shard_for(k) != more.shard_for(k) for k in keys) < len(keys) / 2


def test_snippets():
    text = "First one. " + "filler words here. " * 20 + "The needle is in this sentence. " + "more text. " * 20
    got = snippet(text, ["needle", "first"], {"needle": 5.0, "first": 1.0})
    assert "needle" in got and got.startswith("…") and got.endswith("…") and len(got) <= 202
    assert snippet("short text", ["absent"], {}) == "short text"
    assert snippet(None, ["x"]) == snippet("", ["x"]) == ""
    assert sentences("A b. C!\nD") and sentences("") == []


def test_config(tmp_path):
    path = tmp_path / "settings.yaml"
    path.write_text("index:\n  bm25_k1: 0.9 # saturation\n  stemming: true\n")
    assert Config.load(env={}) == Config()
    assert Config.load(str(path), env={}).bm25_k1 == 0.9 and Config.load(str(path), env={}).stemming
    assert Config.load(str(path), env={"SPARQUILL_BM25_K1": "1.5"}).bm25_k1 == 1.5
    assert Config.load(env={"SPARQUILL_NUM_SHARDS": "many"}).num_shards == 1
    path.write_text("unknown: 1\n")
    with pytest.raises(ValueError):
        Config.load(str(path), env={})
