"""Searches straight from texts: the texts are read once, and terms are those of the analyzer."""

import pytest
from pyspark.sql import functions as F

from sparquill import queries as engine
from sparquill.functions.analysis import Analyzer, joined, tokens
from sparquill.functions.porter2 import stem
from sparquill.operators import build
from sparquill.plans import search as plan
from sparquill.plans.query_parser import parse

SF = "/root/testdata/sf0.001"


def test_joined_terms(spark):
    texts = ["", " ", None, "İstanbul ΣΑΣ ΟΔΟΣ Straße ǅ K ⅠⅡ ٣٤ éx", "a--b  c. d\n1.5 x_y", "日本 語 Ⓐ ª", "A" * 50 + "!?"]
    texts += [f"a{chr(c)}B {chr(c)}{chr(c)} {chr(c)}Σ" for c in range(1, 0x3000)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    assert not docs.filter(~F.array_join(tokens("text"), " ").eqNullSafe(joined("text"))).collect()


@pytest.mark.parametrize("name", ["phrase_boost", "synonym_expand"])
def test_texts_are_read_once(spark, name):
    """What the result is computed from are narrow rows, not the documents again."""
    assert "documents.parquet" not in engine.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert not any("documents.parquet" in f for f in engine.queries()[name](spark, SF).inputFiles())


def test_stemmed_reads_no_postings(spark):
    assert not any("documents.parquet" in f for f in engine.queries()["stemmed_topk"](spark, SF).inputFiles())


def test_stems_by_form(spark):
    """Each form of a stem counts, also where there are many; other terms with the first letter do not."""
    texts = ["licenses licensed a license", "licensing", "lice light", "works working worked", "the of", ""]
    texts += [f"work{'s' * (i % 2)} w{i}ing" for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    a = Analyzer(stemming=True, stop_words=True)
    query = parse("licenses OR works", a)
    want = plan.search(build.build(docs, a), query, 70, digits=6).collect()
    assert plan.scan_search(docs, query, 70, analyzer=a, digits=6).collect() == want
    forms = plan.stem_forms(docs, a, ["licens", "work"])
    assert sorted(forms["licens"]) == ["license", "licensed", "licenses", "licensing"]
    assert all(stem(f) == "work" for f in forms["work"]) and len(forms["work"]) == 4


def test_two_phase_reads_texts_once(spark):
    assert not any("documents.parquet" in f for f in engine.queries()["two_phase_topk"](spark, SF).inputFiles())
