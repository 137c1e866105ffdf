"""The queries that have no SQL, against plain restatements of their rules; stems against published examples."""

import math
import re
from collections import Counter

import pandas as pd
import pytest

from sparquill import queries as engine
from sparquill.functions.porter2 import stem
from sparquill.functions.snippet import snippet
from sparquill.sources import readers

SF = "/root/testdata/sf0.001"
# Words and stems of the English stemmer's published sample vocabulary.
STEMS = """consign consign, consigned consign, consigning consign, consignment consign, consist consist, consisted consist, consistency consist, consistent consist, consistently consist, consisting consist,
consists consist, consolation consol, consolations consol, consolatory consolatori, console consol, consoled consol, consoles consol, consolidate consolid, consolidated consolid, consolidating consolid, consoling consol,
consolingly consol, consols consol, consonant conson, consort consort, consorted consort, consorting consort, conspicuous conspicu, conspicuously conspicu, conspiracy conspiraci, conspirator conspir, conspirators conspir,
conspire conspir, conspired conspir, conspiring conspir, constable constabl, constables constabl, constance constanc, constancy constanc, constant constant,
knack knack, knackeries knackeri, knacks knack, knag knag, knave knave, knaves knave, knavish knavish, kneaded knead, kneading knead, knee knee, kneel kneel, kneeled kneel, kneeling kneel, kneels kneel, knees knee, knell knell,
knelt knelt, knew knew, knick knick, knif knif, knife knife, knight knight, knightly knight, knights knight, knit knit, knits knit, knitted knit, knitting knit, knives knive, knob knob, knobs knob, knock knock, knocked knock,
knocker knocker, knockers knocker, knocking knock, knocks knock, knopp knopp, knot knot, knots knot"""


@pytest.mark.parametrize("pair", STEMS.replace("\n", " ").split(", "))
def test_published_stems(pair):
    word, want = pair.split()
    assert stem(word) == want


def texts():
    t = pd.read_parquet(f"{SF}/documents.parquet", columns=["doc_id", "text"])
    return {int(i): x or "" for i, x in zip(t["doc_id"], t["text"])}


def words_of(text):
    return [w.lower() for w in re.findall(r"[^\W_]+", text)]


def best(bags, weights, k=10):
    """Doc ids and scores by BM25 over bags of terms."""
    n, mean = len(bags), sum(sum(b.values()) for b in bags.values()) / len(bags)
    df = {t: sum(t in b for b in bags.values()) for t in weights}
    out = []
    for i, b in bags.items():
        own = [t for t in weights if b[t]]
        if own:
            dl = sum(b.values())
            out.append((round(sum(weights[t] * math.log((n - df[t] + 0.5) / (df[t] + 0.5) + 1) * b[t] * 2.2 / (b[t] + 1.2 * (0.25 + 0.75 * dl / mean)) for t in own), 6), i))
    return sorted(out, key=lambda x: (-x[0], x[1]))[:k]


def test_stemmed_topk(spark):
    from sparquill.functions.analysis import Analyzer

    stop = Analyzer(stop_words=True).stop
    bags = {i: Counter(stem(w) for w in words_of(t) if w not in stop) for i, t in texts().items()}
    want = best(bags, {"licens": 1, "reserv": 1, "work": 1})
    got = [(r.score, r.doc_id) for r in engine.queries()["stemmed_topk"](spark, SF).orderBy("rank").collect()]
    assert [i for _, i in got] == [i for _, i in want] and all(abs(a - b) < 2e-6 for (a, _), (b, _) in zip(got, want))


def plain_snippet(text, terms, idf):
    """The rules one after the other, place by place."""
    if not text:
        return ""
    low, hit, weight = text.lower(), -1, None
    for t in dict.fromkeys(terms):
        p = low.find(t)
        if p >= 0 and (hit < 0 or idf.get(t, 1.0) > weight or idf.get(t, 1.0) == weight and p < hit):
            hit, weight = p, idf.get(t, 1.0)
    spans, a, i = [], 0, 0
    while i < len(text):
        if text[i] in ".!?\n":
            while i < len(text) and text[i] in ".!?\n":
                i += 1
            spans.append((a, i))
            a = i
        else:
            i += 1
    if a < len(text):
        spans.append((a, len(text)))
    start = hit - 100 if hit > 100 else 0
    sentence = next((x for x, y in spans if x <= hit < y), 0)
    if sentence >= start:
        start = sentence
    elif start:
        while start < len(text) and not text[start].isspace():
            start += 1
        while start < len(text) and text[start].isspace():
            start += 1
    end = min(start + 200, len(text))
    close = next((y for x, y in spans if x <= end - 1 <= y), 0)
    if start < close <= end:
        end = close
    elif end < len(text):
        while end > start and not text[end - 1].isspace():
            end -= 1
    return ("…" if start > 0 else "") + text[start:end].strip() + ("…" if end < len(text) else "")


def test_snippets(spark):
    docs = texts()
    terms = ["license", "rights", "reserved"]
    rows = engine.queries()["snippets"](spark, SF).collect()
    want = best({i: Counter(words_of(t)) for i, t in docs.items()}, dict.fromkeys(terms, 1))
    assert [r.doc_id for r in sorted(rows, key=lambda r: r["rank"])] == [i for _, i in want]
    for r in rows:
        assert r.snippet == plain_snippet(docs[r.doc_id], terms, {})
    for i, t in docs.items():
        some = t.lower().split()[5:90:17]
        idf = {w: (len(w) * 7 + i) % 5 / 2 for w in some}
        assert snippet(t, some, idf) == plain_snippet(t, some, idf)


def test_gen_corpus(spark):
    rows = engine.queries()["gen_corpus"](spark, SF).collect()
    again = {r.id: r.text for r in readers.read_source(spark, "gen://1000", seed=42).collect()}
    assert {r.id: r.text for r in rows} == again and sorted(again) == [f"doc-{i:010d}" for i in range(1000)]
    sizes = [len(t.split()) for t in again.values()]
    assert min(sizes) >= 20 and max(sizes) <= 150 and abs(sum(sizes) / 1000 - 85) < 5
    count = Counter(w for t in again.values() for w in t.split())
    assert set(count) <= set(readers.VOCABULARY)
    share = [(1 + r) ** -1.07 for r in range(len(readers.VOCABULARY))]
    for r in (0, 1, 5, 20):
        want = share[r] / sum(share) * sum(sizes)
        assert abs(count[readers.VOCABULARY[r]] - want) < 6 * math.sqrt(want)
    other = {r.id: r.text for r in readers.read_source(spark, "gen://1000", seed=43).collect()}
    assert other != again
