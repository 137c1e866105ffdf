import zlib

from sparquill.llm import toxicity as T

from .conftest import make, words


def brute_segments(scores):
    """All maximal segments by their definition: the best (longest of equals) part, then left and right of it."""
    best = None
    for a in range(len(scores)):
        for b in range(a + 1, len(scores) + 1):
            s = sum(scores[a:b])
            if s > 0 and (best is None or s > best[2]):
                best = (a, b, s)
    if not best:
        return []
    a, b, s = best
    left = [(x, y, v) for x, y, v in brute_segments(scores[:a])]
    right = [(x + b, y + b, v) for x, y, v in brute_segments(scores[b:])]
    return [*left, (a, b, s), *right]


def test_segments_match_their_definition(rnd):
    for _ in range(400):
        x = [rnd.choice((-7, -5, -3, -2, 1, 2, 3, 6)) + rnd.random() * 0.01 for _ in range(rnd.randrange(14))]
        got = [(a, b, round(s, 6)) for a, b, s in T.segments(x)]
        assert got == [(a, b, round(s, 6)) for a, b, s in brute_segments(x)]


def corpus(rnd, n=600):
    rows, labels = [], []
    for i in range(n):
        w = words(rnd, rnd.randrange(20, 80), 3000).split()
        toxic = i % 5 == 0
        if toxic:
            for _ in range(4):
                w.insert(rnd.randrange(len(w)), rnd.choice(("vile", "foul", "nasty")))
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_held_out_accuracy_and_edge_rows(spark, rnd, odd):
    rows, labels = corpus(rnd)
    extra = [(None if i is None else i + 10_000, t) for i, t in odd]
    docs = make(spark, rows + extra, "score predicted toxic")
    lab = spark.createDataFrame([*labels, (None, 1, 1), (3, 1, None), (10, None, 1)], "doc_id bigint, quality int, toxic int")
    model = T.fit(docs, lab)
    out = T.score(docs, model).collect()
    assert len(out) == len(rows) + len(odd)
    truth = {i: t for i, _, t in labels}
    held = [r for r in out if r.held_out and r.doc_id in truth]
    assert len(held) > 80 and all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in held)
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out)
    empty = {r.score for r in out if r.doc_id in (10_002, 10_003)}
    assert empty == {model.score(None)} and model.score(None) < 0.3
    assert len({r.score for r in out if r.doc_id == 10_005}) == 1
    kept = T.clean(docs, model)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in out if not r.predicted}


def test_labels_of_held_out_rows_are_never_read(spark, rnd):
    rows, labels = corpus(rnd, 200)
    docs = make(spark, rows)
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 4 == 2 else t) for i, q, t in labels]
    a, b = (T.fit(docs, spark.createDataFrame(x, "doc_id bigint, quality int, toxic int")) for x in (labels, flipped))
    assert a == b


def test_no_labels_and_no_rows(spark):
    docs = make(spark, [(1, "a b"), (2, None)])
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    model = T.fit(docs, none)
    assert {r.predicted for r in T.score(docs, model).collect()} == {0}  # nothing is known to be toxic
    assert T.score(make(spark, []), model).count() == 0


def test_without_both_classes_nothing_is_flagged(spark, rnd):
    rows, _ = corpus(rnd, 40)
    docs = make(spark, rows)
    for labels in ([], [(i, 1, 1) for i in range(40)], [(i, 1, 0) for i in range(40)], [(i, 1, i % 2) for i in range(4)]):
        model = T.fit(docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
        assert T.clean(docs, model).count() == 40, labels


def test_fitted_figures_match_their_definition(spark, rnd):
    """Log-odds, the prior, the words that count, K and the curve, by plain counting over the same rows."""
    import math
    import re
    from collections import Counter

    import numpy as np

    rows, labels = corpus(rnd, 300)
    model = T.fit(make(spark, rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    of = {i: t for i, _, t in labels}
    used = [(t, of[i]) for i, t in rows if zlib.crc32(str(i).encode()) % 4 != 2]
    count, inside = (Counter(), Counter()), (Counter(), Counter())
    for t, y in used:
        w = re.findall(r"\w+", t.lower())
        w += [x[:6] + "*" for x in w if len(x) > 6]
        count[y].update(w)
        inside[y].update(set(w))
    n = [sum(y == k for _, y in used) for k in (0, 1)]
    total = [sum(c.values()) for c in count]
    want, hit = {}, [0, 0]
    for w in inside[1]:
        d = [inside[0][w], inside[1][w]]
        q = sum(d) / sum(n)
        c = [d[k] + 0.2 * n[k] * q for k in (0, 1)]
        m = [n[k] * 1.2 - c[k] + 0.5 for k in (0, 1)]
        z = (math.log(c[1] / m[1]) - math.log(c[0] / m[0])) / math.sqrt(sum(1 / x for x in (*c, *m)))
        if d[1] >= 3 and z >= 2.8:
            hit = [h + count[k][w] for k, h in enumerate(hit)]
            share = (count[0][w] + count[1][w]) / sum(total)
            p = [(count[k][w] + 0.2 * total[k] * share) / (total[k] * 1.2) for k in (0, 1)]
            if p[1] > p[0]:
                want[w] = math.log(p[1] / p[0])
    assert model.words.keys() == want.keys() and {"vile", "foul", "nasty"} <= want.keys()
    assert all(abs(model.words[w] - s) < 1e-9 for w, s in want.items())
    other = math.log((1 - hit[1] / (total[1] + 1)) / (1 - hit[0] / (total[0] + 1)))
    assert abs(model.other - min(other, -1e-6)) < 1e-9

    def parts(t):
        w = re.findall(r"\w+", t.lower())
        return len(w), [s for _, _, s in brute_segments([want.get(x) or want.get(x[:6] + "*") or other for x in w])]

    seen = [(*parts(t), y) for t, y in used[:60]]
    for (n_words, s, _), (t, _) in zip(seen, used):
        got_n, got = model.passages(t)
        assert got_n == n_words and np.allclose(sorted(x for _, _, x in got), sorted(s))
    least = min(want.values())
    clean = [model.passages(t) for t, y in used if not y]
    over = sum(s >= least for _, f in clean for _, _, s in f)
    assert abs(model.log_k - (math.log((over + 0.5) / (sum(k for k, _ in clean) + 1)) + least)) < 1e-9
    x = np.array([[1.0, *model.evidence(*model.passages(t))] for t, _ in used])
    p = 1 / (1 + np.exp(-np.clip(x @ np.array(model.curve), -30, 30)))
    slope = x.T @ (np.array([y for _, y in used]) - p) - np.array([1e-6, 0.01, 0.01]) * np.array(model.curve)
    assert abs(slope).max() < 1e-4  # the curve is where the penalised likelihood is greatest
