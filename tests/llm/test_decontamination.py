from sparquill.llm import decontamination as D

from .conftest import make, words


def distance(p, t):
    """Least edits of p against any part of t."""
    row = [0] * (len(t) + 1)
    for i, a in enumerate(p):
        new = [i + 1]
        for j, b in enumerate(t):
            new.append(min(row[j] + (a != b), row[j + 1] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_myers_matches_dynamic_programming(rnd):
    for _ in range(300):
        p = "".join(rnd.choice("abc ") for _ in range(rnd.randrange(1, 70)))
        t = "".join(rnd.choice("abc ") for _ in range(rnd.randrange(0, 90)))
        got = D.Myers(p).best(t, len(p))
        assert (got[0] if got else len(p)) == min(distance(p, t), len(p))


def edited(rnd, s, n):
    s = list(s)
    for _ in range(n):
        k, i = rnd.randrange(3), rnd.randrange(len(s))
        if k == 0:
            s[i] = "#"
        elif k == 1:
            s.insert(i, "@")
        elif len(s) > 1:
            del s[i]
    return "".join(s)


def test_all_within_budget_and_no_others(spark, rnd, odd):
    items = [(i, words(rnd, 20)) for i in range(12)] + [(90, None), (91, "  "), (92, "tiny"), (93, words(rnd, 20))]
    docs = list(odd)
    for k in range(80):
        i, t = items[k % 12]
        docs.append((100 + k, words(rnd, 30) + "\n" + edited(rnd, t, rnd.randrange(0, 14)) + "  " + words(rnd, 10)))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r for r in D.contaminated(make(spark, docs, "item_id distance"), bench).collect()}
    want = {}
    for d, t in docs:
        if t and len(t) < 5000:
            for i, x in items:
                x = D.plain(x or "")
                if x and (e := distance(x, D.plain(t))) <= int(D.RATE * len(x)):
                    want[d, i] = e
    assert {k: r.distance for k, r in got.items()} == want and len(want) > 20
    for (d, i), r in got.items():
        text, item = dict(docs)[d], D.plain(dict(items)[i])
        assert distance(item, D.plain(text[r.start : r.end])) == r.distance
    kept = {r.doc_id for r in D.decontaminated(make(spark, docs, "free"), bench).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in want}


def test_blocks_and_empty_tables(spark, monkeypatch, rnd):
    monkeypatch.setattr(D, "BLOCK_ITEMS", 2)
    items = [(i, words(rnd, 12)) for i in range(5)]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    docs = make(spark, [(i, "x " + t + " y") for i, t in items] * 2)
    assert D.contaminated(docs, bench).count() == 10
    assert D.contaminated(make(spark, []), bench).count() == 0
    assert D.contaminated(docs, bench.limit(0)).count() == 0
    assert D.decontaminated(docs, bench.limit(0)).count() == 10


def test_all_piece_hits_are_found(rnd):
    for _ in range(60):
        some = ["é漢😀 ab", "the cat ", "x", "a b c d e f g h ", words(rnd, 3)]
        items = [(k, D.plain("".join(rnd.choice(some) for _ in range(rnd.randrange(1, 12))))) for k in range(8)]
        items = [(k, t) for k, t in items if t]
        block = D.Block(items, 0.08)
        text = D.plain(" ".join(rnd.choice([*some, *(t for _, t in items)]) for _ in range(10)))
        want = {}
        for k, (_, t, e) in enumerate(block.items):
            for start, piece in D.pieces(t, e):
                for p in range(len(text) - len(piece) + 1):
                    if text[p : p + len(piece)] == piece:
                        want.setdefault(k, set()).add(p - start)
        assert dict(block.hits(text)) == want
    assert not D.Block([(1, "a short item of text")], 0.08).hits("")
