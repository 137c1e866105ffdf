import hashlib
import math
from collections import Counter

import numpy as np

from sparquill.llm import byte_digest as B

from .conftest import make, words


def test_levels_match_brute_force(rnd):
    for n in (8, 9, 30, 255, 256, 400):
        b = bytes(rnd.choice(b"abcdefgh \n") for _ in range(n))
        w = B.window_of(n)
        got = B.levels(np.frombuffer(b, np.uint8))
        assert len(got) == n - w + 1
        for i in range(n - w + 1):
            h = -sum(c / w * math.log2(c / w) for c in Counter(b[i : i + w]).values())
            assert abs(got[i] - h * B.LEVELS / math.log2(w)) <= 1.001


def rank():
    return np.arange(B.LEVELS)[::-1].copy()


def test_likeness_of_copies_edits_and_strangers(rnd):
    for n in (30, 300, 4000):
        a, b = words(rnd, n, 10**6), words(rnd, n, 10**6)
        x, y, e = (B.chain(t, rank()) for t in (a, b, B.edited(a, b)))
        assert B.likeness(x, x) == 1.0 and B.likeness(x, y) < 0.1 < B.likeness(x, e) < 0.9
        assert B.digest(B.chain(a, rank())) == B.digest(x)
    none = B.chain("", rank())
    assert B.digest(none) == "" and B.likeness(none, none) == 1.0 and B.likeness(none, x) == 0.0


def test_sizes_do_not_part_near_copies(rnd):
    for n in (60, 120, 250, 500, 1000):
        a = words(rnd, n, 10**6)[:n]
        x, y = B.chain(a, rank()), B.chain(a + " and more."[:10], rank())
        assert B.likeness(x, y) > 0.5, n
    a = words(rnd, 99, 10**6)[:300]
    for following in ("", "x", "short one", words(rnd, 99, 10**6)[:80]):
        e = B.edited(a, following)
        assert len(e) < 256 and B.likeness(B.chain(a, rank()), B.chain(e, rank())) > 0.1, following


def test_compared_over_a_table(spark, rnd):
    rows = [(i, words(rnd, rnd.randrange(1, 60), 9999)) for i in rnd.sample(range(10_000), 300)]
    rows += [(20_000, None), (20_001, ""), (-5, "é漢😀 " * 40), (77_777, words(rnd, 5000)), (-7, rows[0][1])]
    check(spark, rows)
    check(spark, rows[:1])
    assert B.compared(make(spark, [])).count() == 0


def test_ties_nulls_and_clashing_names(spark, rnd):
    rows = [(i % 40, words(rnd, 9)) for i in range(200)] + [(3, "same")] * 3 + [(None, "b"), (None, "a"), (None, None)]
    check(spark, rows)
    check(spark, [(None, "b"), (None, "a")])


def check(spark, rows):
    docs = make(spark, rows, "part own head fingerprint")
    r = B.rarity(docs)
    got = [tuple(x)[:5] + (x.near_next,) for x in B.compared(docs).collect()]
    order = sorted(((i, t or "") for i, t in rows), key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))
    want = []
    for k, (i, t) in enumerate(order):
        nxt = order[(k + 1) % len(order)][1]
        e = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        c = B.chain(t, r)
        want.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), B.digest(c), B.digest(B.chain(e, r)), B.likeness(c, B.chain(nxt, r))))
    assert sorted(got, key=repr) == sorted(want, key=repr)


def plain_chain(text, rank):
    """The filters by their definition, one window at a time."""
    b, w = text.encode(), 8
    if not b:
        return []
    mask = (1 << 64) - 1
    if len(b) < w:
        found = [int.from_bytes(hashlib.blake2b(b, digest_size=8).digest(), "little")]
    else:
        ranks = []
        for i in range(len(b) - w + 1):
            n = Counter(b[i : i + w])
            h = math.log2(w) - sum(round(c * math.log2(c) * 2**32) for c in n.values()) / (w * 2**32)
            ranks.append(int(rank[min(B.LEVELS - 1, max(0, int(h * (B.LEVELS / (math.log2(w) + 1e-9)))))]))
        m = len(ranks)
        run = min(32, max(4, m // 8), m)
        votes = Counter(min(range(s, s + run), key=lambda i: (ranks[i], i)) for s in range(m - run + 1))
        found = []
        for i in sorted(i for i, v in votes.items() if v >= min(max(1, run // 4), m - run + 1)):
            h = int.from_bytes(b[i : i + w], "little") * 0x9E3779B97F4A7C15 & mask
            found.append(h ^ h >> 29)
    out = []
    for at in range(0, len(found), 64):
        bits = 0
        for h in found[at : at + 64]:
            for j in range(4):
                bits |= 1 << (1023 - (h >> 13 * j) % 1024)
        out.append(bits)
    return out


def plain_likeness(a, b):
    if not a or not b:
        return float(len(a) == len(b))
    if len(a) > len(b):
        a, b = b, a
    total = 0.0
    for f in a:
        best, n = 0.0, bin(f).count("1")
        for g in b:
            k = bin(g).count("1")
            chance, most = n * k / 1024, min(n, k)
            floor = chance + 0.2 * (most - chance)
            best = max(best, (bin(f & g).count("1") - floor) / max(most - floor, 1e-9))
        total += n * min(1.0, best)
    return min(1.0, total / sum(bin(f).count("1") for f in a))


def test_digest_and_likeness_match_their_definition(rnd):
    ranks = [rank(), np.array(rnd.sample(range(B.LEVELS), B.LEVELS))]
    texts = ["", "a", "short", "12345678", "aaaaaaaaaaaaaaaaaaaa", "é漢😀 " * 9, *(words(rnd, n, 5000) for n in (3, 20, 90, 400, 1200))]
    texts += [t[: len(t) // 2] + words(rnd, 30) for t in texts[-3:]]
    for r in ranks:
        chains = {}
        for t in texts:
            want = plain_chain(t, r)
            chains[t] = want, B.chain(t, r)
            assert B.digest(chains[t][1]) == "".join(f"{x:0256x}" for x in want)
        for _ in range(60):
            (wa, ga), (wb, gb) = chains[rnd.choice(texts)], chains[rnd.choice(texts)]
            assert abs(B.likeness(ga, gb) - plain_likeness(wa, wb)) < 1e-9


def test_likeness_grows_with_texts_and_not_their_square(rnd):
    one = words(rnd, 400_000, 10**6)
    a, b = B.chain(one, rank()), B.chain(one[:1_000_000] + words(rnd, 3000, 10**6) + one[1_000_000:], rank())
    assert len(a) > 2000 and B.likeness(a, b) > 0.7 and B.likeness(a, a) == 1.0
    assert B.likeness(a, B.chain(words(rnd, 400_000, 10**6), rank())) < 0.1


def test_ids_that_are_texts_or_dates(spark, rnd):
    import datetime

    rows = [(i, words(rnd, 20, 999)) for i in rnd.sample(range(1000), 60)]
    for name, to in (("string", lambda i: f"doc-{i:05d}"), ("date", lambda i: datetime.date(2000, 1, 1) + datetime.timedelta(days=i))):
        docs = spark.createDataFrame([(to(i), t) for i, t in rows] + [(None, "last")], f"doc_id {name}, text string")
        got = {r.doc_id: (r.edited_sha256, r.near_next) for r in B.compared(docs).collect()}
        plain = {r.doc_id: (r.edited_sha256, r.near_next) for r in B.compared(make(spark, [*rows, (None, "last")])).collect()}
        assert got == {None if i is None else to(i): x for i, x in plain.items()}


def test_a_passage_counts_wherever_it_stands(rnd):
    whole, part = words(rnd, 60_000, 10**6), words(rnd, 4000, 10**6)
    assert len(B.chain(whole, rank())) > 4 * 64  # further than 64 filters from both ends
    for at in (0, len(whole) // 3, len(whole) // 2, len(whole)):
        a, b = B.chain(part, rank()), B.chain(whole[:at] + part + whole[at:], rank())
        # Where a filter begins elsewhere in the passage, two of the longer text share its features.
        assert B.likeness(a, b) > 0.3 and B.likeness(b, a) == B.likeness(a, b), at
    assert B.likeness(B.chain(part, rank()), B.chain(whole, rank())) < 0.1


def test_likeness_takes_the_best_of_all_filters(rnd, monkeypatch):
    def some(k):
        return np.packbits(np.array([[rnd.random() < p for _ in range(B.BITS)] for p in (rnd.uniform(0.01, 0.4) for _ in range(k))]), axis=1)

    def plain(c):
        return [int.from_bytes(f.tobytes(), "big") for f in c]

    a, b = some(150), some(400)
    b[rnd.sample(range(400), 60)] = a[rnd.sample(range(150), 60)]  # as they are, anywhere
    b[:40] = a[-40:] | some(40) & some(40)  # much alike, far off
    for pairs in (None, 1000, 1):
        if pairs:
            monkeypatch.setattr(B, "PAIRS", pairs)
        for x, y in ((a, b), (b, a), (a[:1], b), (a, a)):
            assert abs(B.likeness(x, y) - plain_likeness(plain(x), plain(y))) < 1e-9
