import pytest

from sparquill.llm import suffix_dedup as S

from .conftest import make, words


def brute(rows, least=50):
    """Word places covered by a passage of ``least`` words that another document has."""
    seen = {}
    for i, t in rows:
        if i is None:
            continue
        w = S.words_of(t)
        for k in range(len(w) - least + 1):
            seen.setdefault(tuple(w[k : k + least]), set()).add(i)
    out = {}
    for i, t in rows:
        w = S.words_of(t)
        for k in range(len(w) - least + 1):
            if i is not None and len(seen[tuple(w[k : k + least])]) > 1:
                out.setdefault(i, set()).update(range(k, k + least))
    return out


def test_every_passage_has_a_common_suffix(rnd):
    import numpy as np

    for _ in range(50):
        p = [rnd.getrandbits(64) for _ in range(S.LEAST)]
        found = []
        for _ in range(2):
            c = [rnd.getrandbits(64) for _ in range(rnd.randrange(30))] + p + [rnd.getrandbits(64) for _ in range(rnd.randrange(30))]
            at = next(k for k in range(len(c)) if c[k : k + 3] == p[:3])
            places = S.minimisers(np.array(c, np.uint64))[0]
            found.append({x - at for x in places.tolist() if 0 <= x - at <= S.LEAST - S.SHINGLE})
        assert found[0] & found[1]


def test_matches_brute_force(spark, rnd, odd):
    shared = [words(rnd, n, 5000) for n in (50, 51, 70, 130, 49)]
    rows = [(None if i is None else i + 1000, t if not t or len(t) < 9999 else words(rnd, 3000, 50_000)) for i, t in odd]
    for k in range(60):
        rows.append((k, words(rnd, rnd.randrange(80), 5000) + " " + shared[k % 5].upper() + "\n" + words(rnd, rnd.randrange(80), 5000)))
    rows += [(k, rows[20][1]) for k in range(200, 230)] + [(300, shared[2] + " x " + shared[2]), (301, "a b " * 400)]
    got = {}
    out = S.repeated(make(spark, rows, "places shingle start_word")).collect()
    for r in out:
        assert r.n_words == r.end_word - r.start_word >= 50 and r.other_doc_id != r.doc_id
        got.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
    want = brute(rows)
    assert got.keys() == want.keys()
    for i, covered in want.items():
        assert got[i] == covered, i


def test_clean_and_empty_tables(spark, rnd):
    assert S.repeated(make(spark, [(i, words(rnd, 300, 100_000)) for i in range(10)])).count() == 0
    assert S.repeated(make(spark, [])).count() == 0
    one = words(rnd, 100, 9999)
    assert S.repeated(make(spark, [(1, one + " " + one), (1, one)])).count() == 0


@pytest.mark.parametrize("together", [2000, 3])
def test_windows_apart_in_the_order(spark, rnd, monkeypatch, together):
    """A passage whose holders stand apart in the sort, among others that share more of what follows."""
    import numpy as np
    import xxhash

    monkeypatch.setattr(S, "TOGETHER", together)
    tail, passage = words(rnd, 40, 9999).split(), words(rnd, 60, 9999).split()
    codes = np.array([xxhash.xxh64_intdigest(w) for w in passage], np.uint64)
    at = int(S.minimisers(codes)[0][0])
    rows = [(k, " ".join(passage[: at + 12] + words(rnd, 3, 99).split() + passage[at + 12 :])) for k in range(4)]
    for k in range(8):
        rows.append((10 + k, " ".join(words(rnd, 30, 9999).split() + passage[at : at + 10 + k % 4] + tail[k:])))
        rows.append((20 + k, " ".join(words(rnd, 9, 9999).split() + passage + tail[: 10 * (k % 3)])))
    rows.append((90, "del " * 400))
    rows.append((91, "x " * 30 + "del " * 60))
    got = {}
    for r in S.repeated(make(spark, rows)).collect():
        got.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
    assert got == brute(rows)
