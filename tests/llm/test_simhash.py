import xxhash
from pyspark.sql import functions as F

from sparquill.llm import simhash
from sparquill.llm.components import components

from .conftest import make, words


def brute_fp(text):
    blanks = "\x20\x09\x0a\x0b\x0c\x0d"
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for b in blanks:
        low = low.replace(b, " ")
    w = [x for x in low.split(" ") if x]
    if not w:
        return 0
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute(fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 2:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def partition(keys, names):
    out = {}
    for k, n in zip(keys, names):
        out.setdefault(k, set()).add(n)
    return {frozenset(s) for s in out.values()}


def test_fingerprint_matches_definition(rnd):
    for t in ("", " ", "A b", "É A b c d", "a a a a a", "İ x\x0by\x1cz q", *(words(rnd, rnd.randrange(40)) for _ in range(50))):
        assert simhash.fingerprint(t) == brute_fp(t)


def test_spark_hash_is_the_same(spark):
    got = spark.range(1).select(F.xxhash64(F.lit("ab cd é")).alias("h")).first().h
    assert got & (1 << 64) - 1 == xxhash.xxh64_intdigest("ab cd é".encode(), 42)


def test_links_give_the_components_of_brute_force(spark, rnd):
    fps = {rnd.getrandbits(64) for _ in range(150)}
    for c in list(fps)[:6]:  # dense clusters: chains and stars of one to three bits
        x = c
        for _ in range(40):
            x ^= 1 << rnd.randrange(64)
            if rnd.random() < 0.5:
                x ^= 1 << rnd.randrange(64)
            fps.add(x)
            if rnd.random() < 0.4:
                x = c
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    edges = simhash.links(spark.createDataFrame([(s,) for s in signed], "fp bigint"))
    for r in edges.collect():
        assert bin((r.a ^ r.b) & (1 << 64) - 1).count("1") <= 2
    root = {r.node: r.root for r in components(edges).collect()}
    assert partition([root.get(s, s) for s in signed], signed) == partition(brute(fps), signed)


def test_near_duplicates_whole(spark, rnd, odd):
    base = [words(rnd, 120) for _ in range(30)]
    rows = odd + [(100 + i, t) for i, t in enumerate(base)] + [(200 + i, t + " end") for i, t in enumerate(base)]
    rows += [(300, base[0])] * 50
    out = simhash.near_duplicates(make(spark, rows, "fp component_id fingerprint root")).collect()
    assert len(out) == len(rows)
    fps = [brute_fp(t) for _, t in rows]
    comp = brute(fps)
    least = {}
    for c, (i, _) in zip(comp, rows):
        if i is not None:
            least[c] = min(i, least.get(c, i))
    want = sorted(((i, f"{f:016x}", least.get(c)) for (i, _), f, c in zip(rows, fps, comp)), key=repr)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in out), key=repr) == want


def test_deduplicated_keeps_one_row_of_each_group(spark, rnd, odd):
    base = words(rnd, 200)
    rows = [*odd, (50, base), (40, base), (60, base + " x"), (70, words(rnd, 100)), (40, base), (70, words(rnd, 90))]
    docs = make(spark, rows, "fp keep_id n")
    out = simhash.deduplicated(docs)
    assert out.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)
    comp = brute([brute_fp(t) for _, t in rows])
    assert len(got) == len(set(comp))
    assert (40, base) in got and not any(i in (50, 60) for i, _ in got)
    assert simhash.deduplicated(make(spark, [])).count() == 0
    assert simhash.near_duplicates(make(spark, [])).count() == 0
