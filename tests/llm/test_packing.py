import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from sparquill.llm import packing

from .conftest import make, words

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_pieces_and_sequences(spark, rnd, odd):
    rows = odd + [(100 + i, words(rnd, rnd.randrange(1, 900))) for i in range(120)] + [(900, "a<|endoftext|>b  c")]
    out = packing.pack(packing.pieces(make(spark, rows, "piece start length"), PATH)).collect()
    tk = Tokenizer.from_file(PATH)
    want = []
    for i, t in rows:
        ids = [*tk.encode(t or "", add_special_tokens=False).ids, 2]
        r = len(ids) % 1024
        cuts = [0, *([r] if r and len(ids) > 1024 else []), *range(r + 1024 if len(ids) > 1024 else len(ids), len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want.append((i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out), key=repr) == sorted(want, key=repr)
    seqs = {}
    for r in out:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= 1024
    total = sum(r.length for r in out)
    assert len(seqs) <= -(-total // 1024) + 2


def optimum(lengths, capacity):
    """The fewest bins by exhaustive search."""
    best = len(lengths)

    def go(i, space):
        nonlocal best
        if len(space) >= best:
            return
        if i == len(lengths):
            best = len(space)
            return
        for k in range(len(space)):
            if space[k] >= lengths[i] and space[k] not in space[:k]:
                go(i + 1, [*space[:k], space[k] - lengths[i], *space[k + 1 :]])
        go(i + 1, [*space, capacity - lengths[i]])

    go(0, [])
    return best


def test_bounds_never_pass_the_optimum(rnd):
    for _ in range(150):
        x = sorted((rnd.randrange(1, 21) for _ in range(rnd.randrange(1, 9))), reverse=True)
        low = packing.lower_bound(np.array(x), 20)
        bins, _, space = packing.best_fit_decreasing(np.array(x), 20)
        assert low <= optimum(x, 20) <= len(space)
        used = np.bincount(bins, weights=x)
        assert (used + space == 20).all() and used.max() <= 20
    assert packing.lower_bound(np.array([], int), 20) == 0


def test_exchange_rounds_close_gaps(spark, rnd):
    n = [rnd.randrange(200, 520) for _ in range(1500)]
    items = spark.createDataFrame([(i, 0, 0, x, i) for i, x in enumerate(n)], "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")
    out = packing.pack(items, per_partition=100).collect()
    assert len(out) == len(n) and {r.turn for r in out} > {0}
    alone = len(packing.best_fit_decreasing(np.array(sorted(n, reverse=True)), 1024)[2])
    assert len({r.sequence_id for r in out}) <= 1.02 * alone + 1
    assert packing.pack(items.limit(0)).count() == 0


def test_exchanges_go_on_while_sequences_get_fewer(spark, rnd):
    n = [rnd.randrange(200, 520) for _ in range(1500)]
    items = spark.createDataFrame([(i, 0, 0, x, i) for i, x in enumerate(n)], "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")
    out = packing.pack(items, per_partition=60).collect()
    assert sorted(r.length for r in out) == sorted(n) and max(r.turn for r in out) > 1
    assert len({r.sequence_id for r in out}) <= 560  # the bound is 524; 565 after two turns


def test_rows_that_are_equal_are_dealt_apart(spark, monkeypatch):
    items = spark.createDataFrame([(7, 0, 0, 300, 1)] * 4000, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")
    out = packing.pack(items, per_partition=500).collect()
    first = [r for r in out if r.turn == 0]
    assert len(out) == 4000 and len({r.sequence_id for r in out}) <= 1334 + 8  # partitions are certified one by one
    assert len({r.sequence_id >> 32 for r in first}) > 5
