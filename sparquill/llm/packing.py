"""Best-fit packing with bound-certified repacking.

Documents become pieces of at most ``capacity`` tokens. Pieces are dealt by a
hash to partitions of a bounded number of pieces; each partition packs its own
by best-fit decreasing and computes dual-feasible-function lower bounds on its
bin count. A partition whose count meets the bound is certified: no packing of
its pieces has fewer bins. A partition with a gap releases the pieces of its
emptiest bins; the released pieces of all partitions are exchanged (dealt anew
over fewer partitions) and packed again, until no gap is left, one partition
has seen all that was released, or an exchange has not made the sequences fewer.

Only lengths and keys move between machines, never texts or ids.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparquill.llm.bpe import byte_bpe
from sparquill.llm.common import kind, map_rows, written

#: Pieces that a partition packs, on average.
PIECES = 40_000
#: Bins that a partition with a gap releases: so many for each bin of the gap, and at least LEAST.
RELEASE, LEAST = 8, 16
PIECE = "piece int, start bigint, length bigint, ids_crc32 bigint"


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): a document's ids and end_id, cut from the end into pieces of ``capacity``.

    Null and empty texts are the end id alone. Rows with equal or null ids each
    have their own pieces. Columns besides doc_id and text are not read.
    """

    def make():
        bpe, end = byte_bpe(tokenizer), end_id.to_bytes(4, "little")

        def f(ids, texts):
            rows = []
            for d, t in zip(ids, texts):
                b = bpe.encode(t or "") + end
                n = len(b) // 4
                start = 0
                for k, stop in enumerate(range(n % capacity or capacity, n + 1, capacity)):
                    rows.append((d, k, start, stop - start, zlib.crc32(b[4 * start : 4 * stop])))
                    start = stop
            cols = list(zip(*rows)) if rows else [[]] * 5
            return dict(zip(("doc_id", "piece", "start", "length", "ids_crc32"), map(list, cols)))

        return f

    return map_rows(docs.select("doc_id", "text"), f"doc_id {kind(docs, 'doc_id')}, {PIECE}", make)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The best of two families of dual feasible functions: no packing has fewer bins.

    f_a counts a length above capacity - a as a whole bin and one below a as
    nothing; u_k rounds a length to k-ths of a bin.
    """
    if not len(lengths):
        return 0
    x, n = np.unique(lengths, return_counts=True)
    best = -(-int((x * n).sum()) // capacity)
    for a in range(1, capacity // 2 + 1):
        v = np.where(x > capacity - a, capacity, np.where(x >= a, x, 0))
        best = max(best, -(-int((v * n).sum()) // capacity))
    for k in range(1, 33):
        whole, rest = np.divmod((k + 1) * x, capacity)
        # in units of 1 / (k * capacity) of a bin
        v = np.where(rest == 0, k * x, whole * capacity)
        best = max(best, -(-int((v * n).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For lengths in descending order: each one's bin and offset, and the space left in each bin."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    by_space: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, space = 0, []
    for i, x in enumerate(lengths.tolist()):
        fit = mask >> x
        if fit:
            s = x + (fit & -fit).bit_length() - 1
            b = by_space[s].pop()
            if not by_space[s]:
                mask ^= 1 << s
        else:
            s, b = capacity, len(space)
            space.append(capacity)
        bins[i], offsets[i] = b, capacity - s
        space[b] = left = s - x
        if left:
            by_space[left].append(b)
            mask |= 1 << left
    return bins, offsets, np.array(space, np.int64)


def _packed(df: DataFrame, capacity: int, turn: int, last: bool) -> DataFrame:
    """One turn of all partitions; released rows have no sequence, but the offset they had."""
    more = "sequence_id bigint, offset bigint, turn int, partition_bins bigint, partition_bound bigint"
    schema = f"doc_id {kind(df, 'doc_id')}, {PIECE}, {more}"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [b for b in batches if b.num_rows]
        if not own:
            return
        t = pa.Table.from_batches(own)
        t = t.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        x = t["length"].to_numpy()
        bins, offsets, space = best_fit_decreasing(x, capacity)
        bound = lower_bound(x, capacity)
        seq = bins + (turn << 56) + (TaskContext.get().partitionId() << 32)
        gap = len(space) - bound
        keep = np.ones(len(x), bool)
        if gap > 0 and not last:
            freed = np.argsort(-space, kind="stable")[: max(RELEASE * gap, LEAST)]
            keep = ~np.isin(bins, freed[space[freed] > 0])
        n = len(x)
        cols = [t[c] for c in names[:5]] + [
            pa.array(seq, mask=~keep), pa.array(offsets), pa.array(np.full(n, turn, np.int32)),
            pa.array(np.full(n, len(space))), pa.array(np.full(n, bound)),
        ]
        yield from pa.Table.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in cols], names=names).to_batches(max_chunksize=10_000)

    return df.mapInArrow(run, schema)


def pack(items: DataFrame, capacity: int = 1024, per_partition: int = PIECES) -> DataFrame:
    """Adds sequence_id, offset, turn, partition_bins and partition_bound to pieces.

    In the last columns are the turn in which the piece was placed, and the bin
    count and lower bound of the partition that placed it. Lengths must be from
    1 to ``capacity``. An empty table gives an empty result; equal rows are
    separate pieces.
    """
    left = written(items)
    done, turn, closed = None, 0, 0
    n, before, total = left.count(), math.inf, 0
    while True:
        parts = max(1, -(-n // per_partition))
        last = turn > 0 and (parts == 1 or total >= before)
        before = total if turn else math.inf
        # With the row's place in the written table, so that rows that are equal are not dealt to one partition.
        dealt = left.withColumn("place", F.monotonically_increasing_id()).repartition(parts, F.xxhash64("place", F.lit(turn))).drop("place")
        now = written(_packed(dealt, capacity, turn, last))
        placed = now.filter("sequence_id is not null")
        done = placed if done is None else done.unionByName(placed)
        released = now.filter("sequence_id is null")
        # Each sequence has one piece at offset 0.
        first = F.col("offset") == 0
        n, opened, kept = now.agg(F.count_if(F.col("sequence_id").isNull()), F.count_if(first), F.count_if(first & F.col("sequence_id").isNotNull())).first()
        total, closed = closed + opened, closed + kept
        if not n:
            return done
        left, turn = released.select("doc_id", "piece", "start", "length", "ids_crc32"), turn + 1
