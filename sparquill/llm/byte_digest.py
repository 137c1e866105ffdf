"""Document fingerprints by improbable features.

Each window of WINDOW bytes, in texts of any size, has a Shannon entropy, kept by counts that change
by one byte in and one out. A window's rank is the share of the corpus's
windows with its entropy level: the rarer, the lower. In each run of RUN
windows the one of lowest rank (leftmost of equals) gets a vote; windows with
a quarter of a run's votes are the document's features. Features go in order into a chain of
Bloom filters of BITS bits, PER_FILTER features each. Two chains are compared
by the overlap of set bits, normalised between what chance gives and what the
emptier filter allows. A filter is compared with all of the other chain, so a
passage counts wherever it has moved to; only filters that the other chain has
as they are need no comparison.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparquill.llm.common import kind, map_rows, text_batches

#: Bytes of a window; windows of a run.
WINDOW, RUN = 8, 32
BITS, HASHES, PER_FILTER = 1024, 4, 64
LEVELS = 64
#: Bytes of text that a task sorts and compares, on average.
TASK_BYTES = 16_000_000
#: Pairs of filters that are compared at once.
PAIRS = 1 << 15
#: Share of the way from chance to full overlap that counts as no likeness.
NOISE = 0.2
#: c * log2(c) in units of 2^-32: sums are exact, so that a window's level does not depend on what stands before it.
_UNIT = 1 << 32
_STEP = np.array([0] + [round(c * np.log2(c) * _UNIT) for c in range(1, WINDOW + 1)], np.int64)
_GAIN = np.diff(_STEP, append=0)
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def window_of(n: int) -> int:
    """The window of a text of n bytes: one for all, as hashes of windows of two sizes never meet."""
    return WINDOW


def levels(b: np.ndarray) -> np.ndarray:
    """The entropy level, 0 to LEVELS - 1, of each window of a uint8 array of at least a window's bytes."""
    n, w = len(b), window_of(len(b))
    back, ahead = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    for d in range(1, w):
        same = b[d:] == b[:-d]
        back[d:] += same
        ahead[:-d] += same
    # The first window's sum, then one byte out and one in at each step.
    first = _STEP[np.bincount(b[:w])].sum()
    out, enters = ahead[: n - w], back[w:]
    step = _GAIN[enters] - _GAIN[out]
    total = np.empty(n - w + 1, np.int64)
    total[0] = 0
    np.cumsum(step, out=total[1:])
    entropy = np.log2(w) - (first + total) / (w * _UNIT)
    return np.clip((entropy * (LEVELS / (np.log2(w) + 1e-9))).astype(np.int64), 0, LEVELS - 1)


def features(b: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """64-bit hashes of the selected windows, in their order; a shorter text is one feature of its own."""
    n = len(b)
    if not n:
        return np.empty(0, np.uint64)
    w = window_of(n)
    if n < w:
        return np.frombuffer(hashlib.blake2b(b.tobytes(), digest_size=8).digest(), np.uint64)
    r = rank[levels(b)].astype(np.int64)
    m = len(r)
    key = r * m + np.arange(m)
    run = min(RUN, max(4, m // 8), m)  # short texts have several features too
    low, size = key, 1
    while size < run:  # the least of ever longer runs
        step = min(size, run - size)
        low = np.minimum(low[: len(low) - step], low[step:])
        size += step
    votes = np.bincount(low % m, minlength=m)
    at = np.flatnonzero(votes >= min(max(1, run // 4), len(low)))
    rows = b[at[:, None] + np.arange(w)].view(np.uint64)
    h = np.zeros(len(at), np.uint64)
    for k in range(w // 8):
        h = (h ^ rows[:, k]) * _MIX[k % 4]
        h ^= h >> np.uint64(29)
    return h


def chain(text: str | None, rank: np.ndarray) -> np.ndarray:
    """The filters of a text, as rows of BITS / 8 bytes; none for an empty text."""
    h = features(np.frombuffer((text or "").encode(), np.uint8), rank)
    k = -(-len(h) // PER_FILTER)
    bits = np.zeros((k, BITS), bool)
    own = np.arange(len(h)) // PER_FILTER
    for j in range(HASHES):
        bits[own, (h >> np.uint64(13 * j)) % np.uint64(BITS)] = True
    return np.packbits(bits, axis=1)


def digest(filters: np.ndarray) -> str:
    return filters.tobytes().hex()


def shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The number of bits that each row of ``a`` has in common with each of ``b``, both of 64-bit words."""
    if len(a) * len(b) < 1000:  # all words in one call
        return np.bitwise_count(a[:, None] & b).sum(axis=2, dtype=np.uint16)
    both = np.zeros((len(a), len(b)), np.uint16)
    for x, y in zip(a.T[:, :, None], b.T):
        both += np.bitwise_count(x & y)
    return both


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1: for each filter of the shorter chain its best normalised overlap with any of the other's, averaged by set bits.

    Two empty chains are alike (1), an empty and another are not (0).
    """
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if len(a) > len(b):
        a, b = b, a
    there = {f.tobytes() for f in b}
    equal = np.array([f.tobytes() in there for f in a])
    a, b = (np.asfortranarray(x.view(np.uint64)) for x in (a, b))
    na, nb = (np.bitwise_count(x).sum(axis=1, dtype=float) for x in (a, b))
    total, bits = 0.0, na.sum()
    if equal.any():  # their best is 1
        total, a, na = na[equal].sum(), a[~equal], na[~equal]
    rows = max(1, PAIRS // len(b))
    for i in range(0, len(a), rows):
        n, both = na[i : i + rows, None], shared(a[i : i + rows], b)
        chance, most = n * nb / BITS, np.minimum(n, nb)
        floor = chance + NOISE * (most - chance)
        best = ((both - floor) / np.maximum(most - floor, 1e-9)).max(axis=1)
        total += n[:, 0] @ np.clip(best, 0, 1)
    return min(1.0, float(total / bits))


def rarity(docs: DataFrame) -> np.ndarray:
    """The rank of each entropy level: its place among the levels by the number of windows of all texts, rarest first."""

    def make():
        def f(texts):
            n = np.zeros(LEVELS, np.int64)
            for t in texts:
                b = np.frombuffer((t or "").encode(), np.uint8)
                if len(b) >= WINDOW:
                    n += np.bincount(levels(b), minlength=LEVELS)
            return {"level": list(range(LEVELS)), "n": n}

        return f

    found = map_rows(docs.select("text"), "level int, n bigint", make).groupBy("level").agg(F.sum("n").alias("n")).collect()
    n = np.zeros(LEVELS)
    for r in found:
        n[r.level] = r.n
    n[: LEVELS // 3] = n.max() + 1  # windows of little entropy are common everywhere: padding, rules, tables
    return np.argsort(np.argsort(n, kind="stable"), kind="stable")


def fingerprints(docs: DataFrame, rank: np.ndarray | None = None) -> DataFrame:
    """(doc_id, fingerprint): the hexadecimal chain of filters of each text; null is empty."""
    rank = rarity(docs) if rank is None else rank

    def make():
        return lambda ids, texts: {"doc_id": ids, "fingerprint": [digest(chain(t, rank)) for t in texts]}

    return map_rows(docs.select("doc_id", "text"), f"doc_id {kind(docs, 'doc_id')}, fingerprint string", make)


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by as much of the following document, or all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def with_next(docs: DataFrame) -> DataFrame:
    """(part, doc_id, text, own) in partitions by ``part``, sorted: each own row's next document stands after it.

    The order is by descending doc_id (of any type that has one: numbers, texts,
    dates), then text; nulls are last, and after the
    last comes the first. Parts are ranges of ids between quantiles; the row
    that a part ends before is sent to it as well, marked as not its own, so
    that each text is moved once and a few of them twice.
    """
    spark, docs = docs.sparkSession, docs.select("doc_id", "text")
    size = docs.agg(F.sum(F.octet_length("text")).alias("b"), F.count("*").alias("n")).first()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(size.b or 0) // TASK_BYTES))
    known = docs.select("doc_id").filter("doc_id is not null")
    # The greatest id of each range of ids: one number or text a part.
    ranges = known.repartitionByRange(parts, "doc_id").select(F.spark_partition_id().alias("p"), "doc_id").groupBy("p").agg(F.max("doc_id").alias("m"))
    cuts = sorted(r.m for r in ranges.collect())[:-1]

    # Ids above the last cut are part 0, nulls go with the least ids.
    part_of = F.udf(lambda i: len(cuts) if i is None else len(cuts) - bisect_left(cuts, i), "bigint", useArrow=True)
    text_batches(spark)
    own = docs.select(part_of("doc_id").alias("part"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    heads = {r.part: r.m for r in known.select(part_of("doc_id").alias("part"), "doc_id").groupBy("part").agg(F.max("doc_id").alias("m")).collect()}
    there = sorted(heads)
    nulls = not docs.filter("doc_id is null").isEmpty()
    sent = [(heads[b], a) for a, b in zip(there, there[1:])]
    if there:
        last = len(cuts) if nulls else there[-1]
        if nulls and there[-1] != last:
            # The first of the nulls cannot be sent by id; they join the last part that has ids.
            own = own.withColumn("part", F.when(F.col("doc_id").isNull(), F.lit(there[-1])).otherwise(F.col("part")))
            last = there[-1]
        sent.append((heads[there[0]], last))
    rows = own.withColumn("own", F.lit(True))
    if sent:
        to = spark.createDataFrame(sent, f"head {kind(docs, 'doc_id')}, part bigint")  # one row a part
        tails = docs.join(F.broadcast(to), F.col("doc_id") == F.col("head")).select("part", "doc_id", F.coalesce("text", F.lit("")).alias("text"), F.lit(False).alias("own"))
        rows = rows.unionByName(tails)
    return rows.repartitionById(parts, F.col("part").cast("int")).sortWithinPartitions("part", F.col("own").desc(), F.col("doc_id").desc_nulls_last(), "text")


def compared(docs: DataFrame, rank: np.ndarray | None = None) -> DataFrame:
    """One row per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is ``edited(text, next text)``, see ``with_next`` for the
    order; a single document is followed by itself. Null texts are empty.
    """
    rank = rarity(docs) if rank is None else rank
    schema = f"doc_id {kind(docs, 'doc_id')}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    names = [x.split()[0] for x in schema.split(", ")]
    from pyspark.sql.pandas.types import to_arrow_type

    types = [to_arrow_type(docs.schema["doc_id"].dataType), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def row(doc: tuple, after: tuple) -> tuple:
        text = doc[0]
        other = edited(text, after[0])
        e = chain(other, rank)
        return doc[1], len(text), hashlib.sha256(other.encode()).hexdigest(), digest(doc[2]), digest(e), likeness(doc[2], e), likeness(doc[2], after[2])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = first = before = None  # the part, its first row, the row that waits for the next
        rows: list[tuple] = []
        for b in batches:
            for part, i, text, own in zip(*(c.to_pylist() for c in b.columns)):
                if now is not None and part != now:
                    if before:
                        rows.append(row(before, first))
                    first = before = None
                if part == now and not own and before is None:
                    continue  # a tail of equal ids: the first of them was the next
                now, doc = part, (text, i, chain(text, rank))
                first = first or doc
                if before:
                    rows.append(row(before, doc))
                before = doc if own else None
            if len(rows) >= 500:
                yield batch(rows)
                rows = []
        if before:
            rows.append(row(before, first))
        yield batch(rows)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)

    return with_next(docs).mapInArrow(run, schema)


