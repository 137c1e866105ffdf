"""Repeated passages by sparse suffix arrays.

Suffixes are kept only where content selects them: at the minimisers of word
shingles, so that any passage of LEAST words has one, and equal passages have
the same. Suffixes whose shingle stands in one document only are dropped by a
count of shingles. The others are sorted by shingle and following words over
all machines, each is compared with its neighbours of other documents, and
matches are extended to the right and to the left. Extensions from successive
suffixes of a document overlap and are merged to passages.

The suffixes are dealt by shingle, those of a frequent shingle by document as
well, so that a passage of a third of all documents is spread over machines,
and sorted by (shingle, following words, document). A suffix and its window
mates share the words from the window's first to its last, so each suffix
carries just the words of the windows of LEAST words that it is the minimiser
of. Neighbours in the sort share the most following words, neighbours in the
sort by preceding words the most of those; what they share bounds what anybody
does. Windows that these bounds leave open, as holders may stand apart in both
orders, are looked up among all the windows of the group. Of a frequent
shingle, dealt to several groups, the windows of one document in its group are
joined by hash with those of the other groups, where each stands once however
many hold it. So no passage is missed, and what is written grows with suffixes
and not with windows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparquill.llm.bpe import Memo
from sparquill.llm.common import discard, kind, map_rows, text_batches, written

#: Words of a passage at least, and of a shingle; SPAN shingles in a row hold a kept suffix.
LEAST, SHINGLE = 50, 8
SPAN = LEAST - SHINGLE + 1
#: Bits of a place in its document; the others of a shingle's hash decide which is kept.
PLACE = 30
#: Documents with one shingle whose suffixes are sorted together, on average; a frequent shingle's are dealt by document.
TOGETHER = 2_000
_ODD, _ODD2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def words_of(text: str | None) -> list[str]:
    """The words that are compared: runs of non-blanks, in lower case."""
    return text.lower().split() if text else []


def minimisers(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the kept suffixes of a sequence of word codes: place, shingle hash, first and last start of the windows of LEAST words that it is the minimiser of."""
    n = len(codes) - SHINGLE + 1
    if n < SPAN:
        none = np.empty(0, np.int64)
        return none, np.empty(0, np.uint64), none, none
    h = np.zeros(n, np.uint64)
    for j in range(SHINGLE):
        h = h * _ODD + codes[j : j + n]
    h ^= h >> np.uint64(32)
    h *= _ODD2
    h ^= h >> np.uint64(29)
    # Of equal hashes the leftmost, so that places only ascend; equal content ties alike.
    place = np.uint64((1 << PLACE) - 1)
    low, size = h & ~place | np.arange(n, dtype=np.uint64), 1
    while size < SPAN:
        step = min(size, SPAN - size)
        low, size = np.minimum(low[: len(low) - step], low[step:]), size + step
    at = (low & place).astype(np.int64)
    places, first, count = np.unique(at, return_index=True, return_counts=True)
    return places, h[places], first, first + count - 1


def suffixes(docs: DataFrame) -> DataFrame:
    """(doc_id, shingle): the shingles of the kept suffixes of each text, each once; null and short texts have none."""

    def make():
        code = Memo(lambda w: xxhash.xxh64_intdigest(w))

        def f(ids, texts):
            owners, found = [], [np.empty(0, np.int64)]
            for i, t in zip(ids, texts):
                w = words_of(t)
                h = np.unique(minimisers(np.fromiter(map(code.__getitem__, w), np.uint64, len(w)))[1])
                owners.extend([i] * len(h))
                found.append(h.view(np.int64))
            return {"doc_id": owners, "shingle": np.concatenate(found)}

        return f

    return map_rows(docs.select("doc_id", "text").filter("doc_id is not null"), f"doc_id {kind(docs, 'doc_id')}, shingle bigint", make)


def _common(a: list[str], b: list[str]) -> int:
    if a == b:
        return len(a)
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


class _Group:
    """Suffixes with one shingle, sorted by following words.

    A row is (after, before, doc_id, places, nearest): the following words and
    the preceding ones, nearest first; where in its document the suffix stands;
    and the least distance of a window's start before it. The windows that the
    suffix is the minimiser of start nearest to len(before) words before it.
    """

    def __init__(self, rows: list[tuple], least: int):
        self.rows, self.least = rows, least
        self.after = [r[0].split(" ")[:-1] for r in rows]
        self.before = [r[1].split(" ")[:-1] for r in rows]
        self.doc = [r[2] for r in rows]
        self.nearest = [max(r[4], least - len(a)) for r, a in zip(rows, self.after)]
        n = len(rows)
        #: Least and greatest distance of a window that another document has, the least such document.
        self.low, self.high, self.other = [least] * n, [-1] * n, [None] * n
        #: Following and preceding words shared with another document at most.
        self.right, self.left = [0] * n, [0] * n

    def hold(self, x: int, low: int, high: int, other) -> None:
        self.low[x], self.high[x] = min(self.low[x], low), max(self.high[x], high)
        self.other[x] = other if self.other[x] is None else min(self.other[x], other)

    def compare(self, x: int, y: int) -> None:
        """Extends the match of two suffixes both ways."""
        r, l = _common(self.after[x], self.after[y]), _common(self.before[x], self.before[y])
        for a, b in ((x, y), (y, x)):
            self.right[a], self.left[a] = max(self.right[a], r), max(self.left[a], l)
            if r >= SHINGLE and l + r >= self.least:
                self.hold(a, self.least - r, l, self.doc[b])

    def neighbours(self, order: list[int]) -> None:
        """Compares each suffix with the nearest of another document on either side."""
        pairs = set()
        for way in (order, order[::-1]):
            near = before = None  # the nearest of another document; the one just passed
            for x in way:
                if before is not None and self.doc[before] != self.doc[x]:
                    near = before
                if near is not None:
                    pairs.add((min(x, near), max(x, near)))
                before = x
        for x, y in pairs:
            self.compare(x, y)

    def open(self, x: int) -> list[int]:
        """Distances of windows that the bounds leave open."""
        span = range(max(self.nearest[x], self.least - self.right[x]), min(len(self.before[x]), self.left[x]) + 1)
        return [d for d in span if not self.low[x] <= d <= self.high[x]]

    def windows(self, x: int, distances) -> Iterator[tuple[int, int]]:
        """(distance, hash of the words) of windows of a suffix."""
        words = [w.encode() for w in (*reversed(self.before[x]), *self.after[x])]
        ends = [0, *accumulate(len(w) + 1 for w in words)]
        line, n = b" ".join(words), len(self.before[x])
        for d in distances:
            yield d, xxhash.xxh3_64_intdigest(line[ends[n - d] : ends[n - d + self.least] - 1]) - (1 << 63)

    def own(self, x: int) -> range:
        return range(self.nearest[x], len(self.before[x]) + 1)

    def look_up(self, wanted: dict[int, list[int]]) -> None:
        """Settles open windows among all of the group at their distances."""
        sought = {d for ds in wanted.values() for d in ds}
        holders: dict[int, list] = {}
        for x in range(len(self.rows)):
            for _, h in self.windows(x, [d for d in self.own(x) if d in sought]):
                self._seen(holders, h, self.doc[x])
        for x, ds in wanted.items():
            for d, h in self.windows(x, ds):
                self._shared(x, d, holders[h])

    @staticmethod
    def _seen(holders: dict[int, list], h: int, doc) -> None:
        """Keeps the least and greatest document of each window."""
        got = holders.get(h)
        if got is None:
            holders[h] = [doc, doc]
        elif doc < got[0]:
            got[0] = doc
        elif doc > got[1]:
            got[1] = doc

    def _shared(self, x: int, d: int, ends: list) -> bool:
        if ends[0] == ends[1]:
            return False
        self.hold(x, d, d, ends[1] if self.doc[x] == ends[0] else ends[0])
        return True

    def matches(self, apart: bool) -> Iterator[tuple]:
        """(doc_id, start, end, other, hash) of matches, without a hash; if ``apart``, also of windows to be sought in other groups.

        A window that one document of the group has comes with its start, one
        that several have comes once without a start.
        """
        n = len(self.rows)
        self.neighbours(list(range(n)))
        if apart:
            holders: dict[int, list] = {}
            for x in range(n):
                for _, h in self.windows(x, self.own(x)):
                    self._seen(holders, h, self.doc[x])
            for x in range(n):
                for d, h in self.windows(x, self.own(x)):
                    if not self._shared(x, d, holders[h]):
                        for p in self.rows[x][3]:
                            yield self.doc[x], p - d, None, None, h
            for h, (a, b) in holders.items():
                if a != b:
                    yield a, None, None, None, h
        elif n > 2:
            self.left = [len(b) for b in self.before]
            if any(self.open(x) for x in range(n)):
                self.left = [0] * n
                self.neighbours(sorted(range(n), key=lambda x: self.rows[x][1]))
                if wanted := {x: ds for x in range(n) if (ds := self.open(x))}:
                    self.look_up(wanted)
        for x in range(n):
            if self.high[x] >= 0:
                for p in self.rows[x][3]:
                    yield self.doc[x], p - self.high[x], p + self.least - self.low[x], self.other[x], None


def repeated(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """One row for each maximal stretch of a document made of passages of ``least`` words or more that other documents hold.

    Columns: doc_id, start_word, end_word (exclusive; words are runs of
    non-blanks, compared in lower case), n_words, other_doc_id (the least of
    the neighbours found). Rows with one doc_id are one document, whose own
    repetitions do not count; rows without an id are left out. An empty table
    gives an empty result; other columns are not read.
    """
    if least < LEAST:
        raise ValueError(f"suffixes are kept for passages of {LEAST} words and more")
    spark, of = docs.sparkSession, kind(docs, "doc_id")
    docs = docs.select("doc_id", "text").filter(F.col("doc_id").isNotNull() & (F.length("text") >= 2 * LEAST - 1))  # what is shorter has no passage
    all_kept = written(suffixes(docs))
    # Written, so that the join reads two plain exchanges and adaptive execution can split a frequent shingle.
    parts = F.ceil(F.count("*") / TOGETHER).cast("int").alias("parts")
    shared = written(all_kept.groupBy("shingle").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), parts).filter("a <> b").select("shingle", "parts"))
    wanted = all_kept.join(shared, "shingle").groupBy("doc_id").agg(F.collect_set(F.struct("shingle", "parts")).alias("wanted"))  # no more than the document's own words

    def squeeze():
        pack = zstandard.ZstdCompressor(level=1).compress
        return lambda ids, ts: {"doc_id": ids, "z": [pack(t.encode()) for t in ts]}

    # Texts are moved to their documents' shared shingles, compressed.
    texts = map_rows(docs, f"doc_id {of}, z binary", squeeze).join(wanted.hint("shuffle_hash"), "doc_id")

    def cut():
        code = Memo(lambda w: xxhash.xxh64_intdigest(w))
        unpack = zstandard.ZstdDecompressor().decompress
        names = ("shingle", "parts", "after", "before", "doc_id", "places", "nearest")

        def f(ids, zs, shingles):
            rows: list[tuple] = []
            for i, z, own in zip(ids, zs, shingles):
                w = words_of(unpack(z).decode())
                found = minimisers(np.fromiter(map(code.__getitem__, w), np.uint64, len(w)))
                of_shingle = {x["shingle"]: x["parts"] for x in own}
                alike: dict[tuple, list[int]] = {}  # suffixes that repeat in the document, with the windows they stand for
                for p, h, first, last in zip(found[0].tolist(), found[1].view(np.int64).tolist(), *(x.tolist() for x in found[2:])):
                    if h in of_shingle:
                        key = h, " ".join([*w[p : last + least], ""]), " ".join([*reversed(w[first:p]), ""]) if first < p else "", p - last
                        alike.setdefault(key, []).append(p)
                rows += [(h, of_shingle[h], after, before, i, places, d) for (h, after, before, d), places in alike.items()]
            return dict(zip(names, map(list, zip(*rows)))) if rows else {k: [] for k in names}

        return f

    text_batches(spark)
    rows = map_rows(texts.select("doc_id", "z", "wanted"), f"shingle bigint, parts int, after string, before string, doc_id {of}, places array<bigint>, nearest bigint", cut)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    from pyspark.sql.pandas.types import to_arrow_type

    same = to_arrow_type(docs.schema["doc_id"].dataType)
    types = {"doc_id": same, "start": pa.int64(), "end": pa.int64(), "other": same, "hash": pa.int64()}

    def batch(made: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([m[k] for m in made], t) for k, t in enumerate(types.values())], names=list(types))

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[tuple] = []
        now, own = None, []
        for b in batches:
            for shingle, parts, part, *row in zip(*(c.to_pylist() for c in b.columns)):
                if (shingle, part, parts) != now:
                    if own:
                        made += _Group(own, least).matches(now[2] > 1)
                    now, own = (shingle, part, parts), []
                own.append(row)
            while len(made) >= 20_000:
                yield batch(made[:20_000])
                del made[:20_000]
        if own:
            made += _Group(own, least).matches(now[2] > 1)
        yield batch(made)

    dealt = rows.withColumn("part", F.pmod(F.xxhash64("doc_id"), "parts")).repartition(n, "shingle", "part").sortWithinPartitions("shingle", "part", "after", "doc_id")
    dealt = dealt.select("shingle", "parts", "part", "after", "before", "doc_id", "places", "nearest")
    found = written(dealt.mapInArrow(neighbours, f"doc_id {of}, start bigint, end bigint, other {of}, hash bigint"))
    discard(all_kept, shared)
    hashed = found.filter("hash is not null").select("doc_id", "start", "hash")
    equal = written(hashed.groupBy("hash").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter("a <> b"))
    apart = hashed.filter("start is not null").join(equal, "hash").select("doc_id", "start", (F.col("start") + least).alias("end"), F.when(F.col("doc_id") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("other"))
    matches = found.filter("hash is null").select("doc_id", "start", "end", "other").unionByName(apart)
    own = Window.partitionBy("doc_id").orderBy("start", "end")
    reach = F.max("end").over(own.rowsBetween(Window.unboundedPreceding, -1))
    marked = matches.withColumn("fresh", F.coalesce((F.col("start") > reach).cast("int"), F.lit(1)))
    marked = marked.withColumn("passage", F.sum("fresh").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    merged = marked.groupBy("doc_id", "passage").agg(F.min("start").alias("start_word"), F.max("end").alias("end_word"), F.min("other").alias("other_doc_id"))
    return merged.select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), "other_doc_id")
