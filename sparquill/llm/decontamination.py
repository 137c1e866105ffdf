"""Benchmark decontamination by pigeonhole edit matching.

A test item with a budget of e edits is cut into e + 1 pieces: wherever the
item occurs with at most e edits, one piece occurs unchanged. All pieces of a
block of items are sought in one pass over each text: the hashes of all its
runs of PREFIX code points are looked up among those that pieces begin with
(pieces that are shorter are sought by Aho-Corasick), and what is found is
compared with the piece. The window around each hit is verified with Myers'
bit-parallel edit distance over the whole item. Texts and items are compared in
lower case, with runs of blanks as one space.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparquill.llm.common import kind, map_rows

#: Edits allowed for each character of an item.
RATE = 0.08
#: Items and characters of a block: what a task holds of the benchmark at a time, some 150 MB.
BLOCK_ITEMS, BLOCK_CHARS = 50_000, 16_000_000
#: Code points that pieces are looked up by; bits of a hash that tell at once that no piece begins so.
PREFIX, BITS = 8, 22
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BLANKS = re.compile(r"\s+")


def plain(text: str) -> str:
    """Lower case code point by code point, runs of blanks as a space, none at the ends."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower()[:1] for c in text)
    return " ".join(low.split())


def positions(text: str) -> list[int]:
    """For each code point of plain(text), and its end, the place in text."""
    out, at = [], 0
    for m in re.finditer(r"\S+", text):
        if out:
            out.append(at)
        out += range(m.start(), m.end())
        at = m.end()
    return [*out, at]


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """budget + 1 pieces of nearly equal length with their offsets."""
    k, n = budget + 1, len(item)
    cuts = [n * i // k for i in range(k + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def _starts(text: str) -> np.ndarray:
    """A hash of each run of PREFIX code points."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = max(0, len(c) - PREFIX + 1)
    h = np.zeros(n, np.uint64)
    for j in range(PREFIX):
        h *= _ODD
        h += c[j : j + n]
    h ^= h >> np.uint64(31)
    h *= _ODD
    return h


class Myers:
    """Approximate search of one pattern, the pattern's rows held as bits of an integer."""

    def __init__(self, pattern: str):
        self.m = len(pattern)
        self.peq: dict[str, int] = defaultdict(int)
        for i, c in enumerate(pattern):
            self.peq[c] |= 1 << i
        self.peq = dict(self.peq)
        self.mask, self.top = (1 << self.m) - 1, 1 << (self.m - 1)

    def best(self, text: str, limit: int) -> tuple[int, int] | None:
        """(distance, end) of the best occurrence in text with at most ``limit`` edits; of equals, the first."""
        pv, mv, d, mask, top, get = self.mask, 0, self.m, self.mask, self.top, self.peq.get
        found = None
        for j, c in enumerate(text):
            eq = get(c, 0)
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph = mv | (~(xh | pv) & mask)
            mh = pv & xh
            if ph & top:
                d += 1
            elif mh & top:
                d -= 1
            ph = (ph << 1) & mask
            pv = ((mh << 1) & mask) | (~(xv | ph) & mask)
            mv = ph & xv
            if d <= limit:
                found, limit = (d, j + 1), d - 1
                if d == 0:
                    break
        return found


class Block:
    """Items with what finds all their pieces."""

    def __init__(self, items: list[tuple[object, str]], rate: float):
        self.items = [(i, t, int(rate * len(t))) for i, t in items]
        at: dict[str, list[tuple[int, int]]] = defaultdict(list)
        found: list[tuple] = []
        for k, (_, t, e) in enumerate(self.items):
            h = _starts(t)
            for start, piece in pieces(t, e):
                if len(piece) < PREFIX:
                    at[piece].append((k, start))
                else:
                    found.append((h[start], k, start, len(piece)))
        self.short = ahocorasick.Automaton() if at else None
        for piece, where in at.items():
            self.short.add_word(piece, (len(piece), where))
        if self.short:
            self.short.make_automaton()
        hashes = np.array([f[0] for f in found], np.uint64)
        order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[order]
        self.item, self.start, self.size = (np.array([f[i] for f in found], np.int64)[order] for i in (1, 2, 3))
        self.some = np.zeros(1 << BITS, bool)
        self.some[(self.hashes >> np.uint64(64 - BITS)).astype(np.int64)] = True
        self.forward: dict[int, Myers] = {}
        self.backward: dict[int, Myers] = {}

    def hits(self, text: str) -> dict[int, set[int]]:
        """By item, where it would start for a piece of it to stand as it does."""
        starts: dict[int, set[int]] = defaultdict(set)
        if self.short:
            for end, (n, where) in self.short.iter(text):
                for k, offset in where:
                    starts[k].add(end + 1 - n - offset)
        h = _starts(text)
        at = np.flatnonzero(self.some[(h >> np.uint64(64 - BITS)).astype(np.int64)])
        if len(at):
            first, last = (np.searchsorted(self.hashes, h[at], side) for side in ("left", "right"))
            for i in np.flatnonzero(last > first).tolist():
                p = int(at[i])
                for j in range(first[i], last[i]):
                    k, offset, n = int(self.item[j]), int(self.start[j]), int(self.size[j])
                    if text[p : p + n] == self.items[k][1][offset : offset + n]:
                        starts[k].add(p - offset)
        return starts

    def matches(self, text: str) -> Iterator[tuple[object, int, int, int]]:
        """(item id, distance, start, end) of the best occurrence of each item within its budget."""
        for k, at in self.hits(text).items():
            item, pattern, budget = self.items[k]
            best = None
            for low, high in _windows(sorted(at), len(pattern), budget, len(text)):
                limit = budget if best is None else best[0] - 1
                got = self._of(self.forward, k, pattern).best(text[low:high], limit)
                if got:
                    best = (got[0], low + got[1], low)
                    if not got[0]:
                        break
            if best:
                d, end, low = best
                back = self._of(self.backward, k, pattern[::-1]).best(text[low:end][::-1], d)
                yield item, d, end - back[1], end

    @staticmethod
    def _of(made: dict[int, Myers], k: int, pattern: str) -> Myers:
        if k not in made:
            made[k] = Myers(pattern)
        return made[k]


def _windows(starts: list[int], m: int, budget: int, n: int) -> Iterator[tuple[int, int]]:
    """Merged windows of text that hold every occurrence starting within ``budget`` of a place in ``starts``."""
    low = high = None
    for s in starts:
        a, b = max(0, s - budget), min(n, s + m + budget)
        if high is not None and a <= high:
            high = max(high, b)
            continue
        if high is not None:
            yield low, high
        low, high = a, b
    if high is not None:
        yield low, high


def blocks(benchmark: DataFrame) -> Iterator[list[tuple[object, str]]]:
    """The items with text, one bounded block after the other."""
    block: list[tuple[object, str]] = []
    size = 0
    for r in benchmark.select("item_id", "text").filter("text is not null").toLocalIterator():
        t = plain(r.text)
        if not t:
            continue
        if block and (len(block) >= BLOCK_ITEMS or size + len(t) > BLOCK_CHARS):
            yield block
            block, size = [], 0
        block.append((r.item_id, t))
        size += len(t)
    if block:
        yield block


def contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """One row for each row of ``docs`` and item that occurs in it within floor(rate * length) edits.

    Columns: doc_id, item_id, distance, start, end (code points of the text as
    given, of the best occurrence; the first end of equals). The items are the
    stated query set: each block of them is one pass over all documents. Null
    and empty texts hold nothing, null and blank items are nowhere; repeated
    rows and items each give their rows. Other columns are not read.
    """
    schema = f"doc_id {kind(docs, 'doc_id')}, item_id {kind(benchmark, 'item_id')}, distance int, start bigint, end bigint"
    names = ("doc_id", "item_id", "distance", "start", "end")
    out = None
    for block in blocks(benchmark):

        def make(block=block):
            sought = Block(block, rate)

            def f(ids, texts):
                rows = []
                for i, t in zip(ids, texts):
                    got = list(sought.matches(plain(t))) if t else []
                    if got:
                        at = positions(t)
                        rows += [(i, item, d, at[a], at[b - 1] + 1) for item, d, a, b in got]
                return {n: [r[k] for r in rows] for k, n in enumerate(names)}

            return f

        one = map_rows(docs.select("doc_id", "text"), schema, make)
        out = one if out is None else out.unionByName(one)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def decontaminated(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """The rows of ``docs`` in which no item occurs, with all their columns; rows with null texts stay."""
    out = docs
    for block in blocks(benchmark):
        out = out.filter(F.udf(_Lazy(block, rate), "boolean", useArrow=True)("text"))
    return out


class _Lazy:
    """Whether a text is free of a block's items; the automaton is built where it is used."""

    def __init__(self, block: list[tuple[object, str]], rate: float):
        self.block, self.rate, self.made = block, rate, None

    def __call__(self, text: str | None) -> bool:
        if self.made is None:
            self.made = Block(self.block, self.rate)
        return not text or next(self.made.matches(plain(text)), None) is None
