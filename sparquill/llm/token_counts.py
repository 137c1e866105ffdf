"""Token counts at every prefix of a text by dynamic programming.

For byte-level BPE the encoding of a piece's prefix ends in the one token t
that is compatible with the last token of the prefix without t (the two,
merged anew, stay as they are). So count[i] = count[i - len(t)] + 1, and one
pass over a piece gives the count at each of its prefixes. Over a text, the
counts of whole chunks are summed before the chunk that a prefix ends in. The
resulting array answers "how many tokens has this prefix" and "what is the
longest prefix within this budget" without encoding again.
"""

from __future__ import annotations

from array import array
from functools import lru_cache
from operator import sub

import ahocorasick
import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparquill.llm.bpe import PATTERN, ByteBPE, Chunks, Memo, byte_bpe
from sparquill.llm.common import kind, map_rows

_PIECE = regex.compile(PATTERN)
_BLANKS = regex.compile(r"\s{2,}")
#: Pairs of adjacent tokens whose verdict is kept at most.
_PAIRS = 500_000


def _steps(counts: list[int]) -> bytes:
    """The differences of successive counts, as 16-bit integers: those of adjacent texts are joined to those of both."""
    return array("h", map(sub, counts[1:], counts)).tobytes()


class PrefixCounter:
    """Counts at every prefix, of pieces, chunks and texts."""

    def __init__(self, bpe: ByteBPE):
        self.bpe, self.fits = bpe, {}
        self.words = {i: b for b, i in bpe.ranks.items()}
        # Finds all tokens that end at a place in one step a byte.
        self.ending = ahocorasick.Automaton()
        for b, i in bpe.ranks.items():
            self.ending.add_word(b.decode("latin-1"), (len(b), i))
        self.ending.make_automaton()
        self.parts = Memo(self._part)
        self.chunks = Chunks(self.chunk)

    def _single(self, b: bytes) -> list[int]:
        return self.bpe.encoding._core_bpe.encode_single_piece(b)

    def _fit(self, a: int, t: int) -> bool:
        """Whether t may follow a within a piece; a is -1 at its start."""
        if len(self.fits) >= _PAIRS:
            self.fits.clear()
        got = self._single(self.words[t] if a < 0 else self.words[a] + self.words[t]) == ([t] if a < 0 else [a, t])
        self.fits[a << 20 | t] = got
        return got

    def piece(self, p: str) -> list[int]:
        """Tokens of p[:i] for each byte i from 0 to p's last, each prefix as a piece of its own."""
        b = p if p.isascii() else p.encode().decode("latin-1")  # a byte as each code point
        last, count = [-1] * (len(b) + 1), [0] * (len(b) + 1)
        fits = self.fits
        for end, (n, t) in self.ending.iter(b):  # at each place the longest first
            i = end + 1
            if not count[i]:
                a = last[i - n]
                key = a << 20 | t
                if fits[key] if key in fits else self._fit(a, t):
                    last[i], count[i] = t, count[i - n] + 1
        return count

    def _part(self, p: str) -> bytes:
        """The steps of one piece, one a code point."""
        count = self.piece(p)
        if not p.isascii():
            count = [0, *(count[e] for e in _ends(p))]
        if len(p) == 3 and p[0] == "'":  # 're, 've, 'll: of two letters' prefix only the quote is a piece
            count[2] = count[1] + self.piece(p[1])[-1]
        return _steps(count)

    def chunk(self, s: str) -> bytes:
        """The steps of s: their sums are the tokens of s[:i] for each code point i, each prefix encoded alone."""
        if s.isascii() and s.removeprefix(" ").isalpha():
            return _steps(self.piece(s))
        out = b"".join(map(self.parts.__getitem__, _PIECE.findall(s)))
        if not _BLANKS.search(s):
            return out
        out = np.cumsum(np.frombuffer(out, np.int16), dtype=np.int64).tolist()
        for m in _BLANKS.finditer(s):  # a run of blanks is one piece while nothing follows it
            at = self.piece(m.group())
            first = out[m.start() - 1] if m.start() else 0
            out[m.start() : m.end()] = [first + at[e] for e in _ends(m.group())]
        return _steps([0, *out])

    def prefixes(self, text: str) -> np.ndarray:
        """Tokens of text[:i] for each code point i from 0 to len(text)."""
        if not any(s in text for s in self.bpe.special):
            return _counted(self.chunks(text))
        out, before, ordinary, base = [np.zeros(1, np.int32)], 0, "", 0
        for part in self.bpe.cut.split(text):
            if part in self.bpe.special:  # its own prefixes are ordinary text after the ordinary text before it
                out += [base + _counted([self.chunk(ordinary + part[:-1])])[len(ordinary) + 1 :], np.array([before + 1], np.int32)]
                before, ordinary, base = before + 1, "", before + 1
                continue
            ordinary, base = part, before
            own = _counted(self.chunks(part))
            out.append(base + own[1:])
            before += int(own[-1])
        return np.concatenate(out)


def _counted(steps: list[bytes]) -> np.ndarray:
    """The counts that the steps lead to, from 0."""
    joined = np.frombuffer(b"".join(steps), np.int16)
    out = np.zeros(len(joined) + 1, np.int32)
    np.cumsum(joined, out=out[1:])
    return out


def _ends(s: str) -> list[int]:
    """Byte offsets after each code point."""
    if s.isascii():
        return list(range(1, len(s) + 1))
    out, n = [], 0
    for c in s:
        n += len(c.encode())
        out.append(n)
    return out


@lru_cache(maxsize=4)
def prefix_counter(path: str) -> PrefixCounter:
    return PrefixCounter(byte_bpe(path))


def prefix_table(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, prefix_tokens): element i is the exact token count of the first i code points.

    Null and empty texts have the array [0]. Rows with equal or null ids each
    keep their row; other columns are not read.
    """

    def make():
        counter = prefix_counter(tokenizer)
        return lambda ids, texts: {"doc_id": ids, "prefix_tokens": [counter.prefixes(t or "") for t in texts]}

    return map_rows(docs.select("doc_id", "text"), f"doc_id {kind(docs, 'doc_id')}, prefix_tokens array<int>", make)


def fits_within(prefix_tokens: np.ndarray, budget: int) -> int:
    """Code points of the longest prefix of at most ``budget`` tokens. Counts may fall by a token or two, so all are looked at."""
    return int(np.flatnonzero(np.asarray(prefix_tokens) <= budget)[-1])


def counts(docs: DataFrame, tokenizer: str, limit: int = 512) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, limit_chars), answered from each text's prefix table.

    n_tokens is the table's last element, limit_chars the length in code points
    of the longest prefix of at most ``limit`` tokens. A table lasts as long as
    its text is looked at. Null text counts as empty: no bytes, no tokens. Rows
    with equal or null ids each keep their row; other columns are not read.
    """

    def make():
        counter = prefix_counter(tokenizer)

        def f(ids, texts):
            out: tuple[list, list, list] = ([], [], [])
            for t in texts:
                t = t or ""
                table = counter.prefixes(t)
                n = int(table[-1])
                out[0].append(len(t.encode()))
                out[1].append(n)
                out[2].append(len(t) if n <= limit else fits_within(table, limit))
            return {"doc_id": ids, "n_bytes": out[0], "n_tokens": out[1], "limit_chars": out[2]}

        return f

    got = map_rows(docs.select("doc_id", "text"), f"doc_id {kind(docs, 'doc_id')}, n_bytes bigint, n_tokens bigint, limit_chars bigint", make)
    return got.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "limit_chars")
