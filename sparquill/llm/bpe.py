"""Exact byte-level BPE for whole texts, and values of the chunks of a text with a bounded memo.

Pre-tokens never cross from a non-blank into a following space, so a text in
which no two blanks touch falls into chunks (a space and what follows it) that
can be looked at alone; equal chunks are looked up. Texts with runs of blanks
are cut before each run, with the run kept whole; texts with the control
characters that libraries class differently are not cut. The vocabulary comes
from the tokenizer's own JSON file; its special strings inside a text become
their ids, as the library does by default.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache

import regex
import tiktoken

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Chunks of one generation of the memo; two generations are held, about 200 bytes a chunk.
MEMO = 250_000
LONGEST_KEPT = 64
#: A run of so many blanks has the pre-tokens of its text found here: the library's pattern fails on some 100,000.
LONG = 10_000
_RUN = re.compile(r"\s\s")
_CUT = re.compile(r"\s*\S+|\s+")
_ODD = re.compile("[\x1c-\x1f]")
_PIECE = regex.compile(PATTERN)
_LONG_RUN = re.compile(r"\s{%d}" % LONG)


class Memo(dict):
    """A dict that fills itself; at MEMO entries the older generation goes."""

    def __init__(self, make):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, key):
        got = self.old.get(key)
        if got is None:
            got = self.make(key)
        if len(key) <= LONGEST_KEPT:
            if len(self) >= MEMO:
                self.old = dict(self)
                self.clear()
            self[key] = got
        return got


def _byte_names() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use, back to bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBPE:
    """A byte-level BPE tokenizer of a JSON file whose merge order is its id order."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        kind = spec["pre_tokenizer"] or {}
        if spec["model"]["type"] != "BPE" or kind.get("type") != "ByteLevel" or kind.get("add_prefix_space") or spec["normalizer"]:
            raise ValueError(f"{path}: not a plain byte-level BPE tokenizer")
        back = _byte_names()
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.ranks = {bytes(back[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        merges = ["".join(m if isinstance(m, list) else m.split(" ")) for m in spec["model"]["merges"]]
        order = [spec["model"]["vocab"][m] for m in merges]
        if order != sorted(order):
            raise ValueError(f"{path}: ids are not in the order of merges")
        self.encoding = tiktoken.Encoding("byte-bpe", pat_str=PATTERN, mergeable_ranks=self.ranks, special_tokens={})
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def _ordinary(self, s: str) -> bytes:
        if len(s) < LONG or not _LONG_RUN.search(s):
            return array("I", self.encoding.encode_ordinary(s)).tobytes()
        single = self.encoding._core_bpe.encode_single_piece
        return b"".join(array("I", single(m.group().encode())).tobytes() for m in _PIECE.finditer(s))

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if not any(s in text for s in self.special):
            return self._ordinary(text)
        return b"".join(array("I", [self.special[p]]).tobytes() if p in self.special else self._ordinary(p) for p in self.cut.split(text))


class Chunks:
    """Values of a text's chunks, made once: made(chunk), as bytes that for adjacent pre-tokens are joined.

    So a line break before a word and a stop after one need no entry of their own.
    """

    def __init__(self, made):
        self.made = made
        self.mark = {c: made(c) for c in ".,\n"}
        self.bare = Memo(lambda k: self._part(k, k, self.bare))
        self.spaced = Memo(lambda k: self.mark["\n"] + self.bare[k[1:]] if k[:1] == "\n" and len(k) > 1 else self._part(k, k if k[:1] == "\n" else " " + k, self.spaced))

    def _part(self, key: str, chunk: str, memo: Memo) -> bytes:
        if key[-1:] in self.mark and key[:-1].isalpha():
            return memo[key[:-1]] + self.mark[key[-1]]
        return self.made(chunk)

    def __call__(self, text: str) -> list[bytes]:
        """The chunks' values in order, of a text without special strings."""
        if not text:
            return []
        if _RUN.search(text):
            return [self.made(text)] if _ODD.search(text) else list(map(self.bare.__getitem__, _CUT.findall(text)))
        first, *rest = text.replace("\n", " \n").split(" ")
        return [*([self.bare[first]] if first else []), *map(self.spaced.__getitem__, rest)]


@lru_cache(maxsize=4)
def byte_bpe(path: str) -> ByteBPE:
    """One for each path and process."""
    return ByteBPE(path)
