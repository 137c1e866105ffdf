"""Which shard a document belongs to: a ring of virtual nodes."""

from __future__ import annotations

import json
from bisect import bisect_left

from pyspark.sql import Column
from pyspark.sql import functions as F

_FNV_PRIME, _FNV_START, _M32 = 0x01000193, 0x811C9DC5, 0xFFFFFFFF


def ring_hash(s: str) -> int:
    """FNV-1a of 32 bits over UTF-8, then murmur3's finaliser."""
    h = _FNV_START
    for b in s.encode():
        h = (h ^ b) * _FNV_PRIME & _M32
    h = (h ^ (h >> 16)) * 0x85EBCA6B & _M32
    h = (h ^ (h >> 13)) * 0xC2B2AE35 & _M32
    return h ^ (h >> 16)


def _times(x: Column, by: int) -> Column:
    """x * by modulo 2^32 without leaving 64 bits: the factor's halves one after the other."""
    m = F.lit(_M32).cast("long")
    low = (x * F.lit(by & 0xFFFF)).bitwiseAND(m)
    high = F.shiftleft((x * F.lit(by >> 16)).bitwiseAND(F.lit(0xFFFF).cast("long")), 16)
    return (low + high).bitwiseAND(m)


def _xor_shift(x: Column, n: int) -> Column:
    return x.bitwiseXOR(F.shiftright(x, n))


def ring_hash_column(key: Column | str) -> Column:
    """The same for a string column, in column expressions."""
    c = F.col(key) if isinstance(key, str) else key
    digits = F.hex(F.encode(c, "UTF-8"))
    n = (F.length(digits) / 2).cast("int")
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    octets = F.transform(places, lambda i: F.conv(F.substring(digits, i * 2 + 1, F.lit(2)), 16, 10).cast("long"))
    h = F.aggregate(octets, F.lit(_FNV_START).cast("long"), lambda h, b: _times(h.bitwiseXOR(b), _FNV_PRIME))
    h = _times(_xor_shift(h, 16), 0x85EBCA6B)
    h = _times(_xor_shift(h, 13), 0xC2B2AE35)
    return _xor_shift(h, 16)


class Ring:
    """n shards with ``vnodes`` places each; a key belongs to the first place at or after its hash."""

    def __init__(self, n: int, vnodes: int = 150):
        if n < 1:
            raise ValueError("a ring needs a shard")
        places = sorted((ring_hash(f"{shard}:{k}"), shard) for shard in range(n) for k in range(vnodes))
        self.places = [p for p, _ in places]
        self.shards = [s for _, s in places]

    def shard_for(self, key: str) -> int:
        i = bisect_left(self.places, ring_hash(key))
        return self.shards[i if i < len(self.shards) else 0]

    def column(self, key: Column | str) -> Column:
        """The shard of a string column.

        Places are literals by the first byte of the hash, each byte's list
        closed by the first place after it, so a row looks at a few of them.
        """
        lists, i = [], 0
        for top in range(256):
            own = []
            while i < len(self.places) and self.places[i] >> 24 == top:
                own.append((self.places[i], self.shards[i]))
                i += 1
            own.append((self.places[i], self.shards[i]) if i < len(self.places) else (1 << 32, self.shards[0]))
            lists.append([{"p": p, "s": s} for p, s in own])
        ring = F.from_json(F.lit(json.dumps(lists)), "array<array<struct<p: bigint, s: int>>>")  # folded to a literal

        def find(h: Column) -> Column:
            return F.array_min(F.filter(F.element_at(ring, (F.shiftright(h, 24) + 1).cast("int")), lambda x: x["p"] >= h))["s"]

        return F.element_at(F.transform(F.array(ring_hash_column(key)), find), 1)  # the hash is bound, not computed again
