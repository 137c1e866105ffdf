"""Scorers as column factories: what they build is compiled with the rest of the plan."""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F


class Scorer(Protocol):
    """The extension point: any object with these two methods ranks."""

    def idf(self, n: Column, df: Column) -> Column: ...

    def impact(self, tf: Column, dl: Column, avgdl: Column, idf: Column) -> Column: ...


def _d(x: float) -> Column:
    return F.lit(float(x))


# k1, b, the fields' weights and the thousandths of pseudo frequencies are those that results are compared with.


@dataclass(frozen=True)
class BM25:
    k1: float = 1.2
    b: float = 0.75

    def idf(self, n: Column, df: Column) -> Column:
        return F.log((n - df + _d(0.5)) / (df + _d(0.5)) + _d(1))

    def impact(self, tf: Column, dl: Column, avgdl: Column, idf: Column) -> Column:
        norm = F.when(avgdl > 0, dl / avgdl).otherwise(_d(0))
        return idf * (tf * _d(self.k1 + 1)) / (tf + _d(self.k1) * (_d(1 - self.b) + _d(self.b) * norm))

    def score(self, tf: float, df: float, dl: float, avgdl: float, n: float) -> float:
        """The same number on the driver, for explanations and tests."""
        idf = math.log((n - df + 0.5) / (df + 0.5) + 1)
        return idf * tf * (self.k1 + 1) / (tf + self.k1 * (1 - self.b + self.b * (dl / avgdl if avgdl else 0)))

    def upper_bound(self, df: float, shortest: float, avgdl: float, n: float) -> float:
        """The score of one occurrence in the shortest document."""
        return self.score(1, df, shortest, avgdl, n)


@dataclass(frozen=True)
class TFIDF:
    def idf(self, n: Column, df: Column) -> Column:
        return F.when((df > 0) & (n > 0), F.log(n / F.when(df > 0, df))).otherwise(_d(0))

    def impact(self, tf: Column, dl: Column, avgdl: Column, idf: Column) -> Column:
        return idf * F.log1p(tf)

    def score(self, tf: float, df: float, dl: float, avgdl: float, n: float) -> float:
        return math.log(n / df) * math.log1p(tf) if df and n else 0.0


@dataclass(frozen=True)
class BM25F:
    """Over the field-weighted pseudo frequency in thousandths; document length is in it already."""

    k1: float = 1.2

    def idf(self, n: Column, df: Column) -> Column:
        return BM25(self.k1).idf(n, df)

    def impact(self, tf: Column, dl: Column, avgdl: Column, idf: Column) -> Column:
        p = tf / _d(1000)
        return idf * _d(self.k1 + 1) * p / (_d(self.k1) + p)

    def score(self, tf: float, df: float, dl: float, avgdl: float, n: float) -> float:
        p = tf / 1000
        return math.log((n - df + 0.5) / (df + 0.5) + 1) * (self.k1 + 1) * p / (self.k1 + p)


@dataclass(frozen=True)
class FieldWeight:
    name: str
    weight: float
    b: float


#: Fields of BM25F where none are configured.
DEFAULT_FIELDS = (FieldWeight("title", 2.5, 0.45), FieldWeight("body", 1.0, 0.75))


def scorer_for(name: str | None, k1: float = 1.2, b: float = 0.75) -> Scorer:
    """By retriever name; what is not tfidf or bm25f is bm25 with the given parameters."""
    return {"tfidf": TFIDF(), "bm25f": BM25F(k1)}.get((name or "").lower(), BM25(k1, b))
