"""Text to terms, as column expressions and, for query texts, on the driver.

A term is a maximal run of letters and decimal digits, in simple lower case:
``İ`` and ``Σ`` are mapped by themselves first, because full case mapping
would add a combining dot or choose a final sigma. Combining marks separate.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

import pandas as pd
import regex
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparquill.functions.porter2 import stem

TERM = r"[\p{L}\p{Nd}]+"
SEPARATOR = r"[^\p{L}\p{Nd}]+"
_TERM = regex.compile(TERM)
_SIMPLE = str.maketrans("İΣ", "iσ")


def tokens(text: Column | str) -> Column:
    """array<string> of the terms of a text column; empty for null."""
    c = F.col(text) if isinstance(text, str) else text
    found = F.regexp_extract_all(F.translate(c, "İΣ", "iσ"), F.lit(f"({TERM})"), F.lit(1))
    return F.coalesce(F.transform(found, F.lower), F.array().cast("array<string>"))


def joined(text: Column | str) -> Column:
    """The same terms as one string with a blank between two: no array and no object for each term.

    Lower case is taken before separators are sought: it makes no letter of
    what is none, nor the other way.
    """
    c = F.col(text) if isinstance(text, str) else text
    for old, new in (("İ", "i"), ("Σ", "σ")):
        c = F.replace(c, F.lit(old), F.lit(new))
    return F.coalesce(F.trim(F.regexp_replace(F.lower(c), SEPARATOR, " ")), F.lit(""))


def tokenize(text: str) -> list[str]:
    """The same on the driver, for query texts."""
    return [t.lower() for t in _TERM.findall(text.translate(_SIMPLE))]


def english_stop_words(spark: SparkSession | None = None) -> list[str]:
    """Spark's English list, split at apostrophes as terms are; digits are no stop words."""
    del spark  # the list needs a running session, which its loader finds
    return sorted({t for w in StopWordsRemover.loadDefaultStopWords("english") for t in tokenize(w) if not t.isdigit()})


def without_stop_words(terms: Column, stop: Iterable[str]) -> Column:
    """Order and repetition of the rest stay."""
    stop = list(stop)
    return F.filter(terms, lambda t: ~t.isin(stop)) if stop else terms


@dataclass(frozen=True)
class Analyzer:
    """How texts become terms. ``language`` is that of the stemmer; english is the only one."""

    stop_words: bool = False
    stemming: bool = False
    language: str = "english"
    stop: tuple[str, ...] = field(default=(), compare=False)

    def __post_init__(self):
        if self.language != "english":
            raise ValueError(f"no stemmer for {self.language}")
        if self.stop_words and not self.stop:
            object.__setattr__(self, "stop", tuple(english_stop_words()))

    def column(self, text: Column | str) -> Column:
        """Terms without stemming, which ``postings`` does once for each distinct term."""
        out = tokens(text)
        return without_stop_words(out, self.stop) if self.stop_words else out

    def joined(self, text: Column | str) -> Column:
        """The same as one string with a blank between two."""
        return F.array_join(self.column(text), " ") if self.stop_words else joined(text)

    def terms(self, text: str) -> list[str]:
        out = [t for t in tokenize(text) if not (self.stop_words and t in set(self.stop))]
        return [stem(t) for t in out] if self.stemming else out

    def with_synonyms(self, word: str, synonyms: Synonyms | None) -> list[str]:
        """Terms of one query word, each followed by its synonyms; no repetition within the word if there is a map."""
        own = self.terms(word)
        if synonyms is None:
            return own
        out: list[str] = []
        for t in own:
            for x in (t, *synonyms.of(t, self.stemming)):
                if x not in out:
                    out.append(x)
        return out

    def stemmed(self, rows: DataFrame, column: str = "term") -> DataFrame:
        """``rows`` with the column's values stemmed: each distinct value once, then an equality join."""
        if not self.stemming:
            return rows
        return stem_terms(rows, column)


def stem_column(column: Column | str) -> Column:
    """The stem of each value."""

    @F.pandas_udf("string")
    def stems(words: pd.Series) -> pd.Series:
        return words.map(stem, na_action="ignore")

    return stems(column)


def stem_terms(rows: DataFrame, column: str) -> DataFrame:
    known = rows.select(F.col(column).alias("__word")).distinct().withColumn("__stem", stem_column("__word"))
    out = rows.join(known, F.col(column) == F.col("__word"), "left")
    return out.withColumn(column, F.coalesce("__stem", column)).drop("__word", "__stem")


class Synonyms:
    """Groups of words that stand for each other; a word of several groups has the others of all, first seen first."""

    def __init__(self, groups: Iterable[Iterable[str]]):
        self.map: dict[str, list[str]] = {}
        for group in groups:
            words = list(dict.fromkeys(w for g in group if (w := g.strip().lower())))
            if len(words) < 2:
                continue
            for w in words:
                others = self.map.setdefault(w, [])
                others += [x for x in words if x != w and x not in others]
        self.by_stem: dict[str, list[str]] = {}
        for w, others in self.map.items():
            known = self.by_stem.setdefault(stem(w), [])
            known += [s for s in dict.fromkeys(map(stem, others)) if s not in known]

    def of(self, term: str, stemmed: bool = False) -> list[str]:
        return (self.by_stem if stemmed else self.map).get(term, [])

    @classmethod
    def parse(cls, text: str) -> Synonyms:
        """One comma-separated group a line; ``#`` starts a comment line."""
        lines = (line.strip() for line in text.splitlines())
        return cls(line.split(",") for line in lines if line and not line.startswith("#"))

    @classmethod
    def load(cls, path: str) -> Synonyms:
        with open(path, encoding="utf-8") as file:
            return cls.parse(file.read())

    def frame(self, spark: SparkSession) -> DataFrame:
        """(term, synonym) rows."""
        return spark.createDataFrame([(w, s) for w, o in self.map.items() for s in o], "term string, synonym string")
