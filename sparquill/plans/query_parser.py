"""The search box: words, ``+must``, ``-not``, NOT, AND, OR and ``"phrases"``."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

from sparquill.functions.analysis import Analyzer, Synonyms


def _add(to: list[str], new: list[str]) -> None:
    to += [t for t in dict.fromkeys(new) if t not in to]


@dataclass
class ParsedQuery:
    must: list[str] = field(default_factory=list)
    should: list[str] = field(default_factory=list)
    excluded: list[str] = field(default_factory=list)
    phrases: list[list[str]] = field(default_factory=list)
    counts: Counter = field(default_factory=Counter)

    @property
    def terms(self) -> list[str]:
        """All scored terms, each once: must first."""
        return list(dict.fromkeys(self.must + self.should))

    @property
    def scoring_terms(self) -> list[str]:
        """Each scored term as often as it was typed."""
        return [t for t in self.terms for _ in range(max(1, self.counts[t]))]

    @property
    def weights(self) -> dict[str, int]:
        return {t: max(1, self.counts[t]) for t in self.terms}

    @property
    def has_filters(self) -> bool:
        return bool(self.must or self.excluded or self.phrases)

    def key(self) -> tuple:
        """What two queries share exactly if they mean the same."""
        return (tuple(sorted(self.must)), tuple(sorted(self.should)), tuple(sorted(self.excluded)), tuple(sorted(map(tuple, self.phrases))), tuple(sorted(self.weights.items())))


class _Reader:
    def __init__(self, analyzer: Analyzer, synonyms: Synonyms | None):
        self.analyzer, self.synonyms = analyzer, synonyms
        self.out, self.negated, self.required = ParsedQuery(), False, False
        self.recent: list[str] = []  # terms of the last word that became optional

    def scored(self, terms: list[str], required: bool) -> None:
        _add(self.out.must if required else self.out.should, terms)
        self.out.counts.update(terms)

    def conjunction(self) -> None:
        for t in self.recent:
            if t in self.out.should:
                self.out.should.remove(t)
                _add(self.out.must, [t])
        self.recent, self.required = [], True

    def phrase(self, text: str) -> None:
        terms = self.analyzer.terms(text)
        if terms and self.negated:
            _add(self.out.excluded, terms)
        elif terms:
            self.out.phrases.append(terms)
            self.recent = terms
            self.scored(terms, self.required)
        self.negated = self.required = False

    def word(self, w: str) -> None:
        if len(w) > 1 and w[0] in "+-":
            self.negated, self.required = self.negated or w[0] == "-", self.required or w[0] == "+"
            w = w[1:]
        terms = self.analyzer.with_synonyms(w, self.synonyms)
        if self.negated:
            _add(self.out.excluded, terms)
            self.negated = False
        elif self.required:
            self.scored(terms, True)
            self.required = False
        else:
            self.recent = terms
            self.scored(terms, False)


def parse(q: str, analyzer: Analyzer | None = None, synonyms: Synonyms | None = None) -> ParsedQuery:
    """A preprocessed query; operators are recognised in upper case only.

    A term joined by AND takes what stood before it along. A quote that is
    never closed runs to the end. Signs before a quote belong to the first word.
    """
    r, words = _Reader(analyzer or Analyzer(), synonyms), iter(q.split())
    for w in words:
        if w.startswith('"'):
            text = w[1:]
            while not text.endswith('"') and (more := next(words, None)) is not None:
                text += " " + more
            r.phrase(text.removesuffix('"'))
        elif w == "AND":
            r.conjunction()
        elif w == "OR":
            r.negated = r.required = False
        elif w == "NOT":
            r.negated = True
        else:
            r.word(w)
    return r.out
