"""The passage of a text that is shown with a hit."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH = 200
_SENTENCE = re.compile(r"[^.!?\n]*[.!?\n]+|[^.!?\n]+\Z")


def sentences(text: str) -> list[tuple[int, int]]:
    """(start, end) of each sentence with its marks; what precedes the first blank is kept as it is."""
    return [m.span() for m in _SENTENCE.finditer(text)]


def snippet(text: str | None, terms: list[str], idf: dict[str, float] | None = None, width: int = WIDTH) -> str:
    """About ``width`` code points around the rarest term's first place, cut at a sentence or else a word.

    Terms are found as substrings in lower case; a term without an idf weighs
    1; of equal weights the earlier place wins. Without a hit the text's start.
    """
    if not text:
        return ""
    low, n = text.lower(), len(text)
    places = [(-(idf or {}).get(t, 1.0), p) for t in dict.fromkeys(terms) if t and (p := low.find(t)) >= 0]
    hit = min(places)[1] if places else -1
    spans = sentences(text)
    start = max(0, hit - width // 2)
    own = next((a for a, b in spans if a <= hit < b), 0)
    if own >= start:
        start = own
    elif start:
        while start < n and not text[start].isspace():
            start += 1
        while start < n and text[start].isspace():
            start += 1
    end = min(start + width, n)
    stop = next((b for a, b in spans if a <= end - 1 <= b), 0)
    if start < stop <= end:
        end = stop
    elif end < n:
        while end > start and not text[end - 1].isspace():
            end -= 1
    return ("…" if start else "") + text[start:end].strip() + ("…" if end < n else "")


def with_snippets(hits: DataFrame, docs: DataFrame, terms: list[str], idf: dict[str, float] | None = None, id_col: str = "doc_id") -> DataFrame:
    """``hits`` with a snippet column; texts are read for the hits only, after the top k are known."""
    cut = F.udf(lambda t: snippet(t, terms, idf), "string", useArrow=True)
    found = docs.select(id_col, "text").join(F.broadcast(hits), id_col)
    return found.withColumn("snippet", cut(F.col("text"))).drop("text")
