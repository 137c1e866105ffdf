"""Secret scans: named patterns, and sliding-window entropy per character class.

Candidate strings are runs of token characters. In each stretch of a class
(hexadecimal, or letters and digits of both) a window slides one character at
a time; its Shannon entropy follows from counts that change by one character
in and one out. Windows over the class's threshold are merged to spans, with
the ends of the stretch that are shorter than a window; of a
span that a named pattern covers in part, what is left is a span. An
allow list suppresses what looks random but is public: UUIDs, digests that are
announced as such, placeholders, alphabets. Of these only the announced digest
is suppressed with its whole run, the others with the windows that they touch.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparquill.llm.common import kind, map_rows

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # as AKIA[A-Z0-9]+ of 20 and more: the rest of a run only gets shorter
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "entropy")
_NAMES = ("passw", "secret", "token", "api")

WINDOW = 20
#: Class of characters, bits of entropy that a window needs, what else the window must hold.
CLASSES = (
    (re.compile(r"[0-9a-fA-F]{20,}"), 3.0, re.compile(r"(?=.*[0-9]{1})(?=.*[a-fA-F])")),
    (re.compile(r"[A-Za-z0-9+/_=-]{20,}"), 3.8, re.compile(r"(?=.*[0-9])(?=.*[A-Za-z])")),
)
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
_UUID = re.compile(r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}")
_PUBLIC = re.compile(r"(?i)wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY|example|sample|placeholder|dummy|xxxx|abcdefghij|0123456789|1234567890|changeme")
_ANNOUNCED = re.compile(r"(?i)(?<![a-z0-9])(sha-?(1|224|256|384|512)|md5|commit|digest|checksum|integrity|etag|rev(ision)?)[\"']?\s*[:=-]?\s*[\"']?$")
_CLOG = [0.0] + [c * math.log2(c) for c in range(1, WINDOW + 2)]  # a character comes in before one goes out


def hot_windows(s: str, threshold: float) -> list[tuple[int, int]]:
    """Merged spans of the windows of s with at least ``threshold`` bits of entropy."""
    n, count, total, out = len(s), {}, 0.0, []
    top = math.log2(WINDOW)
    for i, c in enumerate(s):
        k = count.get(c, 0)
        total += _CLOG[k + 1] - _CLOG[k]
        count[c] = k + 1
        if i >= WINDOW:
            o = s[i - WINDOW]
            k = count[o]
            total += _CLOG[k - 1] - _CLOG[k]
            count[o] = k - 1
        if i >= WINDOW - 1 and top - total / WINDOW >= threshold:
            a = i - WINDOW + 1
            if out and a <= out[-1][1]:
                out[-1] = (out[-1][0], i + 1)
            else:
                out.append((a, i + 1))
    return out if n >= WINDOW else []


def stretched(s: str, hot: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans, the first and last over the ends of s too: less than a window, up to a slash, they cannot be judged alone."""
    if hot and hot[0][0] < WINDOW:
        hot = [(s.rfind("/", 0, hot[0][0]) + 1, hot[0][1]), *hot[1:]]
    if hot and len(s) - hot[-1][1] < WINDOW:
        end = s.find("/", hot[-1][1])
        hot = [*hot[:-1], (hot[-1][0], len(s) if end < 0 else end)]
    return hot


def suspects(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """The parts of the candidate at start..end that are not public by their form; none if what stands before announces it."""
    if _ANNOUNCED.search(text, max(0, start - 24), start):
        return []
    public = sorted(m.span() for r in (_UUID, _PUBLIC) for m in r.finditer(text, start, end))
    return outside(start, end, public)


def outside(a: int, b: int, base: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What the sorted spans of ``base`` leave of a..b, where that is a window or more."""
    out = []
    for x, y in [*base, (b, b)]:
        if min(x, b) - a >= WINDOW:
            out.append((a, min(x, b)))
        a = max(a, y)
    return out


def spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start and then kind; entropy spans overlap no other span."""
    if not text:
        return []
    low = text.lower()
    out = []
    if any(x in low for x in _NAMES):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text)]
    runs = [m.span() for m in _CANDIDATE.finditer(text)]
    if runs:
        out += [("hex", *m.span()) for m in HEX.finditer(text)]
        base = sorted((a, b) for _, a, b in out)
        ends = list(accumulate((b for _, b in base), max))  # of all up to each
        at = 0
        more: list[tuple[int, int]] = []
        for a, b in runs:
            parts = suspects(text, a, b)
            while at < len(ends) and ends[at] <= a:
                at += 1
            near = base[at : bisect_left(base, (b,))]
            for chars, bits, needs in CLASSES:
                for m in (m for part in parts for m in chars.finditer(text, *part)):
                    hot = [s for x, y in stretched(m.group(), hot_windows(m.group(), bits)) for s in outside(m.start() + x, m.start() + y, near)]
                    more += [(x, y) for x, y in hot if needs.match(text[x:y])]
        merged: list[tuple[int, int]] = []
        for a, b in sorted(more):
            if merged and a <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
            else:
                merged.append((a, b))
        out += [("entropy", a, b) for a, b in merged]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def joined(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def scan(docs: DataFrame) -> DataFrame:
    """One row per row: doc_id, n_assign, n_access, n_hex, n_entropy, base_sha256, spans.

    Null text is empty text: no spans, and the digest of nothing. Rows with
    equal or null ids each keep their row; other columns are not read.
    """

    def make():
        def f(ids, texts):
            found = [spans(t) for t in texts]
            n = {f"n_{k}": [sum(s[0] == k for s in x) for x in found] for k in KINDS}
            sha = [hashlib.sha256(joined([s for s in x if s[0] != "entropy"]).encode()).hexdigest() for x in found]
            return {"doc_id": ids, **n, "base_sha256": sha, "spans": [joined(x) for x in found]}

        return f

    counts = ", ".join(f"n_{k} bigint" for k in KINDS)
    return map_rows(docs.select("doc_id", "text"), f"doc_id {kind(docs, 'doc_id')}, {counts}, base_sha256 string, spans string", make)


def redact(text: str | None) -> str | None:
    """The text with each stretch of secrets replaced by the kind of its first span."""
    found = spans(text)
    out, at = [], 0
    for k, a, b in found:
        if a >= at:
            out += [text[at:a], f"<secret:{k}>"]
        at = max(at, b)
    return "".join([*out, text[at:]]) if found else text


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with secrets masked in text, and n_chars (where there) counted anew for the masked texts. All rows and columns stay."""
    mask = F.udf(redact, "string", useArrow=True)
    out = docs.withColumn("__masked", mask("text"))
    if "n_chars" in docs.columns:
        n = F.when(F.col("__masked") != F.col("text"), F.length("__masked")).otherwise(F.col("n_chars"))
        out = out.withColumn("n_chars", n.cast(docs.schema["n_chars"].dataType))
    return out.withColumn("text", F.col("__masked")).select(docs.columns)
