"""Toxic passages by maximal-scoring segments of token log-odds.

Fitting: words of labelled documents get log-odds between the toxic and the
other class under Dirichlet priors whose mass follows the pooled distribution;
words that are significantly toxic keep theirs, all others share one small
negative score, the log-odds of not being such a word. Scores are thus
log-likelihood ratios, for which the extreme-value parameter lambda is 1.

Scoring: one scan (Ruzzo and Tompa) finds all maximal segments in linear time;
runs of ordinary words enter as one negative number. A segment of score S in a
text of n words has S - ln(K n) as its normalised score, with K measured on
clean documents; the largest and the sum of the positive ones are mapped to a
probability by a logistic curve that is fitted on the same labelled rows.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparquill.llm.bpe import Memo
from sparquill.llm.common import kind, map_rows, written

#: Labelled rows that a model is fitted on at most, chosen by a hash of their id.
FIT_ROWS = 20_000
#: Prior mass as a share of each class's own, least z value and documents of a toxic word.
PRIOR, LEAST_Z, LEAST_DOCS = 0.2, 2.8, 3
THRESHOLD = 0.3
#: The score of a model that knows no toxic word, at most.
UNKNOWN = THRESHOLD / 2
#: Letters of a word's start, which counts as a token too and scores a word that has no score of its own.
START = 6
_WORD = re.compile(r"\w+")


def segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), end exclusive, in linear time."""
    kept: list[tuple[int, int, float, float]] = []  # start, end, sum before, sum up to the end
    total = 0.0
    for i, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        a, left, right = i, before, total
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= left:
                j -= 1
            if j < 0 or kept[j][3] >= right:
                break
            a, left = kept[j][0], kept[j][2]
            del kept[j:]
        kept.append((a, i + 1, left, right))
    return [(a, b, r - x) for a, b, x, r in kept]


@dataclass(frozen=True)
class Model:
    words: dict[str, float]
    other: float
    log_k: float
    curve: tuple[float, ...]

    @cached_property
    def of(self) -> Memo:
        """A word's score, that of its start, or 0; looked up once a word while the memo holds it."""
        get = self.words.get
        return Memo(lambda w: get(w) or get(w[:START] + "*", 0.0))

    def passages(self, text: str | None) -> tuple[int, list[tuple[int, int, float]]]:
        """The number of words, and (first word, word after the last, score) of each maximal segment."""
        words = _WORD.findall(text.lower()) if text else []
        of = self.of
        hits = [(i, s) for i, w in enumerate(words) if (s := of[w])]
        if not hits:
            return len(words), []
        scores, at, last = [], [], -1
        for i, s in hits:
            scores += [self.other * (i - last - 1), s]
            at += [i, i]
            last = i
        return len(words), [(at[a], at[b - 1] + 1, s) for a, b, s in segments(scores)]

    def evidence(self, n: int, found: list[tuple[int, int, float]]) -> tuple[float, float]:
        """Largest normalised score (-5 where there is no segment), and the log of 1 + the sum of positive ones."""
        base = self.log_k + math.log(max(n, 1))
        e = [s - base for _, _, s in found]
        return max(-5.0, min(15.0, max(e, default=-5.0))), math.log1p(sum(x for x in e if x > 0))

    def score(self, text: str | None) -> float:
        return self.chance(*self.passages(text))

    def chance(self, n: int, found: list[tuple[int, int, float]]) -> float:
        """The score of a text of n words with these passages."""
        a, b = self.evidence(n, found)
        z = self.curve[0] + self.curve[1] * a + self.curve[2] * b
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def _signature(text: str) -> int:
    """The least hash of five-word shingles: copies and near copies of a text mostly share it."""
    w = text.lower().split()
    return min((xxhash.xxh32_intdigest(" ".join(w[i : i + 5])) for i in range(max(1, len(w) - 4))), default=0)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    x, w = np.column_stack([np.ones(len(x)), x]), np.zeros(x.shape[1] + 1)
    ridge = np.diag([1e-6] + [0.01] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge
        step = np.linalg.solve(h, x.T @ (y - p) - ridge @ w)
        w = w + np.clip(step, -2, 2)
        if abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    """A model from the labelled documents whose crc32(doc_id) mod 4 is not 2.

    At most about ``rows`` of them, chosen by a hash of the id; of texts that
    are copies or nearly so, one. Null texts and labels are left out. With no
    labelled rows, or of one class only, or where no word stands out, no word is
    toxic and nothing is flagged: all scores are the share of toxic rows, or
    UNKNOWN where that is more or there are no rows of both classes.
    """
    known = labels.filter("toxic is not null and doc_id is not null and crc32(cast(doc_id as string)) % 4 <> 2")
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    n = known.count()
    known = known.filter(F.expr(f"pmod(xxhash64(doc_id), 1000000) < {min(1.0, rows / max(n, 1)) * 1e6:.0f}"))
    # The sample has a bound, so it is broadcast and texts are read where they lie.
    # Written, as two jobs follow: the documents are read once.
    texts = written(docs.select("doc_id", "text").filter("text is not null").join(F.broadcast(known), "doc_id"))

    def mark():
        return lambda ids, ts, ys: {"doc_id": ids, "text": ts, "toxic": ys, "sign": [_signature(t) for t in ts]}

    marked = map_rows(texts.select("doc_id", "text", "toxic"), f"doc_id {kind(docs, 'doc_id')}, text string, toxic int, sign bigint", mark)
    best = marked.groupBy("sign", "toxic").agg(F.min("doc_id").alias("doc_id"))
    sample = written(marked.join(best, ["sign", "toxic", "doc_id"], "left_semi").dropDuplicates(["doc_id"]).select("text", "toxic"))

    def count():
        def f(ts, ys):
            tokens, inside = (Counter(), Counter()), (Counter(), Counter())
            for t, y in zip(ts, ys):
                w = _WORD.findall(t.lower())
                w += [x[:START] + "*" for x in w if len(x) > START]
                y = int(y > 0)
                tokens[y].update(w)
                inside[y].update(set(w))
            words = list(tokens[0].keys() | tokens[1].keys())
            cols = {"word": words}
            for y in (0, 1):
                cols |= {f"t{y}": [tokens[y][w] for w in words], f"d{y}": [inside[y][w] for w in words]}
            return cols

        return f

    n1, n0 = (sample.filter(c).count() for c in ("toxic > 0", "toxic <= 0"))
    share = min(UNKNOWN, (n1 + 0.5) / (n1 + n0 + 1))
    flat = Model({}, -1e-9, 0.0, (math.log(share / (1 - share)), 0.0, 0.0))
    if not n1 or not n0:
        return flat
    words = map_rows(sample, "word string, t0 bigint, d0 bigint, t1 bigint, d1 bigint", count)
    words = written(words.groupBy("word").agg(*(F.sum(c).alias(c) for c in ("t0", "d0", "t1", "d1"))))
    all0, all1 = words.agg(F.sum("t0"), F.sum("t1")).first()
    # Log-odds of documents with the word, under priors in proportion to the pooled share, over their deviation.
    q = f"((d0 + d1) / {float(n0 + n1)}D)"
    c1, c0 = (f"(d{y} + {PRIOR * n}D * {q})" for y, n in ((1, n1), (0, n0)))
    m1, m0 = f"({n1 * (1 + PRIOR)}D - {c1} + 0.5D)", f"({n0 * (1 + PRIOR)}D - {c0} + 0.5D)"
    z = f"(ln({c1} / {m1}) - ln({c0} / {m0})) / sqrt(1D / {c1} + 1D / {c0} + 1D / {m1} + 1D / {m0})"
    odd = words.filter(f"d1 >= {LEAST_DOCS}").withColumn("z", F.expr(z)).filter(f"z >= {LEAST_Z}").select("word", "t0", "t1").collect()
    if not odd:
        return flat
    in1, in0 = sum(r.t1 for r in odd), sum(r.t0 for r in odd)
    scores = {}
    for r in odd:
        share = (r.t0 + r.t1) / (all0 + all1)
        p1, p0 = ((t + PRIOR * a * share) / (a * (1 + PRIOR)) for t, a in ((r.t1, all1), (r.t0, all0)))
        scores[r.word] = math.log(p1 / p0)
    scores = {w: s for w, s in scores.items() if s > 0}
    other = math.log((1 - in1 / (all1 + 1)) / (1 - in0 / (all0 + 1)))
    model = Model(scores, min(other, -1e-6), 0.0, (0.0, 1.0, 1.0))

    def look():
        def f(ts, ys):
            found = [model.passages(t) for t in ts]
            return {"toxic": [int(y > 0) for y in ys], "n": [n for n, _ in found], "s": [[s for _, _, s in x] for _, x in found]}

        return f

    seen = map_rows(sample, "toxic int, n bigint, s array<double>", look).collect()  # as many rows as the sample
    least = min(scores.values())
    over = sum(s >= least for r in seen if not r.toxic for s in r.s)
    model = Model(scores, model.other, math.log((over + 0.5) / (sum(r.n for r in seen if not r.toxic) + 1)) + least, model.curve)
    x = np.array([model.evidence(r.n, [(0, 0, s) for s in r.s]) for r in seen])
    return Model(scores, model.other, model.log_k, _logistic(x, np.array([r.toxic for r in seen], float)))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row: doc_id, held_out, score, predicted, passages (first word, word after the last, score).

    Null and empty texts have no passages and the score of such texts. A null
    id is not held out. Other columns are not read.
    """

    def make():
        def f(ids, texts):
            found = [model.passages(t) for t in texts]
            got = [model.chance(n, x) for n, x in found]
            held = [i is not None and zlib.crc32(str(i).encode()) % 4 == 2 for i in ids]
            return {"doc_id": ids, "held_out": held, "score": got, "predicted": [int(s >= threshold) for s in got], "passages": [[{"start": a, "end": b, "score": s} for a, b, s in x] for _, x in found]}

        return f

    schema = f"doc_id {kind(docs, 'doc_id')}, held_out boolean, score double, predicted int, passages array<struct<start: bigint, end: bigint, score: double>>"
    return map_rows(docs.select("doc_id", "text"), schema, make)


def clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that are under the threshold, with all their columns. Null texts are judged as empty ones."""
    ok = F.udf(lambda t: model.score(t) < threshold, "boolean", useArrow=True)
    return docs.filter(ok("text"))
