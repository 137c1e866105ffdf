"""Batches of queries straight from texts, for as many queries and terms as fit one matrix.

One scan makes a row for each document with the places of its wanted terms,
their numbers and the wanted runs of terms that it holds. Scores are products
of such rows with the matrix of the queries' weights, and each task keeps what
can still be among a query's k best; so no pairs of queries and documents are
shuffled.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparquill.functions.analysis import Analyzer
from sparquill.functions.scoring import BM25
from sparquill.sources.readers import written

#: Cells of the matrix of terms and queries, 8 bytes each in every worker, at most.
CELLS = 4_000_000


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *(len(x) for x in parts)]).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(kind.to_pandas_dtype()), kind))


def _hashes(ids: np.ndarray, n: int) -> np.ndarray:
    """A number for each run of n ids; equal runs have equal ones."""
    u, out = ids.astype(np.uint64), np.zeros(len(ids) - n + 1, np.uint64)
    for i in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + u[i : i + len(out)]
    return out


def counted(docs: DataFrame, terms: list[str], runs: list[tuple[str, ...]] = (), analyzer: Analyzer | None = None) -> DataFrame:
    """(doc_id, dl, ids, tfs, held): places in ``terms`` and how often each is there, places of the runs (of one length, all of ``terms``) that it holds."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    n = len(runs[0]) if runs else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {t: i for i, t in enumerate(terms)}
        known = {tuple(place[t] for t in r): i for i, r in enumerate(runs)}
        sought = np.unique(np.concatenate([_hashes(np.array(r), n) for r in known])) if known else None
        for b in batches:
            dl, ids, tfs, held = [], [], [], []
            for text in b.column(1).to_pylist():
                toks = text.split(" ") if text else []
                own = np.fromiter((place.get(t, -1) for t in toks), np.int64, len(toks))
                found, tf = np.unique(own[own >= 0], return_counts=True)
                dl.append(len(toks))
                ids.append(found)
                tfs.append(tf)
                of = set()
                if known and len(own) >= n:
                    h = _hashes(own, n)
                    at = np.minimum(np.searchsorted(sought, h), len(sought) - 1)
                    of = {known.get(tuple(own[i : i + n].tolist()), -1) for i in np.flatnonzero(sought[at] == h)} - {-1}
                held.append(np.array(sorted(of), np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(dl, pa.int32()), _lists(ids, pa.int32()), _lists(tfs, pa.int32()), _lists(held, pa.int32())], names=["doc_id", "dl", "ids", "tfs", "held"])

    rows = docs.select("doc_id", (analyzer or Analyzer()).joined("text").alias("w"))
    return written(rows.mapInArrow(run, f"doc_id {kind}, dl int, ids array<int>, tfs array<int>, held array<int>"))


def _best(found: list[tuple], k: int, slack: float) -> list[tuple]:
    """Of (score, doc_id) those that can be among the k best once scores are rounded: of equal scores the k least ids."""
    found.sort(key=lambda x: (-x[0], x[1] is not None, x[1]))
    if len(found) <= k:
        return found
    floor, out, same = found[k - 1][0] - slack, [], Counter()
    for x in found:
        if x[0] < floor:
            break
        same[x[0]] += 1
        if same[x[0]] <= k:
            out.append(x)
    return out


def search(rows: DataFrame, terms: list[str], asked: list[tuple], k: int, scorer: BM25, digits: int | None = None, qid: str = "bigint") -> DataFrame:
    """(qid, doc_id, score, rank) of queries (qid, term, qtf) over the rows of ``counted``."""
    spark = rows.sparkSession
    n, avgdl = rows.agg(F.count("*"), F.coalesce(F.avg("dl"), F.lit(0.0))).first()
    df = np.zeros(len(terms))
    for r in rows.select(F.explode("ids").alias("id")).groupBy("id").agg(F.count("*").alias("df")).collect():  # the queries' terms
        df[r.id] = r.df
    idf = np.log((n - df + 0.5) / (df + 0.5) + 1)
    place, names = {t: i for i, t in enumerate(terms)}, list(dict.fromkeys(q for q, _, _ in asked))
    at = {q: i for i, q in enumerate(names)}
    weight = np.zeros((len(terms), len(names)))
    for q, t, qtf in asked:
        weight[place[t], at[q]] = qtf * idf[place[t]]
    k1, b, slack = scorer.k1, scorer.b, 0.0 if digits is None else 2 * 10.0**-digits
    kind = rows.schema["doc_id"].dataType.simpleString()
    target = pa.schema([("q", pa.int32()), ("doc_id", rows.select("doc_id").limit(0).toArrow().schema.field(0).type), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, floor = defaultdict(list), np.zeros(len(names))
        rows_at_once = max(1, CELLS // len(names))
        for batch in (b.slice(i, rows_at_once) for b in batches for i in range(0, b.num_rows, rows_at_once)):
            doc, dl = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            ids, tfs = batch.column(2), batch.column(3)
            ends, ids, tfs = ids.offsets.to_numpy(), ids.values.to_numpy(), tfs.values.to_numpy().astype(float)
            score = np.zeros((len(doc), len(names)))
            for i in range(len(doc)):
                s = slice(ends[i], ends[i + 1])
                part = tfs[s] * (k1 + 1) / (tfs[s] + k1 * (1 - b + b * dl[i] / avgdl if avgdl else 1 - b))
                score[i] = part @ weight[ids[s]]
            for q in range(len(names)):
                for i in _above(score[:, q], k, floor[q], slack):
                    kept[q].append((float(score[i, q]), doc[i]))
                kept[q] = _best(kept[q], k, slack)
                if len(kept[q]) >= k:
                    floor[q] = kept[q][k - 1][0] - slack
        out = [(q, d, s) for q, own in kept.items() for s, d in own]
        yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], f.type) for j, f in enumerate(target)], schema=target)

    hits = rows.select("doc_id", "dl", "ids", "tfs").mapInArrow(run, f"q int, doc_id {kind}, score double")
    hits = hits.join(F.broadcast(spark.createDataFrame(list(enumerate(names)), f"q int, qid {qid}")), "q").select("qid", "doc_id", "score")  # a row a query
    if digits is not None:
        hits = hits.withColumn("score", F.round("score", digits))
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "doc_id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _above(score: np.ndarray, k: int, floor: float, slack: float) -> np.ndarray:
    """Places of the scores that can be among the k best."""
    kth = np.partition(score, -k)[-k] - slack if len(score) > k else 0.0
    return np.flatnonzero((score > 0) & (score >= max(kth, floor)))
