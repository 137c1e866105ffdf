"""Command line: ``python -m sparquill.cli INDEX COMMAND ...``; results are JSON lines."""

from __future__ import annotations

import argparse
import json
import sys
import time
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from sparquill.config import Config
from sparquill.operators import evaluate
from sparquill.operators.lifecycle import Index
from sparquill.sources.readers import Mapping, read_source


def _said(rows: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in rows.collect()]


def index(i: Index, a) -> list[dict]:
    return [i.upsert([{"id": a.id, "text": a.text, "metadata": dict(m.split("=", 1) for m in a.meta)}], strict=True)]


def bulk(i: Index, a) -> list[dict]:
    return [i.upsert_ndjson(i.spark.read.text(a.lines))]


def ingest(i: Index, a) -> list[dict]:
    """Documents of files of any known format, or gen://N."""
    docs = read_source(i.spark, a.source, Mapping(a.id_field, a.text_field or ("text",), a.meta_field), a.format, a.limit, a.seed)
    out = i.upsert(docs)
    i.flush()
    return [out | {"seq": i.manifest["seq"]}]


def delete(i: Index, a) -> list[dict]:
    return [{"seq": i.delete(a.id)}]


def search(i: Index, a) -> list[dict]:
    return i.search(" ".join(a.query), a.top_k, a.retriever, not a.no_snippet, a.per_shard)


def batch(i: Index, a) -> list[dict]:
    """Queries of a file of JSON lines (qid, text), written as Parquet."""
    i.search_batch(i.spark.read.schema("qid string, text string").json(a.queries), a.top_k, a.retriever).write.mode("overwrite").parquet(a.out)
    return [{"out": a.out}]


def health(i: Index, a) -> list[dict]:
    return [i.health()]


def segments(i: Index, a) -> list[dict]:
    return _said(i.segments())


def shards(i: Index, a) -> list[dict]:
    return _said(i.shards())


def flush(i: Index, a) -> list[dict]:
    return [{"flushed": i.flush()}]


def merge(i: Index, a) -> list[dict]:
    return [{"segments": i.force_merge(a.segments)}]


def warm(i: Index, a) -> list[dict]:
    return [{"postings": i.warm(a.terms)}]


def vacuum(i: Index, a) -> list[dict]:
    return [{"deleted": i.vacuum(a.log)}]


def reset(i: Index, a) -> list[dict]:
    i.reset()
    return [{"seq": i.manifest["seq"]}]


def sweep(i: Index, a) -> list[dict]:
    """Effectiveness and latency of the same queries at falling numbers of generations."""
    asked = i.spark.read.schema("qid string, text string").json(a.queries)
    if a.sample:
        asked = evaluate.sampled(asked, a.sample)
    judged = i.spark.read.schema("qid string, doc_id string, rel int").json(a.qrels)
    return sweep_segments(i, asked, judged, a.segments, a.top_k)


def sweep_segments(i: Index, asked: DataFrame, judged: DataFrame, targets: Sequence[int], k: int = 10) -> list[dict]:
    """One row for each target, most generations first: those left, seconds to merge and to warm, means of effectiveness, latency of single queries."""
    queries = [(r.qid, r.text) for r in asked.select("qid", "text").collect()]  # a sample of queries
    out = []
    for target in sorted(targets, reverse=True):
        began = time.perf_counter()
        left = i.force_merge(target)
        i.warm()
        ready = time.perf_counter() - began
        times, hits = [], []
        for qid, text in queries:
            began = time.perf_counter()
            hits += [(qid, h["doc_id"], h["rank"]) for h in i.search(text, k, snippet=False)]
            times.append((time.perf_counter() - began,))
        run = i.spark.createDataFrame(hits, "qid string, doc_id string, rank int")
        means = evaluate.means(evaluate.per_query(run, judged, k)).first().asDict()
        took = evaluate.latency(i.spark.createDataFrame(times, "s double"), "s").first().asDict()
        out.append({"target": target, "segments": left, "ready_s": round(ready, 3)} | means | {f"{n}_ms": round(1000 * took[n], 1) for n in ("mean", "p50", "p95", "p99")} | {"qps": round(len(times) / max(1e-9, sum(t for t, in times)), 2)})
    return out


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="sparquill", description=__doc__)
    top.add_argument("path", help="folder of the index")
    top.add_argument("--config", help="file of settings")
    of = top.add_subparsers(dest="command", required=True)

    def command(f: Callable, *options: tuple) -> None:
        p = of.add_parser(f.__name__, help=f.__doc__)
        p.set_defaults(run=f)
        for *names, how in options:
            p.add_argument(*names, **how)

    k = ("--top-k", {"type": int, "default": 10})
    command(index, ("id", {}), ("text", {}), ("--meta", {"action": "append", "default": [], "metavar": "KEY=VALUE"}))
    command(bulk, ("lines", {"help": "a file of one JSON document a line"}))
    command(
        ingest, ("source", {}), ("--format", {}), ("--limit", {"type": int}), ("--seed", {"type": int, "default": 0}), ("--id-field", {"default": "id"}),
        ("--text-field", {"action": "extend", "nargs": "+", "default": []}), ("--meta-field", {"action": "extend", "nargs": "+", "default": []}),
    )
    command(delete, ("id", {"nargs": "+"}))
    command(search, ("query", {"nargs": "+"}), k, ("--retriever", {}), ("--no-snippet", {"action": "store_true"}), ("--per-shard", {"action": "store_true"}))
    command(batch, ("queries", {}), ("out", {}), k, ("--retriever", {}))
    command(sweep, ("queries", {}), ("qrels", {}), k, ("--sample", {"type": int}), ("--segments", {"type": int, "nargs": "+", "default": [8, 4, 2, 1]}))
    command(merge, ("--segments", {"type": int, "default": 1}))
    command(warm, ("--terms", {"type": int}))
    command(vacuum, ("--log", {"action": "store_true"}))
    for f in (health, segments, shards, flush, reset):
        command(f)
    return top


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("sparquill").getOrCreate()
    try:
        for row in a.run(Index(spark, a.path, Config.load(a.config)), a):
            print(json.dumps(row, default=str, ensure_ascii=False))
    except (ValueError, OSError) as wrong:
        print(f"error: {wrong}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
