"""Effectiveness of a run (qid, doc_id, rank) against judgements (qid, doc_id, rel), and latency figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def per_query(run: DataFrame, qrels: DataFrame, k: int = 10, recall_k: int | None = None) -> DataFrame:
    """(qid, ndcg, mrr, recall, ap): one row for each judged query; without hits or relevant documents 0."""
    recall_k = recall_k or k
    qrels = qrels.groupBy("qid", "doc_id").agg(F.max("rel").alias("rel"))
    order = Window.partitionBy("qid").orderBy(F.desc("rel"), "doc_id")
    gain = (F.pow(F.lit(2.0), F.col("rel")) - 1) / F.log2(F.col("rank") + 1.0)
    ideal = qrels.withColumn("rank", F.row_number().over(order)).groupBy("qid").agg(
        F.sum(F.when(F.col("rank") <= k, gain).otherwise(0.0)).alias("idcg"),
        F.sum((F.col("rel") > 0).cast("int")).alias("relevant"),
    )
    hits = run.select("qid", "doc_id", "rank").join(qrels, ["qid", "doc_id"]).filter("rel > 0")
    place = Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    hits = hits.withColumn("nth", F.count("*").over(place))

    def within(value: Column, n: int) -> Column:
        return F.when(F.col("rank") <= n, value)

    found = hits.groupBy("qid").agg(
        F.sum(within(gain, k)).alias("dcg"),
        F.min(within(F.col("rank"), k)).alias("first"),
        F.count(within(F.lit(1), recall_k)).alias("n"),
        F.sum(within(F.col("nth") / F.col("rank"), recall_k)).alias("precision"),
    )
    j = ideal.join(found, "qid", "left")
    zero = F.lit(0.0)
    some = F.col("relevant") > 0
    return j.select(
        "qid",
        F.coalesce(F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")), zero).alias("ndcg"),
        F.coalesce(F.lit(1.0) / F.col("first"), zero).alias("mrr"),
        F.coalesce(F.when(some, F.col("n") / F.col("relevant")), zero).alias("recall"),
        F.coalesce(F.when(some, F.col("precision") / F.col("relevant")), zero).alias("ap"),
    )


def means(scores: DataFrame) -> DataFrame:
    """One row: queries, ndcg, mrr, recall, map."""
    return scores.agg(F.count("*").alias("queries"), *(F.avg(c).alias(n) for c, n in (("ndcg", "ndcg"), ("mrr", "mrr"), ("recall", "recall"), ("ap", "map"))))


def latency(times: DataFrame, column: str, by: str | None = None) -> DataFrame:
    """Exact linear percentiles p50, p95, p99, the mean and the count."""
    aggs = [F.percentile(column, p).alias(f"p{int(p * 100)}") for p in (0.5, 0.95, 0.99)]
    aggs += [F.avg(column).alias("mean"), F.count(column).alias("n")]
    return times.groupBy(by).agg(*aggs) if by else times.agg(*aggs)


def against(scores: DataFrame, baseline: DataFrame) -> DataFrame:
    """(dataset, metric, value, base, delta) and so the macro average as dataset ``mean``."""
    both = scores.join(baseline.withColumnRenamed("value", "base"), ["dataset", "metric"], "left")
    mean = both.groupBy("metric").agg(F.avg("value").alias("value"), F.avg("base").alias("base")).withColumn("dataset", F.lit("mean"))
    return both.unionByName(mean.select(*both.columns)).withColumn("delta", F.col("value") - F.col("base"))


def sampled(queries: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n queries drawn without replacement, the same for the same seed and ids."""
    return queries.orderBy(F.xxhash64("qid", F.lit(seed)), "qid").limit(n)
