"""One ranking out of several."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60


def _ranked(hits: DataFrame, k: int, digits: int | None, ties: tuple[Column | str, ...]) -> DataFrame:
    if digits is not None:
        hits = hits.withColumn("score", F.round("score", digits))
    best = hits.orderBy(F.desc("score"), *ties).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), *ties)))  # k rows


def by_score(lists: DataFrame, k: int, digits: int | None = None, ties: tuple[Column | str, ...] = ("doc_id",)) -> DataFrame:
    """(doc_id, score, rank): the best score of each document over (doc_id, score) lists."""
    return _ranked(lists.groupBy("doc_id").agg(F.max("score").alias("score")), k, digits, ties)


def reciprocal_rank(lists: DataFrame, k: int, rrf_k: int = RRF_K, digits: int | None = None, ties: tuple[Column | str, ...] = ("doc_id",)) -> DataFrame:
    """(doc_id, score, rank) over (doc_id, rank[, weight]) lists: the sum of weight / (rrf_k + rank)."""
    weight = F.col("weight") if "weight" in lists.columns else F.lit(1.0)
    return _ranked(lists.groupBy("doc_id").agg(F.sum(weight / (F.lit(float(rrf_k)) + F.col("rank"))).alias("score")), k, digits, ties)


def weights_of(sizes: DataFrame) -> DataFrame:
    """(shard, weight) of (shard, n): each shard's share of the documents."""
    return sizes.crossJoin(F.broadcast(sizes.agg(F.sum("n").alias("all")))).select("shard", (F.col("n") / F.col("all").cast("double")).alias("weight"))  # one row


def shard_weights(sharded: DataFrame) -> DataFrame:
    """The same of one row a document."""
    return weights_of(sharded.groupBy("shard").agg(F.count("*").alias("n")))
