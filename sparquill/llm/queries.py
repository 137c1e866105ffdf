"""The registered queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sparquill.llm import (
    byte_digest,
    chat,
    decontamination,
    licenses,
    packing,
    secret_scan,
    simhash,
    suffix_dedup,
    token_counts,
    toxicity,
)
from sparquill.llm.common import table

TOKENIZER = "byte_bpe_50k.json"
#: Both turns of conversation -1.
CONFLICT = "<|im_end|><|im_start|>assistant ok"


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = packing.pieces(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
    return packing.pack(items)


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated(table(spark, sf_dir, "documents"))


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.counts(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", CONFLICT), (-1, 1, "assistant", CONFLICT)], rows.schema)
    return chat.summary(rows.unionByName(extra))


def op9_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op10_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_digest.compared(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op")}


def oracle_sql() -> dict[str, str]:
    own = " UNION ALL ".join(f"SELECT -1, {turn}, '{role}', '{CONFLICT}'" for turn, role in enumerate(("user", "assistant")))
    rows = f"(SELECT conv_id, turn, role, text FROM conversations UNION ALL {own})"
    return {"op8_chat_formatting": chat.summary_sql(rows), "op9_license_scans": licenses.scan_sql()}


