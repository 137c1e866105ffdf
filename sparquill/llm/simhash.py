"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint has 64 bits. Two that differ in at most two bits, cut into two
segments of 32, have a segment in which they differ in at most one. So each
distinct fingerprint is indexed under its 64 one-wildcard variants (segment,
position, the segment without that bit), variants are joined by equality, and
every candidate is verified by its distance.

A key held by two fingerprints gives its pair from the aggregate itself. Where
a key is held by three or more, pairs could grow with the square of the group:
those fingerprints are joined instead by one-bit variants of the whole
fingerprint. Two fingerprints are within two bits exactly if some 64-bit value
is within one bit of both, so grouping the 65 values around each fingerprint by
equality, and linking each to the least of its value's group (65 members at
most), gives the same components with a number of links in proportion to the
fingerprints. No cap, no dropped bucket.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparquill.llm.common import discard, few_files, kind, map_rows, written
from sparquill.llm.components import components

#: Keys that are broadcast at most when fingerprints of dense keys are looked up (16 bytes each).
BROADCAST_KEYS = 100_000


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash of the word shingles; 0 for null, empty and blank texts."""
    if not text:
        return 0
    w = text.encode().lower().split()  # of bytes: A-Z only, and the six ASCII blanks only
    if not w:
        return 0
    shingles = map(b" ".join, zip(*(w[i:] for i in range(words)))) if len(w) >= words else [b" ".join(w)]
    h = np.fromiter((xxhash.xxh64_intdigest(s, seed) for s in shingles), dtype=">u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 4096):
        ones += np.unpackbits(h[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp): fp holds the 64 bits as a signed long. Other columns of ``docs`` are not read."""

    def make():
        def f(ids, texts):
            got = np.fromiter((fingerprint(t, words, seed) for t in texts), dtype=np.uint64, count=len(texts))
            return {"doc_id": ids, "fp": got.view(np.int64)}

        return f

    return map_rows(docs.select("doc_id", "text"), f"doc_id {kind(docs, 'doc_id')}, fp long", make)


def variants(fps: DataFrame) -> DataFrame:
    """(key, fp): the 64 one-wildcard variants of the two 32-bit segments."""
    low, high = "(fp & 4294967295L)", "shiftrightunsigned(fp, 32)"
    key = f"shiftleft(cast(p as bigint), 32) | (if(p < 32, {low}, {high}) & ~shiftleft(1L, p % 32))"
    return fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("p")).select(F.expr(key).alias("key"), "fp")


def links(fps: DataFrame) -> DataFrame:
    """(a, b) between distinct fingerprints within two bits, enough of them to connect all that are."""
    # A fingerprint becomes 64 rows: the few files it is read from are dealt over as many tasks as a shuffle has.
    index = variants(fps.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp"))
    held = written(index.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).filter("n > 1"))
    pairs = held.filter("n = 2 and bit_count(a ^ b) <= 2").select("a", "b")
    keys = held.filter("n > 2").select("key")
    few = keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    dense = written(few_files(index.join(F.broadcast(keys) if few else keys, "key", "left_semi").select("fp").distinct(), fps.count()))
    around = dense.select("fp", F.explode(F.expr("concat(array(fp), transform(sequence(0, 63), p -> fp ^ shiftleft(1L, p)))")).alias("m"))
    star = around.withColumn("a", F.min("fp").over(Window.partitionBy("m"))).filter("fp <> a").select("a", F.col("fp").alias("b"))
    return pairs.unionByName(star)


def grouped(docs: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp, root, component_id) for each row of ``docs``; root names the group even where ids are null."""
    own = written(fingerprints(docs, words, seed))
    return _grouped(own, own.count())


def _grouped(own: DataFrame, rows: int) -> DataFrame:
    fps = written(few_files(own.groupBy("fp").agg(F.min("doc_id").alias("least")), rows))
    root = components(links(fps.select("fp")))
    of = written(few_files(fps.join(root, fps.fp == root.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), rows))
    discard(fps)
    least = of.groupBy("root").agg(F.min("least").alias("component_id"))
    return own.join(of.join(least, "root").select("fp", "root", "component_id"), "fp").select("doc_id", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id (the least doc_id reachable).

    Null and blank texts have fingerprint 0 and are linked like any other. A
    null doc_id takes part; a component of null ids only has a null id. Rows
    that repeat each keep their row. An empty table gives an empty result.
    Other columns of ``docs``, whatever their names, are not read.
    """
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return grouped(docs, words, seed).select("doc_id", digits, "component_id")


def deduplicated(docs: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """``docs`` with one row of each group left: that of its least doc_id (nulls last).

    All columns are kept. Where several rows of a group share that doc_id, the
    one with the least fingerprint stays; of rows equal in both, one.
    """
    own = written(fingerprints(docs, words, seed))
    n = own.count()
    found = written(few_files(_grouped(own, n), n))
    discard(own)
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "fp")
    best = found.groupBy("root").agg(F.min(order).alias("best")).select(F.col("best.doc_id").alias("keep_id"), F.col("best.fp").alias("keep_fp"))
    rows = found.groupBy(F.col("doc_id").alias("id")).agg(F.count("*").alias("n"))
    keep = written(few_files(best.join(rows, F.expr("keep_id <=> id")).select("keep_id", "keep_fp", "n"), n))
    discard(found)
    # An id of one row is looked up by id alone, so no fingerprint is computed again.
    once = keep.filter("n = 1 and keep_id is not null").select(F.col("keep_id").alias("__keep"))
    out = docs.join(once.hint("shuffle_hash"), docs["doc_id"] == F.col("__keep"), "left_semi")
    again = keep.filter("n > 1 or keep_id is null").select(F.col("keep_id").alias("__id"), F.col("keep_fp").alias("__best"))
    if again.isEmpty():
        return out
    ids = again.select(F.col("__id").alias("__some")).distinct()
    some = docs.join(ids, F.col("doc_id").eqNullSafe(F.col("__some")), "left_semi")
    mark = F.udf(lambda t: int(np.uint64(fingerprint(t, words, seed)).astype(np.int64)), "long")
    some = some.withColumn("__fp", mark("text"))
    some = some.join(again, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__fp") == F.col("__best")), "left_semi")
    return out.unionByName(some.dropDuplicates(["doc_id", "__fp"]).select(docs.columns))
