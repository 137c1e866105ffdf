"""Which generations to merge."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MB = 1024 * 1024


@dataclass(frozen=True)
class TieredPolicy:
    segments_per_tier: int = 10
    max_merge_at_once: int = 10
    level_ratio: int = 10  # kept as a setting, read by nothing
    deletion_weight: float = 2.0
    floor_segment_mb: int = 2
    max_merge_size_bytes: int = 0
    expunge_deletes_threshold: float = 0.25

    def waste(self, segment: dict) -> float:
        """Size, at least the floor, made heavier by the share of deleted documents."""
        share = segment["deleted_docs"] / segment["doc_count"] if segment["doc_count"] else 0
        return max(segment["size_bytes"], self.floor_segment_mb * MB, 1) * (1 + self.deletion_weight * share)

    def select_merge(self, segments: list[dict]) -> list[dict]:
        """The most wasteful of the lowest level that is over capacity; at least two, else within the size cap."""
        for level in sorted({s["level"] for s in segments}):
            group = [s for s in segments if s["level"] == level]
            if len(group) <= self.segments_per_tier:
                continue
            picked = sorted(group, key=self.waste, reverse=True)[: self.max_merge_at_once]
            total, out = 0, []
            for s in picked:
                total += s["size_bytes"]
                if self.max_merge_size_bytes and total > self.max_merge_size_bytes and len(out) >= 2:
                    break
                out.append(s)
            return out
        return []

    def select_expunge(self, segments: list[dict]) -> list[dict]:
        t = self.expunge_deletes_threshold
        return [s for s in segments if s["doc_count"] and s["deleted_docs"] / s["doc_count"] >= t] if 0 < t < 1 else []

    def select_expunge_frame(self, segments: DataFrame) -> DataFrame:
        """The same choice over a table of segments."""
        if not 0 < self.expunge_deletes_threshold < 1:
            return segments.limit(0)
        share = F.col("deleted_docs") / F.when(F.col("doc_count") > 0, F.col("doc_count")).cast("double")
        return segments.filter(share >= F.lit(float(self.expunge_deletes_threshold)))

    def select_merge_frame(self, segments: DataFrame) -> DataFrame:
        """The same choice over a table (segment_id, level, doc_count, deleted_docs, size_bytes); ties by segment_id."""
        share = F.when(F.col("doc_count") > 0, F.col("deleted_docs") / F.col("doc_count").cast("double")).otherwise(0.0)
        waste = F.greatest(F.col("size_bytes").cast("double"), F.lit(float(max(1, self.floor_segment_mb * MB)))) * (F.lit(1.0) + F.lit(float(self.deletion_weight)) * share)
        crowded = segments.groupBy("level").agg(F.count("*").alias("n")).filter(F.col("n") > self.segments_per_tier).agg(F.min("level").alias("level"))
        one = segments.join(F.broadcast(crowded), "level").withColumn("waste", waste)  # one level
        order = Window.partitionBy("level").orderBy(F.desc("waste"), "segment_id")
        one = one.withColumn("place", F.row_number().over(order)).withColumn("running", F.sum("size_bytes").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        ok = F.col("place") <= self.max_merge_at_once
        if self.max_merge_size_bytes:
            ok &= (F.col("place") <= 2) | (F.col("running") <= self.max_merge_size_bytes)
        return one.filter(ok).select("segment_id", "level", "place")

    @staticmethod
    def next_level(level: int) -> int:
        return level + 1
