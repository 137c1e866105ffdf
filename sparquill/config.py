"""Settings: defaults, then a file, then the environment."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields, replace

from sparquill.functions.scoring import DEFAULT_FIELDS, FieldWeight


@dataclass(frozen=True)
class Config:
    data_dir: str = "data"
    num_shards: int = 1
    virtual_nodes_per_shard: int = 150
    max_buffer_docs: int = 100_000
    max_buffer_mb: int = 256
    idle_flush_seconds: int = 30
    merge_after_flush: bool = True
    refresh_interval_ms: int = 1000
    segments_per_tier: int = 15
    max_merge_at_once: int = 10
    max_merge_size_mb: int = 256
    merge_deletion_weight: float = 2.0
    floor_segment_mb: int = 2
    expunge_deletes_pct: float = 0.25
    warmup_top_terms: int = 1000
    bm25_k1: float = 1.2
    bm25_b: float = 0.75
    scorer: str = "bm25"
    stemming: bool = False
    language: str = "english"
    numeric_ids: bool = False
    stopwords: bool = False
    synonyms: str = ""
    global_fusion: str = "score"
    default_top_k: int = 10
    phrase_boost: float = 0.25
    query_cache_size: int = 1000
    log_level: str = "info"
    field_weights: tuple[FieldWeight, ...] = field(default=DEFAULT_FIELDS)

    @classmethod
    def load(cls, path: str | None = None, env: dict[str, str] | None = None, prefix: str = "SPARQUILL_") -> Config:
        """A file of ``key: value`` lines (``#`` comments, one level of sections ignored), then PREFIX_KEY variables.

        A variable that does not parse as its setting's type is ignored; an
        unknown key in a file is an error.
        """
        out, kinds = cls(), {f.name: f.type for f in fields(cls) if f.name != "field_weights"}
        if path:
            with open(path, encoding="utf-8") as file:
                for line in file:
                    key, _, value = (x.strip() for x in line.split("#")[0].partition(":"))
                    if not value:
                        continue
                    if key not in kinds:
                        raise ValueError(f"{path}: unknown setting {key}")
                    out = replace(out, **{key: _parsed(value.strip("\"'"), kinds[key])})
        for key, kind in kinds.items():
            value = (os.environ if env is None else env).get(prefix + key.upper())
            if value:
                try:
                    out = replace(out, **{key: _parsed(value, kind)})
                except ValueError:
                    continue
        return out


def _parsed(value: str, kind: str):
    if kind == "bool":
        return value.lower() in ("1", "true", "yes", "on")
    return {"int": int, "float": float}.get(kind, str)(value)
