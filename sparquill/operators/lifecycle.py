"""A persistent index: a log of changes, immutable generations, numbered manifests.

``changelog/`` holds every change with its sequence number, in batches whose
names tell their numbers; a batch is there from one rename on. A flush turns
the changes since the last one into a generation (documents, postings, lengths)
and lists what they make void in older ones; a merge rewrites several
generations as one, without what is void. The manifest names all that counts
and keeps the figures of each generation, so a search reads the postings of its
terms, the list of void documents and the texts of its hits, and statistics are
those of the live view: results do not depend on the layout.

One writer at a time; a second one fails at its next manifest. A writer that
stops anywhere leaves the last manifest and a log that goes on where the last
whole batch ends.
"""

from __future__ import annotations

import math
import time
import uuid
from collections import OrderedDict
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparquill.config import Config
from sparquill.functions.analysis import Analyzer, Synonyms
from sparquill.functions.query_text import preprocess, preprocess_column
from sparquill.functions.routing import Ring
from sparquill.functions.scoring import scorer_for
from sparquill.functions.snippet import snippet as cut_snippet
from sparquill.operators import build, fusion, versions
from sparquill.operators.policy import MB, TieredPolicy
from sparquill.operators.store import Conflict, Files, Manifests
from sparquill.plans import search as plan
from sparquill.plans.query_parser import ParsedQuery, parse

FORMAT = 2
_DOC = "id string, text string, fields map<string,string>, metadata map<string,string>"
_LOG = [x.split()[0] for x in versions.CHANGES.split(", ")]
#: Columns of a generation's tables.
TABLES = {
    "docs": versions.CHANGES + ", shard int",
    "postings": "term string, doc_id string, tf int, dl int, seq bigint, shard int",
    "terms": "term string, df bigint",
    "lengths": "doc_id string, seq bigint, dl int, shard int, segment_id string",
    "fields": "term string, doc_id string, field string, len int, tf int, seq bigint",
    "field_lengths": "doc_id string, field string, len int, seq bigint",
    "voids": "segment_id string, doc_id string, seq bigint, dl int",
}
#: Void documents, pending changes or hits that are broadcast at most (some tens of bytes each); more are joined by a shuffle.
FEW = 500_000
#: Hits that are looked up by a list of their ids, which readers prune files by.
LISTED = 1_000
#: Term frequencies that a view keeps.
KNOWN = 100_000


class Hits(list):
    """Hits, and whether they lack generations that could not be read."""

    degraded = False


@dataclass
class View:
    """What a version of the index shows: figures of the live documents, void rows, live documents not yet flushed."""

    n: int
    total: int
    segments: list[dict]
    voids: DataFrame | None
    few: bool
    fresh: DataFrame | None
    degraded: bool = False
    fields: dict[str, tuple[int, int]] = field(default_factory=dict)
    #: Documents with a term, by scorer and term, as far as they were asked for; 0 for a term that none has.
    known: dict[tuple[str, str], int] = field(default_factory=dict)

    def live(self, rows: DataFrame) -> DataFrame:
        """Rows (doc_id, seq, ...) of generations without those of void documents."""
        if self.voids is None:
            return rows
        keys = self.voids.select("doc_id", "seq")
        return rows.join(F.broadcast(keys) if self.few else keys, ["doc_id", "seq"], "left_anti")


class Index:
    """One index in one folder. Methods that change it return the new high sequence number."""

    def __init__(self, spark: SparkSession, path: str, config: Config | None = None):
        self.spark, self.path, self.config = spark, path, config or Config()
        self.files = Files(spark, path)
        self.manifests = Manifests(self.files)
        self.analyzer = Analyzer(self.config.stopwords, self.config.stemming, self.config.language)
        self.synonyms = Synonyms.load(self.config.synonyms) if self.config.synonyms else None
        self.ring = Ring(self.config.num_shards, self.config.virtual_nodes_per_shard)
        self.policy = TieredPolicy(
            self.config.segments_per_tier, self.config.max_merge_at_once, 10, self.config.merge_deletion_weight,
            self.config.floor_segment_mb, self.config.max_merge_size_mb * MB, self.config.expunge_deletes_pct,
        )
        self.ties = (F.expr("try_cast(doc_id as bigint)"), "doc_id") if self.config.numeric_ids else plan.BY_ID
        self.results: OrderedDict = OrderedDict()
        self.views: dict[tuple, View] = {}
        self.warmed: tuple[int, frozenset, DataFrame] | None = None
        kind = {"analyzer": asdict(self.analyzer) | {"stop": sorted(self.analyzer.stop)}, "format": FORMAT, "shards": self.config.num_shards}
        found = self.manifests.newest()
        if found is None:
            if self.files.names("gen") or self.files.exists("manifest.json"):
                raise ValueError(f"{path} has generations but no manifest of format {FORMAT}")
            self.manifest = kind | {"segments": [], "voids": [], "seq": 0, "flushed": 0, "floor": 0, "version": 0, "pending_bytes": 0, "changed_at": 0.0}
            self._save()
        else:
            self.manifest = found
            if self.manifest["format"] != FORMAT:
                raise ValueError(f"{path} has format {self.manifest['format']}, not {FORMAT}: index the documents again")
            if self.manifest["analyzer"] != kind["analyzer"] or self.manifest["shards"] != kind["shards"]:
                raise ValueError(f"{path} was built with another analyzer or number of shards")
        self._replay()

    def _save(self) -> None:
        self.manifest["version"] += 1
        self.results.clear()
        for v in self.views.values():
            for frame in (v.fresh, v.voids):
                if frame is not None:
                    frame.unpersist()
        self.views.clear()
        self.manifests.save(self.manifest)

    def _replay(self) -> None:
        """Takes up batches of the log that no manifest has heard of: the writer stopped between the two."""
        lost = [b for b in self._batches() if b[1] > self.manifest["seq"]]
        if not lost:
            return
        log = self.spark.read.schema(versions.CHANGES).parquet(*(f"{self.path}/changelog/{name}" for _, _, name in lost))
        reset = log.filter("op = 'reset'").agg(F.max("seq")).first()[0]
        if reset is not None:
            self._emptied(reset)
        self.manifest["pending_bytes"] += log.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
        self.manifest["seq"] = max(last for _, last, _ in lost)
        self._save()

    # Changes

    def _batches(self) -> list[tuple[int, int, str]]:
        """(first, last, name) of the log's batches in order."""
        out = []
        for name in self.files.names("changelog"):
            first, _, last = name.removeprefix("b").partition("-")
            if name.startswith("b") and first.isdigit() and last.isdigit():
                out.append((int(first), int(last), name))
        return sorted(out)

    def _log(self, numbered: DataFrame, first: int, last: int) -> None:
        """A batch of the log: written aside, there with one rename."""
        aside = f"staged/{uuid.uuid4().hex}"
        numbered.select(*_LOG).write.parquet(f"{self.path}/{aside}")
        if any(b[1] >= first for b in self._batches()):
            self.files.delete(aside)
            raise Conflict(f"change {first} of {self.path} is in the log already")
        self.files.move(aside, f"changelog/b{first:019d}-{last:019d}")

    def _documents(self, docs: DataFrame | list[dict]) -> DataFrame:
        if isinstance(docs, list):
            rows = [(d.get("id"), d.get("text"), d.get("fields"), d.get("metadata")) for d in docs]
            return self.spark.createDataFrame(rows, _DOC)
        have = [F.col(c) if c in docs.columns else F.lit(None).cast("map<string,string>").alias(c) for c in ("fields", "metadata")]
        return docs.select(F.col("id").cast("string").alias("id"), "text", *have)

    def _append(self, changes: DataFrame) -> int:
        """Changes (op, doc_id, text, fields, metadata) get consecutive numbers in their order and are logged.

        They are written before they are numbered, so that a task that runs
        again cannot number them otherwise.
        """
        aside = f"staged/{uuid.uuid4().hex}"
        changes.withColumn("at", F.monotonically_increasing_id()).write.parquet(f"{self.path}/{aside}")
        placed = self.spark.read.schema("op string, doc_id string, text string, fields map<string,string>, metadata map<string,string>, at bigint").parquet(f"{self.path}/{aside}")
        placed = placed.withColumn("part", F.shiftright("at", 33).cast("int"))
        sizes = placed.groupBy("part").agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).collect()  # one row a partition
        starts, first = [], self.manifest["seq"] + 1
        last = first - 1
        for part, n, _ in sorted(sizes):
            starts.append((part, last + 1))
            last += n
        if starts:
            known = self.spark.createDataFrame(starts, "part int, start bigint")
            seq = (F.col("start") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).alias("seq")
            self._log(placed.join(F.broadcast(known), "part").select(seq, "op", "doc_id", "text", "fields", "metadata", F.current_timestamp().alias("ts")), first, last)
            self.manifest["seq"] = last
            self.manifest["pending_bytes"] += sum(b for _, _, b in sizes)
            self.manifest["changed_at"] = time.time()
            self._save()
        self.files.delete(aside)
        self._flush_if_full()
        return last

    def upsert(self, docs: DataFrame | list[dict], strict: bool = False, blank: bool = False) -> dict[str, int]:
        """Logs documents with an id and a text, counts the others as failed; strict: any failure refuses all.

        ``blank``: a document needs no text; one without counts, with no terms.
        """
        docs = self._documents(docs)
        ok = F.coalesce(F.length("id") > 0 if blank else (F.length("id") > 0) & (F.length("text") > 0), F.lit(False))
        n = docs.agg(F.count_if(ok).alias("good"), F.count_if(~ok).alias("bad")).first()
        if strict and n.bad:
            raise ValueError(f"{n.bad} documents have no id or no text")
        if n.good:
            self._append(docs.filter(ok).select(F.lit("index").alias("op"), F.col("id").alias("doc_id"), "text", "fields", "metadata"))
        return {"indexed": n.good, "failed": n.bad}

    def upsert_ndjson(self, lines: DataFrame) -> dict[str, int]:
        """One JSON document a line in column ``value``; lines that do not parse are failures."""
        return self.upsert(lines.filter("trim(value) <> ''").select(F.from_json("value", _DOC).alias("d")).select("d.*"))

    def delete(self, ids: list[str] | DataFrame) -> int:
        if isinstance(ids, list):
            ids = self.spark.createDataFrame([(i,) for i in ids], "doc_id string")
        none = F.lit(None)
        maps = [none.cast("map<string,string>").alias(c) for c in ("fields", "metadata")]
        return self._append(ids.select(F.lit("delete").alias("op"), F.col("doc_id").cast("string").alias("doc_id"), none.cast("string").alias("text"), *maps))

    def apply(self, changes: DataFrame) -> int:
        """Logs changes that have their numbers already, all past the last one (replication)."""
        of = changes.agg(F.min("seq"), F.max("seq"), F.max(F.when(F.col("op") == "reset", F.col("seq"))), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
        first, last, reset, size = of
        if last is None:
            return self.manifest["seq"]
        self._log(changes, first, last)
        if reset is not None:
            self._emptied(reset)
        self.manifest["seq"] = last
        self.manifest["pending_bytes"] += size
        self.manifest["changed_at"] = time.time()
        self._save()
        return last

    def skip_to(self, seq: int) -> None:
        """Numbers up to ``seq`` are done with, whether or not the log has them (a replica's dead letters)."""
        self.manifest["seq"] = max(seq, self.manifest["seq"])
        self._save()

    def changelog(self, after: int = 0) -> DataFrame:
        """Changes past ``after`` and the last reset; batches that end before are not read."""
        after = max(after, self.manifest["floor"])
        names = [name for _, last, name in self._batches() if last > after]
        if not names:
            return self.spark.createDataFrame([], versions.CHANGES)
        log = self.spark.read.schema(versions.CHANGES).parquet(*(f"{self.path}/changelog/{n}" for n in names))
        return log.filter((F.col("seq") > after) & (F.col("op") != "reset"))

    def log_faults(self) -> DataFrame:
        """(seq, n): numbers that the log has more than once; n is 0 for one that is missing between its ends."""
        names = [name for _, _, name in self._batches()]
        if not names:
            return self.spark.createDataFrame([], "seq bigint, n bigint")
        seqs = self.spark.read.schema("seq bigint").parquet(*(f"{self.path}/changelog/{n}" for n in names))
        n = seqs.groupBy("seq").agg(F.count("*").alias("n"))
        ends = n.agg(F.max("seq").alias("high"))
        gaps = n.select((F.col("seq") + 1).alias("seq")).join(n.select("seq"), "seq", "left_anti").crossJoin(F.broadcast(ends)).filter("seq < high")  # one row
        return n.filter("n > 1").unionByName(gaps.select("seq", F.lit(0).cast("bigint").alias("n")))

    def pending(self) -> int:
        return self.manifest["seq"] - max(self.manifest["flushed"], self.manifest["floor"])

    # Generations

    def _flush_if_full(self) -> None:
        if self.pending() >= self.config.max_buffer_docs or self.pending() and self.manifest["pending_bytes"] >= self.config.max_buffer_mb * MB:
            self.flush()

    def flush_if_idle(self, now: float | None = None) -> bool:
        """Flushes what is pending once nothing has changed for ``idle_flush_seconds``."""
        if not self.pending() or (time.time() if now is None else now) - self.manifest["changed_at"] < self.config.idle_flush_seconds:
            return False
        self.flush()
        return True

    @property
    def _by_field(self) -> bool:
        return self.config.scorer == "bm25f"

    def _write(self, rows: DataFrame, level: int, flush_seq: int) -> dict | None:
        """A generation of live changes, one a document; None where there are none."""
        name = uuid.uuid4().hex
        root = f"{self.path}/gen/{name}"
        rows = rows.select(*_LOG).withColumn("shard", self.ring.column("doc_id") if self.config.num_shards > 1 else F.lit(0))
        if self.config.num_shards > 1:  # a file holds the rows of one shard, as far as there are enough files
            deal = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")) // self.config.num_shards)
            rows = rows.repartition("shard", F.pmod(F.xxhash64("doc_id"), F.lit(deal)))
        rows.sortWithinPartitions("doc_id").write.parquet(f"{root}/docs")
        docs = self.spark.read.schema(TABLES["docs"]).parquet(f"{root}/docs")
        # Ranges of terms, and of documents within a frequent term: readers skip the files that have none of a query's terms.
        aside = f"staged/{uuid.uuid4().hex}"
        counted = build.document_terms(docs, self.analyzer, extra=("seq", "shard"))
        counted.write.parquet(f"{self.path}/{aside}")
        counted = self.spark.read.schema(counted.schema).parquet(f"{self.path}/{aside}")
        post = build.exploded(counted, extra=("seq", "shard"))
        post.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id").write.parquet(f"{root}/postings")
        frequency = self._read("postings", [f"gen/{name}"]).groupBy("term").agg(F.count("*").alias("df"))
        frequency.repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{root}/terms")
        counted.select("doc_id", "seq", "dl", "shard", F.lit(name).alias("segment_id")).write.parquet(f"{root}/lengths")
        self.files.delete(aside)
        n, total = self._read("lengths", [f"gen/{name}"]).agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
        if not n:
            self.files.delete(f"gen/{name}")
            return None
        sizes = {}
        if self._by_field:
            flat = build.field_terms(build.resolved_fields(docs, extra=("seq",)), self.analyzer, extra=("seq",))
            flat.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id").write.parquet(f"{root}/fields")
            self._read("fields", [f"gen/{name}"]).select("doc_id", "field", "len", "seq").distinct().write.parquet(f"{root}/field_lengths")
            sizes = self._field_sizes(self._read("field_lengths", [f"gen/{name}"]))
        return {
            "segment_id": name, "level": level, "doc_count": n, "deleted_docs": 0, "total_terms": total, "deleted_terms": 0, "path": f"gen/{name}",
            "flush_seq": flush_seq, "size_bytes": self.files.size(f"gen/{name}"), "fields": sizes, "deleted_fields": {},
        }

    @staticmethod
    def _field_sizes(lengths: DataFrame) -> dict[str, list[int]]:
        """Documents with each field, and its terms in all."""
        return {r.field: [r.n, r.total] for r in lengths.groupBy("field").agg(F.count("*").alias("n"), F.sum("len").alias("total")).collect()}  # one row a field

    def _read(self, kind: str, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(TABLES[kind]).parquet(*(f"{self.path}/{p}/{kind}" if kind != "voids" else f"{self.path}/{p}" for p in paths))

    def _part(self, kind: str, segments: list[dict]) -> DataFrame | None:
        """A table of generations."""
        return self._read(kind, [s["path"] for s in segments]) if segments else None

    def _voids(self, segments: list[dict]) -> DataFrame | None:
        """(segment_id, doc_id, seq, dl): rows of the generations that newer changes made void."""
        if not self.manifest["voids"] or not sum(s["deleted_docs"] for s in segments):
            return None
        return self._read("voids", [v["path"] for v in self.manifest["voids"]]).filter(F.col("segment_id").isin([s["segment_id"] for s in segments]))

    def _superseded(self, changed: DataFrame, n: int, segments: list[dict]) -> DataFrame | None:
        """Rows (segment_id, doc_id, seq, dl) of generations that ``changed`` (doc_id, seq) makes void, and nothing did before."""
        rows = self._part("lengths", segments)
        if rows is None:
            return None
        void = self._voids(segments)
        newer = changed.select("doc_id", F.col("seq").alias("newer"))
        rows = rows.select("segment_id", "doc_id", "seq", "dl").join(F.broadcast(newer) if n <= FEW else newer, "doc_id").filter("seq < newer").drop("newer")
        return rows if void is None else rows.join(void.select("doc_id", "seq"), ["doc_id", "seq"], "left_anti").select("segment_id", "doc_id", "seq", "dl")

    def flush(self) -> int:
        """Makes a generation of what is pending and lists what it makes void; the log stays the record of changes."""
        n = self.pending()
        if n > 0:
            log = self.changelog(self.manifest["flushed"])
            last = versions.newest(log)
            segments = [dict(s) for s in self.manifest["segments"]]
            void = self._superseded(last, n, segments)
            path = f"voids/{uuid.uuid4().hex}"
            if void is not None:
                void.write.parquet(f"{self.path}/{path}")
                rows = self._read("voids", [path])
                gone = {r.segment_id: (r.n, r.total) for r in rows.groupBy("segment_id").agg(F.count("*").alias("n"), F.sum("dl").alias("total")).collect()}  # one row a generation
                for s in segments:
                    if s["segment_id"] in gone:
                        s["deleted_docs"] += gone[s["segment_id"]][0]
                        s["deleted_terms"] += gone[s["segment_id"]][1]
                        if self._by_field:
                            own = rows.filter(F.col("segment_id") == s["segment_id"]).select("doc_id", "seq")
                            for f, (k, t) in self._field_sizes(self._part("field_lengths", [s]).join(own, ["doc_id", "seq"], "left_semi")).items():
                                was = s["deleted_fields"].get(f, [0, 0])
                                s["deleted_fields"][f] = [was[0] + k, was[1] + t]
                if gone:
                    self.manifest["voids"] = [*self.manifest["voids"], {"path": path, "segments": sorted(gone)}]
                else:
                    self.files.delete(path)
            made = self._write(log.join(last.filter("op = 'index'").select("doc_id", "seq"), ["doc_id", "seq"], "left_semi"), 0, self.manifest["seq"])
            self.manifest["segments"] = segments + ([made] if made else [])
            self.manifest["flushed"], self.manifest["pending_bytes"] = self.manifest["seq"], 0
            self._save()
            if self.config.merge_after_flush:
                while self.policy.select_merge(self.manifest["segments"]) and self.compact():
                    pass
        return self.manifest["flushed"]

    def compact(self, segments: list[dict] | None = None) -> bool:
        """Merges the given generations, or those the policy picks, without what is void in them."""
        live = self.manifest["segments"]
        picked = segments if segments is not None else self.policy.select_merge(live) or self.policy.select_expunge(live)
        if not picked:
            return False
        ids = {s["segment_id"] for s in picked}
        own = [s for s in live if s["segment_id"] in ids]
        rest = [s for s in live if s["segment_id"] not in ids]
        rows, void = self._part("docs", own), self._voids(own)
        if void is not None:
            few = sum(s["deleted_docs"] for s in own) <= FEW
            keys = void.select("doc_id", "seq")
            rows = rows.join(F.broadcast(keys) if few else keys, ["doc_id", "seq"], "left_anti")
        made = self._write(rows, self.policy.next_level(max(s["level"] for s in own)), max(s["flush_seq"] for s in own))
        self.manifest["segments"] = [*rest, *([made] if made else [])]
        named = {s["segment_id"] for s in rest}
        self.manifest["voids"] = [v for v in self.manifest["voids"] if named & set(v["segments"])]
        self._save()
        return True

    def force_merge(self, max_segments: int = 1) -> int:
        """Merges the smallest first until no more than ``max_segments`` are left, and none has void documents."""
        while len(s := self.manifest["segments"]) > max(1, max_segments):
            many = min(self.config.max_merge_at_once, len(s) - max_segments + 1)
            self.compact(sorted(s, key=lambda x: x["size_bytes"])[: max(2, many)])
        if max_segments <= 1 and any(s["deleted_docs"] for s in self.manifest["segments"]):
            self.compact(self.manifest["segments"])
        return len(self.manifest["segments"])

    def _emptied(self, floor: int) -> None:
        self.manifest.update(segments=[], voids=[], floor=floor, flushed=max(self.manifest["flushed"], floor), pending_bytes=0)

    def reset(self) -> None:
        """Empties the index; numbers go on from where they were."""
        self._emptied(self.manifest["seq"])
        self._save()

    def vacuum(self, log: bool = False) -> int:
        """Deletes generations and lists that the manifest no longer names, and what a stopped writer left aside; returns the generations deleted.

        With ``log``, also the batches of the log that are flushed or before
        the last reset; replicas that have not read them must be seeded anew.
        """
        kept = {s["segment_id"] for s in self.manifest["segments"]}
        gone = [g for g in self.files.names("gen") if g not in kept]
        for g in gone:
            self.files.delete(f"gen/{g}")
        lists = {v["path"] for v in self.manifest["voids"]}
        for name in self.files.names("voids"):
            if f"voids/{name}" not in lists:
                self.files.delete(f"voids/{name}")
        for name in self.files.names("staged"):
            self.files.delete(f"staged/{name}")
        for name in self.files.names("."):
            if name.startswith(".part-"):
                self.files.delete(name)
        for _, last, name in self._batches() if log else []:
            if last <= max(self.manifest["flushed"], self.manifest["floor"]) and last < self.manifest["seq"]:
                self.files.delete(f"changelog/{name}")
        return len(gone)

    # Views

    def _usable(self) -> tuple[list[dict], bool]:
        """The generations whose files are there, and whether some are not; none at all is an error."""
        all_of = self.manifest["segments"]
        there = [s for s in all_of if all(self.files.exists(f"{s['path']}/{k}/_SUCCESS") for k in ("docs", "postings", "terms", "lengths"))]
        if all_of and not there:
            raise OSError(f"none of the {len(all_of)} generations of {self.path} can be read")
        return there, len(there) < len(all_of)

    def view(self) -> View:
        """The live view: generations, and pending changes unless they are to be seen only after a flush."""
        segments, degraded = self._usable()
        key = (self.manifest["version"], tuple(s["segment_id"] for s in segments))
        if key in self.views:
            return self.views[key]
        n, total = (sum(s[k] - s[gone] for s in segments) for k, gone in (("doc_count", "deleted_docs"), ("total_terms", "deleted_terms")))
        fields: dict[str, list[int]] = {}
        for s in segments:
            for sign, of in ((1, s["fields"]), (-1, s["deleted_fields"])):
                for f, (k, t) in of.items():
                    was = fields.setdefault(f, [0, 0])
                    was[0], was[1] = was[0] + sign * k, was[1] + sign * t
        void, few, fresh = self._voids(segments), sum(s["deleted_docs"] for s in segments), None
        pending = self.pending()
        if pending > 0 and self.config.refresh_interval_ms >= 0:
            log = self.changelog(self.manifest["flushed"])
            last = versions.newest(log).cache()
            more = self._superseded(last, pending, segments)
            fresh = log.join(F.broadcast(last.filter("op = 'index'").select("doc_id", "seq")) if pending <= FEW else last.filter("op = 'index'").select("doc_id", "seq"), ["doc_id", "seq"], "left_semi").cache()
            new = build.analyzed(fresh, self.analyzer).agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
            n, total = n + new[0], total + new[1]
            if more is not None:
                more = more.cache()
                lost = more.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
                n, total, few = n - lost[0], total - lost[1], few + lost[0]
                void = more if void is None else void.unionByName(more)
            if self._by_field:
                gone = self._field_sizes(self._part("field_lengths", segments).join(more.select("doc_id", "seq"), ["doc_id", "seq"], "left_semi")) if more is not None else {}
                made = self._field_sizes(build.field_terms(build.resolved_fields(fresh), self.analyzer).select("doc_id", "field", "len").distinct())
                for sign, of in ((1, made), (-1, gone)):
                    for f, (k, t) in of.items():
                        was = fields.setdefault(f, [0, 0])
                        was[0], was[1] = was[0] + sign * k, was[1] + sign * t
        if void is not None and few <= FEW:
            void = void.select("segment_id", "doc_id", "seq", "dl").cache()
        out = View(n, total, segments, void, few <= FEW, fresh, degraded, {f: (k, t) for f, (k, t) in fields.items() if k > 0})
        self.views[key] = out
        return out

    def _rows(self, kind: str, made) -> DataFrame | None:
        """Live rows of a table: those of generations that are not void, and ``made`` of the pending documents."""
        v = self.view()
        old = self._part(kind, v.segments)
        parts = [x for x in (v.live(old) if old is not None else None, made(v.fresh) if v.fresh is not None else None) if x is not None]
        return None if not parts else parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def documents(self) -> DataFrame:
        """Live documents: doc_id, seq, text, fields, metadata."""
        columns = ["doc_id", "seq", "text", "fields", "metadata"]
        rows = self._rows("docs", lambda fresh: fresh.withColumn("shard", self.ring.column("doc_id")))
        return self.spark.createDataFrame([], versions.CHANGES).select(*columns) if rows is None else rows.select(*columns)

    def _postings(self) -> DataFrame:
        """(term, doc_id, tf, dl, shard) of live documents; of pending ones they are made."""
        columns = ["term", "doc_id", "tf", "dl", "shard"]
        rows = self._rows("postings", lambda fresh: build.postings(fresh.withColumn("shard", self.ring.column("doc_id")), self.analyzer, extra=("seq", "shard")))
        return self.spark.createDataFrame([], TABLES["postings"]).select(*columns) if rows is None else rows.select(*columns)

    def _lengths(self) -> DataFrame:
        columns = ["doc_id", "dl", "shard"]
        rows = self._rows("lengths", lambda fresh: build.analyzed(fresh, self.analyzer, extra=("seq",)).select("doc_id", "seq", "dl", self.ring.column("doc_id").alias("shard"), F.lit("").alias("segment_id")))
        return self.spark.createDataFrame([], TABLES["lengths"]).select(*columns) if rows is None else rows.select(*columns)

    def tables(self, scorer: str | None = None, terms: list[str] | None = None) -> build.Tables:
        """Postings and statistics of the live view; corpus figures come from the manifest. ``terms``: all that will be asked for."""
        v = self.view()
        figures = (v.n, "n", "bigint"), (v.total, "total_terms", "bigint"), (v.total / v.n if v.n else 0.0, "avgdl", "double")
        corpus = self.spark.range(0, 1, 1, 1).select(*(F.lit(x).cast(kind).alias(c) for x, c, kind in figures))
        if (scorer or self.config.scorer) == "bm25f":
            if not self._by_field:  # the index keeps no fields
                return build.field_build(build.resolved_fields(self.documents()), self.config.field_weights, self.analyzer)
            flat = self._rows("fields", lambda fresh: build.field_terms(build.resolved_fields(fresh, extra=("seq",)), self.analyzer, extra=("seq",)))
            means = {f: t / n for f, (n, t) in v.fields.items()}
            flat = self.spark.createDataFrame([], TABLES["fields"]) if flat is None else flat
            post = build.pseudo_postings(flat.drop("seq"), self.config.field_weights, means)
            return build.Tables(post, build.term_stats(post), corpus, self._lengths())
        if terms is not None and self.warmed and self.warmed[0] == self.manifest["version"] and set(terms) <= self.warmed[1]:
            post = self.warmed[2]
        else:
            post = self._postings()
        return build.Tables(post, self._terms(post), corpus, self._lengths())

    def _terms(self, post: DataFrame) -> DataFrame:
        """(term, df) of the live view: as stored with the generations where nothing is void or pending, else counted."""
        v = self.view()
        if v.voids is not None or v.fresh is not None or not v.segments:
            return build.term_stats(post)
        stored = self._part("terms", v.segments)
        return stored if len(v.segments) == 1 else stored.groupBy("term").agg(F.sum("df").alias("df"))

    def shard_column(self, column: str = "doc_id"):
        return self.ring.column(column)

    # Search

    def parse(self, q: str) -> ParsedQuery:
        return parse(preprocess(q), self.analyzer, self.synonyms)

    def search(self, q: str, top_k: int | None = None, retriever: str | None = None, snippet: bool = True, per_shard: bool = False) -> Hits:
        """Hits as dicts: doc_id, score, rank, metadata and, unless turned off, snippet.

        ``degraded`` of the result tells that generations could not be read and
        the others answered.
        """
        k = top_k if isinstance(top_k, int) and top_k > 0 else self.config.default_top_k
        query = self.parse(q)
        key = (self.manifest["version"], query.key(), tuple(query.terms), k, retriever, snippet, per_shard)
        if key in self.results:
            self.results.move_to_end(key)
            return self.results[key]
        out = Hits()
        view = self.view()
        out.degraded = view.degraded
        if query.terms:
            ranked, idf = self.ranked(query, k, retriever, per_shard)
            hits = ranked.collect()  # k rows
            found = {r.doc_id: r for r in self._texts([r.doc_id for r in hits], snippet).collect()}  # the same
            for r in sorted(hits, key=lambda r: r["rank"]):
                d = found[r.doc_id]
                out.append({"doc_id": r.doc_id, "score": r.score, "rank": r["rank"], "metadata": d.metadata} | ({"snippet": cut_snippet(d.text, query.terms, idf)} if snippet else {}))
        if not out.degraded:
            self.results[key] = out
            while len(self.results) > self.config.query_cache_size:
                self.results.popitem(last=False)
        return out

    def _texts(self, ids: list[str], text: bool) -> DataFrame:
        """(doc_id, metadata[, text]) of the given live documents: readers prune by their ids."""
        docs = self.documents().select("doc_id", "metadata", *(["text"] if text else []))
        if len(ids) <= LISTED:
            return docs.filter(F.col("doc_id").isin(ids))
        wanted = self.spark.createDataFrame([(i,) for i in ids], "doc_id string")
        return docs.join(F.broadcast(wanted) if len(ids) <= FEW else wanted, "doc_id", "left_semi")

    def ranked(self, query: ParsedQuery, k: int, retriever: str | None = None, per_shard: bool = False, digits: int | None = None) -> tuple[DataFrame, dict[str, float]]:
        """(doc_id, score, rank) of the k best, and the weights of the query's terms in snippets."""
        name = retriever or self.config.scorer
        scorer = scorer_for(name, self.config.bm25_k1, self.config.bm25_b)
        asked = list(dict.fromkeys([*query.terms, *query.excluded, *(t for p in query.phrases for t in p)]))
        tables = self.tables(name, asked)
        v, kind = self.view(), "bm25f" if name == "bm25f" else ""
        if new := [t for t in query.terms if (kind, t) not in v.known]:
            if len(v.known) + len(new) > KNOWN:
                v.known.clear()
                new = query.terms
            v.known |= {(kind, t): 0 for t in new}
            v.known |= {(kind, r.term): r.df for r in tables.terms.filter(F.col("term").isin(new)).collect()}  # the query's terms
        df = {t: v.known[kind, t] for t in query.terms if v.known[kind, t]}
        idf = {t: math.log(v.n / d) for t, d in df.items()}
        toks = build.analyzed(self.documents(), self.analyzer).select("doc_id", "toks") if query.phrases else None
        if per_shard:
            return self._sharded(tables, query, k, scorer, toks, digits), idf
        hits = plan.known_scores(tables.postings, query.weights, df, v.n, v.total / max(1, v.n), scorer)
        return plan.search(tables, query, k, scorer, toks, self.config.phrase_boost, digits, hits, self.ties), idf

    def _sharded(self, tables: build.Tables, query: ParsedQuery, k: int, scorer, toks: DataFrame | None, digits: int | None = None) -> DataFrame:
        """Each shard ranks with its own statistics; the lists are fused by score or by reciprocal rank."""
        if "shard" not in tables.postings.columns:
            tables = build.Tables(tables.postings.withColumn("shard", self.ring.column("doc_id")), tables.terms, tables.corpus, tables.lengths)
        lists, sizes = plan.per_shard(tables, query, k * self.config.num_shards, scorer, toks, self.config.phrase_boost, digits, self.ties)
        if self.config.global_fusion == "rrf":
            return fusion.reciprocal_rank(lists.join(F.broadcast(fusion.weights_of(sizes)), "shard"), k, digits=digits, ties=self.ties)  # a row a shard
        return fusion.by_score(lists, k, digits, self.ties)

    def search_batch(self, queries: DataFrame, k: int = 10, retriever: str | None = None, digits: int | None = None) -> DataFrame:
        """(qid, doc_id, score, rank) of (qid, text): all queries in one job, as disjunctions of their terms."""
        terms = queries.select("qid", F.explode(self.analyzer.column(preprocess_column("text"))).alias("term"))
        terms = self.analyzer.stemmed(terms).groupBy("qid", "term").agg(F.count("*").alias("qtf"))
        return plan.search_batch(self.tables(retriever), terms, k, scorer_for(retriever or self.config.scorer, self.config.bm25_k1, self.config.bm25_b), digits, self.ties)

    def warm(self, top_terms: int | None = None) -> int:
        """Caches the postings of the most frequent terms; searches for such terms alone read them, until the index changes."""
        post = self._postings()
        n = top_terms or self.config.warmup_top_terms
        common = [r.term for r in self._terms(post).orderBy(F.desc("df"), "term").limit(n).collect()]  # n terms
        if self.warmed:
            self.warmed[2].unpersist()
        self.warmed = (self.manifest["version"], frozenset(common), post.filter(F.col("term").isin(common)).cache())
        return self.warmed[2].count()

    # Status

    def segment_rows(self) -> list[dict]:
        """Generations with the number of their documents that newer changes made void."""
        return self.manifest["segments"]

    def segments(self) -> DataFrame:
        rows = [(0, s["segment_id"], s["level"], s["doc_count"], s["deleted_docs"], s["size_bytes"], s["path"], s["flush_seq"]) for s in self.segment_rows()]
        return self.spark.createDataFrame(rows, "shard_id int, segment_id string, level int, doc_count bigint, deleted_docs bigint, size_bytes bigint, path string, flush_seq bigint")

    def shards(self) -> DataFrame:
        """One row for each shard: documents, and the index's generations, pending changes and merge debt."""
        n = len(self.manifest["segments"])
        known = self.spark.range(self.config.num_shards).select(F.col("id").cast("int").alias("shard"))
        own = self._lengths().groupBy("shard").agg(F.count("*").alias("docs"))
        debt = max(0, n - self.config.segments_per_tier)
        return known.join(own, "shard", "left").select("shard", F.lit("active").alias("state"), F.coalesce("docs", F.lit(0)).alias("docs"), F.lit(n).alias("segments"), F.lit(self.pending()).cast("bigint").alias("buffer_docs"), F.lit(self.manifest["seq"]).cast("bigint").alias("wal_seq"), F.lit(debt).alias("merge_debt"))

    def health(self) -> dict:
        there, lost = self._usable()
        warm = self.warmed is not None and self.warmed[0] == self.manifest["version"]
        return {"status": "degraded" if lost else "ok", "shards": self.config.num_shards, "ready": True, "warm": warm, "seq": self.manifest["seq"], "segments": len(there), "at": time.time()}
