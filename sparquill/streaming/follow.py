"""A replica that follows a change log: in order, without gaps, each change once."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sparquill.operators.lifecycle import Index
from sparquill.operators.versions import CHANGES

ATTEMPTS = 5


class Gap(ValueError):
    """A sequence number is missing: the replica must be seeded anew."""


def fresh(changes: DataFrame, applied: int) -> DataFrame:
    """Changes past ``applied``, one for each number, heartbeats left out."""
    new = changes.filter((F.col("seq") > applied) & F.col("op").isin("index", "delete", "reset"))
    return new.dropDuplicates(["seq"])


def missing(changes: DataFrame, applied: int) -> int | None:
    """The first number that is not there, if the numbers after ``applied`` are not consecutive."""
    n, low, high = changes.agg(F.count("*"), F.min("seq"), F.max("seq")).first()
    if not n or (low == applied + 1 and high - low + 1 == n):
        return None
    if low != applied + 1:
        return applied + 1
    before = changes.select((F.col("seq") - 1).alias("seq"))
    ends = changes.select("seq").join(before, "seq", "left_anti").filter(F.col("seq") < high)
    return ends.agg(F.min("seq")).first()[0] + 1


class Follower:
    """Applies micro-batches to an index. A change that fails ATTEMPTS times is set aside."""

    def __init__(self, index: Index, dead_letters: str | None = None, check: Callable[[DataFrame], DataFrame] | None = None):
        self.index, self.dead_letters = index, dead_letters
        #: Gives the rows of a batch that can't be applied; by default those without an id, or texts of index changes.
        self.bad = check or (lambda d: d.filter("op <> 'reset' and (doc_id is null or doc_id = '' or (op = 'index' and coalesce(text, '') = ''))"))
        self.set_aside = 0

    @property
    def applied(self) -> int:
        return self.index.manifest["seq"]

    def _attempts(self) -> dict[str, int]:
        """Failed attempts by change; kept beside the index, so that they add up over restarts."""
        names = [n for n in self.index.files.names("attempts") if n.endswith(".json")]
        return json.loads(self.index.files.read(f"attempts/{names[-1]}")) if names else {}

    def _tried(self, seq: int) -> int:
        """Counts one more attempt at a change and returns how many there were; those before it are done with."""
        old = self.index.files.names("attempts")
        n = self._attempts().get(str(seq), 0) + 1
        self.index.files.create(f"attempts/{seq:019d}-{n:06d}.json", json.dumps({str(seq): n}))
        for name in old:
            self.index.files.delete(f"attempts/{name}")
        return n

    def batch(self, changes: DataFrame, _: int = 0) -> int:
        """Applies one batch; safe to repeat, as what is applied already is skipped."""
        new = fresh(changes, self.applied).cache()
        try:
            hole = missing(new, self.applied)
            if hole is not None:
                raise Gap(f"change {hole} is missing after {self.applied}")
            bad = self.bad(new)
            first = bad.agg(F.min("seq")).first()[0]
            if first is not None:
                tried = self._tried(first)
                if tried < ATTEMPTS:
                    self.index.apply(new.filter(F.col("seq") < first))
                    raise ValueError(f"change {first} cannot be applied, attempt {tried}")
                self.set_aside += bad.count()
                if self.dead_letters:
                    bad.write.mode("append").json(self.dead_letters)
                good = new.join(bad.select("seq"), "seq", "left_anti")
                high = new.agg(F.max("seq")).first()[0]
                self.index.apply(good)
                self.index.skip_to(high)
            else:
                self.index.apply(new)
        finally:
            new.unpersist()
        return self.applied

    def start(self, path: str, checkpoint: str, once: bool = True, interval: str = "10 seconds", files: int = 100) -> StreamingQuery:
        """Follows the batches of a change log; ``once`` stops when there are no more."""
        stream = self.index.spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", files).option("recursiveFileLookup", True).parquet(path)
        out = stream.writeStream.foreachBatch(self.batch).option("checkpointLocation", checkpoint)
        return (out.trigger(availableNow=True) if once else out.trigger(processingTime=interval)).start()
