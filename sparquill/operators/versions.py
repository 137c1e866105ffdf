"""The state that a log of changes leaves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHANGES = "seq bigint, op string, doc_id string, text string, fields map<string,string>, metadata map<string,string>, ts timestamp"


def since_reset(log: DataFrame) -> DataFrame:
    """Changes after the last reset; a reset makes all before it void."""
    last = log.filter("op = 'reset'").agg(F.coalesce(F.max("seq"), F.lit(-1)).alias("__reset"))
    return log.crossJoin(F.broadcast(last)).filter("seq > __reset and op <> 'reset'").drop("__reset")  # one row


def newest(log: DataFrame) -> DataFrame:
    """(doc_id, seq, op) of each document's last change: narrow rows with partial maxima, texts stay where they are."""
    last = log.groupBy("doc_id").agg(F.max(F.struct("seq", "op")).alias("last"))
    return last.select("doc_id", "last.seq", "last.op")


def live(log: DataFrame) -> DataFrame:
    """The changes that stand: the newest of each document, unless it is a deletion."""
    own = newest(log).filter("op = 'index'").select("doc_id", "seq")
    return log.join(own, ["doc_id", "seq"], "left_semi")


def tombstones(log: DataFrame) -> DataFrame:
    """(doc_id, seq) of documents whose last change is a deletion."""
    return newest(log).filter("op = 'delete'").select("doc_id", "seq")


def after(log: DataFrame, seq: int) -> DataFrame:
    """Changes past a sequence number, in order."""
    return log.filter(F.col("seq") > seq).orderBy("seq")
