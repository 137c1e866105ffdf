"""Files to documents: (id, text, metadata).

The id is a column of the file; where it is missing, Parquet and CSV rows get
their place among the rows with text (from 0). The text is the non-empty text columns, joined by
a space; rows without text are skipped. Rows that do not parse are skipped.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SUFFIX = {".parquet": "parquet", ".jsonl": "jsonl", ".ndjson": "jsonl", ".json": "json", ".csv": "csv"}
_PLAIN = (T.StringType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.BooleanType)
SCHEMA = "id string, text string, metadata map<string,string>"


@dataclass(frozen=True)
class Mapping:
    id_field: str = "id"
    text_fields: Sequence[str] = ("text",)
    meta_fields: Sequence[str] = ()


def detect_format(path: str, explicit: str | None = None) -> str:
    """By suffix; JSON lines where it says nothing; an explicit format wins."""
    if explicit:
        return explicit
    return next((f for s, f in _SUFFIX.items() if path.lower().endswith(s)), "jsonl")


#: Bytes from which a table in few splits is dealt over all cores.
SPREAD_BYTES = 4_000_000


def spread(table: DataFrame) -> DataFrame:
    """A scanned table over at least as many partitions as the session has cores, if it is worth a shuffle.

    A file of one row group is one split, which leaves all cores but one idle
    in what follows; tables in many splits stay as they are.
    """
    session = table.sparkSession
    n = session.sparkContext.defaultParallelism
    plan = table._jdf.queryExecution()
    if plan.optimizedPlan().stats().sizeInBytes() < SPREAD_BYTES or plan.toRdd().getNumPartitions() >= n:
        return table
    return table.repartition(n)


def _plain(df: DataFrame, name: str) -> Column:
    """A scalar column as a string; other types are empty."""
    return F.col(f"`{name}`").cast("string") if isinstance(df.schema[name].dataType, _PLAIN) else F.lit("")


def _numbered(rows: DataFrame, by: str) -> DataFrame:
    """Rows with a null id get their place by ``by``; the others keep theirs.

    Counts of partitions, one number each, come to the driver; rows stay where
    they are.
    """
    if rows.filter("id is null").isEmpty():
        return rows.drop(by)
    placed = rows.withColumn("__part", F.shiftright(F.col(by), 33).cast("int"))
    sizes = sorted((r[0], r[1]) for r in placed.groupBy("__part").agg(F.count("*")).collect())
    start, n = [], 0
    for part, size in sizes:
        start += [F.lit(part), F.lit(n).cast("long")]
        n += size
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("__part").orderBy(by)) - 1 + F.element_at(F.create_map(*start), F.col("__part"))
    return placed.withColumn("id", F.coalesce("id", place.cast("string"))).drop(by, "__part")


def _mapped(df: DataFrame, m: Mapping, number: bool, trim: bool) -> DataFrame:
    have = set(df.columns)
    texts = [_plain(df, c) for c in m.text_fields if c in have]
    if m.id_field not in have and not texts:
        raise ValueError(f"neither {m.id_field} nor any of {list(m.text_fields)} is among {df.columns}")
    if trim:
        texts = [F.trim(t) for t in texts]
    text = F.concat_ws(" ", *(F.nullif(t, F.lit("")) for t in texts)) if texts else F.lit("")
    own = F.nullif(_plain(df, m.id_field), F.lit("")) if m.id_field in have else F.lit(None).cast("string")
    meta = [c for c in m.meta_fields if c in have]
    pairs = F.create_map(*(x for c in meta for x in (F.lit(c), _plain(df, c)))) if meta else F.create_map().cast("map<string,string>")
    rows = df.select(own.alias("id"), text.alias("text"), F.map_filter(pairs, lambda k, v: v.isNotNull()).alias("metadata")).filter("text <> ''")
    if number:
        return _numbered(rows.withColumn("__at", F.monotonically_increasing_id()), "__at")
    return rows.filter("id is not null")


def read_parquet(spark: SparkSession, paths: Sequence[str], m: Mapping) -> DataFrame:
    return _mapped(spark.read.parquet(*paths), m, number=True, trim=False)


def _fields(m: Mapping) -> T.StructType:
    names = dict.fromkeys([m.id_field, *m.text_fields, *m.meta_fields])
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def read_jsonl(spark: SparkSession, paths: Sequence[str], m: Mapping) -> DataFrame:
    """One object a line; the id is required."""
    lines = spark.read.text(list(paths)).filter("trim(value) <> ''")
    return _mapped(lines.select(F.from_json("value", _fields(m)).alias("r")).select("r.*"), m, number=False, trim=True)


def read_json(spark: SparkSession, paths: Sequence[str], m: Mapping) -> DataFrame:
    """A file is an array of objects, or one object."""
    return _mapped(spark.read.schema(_fields(m)).option("multiLine", True).json(list(paths)), m, number=False, trim=True)


def read_csv(spark: SparkSession, paths: Sequence[str], m: Mapping) -> DataFrame:
    raw = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).option("escape", '"').option("multiLine", True).option("mode", "DROPMALFORMED").csv(list(paths))
    return _mapped(raw, m, number=True, trim=True)


READERS = {"parquet": read_parquet, "jsonl": read_jsonl, "json": read_json, "csv": read_csv}


def read_source(spark: SparkSession, uri: str | Sequence[str], mapping: Mapping | None = None, fmt: str | None = None, limit: int | None = None, seed: int = 0) -> DataFrame:
    """``gen://N``, or the path or paths (globs too) of files of one format."""
    if isinstance(uri, str) and uri.startswith("gen://"):
        out = generate(spark, uri, seed)
    else:
        paths = [uri] if isinstance(uri, str) else list(uri)
        kind = detect_format(paths[0], fmt)
        if kind not in READERS:
            raise ValueError(f"unknown format {kind}")
        out = READERS[kind](spark, paths, mapping or Mapping())
    return out if limit is None else out.limit(limit)


def dataset(root: str, config: str | None = None, split: str | None = None, suffix: str = ".parquet") -> str:
    """The path pattern of a dataset's files, one folder a configuration and in it one a split; None stands for all of them."""
    return f"{root.rstrip('/')}/{config or '*'}/{split or '*'}/*{suffix}"


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset a temporary one, in local mode alone."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="sparquill-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the JVM may have gone first; the folder is scratch space
        pass


def written(df: DataFrame, *, temporary: bool = True) -> DataFrame:
    """The rows of ``df`` as a table in the shared folder: computed once, read by all.

    The table goes when the driver's Python ends, unless ``temporary`` is false.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sparquill/{uuid.uuid4().hex}"
    df.write.parquet(path)
    if temporary:
        atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


_SYLLABLES = "ba ke li mo nu pra sta tor ven wis".split()
VOCABULARY = [a + b + c for a in _SYLLABLES for b in _SYLLABLES for c in ("", "n", "s", "r")]


def generate(spark: SparkSession, uri: str, seed: int = 0, shape: float = 1.07) -> DataFrame:
    """N documents of 20 to 150 words, word ranks by a Zipf law; the same for the same seed, ids ``doc-`` and ten digits."""
    try:
        n = int(uri.removeprefix("gen://"))
    except ValueError:
        raise ValueError(f"{uri}: gen:// takes a number") from None
    weights = [(1 + r) ** -shape for r in range(len(VOCABULARY))]
    total, cum, acc = sum(weights), [], 0.0
    for w in weights:
        acc += w / total
        cum.append(acc)

    def unit(*key: Column) -> Column:
        return F.pmod(F.xxhash64(*key, F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)

    length = (F.floor(unit(F.col("id"), F.lit("n")) * 131) + 20).cast("int")
    words = spark.range(n).select("id", F.explode(F.sequence(F.lit(1), length)).alias("at"))
    steps = F.array(*(F.lit(c) for c in cum))
    u = unit(F.col("id"), F.col("at"))
    rank = F.least(F.size(F.filter(steps, lambda c: c < u)), F.lit(len(VOCABULARY) - 1))
    word = F.element_at(F.array(*(F.lit(w) for w in VOCABULARY)), rank + 1)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ")
    docs = words.withColumn("word", word).groupBy("id").agg(text.alias("text"))
    return docs.select(F.format_string("doc-%010d", "id").alias("id"), "text", F.create_map().cast("map<string,string>").alias("metadata"))


def load_corpus(spark: SparkSession, path: str) -> DataFrame:
    """A retrieval benchmark's corpus (_id, title, text) as documents."""
    return read_source(spark, path, Mapping("_id", ("title", "text")))


def load_queries_and_qrels(spark: SparkSession, queries: str, qrels: str) -> tuple[DataFrame, DataFrame]:
    """(qid, text) of the judged queries only, and (qid, doc_id, rel) of a tab-separated file with a header."""
    judged = spark.read.option("header", True).option("sep", "\t").csv(qrels)
    judged = judged.toDF("qid", "doc_id", "rel").withColumn("rel", F.col("rel").cast("int"))
    asked = read_source(spark, queries, Mapping("_id", ("text",))).select(F.col("id").alias("qid"), "text")
    return asked.join(judged.select("qid").distinct(), "qid", "left_semi"), judged
