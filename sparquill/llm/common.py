"""Shared plumbing of the training-data operators.

Nothing here holds more than one Arrow batch of texts in a Python worker, and
whatever is used by more than one job is written once to the folder that the
cluster shares, so that a lost executor costs one task and not a lineage.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from sparquill.sources.readers import _remove, shared_dir, spread, written  # noqa: F401 - written is for the operators

#: Rows of text per Arrow batch; with texts of a few KB a batch is a few MB.
TEXT_ROWS = 512
#: Narrow rows of a task, in tables that have too few for all tasks of a shuffle.
NARROW_ROWS = 20_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def release(spark: SparkSession) -> None:
    """Deletes all that ``written`` wrote for this session; results that were not saved are lost with it."""
    _remove(spark, f"{shared_dir(spark)}/sparquill")


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``written`` gave and that nothing will read again."""
    for t in tables:
        if path := getattr(t, "written_to", None):
            _remove(t.sparkSession, path)


def few_files(df: DataFrame, rows: int) -> DataFrame:
    """``df``, which has ``rows`` narrow rows at most, in no more partitions than so many rows are worth.

    Each file that a task writes to a local store starts a process or two.
    """
    return df.coalesce(max(1, min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // NARROW_ROWS))))


def text_batches(spark: SparkSession, rows: int = TEXT_ROWS) -> None:
    """Bounds the rows of an Arrow batch for plans made from here on; a session that allows fewer keeps its bound."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if now <= 0 or now > rows:
        spark.conf.set(name, str(rows))


def map_rows(df: DataFrame, schema: str, make: Callable[[], Callable]) -> DataFrame:
    """``make()`` runs once a task and gives f(*columns as lists) -> dict of lists or arrays.

    The number of rows that f returns is its own choice.
    """
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    text_batches(df.sparkSession)
    names = df.columns
    target = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for b in batches:
            got = f(*(b.column(i).to_pylist() for i in range(len(names))))
            arrays = [x if isinstance(x, pa.Array) else pa.array(x, type=fd.type) for fd, x in ((fd, got[fd.name]) for fd in target)]
            yield pa.RecordBatch.from_arrays(arrays, schema=target)

    return df.mapInArrow(run, schema)


def kind(df: DataFrame, column: str) -> str:
    """The SQL name of a column's type."""
    return df.schema[column].dataType.simpleString()
