"""Documents to postings and statistics: explode, count, aggregate."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparquill.functions.analysis import Analyzer
from sparquill.functions.porter2 import stem
from sparquill.functions.scoring import BM25, DEFAULT_FIELDS, FieldWeight, Scorer


@dataclass(frozen=True)
class Tables:
    """postings(term, doc_id, tf, dl, df), terms(term, df), corpus(n, total_terms, avgdl), all lazy."""

    postings: DataFrame
    terms: DataFrame
    corpus: DataFrame
    lengths: DataFrame

    def cached(self) -> Tables:
        return Tables(*(t.cache() for t in (self.postings, self.terms, self.corpus, self.lengths)))


def analyzed(docs: DataFrame, analyzer: Analyzer, text: str = "text", id_col: str = "doc_id", extra: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, toks, dl) and the extra columns."""
    return docs.select(F.col(id_col).alias("doc_id"), *extra, analyzer.column(text).alias("toks")).withColumn("dl", F.size("toks"))


def postings(docs: DataFrame, analyzer: Analyzer | None = None, text: str = "text", id_col: str = "doc_id", extra: tuple[str, ...] = (), only: DataFrame | list[str] | None = None) -> DataFrame:
    """(term, doc_id, tf, dl) and extra columns of the document: one row for each distinct term of a document.

    ``only``: the terms that are wanted, as a list or a table (term), each once; the others go before anything is grouped.

    Terms are exploded at once, so that grouping runs on flat rows with
    map-side partial counts; stems come from a join on distinct terms.
    """
    analyzer = analyzer or Analyzer()
    flat = analyzed(docs, analyzer, text, id_col, extra).select("doc_id", "dl", *extra, F.explode("toks").alias("term"))
    if only is not None and not analyzer.stemming:
        flat = _wanted(flat, only)
    counted = flat.groupBy("term", "doc_id", "dl", *extra).agg(F.count("*").cast("int").alias("tf"))
    if analyzer.stemming:
        counted = analyzer.stemmed(counted).groupBy("term", "doc_id", "dl", *extra).agg(F.sum("tf").cast("int").alias("tf"))
    return counted.select("term", "doc_id", "tf", "dl", *extra)


def document_terms(docs: DataFrame, analyzer: Analyzer, extra: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, extra columns, dl, terms, tfs): a row for each row, its distinct terms and how often each is there.

    A document is one row, so its terms are counted where it is: no row for
    each occurrence is made, and nothing is shuffled.
    """
    own = docs.select("doc_id", *extra)
    names, n, stemming = [*own.columns, "dl", "terms", "tfs"], len(own.columns), analyzer.stemming

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dl, ends, terms, tfs = [], [0], [], []
            for text in b.column(n).to_pylist():
                toks = text.split(" ") if text else []
                found = Counter(map(stem, toks) if stemming else toks)
                terms += found
                tfs += found.values()
                dl.append(len(toks))
                ends.append(len(terms))
            at = pa.array(ends, pa.int32())
            lists = (pa.ListArray.from_arrays(at, pa.array(x, kind)) for x, kind in ((terms, pa.string()), (tfs, pa.int32())))
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(dl, pa.int32()), *lists], names=names)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema)
    return docs.select(*own.columns, analyzer.joined("text").alias("__w")).mapInArrow(run, f"{kinds}, dl int, terms array<string>, tfs array<int>")


def exploded(counted: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """(term, doc_id, tf, dl) and the extra columns of rows of ``document_terms``."""
    pairs = F.explode(F.arrays_zip("terms", "tfs")).alias("p")
    return counted.select("doc_id", "dl", *extra, pairs).select(F.col("p.terms").alias("term"), "doc_id", F.col("p.tfs").alias("tf"), "dl", *extra)


def _wanted(flat: DataFrame, only: DataFrame | list[str]) -> DataFrame:
    return flat.filter(F.col("term").isin(only)) if isinstance(only, list) else flat.join(only, "term", "left_semi")


def term_stats(post: DataFrame, corpus: DataFrame | None = None, scorer: Scorer | None = None) -> DataFrame:
    """(term, df), and with corpus statistics the exact greatest impact of each term as ``ub``.

    An impact is its term's idf, which is not negative, times what the posting
    gives, so the greatest of the latter is found while postings are counted.
    """
    if corpus is None:
        return post.groupBy("term").agg(F.count("*").alias("df"))
    scorer = scorer or BM25()
    part = scorer.impact(F.col("tf").cast("double"), F.col("dl").cast("double"), F.col("avgdl"), F.lit(1.0))
    one = post.crossJoin(F.broadcast(corpus.select("n", "avgdl")))  # one row
    of = one.groupBy("term").agg(F.count("*").alias("df"), F.max(part).alias("__part"), F.first("n").alias("__n"))
    return of.select("term", "df", (scorer.idf(F.col("__n").cast("double"), F.col("df").cast("double")) * F.col("__part")).alias("ub"))


def corpus_stats(lengths: DataFrame) -> DataFrame:
    """One row: n, total_terms, avgdl over (doc_id, dl)."""
    return lengths.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).cast("bigint").alias("total_terms"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl"))


def build(docs: DataFrame, analyzer: Analyzer | None = None, text: str = "text", id_col: str = "doc_id", only: DataFrame | list[str] | None = None) -> Tables:
    analyzer = analyzer or Analyzer()
    post = postings(docs, analyzer, text, id_col, only=only)
    lengths = analyzed(docs, analyzer, text, id_col).select("doc_id", "dl")
    return Tables(post, term_stats(post), corpus_stats(lengths), lengths)


def field_map(docs: DataFrame, fields: dict[str, Column | str]) -> DataFrame:
    """(doc_id, fields): a map of field name to text, nulls left out."""
    pairs = F.array(*(F.struct(F.lit(k).alias("key"), (F.col(v) if isinstance(v, str) else v).alias("value")) for k, v in fields.items()))
    return docs.select("doc_id", F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull())).alias("fields"))


def resolved_fields(docs: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fields) and the extra columns: a document without fields has its text as ``body``."""
    whole = F.create_map(F.lit("body"), F.coalesce("text", F.lit("")))
    return docs.select("doc_id", *extra, F.when(F.size("fields") > 0, F.col("fields")).otherwise(whole).alias("fields"))


def field_terms(docs: DataFrame, analyzer: Analyzer | None = None, extra: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, field, len, term, tf) and extra columns of (doc_id, fields); a field without terms has a row with none."""
    analyzer = analyzer or Analyzer()
    key = ["doc_id", *extra, "field"]
    flat = docs.select("doc_id", *extra, F.explode("fields").alias("field", "body")).select(*key, analyzer.column("body").alias("toks"))
    flat = flat.select(*key, F.size("toks").alias("len"), F.explode_outer("toks").alias("term"))
    counted = flat.groupBy(*key, "len", "term").agg(F.count("term").cast("int").alias("tf"))
    if analyzer.stemming:
        counted = analyzer.stemmed(counted).groupBy(*key, "len", "term").agg(F.sum("tf").cast("int").alias("tf"))
    return counted


def pseudo_postings(flat: DataFrame, fields: tuple[FieldWeight, ...], means: dict[str, float]) -> DataFrame:
    """(term, doc_id, tf, dl) over the pseudo frequency of rows (doc_id, field, len, term, tf), with known mean lengths of fields."""
    table = flat.sparkSession.createDataFrame([(f.name, float(f.weight), float(f.b), float(means.get(f.name) or 1.0)) for f in fields], "field string, w double, b double, mean double")
    flat = flat.filter("term is not null").join(F.broadcast(table), "field")  # as many rows as configured fields
    part = F.col("w") * F.col("tf") / (F.lit(1.0) - F.col("b") + F.col("b") * F.col("len") / F.col("mean"))
    post = flat.groupBy("term", "doc_id").agg(F.sum(part).alias("p"))
    return post.select("term", "doc_id", F.greatest(F.lit(1), F.round(F.col("p") * 1000.0).cast("int")).alias("tf"), F.lit(0).alias("dl"))


def field_build(docs: DataFrame, fields: tuple[FieldWeight, ...] = DEFAULT_FIELDS, analyzer: Analyzer | None = None, only: DataFrame | list[str] | None = None) -> Tables:
    """Tables over the pseudo frequency: tf is in thousandths, a sum of weighted, length-normalised field frequencies.

    Average lengths are over the documents that have the field (1 where none
    has); a document counts in n whether or not it has a configured field.
    """
    analyzer = analyzer or Analyzer()
    table = docs.sparkSession.createDataFrame([(f.name, float(f.weight), float(f.b)) for f in fields], "field string, w double, b double")
    rows = docs.select("doc_id", F.explode("fields").alias("field", "body")).join(F.broadcast(table), "field")  # as many rows as configured fields
    rows = rows.select("doc_id", "field", "w", "b", analyzer.column("body").alias("toks")).withColumn("len", F.size("toks"))
    average = rows.groupBy("field").agg(F.avg("len").alias("mean"))
    flat = rows.select("doc_id", "field", "w", "b", "len", F.explode("toks").alias("term"))
    if only is not None and not analyzer.stemming:
        flat = _wanted(flat, only)
    key = ("doc_id", "field", "w", "b", "len", "term")
    flat = flat.groupBy(*key).agg(F.count("*").alias("tf"))
    if analyzer.stemming:
        flat = analyzer.stemmed(flat).groupBy(*key).agg(F.sum("tf").alias("tf"))
    flat = flat.join(F.broadcast(average), "field")
    mean = F.when(F.col("mean") > 0, F.col("mean")).otherwise(F.lit(1.0))
    part = F.col("w") * F.col("tf") / (F.lit(1.0) - F.col("b") + F.col("b") * F.col("len") / mean)
    post = flat.groupBy("term", "doc_id").agg(F.sum(part).alias("p"))
    post = post.select("term", "doc_id", F.greatest(F.lit(1), F.round(F.col("p") * 1000.0).cast("int")).alias("tf"), F.lit(0).alias("dl"))
    lengths = docs.select("doc_id").join(rows.groupBy("doc_id").agg(F.sum("len").alias("dl")), "doc_id", "left").select("doc_id", F.coalesce("dl", F.lit(0)).alias("dl"))
    return Tables(post, term_stats(post), corpus_stats(lengths), lengths)
