"""Ranked retrieval: query terms joined to postings, summed by document, filtered, cut to k.

Filters are applied before the cut, so the top k are exact. One query pushes
its terms into the scan as an IN list; a batch is one job with the queries'
terms as a table.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparquill.functions.analysis import Analyzer, stem_column
from sparquill.functions.scoring import BM25, Scorer
from sparquill.operators.build import Tables, corpus_stats, term_stats
from sparquill.plans.query_parser import ParsedQuery
from sparquill.sources.readers import written

PHRASE_BOOST = 0.25
#: Query terms of a batch that are broadcast at most; more are joined by a shuffle.
BROADCAST_TERMS = 200_000
DEFAULT_K = 10
Ties = tuple[Column | str, ...]
#: What equal scores are ordered by.
BY_ID: Ties = ("doc_id",)
DIGITS = 6


def weights_frame(spark: SparkSession, weights: dict[str, int]) -> DataFrame:
    return spark.createDataFrame(list(weights.items()), "term string, qtf int")


def _empty(tables: Tables) -> DataFrame:
    return tables.lengths.select("doc_id", F.lit(0.0).alias("score"), F.lit(1).alias("rank")).limit(0)


def impact(scorer: Scorer) -> Column:
    """The contribution of a posting, of columns tf, dl, avgdl, n, df."""
    d = {c: F.col(c).cast("double") for c in ("tf", "dl", "avgdl", "n", "df")}
    return scorer.impact(d["tf"], d["dl"], d["avgdl"], scorer.idf(d["n"], d["df"]))


def scored(tables: Tables, weights: dict[str, int], scorer: Scorer | None = None, known_df: DataFrame | None = None) -> DataFrame:
    """(doc_id, score) of all documents with any of the terms.

    df is counted over the postings that the IN list lets through, so the
    postings are scanned once and no dictionary is built.
    """
    spark = tables.postings.sparkSession
    wanted = weights_frame(spark, weights)
    post = tables.postings.filter(F.col("term").isin(list(weights))).join(F.broadcast(wanted), "term")
    df = known_df if known_df is not None else tables.terms.filter(F.col("term").isin(list(weights)))
    post = post.join(F.broadcast(df), "term")  # no more rows than the query has terms
    post = post.crossJoin(F.broadcast(tables.corpus))  # one row
    return post.groupBy("doc_id").agg(F.sum(F.col("qtf") * impact(scorer or BM25())).alias("score"))


def known_scores(postings: DataFrame, weights: dict[str, int], df: dict[str, int], n: int, avgdl: float, scorer: Scorer | None = None) -> DataFrame:
    """(doc_id, score) where the statistics are known: they are literals, so postings meet no other table."""
    scorer = scorer or BM25()
    own = [t for t in weights if t in df]
    number, weight = F.lit(None).cast("double"), F.lit(None).cast("double")
    if own:
        number, weight = (F.element_at(F.create_map(*(x for t in own for x in (F.lit(t), F.lit(float(of[t]))))), F.col("term")) for of in (df, weights))
    part = scorer.impact(F.col("tf").cast("double"), F.col("dl").cast("double"), F.lit(float(avgdl)), scorer.idf(F.lit(float(n)), number))
    return postings.filter(F.col("term").isin(own)).groupBy("doc_id").agg(F.sum(weight * part).alias("score"))


def having_all(tables: Tables, terms: Iterable[str]) -> DataFrame:
    """(doc_id) of the documents with every term."""
    terms = list(dict.fromkeys(terms))
    post = tables.postings.filter(F.col("term").isin(terms)).select("doc_id", "term")
    return post.groupBy("doc_id").agg(F.count("*").alias("n")).filter(F.col("n") == len(terms)).select("doc_id")


def having_any(tables: Tables, terms: Iterable[str]) -> DataFrame:
    return tables.postings.filter(F.col("term").isin(list(terms))).select("doc_id").distinct()


def holds_phrase(toks: Column, phrase: list[str]) -> Column:
    """Whether the terms stand in this order without a gap: terms hold no blanks, so one substring search tells."""
    return F.concat(F.lit(" "), F.array_join(toks, " "), F.lit(" ")).contains(f" {' '.join(phrase)} ")


def boosted(hits: DataFrame, tables: Tables, toks: DataFrame, phrases: list[list[str]], boost: float = PHRASE_BOOST) -> DataFrame:
    """Scores times 1 + boost for each phrase; only documents with all its terms are looked at."""
    boost = PHRASE_BOOST if boost == 0 else max(boost, 0.0)
    for phrase in phrases if boost else []:
        near = toks.join(having_all(tables, phrase), "doc_id", "left_semi").filter(holds_phrase(F.col("toks"), phrase)).select("doc_id", F.lit(1.0 + boost).alias("__x"))
        hits = hits.join(near, "doc_id", "left").withColumn("score", F.col("score") * F.coalesce("__x", F.lit(1.0))).drop("__x")
    return hits


def top(hits: DataFrame, k: int, digits: int | None = None, ties: Ties = BY_ID) -> DataFrame:
    """(doc_id, score, rank) of the k best; ties by doc_id, or as told."""
    score = F.round("score", digits) if digits is not None else F.col("score")
    best = hits.select("doc_id", score.alias("score")).orderBy(F.desc("score"), *ties).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), *ties)))  # k rows


def search(tables: Tables, query: ParsedQuery, k: int = DEFAULT_K, scorer: Scorer | None = None, toks: DataFrame | None = None, boost: float = PHRASE_BOOST, digits: int | None = None, hits: DataFrame | None = None, ties: Ties = BY_ID) -> DataFrame:
    """(doc_id, score, rank). ``toks`` (doc_id, toks) is needed for phrases only. A query of exclusions finds nothing.

    ``hits``: (doc_id, score) of the query's disjunction, if it is known.
    """
    if not query.terms:
        return _empty(tables)
    hits = scored(tables, query.weights, scorer) if hits is None else hits
    if query.must:
        hits = hits.join(having_all(tables, query.must), "doc_id", "left_semi")
    if query.excluded:
        hits = hits.join(having_any(tables, query.excluded), "doc_id", "left_anti")
    if query.phrases and toks is not None:
        hits = boosted(hits, tables, toks, query.phrases, boost)
    return top(hits, k, digits, ties)


#: Forms of a stem that are counted one by one; more are looked up in a set.
FORMS = 20


def _occurrences(spaced: Column, words: Column, forms: list[str]) -> Column:
    """How many terms of a row are one of ``forms``; in ``spaced`` each term stands between two blanks of its own."""
    if len(forms) > FORMS:
        return F.size(F.filter(F.split(words, " "), lambda t: t.isin(forms)))
    gone = [(F.octet_length(spaced) - F.octet_length(F.replace(spaced, F.lit(f" {t} "), F.lit("")))) / F.lit(len(t.encode()) + 2) for t in forms]
    return sum(gone[1:], gone[0]).cast("int") if gone else F.lit(0)


def _counted(docs: DataFrame, query: ParsedQuery, analyzer: Analyzer, *extra: Column) -> tuple[DataFrame, dict[str, str]]:
    """A row for each document with dl, the extra columns, a count for each term of the query and a mark for each phrase; the counts' names.

    The texts are read once: the narrow rows are written, and read for the
    statistics and for the scores.
    """
    asked = list(dict.fromkeys([*query.terms, *query.excluded]))
    tf = {t: f"__t{i}" for i, t in enumerate(asked)}
    forms = {t: [t] for t in asked}
    if analyzer.stemming:
        if query.phrases:
            raise ValueError("phrases of stems need postings")
        forms = stem_forms(docs, analyzer, asked)
    w, x = F.col("__w"), F.col("__x")
    rows = docs.select("doc_id", *extra, analyzer.joined("text").alias("__w"))
    names = [c for c in rows.columns if c != "__w"]
    rows = rows.withColumn("__x", F.concat(F.lit(" "), F.replace(w, F.lit(" "), F.lit("  ")), F.lit(" ")))
    dl = F.when(w == "", 0).otherwise(F.length(w) - F.length(F.replace(w, F.lit(" "), F.lit(""))) + 1)
    held = [F.concat(F.lit(" "), w, F.lit(" ")).contains(f" {' '.join(p)} ").cast("int").alias(f"__p{i}") for i, p in enumerate(query.phrases)]
    return written(rows.select(*names, dl.alias("dl"), *(_occurrences(x, w, forms[t]).alias(c) for t, c in tf.items()), *held)), tf


def stem_forms(docs: DataFrame, analyzer: Analyzer, stems: list[str]) -> dict[str, list[str]]:
    """The terms of the texts that have one of the stems: a stem begins as its term does, so only such terms are stemmed."""
    first = sorted({s[:1] for s in stems})
    words = docs.select(F.explode(F.split(analyzer.joined("text"), " ")).alias("term"))
    words = words.filter(F.substring("term", 1, 1).isin(first)).distinct()
    out: dict[str, list[str]] = {s: [] for s in stems}
    for r in words.withColumn("stem", stem_column("term")).filter(F.col("stem").isin(stems)).collect():  # forms of the query's terms
        out[r.stem].append(r.term)
    return out


def scan_tables(docs: DataFrame, terms: list[str], analyzer: Analyzer | None = None) -> Tables:
    """``Tables`` of the given terms, from one scan of the texts: what reads them reads narrow rows."""
    rows, tf = _counted(docs, ParsedQuery(should=list(terms)), analyzer or Analyzer())
    pairs = F.array(*(F.struct(F.lit(t).alias("term"), F.col(c).alias("tf")) for t, c in tf.items()))
    post = rows.select("doc_id", "dl", F.explode(F.filter(pairs, lambda p: p["tf"] > 0)).alias("p")).select("p.term", "doc_id", "p.tf", "dl")
    lengths = rows.select("doc_id", "dl")
    return Tables(post, term_stats(post), corpus_stats(lengths), lengths)


def _statistics(tf: dict[str, str]) -> list[Column]:
    return [F.count("*").alias("__n"), F.avg("dl").alias("__avgdl"), *(F.sum((F.col(c) > 0).cast("long")).alias(f"__df{c}") for c in tf.values())]


def _row_score(query: ParsedQuery, tf: dict[str, str], scorer: Scorer, boost: float) -> Column:
    """The score of a counted row beside its statistics; negative where the query's conditions do not hold.

    The test is part of the score, so that it is not evaluated on texts a
    second time below the join with the statistics.
    """
    score = F.lit(0.0)
    n, avgdl, dl = (F.col(c).cast("double") for c in ("__n", "__avgdl", "dl"))
    for t, weight in query.weights.items():
        part = scorer.impact(F.col(tf[t]).cast("double"), dl, avgdl, scorer.idf(n, F.col(f"__df{tf[t]}").cast("double")))
        score = score + F.when(F.col(tf[t]) > 0, F.lit(float(weight)) * part).otherwise(F.lit(0.0))
    boost = PHRASE_BOOST if boost == 0 else max(boost, 0.0)
    for i in range(len(query.phrases)):
        score = score * F.when(F.col(f"__p{i}") > 0, F.lit(1.0 + boost)).otherwise(F.lit(1.0))
    ok = F.lit(False)
    for t in query.terms:
        ok |= F.col(tf[t]) > 0
    for t in query.must:
        ok &= F.col(tf[t]) > 0
    for t in query.excluded:
        ok &= F.col(tf[t]) == 0
    return F.when(ok, score).otherwise(F.lit(-1.0))


def scan_search(docs: DataFrame, query: ParsedQuery, k: int = DEFAULT_K, scorer: Scorer | None = None, analyzer: Analyzer | None = None, boost: float = PHRASE_BOOST, digits: int | None = None) -> DataFrame:
    """The same from texts without an index: one scan of them, and no shuffle of postings.

    A document is a row with a count for each term of the query, so conditions
    and phrases are tests of a row. With stemming, one more scan finds the
    terms that have the query's stems, and there are no phrases.
    """
    rows, tf = _counted(docs, query, analyzer or Analyzer())
    if not query.terms:
        return rows.select("doc_id", F.lit(0.0).alias("score"), F.lit(1).alias("rank")).limit(0)
    both = rows.crossJoin(F.broadcast(rows.agg(*_statistics(tf))))  # one row
    return top(both.select("doc_id", _row_score(query, tf, scorer or BM25(), boost).alias("score")).filter("score >= 0"), k, digits)


def scan_per_shard(docs: DataFrame, shard: Column, query: ParsedQuery, k: int, scorer: Scorer | None = None, analyzer: Analyzer | None = None, boost: float = PHRASE_BOOST, digits: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``per_shard`` from texts without an index; ``shard`` is a column of doc_id. Narrow rows of hits alone are shuffled."""
    rows, tf = _counted(docs, query, analyzer or Analyzer(), shard.alias("shard"))
    stats = rows.groupBy("shard").agg(*_statistics(tf))
    stats = docs.sparkSession.createDataFrame(stats.collect(), stats.schema)  # a row a shard, wanted three times
    both = rows.join(F.broadcast(stats), "shard")  # a row a shard
    score = _row_score(query, tf, scorer or BM25(), boost)
    hits = both.select("shard", "doc_id", (score if digits is None else F.round(score, digits)).alias("score")).filter("score >= 0")
    order = Window.partitionBy("shard").orderBy(F.desc("score"), "doc_id")
    lists = hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return lists, stats.select("shard", F.col("__n").alias("n"), F.col("__avgdl").alias("avgdl"))


def search_batch(tables: Tables, queries: DataFrame, k: int = DEFAULT_K, scorer: Scorer | None = None, digits: int | None = None, ties: Ties = BY_ID) -> DataFrame:
    """(qid, doc_id, score, rank) for many disjunctive queries (qid, term, qtf) in one job."""
    few = queries.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    small = F.broadcast if few else (lambda d: d)
    words = queries.select("term").distinct()
    df = tables.terms.join(small(words), "term", "left_semi")
    weighted = queries.join(df, "term")
    post = tables.postings.join(small(weighted), "term").crossJoin(F.broadcast(tables.corpus))  # one row
    hits = post.groupBy("qid", "doc_id").agg(F.sum(F.col("qtf") * impact(scorer or BM25())).alias("score"))
    if digits is not None:
        hits = hits.withColumn("score", F.round("score", digits))
    order = Window.partitionBy("qid").orderBy(F.desc("score"), *ties)
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def per_shard(tables: Tables, query: ParsedQuery, k: int, scorer: Scorer | None = None, toks: DataFrame | None = None, boost: float = PHRASE_BOOST, digits: int | None = None, ties: Ties = BY_ID) -> tuple[DataFrame, DataFrame]:
    """(shard, doc_id, score, rank) of each shard's k best by its own statistics, and (shard, n, avgdl).

    Postings and lengths have a column ``shard``.
    """
    sizes = tables.lengths.groupBy("shard").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    post = tables.postings.filter(F.col("term").isin(query.terms))
    df = post.groupBy("shard", "term").agg(F.count("*").alias("df"))
    wanted = weights_frame(tables.postings.sparkSession, query.weights)
    hits = post.join(F.broadcast(wanted), "term").join(F.broadcast(df), ["shard", "term"]).join(F.broadcast(sizes), "shard")  # shards times terms
    hits = hits.groupBy("shard", "doc_id").agg(F.sum(F.col("qtf") * impact(scorer or BM25())).alias("score"))
    if query.must:
        hits = hits.join(having_all(tables, query.must), "doc_id", "left_semi")
    if query.excluded:
        hits = hits.join(having_any(tables, query.excluded), "doc_id", "left_anti")
    if query.phrases and toks is not None:
        hits = boosted(hits, tables, toks, query.phrases, boost)
    if digits is not None:
        hits = hits.withColumn("score", F.round("score", digits))
    order = Window.partitionBy("shard").orderBy(F.desc("score"), *ties)
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k), sizes


def explain(tables: Tables, query: ParsedQuery, doc_id, scorer: Scorer | None = None) -> DataFrame:
    """(term, tf, dl, df, qtf, score): what each term gives one document."""
    wanted = weights_frame(tables.postings.sparkSession, query.weights)
    post = tables.postings.filter(F.col("term").isin(query.terms) & (F.col("doc_id") == doc_id))
    post = post.join(F.broadcast(wanted), "term").join(tables.terms, "term").crossJoin(F.broadcast(tables.corpus))
    return post.select("term", "tf", "dl", "df", "qtf", (F.col("qtf") * impact(scorer or BM25())).alias("score"))


def two_phase(tables: Tables, weights: dict[str, int], k: int, scorer: Scorer | None = None, digits: int | None = None) -> DataFrame:
    """The same top k with long posting lists read only for documents that can still enter.

    Bounds of the active scorer's impacts split terms: those whose bounds sum
    to less than the k-th score of the others cannot bring in a document of
    their own (up to a relative margin for rounding).
    """
    scorer = scorer or BM25()
    post = tables.postings.filter(F.col("term").isin(list(weights))).join(F.broadcast(tables.terms.filter(F.col("term").isin(list(weights)))), "term").crossJoin(F.broadcast(tables.corpus))
    bounds = {r.term: r.ub * weights[r.term] for r in post.groupBy("term").agg(F.max(impact(scorer)).alias("ub")).collect()}  # query terms only
    order = sorted(bounds, key=bounds.get, reverse=True)
    for cut in range(1, len(order)):
        head = {t: weights[t] for t in order[:cut]}
        floor = scored(tables, head, scorer).orderBy(F.desc("score")).limit(k).collect()  # k rows
        rest = sum(bounds[t] for t in order[cut:])
        if len(floor) == k and rest * (1 + 1e-6) < floor[-1].score:
            enter = having_any(tables, head)
            kept = Tables(tables.postings.join(enter, "doc_id", "left_semi"), tables.terms, tables.corpus, tables.lengths)
            return top(scored(kept, weights, scorer), k, digits)
    return top(scored(tables, weights, scorer), k, digits)
