"""Persisted inverted index: build once, query many times without scanning the corpus.

Layout under ``path/<field>/``:
  ``postings``  rows ``(term, doc_id, tf, positions, dl)``; a file holds the postings of the documents
                that one task read, in (term, doc_id) order, so a term filter reads few pages of each
                and a very common term spans all files; every document also has a row under the
                empty term, which the analyzer never makes;
  ``terms``     ``(term, df)`` in term order;
  ``stats``     one row ``(n_docs, total_len)``.

A query reads the df of its own terms (a handful of rows), then their postings with the filter
pushed into the scan, and aggregates them per document: one shuffle over matching postings.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokenize
from .analysis import read_postings_for, row_postings
from .search import B, K1, CorpusStats, _tf_norm, analyze_query, bm25_idf, query_mode

FIELDS = ("content", "basics_text")


def build_index(docs: DataFrame, path: str, fields=FIELDS, partitions: int | None = None) -> None:
    """Index the text ``fields`` of ``docs`` (doc_id, fields...); one pass over the corpus each."""
    spark = docs.sparkSession
    for field in fields:
        at = f"{path.rstrip('/')}/{field}"
        p = row_postings(docs.select("doc_id", tokenize(field).alias("_t")), mark=True)
        p = p.repartition(partitions, "doc_id") if partitions else p
        p.sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{at}/postings")
        written = spark.read.parquet(f"{at}/postings")
        terms = written.filter("term <> ''").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        (terms.repartitionByRange(partitions, "term") if partitions else terms.repartitionByRange("term")).sortWithinPartitions(
            "term").write.mode("overwrite").parquet(f"{at}/terms")
        stats = written.filter("term = ''").agg(F.count_if(F.col("dl") > 0).alias("n_docs"), F.coalesce(F.sum("dl"), F.lit(0)).cast("bigint").alias("total_len"))
        stats.write.mode("overwrite").parquet(f"{at}/stats")


def stored_stats(spark: SparkSession, path: str, field: str, terms: list[str]) -> CorpusStats:
    """Corpus size, total length and the df of the query's terms."""
    at = f"{path.rstrip('/')}/{field}"
    row = spark.read.parquet(f"{at}/stats").first()
    df = {r["term"]: r["df"] for r in spark.read.parquet(f"{at}/terms").filter(F.col("term").isin(terms)).collect()}
    return CorpusStats(row["n_docs"], row["total_len"], {t: df.get(t, 0) for t in terms})


def _lookup(spark: SparkSession, path: str, field: str, query: str):
    """(tokens, distinct tokens, their postings, statistics) of a query, or None without tokens."""
    tokens = analyze_query(spark, query)
    if not tokens:
        return None
    distinct = list(dict.fromkeys(tokens))
    return tokens, distinct, read_postings_for(spark, f"{path.rstrip('/')}/{field}/postings", distinct), stored_stats(spark, path, field, distinct)


def _nothing(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "doc_id bigint, score double")


def _by_term(values: dict) -> F.Column:
    """Value of the ``term`` column among a query's few terms."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), F.col("term"))


def indexed_keyword_search(spark: SparkSession, path: str, query: str, field: str = "content", mode: str = "or",
                           k1: float = K1, b: float = B) -> DataFrame:
    """BM25 ``match`` -> ``(doc_id, score)``, the scores of ``search.keyword_search``."""
    found = _lookup(spark, path, field, query)
    if found is None:
        return _nothing(spark)
    tokens, distinct, postings, stats = found
    weight = {t: n * bm25_idf(stats.n_docs, stats.df[t]) for t, n in Counter(tokens).items()}
    part = _by_term(weight) * _tf_norm(F.col("tf").cast("double"), F.col("dl"), stats.avgdl, k1, b)
    g = postings.select("doc_id", part.alias("s")).groupBy("doc_id").agg(F.sum("s").alias("score"), F.count(F.lit(1)).alias("n"))
    return (g.filter(F.col("n") == len(distinct)) if mode == "and" else g).select("doc_id", "score")


def indexed_phrase_search(spark: SparkSession, path: str, query: str, field: str = "content", k1: float = K1, b: float = B) -> DataFrame:
    """``match_phrase`` -> ``(doc_id, score)``, the scores of ``search.phrase_search``: a phrase
    starts where every token's positions, moved back by its place, agree."""
    found = _lookup(spark, path, field, query)
    if found is None:
        return _nothing(spark)
    tokens, distinct, postings, stats = found
    held = [F.max(F.when(F.col("term") == t, F.col("positions"))).alias(f"p{i}") for i, t in enumerate(distinct)]
    docs = postings.groupBy("doc_id").agg(F.first("dl").alias("dl"), F.count(F.lit(1)).alias("n"), *held).filter(F.col("n") == len(distinct))

    def starts(place: int, token: str):
        return F.transform(f"p{distinct.index(token)}", lambda x: x - place)

    begin = starts(0, tokens[0])
    for place, token in enumerate(tokens[1:], 1):
        begin = F.array_intersect(begin, starts(place, token))
    idf = sum(bm25_idf(stats.n_docs, stats.df[t]) for t in tokens)
    pf = docs.select("doc_id", "dl", F.size(begin).cast("double").alias("pf")).filter("pf > 0")
    return pf.select("doc_id", (F.lit(idf) * _tf_norm(F.col("pf"), F.col("dl"), stats.avgdl, k1, b)).alias("score"))


def indexed_search(spark: SparkSession, path: str, query: str, field: str = "content") -> DataFrame:
    """Quoted query -> phrase search, else OR-match."""
    if query_mode(query) == "phrase":
        return indexed_phrase_search(spark, path, query, field)
    return indexed_keyword_search(spark, path, query, field)
