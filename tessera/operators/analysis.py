"""Text analysis operators: tokens, postings, corpus statistics, stop words, sentences,
bag of words.

Postings are the inverted index: ``(term, doc_id, tf, positions, dl)``. A document lives in one
row, so its tokens are sorted and counted inside the row and nothing is shuffled; only rows whose
key occurs more than once meet in an aggregation afterwards. ``write_postings`` stores postings in term
order so a query reads only the row groups of its terms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import keep_token
from ..functions.text import let, split_sentences, tokenize

#: Repeated keys up to this many are copied to all tasks.
FEW_KEYS = 100_000


def tokens(df: DataFrame, text_col: str = "text", key: str = "doc_id") -> DataFrame:
    return df.select(key, tokenize(text_col).alias("tokens"))


def runs_in_row(placed: Column, of) -> Column:
    """``of(term, positions)`` for every term of an array of (term, pos), in one sort of the array."""
    def runs(s: Column) -> Column:
        term = lambda i: F.get(s, i)["term"]
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: ~term(i).eqNullSafe(term(i - 1)))
        each = let(starts, lambda at: F.transform(at, lambda b, k: of(term(b), F.transform(
            F.sequence(b, F.coalesce(F.get(at, k + 1), F.size(s)) - 1), lambda i: F.get(s, i)["pos"]))))
        return F.when(F.size(s) > 0, each)

    return let(F.sort_array(placed), runs)


def alone_and_shared(df: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """Rows that are the only ones of their key, and the others (None if there are none); null is a
    key like any other."""
    again = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*[F.col(k).alias(f"_{k}") for k in keys])
    n = again.count()
    if not n:
        return df, None
    again, same = F.broadcast(again) if n <= FEW_KEYS else again, F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    return df.join(again, same, "left_anti"), df.join(again, same, "left_semi")


def row_postings(t: DataFrame, mark: bool = False) -> DataFrame:
    """``(term, doc_id, tf, positions, dl)`` of documents (doc_id, _t tokens); with ``mark`` every document
    also stands under the empty term, at position -1 and with tf 0."""
    head = F.array(F.struct(F.lit("").alias("term"), F.lit(-1).alias("pos"))) if mark else F.array().cast("array<struct<term: string, pos: int>>")
    less = int(mark)

    def listed(rows: DataFrame) -> DataFrame:
        placed = F.concat(head, F.transform("_t", lambda x, i: F.struct(x.alias("term"), i.alias("pos"))))
        each = let(placed, lambda a: runs_in_row(a, lambda term, at: F.struct(
            term.alias("term"), F.when(term == "", F.lit(0)).otherwise(F.size(at)).cast("long").alias("tf"), at.alias("positions"), (F.size(a) - less).alias("dl"))))
        return rows.select("doc_id", F.inline(each)).select("term", "doc_id", "tf", "positions", "dl")

    alone, shared = alone_and_shared(t, ["doc_id"])
    if shared is None:
        return listed(alone)
    met = listed(shared).groupBy("term", "doc_id").agg(F.sum("tf").alias("tf"), F.sort_array(F.flatten(F.collect_list("positions"))).alias("positions"), F.first("dl").alias("dl"))
    return listed(alone).unionByName(met)


def postings(df: DataFrame, text_col: str = "text", key: str = "doc_id") -> DataFrame:
    """``(term, doc_id, tf, positions array<int>, dl)``; positions are 0-based."""
    return row_postings(df.select(F.col(key).alias("doc_id"), tokenize(text_col).alias("_t")))


def by_term(p: DataFrame, partitions: int | None = None) -> DataFrame:
    """Postings range-partitioned and sorted by (term, doc_id): files hold ranges of terms, so
    Parquet statistics prune a term filter to a few files and row groups, and the posting list
    of a very common term is cut into several files."""
    ranged = p.repartitionByRange(partitions, "term", "doc_id") if partitions else p.repartitionByRange("term", "doc_id")
    return ranged.sortWithinPartitions("term", "doc_id")


def write_postings(p: DataFrame, path: str, mode: str = "overwrite", partitions: int | None = None) -> None:
    by_term(p, partitions).write.mode(mode).parquet(path)


def read_postings_for(spark, path: str, terms: list[str]) -> DataFrame:
    """Postings of ``terms``; the filter is pushed into the scan."""
    return spark.read.parquet(path).filter(F.col("term").isin(list(terms)))


def term_stats(df: DataFrame, text_col: str = "text", key: str = "doc_id") -> DataFrame:
    """Per-term document frequency with the corpus size and mean length on every row."""
    t = df.select(F.col(key).alias("doc_id"), tokenize(text_col).alias("_t")).withColumn("dl", F.size("_t"))
    st = t.agg(F.count_if(F.col("dl") > 0).alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("tot")).first()
    n_docs = int(st["n"])
    avgdl = int(st["tot"]) / n_docs if n_docs else 0.0
    dfs = (t.select("doc_id", F.explode(F.array_distinct("_t")).alias("term"))
           .groupBy("term").agg(F.count(F.lit(1)).alias("df")))
    return dfs.select("term", F.col("df").cast("bigint"), F.lit(n_docs).cast("bigint").alias("n_docs"),
                      F.round(F.lit(avgdl), 6).alias("avgdl"))


def corpus_stop_words(df: DataFrame, text_col: str = "text", key: str = "doc_id", max_df_ratio: float = 0.5) -> DataFrame:
    """Stop words derived from the data: terms in more than ``max_df_ratio`` of documents.

    The result is small by construction: the df of all terms sums to N x (mean distinct
    terms per document), so fewer than ``mean distinct terms / max_df_ratio`` terms pass.
    """
    t = df.select(F.col(key).alias("doc_id"), tokenize(text_col).alias("_t"))
    n = t.count()
    dfs = t.select("doc_id", F.explode(F.array_distinct("_t")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return dfs.filter(F.col("df") > F.lit(n * max_df_ratio)).select("term")


def remove_stop_words(df: DataFrame, tokens_col: str, stop: DataFrame | list | None, key: str | list = "doc_id") -> DataFrame:
    """Drop stop words (plus the digit-only rule) from a token array column.

    A list (the caller's own words) is inlined. A table of terms is anti-joined with the tokens,
    one row each, and the arrays are put together again by ``key``, which must be unique; Spark
    decides from its sizes whether the table is broadcast.
    """
    if not isinstance(stop, DataFrame):
        arr = F.array(*[F.lit(w) for w in (stop or [])]).cast("array<string>")
        return df.withColumn(tokens_col, F.filter(tokens_col, lambda x: keep_token(x, arr)))
    keys = [key] if isinstance(key, str) else list(key)
    each = df.select(*keys, F.posexplode(tokens_col).alias("_pos", "term")).filter(keep_token(F.col("term"), None))
    kept = each.join(stop.select("term").distinct(), "term", "left_anti")
    arrays = kept.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_pos", "term")))["term"].alias("_kept"))
    out = df.join(arrays, keys, "left").withColumn(tokens_col, F.coalesce("_kept", F.array().cast("array<string>")))
    return out.select(df.columns)


def sentences(df: DataFrame, text_col: str = "text", key: str = "doc_id") -> DataFrame:
    """``(doc_id, sent_idx, sentence)``, 0-based index in text order."""
    return df.select(F.col(key).alias("doc_id"), F.posexplode(split_sentences(text_col)).alias("sent_idx", "sentence"))


def bag_of_words(sents: DataFrame, stop=None) -> DataFrame:
    """Sparse counts ``(doc_id, sent_idx, term, tf)`` per sentence (lower-cased tokens)."""
    t = sents.select("doc_id", "sent_idx", tokenize("sentence").alias("_t"))
    if stop is not None:
        t = remove_stop_words(t, "_t", stop, ["doc_id", "sent_idx"])

    def counted(rows: DataFrame) -> DataFrame:
        placed = F.transform("_t", lambda x: F.struct(x.alias("term"), F.lit(0).alias("pos")))
        each = runs_in_row(placed, lambda term, at: F.struct(term.alias("term"), F.size(at).cast("long").alias("tf")))
        return rows.select("doc_id", "sent_idx", F.inline(each))

    alone, shared = alone_and_shared(t, ["doc_id", "sent_idx"])
    if shared is None:
        return counted(alone)
    return counted(alone).unionByName(counted(shared).groupBy("doc_id", "sent_idx", "term").agg(F.sum("tf").alias("tf")))
