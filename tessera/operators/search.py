"""Retrieval: BM25 match (OR / AND), phrase match, query-by-document, multi-field.

Two execution shapes:

* **One query** (``keyword_search``, ``phrase_search``, ...). The query's tokens are a
  literal of known size, so term frequencies are computed *inside each document row*
  with higher-order functions; corpus statistics (N, total length, df of the query
  terms: ``2 + |terms|`` numbers) come from one global aggregate; scoring is then a
  map-only pass followed by ``TakeOrderedAndProject``. No shuffle of postings at all.
* **A table of queries** (``similar_cases``, ``batch_keyword_search``). Query terms
  are a DataFrame; candidates come from postings joined on ``term`` in two exact
  MaxScore passes (:func:`maxscore_top_k`): rare terms first, then only the common terms
  whose score bound can still reach the query's k-th score. Candidates are scored from
  per-query and per-document term maps and cut to the top k with ``row_number``
  (planned as WindowGroupLimit, which also prunes before the shuffle).
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import col_, strip_newlines, tokenize
from ..session import ensure_checkpoint_dir
from .analysis import row_postings
from .products import block_product

K1 = 1.2
B = 0.75
RARE_RATIO = 0.01
#: Terms used by queries up to this many are copied to all tasks.
FEW_USED = 500_000
#: (query, term) rows from which on a table of queries is answered by a blocked product.
MANY_ASKED = 20_000
# Characters that open / close a quoted (phrase) query.
PHRASE_OPEN = "'\"“"
PHRASE_CLOSE = "'\"”"
# The two search fields and the columns they search.
SEARCH_FIELDS = {"全文": "content", "仅案情": "basics_text"}


# ---------------------------------------------------------------------------------------
# query analysis


def query_mode(query: str) -> str:
    """'phrase' if the query is wrapped in quotes, else 'match'. Empty queries are errors."""
    if not query:
        raise ValueError("empty query")
    return "phrase" if (query[0] in PHRASE_OPEN and query[-1] in PHRASE_CLOSE) else "match"


def query_mode_col(c) -> Column:
    """Column form of :func:`query_mode` for a table of queries."""
    q = col_(c)
    first, last = F.substring(q, 1, 1), F.substring(q, -1, 1)
    return (F.when(q.isNull() | (q == ""), F.lit(None))
            .when(first.isin(*PHRASE_OPEN) & last.isin(*PHRASE_CLOSE), F.lit("phrase"))
            .otherwise(F.lit("match")))


def field_for(search_field: str) -> str:
    """Column of a search field; an unknown field is an error."""
    if search_field not in SEARCH_FIELDS:
        raise ValueError(f"unknown search field {search_field!r}")
    return SEARCH_FIELDS[search_field]


def analyze_query(spark: SparkSession, text: str) -> list[str]:
    """Query tokens (with repeats) using the same analyzer as the corpus."""
    row = spark.range(1).select(tokenize(F.lit(text)).alias("t")).first()
    return list(row["t"]) if row is not None else []


def bm25_idf(n_docs: float, df: float) -> float:
    return math.log(1.0 + (n_docs - df + 0.5) / (df + 0.5))


def _tf_norm(tf: Column, dl: Column, avgdl: float, k1: float, b: float) -> Column:
    return tf * (k1 + 1.0) / (tf + k1 * (1.0 - b + b * dl / F.lit(avgdl)))


@dataclass
class CorpusStats:
    n_docs: int
    total_len: int
    df: dict

    @property
    def avgdl(self) -> float:
        return self.total_len / self.n_docs if self.n_docs else 0.0


def pin(df: DataFrame, expr: Column, name: str, *cols) -> DataFrame:
    """Project ``cols`` plus ``expr`` as ``name``, evaluated exactly once per row.

    The value comes out of a one-element ``explode``; Catalyst cannot push a filter that
    uses generator output beneath the generator, so a later ``filter`` on ``name`` does
    not inline (and re-run) the expression inside the scan's filter.
    """
    return df.select(*cols, F.explode(F.array(expr)).alias(name))


def _with_tokens(docs: DataFrame, field_tokens: Column, keep) -> DataFrame:
    return pin(docs, field_tokens, "_tok", "doc_id", *keep).withColumn("_dl", F.size("_tok"))


def _corpus_stats(tok: DataFrame, terms: list[str], extra_df: dict | None = None) -> CorpusStats:
    """One global aggregate: docs with >=1 token, total length, df of each query term."""
    aggs = [F.count_if(F.col("_dl") > 0).alias("n"), F.coalesce(F.sum("_dl"), F.lit(0)).alias("tot")]
    for i, t in enumerate(terms):
        aggs.append(F.count_if(F.array_contains("_tok", F.lit(t))).alias(f"df{i}"))
    for name, cond in (extra_df or {}).items():
        aggs.append(F.count_if(cond).alias(name))
    row = tok.agg(*aggs).first()
    dfs = {t: int(row[f"df{i}"]) for i, t in enumerate(terms)}
    for name in (extra_df or {}):
        dfs[name] = int(row[name])
    return CorpusStats(int(row["n"]), int(row["tot"]), dfs)


def _single_query_scores(tok: DataFrame, terms: list[str], mode: str, k1: float, b: float, stats: CorpusStats) -> DataFrame:
    qtf = Counter(terms)
    uniq = list(qtf)
    qarr = F.array(*[F.lit(t) for t in uniq])
    tok = tok.withColumn("_m", F.filter("_tok", lambda x: F.array_contains(qarr, x)))
    score = F.lit(0.0)
    present = []
    for t in uniq:
        tf = F.size(F.filter("_m", lambda x: x == F.lit(t))).cast("double")
        idf = bm25_idf(stats.n_docs, stats.df[t])
        score = score + F.lit(qtf[t] * idf) * _tf_norm(tf, F.col("_dl"), stats.avgdl, k1, b)
        present.append(tf > 0)
    if mode == "and":
        cond = F.lit(True)
        for p in present:
            cond = cond & p
    else:
        cond = F.size("_m") > 0
    return tok.filter(cond).withColumn("score", score)


def keyword_search(docs: DataFrame, query: str, field: str = "content", mode: str = "or",
                   keep: tuple = (), k1: float = K1, b: float = B, field_tokens: Column | None = None) -> DataFrame:
    """BM25 ``match`` over one text field; ``mode='and'`` requires every query term.

    Returns ``(doc_id, score, *keep)`` for every matching document (unordered; callers
    rank with :func:`top_k` or page with ``search_page``).
    """
    spark = docs.sparkSession
    terms = analyze_query(spark, query)
    out_cols = ["doc_id", "score", *keep]
    if not terms:
        return docs.select("doc_id", *keep).withColumn("score", F.lit(0.0)).limit(0).select(*out_cols)
    tok = _with_tokens(docs, field_tokens if field_tokens is not None else tokenize(field), keep)
    stats = _corpus_stats(tok, list(dict.fromkeys(terms)))
    return _single_query_scores(tok, terms, mode, k1, b, stats).select(*out_cols)


def _phrase_freq(tok_col: str, phrase: list[str]) -> Column:
    """Number of positions where ``phrase`` occurs as consecutive tokens."""
    n = len(phrase)

    def at(i: Column, j: int) -> Column:
        return F.try_element_at(F.col(tok_col), (i + F.lit(j + 1)).cast("int"))

    def starts_here(x: Column, i: Column) -> Column:
        cond = x == F.lit(phrase[0])
        for j in range(1, n):
            cond = cond & (F.coalesce(at(i, j), F.lit("")) == F.lit(phrase[j]))
        return cond

    return F.size(F.filter(F.transform(F.col(tok_col), lambda x, i: F.when(starts_here(x, i), i)), lambda i: i.isNotNull()))


def phrase_search(docs: DataFrame, query: str, field: str = "content", keep: tuple = (),
                  k1: float = K1, b: float = B, field_tokens: Column | None = None) -> DataFrame:
    """``match_phrase``: query tokens at consecutive positions.

    Score = (sum of idf over phrase tokens) x BM25 tf-norm of the phrase frequency.
    """
    spark = docs.sparkSession
    terms = analyze_query(spark, query)
    tok = _with_tokens(docs, field_tokens if field_tokens is not None else tokenize(field), keep)
    out_cols = ["doc_id", "score", *keep]
    if not terms:
        return tok.withColumn("score", F.lit(0.0)).limit(0).select(*out_cols)
    stats = _corpus_stats(tok, list(dict.fromkeys(terms)))
    idf_sum = sum(bm25_idf(stats.n_docs, stats.df[t]) for t in terms)
    # cheap pre-filter: every phrase token must be present
    cond = F.lit(True)
    for t in dict.fromkeys(terms):
        cond = cond & F.array_contains("_tok", F.lit(t))
    pf = _phrase_freq("_tok", terms).cast("double")
    return (tok.filter(cond).withColumn("_pf", pf).filter(F.col("_pf") > 0)
            .withColumn("score", F.lit(idf_sum) * _tf_norm(F.col("_pf"), F.col("_dl"), stats.avgdl, k1, b))
            .select(*out_cols))


def search_by_mode(docs: DataFrame, query: str, field: str, keep: tuple = ()) -> DataFrame:
    """Quoted query -> phrase search, else OR-match (the quotes are dropped by the analyzer)."""
    if query_mode(query) == "phrase":
        return phrase_search(docs, query, field, keep)
    return keyword_search(docs, query, field, "or", keep)


def top_k(scored: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """Deterministic top-k: score rounded to ``digits`` descending, then ``doc_id``."""
    r = scored.withColumn("score", F.round("score", digits))
    return r.orderBy(F.desc("score"), F.asc("doc_id")).limit(k)


# ---------------------------------------------------------------------------------------
# multi-field


def multi_field_search(docs: DataFrame, query: str, fields=("case_name", "content"), keep: tuple = ()) -> DataFrame:
    """``combined_fields``: the fields act as one (tf and length summed over fields)."""
    combined = None
    for f in fields:
        t = tokenize(f)
        combined = t if combined is None else F.concat(combined, t)
    return keyword_search(docs, query, "+".join(fields), "or", keep, field_tokens=combined)


def multi_field_phrase(docs: DataFrame, query: str, fields=("case_name", "content"), keep: tuple = (), k1: float = K1, b: float = B) -> DataFrame:
    """``multi_match`` of type phrase: phrase score per field, best field wins. The fields are
    analysed side by side in one row: one pass for the statistics, one for the scores."""
    terms = analyze_query(docs.sparkSession, query)
    out_cols = ["doc_id", "score", *keep]
    names = [f"_toks.f{i}" for i in range(len(fields))]
    tok = pin(docs, F.struct(*[tokenize(f).alias(f"f{i}") for i, f in enumerate(fields)]), "_toks", "doc_id", *keep)
    if not terms:
        return tok.withColumn("score", F.lit(0.0)).limit(0).select(*out_cols)
    distinct = list(dict.fromkeys(terms))
    row = tok.agg(*[a for i, c in enumerate(names) for a in (
        F.count_if(F.size(c) > 0).alias(f"n{i}"), F.coalesce(F.sum(F.size(c)), F.lit(0)).alias(f"t{i}"),
        *[F.count_if(F.array_contains(c, t)).alias(f"d{i}_{j}") for j, t in enumerate(distinct)])]).first()
    scores = []
    for i, c in enumerate(names):
        stats = CorpusStats(row[f"n{i}"], row[f"t{i}"], {t: row[f"d{i}_{j}"] for j, t in enumerate(distinct)})
        if all(stats.df.values()):  # else no record holds the phrase in this field
            idf = sum(bm25_idf(stats.n_docs, stats.df[t]) for t in terms)
            pf = _phrase_freq(c, terms).cast("double")
            tok = tok.withColumn(f"_pf{i}", pf)
            scores.append(F.when(F.col(f"_pf{i}") > 0, F.lit(idf) * _tf_norm(F.col(f"_pf{i}"), F.size(c), stats.avgdl, k1, b)))
    if not scores:
        return tok.withColumn("score", F.lit(0.0)).limit(0).select(*out_cols)
    best = F.greatest(*scores) if len(scores) > 1 else scores[0]
    return tok.withColumn("score", best).filter("score is not null").select(*out_cols)


# ---------------------------------------------------------------------------------------
# tables of queries


def query_terms_table(queries: DataFrame, qid: str, text) -> DataFrame:
    """``(qid, term, qtf)`` from a query table (one row per distinct query term)."""
    t = tokenize(text)
    return (queries.select(F.col(qid).alias("qid"), F.explode(t).alias("term"))
            .groupBy("qid", "term").agg(F.count(F.lit(1)).alias("qtf")))


def _stored_postings(docs: DataFrame, field_tokens: Column, restrict_terms: DataFrame | None = None) -> tuple[DataFrame, int, float]:
    """((term, doc_id, tf, dl), documents with a token, mean length): the postings of the terms some query
    uses, counted inside the documents' rows and written to the checkpoint folder."""
    spark = docs.sparkSession
    folder = ensure_checkpoint_dir(spark).rstrip("/")
    t = docs.select("doc_id", field_tokens.alias("_t"))
    rows = row_postings(t, mark=True).select("term", "doc_id", "tf", "dl")
    if restrict_terms is not None:
        used = restrict_terms.select("term").distinct().unionByName(spark.createDataFrame([("",)], "term string"))
        rows = rows.join(F.broadcast(used) if used.count() <= FEW_USED else used, "term", "left_semi")
    path = f"{folder}/postings-{uuid.uuid4().hex}"
    rows.write.option("compression", "zstd").parquet(path)
    stored = spark.read.parquet(path)
    st = stored.where("term = ''").agg(F.count_if(F.col("dl") > 0).alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("tot")).first()
    return stored.where("term <> ''"), int(st["n"]), (int(st["tot"]) / int(st["n"]) if st["n"] else 0.0)


def weighted_postings(docs: DataFrame, field_tokens: Column, k1: float = K1, b: float = B,
                      restrict_terms: DataFrame | None = None, max_df_ratio: float = 1.0) -> DataFrame:
    return _weighted_postings(docs, field_tokens, k1, b, restrict_terms, max_df_ratio)[0]


def _weighted_postings(docs: DataFrame, field_tokens: Column, k1: float = K1, b: float = B,
                       restrict_terms: DataFrame | None = None, max_df_ratio: float = 1.0) -> tuple[DataFrame, int]:
    """``(term, doc_id, w)`` with w = idf(term) x tf-norm; exact corpus statistics.

    One pass over the corpus: every document emits its postings for the terms some query
    uses (``restrict_terms``) plus one row under the empty term, which the analyzer never makes,
    with its length. That table is written to the reliable checkpoint directory,
    and N, mean length and df are small aggregates over it, so the corpus (and any
    preparation feeding it) is read and analysed once. ``max_df_ratio`` < 1 drops very
    common terms (changes scores; off by default).
    """
    post, n_docs, avgdl = _stored_postings(docs, field_tokens, restrict_terms)
    df = post.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    w = (post.join(df, "term")
         .withColumn("idf", F.log(1.0 + (F.lit(float(n_docs)) - F.col("df") + 0.5) / (F.col("df") + 0.5)))
         .withColumn("w", F.col("idf") * (F.col("tf") * (k1 + 1.0)) /
                     (F.col("tf") + k1 * (1.0 - b + b * F.col("dl") / F.lit(avgdl)))))
    if max_df_ratio < 1.0:
        w = w.filter(F.col("df") <= F.lit(n_docs * max_df_ratio))
    return w.select("term", "doc_id", "w"), n_docs


def batch_keyword_search(docs: DataFrame, queries: DataFrame, qid: str, query_text, field: str = "basics_text",
                         k: int = 10, max_df_ratio: float = 1.0, keep: tuple = (), rare_ratio: float = RARE_RATIO,
                         exhaustive: bool = False) -> DataFrame:
    """BM25 OR-match for every row of a query table; exact top ``k`` documents per query.

    Output ``(qid, doc_id, score, rank)``. By default runs :func:`maxscore_top_k`, which
    never joins a query with all postings of its common terms unless its own scores
    require it; ``exhaustive=True`` scores every (query, matching document) pair. Large tables of
    queries are multiplied with the postings in blocks (:func:`products.block_product`).
    """
    qt = query_terms_table(queries, qid, query_text)
    if max_df_ratio == 1.0 and not exhaustive:
        ensure_checkpoint_dir(docs.sparkSession)
        qt = qt.checkpoint()
        asked = qt.count()
        if asked >= MANY_ASKED:
            post, n, avgdl = _stored_postings(docs, tokenize(field), qt)
            df = post.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
            idf = F.log(1.0 + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
            weighted = qt.join(df, "term").select("qid", "term", (F.col("qtf") * idf).alias("weight"))
            return _rank(block_product(weighted, post.select("term", "doc_id", _tf_norm(F.col("tf"), F.col("dl"), avgdl, K1, B).alias("v")), k), k)
    wp, n_docs = _weighted_postings(docs, tokenize(field), restrict_terms=qt, max_df_ratio=max_df_ratio)
    if exhaustive:
        partial = qt.join(wp, "term").select("qid", "doc_id", (F.col("qtf") * F.col("w")).alias("s"))
        return _rank(partial.groupBy("qid", "doc_id").agg(F.sum("s").alias("score")), k)
    return maxscore_top_k(qt, wp, n_docs, k, rare_ratio)


def _rank(scores: DataFrame, k: int) -> DataFrame:
    scores = scores.withColumn("score", F.round("score", 6))
    win = Window.partitionBy("qid").orderBy(F.desc("score"), F.asc("doc_id"))
    return (scores.withColumn("rank", F.row_number().over(win)).filter(F.col("rank") <= k)
            .select(F.col("qid"), "doc_id", "score", F.col("rank").cast("int")))


def _partial(terms: DataFrame, wp: DataFrame) -> DataFrame:
    """``(qid, doc_id, s)``: qtf x w for the given ``(qid, term, qtf)`` rows' postings."""
    return terms.select("qid", "term", "qtf").join(wp, "term").select("qid", "doc_id", (F.col("qtf") * F.col("w")).alias("s"))


def _kth(scores: DataFrame, k: int, name: str) -> DataFrame:
    win = Window.partitionBy("qid").orderBy(F.desc("score"), F.asc("doc_id"))
    return scores.withColumn("_r", F.row_number().over(win)).filter(F.col("_r") == k).select("qid", F.col("score").alias(name))


def maxscore_top_k(qt: DataFrame, wp: DataFrame, n_docs: int, k: int, rare_ratio: float = RARE_RATIO,
                   margin: float = 1e-6) -> DataFrame:
    """Exact top-k per query by MaxScore over ``qt (qid, term, qtf)`` and
    ``wp (term, doc_id, w)``; all weights are positive, ``ub(term) = qtf x max w``.

    1. Each query's *rare* terms (df <= ``rare_ratio`` x N, plus its rarest term) are
       joined with their postings; the k-th best of these partial sums, theta, is a lower
       bound of the query's true k-th score (0 with fewer than k documents).
    2. The other terms, ordered by ub, split into a non-essential prefix (cumulative ub
       < theta - ``margin``) and the essential rest. A document holding only
       non-essential terms scores below theta and cannot enter the top k (not even by a
       tie after rounding to 6 digits), so only essential postings are joined.
    3. With ``P`` the partial sum over rare + essential terms and theta' the k-th best P,
       a candidate survives only if ``P + ub(non-essential) >= theta' - margin``; only
       survivors are probed for their non-essential terms (join on ``(term, doc_id)``).

    A common term (a third of all documents, say) thus meets only the queries whose
    bound needs it, and scoring is plain joins and sums (whole-stage code generated).
    """
    ensure_checkpoint_dir(wp.sparkSession)
    wp = wp.checkpoint(eager=True)
    tstats = wp.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.max("w").alias("maxw"))
    rare_df = max(1, int(math.ceil(rare_ratio * n_docs)))
    by_df = Window.partitionBy("qid").orderBy(F.asc("df"), F.asc("term"))
    qts = (qt.join(tstats, "term")
           .withColumn("ub", F.col("qtf") * F.col("maxw"))
           .withColumn("phase1", (F.col("df") <= rare_df) | (F.row_number().over(by_df) == 1))
           .checkpoint(eager=True))

    p1 = _partial(qts.filter("phase1"), wp).groupBy("qid", "doc_id").agg(F.sum("s").alias("score")).checkpoint(eager=True)
    by_ub = (Window.partitionBy("qid").orderBy(F.asc("ub"), F.asc("term"))
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rest = (qts.filter(~F.col("phase1")).join(_kth(p1, k, "theta"), "qid", "left")
            .withColumn("cum", F.sum("ub").over(by_ub))
            .withColumn("essential", F.col("cum") >= F.coalesce(F.col("theta"), F.lit(0.0)) - F.lit(margin))
            .checkpoint(eager=True))
    non_ess = rest.filter(~F.col("essential"))
    ub_rest = non_ess.groupBy("qid").agg(F.max("cum").alias("ub_rest"))

    p2 = _partial(rest.filter("essential"), wp).withColumnRenamed("s", "score")
    part = p1.unionByName(p2).groupBy("qid", "doc_id").agg(F.sum("score").alias("score")).checkpoint(eager=True)
    survivors = (part.join(_kth(part, k, "theta2"), "qid", "left").join(ub_rest, "qid", "left")
                 .filter(F.col("score") + F.coalesce(F.col("ub_rest"), F.lit(0.0))
                         >= F.coalesce(F.col("theta2"), F.lit(0.0)) - F.lit(margin))
                 .select("qid", "doc_id", "score"))
    probe = (survivors.select("qid", "doc_id").join(non_ess.select("qid", "term", "qtf"), "qid")
             .join(wp, ["term", "doc_id"])
             .groupBy("qid", "doc_id").agg(F.sum(F.col("qtf") * F.col("w")).alias("extra")))
    full = (survivors.join(probe, ["qid", "doc_id"], "left")
            .select("qid", "doc_id", (F.col("score") + F.coalesce(F.col("extra"), F.lit(0.0))).alias("score")))
    return _rank(full, k)


def pseudo_facts(df: DataFrame) -> Column:
    """Follow-up query text of a hit: its facts passage, or newline-free content."""
    return F.when(F.coalesce(F.col("basics_text"), F.lit("")) != "", F.col("basics_text")) \
        .otherwise(strip_newlines(F.coalesce(F.col("content"), F.lit(""))))


def similar_cases(cases: DataFrame, query_docs: DataFrame, k: int = 10, max_df_ratio: float = 1.0) -> DataFrame:
    """Query by document: each query document's facts (or content) searched in the facts
    passages of ``cases``; the query document itself is kept if it ranks."""
    q = query_docs.select(F.col("doc_id").alias("qid"), pseudo_facts(query_docs).alias("qtext"))
    return batch_keyword_search(cases, q, "qid", "qtext", "basics_text", k, max_df_ratio)
