"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per operator key.

Every query reads the driver tables under ``sf_dir`` (through the ``cases`` view and its
preparation) and runs over whole tables and whole texts.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.facts import extract_facts
from ..functions.labels import FACET_FIELDS
from ..functions.text import preview, strip_newlines
from ..functions.vectors import l2_norm, l2_normalize
from ..operators import analysis as an
from ..operators import components as cp
from ..operators import facets as fc
from ..operators import index as ix
from ..operators import ivf as iv
from ..operators import prep as pr
from ..operators import search as se
from ..operators import segments as sg
from ..operators import sentence_join as sj
from ..operators import shape as sh
from ..operators import substrings as sb
from ..operators import vectors as vx
from ..session import ensure_checkpoint_dir
from ..sources import io as sio
from ..sources import tables as tb
from . import params as P
from .search_plan import FULL_TEXT, SIMILAR, SearchRequest, search

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(fn=None, *, name: str | None = None):
    def deco(f):
        REGISTRY[name or f.__name__] = f
        return f
    return deco(fn) if fn is not None else deco


def prepared(spark: SparkSession, sf_dir: str, with_vectors: bool = False) -> DataFrame:
    raw = tb.cases(spark, sf_dir)
    vec = tb.case_vectors(spark, sf_dir) if with_vectors else None
    return pr.prepare_cases(raw, vec)


FACET_KEEP = tuple(f for f in FACET_FIELDS if f in ("court_name", "court_province", "trial_round", "case_type", "legal_base"))


def _or_hits(spark, sf_dir, keep=()):
    return se.keyword_search(prepared(spark, sf_dir), P.Q_OR, "content", "or", keep)


# ---------------------------------------------------------------- retrieval


@register
def keyword_search(spark, sf_dir):
    return se.top_k(_or_hits(spark, sf_dir), 20)


@register
def keyword_search_all_terms(spark, sf_dir):
    h = se.keyword_search(prepared(spark, sf_dir), P.Q_AND, "content", "and")
    return h.select("doc_id", F.round("score", 6).alias("score"))


@register
def phrase_search(spark, sf_dir):
    assert se.query_mode(P.Q_PHRASE) == "phrase"
    h = se.search_by_mode(prepared(spark, sf_dir), P.Q_PHRASE, "content")
    return h.select("doc_id", F.round("score", 6).alias("score"))


@register
def facts_search(spark, sf_dir):
    fld = se.field_for("仅案情")
    return se.top_k(se.keyword_search(prepared(spark, sf_dir), P.Q_OR, fld), 20)


@register
def title_phrase(spark, sf_dir):
    h = se.phrase_search(prepared(spark, sf_dir), P.Q_TITLE, "case_name")
    return h.select("doc_id", F.round("score", 6).alias("score"))


@register
def multi_field_search(spark, sf_dir):
    return se.top_k(se.multi_field_search(prepared(spark, sf_dir), P.Q_MULTI), 20)


@register
def multi_field_phrase(spark, sf_dir):
    h = se.multi_field_phrase(prepared(spark, sf_dir), P.Q_MULTI_PHRASE)
    return h.select("doc_id", F.round("score", 6).alias("score"))


_INDEXES: dict[tuple[str, str], str] = {}


def case_index(spark, sf_dir):
    """Index of the prepared cases, built once per application in the shared folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _INDEXES:
        path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/case-index-{uuid.uuid4().hex}"
        ix.build_index(prepared(spark, sf_dir).select("doc_id", *ix.FIELDS), path)
        _INDEXES[key] = path
    return _INDEXES[key]


@register
def indexed_keyword_search(spark, sf_dir):
    return se.top_k(ix.indexed_search(spark, case_index(spark, sf_dir), P.Q_OR), 20)


@register
def indexed_phrase_search(spark, sf_dir):
    h = ix.indexed_search(spark, case_index(spark, sf_dir), P.Q_PHRASE)
    return h.select("doc_id", F.round("score", 6).alias("score"))


@register
def indexed_facts_search(spark, sf_dir):
    return se.top_k(ix.indexed_search(spark, case_index(spark, sf_dir), P.Q_OR, se.field_for("仅案情")), 20)


_SEGMENTED: dict[tuple[str, str, str], sg.Index] = {}


def segmented_index(spark, sf_dir, state="loaded"):
    """Segmented index of the prepared cases, once per application: ``loaded`` in two batches, then
    ``deleted`` without one collection of the first batch, then ``merged`` into one segment."""
    key = (spark.sparkContext.applicationId, sf_dir, state)
    if key not in _SEGMENTED:
        if state == "loaded":
            index = sg.Index.create(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/segments-{uuid.uuid4().hex}", ix.FIELDS, facet_fields=FACET_KEEP)
            docs = prepared(spark, sf_dir).select("doc_id", "collection", *ix.FIELDS, *FACET_KEEP)
            last = F.col("collection") == P.LAST_BATCH
            _SEGMENTED[key] = index.add(docs.filter(~last)).add(docs.filter(last))
        elif state == "deleted":
            _SEGMENTED[key] = segmented_index(spark, sf_dir).delete(F.col("collection") == P.DELETED)
        else:
            _SEGMENTED[key] = segmented_index(spark, sf_dir, "deleted").merge()
    return _SEGMENTED[key]


@register
def indexed_similar_cases(spark, sf_dir):
    bench = tb.read_table(spark, sf_dir, "benchmark")
    return segmented_index(spark, sf_dir).search_table(bench, "item_id", F.col("text"), "basics_text", P.SIMILAR_K)


@register
def indexed_similar_stored_cases(spark, sf_dir):
    p = prepared(spark, sf_dir)
    asked = p.filter(F.col("doc_id") % 50 == 0)
    return segmented_index(spark, sf_dir).search_table(asked, "doc_id", se.pseudo_facts(p), "basics_text", P.SIMILAR_K)


@register
def index_after_delete(spark, sf_dir):
    bench = tb.read_table(spark, sf_dir, "benchmark")
    return segmented_index(spark, sf_dir, "deleted").search_table(bench, "item_id", F.col("text"), "basics_text", P.SIMILAR_K)


@register
def index_after_merge(spark, sf_dir):
    h = segmented_index(spark, sf_dir, "merged").search(P.Q_OR)
    return h.select("doc_id", F.round("score", 6).alias("score"))


@register
def indexed_pair_phrase(spark, sf_dir):
    """A phrase of common words, answered from their pair lists."""
    h = segmented_index(spark, sf_dir).search(P.Q_PHRASE)
    return h.select("doc_id", F.round("score", 6).alias("score"))


@register
def indexed_facets(spark, sf_dir):
    index = segmented_index(spark, sf_dir)
    return index.facets(index.hits(P.Q_OR), FACET_FIELDS)


@register
def indexed_post_filter(spark, sf_dir):
    index = segmented_index(spark, sf_dir)
    return se.top_k(index.post_filter(index.hits(P.Q_OR), P.POST_FILTER).select("doc_id", "score"), 20)


@register
def query_mode(spark, sf_dir):
    bench = tb.read_table(spark, sf_dir, "benchmark")
    m = F.col("item_id") % 4
    q = (F.when(m == 0, F.concat(F.lit('"'), "text", F.lit('"')))
         .when(m == 1, F.concat(F.lit("“"), "text", F.lit("”")))
         .when(m == 2, F.col("text")).otherwise(F.concat(F.lit('"'), "text")))
    return bench.select("item_id", se.query_mode_col(q).alias("mode"))


@register
def similar_cases(spark, sf_dir):
    bench = tb.read_table(spark, sf_dir, "benchmark")
    q = bench.select(F.col("item_id").alias("qid"), F.col("text").alias("qtext"))
    return se.batch_keyword_search(prepared(spark, sf_dir), q, "qid", "qtext", "basics_text", P.SIMILAR_K)


@register
def similar_stored_cases(spark, sf_dir):
    """Stored cases as queries: those whose id is divisible by 50 against the facts of all cases."""
    p = prepared(spark, sf_dir)
    asked = p.filter(F.col("doc_id") % 50 == 0)
    return se.similar_cases(p, asked, P.SIMILAR_K)


# ---------------------------------------------------------------- search response


def _request(**kw):
    return SearchRequest(query=P.Q_OR, field=FULL_TEXT, facet_fields=list(FACET_FIELDS), **kw)


@register
def facets(spark, sf_dir):
    return search(tb.cases(spark, sf_dir), _request(), prepare=pr.prepare_cases, persist=False).facets


@register
def facets_sampled(spark, sf_dir):
    return search(tb.cases(spark, sf_dir), _request(sample_size=P.SAMPLE_SIZE), prepare=pr.prepare_cases, persist=False).facets


@register
def similar_search_hits(spark, sf_dir):
    req = SearchRequest(query=P.Q_KNN, backbone=SIMILAR, field=FULL_TEXT)
    return search(tb.cases(spark, sf_dir), req, prepare=pr.prepare_cases, persist=False, vectors=tb.case_vectors(spark, sf_dir), dims=P.DIMS).hits


@register
def search_total(spark, sf_dir):
    return search(tb.cases(spark, sf_dir), _request(facets=P.POST_FILTER), prepare=pr.prepare_cases, persist=False).total


@register
def post_filter_search(spark, sf_dir):
    h = _or_hits(spark, sf_dir, keep=FACET_KEEP)
    return se.top_k(fc.post_filter(h, P.POST_FILTER), 20).select("doc_id", "score")


@register
def search_page(spark, sf_dir):
    return sh.search_page(_or_hits(spark, sf_dir), 20, 25)


@register
def search_hits(spark, sf_dir):
    return search(tb.cases(spark, sf_dir), _request(), prepare=pr.prepare_cases, persist=False).hits


@register
def highlight(spark, sf_dir):
    page = sh.search_page(_or_hits(spark, sf_dir, keep=("content",)), 0, 20)
    terms = se.analyze_query(spark, P.Q_OR)
    return page.select("doc_id", sh.highlight(F.col("content"), terms).alias("highlight"))


@register
def highlight_window(spark, sf_dir):
    page = sh.search_page(_or_hits(spark, sf_dir, keep=("content",)), 0, 20)
    terms = se.analyze_query(spark, P.Q_OR)
    return page.select("doc_id", sh.highlight_window(F.col("content"), terms).alias("fragment"))


@register
def page_window(spark, sf_dir):
    total = _or_hits(spark, sf_dir).agg(F.count(F.lit(1)).alias("total"))
    n_pages = F.ceil(F.col("total") / F.lit(P.CLIENT_PAGE)).cast("int")
    pages = total.select("total", F.explode(F.sequence(F.lit(1), F.greatest(n_pages, F.lit(1)))).alias("page"), n_pages.alias("n_pages"))
    pages = pages.filter(F.col("page") <= F.col("n_pages"))
    return pages.select(F.col("page").cast("int"), "n_pages",
                        F.array_join(sh.page_window(F.col("total"), F.col("page")), ",").alias("pages"))


@register
def count_all(spark, sf_dir):
    return prepared(spark, sf_dir).agg(F.count(F.lit(1)).cast("bigint").alias("n"))


@register
def term_filter(spark, sf_dir):
    return fc.term_filter(prepared(spark, sf_dir), "collection", "p2").select("doc_id")


@register
def terms_filter(spark, sf_dir):
    sel = {"court_province": ["en", "de"], "legal_base": P.TERMS_FILTER_LAWS}
    return fc.post_filter(prepared(spark, sf_dir), sel).select("doc_id")


@register
def substring_scan(spark, sf_dir):
    return prepared(spark, sf_dir).filter(F.instr("content", P.SUBSTRING) > 0).select("doc_id")


def _substring_index(spark, sf_dir):
    return _built(spark, sf_dir, "trigrams", lambda at: sb.build(prepared(spark, sf_dir), at, "content"))


@register
def indexed_substring(spark, sf_dir):
    return sb.find(spark, _substring_index(spark, sf_dir), P.SUBSTRING)


@register
def indexed_substrings(spark, sf_dir):
    """A table of patterns: a stretch of every benchmark passage."""
    bench = tb.read_table(spark, sf_dir, "benchmark")
    return sb.find_table(bench, _substring_index(spark, sf_dir), "item_id", F.substring("text", *P.STRETCH)).select(F.col("pid").alias("item_id"), "doc_id")


@register
def exists_filter(spark, sf_dir):
    from ..functions.facts import truthy
    # the facts passage is pinned so the filter does not inline the cascade a second time
    return se.pin(prepared(spark, sf_dir), F.col("basics_text"), "_bt", "doc_id").filter(truthy("_bt")).select("doc_id")


@register
def get_by_id(spark, sf_dir):
    ids = tb.read_table(spark, sf_dir, "labels").filter(F.col("quality") == 1).select("doc_id")
    return prepared(spark, sf_dir).join(ids, "doc_id", "left_semi").select("doc_id", "case_id", "case_name")


@register
def terms_agg(spark, sf_dir):
    return fc.terms_agg(prepared(spark, sf_dir), "court_name").select("key", F.col("doc_count").cast("bigint"))


@register
def delete_by_collection(spark, sf_dir):
    return sio.delete_by_term(prepared(spark, sf_dir), "collection", "p1").select("doc_id", "collection")


# ---------------------------------------------------------------- shaping


@register(name="preview")
def preview_text(spark, sf_dir):
    return prepared(spark, sf_dir).select("doc_id", preview("content").alias("preview"))


@register
def pseudo_facts(spark, sf_dir):
    p = prepared(spark, sf_dir)
    return p.select("doc_id", se.pseudo_facts(p).alias("query_text"))


@register
def date_render(spark, sf_dir):
    return prepared(spark, sf_dir).select("doc_id", F.date_format("publish_date", "yyyy-MM-dd").alias("publish_date"))


@register
def hit_defaults(spark, sf_dir):
    return pr.hit_defaults(prepared(spark, sf_dir))


@register
def record_detail(spark, sf_dir):
    p = prepared(spark, sf_dir)
    return sh.record_detail(p).select("doc_id", F.col("field_pos").cast("int"), "field", "label", "value")


@register
def export_text(spark, sf_dir):
    return sh.export_text(prepared(spark, sf_dir))


# ---------------------------------------------------------------- preparation


@register
def newline_strip(spark, sf_dir):
    return tb.documents(spark, sf_dir).select("doc_id", strip_newlines("text").alias("text"))


@register
def fact_extract(spark, sf_dir):
    c = tb.cases(spark, sf_dir)
    fx = extract_facts("content")
    return c.select("doc_id", fx["text"].alias("text"), fx["matched"].alias("matched"), fx["pattern"].alias("pattern"))


@register
def facts_with_validity(spark, sf_dir):
    return prepared(spark, sf_dir).select("doc_id", "basics_text", "is_valid", "fact_source", "fact_pattern")


@register
def filter_rejects(spark, sf_dir):
    return pr.filter_rejects(prepared(spark, sf_dir))


@register
def reject_sample(spark, sf_dir):
    return pr.reject_sample(prepared(spark, sf_dir), 100)


@register
def legal_base_normalize(spark, sf_dir):
    p = prepared(spark, sf_dir)
    return p.select("doc_id", F.array_join("legal_base", "|").alias("legal_base"),
                    F.size("legal_base").cast("int").alias("n_items"), "legal_base_rejected")


@register
def legal_base_rejects(spark, sf_dir):
    return pr.legal_base_rejects(prepared(spark, sf_dir)).select("doc_id", F.array_join("legal_base", "|").alias("legal_base"))


@register
def provenance(spark, sf_dir):
    return prepared(spark, sf_dir).select("doc_id", "id", "collection")


@register
def safe_cast(spark, sf_dir):
    c = tb.cases(spark, sf_dir)
    return pr.safe_cast(c).select("doc_id", "publish_date_raw", F.date_format("publish_date", "yyyy-MM-dd").alias("publish_date"))


@register
def attach_vector(spark, sf_dir):
    p = prepared(spark, sf_dir, with_vectors=True)
    vsum = F.aggregate("vector", F.lit(0.0).cast("double"), lambda a, x: a + x.cast("double"))
    return p.select("doc_id", F.col("vector").isNotNull().alias("has_vector"), F.size("vector").cast("int").alias("dims"),
                    F.round(vsum, 6).alias("vsum"))


@register
def prep_stats(spark, sf_dir):
    return pr.prep_stats(prepared(spark, sf_dir))


@register
def line_range(spark, sf_dir):
    docs = tb.read_table(spark, sf_dir, "documents")
    return sio.line_range(docs, P.LINE_START, 0).select(F.col("line_no"), "doc_id")


@register
def line_lookup(spark, sf_dir):
    docs = tb.read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return sio.line_lookup(docs, P.LINE_LOOKUP).select("line_no", "doc_id", "text")


# ---------------------------------------------------------------- analysis


@register
def tokenize(spark, sf_dir):
    t = an.tokens(tb.documents(spark, sf_dir))
    return t.select("doc_id", F.size("tokens").cast("int").alias("n_tokens"), F.array_join("tokens", " ").alias("tokens"))


@register
def postings(spark, sf_dir):
    p = an.postings(tb.documents(spark, sf_dir))
    return p.select("term", "doc_id", F.col("tf").cast("bigint"), F.array_join("positions", ",").alias("positions"), F.col("dl").cast("int"))


@register
def term_stats(spark, sf_dir):
    return an.term_stats(tb.documents(spark, sf_dir))


@register
def stopword_removal(spark, sf_dir):
    docs = tb.documents(spark, sf_dir)
    stop = an.corpus_stop_words(docs, max_df_ratio=P.STOP_DF_RATIO)
    t = an.remove_stop_words(an.tokens(docs), "tokens", stop)
    return t.select("doc_id", F.size("tokens").cast("int").alias("n_kept"))


@register
def sentence_split(spark, sf_dir):
    return an.sentences(tb.documents(spark, sf_dir))


@register
def bag_of_words(spark, sf_dir):
    b = an.bag_of_words(an.sentences(tb.documents(spark, sf_dir)))
    return b.select("doc_id", F.col("sent_idx").cast("int"), "term", F.col("tf").cast("bigint"))


# ---------------------------------------------------------------- vectors


def _explode_vec(df, key, col):
    return df.select(key, F.posexplode(col).alias("dim", "value")).select(key, F.col("dim").cast("int"), F.round("value", 6).alias("value"))


@register
def hash_encode(spark, sf_dir):
    return _explode_vec(vx.hash_encode(tb.documents(spark, sf_dir), "text", dims=P.DIMS), "doc_id", "vector")


@register(name="l2_normalize")
def l2_normalize_vectors(spark, sf_dir):
    e = tb.case_vectors(spark, sf_dir)
    n = e.withColumn("nv", l2_normalize("vector"))
    return n.select("doc_id", F.round(l2_norm("vector"), 6).alias("norm_before"), F.round(l2_norm("nv"), 6).alias("norm_after"),
                    F.round(F.get("nv", 0), 6).alias("v0"))


@register
def knn_query_prep(spark, sf_dir):
    bench = tb.read_table(spark, sf_dir, "benchmark")
    v = bench.select("item_id", vx.hash_vector(vx.query_text_prep(F.col("text")), P.DIMS).alias("v"))
    return _explode_vec(v, "item_id", "v")


def _knn_corpus(spark, sf_dir):
    return prepared(spark, sf_dir, with_vectors=True)


@register
def knn_search(spark, sf_dir):
    qv = vx.query_vector(spark, P.Q_KNN, dims=P.DIMS)
    return vx.knn_search(_knn_corpus(spark, sf_dir), qv, P.KNN_K)


@register
def knn_facets(spark, sf_dir):
    qv = vx.query_vector(spark, P.Q_KNN, dims=P.DIMS)
    hits = vx.knn_search(_knn_corpus(spark, sf_dir), qv, P.KNN_K, keep=FACET_KEEP)
    return fc.facets(hits, FACET_FIELDS)


def _bench_query_vectors(spark, sf_dir):
    bench = tb.read_table(spark, sf_dir, "benchmark")
    return bench.select(F.col("item_id").alias("qid"), vx.hash_vector(vx.query_text_prep(F.col("text")), P.DIMS).alias("qvec"))


@register
def knn_join(spark, sf_dir):
    return vx.knn_join(_bench_query_vectors(spark, sf_dir), tb.case_vectors(spark, sf_dir), P.KNN_JOIN_K)


@register
def knn_lsh(spark, sf_dir):
    return vx.knn_lsh(_bench_query_vectors(spark, sf_dir), tb.case_vectors(spark, sf_dir), P.KNN_JOIN_K) \
        .select("qid", "doc_id", "score", F.col("rank").cast("int"))


_BUILT: dict[tuple[str, str, str], str] = {}


def _built(spark, sf_dir, name, build):
    """Path of an index built once per application in the shared folder."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _BUILT:
        path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        build(path)
        _BUILT[key] = path
    return _BUILT[key]


@register
def knn_ivf(spark, sf_dir):
    path = _built(spark, sf_dir, "ivf", lambda at: iv.build(tb.case_vectors(spark, sf_dir), at))
    return iv.search(_bench_query_vectors(spark, sf_dir), path, P.KNN_JOIN_K, P.IVF_PROBE)


@register
def knn_ivf_exhaustive(spark, sf_dir):
    """All cells and all rows of the shortlist: the exact join."""
    path = _built(spark, sf_dir, "ivf", lambda at: iv.build(tb.case_vectors(spark, sf_dir), at))
    n = tb.case_vectors(spark, sf_dir).count()
    return iv.search(_bench_query_vectors(spark, sf_dir), path, P.KNN_JOIN_K, 1.0, n)


@register
def hybrid_rescore(spark, sf_dir):
    qv = vx.query_vector(spark, P.Q_KNN, dims=P.DIMS)
    return vx.hybrid_rescore(_or_hits(spark, sf_dir), tb.case_vectors(spark, sf_dir), qv)


@register
def vector_pairs(spark, sf_dir):
    v = tb.case_vectors(spark, sf_dir)
    nxt = v.select((F.col("doc_id") - 1).alias("doc_id"), "vector")
    return vx.vector_pairs(v, nxt)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(REGISTRY)


# ---------------------------------------------------------------- explanation

from ..operators import explain as xp  # noqa: E402


def explain_input(spark, sf_dir):
    """Pairs to explain: every benchmark passage with its best similar case (whole query
    table, whole texts): ``(pair_id, query_text, cand_text)``. The candidate's facts are
    prepared after the top-1 cut, on the chosen rows only."""
    bench = tb.read_table(spark, sf_dir, "benchmark")
    q = bench.select(F.col("item_id").alias("qid"), F.col("text").alias("qtext"))
    top = se.batch_keyword_search(prepared(spark, sf_dir), q, "qid", "qtext", "basics_text", 1)
    chosen = pr.prepare_cases(tb.cases(spark, sf_dir).join(top.select("doc_id", "qid"), "doc_id"))
    cand = chosen.select(F.col("qid").alias("pair_id"), F.col("basics_text").alias("cand_text"))
    return bench.select(F.col("item_id").alias("pair_id"), F.col("text").alias("query_text")).join(cand, "pair_id")


def case_pairs(spark, sf_dir, k):
    """Every benchmark passage with its ``k`` most similar cases: (pair_id, q_id, c_id, query_text, cand_text)."""
    bench = tb.read_table(spark, sf_dir, "benchmark")
    top = segmented_index(spark, sf_dir).search_table(bench, "item_id", F.col("text"), "basics_text", k)
    top = top.select("doc_id", F.col("qid").alias("q_id"), (F.col("qid") * 10 + F.col("rank")).alias("pair_id"))
    chosen = pr.prepare_cases(tb.cases(spark, sf_dir).join(top, "doc_id"))
    cand = chosen.select("pair_id", "q_id", F.col("doc_id").alias("c_id"), F.col("basics_text").alias("cand_text"))
    return cand.join(bench.select(F.col("item_id").alias("q_id"), F.col("text").alias("query_text")), "q_id")


def identity_input(spark, sf_dir):
    bench = tb.read_table(spark, sf_dir, "benchmark")
    return bench.select(F.col("item_id").alias("pair_id"), F.col("text").alias("query_text"), F.col("text").alias("cand_text"))


def _explained(spark, sf_dir, identity=False):
    pairs = identity_input(spark, sf_dir) if identity else explain_input(spark, sf_dir)
    return xp.explain_pairs(pairs)


@register
def textrank(spark, sf_dir):
    return _explained(spark, sf_dir).weights.withColumn("weight", F.round("weight", 6))


@register
def key_sentences(spark, sf_dir):
    return _explained(spark, sf_dir).keys.select("pair_id", "side", "sent_idx", "rank", "n_key")


@register
def joint_vocab(spark, sf_dir):
    return _explained(spark, sf_dir).joint_vocab


@register
def sentence_cosine(spark, sf_dir):
    return _explained(spark, sf_dir).cosines.withColumn("cos", F.round("cos", 6))


@register
def adaptive_threshold(spark, sf_dir):
    return _explained(spark, sf_dir).threshold.withColumn("threshold", F.round("threshold", 6))


@register
def matched_pairs(spark, sf_dir):
    return _explained(spark, sf_dir).matched.withColumn("score", F.round("score", 6))


@register
def explain_identical(spark, sf_dir):
    return _explained(spark, sf_dir, identity=True).matched.drop("score")


def _components_out(c):
    return c.select("pair_id", "comp_rank", F.array_join("q_idx", ",").alias("q_idx"), F.array_join("c_idx", ",").alias("c_idx"), "color")


@register
def explain_components(spark, sf_dir):
    return _components_out(_explained(spark, sf_dir).components)


@register
def case_graph_components(spark, sf_dir):
    pairs = case_pairs(spark, sf_dir, P.GRAPH_K).checkpoint()
    found = xp.explain_pairs(pairs.select("pair_id", "query_text", "cand_text"))
    return cp.case_components(found.matched, pairs)


@register
def sentence_links(spark, sf_dir):
    """Pairs of different sentences of all documents with cosine 0.8 or more."""
    return sj.links(an.sentences(tb.documents(spark, sf_dir)), P.LINK_COSINE).withColumn("cos", F.round("cos", 6))


@register
def explain_identical_components(spark, sf_dir):
    return _components_out(_explained(spark, sf_dir, identity=True).components)


@register
def explain_pairs(spark, sf_dir):
    """End to end: per pair, sentence counts of both sides, matches and components."""
    return _explained(spark, sf_dir).summary
