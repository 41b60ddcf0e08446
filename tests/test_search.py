import pytest
from pyspark.sql import functions as F

from tessera.functions.text import tokenize
from tessera.operators import facets as fc
from tessera.operators import search as se
from tessera.operators import shape as sh
from tessera.plans import search_plan as sp
from tessera.operators import prep as pr
from tessera.sources import tables as tb

from conftest import SF01


def test_query_mode_golden():
    assert [se.query_mode(q) for q in ['"合同"', "“合同”", "合同", '"合同']] == ["phrase", "phrase", "match", "match"]
    with pytest.raises(ValueError):
        se.query_mode("")


def test_page_window_golden(spark):
    rows = [(3 * 25, 1), (9 * 25, 5), (9 * 25, 9), (9 * 25, 1), (9 * 25, 2), (0, 1)]
    df = spark.createDataFrame(rows, "total int, page int")
    got = [list(r.w) for r in df.select(sh.page_window(F.col("total"), F.col("page")).alias("w")).collect()]
    assert got == [[1, 2, 3], [3, 4, 5, 6, 7], [5, 6, 7, 8, 9], [1, 2, 3, 4, 5], [1, 2, 3, 4, 5], []]


def test_preview_and_followup(spark):
    df = spark.createDataFrame([(1, "x" * 400, "", "a\nb")], "doc_id int, long string, basics_text string, content string")
    r = df.select(F.length(sh.preview("long")).alias("n"), se.pseudo_facts(df).alias("q")).first()
    assert (r.n, r.q) == (300, "ab")


def test_tokenizer_latin_and_han(spark):
    r = spark.range(1).select(tokenize(F.lit("Héllo, World 42 合同法")).alias("t")).first()
    assert list(r.t) == ["héllo", "world", "42", "合", "同", "法"]


@pytest.fixture(scope="module")
def prepared(spark):
    return pr.prepare_cases(tb.cases(spark, SF01))


def test_phrase_subset_and_subset_or(spark, prepared):
    q = "of the"
    phrase = {r.doc_id for r in se.phrase_search(prepared, f'"{q}"', "content").collect()}
    both = {r.doc_id for r in se.keyword_search(prepared, q, "content", "and").collect()}
    anyt = {r.doc_id for r in se.keyword_search(prepared, q, "content", "or").collect()}
    assert phrase and phrase <= both <= anyt


def test_pages_concatenate(spark, prepared):
    hits = se.keyword_search(prepared, "lyon chen atst", "content")
    full = [r.doc_id for r in sh.search_page(hits, 0, 60).collect()]
    pages = [r.doc_id for p in range(3) for r in sh.search_page(hits, p * 20, 20).collect()]
    assert full == pages


def test_post_filter_leaves_facets(spark):
    cases = tb.cases(spark, SF01)
    req = sp.SearchRequest(query="lyon chen atst of")
    a = sp.search(cases, req, prepare=pr.prepare_cases, persist=False)
    b = sp.search(cases, sp.SearchRequest(query="lyon chen atst of", facets={"court_province": ["en"]}),
                  prepare=pr.prepare_cases, persist=False)
    assert sorted(map(tuple, a.facets.collect())) == sorted(map(tuple, b.facets.collect()))
    assert b.total.first().total < a.total.first().total
    assert all(r.doc_count <= 10000 for r in a.facets.collect())
    hits = a.hits.collect()
    assert len(hits) == 20 and any("<strong>" in h.content for h in hits)


def test_facet_blank_and_multivalue(spark):
    df = spark.createDataFrame([(1, 1.0, "", ["a", "a", "b"]), (2, 0.5, "x", ["a"]), (3, 0.1, "", None)],
                               "doc_id int, score double, trial_round string, legal_base array<string>")
    out = {(r.field, r.key): r.doc_count for r in fc.facets(df, ["trial_round", "legal_base"]).collect()}
    assert out == {("trial_round", "x"): 1, ("legal_base", "a"): 2, ("legal_base", "b"): 1}


def test_similar_cases_self_hit(spark, prepared):
    q = prepared.filter(F.col("doc_id").isin(3, 11))
    top = se.similar_cases(prepared, q, k=3).collect()
    assert {(3, 3), (11, 11)} <= {(r.qid, r.doc_id) for r in top}


def test_persisted_index_matches_scan_search(spark, scratch):
    from tessera.operators import index as ix
    from tessera.sources import tables as tb

    docs = tb.documents(spark, SF01).select("doc_id", F.col("text").alias("content"))
    docs = docs.unionByName(spark.createDataFrame([(100_000, "the the of the of the"), (100_001, ""), (100_002, None)], docs.schema))
    ix.build_index(docs, scratch, ["content"], partitions=5)

    def rounded(df):
        return sorted((r.doc_id, round(r.score, 6)) for r in df.collect())

    for q, mode in [("lyon chen of", "or"), ("the of lyon", "and"), ("xyzzy", "or"), ("!", "or")]:
        assert rounded(ix.indexed_keyword_search(spark, scratch, q, mode=mode)) == rounded(se.keyword_search(docs, q, "content", mode))
    for q in ['"of the"', '"the of the"', '"the the"', '"xyzzy the"']:
        assert rounded(ix.indexed_search(spark, scratch, q)) == rounded(se.phrase_search(docs, q, "content"))
    plan = ix.indexed_keyword_search(spark, scratch, "lyon chen")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(term" in plan

def test_maxscore_equals_exhaustive(spark, prepared):
    bench = spark.read.parquet(SF01 + "/benchmark.parquet")
    q = bench.select(F.col("item_id").alias("qid"), F.col("text").alias("qtext"))
    want = sorted(map(tuple, se.batch_keyword_search(prepared, q, "qid", "qtext", k=5, exhaustive=True).collect()))
    assert len(want) > 0
    # 0: only each query's rarest term in the first pass; 1: every term is rare
    for ratio in (0.0, 0.002, 0.01, 1.0):
        got = sorted(map(tuple, se.batch_keyword_search(prepared, q, "qid", "qtext", k=5, rare_ratio=ratio).collect()))
        assert got == want, ratio


def test_maxscore_hot_term_fixture(spark):
    # one term in a third of all documents, queries mixing it with rare terms and with nothing else
    rows = []
    for i in range(600):
        words = [f"w{i % 97}", f"v{i % 13}", f"u{i}"]
        if i % 3 == 0:
            words += ["hot"] * (1 + i % 4)
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, basics_text string")
    qs = spark.createDataFrame([(1, "hot w5 u17"), (2, "hot"), (3, "hot hot v3 w40"), (4, "u599 w1"), (5, "zzz")],
                               "qid int, qtext string")
    want = sorted(map(tuple, se.batch_keyword_search(docs, qs, "qid", "qtext", k=7, exhaustive=True).collect()))
    got = sorted(map(tuple, se.batch_keyword_search(docs, qs, "qid", "qtext", k=7).collect()))
    assert got == want and {r[0] for r in want} == {1, 2, 3, 4}
