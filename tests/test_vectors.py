import numpy as np
from pyspark.sql import functions as F

from tessera.functions.vectors import l2_norm, l2_normalize
from tessera.operators import vectors as vx
from tessera.sources import tables as tb

from conftest import SF01


def test_normalize_golden(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>")
    got = [list(r.n) for r in df.select(l2_normalize("v").alias("n")).collect()]
    assert np.allclose(got[0], [0.6, 0.8]) and got[1] == [0.0, 0.0]


def test_hash_vectors_unit_norm(spark):
    docs = tb.documents(spark, SF01)
    norms = [r.n for r in vx.hash_encode(docs, "text").select(l2_norm("vector").alias("n")).collect()]
    assert all(abs(n - 1.0) < 1e-9 for n in norms)


def test_knn_join_one_query_equals_knn_search(spark):
    corpus = tb.case_vectors(spark, SF01)
    qv = vx.query_vector(spark, "the treaty of lyon")
    q = spark.createDataFrame([(7, qv)], "qid int, qvec array<double>")
    a = [(r.doc_id, r.score) for r in vx.knn_join(q, corpus, 10).orderBy("rank").collect()]
    b = [(r.doc_id, r.score) for r in vx.knn_search(corpus, qv, 10).collect()]
    assert a == b
    # several query blocks give the same answer as one
    qs = vx.hash_encode(tb.documents(spark, SF01).limit(30), "text").select(F.col("doc_id").alias("qid"), F.col("vector").alias("qvec"))
    one = sorted(map(tuple, vx.knn_join(qs, corpus, 5).collect()))
    many = sorted(map(tuple, vx.knn_join(qs, corpus, 5, block_bytes=2000).collect()))
    assert one == many and len(one) == 150


def test_knn_join_ties_emit_k_rows_per_block(spark):
    vec = [0.6, 0.8]
    corpus = spark.createDataFrame([(i, vec) for i in range(3000)] + [(5000 + i, [1.0, 0.0]) for i in range(10)], "doc_id long, vector array<double>")
    q = spark.createDataFrame([(1, [0.0, 0.0]), (2, vec), (3, [-1.0, 0.0])], "qid int, qvec array<double>")
    got = sorted(map(tuple, vx.knn_join(q, corpus, 4, block_bytes=20_000).collect()))
    assert got == [(1, i, 0.0, i + 1) for i in range(4)] + [(2, i, 1.0, i + 1) for i in range(4)] + [(3, i, -0.6, i + 1) for i in range(4)]
    empty = corpus.limit(0)
    assert vx.knn_join(q, empty, 4).collect() == [] and vx.knn_join(q.limit(0), corpus, 4).collect() == []


def test_knn_lsh_prunes_and_finds(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(600, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    near = base[:60] + rng.normal(scale=0.03, size=(60, 64))
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(base)], "doc_id long, vector array<double>")
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(near)], "qid long, qvec array<double>")
    exact = {(r.qid, r.doc_id) for r in vx.knn_join(q, corpus, 1).collect()}
    approx = {(r.qid, r.doc_id) for r in vx.knn_lsh(q, corpus, 1).collect()}
    met = vx.lsh_candidates(q.withColumnRenamed("qvec", "qv"), corpus.withColumnRenamed("vector", "v"), 64, 12, 8, 2).count()
    assert len(exact & approx) / len(exact) >= 0.8 and met < 60 * 600 / 5


def test_knn_lsh_recall_on_registered_tables(spark):
    from tessera.plans import queries

    exact = {(r.qid, r.doc_id) for r in queries.knn_join(spark, SF01).collect()}
    approx = {(r.qid, r.doc_id) for r in queries.knn_lsh(spark, SF01).collect()}
    assert len(exact) == 10 * len({q for q, _ in exact}) and len(exact & approx) / len(exact) >= 0.9


def test_lsh_pairs_carry_no_vectors(spark):
    """Pairs are shuffled as ids and a score; of rows that repeat an id the best counts, whatever their order."""
    near, nearer, other = [0.8, 0.6, 0.0], [1.0, 0.0, 0.0], [0.6, 0.8, 0.0]
    corpus = spark.createDataFrame([(1, near), (1, nearer), (1, near), (2, other), (None, other), (None, near)], "doc_id long, v array<double>")
    q = spark.createDataFrame([(7, nearer), (7, nearer)], "qid long, qv array<double>")
    for rows in (corpus, corpus.orderBy(F.desc("v"))):
        met = vx.lsh_candidates(q, rows, 3, 12, 2, 3)
        assert sorted(map(tuple, met.collect()), key=str) == [(7, 1, 1.0), (7, 2, 0.6), (7, None, 0.8)]
    above = met._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
    assert "first(" not in above and [f for f, t in met.dtypes if t.startswith("array")] == []


def test_metric_of_a_model(spark):
    from pyspark.sql import functions as F

    encoder = lambda c: F.array(F.lit(3.0), F.lit(4.0))
    assert np.allclose(vx.query_vector(spark, "x", encoder), [0.6, 0.8]) and vx.query_vector(spark, "x", encoder, metric="l2") == [3.0, 4.0]


def test_model_encoder_plugin(spark):
    dims = 8

    def make_predict():
        def predict(texts):
            out = np.zeros((len(texts), dims), dtype=np.float32)
            for i, t in enumerate(texts):
                out[i, len(t) % dims] = 1.0
            return out
        return predict

    enc = vx.model_encoder(make_predict, dims, batch_size=4)
    df = spark.createDataFrame([(i, "x" * i) for i in range(10)], "doc_id int, t string")
    rows = df.select("doc_id", enc(F.col("t")).alias("v")).orderBy("doc_id").collect()
    assert all(list(r.v).index(1.0) == r.doc_id % dims for r in rows)


def test_hybrid_rescore_missing_vector_scores_zero(spark):
    hits = spark.createDataFrame([(1,), (2,)], "doc_id long")
    vecs = spark.createDataFrame([(1, [1.0, 0.0])], "doc_id long, vector array<double>")
    out = {r.doc_id: r.score for r in vx.hybrid_rescore(hits, vecs, [0.5, 0.5]).collect()}
    assert out == {1: 1.5, 2: 0.0}


def test_knn_join_large_scores_ties_and_odd_vectors(spark):
    nan = float("nan")
    corpus = [(i, [float(i % 3), 0.0]) for i in range(2_500)] + [(5_000, [7e5, 1.0]), (5_001, [7e5 + 1, 1.0]), (5_002, [-7e5, 0.0]), (5_003, [1e12, 0.0]), (5_004, [1e12 + 1, 0.0]),
              (5_005, None), (5_006, [nan, 1.0]), (5_007, [1.0]), (5_008, [1.0, None]), (5_009, [1.0, 2.0, 3.0]), (5_010, [])]
    queries = [(1, [1.0, 0.0]), (2, [1e3, 0.0]), (3, [-1.0, 0.0]), (4, [nan, 0.0]), (5, [1.0]), (6, None)]
    got = vx.knn_join(spark.createDataFrame(queries, "qid long, qvec array<double>"), spark.createDataFrame(corpus, "doc_id long, vector array<double>").repartition(5), 9)
    rows = sorted((r.qid, r["rank"], r.doc_id, r.score) for r in got.collect())
    fine = [(d, v) for d, v in corpus if v and len(v) == 2 and None not in v and v[0] == v[0]]
    want = []
    for q, w in queries[:3]:
        scored = sorted((-round(w[0] * v[0] + w[1] * v[1], 6), d) for d, v in fine)[:9]
        want += [(q, n + 1, d, -s) for n, (s, d) in enumerate(scored)]
    assert rows == want
