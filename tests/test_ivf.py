"""Inverted-file neighbours against the exact join."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import ivf
from tessera.operators import vectors as vx
from tessera.plans import queries as qs
from tessera.sources import tables as tb

SF1 = "/root/testdata/sf0.1"


def listed(df):
    return sorted((r.qid, r["rank"], r.doc_id, r.score) for r in df.collect())


def recall(found, exact, k):
    """Share of the exact neighbours found, ties at the last place counting alike."""
    want = {}
    for q, rank, d, s in listed(exact):
        want.setdefault(q, []).append(s)
    got = sum(s >= want[q][-1] for q, rank, d, s in listed(found))
    return got / sum(min(k, len(w)) for w in want.values())


def figures(spark, queries, corpus, path, probe, k=10):
    model = ivf.build(corpus, path)
    found = ivf.search(queries, path, k, probe)
    q = np.array([r.qvec for r in queries.collect()], float)
    shares = np.array([ivf.share_compared(model, v, probe, 16 * k) for v in q]).mean(0)
    return recall(found, vx.knn_join(queries, corpus, k), k), *shares


def test_registered_vectors_recall_and_pairs(spark, scratch):
    """Directions without near neighbours: most codes are read, a twelfth of the vectors."""
    queries, corpus = qs._bench_query_vectors(spark, SF1), tb.case_vectors(spark, SF1)
    found, coded, compared = figures(spark, queries, corpus, scratch, qs.P.IVF_PROBE)
    assert found >= 0.9 and compared <= 0.1 and coded <= 0.85, (found, coded, compared)


def test_text_vectors_recall_and_pairs(spark, scratch):
    """Vectors of texts, queries every 50th: a third of the codes, a fiftieth of the vectors."""
    corpus = vx.hash_encode(tb.documents(spark, SF1), "text").checkpoint()
    queries = corpus.filter(F.col("doc_id") % 50 == 0).select(F.col("doc_id").alias("qid"), F.col("vector").alias("qvec"))
    found, coded, compared = figures(spark, queries, corpus, scratch, 0.35)
    assert found >= 0.9 and compared <= 0.02 and coded <= 0.45, (found, coded, compared)


def frame(spark, rows, kind="double"):
    return spark.createDataFrame(rows, f"doc_id long, vector array<{kind}>").repartition(3)


def test_all_cells_and_rows_are_exact(spark, scratch):
    rng = np.random.default_rng(1)
    corpus = frame(spark, [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(300, 7)))], "float")
    queries = corpus.filter("doc_id % 10 = 0").select(F.concat(F.lit("q"), "doc_id").alias("qid"), F.col("vector").alias("qvec"))
    ivf.build(corpus, scratch, cells=12)
    assert listed(ivf.search(queries, scratch, 5, 1.0, 300)) == listed(vx.knn_join(queries, corpus, 5))


def test_copies_spread_over_parts(spark, scratch, monkeypatch):
    monkeypatch.setattr(ivf, "PART_BYTES", 8 * 4 * 16)  # 16 rows a part
    corpus = frame(spark, [(i, [1.0, 0.0, 0.5, 0.25]) for i in range(200)] + [(i, [0.0, 1.0, i / 400, 0.0]) for i in range(200, 300)])
    queries = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0]), (2, [0.0, 1.0, 1.0, 0.0])], "qid long, qvec array<double>")
    model = ivf.build(corpus, scratch, cells=8)
    assert model.parts().max() >= 200 // 16 and model.sizes.sum() == 300
    got = listed(ivf.search(queries, scratch, 3, 1.0, 300))
    assert got == listed(vx.knn_join(queries, corpus, 3)) and [g[2] for g in got if g[0] == 1] == [0, 1, 2]


def test_rows_left_out_and_empty(spark, scratch):
    nan = float("nan")
    corpus = frame(spark, [(1, [1.0, 0.0]), (2, None), (3, [nan, 1.0]), (4, [1.0]), (5, [None, 1.0]), (6, [0.0, 1.0]), (7, [])])
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0]), (3, None)], "qid long, qvec array<double>")
    ivf.build(corpus, scratch)
    assert listed(ivf.search(queries, scratch, 5, 1.0)) == [(1, 1, 1, 1.0), (1, 2, 6, 0.0)]
    ivf.build(frame(spark, []), scratch + "/none")
    assert ivf.search(queries, scratch + "/none").count() == 0


@pytest.mark.parametrize("probe", [0.1, 0.6])
def test_visited_cells(probe):
    model = ivf.Model(np.array([[1.0, 0], [0, 1.0], [-1.0, 0]]), [], np.array([10, 30, 60]), 2)
    assert model.visited(np.array([0.2, 0.9]), probe).tolist() == ([1] if probe == 0.1 else [1, 0, 2])
