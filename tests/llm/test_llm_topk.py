"""Exact top-k against brute force."""

import math

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import topk


def brute(rows, k, every):
    ok = [(i, [math.floor(256 * float(x)) if abs(x) < 1e15 else int(x) * 256 for x in v]) for i, v in rows
          if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    asked = {}
    for i, v in ok:
        if i % every == 0:
            asked[i] = min(asked.get(i, v), v)
    for q, w in asked.items():
        scored = sorted((-max(-topk.LONG, min(topk.LONG, sum(a * b for a, b in zip(w, v)))), i) for i, v in ok if i != q)
        out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])}
    return out


def run(spark, rows, k=5, every=5, kind="double"):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").withColumn("score", F.lit("x")).repartition(3)
    return {tuple(r) for r in topk.search(df, F.pmod("vec_id", F.lit(every)) == 0, k).collect()}


def test_random_ties_and_signs(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.integers(-3, 4, 6) / 4).tolist()) for i in range(150)]
    assert run(spark, rows) == brute(rows, 5, 5)


def test_many_copies_resolve_by_id(spark):
    rows = [(i, [0.5, -0.25]) for i in range(60)] + [(i, [0.0, 0.0]) for i in range(60, 80)]
    assert run(spark, rows) == brute(rows, 5, 5)


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, None), (2, []), (3, [None, 1.0]), (4, [nan, 1.0]), (5, [inf, 0.0]), (6, [3.0, -1.0]), (None, [1.0, 1.0]),
            (10, [-1.0]), (11, [1e9, 0.0]), (12, [0.0, 0.0]), (10, [-2.0]), (12, [0.0, 0.0]), (-5, [1.0, 1.0])]
    assert run(spark, rows) == brute(rows, 5, 5)


def test_fewer_rows_than_k_and_empty(spark):
    assert run(spark, [(0, [1.0]), (1, [2.0])]) == {(0, 1, 1, 256 * 512)}
    assert run(spark, [(0, [1.0])]) == set()
    assert run(spark, []) == set()


def test_block_boundaries(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 16)
    monkeypatch.setattr(topk, "QUERIES", 4)
    monkeypatch.setattr(topk, "COLUMN", 64)
    monkeypatch.setattr(topk, "LINE", 8)
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=5).tolist()) for i in range(300)]
    assert run(spark, rows) == brute(rows, 5, 5)


def test_large_components_score_exactly(spark, monkeypatch):
    rows = [(0, [1.0, 2.0]), (1, [70000.0, 0.0]), (2, [0.5, 0.5]), (5, [-70000.0, 3.0, 1.0]), (6, [1e9, -1e9]), (7, [65536.0, 65536.0]), (8, [65535.99, 1.0]),
            (10, [3e8, 1.0]), (11, [1e300, 1.0]), (12, [-1e300]), (15, [1e300, -1e300]), (16, [2.0 ** 40, 2.0 ** 41]), (0, [1.0, 70000.0])]
    assert (0, 1, 11, topk.LONG) in run(spark, rows)
    assert run(spark, rows) == brute(rows, 5, 5)
    monkeypatch.setattr(topk, "LARGEST", 64)  # most rows far, a few not
    rng = np.random.default_rng(7)
    rows = [(i, (rng.normal(size=4) * 10.0 ** rng.integers(-2, 4)).tolist()) for i in range(200)]
    assert run(spark, rows) == brute(rows, 5, 5)
