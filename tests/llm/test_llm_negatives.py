"""Hard negatives against brute force."""

import math

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import negatives

LONG = (1 << 63) - 1


def brute(rows, positives=5, negatives_=3):
    ok = [(i, lab, [math.floor(256 * x) if abs(x) < 1e15 else int(x) * 256 for x in v]) for i, lab, v in rows
          if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    ok = [(i, (lab + 1) % 10 if i % 7 == 0 else lab, v) for i, lab, v in ok]
    out = []
    for n, (a, lab, w) in enumerate(ok):
        if a % 50:
            continue
        scored = [(-max(-LONG, min(LONG, sum(x * y for x, y in zip(w, v)))), i, other) for k, (i, other, v) in enumerate(ok) if k != n]
        for minus, p, _ in sorted(s for s in scored if s[2] == lab)[:positives]:
            ps = -minus
            hard = sorted((s, i) for s, i, other in scored if other != lab and 50 * ps <= 100 * -s <= 95 * ps)
            out += [(a, p, r + 1, i, ps, -s) for r, (s, i) in enumerate(hard[:negatives_])]
    return sorted(out)


def run(spark, rows, kind="double"):
    df = spark.createDataFrame(rows, f"vec_id long, label int, embedding array<{kind}>")
    df = df.withColumn("key", F.lit("x")).withColumn("score", F.lit(0)).withColumn("asks", F.lit(1)).repartition(3)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return sorted(tuple(r) for r in negatives.mine(df, label, F.pmod("vec_id", F.lit(50)) == 0).collect())


def clustered(seed, n=500, dims=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dims))
    return [(i, int(rng.integers(0, 4)), (centres[i % 6] + 0.4 * rng.normal(size=dims)).tolist()) for i in range(n)]


def test_brute_force(spark):
    rows = clustered(1)
    want = brute(rows)
    assert want and run(spark, rows) == want


def test_small_cells_and_waves(spark, monkeypatch):
    monkeypatch.setattr(negatives, "COLUMN", 40)
    monkeypatch.setattr(negatives, "LINE", 3)
    monkeypatch.setattr(negatives, "WAVE", 4)
    rows = clustered(2, n=300, dims=5)
    assert run(spark, rows) == brute(rows)


def test_copies_and_ties(spark):
    rows = [(i, i % 3, [0.5, -0.25, 0.125]) for i in range(120)] + [(i, i % 2, [0.25, -0.125, 0.0]) for i in range(120, 160)]
    rows += [(50, 1, [0.5, -0.25, 0.125]), (50, 1, [1.0, 0.0, 0.0]), (3, 2, [0.25, 0.0, 0.0])]
    assert run(spark, rows) == brute(rows)


def test_rows_that_take_no_part_and_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [1.0, 2.0, 0.0]), (50, 1, [70000.0, -1.0]), (100, 2, []), (150, 1, [1e9, 3.0]), (200, 2, [1e300, -1e300]), (1, 1, None), (2, None, [1.0]),
            (3, 1, [None, 1.0]), (4, 1, [nan]), (5, 1, [inf, 0.0]), (None, 1, [1.0, 1.0]), (6, 1, [0.5, 1.5, 2.5, 9.0]), (8, 2, [0.4, 1.0]), (9, 2, [40000.0]),
            (10, 1, [0.9, 1.9]), (11, 3, [7e8, 0.0]), (12, 2, [-1.0]), (13, 1, [-1.0, -2.0]), (15, 4, [0.6, 1.3]), (250, 2, [-3.0, 0.5])]
    assert run(spark, rows) == brute(rows)


def test_empty(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, 1, [1.0])]) == [] and run(spark, [(50, 1, [1.0])]) == [] and run(spark, [(50, 1, [1.0]), (51, 2, [0.7])]) == []


def test_walk_stops_early_and_finds_all(monkeypatch):
    monkeypatch.setattr(negatives, "WAVE", 64)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 6)) * 400
    x = np.floor(np.concatenate([c + rng.normal(size=(400, 6)) * 12 for c in centres]))
    index = negatives.MultiIndex(x, negatives.fit(x[::7]))
    ids = rng.permutation(len(x))
    read = 0
    for n in range(0, len(x), 300):
        w, allowed = x[n], np.ones(len(x), bool)
        scores = (index.x @ w).astype(np.int64)
        windows = [(-LONG, LONG), (int(scores.max()) // 2, int(scores.max() * 0.95)), (5, 4)]
        best, seen = negatives.walk(index, w, allowed, ids, windows, 3)
        read += seen
        for (low, high), (s, r) in zip(windows, best):
            inside = np.flatnonzero((scores >= low) & (scores <= high))
            want = inside[np.lexsort((ids[inside], -scores[inside]))[:3]]
            assert (r == want).all() and (s == scores[want]).all()
    assert read < 0.6 * 16 * len(x)  # the heap leaves a good part of the cells unread
