"""Components by contraction against union-find."""

import random

import pytest

from tessera.operators import components as cp


def brute(edges):
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            a, b = sorted((top(a), top(b)))
            up[b] = a
    return sorted((x, top(x)) for x in list(up))


def run(spark, edges, kind="long"):
    df = spark.createDataFrame(edges, f"x {kind}, y {kind}").repartition(4)
    return sorted(tuple(r) for r in cp.components(df, "x", "y").collect())


def shapes():
    rng = random.Random(5)
    yield [(i, i + 1) for i in range(200)]  # a chain
    yield [(i, i + 1) for i in rng.sample(range(200), 150)]
    yield [(0, i) for i in range(1, 150)] + [(500 + i, 999) for i in range(150)]  # hubs with small and large names
    yield [(rng.randrange(150), rng.randrange(150)) for _ in range(110)] + [(3, 3), (7, None), (None, None), (900, 900)]


@pytest.mark.parametrize("edges", list(shapes()))
def test_shapes(spark, edges):
    assert run(spark, edges) == brute(edges)


def test_strings_and_empty(spark):
    edges = [("b", "a"), ("c", "b"), ("z", "y"), ("é", "z")]
    assert run(spark, edges, "string") == brute(edges)
    assert run(spark, []) == []


def test_case_components(spark):
    matched = spark.createDataFrame([(1, 0, 4), (1, 1, 5), (2, 0, 9), (2, 2, 4), (3, 7, 7), (3, 7, 7)], "pair_id long, q_idx int, c_idx int")
    pairs = spark.createDataFrame([(1, 10, 77), (2, 11, 77), (3, 12, 78), (4, 13, 79)], "pair_id long, q_id long, c_id long")
    got = sorted(tuple(r) for r in cp.case_components(matched, pairs).collect())
    # sentence 4 of case 77 joins sentence 0 of query 10 and 2 of query 11
    assert got == [(10, 0, 0, 10, 0, 2, 1), (10, 0, 0, 11, 2, 2, 1), (10, 0, 1, 77, 4, 2, 1), (10, 1, 0, 10, 1, 1, 1), (10, 1, 1, 77, 5, 1, 1),
                   (11, 0, 0, 11, 0, 1, 1), (11, 0, 1, 77, 9, 1, 1), (12, 7, 0, 12, 7, 1, 1), (12, 7, 1, 78, 7, 1, 1)]
