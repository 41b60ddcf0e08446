"""Mixing: targets by simulation, budgets to the word."""

import math
import re

import pytest

from tessera.llm import mixing


def shares(sizes):
    """Targets by resharing the excess round after round; sizes in source order."""
    weights = [mixing.WEIGHTS[i % 3] for i in range(len(sizes))]
    total, fixed = 1.5 * sum(sizes), {}
    while True:
        free = [i for i in range(len(sizes)) if i not in fixed]
        left = total - sum(fixed.values())
        now = {i: left * weights[i] / sum(weights[j] for j in free) for i in free}
        over = {i: 2.0 * sizes[i] for i in free if now[i] > 2 * sizes[i] + 1e-9}
        if not over:
            return [fixed.get(i, now.get(i)) for i in range(len(sizes))]
        fixed |= over


@pytest.mark.parametrize("per", [[40, 3, 900, 12], [5, 5, 5], [1, 10_000, 1, 1, 1, 1], [7]])
def test_targets_and_exact_budgets(spark, per, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE", 8)
    rows, n = [], 0
    for s, words in enumerate(per):
        while words > 0:
            size = min(words, 1 + n % 9)
            rows.append((n, " ".join("w" * size), f"s{s:02d}", "t"))
            n, words = n + 1, words - size
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, taken string").repartition(4)
    got = {r["doc_id"]: r for r in mixing.mix(df).collect()}
    assert len(got) == len(rows)
    for s, target in enumerate(shares(per)):
        mine = [got[i] for i, _, source, _ in rows if source == f"s{s:02d}"]
        assert mine[0]["target"] == pytest.approx(target) and sum(r["taken"] for r in mine) == math.floor(mine[0]["target"])
        assert all(0 <= r["taken"] <= 2 * r["size"] for r in mine) and sum(r["size"] for r in mine) == per[s] == mine[0]["source_size"]
    again = {r["doc_id"]: r for r in mixing.mix(df.repartition(2)).collect()}
    assert again == got


def test_edge_cases(spark):
    rows = [(1, None, "a"), (2, "", None), (3, "x\x0by  z\t", None), (3, "x y z", None), (None, "p q", "a"), (5, " é ", "b"), (6, "w " * 5000, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    assert sorted(r["size"] for r in got) == sorted(len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows)
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    assert mixing.mix(df.limit(0)).collect() == []
    empty = mixing.mix(spark.createDataFrame([(1, "", "a"), (2, None, "b")], "doc_id long, text string, source string")).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in empty] == [(0, 0.0, 0)] * 2


def test_hot_id_spreads_over_ranges(spark, monkeypatch):
    """A third of all rows with one id: its ranges hold RANGE rows each, the budget stays exact."""
    monkeypatch.setattr(mixing, "RANGE", 16)
    seen = []
    real = mixing.bucketed_prefix
    monkeypatch.setattr(mixing, "bucketed_prefix", lambda df, groups, bucket, *a: (seen.append(df.groupBy(*groups, bucket).count().agg({"count": "max"}).first()[0]), real(df, groups, bucket, *a))[1])
    rows = [(7, "w " * (i % 3 + 1), "a") for i in range(300)] + [(None, "x y", "a") for i in range(100)] + [(i, "p q r", "b") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    got = mixing.mix(df).collect()
    assert seen[0] <= 16
    for s in ("a", "b"):
        size = sum(len(t.split()) for _, t, source in rows if source == s)
        mine = [r for r in got if r["source_size"] == size]
        assert sum(r["taken"] for r in mine) == math.floor(mine[0]["target"])
    key = lambda rs: sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["taken"]) for r in rs)
    assert key(got) == key(mixing.mix(df.repartition(2)).collect())
