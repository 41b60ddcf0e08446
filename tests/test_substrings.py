"""Trigram index against a plain scan."""

import random
import re

from pyspark.sql import functions as F

from tessera.operators import substrings as sub

SCHEMA = "doc_id long, content string"


def texts(n=300):
    rng = random.Random(3)
    alphabet = ["a", "b", "é", "字", "😀", "\n", ".", " ", "A"]
    return [(i, "".join(rng.choice(alphabet) for _ in range(rng.randrange(40)))) for i in range(n)] + [(900, None), (None, "aab"), (901, ""), (5, "aaba")]


def scan(rows, patterns):
    return sorted((p, d) for p, x in patterns if x for d, t in rows if d is not None and t is not None and x in t)


def test_every_length_of_pattern(spark, scratch):
    rows = texts()
    sub.build(spark.createDataFrame(rows, SCHEMA).repartition(3), scratch)
    rng = random.Random(4)
    patterns = [(1, "aaba"), (2, ""), (3, None), (4, "a"), (5, "字😀"), (6, "\n.a"), (7, "zzz"), (8, "zz"), (9, ".*"), (10, "a" * 60), (4, "aab")]
    for i in range(11, 60):
        t = rng.choice([t for _, t in rows if t and len(t) > 8])
        at = rng.randrange(len(t) - 5)
        patterns.append((i, t[at:at + rng.randrange(1, 8)]))
    got = sub.find_table(spark.createDataFrame(patterns, "id long, p string"), scratch, "id", "p")
    assert sorted(tuple(r) for r in got.collect()) == scan(rows, patterns)
    assert sorted(r.doc_id for r in sub.find(spark, scratch, "aab").collect()) == [d for _, d in scan(rows, [(0, "aab")])]


def test_many_keys_are_joined(spark, scratch, monkeypatch):
    monkeypatch.setattr(sub, "FEW", 1)
    rows = texts(150)
    sub.build(spark.createDataFrame(rows, SCHEMA), scratch)
    patterns = [(1, "aa"), (2, "ba"), (3, "aba"), (4, "a b"), (5, "é"), (6, "字")]
    got = sub.find_table(spark.createDataFrame(patterns, "id long, p string"), scratch, "id", F.col("p"))
    assert sorted(tuple(r) for r in got.collect()) == scan(rows, patterns)


def test_only_candidates_are_read(spark, scratch):
    rows = [(i, f"text number {i} of the corpus") for i in range(2_000)]
    sub.build(spark.createDataFrame(rows, SCHEMA).repartition(4), scratch)
    found = sub.find(spark, scratch, "number 1234 ")
    assert [r.doc_id for r in found.collect()] == [1234]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedFilters: \[[^\]]*(In|EqualTo)\(w,", plan) and "text" in plan


def test_empty(spark, scratch):
    sub.build(spark.createDataFrame([], SCHEMA), scratch)
    assert sub.find(spark, scratch, "abc").count() == 0 and sub.find(spark, scratch, "a").count() == 0
