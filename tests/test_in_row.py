"""Postings, bags and blocks made inside rows and tasks, and blocked products, against plain Python."""

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.operators import analysis as an
from tessera.operators import blocks as bl
from tessera.operators import index as ix
from tessera.operators import products as pd
from tessera.operators import search as se
from tessera.operators import segments as sg

SCHEMA = "doc_id long, text string"
ROWS = [(1, "b a b. a"), (2, "a"), (2, "b a"), (None, "a a"), (None, "c"), (3, None), (4, "")]


def wanted_postings(rows):
    out, length = defaultdict(list), {}
    for doc, text in rows:
        words = (text or "").replace(".", "").split()
        for i, w in enumerate(words):
            out[w, doc].append(i)
    return sorted(((w, -1 if d is None else d, len(p), sorted(p)) for (w, d), p in out.items()))


@pytest.mark.parametrize("few", [0, 100])
def test_postings_of_repeated_and_null_ids(spark, monkeypatch, few):
    monkeypatch.setattr(an, "FEW_KEYS", few)
    got = an.postings(spark.createDataFrame(ROWS, SCHEMA)).collect()
    assert sorted((r["term"], -1 if r["doc_id"] is None else r["doc_id"], r["tf"], r["positions"]) for r in got) == wanted_postings(ROWS)
    assert {r["dl"] for r in got if r["doc_id"] == 1} == {4}


def test_rows_of_their_own_key_are_not_shuffled(spark):
    docs = spark.createDataFrame([r for r in ROWS if r[0] in (1, 3, 4)], SCHEMA)
    for made in (an.postings(docs), an.bag_of_words(an.sentences(docs))):
        assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()


def test_bags_of_repeated_sentences(spark):
    got = an.bag_of_words(an.sentences(spark.createDataFrame(ROWS, SCHEMA))).collect()
    assert sorted((-1 if r[0] is None else r[0], r[1], r[2], r[3]) for r in got) == [
        (-1, 0, "a", 2), (-1, 0, "c", 1), (1, 0, "a", 1), (1, 0, "b", 2), (1, 1, "a", 1), (2, 0, "a", 2), (2, 0, "b", 1)]


def test_index_has_one_shuffle_less_and_counts_repeated_ids_once(spark, scratch):
    docs = spark.createDataFrame(ROWS, SCHEMA).withColumnRenamed("text", "content")
    ix.build_index(docs, scratch, ["content"])
    assert ix.stored_stats(spark, scratch, "content", ["a", "b", "zz"]) == se.CorpusStats(3, spark.read.parquet(f"{scratch}/content/stats").first()["total_len"], {"a": 3, "b": 2, "zz": 0})


@pytest.mark.parametrize("tokens", [1, 37, 10**6])
def test_window_blocks(spark, monkeypatch, tokens):
    """Windows that go on in the next batch, empty documents and pairs."""
    rng, words = random.Random(5), ["the", "of", "x", "y", "z"]
    rows = [(m >> 2, m & 3, 100 + m, [rng.choice(words) for _ in range(rng.randrange(0, 7))]) for m in range(50)]
    schema = pa.schema([("w", pa.int64()), ("bit", pa.int32()), ("doc_id", pa.int64()), ("t", pa.list_(pa.string()))])
    table = pa.Table.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
    docs = spark.createDataFrame(rows, "w long, bit int, doc_id long, t array<string>").coalesce(1)
    monkeypatch.setattr(bl, "TOKENS", tokens)
    want, pairs = defaultdict(dict), defaultdict(dict)
    for w, bit, doc, t in rows:
        for i, x in enumerate(t):
            want[x, w].setdefault((doc, len(t), bit), []).append(i)
        for i, (x, y) in enumerate(zip(t, t[1:])):
            if {x, y} <= {"the", "of"}:
                pairs[f"{x} {y}", w].setdefault((doc, len(t), bit), []).append(i)
    for common, expected in ((None, want), (["the", "of"], pairs)):
        listed = bl.blocks(docs, common).collect()
        got = {(r["term"], r["w"]): {(d["doc_id"], d["dl"], d["bit"]): p for d, p in zip(r["docs"], r["positions"])} for r in listed}
        assert got == expected and len(listed) == len(expected)
        assert all(d["tf"] == len(p) for r in listed for d, p in zip(r["docs"], r["positions"]))
    assert bl.window_blocks(table.slice(0, 0)).num_rows == 0


@pytest.mark.parametrize("long", [0, 1 << 30])
def test_impacts_come_with_the_blocks(spark, long):
    """Those of ``segments._impacts``, which ran row by row behind the blocks, also where lengths need a wide key."""
    rng, words = np.random.default_rng(8), ["the", "of", "x", "y", "z"]
    rows = [(m >> 6, m & 63, m, [words[int(i)] for i in rng.geometric(0.5, int(rng.integers(0, 30))) % 5]) for m in range(400)]
    made = bl.blocks(spark.createDataFrame(rows, "w long, bit int, doc_id long, t array<string>").coalesce(1))
    listed = made.withColumn("want", sg._impacts(F.col("docs"))).collect()
    assert any(len(r["want"]) > 2 for r in listed) and [r["impacts"] for r in listed] == [r["want"] for r in listed]
    block = np.repeat(np.arange(20), 50)
    tf, dl = rng.integers(1, 9, 1000), rng.integers(9, 40, 1000) + long
    best, held = bl._impacts(block, tf, dl)
    for b in range(20):
        left = 1 << 40
        want = [(t, d) for t, d in sorted(zip(tf[block == b], dl[block == b]), key=lambda x: (-x[0], x[1])) if d < left and (left := d)]
        assert [(tf[i], dl[i]) for i in best[held == b]] == want


def test_block_product_against_numpy(spark, monkeypatch):
    """Several blocks, dense and rare terms, repeated postings, ties and terms that one side lacks."""
    monkeypatch.setattr(pd, "LEAST_POSTINGS", 200)
    monkeypatch.setattr(pd, "ASKED", 60)
    rng = np.random.default_rng(3)
    weights = [(int(q), f"t{t}", float(rng.integers(1, 4))) for q in range(40) for t in rng.choice(30, 5, replace=False)] + [(99, "absent", 1.0)]
    posts = [(f"t{t}", int(d), float(rng.integers(1, 3))) for d in range(120) for t in rng.choice(40, 8, replace=False)] + [("t1", 7, 2.0), ("t1", None, 1.0)]
    score = defaultdict(float)
    for q, t, w in weights:
        for u, d, v in posts:
            if t == u:
                score[q, -1 if d is None else d] += w * v
    want = sorted((q, d, s) for q in range(40) for d, s in sorted(((d, s) for (p, d), s in score.items() if p == q), key=lambda x: (-x[1], x[0]))[:4])
    asked = spark.createDataFrame(weights, "qid long, term string, weight double")
    best = se._rank(pd.block_product(asked, spark.createDataFrame(posts, "term string, doc_id long, v double"), 4), 4)
    assert sorted((r["qid"], -1 if r["doc_id"] is None else r["doc_id"], r["score"]) for r in best.collect()) == want


def test_blocks_of_a_product_are_stored_once(spark, monkeypatch):
    """Neither side is repeated for the blocks of the other: nothing is shuffled behind the packed blocks."""
    monkeypatch.setattr(pd, "LEAST_POSTINGS", 20)
    monkeypatch.setattr(pd, "ASKED", 10)
    asked = spark.createDataFrame([(q, f"t{q % 7}", 1.0) for q in range(50)], "qid long, term string, weight double")
    posts = spark.createDataFrame([(f"t{d % 7}", d, 1.0) for d in range(200)], "term string, doc_id long, v double")
    best = pd.block_product(asked, posts, 3)
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan and "Generate" not in plan
    assert pd._packed(posts, "doc_id", 10).count() <= 10 and best.count() >= 150


def test_all_blocks_meet_whatever_the_partitions(spark, monkeypatch):
    """Blocks were dealt by an int on one side and a bigint on the other, so those of several partitions missed each other."""
    monkeypatch.setattr(pd, "LEAST_POSTINGS", 20)
    monkeypatch.setattr(pd, "ASKED", 10)
    asked = spark.createDataFrame([(q, "t", 1.0) for q in range(30)], "qid long, term string, weight double")
    posts = spark.createDataFrame([("t", d, float(d)) for d in range(1, 200)], "term string, doc_id long, v double")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = se._rank(pd.block_product(asked, posts, 2), 2).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sorted((r["qid"], r["doc_id"]) for r in got) == [(q, d) for q in range(30) for d in (198, 199)]


def test_many_queries_by_blocks(spark, scratch, monkeypatch):
    """The scan and the segmented index answer a large table of queries by the product."""
    rng = random.Random(2)
    rows = [(i, "k", " ".join(rng.choice(["the", "of", *[f"w{j}" for j in range(60)]]) for _ in range(rng.randrange(0, 30)))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, collection string, content string")
    asked = docs.where("doc_id % 5 = 0")
    want = sorted(map(tuple, se.batch_keyword_search(docs, asked, "doc_id", F.col("content"), "content", 5, exhaustive=True).collect()))
    for module in (se, sg):
        monkeypatch.setattr(module, "MANY_ASKED", 1)
    assert sorted(map(tuple, se.batch_keyword_search(docs, asked, "doc_id", F.col("content"), "content", 5).collect())) == want
    index = sg.Index.create(spark, scratch, ("content",)).add(docs.where("doc_id < 200")).add(docs.where("doc_id >= 200"))
    assert sorted(map(tuple, index.search_table(asked, "doc_id", F.col("content"), "content", 5).collect())) == want
