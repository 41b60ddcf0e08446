"""Toxicity, quality, language identification: held-out accuracy and defined edge cases."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import langid, quality, queries, textbatch, toxicity
from tessera.llm.common import fold

from conftest import SF01

EDGE = "doc_id long, text string, lang string, source string, score string, held_out int"
ROWS = [(1, None, None, None, "s", 1), (2, "", "en", "a", "s", 1), (3, " \n\t", "en", None, "s", 1), (4, "12 34 !!", None, "a", "s", 1),
        (5, "the cat sat " * 4000, "en", "a", "s", 1), (5, "the cat sat " * 4000, "en", "a", "s", 1), (None, "der Hund", "de", "a", "s", 1),
        (7, "日本語", None, None, None, None), (8, "x" * 200_000, "en", "b", "s", 1)]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(ROWS, EDGE)


def test_folds(spark):
    df = spark.createDataFrame([(i,) for i in (0, 5, -7, 10**12, None)], "doc_id long")
    got = [r[0] for r in df.select(fold(F.col("doc_id"), 5)).collect()]
    assert got == [zlib.crc32(("" if i is None else str(i)).encode()) % 5 for i in (0, 5, -7, 10**12, None)]


def test_word_hashes_agree_with_words():
    texts = ["", "One two", None, "two  ONE\tzwei é", "é", "two"]
    buf, offsets = textbatch.text_bytes(pa.array(texts))
    w = textbatch.words(buf, offsets)
    plain = [x for t in texts for x in (t or "").split()]
    assert [bytes(buf[s:e]).decode() for s, e in zip(w.start, w.end)] == plain
    h = textbatch.span_hashes(buf, w.start, w.end)
    assert {a: b for a, b in zip(plain, h)} == dict(zip(plain, h)) and len(set(h.tolist())) == len(set(plain))
    old, textbatch.STEP = textbatch.STEP, 4
    try:
        assert (textbatch.span_hashes(buf, w.start, w.end) == h).all()
        word, g = textbatch.inner_grams(buf, w, 2, 1)
    finally:
        textbatch.STEP = old
    whole, again = textbatch.inner_grams(buf, w, 2, 1)
    assert (word == whole).all() and (g == again).all() and len(g) == sum(len(x.encode()) - 1 for x in plain)


def held_out(spark, name, label):
    got = queries.REGISTRY[name](spark, SF01).toPandas()
    labels = spark.read.parquet(f"{SF01}/labels.parquet").toPandas()
    docs = spark.read.parquet(f"{SF01}/documents.parquet").count()
    assert len(got) == docs and got["score"].between(0, 1).all() and got["doc_id"].is_unique
    both = got.merge(labels, on="doc_id")
    return both[both["held_out"]], got


def test_toxicity_held_out(spark):
    both, _ = held_out(spark, "op6_toxicity", "toxic")
    assert (both["predicted"] == both["toxic"]).mean() > 0.9
    assert both[both.toxic == 1]["score"].mean() > both[both.toxic == 0]["score"].mean() + 0.3


def test_quality_held_out(spark):
    both, got = held_out(spark, "op2_quality", "quality")
    assert (both["predicted"] == both["quality"]).mean() > 0.9 and ((got.score >= 0.3) == (got.predicted == 1)).all()
    good, bad = both[both.quality == 1]["score"].to_numpy(), both[both.quality == 0]["score"].to_numpy()
    assert (good[:, None] > bad[None, :]).mean() > 0.97


def test_class_prior_and_risk():
    rng = np.random.default_rng(0)
    width = len(quality.FEATURES)
    good, bad = rng.normal(1, 1, (4000, width)), rng.normal(-1, 1, (4000, width))
    mixed = np.concatenate([good[2000:2000 + 1200], bad[:800]])
    model = quality.train(good[:2000], mixed)
    assert abs(model["prior"] - 0.6) < 0.08
    score = quality._sigmoid(quality._raw(model["w"], quality.binned(np.concatenate([good[3300:], bad[1000:]]), model["edges"])))
    truth = np.arange(len(score)) < 700
    assert ((score > 0.5) == truth).mean() > 0.95
    assert quality.train(good[:0], mixed)["prior"] == 0.5


def test_langid_held_out(spark):
    got = queries.REGISTRY["op4_langid"](spark, SF01).toPandas()
    docs = spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "lang").toPandas()
    both = got.merge(docs, on="doc_id")
    both = both[both.held_out]
    assert (both.lang == both.lang_pred).mean() > 0.98 and got.score.between(0, 1).all() and got.rejected.mean() < 0.2


def test_edge_rows(spark, edge):
    model = langid.fit(edge)
    got = {(r["doc_id"], r["text"] and r["text"][:5]): r["p"] for r in edge.select("*", langid.predict(edge, model).alias("p")).collect()}
    for key in ((1, None), (2, ""), (3, " \n\t"), (4, "12 34")):
        assert got[key]["lang"] == "und" and got[key]["score"] == 0 and got[key]["rejected"]
    assert got[(7, "日本語")]["lang"] in ("en", "de") and got[(5, "the c")]["lang"] == "en"
    labels = spark.createDataFrame([(5, 1), (8, 0), (2, None), (None, 1), (5, 1), (99, 1)], "doc_id long, toxic int")
    for make, of in ((toxicity.fit, toxicity.score), ):
        scores = edge.select(of(edge, make(edge, labels)).alias("x")).collect()
        assert len(scores) == len(ROWS) and all(0 <= r["x"] <= 1 for r in scores)
    trained = quality.fit(edge, labels)
    assert all(0 <= r["x"] <= 1 for r in edge.select(quality.score(edge, trained).alias("x")).collect())


def test_empty_tables(spark, edge):
    empty, none = edge.limit(0), spark.createDataFrame([], "doc_id long, toxic int")
    assert langid.fit(empty)["names"] == []
    assert {r["p"]["lang"] for r in edge.select(langid.predict(edge, langid.fit(empty)).alias("p")).collect()} == {"und"}
    model = toxicity.fit(edge, none)
    assert {r[0] for r in edge.select(toxicity.score(edge, model)).collect()} == {0.5}
    assert {r[0] for r in edge.select(quality.score(edge, quality.fit(empty, none))).collect()} == {0.5}
    assert empty.select(toxicity.score(empty, model), quality.score(empty, quality.fit(empty, none))).collect() == []
