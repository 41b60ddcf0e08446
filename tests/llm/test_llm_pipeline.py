"""The pipeline's stages, each against its own input."""

import hashlib
import re

import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from tessera.llm import queries, simhash

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def stage(name):
    return dict(pipeline.STAGES)[name]


@pytest.fixture(scope="module")
def sf(tmp_path_factory, spark):
    d = str(tmp_path_factory.mktemp("tables"))
    clean = [(i, f"word{i} of text number {i} and {'more ' * (i % 7)}words{i * 7}", "en", f"s{i % 3}", 5) for i in range(60)]
    toxic = [(100 + i, f"you idiot{'' if i % 2 else ' scum'} thing {i} said again {i}", "en", "s0", 5) for i in range(40)]
    copies = [(200 + i, "exactly the same text in many places here", "en", "s1", 5) for i in range(9)]
    private = [(300, "mail me at a.b@example.com please, ip 1.2.3.4", "en", "s2", 45), (301, None, None, None, None), (302, "", "en", "s2", 0),
               (None, "a text without any id at all here", "en", "s2", 3), (303, "twice the id", "en", "s2", 3), (303, "twice the id, other", "en", "s2", 3)]
    spark.createDataFrame(clean + toxic + copies + private, COLUMNS).repartition(3).write.parquet(f"{d}/documents.parquet")
    labels = [(i, 1, 0) for i in range(60)] + [(100 + i, 1, 1) for i in range(40)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = stage("toxicity")(spark, docs, sf)
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert ids >= {*range(60), *range(200, 209), 300, 301, 302, 303, None} and not ids & set(range(100, 140))

    single = stage("near_duplicates")(spark, kept, sf)
    groups = {}
    for r in simhash.near_duplicates(kept, 3, 2).collect():
        groups.setdefault(r["component_id"], set()).add(r["doc_id"])
    rows = single.collect()
    assert single.columns == docs.columns
    firsts = [min(x for x in g if x is not None) for k, g in groups.items() if k is not None]
    assert sorted(r["doc_id"] for r in rows if r["doc_id"] is not None) == sorted([*firsts, 303])  # its two texts are no duplicates
    assert sorted(r["text"] for r in rows if r["doc_id"] == 303) == ["twice the id", "twice the id, other"] and sum(r["doc_id"] is None for r in rows) == 1

    hidden = stage("personal_data")(spark, single, sf)
    shown = hidden.collect()
    by = {(r["doc_id"], r["text"]): r for r in shown}
    private = next(r for r in shown if r["doc_id"] == 300)
    assert hidden.columns == docs.columns and len(by) == len(rows)
    assert private["text"] == "mail me at [EMAIL] please, ip [IP]" and private["n_chars"] == len(private["text"])
    assert all(by[r["doc_id"], r["text"]]["n_chars"] == r["n_chars"] for r in rows if r["doc_id"] != 300)

    mixed = stage("mixing")(spark, hidden, sf)
    taken = {}
    for r in mixed.collect():
        key = r["doc_id"], r["text"]
        taken[key] = taken.get(key, 0) + 1
        assert key in by
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    total = sum(words(r["text"]) for r in by.values())
    assert set(taken.values()) <= {1, 2} and abs(sum(words(t) * n for (_, t), n in taken.items()) - 1.5 * total) < 40

    ids = stage("encoding")(spark, mixed, sf).collect()
    assert len(ids) == sum(taken.values()) and all(r["n_tokens"] == len(r["ids"]) and r["ids"][0] == 1 and r["ids"][-1] == 2 for r in ids)
    processor = sentencepiece.SentencePieceProcessor(model_proto=queries.piece_model())
    texts = {}
    for _, t in taken:
        texts.setdefault(tuple([1, *processor.encode(t), 2]), []).append(t)
    for r in ids:
        assert r["decoded_sha256"] == hashlib.sha256(processor.decode(r["ids"]).encode()).hexdigest()
        t = texts[tuple(r["ids"])][0].encode()
        assert r["begin"][0] == 0 and r["end"][-1] == len(t) and all(a <= b for a, b in zip(r["begin"], r["end"])) and len(r["begin"]) == len(r["ids"])


def test_mix_of_repeated_ids_is_rerun_stable(spark):
    """Rows of one id and size with other texts: the mix takes the same ones however they lie."""
    rows = [(1, f"text {i} with words", "en", "s", i) for i in range(40)] + [(2, "a b c d e f", "en", "t", 0)]
    taken = [sorted(map(tuple, stage("mixing")(spark, spark.createDataFrame(rows[::step], COLUMNS).repartition(n), "").collect())) for step, n in ((1, 1), (-1, 5), (1, 7))]
    assert taken[0] == taken[1] == taken[2] and taken[0]


def test_run_equals_the_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, f in pipeline.STAGES:
        docs = f(spark, docs, sf)
    key = lambda df: sorted((r["doc_id"] is None, r["doc_id"] or 0, r["ids"]) for r in df.collect())
    assert key(pipeline.run(spark, sf)) == key(docs)


def test_rows_without_or_with_repeated_ids(spark, sf):
    """Copies of a text with an id or of each other go, whatever their ids; a clean text whose id
    also stands on a copy stays; counts of the mix belong to rows."""
    a, b, c = "seven has a text of its own here", "a first text that the third document has", "nobody gave this text any id at all"
    rows = [(7, a, "en", "s", 1), (3, b, "en", "s", 1), (7, b, "en", "s", 1), (None, b, "en", "s", 1), (None, c, "en", "s", 1), (None, c, "en", "s", 2),
            (None, c, "en", "s", 1), (None, None, "en", "s", 0)]
    docs = spark.createDataFrame(rows, COLUMNS).repartition(3)
    single = stage("near_duplicates")(spark, docs, sf)
    got = sorted(map(tuple, single.collect()), key=str)
    assert got == sorted([rows[0], rows[1], rows[4], rows[7]], key=str)

    two = spark.createDataFrame([(None, "one two three four", "en", "s", 1), (None, "five six", "en", "s", 2), (None, None, "en", "s", 0)], COLUMNS)
    texts = [r["text"] for r in stage("mixing")(spark, two, sf).collect()]
    assert None not in texts and {t: texts.count(t) for t in set(texts)} == {"five six": 2, "one two three four": 1 + (9 - 6 - 2 >= 2)}


@pytest.mark.parametrize("name", [n for n, _ in pipeline.STAGES])
def test_empty_input(spark, sf, name):
    assert stage(name)(spark, spark.createDataFrame([], COLUMNS), sf).withColumn("x", F.lit(1)).collect() == []
