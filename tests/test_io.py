import json
import os

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import analysis as an
from tessera.plans.load_plan import LoadPaths, offline_load
from tessera.sources import io as sio
from tessera.streaming.incremental import start_incremental_load


def _write_cases(path, rows):
    with open(path, "w", encoding="utf-8") as f:
        for r in rows:
            f.write((r if isinstance(r, str) else json.dumps(r, ensure_ascii=False)) + "\n")


CASE_A = {"doc_id": "x1", "case_id": "（2020）1号", "case_name": "甲乙借款判决书", "content": "经审理查明，甲向乙借款。本院认为，应还。",
          "basics_text": "", "court_name": "一院", "publish_date": "2020-01-02", "crawl_time": "t", "browse_count": "3",
          "legal_base": [{"fgmc": "《民法》", "tkx": "第1条"}]}
CASE_B = {"doc_id": "x2", "case_id": "（2020）2号", "case_name": "决定书", "content": "无模式", "basics_text": None,
          "court_name": "二院", "publish_date": "bad"}


def test_line_json_scan_and_ranges(spark, scratch):
    p = os.path.join(scratch, "p1.txt")
    _write_cases(p, [CASE_A, CASE_B, "{not json", CASE_A])
    df = sio.read_case_lines(spark, p)
    assert df.count() == 4 and df.filter(F.col("_corrupt").isNotNull() & F.col("case_id").isNull()).count() == 1
    assert [r.line_no for r in sio.line_range(df, 1, 3).orderBy("line_no").collect()] == [1, 2]
    assert sio.line_range(df, 2, 0).count() == 2
    assert sio.line_lookup(df, 3).first().case_id == "（2020）1号"


def test_binary_vectors_roundtrip(spark, scratch):
    m = np.arange(5 * 4, dtype="<f4").reshape(5, 4)
    p = os.path.join(scratch, "v.mmp")
    m.tofile(p)
    rows = sio.read_vectors_binary(spark, p, 4).orderBy("ord").collect()
    assert [list(r.vector) for r in rows] == m.tolist()


def test_offline_load_end_to_end(spark, scratch):
    p = os.path.join(scratch, "p2-1.txt")
    _write_cases(p, [CASE_A, CASE_B])
    paths = LoadPaths(*(os.path.join(scratch, d) for d in ["docs", "vecs", "post", "rej", "stat"]))
    offline_load(spark, p, paths, "p2-1")
    docs = spark.read.parquet(paths.documents)
    assert docs.count() == 2 and {r.collection for r in docs.collect()} == {"p2-1"}
    row = docs.filter("case_name = '甲乙借款判决书'").first()
    assert row.basics_text == "甲向乙借款。" and list(row.legal_base) == ["《民法》第1条"] and row.vector is not None
    assert docs.filter("case_name = '决定书'").first().vector is None
    assert "crawl_time" not in docs.columns
    ids = {r.case_id: r.doc_id for r in docs.collect()}
    assert len(set(ids.values())) == 2
    stat = spark.read.json(paths.stats).first()
    assert stat.valid_tf_content_count == 1
    assert spark.read.text(os.path.join(paths.rejects, "stage=filter")).count() == 0  # title is a decision
    post = spark.read.parquet(paths.postings)
    assert post.filter("term = '借'").count() == 1
    # delete a collection physically
    sio.delete_collection(spark, paths.documents, "p2-1")
    assert not os.path.exists(os.path.join(paths.documents, "collection=p2-1"))


def test_two_collections_malformed_lines_and_a_rerun(spark, scratch):
    import pytest

    paths = LoadPaths(*(os.path.join(scratch, d) for d in ["docs", "vecs", "post", "rej", "stat"]))
    files = {}
    for name in ("p2:2", "p3"):
        files[name] = os.path.join(scratch, f"{name.replace(':', '_')}.txt")
        _write_cases(files[name], ["{bad", CASE_A, CASE_B, "[1", CASE_A])
    for name in ("p2:2", "p3", "p2:2"):
        offline_load(spark, files[name], paths, name)
    docs = spark.read.parquet(paths.documents)
    assert docs.count() == 6 and docs.select("doc_id").distinct().count() == 6 and "_corrupt" not in docs.columns
    assert {r.collection for r in docs.collect()} == {"p2:2", "p3"}
    assert spark.read.parquet(paths.vectors).count() == 4 and spark.read.json(paths.stats).count() == 2
    bad = spark.read.json(os.path.join(paths.rejects, "stage=parse")).collect()
    assert sorted((r.collection, r.line_no, r._corrupt) for r in bad) == [(c, n, x) for c in ("p2:2", "p3") for n, x in ((0, "{bad"), (3, "[1"))]
    assert spark.read.parquet(paths.postings).filter("term = '借'").count() == 4
    sio.delete_collection(spark, paths.documents, "p2:2")
    assert {r.collection for r in spark.read.parquet(paths.documents).collect()} == {"p3"}
    with pytest.raises(FileNotFoundError):
        sio.delete_collection(spark, paths.documents, "p2:2")


def test_line_numbers_of_two_files_in_many_splits(spark, scratch):
    import random

    lines = {"a.txt": 700, "b.txt": 1100}
    for name, n in lines.items():
        _write_cases(os.path.join(scratch, name), [{"case_id": f"{name}-{i}", "content": "x" * random.Random(i).randint(1, 400)} for i in range(n)])
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        raw = sio.read_case_lines(spark, scratch)
        assert raw.rdd.getNumPartitions() > 4
        got = sorted((r.case_id, r.line_no) for r in sio.with_line_numbers(raw).collect())
        assert got == sorted((f"{name}-{i}", i) for name, n in lines.items() for i in range(n))
        assert sio.line_range(raw, 690, 710).count() == 30 and sio.line_lookup(raw, 800).first().case_id == "b.txt-800"
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_stop_words_file(spark, scratch):
    p = os.path.join(scratch, "stop.txt")
    with open(p, "w", encoding="utf-8") as f:
        f.write("the\nof\n\n")
    stop = sio.read_stop_words(spark, p)
    df = spark.createDataFrame([(1, ["the", "cat", "of", "7"])], "doc_id int, tokens array<string>")
    assert list(an.remove_stop_words(df, "tokens", stop).first().tokens) == ["cat"]


def test_incremental_stream_picks_only_new_files(spark, scratch):
    land, table, ck = (os.path.join(scratch, d) for d in ["land", "table", "ck"])
    os.makedirs(land)
    _write_cases(os.path.join(land, "p1.txt"), [CASE_A])
    start_incremental_load(spark, land, table, ck).awaitTermination()
    assert spark.read.parquet(table).count() == 1
    _write_cases(os.path.join(land, "p2.txt"), [CASE_A, CASE_B])
    start_incremental_load(spark, land, table, ck).awaitTermination()
    _write_cases(os.path.join(land, "p3.txt"), ["{bad", CASE_B])
    start_incremental_load(spark, land, table, ck).awaitTermination()
    bad = spark.read.json(table + "_rejects").collect()
    assert [(r.collection, r.line_no, r._corrupt) for r in bad] == [("p3", 0, "{bad")]
    # the batch load gives a record the same key
    paths = LoadPaths(*(os.path.join(scratch, d) for d in ["docs", "vecs", "post", "rej", "stat"]))
    offline_load(spark, os.path.join(land, "p3.txt"), paths, "p3")
    key = spark.read.parquet(paths.documents).first().doc_id
    out = spark.read.parquet(table)
    assert [r.doc_id for r in out.filter("collection = 'p3'").collect()] == [key] and "_corrupt" not in out.columns
    out = out.filter("collection <> 'p3'")
    assert out.count() == 3 and sorted(r.collection for r in out.select("collection").distinct().collect()) == ["p1", "p2"]


def test_loads_feed_the_segmented_index(spark, scratch):
    """A collection is a segment; its rerun replaces it, a stream's batch adds to it, a retried batch does not."""
    from tessera.operators import search as se
    from tessera.operators.segments import Index

    paths = LoadPaths(*(os.path.join(scratch, d) for d in ["docs", "vecs", "post", "rej", "stat", "index"]))
    for name in ("a", "b", "a"):
        _write_cases(os.path.join(scratch, f"{name}.txt"), [CASE_A, CASE_B] if name == "a" else [CASE_A])
        offline_load(spark, os.path.join(scratch, f"{name}.txt"), paths, name)
    docs = spark.read.parquet(paths.documents)
    index = Index.open(spark, paths.index)
    key = lambda df: sorted((r.doc_id, round(r.score, 6)) for r in df.collect())
    assert len(index.segments) == 2 and sorted(r.doc_id for r in index.documents().collect()) == sorted(r.doc_id for r in docs.select("doc_id").collect())
    assert key(index.search("借款")) == key(se.keyword_search(docs, "借款")) and index.search("借款").count() > 0

    land, table, ck = (os.path.join(scratch, d) for d in ["land", "table", "ck"])
    os.makedirs(land)
    for name in ("c", "d"):
        _write_cases(os.path.join(land, f"{name}.txt"), [CASE_A, CASE_B])
        start_incremental_load(spark, land, table, ck, max_files_per_trigger=1, index_dir=paths.index).awaitTermination()
    start_incremental_load(spark, land, table + "2", ck + "2", index_dir=paths.index).awaitTermination()  # the same files again
    index = Index.open(spark, paths.index)
    got = sorted((r.collection, r.doc_id) for r in index.documents().collect())
    want = docs.select("collection", "doc_id").unionByName(spark.read.parquet(table).select("collection", "doc_id"))
    assert got == sorted((r.collection, r.doc_id) for r in want.collect()) and len(got) == 7
