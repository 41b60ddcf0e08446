"""SimHash near-duplicates against brute force."""

import re

import numpy as np
import pyarrow as pa
import xxhash

from tessera.llm import simhash


def brute_print(text, size=3):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    runs = [" ".join(words[i:i + size]) for i in range(len(words) - size + 1)] if len(words) >= size else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_labels(prints, radius):
    root = list(range(len(prints)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if bin(int(prints[i]) ^ int(prints[j])).count("1") <= radius:
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(prints))]


TEXTS = ["", None, "  \t\n", "one", "One TWO", "a b c", "a b c a b c", "é Ü ß \x0b x\x0cy", "x " * 500, "Ä" * 3000 + " b c d", "a b c d e f g"]


def test_fingerprints_match_brute_force():
    texts = pa.array(TEXTS * 3)
    got = simhash.majority(*simhash.shingle_hashes(texts.slice(5), 3))
    assert [int(x) for x in got] == [brute_print(t) for t in (TEXTS * 3)[5:]]


def clustered(rng, n):
    """Dense balls, chains and lone points."""
    out = list(rng.integers(0, 1 << 64, n, dtype=np.uint64))
    for centre in out[:6]:
        point = centre
        for _ in range(n // 6):
            flips = rng.integers(0, 64, int(rng.integers(1, 4)))
            point = centre ^ np.bitwise_xor.reduce(np.uint64(1) << flips.astype(np.uint64)) if rng.random() < 0.5 else point ^ (np.uint64(1) << np.uint64(flips[0]))
            out.append(point)
    return np.unique(np.array(out, np.uint64))


def test_tree_search_loses_no_link():
    for seed in range(4):
        points = clustered(np.random.default_rng(seed), 300)
        old, simhash.LEAF = simhash.LEAF, 8
        try:
            forest = simhash.search(points, np.ones(len(points), bool), 2)
        finally:
            simhash.LEAF = old
        assert forest.root.tolist() == brute_labels(points, 2)


def test_links_across_shards_and_components(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD", 40)
    points = clustered(np.random.default_rng(9), 240)
    df = spark.createDataFrame([(int(p),) for p in points.view(np.int64)], "fp long").repartition(3)
    found = {r["node"]: r["label"] for r in simhash.components(simhash.links(df, 2)).collect()}
    labels = brute_labels(points, 2)
    signed = points.view(np.int64)
    groups = {}
    for i, lab in enumerate(labels):
        groups.setdefault(lab, []).append(int(signed[i]))
    for members in groups.values():
        assert {found.get(m, m) for m in members} == {min(members)}


def test_chain_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r["node"]: r["label"] for r in simhash.components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 101: 100}


def test_rows_edge_cases(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(20, "a b c", "y"), (20, "a b c", "y"), (None, "lone words here", "z"), (21, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = simhash.near_duplicates(df, 3, 2).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert by[1]["component_id"] == by[2]["component_id"] == by[21]["component_id"] == 0 and by[0]["fp"] == 0
    assert by[20]["component_id"] == by[5]["component_id"] and by[None]["component_id"] is None
    for r in got:
        if r["doc_id"] is not None and r["doc_id"] < len(TEXTS):
            assert r["fp"] % (1 << 64) == brute_print(TEXTS[r["doc_id"]])


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(empty, 3, 2).collect() == []
