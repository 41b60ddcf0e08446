import pytest

from tessera.operators import explain as xp


def test_key_sentence_target():
    assert [xp.n_key(n) for n in [0, 2, 3, 9, 40]] == [1, 1, 1, 3, 10]


# (scores, zeros, min_key, start, step) -> threshold, scores above it
GOLDEN = [
    (([0.5, 0.3], 0, 2, 0.2, 0.01), 0.3, 1),
    (([0.9], 0, 1, 0.2, 0.01), 0.9, 0),
    (([], 1, 2, 0.2, 0.01), 0.0, 1),
    (([0.15, 0.05], 0, 3, 0.2, 0.01), 0.15, 1),
    (([(i + 1) / 41 for i in range(40)], 0, 3, 0.2, 0.001), 0.927, 2),
    (([0.97] * 3 + [0.1] * 37, 0, 3, 0.2, 0.001), 0.97, 0),
    (([0.3], 0, 1, 0.5, 0.1), 0.3, 0),
    (([1.0, 1.0], 0, 1, 0.2, 0.01), 1.0, 0),
    (([], 0, 1, 0.2, 0.01), 0.0, 0),
]


@pytest.mark.parametrize("args,expected,kept", GOLDEN)
def test_threshold_golden(args, expected, kept):
    t = xp.threshold(*args)
    assert t == pytest.approx(expected, abs=args[4] * 1.01)
    assert sum(s > t for s in list(args[0]) + [0.0] * args[1]) <= max(kept, args[2])


def test_components_golden():
    assert xp.components([(0, 0), (0, 1), (2, 1), (5, 7)]) == [([0, 2], [0, 1]), ([5], [7])]


TEXT = "The first sentence is long enough. A second sentence follows here. Third one closes the text!"
OTHER = "Completely different words appear now. Nothing overlaps with the first text."


@pytest.mark.parametrize("ids,kind", [((-3, 2**53 + 1), "long"), (("a", "b/ü"), "string"), ((2, 3), "int")])
def test_identity_pairing_and_two_sided(spark, ids, kind):
    pairs = spark.createDataFrame([(ids[0], TEXT, TEXT), (ids[1], TEXT, OTHER)], f"pair_id {kind}, query_text string, cand_text string")
    e = xp.explain_pairs(pairs)
    assert sorted((r.q_idx, r.c_idx) for r in e.matched.collect() if r.pair_id == ids[0]) == [(0, 0), (1, 1), (2, 2)]
    comps = e.components.collect()
    assert all(len(r.q_idx) > 0 and len(r.c_idx) > 0 for r in comps)
    assert sorted(r.comp_rank for r in comps if r.pair_id == ids[0]) == [1, 2, 3]
    assert {(r.pair_id, r.side) for r in e.weights.collect()} == {(i, s) for i in ids for s in (0, 1)}
    assert [r.pair_id for r in e.threshold.collect()] == [ids[1]]
    assert {r.pair_id: (r.n_query_sents, r.n_cand_sents) for r in e.summary.collect()} == {ids[0]: (3, 3), ids[1]: (3, 2)}


def test_null_and_empty_texts(spark):
    pairs = spark.createDataFrame([(1, None, TEXT), (2, "", None), (3, "7. 8.", "7. 8.")], "pair_id long, query_text string, cand_text string")
    e = xp.explain_pairs(pairs)
    assert e.matched.count() == 0 and e.components.count() == 0 and {r.pair_id for r in e.summary.collect()} == {1, 3}


def test_tunables_and_lookup_by_id(spark):
    from pyspark.sql import functions as F

    cases = spark.createDataFrame([("x", TEXT), ("y", OTHER)], "doc_id string, basics_text string")
    asked = spark.createDataFrame([(1, "The second sentence is long enough. More of it follows here.", "x")], "pair_id long, query_text string, doc_id string")
    low = xp.explain_by_id(cases, asked, relation_ratio=0.2).cosines.count()
    none = xp.explain_by_id(cases, asked, analyzer=lambda c: F.split(F.lit("1 2 3"), " ")).cosines.count()
    assert low >= 1 and none == 0
    assert xp.explain_by_id(cases, asked, relation_ratio=0.9, step=0.05).threshold.first().threshold > 0
