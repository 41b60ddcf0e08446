import __spark_entry__ as entry


def test_entry_runs(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) > 0 and df.columns == ["doc_id", "score"]


def test_every_query_has_oracle_but_lsh():
    from tessera.plans.queries import REGISTRY

    q, o = entry.queries(), entry.oracle_sql()
    # The approximate searches; knn_ivf has its exhaustive form checked as knn_ivf_exhaustive.
    assert set(REGISTRY) - set(o) == {"knn_lsh", "knn_ivf"}
    assert set(o) <= set(q)
