"""Terms facets, post-filters and the single terms aggregation.

All requested facets are computed in **one** shuffle: every hit emits one
``(field_pos, field, key)`` row per distinct value of every facet field, then a single
``groupBy`` counts them and ``row_number`` keeps the top buckets per field.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ..functions.labels import FACET_FIELDS

FACET_SIZE = 10


def _values(df: DataFrame, field: str):
    """Distinct string values of a field as an array (multi-valued fields counted once)."""
    dt = df.schema[field].dataType
    if isinstance(dt, ArrayType):
        return F.array_distinct(F.filter(F.col(field).cast("array<string>"), lambda x: x.isNotNull()))
    return F.when(F.col(field).isNotNull(), F.array(F.col(field).cast("string"))).otherwise(F.array().cast("array<string>"))


def sample_hits(scored: DataFrame, size: int) -> DataFrame:
    """Sampler: the best-scoring ``size`` hits (ties broken by ``doc_id``)."""
    return scored.orderBy(F.desc("score"), F.asc("doc_id")).limit(size)


def facets(hits: DataFrame, fields=None, size: int = FACET_SIZE, drop_blank: bool = True) -> DataFrame:
    """Terms facets over ``hits`` -> ``(field_pos, field, key, doc_count, rank)``.

    Buckets are ordered by ``doc_count`` desc then ``key``; fields absent from ``hits``
    are skipped; blank keys are removed *after* ranking (the display drops them from the
    already chosen buckets).
    """
    wanted = [f for f in (fields or FACET_FIELDS) if f in hits.columns]
    if not wanted:
        return hits.sparkSession.createDataFrame([], "field_pos int, field string, key string, doc_count bigint, rank int")
    def tag(i: int, f: str):
        return lambda v: F.struct(F.lit(i).alias("field_pos"), F.lit(f).alias("field"), v.alias("key"))

    pairs = F.flatten(F.array(*[F.transform(_values(hits, f), tag(i, f)) for i, f in enumerate(wanted)]))
    ex = hits.select(F.explode(pairs).alias("p")).select("p.*")
    counts = ex.groupBy("field_pos", "field", "key").agg(F.count(F.lit(1)).alias("doc_count"))
    win = Window.partitionBy("field_pos").orderBy(F.desc("doc_count"), F.asc("key"))
    ranked = counts.withColumn("rank", F.row_number().over(win)).filter(F.col("rank") <= size)
    if drop_blank:
        ranked = ranked.filter(F.length("key") > 0)
    return ranked.select(F.col("field_pos").cast("int"), "field", "key", F.col("doc_count").cast("bigint"), F.col("rank").cast("int"))


def terms_agg(df: DataFrame, field: str, size: int = FACET_SIZE) -> DataFrame:
    """Single terms aggregation ``(key, doc_count)``, top ``size`` by count then key."""
    ex = df.select(F.explode(_values(df, field)).alias("key"))
    return (ex.groupBy("key").agg(F.count(F.lit(1)).alias("doc_count"))
            .orderBy(F.desc("doc_count"), F.asc("key")).limit(size))


def post_filter(df: DataFrame, selection: dict | None) -> DataFrame:
    """AND across fields, OR within a field; ``None`` means no filter, ``{}`` all rows."""
    if not selection:
        return df
    cond = F.lit(True)
    for field, values in selection.items():
        vals = list(values)
        if isinstance(df.schema[field].dataType, ArrayType):
            c = F.arrays_overlap(F.col(field), F.array(*[F.lit(v) for v in vals]))
        else:
            c = F.col(field).isin(vals)
        cond = cond & F.coalesce(c, F.lit(False))
    return df.filter(cond)


def term_filter(df: DataFrame, field: str, value) -> DataFrame:
    """Exact term: equality, or membership for a multi-valued field."""
    if isinstance(df.schema[field].dataType, ArrayType):
        return df.filter(F.array_contains(field, value))
    return df.filter(F.col(field) == F.lit(value))
