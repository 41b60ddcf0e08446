"""Record preparation: facts extraction with validity, rejects, citations, provenance,
safe casts, vector attachment and the kept/skipped counters.

All operators are narrow projections (no shuffle) except ``attach_vector`` (one keyed
join) and ``prep_stats`` (one global aggregate).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.citations import normalize_citations
from ..functions.facts import extract_facts, truthy
from ..functions.text import strip_newlines

DROPPED_SOURCE_COLUMNS = ["crawl_time", "browse_count"]
# A title containing any of these marks a ruling/decision/notice, which is
# not logged as a reject.
REJECT_EXEMPT_TITLE_PATTERN = "裁定|决定|通知"
# Fixed value: what a hit shows for a missing title or content.
MISSING = "MISSING CONTENT!"


def facts_with_validity(df: DataFrame, patterns=None) -> DataFrame:
    """Extract the facts passage and decide validity.

    * non-empty ``basics_text``: extract from it, always valid;
    * else non-empty ``content``: extract from it, valid iff a pattern matched;
    * else invalid.
    Valid rows get ``basics_text`` := extracted text; invalid rows keep the original.
    Adds ``is_valid`` (0/1), ``fact_source`` and ``fact_pattern`` (1-based, 0 = none).
    """
    from_basics = extract_facts("basics_text", patterns)
    from_content = extract_facts("content", patterns)
    has_basics = truthy("basics_text")
    has_content = truthy("content")
    ex = (F.when(has_basics, from_basics).when(has_content, from_content))
    out = (df.withColumn("_fx", ex)
           .withColumn("is_valid", F.when(has_basics, F.lit(1))
                       .when(has_content, F.col("_fx.matched")).otherwise(F.lit(0)).cast("int"))
           .withColumn("fact_source", F.when(has_basics, F.lit("basics_text"))
                       .when(has_content, F.lit("content")).otherwise(F.lit("none")))
           .withColumn("fact_pattern", F.coalesce(F.col("_fx.pattern"), F.lit(0)).cast("int"))
           .withColumn("basics_text", F.when(F.col("is_valid") == 1, F.col("_fx.text")).otherwise(F.col("basics_text")))
           .drop("_fx"))
    return out


def reject_logged(df: DataFrame) -> DataFrame:
    """Flag invalid rows that go to the reject log: content present and the space-free
    title names no ruling, decision or notice (null title counts as empty)."""
    title = F.replace(F.coalesce(F.col("case_name"), F.lit("")), F.lit(" "), F.lit(""))
    logged = (F.col("is_valid") == 0) & truthy("content") & ~title.rlike(REJECT_EXEMPT_TITLE_PATTERN)
    return df.withColumn("reject_logged", logged)


def filter_rejects(df: DataFrame) -> DataFrame:
    """Reject-log rows: ``doc_id`` and the newline-free content."""
    return (reject_logged(df).filter("reject_logged")
            .select("doc_id", strip_newlines("content").alias("content")))


def reject_sample(df: DataFrame, n: int) -> DataFrame:
    """Debug sampler: the first ``n`` invalid rows by key, of which the logged ones."""
    first = df.filter(F.col("is_valid") == 0).orderBy("doc_id").limit(n)
    return filter_rejects(first)


def normalize_legal_base(df: DataFrame, raw_col: str = "legal_base_raw") -> DataFrame:
    """``legal_base: array<string>`` and ``legal_base_rejected: boolean`` from raw JSON."""
    return (df.withColumn("_lb", normalize_citations(raw_col))
            .withColumn("legal_base", F.col("_lb.items"))
            .withColumn("legal_base_rejected", F.col("_lb.rejected"))
            .drop("_lb"))


def legal_base_rejects(df: DataFrame) -> DataFrame:
    return df.filter("legal_base_rejected")


def provenance(df: DataFrame, collection=None, id_col: str = "doc_id") -> DataFrame:
    """Drop crawl bookkeeping columns, add ``collection`` (when given) and ``id``."""
    out = df.drop(*[c for c in DROPPED_SOURCE_COLUMNS if c in df.columns])
    if collection is not None:
        out = out.withColumn("collection", collection if not isinstance(collection, str) else F.lit(collection))
    return out.withColumn("id", F.col(id_col).cast("bigint"))


DATE_COLUMNS = ("publish_date", "upload_date", "trial_date")


def safe_cast(df: DataFrame, date_cols=DATE_COLUMNS, raw_suffix: str = "_raw") -> DataFrame:
    """Malformed values become null instead of failing the job (``try_to_date``); columns the
    table does not have are skipped."""
    for c in date_cols:
        src = c + raw_suffix if c + raw_suffix in df.columns else c
        if src in df.columns:
            df = df.withColumn(c, F.try_to_date(F.col(src).cast("string")))
    return df


def malformed_counts(df: DataFrame, date_cols=DATE_COLUMNS, raw_suffix: str = "_raw") -> DataFrame:
    """One row: for each date column, how many non-empty values ``safe_cast`` turns to null."""
    found = [(c, c + raw_suffix if c + raw_suffix in df.columns else c) for c in date_cols]
    bad = lambda src: F.count_if((F.coalesce(F.col(src).cast("string"), F.lit("")) != "") & F.try_to_date(F.col(src).cast("string")).isNull())
    return df.agg(*[bad(src).alias(f"{c}_malformed") for c, src in found if src in df.columns])


def attach_vector(df: DataFrame, vectors: DataFrame, key: str = "doc_id") -> DataFrame:
    """Keyed left join; only records with a non-empty facts passage keep their vector.

    Both sides are large at scale, so this is a sort-merge join on ``key`` (AQE may
    switch it to broadcast when the vector side is measured small at run time).
    """
    v = vectors.select(F.col(key), F.col("vector"))
    j = df.join(v, on=key, how="left")
    return j.withColumn("vector", F.when(truthy("basics_text"), F.col("vector")))


def hit_defaults(df: DataFrame) -> DataFrame:
    """Defaults a search hit shows for missing fields."""
    missing = F.lit(MISSING)
    return df.select(
        "doc_id",
        F.coalesce("case_name", missing).alias("case_name"),
        F.coalesce("content", missing).alias("content"),
        F.coalesce("court_name", F.lit("")).alias("court_name"),
        F.coalesce(F.date_format("publish_date", "yyyy-MM-dd"), F.lit("")).alias("publish_date"),
        F.when(truthy("case_id"), F.col("case_id")).otherwise(F.lit("")).alias("case_id"),
        F.coalesce("basics_text", F.lit("")).alias("basics_text"),
    )


def prep_stats(df: DataFrame) -> DataFrame:
    """Kept / skipped counters (exact) and the corpus stat sidecar value."""
    return df.agg(
        F.sum(F.col("is_valid")).cast("bigint").alias("kept"),
        F.sum(1 - F.col("is_valid")).cast("bigint").alias("skipped"),
    ).select("kept", "skipped", F.col("kept").alias("valid_tf_content_count"))


def prepare_cases(raw: DataFrame, vectors: DataFrame | None = None, collection=None, patterns=None) -> DataFrame:
    """Full preparation of raw case rows into indexed documents; ``patterns`` replaces the list
    of fact patterns."""
    df = facts_with_validity(raw, patterns)
    df = normalize_legal_base(df) if "legal_base_raw" in df.columns else df
    df = safe_cast(df)
    df = provenance(df, collection)
    if vectors is not None:
        df = attach_vector(df, vectors)
    return df
