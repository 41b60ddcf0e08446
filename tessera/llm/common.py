"""Shared helpers of the training-data operators: table access, hash folds, bounded samples,
lineage cuts and prefix sums that never put a whole group into one task."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: A word of the contracts: a maximal run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


#: Rows of an Arrow batch; batches of texts are further cut by bytes inside the tasks.
BATCH_ROWS = 1_000


def bounded_batches() -> None:
    """Texts are long rows: send Python workers batches of ``BATCH_ROWS`` of them at most."""
    spark = SparkSession.active()
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fold(id_col: Column, k: int) -> Column:
    """crc32 of the id as text, modulo ``k`` (null ids count as the empty string)."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(k))


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the folder named by ``spark.checkpoint.dir``."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager)


def stored(df: DataFrame) -> DataFrame:
    """Cut lineage by a table written in the folder of ``spark.checkpoint.dir``: for loops, since a
    checkpoint carries its plan's constraints on, which grow with every round."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hash_sample(df: DataFrame, id_col: str, size: int, seed: int) -> DataFrame:
    """Deterministic sample of the ids whose hash falls below ``size / count``: a map-side
    filter, ``size`` rows expected (all of them if there are fewer); repeats of one id are
    kept together, so dedupe ``df`` by id first where the bound must hold."""
    n = df.count()
    if n <= size:
        return df
    span = 1 << 30
    return df.where(F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(span)) < int(span * size / n))


def bucketed_prefix(df: DataFrame, groups: Sequence[str], bucket: str, order: Sequence[Column], values: Sequence[str],
                    before: str = "_before") -> DataFrame:
    """Distributed exclusive prefix sums of ``values`` over ``groups`` in (bucket, order).

    ``bucket`` cuts each group into ranges that agree with ``order``. A task sorts one range
    only; the ranges' totals (one small row each) carry the offsets, so a group with a third
    of all rows is summed by as many tasks as it has ranges. Group columns may be null.
    Adds ``<value>_before`` for every value.
    """
    groups = list(groups)
    inner = Window.partitionBy(*groups, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy(*groups).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*groups, bucket).agg(*[F.sum(v).alias(f"_t{i}") for i, v in enumerate(values)])
    offsets = totals.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)], F.col(bucket).alias("_b"),
                            *[F.coalesce(F.sum(f"_t{i}").over(over), F.lit(0)).alias(f"_o{i}") for i in range(len(values))])
    cond = F.col(bucket) == F.col("_b")
    for i, g in enumerate(groups):
        cond &= F.col(g).eqNullSafe(F.col(f"_g{i}"))
    local = df.select("*", *[F.coalesce(F.sum(v).over(inner), F.lit(0)).alias(f"_l{i}") for i, v in enumerate(values)])
    out = local.join(offsets, cond)
    sums = [(F.col(f"_l{i}") + F.col(f"_o{i}")).alias(f"{v}{before}") for i, v in enumerate(values)]
    return out.select(*df.columns, *sums)
