"""Scans and sinks: line-JSON records, line ranges, fixed-width float32 vectors, stop-word
files, document loads and deletes.

Line ordinals are per file: position in its split plus the lengths of the file's earlier
splits (see ``with_line_numbers``); no window runs over the rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir
from .schema import CASE_SCHEMA

#: File splits whose offsets are copied to every task; more are joined by a shuffle.
FEW_SPLITS = 100_000


def read_case_lines(spark: SparkSession, path: str, schema: T.StructType = CASE_SCHEMA) -> DataFrame:
    """Line-JSON scan with an explicit schema; malformed lines land in ``_corrupt``."""
    sch = schema
    if "_corrupt" not in schema.fieldNames():
        sch = T.StructType(schema.fields + [T.StructField("_corrupt", T.StringType())])
    return (spark.read.schema(sch).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt")
            .json(path))


def split_malformed(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, malformed lines) of a scan with a ``_corrupt`` column; the records lose it."""
    return raw.filter(F.col("_corrupt").isNull()).drop("_corrupt"), raw.filter(F.col("_corrupt").isNotNull())


def with_file_position(df: DataFrame) -> DataFrame:
    """Columns ``_file``, ``_split`` and ``_row`` of a file scan: file, first byte of the split and
    an ascending number within it."""
    return df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_split"),
                     F.monotonically_increasing_id().alias("_row"))


def with_line_numbers(df: DataFrame, col: str = "line_no", keep_file: bool = False) -> DataFrame:
    """Append the 0-based line ordinal within its file without leaving the JVM.

    Rows of a split are consecutive in scan order, so ``monotonically_increasing_id`` counts
    them; one aggregate gives each split's length and first number (one row per split), a
    running sum per file its offset. ``df`` is a file scan (it needs ``_metadata``), possibly
    with projections and with position columns of ``with_file_position``.
    """
    tagged = df if "_split" in df.columns else with_file_position(df)
    splits = tagged.groupBy("_file", "_split").agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_base"))
    w = Window.partitionBy("_file").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select("_file", "_split", "_base", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    # One row per file split (about one per 100 MB of input), written once and counted.
    ensure_checkpoint_dir(df.sparkSession)
    offsets = offsets.checkpoint()
    few = offsets.count() <= FEW_SPLITS
    out = tagged.join(F.broadcast(offsets) if few else offsets, ["_file", "_split"])
    out = out.withColumn(col, (F.col("_off") + F.col("_row") - F.col("_base")).cast("bigint")).drop("_split", "_row", "_base", "_off")
    return out if keep_file else out.drop("_file")


def line_range(df: DataFrame, start: int = 0, end: int = 0, col: str = "line_no", keep_file: bool = False) -> DataFrame:
    """Rows whose ordinal in their file lies in ``[start, end)``; ``end == 0`` means unbounded."""
    n = with_line_numbers(df, col, keep_file)
    cond = F.col(col) >= start
    if end > 0:
        cond = cond & (F.col(col) < end)
    return n.filter(cond)


def line_lookup(df: DataFrame, k: int, col: str = "line_no") -> DataFrame:
    """Line ``k`` of every file."""
    return with_line_numbers(df, col).filter(F.col(col) == k)


def read_vectors_binary(spark: SparkSession, path: str, dims: int, key: str = "ord") -> DataFrame:
    """Row-major float32 matrix file(s) -> ``(ord, vector array<float>)``. Fixed-length records have
    no DataFrame reader, so bytes come as records; they become vectors by whole Arrow batches."""
    recs = spark.sparkContext.binaryRecords(path, 4 * dims).zipWithIndex().map(lambda vi: (vi[1], vi[0]))

    def decoded(batches):
        for batch in batches:
            flat = np.frombuffer(b"".join(batch.column("raw").to_pylist()), "<f4")
            offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * dims)
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.ListArray.from_arrays(offsets, pa.array(flat))], [key, "vector"])

    return spark.createDataFrame(recs, f"{key} bigint, raw binary").mapInArrow(decoded, f"{key} bigint, vector array<float>")


def partition_path(spark: SparkSession, path: str, column: str, value: str) -> str:
    """Directory of a partition value, escaped as Spark's own writer does."""
    escaped = spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(value)
    return f"{path.rstrip('/')}/{column}={escaped}"


def write_collection(df: DataFrame, path: str, collection: str, fmt: str = "parquet") -> None:
    """Replace one collection of a table partitioned by ``collection``; a rerun leaves the same
    rows, other collections are untouched."""
    target = partition_path(df.sparkSession, path, "collection", collection)
    df.drop("collection").write.mode("overwrite").format(fmt).save(target)


def write_vectors(df: DataFrame, path: str, collection: str, key: str = "doc_id") -> None:
    """Keyed vector sink (Parquet): rows carry their key, so no positional alignment."""
    write_collection(df.select(key, "vector"), path, collection)


def write_records(df: DataFrame, path: str, fmt: str = "json", mode: str = "overwrite") -> None:
    df.write.mode(mode).format(fmt).save(path)


def write_stat(df: DataFrame, path: str, collection: str) -> None:
    """One-row stat sidecar (``valid_tf_content_count``) as JSON."""
    write_collection(df.select("valid_tf_content_count").coalesce(1), path, collection, "json")


def write_rejects(df: DataFrame, path: str, stage: str, collection: str) -> None:
    write_collection(df, f"{path.rstrip('/')}/stage={stage}", collection, "json")


def delete_by_term(df: DataFrame, field: str, value) -> DataFrame:
    """Rows surviving a delete-by-term (``field == value`` removed; nulls survive)."""
    return df.filter(~F.coalesce(F.col(field) == F.lit(value), F.lit(False)))


def delete_collection(spark: SparkSession, path: str, collection: str) -> None:
    """Physically drop one collection of a table partitioned by ``collection`` through the
    Hadoop FileSystem of its path; a collection that is not there is an error."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(partition_path(spark, path, "collection", collection))
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(target):
        raise FileNotFoundError(f"no collection {collection!r} under {path}")
    fs.delete(target, True)


def read_stop_words(spark: SparkSession, path: str) -> DataFrame:
    """One word per line -> ``(term)``."""
    return spark.read.text(path).select(F.trim(F.col("value")).alias("term")).filter(F.col("term") != "")
