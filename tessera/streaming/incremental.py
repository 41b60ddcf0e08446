"""Incremental loading of newly arrived case files with Structured Streaming.

A file-source stream over a landing directory picks up only files it has not seen (tracked in
the checkpoint). A file belongs to one micro-batch as a whole, so each batch is keyed, parsed and
prepared by the same functions as the offline load and a record gets the same key in both. A
batch is written under its own ``batch`` partition, which a retry replaces; malformed lines go to
``rejects``. ``trigger(availableNow=True)`` processes everything present and stops, so a
scheduler can run it like a batch job; rerunning it loads only files that arrived since.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.prep import prepare_cases
from ..plans.load_plan import index_at, keyed, parsed
from ..sources.schema import CASE_SCHEMA


def case_stream(spark: SparkSession, landing_dir: str, max_files_per_trigger: int | None = None) -> DataFrame:
    schema = T.StructType([*CASE_SCHEMA.fields, T.StructField("_corrupt", T.StringType())])
    reader = spark.readStream.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    raw = reader.json(landing_dir)
    return raw.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_split"))


def collection_of_file(file: str = "_file") -> F.Column:
    """Collection name = file stem of the source file (``p2-1.txt`` -> ``p2-1``)."""
    return F.substring_index(F.element_at(F.split(F.url_decode(F.col(file)), "/"), -1), ".", 1)


def start_incremental_load(spark: SparkSession, landing_dir: str, table_dir: str, checkpoint_dir: str,
                           available_now: bool = True, rejects_dir: str | None = None, patterns=None,
                           max_files_per_trigger: int | None = None, index_dir: str | None = None) -> StreamingQuery:
    """Start the load; the caller waits with ``awaitTermination()``. Malformed lines are written
    under ``rejects_dir`` (by default beside the table). With ``index_dir`` each batch becomes a
    segment of that search index; a retried batch replaces its own records."""
    rejects = rejects_dir or f"{table_dir.rstrip('/')}_rejects"

    def load(batch: DataFrame, number: int) -> None:
        rows = keyed(batch.withColumn("_row", F.monotonically_increasing_id()), collection_of_file()).persist()
        cases, malformed = parsed(rows)
        for df, path, fmt in ((prepare_cases(cases, patterns=patterns), table_dir, "parquet"), (malformed, rejects, "json")):
            out = df.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            out.partitionBy("collection", "batch").format(fmt).save(path)
        if index_dir:
            index_at(spark, index_dir).replace(prepare_cases(cases, patterns=patterns).select("doc_id", "collection", "content", "basics_text"))
        rows.unpersist()

    writer = case_stream(spark, landing_dir, max_files_per_trigger).writeStream.foreachBatch(load).option("checkpointLocation", checkpoint_dir)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
