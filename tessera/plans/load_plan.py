"""Offline load: raw line-JSON records -> prepared, encoded, indexed tables.

``read -> malformed lines aside -> prepare (facts, validity, citations, dates, provenance) ->
rejects + stats -> encode facts -> attach vectors -> documents -> postings -> index``. Every output is
partitioned by collection and a run replaces its collection's partition, so a rerun leaves the
same tables and other collections are untouched; with ``LoadPaths.index`` the collection becomes a
segment of the search index in place of its former one. Records are keyed by collection, file and line.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.facts import truthy
from ..operators import analysis as an
from ..operators import prep as pr
from ..operators import vectors as vx
from ..operators.segments import Index
from ..session import ensure_checkpoint_dir
from ..sources import io as sio


@dataclass
class LoadPaths:
    documents: str
    vectors: str
    postings: str
    rejects: str
    stats: str
    index: str | None = None


def record_key(collection: Column, file: Column, line: Column) -> Column:
    """64-bit key of a record: its collection, its file's name and its line in the file."""
    return F.xxhash64(collection, F.element_at(F.split(file, "/"), -1), line)


def keyed(raw: DataFrame, collection: Column, start: int = 0, end: int = 0) -> DataFrame:
    """Raw line-JSON rows (malformed ones included, so that lines count) with ``collection``,
    ``line_no`` and the key as ``doc_id``; optionally a line range of every file."""
    numbered = sio.line_range(raw, start, end, "line_no", keep_file=True).withColumn("collection", collection)
    key = record_key(F.col("collection"), F.col("_file"), F.col("line_no"))
    renamed = {"legal_base": "legal_base_raw", "publish_date": "publish_date_raw", "doc_id": "source_doc_id"}
    return numbered.withColumnsRenamed({a: b for a, b in renamed.items() if a in numbered.columns}).withColumn("doc_id", key)


def parsed(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(case rows, malformed lines) of keyed rows."""
    good, bad = sio.split_malformed(rows)
    return good.drop("_file", "line_no", "source_doc_id"), bad.select("collection", "_file", "line_no", "_corrupt")


def index_at(spark: SparkSession, path: str) -> Index:
    """The newest version of the segmented index, created empty if there is none."""
    try:
        return Index.open(spark, path)
    except FileNotFoundError:
        return Index.create(spark, path)


def offline_load(spark: SparkSession, path: str, paths: LoadPaths, collection: str, encoder=None,
                 dims: int = vx.DEFAULT_DIMS, start: int = 0, end: int = 0, metric: str = "cos", patterns=None) -> DataFrame:
    ensure_checkpoint_dir(spark)
    rows = keyed(sio.read_case_lines(spark, path), F.lit(collection), start, end).checkpoint(eager=True)
    cases, malformed = parsed(rows)
    prepared = pr.prepare_cases(cases, patterns=patterns).checkpoint(eager=True)
    sio.write_rejects(malformed, paths.rejects, "parse", collection)
    sio.write_rejects(pr.filter_rejects(prepared), paths.rejects, "filter", collection)
    sio.write_rejects(pr.legal_base_rejects(prepared).select("doc_id", "legal_base_raw"), paths.rejects, "legal_base", collection)
    sio.write_stat(pr.prep_stats(prepared), paths.stats, collection)
    with_facts = prepared.filter(truthy("basics_text"))
    if encoder is not None:
        vecs = with_facts.select("doc_id", vx.by_metric(encoder(F.col("basics_text")), metric).alias("vector"))
    else:
        vecs = vx.hash_encode(with_facts, "basics_text", dims=dims)
    sio.write_vectors(vecs, paths.vectors, collection)
    written = spark.read.parquet(sio.partition_path(spark, paths.vectors, "collection", collection))
    docs = pr.attach_vector(prepared, written)
    sio.write_collection(docs, paths.documents, collection)
    sio.write_collection(an.by_term(an.postings(prepared, "content")), paths.postings, collection)
    if paths.index:
        index_at(spark, paths.index).load(prepared.select("doc_id", "content", "basics_text"), collection)
    return docs
