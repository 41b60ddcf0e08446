"""Driver tables and the deterministic ``cases`` / ``case_vectors`` views derived from them.

The ``cases`` view turns the generic ``documents`` table into court-record-shaped rows
(fact cues around the text, titles, citations, dates with malformed values). Its column
expressions are SQL text valid in both Spark SQL and DuckDB, so the Spark side and the
oracle build byte-identical inputs; every operator under test runs on top of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DRIVER_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
                 "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

_LAW_A = ("concat('[{\"法规名称\":\"《合同法》\",\"条文\":[{\"a\":\"第', CAST(doc_id % 7 AS STRING), "
          "'条\"},{\"a\":\"第二条\"}]}]')")
_LAW_B = "concat('[{\"fgmc\":\"《民法》\",\"tkx\":\"第', CAST(doc_id % 7 AS STRING), '条\"}]')"
_LAW_BAD = ("concat('[{\"fgmc\":\"《民法》\",\"tkx\":\"第', CAST(doc_id % 7 AS STRING), "
            "'条\"},{\"zzz\":\"bad\"},{\"fgmc\":\"《刑法》\",\"tkx\":\"第一条\"}]')")

# (column, SQL expression over `documents`) in output order.
CASES_COLUMNS: list[tuple[str, str]] = [
    ("doc_id", "doc_id"),
    ("collection", "concat('p', CAST(doc_id % 3 + 1 AS STRING))"),
    ("case_id", "concat('（', CAST(2010 + doc_id % 10 AS STRING), '）民初字第', CAST(doc_id AS STRING), '号')"),
    ("case_name", "CASE doc_id % 5 WHEN 0 THEN concat('案', CAST(doc_id AS STRING), ' 民事裁定 书') WHEN 1 THEN '决定书' "
                  "WHEN 2 THEN NULL ELSE concat('案', CAST(doc_id AS STRING), ' 判决书') END"),
    # Every record holds its whole text: where the content is empty, the facts hold it.
    ("content", "CASE WHEN doc_id % 4 = 0 THEN concat('经审理查明，', text, '本院认为，证据确实。') "
                "WHEN doc_id % 4 = 1 THEN concat('公诉机关指控：', text, '公诉机关认为有罪') "
                "WHEN doc_id % 8 = 3 THEN '' ELSE text END"),
    ("basics_text", "CASE doc_id % 8 WHEN 3 THEN concat('本院查明：', text, '上述事实') WHEN 0 THEN text ELSE NULL END"),
    ("court_name", "source"),
    ("court_province", "lang"),
    ("case_type", "CASE doc_id % 3 WHEN 0 THEN '民事' WHEN 1 THEN '刑事' ELSE '行政' END"),
    ("trial_round", "CASE doc_id % 4 WHEN 0 THEN '一审' WHEN 1 THEN '二审' WHEN 2 THEN '再审' ELSE '' END"),
    ("publish_date_raw", "CASE WHEN doc_id % 11 = 0 THEN 'n/a' ELSE concat(CAST(2010 + doc_id % 10 AS STRING), '-0', "
                         "CAST(1 + doc_id % 9 AS STRING), '-1', CAST(doc_id % 10 AS STRING)) END"),
    ("legal_base_raw", f"CASE doc_id % 5 WHEN 0 THEN {_LAW_A} WHEN 1 THEN {_LAW_B} WHEN 2 THEN {_LAW_BAD} "
                       "WHEN 3 THEN '[]' ELSE NULL END"),
]

CASES_SQL = "SELECT " + ", ".join(f"{expr} AS {name}" for name, expr in CASES_COLUMNS) + " FROM documents"
CASE_VECTORS_SQL = "SELECT vec_id AS doc_id, embedding AS vector FROM embeddings"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``documents`` table. A deployment whose text files cannot be split (a single row
    group) may name a number of partitions in ``tessera.scan.partitions``."""
    docs = read_table(spark, sf_dir, "documents")
    parts = spark.conf.get("tessera.scan.partitions", None)
    return docs.repartition(int(parts)) if parts else docs


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw case rows (before preparation) derived from ``documents``."""
    docs = documents(spark, sf_dir)
    return docs.select(*[F.expr(expr).alias(name) for name, expr in CASES_COLUMNS])


def case_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = read_table(spark, sf_dir, "embeddings")
    return emb.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))


def duckdb_prelude() -> str:
    """CTE text the oracle SQL puts in front of queries that use the derived views."""
    return f"cases AS ({CASES_SQL}), case_vectors AS ({CASE_VECTORS_SQL})"
