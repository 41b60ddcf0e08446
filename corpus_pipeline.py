"""Corpus pipeline: documents to token ids in five stages.

Each stage takes what its predecessor kept and calls one operator: toxic documents go, one
document of each near-duplicate group stays, personal data is replaced by its kind, sources are
mixed to their target weights, and texts are encoded with the public SentencePiece model.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import mixing, pieces, pii, queries, simhash, toxicity
from tessera.llm.common import cut, fold, stored, table


def row_key(docs: DataFrame) -> Column:
    """Hash of a whole row, told from others with the same id. Nulls do not enter xxhash64 by
    themselves, so what is null is hashed too."""
    return F.xxhash64(*docs.columns, *[F.col(c).isNull() for c in docs.columns])


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 or more as toxic go. The classifier learns from the documents it is
    given and from ``labels`` outside the held-out fold."""
    labels = table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(fold(F.col("doc_id"), 5) != 0))
    return docs.where(toxicity.score(docs, model) < 0.5)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component one row stays: the one with its smallest id; of rows that repeat that id, and
    of a component without any id, the smallest text. A component is known by its label, so two that
    share their smallest id keep a row each."""
    found = simhash.near_duplicates(docs, size=3, radius=2, carry={"_row": row_key(docs)})
    # No smaller id is in the component, so no table of groups is needed; copies of a row share its key.
    asked = found.where(F.col("component_id").isNull() | (F.col("doc_id") == F.col("component_id")))
    first = cut(asked.groupBy("_row").agg(F.first("label").alias("_label")))
    rows = docs.withColumn("_row", row_key(docs)).join(first, "_row")
    kept = rows.groupBy("_label").agg(F.min(F.struct("text", *[c for c in docs.columns if c != "text"])).alias("_r"))
    return kept.select("_r.*").select(docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span found is replaced by its kind in brackets; the texts' lengths follow. Candidates
    are found once and written beside the texts; the fit reads them alone."""
    found = stored(docs.withColumn("_found", pii.candidates(F.col("text"))))
    model = pii.fit(found.select("_found"), "_found")
    spans = pii.accepted(F.col("_found"), model)
    clean = found.withColumn("_spans", spans).withColumn("text", pii.redacted(F.col("text"), F.col("_spans")))
    return clean.withColumn("n_chars", F.when(F.size("_spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document stays as often as the mix takes it, in whole texts: the words taken, rounded
    to a multiple of the document's. A document without words is not taken. Rows of one id and
    size go by their key, so reruns take the same texts."""
    taken = mixing.mix(docs, carry={"_row": row_key(docs)}, ties=["_row"])
    times = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(0).cast("int")
    copies = cut(taken.groupBy("_row").agg(F.max(times).alias("_times")))
    rows = docs.withColumn("_row", row_key(docs)).join(copies, "_row").where("_times > 0")
    return rows.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col("_times"))).alias("_copy")).select(docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, n_tokens, ids, begin, end, decoded_sha256): the texts as ids, begin and end
    included, the byte span of every piece in the text, and the hash of what the ids decode to."""
    pieced = docs.select("doc_id", "source", pieces.encoded(spark, F.col("text"), queries.piece_model(), decode=True).alias("p"))
    return pieced.select("doc_id", "source", F.size("p.ids").cast("long").alias("n_tokens"), "p.ids", "p.begin", "p.end", "p.decoded_sha256")


STAGES = [("toxicity", toxic), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mixing", mixed), ("encoding", encoded)]

#: SQL cannot express the classifiers and the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
