"""Registered queries ``opN_<name>``: each applies its operator to its whole table and derives
the digest columns of its contract from the operator's outputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, langid, mixing, negatives, packing, pieces, pii, quality, rules, simhash, topk, toxicity, trie
from .common import fold, table

#: Name of the tokenizer model among the installed public tokenizers.
PIECE_MODEL = "piece_bpe_32k.model"
#: The tokenizer whose ids are packed into sequences.
BYTE_MODEL = "byte_bpe_50k.json"

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(fn):
    REGISTRY[fn.__name__] = fn
    return fn


def piece_model() -> bytes:
    import public_tokenizers

    with open(public_tokenizers.path(PIECE_MODEL), "rb") as f:
        return f.read()


def byte_model() -> str:
    import public_tokenizers

    with open(public_tokenizers.path(BYTE_MODEL), encoding="utf-8") as f:
        return f.read()


@register
def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    count = lambda k: F.size(F.filter("spans", lambda s: s["base"] & (s["k"] == k))).cast("long")
    return found.select("doc_id", *[count(i).alias(f"n_{kind}") for i, kind in enumerate(pii.KINDS)],
                        F.sha2(pii.written(base).cast("binary"), 256).alias("base_sha256"), pii.written(F.col("spans")).alias("spans"))


@register
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = fold(F.col("doc_id"), 5) == 0
    model = quality.fit(docs.where(~held_out), labels.where(~held_out & (F.col("quality") == 1)))
    return docs.select("doc_id", held_out.alias("held_out"), quality.score(docs, model).alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.3).cast("int"))


@register
def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", pieces.digests(spark, F.col("text"), piece_model()).alias("r")).select("doc_id", "r.*")


@register
def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold(F.col("doc_id"), 4) == 2
    model = langid.fit(docs.where(~held_out))
    return docs.select("doc_id", held_out.alias("held_out"), langid.predict(docs, model).alias("r")).select(
        "doc_id", "held_out", F.col("r.lang").alias("lang_pred"), "r.score", "r.rejected")


@register
def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.collapse(table(spark, sf_dir, "conversations"))


@register
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(fold(F.col("doc_id"), 5) != 0))
    return docs.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), toxicity.score(docs, model).alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int"))


@register
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


@register
def op8_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


@register
def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.pmod("vec_id", F.lit(50)) == 0, k=5)


@register
def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), size=3, radius=2)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@register
def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.statistics(table(spark, sf_dir, "conversations"))


@register
def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, sf_dir, "embeddings"), label, F.pmod("vec_id", F.lit(50)) == 0)


@register
def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), byte_model())
