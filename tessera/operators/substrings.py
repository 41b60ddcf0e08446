"""Substring search on a persisted trigram index, survivors verified.

Layout under ``path``: ``texts`` ``(w, bit, doc_id, text)`` in order of ``w``, a window of 64 texts where they lie;
``grams`` ``(gram, w, bits)`` in (gram, w) order: which texts of a window hold three consecutive characters.

A pattern's windows are those that hold all its trigrams; the bitmaps' conjunction names the texts
that may hold the pattern, and only these are read and searched. Matching is exact, by code point and
case. Patterns under three characters have no trigram and scan the texts. A pattern that is
null or empty finds nothing; texts that are null hold nothing; documents without an id are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Windows and trigrams that are pushed into a scan as a list; more are joined.
FEW = 2_000
_TRIGRAMS = r"(?s)(?=(.{3}))"


def trigrams(text) -> Column:
    """The distinct trigrams of a text, in one pass over it."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(_TRIGRAMS), 1))


def build(docs: DataFrame, path: str, text_col: str = "content") -> None:
    """Index ``text_col`` of ``docs`` (doc_id, text)."""
    spark, path = docs.sparkSession, path.rstrip("/")
    m = F.monotonically_increasing_id()
    rows = docs.where(F.col("doc_id").isNotNull() & F.col(text_col).isNotNull()).select(m.alias("m"), "doc_id", F.col(text_col).alias("text"))
    rows.select(F.shiftright("m", 6).alias("w"), F.col("m").bitwiseAND(63).cast("int").alias("bit"), "doc_id", "text").write.mode("overwrite").parquet(f"{path}/texts")
    texts = spark.read.parquet(f"{path}/texts")
    held = texts.select("w", "bit", F.explode(trigrams("text")).alias("gram"))
    grams = held.groupBy("gram", "w").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"))
    grams.repartitionByRange("gram", "w").sortWithinPartitions("gram", "w").write.mode("overwrite").parquet(f"{path}/grams")


def find(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """``(doc_id)`` of the texts that hold ``pattern``."""
    patterns = spark.createDataFrame([(0, pattern)], "pid int, pattern string")
    return find_table(patterns, path, "pid", "pattern").select("doc_id")


def find_table(patterns: DataFrame, path: str, pid: str, pattern) -> DataFrame:
    """``(pid, doc_id)``: for every row of a pattern table the texts that hold its pattern."""
    spark, path = patterns.sparkSession, path.rstrip("/")
    from ..session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    p = patterns.select(F.col(pid).alias("pid"), F.col(pattern).alias("pattern") if isinstance(pattern, str) else pattern.alias("pattern"))
    p = p.where(F.length("pattern") > 0).withColumn("grams", trigrams("pattern")).checkpoint()
    texts = spark.read.parquet(f"{path}/texts")
    asked = p.where(F.size("grams") > 0)
    each = asked.select("pid", "pattern", F.size("grams").alias("need"), F.explode("grams").alias("gram"))
    grams = _few(spark.read.parquet(f"{path}/grams"), each, "gram")
    # A row of the pattern table that repeats a pid is a pattern of its own.
    met = each.join(grams, "gram").groupBy("pid", "pattern", "w").agg(F.count("*").alias("n"), F.first("need").alias("need"), F.bit_and("bits").alias("bits"))
    candidates = met.where("n = need and bits <> 0").select("pid", "pattern", "w", "bits").checkpoint()
    near = _few(texts, candidates, "w").join(candidates, "w").where("shiftright(bits, bit) & 1 = 1")
    found = near.where(F.expr("instr(text, pattern) > 0")).select("pid", "doc_id")
    short = p.where(F.size("grams") == 0)
    if short.isEmpty():
        return found
    few = [r["pattern"] for r in short.select("pattern").distinct().collect()]  # one or two characters each
    holds = F.array(*[F.when(F.instr("text", x) > 0, F.lit(x)) for x in few]) if len(few) <= FEW else None
    if holds is None:
        parts = F.array_distinct(F.concat(F.split("text", ""), F.regexp_extract_all("text", F.lit(r"(?s)(?=(.{2}))"), 1)))
    else:
        parts = F.filter(holds, lambda x: x.isNotNull())
    return found.unionByName(texts.select("doc_id", F.explode(parts).alias("pattern")).join(short.select("pid", "pattern"), "pattern").select("pid", "doc_id"))


def _few(table: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Rows of ``table`` whose key is wanted: through the scan's filter, or a join beyond ``FEW`` keys."""
    keys = [r[0] for r in wanted.select(key).distinct().limit(FEW + 1).collect()]
    return table.where(F.col(key).isin(keys)) if len(keys) <= FEW else table.join(wanted.select(key).distinct(), key, "left_semi")
