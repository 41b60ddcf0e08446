"""Mixing sources to target weights with exact word budgets.

Sources in code-point order (null last) weigh 3, 1, 2, repeating, and share ``SHARE`` times all
words; a target stops at ``LIMIT`` times its source's words and the excess is shared again by
weight until no target is above, which is the water level: the l with
sum(min(LIMIT * size, l * weight)) = total. Documents get a hash-random key. One range sort by
(source, key, id, size) numbers the rows; ``RANGE`` consecutive numbers are a range, also within the
rows of one id, and rows that are alike in all four, which the result cannot tell apart, go by where they
lie. Prefix sums of the word counts run over ranges and sources in parallel (``common.bucketed_prefix``); the mix takes
every document as often as whole epochs fit in the budget, then documents in key order until
the budget is used up to the word: the document the cut falls into gives the words left.

DataFrame operations only. Text is read once; what follows works on a checkpointed table of
(id, source, words, key).

Defined results: null text counts 0 words and takes 0; a source without words has target 0;
equal keys (repeated rows) are ordered by id, then words; null ids sort first; empty tables give
empty results; the key depends on the id alone, so reruns and other partitionings agree.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, bucketed_prefix, cut

WEIGHTS = (3, 1, 2)
SHARE, LIMIT = 1.5, 2
RANGE = 4_096
SALT = "mix-1"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def key(id_col: Column) -> Column:
    """Hash-random key: 32 hexadecimal digits."""
    return F.md5(F.concat(F.coalesce(id_col.cast("string"), F.lit("")), F.lit("-" + SALT)).cast("binary"))


def targets(sized: DataFrame, share: float = SHARE, limit: int = LIMIT) -> DataFrame:
    """(source, n_docs, source_size, target) of rows (source, size): one row per source, so the
    two orderings below sort a table of sources, not of documents."""
    per = sized.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (place % len(WEIGHTS) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("full", F.col("source_size") / F.col("weight"))
    # In the order in which sources reach their limit: the level if all before this one have reached
    # it and this one and all after it have not. The first source for which that holds has the level.
    ranks = Window.orderBy("full", F.col("source").asc_nulls_last())
    order = ranks.rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("at", F.row_number().over(ranks))
    whole = Window.partitionBy()
    total = F.sum("source_size").over(whole)
    below = F.coalesce(F.sum("source_size").over(order), F.lit(0))
    left = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(order), F.lit(0))
    per = per.withColumn("level", (total * F.lit(share) - below * limit) / left)
    per = per.withColumn("open", F.col("level") <= F.col("full") * limit)
    level = F.min(F.when(F.col("open"), F.struct("at", "level"))).over(whole)["level"]
    target = F.least(F.col("source_size") * F.lit(float(limit)),
                     F.coalesce(F.col("weight") * level, F.col("source_size") * F.lit(float(limit))))
    return per.select("source", "n_docs", "source_size", target.cast("double").alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: dict[str, Column] | None = None,
        ties: Sequence[str] = ()) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, and the ``carry`` columns
    (checkpointed with the sizes, so keep them small). ``ties`` names those of them that order rows of
    one id and size."""
    carry = carry or {}
    rows = cut(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"),
                           key(F.col(id_col)).alias("key"), *[c.alias(n) for n, c in carry.items()]))
    goal = cut(targets(rows))
    goals = goal.select(F.col("source").alias("_s"), "source_size", "target")
    order = ["source", "key", "doc_id", "size", *ties]
    ranged = rows.withColumn("_at", F.monotonically_increasing_id()).repartitionByRange(*order, "_at").sortWithinPartitions(*order, "_at")
    placed = cut(ranged.drop("_at").withColumn("_m", F.monotonically_increasing_id()))
    dealt = placed.withColumn("range", F.floor(F.col("_m") / RANGE)).join(goals, F.col("source").eqNullSafe(F.col("_s")))
    summed = bucketed_prefix(dealt, ["source"], "range", [F.col("_m")], ["size"])
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    rest = budget - epochs * F.col("source_size")
    more = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("size_before")))
    return summed.select("doc_id", "size", "source_size", "target", (F.col("size") * epochs + more).cast("long").alias("taken"), *carry)
