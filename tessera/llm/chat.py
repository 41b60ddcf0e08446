"""Chat formatting: logged conversations that are snapshots of longer ones are dropped, the
maximal ones rendered.

A log may hold a conversation after every turn. Each turn's (turn, role, text) is hashed to 128
bits; running sums of the hashes in turn order are the rolling hashes of the conversation's
prefixes (a turn's number is part of its hash, so order counts). The last prefix is the
conversation itself. A prefix that more conversations pass through than end at is extended by a
longer one; an anti-join keeps the conversations whose own hash is not extended, and of equal
conversations the one with the smallest id. These are rendered with a chat template.

DataFrame operations only. Conversations are cut into segments of ``SEGMENT`` turn numbers: running
sums are taken per segment and offset by the segments' totals, and a conversation is rendered one row
a segment, so a conversation whose turns are numbered passes through many tasks whatever its length.
Segments go by number, not by place: the rows of one conversation that share a turn number, or have
none, are sorted and rendered together in one task.

Defined results: rows repeated within a conversation count once; different rows with one turn
number all stay, in order of role and text; a null conversation id is an id like any other (the
smallest non-null id represents a group of equals); null turns come first; null role or text
hash as nulls and are rendered as ``unknown`` and as nothing; empty tables give empty results;
template marks inside texts are broken up; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bucketed_prefix, cut

SEGMENT = 1_024
_PARTS = ["one", "p", "q", "r", "s"]


def _hash(seed: int, *cols: Column) -> Column:
    """xxhash64 in which nulls count as such."""
    return F.xxhash64(F.lit(seed), *[x for c in cols for x in (c.isNull(), c)])


def _halves(h: Column) -> tuple[Column, Column]:
    return F.shiftrightunsigned(h, 32), h.bitwiseAND(F.lit(0xFFFFFFFF))


def segment(turn: Column) -> Column:
    return F.coalesce(F.floor(turn / SEGMENT), F.lit(-(1 << 52))).cast("long")


def maximal(turns: DataFrame) -> DataFrame:
    """(conv_id, copies) of the conversations that are no proper prefix of another; ``turns`` has
    conv_id, turn, role, text."""
    digests = turns.select("conv_id", "turn", "role", _hash(1, F.col("turn"), F.col("role"), F.col("text")).alias("a"),
                           _hash(2, F.col("turn"), F.col("role"), F.col("text")).alias("b")).distinct()
    p, q = _halves(F.col("a"))
    r, s = _halves(F.col("b"))
    rows = cut(digests.select("conv_id", "turn", "role", "a", "b", segment(F.col("turn")).alias("segment"), F.lit(1).cast("long").alias("one"),
                              p.alias("p"), q.alias("q"), r.alias("r"), s.alias("s")))
    order = [F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("a"), F.col("b")]
    run = bucketed_prefix(rows, ["conv_id"], "segment", order, _PARTS)
    prefixes = run.select(*[(F.col(c) + F.col(f"{c}_before")).alias(c) for c in _PARTS])
    finals = cut(rows.groupBy("conv_id").agg(*[F.sum(c).alias(c) for c in _PARTS]))
    passing = prefixes.withColumn("n", F.lit(1)).union(finals.select(*_PARTS).withColumn("n", F.lit(-1)))
    extended = passing.groupBy(*_PARTS).agg(F.sum("n").alias("n")).where("n > 0")
    whole = finals.groupBy(*_PARTS).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"))
    return whole.join(extended, _PARTS, "left_anti").select("conv_id", "copies")


def rendered() -> Column:
    """Aggregate: a group's (turn, role, text) rows, sorted, in the chat template."""
    line = lambda t: F.concat(F.lit("<|"), F.coalesce(t["role"], F.lit("unknown")), F.lit("|>\n"),
                              F.replace(F.coalesce(t["text"], F.lit("")), F.lit("<|"), F.lit("< |")), F.lit("<|end|>\n"))
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), line), "")


def collapse(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, segment, n_turns, copies, rendered): the maximal conversations, one row for each
    ``SEGMENT`` turns; ``copies`` counts the equal conversations it stands for."""
    turns = turns.select(F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    kept = cut(maximal(turns)).select(F.col("conv_id").alias("_id"), "copies")
    chosen = turns.join(kept, F.col("conv_id").eqNullSafe(F.col("_id"))).select("conv_id", "copies", "turn", "role", "text").distinct()
    return chosen.groupBy("conv_id", segment(F.col("turn")).alias("segment")).agg(
        F.count("*").alias("n_turns"), F.first("copies").alias("copies"), rendered().alias("rendered"))
