"""Connected components of an edge table, and of the case graph that matched sentences make.

**Contraction.** Every round lets each node that still has edges hook onto its smallest neighbour if that is
smaller, follows these hooks to their ends by doubling, and replaces both ends of every edge by the node
they lead to. Edges inside a group vanish, the others get fewer each round, and the nodes' labels are carried
along. Tables are written between the steps, so a hub's rows are plain shuffle input that adaptive
execution splits; nothing passes through the driver but counts.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def _written(df: DataFrame) -> DataFrame:
    """Lineage cut by a table in the checkpoint folder; unlike a checkpoint it forgets its plan."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/components-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _ends(hooks: DataFrame) -> DataFrame:
    """(node, to): hooks (node, to), to < node, followed to the end."""
    while True:
        on = hooks.select(F.col("node").alias("to"), F.col("to").alias("next"))
        longer = _written(hooks.join(on, "to", "left").select("node", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")))
        hooks = longer.select("node", "to")
        if longer.where("moved").isEmpty():
            return hooks


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for every node of the edges; a component is called by its smallest
    node. Loops and repeated edges do no harm, edges with a null end are left out."""
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    now = _written(pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = _written(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct().withColumn("component", F.col("node")))
    while not now.isEmpty():
        hooks = _ends(_written(now.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("to"))))

        def led(df: DataFrame, column: str) -> DataFrame:
            return df.join(hooks.select(F.col("node").alias(column), "to"), column, "left").withColumn(column, F.coalesce("to", column)).drop("to")

        moved = led(led(now, "a"), "b").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        now, labels = _written(moved), _written(led(labels, "component"))
    return labels.select("node", "component")


def case_components(matched: DataFrame, pairs: DataFrame) -> DataFrame:
    """Groups of matching sentences over all explained pairs at once.

    ``matched`` (pair_id, q_idx, c_idx) as the explanation gives it, ``pairs`` (pair_id, q_id, c_id): a
    sentence of a text is one node in whatever pairs the text takes part. One row per sentence:
    ``(q_first, q_first_idx, side, text_id, sent_idx, n_query, n_cand)``, a group called by its first query
    sentence, ``side`` 0 for queries and 1 for candidates. Groups with sentences on both sides only."""
    met = matched.join(pairs.select("pair_id", "q_id", "c_id"), "pair_id").select("q_id", "q_idx", "c_id", "c_idx").distinct()
    met = _written(met)
    node = lambda side, i, n: F.concat_ws(":", F.lit(side), F.col(i).cast("string"), F.col(n).cast("string"))
    found = components(met.select(node("0", "q_id", "q_idx").alias("a"), node("1", "c_id", "c_idx").alias("b")))
    nodes = met.select(F.lit(0).alias("side"), F.col("q_id").alias("text_id"), F.col("q_idx").alias("sent_idx"), node("0", "q_id", "q_idx").alias("node")).unionByName(
        met.select(F.lit(1).alias("side"), F.col("c_id").alias("text_id"), F.col("c_idx").alias("sent_idx"), node("1", "c_id", "c_idx").alias("node"))).distinct()
    placed = _written(nodes.join(found, "node").select("component", "side", "text_id", "sent_idx"))
    first = F.min(F.when(F.col("side") == 0, F.struct("text_id", "sent_idx")))
    groups = placed.groupBy("component").agg(first.alias("f"), F.count_if(F.col("side") == 0).alias("n_query"), F.count_if(F.col("side") == 1).alias("n_cand"))
    both = placed.join(groups.where("n_query > 0 and n_cand > 0"), "component")
    return both.select(F.col("f.text_id").alias("q_first"), F.col("f.sent_idx").alias("q_first_idx"), "side", "text_id", "sent_idx", "n_query", "n_cand")
