"""Conversation prefix trie: every distinct prefix of the rebuilt conversations is a node, and sums
over subtrees are rolled up by a centroid decomposition of the parent edges.

**Trie.** Turns are numbered by one range sort. A conversation's prefix of ``d`` turns is named by
running sums of its turns' 128-bit hashes (the turn's place is part of its hash), so equal prefixes
of different conversations meet in one aggregation. A node is called by its smallest member and
its depth, (conv_id, depth); the ancestors of a node are the shorter prefixes of its own
smallest member, so the path from a node to any ancestor is a range of depths of one conversation.

**Rollup.** A component of the forest is a connected set of nodes with one top. A round takes from
every component that is too large its centroid (the lowest node that holds at least half of the
component), which cuts it into the subtrees below the centroid and the rest above. The totals of
the centroid and of what lies below it are added to the nodes on the path from the centroid to the
component's top, and the path's subtree sizes fall by the same cut. Components halve, so ``log2(N /
LEAF)`` rounds leave components of at most ``LEAF`` nodes, which are dealt to tasks in bins; each
task goes on with the same decomposition down to single nodes in numpy. However long or bushy the
trie is, no task holds more than a bin and no round walks the depth of the tree. Only the sizes by
which the first centroids are chosen are counted outright, over the path table.

Hot groups: a conversation is worked on in segments of ``SEGMENT`` turns, members of one prefix in
``SALTS`` parts. The list of conversations that end at a node is joined in chunks of ids and
hashed as a stream; the last step of one node's SHA-256 is sequential by definition.

Defined results: rows without a conversation id take no part; a null role or text is empty; a null
turn comes first; turns of one number go by role and text, and repeated rows are turns each; extra
columns are ignored; an empty table has no nodes, not even a root.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, bucketed_prefix, stored

#: Turns of a segment, parts of a prefix's members, largest component of a task, ids of a chunk (2 ** CHUNK).
SEGMENT, SALTS, LEAF, CHUNK = 1_024, 256, 65_536, 12
#: Components under this size are never cut over the cluster, however many tasks are free.
SMALL = 4_096
#: Rows of a table that is copied to every task; larger ones are joined by shuffles.
FEW = 100_000
_PARTS = ["p", "q", "r", "s"]


# ---------------------------------------------------------------------------------------
# turns


def positions(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((conv_id, part, m, a, b, bytes), (conv_id, part, low, before)): turns in order and where
    their runs start; the place of a turn in its conversation is ``m - low + before + 1``. Rows
    are range-sorted, so a long conversation spans partitions; rows alike up to the first
    characters of long texts share one."""
    rows = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("at"))
    plain, short = F.length("role") <= 32, F.length("text") <= 64
    by = ["conv_id", "turn", F.substring("role", 1, 32), F.when(plain, F.substring("text", 1, 64)).asc_nulls_last(),
          F.when(plain & short, F.col("at")).asc_nulls_last()]
    placed = stored(rows.repartitionByRange(*by).sortWithinPartitions("conv_id", "turn", "role", "text").select(
        "conv_id", F.xxhash64(F.lit(1), "role", "text").alias("a"), F.xxhash64(F.lit(2), "role", "text").alias("b"),
        F.octet_length("text").cast("long").alias("bytes"), F.monotonically_increasing_id().alias("m"))
        .withColumn("part", F.shiftright("m", 33)))
    runs = placed.groupBy("conv_id", "part").agg(F.min("m").alias("low"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return placed, runs.withColumn("before", before)


def rebuilt(turns: DataFrame, every: int = 5, heads: int = 9) -> tuple[DataFrame, DataFrame]:
    """((conv_id, depth, a, b, bytes), (conv_id, depth)): every conversation ``c`` begins with the
    first ``h = crc32(c) % heads`` turns of conversation ``c - c % every`` and goes on with its own
    turns after its first ``h``; the second table gives all lengths, 0 included."""
    placed, runs = positions(turns)
    runs = stored(runs)
    c = F.col("conv_id")
    convs = runs.groupBy("conv_id").agg(F.sum("n").alias("n")).select(
        "conv_id", "n", (c - c % every).alias("base"), (F.crc32(c.cast("string").cast("binary")) % heads).alias("h"))
    bases = convs.select(c.alias("base"), F.col("n").alias("base_n"))
    convs = stored(convs.join(bases, "base", "left").withColumn("lent", F.least("h", F.coalesce("base_n", F.lit(0)))))
    place = runs.join(convs.select("conv_id", "h", "lent"), "conv_id")
    numbered = placed.join(place.select("conv_id", "part", "low", "before", "h", "lent"), ["conv_id", "part"]).withColumn(
        "pos", F.col("m") - F.col("low") + F.col("before") + 1)
    own = numbered.where("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("lent")).alias("depth"), "a", "b", "bytes")
    first = numbered.where((F.col("pos") < heads) & (c % every == 0)).select(c.alias("base"), F.col("pos").alias("depth"), "a", "b", "bytes")
    lent = first.join(convs.select("conv_id", "base", "h"), "base").where("depth <= h").select("conv_id", "depth", "a", "b", "bytes")
    lengths = convs.select("conv_id", (F.col("lent") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("depth"))
    return own.unionByName(lent), lengths


# ---------------------------------------------------------------------------------------
# nodes


@dataclass
class Trie:
    """``paths`` (conv_id, depth, owner, up): the node (owner, depth) that a conversation passes
    and its parent's owner, for conversations that own nodes; ``nodes`` (owner, depth, up, n_convs,
    bytes); ``ends`` (owner, depth, conv_id); ``count`` of nodes."""

    paths: DataFrame
    nodes: DataFrame
    ends: DataFrame
    count: int


def segment(depth: Column) -> Column:
    return F.floor(depth / SEGMENT).cast("long")


def build(turns: DataFrame, lengths: DataFrame) -> Trie | None:
    """The trie of (conv_id, depth from 1 without gaps, a, b, bytes) and of (conv_id, depth) for all
    conversations; None without any."""
    root = lengths.agg(F.min("conv_id"), F.count("*")).first()
    if not root[1]:
        return None
    low32 = lambda h: h.bitwiseAND(F.lit(0xFFFFFFFF))
    here = lambda seed, c: F.xxhash64(F.lit(seed), "depth", c)
    rows = turns.withColumn("x", here(1, "a")).withColumn("y", here(2, "b")).select(
        "conv_id", "depth", "bytes", segment(F.col("depth")).alias("segment"),
        F.shiftrightunsigned("x", 32).alias("p"), low32(F.col("x")).alias("q"), F.shiftrightunsigned("y", 32).alias("r"), low32(F.col("y")).alias("s"))
    run = bucketed_prefix(stored(rows), ["conv_id"], "segment", [F.col("depth")], _PARTS)
    upto = {c: F.col(c) + F.col(f"{c}_before") for c in _PARTS}
    named = stored(run.select("conv_id", "depth", "bytes", F.xxhash64(F.lit(3), upto["p"], upto["q"], "depth").alias("k"),
                           F.xxhash64(F.lit(4), upto["r"], upto["s"], "depth").alias("l"),
                           F.pmod(F.xxhash64("conv_id"), F.lit(SALTS)).alias("salt")))
    # Members of one prefix meet in parts first; the parts, not the members, learn the owner.
    key = ["depth", "k", "l"]
    parts = stored(named.groupBy(*key, "salt").agg(F.min("conv_id").alias("low"), F.count("*").alias("n"), F.first("bytes").alias("bytes")))
    whole = stored(parts.groupBy(*key).agg(F.min("low").alias("owner"), F.sum("n").alias("n_convs"), F.first("bytes").alias("bytes")))
    owners = parts.select(*key, "salt").join(whole.select(*key, "owner"), key)
    owned = named.select("conv_id", *key, "salt").join(owners, [*key, "salt"]).select("conv_id", "depth", "owner")
    top = lengths.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(root[0]).alias("owner"))
    every = stored(owned.unionByName(top))
    above = every.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("owner").alias("up"))
    paths = stored(every.join(above, ["conv_id", "depth"], "left"))
    own = paths.where("owner = conv_id").select("owner", "depth", "up")
    sized = whole.select("owner", "depth", "n_convs", "bytes").union(
        lengths.sparkSession.createDataFrame([(root[0], 0, root[1], 0)], "owner long, depth long, n_convs long, bytes long"))
    nodes = stored(own.join(sized, ["owner", "depth"]))
    ends = every.join(lengths, ["conv_id", "depth"]).select("owner", "depth", "conv_id")
    return Trie(paths, nodes, ends, nodes.count())


def sizes(trie: Trie) -> DataFrame:
    """(owner, depth, w): nodes in every node's subtree. A conversation owns the nodes of its last
    turns, ``first`` to ``last``; each of its prefixes holds those below it."""
    held = trie.nodes.groupBy("owner").agg(F.min("depth").alias("first"), F.max("depth").alias("last"))
    spread = held.select(F.col("owner").alias("conv_id"), "first", "last", F.explode(F.sequence(F.lit(0).cast("long"), segment(F.col("last")))).alias("segment"))
    rows = trie.paths.withColumn("segment", segment(F.col("depth"))).join(spread, ["conv_id", "segment"])
    return rows.groupBy("owner", "depth").agg(F.sum(F.col("last") + 1 - F.greatest("depth", "first")).alias("w"))


# ---------------------------------------------------------------------------------------
# centroid decomposition


def roll_up(parent: np.ndarray, sizes: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums over the subtrees of a forest by centroid decomposition; ``parent`` gives indices, -1
    above a top, ``sizes`` the nodes in each subtree."""
    n = len(parent)
    w, added, total = sizes.copy(), np.zeros_like(values), np.zeros_like(values)
    gone = np.zeros(n, bool)
    top = _tops(parent, gone)
    while not gone.all():
        alive = np.flatnonzero(~gone)
        heavy = alive[2 * w[alive] >= w[top[alive]]]
        heavy = heavy[np.lexsort((w[heavy], top[heavy]))]
        centre = heavy[np.concatenate([[True], top[heavy][1:] != top[heavy][:-1]])]
        of = np.full(n, -1)
        of[top[centre]] = np.arange(len(centre))
        gone[centre] = True
        now = _tops(parent, gone)
        over = parent[now]
        below = alive[~gone[alive] & (over[alive] >= 0)]
        below = below[over[below] == centre[of[top[below]]]]
        sums = values[centre].copy()
        np.add.at(sums, of[top[below]], values[below])
        total[centre] = added[centre] + sums
        # One path a component, all walked side by side.
        step = np.flatnonzero(centre != top[centre])
        at = parent[centre[step]]
        while len(step):
            added[at] += sums[step]
            w[at] -= w[centre[step]]
            on = at != top[centre[step]]
            step, at = step[on], parent[at[on]]
        top = now
    return total


def _tops(parent: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """Top of every node's component once the ``gone`` nodes are taken out."""
    at = np.arange(len(parent))
    up = np.where((parent >= 0) & ~gone & ~gone[np.maximum(parent, 0)], parent, at)
    while True:
        nxt = up[up]
        if (nxt == up).all():
            return up
        up = nxt


def _split(state: DataFrame, paths: DataFrame, big: DataFrame, values: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """One round over the components named in ``big`` (comp, comp_depth, size): (state, finished)."""
    few = big.count() <= FEW
    small = (lambda t: F.broadcast(t)) if few else (lambda t: t)
    comp = ["comp", "comp_depth"]
    inside = state.join(small(big), comp)
    centre = inside.where(2 * F.col("w") >= F.col("size")).groupBy(*comp).agg(
        F.min_by(F.struct("owner", "depth", "w"), "w").alias("c")).select(*comp, F.col("c.owner").alias("c_owner"), F.col("c.depth").alias("c_depth"), F.col("c.w").alias("c_w"))
    centre = stored(centre)
    state = state.join(small(centre), comp, "left")
    # Nodes of one owner in a component lie on one path: their segments learn the new top together.
    asking = state.where("depth > c_depth").select("owner", segment(F.col("depth")).alias("segment"), *comp, "c_owner", "c_depth").distinct()
    step = paths.select(F.col("conv_id").alias("owner"), (F.col("depth") - 1).alias("c_depth"), F.col("owner").alias("new"), F.col("up").alias("c_owner"))
    told = asking.join(step, ["owner", "c_depth", "c_owner"]).select("owner", "segment", *comp, "new")
    state = state.withColumn("segment", segment(F.col("depth"))).join(told, ["owner", "segment", *comp], "left").withColumn(
        "below", F.col("new").isNotNull() & (F.col("depth") > F.col("c_depth"))).withColumn(
        "is_c", F.coalesce((F.col("owner") == F.col("c_owner")) & (F.col("depth") == F.col("c_depth")), F.lit(False)))
    state = stored(state)
    sums = state.where("below or is_c").groupBy(*comp).agg(*[F.sum(v).alias(f"sum_{v}") for v in values])
    sums = stored(centre.join(sums, comp))
    up = sums.where("c_depth > comp_depth").select(F.col("c_owner").alias("conv_id"), F.explode(F.sequence("comp_depth", F.col("c_depth") - 1)).alias("depth"),
                                                   "c_w", *[f"sum_{v}" for v in values])
    final = state.where("is_c").join(small(sums.select(*comp, *[f"sum_{v}" for v in values])), comp).select(
        "owner", "depth", *[(F.col(f"add_{v}") + F.col(f"sum_{v}")).alias(v) for v in values])
    zero = F.lit(0).cast("long")
    given = up.join(paths.select("conv_id", "depth", "owner"), ["conv_id", "depth"]).select(F.col("owner").alias("g_owner"), F.col("depth").alias("g_depth"), F.col("c_w").alias("g_w"), *[F.col(f"sum_{v}").alias(f"g_{v}") for v in values])
    rest = state.where("not is_c").join(given, (F.col("owner") == F.col("g_owner")) & (F.col("depth") == F.col("g_depth")), "left")
    rest = rest.select("owner", "depth", "up", F.when(F.col("below"), F.col("new")).otherwise(F.col("comp")).alias("comp"),
                       F.when(F.col("below"), F.col("c_depth") + 1).otherwise(F.col("comp_depth")).alias("comp_depth"),
                       (F.col("w") - F.coalesce("g_w", zero)).alias("w"), *values,
                       *[(F.col(f"add_{v}") + F.coalesce(f"g_{v}", zero)).alias(f"add_{v}") for v in values])
    return stored(rest), final


def subtree_sums(trie: Trie, nodes: DataFrame, values: Sequence[str], leaf: int | None = None) -> DataFrame:
    """(owner, depth, values): every node's ``values`` summed over its subtree. ``nodes`` has owner,
    depth, up and the values; ``leaf`` is the largest component one task may take."""
    values = list(values)
    target = leaf or min(LEAF, max(SMALL, trie.count // 64))
    top = trie.nodes.where("depth = 0").select("owner").first()[0]
    state = nodes.join(sizes(trie), ["owner", "depth"]).select(
        "owner", "depth", "up", F.lit(top).alias("comp"), F.lit(0).cast("long").alias("comp_depth"), "w", *values,
        *[F.lit(0).cast("long").alias(f"add_{v}") for v in values])
    state, finished = stored(state), []
    while True:
        big = stored(state.groupBy("comp", "comp_depth").agg(F.max("w").alias("size")).where(F.col("size") > target))
        if big.isEmpty():
            break
        state, done = _split(state, trie.paths, big, values)
        finished.append(done)
    bins = max(1, math.ceil(2 * trie.count / target))

    def within(frame: pd.DataFrame) -> pd.DataFrame:
        owner, depth = frame["owner"].to_numpy(), frame["depth"].to_numpy()
        index = pd.MultiIndex.from_arrays([owner, depth])
        inner = (owner != frame["comp"].to_numpy()) | (depth != frame["comp_depth"].to_numpy())
        parent = np.full(len(frame), -1)
        parent[inner] = index.get_indexer(pd.MultiIndex.from_arrays([frame["up"].to_numpy()[inner].astype(np.int64), depth[inner] - 1]))
        raw = frame[values].to_numpy(np.int64)
        out = roll_up(parent, frame["w"].to_numpy(np.int64), raw) + frame[[f"add_{v}" for v in values]].to_numpy(np.int64)
        return pd.DataFrame({"owner": owner, "depth": depth, **{v: out[:, i] for i, v in enumerate(values)}})

    schema = "owner long, depth long, " + ", ".join(f"{v} long" for v in values)
    rest = state.withColumn("bin", F.pmod(F.xxhash64("comp", "comp_depth"), F.lit(bins))).groupBy("bin").applyInPandas(within, schema)
    for done in finished:
        rest = rest.unionByName(done)
    return rest


# ---------------------------------------------------------------------------------------
# ends


def end_hashes(ends: DataFrame) -> DataFrame:
    """(owner, depth, ends_sha256): SHA-256 of the ascending, comma-joined ids that end at a node.
    Ids are joined in chunks of 2 ** CHUNK consecutive numbers; a node's chunks stream through one hash."""
    bounded_batches()
    chunks = ends.groupBy("owner", "depth", F.shiftright("conv_id", CHUNK).alias("chunk")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))
    ordered = chunks.repartition("owner", "depth").sortWithinPartitions("owner", "depth", "chunk")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, h = None, None
        for batch in batches:
            done = []
            for owner, depth, ids in zip(*[batch.column(c).to_pylist() for c in ("owner", "depth", "ids")]):
                if (owner, depth) == last:
                    h.update(b"," + ids.encode())
                    continue
                if last is not None:
                    done.append((*last, h.hexdigest()))
                last, h = (owner, depth), hashlib.sha256(ids.encode())
            yield _ends(done)
        if last is not None:
            yield _ends([(*last, h.hexdigest())])

    return ordered.mapInArrow(stream, "owner long, depth long, ends_sha256 string")


def _ends(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (("owner", pa.int64()), ("depth", pa.int64()), ("ends_sha256", pa.string()))
    return pa.RecordBatch.from_pydict({name: pa.array([r[i] for r in rows], kind) for i, (name, kind) in enumerate(kinds)})


def statistics(turns: DataFrame, every: int = 5, heads: int = 9, leaf: int | None = None) -> DataFrame:
    """One row per node of the trie of the rebuilt conversations: (conv_id, depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256); ``saved_tokens`` counts the bytes that a
    prefix cache keeps from being read again below the node."""
    spark = turns.sparkSession
    rows, lengths = rebuilt(turns, every, heads)
    trie = build(rows, stored(lengths))
    if trie is None:
        return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    children = trie.nodes.where("depth > 0").groupBy(F.col("up").alias("owner"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    nodes = stored(trie.nodes.join(children, ["owner", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long"))
                .withColumn("n_leaves", (F.col("n_children") == 0).cast("long")).withColumn("saved_tokens", (F.col("n_convs") - 1) * F.col("bytes")))
    sums = subtree_sums(trie, nodes.select("owner", "depth", "up", "n_leaves", "saved_tokens"), ["n_leaves", "saved_tokens"], leaf)
    out = nodes.drop("n_leaves", "saved_tokens").join(sums, ["owner", "depth"]).join(end_hashes(trie.ends), ["owner", "depth"], "left")
    return out.select(F.col("owner").alias("conv_id"), "depth", F.col("up").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
                      F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
