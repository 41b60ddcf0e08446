"""SimHash near-duplicates: 64-bit fingerprints joined exactly within a Hamming radius by
vantage-point trees.

A text's fingerprint takes, bit by bit, the majority over the XXH64 values of its word shingles.
Equal fingerprints are collapsed before anything else (a group of copies of any size is one row
with its smallest id). A vantage-point tree over a bounded sample (``SAMPLE`` fingerprints, the
only ones the driver sees) cuts the space into shards: at each node a fingerprint at distance d
from the vantage point is at home inside (d <= mu) or outside, and triangle bounds tell which
other side may hold partners within the radius. It is sent as a visitor only there, so every
pair within the radius meets in exactly the home shard of one of the two. Each shard is searched
by the same tree, deeper, down to leaves that are compared bit by bit; its pairs leave the task
as a spanning forest, never as all pairs. Components of the forests are then found by
alternating star contractions over checkpointed tables.

Defined results: null texts and texts without words have fingerprint zero and link like any
other; repeated rows and repeated ids give one result row each; a component's id is its smallest
non-null document id (null if it has none); empty tables give empty results; extra columns are
not touched.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import LongType
from xxhash import xxh64_intdigest

from . import textbatch as tb
from .common import bounded_batches, cut

SEED = 42
#: Fingerprints the driver may see when it lays out the shards, wanted shard size, most shards.
SAMPLE, SHARD, MOST_SHARDS = 65_536, 1_024, 4_096
LEAF = 256


def shingle_hashes(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets per text): XXH64 of each run of ``size`` words joined by single spaces;
    a text with fewer words has one run, a text with none has none."""
    buf, offsets = tb.text_bytes(texts)
    w = tb.words(buf, offsets)
    length = w.end - w.start
    to = np.cumsum(length + 1) - (length + 1)
    joined = np.full(int((length + 1).sum()), 0x20, np.uint8)
    source = np.flatnonzero(~tb.SPACE[buf])
    joined[source + np.repeat(to - w.start, length)] = tb.LOWER[buf[source]]
    n = w.counts()
    runs = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    first = np.concatenate([[0], np.cumsum(runs)])
    begin = np.repeat(w.first[:-1] - first[:-1], runs) + np.arange(first[-1])
    last = begin + np.repeat(np.minimum(n, size), runs) - 1
    s, e = to[begin].tolist(), (to + length)[last].tolist()
    data = joined.tobytes()
    return np.fromiter((xxh64_intdigest(data[i:j], SEED) for i, j in zip(s, e)), np.uint64, len(s)), first


def majority(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per text: the bits set in more than half of its hashes (zero for a text without any)."""
    n = np.diff(first)
    out = np.zeros(len(n), np.uint64)
    some = np.flatnonzero(n)
    if len(some):
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, first[some], axis=0, dtype=np.int64)
        out[some] = np.packbits(ones * 2 > n[some][:, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprint(text: Column, size: int) -> Column:
    """Column: the fingerprint of each text as a signed 64-bit integer."""
    bounded_batches()

    @arrow_udf(LongType())
    def made(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            for part in tb.slices(batch, tb.SLICE):
                yield pa.array(majority(*shingle_hashes(part, size)).view(np.int64), pa.int64())

    return made(text)


class Tree:
    """Vantage-point tree whose leaves are shard numbers."""

    def __init__(self, points: np.ndarray, shards: int, radius: int, seed: int = 7):
        self.radius, self.nodes, self.leaves = radius, [], 0
        self.root = self._build(points, shards, np.random.default_rng(seed))

    def _build(self, points, shards, rng):
        node = split(points, self.radius, rng) if shards > 1 else None
        if node is None:
            self.leaves += 1
            return -self.leaves
        point, mu, d = node
        at = len(self.nodes)
        self.nodes.append(None)
        inside = self._build(points[d <= mu], shards // 2, rng)
        outside = self._build(points[d > mu], shards - shards // 2, rng)
        self.nodes[at] = (point, mu, inside, outside)
        return at

    def route(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the point, shard, at home): one home row each, and the visits."""
        found = []
        todo = [(self.root, np.arange(len(points)), np.ones(len(points), bool))]
        while todo:
            node, at, home = todo.pop()
            if not len(at):
                continue
            if node < 0:
                found.append((at, np.full(len(at), -node - 1), home))
                continue
            point, mu, inside, outside = self.nodes[node]
            d = distance(points[at], point)
            for child, (go, stays) in zip((inside, outside), sides(d, mu, home, self.radius)):
                todo.append((child, at[go], stays[go]))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        return tuple(np.concatenate(x) for x in zip(*found))


def distance(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int64)


def split(points: np.ndarray, radius: int, rng) -> tuple[np.uint64, int, np.ndarray] | None:
    """The best of a few vantage points: fewest points near the boundary of an even cut."""
    best = None
    for point in points[rng.integers(0, len(points), 8)] if len(points) > 1 else ():
        d = distance(points, point)
        mu = int(np.median(d))
        if mu >= d.max():
            mu = int(d.max()) - 1
        inner = int((d <= mu).sum())
        if mu < 0 or inner == 0:
            continue
        cost = int((np.abs(d - mu) <= radius).sum()) + abs(len(d) - 2 * inner)
        if best is None or cost < best[0]:
            best = (cost, point, mu, d)
    return best and best[1:]


def sides(d: np.ndarray, mu: int, home: np.ndarray, radius: int):
    """Who goes inside and outside, each with who is at home there. Of a pair that a boundary
    parts the inner one visits; visitors go wherever the triangle bounds allow a partner."""
    inner = d <= mu
    inside = (home & inner) | (~home & (d - radius <= mu))
    outside = (home & ~inner) | ((d + radius > mu) & (~home | inner))
    return (inside, home & inner), (outside, home & ~inner)


class Forest:
    """Components of the points 0..n-1, joined by blocks of pairs."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.root[a], self.root[b]
            apart = x != y
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.root, np.maximum(x, y), np.minimum(x, y))
            while not np.array_equal(up := self.root[self.root], self.root):
                self.root = up


def search(points: np.ndarray, home: np.ndarray, radius: int) -> Forest:
    """Joins every pair within the radius of which one is at home and the other is in the shard."""
    forest, rng = Forest(len(points)), np.random.default_rng(11)
    todo = [(np.arange(len(points)), home)]
    while todo:
        at, stays = todo.pop()
        owners = at[stays]
        if not len(owners):
            continue
        node = split(points[owners], radius, rng) if len(owners) > LEAF else None
        if node:
            for go, there in sides(distance(points[at], node[0]), node[1], stays, radius):
                todo.append((at[go], there[go]))
        else:
            _compare(points, owners, at, radius, forest)
    return forest


def _compare(points, owners, others, radius, forest, block: int = 1 << 21) -> None:
    step = max(1, block // max(1, len(owners)))
    for i in range(0, len(others), step):
        part = others[i:i + step]
        a, b = np.nonzero(np.bitwise_count(points[owners][:, None] ^ points[part][None, :]) <= radius)
        forest.join(owners[a], part[b])


def links(prints: DataFrame, radius: int) -> DataFrame:
    """(a, b): a spanning forest, shard by shard, of the distinct fingerprints ``fp`` within the
    radius of each other. ``prints`` must not repeat a fingerprint."""
    n = prints.count()
    share = min(1.0, SAMPLE / max(1, n))
    span = 1 << 30
    sample = prints.where(F.pmod(F.xxhash64(F.lit(5), "fp"), F.lit(span)) < int(span * share)).toPandas()["fp"].to_numpy(np.int64)
    shards = max(1, min(MOST_SHARDS, math.ceil(n / SHARD)))
    tree = Tree(np.sort(sample).view(np.uint64), shards, radius)
    held = prints.sparkSession.sparkContext.broadcast(tree)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            at, shard, home = held.value.route(fp.view(np.uint64))
            yield pa.RecordBatch.from_pydict({"shard": shard, "fp": fp[at], "home": home})

    def within(table: pa.Table) -> pa.Table:
        fp, home = table["fp"].to_numpy(), table["home"].to_numpy()
        order = np.argsort(fp, kind="stable")
        fp, home = fp[order], home[order]
        root = search(fp.view(np.uint64), home, radius).root
        moved = np.flatnonzero(root != np.arange(len(fp)))
        return pa.table({"a": fp[moved], "b": fp[root[moved]]})

    routed = prints.select("fp").mapInArrow(route, "shard long, fp long, home boolean")
    return routed.groupBy("shard").applyInArrow(within, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node each node of the edges (a, b) is connected with.

    Alternating star contraction; the tables of minima are written out before they are joined,
    so both sides of each join are plain shuffles and a hub's rows can be split.
    """
    def order(df):
        return df.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    now = cut(order(edges))
    mark = _mark(now)
    while mark[0]:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select("b", "a"))
        low = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        big = cut(both.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct())
        low = cut(big.groupBy("a").agg(F.min("b").alias("m")))
        moved = big.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = cut(moved.union(low).distinct())
        before, mark = mark, _mark(now)
        if before == mark:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("label"))


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.shiftright(F.xxhash64("a", "b"), 24)), F.sum(F.shiftright(F.xxhash64("b", "a"), 24))).first())


def near_duplicates(docs: DataFrame, size: int, radius: int, id_col: str = "doc_id", text_col: str = "text", carry: dict[str, Column] | None = None) -> DataFrame:
    """One row (doc_id, fp, component_id) for every row of ``docs``; with ``carry`` also its columns
    (checkpointed with the fingerprints, so keep them small) and ``label``, a fingerprint that names
    the component whether it has ids or not."""
    more = [c.alias(n) for n, c in (carry or {}).items()]
    rows = cut(docs.select(F.col(id_col).alias("doc_id"), fingerprint(F.col(text_col), size).alias("fp"), *more))
    prints = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    found = components(links(prints, radius)).withColumnRenamed("node", "fp")
    # A label is itself a fingerprint of its component and has no row of its own in ``found``.
    named = prints.join(found, "fp", "left").select("fp", "first_id", F.coalesce("label", "fp").alias("label"))
    lowest = named.groupBy("label").agg(F.min("first_id").alias("component_id"))
    named = cut(named.join(cut(lowest), "label").select("fp", "component_id", "label"))
    return rows.join(named, "fp").select("doc_id", "fp", "component_id", *(carry or {}), *(["label"] if carry else []))
