"""Exact top-k inner products on a bit-sliced index.

Components are quantised to integers and stored in blocks of ``BLOCK`` rows as bit slices: one
bitmap per attribute and bit. A query's score is the sum of its weights times the attributes, so
for each set bit of a weight the attribute's slices, moved up by that bit, are added with
carry-save bitmap arithmetic (a negative weight takes the complement of the slices, which adds a
constant to all rows). From the most significant slice of the sums downward the k best rows of
the block are singled out; rows of equal sum on the boundary are resolved by smaller id. The
blocks' candidates (at most k a query) meet in one rank per query.

Queries are packed into blocks as well, and a block of rows and a block of queries meet by an
equi-join on grid coordinates, so neither side passes through the driver and no row pair is made.
The slices are made once, when a block is packed. Vectors with a component of ``LARGEST`` or more
after quantisation would widen every slice of their block: they are packed into blocks of their own, as
numbers, and scored exactly in the same cells, by 64-bit products where these cannot overflow and by Python's
integers elsewhere. A score beyond a long counts as the nearest long.

Defined results: a vector that is null, empty or holds a null or non-finite component takes no part; vectors of different length are compared
over their common components; rows with the query's id are not its candidates; of repeated
query ids the smallest vector asks; repeated candidate rows count each; null ids take no part;
empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

BLOCK, QUERIES = 8_192, 1_024
#: Most rows of a grid column and queries of a grid line; a cell compares these in one task. Larger
#: cells copy less, so only inputs too small to occupy the cluster get cells of single blocks.
COLUMN, LINE = 8 * BLOCK, 8 * QUERIES
#: Quantised components from this magnitude on are kept out of the slices.
LARGEST = 1 << 24
LONG = (1 << 63) - 1


def usable(vector: Column) -> Column:
    """The vector as doubles; null if it takes no part."""
    v = vector.cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when((F.size(v) > 0) & F.coalesce(fine, F.lit(False)), v)


def is_far(vector: Column, scale: int = 256) -> Column:
    return F.exists(vector, lambda x: F.abs(x * scale) >= LARGEST)


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component of a vector that is not far."""
    return F.transform(vector, lambda x: F.floor(x * scale)).cast("array<int>")


def whole(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as longs where that fits, else as Python's integers."""
    if np.abs(x).max(initial=0) < (1 << 62) / scale:
        return np.floor(scale * x).astype(np.int64)
    flat = [math.floor(scale * e) if abs(e) < 1e15 else int(e) * scale for e in x.ravel().tolist()]
    return np.array(flat, object).reshape(x.shape)


def products(rows: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Exact scores of integer rows with one weight vector, as the nearest longs."""
    most = int(np.abs(rows).max(initial=0)) * int(np.abs(weights).max(initial=0)) * max(1, rows.shape[1])
    if most <= LONG and rows.dtype != object and weights.dtype != object:
        return rows @ weights
    sums = [sum(a * b for a, b in zip(r, weights.tolist())) for r in rows.tolist()]
    return np.array([max(-LONG, min(LONG, s)) for s in sums], np.int64)


def matrix(vectors: pa.Array) -> np.ndarray:
    """Rows of integers, shorter vectors filled with zeros."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    lengths = np.asarray(vectors.value_lengths()).astype(np.int64)
    out = np.zeros((len(vectors), int(lengths.max()) if len(lengths) else 0), np.int64)
    out[np.arange(out.shape[1]) < lengths[:, None]] = vectors.flatten().to_numpy()
    return out


def slice_block(x: np.ndarray) -> tuple[np.ndarray, int]:
    """(bitmaps [attribute, bit, word], bits): two's complement offset to be non-negative, that is
    value + 2**(bits - 1)."""
    bits = 1 + max(1, int(max(x.max(initial=0), -1 - x.min(initial=0))).bit_length())
    shifted = (x + (1 << (bits - 1))).T
    planes = (shifted[:, None, :] >> np.arange(bits)[None, :, None]) & 1
    packed = np.packbits(planes.astype(np.uint8), axis=2, bitorder="little")
    room = -packed.shape[2] % 8
    return np.ascontiguousarray(np.pad(packed, ((0, 0), (0, 0), (0, room)))).view(np.uint64), bits


def add_slices(slices: np.ndarray, flipped: np.ndarray, bits: int, weights: np.ndarray) -> np.ndarray:
    """Bitmaps of sum(|w| * y) over attributes, least significant first; y is the offset
    attribute, or its complement where the weight is negative."""
    size = np.abs(weights)
    levels: list[list[np.ndarray]] = [[] for _ in range(bits + int(size.max(initial=0)).bit_length())]
    for up in range(int(size.max(initial=0)).bit_length()):
        for side, mask in ((slices, weights > 0), (flipped, weights < 0)):
            chosen = np.flatnonzero(mask & (size >> up & 1 == 1))
            if len(chosen):
                for b in range(bits):
                    levels[b + up].append(side[chosen, b])
    out, at = [], 0
    while at < len(levels):
        pile = np.concatenate(levels[at]) if levels[at] else np.zeros((0, slices.shape[2]), np.uint64)
        carries = []
        while len(pile) > 1:
            n = len(pile) // 3
            if n:
                a, b, c = pile[:n], pile[n:2 * n], pile[2 * n:3 * n]
                ab = a ^ b
                carries.append((a & b) | (ab & c))
                pile = np.concatenate([ab ^ c, pile[3 * n:]])
            else:
                carries.append(pile[:1] & pile[1:])
                pile = pile[:1] ^ pile[1:]
        if carries:
            if at + 1 == len(levels):
                levels.append([])
            levels[at + 1] += carries
        out.append(pile[0] if len(pile) else np.zeros(slices.shape[2], np.uint64))
        at += 1
    return np.stack(out) if out else np.zeros((0, slices.shape[2]), np.uint64)


def best(sums: np.ndarray, allowed: np.ndarray, k: int) -> np.ndarray:
    """Rows of the k largest sums among the allowed (bitmap); rows stand in id order, so of equal
    sums on the boundary the first are taken."""
    sure, even = np.zeros_like(allowed), allowed
    for plane in sums[::-1]:
        with_bit = even & plane
        n = int(np.bitwise_count(sure | with_bit).sum())
        if n > k:
            even = with_bit
        else:
            sure, even = sure | with_bit, even & ~plane
            if n == k:
                even = np.zeros_like(even)
                break
    taken = rows_of(sure)
    return np.concatenate([taken, rows_of(even)[:k - len(taken)]])


def rows_of(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def top(ids: np.ndarray, slices: np.ndarray, bits: int, query_ids: np.ndarray, queries: np.ndarray, k: int):
    """(query id, id, score) of each query's k best rows of one sliced block, whose ids ascend."""
    width = min(slices.shape[0], queries.shape[1])
    slices, queries = slices[:width], queries[:, :width]
    flipped = ~slices
    present = np.zeros(slices.shape[2] * 64, np.uint8)
    present[:len(ids)] = 1
    left, right = np.searchsorted(ids, query_ids), np.searchsorted(ids, query_ids, "right")
    asked, found, scores = [], [], []
    for q, weights in enumerate(queries):
        allowed = present.copy()
        allowed[left[q]:right[q]] = 0
        sums = add_slices(slices, flipped, bits, weights)
        at = best(sums, np.packbits(allowed, bitorder="little").view(np.uint64), k)
        asked.append(np.full(len(at), query_ids[q]))
        found.append(ids[at])
        scores.append(values(sums, at) - offset(weights, bits))
    return np.concatenate(asked), np.concatenate(found), np.concatenate(scores)


def values(sums: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The sums of some rows, read off the bitmaps."""
    bit = (sums[:, at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)
    return (bit.astype(np.int64) << np.arange(len(sums))[:, None]).sum(0) if len(sums) else np.zeros(len(at), np.int64)


def offset(weights: np.ndarray, bits: int) -> int:
    """What the offset attributes and complements add to every row's sum."""
    half = 1 << (bits - 1)
    return int(weights[weights > 0].sum()) * half - int(weights[weights < 0].sum()) * (half - 1)


def top_far(ids: np.ndarray, rows: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int):
    """``top`` of integer rows and queries, without slices."""
    width = min(rows.shape[1], queries.shape[1])
    asked, found, scores = [], [], []
    for q, weights in zip(query_ids, queries[:, :width]):
        s = products(rows[:, :width], weights)
        other = np.flatnonzero(ids != q)
        at = other[np.lexsort((ids[other], -s[other]))[:k]]
        asked.append(np.full(len(at), q))
        found.append(ids[at])
        scores.append(s[at])
    return np.concatenate(asked), np.concatenate(found), np.concatenate(scores)


def _blocks(rows: DataFrame, size: int, scale: int, sliced: bool) -> DataFrame:
    """(part, far, ids, width, bits, data): rows (id, far, v) packed where they lie, at most ``size`` to a
    block; ids ascend. Data are the slices of the block, or its integers (not ``sliced``), or the
    doubles of far rows."""

    def block(table: pa.Table, far: bool, n: int) -> pa.RecordBatch:
        table = table.sort_by("id")
        if far:
            x, bits = doubles(table["v"]), 0
            data, width = x.astype("<f8").tobytes(), x.shape[1]
        else:
            x = matrix(table["q"])
            width = x.shape[1]
            data, bits = slice_block(x) if sliced else (x.astype("<i4"), 0)
            data = data.tobytes()
        return pa.RecordBatch.from_pydict({"part": pa.array([n], pa.int64()), "far": pa.array([far]), "ids": [table["id"].to_numpy().astype("<i8").tobytes()],
                                           "width": pa.array([width], pa.int32()), "bits": pa.array([bits], pa.int32()), "data": [data]})

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held: dict[bool, list[pa.RecordBatch]] = {False: [], True: []}
        part = TaskContext.get().partitionId() * 1_000_003
        for batch in batches:
            for far in held:
                held[far].append(batch.filter(batch.column("far") if far else pc.invert(batch.column("far"))))
                while sum(b.num_rows for b in held[far]) >= size:
                    table = pa.Table.from_batches(held[far])
                    yield block(table.slice(0, size), far, part)
                    part += 1
                    held[far] = table.slice(size).to_batches()
        for far in held:
            if sum(b.num_rows for b in held[far]):
                yield block(pa.Table.from_batches(held[far]), far, part)
                part += 1

    q = F.when(~F.col("far"), quantised(F.col("v"), scale)).alias("q")
    return rows.select("id", "far", q, F.when(F.col("far"), F.col("v")).alias("v")).mapInArrow(pack, "part long, far boolean, ids binary, width int, bits int, data binary")


def doubles(vectors: pa.Array) -> np.ndarray:
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    lengths = np.asarray(vectors.value_lengths()).astype(np.int64)
    out = np.zeros((len(vectors), int(lengths.max(initial=0))))
    out[np.arange(out.shape[1]) < lengths[:, None]] = vectors.flatten().to_numpy()
    return out


def _slices(cell: dict, n: int) -> np.ndarray:
    return np.frombuffer(cell["data"], np.uint64).reshape(cell["width"], cell["bits"], -1)


def _unsliced(cell: dict, n: int) -> np.ndarray:
    """Integer rows from a block's slices."""
    at = np.arange(n)
    bit = (_slices(cell, n)[:, :, at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)
    return ((bit.astype(np.int64) << np.arange(cell["bits"])[None, :, None]).sum(1) - (1 << (cell["bits"] - 1))).T


def meet(cell: dict, k: int, scale: int):
    """Finds of one block of rows and one of queries."""
    ids, query_ids = np.frombuffer(cell["ids"], "<i8"), np.frombuffer(cell["q_ids"], "<i8")
    if cell["q_far"]:
        q = whole(np.frombuffer(cell["q_data"], "<f8").reshape(len(query_ids), -1), scale)
    else:
        q = np.frombuffer(cell["q_data"], "<i4").reshape(len(query_ids), -1).astype(np.int64)
    if cell["far"]:
        return top_far(ids, whole(np.frombuffer(cell["data"], "<f8").reshape(len(ids), -1), scale), query_ids, q, k)
    if cell["q_far"]:
        return top_far(ids, _unsliced(cell, len(ids)), query_ids, q, k)
    return top(ids, _slices(cell, len(ids)), cell["bits"], query_ids, q, k)


def search(rows: DataFrame, is_query: Column, k: int, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest integer inner products over all
    rows but its own; fewer rows give fewer ranks."""
    vectors = rows.select(F.col(id_col).cast("long").alias("id"), usable(F.col(vector_col)).alias("v"), is_query.alias("_asks")).where(
        F.col("id").isNotNull() & F.col("v").isNotNull()).withColumn("far", is_far(F.col("v"), scale))
    vectors = cut(vectors)
    index = cut(_blocks(vectors.select("id", "far", "v"), BLOCK, scale, True))
    # Of repeated query ids the smallest vector asks; the least component decides, as it is scored.
    floors = F.transform("v", lambda x: x * scale - F.pmod(x * scale, F.lit(1.0)))
    asking = vectors.where("_asks").groupBy("id").agg(F.min_by(F.struct("far", "v"), floors).alias("r")).select("id", "r.far", "r.v")
    queries = cut(_blocks(asking, QUERIES, scale, False))
    # The grid: every block of rows is copied to each row of the grid, every block of queries to
    # each column; both are dealt by hash, a cell holds a few blocks of either side.
    n, m = vectors.count(), queries.count()
    busy = rows.sparkSession.sparkContext.defaultParallelism
    lines = max(1, math.ceil(m * QUERIES / LINE))
    columns = max(1, math.ceil(n / COLUMN), min(2 * math.ceil(n / BLOCK), math.ceil(2 * busy / lines)))
    cells = 4 * columns * lines  # partitions; more than cells, so that few share one
    deal = lambda c, parts: F.pmod(F.xxhash64(c), F.lit(parts)).cast("int")
    own = ["far", "ids", "width", "bits", "data"]
    left = index.select(*own, deal("part", columns).alias("x"), F.explode(F.sequence(F.lit(0), F.lit(lines - 1))).alias("y"))
    right = queries.select(*[F.col(c).alias(f"q_{c}") for c in own], F.explode(F.sequence(F.lit(0), F.lit(columns - 1))).alias("x"), deal("part", lines).alias("y"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell in batch.to_pylist():
                asked, found, scores = meet(cell, k, scale)
                yield pa.RecordBatch.from_pydict({"query_id": asked, "vec_id": found, "score": scores.astype(np.int64)})

    # A given number of partitions: cells weigh by their work, not by the few bytes they hold.
    met = left.repartition(cells, "x", "y").join(right.repartition(cells, "x", "y"), ["x", "y"]).select(*own, *[f"q_{c}" for c in own])
    near = met.mapInArrow(compare, "query_id long, vec_id long, score long")
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
