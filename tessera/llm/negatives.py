"""Hard negatives from embeddings by an inverted multi-index.

For every anchor the best rows of its own label are its positives; for every positive, the best
rows of other labels whose score lies in a window below the positive's score are its negatives.

**Index.** Vectors are cut into two halves, each with a codebook of ``WORDS`` centroids fitted by
k-means on a bounded sample (``SAMPLE`` rows by hash). A pair of codewords is a cell. A block of
rows keeps its rows in cell order, and the radius of each codeword over its rows.

**Search.** The half score of a row under codeword c is at most ``q.c + |q| * radius``. For each
anchor both codebooks are ordered by that bound, and a heap visits the cells in the order of the
summed half bounds (multi-sequence). Cells whose lower bound exceeds all windows are passed over.
Visited rows are scored exactly; the walk stops once every window is certified: its list is full
and its last score is above the bound of the next cell, or that bound is below the window. So the
codebooks decide how much is read, never what is found.

**Spark.** Rows and anchors are dealt by row to a grid; a cell of the grid co-groups at most
``COLUMN`` rows with at most ``LINE`` anchors (in expectation) and returns a few rows an anchor;
one rank an anchor merges them. Positives come first, then the windows they span go through the
same grid. No row pair is written and nothing passes through the driver but the sample.

Scores are exact integers: products that may leave 53 bits are summed as Python integers. A score
beyond a long counts as the nearest long.

Defined results: rows without id, label or vector, or with a null or non-finite component, take no
part; vectors of different length are compared over their common components, an empty one scores
0; other rows are other rows, also those that repeat the anchor's id; each row of a repeated anchor
id asks for itself; a negative positive score spans no window; extra columns are ignored; empty
tables give empty results.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hash_sample, stored

WORDS, SAMPLE, STEPS = 16, 8_192, 8
#: Rows and anchors of a grid cell; rows scored at a time, doubled from step to step.
COLUMN, LINE, WAVE = 32_768, 4_096, 512
LONG = (1 << 63) - 1
_SCHEMA = "asker long, window int, score long, id long"


# ---------------------------------------------------------------------------------------
# numbers


def matrix(vectors: pa.Array, width: int = 0) -> np.ndarray:
    """Rows of doubles, at least ``width`` wide, shorter vectors filled with zeros."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    lengths = np.asarray(vectors.value_lengths()).astype(np.int64)
    out = np.zeros((len(vectors), max(width, int(lengths.max(initial=0)))))
    out[np.arange(out.shape[1]) < lengths[:, None]] = vectors.flatten().to_numpy(zero_copy_only=False)
    return out


def exact(x: np.ndarray, w: np.ndarray, scale: int) -> np.ndarray:
    """Integer scores of rows with a weight vector, from the unscaled doubles, as longs."""
    whole = lambda v: [math.floor(scale * e) if abs(e) < 1e15 else int(e) * scale for e in v]
    weights = whole(w.tolist())
    sums = [sum(a * b for a, b in zip(whole(r), weights)) for r in x.tolist()]
    return np.array([max(-LONG, min(LONG, s)) for s in sums], np.int64)


# ---------------------------------------------------------------------------------------
# index


def codebook(x: np.ndarray, words: int, seed: int) -> np.ndarray:
    """Centroids of Lloyd's k-means; fewer than ``words`` if there are fewer distinct rows."""
    if not x.shape[1]:
        return np.zeros((1, 0))
    distinct = np.unique(x, axis=0)
    if len(distinct) <= words:
        return distinct
    rng = np.random.default_rng(seed)
    centres = distinct[rng.integers(len(distinct))][None]
    far = ((distinct - centres) ** 2).sum(1)
    while len(centres) < words:  # the further from all centres, the likelier the next one
        centres = np.vstack([centres, distinct[rng.choice(len(distinct), p=far / far.sum())]])
        far = np.minimum(far, ((distinct - centres[-1]) ** 2).sum(1))
    for _ in range(STEPS):
        near = nearest(x, centres)
        counts = np.bincount(near, minlength=words)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres ** 2).sum(1) - 2 * x @ centres.T, axis=1)


@dataclass
class Books:
    """The two half-space codebooks over quantised components; ``half`` components are in the first."""

    first: np.ndarray
    second: np.ndarray
    half: int


def fit(sample: np.ndarray) -> Books:
    half = sample.shape[1] // 2
    return Books(codebook(sample[:, :half], WORDS, 1), codebook(sample[:, half:], WORDS, 2), half)


def _wide(centres: np.ndarray, width: int) -> np.ndarray:
    return np.pad(centres, ((0, 0), (0, max(0, width - centres.shape[1]))))


class MultiIndex:
    """Rows of one block in cell order, with codeword radii."""

    def __init__(self, x: np.ndarray, books: Books) -> None:
        self.books, self.half = books, books.half
        self.first = books.first
        self.second = _wide(books.second, x.shape[1] - books.half)
        a, b = nearest(x[:, :self.half], self.first), nearest(x[:, self.half:], self.second)
        cell = a * len(self.second) + b
        self.order = np.argsort(cell, kind="stable")
        self.x = x[self.order]
        self.largest = np.abs(x).max(initial=0)
        self.starts = np.searchsorted(cell[self.order], np.arange(len(self.first) * len(self.second) + 1))
        self.radius = []
        for part, words, near in ((x[:, :self.half], self.first, a), (x[:, self.half:], self.second, b)):
            r = np.full(len(words), -np.inf)
            np.maximum.at(r, near, np.sqrt(((part - words[near]) ** 2).sum(1)))
            self.radius.append(r)

    def cells(self, w: np.ndarray):
        """(upper bound, lower bound, cell) in descending order of the upper bound: a heap over the
        two orders of half bounds. Codewords without rows are left out."""
        halves = []
        for part, words, radius in ((w[:self.half], self.first, self.radius[0]), (w[self.half:], self.second, self.radius[1])):
            held = np.flatnonzero(radius >= 0)
            mid, reach = words[held] @ part, np.sqrt(part @ part) * radius[held]
            down = np.argsort(-(mid + reach), kind="stable")
            halves.append((held[down].tolist(), (mid + reach)[down].tolist(), (mid - reach)[down].tolist()))
        (one, up1, low1), (two, up2, low2) = halves
        if not one:
            return
        heap, width = [(-(up1[0] + up2[0]), 0, 0)], len(self.second)
        while heap:
            bound, i, j = heapq.heappop(heap)
            yield -bound, low1[i] + low2[j], one[i] * width + two[j]
            if j + 1 < len(two):
                heapq.heappush(heap, (-(up1[i] + up2[j + 1]), i, j + 1))
            if j == 0 and i + 1 < len(one):  # each pair is pushed once
                heapq.heappush(heap, (-(up1[i + 1] + up2[0]), i + 1, 0))


def walk(index: MultiIndex, w: np.ndarray, allowed: np.ndarray, ids: np.ndarray, windows: list[tuple[int, int]], k: int) -> tuple[list, int]:
    """For each window (low, high) the k best (score, row place) of the allowed rows, and the rows
    that were scored. ``allowed`` and ``ids`` are in the index's order."""
    slack = 1 + 1e-9 * np.abs(w).sum() * index.largest
    best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in windows]
    open_, top, seen = [i for i, (low, high) in enumerate(windows) if low <= high], max((h for _, h in windows), default=0), 0
    wave, cells = WAVE, index.cells(w)
    ahead = next(cells, None) if open_ else None
    while ahead is not None:
        rows, n, lowest = [], 0, min(windows[i][0] for i in open_)
        while ahead is not None and n < wave:
            bound, least, cell = ahead
            if bound + slack < lowest:
                break
            lo, hi = index.starts[cell], index.starts[cell + 1]
            if hi > lo and least - slack <= top:
                rows.append((lo, hi))
                n += hi - lo
            ahead = next(cells, None)
        if rows:
            at = np.concatenate([np.arange(lo, hi) for lo, hi in rows])
            at = at[allowed[at]]
            seen += n
            scores = (index.x[at] @ w).astype(np.int64)
            for i in open_:
                low, high = windows[i]
                have, held = best[i]
                floor = max(low, have[-1]) if len(have) == k else low
                new = (scores >= floor) & (scores <= high)
                if new.any():
                    s, r = np.concatenate([have, scores[new]]), np.concatenate([held, at[new]])
                    keep = np.lexsort((ids[r], -s))[:k]
                    best[i] = s[keep], r[keep]
        if ahead is None:
            break
        nxt = ahead[0] + slack
        open_ = [i for i in open_ if nxt >= windows[i][0] and not (len(best[i][0]) == k and best[i][0][-1] > nxt)]
        if not open_:
            break
        wave *= 2
    return best, seen


def compare(rows: pa.Table, anchors: pa.Table, books: Books, k: int, scale: int, same: bool) -> pa.Table:
    """(asker, window, score, id): a block's best rows for each anchor and window. ``same`` asks for
    rows of the anchor's label, else for those of others."""
    width = books.half + books.second.shape[1]
    raw = matrix(rows["v"], width)
    ids, label, key = (rows[c].to_numpy() for c in ("id", "label", "key"))
    with np.errstate(over="ignore", invalid="ignore"):
        x = np.floor(scale * raw)
        limit = math.isqrt((1 << 53) // max(1, raw.shape[1]))
        fine = (np.abs(x) < limit).all(1)
    index = MultiIndex(x[fine], books)
    at = np.flatnonzero(fine)[index.order]
    index_ids, index_label, index_key = ids[at], label[at], key[at]
    far = np.flatnonzero(~fine)
    weights = matrix(anchors["v"])
    out: list[tuple] = []
    for n in range(anchors.num_rows):
        asker, own = anchors["key"][n].as_py(), anchors["label"][n].as_py()
        windows = [(e["low"], e["high"]) for e in anchors["windows"][n].as_py()]
        numbers = [e["n"] for e in anchors["windows"][n].as_py()]
        asked = np.zeros(raw.shape[1])
        common = min(raw.shape[1], weights.shape[1])
        asked[:common] = weights[n, :common]
        with np.errstate(over="ignore", invalid="ignore"):
            w = np.floor(scale * asked)
        rest = far
        if (np.abs(w) < limit).all():
            allowed = ((index_label == own) if same else (index_label != own)) & (index_key != asker)
            found = [(s, at[r]) for s, r in walk(index, w, allowed, index_ids, windows, k)[0]]
        else:
            found, rest = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(windows), np.arange(len(raw))
        rest = rest[((label[rest] == own) if same else (label[rest] != own)) & (key[rest] != asker)]
        scores = exact(raw[rest], asked, scale) if len(rest) else np.zeros(0, np.int64)
        for number, (low, high), (s, r) in zip(numbers, windows, found):
            inside = (scores >= low) & (scores <= high)
            s, r = np.concatenate([s, scores[inside]]), np.concatenate([r, rest[inside]])
            keep = np.lexsort((ids[r], -s))[:k]
            out += [(asker, number, int(a), int(b)) for a, b in zip(s[keep], ids[r[keep]])]
    kinds = (("asker", pa.int64()), ("window", pa.int32()), ("score", pa.int64()), ("id", pa.int64()))
    return pa.Table.from_pydict({name: pa.array([o[i] for o in out], kind) for i, (name, kind) in enumerate(kinds)})


# ---------------------------------------------------------------------------------------
# queries


def usable(rows: DataFrame, label: Column, is_anchor: Column, id_col: str, vector_col: str) -> DataFrame:
    """(key, id, label, asks, v) of the rows that take part; ``key`` tells rows apart."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.coalesce(F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))), F.lit(False))
    whole = F.col(id_col).isNotNull() & label.isNotNull() & fine
    return rows.where(whole).select(F.monotonically_increasing_id().alias("key"), F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"),
                                    F.coalesce(is_anchor, F.lit(False)).alias("asks"), v.alias("v"))


def _meet(rows: DataFrame, anchors: DataFrame, n: int, m: int, books: Books, k: int, scale: int, same: bool) -> DataFrame:
    """Every grid cell's finds; ``anchors`` has key, label, v and windows."""
    busy = rows.sparkSession.sparkContext.defaultParallelism
    lines = max(1, math.ceil(m / LINE))
    columns = max(1, math.ceil(n / COLUMN), min(math.ceil(n / 2_048), math.ceil(2 * busy / lines)))
    deal = lambda parts: F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int")
    left = rows.select("key", "id", "label", "v", deal(columns).alias("x"), F.explode(F.sequence(F.lit(0), F.lit(lines - 1))).alias("y"))
    right = anchors.select("key", "label", "v", "windows", F.explode(F.sequence(F.lit(0), F.lit(columns - 1))).alias("x"), deal(lines).alias("y"))
    cells = 4 * columns * lines  # more partitions than cells, so that few share one

    def cell(a: pa.Table, b: pa.Table) -> pa.Table:
        return compare(a, b, books, k, scale, same)

    return left.repartition(cells, "x", "y").groupBy("x", "y").cogroup(right.repartition(cells, "x", "y").groupBy("x", "y")).applyInArrow(cell, _SCHEMA)


def mine(rows: DataFrame, label: Column, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
         id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): the ``negatives``
    best rows of other labels that score ``low`` to ``high`` percent of the positive's score."""
    spark = rows.sparkSession
    rows = stored(usable(rows, label, is_anchor, id_col, vector_col))
    n, anchors = rows.count(), rows.where("asks")
    m = anchors.count()
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not n or not m:
        return spark.createDataFrame([], schema)
    sample = np.floor(scale * np.clip(matrix(hash_sample(rows, "key", SAMPLE, 12).select("v").toArrow()["v"]), -1e12, 1e12))
    books = fit(sample)
    struct = "array<struct<n: int, low: bigint, high: bigint>>"
    everything = F.array(F.struct(F.lit(0).alias("n"), F.lit(-LONG).alias("low"), F.lit(LONG).alias("high"))).cast(struct)
    near = _meet(rows, anchors.withColumn("windows", everything), n, m, books, positives, scale, True)
    order = [F.col("score").desc(), F.col("id")]
    first = stored(near.withColumn("n", F.row_number().over(Window.partitionBy("asker").orderBy(*order))).where(F.col("n") <= positives))
    # ceil(low * s / 100) and floor(high * s / 100) without leaving 64 bits: s = 100 * q + r
    q, r = F.expr("score div 100"), F.pmod("score", F.lit(100))
    lowest, highest = q * low + F.ceil(r * low / 100).cast("long"), q * high + F.floor(r * high / 100).cast("long")
    spans = first.where("score >= 0").groupBy("asker").agg(F.collect_list(F.struct(F.col("n").cast("int").alias("n"), lowest.alias("low"), highest.alias("high"))).cast(struct).alias("windows"))
    asking = anchors.join(spans, F.col("key") == F.col("asker")).select("key", "label", "v", "windows")
    hard = _meet(rows, stored(asking), n, m, books, negatives, scale, False)
    ranked = hard.withColumn("rank", F.row_number().over(Window.partitionBy("asker", "window").orderBy(*order))).where(F.col("rank") <= negatives)
    known = first.select("asker", F.col("n").alias("window"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    named = known.join(anchors.select(F.col("key").alias("asker"), F.col("id").alias("anchor_id")), "asker")
    return ranked.join(named, ["asker", "window"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
                                                          "positive_score", F.col("score").alias("negative_score"))
