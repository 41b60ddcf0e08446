"""Approximate nearest neighbours on a persisted inverted file with product codes.

**Build.** Coarse cells come from a distributed k-means: every step assigns rows inside their
partitions and ships one sum per cell and partition. What is left of a vector beside its cell's
centre is coded in sub-spaces of ``sub`` components, one byte each for the nearest of ``WORDS``
words. Written under ``path``: ``model`` (centres, words, sizes of the cells) and ``cells``
``(cell, doc_id, code, vector)`` in cell order.

**Search.** A query visits cells by falling ``q . centre`` until they hold ``probe`` of all rows. Their
codes, an eighth of the vectors' bytes at ``sub`` 2, are scored against the query, the best ``shortlist`` rows
over all its cells are kept, and only these are compared by their vectors: scores in the result are exact.
``probe`` 1 and a shortlist of all rows is the exact join.

Cells larger than ``PART_BYTES`` are cut into parts by row, so copies of one vector spread. Models are
bounded: ``MOST_CELLS`` centres and ``WORDS`` words a sub-space, fitted on at most ``TRAIN`` rows a cell and
``BOOK_ROWS`` rows. Rows whose vector is null, of another length than the longest, or holds a null or
non-finite component are left out, queries alike. Made for vectors of about unit length.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.vectors import dot, finite_vector

MOST_CELLS, WORDS, TRAIN, BOOK_ROWS = 4_096, 256, 256, 16_384
PART_BYTES = 16 * 1024 * 1024
_SPAN = 1 << 30


def vectors_of(column: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dims)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres ** 2).sum(1) - 2 * (x @ centres.T), axis=1)


def words_of(x: np.ndarray, words: int, steps: int, seed: int) -> np.ndarray:
    """k-means words of one sub-space."""
    distinct = np.unique(x, axis=0)
    if len(distinct) <= words:
        return distinct
    centres = distinct[np.random.default_rng(seed).choice(len(distinct), words, replace=False)]
    for _ in range(steps):
        near = nearest(x, centres)
        n = np.bincount(near, minlength=words)
        sums = np.stack([np.bincount(near, x[:, i], words) for i in range(x.shape[1])], 1)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


@dataclass(frozen=True)
class Model:
    centres: np.ndarray
    books: list
    sizes: np.ndarray
    sub: int

    @property
    def dims(self) -> int:
        return self.centres.shape[1]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cell, code bytes) of every row."""
        cell = nearest(x, self.centres)
        rest = x - self.centres[cell]
        codes = [nearest(rest[:, i * self.sub:(i + 1) * self.sub], book) for i, book in enumerate(self.books)]
        return cell, np.stack(codes, 1).astype(np.uint8)

    def decode(self, cell: int, codes: np.ndarray) -> np.ndarray:
        return self.centres[cell] + np.concatenate([book[codes[:, i]] for i, book in enumerate(self.books)], 1)

    def parts(self) -> np.ndarray:
        """Parts of every cell."""
        rows = max(1, PART_BYTES // (8 * self.dims))
        return np.maximum(1, -(-self.sizes // rows))

    def visited(self, q: np.ndarray, probe: float) -> np.ndarray:
        """Cells in the order of ``q . centre`` until they hold ``probe`` of the rows."""
        order = np.argsort(-(self.centres @ q), kind="stable")
        held = np.cumsum(self.sizes[order])
        return order[:1 + int(np.searchsorted(held, probe * self.sizes.sum()))]


def usable(rows: DataFrame, column: str, dims: int | None = None) -> DataFrame:
    """Rows with a finite vector (of ``dims`` components), as doubles."""
    return rows.where(finite_vector(column, dims)).withColumn(column, F.col(column).cast("array<double>"))


def _sampled(rows: DataFrame, n: int, size: int, seed: int) -> DataFrame:
    if n <= size:
        return rows
    return rows.where(F.pmod(F.xxhash64(F.lit(seed), "doc_id", "vector"), F.lit(_SPAN)) < int(_SPAN * size / n))


def _centres(rows: DataFrame, cells: int, dims: int, steps: int) -> np.ndarray:
    """Distributed Lloyd steps over ``rows``."""
    first = rows.orderBy(F.xxhash64(F.lit(3), "vector"), "vector").select("vector").distinct().limit(cells).toArrow()
    centres = np.unique(vectors_of(first["vector"], dims), axis=0)
    for _ in range(steps):

        def sums(batches: Iterator[pa.RecordBatch], centres=centres) -> Iterator[pa.RecordBatch]:
            n, total = np.zeros(len(centres), np.int64), np.zeros_like(centres)
            for batch in batches:
                x = vectors_of(batch.column("vector"), dims)
                near = nearest(x, centres)
                n += np.bincount(near, minlength=len(centres))
                np.add.at(total, near, x)
            held = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({"cell": pa.array(held, pa.int64()), "n": pa.array(n[held], pa.int64()), "total": pa.array(list(total[held]), pa.list_(pa.float64()))})

        def added(t: pa.Table) -> pa.Table:
            total = vectors_of(t["total"], dims).sum(0)
            return pa.table({"cell": pa.array([t["cell"][0].as_py()], pa.int64()), "n": pa.array([sum(t["n"].to_pylist())], pa.int64()), "total": pa.array([total], pa.list_(pa.float64()))})

        kind = "cell long, n long, total array<double>"
        moved = rows.select("vector").mapInArrow(sums, kind).groupBy("cell").applyInArrow(added, kind).toArrow()
        centres = centres.copy()
        centres[moved["cell"].to_numpy()] = vectors_of(moved["total"], dims) / moved["n"].to_numpy()[:, None]
    return centres


def build(vectors: DataFrame, path: str, cells: int | None = None, sub: int = 2, steps: int = 8) -> Model:
    """Index ``vectors`` (doc_id, vector); about the square root of the rows as cells by default."""
    spark, path = vectors.sparkSession, path.rstrip("/")
    rows = usable(vectors.select(F.col("doc_id").cast("bigint").alias("doc_id"), "vector"), "vector")
    longest = rows.agg(F.max(F.size("vector"))).first()[0] or 0
    rows = rows.where(F.size("vector") == longest)
    n = rows.count()
    cells = min(cells or math.isqrt(n) + 1, MOST_CELLS)
    if n:
        centres = _centres(_sampled(rows, n, TRAIN * cells, 1), cells, longest, steps)
        some = vectors_of(_sampled(rows, n, BOOK_ROWS, 2).select("vector").toArrow()["vector"], longest)
        some = some if len(some) else centres
        rest = some - centres[nearest(some, centres)]
        books = [words_of(rest[:, i:i + sub], WORDS, steps, i) for i in range(0, longest, sub)]
    else:
        centres, books = np.zeros((0, longest)), []
    model = Model(centres, books, np.zeros(len(centres), np.int64), sub)
    shared = spark.sparkContext.broadcast(model)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell, code = shared.value.encode(vectors_of(batch.column("vector"), longest))
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), batch.column("doc_id"), pa.array([c.tobytes() for c in code], pa.binary()), batch.column("vector")],
                                                 ["cell", "doc_id", "code", "vector"])

    found = rows.select("doc_id", "vector").mapInArrow(coded, "cell int, doc_id bigint, code binary, vector array<double>")
    found.withColumn("vector", F.col("vector").cast("array<float>") if vectors.schema["vector"].dataType.elementType.simpleString() == "float" else F.col("vector")) \
        .repartitionByRange("cell", "doc_id").sortWithinPartitions("cell", "doc_id").write.mode("overwrite").parquet(f"{path}/cells")
    sizes = np.zeros(len(centres), np.int64)
    for r in spark.read.parquet(f"{path}/cells").groupBy("cell").agg(F.count("*").alias("n")).collect():
        sizes[r["cell"]] = r["n"]
    lines = [("sub", sub, [])] + [("centre", i, c.tolist()) for i, c in enumerate(centres)] + [("size", i, [float(s)]) for i, s in enumerate(sizes)]
    lines += [("book", i, [float(book.shape[1]), *book.ravel().tolist()]) for i, book in enumerate(books)]
    spark.createDataFrame(lines, "kind string, i long, numbers array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/model")
    return Model(centres, books, sizes, sub)


def load(spark: SparkSession, path: str) -> Model:
    """The model of the index at ``path``."""
    rows = spark.read.parquet(f"{path.rstrip('/')}/model").collect()
    kind = lambda k: [r["numbers"] for r in sorted((r for r in rows if r["kind"] == k), key=lambda r: r["i"])]
    books = [np.array(b[1:]).reshape(-1, int(b[0])) for b in kind("book")]
    centres = np.array(kind("centre")) if kind("centre") else np.zeros((0, 0))
    return Model(centres, books, np.array(kind("size")).ravel().astype(np.int64), next(r["i"] for r in rows if r["kind"] == "sub"))


def search(queries: DataFrame, path: str, k: int = 10, probe: float = 0.35, shortlist: int | None = None, qid: str = "qid", qvec: str = "qvec") -> DataFrame:
    """``(qid, doc_id, score, rank)``: each query's ``k`` best of its shortlist (16 * k rows by
    default) by exact dot product, rounded to 6 digits, ties by ``doc_id``. Query ids are unique."""
    spark, path = queries.sparkSession, path.rstrip("/")
    model = load(spark, path)
    kind = queries.schema[qid].dataType.simpleString()
    if not model.sizes.sum():
        return spark.createDataFrame([], f"qid {kind}, doc_id bigint, score double, rank int")
    q = usable(queries.select(F.col(qid).alias("qid"), F.col(qvec).alias("q")), "q", model.dims)
    ranked = _shortlisted(q, model, path, probe, shortlist or 16 * k)
    vectors = spark.read.parquet(f"{path}/cells").select("cell", "doc_id", "vector")
    exact = ranked.join(vectors, ["cell", "doc_id"]).join(q, "qid").select("qid", "doc_id", F.round(dot(F.col("vector"), F.col("q")), 6).alias("score"))
    best = Window.partitionBy("qid").orderBy(F.desc("score"), F.asc("doc_id"))
    return exact.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("qid", "doc_id", "score", F.col("rank").cast("int"))


def _shortlisted(q: DataFrame, model: Model, path: str, probe: float, size: int) -> DataFrame:
    """(qid, cell, doc_id): the best ``size`` rows of each query by code."""
    spark = q.sparkSession
    shared, kind = spark.sparkContext.broadcast(model), q.schema["qid"].dataType.simpleString()
    cut = model.parts()
    parts = spark.createDataFrame([(i, int(p)) for i, p in enumerate(cut)], "cell int, parts int")

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for i, v in enumerate(vectors_of(batch.column("q"), m.dims)):
                cells = m.visited(v, probe)
                cell = np.repeat(cells, cut[cells])
                part = np.concatenate([np.arange(cut[c]) for c in cells])
                at = pa.array(np.full(len(cell), i))
                yield pa.RecordBatch.from_arrays([batch.column("qid").take(at), batch.column("q").take(at), pa.array(cell, pa.int32()), pa.array(part, pa.int32())], ["qid", "q", "cell", "part"])

    def scored(asked: pa.Table, rows: pa.Table) -> pa.Table:
        m, out = shared.value, []
        ids = rows["doc_id"].to_numpy()
        if len(ids) and asked.num_rows:
            cell = rows["cell"][0].as_py()
            codes = np.frombuffer(b"".join(rows["code"].to_pylist()), np.uint8).reshape(len(ids), -1)
            seen, qs = m.decode(cell, codes), vectors_of(asked["q"], m.dims)
            keep = min(size, len(ids))
            for at in range(0, len(qs), 256):
                near = qs[at:at + 256] @ seen.T
                best = np.argpartition(-near, keep - 1, axis=1)[:, :keep]
                n = np.repeat(np.arange(at, at + len(near)), keep)
                out.append(pa.table({"qid": asked["qid"].take(pa.array(n)), "cell": pa.array(np.full(len(n), cell), pa.int32()), "doc_id": pa.array(ids[best.ravel()]),
                                     "near": pa.array(np.take_along_axis(near, best, 1).ravel())}))
        empty = pa.table({"qid": asked["qid"].slice(0, 0), "cell": pa.array([], pa.int32()), "doc_id": pa.array([], pa.int64()), "near": pa.array([], pa.float64())})
        return pa.concat_tables([empty, *out])

    asked = q.mapInArrow(visits, f"qid {kind}, q array<double>, cell int, part int")
    codes = spark.read.parquet(f"{path}/cells").select("cell", "doc_id", "code").join(F.broadcast(parts), "cell")  # at most MOST_CELLS rows
    codes = codes.select("cell", "doc_id", "code", F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.col("parts")).cast("int").alias("part"))
    near = asked.groupBy("cell", "part").cogroup(codes.groupBy("cell", "part")).applyInArrow(scored, f"qid {kind}, cell int, doc_id bigint, near double")
    best = Window.partitionBy("qid").orderBy(F.desc("near"), F.asc("doc_id"))
    return near.withColumn("r", F.row_number().over(best)).where(F.col("r") <= size).select("qid", "cell", "doc_id")


def share_compared(model: Model, q: np.ndarray, probe: float, shortlist: int) -> tuple[float, float]:
    """(share of the rows whose codes a query scores, share whose vectors it is compared with)."""
    n = model.sizes.sum()
    coded = model.sizes[model.visited(q, probe)].sum()
    return coded / n, min(shortlist, coded) / n
