"""Best documents of many queries: the product of two sparse matrices in blocks.

Queries and documents are hashed into blocks, each packed and written once; every block of queries meets every block of documents
in one task that reads both, so neither side is shuffled or stored once for every block of the other. Terms that many of the block's documents hold are rows of a dense matrix, the others'
postings are added up one by one, and a task gives exactly k documents a query, however many tie.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .blocks import pack, unpack

#: Postings of a block of documents at least and at most; (query, term) rows of a block of queries.
LEAST_POSTINGS, MOST_POSTINGS, ASKED = 500_000, 4_000_000, 4_000_000
#: A term in one of so many documents of a block is a dense row; queries scored at a time.
DENSE, CHUNK = 8, 32


def _numbered(column: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """The distinct values by rising order, null first, and each row's place among them."""
    coded = pc.dictionary_encode(column.combine_chunks(), null_encoding="encode")
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    order = pc.sort_indices(coded.dictionary, null_placement="at_start").to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return coded.dictionary.take(pa.array(order)), place[coded.indices.to_numpy()]


def _best(raw: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, score to six digits) of the k best positive scores of every row, ties to the first column."""
    units = np.floor(raw * 1e6 + 0.5)
    last = -np.partition(-units, k - 1, axis=1)[:, k - 1:k] if units.shape[1] > k else np.full((len(units), 1), -1.0)
    above, equal = units > last, units == last
    take = (above | (equal & (np.cumsum(equal, axis=1) <= k - above.sum(1, keepdims=True)))) & (raw > 0)
    row, column = np.nonzero(take)
    return row, column, units[row, column] / 1e6


def cell(asked: pa.Table, posts: pa.Table, k: int) -> pa.Table:
    """(qid, doc_id, score) of a block of (qid, term, weight) and one of (term, doc_id, v)."""
    schema = pa.schema([asked.schema.field("qid"), pa.field("doc_id", pa.int64()), pa.field("score", pa.float64())])
    words = pc.unique(asked.column("term"))
    known = pc.index_in(posts.column("term"), value_set=words)
    posts, known = posts.filter(pc.is_valid(known)), known.drop_null()
    if not len(known) or not len(asked):
        return schema.empty_table()
    docs, doc = _numbered(posts.column("doc_id"))
    n = len(docs)
    # Postings by term and document; rows of one document add up.
    key = known.to_numpy().astype(np.int64) * n + doc
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    v = np.add.reduceat(posts.column("v").to_numpy()[order], first)
    term, doc = np.divmod(key[first], n)
    begin = np.searchsorted(term, np.arange(len(words) + 1))
    count = np.diff(begin)
    dense = np.flatnonzero(count * DENSE > n)
    line = np.full(len(words), -1)
    line[dense] = np.arange(len(dense))
    matrix = np.zeros((len(dense), n))
    common = line[term] >= 0
    matrix[line[term[common]], doc[common]] = v[common]
    qids, query = _numbered(asked.column("qid"))
    used, weight = pc.index_in(asked.column("term"), value_set=words).to_numpy().astype(np.int64), asked.column("weight").to_numpy()
    order = np.argsort(query, kind="stable")
    query, used, weight = query[order], used[order], weight[order]
    out = []
    for lo in range(0, len(qids), CHUNK):
        a, b = np.searchsorted(query, [lo, lo + CHUNK])
        q, t, w = query[a:b] - lo, used[a:b], weight[a:b]
        m = min(CHUNK, len(qids) - lo)
        held = line[t] >= 0
        side = np.zeros((m, len(dense)))
        np.add.at(side, (q[held], line[t[held]]), w[held])
        q, t, w = q[~held], t[~held], w[~held]
        size = count[t]
        at = np.repeat(begin[t] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        rare = np.bincount(np.repeat(q * n, size) + doc[at], v[at] * np.repeat(w, size), m * n)
        row, column, score = _best(side @ matrix + rare.reshape(m, n), k)
        out.append((row + lo, column, score))
    row, column, score = map(np.concatenate, zip(*out))
    return pa.Table.from_arrays([qids.take(pa.array(row)), docs.take(pa.array(column)).cast(pa.int64()), pa.array(score)], schema=schema)


def block_product(asked: DataFrame, posts: DataFrame, k: int) -> DataFrame:
    """Of every block of documents the ``k`` best (qid, doc_id, score) of each query: the sum over its terms
    of ``weight`` (qid, term, weight) times ``v`` (term, doc_id, v), rounded to six digits."""
    cores = asked.sparkSession.sparkContext.defaultParallelism
    n_posts, n_asked = posts.count(), asked.count()
    each = min(MOST_POSTINGS, max(LEAST_POSTINGS, n_posts // (4 * cores)))
    d_blocks, q_blocks = max(1, math.ceil(n_posts / each)), max(1, math.ceil(n_asked / ASKED))
    q = _packed(asked.select("qid", "term", F.col("weight").cast("double").alias("weight")), "qid", q_blocks)
    d = _packed(posts.select("term", F.col("doc_id").cast("bigint").alias("doc_id"), F.col("v").cast("double").alias("v")), "doc_id", d_blocks)
    kind = asked.schema["qid"].dataType.simpleString()

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for left, right in zip(batch.column("q"), batch.column("d")):
                sides = [t.set_column(t.column_names.index("term"), "term", t.column("term").cast(pa.string())) for t in (unpack(left), unpack(right))]
                yield from cell(*sides, k).to_batches()

    met = q.select(F.col("data").alias("q")).crossJoin(d.select(F.col("data").alias("d")).hint("shuffle_replicate_nl"))
    return met.mapInArrow(scored, f"qid {kind}, doc_id bigint, score double")


def _packed(rows: DataFrame, by: str, n: int) -> DataFrame:
    """(data): ``n`` blocks of rows at most, those of one ``by`` in one, terms as numbers of a block's own dictionary."""
    ensure_checkpoint_dir(rows.sparkSession)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            t = pa.Table.from_batches(held).combine_chunks()
            t = t.set_column(t.column_names.index("term"), "term", t.column("term").dictionary_encode()).combine_chunks()
            yield pa.RecordBatch.from_arrays([pa.array([pack(t.to_batches()[0])], pa.binary())], ["data"])

    return rows.repartition(n, by).mapInArrow(made, "data binary").checkpoint()
