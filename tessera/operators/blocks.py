"""Blocks of postings made a window of documents at a time, inside the task that holds the documents.

Tokens are numbered by Arrow's dictionary, and one stable sort by (window, term) puts the positions
of a term's documents side by side: no row per token, no shuffle. ``impacts`` are the (tf, dl) pairs that bound a block's
best score, found there as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Documents of an Arrow batch, and tokens after which the windows read so far are turned into blocks.
BATCH_ROWS, TOKENS = 256, 2_000_000
SCHEMA = "term string, w bigint, docs array<struct<doc_id: bigint, tf: int, dl: int, bit: int>>, positions array<array<int>>, impacts array<struct<tf: int, dl: int>>"


def pack(batch: pa.RecordBatch) -> bytes:
    """A batch as one compressed value."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack(data: pa.Scalar) -> pa.Table:
    return pa.ipc.open_stream(data.as_buffer()).read_all().combine_chunks()


def _starts(*keys: np.ndarray) -> np.ndarray:
    """First places of the runs of equal keys."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def _impacts(block: np.ndarray, tf: np.ndarray, dl: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Postings, by blocks, that no other of their block beats, by falling tf, each shorter than the last; and their blocks."""
    bits, blocks = int(dl.max(initial=0)).bit_length(), int(block.max(initial=0)).bit_length()
    if 2 * bits + blocks < 64:
        order = np.argsort((block << 2 * bits) + ((1 << bits) - 1 - tf.astype(np.int64) << bits) + dl, kind="stable")
    else:
        order = np.lexsort((dl, -tf.astype(np.int64), block))
    # Lengths fall from block to block, so a block's least so far is the least so far of all.
    length = dl[order] - block[order] * (int(dl.max(initial=0)) + 1)
    least = np.minimum.accumulate(length)
    better = np.append(True, length[1:] < least[:-1])[:len(order)]
    return order[better], block[order[better]]


def window_blocks(rows: pa.Table, common: pa.Array | None = None) -> pa.RecordBatch:
    """Blocks of documents (w, bit, doc_id, t), a window's together; with ``common``, of the pairs of
    these words that follow each other."""
    tokens = rows.column("t").combine_chunks()
    size = pc.list_value_length(tokens).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(size)), size)
    pos = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    coded = tokens.flatten().dictionary_encode()
    code, words = coded.indices.to_numpy().astype(np.int64), coded.dictionary
    if common is not None:
        held = pc.is_in(words, value_set=common).to_numpy(zero_copy_only=False)[code]
        at = np.flatnonzero(held[:-1] & held[1:] & (row[:-1] == row[1:]))
        both, pair = np.unique(code[at] * max(len(words), 1) + code[at + 1], return_inverse=True)
        one, two = np.divmod(both, max(len(words), 1))
        words = pc.binary_join_element_wise(words.take(pa.array(one)), words.take(pa.array(two)), " ")
        code, row, pos = pair, row[at], pos[at]
    w = rows.column("w").to_numpy()
    window = np.cumsum(np.append(0, w[1:] != w[:-1]))
    key = window[row] * max(len(words), 1) + code
    order = np.argsort(key, kind="stable")
    key, row, pos = key[order], row[order], pos[order]
    posting = _starts(key, row) if len(key) else np.zeros(0, np.int64)
    block = _starts(key[posting]) if len(key) else posting
    doc = row[posting]
    fields = [pa.array(rows.column("doc_id").to_numpy()[doc]), pa.array(np.diff(np.append(posting, len(key))).astype(np.int32)),
              pa.array(size[doc].astype(np.int32)), pa.array(rows.column("bit").to_numpy()[doc].astype(np.int32))]
    ends = pa.array(np.append(block, len(posting)).astype(np.int32))
    docs = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(fields, ["doc_id", "tf", "dl", "bit"]))
    places = pa.ListArray.from_arrays(pa.array(np.append(posting, len(key)).astype(np.int32)), pa.array(pos.astype(np.int32)))
    head = posting[block]
    # Blocks' numbers in the order of their postings.
    of = np.repeat(np.arange(len(block)), np.diff(np.append(block, len(posting))))
    best, held = _impacts(of, np.diff(np.append(posting, len(key))), size[doc])
    bounds = pa.StructArray.from_arrays([fields[1].take(pa.array(best)), fields[2].take(pa.array(best))], ["tf", "dl"])
    impacts = pa.ListArray.from_arrays(pa.array(np.searchsorted(held, np.arange(len(block) + 1)).astype(np.int32)), bounds)
    return pa.RecordBatch.from_arrays([words.take(pa.array(key[head] % max(len(words), 1))), pa.array(w[row[head]]), docs, pa.ListArray.from_arrays(ends, places), impacts],
                                      ["term", "w", "docs", "positions", "impacts"])


def blocks(docs: DataFrame, common: list[str] | None = None) -> DataFrame:
    """(term, w, docs, positions, impacts) of documents (w, bit, doc_id, t) that stand in the order of their windows."""
    spark = docs.sparkSession
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))
    shared = None if common is None else spark.sparkContext.broadcast(common)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = None if shared is None else pa.array(shared.value, pa.string())
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += len(batch.column("t").flatten())
            if n < TOKENS:
                continue
            rows = pa.Table.from_batches(held)
            w = rows.column("w").to_numpy()
            whole = int(np.flatnonzero(w != w[-1]).max(initial=-1)) + 1  # the last window may go on
            if whole:
                yield window_blocks(rows.slice(0, whole), pairs)
                rest = rows.slice(whole).combine_chunks()
                held, n = rest.to_batches(), len(rest.column("t").combine_chunks().flatten())
        if held:
            yield window_blocks(pa.Table.from_batches(held), pairs)

    return docs.select("w", "bit", "doc_id", "t").mapInArrow(made, SCHEMA)
