"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Words are runs of letters, digits and non-ASCII characters, ASCII letters lower-cased. A text's
features are its distinct words, neighbouring word pairs and pairs with one word between, plus
the 4- and 6-byte grams inside words (inflected and compounded forms), each hashed to one of
``DIMS`` coordinates; coordinates in fewer than ``MIN_TEXTS`` texts of the sample are not fitted. FTRL-proximal keeps a learning rate for every coordinate
and an L1 penalty that leaves most weights at exactly zero, so the model that is broadcast is a
short list (at most ``DIMS`` pairs whatever the corpus).

Fitting uses at most about ``SAMPLE`` labelled texts (hash-chosen ids, a documented bound); the
features are made where the texts lie and one task runs the sequential updates. Scoring is one
pass over whole texts without a shuffle.

Defined results: null and empty texts, and texts without words, score the bias alone; repeated
rows get equal scores; an empty table or a label column without both classes gives an all-zero
model (score 0.5 and label rate respectively); null labels and null ids are not learnt from.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import BinaryType, DoubleType

from . import textbatch as tb
from .common import bounded_batches, hash_sample

DIMS = 1 << 20
SAMPLE = 6_000
SEED = 61
EPOCHS, ALPHA, BETA, L1, L2 = 3, 0.5, 1.0, 8.0, 0.1
MIN_TEXTS = 4
GRAMS = (4, 6)

#: Everything in ASCII that is neither letter nor digit separates words.
SEPARATOR = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def features(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text index, coordinate) of every word, neighbour pair, skip pair and inner gram of a
    batch, in portions of about a megabyte of text."""
    buf, offsets = tb.text_bytes(texts)
    w = tb.words(buf, offsets, SEPARATOR)
    doc = w.doc()
    for at, stop in tb.word_chunks(w):
        # Pairs reach two words beyond the portion; those beginning there belong to the next.
        ahead = tb.part(w, at, stop + 2)
        h, of = tb.span_hashes(buf, ahead.start, ahead.end, tb.LOWER), doc[at:stop + 2]
        n = stop - at
        hashes, docs = [h[:n]], [of[:n]]
        for gap in (1, 2):
            pairs, texts_of = tb.pair_hashes(h[:n + gap], of[:n + gap], gap, gap)
            hashes.append(pairs)
            docs.append(texts_of)
        for size in GRAMS:
            word, gram = tb.inner_grams(buf, tb.part(w, at, stop), size, 100 + size, tb.LOWER)
            hashes.append(gram)
            docs.append(of[word])
        yield np.concatenate(docs), (np.concatenate(hashes) >> np.uint64(64 - 20)).astype(np.int64)


def present(texts: pa.Array, table: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text index, coordinate) of a batch; with ``table``, of coordinates that have a
    weight there."""
    parts = []
    for doc, at in features(texts):
        if table is not None:
            used = table[at] != 0
            doc, at = doc[used], at[used]
        parts.append(np.unique(doc * DIMS + at))
    key = np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.int64)
    return key // DIMS, key % DIMS


@arrow_udf(BinaryType())
def _packed(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The distinct coordinates of each text as little-endian 32-bit integers."""
    for batch in texts:
        for part in tb.slices(batch, tb.SLICE):
            doc, at = present(part)
            first = np.searchsorted(doc, np.arange(len(part) + 1))
            at = at.astype("<u4")
            yield pa.array([at[first[i]:first[i + 1]].tobytes() for i in range(len(part))], pa.binary())


def ftrl(rows: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS) -> tuple[float, np.ndarray, np.ndarray]:
    """Sequential FTRL-proximal; returns bias, the coordinates with a weight, their weights."""
    z, n = np.zeros(DIMS + 1), np.zeros(DIMS + 1)

    def weights(at):
        shrunk = np.sign(z[at]) * np.maximum(np.abs(z[at]) - np.where(at == DIMS, 0.0, L1), 0)
        return -shrunk / ((BETA + np.sqrt(n[at])) / ALPHA + L2)

    for _ in range(epochs):
        for r, y in zip(rows, labels):
            at = np.append(r.astype(np.int64), DIMS)
            w = weights(at)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
            more = n[at] + g * g
            z[at] += g - (np.sqrt(more) - np.sqrt(n[at])) / ALPHA * w
            n[at] = more
    w = weights(np.arange(DIMS + 1))
    kept = np.flatnonzero(w[:DIMS])
    return float(w[DIMS]), kept, w[kept]


def gathered(batches: Iterator[pa.RecordBatch]) -> tuple[list[np.ndarray], np.ndarray]:
    """The texts' coordinates and labels in the order of training, coordinates in fewer than
    ``MIN_TEXTS`` texts left out. A batch is let go once read: the sample is held once, as 32-bit integers."""
    keys, labels, rows = [], [], []
    texts = np.zeros(DIMS, np.int32)
    for batch in batches:
        keys += map(hash_of, batch.column("_id").to_pylist())
        labels += batch.column("_y").to_pylist()
        for packed in batch.column("_f"):
            rows.append(np.frombuffer(packed.as_py(), "<u4"))
            texts[rows[-1]] += 1  # a text's coordinates are distinct
    common = texts >= MIN_TEXTS
    for i, r in enumerate(rows):
        rows[i] = r[common[r]]
    order = np.argsort(tb.mix(np.array(keys, np.uint64)), kind="stable")
    return [rows[i] for i in order], np.array(labels, float)[order]


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text",
        sample: int = SAMPLE) -> dict:
    """Fit on the labelled texts; ``labels`` holds (id, 0/1) of the rows that may be learnt from.

    The labelled ids are sampled first (``sample`` expected), so only their texts are read out
    and the list of ids that is broadcast is bounded.
    """
    bounded_batches()
    known = labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(
        F.max(F.col(label).cast("int")).alias("_y"))
    known = hash_sample(known, "_id", sample, SEED)
    rows = (docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
            .join(F.broadcast(known), "_id").select("_id", "_y", _packed("_text").alias("_f"))
            .groupBy("_id").agg(F.min(F.struct("_y", "_f")).alias("r")).select("_id", "r._y", "r._f"))

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bias, at, w = ftrl(*gathered(batches))
        yield pa.RecordBatch.from_pydict({"at": np.append(at, DIMS), "w": np.append(w, bias)})

    got = rows.select(F.col("_id").cast("string"), "_y", "_f").repartition(1).mapInArrow(train, "at long, w double").toPandas()
    table = np.zeros(DIMS, np.float32)
    bias = 0.0
    if len(got):
        inner = got["at"].to_numpy() < DIMS
        table[got["at"].to_numpy()[inner]] = got["w"].to_numpy()[inner]
        bias = float(got["w"].to_numpy()[~inner][0])
    at = np.flatnonzero(table)
    return {"bias": bias, "at": at, "w": table[at]}


def hash_of(key: str | None) -> int:
    import zlib

    data = (key or "").encode()
    return zlib.crc32(data) << 32 | zlib.adler32(data)


def score(docs: DataFrame, model: dict, text_col: str = "text") -> Column:
    """Column: probability (0 to 1) that the text is toxic."""
    bounded_batches()
    held = docs.sparkSession.sparkContext.broadcast(model)

    @arrow_udf(DoubleType())
    def scored(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = held.value
        table = np.zeros(DIMS, np.float32)
        table[m["at"]] = m["w"]
        for batch in texts:
            for part in tb.slices(batch, tb.SLICE):
                doc, at = present(part, table)
                z = m["bias"] + np.bincount(doc, table[at], len(part))
                yield pa.array(1 / (1 + np.exp(-np.clip(z, -35, 35))), pa.float64())

    return scored(F.col(text_col))
