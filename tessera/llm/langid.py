"""Language identification: averaged hashed subword embeddings with a linear softmax.

Subwords are the byte grams of 3 and 4 bytes inside space-padded lower-cased words, and the
words; each is hashed to one of ``BUCKETS`` rows of an embedding table, a text is the average of
its rows, and a linear softmax predicts its language. Table and softmax are trained together by
stochastic gradient descent in numpy. The softmax temperature is calibrated on a part of the
sample kept out of training, and so is the confidence below which a prediction is marked as
rejected. For scoring, table and softmax are multiplied out (``BUCKETS`` rows of one number a
language), so the broadcast is bounded by the number of languages learnt.

Fitting uses about ``SAMPLE`` texts (hash-chosen, a documented bound) and at most ``CLASSES``
languages, the most frequent ones of the sample. Scoring is one pass over whole texts.

Defined results: a text that is null or has no letter is ``und`` with score 0 and rejected;
repeated rows score alike; with no labelled text at all every text is ``und``; null languages
are not learnt from.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import BinaryType, BooleanType, DoubleType, StringType, StructField, StructType

from . import textbatch as tb
from .common import bounded_batches, hash_sample

BITS = 16
BUCKETS = 1 << BITS
SAMPLE, CLASSES, SEED = 4_000, 512, 41
WIDTH, EPOCHS, RATE, BATCH = 16, 12, 2.0, 64
#: Share of the sample kept out for calibration, and the accuracy wanted above the rejection line.
KEPT_OUT, WANTED = 0.2, 0.995
PREDICTION = StructType([StructField("lang", StringType()), StructField("score", DoubleType()), StructField("rejected", BooleanType())])
#: ASCII bytes that are no letters separate words.
SEPARATOR = np.array([b < 128 and not chr(b).isalpha() for b in range(256)])


def subwords(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text index, bucket) of every subword of a batch, in portions of about a megabyte of text."""
    buf, offsets = tb.text_bytes(texts)
    whole = tb.words(buf, offsets, SEPARATOR)
    docs = whole.doc()
    for at, stop in tb.word_chunks(whole):
        w, doc = tb.part(whole, at, stop), docs[at:stop]
        ids, hashes = [doc], [tb.span_hashes(buf, w.start, w.end, tb.LOWER)]
        # Grams inside the word; its first and last two bytes carry their place.
        for n in (3, 4):
            word, h = tb.inner_grams(buf, w, n, n, tb.LOWER)
            ids.append(doc[word])
            hashes.append(h)
        for salt, start, end in ((11, w.start, np.minimum(w.start + 2, w.end)), (12, np.maximum(w.end - 2, w.start), w.end)):
            ids.append(doc)
            hashes.append(tb.mix(tb.span_hashes(buf, start, end, tb.LOWER) + np.uint64(salt)))
        yield np.concatenate(ids), (np.concatenate(hashes) >> np.uint64(64 - BITS)).astype(np.int64)


def has_letter(texts: pa.Array) -> np.ndarray:
    """Whether each text has a letter (Unicode category L)."""
    buf, offsets = tb.text_bytes(texts)
    ascii_letter = np.zeros(256, bool)
    ascii_letter[[b for b in range(128) if chr(b).isalpha()]] = True
    seen = np.concatenate([[0], np.cumsum(ascii_letter[buf])])
    out = seen[offsets[1:]] > seen[offsets[:-1]]
    high = np.concatenate([[0], np.cumsum(buf >= 128)])
    for i in np.flatnonzero(~out & (high[offsets[1:]] > high[offsets[:-1]])):
        out[i] = any(c.isalpha() for c in texts[int(i)].as_py())
    return out


@arrow_udf(BinaryType())
def _packed(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Each text's subword counts: distinct buckets, then their counts (32-bit integers)."""
    for batch in texts:
        for part in tb.slices(batch):
            counts = [np.unique(doc * BUCKETS + at, return_counts=True) for doc, at in subwords(part)]
            key, back = np.unique(np.concatenate([np.zeros(0, np.int64), *[c[0] for c in counts]]), return_inverse=True)
            n = np.bincount(back, np.concatenate([np.zeros(0), *[c[1] for c in counts]]), len(key))
            first = np.searchsorted(key, np.arange(len(part) + 1) * BUCKETS)
            rows = [slice(first[i], first[i + 1]) for i in range(len(part))]
            yield pa.array([np.concatenate([key[s] % BUCKETS, n[s]]).astype("<u4").tobytes() for s in rows], pa.binary())


def train(rows: list[bytes], langs: list[str]) -> dict:
    """Fit table, softmax, temperature and rejection line on packed texts."""
    names, y = np.unique(np.array(langs, object).astype(str), return_inverse=True) if langs else (np.array([], str), np.zeros(0, int))
    if len(names) > CLASSES:
        top = np.argsort(-np.bincount(y), kind="stable")[:CLASSES]
        keep = np.isin(y, top)
        return train([r for r, k in zip(rows, keep) if k], [x for x, k in zip(langs, keep) if k])
    k = len(names)
    rng = np.random.default_rng(SEED)
    table, soft = rng.normal(0, 1 / WIDTH, (BUCKETS, WIDTH)), np.zeros((WIDTH, k))
    texts = []
    for r in rows:
        x = np.frombuffer(r, "<u4").astype(np.int64)
        at, n = x[:len(x) // 2], x[len(x) // 2:].astype(float)
        texts.append((at, n / max(1.0, n.sum())))
    out = rng.random(len(rows)) < KEPT_OUT
    fit, held = np.flatnonzero(~out), np.flatnonzero(out)
    steps, done = EPOCHS * max(1, -(-len(fit) // BATCH)), 0
    for _ in range(EPOCHS):
        for part in np.array_split(rng.permutation(fit), max(1, -(-len(fit) // BATCH))) if len(fit) else ():
            rate = RATE * (1 - done / steps)
            done += 1
            hidden = np.stack([f @ table[at] for at, f in (texts[i] for i in part)])
            g = softmax(hidden @ soft)
            g[np.arange(len(part)), y[part]] -= 1
            back = g @ soft.T
            soft -= rate * hidden.T @ g / len(part)
            for i, row in zip(part, back):
                at, f = texts[i]
                table[at] -= rate * f[:, None] * row
    votes = table @ soft
    z = np.stack([f @ votes[at] for at, f in (texts[i] for i in held)]) if len(held) else np.zeros((0, k))
    heat = min((0.25 * 1.25 ** i for i in range(20)), key=lambda t: -np.log(softmax(z / t)[np.arange(len(held)), y[held]] + 1e-12).sum())
    p = softmax(z / heat)
    best, right = p.max(1, initial=0), p.argmax(1) == y[held] if len(held) else np.zeros(0, bool)
    line = 0.0
    for c in np.sort(best):
        if right[best >= c].mean() >= WANTED:
            line = float(c)
            break
    return {"names": names.tolist(), "votes": (votes / heat).astype(np.float32), "line": line}


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True, initial=-1e9))
    return e / e.sum(1, keepdims=True)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> dict:
    """Learn from the rows given (the caller leaves out what must not be learnt from)."""
    bounded_batches()
    named = docs.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang"))
    chosen = hash_sample(named, "_id", sample, SEED)
    packed = chosen.select("_id", "_lang", _packed("_text").alias("_f")).groupBy("_id").agg(F.min(F.struct("_lang", "_f")).alias("r"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist())]
        got.sort(key=lambda r: r[0])
        model = train([r[2] for r in got], [r[1] for r in got])
        yield pa.RecordBatch.from_pydict({"names": pa.array([model["names"]], pa.list_(pa.string())), "line": [model["line"]],
                                          "votes": pa.array([model["votes"].tobytes()], pa.binary())})

    got = packed.select(F.col("_id").cast("string"), "r._lang", "r._f").repartition(1).mapInArrow(
        run, "names array<string>, line double, votes binary").first()
    if got is None:
        return {"names": [], "votes": np.zeros((BUCKETS, 0), np.float32), "line": 0.0}
    return {"names": list(got["names"]), "line": got["line"], "votes": np.frombuffer(bytes(got["votes"]), np.float32).reshape(BUCKETS, -1)}


def predict(docs: DataFrame, model: dict, text_col: str = "text") -> Column:
    """Column: struct of the language, its probability and whether it is rejected."""
    bounded_batches()
    held = docs.sparkSession.sparkContext.broadcast(model)

    @arrow_udf(PREDICTION)
    def predicted(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = held.value
        names = np.array(m["names"], object)
        for batch in texts:
            for part in tb.slices(batch):
                n, known = len(part), has_letter(part)
                if not len(names):
                    known[:] = False
                many, z = np.zeros(n), np.zeros((n, max(1, len(names))))
                for doc, at in subwords(part):
                    many += np.bincount(doc, minlength=n)
                    for j in range(len(names)):
                        z[:, j] += np.bincount(doc, m["votes"][:, j][at], n)
                p = softmax(z / np.maximum(many, 1)[:, None])
                score = np.where(known, p.max(1), 0.0)
                langs = [x if k else "und" for x, k in zip(names[p.argmax(1)] if len(names) else [None] * n, known)]
                yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(score, pa.float64()),
                                                  pa.array(~known | (score < m["line"]), pa.bool_())], names=["lang", "score", "rejected"])

    return predicted(F.col(text_col))
