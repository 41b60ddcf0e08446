"""Quality classifier by positive-unlabelled learning.

Texts are described by word and character statistics, each cut at quantiles of the training
sample into one-hot bins; a logistic model over the bins is trained on trusted positives (texts
labelled good) and unlabelled web text (texts whatever their label, unseen). The class prior of
the unlabelled text comes from the best-bin estimate: a classifier of positives against
unlabelled text ranks both, and the smallest ratio of their tail shares bounds the prior. The
model then minimises the non-negative risk  prior * R+(g) + max(0, Ru-(g) - prior * Rp-(g))
(when the bracket turns negative its gradient is reversed) with Adam.

Fitting uses about ``SAMPLE`` positives and ``SAMPLE`` unlabelled texts (hash-chosen, documented
bounds). Scoring is one pass over whole texts.

Defined results: null and empty texts have zero statistics and are scored like any other;
repeated rows score alike; without positives or unlabelled text the score is the prior of 0.5;
null labels and ids are not learnt from.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, DoubleType

from . import textbatch as tb
from .common import bounded_batches, hash_sample

SAMPLE, SEED = 8_000, 21
BINS, STEPS, RATE = 24, 2_000, 0.1
#: Weight of the squared norm, per positive, of the ranking and of the final model.
ROUGH, NORM = 5.0, 0.02
FEATURES = ("words", "chars", "mean_length", "long_words", "short_words", "upper", "capitals", "digits", "symbols", "bars", "bangs", "stops",
            "commas", "quotes", "distinct", "neighbours", "windows", "lines", "line_words", "high_bytes", "odd_ends", "lone_marks")


def _mask(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out


_UPPER, _LOWER, _DIGIT = _mask("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _mask("abcdefghijklmnopqrstuvwxyz"), _mask("0123456789")
_SYMBOL, _PUNCT = _mask("#*$%&<>~^=_\\@"), _mask("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")


def statistics(texts: pa.Array) -> np.ndarray:
    """[text, statistic]: shares and log counts, all zero for an empty text."""
    buf, offsets = tb.text_bytes(texts)
    w = tb.words(buf, offsets)
    n, doc, m = len(texts), w.doc(), w.counts().astype(float)
    some = np.maximum(m, 1)
    size = np.maximum(np.diff(offsets), 1).astype(float)

    def per_byte(mask):
        c = np.concatenate([[0], np.cumsum(mask[buf])])
        return c, c[offsets[1:]] - c[offsets[:-1]]

    def share(flag):
        return np.bincount(doc, flag, n) / some

    length = w.end - w.start
    h = tb.span_hashes(buf, w.start, w.end)
    key = doc.astype(np.uint64) << np.uint64(40) | h >> np.uint64(24)
    distinct = np.bincount((np.unique(key) >> np.uint64(40)).astype(np.int64), minlength=n) / some
    follow = np.zeros(len(h), bool)
    if len(h) > 1:
        follow[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    pairs, pair_doc = tb.pair_hashes(h, doc, 1, 5)
    pair_key = pair_doc.astype(np.uint64) << np.uint64(40) | pairs >> np.uint64(24)
    seen = np.bincount((np.unique(pair_key) >> np.uint64(40)).astype(np.int64), minlength=n)
    again = 1 - seen / np.maximum(m - 1, 1)
    cu, upper = per_byte(_UPPER)
    cl, lower = per_byte(_LOWER)
    cp, _ = per_byte(_PUNCT)
    capitals = (cu[w.end] - cu[w.start] > 0) & (cl[w.end] - cl[w.start] == 0)
    marks = cp[w.end] - cp[w.start]
    last = buf[w.end - 1] if len(w.end) else np.zeros(0, np.uint8)
    lines = np.zeros(256, bool)
    lines[10] = True
    _, breaks = per_byte(lines)
    high = np.arange(256) >= 128

    def density(chars):
        return per_byte(_mask(chars))[1] / size

    cols = [np.log1p(m), np.log1p(np.diff(offsets)), share(length), share(length > 12), share(length <= 3), upper / np.maximum(upper + lower, 1),
            share(capitals), per_byte(_DIGIT)[1] / size, per_byte(_SYMBOL)[1] / size, density("|"), density("!"), density("."), density(","),
            density("\"'"), distinct, share(follow), np.where(m > 1, again, 0), np.log1p(breaks), np.log1p(m / (breaks + 1)),
            per_byte(high)[1] / size, share(_SYMBOL[last]), share(marks == length)]
    return np.stack(cols, 1)


@arrow_udf(ArrayType(DoubleType()))
def _described(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in texts:
        for part in tb.slices(batch):
            x = statistics(part)
            yield pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], x.ravel())


def binned(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Weight index of each statistic's bin."""
    out = np.empty(x.shape, np.int64)
    for j in range(x.shape[1]):
        out[:, j] = np.searchsorted(edges[j], x[:, j], "right") + j * (BINS + 1)
    return out


def _raw(w: np.ndarray, at: np.ndarray) -> np.ndarray:
    return w[at].sum(1) + w[-1]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def _spread(at: np.ndarray, g: np.ndarray, size: int) -> np.ndarray:
    out = np.bincount(at.ravel(), np.repeat(g, at.shape[1]), size)
    out[-1] += g.sum()
    return out


def descend(gradient, size: int, decay: float) -> np.ndarray:
    """Adam; ``decay`` is the weight of the squared norm in the objective."""
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for step in range(1, STEPS + 1):
        g = gradient(w) + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return w


def class_prior(p: np.ndarray, u: np.ndarray) -> float:
    """Best-bin estimate from scores of positives and of unlabelled texts not fitted on."""
    if not len(p) or not len(u):
        return 0.5
    line = np.unique(p)
    tail_p = 1 - np.searchsorted(np.sort(p), line, "left") / len(p)
    tail_u = 1 - np.searchsorted(np.sort(u), line, "left") / len(u)
    slack = np.sqrt(np.log(4 / 0.1) / 2) * (1 / np.sqrt(len(p)) + 1 / np.sqrt(len(u)))
    bound = (tail_u + slack) / tail_p
    best = int(np.argmin(bound))
    return float(np.clip(tail_u[best] / tail_p[best], 0.01, 0.99))


def train(p: np.ndarray, u: np.ndarray) -> dict:
    """Bin edges, weights and prior from statistics of positives and of unlabelled texts."""
    pool = np.concatenate([p, u])
    width = len(FEATURES)
    # The number of bins follows the square root of the sample; unused edges lie beyond all values.
    used = int(np.clip(np.sqrt(len(p)) / 2, 4, BINS))
    edges = np.full((width, BINS), np.inf)
    if len(pool):
        edges[:, :used] = np.quantile(pool, np.linspace(0, 1, used + 2)[1:-1], axis=0).T
    size = width * (BINS + 1) + 1
    if not len(p) or not len(u):
        return {"edges": edges, "w": np.zeros(size), "prior": 0.5}
    bp, bu = binned(p, edges), binned(u, edges)
    # Scores for the prior come from a classifier fitted on the other half of the sample.
    scored_p, scored_u = np.empty(len(p)), np.empty(len(u))
    for one, other in ((slice(0, None, 2), slice(1, None, 2)), (slice(1, None, 2), slice(0, None, 2))):
        a, b = bp[one], bu[one]
        rough = descend(lambda w: (_spread(a, _sigmoid(_raw(w, a)) - 1, size) + _spread(b, _sigmoid(_raw(w, b)), size) * (len(a) / max(1, len(b)))) / max(1, len(a)),
                        size, ROUGH / max(1, len(a)))
        scored_p[other], scored_u[other] = _sigmoid(_raw(rough, bp[other])), _sigmoid(_raw(rough, bu[other]))
    prior = class_prior(scored_p, scored_u)

    def risk(w):
        sp, su = _sigmoid(_raw(w, bp)), _sigmoid(_raw(w, bu))
        negative = -np.log1p(-su + 1e-12).mean() + prior * np.log1p(-sp + 1e-12).mean()
        of_positive = _spread(bp, sp - 1, size) / len(bp) * prior
        of_negative = _spread(bu, su, size) / len(bu) - prior * _spread(bp, sp, size) / len(bp)
        return of_positive + of_negative if negative >= 0 else -of_negative

    return {"edges": edges, "w": descend(risk, size, NORM / len(p)), "prior": prior}


def fit(docs: DataFrame, good: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> dict:
    """``good``: ids of trusted positives. ``docs``: the rows that may be learnt from; their
    hash sample is the unlabelled text. Both samples are chosen by id, then described in place."""
    bounded_batches()
    ids = docs.select(F.col(id_col).alias("_id")).where(F.col("_id").isNotNull())
    positive = hash_sample(good.select(F.col(id_col).alias("_id")).where(F.col("_id").isNotNull()).distinct(), "_id", sample, SEED)
    web = hash_sample(ids, "_id", sample, SEED + 1).distinct()
    chosen = positive.withColumn("_p", F.lit(True)).unionByName(web.withColumn("_p", F.lit(False))).groupBy("_id").agg(
        F.max("_p").alias("_p"), F.max(~F.col("_p")).alias("_u"))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), "_id").select(
        "_id", "_p", "_u", _described("_text").alias("_x"))
    rows = rows.groupBy("_id").agg(F.min(F.struct("_x", "_p", "_u")).alias("r")).select(F.col("_id").cast("string"), "r._p", "r._u", "r._x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [r for b in batches for r in zip(*(b.column(i).to_pylist() for i in range(4)))]
        got.sort(key=lambda r: r[0])
        x = np.array([r[3] for r in got]).reshape(-1, len(FEATURES))
        model = train(x[[bool(r[1]) for r in got]], x[[bool(r[2]) for r in got]])
        yield pa.RecordBatch.from_pydict({"edges": pa.array([model["edges"].ravel()], pa.list_(pa.float64())),
                                          "w": pa.array([model["w"]], pa.list_(pa.float64())), "prior": [model["prior"]]})

    got = rows.repartition(1).mapInArrow(run, "edges array<double>, w array<double>, prior double").first()
    if got is None:
        return train(np.zeros((0, len(FEATURES))), np.zeros((0, len(FEATURES))))
    return {"edges": np.array(got["edges"]).reshape(len(FEATURES), BINS), "w": np.array(got["w"]), "prior": got["prior"]}


def score(docs: DataFrame, model: dict, text_col: str = "text") -> Column:
    """Column: probability (0 to 1) that the text is good."""
    bounded_batches()
    held = docs.sparkSession.sparkContext.broadcast(model)

    @arrow_udf(DoubleType())
    def scored(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = held.value
        for batch in texts:
            for part in tb.slices(batch):
                yield pa.array(_sigmoid(_raw(m["w"], binned(statistics(part), m["edges"]))), pa.float64())

    return scored(F.col(text_col))
