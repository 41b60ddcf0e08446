"""Quality rules with robust multivariate outliers.

Word and line counts of whole texts give a vector of transformed statistics (``DIMS`` numbers).
For each language and source, location and scatter are minimum-covariance-determinant estimates:
starting from medians and absolute deviations, concentration steps refit mean and covariance on
the share ``SUBSET`` of the group's texts with the smallest Mahalanobis distances. A text is
rejected if its squared distance exceeds the chi-square quantile ``LEVEL``, or by the base rules.

Every step covers all texts; texts of a group with the same counts (copies) are one point, so that
a group of copies neither makes the estimate nor is judged by its size. A step is one aggregation: distances are binned finely, moments are
summed per group and bin (so a source with a third of all texts is pre-aggregated before the
shuffle), and the bins up to the subset's size give the next estimate. Groups of fewer than
``LEAST`` texts are estimated together with the other small groups of their language, and these,
if still too few, with those of all languages. Fewer than ``LEAST`` points have no robust subset: their mean
and covariance are taken whole.

No scale is a constant. Along any direction a variance below the mean counting error of the subset's
own texts counts as that error (the scatter is whitened by the errors and its eigenvalues are at
least one), so that copies of a few texts, whose scatter is singular, keep finite distances, and statistics that are zero in nearly all texts do not reject on
the first deviation: 1 / n for the log of n words, 1 / (4 n) for the square root of a share of n
(its binomial error, whatever the share), ``CLUMP`` times that for repeated words, as one
repeated window covers two windows of three words.

Defined results: null and empty texts have zero counts and fail the base rule on length; null
languages and sources are groups like any other; repeated rows are judged alike; empty tables
give empty results; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from . import textbatch as tb
from .common import bounded_batches, cut

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capital_words", "n_mark_words")
_STRUCT = StructType([StructField(c, LongType()) for c in COUNTS])
DIMS = 7
SUBSET, STEPS, LEVEL, LEAST = 0.75, 6, 0.999, 100
CLUMP = 6
#: Counting error of each statistic: the place in ``inverse_lengths`` and its factor.
ERROR = ((0, 1.0), (1, 0.25), (1, 0.25), (2, 0.25), (0, 0.25 * CLUMP), (0, 0.25), (0, 0.25))
GRID = 128  # bins to one unit of a statistic
FINE = 32  # bins to a doubling of a squared distance
#: Groups up to which their estimates are sent to all executors (about 1 kB each).
BROADCAST_GROUPS = 10_000

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER, _LOWER = np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91] = _LOWER[97:123] = True
_ALNUM = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])


def counts(texts: pa.Array) -> np.ndarray:
    """[text, count] in the order of ``COUNTS``."""
    buf, offsets = tb.text_bytes(texts)
    w, n = tb.words(buf, offsets), len(texts)
    doc = w.doc()

    def running(flags):
        return np.concatenate([[0], np.cumsum(flags)])

    def in_text(flags):
        c = running(flags)
        return c[offsets[1:]] - c[offsets[:-1]]

    # Words repeated in three-word windows.
    h = tb.span_hashes(buf, w.start, w.end)
    covered = np.zeros(len(h) + 1, np.int64)
    if len(h) > 2:
        window = np.flatnonzero(doc[:-2] == doc[2:])
        t = tb.mix(h[window] * np.uint64(3) + h[window + 1] * np.uint64(0x2545F4914F6CDD1D) + tb.mix(h[window + 2]))
        t = tb.mix(t + tb.mix(doc[window].astype(np.uint64)))
        order = np.argsort(t, kind="stable")
        same = t[order[1:]] == t[order[:-1]]
        again = np.zeros(len(t), bool)
        again[order[1:][same]] = again[order[:-1][same]] = True
        begin = window[again]
        np.add.at(covered, begin, 1)
        np.subtract.at(covered, begin + 3, 1)
    repeated = np.cumsum(covered)[:-1] > 0 if len(h) else np.zeros(0, bool)
    # Lines that hold a word.
    newline = np.zeros(256, bool)
    newline[10] = True
    lines = tb.words(buf, offsets, newline)
    inked = running(~tb.SPACE[buf])
    full = inked[lines.end] > inked[lines.start]
    line_doc = lines.doc()[full]
    line_hash = tb.span_hashes(buf, lines.start[full], lines.end[full])
    n_lines = np.bincount(line_doc, minlength=n)
    pairs = np.unique(np.stack([line_doc.astype(np.uint64), line_hash], 1), axis=0) if len(line_doc) else np.zeros((0, 2), np.uint64)
    distinct = np.bincount(pairs[:, 0].astype(np.int64), minlength=n)
    up, low, some = running(_UPPER[buf]), running(_LOWER[buf]), running(_ALNUM[buf])
    capital = (up[w.end] > up[w.start]) & (low[w.end] == low[w.start])
    mark = some[w.end] == some[w.start]
    characters = ~tb.SPACE[buf] & (buf & 0xC0 != 0x80)
    return np.stack([w.counts(), in_text(characters), in_text(_SYMBOL[buf]), n_lines - distinct, np.bincount(doc, repeated, n).astype(np.int64),
                     n_lines, np.bincount(doc, capital, n).astype(np.int64), np.bincount(doc, mark, n).astype(np.int64)], 1)


@arrow_udf(_STRUCT)
def counted(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Struct of ``COUNTS`` for each text."""
    for batch in texts:
        for part in tb.slices(batch):
            x = counts(part)
            yield pa.StructArray.from_arrays([pa.array(x[:, j], pa.int64()) for j in range(x.shape[1])], names=list(COUNTS))


def transformed() -> list[Column]:
    """The statistic vector: log length, log word length and square roots of shares."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    root = lambda a, b: F.sqrt(F.least(F.col(a) / b, F.lit(1.0)))
    return [F.log1p("n_words"), F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n), root("n_symbols", F.greatest(F.col("word_chars"), F.lit(1))),
            root("n_dup_lines", F.greatest(F.col("n_lines"), F.lit(1))), root("n_repeat_words", n), root("n_capital_words", n), root("n_mark_words", n)]


def inverse_lengths() -> list[Column]:
    """One over the words, the characters and the lines of a text."""
    return [1 / F.greatest(F.col(c), F.lit(1)) for c in ("n_words", "word_chars", "n_lines")]


def chi_square(p: int, share: float) -> float:
    """Quantile of the chi-square distribution, by bisection."""
    lo, hi = 0.0, 1000.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi_square_share(p, mid) < share else (lo, mid)
    return lo


def chi_square_share(p: int, x: float) -> float:
    """Distribution function: the series of the lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    a, z = p / 2, x / 2
    term = total = 1 / a
    for k in range(1, 2000):
        term *= z / (a + k)
        total += term
    return min(1.0, math.exp(a * math.log(z) - z - math.lgamma(a)) * total)


def _grouped(rows: DataFrame) -> DataFrame:
    """Adds ``unit``: the group a text is judged in."""
    one = F.to_json(F.struct(F.col("lang").alias("l"), F.col("source").alias("s")))
    of_lang = F.to_json(F.struct(F.col("lang").alias("of")))
    sizes = rows.groupBy("lang", "source").agg(F.count("*").alias("n")).withColumn("small", F.col("n") < LEAST)
    over = Window.partitionBy("lang", "small")
    whole = F.when(~F.col("small"), one).when(F.sum("n").over(over) >= LEAST, of_lang).otherwise(F.lit("{}"))
    units = sizes.select(F.col("lang").alias("_l"), F.col("source").alias("_s"), whole.alias("unit"))
    units = _shared(cut(units))
    return rows.join(units, F.col("lang").eqNullSafe(F.col("_l")) & F.col("source").eqNullSafe(F.col("_s"))).drop("_l", "_s")


def _shared(table: DataFrame) -> DataFrame:
    """Broadcast a checkpointed table of groups if it is small enough, else leave the join to Spark."""
    return F.broadcast(table) if table.count() <= BROADCAST_GROUPS else table


def _start(rows: DataFrame) -> DataFrame:
    """(unit, n, mu, inverse): medians and 1.4826 times the median absolute deviations, exact to
    the grid, from counts per grid cell; the counting errors are means over all texts."""
    long = rows.select("unit", F.posexplode("x").alias("j", "v"))

    def median(df, value):
        cells = df.groupBy("unit", "j", F.round(value * GRID).cast("long").alias("cell")).agg(F.count("*").alias("n"))
        w = Window.partitionBy("unit", "j")
        up = F.sum("n").over(w.orderBy("cell"))
        return cells.withColumn("up", up).withColumn("n", F.sum("n").over(w)).where(F.col("up") * 2 >= F.col("n")).groupBy("unit", "j").agg(
            (F.min("cell") / GRID).alias("m"), F.first("n").alias("n"))

    mid = cut(median(long, F.col("v")))
    off = median(long.join(_shared(mid).withColumnRenamed("n", "_n"), ["unit", "j"]), F.abs(F.col("v") - F.col("m")))
    lengths = rows.groupBy("unit").agg(*[F.avg(F.col("e")[i]).alias(f"e{i}") for i in range(3)])
    errors = cut(lengths.select("unit", F.array(*[F.sqrt(F.col(f"e{i}") * f) for i, f in ERROR]).alias("least")))
    both = mid.join(off.select("unit", "j", F.col("m").alias("d")), ["unit", "j"]).join(_shared(errors), "unit")
    spread = F.greatest(F.col("d") * 1.4826, F.element_at("least", F.col("j") + 1))
    per = both.groupBy("unit").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("j", "m", spread.alias("s")))).alias("v"))
    inverse = F.flatten(F.array(*[F.array(*[1 / F.pow(F.col("v")[i]["s"], 2) if i == j else F.lit(0.0) for j in range(DIMS)]) for i in range(DIMS)]))
    return per.select("unit", "n", F.transform("v", lambda t: t["m"]).alias("mu"), inverse.alias("inverse"))


def _distance() -> Column:
    """Squared Mahalanobis distance of ``x`` from ``mu`` under ``inverse`` (row-major)."""
    d = [F.col("x")[i] - F.col("mu")[i] for i in range(DIMS)]
    terms = [d[i] * d[j] * F.col("inverse")[i * DIMS + j] * (1 if i == j else 2) for i in range(DIMS) for j in range(i, DIMS)]
    return F.greatest(sum(terms[1:], terms[0]), F.lit(0.0))


_PAIRS = [(i, j) for i in range(DIMS) for j in range(i, DIMS)]


@arrow_udf(ArrayType(DoubleType()))
def _inverted(moments: pa.Array, robust: pa.Array) -> pa.Array:
    """Means, then the inverse of the covariance (consistent for normal data). In units of the
    counting errors no direction varies by less than one: a scatter of few distinct texts, or of
    statistics that move together, has directions without any variance."""
    factor = SUBSET / chi_square_share(DIMS + 2, chi_square(DIMS, SUBSET))
    out = []
    for m, part in zip(moments.to_pylist(), robust.to_pylist()):
        n, sums, squares = m[0], np.array(m[1:1 + DIMS]), m[1 + DIMS:-3]
        mu = sums / n
        cov = np.zeros((DIMS, DIMS))
        for (i, j), s in zip(_PAIRS, squares):
            cov[i, j] = cov[j, i] = s / n - mu[i] * mu[j]
        cov *= factor if part else 1
        unit = 1 / np.sqrt([m[len(m) - 3 + i] / n * f for i, f in ERROR])
        wide, turn = np.linalg.eigh(cov * np.outer(unit, unit))
        turn = unit[:, None] * turn
        out.append(np.concatenate([mu, (turn / np.maximum(wide, 1) @ turn.T).ravel()]).tolist())
    return pa.array(out, pa.list_(pa.float64()))


def _step(rows: DataFrame, now: DataFrame) -> DataFrame:
    """One concentration step."""
    placed = rows.join(_shared(now), "unit").withColumn("bin", F.floor(F.log2(_distance() + 2.0 ** -10) * FINE).cast("long"))
    x = [F.col("x")[i] for i in range(DIMS)]
    moments = [F.sum(c).alias(f"m{k}") for k, c in enumerate([F.lit(1.0), *x, *[x[i] * x[j] for i, j in _PAIRS], *[F.col("e")[i] for i in range(3)]])]
    bins = placed.groupBy("unit", "bin").agg(F.first("n").alias("n"), *moments)
    before = F.coalesce(F.sum("m0").over(Window.partitionBy("unit").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    inner = bins.withColumn("before", before).where(F.col("before") < F.col("n") * F.when(F.col("n") < LEAST, 1.0).otherwise(SUBSET))
    total = inner.groupBy("unit").agg(F.first("n").alias("n"), F.array(*[F.sum(f"m{k}") for k in range(len(moments))]).alias("m"))
    fitted = total.select("unit", "n", _inverted("m", F.col("n") >= LEAST).alias("f"))
    return fitted.select("unit", "n", F.slice("f", 1, DIMS).alias("mu"), F.slice("f", DIMS + 1, DIMS * DIMS).alias("inverse"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row per text: doc_id, the counts, base_failed, distance (squared), kept."""
    bounded_batches()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), counted(F.col(text_col)).alias("c"))
    rows = cut(rows.select("doc_id", "lang", "source", "c.*"))
    units = cut(_grouped(rows).select("doc_id", "unit", *COUNTS, F.array(*transformed()).alias("x"), F.array(*inverse_lengths()).alias("e")))
    points = cut(units.groupBy("unit", *COUNTS).agg(F.first("x").alias("x"), F.first("e").alias("e")).select("unit", "x", "e"))
    now = cut(_start(points))
    for _ in range(STEPS):
        now = cut(_step(points, now))
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    far = units.join(_shared(now), "unit").withColumn("distance", _distance())
    return far.select("doc_id", *COUNTS, failed.alias("base_failed"), "distance",
                      (~failed & (F.col("distance") <= chi_square(DIMS, LEVEL))).alias("kept"))
