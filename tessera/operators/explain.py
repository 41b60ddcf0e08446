"""Pair explanation: why is a candidate text similar to a query text?

Batch form over a pair table ``(pair_id, query_text, cand_text)``; ``pair_id`` is of any type.

1. Distinct texts of both sides, one row each, split into sentences and words (tokens minus
   stop words) inside the row.
2. TextRank weight per sentence, once per distinct text: power iterations in numpy on a
   pair-free factorisation of the word-overlap similarity (by word and sentence length).
3. Key sentences: ``n_key = max(min(n // 3, sentence_number), 1)``, best weights first,
   sentences shorter than ``sentence_min_len`` characters skipped.
4. Each pair joins its two text rows (at most ``2 x sentence_number`` key sentences) and is
   explained inside its row: cosine of key sentences on raw word counts, the adaptive
   threshold, matched pairs above it (identical texts: sentence i with sentence i), and the
   connected components of the match graph, two-sided only, largest first.

Shuffles: one to find the distinct texts, two joins by text. The text table is checkpointed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from ..functions.labels import keep_token
from ..functions.text import split_sentences, tokenize
from ..session import ensure_checkpoint_dir

DAMPING = 0.85
ITERATIONS = 20
WEIGHT_DIGITS = 9
SENTENCE_NUMBER = 10
SENTENCE_MIN_LEN = 10
RELATION_RATIO = 0.2
STEP = 0.01
COLORS = 5

_RANKED = T.StructType([
    T.StructField("weights", T.ArrayType(T.DoubleType())),
    T.StructField("keys", T.ArrayType(T.IntegerType())),  # sentence indices, best first
    T.StructField("n_key", T.IntegerType()),
])
_EDGE = T.StructType([T.StructField("q_idx", T.IntegerType()), T.StructField("c_idx", T.IntegerType()), T.StructField("score", T.DoubleType())])
_COMPONENT = T.StructType([T.StructField("q_idx", T.ArrayType(T.IntegerType())), T.StructField("c_idx", T.ArrayType(T.IntegerType()))])
_FOUND = T.StructType([
    T.StructField("cosines", T.ArrayType(_EDGE)),
    T.StructField("threshold", T.DoubleType()),
    T.StructField("min_key", T.IntegerType()),
    T.StructField("n_zero", T.IntegerType()),
    T.StructField("matched", T.ArrayType(_EDGE)),
    T.StructField("components", T.ArrayType(_COMPONENT)),
])


# ---------------------------------------------------------------- sentences and words


def words(sentence: Column, stop_words=None, analyzer: Callable[[Column], Column] = tokenize) -> Column:
    """Words of a sentence: the analyzer's tokens minus stop words (a list) and bare numbers."""
    stop = F.array(*[F.lit(w) for w in stop_words]).cast("array<string>") if stop_words else None
    return F.filter(analyzer(sentence), lambda x: keep_token(x, stop))


def sentence_array(text: Column, stop_words=None, analyzer: Callable[[Column], Column] = tokenize) -> Column:
    """``array<struct<sentence, words>>`` of a text, in order."""
    return F.transform(split_sentences(text), lambda s: F.struct(s.alias("sentence"), words(s, stop_words, analyzer).alias("words")))


# ---------------------------------------------------------------- TextRank and key sentences


def textrank(sentences: list[list[str]], iterations: int = ITERATIONS, damping: float = DAMPING) -> np.ndarray:
    """Weights of a text's sentences, given as word lists: ``ws <- (1-d) + d * sum_j (w_ji /
    out_j) ws_j`` from ``ws = 1``, ``w_ij`` = shared distinct words / (ln |i| + ln |j|) (no
    edge when the denominator is zero); isolated sentences end at ``1 - d``.

    With ``S[w, k]`` the sum of ``y`` over sentences of length class k that hold word w,
    ``sum_j w_ij y_j = sum_{w in i} sum_k S[w, k] / (ln n_i + ln m_k)`` minus i's own term:
    linear in the text's sentence-word pairs, one class at a time, never sentence x sentence.
    """
    n = len(sentences)
    vocabulary: dict[str, int] = {}
    distinct = [list({vocabulary.setdefault(w, len(vocabulary)) for w in s}) for s in sentences]
    row = np.repeat(np.arange(n), [len(d) for d in distinct])
    word = np.array([w for d in distinct for w in d], np.int64)
    if not len(word):
        return np.full(n, 1.0 if iterations == 0 else 1.0 - damping)
    lengths, of = np.unique([len(s) for s in sentences], return_inverse=True)
    with np.errstate(divide="ignore"):  # sentences without words hold no pair
        log = np.log(lengths.astype(float))
    total = log[:, None] + log[None, :]
    inverse = np.where(np.abs(total) >= 1e-12, 1.0 / np.where(total == 0, 1.0, total), 0.0)
    mine = of[row]
    members = [(k, at) for k in range(len(lengths)) if len(at := np.flatnonzero(mine == k))]

    def neighbour_sum(y: np.ndarray) -> np.ndarray:
        out = np.zeros(len(word))
        for k, inside in members:
            held = np.bincount(word[inside], y[row[inside]], len(vocabulary))[word]
            held[inside] -= y[row[inside]]
            out += held * inverse[mine, k]
        return np.bincount(row, out, n)

    degree = neighbour_sum(np.ones(n))
    live = degree > 0
    weight = np.where(live, 1.0, 0.0)
    for _ in range(iterations):
        weight = (1.0 - damping) + damping * neighbour_sum(np.where(live, weight / np.where(live, degree, 1.0), 0.0))
    return np.where(live, weight, 1.0 - damping) if iterations else np.ones(n)


def n_key(n, sentence_number: int = SENTENCE_NUMBER):
    """Key-sentence target: at most a third of the sentences, at most ``sentence_number``, at
    least one."""
    return max(min(n // 3, sentence_number), 1)


def ranked(sentences: Column, sentence_number: int = SENTENCE_NUMBER, min_len: int = SENTENCE_MIN_LEN,
           iterations: int = ITERATIONS, damping: float = DAMPING) -> Column:
    """Struct of the sentences' weights, the key sentences' indices (best first) and their target."""

    @arrow_udf(_RANKED)
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            rows = []
            for at in range(len(batch)):  # a batch is bounded by bytes; one text at a time is unpacked
                sents = batch[at].as_py()
                weights = np.round(textrank([s["words"] for s in sents], iterations, damping), WEIGHT_DIGITS).tolist()
                target = n_key(len(sents), sentence_number)
                long = [i for i, s in enumerate(sents) if len(s["sentence"]) >= min_len]
                rows.append({"weights": weights, "keys": sorted(long, key=lambda i: (-weights[i], i))[:target], "n_key": target})
            yield pa.array(rows, pa.struct([("weights", pa.list_(pa.float64())), ("keys", pa.list_(pa.int32())), ("n_key", pa.int32())]))

    return run(sentences)


def text_table(pairs: DataFrame, stop_words=None, analyzer: Callable[[Column], Column] = tokenize, **tunables) -> DataFrame:
    """One row per distinct text of the pairs: ``(tid, sents, r)``; ``tid`` is the text's hash."""
    both = pairs.select(F.col("query_text").alias("text")).unionByName(pairs.select(F.col("cand_text").alias("text")))
    texts = both.withColumn("tid", text_id("text")).dropDuplicates(["tid"])
    sents = texts.select("tid", sentence_array(F.col("text"), stop_words, analyzer).alias("sents"))
    return sents.withColumn("r", ranked(F.col("sents"), **tunables))


def text_id(col: str) -> Column:
    return F.sha2(F.coalesce(F.col(col), F.lit("")).cast("binary"), 256)


# ---------------------------------------------------------------- one pair


def ladder(start: float, step: float, stop: Callable[[float], bool]) -> list[float]:
    """``start`` and what repeated addition of ``step`` makes of it, up to where ``stop`` holds."""
    out = [start]
    while not stop(out[-1]):
        out.append(out[-1] + step)
    return out


def threshold(scores: list[float], n_zero: int, min_key: int, start: float = RELATION_RATIO, step: float = STEP) -> float:
    """Adaptive threshold: lowered from ``start`` to where a score lies above it (or to the first
    value not above zero), then raised while at least ``min_key`` scores lie above it and it does
    not exceed 1. ``n_zero`` more scores are zero. The rungs come from repeated addition, so they
    equal those of a loop in doubles for any start and step."""
    ordered = np.sort(np.append(np.asarray(scores, float), np.zeros(n_zero)))

    def above(rungs: list[float]) -> np.ndarray:
        return len(ordered) - np.searchsorted(ordered, rungs, "right")

    down = ladder(start, -step, lambda r: r <= 0)
    reached = np.flatnonzero(above(down) > 0)
    up = ladder(down[reached[0]] if len(reached) else down[-1], step, lambda r: r > 1)
    short = np.flatnonzero(above(up) < min_key)
    return up[short[0]] if len(short) else up[-1]


def cosines(q: list[dict], c: list[dict]) -> list[tuple[int, int, float]]:
    """Positive cosines ``(q_idx, c_idx, cos)`` of key sentences on raw word counts."""
    def counted(side):
        out = []
        for s in side:
            n: dict[str, int] = {}
            for w in s["words"]:
                n[w] = n.get(w, 0) + 1
            out.append((s["idx"], n, float(np.sqrt(float(sum(v * v for v in n.values()))))))
        return out

    found = []
    right = counted(c)
    for i, a, na in counted(q):
        for j, b, nb in right:
            dot = sum(v * b[w] for w, v in a.items() if w in b)
            if dot:
                found.append((i, j, dot / (na * nb)))
    return found


def components(edges: list[tuple[int, int]]) -> list[tuple[list[int], list[int]]]:
    """Connected components of a bipartite graph as (query indices, candidate indices), largest
    first, ties by smallest query index."""
    group: dict[tuple[int, int], set] = {}
    for q, c in edges:
        merged = group.get((0, q), {(0, q)}) | group.get((1, c), {(1, c)})
        for node in merged:
            group[node] = merged
    unique = {id(g): g for g in group.values()}.values()
    sides = [(sorted(i for s, i in g if s == 0), sorted(i for s, i in g if s == 1)) for g in unique]
    return sorted(sides, key=lambda x: (-len(x[0]) - len(x[1]), x[0][0]))


def explained(q: dict, c: dict, same: bool, start: float, step: float) -> dict:
    """Explanation of one pair from its two text rows (key sentences, targets, sentence count)."""
    full = [[s for s in side["keys"] if s["words"]] for side in (q, c)]
    found = cosines(*full)
    out = {"cosines": [dict(zip(("q_idx", "c_idx", "score"), f)) for f in found], "threshold": None, "min_key": None, "n_zero": None}
    if same:
        edges = [(i, i, None) for i in range(q["n"])] if full[0] else []
    else:
        out["n_zero"] = len(full[0]) * len(full[1]) - len(found)
        out["min_key"] = min(q["n_key"], c["n_key"])
        line = out["threshold"] = threshold([s for *_, s in found], out["n_zero"], out["min_key"], start, step)
        edges = [f for f in found if f[2] > line]
        if line < 0 and out["n_zero"]:
            seen = {f[:2] for f in found}
            edges += [(a["idx"], b["idx"], 0.0) for a in full[0] for b in full[1] if (a["idx"], b["idx"]) not in seen]
    out["matched"] = [dict(zip(("q_idx", "c_idx", "score"), e)) for e in edges]
    out["components"] = [{"q_idx": a, "c_idx": b} for a, b in components([e[:2] for e in edges])]
    return out


def pair_table(pairs: DataFrame, texts: DataFrame, relation_ratio: float = RELATION_RATIO, step: float = STEP) -> DataFrame:
    """``(pair_id, found)``: each pair joined with its two text rows and explained in place."""

    @arrow_udf(_FOUND)
    def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        from pyspark.sql.pandas.types import to_arrow_type

        kind = to_arrow_type(_FOUND)
        for q, c, same in batches:
            yield pa.array([explained(q[i].as_py(), c[i].as_py(), same[i].as_py(), relation_ratio, step) for i in range(len(q))], kind)

    keys = F.transform("r.keys", lambda i: F.struct(i.alias("idx"), F.get("sents", i)["words"].alias("words")))
    side = texts.select("tid", F.struct(keys.alias("keys"), F.col("r.n_key").alias("n_key"), F.size("sents").alias("n")).alias("t"))
    ids = pairs.select("pair_id", text_id("query_text").alias("q_tid"), text_id("cand_text").alias("c_tid"))
    joined = (ids.join(side.select(F.col("tid").alias("q_tid"), F.col("t").alias("q")), "q_tid")
              .join(side.select(F.col("tid").alias("c_tid"), F.col("t").alias("c")), "c_tid"))
    return joined.select("pair_id", run("q", "c", F.col("q_tid") == F.col("c_tid")).alias("found"))


# ---------------------------------------------------------------- tables


@dataclass
class Explanation:
    """Tables over ``pair_id``; each is an explode of the text or the pair table."""

    pairs: DataFrame
    texts: DataFrame
    found: DataFrame  # (pair_id, found): one row per pair

    def _sides(self) -> DataFrame:
        """(pair_id, side, sents, r); side 0 = query."""
        ids = self.pairs.select("pair_id", F.posexplode(F.array(text_id("query_text"), text_id("cand_text"))).alias("side", "tid"))
        return ids.join(self.texts, "tid").drop("tid")

    @property
    def sentences(self) -> DataFrame:
        """(pair_id, side, sent_idx, sentence)"""
        s = self._sides().select("pair_id", "side", F.posexplode("sents").alias("sent_idx", "s"))
        return s.select("pair_id", "side", "sent_idx", F.col("s.sentence").alias("sentence"))

    @property
    def weights(self) -> DataFrame:
        """(pair_id, side, sent_idx, weight)"""
        return self._sides().select("pair_id", "side", F.posexplode("r.weights").alias("sent_idx", "weight"))

    @property
    def keys(self) -> DataFrame:
        """(pair_id, side, sent_idx, sentence, words, weight, rank, n_key)"""
        k = self._sides().select("pair_id", "side", "sents", "r", F.posexplode("r.keys").alias("rank", "sent_idx"))
        s = F.get("sents", F.col("sent_idx"))
        return k.select("pair_id", "side", "sent_idx", s["sentence"].alias("sentence"), s["words"].alias("words"),
                        F.get("r.weights", F.col("sent_idx")).alias("weight"), (F.col("rank") + 1).alias("rank"), F.col("r.n_key").alias("n_key"))

    @property
    def joint_vocab(self) -> DataFrame:
        """(pair_id, term): words of the key sentences of both sides."""
        return self.keys.select("pair_id", F.explode("words").alias("term")).distinct()

    @property
    def cosines(self) -> DataFrame:
        """(pair_id, q_idx, c_idx, cos)"""
        e = self.found.select("pair_id", F.explode("found.cosines").alias("e"))
        return e.select("pair_id", "e.q_idx", "e.c_idx", F.col("e.score").alias("cos"))

    @property
    def threshold(self) -> DataFrame:
        """(pair_id, threshold, min_key, n_zero) of the pairs of different texts."""
        return self.found.select("pair_id", "found.threshold", "found.min_key", "found.n_zero").where("threshold is not null")

    @property
    def matched(self) -> DataFrame:
        """(pair_id, q_idx, c_idx, score); the score is null where the texts are identical."""
        return self.found.select("pair_id", F.explode("found.matched").alias("e")).select("pair_id", "e.q_idx", "e.c_idx", "e.score")

    @property
    def components(self) -> DataFrame:
        """(pair_id, comp_rank, q_idx, c_idx, color), largest component first."""
        c = self.found.select("pair_id", F.posexplode("found.components").alias("at", "c"))
        return c.select("pair_id", (F.col("at") + 1).alias("comp_rank"), "c.q_idx", "c.c_idx", F.pmod("at", F.lit(COLORS)).cast("int").alias("color"))

    @property
    def summary(self) -> DataFrame:
        """(pair_id, n_query_sents, n_cand_sents, n_matched, n_components) of pairs with a sentence."""
        n = self.texts.select("tid", F.size("sents").cast("long").alias("n"))
        ids = self.pairs.select("pair_id", text_id("query_text").alias("q"), text_id("cand_text").alias("c"))
        counted = (ids.join(n.select(F.col("tid").alias("q"), F.col("n").alias("n_query_sents")), "q")
                   .join(n.select(F.col("tid").alias("c"), F.col("n").alias("n_cand_sents")), "c").drop("q", "c"))
        sizes = self.found.select("pair_id", F.size("found.matched").cast("long").alias("n_matched"),
                                  F.size("found.components").cast("long").alias("n_components"))
        return counted.join(sizes, "pair_id").where("n_query_sents + n_cand_sents > 0")


def explain_pairs(pairs: DataFrame, stop_words=None, sentence_number: int = SENTENCE_NUMBER, sentence_min_len: int = SENTENCE_MIN_LEN,
                  iterations: int = ITERATIONS, relation_ratio: float = RELATION_RATIO, step: float = STEP,
                  analyzer: Callable[[Column], Column] = tokenize) -> Explanation:
    """End-to-end explanation for a table ``(pair_id, query_text, cand_text)``. The producers of
    the pairs and the ranked texts are cut off by reliable checkpoints, since several tables of
    the result read them."""
    ensure_checkpoint_dir(pairs.sparkSession)
    pairs = pairs.select("pair_id", "query_text", "cand_text").checkpoint(eager=True)
    texts = text_table(pairs, stop_words, analyzer, sentence_number=sentence_number, min_len=sentence_min_len, iterations=iterations)
    texts = texts.checkpoint(eager=True)
    return Explanation(pairs, texts, pair_table(pairs, texts, relation_ratio, step))


def explain_by_id(cases: DataFrame, asked: DataFrame, text_col: str = "basics_text", id_col: str = "doc_id", **tunables) -> Explanation:
    """Explanation for ``(pair_id, query_text, doc_id)``: the candidate text is looked up by id."""
    cand = cases.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("cand_text"))
    return explain_pairs(asked.select("pair_id", "query_text", "doc_id").join(cand, "doc_id"), **tunables)
