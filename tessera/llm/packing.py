"""Best-fit packing of documents into sequences of tokens by minimum bin slack.

Texts become token ids where they lie; longer documents are cut into pieces of ``capacity``
tokens, of which the first may be shorter. The bins are filled one after another: the longest
remaining piece opens a bin, a bitset subset-sum over the available lengths (bit s: a sum of s can
be made) finds the fullest combination that still fits, and the combination is removed.

What the method looks at is how many pieces of each length remain: ``capacity`` numbers, whatever
the size of the corpus. So the bins are planned on that histogram, and a combination is taken at once as often as the
counts allow: without its pieces the remaining sums only shrink, so it stays the fullest. Each step
uses up a length at some multiplicity, which bounds the steps by ``capacity * ln(capacity)``. The
pieces then find their places in the plan: pieces of a length are numbered over the cluster (equal
rows are counted, hash buckets of about ``BUCKET`` rows carry prefix sums) and a number is looked up
among its length's steps. No task sees more than a bucket or a batch.

Defined results: a null text is empty and gives the end id alone; repeated rows are packed each;
null ids are ids like any other; ties are broken by the pieces' checksums, ids and places, so
reruns agree; extra columns are ignored; an empty table gives no pieces. Texts of any length are encoded in
short stretches and by slices of about a megabyte of whole texts.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import compress, islice
from operator import not_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbatch as tb
from .common import bounded_batches, bucketed_prefix, stored

CAPACITY, BUCKET = 2_048, 1_024
#: Stretches given to the tokenizer at a time, remembered at most (by each worker, some 100 MB), and characters of one that is remembered.
BATCH, REMEMBERED, SHORT = 1 << 14, 1 << 19, 64
_PIECE = (("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()))
_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
_SOLID = f"!-~{_LETTER[6:]}"  # no white space: ASCII's marks, digits and letters, and Latin letters
_LINE, _SPACE = (re.compile(rf"{x}(?<=[{_SOLID}]{x})(?=[{_SOLID}])") for x in ("\n", " "))
#: A word that a space stands before; a line after a line feed, with that; letters with marks behind.
_WORD = re.compile(rf"[^ ]*[{_SOLID}]\Z").match
_AFTER = re.compile(rf"\n[^\n]*[{_SOLID}]\Z").match
_MARKED = re.compile(rf"([^\n]*[{_LETTER}])([!#$%&*,.:;?]+)\Z").match
_loaded: dict[str, object] = {}


# ---------------------------------------------------------------------------------------
# tokens


class Encoder:
    """Ids by the tokenizers library, asked once for every distinct stretch of text.

    Texts are cut before a single space or line feed between two characters that are no white space: there
    the tokenizer's pattern always starts anew, whatever stands around. ``known`` holds the ids of
    stretches up to ``SHORT`` characters: what follows the space, or the line feed and what follows it."""

    def __init__(self, model: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(model)
        self.known: dict[str, bytes] = {}
        self.feed = np.array(self.tokenizer.encode("\n", add_special_tokens=False).ids, "<u4").tobytes()
        self.marks: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.spaced = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.spaced[[i for piece, i in vocabulary.items() if piece[0] == "\u0120"]] = True  # a space in the byte alphabet

    def ids(self, stretches: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(stretches, add_special_tokens=False)]

    def learn(self, stretches: set[str]) -> None:
        """Marks behind a letter are tokens of their own. Words are encoded many at a time, as a word holds one
        space, its first character; lines that end in a word or mark with a line feed between them, which is
        a token of its own there."""
        known, marked = self.known, {c: (m[1], m[2]) for c in stretches if (m := _MARKED(c))}
        tails = list({tail for _, tail in marked.values() if tail not in self.marks})
        marks = self.marks | dict(zip(tails, self.ids(tails)))
        self.marks.update(islice(((tail, marks[tail]) for tail in tails if len(tail) <= SHORT), max(0, BATCH - len(self.marks))))
        bare = stretches.difference(marked).union([c for c, _ in marked.values()]).difference(known)
        words = [c for c in bare if c[0] != "\n" and _WORD(c)]
        rough = [c for c in bare if c[0] != "\n" and not _WORD(c)]
        for at in range(0, len(words), BATCH):
            some = words[at:at + BATCH]
            data = self.ids([" " + " ".join(some)])[0]
            begin = (4 * np.flatnonzero(self.spaced[np.frombuffer(data, "<u4")])).tolist()
            if len(begin) == len(some):
                known.update(zip(some, map(data.__getitem__, map(slice, begin, [*begin[1:], len(data)]))))
            else:
                rough += some
        known.update(zip(rough, self.ids([" " + c for c in rough])))
        lines = [c for c in bare if c[0] == "\n"]
        rough, lines = [c for c in lines if not _AFTER(c)], [c for c in lines if _AFTER(c)]
        known.update(zip(rough, self.ids(rough)))
        for at in range(0, len(lines), BATCH):
            some = lines[at:at + BATCH]
            data = self.ids(["".join(some)[1:] + "\n"])[0]
            begin = 0
            for c, end in zip(some, (4 * np.flatnonzero(np.frombuffer(data, "<u4") == np.frombuffer(self.feed, "<u4"))).tolist()):
                known[c] = self.feed + data[begin:end]
                begin = end + 4
        for c, (letters, tail) in marked.items():
            known[c] = known[letters] + marks[tail]

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Token ids of each text as little-endian 32-bit integers, without special tokens of its own."""
        known, heads, flat, ends = self.known, [], [], [0]
        for text in texts:
            line, *lines = _LINE.split(text)
            head, *cut = _SPACE.split(line)
            heads.append(head)
            flat += cut
            for line in lines:
                first, *cut = _SPACE.split(line)
                flat.append("\n" + first)
                flat += cut
            ends.append(len(flat))
        found, before = list(map(known.get, flat)), len(known)
        missed = list(compress(range(len(flat)), map(not_, found)))
        self.learn({flat[i] for i in missed})
        for i in missed:
            found[i] = known[flat[i]]
        for head, a, b in zip(self.ids(heads), ends, ends[1:]):
            yield head + b"".join(found[a:b])
        # The stretches met first, so the frequent ones, stay.
        fresh = list(islice(known, before, None))
        for c in fresh if len(known) > REMEMBERED else [c for c in fresh if len(c) > SHORT]:
            del known[c]


def encoder(model: str) -> Encoder:
    """The encoder of a JSON model, kept by the worker."""
    if model not in _loaded:
        _loaded.clear()
        _loaded[model] = Encoder(model)
    return _loaded[model]


def pieces(docs: DataFrame, model: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): the documents' pieces of at most ``capacity`` ids."""
    bounded_batches()
    shared = docs.sparkSession.sparkContext.broadcast(model)
    end = np.array([end_id], "<u4").tobytes()

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        for batch in batches:
            rows = []
            ids_of = (ids for part in tb.slices(batch.column("text")) for ids in encoder(shared.value).encode([t or "" for t in part.to_pylist()]))
            for ids, doc in zip(ids_of, batch.column("doc_id").to_pylist()):
                ids += end
                n = len(ids) // 4
                edges = [0, *range(n % capacity or capacity, n, capacity), n]
                for i, (a, b) in enumerate(zip(edges, edges[1:])):
                    rows.append((doc, i, a, b - a, zlib.crc32(ids[4 * a:4 * b])))
            yield pa.RecordBatch.from_pydict({name: pa.array([r[i] for r in rows], kind) for i, (name, kind) in enumerate(_PIECE)})

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(cut_up, "doc_id long, piece int, start long, length long, ids_crc32 long")


# ---------------------------------------------------------------------------------------
# plan


def fullest(counts: dict[int, int], order: list[int], room: int) -> list[tuple[int, int]]:
    """[(length, times)] of the fullest combination of available lengths in ``room``; ``order`` lists
    the lengths from the longest, which are preferred among equals."""
    reach, mask, made = 1, (1 << (room + 1)) - 1, []
    for length in order:
        if length > room:
            continue
        left, step = min(counts[length], room // length), 1
        while left > 0:
            step = min(step, left)
            more = (reach | reach << (step * length)) & mask
            if more != reach:
                made.append((length, step, reach))
                reach = more
            left -= step
            step *= 2
        if reach >> room:
            break
    target, chosen = reach.bit_length() - 1, {}
    for length, step, before in reversed(made):
        if not before >> target & 1:
            chosen[length] = chosen.get(length, 0) + step
            target -= step * length
    return sorted(chosen.items(), reverse=True)


def planned(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """[(bins, [(length, pieces a bin)])]: minimum bin slack, equal bins counted."""
    counts = {length: n for length, n in histogram.items() if n > 0}
    order, out = sorted(counts, reverse=True), []
    while order:
        seed = order[0]
        counts[seed] -= 1
        inside = dict(fullest(counts, [x for x in order if counts[x]], capacity - seed))
        counts[seed] += 1
        inside[seed] = inside.get(seed, 0) + 1
        times = min(counts[x] // n for x, n in inside.items())
        for x, n in inside.items():
            counts[x] -= n * times
        out.append((times, sorted(inside.items(), reverse=True)))
        if any(not counts[x] for x in inside):
            order = [x for x in order if counts[x]]
    return out


@dataclass
class Places:
    """Where the n-th piece of a length goes: ``at`` holds length << 48 | first number of a step."""

    at: np.ndarray
    sequence: np.ndarray
    times: np.ndarray
    offset: np.ndarray

    def find(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = (length << 48) | number
        i = np.searchsorted(self.at, key, "right") - 1
        nth = key - self.at[i]
        return self.sequence[i] + nth // self.times[i], self.offset[i] + nth % self.times[i] * length


def places(plan: list[tuple[int, list[tuple[int, int]]]]) -> Places:
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for bins, inside in plan:
        offset = 0
        for length, n in inside:
            rows.append((length << 48 | used.get(length, 0), sequence, n, offset))
            used[length] = used.get(length, 0) + n * bins
            offset += n * length
        sequence += bins
    return Places(*np.array(sorted(rows), np.int64).reshape(-1, 4).T.copy())


# ---------------------------------------------------------------------------------------
# packing


def pack(docs: DataFrame, model: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): every document's pieces and
    their places in sequences of at most ``capacity`` tokens. ``model`` is the tokenizer's JSON."""
    spark = docs.sparkSession
    names = [name for name, _ in _PIECE]
    cut = stored(pieces(docs, model, capacity, end_id).groupBy(*names).agg(F.count("*").alias("n")))
    # At most ``capacity`` rows, whatever the input.
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    shared = spark.sparkContext.broadcast(places(planned(counts, capacity)))
    buckets = spark.createDataFrame([(x, -(-n // BUCKET)) for x, n in counts.items()] or [(0, 1)], "length long, buckets long")
    dealt = cut.join(F.broadcast(buckets), "length").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("buckets")))
    order = [F.col(c) for c in ("ids_crc32", "doc_id", "piece", "start")]
    numbered = bucketed_prefix(dealt.select(*names, "n", "bucket"), ["length"], "bucket", order, ["n"])
    single = numbered.select(*names, F.explode(F.sequence("n_before", F.col("n_before") + F.col("n") - 1)).alias("number"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = shared.value.find(batch.column("length").to_numpy(), batch.column("number").to_numpy())
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    return single.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
