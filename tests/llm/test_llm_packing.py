"""Packing against the tokenizers library and brute force."""

import itertools
import random
import sys
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import packing
from tests.conftest import SF01

PATH = public_tokenizers.path("byte_bpe_50k.json")
MODEL = open(PATH, encoding="utf-8").read()
SCHEMA = "doc_id long, text string"


def run(spark, rows, capacity=packing.CAPACITY):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("length", F.lit("x")).withColumn("n", F.lit(1)).withColumn("bucket", F.lit(2)).repartition(3)
    return [tuple(r) for r in packing.pack(df, MODEL, capacity).collect()]


def wanted(rows, capacity):
    """The pieces, from the library."""
    t, out = Tokenizer.from_file(PATH), []
    for doc, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        cut = [ids] if len(ids) <= capacity else [ids[:len(ids) % capacity]] * (len(ids) % capacity > 0) + [
            ids[i:i + capacity] for i in range(len(ids) % capacity, len(ids), capacity)]
        at = 0
        for i, p in enumerate(cut):
            out.append((doc, i, at, len(p), zlib.crc32(np.array(p, "<u4").tobytes())))
            at += len(p)
    return out


def check(got, rows, capacity, spare=1.02):
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    assert sorted((r[:5] for r in got), key=key) == sorted(wanted(rows, capacity), key=key)
    bins = {}
    for r in got:
        bins.setdefault(r[5], []).append((r[6], r[3]))
    for placed in bins.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= capacity
    least = -(-sum(r[3] for r in got) // capacity)
    assert len(bins) <= max(least + 1, spare * least), (len(bins), least)


def texts(seed, n, most=60):
    rng = random.Random(seed)
    words = ["the", "Treaty", "naïve", "日本", "don't", "1234", " ", "\n\n", "x" * 9, "<|", "\t", "é", "'s"]
    return [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(most)))) for i in range(n)]


def test_pieces_and_bins(spark):
    rows = texts(1, 400) + [(7, None), (7, ""), (None, "a b"), (None, None)] + [(9, "copy of one")] * 50
    check(run(spark, rows, 64), rows, 64)


def test_long_text_and_full_pieces(spark):
    rows = [(1, "word " * 5_000), (2, "a" * 300), (3, ("x" * 40 + "\n") * 900), (4, "b c " * 2_047)]
    check(run(spark, rows), rows, packing.CAPACITY)


def test_registered_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "text").collect()]
    check([tuple(r) for r in packing.pack(spark.read.parquet(f"{SF01}/documents.parquet"), MODEL).collect()], rows, packing.CAPACITY, 1.01)


def test_empty(spark):
    assert run(spark, []) == []


def test_reruns_agree_and_small_buckets(spark, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET", 3)
    rows = texts(2, 120, 12) + [(5, "same")] * 40
    got = run(spark, rows, 32)
    check(got, rows, 32, 1.05)
    assert sorted(got) == sorted(run(spark, rows[::-1], 32))


def test_stretches_encode_like_the_whole(monkeypatch):
    t = Tokenizer.from_file(PATH)
    of = packing.Encoder(MODEL)
    rng = random.Random(4)
    alphabet = ["a", "B", " ", " ", "\n", "é", "1", ".", "'s", "  ", "日", "\t", " ", "²", ", ", "<|endoftext|>", "\x1c", " ", "Ü", "don't", "\u0308", "\u00a0"]
    rows = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(200))) for _ in range(1_500)]
    rows += ["a b " * 300, "x" * 200 + " y", "", " ", "\n", " a", "\na\nb", "word " * 50]
    for remembered in (packing.REMEMBERED, 5):
        monkeypatch.setattr(packing, "REMEMBERED", remembered)
        for at in range(0, len(rows), 100):
            got = list(of.encode(rows[at:at + 100]))
            assert [np.frombuffer(g, "<u4").tolist() for g in got] == [t.encode(x, add_special_tokens=False).ids for x in rows[at:at + 100]]
    assert all(len(k) <= packing.SHORT for k in of.known)


def test_words_between_marks_are_asked_once():
    """The library gets a word once, whatever marks follow it and whatever stands between it and the next."""
    of, asked = packing.Encoder(MODEL), []
    ids = of.ids
    of.ids = lambda stretches: asked.extend(stretches) or ids(stretches)
    text = "Of alpha, alpha%%% alpha | beta alpha; alpha. beta!\nalpha - beta"
    want = Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids
    for _ in range(2):
        assert [np.frombuffer(g, "<u4").tolist() for g in of.encode([text])] == [want]
    assert sum(a.count(" alpha") for a in asked) == 1 and sum(a.count(" beta") for a in asked) == 1


def test_what_a_worker_remembers_stays_small():
    """Two workers share an executor with the JVM: what one keeps of ever new words is bounded well below its share."""
    of = packing.Encoder(MODEL)
    for at in range(0, 800_000, 40_000):
        for _ in of.encode([" ".join(f"w{i:x}" for i in range(at, at + 40_000))]):
            pass
    assert len(of.known) > 400_000
    assert sys.getsizeof(of.known) + sum(sys.getsizeof(k) + sys.getsizeof(v) for k, v in of.known.items()) < 120e6


def test_each_bin_is_the_fullest():
    rng = random.Random(6)
    for _ in range(60):
        capacity = rng.randrange(5, 40)
        left = {}
        for _ in range(rng.randrange(1, 14)):
            x = rng.randrange(1, capacity + 1)
            left[x] = left.get(x, 0) + 1
        for times, inside in packing.planned(dict(left), capacity):
            for _ in range(times):
                items = [x for x, n in left.items() for _ in range(n)]
                seed = max(items)
                items.remove(seed)
                best = max(sum(c) for k in range(len(items) + 1) for c in itertools.combinations(items, k) if sum(c) + seed <= capacity)
                assert sum(x * n for x, n in inside) == best + seed and dict(inside).get(seed)
                for x, n in inside:
                    left[x] -= n
                    assert left[x] >= 0
        assert not any(left.values())


def test_steps_do_not_grow_with_the_corpus():
    rng = np.random.default_rng(1)
    small = {int(x): int(n) for x, n in zip(*np.unique(rng.integers(1, 2049, 20_000), return_counts=True))}
    steps = len(packing.planned(small, 2_048))
    assert len(packing.planned({x: 1_000 * n for x, n in small.items()}, 2_048)) < 3 * steps
    assert steps < 2_048 * 8
