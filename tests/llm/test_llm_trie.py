"""Conversation prefix trie against brute force."""

import hashlib
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    turns = {}
    for c, turn, role, text in rows:
        if c is not None:
            turns.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(ts)] for c, ts in turns.items()}
    built = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        built[c] = tuple(turns.get(base, [])[:h] + own[h:])
    nodes = {}
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            nodes.setdefault(seq[:d], []).append(c)
    out = set()
    for seq, members in nodes.items():
        under = [s for s in nodes if s[:len(seq)] == seq]
        kids = [s for s in under if len(s) == len(seq) + 1]
        leaves = [s for s in under if not any(len(t) == len(s) + 1 and t[:len(s)] == s for t in under)]
        saved = sum((len(nodes[s]) - 1) * len(s[-1][1].encode()) for s in under if s)
        ends = ",".join(str(c) for c in sorted(members) if len(built[c]) == len(seq))
        out.add((min(members), len(seq), min(nodes[seq[:-1]]) if seq else None, len(members), len(kids), len(leaves), saved,
                 hashlib.sha256(ends.encode()).hexdigest()))
    return out


def run(spark, rows, **how):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("depth", F.lit("x")).withColumn("owner", F.lit(1)).repartition(3)
    got = [tuple(r) for r in trie.statistics(df, **how).collect()]
    assert len(got) == len(set(got))
    return set(got)


def conversations(seed, n=60, most=9, words=2):
    rng = random.Random(seed)
    return [(c, t, rng.choice(["user", "assistant"]) if t % 2 else None, rng.choice(["a", "", None, "é\n"][:words]))
            for c in range(n) for t in range(rng.randrange(most))]


def test_brute_force_whole_and_cut(spark):
    rows = conversations(1) + conversations(2, n=10, most=30)
    want = brute(rows)
    assert run(spark, rows) == want
    assert run(spark, rows, leaf=4) == want


def test_nulls_ties_repeats_and_negative_ids(spark):
    rows = [(None, 0, "user", "x"), (-7, 0, "user", "a"), (-5, 1, "user", "b"), (-5, None, None, None), (3, None, "user", "b"), (3, None, "user", "b"),
            (0, 2, "user", "y"), (0, 2, "user", "y"), (0, 2, "assistant", "z"), (1, 5, "user", "y"), (5, 1, "u" * 40 + "b", "t"), (5, 1, "u" * 40, "z" * 70),
            (5, 1, "u" * 40, "z" * 65), (6, 1, "r", "z" * 64), (6, 1, "r", "z" * 65), (6, 1, "r", "z" * 64)]
    assert run(spark, rows) == brute(rows)


def test_empty(spark):
    assert run(spark, []) == set()
    assert run(spark, [(None, 1, "user", "x")]) == set()


def test_hot_prefix_long_chain_and_small_segments(spark, monkeypatch):
    monkeypatch.setattr(trie, "SEGMENT", 4)
    monkeypatch.setattr(trie, "SALTS", 3)
    monkeypatch.setattr(trie, "CHUNK", 2)
    rows = [(5 * c, t, "user", "same") for c in range(40) for t in range(3)]  # equal conversations: one node's ends span chunks
    rows += [(5 * c, t, "user", f"{t}") for c in (100, 101) for t in range(50)] + [(600, None, "user", f"{t}") for t in range(25)]
    want = brute(rows)
    assert run(spark, rows, leaf=2) == want
    monkeypatch.setattr(trie, "FEW", 0)
    assert run(spark, rows, leaf=5) == want


def test_roll_up_shapes():
    rng = np.random.default_rng(3)
    for n, parent in [(1, [-1]), (300, list(range(-1, 299))), (300, [-1] + [0] * 299), (400, [-1, -1] + [int(rng.integers(0, i)) for i in range(2, 400)])]:
        parent = np.array(parent)
        values = rng.integers(-5, 9, (n, 2))
        sizes, want = np.ones(n, np.int64), values.copy()
        for i in range(n - 1, 0, -1):  # parents come first
            if parent[i] >= 0:
                sizes[parent[i]] += sizes[i]
                want[parent[i]] += want[i]
        assert (trie.roll_up(parent, sizes, values) == want).all()
