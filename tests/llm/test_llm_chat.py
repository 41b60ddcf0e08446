"""Snapshot collapse against brute force."""

import random

from tessera.llm import chat


def brute(rows):
    convs = {}
    for c, t, r, x in rows:
        convs.setdefault(c, set()).add((t, r, x))
    def rank(v):
        return (v is not None, v if v is not None else 0)

    order = {c: tuple(sorted(s, key=lambda v: (rank(v[0]), v[1] is not None, v[1] or "", v[2] is not None, v[2] or ""))) for c, s in convs.items()}
    kept = {}
    for c, seq in order.items():
        if not any(len(o) > len(seq) and o[:len(seq)] == seq for o in order.values()):
            kept.setdefault(seq, []).append(c)
    return {(min((c for c in cs if c is not None), default=None), len(cs), len(seq)) for seq, cs in kept.items()}


def run(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, copies string" if rows and len(rows[0]) == 5 else
                               "conv_id long, turn long, role string, text string").repartition(3)
    return chat.collapse(df).collect()


def totals(got):
    out = {}
    for r in got:
        copies, n = out.get(r["conv_id"], (r["copies"], 0))
        out[r["conv_id"]] = (copies, n + r["n_turns"])
    return {(c, *v) for c, v in out.items()}


def test_snapshots_copies_and_branches(spark):
    rng, rows, n = random.Random(4), [], 0
    for _ in range(25):
        turns = [(i, "user" if i % 2 == 0 else "assistant", rng.choice(["hi", "same", "x y"])) for i in range(rng.randint(1, 9))]
        for _ in range(rng.randint(1, 4)):
            rows += [(n, *t) for t in turns[:rng.randint(1, len(turns))]]
            n += 1
    assert totals(run(spark, rows)) == brute(rows)


def test_nulls_repeats_and_extra_columns(spark):
    rows = [(1, 0, "user", "a", "e"), (1, 0, "user", "a", "e"), (2, 0, "user", "a", "e"), (2, 1, None, None, "e"), (3, 0, "user", "a", "e"),
            (3, 1, None, "", "e"), (None, 0, "user", "a", "e"), (None, 1, None, None, "e"), (4, None, "user", "<|x|>", None), (5, 1, "user", "a", "e"),
            (6, 2, "b", "q", "e"), (6, 2, "a", "q", "e")]
    got = run(spark, rows)
    assert totals(got) == brute([r[:4] for r in rows])
    text = {r["conv_id"]: r["rendered"] for r in got}
    assert text[2] == "<|user|>\na<|end|>\n<|unknown|>\n<|end|>\n" and text[4] == "<|user|>\n< |x|><|end|>\n"
    assert text[6] == "<|a|>\nq<|end|>\n<|b|>\nq<|end|>\n"


def test_long_conversations_are_segmented(spark, monkeypatch):
    monkeypatch.setattr(chat, "SEGMENT", 4)
    rows = [(1, i, "u", str(i)) for i in range(11)] + [(2, i, "u", str(i)) for i in range(9)] + [(3, i, "u", str(i + (i > 7))) for i in range(9)]
    got = run(spark, rows)
    assert sorted((r["conv_id"], r["segment"], r["n_turns"]) for r in got) == [(1, 0, 4), (1, 1, 4), (1, 2, 3), (3, 0, 4), (3, 1, 4), (3, 2, 1)]


def test_empty(spark):
    assert run(spark, []) == []
