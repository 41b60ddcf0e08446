"""Shortest window that holds a query's terms, against brute force."""

import random
import re

from pyspark.sql import functions as F

from tessera.functions.text import RUN_PATTERN
from tessera.operators import shape as sh


def brute(text, terms):
    runs = re.findall(RUN_PATTERN, text or "")
    places = [(i, r.lower()) for i, r in enumerate(runs) if r.lower() in terms]
    want = {t for _, t in places}
    if not want:
        return None
    best = min((b - a, a, b) for a, _ in places for b, _ in places if a <= b and {t for i, t in places if a <= i <= b} == want)
    return best[1], best[2], len(want)


def test_windows(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["Lyon", "x", "treaty", "the", "y,", "of.", "借"]) for _ in range(rng.randrange(30)))) for i in range(150)] + [(900, None), (901, "")]
    df = spark.createDataFrame(rows, "i int, t string")
    for terms in (["lyon"], ["lyon", "treaty", "of"], ["借", "absent", "the", "the"]):
        got = {r["i"]: r["w"] for r in df.select("i", sh.best_window("t", terms).alias("w")).collect()}
        for i, t in rows:
            w = got[i]
            assert (None if w is None else (w["a"], w["b"], w["n"])) == brute(t, set(terms))


def test_fragment(spark):
    df = spark.createDataFrame([(1, "a b c Lyon d treaty e f g h treaty i Lyon treaty j"), (2, "none"), (3, None)], "i int, t string")
    got = {r["i"]: r["h"] for r in df.select("i", sh.highlight_window("t", ["lyon", "treaty"], 2).alias("h")).collect()}
    assert got == {1: "i <strong>Lyon</strong> <strong>treaty</strong> j", 2: None, 3: None}
    assert df.select(sh.highlight_window("t", []).alias("h")).where(F.col("h").isNotNull()).count() == 0
