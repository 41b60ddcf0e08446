"""Personal data: base spans against Python's regular expressions, the method's own spans."""

import random
import time
import re

from pyspark.sql import functions as F

from tessera.llm import pii

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def brute(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            fine = {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m.group().split(".")),
                    "card": lambda: 13 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 9 <= len(digits) <= 15}[kind]()
            if fine:
                out.append((k, m.start(), m.end()))
    return out


FIXED = [None, "", "a@b", "a@b.c", "x@y.com_z@w.com..q@r.s.t", "😀 é@b.co 1.2.3.4.5.6.7.8", "256.1.1.1 000255.1.01.1", "4111111111111111", "4111 1111-1111 1111",
         "4111111111111111 4111111111111111", "4111111111111111  12", "+1 (017) 555-7713 rest", "+1 (377) 555-0271 4111111111111111", "+1+2 345 678 901-",
         "a" * 4000, "1" * 4000, "1-" * 3000, "a.b@" * 1500, "x@y.zz " * 700, "+1 " * 800]


def random_texts():
    rng = random.Random(2)
    bits = ["a", "b.c", "@", ".", "com", " ", " ", "-", "+", "1", "255", "300", "(", ")", "é", "😀", "4111111111111111", "5500 0000 0000 0004", "10.0.0.1", "\n", "_", "%"]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(1, 40))) for _ in range(500)]


def test_base_spans_match_python(spark):
    texts = FIXED + random_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("spans", F.lit(1))
    got = {r["doc_id"]: r["spans"] for r in pii.find(df).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        assert [(s["k"], s["start"], s["end"]) for s in got[i] if s["base"]] == brute(text), text
        loose = [s for s in got[i] if not s["base"]]
        assert all(not (s["start"] < b["end"] and b["start"] < s["end"]) for s in loose for b in got[i] if b["base"] and b["k"] == s["k"])


def test_method_adds_what_the_patterns_miss(spark):
    base = [f"word text card 4111111111111111 more words {i}" for i in range(40)] + [f"write to user{i}@mail.example.com today" for i in range(40)]
    base += [f"call +1 (017) 555-77{i:02d} now" for i in range(40)] + [f"plain text without data {i}" for i in range(100)]
    texts = base + ["two 4111111111111111 5500000000000004 cards", "ring +1 (377) 555-0271 4111111111111111 ok", "id 12345678901234567 end"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: {texts[r["doc_id"]][s["start"]:s["end"]] for s in r["spans"]} for r in pii.find(df).collect()}
    n = len(base)
    assert got[n] == {"4111111111111111", "5500000000000004"} and got[n + 1] >= {"4111111111111111"} and got[n + 2] == set()
    assert all(not got[i] for i in range(120, 220))


def test_redaction(spark):
    texts = ["mail a@b.com, card 4111111111111111.", "nothing", None, "é😀 1.2.3.4", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("found", pii.candidates(F.col("text")))
    model = pii.fit(df)
    got = [r[0] for r in df.orderBy("doc_id").select(pii.redacted(F.col("text"), pii.accepted(F.col("found"), model))).collect()]
    assert got == ["mail [EMAIL], card [CARD].", "nothing", None, "é😀 [IP]", ""]


def test_no_python_in_the_plan_and_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert pii.find(df).collect() == []
    plan = df.select(pii.candidates(F.col("text")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_redaction_of_random_spans(spark, monkeypatch):
    """Overlapping, nested, touching and far spans over small blocks and chunks, against a loop."""
    monkeypatch.setattr(pii, "BLOCK", 3)
    monkeypatch.setattr(pii, "CHUNK", 5)
    rng = random.Random(8)
    rows = []
    for i in range(120):
        text = "".join(rng.choice("aé字😀 \n") for _ in range(rng.randrange(60)))
        spans = [(k, a, min(len(text), a + rng.randrange(1, 9)), True) for k, a in ((rng.randrange(4), rng.randrange(max(1, len(text)))) for _ in range(rng.randrange(12))) if a < len(text)]
        rows.append((i, text, spans))
    df = spark.createDataFrame(rows, "i int, t string, s array<struct<k: int, start: int, end: int, base: boolean>>")
    for r in df.select("i", pii.redacted(F.col("t"), F.col("s")).alias("o")).collect():
        _, text, spans = rows[r["i"]]
        out, at = [], 0
        for k, a, b, _ in sorted(spans, key=lambda s: (s[1], -s[2], s[0])):
            if a >= at:
                out += [text[at:a], f"[{pii.KINDS[k].upper()}]"]
            at = max(at, b)
        assert r["o"] == (("".join(out) + text[at:]) if spans else text)


def test_loose_spans_that_meet_base_spans(spark, monkeypatch):
    rng = random.Random(9)
    rows = []
    for i in range(200):
        at, base = 0, []
        for _ in range(rng.randrange(20)):
            at += rng.randrange(4)
            base.append((at, at + rng.randrange(1, 5)))
            at = base[-1][1]
        a = rng.randrange(60)
        rows.append((i, base, (a, a + rng.randrange(1, 6))))
    df = spark.createDataFrame(rows, "i int, b array<struct<start: int, end: int>>, x struct<start: int, end: int>")
    monkeypatch.setattr(pii, "BLOCK", 0)
    for r in df.select("i", pii._meets(F.col("b"), F.col("x")).alias("m")).collect():
        _, base, (a, b) = rows[r["i"]]
        assert r["m"] == any(a < e and s < b for s, e in base)


def test_fifty_thousand_spans_in_one_text(spark):
    """Twice the spans take about twice the time."""
    took = []
    for n in (25_000, 50_000):
        text = " ".join(f"m{i}@x{i % 7}.com" + (" a (at) b.org" if i % 9 == 0 else "") for i in range(n))
        df = spark.createDataFrame([(1, text)], "doc_id long, text string").checkpoint()
        begin = time.time()
        found = df.select("text", pii.candidates(F.col("text")).alias("f")).checkpoint()
        spans = F.transform("f", lambda c: F.struct(c["k"].alias("k"), c["start"].alias("start"), c["end"].alias("end"), c["base"].alias("base")))
        out = found.select(F.size(F.filter("f", lambda c: c["base"])).alias("n"), pii.redacted(F.col("text"), spans).alias("o")).first()
        took.append(time.time() - begin)
        assert out["n"] == n and out["o"].count("[EMAIL]") == n + (n + 8) // 9 and "@" not in out["o"]
    assert took[1] < 3.2 * took[0] + 1, took
