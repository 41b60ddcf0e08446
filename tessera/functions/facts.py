"""Fact-passage extraction: an ordered regex cascade, first match wins.

The cascade runs on newline-free text. Each arm is ``rlike`` + ``regexp_extract`` on
the JVM; ``coalesce`` over ``when`` arms stops at the first pattern that matches.
``(?d)`` (UNIX_LINES) makes Java's ``.`` exclude only ``\\n``, as Python's does.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col_, strip_newlines

# The fact-passage patterns and the group returned by each, in the order
# they are tried. They must equal the reference cascade for identical extraction.
FACT_PATTERNS: list[tuple[str, int]] = [
    ("(认定|查明|查证|确认|证实).?(本案|如下|以下|下列)?.?(法律|案件|主要|基本)?事实(如下)?.(.*)(本院|合议庭评议)(经审查)?(认为|依照)", 5),
    ("(认定|查明|查证|确认|证实).?(本案|如下|以下|下列)?.?(法律|案件|主要|基本)?事实(如下)?.(.*)(上述事实|如不服本判决)", 5),
    ("(审理|事实)(本院|作如下)?(查明|认定)(如下)?.(.*)(本院|合议庭评议)(经审查)?(认为|依照)", 5),
    ("(审理|事实)(本院|作如下)?(查明|认定)(如下)?.(.*)(上述事实|如不服本判决)", 5),
    ("本院(根据上述认证)?查明.(.*)(本院|合议庭评议)(经审查)?(认为|依照)", 2),
    ("本院(根据上述认证)?查明.(.*)(上述事实|如不服本判决)", 2),
    ("(事实和理由|具体事实|事实确认|案件事实)(如下)?.(.*)(本院|合议庭评议)(经审查)?(认为|依照)", 3),
    ("(事实和理由|具体事实|事实确认|案件事实)(如下)?.(.*)(上述事实|如不服本判决)", 3),
    ("(公诉机关|检察院)指控.(.*)(公诉机关|本院)(经审查)?(认为|依照)", 2),
    ("(公诉机关|检察院)指控.(.*)(上述事实|如不服本判决)", 2),
]


# For each default pattern, literals of which at least one must occur in any
# text the pattern matches (a cheap ``instr`` pre-check that skips the regex otherwise).
FACT_GUARDS: list[tuple[str, ...]] = [
    ("事实",), ("事实",), ("查明", "认定"), ("查明", "认定"), ("查明",),
    ("查明",), ("事实",), ("事实",), ("指控",), ("指控",),
]


def _guard(t: Column, literals) -> Column:
    cond = None
    for lit in literals:
        c = F.instr(t, lit) > 0
        cond = c if cond is None else (cond | c)
    return cond


def extract_facts(c, patterns: list[tuple[str, int]] | None = None) -> Column:
    """``struct<text: string, matched: int, pattern: int>`` for a text column.

    ``text`` is the designated group of the first matching pattern, else the
    newline-free input; ``matched`` is 1/0; ``pattern`` is the 1-based index or 0.
    Null input behaves like the empty string.
    """
    pats = patterns or FACT_PATTERNS
    guards = FACT_GUARDS if patterns is None else [None] * len(pats)
    t = strip_newlines(F.coalesce(col_(c), F.lit("")))
    arms = []
    for i, ((p, g), gd) in enumerate(zip(pats, guards), start=1):
        jp = "(?d)" + p
        hit = t.rlike(jp) if gd is None else (_guard(t, gd) & t.rlike(jp))
        arms.append(F.when(hit, F.struct(F.regexp_extract(t, jp, g).alias("text"),
                                                 F.lit(1).alias("matched"), F.lit(i).alias("pattern"))))
    miss = F.struct(t.alias("text"), F.lit(0).alias("matched"), F.lit(0).alias("pattern"))
    return F.coalesce(*arms, miss)


def truthy(c) -> Column:
    """Python truthiness of an optional string: not null and not empty."""
    x = col_(c)
    return x.isNotNull() & (x != "")
