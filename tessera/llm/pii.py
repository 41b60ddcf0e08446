"""Personal data by weak supervision.

Base patterns find e-mail addresses, IP addresses, card and phone numbers; looser patterns
propose what these miss (a card number followed by other digits, two numbers side by side, an
address written with "(at)"). Six labelers vote on every candidate: base pattern, check (Luhn,
ranges, digit counts), gazetteer (top-level domains, issuers, country codes), context words to
the left, clean edges, shape. Expectation-maximisation over the counts of vote patterns estimates
how often each labeler fires on true and on false candidates; the posteriors train the final
span classifier, a table of log odds of span features, which decides on the loose candidates.
Base spans always stay.

DataFrame operations only. Offsets come from splitting a text at its matches and adding up
lengths, in blocks, so the work is linear in the text. The patterns are written with possessive
repeats and matches may only begin where a run begins, so a very long run of letters or digits
costs linear time and no stack. Vote patterns and span features are counted where the texts lie;
their tables have at most a few thousand rows whatever the corpus (``kinds * 2**6 * bins``), and
the fitted weights at most ``kinds * features * bins``.

Defined results: null and empty texts have no spans (the hash is that of the empty string);
offsets are code points, ends exclusive; repeated rows get equal results; an empty table or one
without candidates gives a classifier that accepts no loose candidate; extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

KINDS = ("email", "ip", "card", "phone")
_LOCAL = r"[A-Za-z0-9._%+-]"
#: The patterns of the contract, in a form that matches the same spans in linear time.
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++[ ]?(?:\(at\)|\[at\])[ ]?[A-Za-z0-9-]++(?:[ ]?(?:\.|\(dot\)|\[dot\])[ ]?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9.])[0-9]{1,3}+[.][0-9]{1,3}+[.][0-9]{1,3}+[.][0-9]{1,3}+(?![0-9])",
    "card": r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[\x20-][0-9]{4}){3}|[0-9]{4}[\x20-][0-9]{6}[\x20-][0-9]{5})(?![0-9])",
    "phone": r"(?<![0-9])(?:\+[0-9]{1,3}[\x20.-]?)?\(?[0-9]{2,4}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
}
#: What a text must hold before a pattern is tried on it.
HINT = {"email": ("@", r"(?:\(at\)|\[at\])"), "ip": (r"[0-9]\.[0-9]", r"[0-9]\.[0-9]"), "card": (r"[0-9](?:[\x20-]?[0-9]){12}",) * 2, "phone": (r"\+[0-9]", r"[0-9]{3}[\x20.-][0-9]{4}")}
#: Fixed lists of the gazetteer labeler.
DOMAINS = "com|org|net|edu|gov|info|io|de|fr|es|uk|it|nl|eu|ch|at|be|us|ca|au|jp|cn|in|br|ru|pl|se"
COUNTRY = "1|7|20|27|3[0-69]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"
CONTEXT = {"email": "mail|contact|write|kontakt|correo|courriel", "ip": r"\bip\b|host|server|addr|login", "card": "card|visa|master|credit|karte|carte|tarjeta|account",
           "phone": r"phone|call|tel|fax|mobile|cell|anruf|llam"}
LEFT, BLOCK, STEPS, CHUNK = 32, 256, 25, 1_024
LABELERS = ("base", "check", "gazetteer", "context", "edge", "shape")
#: Prior counts of a labeler firing on true and on false candidates.
PRIOR = (16.0, 4.0)
_SPAN = "array<struct<start:int,end:int,s:string,l:string,r:string>>"


def bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def matches(text: Column, pattern: str) -> Column:
    """Spans of all matches, leftmost and non-overlapping: offsets, matched text, up to ``LEFT``
    characters before and one after."""

    def block(part: Column, at: Column) -> Column:
        def step(s, x):
            begin = s["at"] + F.length(x["p"])
            end = begin + F.length(x["m"])
            return F.struct(end.alias("at"), F.concat(s["out"], F.array(F.struct(
                begin.alias("start"), end.alias("end"), x["m"].alias("s"), F.right(x["p"], F.lit(LEFT)).alias("l"), F.left(x["q"], F.lit(1)).alias("r")))).alias("out"))

        return F.aggregate(part, F.struct(at.alias("at"), F.array().cast(_SPAN).alias("out")), step)

    def add(z: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(z) - 1) / BLOCK).cast("int")), lambda i: F.slice(z, i * BLOCK + 1, BLOCK))
        start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPAN}>").alias("out"))

        def step(s, part):
            return bound(block(part, s["at"]), lambda b: F.struct(b["at"].alias("at"), F.concat(s["out"], F.array(b["out"])).alias("out")))

        return F.flatten(F.aggregate(parts, start, step)["out"])

    def zipped(v: Column) -> Column:
        n = F.size(v["m"])
        rows = F.arrays_zip(F.slice(v["p"], 1, n).alias("p"), v["m"].alias("m"), F.slice(v["p"], 2, n).alias("q"))
        return F.when(n > 0, bound(rows, add)).otherwise(F.array().cast(_SPAN))

    return bound(F.struct(F.split(text, pattern, -1).alias("p"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m")), zipped)


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def total(d: Column) -> Column:
        n = F.size(d)

        def part(x, i):
            v = x.cast("int")
            twice = v * 2 - F.when(v > 4, 9).otherwise(0)
            return F.when((n - i) % 2 == 0, twice).otherwise(v)

        return F.aggregate(F.transform(d, part), F.lit(0), lambda a, b: a + b)

    return bound(F.split(digits, ""), lambda d: total(F.filter(d, lambda x: x != ""))) % 10 == 0


def valid(kind: str, s: Column) -> Column:
    """The contract's check on a match of the base pattern."""
    if kind == "ip":
        return s.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])(?:\.|$)){4}$")
    if kind == "card":
        return bound(_digits(s), lambda d: F.length(d).between(13, 19) & luhn(d))
    if kind == "phone":
        return F.length(_digits(s)).between(9, 15)
    return F.lit(True)


def _votes(kind: str, x: Column, base: bool) -> list[Column]:
    d, s = _digits(x["s"]), x["s"]
    check = {"email": s.rlike(r"(?:\.|\(dot\)|\[dot\])[ ]?[A-Za-z]{2,}$"), "ip": valid("ip", s) & ~s.rlike(r"(?:^|\.)0[0-9]"),
             "card": valid("card", s), "phone": F.length(d).between(9, 15)}[kind]
    known = {"email": F.lower(s).rlike(rf"(?:\.|\(dot\)|\[dot\])[ ]?(?:{DOMAINS})$"), "ip": s.rlike(r"^(?:[1-9]|[1-9][0-9]|1[0-9][0-9]|2[01][0-9]|22[0-3])\."),
             "card": d.rlike("^(?:4|5[1-5]|2[2-7]|3[47]|6)"), "phone": s.rlike(rf"^\+(?:{COUNTRY})")}[kind]
    shape = {"email": s.rlike(r"^.{3,64}[@(\[ ]"), "ip": F.length(s) <= 15, "card": F.length(d).isin(13, 15, 16, 19),
             "phone": s.rlike(r"[)\x20.-][0-9]+[\x20.-][0-9]+$")}[kind]
    edge = ~x["l"].rlike(r"[\p{L}0-9\"'=/_-]$") & ~x["r"].rlike(r"^[\p{L}0-9\"'=/_@-]")
    return [F.lit(base), check, known, F.lower(x["l"]).rlike(CONTEXT[kind]), edge, shape]


def _side(c: Column) -> Column:
    """Class of a neighbouring character."""
    return (F.when(c == "", "none").when(c.rlike(r"\s"), "space").when(c.rlike("[0-9]"), "digit").when(c.rlike(r"\p{L}"), "letter").otherwise("mark"))


def _meets(base: Column, x: Column) -> Column:
    """Whether a span meets one of ``base``, which are sorted and apart: the first that ends behind
    its start, by halving, begins before its end."""
    some = F.exists(base, lambda b: (x["start"] < b["end"]) & (b["start"] < x["end"]))

    def half(s, _):
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        behind = F.get(base, mid)["end"] > x["start"]
        done = s["lo"] >= s["hi"]
        return F.struct(F.when(done | behind, s["lo"]).otherwise(mid + 1).alias("lo"), F.when(~done & behind, mid).otherwise(s["hi"]).alias("hi"))

    first = F.aggregate(F.sequence(F.lit(0), F.ceil(F.log2(F.size(base) + 1)).cast("int")), F.struct(F.lit(0).alias("lo"), F.size(base).alias("hi")), half)["lo"]
    return F.when(F.size(base) <= BLOCK, some).otherwise(F.coalesce(F.get(base, first)["start"] < x["end"], F.lit(False)))


def candidates(text: Column) -> Column:
    """All candidates of a text: kind, start, end, base, the labelers' votes and the classifier's
    features. Loose candidates do not overlap a base span of their kind."""
    text = F.coalesce(text, F.lit(""))
    none = F.array().cast(_SPAN)

    def of_kind(number: int, kind: str) -> Column:
        hint, loose_hint = HINT[kind]
        base = F.when(text.rlike(hint), F.filter(matches(text, BASE[kind]), lambda x: valid(kind, x["s"]))).otherwise(none)
        loose = F.when(text.rlike(loose_hint), matches(text, LOOSE[kind])).otherwise(none)

        def described(x, is_base):
            votes = F.transform(F.array(*_votes(kind, x, is_base)), lambda v: F.coalesce(v, F.lit(False)).cast("double"))
            features = F.array(F.least(F.floor(F.length(x["s"]) / 3), F.lit(12)).cast("string"), _side(F.right(x["l"], F.lit(1))), _side(x["r"]))
            return F.struct(F.lit(number).alias("k"), x["start"].alias("start"), x["end"].alias("end"), F.lit(is_base).alias("base"),
                            votes.alias("votes"), features.alias("features"))

        def both(v):
            free = F.filter(v["loose"], lambda x: ~_meets(v["base"], x))
            return F.concat(F.transform(v["base"], lambda x: described(x, True)), F.transform(free, lambda x: described(x, False)))

        return bound(F.struct(base.alias("base"), loose.alias("loose")), both)

    return F.concat(*[of_kind(i, kind) for i, kind in enumerate(KINDS)])


def _em(patterns: Column) -> Column:
    """Posterior of every vote pattern of one kind: array of (votes, g). ``patterns`` holds
    (votes, n). Starts from the share of votes, then ``STEPS`` rounds."""
    several = range(len(LABELERS))
    add = lambda values: F.aggregate(values, F.lit(0.0), lambda a, b: a + b)

    def fitted(weighted: Column) -> Column:
        """M step: prior and the labelers' rates on true and on false candidates."""
        true, false = add(F.transform(weighted, lambda p: p["n"] * p["g"])), add(F.transform(weighted, lambda p: p["n"] * (1 - p["g"])))

        def fires(i: int, share) -> Column:
            return add(F.transform(weighted, lambda p: p["n"] * share(p["g"]) * p["votes"][i]))

        on = F.array(*[(fires(i, lambda g: g) + PRIOR[0]) / (true + sum(PRIOR)) for i in several])
        off = F.array(*[(fires(i, lambda g: 1 - g) + PRIOR[1]) / (false + sum(PRIOR)) for i in several])
        return F.struct(((true + 1) / (true + false + 2)).alias("prior"), on.alias("on"), off.alias("off"))

    def posterior(p: Column, m: Column) -> Column:
        """E step for one pattern."""
        odds = reduce(lambda a, b: a + b, [F.when(p["votes"][i] > 0, F.log(m["on"][i] / m["off"][i])).otherwise(
            F.log((1 - m["on"][i]) / (1 - m["off"][i]))) for i in several], F.log(m["prior"] / (1 - m["prior"])))
        return F.struct(p["votes"].alias("votes"), p["n"].alias("n"), (1 / (1 + F.exp(-odds))).alias("g"))

    first = F.transform(patterns, lambda p: F.struct(p["votes"].alias("votes"), p["n"].alias("n"), (0.05 + 0.9 * add(p["votes"]) / len(LABELERS)).alias("g")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), first,
                       lambda weighted, _: bound(fitted(weighted), lambda m: F.transform(weighted, lambda p: posterior(p, m))))


def fit(found: DataFrame, column: str = "found") -> dict[str, float]:
    """Weights of the final classifier from a table of candidates (as ``candidates`` gives them)."""
    each = found.select(F.explode(column).alias("c")).groupBy("c.k", "c.votes", "c.features").agg(F.count("*").cast("double").alias("n"))
    each = cut(each)
    per_kind = each.groupBy("k", "votes").agg(F.sum("n").alias("n")).groupBy("k").agg(F.array_sort(F.collect_list(F.struct("votes", "n"))).alias("p"))
    judged = per_kind.select("k", F.explode(_em(F.col("p"))).alias("p")).select("k", F.col("p.votes").alias("votes"), F.col("p.g").alias("g"))
    rows = each.join(judged, ["k", "votes"]).select("k", "n", "g", F.posexplode(_named(F.col("votes"), F.col("features"))).alias("j", "value"))
    odds = rows.groupBy("k", "j", "value").agg(F.sum(F.col("n") * F.col("g")).alias("t"), F.sum(F.col("n") * (1 - F.col("g"))).alias("f"))
    weight = F.log((F.col("t") + 0.5) / (F.col("f") + 0.5))
    got = odds.select(F.concat_ws(" ", "k", "value").alias("key"), weight.alias("w"), "k", "j", "t", "f").orderBy("key").collect()
    model = {}
    for kind in range(len(KINDS)):
        whole = [r for r in got if r["k"] == kind and r["j"] == 0]
        prior = _log_odds(sum(r["t"] for r in whole), sum(r["f"] for r in whole))
        model[f"{kind} prior"] = prior if whole else -99.0
        model.update({r["key"]: r["w"] - prior for r in got if r["k"] == kind})
    return model


def _log_odds(t: float, f: float) -> float:
    import math

    return math.log((t + 0.5) / (f + 0.5))


def _named(votes: Column, features: Column) -> Column:
    """Names of a span's feature values: the votes but for the base pattern's, then length and
    neighbouring characters."""
    named = F.transform(F.slice(votes, 2, len(LABELERS) - 1), lambda v, i: F.concat(F.lit("v"), i.cast("string"), F.lit("="), v.cast("int").cast("string")))
    return F.concat(named, F.transform(features, lambda v, i: F.concat(F.lit("f"), i.cast("string"), F.lit("="), v)))


def accepted(found: Column, model: dict[str, float]) -> Column:
    """Spans (k, start, end, base) that stay, in order of kind and start: all base spans and the
    loose ones whose log odds are positive."""
    weights = F.create_map(*[F.lit(x) for item in sorted(model.items()) for x in (item[0], float(item[1]))])
    of = lambda key: F.coalesce(F.try_element_at(weights, key), F.lit(0.0))

    def odds(c):
        k = F.concat(c["k"].cast("string"), F.lit(" "))
        return F.aggregate(_named(c["votes"], c["features"]), of(F.concat(k, F.lit("prior"))), lambda a, v: a + of(F.concat(k, v)))

    kept = F.filter(found, lambda c: c["base"] | (odds(c) > 0))
    return F.array_sort(F.transform(kept, lambda c: F.struct(c["k"].alias("k"), c["start"].alias("start"), c["end"].alias("end"), c["base"].alias("base"))))


def written(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["k"] + 1), s["start"].cast("string"), s["end"].cast("string"))))


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets; a span that begins inside an
    earlier one is covered by it. Spans go in blocks of ``BLOCK``, and a block reads the chunks of
    ``CHUNK`` characters it lies in, so the work grows with the text and not with text times spans."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("to"), s["k"].alias("k"))))
    gap = "array<struct<a: int, b: int, k: int>>"

    def step(state, s):
        free = F.array(F.struct(state["at"].alias("a"), s["start"].alias("b"), s["k"].alias("k")))
        return F.struct(F.greatest(state["at"], -s["to"]).alias("at"), F.when(s["start"] >= state["at"], F.concat(state["out"], free)).otherwise(state["out"]).alias("out"))

    def blocks(z):
        """Gaps between uncovered spans, with the kind that follows, and where the last span ends."""
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(z) - 1) / BLOCK).cast("int")), lambda i: F.slice(z, i * BLOCK + 1, BLOCK))
        inner = lambda part, at: F.aggregate(part, F.struct(at.alias("at"), F.array().cast(gap).alias("out")), step)
        return F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{gap}>").alias("out")),
                           lambda s, part: bound(inner(part, s["at"]), lambda v: F.struct(v["at"].alias("at"), F.concat(s["out"], F.array(v["out"])).alias("out"))))

    def between(chunks, a, b, use):
        """``use`` of the chunks from character ``a`` to ``b`` and of the place they begin at."""
        first = F.floor(a / CHUNK).cast("int")
        return bound(F.struct(F.array_join(F.slice(chunks, first + 1, F.floor(b / CHUNK).cast("int") - first + 1), "").alias("s"), (first * CHUNK).alias("at")), use)

    def written_block(chunks, g):
        piece = lambda c: lambda x: F.concat(F.substring(c["s"], x["a"] - c["at"] + 1, x["b"] - x["a"]), F.element_at(names, x["k"] + 1))
        return F.when(F.size(g) > 0, between(chunks, F.element_at(g, 1)["a"], F.element_at(g, -1)["b"], lambda c: F.array_join(F.transform(g, piece(c)), ""))).otherwise("")

    def whole(v):
        body = F.array_join(F.transform(v["g"]["out"], lambda g: written_block(v["c"], g)), "")
        first = F.floor(v["g"]["at"] / CHUNK).cast("int")
        rest = F.array_join(F.slice(v["c"], first + 1, F.size(v["c"]) + 1), "")
        return F.concat(body, bound(rest, lambda r: F.substring(r, v["g"]["at"] - first * CHUNK + 1, F.length(r))))

    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
    return F.when(F.size(spans) > 0, bound(F.struct(bound(ordered, blocks).alias("g"), chunks.alias("c")), whole)).otherwise(text)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per text: doc_id and spans (k, start, end, base), fitted on these texts."""
    found = cut(docs.select(F.col(id_col).alias("doc_id"), candidates(F.col(text_col)).alias("found")))
    return found.select("doc_id", accepted(F.col("found"), fit(found)).alias("spans"))
