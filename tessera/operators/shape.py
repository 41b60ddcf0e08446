"""Result shaping: highlight, preview, shaped hits, record detail, text export, paging.

Highlighting runs only on the rows of a returned page (bounded by the page size).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ..functions.labels import FIELD_LABELS
from ..functions.text import RUN_PATTERN, col_, highlight_runs, let, preview, split_sentences, tokenize, url_quote
from .prep import DATE_COLUMNS, MISSING
from .search import pseudo_facts

PAGE_SIZE = 20
CLIENT_PAGE_SIZE = 25


def best_fragment(text, terms: list[str]) -> Column:
    """Sentence with the most distinct query terms (earliest wins ties), or null."""
    qarr = F.array(*[F.lit(t) for t in dict.fromkeys(terms)])
    sents = split_sentences(text)
    scored = F.transform(sents, lambda s, i: F.struct(
        F.size(F.array_distinct(F.filter(tokenize(s), lambda x: F.array_contains(qarr, x)))).alias("n"),
        (-i).alias("neg_i"), s.alias("s")))
    best = F.array_max(scored)
    return F.when(best.isNotNull() & (best["n"] > 0), best["s"])


def highlight(text, terms: list[str], pre: str = "<strong>", post: str = "</strong>") -> Column:
    """One best fragment with matched tokens wrapped in tags; null when nothing matches."""
    qarr = F.array(*[F.lit(t) for t in dict.fromkeys(terms)])
    return let(best_fragment(text, terms), lambda frag: F.when(frag.isNotNull(), highlight_runs(frag, qarr, pre, post)))


def best_window(text, terms: list[str]) -> Column:
    """The shortest stretch of a text that holds every query term the text has, the first of equals:
    struct of its ``runs``, first and last run (``a``, ``b``) and the number ``n`` of terms; null without any.

    One sweep over the matching runs: the last place of every term is kept, and a window ends at
    each run once all are met, so the work is linear in the text however often terms occur."""
    terms = list(dict.fromkeys(terms))
    qarr = F.array(*[F.lit(t) for t in terms])
    nothing = F.array(*[F.lit(-1) for _ in terms])

    def swept(v: Column) -> Column:
        def step(s: Column, x: Column) -> Column:
            last = F.transform(s["last"], lambda p, j: F.when(j == x["t"], x["i"]).otherwise(p))
            return let(last, lambda held: let(F.filter(held, lambda p: p >= 0), lambda met: F.struct(
                held.alias("last"),
                F.when((F.size(met) == v["n"]) & (x["i"] - F.array_min(met) < s["b"] - s["a"]), F.array_min(met)).otherwise(s["a"]).alias("a"),
                F.when((F.size(met) == v["n"]) & (x["i"] - F.array_min(met) < s["b"] - s["a"]), x["i"]).otherwise(s["b"]).alias("b"))))

        start = F.struct(nothing.alias("last"), F.lit(0).alias("a"), F.lit((1 << 31) - 1).alias("b"))
        done = F.aggregate(v["m"], start, step)
        return let(done, lambda d: F.when(v["n"] > 0, F.struct(v["runs"].alias("runs"), d["a"].alias("a"), d["b"].alias("b"), v["n"].alias("n"))))

    def matched(runs: Column) -> Column:
        places = F.transform(runs, lambda r, i: F.struct(i.alias("i"), (F.array_position(qarr, F.lower(r)) - 1).cast("int").alias("t")))
        return let(F.filter(places, lambda x: x["t"] >= 0), lambda m: let(
            F.struct(runs.alias("runs"), m.alias("m"), F.size(F.array_distinct(F.transform(m, lambda x: x["t"]))).alias("n")), swept))

    return let(F.regexp_extract_all(F.coalesce(col_(text), F.lit("")), F.lit(RUN_PATTERN), 1), matched)


def highlight_window(text, terms: list[str], around: int = 12, pre: str = "<strong>", post: str = "</strong>") -> Column:
    """``best_window`` with ``around`` runs (words and what stands between them) on both sides, its
    matched words wrapped in tags; null when nothing matches."""
    qarr = F.array(*[F.lit(t) for t in dict.fromkeys(terms)])

    def written(w: Column) -> Column:
        first = F.greatest(w["a"] - around, F.lit(0))
        shown = F.slice(w["runs"], first + 1, w["b"] + around - first + 1)
        return F.array_join(F.transform(shown, lambda r: F.when(F.array_contains(qarr, F.lower(r)), F.concat(F.lit(pre), r, F.lit(post))).otherwise(r)), "")

    return let(best_window(text, terms), lambda w: F.when(w.isNotNull(), written(w))) if terms else F.lit(None).cast("string")


def search_page(scored: DataFrame, from_: int = 0, size: int = PAGE_SIZE) -> DataFrame:
    """``from`` / ``size`` paging over the deterministic ranking."""
    r = scored.withColumn("score", F.round("score", 6)).orderBy(F.desc("score"), F.asc("doc_id"))
    return r.offset(from_).limit(size) if from_ else r.limit(size)


def shape_hits(page: DataFrame, search_field: str, terms: list[str] | None, keyword_mode: bool = True) -> DataFrame:
    """Shaped hits: defaults for missing fields, preview of the searched field, highlight
    (keyword mode) overriding the preview, follow-up query text."""
    field = "content" if search_field == "全文" else "basics_text"
    shown = F.when(F.col(field).isNotNull(), preview(field)).otherwise(F.lit(MISSING))
    if field == "basics_text":
        shown = preview(F.coalesce(F.col("basics_text"), F.lit("")))
    content = shown
    if keyword_mode and terms:
        content = F.coalesce(highlight(F.col(field), terms), shown)
    return page.select(
        F.col("doc_id").cast("string").alias("_id"),
        F.coalesce("case_name", F.lit(MISSING)).alias("case_name"),
        content.alias("content"),
        F.coalesce("court_name", F.lit("")).alias("court_name"),
        F.coalesce(F.date_format("publish_date", "yyyy-MM-dd"), F.lit("")).alias("publish_date"),
        F.when(F.coalesce(F.col("case_id"), F.lit("")) != "", F.col("case_id")).otherwise(F.lit("")).alias("case_id"),
        pseudo_facts(page).alias("pseudo_basics_text"),
        "score",
    )


def page_window(total: Column, page: Column, size: int = CLIENT_PAGE_SIZE, width: int = 5) -> Column:
    """Page numbers shown around ``page``: the first ``width`` positive ones from
    ``min(page - 2, n_pages - 4)`` up to the last page."""
    n_pages = F.ceil(total / F.lit(size)).cast("int")
    start = F.greatest(F.least(page - 2, n_pages - (width - 1)), F.lit(1)).cast("int")
    numbers = F.slice(F.sequence(start, F.greatest(n_pages, start)), 1, width)
    return F.filter(numbers, lambda x: x <= n_pages)


def record_detail(df: DataFrame, fields=None) -> DataFrame:
    """Unpivot a record into ``(doc_id, field_pos, field, label, value)`` rows, non-empty
    fields only, in display order; multi-valued fields are joined with ``,``."""
    labels = [(f, lab) for f, lab in (fields or FIELD_LABELS) if f in df.columns]
    cols = []
    for pos, (f, lab) in enumerate(labels):
        dt = df.schema[f].dataType
        if isinstance(dt, ArrayType):
            v = F.array_join(F.col(f).cast("array<string>"), ",")
        elif f in DATE_COLUMNS:  # raw dates may be malformed
            v = F.date_format(F.try_to_date(F.col(f).cast("string")), "yyyy-MM-dd")
        else:
            v = F.col(f).cast("string")
        cols.append(F.struct(F.lit(pos).alias("field_pos"), F.lit(f).alias("field"), F.lit(lab).alias("label"), v.alias("value")))
    ex = df.select("doc_id", F.explode(F.array(*cols)).alias("r")).select("doc_id", "r.*")
    return ex.filter(F.col("value").isNotNull() & (F.col("value") != ""))


def export_text(df: DataFrame) -> DataFrame:
    """File name ``{case_id}.txt`` (percent-encoded) and body ``case_name\\ncontent``."""
    name = F.concat(F.coalesce(F.col("case_id"), F.lit("")), F.lit(".txt"))
    return df.select("doc_id", url_quote(name).alias("file_name"),
                     F.concat_ws("\n", F.coalesce("case_name", F.lit("")), F.coalesce("content", F.lit(""))).alias("body"))
