"""Text column expressions: analyzer, sentence splitter, newline strip, highlight runs.

Everything here returns a ``Column`` evaluated inside the JVM (whole-stage codegen
where Spark supports it); nothing here runs Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values (analyzer and splitter definitions; shared with the DuckDB oracle).
# Default analyzer: lower-case, then runs of Latin letters/digits form one token and
# every Han character is its own token.
TOKEN_PATTERN = "([a-z0-9à-öø-ÿ]+|[一-鿿])"
# Highlight tokenisation keeps the text lossless: word runs, single Han characters,
# and the separator runs between them.
RUN_PATTERN = "([0-9A-Za-zÀ-ÖØ-öø-ÿ]+|[一-鿿]|[^0-9A-Za-zÀ-ÖØ-öø-ÿ一-鿿]+)"
# Sentence delimiters of the sentence splitter; '.' is added for Latin text.
SENTENCE_DELIMITERS = "[?!;？！。；…\n.]"


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body`` as a lambda variable.

    A lambda that mentions an outer expression re-evaluates it on every element; binding
    it through a one-element array makes it a plain variable inside ``body``.
    """
    return F.get(F.transform(F.array(value), body), 0)


def strip_newlines(c) -> Column:
    """Remove ``\\n`` only (carriage returns and other breaks are kept)."""
    return F.replace(col_(c), F.lit("\n"), F.lit(""))


def tokenize(c, pattern: str = TOKEN_PATTERN) -> Column:
    """Analyzer: ``array<string>`` of lower-cased tokens in text order (null text -> [])."""
    return F.coalesce(F.regexp_extract_all(F.lower(col_(c)), F.lit(pattern), 1), F.array().cast("array<string>"))


def split_sentences(c, delimiters: str = SENTENCE_DELIMITERS) -> Column:
    """Sentences in order: split on delimiters, trim spaces, drop empty pieces."""
    parts = F.split(F.coalesce(col_(c), F.lit("")), delimiters)
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != "")


def preview(c, n: int = 300) -> Column:
    return F.substring(col_(c), 1, n)


def url_quote(c) -> Column:
    """Percent-encode like ``urllib.parse.quote`` for file names (space -> %20)."""
    return F.replace(F.url_encode(col_(c)), F.lit("+"), F.lit("%20"))


def highlight_runs(fragment, terms: Column, pre: str = "<strong>", post: str = "</strong>",
                   pattern: str = RUN_PATTERN) -> Column:
    """Wrap every run of ``fragment`` whose lower-case form is in ``terms`` (array<string>)."""
    runs = F.regexp_extract_all(col_(fragment), F.lit(pattern), 1)
    wrapped = F.transform(runs, lambda r: F.when(F.array_contains(terms, F.lower(r)),
                                                 F.concat(F.lit(pre), r, F.lit(post))).otherwise(r))
    return F.array_join(wrapped, "")
