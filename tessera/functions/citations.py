"""Legal-citation normalisation: raw JSON list of citation objects -> list of strings.

Two input shapes are accepted per element:
  * a law object whose first value is the law name and whose second value is a list
    of article objects; each article contributes ``law name + its first value``;
  * an object with keys ``fgmc`` and ``tkx``, contributing ``fgmc + tkx``.
Any other element stops the conversion: the strings collected before it are kept and
the row is flagged as rejected. Null, empty or ``[]`` input gives ``[]``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col_

# The keys that identify the two citation shapes.
LAW_NAME_KEY = "法规名称"
ARTICLE_KEY = "tkx"
CODE_NAME_KEY = "fgmc"

_MAPS = "array<map<string,string>>"


def _element_strings(m: Column) -> Column:
    vals = F.map_values(m)
    articles = F.from_json(F.get(vals, 1), _MAPS)
    shape_a = F.coalesce(
        F.transform(articles, lambda a: F.concat(F.get(vals, 0), F.get(F.map_values(a), 0))),
        F.array(F.lit(None).cast("string")))
    shape_b = F.array(F.concat(m[CODE_NAME_KEY], m[ARTICLE_KEY]))
    return (F.when(F.map_contains_key(m, LAW_NAME_KEY), shape_a)
            .when(F.map_contains_key(m, ARTICLE_KEY), shape_b)
            .otherwise(F.array(F.lit(None).cast("string"))))


def normalize_citations(raw) -> Column:
    """``struct<items: array<string>, rejected: boolean>`` from a JSON text column."""
    r = col_(raw)
    parsed = F.from_json(r, _MAPS)
    flat = F.flatten(F.transform(parsed, _element_strings))
    first_bad = F.array_position(F.transform(flat, lambda x: x.isNull()), True)
    present = r.isNotNull() & (F.trim(r) != "") & (F.trim(r) != "[]")
    items = (F.when(~present, F.array().cast("array<string>"))
             .when(parsed.isNull(), F.array().cast("array<string>"))
             .when(first_bad == 0, flat)
             .otherwise(F.slice(flat, F.lit(1), (first_bad - 1).cast("int"))))
    rejected = present & (parsed.isNull() | (first_bad > 0))
    return F.struct(items.alias("items"), rejected.alias("rejected"))
