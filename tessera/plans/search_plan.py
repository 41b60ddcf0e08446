"""Complete search response: ranked page with highlights, ordered facets, total.

One scored hit set feeds three branches: facet and filter fields ride along with the scores.
The post-filter applies to the page and the total but never to the facets. Facets count all
hits, or the best ``sample_size`` where the request asks for a sample.
"""

from __future__ import annotations

from dataclasses import dataclass
from dataclasses import field as dc_field

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import FACET_FIELDS
from ..operators import facets as fc
from ..operators import prep as pr
from ..operators import search as se
from ..operators import shape as sh
from ..operators import vectors as vx

# Names of the two search forms and of the search fields.
KEYWORD = "关键词查询"
SIMILAR = "类案查询"
FULL_TEXT = "全文"
FACTS_ONLY = "仅案情"
#: Largest page that is sent to the executors to fetch its records.
BROADCAST_HITS = 10_000


@dataclass
class SearchRequest:
    query: str
    backbone: str = KEYWORD
    field: str = FULL_TEXT
    facets: dict | None = None
    from_: int = 0
    size: int = sh.PAGE_SIZE
    facet_fields: list = dc_field(default_factory=lambda: list(FACET_FIELDS))
    sample_size: int | None = None
    knn_k: int = 1000


@dataclass
class SearchResult:
    scored: DataFrame
    hits: DataFrame
    facets: DataFrame
    total: DataFrame

    def unpersist(self):
        self.scored.unpersist()


def scored_hits(cases: DataFrame, req: SearchRequest, prepare=None, encoder=None, vectors: DataFrame | None = None,
                dims: int = vx.DEFAULT_DIMS, metric: str = "cos") -> tuple[DataFrame, list[str] | None]:
    """``(doc_id, score, facet and filter fields)`` for every hit. Preparation is a projection,
    so what the search does not use of it is pruned."""
    src = prepare(cases) if prepare is not None else cases
    keep = tuple(dict.fromkeys([*(req.facets or ()), *[f for f in req.facet_fields if f in src.columns]]))
    if req.backbone == KEYWORD:
        fld = se.field_for(req.field)
        terms = se.analyze_query(cases.sparkSession, req.query)
        if se.query_mode(req.query) == "phrase":
            return se.phrase_search(src, req.query, fld, keep), terms
        return se.keyword_search(src, req.query, fld, "or", keep), terms
    if req.backbone == SIMILAR:
        if "vector" not in src.columns:
            if vectors is None:
                raise ValueError("a similar-case search needs records with a vector column or a table of vectors")
            src = pr.attach_vector(src, vectors)
        qvec = vx.query_vector(cases.sparkSession, req.query, encoder=encoder, dims=dims, metric=metric)
        return vx.knn_search(src, qvec, k=req.knn_k, keep=keep), None
    raise ValueError(f"unknown backbone {req.backbone!r}")


def _fetch(ranked: DataFrame, cases: DataFrame, prepare, size: int) -> DataFrame:
    """Late materialisation: join the ranked ids of a page back to the records and run the
    (expensive) preparation on those rows only. Pages of up to ``BROADCAST_HITS`` ids are
    broadcast; larger ones are joined as Spark sees fit."""
    rows = cases.join(F.broadcast(ranked) if size <= BROADCAST_HITS else ranked, "doc_id")
    return prepare(rows) if prepare is not None else rows


def search(cases: DataFrame, req: SearchRequest, prepare=None, encoder=None, persist: bool = True, vectors: DataFrame | None = None,
           dims: int = vx.DEFAULT_DIMS, metric: str = "cos") -> SearchResult:
    """Search response over raw ``cases``; ``prepare`` turns raw rows into indexed records
    (``operators.prep.prepare_cases``). A similar-case search takes the records' vectors from
    their ``vector`` column or from ``vectors`` (doc_id, vector)."""
    scored, terms = scored_hits(cases, req, prepare, encoder, vectors, dims, metric)
    if persist:
        scored = scored.persist(StorageLevel.MEMORY_AND_DISK)
    counted = scored
    if req.sample_size is not None:
        counted = fc.sample_hits(scored.withColumn("score", F.round("score", 6)), req.sample_size)
    facets = fc.facets(counted, req.facet_fields)
    filtered = fc.post_filter(scored, req.facets).select("doc_id", "score")
    total = filtered.agg(F.count(F.lit(1)).cast("bigint").alias("total"))
    page_ids = sh.search_page(filtered, req.from_, req.size)
    page = _fetch(page_ids, cases, prepare, req.size)
    hits = sh.shape_hits(page, req.field, terms, keyword_mode=req.backbone == KEYWORD)
    return SearchResult(scored, hits, facets, total)
