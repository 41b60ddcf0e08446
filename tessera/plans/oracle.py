"""DuckDB oracle SQL for the registered queries.

Each statement recomputes the query from the driver tables with plain SQL (CTEs,
``unnest``, window functions, list lambdas). Shared fixed values (analyzer pattern,
fact patterns, constants) come from the same modules the Spark side uses so both
engines are handed identical definitions; the computation itself is written
independently here.
"""

from __future__ import annotations

from ..functions.facts import FACT_PATTERNS
from ..functions.labels import FIELD_LABELS
from ..functions.text import SENTENCE_DELIMITERS, TOKEN_PATTERN
from ..sources.tables import CASE_VECTORS_SQL, CASES_SQL
from . import params as P


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def tok(expr: str) -> str:
    return f"coalesce(regexp_extract_all(lower({expr}), {_q(TOKEN_PATTERN)}, 1), [])"


def nl(expr: str) -> str:
    return f"replace(coalesce({expr}, ''), chr(10), '')"


def facts(expr: str):
    t = nl(expr)
    text_arms = " ".join(f"WHEN regexp_matches({t}, {_q(p)}) THEN regexp_extract({t}, {_q(p)}, {g})" for p, g in FACT_PATTERNS)
    pat_arms = " ".join(f"WHEN regexp_matches({t}, {_q(p)}) THEN {i}" for i, (p, _) in enumerate(FACT_PATTERNS, 1))
    return f"CASE {text_arms} ELSE {t} END", f"CASE {pat_arms} ELSE 0 END"


def _legal_base(raw: str) -> str:
    el = ("list_transform(from_json({r}, '[\"json\"]'), lambda e: CASE "
          "WHEN list_contains(json_keys(e), '法规名称') THEN coalesce(list_transform(from_json(json_extract(e, json_keys(e)[2]), '[\"json\"]'), "
          "lambda a: json_extract_string(e, json_keys(e)[1]) || json_extract_string(a, json_keys(a)[1])), [NULL::VARCHAR]) "
          "WHEN list_contains(json_keys(e), 'tkx') THEN [json_extract_string(e, 'fgmc') || json_extract_string(e, 'tkx')] "
          "ELSE [NULL::VARCHAR] END)").format(r=raw)
    return f"flatten({el})"


def prelude() -> str:
    fb_text, fb_pat = facts("basics_text")
    fc_text, fc_pat = facts("content")
    has_b = "coalesce(basics_text, '') <> ''"
    has_c = "coalesce(content, '') <> ''"
    return f"""cases AS ({CASES_SQL}),
case_vectors AS ({CASE_VECTORS_SQL}),
fx AS (SELECT *,
  CASE WHEN {has_b} THEN {fb_text} WHEN {has_c} THEN {fc_text} END AS fx_text,
  CASE WHEN {has_b} THEN {fb_pat} WHEN {has_c} THEN {fc_pat} ELSE 0 END AS fx_pat,
  CASE WHEN {has_b} THEN 1 WHEN {has_c} THEN (CASE WHEN ({fc_pat}) > 0 THEN 1 ELSE 0 END) ELSE 0 END AS is_valid,
  CASE WHEN {has_b} THEN 'basics_text' WHEN {has_c} THEN 'content' ELSE 'none' END AS fact_source,
  {_legal_base('legal_base_raw')} AS lb_flat
  FROM cases),
lb AS (SELECT *, list_position(list_transform(lb_flat, lambda x: x IS NULL), true) AS lb_bad,
  legal_base_raw IS NOT NULL AND trim(legal_base_raw) <> '' AND trim(legal_base_raw) <> '[]' AS lb_present FROM fx),
prepared AS (SELECT doc_id, collection, case_id, case_name, content,
  CASE WHEN is_valid = 1 THEN fx_text ELSE basics_text END AS basics_text,
  is_valid, fact_source, fx_pat AS fact_pattern, court_name, court_province, case_type, trial_round,
  try_cast(publish_date_raw AS DATE) AS publish_date,
  CASE WHEN NOT lb_present OR lb_flat IS NULL THEN []::VARCHAR[] WHEN lb_bad IS NULL THEN lb_flat ELSE lb_flat[1:lb_bad - 1] END AS legal_base,
  lb_present AND (lb_flat IS NULL OR lb_bad IS NOT NULL) AS legal_base_rejected,
  doc_id AS id
  FROM lb),
prepared_v AS (SELECT p.*, CASE WHEN coalesce(p.basics_text, '') <> '' THEN v.vector END AS vector
  FROM prepared p LEFT JOIN case_vectors v USING (doc_id))"""


def with_prelude(body: str) -> str:
    return f"WITH {prelude()},\n{body}"


def bm25_cte(name: str, source: str, tokens_expr: str, query: str, mode: str = "or") -> str:
    """CTE ``name`` with (doc_id, score) for a single BM25 query over ``source``."""
    k1, b = P.K1, P.B
    qt = tok(_q(query))
    having = ""
    if mode == "and":
        having = f"HAVING count(*) = (SELECT count(*) FROM {name}_qtf)"
    return f"""{name}_tok AS (SELECT doc_id, {tokens_expr} AS t FROM {source}),
{name}_qtf AS (SELECT term, count(*) AS qtf FROM (SELECT unnest({qt}) AS term) GROUP BY term),
{name}_st AS (SELECT count(*) FILTER (WHERE len(t) > 0) AS n, sum(len(t)) AS tot FROM {name}_tok),
{name}_tf AS (SELECT doc_id, term, count(*) AS tf, any_value(dl) AS dl FROM
  (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM {name}_tok) WHERE term IN (SELECT term FROM {name}_qtf) GROUP BY doc_id, term),
{name}_df AS (SELECT term, count(*) AS df FROM {name}_tf GROUP BY term),
{name} AS (SELECT doc_id, sum(q.qtf * ln(1 + (s.n - d.df + 0.5) / (d.df + 0.5)) * (f.tf * {k1 + 1.0}) /
  (f.tf + {k1} * (1 - {b} + {b} * f.dl / (s.tot::DOUBLE / s.n)))) AS score
  FROM {name}_tf f JOIN {name}_df d USING (term) JOIN {name}_qtf q USING (term) CROSS JOIN {name}_st s
  GROUP BY doc_id {having})"""


def phrase_cte(name: str, source: str, tokens_expr: str, query: str) -> str:
    k1, b = P.K1, P.B
    qt = tok(_q(query))
    return f"""{name}_tok AS (SELECT doc_id, {tokens_expr} AS t FROM {source}),
{name}_qt AS (SELECT {qt} AS q),
{name}_st AS (SELECT count(*) FILTER (WHERE len(t) > 0) AS n, sum(len(t)) AS tot FROM {name}_tok),
{name}_qterms AS (SELECT unnest(q) AS term FROM {name}_qt),
{name}_df AS (SELECT x.term, (SELECT count(*) FROM {name}_tok WHERE list_contains(t, x.term)) AS df FROM (SELECT DISTINCT term FROM {name}_qterms) x),
{name}_idf AS (SELECT sum(ln(1 + (s.n - d.df + 0.5) / (d.df + 0.5))) AS idf FROM {name}_qterms qt JOIN {name}_df d USING (term) CROSS JOIN {name}_st s),
{name}_pf AS (SELECT doc_id, len(t) AS dl, len(list_filter(range(1, len(t) + 1),
   lambda i: list_bool_and(list_transform(range(1, len(q) + 1), lambda j: coalesce(t[i + j - 1] = q[j], false))))) AS pf
  FROM {name}_tok CROSS JOIN {name}_qt),
{name} AS (SELECT doc_id, (SELECT idf FROM {name}_idf) * (pf * {k1 + 1.0}) / (pf + {k1} * (1 - {b} + {b} * dl / (s.tot::DOUBLE / s.n))) AS score
  FROM {name}_pf CROSS JOIN {name}_st s WHERE pf > 0)"""


def hash_vec_sql(text_expr: str, dims: int) -> str:
    """Hashed-count vector (list of DOUBLE) for a text expression (not normalised)."""
    return (f"list_reduce(list_transform({tok(text_expr)}, lambda x: (('0x' || substr(md5(x), 1, 4))::INTEGER % {dims})), "
            f"lambda acc, b: list_transform(acc, lambda c, i: CASE WHEN i - 1 = b THEN c + 1.0 ELSE c END), "
            f"list_transform(range(0, {dims}), lambda i: 0.0::DOUBLE))")


def _norm_stage(src: str, key: str, vec_expr: str, extra: str = "") -> str:
    """Three staged SELECTs (raw vector, its norm, normalised ``v``) over ``src``; the
    heavy vector expression is evaluated once per row."""
    ex = f", {extra}" if extra else ""
    return (f"(SELECT {key}, nv{', ' + extra.split(' AS ')[-1] if extra else ''}, "
            f"list_transform(nv, lambda x: CASE WHEN nn > 0 THEN x / nn ELSE 0.0 END) AS v FROM "
            f"(SELECT *, sqrt(list_sum(list_transform(nv, lambda x: x * x))) AS nn FROM "
            f"(SELECT {key}, ({vec_expr})::DOUBLE[] AS nv{ex} FROM {src})))")


def _dot(a: str, b: str) -> str:
    return f"coalesce(list_sum(list_transform(range(1, len({a}) + 1), lambda i: {a}[i]::DOUBLE * {b}[i]::DOUBLE)), 0.0)"


def _sentences(expr: str) -> str:
    return f"list_filter(list_transform(regexp_split_to_array(coalesce({expr}, ''), {_q(SENTENCE_DELIMITERS)}), lambda s: trim(s)), lambda s: s <> '')"


def _facets_from(src: str) -> str:
    fields = [("court_name", False), ("court_province", False), ("trial_round", False), ("case_type", False), ("legal_base", True)]
    pos = {f: i for i, f in enumerate(["court_name", "court_province", "court_city", "court_region", "court_district",
                                       "pub_prosecution_org", "trial_round", "case_type", "cause", "legal_base"])}
    parts = []
    for f, multi in fields:
        if multi:
            parts.append(f"SELECT {pos[f]} AS field_pos, '{f}' AS field, unnest(list_distinct(list_filter({f}, lambda x: x IS NOT NULL))) AS key FROM {src}")
        else:
            parts.append(f"SELECT {pos[f]} AS field_pos, '{f}' AS field, {f}::VARCHAR AS key FROM {src} WHERE {f} IS NOT NULL")
    u = " UNION ALL ".join(parts)
    # positions follow the order of the facet fields present in the prepared table
    present = [f for f in pos if f in dict(fields)]
    remap = " ".join(f"WHEN {pos[f]} THEN {i}" for i, f in enumerate(present))
    return f"""fc_ex AS ({u}),
fc_cnt AS (SELECT CASE field_pos {remap} END AS field_pos, field, key, count(*) AS doc_count FROM fc_ex GROUP BY ALL),
fc_rank AS (SELECT *, row_number() OVER (PARTITION BY field_pos ORDER BY doc_count DESC, key ASC) AS rank FROM fc_cnt)
SELECT field_pos::INTEGER AS field_pos, field, key, doc_count::BIGINT AS doc_count, rank::INTEGER AS rank
FROM fc_rank WHERE rank <= {P.FACET_SIZE} AND length(key) > 0"""


def build() -> dict[str, str]:
    S: dict[str, str] = {}
    qo = P.Q_OR

    S["keyword_search"] = with_prelude(bm25_cte("h", "prepared", tok("content"), qo) +
                                       "\nSELECT doc_id, round(score, 6) AS score FROM h ORDER BY round(score, 6) DESC, doc_id LIMIT 20")
    S["keyword_search_all_terms"] = with_prelude(bm25_cte("h", "prepared", tok("content"), P.Q_AND, "and") +
                                                 "\nSELECT doc_id, round(score, 6) AS score FROM h")
    S["phrase_search"] = with_prelude(phrase_cte("h", "prepared", tok("content"), P.Q_PHRASE) +
                                      "\nSELECT doc_id, round(score, 6) AS score FROM h")
    S["facts_search"] = with_prelude(bm25_cte("h", "prepared", tok("basics_text"), qo) +
                                     "\nSELECT doc_id, round(score, 6) AS score FROM h ORDER BY round(score, 6) DESC, doc_id LIMIT 20")
    for scan in ("keyword_search", "phrase_search", "facts_search"):
        S[f"indexed_{scan}"] = S[scan]
    S["title_phrase"] = with_prelude(phrase_cte("h", "prepared", tok("case_name"), P.Q_TITLE) +
                                     "\nSELECT doc_id, round(score, 6) AS score FROM h")
    S["multi_field_search"] = with_prelude(
        bm25_cte("h", "prepared", f"list_concat({tok('case_name')}, {tok('content')})", P.Q_MULTI) +
        "\nSELECT doc_id, round(score, 6) AS score FROM h ORDER BY round(score, 6) DESC, doc_id LIMIT 20")
    S["multi_field_phrase"] = with_prelude(
        phrase_cte("a", "prepared", tok("case_name"), P.Q_MULTI_PHRASE) + ",\n" +
        phrase_cte("c", "prepared", tok("content"), P.Q_MULTI_PHRASE) +
        ",\nu AS (SELECT * FROM a UNION ALL SELECT * FROM c)\nSELECT doc_id, round(max(score), 6) AS score FROM u GROUP BY doc_id")

    hits = bm25_cte("h", "prepared", tok("content"), qo)
    facet_hits = """,
hs AS (SELECT h.doc_id, h.score, p.court_name, p.court_province, p.trial_round, p.case_type, p.legal_base
  FROM h JOIN prepared p USING (doc_id)%s),
""" + _facets_from("hs")
    S["facets"] = with_prelude(hits + facet_hits % "")
    S["facets_sampled"] = with_prelude(hits + facet_hits % f" ORDER BY round(h.score, 6) DESC, h.doc_id LIMIT {P.SAMPLE_SIZE}")
    pf = ("h2 AS (SELECT h.doc_id, h.score FROM h JOIN prepared p USING (doc_id) WHERE p.court_province IN ('en', 'fr') "
          "AND p.trial_round IN ('一审', '二审'))")
    S["search_total"] = with_prelude(hits + ",\n" + pf + "\nSELECT count(*)::BIGINT AS total FROM h2")
    S["post_filter_search"] = with_prelude(hits + ",\n" + pf +
                                           "\nSELECT doc_id, round(score, 6) AS score FROM h2 ORDER BY round(score, 6) DESC, doc_id LIMIT 20")
    S["search_page"] = with_prelude(hits + "\nSELECT doc_id, round(score, 6) AS score FROM h ORDER BY round(score, 6) DESC, doc_id LIMIT 25 OFFSET 20")
    qarr = f"list_distinct({tok(_q(qo))})"
    hl_runs = "regexp_extract_all(frag, '([0-9A-Za-zÀ-ÖØ-öø-ÿ]+|[一-鿿]|[^0-9A-Za-zÀ-ÖØ-öø-ÿ一-鿿]+)', 1)"
    S["highlight"] = with_prelude(hits + f""",
pg AS (SELECT h.doc_id, p.content FROM h JOIN prepared p USING (doc_id) ORDER BY round(h.score, 6) DESC, h.doc_id LIMIT 20),
sn AS (SELECT doc_id, unnest({_sentences('content')}) AS s, generate_subscripts({_sentences('content')}, 1) AS i FROM pg),
sc AS (SELECT doc_id, s, i, len(list_distinct(list_filter({tok('s')}, lambda x: list_contains({qarr}, x)))) AS n FROM sn),
best AS (SELECT doc_id, arg_max(s, n * 100000000 - i) AS frag, max(n) AS n FROM sc GROUP BY doc_id)
SELECT pg.doc_id, CASE WHEN best.n > 0 THEN array_to_string(list_transform({hl_runs},
   lambda r: CASE WHEN list_contains({qarr}, lower(r)) THEN '<strong>' || r || '</strong>' ELSE r END), '') END AS highlight
FROM pg LEFT JOIN best USING (doc_id)""")
    runs = "regexp_extract_all(content, '([0-9A-Za-zÀ-ÖØ-öø-ÿ]+|[一-鿿]|[^0-9A-Za-zÀ-ÖØ-öø-ÿ一-鿿]+)', 1)"
    S["highlight_window"] = with_prelude(hits + f""",
pg AS (SELECT h.doc_id, {runs} AS runs FROM h JOIN prepared p USING (doc_id) ORDER BY round(h.score, 6) DESC, h.doc_id LIMIT 20),
un AS (SELECT doc_id, generate_subscripts(runs, 1) AS i, unnest(runs) AS r FROM pg),
m AS (SELECT doc_id, i, lower(r) AS term FROM un WHERE list_contains({qarr}, lower(r))),
k AS (SELECT doc_id, count(DISTINCT term) AS n FROM m GROUP BY doc_id),
la AS (SELECT e.doc_id, e.i AS b, m.term, max(m.i) AS place FROM m e JOIN m ON m.doc_id = e.doc_id AND m.i <= e.i GROUP BY ALL),
wi AS (SELECT doc_id, b, min(place) AS a, count(*) AS met FROM la GROUP BY doc_id, b),
be AS (SELECT wi.doc_id, arg_min((a, b), (b - a, a)) AS w FROM wi JOIN k ON k.doc_id = wi.doc_id AND wi.met = k.n GROUP BY wi.doc_id)
SELECT pg.doc_id, array_to_string(list_transform(runs[greatest(w[1] - 12, 1):w[2] + 12],
  lambda r: CASE WHEN list_contains({qarr}, lower(r)) THEN '<strong>' || r || '</strong>' ELSE r END), '') AS fragment
FROM pg LEFT JOIN be USING (doc_id)""")
    S["search_hits"] = with_prelude(hits + f""",
pg AS (SELECT h.doc_id, round(h.score, 6) AS score, p.* EXCLUDE (doc_id) FROM h JOIN prepared p USING (doc_id) ORDER BY round(h.score, 6) DESC, h.doc_id LIMIT 20),
sn AS (SELECT doc_id, unnest({_sentences('content')}) AS s, generate_subscripts({_sentences('content')}, 1) AS i FROM pg),
sc AS (SELECT doc_id, s, i, len(list_distinct(list_filter({tok('s')}, lambda x: list_contains({qarr}, x)))) AS n FROM sn),
best AS (SELECT doc_id, arg_max(s, n * 100000000 - i) AS frag, max(n) AS n FROM sc GROUP BY doc_id),
hl AS (SELECT doc_id, CASE WHEN best.n > 0 THEN array_to_string(list_transform({hl_runs},
   lambda r: CASE WHEN list_contains({qarr}, lower(r)) THEN '<strong>' || r || '</strong>' ELSE r END), '') END AS highlight FROM best)
SELECT pg.doc_id::VARCHAR AS _id, coalesce(case_name, 'MISSING CONTENT!') AS case_name,
  coalesce(hl.highlight, CASE WHEN content IS NOT NULL THEN substring(content, 1, 300) ELSE 'MISSING CONTENT!' END) AS content,
  coalesce(court_name, '') AS court_name, coalesce(strftime(publish_date, '%Y-%m-%d'), '') AS publish_date,
  CASE WHEN coalesce(case_id, '') <> '' THEN case_id ELSE '' END AS case_id,
  CASE WHEN coalesce(basics_text, '') <> '' THEN basics_text ELSE {nl('content')} END AS pseudo_basics_text, score
FROM pg LEFT JOIN hl USING (doc_id)""")
    S["page_window"] = with_prelude(hits + f""",
t AS (SELECT count(*) AS total FROM h),
pgs AS (SELECT unnest(range(1, CAST(ceil(total / {P.CLIENT_PAGE}) AS BIGINT) + 1)) AS page, total FROM t),
w AS (SELECT page, total, CAST(ceil(total / {P.CLIENT_PAGE}) AS INTEGER) AS n_pages,
  least(page - 2, CAST(ceil(total / {P.CLIENT_PAGE}) AS INTEGER) - 4) AS st FROM pgs)
SELECT page::INTEGER AS page, n_pages, array_to_string(list_filter(range(st, n_pages + 1), lambda x: x > 0)[1:5], ',') AS pages FROM w""")

    # ---- query mode over the benchmark queries
    S["query_mode"] = f"""WITH q AS (SELECT item_id, CASE item_id % 4 WHEN 0 THEN '"' || text || '"' WHEN 1 THEN '“' || text || '”'
  WHEN 2 THEN text ELSE '"' || text END AS query FROM benchmark)
SELECT item_id, CASE WHEN query IS NULL OR query = '' THEN NULL
  WHEN substring(query, 1, 1) IN ('''', '"', '“') AND substring(query, length(query), 1) IN ('''', '"', '”') THEN 'phrase' ELSE 'match' END AS mode FROM q"""

    # ---- filters and counts
    S["count_all"] = with_prelude("x AS (SELECT 1)\nSELECT count(*)::BIGINT AS n FROM prepared")
    S["term_filter"] = with_prelude("x AS (SELECT 1)\nSELECT doc_id FROM prepared WHERE collection = 'p2'")
    S["terms_filter"] = with_prelude("x AS (SELECT 1)\nSELECT doc_id FROM prepared WHERE court_province IN ('en', 'de') "
                                     "AND len(list_intersect(legal_base, ['《民法》第1条', '《民法》第2条', '《合同法》第二条'])) > 0")
    S["substring_scan"] = with_prelude(f"x AS (SELECT 1)\nSELECT doc_id FROM prepared WHERE strpos(content, {_q(P.SUBSTRING)}) > 0")
    S["exists_filter"] = with_prelude("x AS (SELECT 1)\nSELECT doc_id FROM prepared WHERE basics_text IS NOT NULL AND basics_text <> ''")
    S["get_by_id"] = with_prelude("x AS (SELECT 1)\nSELECT doc_id, case_id, case_name FROM prepared WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
    S["terms_agg"] = with_prelude("x AS (SELECT 1)\nSELECT court_name AS key, count(*)::BIGINT AS doc_count FROM prepared WHERE court_name IS NOT NULL "
                                  "GROUP BY court_name ORDER BY doc_count DESC, key LIMIT 10")
    S["delete_by_collection"] = with_prelude("x AS (SELECT 1)\nSELECT doc_id, collection FROM prepared WHERE collection <> 'p1'")

    # ---- shaping
    S["indexed_substring"] = S["substring_scan"]
    S["indexed_substrings"] = with_prelude("q AS (SELECT item_id, substring(text, %d, %d) AS s FROM benchmark)\n" % P.STRETCH +
                                           "SELECT item_id, doc_id FROM q JOIN prepared ON s <> '' AND strpos(content, s) > 0")
    S["preview"] = with_prelude("x AS (SELECT 1)\nSELECT doc_id, substring(content, 1, 300) AS preview FROM prepared")
    S["pseudo_facts"] = with_prelude(f"x AS (SELECT 1)\nSELECT doc_id, CASE WHEN coalesce(basics_text, '') <> '' THEN basics_text ELSE {nl('content')} END AS query_text FROM prepared")
    S["date_render"] = with_prelude("x AS (SELECT 1)\nSELECT doc_id, strftime(publish_date, '%Y-%m-%d') AS publish_date FROM prepared")
    S["hit_defaults"] = with_prelude("""x AS (SELECT 1)
SELECT doc_id, coalesce(case_name, 'MISSING CONTENT!') AS case_name, coalesce(content, 'MISSING CONTENT!') AS content,
  coalesce(court_name, '') AS court_name, coalesce(strftime(publish_date, '%Y-%m-%d'), '') AS publish_date,
  CASE WHEN coalesce(case_id, '') <> '' THEN case_id ELSE '' END AS case_id, coalesce(basics_text, '') AS basics_text FROM prepared""")
    label_pos = {f: (i, lab) for i, (f, lab) in enumerate(FIELD_LABELS)}
    present = ["publish_date", "trial_round", "court_name", "court_province", "case_name", "case_type", "basics_text", "legal_base", "content"]
    parts = []
    for pos, f in enumerate([f for f, _ in FIELD_LABELS if f in present]):
        lab = label_pos[f][1]
        v = {"publish_date": "strftime(publish_date, '%Y-%m-%d')", "legal_base": "array_to_string(legal_base, ',')"}.get(f, f"{f}::VARCHAR")
        parts.append(f"SELECT doc_id, {pos} AS field_pos, '{f}' AS field, '{lab}' AS label, {v} AS value FROM prepared")
    S["record_detail"] = with_prelude("u AS (" + " UNION ALL ".join(parts) + ")\nSELECT doc_id, field_pos::INTEGER AS field_pos, field, label, value FROM u WHERE value IS NOT NULL AND value <> ''")
    S["export_text"] = with_prelude("""x AS (SELECT 1)
SELECT doc_id, replace(url_encode(coalesce(case_id, '') || '.txt'), '+', '%20') AS file_name,
  coalesce(case_name, '') || chr(10) || coalesce(content, '') AS body FROM prepared""")

    # ---- preparation
    S["newline_strip"] = "SELECT doc_id, replace(text, chr(10), '') AS text FROM documents"
    fct, fcp = facts("content")
    S["fact_extract"] = with_prelude(f"x AS (SELECT 1)\nSELECT doc_id, {fct} AS text, CASE WHEN ({fcp}) > 0 THEN 1 ELSE 0 END AS matched, ({fcp})::INTEGER AS pattern FROM cases")
    S["facts_with_validity"] = with_prelude("x AS (SELECT 1)\nSELECT doc_id, basics_text, is_valid::INTEGER AS is_valid, fact_source, fact_pattern::INTEGER AS fact_pattern FROM prepared")
    rej = f"""p.is_valid = 0 AND coalesce(p.content, '') <> '' AND NOT regexp_matches(replace(coalesce(p.case_name, ''), ' ', ''), '裁定|决定|通知')"""
    S["filter_rejects"] = with_prelude(f"x AS (SELECT 1)\nSELECT doc_id, {nl('content')} AS content FROM prepared p WHERE {rej}")
    S["reject_sample"] = with_prelude(f"first AS (SELECT * FROM prepared WHERE is_valid = 0 ORDER BY doc_id LIMIT 100)\nSELECT doc_id, {nl('content')} AS content FROM first p WHERE {rej}")
    S["legal_base_normalize"] = with_prelude("x AS (SELECT 1)\nSELECT doc_id, array_to_string(legal_base, '|') AS legal_base, len(legal_base)::INTEGER AS n_items, legal_base_rejected FROM prepared")
    S["legal_base_rejects"] = with_prelude("x AS (SELECT 1)\nSELECT doc_id, array_to_string(legal_base, '|') AS legal_base FROM prepared WHERE legal_base_rejected")
    S["provenance"] = with_prelude("x AS (SELECT 1)\nSELECT doc_id, id::BIGINT AS id, collection FROM prepared")
    S["safe_cast"] = with_prelude("x AS (SELECT 1)\nSELECT doc_id, publish_date_raw, strftime(try_cast(publish_date_raw AS DATE), '%Y-%m-%d') AS publish_date FROM cases")
    S["attach_vector"] = with_prelude("x AS (SELECT 1)\nSELECT doc_id, vector IS NOT NULL AS has_vector, len(vector)::INTEGER AS dims, "
                                      "round(list_sum(list_transform(vector, lambda x: x::DOUBLE)), 6) AS vsum FROM prepared_v")
    S["prep_stats"] = with_prelude("x AS (SELECT 1)\nSELECT sum(is_valid)::BIGINT AS kept, sum(1 - is_valid)::BIGINT AS skipped, sum(is_valid)::BIGINT AS valid_tf_content_count FROM prepared")
    S["line_range"] = f"SELECT n::BIGINT AS line_no, doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS n FROM documents) WHERE n >= {P.LINE_START}"
    S["line_lookup"] = f"SELECT n::BIGINT AS line_no, doc_id, text FROM (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id) - 1 AS n FROM documents) WHERE n = {P.LINE_LOOKUP}"

    # ---- analysis
    S["tokenize"] = f"SELECT doc_id, len({tok('text')})::INTEGER AS n_tokens, array_to_string({tok('text')}, ' ') AS tokens FROM documents"
    S["postings"] = f"""WITH t AS (SELECT doc_id, {tok('text')} AS t FROM documents),
p AS (SELECT doc_id, len(t) AS dl, unnest(t) AS term, generate_subscripts(t, 1) - 1 AS pos FROM t)
SELECT term, doc_id, count(*)::BIGINT AS tf, array_to_string(list(pos ORDER BY pos), ',') AS positions, any_value(dl)::INTEGER AS dl FROM p GROUP BY term, doc_id"""
    S["term_stats"] = f"""WITH t AS (SELECT doc_id, {tok('text')} AS t FROM documents),
st AS (SELECT count(*) FILTER (WHERE len(t) > 0) AS n, sum(len(t))::DOUBLE / count(*) FILTER (WHERE len(t) > 0) AS avgdl FROM t),
d AS (SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(t) AS term FROM t) GROUP BY term)
SELECT term, df::BIGINT AS df, n::BIGINT AS n_docs, round(avgdl, 6) AS avgdl FROM d CROSS JOIN st"""
    S["stopword_removal"] = f"""WITH t AS (SELECT doc_id, {tok('text')} AS t FROM documents),
st AS (SELECT count(*) AS n FROM t),
d AS (SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(t) AS term FROM t) GROUP BY term),
sw AS (SELECT list(term) AS stop FROM d CROSS JOIN st WHERE df > n * {P.STOP_DF_RATIO})
SELECT doc_id, len(list_filter(t, lambda x: NOT regexp_matches(x, '^[0-9]+$') AND NOT list_contains(coalesce(stop, []), x)))::INTEGER AS n_kept FROM t CROSS JOIN sw"""
    S["sentence_split"] = f"""SELECT doc_id, (generate_subscripts({_sentences('text')}, 1) - 1)::INTEGER AS sent_idx, unnest({_sentences('text')}) AS sentence FROM documents"""
    S["bag_of_words"] = f"""WITH s AS (SELECT doc_id, generate_subscripts({_sentences('text')}, 1) - 1 AS sent_idx, unnest({_sentences('text')}) AS sentence FROM documents),
w AS (SELECT doc_id, sent_idx, unnest({tok('sentence')}) AS term FROM s)
SELECT doc_id, sent_idx::INTEGER AS sent_idx, term, count(*)::BIGINT AS tf FROM w GROUP BY ALL"""

    # ---- vectors
    dims = P.DIMS
    hv = hash_vec_sql("text", dims)
    S["hash_encode"] = f"""WITH v AS {_norm_stage('documents', 'doc_id', hv)}
SELECT doc_id, (generate_subscripts(v, 1) - 1)::INTEGER AS dim, round(unnest(v), 6) AS value FROM v"""
    S["l2_normalize"] = f"""WITH v AS (SELECT doc_id, v, nv AS embedding FROM {_norm_stage('(SELECT vec_id AS doc_id, embedding FROM embeddings)', 'doc_id', 'embedding')})
SELECT doc_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm_before,
  round(sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS norm_after, round(v[1], 6) AS v0 FROM v"""
    fq, _ = facts("text")
    S["knn_query_prep"] = f"""WITH v AS {_norm_stage('benchmark', 'item_id', hash_vec_sql(fq, dims))}
SELECT item_id, (generate_subscripts(v, 1) - 1)::INTEGER AS dim, round(unnest(v), 6) AS value FROM v"""
    fq_lit, _ = facts(_q(P.Q_KNN))
    qv = f"(SELECT v AS q FROM {_norm_stage('(SELECT 1 AS one)', 'one', hash_vec_sql(fq_lit, dims))})"
    S["knn_search"] = with_prelude(f"""qv AS {qv},
s AS (SELECT doc_id, round({_dot('vector', 'q')}, 6) AS score FROM prepared_v CROSS JOIN qv WHERE vector IS NOT NULL)
SELECT doc_id, score FROM s ORDER BY score DESC, doc_id LIMIT {P.KNN_K}""")
    S["similar_search_hits"] = with_prelude(f"""qv AS {qv},
s AS (SELECT doc_id, round({_dot('vector', 'q')}, 6) AS score FROM prepared_v CROSS JOIN qv WHERE vector IS NOT NULL),
pg AS (SELECT s.doc_id, s.score, p.* EXCLUDE (doc_id) FROM s JOIN prepared p USING (doc_id) ORDER BY s.score DESC, s.doc_id LIMIT 20)
SELECT doc_id::VARCHAR AS _id, coalesce(case_name, 'MISSING CONTENT!') AS case_name,
  CASE WHEN content IS NOT NULL THEN substring(content, 1, 300) ELSE 'MISSING CONTENT!' END AS content,
  coalesce(court_name, '') AS court_name, coalesce(strftime(publish_date, '%Y-%m-%d'), '') AS publish_date,
  CASE WHEN coalesce(case_id, '') <> '' THEN case_id ELSE '' END AS case_id,
  CASE WHEN coalesce(basics_text, '') <> '' THEN basics_text ELSE {nl('content')} END AS pseudo_basics_text, score FROM pg""")
    S["knn_facets"] = with_prelude(f"""qv AS {qv},
s AS (SELECT doc_id, round({_dot('vector', 'q')}, 6) AS score FROM prepared_v CROSS JOIN qv WHERE vector IS NOT NULL),
hs AS (SELECT s.doc_id, s.score, p.court_name, p.court_province, p.trial_round, p.case_type, p.legal_base
  FROM s JOIN prepared p USING (doc_id) ORDER BY s.score DESC, s.doc_id LIMIT {P.KNN_K}),
""" + _facets_from("hs"))
    S["knn_join"] = f"""WITH q AS (SELECT item_id AS qid, v AS qv FROM {_norm_stage('benchmark', 'item_id', hash_vec_sql(fq, dims))}),
c AS ({CASE_VECTORS_SQL}),
s AS (SELECT qid, doc_id, round({_dot('vector', 'qv')}, 6) AS score FROM c CROSS JOIN q WHERE vector IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM s)
SELECT qid, doc_id, score, rank::INTEGER AS rank FROM r WHERE rank <= {P.KNN_JOIN_K}"""
    S["knn_ivf_exhaustive"] = S["knn_join"]
    S["hybrid_rescore"] = with_prelude(hits + f""",
qv AS {qv}
SELECT h.doc_id, round(CASE WHEN v.vector IS NULL THEN 0.0 ELSE {_dot('v.vector', 'q')} + 1 END, 6) AS score
FROM h LEFT JOIN case_vectors v USING (doc_id) CROSS JOIN qv""")
    S["vector_pairs"] = f"""WITH a AS (SELECT vec_id AS doc_id, embedding AS va FROM embeddings),
b AS (SELECT vec_id - 1 AS doc_id, embedding AS vb FROM embeddings)
SELECT doc_id, round({_dot('va', 'vb')}, 6) AS dot,
  round({_dot('va', 'vb')} / (sqrt(list_sum(list_transform(va, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(vb, lambda x: x::DOUBLE * x::DOUBLE)))), 6) AS cosine
FROM a JOIN b USING (doc_id)"""

    # ---- query by document
    S["similar_cases"] = with_prelude(f"""q AS (SELECT item_id AS qid, text AS qtext FROM benchmark),
qt AS (SELECT qid, term, count(*) AS qtf FROM (SELECT qid, unnest({tok('qtext')}) AS term FROM q) GROUP BY qid, term),
tk AS (SELECT doc_id, {tok('basics_text')} AS t FROM prepared),
st AS (SELECT count(*) FILTER (WHERE len(t) > 0) AS n, sum(len(t))::DOUBLE / count(*) FILTER (WHERE len(t) > 0) AS avgdl FROM tk),
tf AS (SELECT term, doc_id, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM tk)
  WHERE term IN (SELECT term FROM qt) GROUP BY term, doc_id),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
w AS (SELECT term, doc_id, ln(1 + (st.n - df.df + 0.5) / (df.df + 0.5)) * (tf * {P.K1 + 1.0}) / (tf + {P.K1} * (1 - {P.B} + {P.B} * dl / st.avgdl)) AS w
  FROM tf JOIN df USING (term) CROSS JOIN st),
s AS (SELECT qid, doc_id, round(sum(qtf * w), 6) AS score FROM qt JOIN w USING (term) GROUP BY qid, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM s)
SELECT qid, doc_id, score, rank::INTEGER AS rank FROM r WHERE rank <= {P.SIMILAR_K}""")
    S["similar_stored_cases"] = S["similar_cases"].replace(
        "q AS (SELECT item_id AS qid, text AS qtext FROM benchmark)",
        f"q AS (SELECT doc_id AS qid, CASE WHEN coalesce(basics_text, '') <> '' THEN basics_text ELSE {nl('content')} END AS qtext "
        f"FROM prepared WHERE doc_id % 50 = 0)")
    S["indexed_similar_cases"] = S["similar_cases"]
    S["indexed_similar_stored_cases"] = S["similar_stored_cases"]
    S["index_after_delete"] = S["similar_cases"].replace("AS t FROM prepared)", f"AS t FROM prepared WHERE collection <> {_q(P.DELETED)})")
    S["indexed_pair_phrase"] = S["phrase_search"]
    S["indexed_facets"], S["indexed_post_filter"] = S["facets"], S["post_filter_search"]
    S["index_after_merge"] = with_prelude(bm25_cte("h", f"(SELECT * FROM prepared WHERE collection <> {_q(P.DELETED)})", tok("content"), qo) +
                                          "\nSELECT doc_id, round(score, 6) AS score FROM h")
    # Every pair of that cosine shares a term up to which what remains of either bag is long enough.
    S["sentence_links"] = f"""WITH sl AS (SELECT doc_id, {_sentences('text')} AS l FROM documents),
s AS (SELECT doc_id, generate_subscripts(l, 1) - 1 AS sent_idx, unnest(l) AS sentence FROM sl),
t AS (SELECT doc_id, sent_idx, list_sort({tok('sentence')}) AS words FROM s),
c AS (SELECT words, min((doc_id, sent_idx)) AS f, count(*) AS copies, row_number() OVER (ORDER BY min((doc_id, sent_idx))) AS bag FROM t WHERE len(words) > 0 GROUP BY words),
v AS (SELECT bag, term, count(*) AS tf FROM (SELECT bag, unnest(words) AS term FROM c) GROUP BY ALL),
n AS (SELECT bag, sum(tf * tf)::BIGINT AS n2 FROM v GROUP BY bag),
d AS (SELECT term, count(*) AS df FROM v GROUP BY term),
o AS (SELECT v.*, n2, sum(tf * tf) OVER (PARTITION BY bag ORDER BY df DESC, term DESC) AS upto FROM v JOIN d USING (term) JOIN n USING (bag)),
p AS (SELECT bag, term FROM o WHERE sqrt(upto) >= sqrt(n2) * {P.LINK_COSINE!r} - 1e-9),
k AS (SELECT DISTINCT a.bag AS a, b.bag AS b FROM p a JOIN p b ON a.term = b.term AND a.bag < b.bag),
x AS (SELECT k.a, k.b, sum(va.tf * vb.tf) AS dot FROM k JOIN v va ON va.bag = k.a JOIN v vb ON vb.bag = k.b AND vb.term = va.term GROUP BY k.a, k.b)
SELECT ca.f[1]::BIGINT AS doc_a, ca.f[2]::INTEGER AS sent_a, ca.copies AS copies_a, cb.f[1]::BIGINT AS doc_b, cb.f[2]::INTEGER AS sent_b, cb.copies AS copies_b,
  round(dot / (sqrt(na.n2) * sqrt(nb.n2)), 6) AS cos
FROM x JOIN c ca ON ca.bag = x.a JOIN c cb ON cb.bag = x.b JOIN n na ON na.bag = x.a JOIN n nb ON nb.bag = x.b WHERE dot / (sqrt(na.n2) * sqrt(nb.n2)) >= {P.LINK_COSINE!r} - 1e-12"""
    S.update(explain_sql())
    return S


def _similar_ctes(k: int) -> str:
    return f"""q AS (SELECT item_id AS qid, text AS qtext FROM benchmark),
qt AS (SELECT qid, term, count(*) AS qtf FROM (SELECT qid, unnest({tok('qtext')}) AS term FROM q) GROUP BY qid, term),
tk AS (SELECT doc_id, {tok('basics_text')} AS t FROM prepared),
st AS (SELECT count(*) FILTER (WHERE len(t) > 0) AS n, sum(len(t))::DOUBLE / count(*) FILTER (WHERE len(t) > 0) AS avgdl FROM tk),
tf AS (SELECT term, doc_id, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM tk)
  WHERE term IN (SELECT term FROM qt) GROUP BY term, doc_id),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
w AS (SELECT term, doc_id, ln(1 + (st.n - df.df + 0.5) / (df.df + 0.5)) * (tf * {P.K1 + 1.0}) / (tf + {P.K1} * (1 - {P.B} + {P.B} * dl / st.avgdl)) AS w
  FROM tf JOIN df USING (term) CROSS JOIN st),
s AS (SELECT qid, doc_id, round(sum(qtf * w), 6) AS score FROM qt JOIN w USING (term) GROUP BY qid, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM s),
sim AS (SELECT qid, doc_id, score, rank FROM r WHERE rank <= {k})"""


def _explain_ctes(identity: bool) -> str:
    """CTEs up to key sentences, cosines, thresholds, matches and components."""
    from ..operators import explain as xp

    if identity:
        pairs = "pairs AS (SELECT item_id AS pair_id, text AS query_text, text AS cand_text FROM benchmark)"
    else:
        pairs = (_similar_ctes(1) + ",\npairs AS (SELECT b.item_id AS pair_id, b.text AS query_text, p.basics_text AS cand_text "
                 "FROM benchmark b JOIN sim ON sim.qid = b.item_id JOIN prepared p ON p.doc_id = sim.doc_id)")
    words = "list_filter(" + tok("sentence") + ", lambda x: NOT regexp_matches(x, '^[0-9]+$'))"
    d = xp.DAMPING
    iters = []
    for k in range(1, xp.ITERATIONS + 1):
        iters.append(f"""r{k} AS (SELECT n.tid, n.sent_idx, {1.0 - d!r}::DOUBLE + {d!r}::DOUBLE * coalesce(c.s, 0.0) AS ws FROM nodes n LEFT JOIN
  (SELECT e.tid, e.dst AS sent_idx, sum(e.p * r.ws) AS s FROM edges e JOIN r{k - 1} r ON e.tid = r.tid AND e.src = r.sent_idx GROUP BY ALL) c
  ON n.tid = c.tid AND n.sent_idx = c.sent_idx)""")
    iters_sql = ",\n".join(iters)
    step = xp.STEP
    return f"""{pairs},
texts AS (SELECT pair_id * 2 AS tid, query_text AS text FROM pairs UNION ALL SELECT pair_id * 2 + 1, cand_text FROM pairs),
sl AS (SELECT tid, {_sentences('text')} AS l FROM texts),
sents0 AS (SELECT tid, generate_subscripts(l, 1) - 1 AS sent_idx, unnest(l) AS sentence FROM sl),
sents AS (SELECT *, {words} AS words, len({words}) AS n_words, length(sentence) AS slen FROM sents0),
nodes AS (SELECT tid, sent_idx FROM sents),
ws AS (SELECT DISTINCT tid, sent_idx, unnest(list_distinct(words)) AS word FROM sents),
shared AS (SELECT a.tid, a.sent_idx AS i, b.sent_idx AS j, count(*) AS shared FROM ws a JOIN ws b ON a.tid = b.tid AND a.word = b.word AND a.sent_idx < b.sent_idx GROUP BY ALL),
e1 AS (SELECT s.tid, s.i, s.j, s.shared / (ln(a.n_words::DOUBLE) + ln(b.n_words::DOUBLE)) AS w FROM shared s
  JOIN sents a ON a.tid = s.tid AND a.sent_idx = s.i JOIN sents b ON b.tid = s.tid AND b.sent_idx = s.j
  WHERE abs(ln(a.n_words::DOUBLE) + ln(b.n_words::DOUBLE)) >= 1e-12),
e2 AS (SELECT tid, i AS src, j AS dst, w FROM e1 UNION ALL SELECT tid, j, i, w FROM e1),
edges AS (SELECT tid, src, dst, w / sum(w) OVER (PARTITION BY tid, src) AS p FROM e2),
r0 AS (SELECT tid, sent_idx, 1.0::DOUBLE AS ws FROM nodes),
{iters_sql},
weights AS (SELECT tid, sent_idx, round(ws, {xp.WEIGHT_DIGITS}) AS weight FROM r{xp.ITERATIONS}),
targets AS (SELECT tid, count(*) AS n, greatest(least(count(*) // 3, {xp.SENTENCE_NUMBER}), 1) AS n_key FROM sents GROUP BY tid),
keys0 AS (SELECT s.tid, s.sent_idx, s.words, w.weight, t.n_key,
  row_number() OVER (PARTITION BY s.tid ORDER BY w.weight DESC, s.sent_idx) AS rank
  FROM sents s JOIN weights w USING (tid, sent_idx) JOIN targets t USING (tid) WHERE s.slen >= {xp.SENTENCE_MIN_LEN}),
keys AS (SELECT * FROM keys0 WHERE rank <= n_key),
kv AS (SELECT tid, sent_idx, term, count(*) AS tf FROM (SELECT tid, sent_idx, unnest(words) AS term FROM keys) GROUP BY ALL),
norms AS (SELECT tid, sent_idx, sqrt(sum(tf * tf)::DOUBLE) AS norm FROM kv GROUP BY ALL),
dots AS (SELECT q.tid // 2 AS pair_id, q.tid AS tq, q.sent_idx AS q_idx, c.tid AS tc, c.sent_idx AS c_idx, sum(q.tf * c.tf) AS dot
  FROM kv q JOIN kv c ON c.tid = q.tid + 1 AND q.term = c.term WHERE q.tid % 2 = 0 GROUP BY ALL),
cos AS (SELECT d.pair_id, d.q_idx, d.c_idx, d.dot / (a.norm * b.norm) AS cos FROM dots d
  JOIN norms a ON a.tid = d.tq AND a.sent_idx = d.q_idx JOIN norms b ON b.tid = d.tc AND b.sent_idx = d.c_idx),
nk AS (SELECT tid, count(*) AS k FROM keys WHERE len(words) > 0 GROUP BY tid),
side AS (SELECT t.tid // 2 AS pair_id, max(CASE WHEN t.tid % 2 = 0 THEN t.n_key END) AS nkq, max(CASE WHEN t.tid % 2 = 1 THEN t.n_key END) AS nkc,
  max(CASE WHEN t.tid % 2 = 0 THEN nk.k END) AS kq, max(CASE WHEN t.tid % 2 = 1 THEN nk.k END) AS kc
  FROM targets t LEFT JOIN nk USING (tid) GROUP BY ALL),
sc AS (SELECT pair_id, list(cos) AS scores FROM cos GROUP BY pair_id),
thr0 AS (SELECT p.pair_id, coalesce(sc.scores, []::DOUBLE[]) AS scores,
  (coalesce(side.kq, 0) * coalesce(side.kc, 0) - len(coalesce(sc.scores, []::DOUBLE[])))::INTEGER AS n_zero,
  least(coalesce(side.nkq, 1), coalesce(side.nkc, 1)) AS min_key
  FROM pairs p LEFT JOIN side USING (pair_id) LEFT JOIN sc USING (pair_id) WHERE p.query_text <> p.cand_text),
thr AS (SELECT pair_id, min_key, n_zero, list_reduce(range(1, 261), lambda acc, x:
   CASE WHEN acc.ph = 0 THEN (CASE WHEN len(list_filter(scores, lambda s: s > acc.r)) + (CASE WHEN acc.r < 0 THEN n_zero ELSE 0 END) = 0 AND acc.r > 0
                                  THEN {{'r': acc.r - {step!r}::DOUBLE, 'ph': 0}} ELSE {{'r': acc.r, 'ph': 1}} END)
        WHEN acc.ph = 1 THEN (CASE WHEN len(list_filter(scores, lambda s: s > acc.r)) + (CASE WHEN acc.r < 0 THEN n_zero ELSE 0 END) >= min_key AND acc.r <= 1
                                  THEN {{'r': acc.r + {step!r}::DOUBLE, 'ph': 1}} ELSE {{'r': acc.r, 'ph': 2}} END)
        ELSE acc END, {{'r': {xp.RELATION_RATIO!r}::DOUBLE, 'ph': 0}}).r AS threshold FROM thr0),
pos AS (SELECT c.pair_id, c.q_idx, c.c_idx, c.cos AS score FROM cos c JOIN thr USING (pair_id) WHERE c.cos > thr.threshold),
nzk AS (SELECT tid, sent_idx FROM keys WHERE len(words) > 0),
zero AS (SELECT q.tid // 2 AS pair_id, q.sent_idx AS q_idx, c.sent_idx AS c_idx, 0.0::DOUBLE AS score FROM nzk q JOIN nzk c ON c.tid = q.tid + 1
  JOIN thr ON thr.pair_id = q.tid // 2 WHERE q.tid % 2 = 0 AND thr.threshold < 0 AND thr.n_zero > 0
  AND NOT EXISTS (SELECT 1 FROM cos WHERE cos.pair_id = q.tid // 2 AND cos.q_idx = q.sent_idx AND cos.c_idx = c.sent_idx)),
same AS (SELECT s.tid // 2 AS pair_id, s.sent_idx AS q_idx, s.sent_idx AS c_idx, NULL::DOUBLE AS score FROM sents s
  JOIN pairs p ON p.pair_id = s.tid // 2 WHERE s.tid % 2 = 0 AND p.query_text = p.cand_text
  AND EXISTS (SELECT 1 FROM nzk WHERE nzk.tid // 2 = p.pair_id)),
matched AS (SELECT * FROM pos UNION ALL SELECT * FROM zero UNION ALL SELECT * FROM same),
adj AS (SELECT pair_id, q_idx::BIGINT AS a, (-1 - c_idx)::BIGINT AS b FROM matched WHERE score IS NOT NULL
  UNION ALL SELECT pair_id, (-1 - c_idx)::BIGINT, q_idx::BIGINT FROM matched WHERE score IS NOT NULL),
reach AS (SELECT * FROM (WITH RECURSIVE rr(pair_id, node, root) AS (SELECT pair_id, a, a FROM adj
  UNION SELECT rr.pair_id, adj.b, rr.root FROM rr JOIN adj ON rr.pair_id = adj.pair_id AND rr.node = adj.a) SELECT * FROM rr)),
lab AS (SELECT pair_id, node, min(root) FILTER (WHERE root >= 0) AS label FROM reach GROUP BY ALL),
comp AS (SELECT pair_id, list_sort(list(node) FILTER (WHERE node >= 0)) AS q, list_sort(list(-1 - node) FILTER (WHERE node < 0)) AS c FROM lab GROUP BY pair_id, label
  UNION ALL SELECT pair_id, [q_idx], [c_idx] FROM matched WHERE score IS NULL),
comps AS (SELECT pair_id, row_number() OVER (PARTITION BY pair_id ORDER BY len(q) + len(c) DESC, q[1]) AS comp_rank, q, c FROM comp WHERE len(q) > 0 AND len(c) > 0)"""


def explain_sql() -> dict[str, str]:
    E: dict[str, str] = {}
    base = with_prelude(_explain_ctes(False))
    same = with_prelude(_explain_ctes(True))
    E["textrank"] = base + "\nSELECT tid // 2 AS pair_id, (tid % 2)::INTEGER AS side, sent_idx::INTEGER AS sent_idx, round(weight, 6) AS weight FROM weights"
    E["key_sentences"] = base + "\nSELECT tid // 2 AS pair_id, (tid % 2)::INTEGER AS side, sent_idx::INTEGER AS sent_idx, rank::INTEGER AS rank, n_key::INTEGER AS n_key FROM keys"
    E["joint_vocab"] = base + "\nSELECT DISTINCT tid // 2 AS pair_id, unnest(words) AS term FROM keys"
    E["sentence_cosine"] = base + "\nSELECT pair_id, q_idx::INTEGER AS q_idx, c_idx::INTEGER AS c_idx, round(cos, 6) AS cos FROM cos"
    E["adaptive_threshold"] = base + "\nSELECT pair_id, round(threshold, 6) AS threshold, min_key::INTEGER AS min_key, n_zero::INTEGER AS n_zero FROM thr"
    E["matched_pairs"] = base + "\nSELECT pair_id, q_idx::INTEGER AS q_idx, c_idx::INTEGER AS c_idx, round(score, 6) AS score FROM matched"
    E["explain_identical"] = same + "\nSELECT pair_id, q_idx::INTEGER AS q_idx, c_idx::INTEGER AS c_idx FROM matched"
    comps_out = "\nSELECT pair_id, comp_rank::INTEGER AS comp_rank, array_to_string(q, ',') AS q_idx, array_to_string(c, ',') AS c_idx, ((comp_rank - 1) % 5)::INTEGER AS color FROM comps"
    E["explain_components"] = base + comps_out
    E["explain_identical_components"] = same + comps_out
    graph = base.replace(_similar_ctes(1), _similar_ctes(P.GRAPH_K)).replace(
        "SELECT b.item_id AS pair_id, b.text AS query_text", "SELECT b.item_id * 10 + sim.rank AS pair_id, b.item_id AS q_id, sim.doc_id AS c_id, b.text AS query_text")
    E["case_graph_components"] = graph + """,
ge AS (SELECT DISTINCT q_id, q_idx, c_id, c_idx, concat('0:', q_id, ':', q_idx) AS a, concat('1:', c_id, ':', c_idx) AS b FROM matched JOIN pairs USING (pair_id)),
ga AS (SELECT a, b FROM ge UNION SELECT b, a FROM ge),
gr AS (SELECT * FROM (WITH RECURSIVE rr(node, root) AS (SELECT a, a FROM ga UNION SELECT ga.b, rr.root FROM rr JOIN ga ON rr.node = ga.a) SELECT * FROM rr)),
gl AS (SELECT node, min(root) AS label FROM gr GROUP BY node),
gn AS (SELECT DISTINCT 0 AS side, q_id AS text_id, q_idx AS sent_idx, a AS node FROM ge UNION SELECT DISTINCT 1, c_id, c_idx, b FROM ge),
gp AS (SELECT label, side, text_id, sent_idx FROM gn JOIN gl USING (node)),
gg AS (SELECT label, min((text_id, sent_idx)) FILTER (WHERE side = 0) AS f, count(*) FILTER (WHERE side = 0) AS n_query, count(*) FILTER (WHERE side = 1) AS n_cand FROM gp GROUP BY label)
SELECT f[1]::BIGINT AS q_first, f[2]::INTEGER AS q_first_idx, side::INTEGER AS side, text_id::BIGINT AS text_id, sent_idx::INTEGER AS sent_idx, n_query, n_cand
FROM gp JOIN gg USING (label) WHERE n_query > 0 AND n_cand > 0"""
    E["explain_pairs"] = base + """,
ns AS (SELECT tid // 2 AS pair_id, count(*) FILTER (WHERE tid % 2 = 0) AS n_query_sents, count(*) FILTER (WHERE tid % 2 = 1) AS n_cand_sents FROM sents GROUP BY ALL),
nm AS (SELECT pair_id, count(*) AS n_matched FROM matched GROUP BY ALL),
nc AS (SELECT pair_id, count(*) AS n_components FROM comps GROUP BY ALL)
SELECT ns.pair_id, n_query_sents::BIGINT AS n_query_sents, n_cand_sents::BIGINT AS n_cand_sents,
  coalesce(n_matched, 0)::BIGINT AS n_matched, coalesce(n_components, 0)::BIGINT AS n_components
FROM ns LEFT JOIN nm USING (pair_id) LEFT JOIN nc USING (pair_id)"""
    return E
