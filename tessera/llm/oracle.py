"""DuckDB SQL of the training-data queries that SQL can express."""

from __future__ import annotations

SQL: dict[str, str] = {
    "op5_chat": r"""
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
e AS (SELECT *, md5(concat(coalesce(CAST(turn AS VARCHAR), 'null'), ' ', coalesce(md5(role), 'null'), ' ', coalesce(md5(text), 'null'))) AS h FROM t),
p AS (
  SELECT conv_id, string_agg(h, '') OVER w AS prefix, row_number() OVER w AS n, count(*) OVER (PARTITION BY conv_id) AS total
  FROM e WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, h ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
kept AS (
  SELECT min(conv_id) AS conv_id, count(*) AS copies FROM p
  WHERE n = total AND prefix NOT IN (SELECT prefix FROM p WHERE n < total) GROUP BY prefix)
SELECT t.conv_id, CAST(coalesce(floor(t.turn / 1024), -4503599627370496) AS BIGINT) AS segment, count(*) AS n_turns, any_value(copies) AS copies,
       string_agg(concat('<|', coalesce(role, 'unknown'), '|>\n', replace(coalesce(text, ''), '<|', '< |'), '<|end|>\n'), ''
                  ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS rendered
FROM t JOIN kept ON t.conv_id IS NOT DISTINCT FROM kept.conv_id GROUP BY ALL""".replace("\\n", "\n"),
    "op7_mixing": r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(concat(coalesce(CAST(doc_id AS VARCHAR), ''), '-mix-1')) AS key
  FROM documents),
per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight
  FROM sized GROUP BY source),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY source_size / weight, source ASC NULLS LAST) AS nth,
            (sum(source_size) OVER () * 1.5::DOUBLE
             - 2 * coalesce(sum(source_size) OVER (ORDER BY source_size / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY source_size / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM per),
goal AS (
  SELECT source, source_size, CAST(least(source_size * 2.0::DOUBLE,
           weight * arg_min(level, nth) FILTER (WHERE level <= 2 * source_size / weight) OVER ()) AS DOUBLE) AS target
  FROM ranked),
run AS (
  SELECT s.doc_id, s.size, g.source_size, g.target, CAST(floor(g.target) AS BIGINT) AS budget,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized s JOIN goal g ON s.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (budget // nullif(source_size, 0)) + greatest(0, least(size, budget - (budget // nullif(source_size, 0)) * source_size - before)) AS BIGINT) AS taken
FROM run""",
    "op9_topk": r"""
WITH v AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum([p[1] * p[2] FOR p IN list_zip(q.v, c.v)]) AS BIGINT) AS score
  FROM v q, v c WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5""",
    # crc32 runs over the digits' bytes: a byte enters by xor, each -1 after it is one of its eight bit steps.
    "op11_trie": r"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base, max(pos) AS n,
         xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten([[CAST(ascii(d) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1] FOR d IN string_split(CAST(conv_id AS VARCHAR), '')])),
           lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, CAST(3988292384 AS BIGINT) * (a & 1)) END), CAST(4294967295 AS BIGINT)) % 9 AS h
  FROM t GROUP BY conv_id),
b AS (SELECT c.*, least(c.h, coalesce(o.n, 0)) AS lent FROM c LEFT JOIN c o ON o.conv_id = c.base),
r AS (
  SELECT t.conv_id, t.pos - b.h + b.lent AS depth, role, text FROM t JOIN b USING (conv_id) WHERE t.pos > b.h
  UNION ALL SELECT b.conv_id, t.pos, role, text FROM b JOIN t ON t.conv_id = b.base WHERE t.pos <= b.h),
p AS (
  SELECT conv_id, depth, string_agg(concat(md5(role), md5(text)), '') OVER (PARTITION BY conv_id ORDER BY depth) AS prefix, strlen(text) AS bytes FROM r
  UNION ALL SELECT conv_id, 0, '', 0 FROM c),
l AS (SELECT conv_id, max(depth) AS len FROM p GROUP BY conv_id),
n AS (
  SELECT p.prefix, p.depth, min(p.conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(bytes) AS saved,
         sha256(coalesce(string_agg(CAST(p.conv_id AS VARCHAR), ',' ORDER BY p.conv_id) FILTER (WHERE l.len = p.depth), '')) AS ends_sha256
  FROM p JOIN l USING (conv_id) GROUP BY p.prefix, p.depth),
e AS (SELECT n.*, up.conv_id AS parent_conv_id FROM n LEFT JOIN n up ON n.depth > 0 AND up.depth = n.depth - 1 AND up.prefix = left(n.prefix, CAST(64 * (n.depth - 1) AS BIGINT))),
k AS (SELECT e.*, coalesce(x.n_children, 0) AS n_children FROM e LEFT JOIN (
  SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM e WHERE depth > 0 GROUP BY ALL) x ON x.conv_id = e.conv_id AND x.depth = e.depth)
SELECT a.conv_id, CAST(a.depth AS BIGINT) AS depth, any_value(a.parent_conv_id) AS parent_conv_id, any_value(a.n_convs) AS n_convs, any_value(a.n_children) AS n_children,
       count(*) FILTER (WHERE d.n_children = 0) AS n_leaves, CAST(sum(d.saved) AS BIGINT) AS saved_tokens, any_value(a.ends_sha256) AS ends_sha256
FROM k a JOIN k d ON d.depth >= a.depth AND left(d.prefix, CAST(64 * a.depth AS BIGINT)) = a.prefix
GROUP BY a.conv_id, a.depth""",
    "op12_negatives": r"""
WITH e AS (
  SELECT row_number() OVER () AS key, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT a.key, a.vec_id AS anchor_id, c.vec_id, c.label = a.label AS same, CAST(coalesce(list_sum([p[1] * p[2] FOR p IN list_zip(a.v, c.v)]), 0) AS BIGINT) AS score
  FROM e a JOIN e c ON a.key <> c.key WHERE a.vec_id % 50 = 0),
p AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, vec_id) AS n FROM s WHERE same),
r AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, s.vec_id AS negative_id, s.score AS negative_score,
         CAST(row_number() OVER (PARTITION BY p.key, p.n ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
  FROM p JOIN s ON s.key = p.key AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score WHERE p.n <= 5)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM r WHERE rank <= 3""",
}
