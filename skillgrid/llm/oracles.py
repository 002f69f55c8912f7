"""DuckDB SQL for the operators that SQL can express on whole tables."""

from __future__ import annotations

LINE_DEDUP = r"""
WITH lines AS (
  SELECT doc_id, unnest(generate_series(1, len(string_split(text, chr(10))))) AS line, string_split(text, chr(10)) AS parts
  FROM documents WHERE text IS NOT NULL
), solid AS (
  SELECT doc_id, line, trim(regexp_replace(parts[line], '\s+$', ''), ' ') AS body FROM lines
), ranked AS (
  SELECT doc_id, line, body, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS pos FROM solid WHERE body <> ''
), alike AS (  -- every line with every earlier equal one
  SELECT a.doc_id, a.pos, b.doc_id AS other, a.pos - b.pos AS shift
  FROM ranked a JOIN ranked b ON a.body = b.body AND (b.doc_id, b.pos) < (a.doc_id, a.pos)
), islands AS (  -- those that follow each other in both documents
  SELECT *, pos - row_number() OVER (PARTITION BY doc_id, other, shift ORDER BY pos) AS island FROM alike
), ends AS (
  SELECT doc_id, pos, max(pos) OVER (PARTITION BY doc_id, other, shift, island) + 1 AS stop FROM islands
), longest AS (
  SELECT doc_id, pos, max(stop) AS stop FROM ends GROUP BY 1, 2
), runs AS (
  SELECT l.doc_id, l.pos, l.stop FROM longest l JOIN ranked r USING (doc_id, pos)
  WHERE l.stop - l.pos >= 2 OR len(regexp_split_to_array(r.body, '\s+')) >= 20
), counted AS (
  SELECT doc_id, count(*) FILTER (lag_pos IS DISTINCT FROM pos - 1 OR lag_stop <> stop) AS n_runs, max(stop - pos) AS longest_run
  FROM (SELECT *, lag(pos) OVER w AS lag_pos, lag(stop) OVER w AS lag_stop FROM runs WINDOW w AS (PARTITION BY doc_id ORDER BY pos)) GROUP BY 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(generate_series(pos, stop - 1)) AS pos FROM runs
), flagged AS (
  SELECT s.doc_id, s.line, l.parts[s.line] AS raw, r.pos IS NOT NULL AS counted, g.pos IS NOT NULL AS removed
  FROM solid s JOIN lines l ON l.doc_id = s.doc_id AND l.line = s.line
  LEFT JOIN ranked r ON r.doc_id = s.doc_id AND r.line = s.line
  LEFT JOIN gone g ON g.doc_id = r.doc_id AND g.pos = r.pos
), done AS (
  SELECT doc_id, count(*) FILTER (counted) AS n_lines, count(*) FILTER (removed) AS n_removed,
         sha256(coalesce(string_agg(raw, chr(10) ORDER BY line) FILTER (NOT removed), '')) AS kept_sha256
  FROM flagged GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(n_runs, 0) AS n_runs, coalesce(longest_run, 0) AS longest_run, kept_sha256
FROM documents d LEFT JOIN done USING (doc_id) LEFT JOIN counted USING (doc_id)
"""

SUBSTRING_DEDUP = r"""
WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), windows AS (
  SELECT doc_id, unnest(generate_series(1, len(w) - 19)) AS start, w FROM words WHERE len(w) >= 20
), keyed AS (
  SELECT doc_id, start, md5(array_to_string(w[start:start + 19], ' ')) AS body FROM windows
), late AS (
  SELECT doc_id, start FROM (SELECT doc_id, start, row_number() OVER (PARTITION BY body ORDER BY doc_id, start) AS copy FROM keyed) WHERE copy > 1
), gone AS (
  SELECT DISTINCT doc_id, start + k AS pos FROM late, (SELECT unnest(generate_series(0, 19)) AS k)
), places AS (
  SELECT doc_id, list(pos) AS pos FROM gone GROUP BY doc_id
), kept AS (
  SELECT p.doc_id, string_agg(w[i], ' ' ORDER BY i) AS text FROM (
    SELECT words.doc_id, w, unnest(generate_series(1, len(w))) AS i FROM words JOIN places USING (doc_id)) p
  WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = p.doc_id AND g.pos = p.i) GROUP BY p.doc_id
)
SELECT words.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(places.pos), 0) AS BIGINT) AS n_removed,
       sha256(CASE WHEN places.pos IS NULL THEN array_to_string(w, ' ') ELSE coalesce(kept.text, '') END) AS kept_sha256
FROM words LEFT JOIN places USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

COVER_TREE = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), u AS (
  SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS norm FROM v WHERE list_dot_product(e, e) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) >= 0.9 * a.norm * b.norm
), reach AS (
  SELECT vec_id AS node, vec_id AS other FROM embeddings UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.other
), comp AS (SELECT node, min(other) AS component_id FROM reach GROUP BY node)
SELECT e.vec_id, coalesce(n, 0) AS n_links, component_id, component_id = e.vec_id AS kept
FROM embeddings e LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) ON a = e.vec_id JOIN comp ON comp.node = e.vec_id
"""


SOURCE_DIVERGENCE = r"""
WITH docs AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
), tokens AS (
  SELECT row, lang, source, unnest(terms) AS term FROM docs
), kept AS (
  SELECT lang, term, count(*) AS lang_count FROM tokens GROUP BY 1, 2 HAVING count(DISTINCT row) >= 3
), kinds AS (
  SELECT lang, count(*) AS kinds, sum(lang_count)::HUGEINT AS lang_total FROM kept GROUP BY 1
), groups AS (
  SELECT DISTINCT lang, source FROM docs
), here AS (
  SELECT lang, source, term, count(*) AS n FROM tokens JOIN kept USING (lang, term) GROUP BY 1, 2, 3
), totals AS (
  SELECT lang, source, sum(n)::HUGEINT AS total FROM here GROUP BY 1, 2
), dense AS (  -- every group with every kept term
  SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n, lang_count, 1 + (1000000000::HUGEINT * (coalesce(n, 0) + 1)) // (coalesce(total, 0) + kinds) AS p,
         1 + (1000000000::HUGEINT * (lang_count + 1)) // (lang_total + kinds) AS q
  FROM groups g JOIN kept k USING (lang) JOIN kinds USING (lang) LEFT JOIN totals USING (lang, source) LEFT JOIN here h ON h.lang = g.lang AND h.source = g.source AND h.term = k.term
), sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
), words AS (
  SELECT lang, source, 'term' AS part, term AS item, CAST(((p - q) * (p - q)) // q AS BIGINT) AS value FROM dense WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM words)
)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 200
"""


def oracle_sql() -> dict[str, str]:
    return {"op13_source_divergence": SOURCE_DIVERGENCE, "op2_line_dedup": LINE_DEDUP, "op6_cover_tree": COVER_TREE, "op7_substring_dedup": SUBSTRING_DEDUP}
