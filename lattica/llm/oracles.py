"""DuckDB SQL for the queries that SQL can express, over whole tables."""

from __future__ import annotations

_WORDS = r"'[^\x20\x09-\x0D]+'"
_REACH = """
  e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
  r AS (SELECT id AS node, id AS seen FROM ids UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.seen)"""

JACCARD = f"""WITH RECURSIVE
  ids AS (SELECT doc_id AS id FROM documents),
  d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_WORDS}) AS w FROM documents),
  s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM d, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS t(i) WHERE len(w) > 0),
  n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
  p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
  l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),{_REACH}
SELECT node AS doc_id, coalesce(max(n), 0) AS n_shingles, min(seen) AS component_id FROM r LEFT JOIN n ON n.doc_id = node GROUP BY node"""

EMBEDDINGS = f"""WITH RECURSIVE
  ids AS (SELECT vec_id AS id FROM embeddings),
  v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND len(list_filter(embedding, lambda y: y <> 0)) > 0),
  l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id < b.vec_id AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= 0.9),{_REACH},
  n AS (SELECT a, count(*) AS n FROM e GROUP BY 1)
SELECT node AS vec_id, coalesce(max(n), 0) AS n_links, min(seen) AS component_id, node = min(seen) AS kept FROM r LEFT JOIN n ON n.a = node GROUP BY node"""

QUALITY_RULES = rf"""WITH
  d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS w FROM documents),
  g AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g FROM d, unnest(range(1, len(w) - 3)) AS t(i)),
  twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
  rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(0, 5) AS t(k) GROUP BY 1),
  x AS (SELECT doc_id, x FROM d, unnest(string_split(t, chr(10))) AS t(x)),
  lines AS (SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT x) AS dup, count(*) FILTER (regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]')) AS bullets FROM x WHERE regexp_matches(x, {_WORDS}) GROUP BY 1),
  f AS (SELECT d.doc_id, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda y: length(y))), 0) AS BIGINT) AS word_chars,
      length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(lines.dup, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
      len(list_filter(w, lambda y: upper(y) = y AND lower(y) <> y)) AS n_upper, len(list_filter(w, lambda y: regexp_matches(y, '\pL'))) AS n_alpha,
      length(t) - length(replace(t, chr(10), '')) + 1 AS n_lines, coalesce(lines.n, 0) AS n_full, coalesce(lines.bullets, 0) AS bullets
    FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN lines USING (doc_id)),
  b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR NOT word_chars BETWEEN 2 * n_words AND 14 * n_words OR (n_dup_lines >= 3 AND 10 * n_dup_lines > 3 * n_lines)
    OR 100 * n_upper > 50 * n_words OR 100 * bullets > 90 * n_full OR 2 * n_alpha < n_words) AS kept
FROM b"""

ORACLE_SQL = {
    "op1_jaccard_join": JACCARD,
    "op5_embedding_dedup": EMBEDDINGS,
    "op9_quality_rules": QUALITY_RULES,
}
