"""SQL for DuckDB of the corpus queries that SQL can express over whole tables."""

from __future__ import annotations

from .decontamination import WINDOW as ITEM_WINDOW
from .jaccard_join import DEN, NUM, SHINGLE
from .sharding import SQL as SHARDING
from .substring_dedup import WINDOW

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = r"'[^\x20\x09-\x0D]+'"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

JACCARD = f"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all({_LOWER}, {_SPACED}) w FROM documents
), s AS MATERIALIZED (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= {SHINGLE} THEN list_transform(range(1, len(w) - {SHINGLE - 2}), lambda i: array_to_string(w[i:i + {SHINGLE - 1}], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) g FROM d
), n AS MATERIALIZED (SELECT doc_id, count(*) n FROM s GROUP BY doc_id
), pairs AS MATERIALIZED (
  SELECT a.doc_id x, b.doc_id y, count(*) i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id
), links AS MATERIALIZED (
  SELECT x, y FROM pairs JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE {DEN} * i >= {NUM} * (p.n + q.n - i)
), sym AS MATERIALIZED (SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), c(doc_id, component_id) USING KEY (doc_id) AS (
  SELECT doc_id, doc_id FROM documents
  UNION (SELECT b.y, min(c.component_id) FROM c JOIN sym b ON b.x = c.doc_id JOIN recurring.c o ON o.doc_id = b.y WHERE c.component_id < o.component_id GROUP BY b.y)
)
SELECT c.doc_id, coalesce(n.n, 0)::BIGINT n_shingles, c.component_id FROM c LEFT JOIN n ON n.doc_id = c.doc_id
"""

SUBSTRINGS = f"""
WITH d AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_SPACED}) w FROM documents
), v AS MATERIALIZED (
  SELECT doc_id, unnest(range(1, len(w) - {WINDOW - 2})) i, unnest(list_transform(range(1, len(w) - {WINDOW - 2}), lambda i: array_to_string(w[i:i + {WINDOW - 1}], ' '))) g FROM d WHERE len(w) >= {WINDOW}
), gone AS MATERIALIZED (
  SELECT doc_id, list(DISTINCT i + k) p FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) own FROM v), range({WINDOW}) r(k) WHERE own < doc_id GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT n_words, coalesce(len(p), 0)::BIGINT n_removed,
  sha256(array_to_string(CASE WHEN p IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(p, i)) END, ' ')) kept_sha256
FROM d LEFT JOIN gone USING (doc_id)
"""

CONTAMINATION = f"""
WITH b AS MATERIALIZED (
  SELECT item_id::VARCHAR item, regexp_extract_all({_LOWER}, {_ALNUM}) w FROM benchmark WHERE item_id IS NOT NULL
), f AS MATERIALIZED (
  SELECT DISTINCT item, least(len(w), {ITEM_WINDOW}) n, unnest(list_transform(range(1, greatest(len(w) - {ITEM_WINDOW - 1}, 1) + 1), lambda i: array_to_string(w[i:i + {ITEM_WINDOW - 1}], ' '))) g FROM b WHERE len(w) > 0
), d AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all({_LOWER}, {_ALNUM}) w FROM documents
), v AS MATERIALIZED (
  SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) i, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) g FROM d, (SELECT DISTINCT n FROM f) WHERE len(w) >= n
), o AS MATERIALIZED (SELECT doc_id, v.n, i, item FROM v JOIN f ON f.n = v.n AND f.g = v.g
), hit AS (SELECT doc_id, count(DISTINCT p) n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) p FROM o) GROUP BY doc_id
), its AS (SELECT doc_id, count(DISTINCT item) n_items, string_agg(DISTINCT item, ',' ORDER BY item) items FROM o GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT n_words, coalesce(n_hit, 0)::BIGINT n_hit, coalesce(n_items, 0)::BIGINT n_items, sha256(coalesce(items, '')) items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""

SQL = {"op2_jaccard_join": JACCARD, "op3_substring_dedup": SUBSTRINGS, "op6_decontamination": CONTAMINATION, "op8_sharding": SHARDING}
