"""DuckDB SQL for the operators that SQL can express, over whole tables and texts."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = r"'[^\x20\x09-\x0D]+'"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

JACCARD = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_SPACED}) AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i + 1 : i + 5], ' ') AS k FROM w, unnest(range(0, greatest(len(ws) - 4, least(len(ws), 1)))) AS u(i)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM reach r JOIN edge e ON e.a = r.b)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id FROM documents d LEFT JOIN n USING (doc_id)
JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1) c USING (doc_id)"""

LEAKS = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_ALNUM}) AS ws FROM documents),
q AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER}, {_ALNUM}) AS ws FROM benchmark),
phrase AS (SELECT DISTINCT item, least(len(ws), 10) AS n, array_to_string(ws[i + 1 : i + least(len(ws), 10)], ' ') AS k FROM q, unnest(range(0, greatest(len(ws) - 9, least(len(ws), 1)))) AS u(i)),
win AS (SELECT doc_id, i, s.n, array_to_string(ws[i + 1 : i + s.n], ' ') AS k FROM d, (SELECT DISTINCT n FROM phrase) s, unnest(range(0, greatest(len(ws) - s.n + 1, 0))) AS u(i)),
hit AS (SELECT w.doc_id, w.i, w.n, p.item FROM win w JOIN phrase p USING (n, k)),
word AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM hit, unnest(range(i, i + n)) AS u(j) GROUP BY 1),
item AS (SELECT doc_id, count(DISTINCT item) AS n_items, sha256(string_agg(DISTINCT item, ',' ORDER BY item)) AS h FROM hit GROUP BY 1)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(h, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN word USING (doc_id) LEFT JOIN item USING (doc_id)"""

SUBSTRINGS = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_SPACED}) AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i + 1 : i + 20], ' ') AS k FROM w, unnest(range(0, greatest(len(ws) - 19, 0))) AS u(i)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM win) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, j, true AS gone FROM later, unnest(range(i, i + 20)) AS u(j)),
word AS (SELECT doc_id, j, ws[j + 1] AS word FROM w, unnest(range(0, len(ws))) AS u(j))
SELECT w.doc_id, CAST(len(w.ws) AS BIGINT) AS n_words, CAST(coalesce(r.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(r.kept, '')) AS kept_sha256
FROM w LEFT JOIN (SELECT doc_id, count(gone) AS n, string_agg(word, ' ' ORDER BY j) FILTER (gone IS NULL) AS kept FROM word LEFT JOIN gone USING (doc_id, j) GROUP BY 1) r USING (doc_id)"""
