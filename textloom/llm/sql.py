"""The contracts that SQL can state, for DuckDB: each by its definition alone, without any of the operators' methods."""

from __future__ import annotations

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_TOKENS = rf"regexp_extract_all({_LOW}, '[^\x20\x09-\x0D]+')"

#: Every run of words of a document as long as some window, against the windows of all items.
DECONTAMINATE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[k:k + 9], ' ') AS s FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM i WHERE len(w) > 0)),
runs AS (SELECT r, n, k, array_to_string(w[k:k + n - 1], ' ') AS s FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
met AS (SELECT r, k, runs.n, item_id FROM runs JOIN win ON runs.s = win.s AND runs.n = win.n),
hits AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS p FROM met) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS named FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM met) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(named, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hits ON d.r = hits.r LEFT JOIN items ON d.r = items.r
"""

#: Links by counting what two sets share; equal sets are linked to the first of them.
JACCARD = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_TOKENS} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] ELSE list_sort(list_distinct(list_transform(range(1, greatest(len(w) - 2, 1) + 1), lambda k: array_to_string(w[k:k + 2], ' ')))) END AS x FROM d),
c AS (SELECT doc_id, len(x) AS n, CASE WHEN len(x) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY x) END AS rep FROM s),
e AS (SELECT doc_id, n, unnest(x) AS g FROM (SELECT c.doc_id, n, x FROM c JOIN s ON c.doc_id = s.doc_id WHERE c.doc_id = rep)),
link AS (SELECT a.doc_id AS p, b.doc_id AS q FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
sides AS (SELECT p, q FROM link UNION ALL SELECT q, p FROM link),
reach AS (SELECT rep AS v, rep AS u FROM c WHERE doc_id = rep UNION SELECT reach.v, sides.q FROM reach JOIN sides ON reach.u = sides.p)
SELECT doc_id, n AS n_shingles, least(doc_id, low) AS component_id FROM c JOIN (SELECT v, min(u) AS low FROM reach GROUP BY v) ON rep = v
"""

#: Every string of 100 bytes by its first place; hexadecimal digits stand for bytes.
REPEATS = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
win AS (SELECT doc_id, k, md5_number(substr(h, 2 * k + 1, 200)) AS s FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 99)) AS k FROM d WHERE length(h) >= 200)),
again AS (SELECT doc_id, k FROM (SELECT doc_id, k, row_number() OVER (PARTITION BY s ORDER BY doc_id, k) AS t FROM win) WHERE t > 1),
b AS (SELECT doc_id, k, max(k) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM again),
run AS (SELECT doc_id, min(k) AS a, max(k) + 100 AS z FROM (SELECT *, sum(CASE WHEN before + 100 >= k THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY k) AS g FROM b) GROUP BY doc_id, g),
gap AS (SELECT doc_id, lag(z, 1, 0) OVER w AS a, a AS z, lead(a) OVER w IS NULL AS last, z AS end_ FROM run WINDOW w AS (PARTITION BY doc_id ORDER BY a)),
part AS (SELECT g.doc_id, g.a, substr(h, 2 * g.a + 1, 2 * (g.z - g.a)) || CASE WHEN last THEN substr(h, 2 * end_ + 1) ELSE '' END AS kept, end_ - g.z AS gone FROM gap g JOIN d ON g.doc_id = d.doc_id),
k AS (SELECT doc_id, CAST(sum(gone) AS BIGINT) AS n_removed, count(*) AS n_spans, string_agg(kept, '' ORDER BY a) AS kept FROM part GROUP BY doc_id)
SELECT d.doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""

ORACLE_SQL: dict[str, str] = {"op4_decontaminate": DECONTAMINATE, "op5_jaccard_join": JACCARD, "op9_remove_repeats": REPEATS}
