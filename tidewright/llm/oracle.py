"""DuckDB SQL for the queries that SQL can express; it states the contracts plainly, without the operators' methods."""

WARC = """
WITH p AS (
  SELECT page_id, url, sha256(coalesce(html, '')) AS payload_digest, strlen(coalesce(html, ''))::BIGINT AS payload_bytes
  FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS smallest FROM p
)
SELECT page_id, url, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id > smallest THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id > smallest THEN smallest END AS refers_to
FROM f
"""

WORD_REPEATS = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS win
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)
), first AS (
  SELECT win, min(doc_id) AS m FROM s GROUP BY win HAVING min(doc_id) < max(doc_id)
), hit AS (
  SELECT s.doc_id, s.i FROM s JOIN first USING (win) WHERE m < s.doc_id
), u AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d
), c AS (
  SELECT u.doc_id, u.i, u.word,
    max(h.i) OVER (PARTITION BY u.doc_id ORDER BY u.i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone
  FROM u LEFT JOIN hit h ON h.doc_id = u.doc_id AND h.i = u.i
), k AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept
  FROM c GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""

BYTE_REPEATS = """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), s AS (
  SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS win
  FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 49)) AS i FROM d WHERE len(h) >= 100)
), first AS (
  SELECT win, min(doc_id) AS m FROM s GROUP BY win HAVING min(doc_id) < max(doc_id)
), hit AS (
  SELECT s.doc_id, s.i FROM s JOIN first USING (win) WHERE m < s.doc_id
), u AS (
  SELECT doc_id, i, substr(h, 2 * i + 1, 2) AS byte FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2)) AS i FROM d)
), c AS (
  SELECT u.doc_id, u.i, u.byte,
    max(h.i) OVER (PARTITION BY u.doc_id ORDER BY u.i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone
  FROM u LEFT JOIN hit h ON h.doc_id = u.doc_id AND h.i = u.i
), b AS (
  SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS opens FROM c
), k AS (
  SELECT doc_id, count(*) AS n_bytes, count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_spans,
    string_agg(byte, '' ORDER BY i) FILTER (NOT gone) AS kept
  FROM b GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_bytes, 0)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""

NEAR_DUPLICATES = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END) AS shingle FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), same AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both
  FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2
), link AS (
  SELECT a, b FROM same JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * "both" >= 80 * (x.n + y.n - "both")
), edge AS (
  SELECT a, b FROM link UNION ALL SELECT b, a FROM link
), reach AS (
  SELECT a AS doc_id, a AS other FROM edge
  UNION
  SELECT r.doc_id, e.b FROM reach r JOIN edge e ON e.a = r.other
), c AS (
  SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id
)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.component_id, w.doc_id) AS component_id, w.doc_id = coalesce(c.component_id, w.doc_id) AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN c ON c.doc_id = w.doc_id
"""

ORACLE_SQL = {"op3_suffix_trees": WORD_REPEATS, "op6_warc": WARC, "op9_minhash": NEAR_DUPLICATES, "op10_suffix_sort": BYTE_REPEATS}
