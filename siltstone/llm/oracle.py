"""DuckDB equivalents of the registered queries that SQL can express."""

from __future__ import annotations

GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORDS = f"[x FOR x IN regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{GAP}') IF x <> '']"

CONTAMINATION = f"""
WITH d AS (SELECT row_number() OVER () AS rn, doc_id, {WORDS} AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item_id, {WORDS} AS w FROM benchmark),
held AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 12], ' ') AS phrase, least(len(w), 13) AS n
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
win AS (SELECT DISTINCT phrase, n FROM held),
grams AS (SELECT rn, i, n, array_to_string(w[i:i + n - 1], ' ') AS phrase
  FROM (SELECT rn, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hits AS (SELECT rn, i, n, phrase FROM grams SEMI JOIN win USING (phrase, n)),
spots AS (SELECT rn, count(DISTINCT p) AS n_hit FROM (SELECT rn, unnest(range(i, i + n)) AS p FROM hits) GROUP BY rn),
named AS (SELECT rn, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
  FROM (SELECT DISTINCT rn, item_id FROM hits JOIN held USING (phrase, n)) GROUP BY rn),
terms AS (SELECT phrase, unnest(string_split(phrase, ' ')) AS term, unnest(range(0, n)) AS off FROM win),
tokens AS (SELECT rn, unnest(w) AS term, unnest(range(0, len(w))) AS pos FROM d),
counts AS (SELECT term, count(*) AS c FROM tokens SEMI JOIN terms USING (term) GROUP BY term),
ranked AS (SELECT t.*, c, row_number() OVER (PARTITION BY phrase ORDER BY c NULLS LAST, off) AS rk FROM terms t LEFT JOIN counts USING (term)),
rare AS (SELECT phrase, off, term, 1::BIGINT << (rk - 1) AS b FROM ranked WHERE rk <= 3 AND c IS NOT NULL),
starts AS (SELECT rn, phrase, pos - off AS start, bit_or(b) AS bits FROM tokens JOIN rare USING (term) WHERE pos - off >= -3 GROUP BY ALL),
steps AS (SELECT *, start - lag(start) OVER o AS apart, lag(bits) OVER o AS other FROM starts WINDOW o AS (PARTITION BY rn, phrase ORDER BY start)),
near AS (SELECT rn, count(DISTINCT phrase) AS n_near FROM steps ANTI JOIN hits USING (rn, phrase)
  WHERE bit_count(bits) > 1 OR (apart <= 3 AND bits <> other) GROUP BY rn)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated,
  coalesce(n_near, 0)::BIGINT AS n_near
FROM d LEFT JOIN spots USING (rn) LEFT JOIN named USING (rn) LEFT JOIN near USING (rn)
"""

ARCHIVE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
s AS (SELECT page_id, strlen(html) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM s WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first THEN first END AS refers_to
FROM s LEFT JOIN f USING (payload_digest)
"""

LINE_RUNS = r"""
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
lines AS (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS no FROM d),
s AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY no) AS upto
  FROM (SELECT *, len(regexp_extract_all(line, '[^ \t\n\x0B\f\r]+')) AS n FROM lines)),
spans AS (SELECT a.doc_id, a.no AS a, b.no AS b FROM s a JOIN s b ON a.doc_id = b.doc_id AND b.no >= a.no AND b.upto - a.upto + a.n >= 50),
units AS (SELECT doc_id, a, min(b) AS b FROM spans GROUP BY doc_id, a UNION SELECT doc_id, max(a), b FROM spans GROUP BY doc_id, b),
bodies AS (SELECT doc_id, a, b, array_to_string(l[a + 1:b + 1], chr(10)) AS body FROM units JOIN d USING (doc_id)),
firsts AS (SELECT body, min({'id': doc_id, 'a': a}) AS f FROM bodies GROUP BY body HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(CASE WHEN doc_id = f.id THEN greatest(a, f.a + b - a + 1) ELSE a END, b + 1)) AS no
  FROM bodies JOIN firsts USING (body) WHERE {'id': doc_id, 'a': a} > f),
runs AS (SELECT doc_id, min(no) AS f, max(no) + 1 AS e
  FROM (SELECT *, no - row_number() OVER (PARTITION BY doc_id ORDER BY no) AS island FROM gone) GROUP BY doc_id, island),
cut AS (SELECT doc_id, sum(e - f)::BIGINT AS n_deleted, string_agg(f || '-' || e, ',' ORDER BY f) AS deleted FROM runs GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY no) AS text FROM lines ANTI JOIN gone USING (doc_id, no) GROUP BY doc_id)
SELECT o.doc_id, coalesce(len(d.l), 0)::BIGINT AS n_lines, coalesce(n_deleted, 0)::BIGINT AS n_deleted, coalesce(deleted, '') AS deleted,
  CASE WHEN o.text IS NOT NULL THEN coalesce(kept.text, '') END AS text
FROM documents o LEFT JOIN d USING (doc_id) LEFT JOIN cut USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

ORACLE_SQL: dict[str, str] = {"op6_line_runs": LINE_RUNS, "op8_warc_archive": ARCHIVE, "op10_decontamination": CONTAMINATION}
