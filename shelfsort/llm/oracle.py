"""DuckDB SQL of the corpus operators that SQL can express."""
from __future__ import annotations

OP1 = r"""
WITH n AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256,
         length(coalesce(text, '')) AS cp
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, text_sha256
FROM n WINDOW w AS (PARTITION BY text_sha256 ORDER BY cp DESC, doc_id)
"""

MIX = r"""
WITH sizes AS (
  SELECT coalesce(source, chr(1) || 'null') AS k, count(*) AS n, pow(count(*)::DOUBLE, 0.5) AS w FROM docs GROUP BY 1),
rates AS (
  SELECT k, w / (SELECT sum(w ORDER BY k) FROM sizes) * (SELECT sum(n) FROM sizes)::DOUBLE / n AS rate FROM sizes),
laws AS (
  SELECT k, rate, greatest(1, ceil(rate / 16.0))::INT AS parts, rate / greatest(1, ceil(rate / 16.0)) AS lam FROM rates),
cdfs AS (
  WITH RECURSIVE t AS (
    SELECT k, lam, 0 AS i, exp(-lam) AS p, exp(-lam) AS s FROM laws
    UNION ALL
    SELECT k, lam, i + 1, p * lam / (i + 1), s + p * lam / (i + 1) FROM t WHERE i < 40 + ceil(lam * 8))
  SELECT k, list(s ORDER BY i) AS cdf FROM t GROUP BY k),
drawn AS (
  SELECT d.*, list_sum(list_transform(range(1, parts + 1), lambda j: len(list_filter(cdf, lambda c: c <=
    ('0x' || substr(md5('mix17:' || coalesce(doc_id::VARCHAR, 'null') || ':' || j::VARCHAR), 1, 13))::UBIGINT::DOUBLE / 4503599627370496.0))))::INT AS times
  FROM docs d JOIN laws ON laws.k = coalesce(d.source, chr(1) || 'null') JOIN cdfs ON cdfs.k = laws.k)
SELECT * EXCLUDE (times, copy), copy::INT AS copy,
       md5('order17:' || coalesce(doc_id::VARCHAR, 'null') || ':' || copy::VARCHAR) AS mix_order
FROM (SELECT *, unnest(range(times)) AS copy FROM drawn)
"""

OP2 = "WITH docs AS (SELECT * FROM documents) " + MIX.strip().replace("WITH sizes", ", sizes", 1)

OP8 = r"""
WITH dw AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
iw AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[s:s + 12], ' ') AS span
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS s FROM iw WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win),
firsts AS (SELECT DISTINCT n, split_part(span, ' ', 1) AS first FROM win),
places AS (
  SELECT doc_id, generate_subscripts(w, 1) AS s, unnest(w) AS word FROM dw),
starts AS (
  SELECT doc_id, s, word, list(word) OVER (PARTITION BY doc_id ORDER BY s ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS ahead
  FROM places),
hits AS (
  SELECT st.doc_id, st.s, win.n, win.item_id
  FROM starts st JOIN firsts f ON f.first = st.word AND len(st.ahead) >= f.n
  JOIN win ON win.n = f.n AND win.span = array_to_string(st.ahead[1:f.n], ' ')),
per AS (
  SELECT h.doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hits) h GROUP BY 1),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hits) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN per USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP9 = r"""
WITH l AS (
  SELECT doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos,
         unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
k AS (
  SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
common AS (
  SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
f AS (SELECT k.*, common.key IS NOT NULL AS gone FROM k LEFT JOIN common USING (key))
SELECT doc_id, count(*) AS n_lines, sum(gone::INT)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM f GROUP BY doc_id
"""

OP4 = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha1(html) AS h FROM p),
b AS (
  SELECT *, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 +
      ((('0x' || substr(h, (1 + 10 * (i // 8))::INT, 10))::UBIGINT >> (35 - 5 * (i % 8))::UBIGINT) & 31::UBIGINT)::INT, 1)), '') AS payload_digest
  FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = min(page_id) OVER w THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> min(page_id) OVER w THEN min(page_id) OVER w END AS refers_to
FROM b WINDOW w AS (PARTITION BY h)
"""

OP6 = r"""
WITH RECURSIVE dw AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE
         list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
  FROM dw WHERE len(w) > 0),
classes AS (  -- equal sets first, so that no text meets all its copies
  SELECT min(doc_id) AS rep, any_value(list_sort(s)) AS s, len(any_value(s)) AS n FROM sets GROUP BY md5(array_to_string(list_sort(s), chr(10)))),
classof AS (
  SELECT doc_id, min(doc_id) OVER (PARTITION BY md5(array_to_string(list_sort(s), chr(10)))) AS rep, len(s) AS n FROM sets),
tok AS (SELECT rep, n, md5_number_lower(unnest(s)) AS t FROM classes),
multi AS (SELECT t FROM tok GROUP BY t HAVING count(*) > 1),
pairs AS (
  SELECT a.rep AS a, b.rep AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS inter
  FROM (SELECT * FROM tok SEMI JOIN multi USING (t)) a JOIN (SELECT * FROM tok SEMI JOIN multi USING (t)) b
    ON a.t = b.t AND a.rep < b.rep AND a.n * 4 >= b.n * 3 AND b.n * 4 >= a.n * 3 GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs WHERE 100 * inter >= 75 * (na + nb - inter)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(node, low) AS (
  SELECT rep, rep FROM classes
  UNION
  SELECT e.b, r.low FROM reach r JOIN edges e ON e.a = r.node WHERE r.low < e.b),
comp AS (SELECT node, min(low) AS component FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(c.n, 0)::BIGINT AS n_shingles, coalesce(comp.component, d.doc_id) AS component_id
FROM documents d LEFT JOIN classof c ON c.doc_id = d.doc_id LEFT JOIN comp ON comp.node = c.rep
"""

ORACLE_SQL = {"op1_exact_dedup": OP1, "op2_mixing": OP2, "op4_warc": OP4, "op6_ngram_jaccard_join": OP6,
              "op8_benchmark_decontamination": OP8, "op9_line_dedup": OP9}
