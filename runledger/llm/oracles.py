"""DuckDB SQL for the operators of this subpackage that SQL can express."""

#: Checksums come from the byte table of the polynomial, which the first two steps derive.
IMPORTANCE = r"""
WITH RECURSIVE bits AS (
  SELECT range::BIGINT AS b, range::BIGINT AS v, 0 AS step FROM range(256)
  UNION ALL SELECT b, CASE WHEN v & 1 = 1 THEN xor(3988292384, v >> 1) ELSE v >> 1 END, step + 1 FROM bits WHERE step < 8),
crc AS MATERIALIZED (SELECT list(v ORDER BY b) AS t FROM bits WHERE step = 8),
texts AS (SELECT 'd' AS side, row_number() OVER () AS row, doc_id, text FROM documents
  UNION ALL SELECT 'b', row_number() OVER (), NULL, text FROM benchmark),
words AS MATERIALIZED (SELECT side, row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
feats AS MATERIALIZED (SELECT side, row, f, count(*) AS c FROM (
  SELECT side, row, unnest(w) AS f FROM words
  UNION ALL SELECT side, row, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM words) GROUP BY ALL),
hashed AS MATERIALIZED (SELECT f, xor(4294967295, list_reduce(
    list_transform(range(1, length(x), 2), lambda i: (instr('0123456789ABCDEF', x[i]) - 1) * 16 + instr('0123456789ABCDEF', x[i + 1]) - 1),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295)) % 10000 AS bucket
  FROM (SELECT f, hex(encode(f)) AS x FROM (SELECT DISTINCT f FROM feats)), crc),
sums AS (SELECT bucket, sum(c) FILTER (side = 'd') AS s, sum(c) FILTER (side = 'b') AS t FROM feats JOIN hashed USING (f) GROUP BY bucket),
gains AS (SELECT bucket, floor(1000 * ln(((coalesce(t, 0) + 1) * (all_s + 10000))::DOUBLE / ((coalesce(s, 0) + 1) * (all_t + 10000))::DOUBLE))::BIGINT AS gain
  FROM sums, (SELECT coalesce(sum(s), 0) AS all_s, coalesce(sum(t), 0) AS all_t FROM sums)),
weights AS (SELECT row, sum(c)::BIGINT AS n_features, floor(sum(c * gain)::DOUBLE / sum(c)::DOUBLE)::BIGINT AS weight
  FROM feats JOIN hashed USING (f) JOIN gains USING (bucket) WHERE side = 'd' GROUP BY row),
scored AS (SELECT doc_id, len(w) >= 20 AS may, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('7:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM words LEFT JOIN weights USING (row) WHERE side = 'd'),
ranked AS (SELECT *, CASE WHEN may THEN row_number() OVER (PARTITION BY may ORDER BY score DESC, doc_id) END AS r,
  count(*) FILTER (may) OVER () * 25 // 100 AS room FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= room THEN r END AS rank FROM ranked"""

FILL_MIDDLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS s FROM documents),
k AS (SELECT doc_id, t, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
  ('0x' || s[1:8])::BIGINT AS h1, ('0x' || s[9:16])::BIGINT AS h2, ('0x' || s[17:24])::BIGINT AS h3, ('0x' || s[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT doc_id, t, len(u) AS n, h1 % (len(u) + 1) AS x, h2 % (len(u) + 1) AS y, u,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain'
    WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM k),
p AS (SELECT doc_id, t, n, form, array_to_string(u[1:least(x, y)], '') AS pre, array_to_string(u[least(x, y) + 1:greatest(x, y)], '') AS mid,
  array_to_string(u[greatest(x, y) + 1:], '') AS suf FROM c),
o AS (SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
  ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END AS output FROM p),
b AS (SELECT *, CASE form WHEN 'plain' THEN output
  WHEN 'psm' THEN regexp_extract(output, '^<P>((?s:.*))<S>((?s:.*))<M>((?s:.*))$', 1) || regexp_extract(output, '^<P>((?s:.*))<S>((?s:.*))<M>((?s:.*))$', 3)
    || regexp_extract(output, '^<P>((?s:.*))<S>((?s:.*))<M>((?s:.*))$', 2)
  ELSE regexp_extract(output, '^<S>((?s:.*))<P>((?s:.*))<M>((?s:.*))$', 2) || regexp_extract(output, '^<S>((?s:.*))<P>((?s:.*))<M>((?s:.*))$', 3)
    || regexp_extract(output, '^<S>((?s:.*))<P>((?s:.*))<M>((?s:.*))$', 1) END AS back FROM o)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(output) AS output_sha256, sha256(back) AS restored_sha256 FROM b"""
