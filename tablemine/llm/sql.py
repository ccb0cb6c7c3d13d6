"""DuckDB counterparts of the queries that SQL can express."""

QUALITY_RULES = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM d WHERE len(w) >= 3),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM p),
c AS (SELECT doc_id, count(DISTINCT q) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS q FROM g WHERE n >= 2) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))::BIGINT
      - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))))::BIGINT AS n_dup_lines,
    coalesce(c.n_repeat_words, 0)::BIGINT AS n_repeat_words, len(regexp_extract_all(text, '\p{Lu}')) AS capitals
  FROM d LEFT JOIN c USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > n_words OR 10 * capitals > 3 * word_chars
    OR 10 * n_dup_lines > n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words) AS kept
FROM m
"""

MIX_SOURCES = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    substr(md5('42:' || coalesce(doc_id::VARCHAR, 'NULL')), 1, 15) AS h FROM documents),
s AS (SELECT source, sum(size)::DOUBLE AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight, 2 * source_size AS cap FROM s),
c AS (
  SELECT *, 1.5 * sum(source_size) OVER () AS budget,
    coalesce(sum(cap) OVER (ORDER BY cap / weight, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
    sum(weight) OVER (ORDER BY cap / weight, encode(source) NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS others FROM w),
l AS (SELECT max((budget - capped) / others) FILTER (WHERE (budget - capped) / others * weight <= cap) AS level FROM c),
t AS (SELECT source, source_size, least(cap, coalesce(level * weight, cap)) AS target FROM c, l),
g AS (SELECT source, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t),
e AS (
  SELECT d.*, g.source_size, g.target, whole, target - whole * g.source_size AS budget,
    sum(size) OVER (PARTITION BY d.source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum,
    sum(size) OVER (PARTITION BY d.source, h) AS same
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size::BIGINT AS source_size, target,
  (size * (whole + (budget > 0 AND (cum <= budget OR 2 * (budget - (cum - same)) >= same AND cum - same < budget))::INT))::BIGINT AS taken
FROM e
"""

CHAT_FORMAT = r"""
WITH t AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS position, count(*) OVER (PARTITION BY conv_id) AS n_turns
  FROM (SELECT DISTINCT conv_id, turn, role, text FROM conversations)),
l AS (SELECT conv_id, list({'r': role, 'x': text} ORDER BY position) AS turns FROM t GROUP BY conv_id),
p AS (SELECT DISTINCT list_slice(turns, 1, k) AS begun FROM (SELECT turns, unnest(range(1, len(turns))) AS k FROM l)),
w AS (SELECT min(conv_id) AS conv_id, turns FROM l GROUP BY turns),
k AS (SELECT w.conv_id FROM w LEFT JOIN p ON w.turns = p.begun WHERE p.begun IS NULL)
SELECT t.conv_id, turn, position, n_turns, role,
  '<|im_start|>' || replace(coalesce(role, ''), '<|', '< |') || chr(10) || replace(coalesce(text, ''), '<|', '< |') || '<|im_end|>' || chr(10) AS rendered
FROM t JOIN k ON t.conv_id IS NOT DISTINCT FROM k.conv_id
"""

# CRC-32 of the distinct words only: a table of 256 entries from the polynomial, then one step per byte.
RESAMPLE = r"""
WITH t8 AS (
  SELECT list(list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS tab
  FROM (SELECT unnest(range(256)) AS i)),
d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
dw AS (SELECT doc_id, unnest(w) AS word FROM d),
bw AS (SELECT unnest(w) AS word FROM b),
u AS (SELECT DISTINCT word FROM (SELECT word FROM dw UNION ALL SELECT word FROM bw)),
x AS (SELECT word, hex(encode(word)) AS hx, tab FROM u, t8),
c AS (
  SELECT word, xor(list_reduce(
    list_concat([4294967295], list_transform(range(0, length(hx), 2), lambda k: ('0x' || substr(hx, (k + 1)::INT, 2))::BIGINT)),
    lambda s, v: xor(s >> 8, tab[((xor(s, v) & 255) + 1)::INT])), 4294967295) % 10000 AS bucket
  FROM x),
s AS (SELECT bucket, count(*)::DOUBLE AS s FROM dw JOIN c USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*)::DOUBLE AS t FROM bw JOIN c USING (word) GROUP BY bucket),
n AS (SELECT (SELECT count(*) FROM dw)::DOUBLE AS s_all, (SELECT count(*) FROM bw)::DOUBLE AS t_all),
g AS (
  SELECT r.bucket, floor(1000 * ln((coalesce(t, 0) + 1) * (s_all + 10000) / ((coalesce(s, 0) + 1) * (t_all + 10000))))::BIGINT AS gain
  FROM (SELECT unnest(range(10000)) AS bucket) r LEFT JOIN s ON r.bucket = s.bucket LEFT JOIN t ON r.bucket = t.bucket, n),
m AS (SELECT doc_id, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM dw JOIN c USING (word) JOIN g USING (bucket) GROUP BY doc_id),
z AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(d.doc_id::VARCHAR, 'NULL')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score
  FROM d LEFT JOIN m ON d.doc_id IS NOT DISTINCT FROM m.doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS FIRST) AS p, count(*) FILTER (WHERE n_features >= 20) OVER () AS able FROM z)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND p <= floor(10 * able / 100) THEN p END::BIGINT AS rank FROM r
"""

CONVERSATION_TRIE = r"""
WITH t8 AS (
  SELECT list(list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS tab
  FROM (SELECT unnest(range(256)) AS i)),
o AS (
  SELECT conv_id, {'r': coalesce(role, ''), 'x': coalesce(text, '')} AS u,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS p
  FROM conversations),
l AS (SELECT conv_id, list(u ORDER BY p) AS t FROM o GROUP BY conv_id),
h AS (
  SELECT conv_id, t, xor(list_reduce(
    list_concat([4294967295], list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda k: ascii(substr(conv_id::VARCHAR, k::INT, 1))::BIGINT)),
    lambda s, v: xor(s >> 8, tab[((xor(s, v) & 255) + 1)::INT])), 4294967295) % 6 AS h
  FROM l, t8),
s AS (
  SELECT h.conv_id, list_concat(coalesce(list_slice(b.t, 1, h), []), list_slice(h.t, h + 1, len(h.t))) AS q
  FROM h LEFT JOIN l b ON b.conv_id = h.conv_id - h.conv_id % 100),
p AS (SELECT conv_id, q, unnest(range(0, len(q) + 1)) AS d FROM s),
n AS (
  SELECT list_slice(q, 1, d) AS seq, d, min(conv_id) AS conv_id, count(*) AS n_convs,
    coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE len(q) = d), '') AS ends
  FROM p GROUP BY 1, 2),
k AS (SELECT list_slice(seq, 1, d - 1) AS seq, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1),
m AS (SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN d > 0 THEN (n_convs - 1) * length(n.seq[d].x) ELSE 0 END AS own FROM n LEFT JOIN k ON n.seq = k.seq),
a AS (
  SELECT up AS seq, sum((n_children = 0)::BIGINT) AS n_leaves, sum(own) AS saved
  FROM (SELECT list_slice(seq, 1, k) AS up, n_children, own FROM (SELECT *, unnest(range(0, d + 1)) AS k FROM m)) GROUP BY 1)
SELECT m.conv_id, m.d AS depth, n.conv_id AS parent_conv_id, m.n_convs, m.n_children, n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(m.ends) AS ends_sha256
FROM m JOIN a ON m.seq = a.seq LEFT JOIN n ON m.d > 0 AND n.d = m.d - 1 AND n.seq = list_slice(m.seq, 1, m.d - 1)
"""
