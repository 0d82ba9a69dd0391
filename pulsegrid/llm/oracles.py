"""SQL (DuckDB) with the results of those operators that SQL can express."""

from __future__ import annotations

from . import chat, quality

OP3 = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, n, list_aggregate(w[i:i + n - 1], 'string_agg', ' ') AS g
  FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, n, i, list_aggregate(w[i:i + n - 1], 'string_agg', ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, dw.n, i, item_id FROM dw JOIN bw USING (n, g)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hits) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP5 = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
g AS (SELECT html, max(page_id) AS last FROM p GROUP BY html),
d AS (SELECT p.*, last, sha1(encode(p.html)) AS hex FROM p JOIN g USING (html)),
bits AS (SELECT page_id, unnest(generate_series(0, 31)) AS k, hex FROM d),
digits AS (
  SELECT page_id, k, (CAST('0x' || substr(hex || '0000', CAST(k * 5 // 4 AS INT) + 1, 3) AS BIGINT) >> (7 - CAST(k * 5 % 4 AS INT))) & 31 AS v FROM bits),
names AS (SELECT page_id, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(v AS INT) + 1, 1), '' ORDER BY k) AS b32 FROM digits GROUP BY page_id)
SELECT d.page_id, url, CAST(strlen(html) AS BIGINT) AS payload_bytes, b32 AS payload_digest,
  CASE WHEN last > d.page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN last > d.page_id THEN last END AS refers_to
FROM d JOIN names USING (page_id)
"""


def text_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


OP6 = rf"""
WITH t AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT doc_id, lang, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS i FROM w WHERE len(w) > 2)),
r AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (
    SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1) GROUP BY 1),
m AS (
  SELECT doc_id, lang, len(w) AS n_words, list_sum(list_transform(w, lambda x: length(x))) AS chars, w,
    len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, length(t) AS size,
    len(regexp_extract_all(t, '[a-z]')) AS lower_n, len(regexp_extract_all(t, '[\x20\x09-\x0D]')) AS space_n, len(regexp_extract_all(t, '[A-Z]')) AS upper_n,
    len(regexp_extract_all(t, '[0-9]')) AS digit_n, len(regexp_extract_all(t, '[^\x00-\x7F]')) AS other_n
  FROM w LEFT JOIN r USING (doc_id)),
h AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    [lower_n, space_n, upper_n, digit_n, other_n, n_symbols, size - lower_n - space_n - upper_n - digit_n - other_n - n_symbols] AS ch FROM m),
names AS (SELECT unnest({text_list(quality.WORDS)}) AS name, unnest(generate_series(1, {len(quality.WORDS)})) AS k),
cw AS (SELECT doc_id, name, count(*) AS c FROM (SELECT doc_id, lower(unnest(w)) AS name FROM h) GROUP BY 1, 2),
wh AS (
  SELECT doc_id, k, c FROM (SELECT doc_id, k, name FROM h, names) LEFT JOIN cw USING (doc_id, name)
  UNION ALL SELECT doc_id, 0, n_words - coalesce((SELECT sum(c) FROM cw JOIN names USING (name) WHERE cw.doc_id = h.doc_id), 0) FROM h),
hist AS (
  SELECT doc_id, 'w' AS kind, k, coalesce(c, 0) AS c FROM wh
  UNION ALL SELECT doc_id, 'c', unnest(generate_series(1, 7)), unnest(ch) FROM h),
ref AS (
  SELECT lang AS ref, kind, k, sum(c) / sum(sum(c)) OVER (PARTITION BY lang, kind) AS q FROM hist JOIN h USING (doc_id)
  WHERE NOT base_failed AND lang IN ('de', 'en', 'es', 'fr') GROUP BY lang, kind, k),
shares AS (SELECT doc_id, kind, k, c / sum(c) OVER (PARTITION BY doc_id, kind) AS p FROM hist),
js AS (
  SELECT doc_id, kind, ref, sqrt(greatest(sum((CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END) + (CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END)) / 2, 0)) AS d
  FROM shares JOIN ref USING (kind, k) WHERE p IS NOT NULL AND NOT isnan(p) GROUP BY 1, 2, 3),
own AS (
  SELECT doc_id, kind, coalesce(max(d) FILTER (WHERE ref = lang), min(d)) AS d FROM js JOIN h USING (doc_id) GROUP BY 1, 2)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(coalesce(chars, 0) AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND NOT (coalesce(chars, 0) >= 200 AND coalesce(a.d, 0) > 0.28 OR n_words >= 100 AND coalesce(b.d, 0) > 0.345) AS kept,
  round(a.d, 6) AS char_distance, round(b.d, 6) AS word_distance
FROM h LEFT JOIN (SELECT * FROM own WHERE kind = 'c') a USING (doc_id) LEFT JOIN (SELECT * FROM own WHERE kind = 'w') b USING (doc_id)
"""

OP9 = f"""
WITH t AS (
  SELECT conv_id, list({{'turn': turn, 'role': coalesce(role, 'user'), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, 'user'), coalesce(text, '')) AS full_turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
n AS (SELECT greatest(1, count(*) // 256) AS parts FROM t),
u AS (SELECT conv_id, list_transform(full_turns, lambda x: {{'role': x.role, 'text': x.text}}) AS turns FROM t),
l AS (SELECT conv_id, turns, len(turns) - list_position(list_reverse(list_transform(turns, lambda x: x.role)), 'assistant') + 1 AS last FROM u
  WHERE list_contains(list_transform(turns, lambda x: x.role), 'assistant')),
a AS (SELECT conv_id, turns, last, turns[last] AS answer, CAST('0x' || substr(md5(CAST(conv_id AS VARCHAR)), 1, 8) AS BIGINT) % parts AS part FROM l, n),
o AS (
  SELECT *, coalesce(lead(conv_id) OVER w, first_value(conv_id) OVER w) AS partner_id, coalesce(lead(answer) OVER w, first_value(answer) OVER w) AS other
  FROM a WINDOW w AS (PARTITION BY part ORDER BY conv_id)),
p AS (SELECT conv_id AS pair_id, partner_id, turns[1:last] AS chosen, list_append(turns[1:last - 1], other) AS rejected,
  CASE WHEN answer = other THEN last ELSE last - 1 END AS n_prefix_turns FROM o),
r AS (
  SELECT pair_id, partner_id, CAST(n_prefix_turns AS BIGINT) AS n_prefix_turns,
    coalesce(list_aggregate(list_transform(chosen[1:n_prefix_turns], lambda x: '{chat.OPEN}' || x.role || chr(10) || x.text || '<|im_end|>' || chr(10)), 'string_agg', ''), '') AS prompt,
    chosen[n_prefix_turns + 1:] AS c, rejected[n_prefix_turns + 1:] AS r FROM p)
SELECT pair_id, partner_id, n_prefix_turns, prompt,
  coalesce(list_aggregate(list_transform(c, lambda x: '{chat.OPEN}' || x.role || chr(10) || x.text || '<|im_end|>' || chr(10)), 'string_agg', ''), '') AS chosen,
  coalesce(list_aggregate(list_transform(r, lambda x: '{chat.OPEN}' || x.role || chr(10) || x.text || '<|im_end|>' || chr(10)), 'string_agg', ''), '') AS rejected,
  list_transform(c, lambda x: {{'start': CAST({len(chat.OPEN)} + length(x.role) + 1 AS BIGINT), 'end': CAST({len(chat.OPEN)} + length(x.role) + 1 + length(x.text) + {len(chat.CLOSE)} AS BIGINT)}}) AS chosen_mask,
  list_transform(r, lambda x: {{'start': CAST({len(chat.OPEN)} + length(x.role) + 1 AS BIGINT), 'end': CAST({len(chat.OPEN)} + length(x.role) + 1 + length(x.text) + {len(chat.CLOSE)} AS BIGINT)}}) AS rejected_mask
FROM r
"""

OP11 = r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM documents
), w AS MATERIALIZED (SELECT doc, lang, source, unnest(words) AS term FROM d),
k AS MATERIALIZED (SELECT lang, term, count(*) AS total FROM w GROUP BY ALL HAVING count(DISTINCT doc) >= 3),
c AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL),
l AS (SELECT lang, count(*) AS v, sum(total) AS n FROM k GROUP BY lang),
g AS (SELECT lang, source, coalesce(sum(n), 0) AS n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS MATERIALIZED (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS used,
         CAST(1 + (1000000000 * CAST(coalesce(c.n, 0) + 1 AS HUGEINT)) // CAST(g.n + l.v AS HUGEINT) AS HUGEINT) AS p,
         CAST(1 + (1000000000 * CAST(k.total + 1 AS HUGEINT)) // CAST(l.n + l.v AS HUGEINT) AS HUGEINT) AS q
  FROM g JOIN l USING (lang) JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source != b.source GROUP BY ALL
), parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pairs.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source != b.source
  LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q)) // q FROM p WHERE used > 0 AND p > q
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
       CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM parts QUALIFY part = 'pair' OR rank <= 200
"""

OP12 = r"""
WITH r AS MATERIALIZED (
  SELECT row_number() OVER () AS uid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS MATERIALIZED (
  SELECT a.uid AS anchor, a.vec_id AS anchor_id, c.uid, c.vec_id, a.label = c.label AS same, CAST(list_dot_product(a.v, c.v) AS BIGINT) AS score
  FROM r a JOIN r c ON a.uid != c.uid AND a.vec_id % 50 = 0
), p AS (
  SELECT anchor, anchor_id, vec_id AS positive_id, score AS positive_score,
         row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id, uid) AS place
  FROM s WHERE same QUALIFY place <= 5
)
SELECT p.anchor_id, p.positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor, p.place ORDER BY s.score DESC, s.vec_id, s.uid) AS INTEGER) AS rank,
       s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor = p.anchor AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
QUALIFY rank <= 3
"""
