"""DuckDB SQL for the queries that SQL can express, written without the operators' shortcuts."""

from __future__ import annotations

from pageframe.llm.sharding import SIZE, lookup_table

#: op6: all counts by exploded words and windows, references by plain grouping, distances bin by bin.
QUALITY = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, lang FROM documents),
w AS (SELECT r, lang, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM docs),
each AS (SELECT r, lang, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w),
wins AS (SELECT r, i, word || chr(1) || lead(word) OVER p || chr(1) || lead(word, 2) OVER p AS g FROM each WINDOW p AS (PARTITION BY r ORDER BY i)),
twice AS (SELECT r, g FROM wins WHERE g IS NOT NULL GROUP BY r, g HAVING count(*) > 1),
covered AS (SELECT r, count(DISTINCT i + d) AS n_repeat_words FROM (SELECT r, i FROM wins JOIN twice USING (r, g)), (SELECT unnest([0, 1, 2]) AS d) GROUP BY r),
lines AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM docs),
dups AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
per_lang AS (SELECT lang, count(*) AS total FROM each WHERE lang IS NOT NULL GROUP BY lang),
ref_lang AS (SELECT lang, total FROM per_lang WHERE total >= 2000),
counts AS (SELECT lang, lower(word) AS word, count(*) AS n FROM each JOIN ref_lang USING (lang) GROUP BY 1, 2),
ref AS (SELECT lang, word, n / total AS q FROM counts JOIN ref_lang USING (lang) WHERE n >= 0.004 * total),
langs AS (SELECT lang, sum(q) AS s FROM ref GROUP BY lang),
stats AS (
  SELECT r, doc_id, lang, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
    length(regexp_replace(text, '\P{Ll}+', '', 'g')) AS k1, length(regexp_replace(text, '[^\x20\x09-\x0D]+', '', 'g')) AS k2, length(regexp_replace(text, '[^\p{Lu}\p{Lt}]+', '', 'g')) AS k3,
    length(regexp_replace(text, '\P{Nd}+', '', 'g')) AS k4, length(regexp_replace(text, '[^.,;:?''()\-]+', '', 'g')) AS k5, length(regexp_replace(text, '[^\p{Lm}\p{Lo}\p{M}]+', '', 'g')) AS k6, length(text) AS total
  FROM docs JOIN (SELECT r, ws FROM w) USING (r)),
cls AS (SELECT r, total, unnest([1, 2, 3, 4, 5, 6, 7]) AS k, unnest([k1, k2, k3, k4, k5, k6, total - k1 - k2 - k3 - k4 - k5 - k6])::DOUBLE AS n FROM stats),
refcls AS (SELECT langs.lang, k, sum(n) / sum(sum(n)) OVER (PARTITION BY langs.lang) AS q FROM cls JOIN (SELECT r, lang FROM stats) USING (r) JOIN langs USING (lang) GROUP BY langs.lang, k),
js_c AS (SELECT r, lang, sqrt(greatest(sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) / 2 ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) / 2 ELSE 0 END), 0)) AS js_chars
  FROM (SELECT r, lang, n / total AS p, q FROM cls JOIN refcls USING (k) WHERE total > 0) GROUP BY r, lang),
hits AS (SELECT r, lower(word) AS word, count(*) AS n FROM each WHERE lower(word) IN (SELECT word FROM ref) GROUP BY 1, 2),
bins AS (SELECT r, ref.lang, n / n_words AS p, q FROM hits JOIN ref USING (word) JOIN (SELECT r, n_words FROM stats) USING (r)),
found AS (SELECT r, lang, sum(p) AS ps, sum(p * log2(2 * p / (p + q)) / 2 + q * log2(2 * q / (p + q)) / 2 - q / 2) AS js FROM bins GROUP BY r, lang),
rest AS (SELECT r, langs.lang, js, s, greatest(1 - coalesce(ps, 0), 0) AS po, greatest(1 - s, 0) AS qo FROM (SELECT r, n_words FROM stats) CROSS JOIN langs LEFT JOIN found USING (r, lang) WHERE n_words > 0),
js_w AS (SELECT r, lang, sqrt(greatest(coalesce(js, 0) + s / 2 + CASE WHEN po > 0 THEN po * log2(2 * po / (po + qo)) / 2 ELSE 0 END + CASE WHEN qo > 0 THEN qo * log2(2 * qo / (po + qo)) / 2 ELSE 0 END, 0)) AS js_words FROM rest),
near AS (SELECT r, min(row(greatest(js_chars - 0.30, js_words - 0.33), js_chars, js_words, lang)) AS x FROM js_c JOIN js_w USING (r, lang) GROUP BY r),
judged AS (
  SELECT doc_id, lang, n_words, word_chars, n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, x[2] AS js_chars, x[3] AS js_words, x[4] AS nearest_lang, total,
    n_words < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * n_words AS base_failed
  FROM stats LEFT JOIN dups USING (r) LEFT JOIN covered USING (r) LEFT JOIN near USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND (lang IS NOT NULL AND lang NOT IN (SELECT lang FROM langs) OR coalesce((total < 200 OR js_chars * js_chars <= 0.09 + 6.0 / total) AND (n_words < 50 OR js_words * js_words <= 0.1089 + 6.0 / n_words), true)) AS kept
FROM judged
"""

#: op5: digests by arithmetic on hexadecimal digits, five of which are four digits of base 32.
WARC = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, html, octet_length(encode(html)) AS payload_bytes, min(page_id) OVER (PARTITION BY html) AS first,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(h, (i // 4 * 5 + 1)::INTEGER, 5))::BIGINT >> (15 - 5 * (i % 4))::INTEGER) & 31) + 1)::INTEGER, 1)), 'string_agg', '') AS payload_digest FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM d
"""

#: op3: each mail quotes the turns before it, so its parent is the last turn that says what it quotes; threads by recursion.
QUOTES = r"""
WITH RECURSIVE m AS (SELECT conv_id, turn, role, replace(coalesce(text, ''), '>', ')') AS text FROM conversations),
q AS (SELECT *, CASE WHEN turn % 3 > 0 THEN lag(text) OVER w END AS q1, CASE WHEN turn % 3 = 2 THEN lag(text, 2) OVER w END AS q2 FROM m WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
x AS (SELECT conv_id, turn, unnest([text] || string_split_regex(text, '\n\s*\n') || string_split(text, chr(10))) AS x FROM m),
u AS (SELECT conv_id, turn, trim(regexp_replace(lower(x), '[\s\x{00a0}]+', ' ', 'g')) AS unit FROM x),
n AS (SELECT *, trim(regexp_replace(lower(q1), '[\s\x{00a0}]+', ' ', 'g')) AS n1, trim(regexp_replace(lower(q2), '[\s\x{00a0}]+', ' ', 'g')) AS n2 FROM q),
p1 AS (SELECT n.conv_id, n.turn, max(u.turn) AS p1 FROM n JOIN u ON u.conv_id = n.conv_id AND u.turn < n.turn AND u.unit = n1 AND n1 <> '' GROUP BY ALL),
p2 AS (SELECT n.conv_id, n.turn, max(u.turn) AS p2 FROM n JOIN u ON u.conv_id = n.conv_id AND u.turn < n.turn AND u.unit = n2 AND n2 <> '' GROUP BY ALL),
k AS (SELECT n.conv_id, n.turn, role, regexp_replace(text, '^\s+|\s+$', '', 'g') AS text, coalesce(p1, p2) AS parent_turn, (p1 IS NOT NULL)::BIGINT + (p2 IS NOT NULL)::BIGINT AS n_quotes, lpad((n.turn::HUGEINT + 9223372036854775808)::VARCHAR, 20, '0') AS step
  FROM n LEFT JOIN p1 ON p1.conv_id = n.conv_id AND p1.turn = n.turn LEFT JOIN p2 ON p2.conv_id = n.conv_id AND p2.turn = n.turn),
t AS (SELECT conv_id, turn, 1::BIGINT AS depth, step AS path FROM k WHERE parent_turn IS NULL UNION ALL SELECT k.conv_id, k.turn, depth + 1, path || '/' || step FROM t JOIN k ON k.conv_id = t.conv_id AND k.parent_turn = t.turn)
SELECT conv_id, turn, role, text, parent_turn, depth, path, n_quotes FROM k JOIN t USING (conv_id, turn)
"""

#: The unsigned CRC-32 of an ASCII text, bit by bit.
_CRC = "xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split({}, ''), lambda c: list_concat([ascii(c)::BIGINT], [-1, -1, -1, -1, -1, -1, -1, -1])))), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295)"


def _repair() -> str:
    """op12: each conversation row by row, with the cheapest prefix for each place in the pattern as (cost, edits, messages)."""
    kind = "STRUCT(c BIGINT, e VARCHAR, o VARCHAR)"
    edit = lambda x, cost, letter, said, when="true": f"CASE WHEN {x} IS NOT NULL AND {when} THEN {{'c': ({x}.c + {cost})::BIGINT, 'e': {x}.e || '{letter}', 'o': {x}.o || {said}}} END"
    least = lambda *xs: f"list_sort(list_filter([{', '.join(xs)}], lambda x: x IS NOT NULL))[1]"
    line = lambda role, text: f"chr(10) || {role} || ':' || {text}"
    insert = lambda x, role: edit(x, 3, "I", line(f"'{role}'", "''"))
    gone = lambda x: edit(x, 4, "D", "''")
    kept = lambda x, initial: edit(x, "3 * cut::INT", "K", line("role", "text"), f"NOT must AND role[1] = '{initial}'")
    changed = lambda x, role: edit(x, "3 + 3 * cut::INT", "R", line(f"'{role}'", "text"), "NOT must")
    opened = f"SELECT conv_id, i, s, p, u2 AS u, {least('a', insert('u2', 'assistant'))} AS a FROM (SELECT *, {least('u', insert('s', 'user'), insert('p', 'user'), insert('a', 'user'))} AS u2 FROM walk)"
    key = "coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')"
    return f"""
WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC.format('(' + key + ')')} % 20 AS fault FROM conversations),
d AS (SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role, CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM k, LATERAL (SELECT unnest(range(CASE fault WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)))),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM d),
n AS (SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS open, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) || role[1] AS two FROM r),
f AS (SELECT *, blank OR again AS must, NOT blank AND NOT again AND open AS cut FROM n),
walk AS (
  SELECT conv_id, 0::BIGINT AS i, {{'c': 0::BIGINT, 'e': '', 'o': ''}}::{kind} AS s, NULL::{kind} AS p, NULL::{kind} AS u, NULL::{kind} AS a FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT w.conv_id, f.i, {gone('s')}, {least(gone('p'), kept('s', 's'))}, {least(gone('u'), *[kept(x, 'u') for x in 'spa'], *[changed(x, 'user') for x in 'spa'])}, {least(gone('a'), kept('u', 'a'), changed('u', 'assistant'))}
  FROM ({opened}) w JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1),
ends AS (SELECT conv_id, {least('s', 'a')} AS x FROM ({opened}) QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank, count_if(NOT blank AND again) AS duplicate, count_if(cut) AS truncated, count_if(two NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
SELECT ends.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, x.c AS cost, x.e AS audit, sha256(x.o[2:]) AS repaired_sha256
FROM ends LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM ends.conv_id
"""


REPAIR = _repair()

#: op13: every prefix of every rebuilt conversation by a digest of its turns, and each node's least member's prefixes as its ancestors.
TRIE = f"""
WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM conversations WHERE conv_id IS NOT NULL),
h AS (SELECT c, c - c % 100 AS base, {_CRC.format('c::VARCHAR')} % 6 AS h FROM (SELECT DISTINCT c FROM t)),
b AS (SELECT h.c, i, role, text FROM h JOIN t ON t.c = base WHERE i <= h UNION ALL SELECT c, i, role, text FROM t JOIN h USING (c) WHERE i > h),
s AS (SELECT c, row_number() OVER w AS d, md5(string_agg(length(role) || ':' || length(text) || ':' || role || text, '') OVER w) AS k, length(text) AS n FROM b WINDOW w AS (PARTITION BY c ORDER BY i)),
p AS (SELECT c, d, k, lag(k, 1, '') OVER (PARTITION BY c ORDER BY d) AS above, n, d = max(d) OVER (PARTITION BY c) AS ends FROM s UNION ALL SELECT c, 0, '', NULL, 0, c NOT IN (SELECT c FROM s) FROM h),
g AS (SELECT k, any_value(d) AS d, any_value(above) AS above, any_value(n) AS n, min(c) AS c, count(*) AS n_convs, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256 FROM p GROUP BY k),
kids AS (SELECT above AS k, count(*) AS n FROM g WHERE above IS NOT NULL GROUP BY above),
sums AS (SELECT p.k, count_if(g.k NOT IN (SELECT k FROM kids)) AS n_leaves, sum((n_convs - 1) * g.n) AS saved FROM g JOIN p ON p.c = g.c AND p.d <= g.d GROUP BY p.k)
SELECT g.c AS conv_id, g.d AS depth, up.c AS parent_conv_id, g.n_convs, coalesce(kids.n, 0) AS n_children, n_leaves, saved::BIGINT AS saved_tokens, g.ends_sha256
FROM g LEFT JOIN g up ON up.k = g.above LEFT JOIN kids ON kids.k = g.k JOIN sums ON sums.k = g.k
"""


def sharding_sql() -> str:
    """op8: the first 60 bits of a key's MD5, modulo the table's size, and the shard that the table has there."""
    return f"""SELECT doc_id, slot::INTEGER AS slot, {lookup_table()}[slot + 1] AS shard FROM (SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % {SIZE} AS slot FROM documents)"""
