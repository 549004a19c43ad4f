"""DuckDB SQL for the operators that SQL can express, over whole tables; doc_id is taken to be unique there."""

from __future__ import annotations

import string

_LOW = f"translate({{}}, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
_SPACES = r"[\x20\x09-\x0D]+"
_TEXT = "coalesce(text, '')"

LINES = rf"""
WITH l AS (SELECT doc_id, unnest(string_split({_TEXT}, chr(10))) AS line, unnest(range(len(string_split({_TEXT}, chr(10))))) AS i FROM documents),
k AS (SELECT *, {_LOW.format(f"regexp_replace(regexp_replace(line, '^{_SPACES}', ''), '{_SPACES}$', '')")} AS line_key FROM l),
f AS (SELECT line_key, min(doc_id) AS m FROM k WHERE length(line_key) >= 10 GROUP BY 1),
t AS (SELECT k.*, coalesce(f.m < k.doc_id, false) AS gone FROM k LEFT JOIN f USING (line_key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM t GROUP BY 1"""

SUBSTRINGS = rf"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array({_TEXT}, '{_SPACES}'), lambda x: x <> '') AS ws FROM documents),
g AS (SELECT doc_id, i, md5(array_to_string(list_slice(ws, i, i + 12), ' ')) AS win FROM (SELECT *, unnest(range(1, len(ws) - 11)) AS i FROM w)),
f AS (SELECT win, min(doc_id) AS m FROM g GROUP BY 1),
hit AS (SELECT DISTINCT doc_id, p FROM (SELECT g.doc_id, unnest(range(i, i + 13)) AS p FROM g JOIN f USING (win) WHERE f.m < g.doc_id)),
each AS (SELECT e.doc_id, e.p, e.word, hit.p IS NOT NULL AS gone FROM (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w) e LEFT JOIN hit ON hit.doc_id = e.doc_id AND hit.p = e.p),
kept AS (SELECT doc_id, count(*) FILTER (gone) AS n, string_agg(word, ' ' ORDER BY p) FILTER (NOT gone) AS t FROM each GROUP BY 1)
SELECT w.doc_id, len(ws) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)"""

_WORDS = rf"regexp_extract_all({_LOW.format(_TEXT)}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
LEAKS = rf"""
WITH item AS (SELECT cast(item_id AS varchar) AS item, ws, least(10, len(ws)) AS n FROM (SELECT item_id, {_WORDS} AS ws FROM benchmark) WHERE len(ws) > 0),
win AS (SELECT DISTINCT item, n, array_to_string(list_slice(ws, i, i + n - 1), ' ') AS win FROM (SELECT *, unnest(range(1, len(ws) - n + 2)) AS i FROM item)),
doc AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
cut AS (SELECT doc_id, n, i, array_to_string(list_slice(ws, i, i + n - 1), ' ') AS win FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM doc, (SELECT DISTINCT n FROM win))),
met AS (SELECT doc_id, n, i, item FROM cut JOIN win USING (n, win)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM met) GROUP BY 1),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM met) GROUP BY 1)
SELECT doc.doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM doc LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)"""

NEAR = rf"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array({_LOW.format(_TEXT)}, '{_SPACES}'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, hash(a, b) AS h FROM (SELECT DISTINCT doc_id, ws[i] AS a, ws[i + 1] AS b FROM (SELECT doc_id, ws, unnest(range(1, greatest(2, len(ws)))) AS i FROM w WHERE len(ws) > 0))),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach(a, b) AS (SELECT a, b FROM edge UNION SELECT r.a, e.b FROM reach r JOIN edge e ON e.a = r.b),
least_ AS (SELECT a, min(b) AS m FROM reach GROUP BY 1)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(m, w.doc_id)) AS component_id, w.doc_id <= coalesce(m, w.doc_id) AS kept FROM w LEFT JOIN n USING (doc_id) LEFT JOIN least_ ON least_.a = w.doc_id"""

_SAYS = r"\### Assistant: </turn> ok"
_LONGER = r"(length({0}) + len(regexp_extract_all({0}, '\\|<turn>|<text>|</turn>')))"
CHAT = rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, {_TEXT} AS said FROM conversations UNION ALL SELECT -7, 0, 'user', '{_SAYS}' UNION ALL SELECT -7, 1, 'assistant', '{_SAYS}')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(concat(role, chr(10), said, chr(10)), '' ORDER BY turn, role, said)) AS turns_sha256,
  cast(sum(CASE WHEN role = 'assistant' THEN length(said) ELSE 0 END) AS bigint) AS loss_chars,
  sha256(coalesce(string_agg(said, '' ORDER BY turn, role, said) FILTER (role = 'assistant'), '')) AS loss_sha256,
  cast(sum({_LONGER.format('role')} + {_LONGER.format('said')} + 19) AS bigint) AS formatted_chars
FROM t GROUP BY 1"""


#: t is the table of the bytewise checksum, made from its polynomial; crc(x) needs it in scope.
_TABLE = "crc_table AS (SELECT list(c ORDER BY b) AS t FROM (SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c FROM range(256) r(b)))"
_BYTES = "list_transform(range(0, strlen({0})), lambda i: cast('0x' || substr(hex(encode({0})), cast(2 * i + 1 AS bigint), 2) AS bigint))"
_CRC = f"xor(list_reduce(list_prepend(4294967295, {_BYTES}), lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8)), 4294967295)"

RESAMPLING = rf"""
WITH {_TABLE},
d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
dw AS (SELECT doc_id, unnest(ws) AS w FROM d),
bw AS (SELECT unnest({_WORDS}) AS w FROM benchmark),
vocabulary AS (SELECT w, {_CRC.format('w')} % 10000 AS bucket FROM (SELECT w FROM dw UNION SELECT w FROM bw), crc_table),
s AS (SELECT bucket, count(*) AS n FROM dw JOIN vocabulary USING (w) GROUP BY 1),
t AS (SELECT bucket, count(*) AS n FROM bw JOIN vocabulary USING (w) GROUP BY 1),
gain AS (SELECT s.bucket, cast(floor(1000 * ln((cast(coalesce(t.n, 0) AS double) + 1) * ((SELECT count(*) FROM dw)::double + 10000) / ((s.n::double + 1) * ((SELECT count(*) FROM bw)::double + 10000)))) AS bigint) AS gain FROM s LEFT JOIN t USING (bucket)),
weighed AS (SELECT doc_id, count(*) AS n, cast(sum(gain) AS bigint) AS weight FROM dw JOIN vocabulary USING (w) JOIN gain USING (bucket) GROUP BY 1),
scored AS (SELECT d.doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + cast(floor(-1000 * ln(-ln((cast('0x' || substr(sha256('2024:' || d.doc_id), 1, 8) AS bigint) + 0.5::double) / 4294967296::double))) AS bigint) AS score FROM d LEFT JOIN weighed USING (doc_id)),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored WHERE n_features >= 20)
SELECT scored.*, rank FROM scored LEFT JOIN (SELECT * FROM ranked WHERE rank <= (SELECT count(*) * 10 // 100 FROM ranked)) USING (doc_id)"""

_BLANKS = r"\x20\x09-\x0D"
REPAIR = rf"""
WITH RECURSIVE {_TABLE},
raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(cast(conv_id AS varchar), ' ') || ':' || coalesce(cast(turn AS varchar), ' ') AS k FROM conversations),
kinds AS (SELECT k, {_CRC.format('k')} % 20 AS kind FROM (SELECT DISTINCT k FROM raw), crc_table),
damaged AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN kind = 0 THEN 0 WHEN kind = 3 THEN 2 ELSE 1 END)) FROM raw JOIN kinds USING (k)),
placed AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged),
row_ AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^{_BLANKS}]') THEN 'b' WHEN i > min(i) OVER (PARTITION BY conv_id, role, text) THEN 'd' WHEN NOT regexp_matches(text, '[.!?][{_BLANKS}]*$') THEN 't' ELSE '' END AS fault, substr(lag(role) OVER (PARTITION BY conv_id ORDER BY i), 1, 1) || substr(role, 1, 1) AS pair FROM placed),
ins(a, b, k) AS (VALUES (0, 0, 0), (1, 1, 0), (2, 2, 0), (3, 3, 0), (0, 2, 1), (0, 3, 2), (1, 2, 1), (1, 3, 2), (2, 3, 1), (3, 2, 1)),
step(a, b, initial) AS (VALUES (0, 1, 's'), (0, 2, 'u'), (1, 2, 'u'), (2, 3, 'a'), (3, 2, 'u')),
edits AS (
  SELECT conv_id, i, a, a AS b, 'D' AS edit, 2 AS price FROM row_, (SELECT DISTINCT a FROM ins)
  UNION ALL SELECT conv_id, i, a, b, 'K', CASE fault WHEN 't' THEN 5 ELSE 0 END FROM row_ JOIN step ON substr(role, 1, 1) = initial WHERE fault NOT IN ('b', 'd')
  UNION ALL SELECT conv_id, i, a, b, 'R', 1 + CASE fault WHEN 't' THEN 5 ELSE 0 END FROM row_, step WHERE initial <> 's' AND fault NOT IN ('b', 'd')),
layer(conv_id, i, state, best) AS (
  SELECT DISTINCT conv_id, cast(0 AS bigint), 0, '000000000' FROM conversations
  UNION ALL
  SELECT l.conv_id, l.i + 1, e.b, min(printf('%09d', cast(substr(best, 1, 9) AS integer) + 5 * k + price) || substr(best, 10) || repeat('I', k) || edit)
  FROM layer l JOIN ins ON ins.a = l.state JOIN edits e ON e.conv_id = l.conv_id AND e.i = l.i + 1 AND e.a = ins.b GROUP BY 1, 2, 3),
ended AS (SELECT l.conv_id, min(printf('%09d', cast(substr(best, 1, 9) AS integer) + 5 * k) || substr(best, 10) || repeat('I', k)) AS best
  FROM layer l JOIN (SELECT conv_id, max(i) AS n FROM layer GROUP BY 1) m ON m.conv_id = l.conv_id AND m.n = l.i JOIN ins ON ins.a = l.state WHERE ins.b IN (0, 3) GROUP BY 1),
edit AS (SELECT conv_id, j, e, sum(CASE WHEN e <> 'I' THEN 1 ELSE 0 END) OVER w AS i, sum(CASE WHEN e <> 'D' THEN 1 ELSE 0 END) OVER w AS o FROM (SELECT conv_id, unnest(string_split(substr(best, 10), '')) AS e, unnest(range(1, length(best) - 8)) AS j FROM ended WHERE length(best) > 9) WINDOW w AS (PARTITION BY conv_id ORDER BY j)),
fixed AS (SELECT edit.conv_id, j, e, o, r.role, r.text, first_value(CASE WHEN e = 'K' AND r.role[1] = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY edit.conv_id ORDER BY j) AS has_s FROM edit LEFT JOIN row_ r ON r.conv_id = edit.conv_id AND r.i = edit.i AND e <> 'I' WHERE e <> 'D'),
said AS (SELECT conv_id, string_agg(CASE WHEN e = 'K' THEN role WHEN (o - has_s) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY j) AS said FROM fixed GROUP BY 1),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (i > 1 AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM row_ GROUP BY 1)
SELECT ended.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, cast(substr(best, 1, 9) AS bigint) AS cost, substr(best, 10) AS audit, sha256(coalesce(said, '')) AS repaired_sha256
FROM ended LEFT JOIN counts USING (conv_id) LEFT JOIN said USING (conv_id)"""
