"""DuckDB SQL of those ``opN_*`` queries that SQL can express."""

from __future__ import annotations

from abundance.llm.licenses import TEMPLATES, THRESHOLD
from abundance.llm.quality import RULES

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LICENCE_WORDS = "regexp_extract_all(lower({t}), '[a-z0-9]+')"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


OP10 = rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
items AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
wins AS (SELECT DISTINCT item_id, least(len(ws), 13) AS n, array_to_string(ws[i:i + least(len(ws), 13) - 1], ' ') AS win
    FROM (SELECT *, unnest(range(1, greatest(len(ws) - 13, 0) + 2)) AS i FROM items WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM wins),
spots AS (SELECT r, i, n, array_to_string(ws[i:i + n - 1], ' ') AS win
    FROM (SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM docs JOIN sizes ON len(ws) >= n)),
hits AS (SELECT s.r, s.i, s.n, w.item_id FROM spots s JOIN wins w ON s.win = w.win AND s.n = w.n),
covered AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r),
found AS (SELECT r, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS ids FROM hits WHERE item_id IS NOT NULL GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(len(ids), 0) AS BIGINT) AS n_items,
  sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM docs LEFT JOIN covered USING (r) LEFT JOIN found USING (r)"""

OP8 = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
spots AS (SELECT r, i, md5(array_to_string(ws[i:i + 34], ' ')) AS win FROM (SELECT r, ws, unnest(range(1, len(ws) - 33)) AS i FROM docs WHERE len(ws) >= 35)),
twice AS (SELECT win FROM spots GROUP BY win HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS p FROM spots JOIN twice USING (win)),
words AS (SELECT r, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS p FROM docs),
kept AS (SELECT r, string_agg(w, ' ' ORDER BY p) AS t, count(*) AS n FROM words ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (r)"""

# Base 32: five hexadecimal digits are four letters.
OP5 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
b AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first_id,
    array_to_string(list_transform(range(0, 8), lambda k: CAST('0x' || substr(h, CAST(k * 5 + 1 AS INTEGER), 5) AS INTEGER)), ',') AS fives FROM p),
c AS (SELECT *, list_transform(string_split(fives, ','), lambda v: CAST(v AS INTEGER)) AS vs, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567' AS letters FROM b)
SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(vs, lambda v: substr(letters, ((v >> 15) & 31) + 1, 1) || substr(letters, ((v >> 10) & 31) + 1, 1)
    || substr(letters, ((v >> 5) & 31) + 1, 1) || substr(letters, (v & 31) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS NOT DISTINCT FROM first_id THEN NULL ELSE first_id END AS refers_to
FROM c"""

GRAMS = "list_distinct(list_transform(range(1, len({w})), lambda i: {w}[i] || ' ' || {w}[i + 1]))"
OP6 = f"""
WITH known AS (SELECT license, {GRAMS.format(w='w')} AS g FROM (SELECT license, {LICENCE_WORDS.format(t='t')} AS w FROM (VALUES
    {", ".join(f"({quoted(n)}, {quoted(t)})" for n, t in sorted(TEMPLATES.items()))}) v(license, t))),
docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
parts AS (SELECT r, unnest(string_split(regexp_replace(t, '\\n[ \\t\\r]*\\n\\s*', chr(10), 'g'), chr(10))) AS t, 0 AS unit FROM docs
    UNION ALL SELECT r, unnest(regexp_split_to_array(t, '\\n[ \\t\\r]*\\n\\s*')), 1 FROM docs WHERE regexp_matches(t, '\\n[ \\t\\r]*\\n')
    UNION ALL SELECT r, t, 2 FROM docs WHERE contains(regexp_replace(t, '\\n[ \\t\\r]*\\n\\s*', chr(10), 'g'), chr(10))),
pieces AS (SELECT row_number() OVER () AS piece, r, {GRAMS.format(w='w')} AS g FROM (SELECT r, {LICENCE_WORDS.format(t='t')} AS w FROM parts)),
pairs AS (SELECT piece, r, license, 2.0 * len(list_intersect(p.g, k.g)) / (len(p.g) + len(k.g)) AS score FROM pieces p JOIN known k
    ON len(p.g) BETWEEN len(k.g) * {THRESHOLD} / (2 - {THRESHOLD}) AND len(k.g) * (2 - {THRESHOLD}) / {THRESHOLD}),
best AS (SELECT r, piece, max(score) AS score,
    arg_min(license, (-score, license)) AS license FROM pairs GROUP BY r, piece HAVING max(score) >= {THRESHOLD} - 1e-12),
top AS (SELECT r, arg_min(license, (-score, license)) AS license, max(score) AS score, count(*) AS n FROM best GROUP BY r)
SELECT doc_id, license, ROUND(score, 6) AS license_score, CAST(coalesce(n, 0) AS BIGINT) AS n_licenses FROM docs LEFT JOIN top USING (r)"""

VOTES = range(len(RULES))
EM_SCORE = "ln(prior / (1 - prior)) + " + " + ".join(f"v{j} * ln(a{j} / (1 - a{j}))" for j in VOTES)
OP3 = rf"""
WITH RECURSIVE docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
lines AS (SELECT r, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM docs),
tri AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM docs WHERE len(ws) >= 3)),
again AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 3)) AS p FROM tri SEMI JOIN
    (SELECT r, g FROM tri GROUP BY r, g HAVING count(*) > 1) USING (r, g)) GROUP BY r),
counted AS (SELECT doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols,
    len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
    FROM docs JOIN lines USING (r) LEFT JOIN again USING (r)),
voted AS (SELECT *, {", ".join(f"CASE WHEN {x.poor} THEN -1 WHEN {x.good} THEN 1 ELSE 0 END AS v{j}" for j, x in enumerate(RULES))} FROM counted),
patterns AS (SELECT {", ".join(f"v{j}" for j in VOTES)}, count(*) AS n FROM voted GROUP BY ALL),
em AS (SELECT 0 AS k, CAST(0.7 AS DOUBLE) AS prior, {", ".join(f"CAST(0.8 AS DOUBLE) AS a{j}" for j in VOTES)}
    UNION ALL SELECT k + 1, least(0.95, greatest(0.05, (sum(n * p) + 1) / (sum(n) + 2))),
    {", ".join(f"least(0.99, greatest(0.55, (sum(CASE v{j} WHEN 1 THEN n * p WHEN -1 THEN n * (1 - p) ELSE 0 END) + 1) / (sum(CASE WHEN v{j} <> 0 THEN n ELSE 0 END) + 2)))" for j in VOTES)}
    FROM (SELECT *, 1 / (1 + exp(-({EM_SCORE}))) AS p FROM em, patterns WHERE k < 200) GROUP BY k),
judged AS (SELECT voted.*, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, 1 / (1 + exp(-({EM_SCORE}))) AS q FROM voted, em WHERE k = 200)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND q >= 0.5 AS kept, ROUND(q, 6) AS quality FROM judged"""

# The turns' lines hold no quote marks of their own, so the quotes of the
# derived mail are the lines of the two turns before.
OP4 = r"""
WITH RECURSIVE t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
key AS (SELECT conv_id, turn, min(text) AS text FROM conversations GROUP BY ALL),
own AS (SELECT *, sum(CASE WHEN l = '' THEN 1 ELSE 0 END) OVER (PARTITION BY m ORDER BY i) AS part FROM (
    SELECT m, conv_id, turn, i, trim(regexp_replace(lower(ls[i]), '[ \t-\r]+', ' ', 'g')) AS l FROM (
    SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT row_number() OVER () AS m, conv_id, turn, string_split(text, chr(10)) AS ls FROM t)))),
said AS (SELECT DISTINCT conv_id, turn, p FROM (
    SELECT conv_id, turn, string_agg(l, chr(10) ORDER BY i) AS p FROM own WHERE l <> '' GROUP BY m, conv_id, turn
    UNION ALL SELECT conv_id, turn, string_agg(l, chr(10) ORDER BY i) FROM own WHERE l <> '' GROUP BY m, conv_id, turn, part
    UNION ALL SELECT conv_id, turn, l FROM own WHERE l <> '')),
lines AS (SELECT conv_id, turn, i, trim(regexp_replace(lower(ls[i]), '[ \t-\r]+', ' ', 'g')) AS l FROM (
    SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT conv_id, turn, string_split(text, chr(10)) AS ls FROM key WHERE text IS NOT NULL))),
passages AS (SELECT conv_id, turn + 1 AS turn, string_agg(l, chr(10) ORDER BY i) AS p, count(DISTINCT l) AS n, list(DISTINCT l) AS ls
    FROM lines WHERE l <> '' GROUP BY ALL),
whole AS (SELECT q.conv_id, q.turn, q.p, any_value(n) AS n, any_value(ls) AS ls, max(s.turn) AS origin FROM
    (SELECT DISTINCT x.* FROM passages x JOIN t USING (conv_id, turn)) q
    LEFT JOIN said s ON s.conv_id = q.conv_id AND s.p = q.p AND s.turn < q.turn GROUP BY q.conv_id, q.turn, q.p),
each AS (SELECT q.conv_id, q.turn, q.l, max(s.turn) AS origin FROM (SELECT conv_id, turn, unnest(ls) AS l FROM whole WHERE origin IS NULL) q
    JOIN said s ON s.conv_id = q.conv_id AND s.p = q.l AND s.turn < q.turn GROUP BY ALL),
counted AS (SELECT conv_id, turn, origin, CAST(sum(n) AS BIGINT) AS n FROM (SELECT conv_id, turn, origin, n FROM whole WHERE origin IS NOT NULL
    UNION ALL SELECT conv_id, turn, origin, 1 FROM each) GROUP BY ALL),
reply AS (SELECT conv_id, turn, arg_max(origin, (n, origin)) AS reply_to, CAST(sum(n) AS BIGINT) AS n_quotes FROM counted GROUP BY ALL),
climb AS (SELECT conv_id, turn, reply_to AS root, CAST(1 AS BIGINT) AS depth FROM reply
    UNION ALL SELECT c.conv_id, c.turn, r.reply_to, c.depth + 1 FROM climb c JOIN reply r ON c.conv_id = r.conv_id AND c.root = r.turn),
place AS (SELECT conv_id, turn, arg_max(root, depth) AS root, max(depth) AS depth FROM climb GROUP BY ALL)
SELECT t.conv_id, t.turn, t.role, reply_to, coalesce(root, t.turn) AS root, coalesce(depth, 0) AS depth, coalesce(n_quotes, 0) AS n_quotes,
  sha256(trim(t.text, chr(10))) AS text_sha256
FROM t LEFT JOIN reply r ON t.conv_id = r.conv_id AND t.turn = r.turn LEFT JOIN place p ON t.conv_id = p.conv_id AND t.turn = p.turn"""


def crc32(text: str) -> str:
    """CRC-32 of an ASCII text, by the byte table ``crc.t``."""
    codes = f"list_transform(string_split({text}, ''), lambda ch: CAST(ascii(ch) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295, {codes}), lambda a, b: xor(a >> 8, crc.t[(xor(a, b) & 255) + 1])), 4294967295)"


CRC_TABLE = """crc AS (SELECT list(v ORDER BY n) AS t FROM (SELECT n, list_reduce(list_prepend(n, range(8)),
    lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v FROM range(256) r(n)))"""

OP11 = f"""
WITH {CRC_TABLE},
t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS pos,
    md5(coalesce(role, '') || chr(10) || md5(coalesce(text, ''))) AS x, strlen(coalesce(text, '')) AS bytes FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT DISTINCT conv_id, conv_id - conv_id % 5 AS base, {crc32("CAST(conv_id AS VARCHAR)")} % 9 AS h FROM t, crc),
built AS (SELECT c.conv_id, 0 AS own, pos, x, bytes FROM c JOIN t ON t.conv_id = c.base AND t.pos <= c.h
    UNION ALL SELECT conv_id, 1, pos, x, bytes FROM c JOIN t USING (conv_id) WHERE pos > h),
seq AS (SELECT c.conv_id, coalesce(list(x ORDER BY own, pos) FILTER (WHERE x IS NOT NULL), []) AS xs,
    coalesce(list(bytes ORDER BY own, pos) FILTER (WHERE x IS NOT NULL), []) AS bs FROM c LEFT JOIN built USING (conv_id) GROUP BY c.conv_id),
members AS (SELECT conv_id, d, xs[1:d] AS node, CASE WHEN d > 0 THEN xs[1:d - 1] END AS parent, bs[d] AS bytes FROM (SELECT *, unnest(range(0, len(xs) + 1)) AS d FROM seq)),
nodes AS (SELECT node, any_value(d) AS depth, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes FROM members GROUP BY node),
kids AS (SELECT parent AS node, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY parent),
ends AS (SELECT xs AS node, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids FROM seq GROUP BY xs),
up AS (SELECT node[1:d] AS node, CASE WHEN k.n IS NULL THEN 1 ELSE 0 END AS leaf, CASE WHEN depth > 0 THEN (n_convs - 1) * bytes ELSE 0 END AS own
    FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM nodes) LEFT JOIN kids k USING (node)),
below AS (SELECT node, sum(leaf) AS n_leaves, sum(own) AS saved FROM up GROUP BY node)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n, 0) AS n_children, CAST(b.n_leaves AS BIGINT) AS n_leaves,
  CAST(b.saved AS BIGINT) AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM nodes n JOIN below b USING (node) LEFT JOIN kids k USING (node) LEFT JOIN ends e USING (node) LEFT JOIN nodes p ON n.parent = p.node"""


def add(state: str, cost, letter: str) -> str:
    """A state's text, its cost in nine digits and its letters, one edit on."""
    return f"(lpad(CAST(CAST(substr({state}, 1, 9) AS INTEGER) + {cost} AS VARCHAR), 9, '0') || substr({state}, 10) || '{letter}')"


MORE = "CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END"
MAY_STAY = "WHEN coalesce(fault, '') NOT IN ('blank', 'duplicate')"
RELAXED = f"""SELECT *, least(s3, {add("q2", 3, "I")}) AS q3 FROM (SELECT *, least(s2, {add("s0", 3, "I")}, {add("s1", 3, "I")}, {add("s3", 3, "I")}) AS q2 FROM {{src}})"""
OP13 = rf"""
WITH RECURSIVE {CRC_TABLE},
raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {crc32("(CAST(conv_id AS VARCHAR) || ':' || coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 AS kind FROM conversations, crc WHERE conv_id IS NOT NULL),
hurt AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
    FROM raw, range(2) r(copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS pos FROM hurt),
judged AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
    WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate'
    WHEN regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault, substr(role, 1, 1) AS i FROM placed),
dp AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS pos, '000000000' AS s0, CAST(NULL AS VARCHAR) AS s1, CAST(NULL AS VARCHAR) AS s2, CAST(NULL AS VARCHAR) AS s3 FROM judged
    UNION ALL SELECT conv_id, pos, {add("s0", 4, "D")},
    least({add("s1", 4, "D")}, CASE {MAY_STAY} AND i = 's' THEN {add("s0", MORE, "K")} END),
    least({add("q2", 4, "D")}, CASE {MAY_STAY} AND i = 'u' THEN least({add("s0", MORE, "K")}, {add("s1", MORE, "K")}, {add("q3", MORE, "K")}) END,
      CASE {MAY_STAY} THEN least({add("s0", "3 + " + MORE, "R")}, {add("s1", "3 + " + MORE, "R")}, {add("q3", "3 + " + MORE, "R")}) END),
    least({add("q3", 4, "D")}, CASE {MAY_STAY} AND i = 'a' THEN {add("q2", MORE, "K")} END, CASE {MAY_STAY} THEN {add("q2", "3 + " + MORE, "R")} END)
    FROM ({RELAXED.format(src="(SELECT j.conv_id, j.pos, j.i, j.fault, s0, s1, s2, s3 FROM dp JOIN judged j ON j.conv_id = dp.conv_id AND j.pos = dp.pos + 1)")})),
best AS (SELECT conv_id, least(s0, q3) AS b FROM ({RELAXED.format(src="(SELECT * FROM dp QUALIFY pos = max(pos) OVER (PARTITION BY conv_id))")})),
letters AS (SELECT conv_id, k, substr(b, CAST(9 + k AS INTEGER), 1) AS letter FROM (SELECT *, unnest(range(1, length(b) - 8)) AS k FROM best)),
named AS (SELECT *, sum(CASE WHEN letter <> 'I' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY k) AS pos,
    row_number() OVER (PARTITION BY conv_id, letter = 'D' ORDER BY k) AS place FROM letters),
turns AS (SELECT n.conv_id, k, letter, place, j.role, CASE WHEN letter = 'I' THEN '' ELSE j.text END AS text, letter = 'K' AND j.i = 's' AS system
    FROM named n LEFT JOIN judged j ON j.conv_id = n.conv_id AND j.pos = n.pos AND letter <> 'I' WHERE letter <> 'D'),
fixed AS (SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (place - lead) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY k) AS t
    FROM (SELECT *, max(CASE WHEN system THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS lead FROM turns) GROUP BY conv_id),
pairs AS (SELECT conv_id, lag(i) OVER (PARTITION BY conv_id ORDER BY pos) || i AS ii FROM judged),
wrong AS (SELECT conv_id, count(*) AS n FROM pairs WHERE ii NOT IN ('su', 'ua', 'au') GROUP BY conv_id),
numbers AS (SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
    count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated FROM judged GROUP BY conv_id)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(w.n, 0) AS illegal, CAST(coalesce(CAST(substr(b, 1, 9) AS INTEGER), 0) AS BIGINT) AS cost, coalesce(substr(b, 10), '') AS audit, sha256(coalesce(f.t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM raw) LEFT JOIN numbers USING (conv_id) LEFT JOIN wrong w USING (conv_id) LEFT JOIN best USING (conv_id) LEFT JOIN fixed f USING (conv_id)"""

ORACLES = {"op3_quality": OP3, "op4_quotes": OP4, "op5_warc": OP5, "op6_licenses": OP6, "op8_substring": OP8, "op10_decontaminate": OP10,
           "op11_prefix_trie": OP11, "op13_repair": OP13}
