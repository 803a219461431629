"""DuckDB SQL for the queries that SQL can express.

op3 and op5 need a tokenizer, op6 XXH64, op9 an HTML parser and op12 a trained
model; those are tested against plain versions in tests/llm.
"""

from __future__ import annotations

from pixelloom.llm import licenses, line_dedup
from pixelloom.llm.license_rules import ANCHORS, CC_ANCHOR, CONFIDENCE, parsed

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPACED = r"[^\x20\x09-\x0D]+"
LOW = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def license_sql() -> str:
    rules = ", ".join(f"({i}, {p}, {quoted(label)}, {quoted(keyword)}, {quoted(regex)}, {CONFIDENCE[p]}::DOUBLE)" for i, (p, label, keyword, regex) in enumerate(parsed()))
    base = "|".join(licenses.BASE)
    names = " ".join(f"WHEN '{phrase}' THEN '{label}'" for phrase, label in licenses.BASE.items())
    gate = " OR ".join([f"regexp_matches(lower(text), {quoted(CC_ANCHOR)})", *(f"contains(lower(text), {quoted(a)})" for a in ANCHORS)])
    spaces = "list_transform({}, lambda x: length(x) - length(replace(x, ' ', '')))"
    return rf"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, {LOW} AS low FROM documents),
    n AS (SELECT rid, doc_id, len(regexp_extract_all(low, '{ALNUM}')) AS n_words,
        CASE WHEN {gate} THEN trim(regexp_replace(regexp_replace(low, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), '[^\x00-\x7F]+', '_', 'g')) ELSE '' END AS norm FROM d),
    rules(rule, priority, label, keyword, re, conf) AS (VALUES {rules}, (-1, 0, '', '', '\b(?:{base})\b', 0::DOUBLE)),
    tried AS (SELECT rid, norm, r.*, string_split_regex(norm, re) AS gaps, regexp_extract_all(norm, re) AS own FROM n, rules r WHERE norm <> '' AND contains(norm, keyword)),
    counted AS (SELECT *, {spaces.format("gaps")} AS g, {spaces.format("own")} AS o FROM tried WHERE len(own) > 0),
    placed AS (SELECT *, unnest(range(1, len(own) + 1)) AS i FROM counted),
    found AS (SELECT rid, rule, priority, label, conf, own[i] AS phrase, (list_sum(g[1:i]) + coalesce(list_sum(o[1:i - 1]), 0))::BIGINT AS first, (list_sum(g[1:i]) + list_sum(o[1:i]))::BIGINT AS last FROM placed),
    base AS (SELECT rid, count(*) AS n_base, min(first) AS first_word, max(first) AS last_word, list(DISTINCT CASE phrase {names} END) AS names FROM found WHERE rule = -1 GROUP BY rid),
    kept AS (SELECT * FROM found a WHERE rule >= 0 AND NOT EXISTS (SELECT 1 FROM found b WHERE b.rule >= 0 AND b.rid = a.rid AND b.first <= a.first AND b.last >= a.last AND b.priority <= a.priority
        AND ((b.first, b.last) <> (a.first, a.last) OR b.priority < a.priority OR b.rule < a.rule))),
    best AS (SELECT rid, list(DISTINCT label) AS names, max(conf) AS score FROM kept GROUP BY rid)
    SELECT n.doc_id, n.n_words::BIGINT AS n_words, coalesce(base.n_base, 0)::BIGINT AS n_base, base.first_word::BIGINT AS first_word, base.last_word::BIGINT AS last_word,
        coalesce(array_to_string(list_sort(base.names), ','), '') AS base_labels,
        coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.names, []), coalesce(best.names, [])))), ','), '') AS labels,
        coalesce(best.score, 0)::DOUBLE AS score
    FROM n LEFT JOIN base USING (rid) LEFT JOIN best USING (rid)
    """


MIX = rf"""
WITH d AS (SELECT doc_id, text, source, len(regexp_extract_all(coalesce(text, ''), '{SPACED}'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS s FROM d GROUP BY source),
w AS (SELECT source, s, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY s * (6 // w), source NULLS LAST) AS k FROM w),
c AS (SELECT *, coalesce(sum(3 * s) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS capped, sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS wleft, sum(s) OVER ()::BIGINT AS total FROM o),
k AS (SELECT min(k) AS k FROM c WHERE (total - capped) * w <= 3 * s * wleft),
p AS (SELECT c.* FROM c, k WHERE c.k = k.k),
t AS (SELECT c.source, c.s AS source_size, CASE WHEN (SELECT count(*) FROM p) = 0 OR c.k < (SELECT p.k FROM p) THEN (3 * c.s)::DOUBLE ELSE (((SELECT total - capped FROM p) * c.w)::DOUBLE / (SELECT wleft FROM p)::DOUBLE) END AS target FROM c),
u AS (SELECT d.*, t.source_size, t.target, CASE WHEN source_size > 0 THEN target / source_size::DOUBLE ELSE 0 END AS rate,
    ('0x' || substr(md5('42:' || coalesce(doc_id::VARCHAR, md5(coalesce(text, '')))), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS draw
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (size * (floor(rate)::BIGINT + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM u
"""

#: The text between block tags; the references in the order in which they are decoded.
SEEN = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>|<!--.*?-->', '<br>', 'g'), '[\\x20\\x09-\\x0D]+', ' ', 'g'), '" + line_dedup.INLINE_TAG + "', '', 'g'), '<[^>]*>', chr(10), 'g')"
for _written, _meant in line_dedup.REFERENCES.items():
    SEEN = f"replace({SEEN}, {quoted(_written)}, {quoted(_meant)})"

LINES = rf"""
WITH p AS (SELECT row_number() OVER () AS rid, page_id, regexp_extract(lower(coalesce(url, '')), '^[a-z][a-z0-9+.-]*://(?:[^@/?#]*@)?([^/?#:]*)', 1) AS host, {SEEN} AS t FROM pages),
l AS (SELECT rid, page_id, host, list_filter(list_transform(string_split(regexp_replace(t, ' +', ' ', 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS lines FROM p),
n AS (SELECT host, count(*) AS pages FROM l GROUP BY host),
c AS (SELECT host, line, count(*) AS n FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM l) GROUP BY host, line),
b AS (SELECT host, list(line) AS bad FROM c JOIN n USING (host) WHERE (c.n >= 2 AND c.n > 0.5 * n.pages) OR (c.n >= 10 AND c.n > 0.1 * n.pages) GROUP BY host),
k AS (SELECT l.*, list_filter(lines, lambda x: NOT list_contains(coalesce(b.bad, []), x)) AS kept FROM l LEFT JOIN b USING (host))
SELECT page_id, host, len(lines)::BIGINT AS n_lines, (len(lines) - len(kept))::BIGINT AS n_dropped, array_to_string(kept, chr(10)) AS text FROM k
"""

LEAKS = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({LOW}, '{ALNUM}') AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all({LOW}, '{ALNUM}') AS w FROM benchmark),
b1 AS (SELECT *, least(10, len(w)) AS n FROM b WHERE len(w) > 0),
b2 AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM b1)),
dn AS (SELECT rid, w, n FROM d, (SELECT DISTINCT n FROM b1) WHERE len(w) >= n),
d2 AS (SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM dn)),
h AS (SELECT d2.rid, d2.i, d2.n, b2.item FROM d2 JOIN b2 ON d2.n = b2.n AND d2.g = b2.g),
c AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM h) GROUP BY rid),
i AS (SELECT rid, count(DISTINCT item) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM h WHERE item IS NOT NULL) GROUP BY rid)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (rid) LEFT JOIN i USING (rid)
"""

QUALITY = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{SPACED}') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{SPACED}')) AS lines FROM documents),
g AS (SELECT rid, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
r AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 8)) AS p FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM g) WHERE c > 1) GROUP BY rid),
f AS (SELECT rid, doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, strlen(array_to_string(w, '')) AS solid, length(text) - length(regexp_replace(text, '[0-9]', '', 'g')) AS digits,
    length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS capitals, length(text) - length(regexp_replace(text, '[A-Za-z]', '', 'g')) AS letters, coalesce(r.n, 0) AS n_repeat_words,
    len(list_filter(list_zip(w[1:len(w) - 1], w[2:]), lambda z: z[1] = z[2])) AS n_same
    FROM d LEFT JOIN r USING (rid)),
v AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
    NOT (base_failed OR 10 * n_symbols > 3 * n_words OR NOT (2 * n_words <= word_chars AND word_chars <= 15 * n_words) OR (n_lines >= 4 AND 2 * n_dup_lines > n_lines)
    OR (solid > 0 AND 2 * digits > solid) OR (letters >= 100 AND 10 * capitals > 6 * letters) OR 10 * n_same > 3 * n_words) AS kept FROM v
"""

CHAT = r"""
WITH said AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
m AS (SELECT *, 24 + length(role) + length(text) + len(regexp_extract_all(role, '\\|<(\||/?s>|</?SYS>)|\[/?INST\]')) + len(regexp_extract_all(text, '\\|<(\||/?s>|</?SYS>)|\[/?INST\]')) AS chars FROM said)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(chars)::BIGINT AS formatted_chars
FROM m GROUP BY conv_id
"""


def crc32(text: str) -> str:
    """The unsigned CRC-32 of an expression's UTF-8 bytes."""
    octets = f"list_transform(range(octet_length(encode({text}))), lambda i: ('0x' || substr(hex(encode({text})), (2 * i + 1)::INT, 2))::BIGINT)"
    step = "list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda c, b: {step}), 4294967295)"


TRIE = rf"""
WITH r AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos FROM conversations),
c AS (SELECT conv_id, CASE WHEN conv_id IS NULL THEN 0 ELSE {crc32("conv_id::VARCHAR")} % 6 END AS h FROM (SELECT DISTINCT conv_id FROM r)),
b AS (SELECT c.conv_id, r.pos, r.role, r.text FROM c JOIN r ON r.conv_id = c.conv_id - c.conv_id % 100 AND r.pos < c.h),
n AS (SELECT conv_id, count(*) AS n FROM b GROUP BY conv_id),
o AS (SELECT r.conv_id, pos - h + coalesce(n.n, 0) AS pos, role, text FROM r JOIN c ON r.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN n ON n.conv_id = r.conv_id WHERE pos >= h),
t AS (SELECT * FROM b UNION ALL SELECT * FROM o),
l AS (SELECT row_number() OVER () AS cid, c.conv_id, coalesce(s.turns, []) AS turns FROM c LEFT JOIN (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY pos) AS turns FROM t GROUP BY conv_id) s ON c.conv_id IS NOT DISTINCT FROM s.conv_id),
k AS (SELECT cid, conv_id, d, len(turns) AS n, sha256(to_json(turns[1:d])::VARCHAR) AS node, CASE WHEN d > 0 THEN sha256(to_json(turns[1:d - 1])::VARCHAR) END AS parent, CASE WHEN d > 0 THEN length(turns[d].text) ELSE 0 END AS chars
    FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM l)),
v AS (SELECT node, min(d) AS d, min(cid) AS cid, min(conv_id) AS conv_id, min(parent) AS parent, count(*) AS n_convs, min(chars) AS chars, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = d), '') AS ids FROM k GROUP BY node),
q AS (SELECT parent, count(*) AS n FROM v WHERE parent IS NOT NULL GROUP BY parent),
u AS (SELECT k.node, sum((v.n_convs - 1) * v.chars) AS saved, count(*) FILTER (q.n IS NULL) AS leaves FROM v LEFT JOIN q ON q.parent = v.node JOIN k ON k.cid = v.cid AND k.d <= v.d GROUP BY k.node)
SELECT v.conv_id, v.d::BIGINT AS depth, p.conv_id AS parent_conv_id, v.n_convs::BIGINT AS n_convs, coalesce(q.n, 0)::BIGINT AS n_children, u.leaves::BIGINT AS n_leaves, u.saved::BIGINT AS saved_tokens, sha256(v.ids) AS ends_sha256
FROM v JOIN u USING (node) LEFT JOIN q ON q.parent = v.node LEFT JOIN v p ON p.node = v.parent
"""

RESAMPLE = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({LOW}, '{ALNUM}') AS w, ('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, md5(coalesce(text, '')))), 1, 8))::BIGINT AS h FROM documents),
x AS (SELECT rid, unnest(w) AS word FROM d),
y AS (SELECT unnest(regexp_extract_all({LOW}, '{ALNUM}')) AS word FROM benchmark),
b AS (SELECT word, {crc32("word")} % 10000 AS bucket FROM (SELECT word FROM x UNION SELECT word FROM y)),
s AS (SELECT bucket, count(*) AS n FROM x JOIN b USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM y JOIN b USING (word) GROUP BY bucket),
g AS (SELECT bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM x) + 10000)::DOUBLE / ((s.n + 1)::DOUBLE * ((SELECT count(*) FROM y) + 10000)::DOUBLE)))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket)),
m AS (SELECT rid, floor(sum(gain) / count(*))::BIGINT AS weight FROM x JOIN b USING (word) JOIN g USING (bucket) GROUP BY rid),
f AS (SELECT rid, doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight, (coalesce(weight, 0) + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score FROM d LEFT JOIN m USING (rid)),
e AS (SELECT rid, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features, weight)::BIGINT AS rank FROM f WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, e.rank FROM f LEFT JOIN e ON f.rid = e.rid AND e.rank <= 10 * (SELECT count(*) FROM e) // 100
"""

SQL: dict[str, str] = {
    "op1_license_scan": license_sql(),
    "op2_source_mix": MIX,
    "op4_line_dedup": LINES,
    "op7_decontamination": LEAKS,
    "op8_quality_rules": QUALITY,
    "op10_chat_format": CHAT,
    "op11_prefix_trie": TRIE,
    "op13_target_resample": RESAMPLE,
}
