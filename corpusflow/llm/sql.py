"""What SQL can say about the corpus queries: op6 to op9, op11 and op13, over the same tables."""

from __future__ import annotations

from corpusflow.llm import chat, collocations, near_dup, prefix_trie, quality_rules

_LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"[^\x20\x09-\x0D]+"

_LEVEL = r"regexp_replace(regexp_replace(regexp_replace(lower(x), '[\x20\x09-\x0D]+', ' ', 'g'), '^ +| +$', '', 'g'), '[0-9]+', '0', 'g')"

OP6 = rf"""WITH d AS (SELECT doc_id, coalesce(source, chr(1)) AS host, text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i + 1 : i + 8], chr(10)) AS g FROM (SELECT doc_id, w, unnest(range(0, len(w) - 7)) AS i FROM d WHERE len(w) >= 8)),
r AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1) GROUP BY 1),
l AS (SELECT doc_id, count(*) - count(DISTINCT x) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM d) WHERE regexp_matches(x, '{_WORD}') GROUP BY 1),
b AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(coalesce(text, '')) - length(translate(coalesce(text, ''), '#*$%&|<>', '')) AS BIGINT) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM d LEFT JOIN l ON l.doc_id = d.doc_id LEFT JOIN r ON r.doc_id = d.doc_id),
k AS MATERIALIZED (SELECT DISTINCT host, text, list_filter(list_transform(string_split(text, chr(10)), lambda x: {_LEVEL}), lambda x: x <> '') AS p FROM d WHERE text IS NOT NULL),
e AS MATERIALIZED (SELECT host, text, unnest(p) AS line, unnest(range(0, len(p))) AS i FROM k WHERE len(p) > 0), o AS (SELECT host, line FROM e GROUP BY 1, 2 HAVING count(DISTINCT text) >= {quality_rules.LINE_DOCS}),
m AS (SELECT e.*, o.line IS NOT NULL AS often, CASE WHEN o.line IS NULL THEN array_to_string(s[list_position(s, list_min(s)) : list_position(s, list_min(s)) + 2], ' ') END AS own FROM (SELECT *, string_split(line, ' ') AS s FROM e) e LEFT JOIN o ON o.host = e.host AND o.line = e.line),
v AS MATERIALIZED (SELECT * FROM (SELECT host, text, line, often, last_value(own IGNORE NULLS) OVER (PARTITION BY host, text ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, last_value(own IGNORE NULLS) OVER (PARTITION BY host, text ORDER BY i DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS after FROM m) WHERE often),
t AS (SELECT host, line FROM v GROUP BY 1, 2 HAVING greatest(count(DISTINCT before) + CAST(count(*) FILTER (before IS NULL) > 0 AS INT), count(DISTINCT after) + CAST(count(*) FILTER (after IS NULL) > 0 AS INT)) >= {quality_rules.NEIGHBOUR_SHARE} * count(DISTINCT text)),
z AS (SELECT host, text, sum(len(string_split(line, ' '))) AS gone FROM v JOIN t USING (host, line) GROUP BY 1, 2),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM b)
SELECT f.*, NOT base_failed AND NOT (coalesce(gone, 0) > 0 AND (n_words - gone < {quality_rules.LEAST_WORDS} OR n_words - gone < {quality_rules.LEAST_SHARE} * n_words)) AS kept FROM f JOIN d ON d.doc_id = f.doc_id LEFT JOIN z ON z.host = d.host AND z.text = d.text"""

_WORDS7 = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP7 = f"""WITH d AS (SELECT doc_id, {_WORDS7.format(_LOWER.format("text"))} AS w FROM documents), b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS7.format(_LOWER.format("text"))} AS w FROM benchmark),
i AS (SELECT item, m, array_to_string(w[k + 1 : k + m], ' ') AS win FROM (SELECT item, w, least(10, len(w)) AS m, unnest(range(0, len(w) - least(10, len(w)) + 1)) AS k FROM b WHERE len(w) > 0)),
s AS (SELECT DISTINCT m FROM i), x AS (SELECT doc_id, m, k, array_to_string(w[k + 1 : k + m], ' ') AS win FROM (SELECT doc_id, w, m, unnest(range(0, greatest(len(w) - m + 1, 0))) AS k FROM d, s)),
h AS (SELECT doc_id, item, m, k FROM x JOIN i USING (m, win)), p AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + m)) AS q FROM h) GROUP BY 1),
n AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated FROM d LEFT JOIN p ON p.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"""

OP8 = f"""WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, regexp_extract_all({_LOWER.format("text")}, '{_WORD}') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[k + 1 : k + {near_dup.WORDS}], ' ') AS g FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w) - {near_dup.WORDS - 1}, 1))) AS k FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
l AS MATERIALIZED (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2) JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d JOIN c ON c.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"""

_MARKS = "|".join(r"\\" if c is None else "".join("\\" + x if not x.isalnum() and x not in "_/" else x for x in c) for c in (None, *chat.CONTROL))
_LONG = f"length({{0}}) + len(regexp_extract_all({{0}}, '{_MARKS}'))"

OP9 = f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
 CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
 CAST(sum({len(chat.START) + len(chat.END) + 2} + {_LONG.format("role")} + {_LONG.format("text")}) AS BIGINT) AS formatted_chars FROM c GROUP BY 1"""

OP11 = rf"""WITH w AS MATERIALIZED (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER.format("text")}, '[.,;:!?\x0A-\x0D]')) AS p FROM documents)),
f AS MATERIALIZED (SELECT lang, d, g, count(*) AS n FROM (SELECT lang, d, array_to_string(w[i + 1 : i + d], ' ') AS g FROM (SELECT lang, w, d, unnest(range(0, len(w) - d + 1)) AS i FROM w, (SELECT unnest(range(1, {collocations.LONGEST + 1})) AS d) WHERE len(w) >= d)) GROUP BY 1, 2, 3 HAVING count(*) >= {collocations.LEAST}),
c AS MATERIALIZED (SELECT lang, d, g, n AS a, string_split(g, ' ') AS w FROM f WHERE d > 1),
k AS (SELECT lang, d, g, a, k, array_to_string(w[1 : k], ' ') AS head, array_to_string(w[k + 1 :], ' ') AS tail FROM (SELECT *, unnest(range(1, d)) AS k FROM c)),
s AS (SELECT k.lang, k.g, a, k, x.n AS l, y.n AS r, CAST(2000000::HUGEINT * a // (x.n::HUGEINT + y.n) AS BIGINT) AS score FROM k JOIN f x ON x.lang = k.lang AND x.g = head JOIN f y ON y.lang = k.lang AND y.g = tail),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, k) AS o FROM s) WHERE o = 1),
i AS (SELECT lang, array_to_string(w[j + 1 : j + m], ' ') AS g, max(a) AS longer FROM (SELECT lang, a, w, d, m, unnest(range(0, d - m + 1)) AS j FROM (SELECT *, unnest(range(2, d)) AS m FROM c WHERE d > 2)) GROUP BY 1, 2),
z AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.g) AS rank FROM b LEFT JOIN i ON i.lang = b.lang AND i.g = b.g WHERE longer IS NULL OR 100::HUGEINT * longer < {collocations.KEEP}::HUGEINT * a),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY 1)
SELECT z.lang, rank, z.g AS phrase, a, l, r, n.n, score FROM z JOIN n ON n.lang = z.lang WHERE rank <= {collocations.TOP}"""

_BITS = "list_reduce(list_prepend(xor(a, b), [1, 2, 3, 4, 5, 6, 7, 8]), lambda c, r: xor(c >> 1, 3988292384 * (c & 1)))"
_CRC = f"xor(4294967295, list_reduce(list_prepend(4294967295, [CAST(ord(x) AS BIGINT) for x in string_split(CAST(conv_id AS VARCHAR), '')]), lambda a, b: {_BITS}))"

OP13 = f"""WITH o AS MATERIALIZED (SELECT conv_id, list({{'r': role, 't': text}} ORDER BY turn NULLS FIRST, role, h) AS t FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, left(sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), {2 * prefix_trie.DIGEST}) AS h FROM conversations WHERE conv_id IS NOT NULL) GROUP BY 1),
h AS (SELECT conv_id, t, conv_id - conv_id % 5 AS base, {_CRC} % 9 AS h FROM o),
c AS MATERIALIZED (SELECT h.conv_id, list_concat(coalesce(o.t[1 : h.h], []), h.t[h.h + 1 :]) AS t FROM h LEFT JOIN o ON o.conv_id = h.base),
m AS MATERIALIZED (SELECT conv_id, len(t) AS n, d AS depth, t[1 : d] AS p FROM (SELECT *, unnest(range(0, len(t) + 1)) AS d FROM c)),
v AS MATERIALIZED (SELECT depth, p, min(conv_id) AS conv_id, count(*) AS n_convs, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = depth) AS ends, (count(*) - 1) * CASE WHEN depth = 0 THEN 0 ELSE coalesce(strlen(p[-1].t), 0) END AS own FROM m GROUP BY 1, 2),
k AS MATERIALIZED (SELECT v.*, u.conv_id AS parent_conv_id, u.p AS up FROM v LEFT JOIN v u ON u.depth = v.depth - 1 AND u.p = v.p[1 : v.depth - 1]),
n AS MATERIALIZED (SELECT depth - 1 AS depth, up AS p, count(*) AS n_children FROM k WHERE depth > 0 GROUP BY 1, 2),
a AS (SELECT x.depth, x.p, CAST(count(*) FILTER (n.p IS NULL) AS BIGINT) AS n_leaves, CAST(sum(y.own) AS BIGINT) AS saved_tokens FROM v x JOIN v y ON y.depth >= x.depth AND y.p[1 : x.depth] = x.p LEFT JOIN n ON n.depth = y.depth AND n.p = y.p GROUP BY 1, 2)
SELECT k.conv_id, k.depth, parent_conv_id, n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256 FROM k JOIN a ON a.depth = k.depth AND a.p = k.p LEFT JOIN n ON n.depth = k.depth AND n.p = k.p"""

SQL = {"op6_quality_rules": OP6, "op7_decontamination": OP7, "op8_near_duplicates": OP8, "op9_chat_formatting": OP9, "op11_phrase_collocations": OP11, "op13_prefix_trie": OP13}
