"""DuckDB SQL that gives the rows of the operators SQL can express, over the whole tables."""

from __future__ import annotations

from .quality import BASE_WINDOW, COVERAGE, LINE_COVERAGE, MAX_REPEAT_PERCENT, MIN_WORDS

_WORDS = r"""t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM t)"""

WORDS = rf"""WITH {_WORDS},
g AS (SELECT doc_id, i, array_to_string(ws[i + 1:i + 20], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(len(ws) - 19)) AS i FROM w WHERE len(ws) >= 20)),
d AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM g) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, i + o AS i FROM d, range(20) AS x(o)),
p AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM w),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS s FROM p ANTI JOIN gone USING (doc_id, i) GROUP BY 1)
SELECT doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)"""

BYTES = r"""WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
g AS (SELECT doc_id, i, substring(h, 2 * i + 1, 200) AS k FROM (SELECT doc_id, h, unnest(range(length(h) // 2 - 99)) AS i FROM t WHERE length(h) >= 200)),
d AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM g) WHERE r > 1),
runs AS (SELECT doc_id, min(i) AS lo, max(i) + 100 AS hi FROM (SELECT *, sum(CASE WHEN i <= before + 100 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run
FROM (SELECT *, lag(i, 1, -1000) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM d)) GROUP BY doc_id, run),
edges AS (SELECT *, lag(hi, 1, 0) OVER (PARTITION BY doc_id ORDER BY lo) AS prior, row_number() OVER (PARTITION BY doc_id ORDER BY lo) AS k FROM runs),
head AS (SELECT doc_id, string_agg(substring(h, 2 * prior + 1, 2 * (lo - prior)), '' ORDER BY k) AS s, sum(hi - lo) AS n, count(*) AS spans, max(hi) AS last FROM edges JOIN t USING (doc_id) GROUP BY 1)
SELECT doc_id, length(h) // 2 AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(s || substring(h, 2 * last + 1), h))) AS kept_sha256 FROM t LEFT JOIN head USING (doc_id)"""

_SHARES = ", ".join(f"CASE WHEN word_chars > 0 THEN coalesce(max(chars) FILTER (n = {n}), 0) / word_chars ELSE 0 END AS share_{n}" for n in COVERAGE)
_BAD = " OR ".join([f"share_lines > {LINE_COVERAGE}", *(f"share_{n} > {most}" for n, most in COVERAGE.items())])
_LENGTHS = ", ".join(f"({n})" for n in COVERAGE)

QUALITY = rf"""WITH {_WORDS},
g AS (SELECT doc_id, i, n, array_to_string(ws[i + 1:i + n], ' ') AS k FROM (SELECT doc_id, ws, n, unnest(range(len(ws) - n + 1)) AS i FROM w, (VALUES {_LENGTHS}) AS v(n) WHERE len(ws) >= n)),
d AS (SELECT doc_id, n, i FROM (SELECT doc_id, n, i, count(*) OVER (PARTITION BY doc_id, n, k) AS c FROM g) WHERE c > 1),
inside AS (SELECT DISTINCT doc_id, n, i + o AS i FROM d, range({max(COVERAGE)}) AS x(o) WHERE o < n),
p AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM w),
cov AS (SELECT doc_id, n, count(*) AS words, sum(length(word)) AS chars FROM inside JOIN p USING (doc_id, i) GROUP BY ALL),
l AS (SELECT doc_id, length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) AS chars, count(*) OVER (PARTITION BY doc_id, line) AS c, row_number() OVER (PARTITION BY doc_id, line) AS r
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
ls AS (SELECT doc_id, count(*) FILTER (r > 1) AS dup, coalesce(sum(chars) FILTER (c > 1), 0) AS line_chars FROM l GROUP BY 1),
b AS (SELECT doc_id, len(ws) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols FROM w),
m AS (SELECT doc_id, n_words, word_chars, n_symbols, coalesce(any_value(dup), 0) AS n_dup_lines, coalesce(max(words) FILTER (n = {BASE_WINDOW}), 0) AS n_repeat_words, {_SHARES},
CASE WHEN word_chars > 0 THEN coalesce(any_value(line_chars), 0) / word_chars ELSE 0 END AS share_lines
FROM b LEFT JOIN (SELECT doc_id, n, words, CAST(chars AS DOUBLE) AS chars FROM cov) USING (doc_id) LEFT JOIN ls USING (doc_id) GROUP BY doc_id, n_words, word_chars, n_symbols),
f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND NOT ({_BAD}) AS kept FROM f"""

#: Covers conversations without tool blocks, as the given ones are: every turn is one message. Linking, schemas and order are
#: held against brute force by tests.
MESSAGES = r"""SELECT conv_id, turn, 0 AS part, role, 'message' AS kind, NULL AS call_id, NULL AS name, false AS linked, true AS valid, NULL AS error,
coalesce(turn, -4611686018427387904) AS order_turn, 0 AS order_part, 0 AS order_level,
'{"content":' || CAST(to_json(coalesce(text, '')) AS VARCHAR) || ',"role":' || coalesce(CAST(to_json(role) AS VARCHAR), 'null') || '}' AS json FROM conversations"""

NEGATIVES = r"""WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS q FROM embeddings
WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_dot_product(CAST(a.q AS DOUBLE[]), CAST(b.q AS DOUBLE[])) AS BIGINT) AS score
FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id != b.vec_id),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 100 * score BETWEEN 50 * positive_score AND 95 * positive_score
QUALIFY rank <= 3"""

# crc32 by bits: c becomes c // 2, with the reversed polynomial added where its last bit is set, eight times a byte.
_CRC = """xor(list_reduce([4294967295::BIGINT] || list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ('0x' || h)::BIGINT),
lambda c, b: list_reduce([xor(c, b)] || [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)), 4294967295)"""
_CRC = _CRC.format(text="coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run")

VARIANTS = rf"""WITH RECURSIVE r AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) AS run FROM documents),
d AS (SELECT doc_id, run, count(*) AS c FROM r GROUP BY ALL),
h AS (SELECT run, c, {_CRC} AS h FROM d),
g AS (SELECT CASE WHEN h % 199 = 0 THEN substring(run, 1, h % length(run)) || substring(run, h % length(run) + 2) ELSE run END AS word, c FROM h),
w AS MATERIALIZED (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM g WHERE length(word) >= 6 GROUP BY 1 HAVING sum(c) >= 5),
cut AS MATERIALIZED (SELECT word, n, i, substring(word, 1, i - 1) AS l, substring(word, i + 1) AS r FROM w, LATERAL unnest(range(1, length(word) + 1)) AS u(i)),
pairs AS (SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.i = b.i AND a.l = b.l AND a.r = b.r AND a.word != b.word
UNION SELECT a.word, a.n, w.word, w.n FROM cut a JOIN w ON a.l || a.r = w.word UNION SELECT w.word, w.n, a.word, a.n FROM cut a JOIN w ON a.l || a.r = w.word),
best AS MATERIALIZED (SELECT w.word, w.n, count(near) AS n_near, arg_min(near, (-near_n, encode(near))) AS near, max(near_n) AS near_n FROM w LEFT JOIN pairs USING (word) GROUP BY ALL),
f AS MATERIALIZED (SELECT word, n, n_near, CASE WHEN near_n >= 5 * n THEN near END AS form, CASE WHEN near_n >= 5 * n THEN near_n END AS form_n FROM best),
way AS (SELECT word, word AS here, 0 AS step FROM f UNION ALL SELECT way.word, f.form, step + 1 FROM way JOIN f ON way.here = f.word WHERE f.form IS NOT NULL)
SELECT word, form, arg_max(here, step) AS root, n, n_near, form_n FROM f JOIN way USING (word) GROUP BY word, form, n, n_near, form_n"""
