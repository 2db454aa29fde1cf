"""DuckDB SQL for the queries that SQL can express; written from the contracts, apart from the Spark code."""

from __future__ import annotations

from .quality_rules import BOILERPLATE, HOLDS, LINE_SYMBOLS, LONG_LINE, LONG_LINE_ENDS, MAX_LOST, MAX_REPEAT_PERCENT, MIN_WORDS, PHRASE_SHARE, SEPARATORS, SYMBOLS, TERMINAL, WRAP_ENDS

_WORD = r"[^\x20\x09-\x0D]+"
_WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _of(column: str, characters: str) -> str:
    """How many of the characters a column holds."""
    return f"(length({column}) - length(translate({column}, {_quoted(characters)}, '')))"


OP4 = rf"""
WITH word_list AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w FROM documents
), placed AS (
    SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos, len(w) AS n FROM word_list
), triples AS (
    SELECT doc_id, n, pos, word || chr(10) || lead(word, 1) OVER d || chr(10) || lead(word, 2) OVER d AS s FROM placed WINDOW d AS (PARTITION BY doc_id ORDER BY pos)
), shingle AS (
    SELECT DISTINCT doc_id, s FROM triples WHERE n >= 3 AND pos <= n - 2
    UNION ALL
    SELECT doc_id, string_agg(word, chr(10) ORDER BY pos) FROM placed WHERE n < 3 GROUP BY doc_id
), sized AS (
    SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id
), link AS (
    SELECT a.doc_id AS x, b.doc_id AS y
    FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id <> b.doc_id
    JOIN sized p ON p.doc_id = a.doc_id JOIN sized q ON q.doc_id = b.doc_id
    GROUP BY a.doc_id, b.doc_id, p.n, q.n
    HAVING 100 * count(*) >= 90 * (p.n + q.n - count(*))
), reach AS (
    SELECT * FROM (
        WITH RECURSIVE r(x, y) AS (SELECT x, y FROM link UNION SELECT r.x, l.y FROM r JOIN link l ON l.x = r.y) SELECT x, min(y) AS least FROM r GROUP BY x
    )
)
SELECT d.doc_id, coalesce(z.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(r.least, d.doc_id)) AS component_id
FROM documents d LEFT JOIN sized z ON z.doc_id = d.doc_id LEFT JOIN reach r ON r.x = d.doc_id
"""

_SPACED = r"' ' || regexp_replace(lower(line), '[^\p{L}\p{N}]+', '  ', 'g') || ' '"
_PHRASES = " + ".join(f"(length(spaced) - length(replace(spaced, {_quoted(m)}, ''))) // {len(m)} * {p.count(' ') + 1}" for p in BOILERPLATE for m in [" " + p.replace(" ", "  ") + " "])


def _goes_on(ends: tuple[str, str]) -> str:
    return f"(regexp_matches(right(line, 1), '{ends[0]}') AND regexp_matches(left(next, 1), '{ends[1]}'))"


OP6 = rf"""
WITH word_list AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents
), placed AS (
    SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM word_list
), runs AS (
    SELECT doc_id, pos, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS run,
        lead(pos, 7) OVER (PARTITION BY doc_id ORDER BY pos) AS last
    FROM placed
), again AS (
    SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, run) AS times FROM runs WHERE last IS NOT NULL
), hit AS (
    SELECT doc_id, pos, max(CASE WHEN times > 1 THEN pos END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS start
    FROM (SELECT p.doc_id, p.pos, a.times FROM placed p LEFT JOIN again a ON a.doc_id = p.doc_id AND a.pos = p.pos)
), repeated AS (
    SELECT doc_id, count(*) AS n FROM hit WHERE start IS NOT NULL GROUP BY doc_id
), line_list AS (
    SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents
), own_lines AS (
    SELECT doc_id, line FROM (SELECT doc_id, unnest(l) AS line FROM line_list) WHERE regexp_matches(line, '{_WORD}')
), neighbours AS (
    SELECT doc_id, line, pos, marked, lead(line) OVER (PARTITION BY doc_id ORDER BY pos) AS next
    FROM (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos, contains(array_to_string(l, ''), chr(11)) AS marked FROM line_list)
), numbered AS (
    SELECT doc_id, line, pos, coalesce(sum(CASE WHEN NOT marked AND ({_goes_on(WRAP_ENDS)} OR (length(line) >= {LONG_LINE} AND {_goes_on(LONG_LINE_ENDS)})) THEN 0 ELSE 1 END)
        OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part
    FROM neighbours
), joined AS (
    SELECT doc_id, string_agg(line, chr(11) ORDER BY pos) AS line FROM numbered GROUP BY doc_id, part
), lines AS (
    SELECT doc_id, line, len(regexp_extract_all(line, '{_WORD}')) AS n, {_SPACED} AS spaced FROM joined WHERE regexp_matches(line, '{_WORD}')
), judged AS (
    SELECT doc_id, line,
        (contains({_quoted(TERMINAL)}, right(rtrim(line, {_WHITE}), 1)) OR (n >= 8 AND regexp_matches(line, '{HOLDS}')))
        AND NOT ({_of('line', SEPARATORS)} >= 3 AND {_of('line', SEPARATORS)} * 5 >= n)
        AND NOT ({_of('line', LINE_SYMBOLS)} >= 3 AND {_of('line', LINE_SYMBOLS)} * 4 >= n)
        AND NOT ((length(line) - length(replace(line, '!!', ' '))) >= 2 AND (length(line) - length(replace(line, '!!', ' '))) * 5 >= n)
        AND ({_PHRASES}) * {PHRASE_SHARE} < n AS passes
    FROM lines
), per_line AS (
    SELECT doc_id, coalesce(sum(length(translate(line, {_WHITE}, ''))) FILTER (WHERE passes), 0) AS clean FROM judged GROUP BY doc_id
), repeats AS (
    SELECT doc_id, count(*) - count(DISTINCT line) AS dup FROM own_lines GROUP BY doc_id
), facts AS (
    SELECT d.doc_id, len(w.w)::BIGINT AS n_words, length(translate(coalesce(text, ''), {_WHITE}, ''))::BIGINT AS word_chars,
        {_of("coalesce(text, '')", SYMBOLS)}::BIGINT AS n_symbols, coalesce(o.dup, 0)::BIGINT AS n_dup_lines,
        coalesce(r.n, 0)::BIGINT AS n_repeat_words, coalesce(p.clean, 0)::BIGINT AS clean_chars
    FROM documents d JOIN word_list w ON w.doc_id = d.doc_id LEFT JOIN repeated r ON r.doc_id = d.doc_id LEFT JOIN per_line p ON p.doc_id = d.doc_id LEFT JOIN repeats o ON o.doc_id = d.doc_id
)
SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
    NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AND clean_chars >= {1 - MAX_LOST} * word_chars AS kept
FROM facts
"""

OP8 = """
WITH payloads AS (
    SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS digest FROM pages
), known AS (
    SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY digest) ELSE page_id END AS original FROM payloads
)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
    CASE WHEN original = page_id THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN original <> page_id THEN original END AS refers_to
FROM known
"""


def _crc32(codes: str) -> str:
    """Unsigned CRC-32 of a list of byte values, bit by bit."""
    step = "list_reduce([xor(s, b), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, y: xor(x >> 1, (x & 1) * 3988292384))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda s, b: {step}), 4294967295)"


OP11 = f"""
WITH turns AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) AS pos
    FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
    SELECT DISTINCT conv_id, conv_id - conv_id % 100 AS base,
        {_crc32("list_transform(string_split(conv_id::VARCHAR, ''), lambda c: unicode(c)::BIGINT)")} % 6 AS h
    FROM turns
), rebuilt AS (
    SELECT c.conv_id, 0 AS own, t.pos, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.base AND t.pos <= c.h
    UNION ALL
    SELECT c.conv_id, 1, t.pos, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.pos > c.h
), prefixed AS (
    SELECT conv_id, row_number() OVER w AS depth, length(text) AS chars, list(length(role) || ':' || role || length(text) || ':' || text) OVER w AS path
    FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY own, pos ROWS UNBOUNDED PRECEDING)
), member AS (
    SELECT conv_id, depth, chars, path, depth = max(depth) OVER (PARTITION BY conv_id) AS ends FROM prefixed
    UNION ALL
    SELECT conv_id, 0, 0, [], conv_id NOT IN (SELECT conv_id FROM prefixed) FROM convs
), node AS (
    SELECT path, depth, any_value(chars) AS chars, min(conv_id) AS conv_id, count(*) AS n_convs,
        sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
    FROM member GROUP BY path, depth
), told AS (
    SELECT n.*, p.conv_id AS parent_conv_id, (SELECT count(*) FROM node k WHERE k.depth = n.depth + 1 AND k.path[1:n.depth] = n.path) AS n_children
    FROM node n LEFT JOIN node p ON p.depth = n.depth - 1 AND p.path = n.path[1:n.depth - 1]
)
SELECT a.conv_id, a.depth, a.parent_conv_id, a.n_convs, a.n_children, (count(*) FILTER (WHERE b.n_children = 0))::BIGINT AS n_leaves,
    sum((b.n_convs - 1) * b.chars)::BIGINT AS saved_tokens, a.ends_sha256
FROM told a JOIN told b ON b.depth >= a.depth AND b.path[1:a.depth] = a.path
GROUP BY ALL
"""

_BYTES = "flatten(list_transform(string_split(keyed, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195::BIGINT, unicode(c)::BIGINT - 64] END))"

OP13 = f"""
WITH RECURSIVE run AS (
    SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r
    FROM documents
), counted AS (
    SELECT doc_id, r, doc_id::VARCHAR || ':' || r AS keyed, count(*) AS times FROM run WHERE length(r) >= 6 GROUP BY doc_id, r
), hashed AS (
    SELECT r, times, CASE WHEN keyed IS NULL THEN 1 ELSE {_crc32(_BYTES)} END AS h FROM counted
), word AS (
    SELECT CASE WHEN h % 199 = 0 THEN r[1:h % length(r)] || r[h % length(r) + 2:] ELSE r END AS word, sum(times)::BIGINT AS n
    FROM hashed GROUP BY 1 HAVING length(word) >= 6 AND sum(times) >= 5
), less AS (
    SELECT DISTINCT word, n, word[1:i - 1] || word[i + 1:] AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM word)
), gap AS (
    SELECT word, n, word[1:i - 1] || '*' || word[i + 1:] AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM word)
), near AS (
    SELECT a.word, b.word AS other, b.n FROM gap a JOIN gap b ON a.rest = b.rest AND a.word <> b.word
    UNION SELECT l.word, w.word, w.n FROM less l JOIN word w ON w.word = l.rest
    UNION SELECT w.word, l.word, l.n FROM less l JOIN word w ON w.word = l.rest
), told AS (
    SELECT word, count(*) AS n_near, max(n) AS most FROM near GROUP BY word
), best AS (
    SELECT t.word, t.n_near, t.most, min(x.other) AS other FROM told t JOIN near x ON x.word = t.word AND x.n = t.most GROUP BY ALL
), formed AS (
    SELECT w.word, w.n, coalesce(b.n_near, 0)::BIGINT AS n_near, CASE WHEN b.most >= 5 * w.n THEN b.other END AS form, CASE WHEN b.most >= 5 * w.n THEN b.most END AS form_n
    FROM word w LEFT JOIN best b ON b.word = w.word
), path AS (
    SELECT word, word AS at FROM formed
    UNION ALL
    SELECT p.word, f.form FROM path p JOIN formed f ON f.word = p.at WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, p.at AS root, f.n, f.n_near, f.form_n
FROM formed f JOIN path p ON p.word = f.word JOIN formed g ON g.word = p.at AND g.form IS NULL
"""
