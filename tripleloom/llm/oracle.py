"""DuckDB statements for the operators that SQL can express on whole tables."""

from __future__ import annotations

from tripleloom.llm.divergence import (
    CHARS_GUARD,
    CHARS_LIMIT,
    CLASSES,
    COMMON_WORDS,
    WORDS_GUARD,
    WORDS_LIMIT,
)

_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

CONTAMINATION = f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWERED}, {_ALNUM}) AS a FROM documents),
    it AS (SELECT item_id, a, least(13, len(a)) AS n
           FROM (SELECT item_id, regexp_extract_all({_LOWERED}, {_ALNUM}) AS a FROM benchmark) WHERE len(a) > 0),
    iw AS (SELECT DISTINCT item_id, n, array_to_string(a[i:i + n - 1], ' ') AS w
           FROM (SELECT *, unnest(range(1, len(a) - n + 2)) AS i FROM it)),
    dw AS (SELECT r, i, n, array_to_string(a[i:i + n - 1], ' ') AS w
           FROM (SELECT r, a, n, unnest(range(1, len(a) - n + 2)) AS i FROM d CROSS JOIN (SELECT DISTINCT n FROM it))),
    hit AS (SELECT r, i, n, item_id FROM dw JOIN iw USING (n, w)),
    places AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r),
    named AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ','
              ORDER BY CAST(item_id AS VARCHAR)) AS items FROM hit GROUP BY r)
    SELECT doc_id, CAST(len(a) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
        sha256(coalesce(items, '')) AS items_sha256,
        coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(a) AS contaminated
    FROM d LEFT JOIN places USING (r) LEFT JOIN named USING (r)"""

_WORD = r"[^\x20\x09-\x0D]"
_OF = {
    "lower": "[a-z]", "upper": "[A-Z]", "accented": r"[^\x00-\x7F]", "digit": "[0-9]", "space": r"[ \t\x0b\f\r]",
    "line": r"\n", "stop": r"[.,;:''\"()\-]", "shout": "[!?]", "symbol": "[#*$%&|<>]",
}
_COUNTS = ", ".join(f"length(t) - length(regexp_replace(t, '{p}+', '', 'g')) AS k_{c}" for c, p in _OF.items())
_OTHER = " - ".join(["length(t)", *(f"k_{c}" for c in _OF)])
_COMMON = ", ".join(f"'{w}'" for w in sorted({w for words in COMMON_WORDS.values() for w in words.split()}))
_LANGS = ", ".join(f"'{x}'" for x in COMMON_WORDS)


def _part(x: str, m: str) -> str:
    return f"CASE WHEN {x} > 0 THEN {x} * log2({x} / ({m})) ELSE 0 END"


_BOTH = f"{_part('p', '(p + q) / 2')} + {_part('q', '(p + q) / 2')}"

DIVERGENCE = f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
                   CASE WHEN lang IN ({_LANGS}) THEN lang ELSE '' END AS known FROM documents),
    w AS (SELECT r, known, unnest(a) AS word, generate_subscripts(a, 1) AS i
          FROM (SELECT r, known, regexp_extract_all(t, '{_WORD}+') AS a FROM d)),
    n AS (SELECT r, count(*) AS n_words, sum(length(word)) AS word_chars FROM w GROUP BY r),
    runs AS (SELECT r, i, word AS x, lead(word, 1) OVER s AS y, lead(word, 2) OVER s AS z FROM w
             WINDOW s AS (PARTITION BY r ORDER BY i)),
    many AS (SELECT r, i, count(*) OVER (PARTITION BY r, x, y, z) AS c FROM runs WHERE z IS NOT NULL),
    again AS (SELECT r, count(DISTINCT p) AS n_repeat_words
              FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM many WHERE c > 1) GROUP BY r),
    rows_ AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines
              FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d)
              WHERE regexp_matches(line, '{_WORD}') GROUP BY r),
    k AS (SELECT *, {_OTHER} AS k_other FROM (SELECT r, known, t, {_COUNTS} FROM d)),
    kc AS (SELECT r, known, unnest([{', '.join(f'k_{c}' for c in CLASSES)}]) AS n,
               unnest([{', '.join(f"'{c}'" for c in CLASSES)}]) AS c FROM k),
    langs AS (SELECT DISTINCT known FROM d UNION SELECT ''),
    ref_c AS (SELECT l.known, c, sum(n) AS n FROM langs l JOIN kc ON l.known IN ('', kc.known) GROUP BY ALL),
    tot_c AS (SELECT known, sum(n) AS n FROM ref_c GROUP BY known),
    js_c AS (SELECT r, sqrt(greatest(sum({_BOTH}) / 2, 0)) AS js
             FROM (SELECT kc.r, kc.n / g.n AS p, ref_c.n / tot_c.n AS q FROM kc
                   JOIN (SELECT r, sum(n) AS n FROM kc GROUP BY r) g USING (r)
                   JOIN ref_c ON ref_c.known = kc.known AND ref_c.c = kc.c JOIN tot_c ON tot_c.known = kc.known
                   WHERE g.n >= {CHARS_GUARD}) GROUP BY r),
    cw AS (SELECT r, known, lower(word) AS c, count(*) AS n FROM w WHERE lower(word) IN ({_COMMON}) GROUP BY ALL),
    ref_w AS (SELECT l.known, c, sum(n) AS n FROM langs l JOIN cw ON l.known IN ('', cw.known) GROUP BY ALL),
    tot_w AS (SELECT known, sum(n) AS n FROM ref_w GROUP BY known),
    js_w AS (SELECT r, sqrt(greatest((sum({_BOTH}) + greatest(1 - sum(q), 0)) / 2, 0)) AS js
             FROM (SELECT cw.r, cw.n / g.n AS p, ref_w.n / tot_w.n AS q FROM cw
                   JOIN (SELECT r, sum(n) AS n FROM cw GROUP BY r) g USING (r)
                   JOIN ref_w ON ref_w.known = cw.known AND ref_w.c = cw.c JOIN tot_w ON tot_w.known = cw.known
                   WHERE g.n >= {WORDS_GUARD}) GROUP BY r),
    base AS (SELECT d.doc_id, coalesce(n_words, 0) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars,
                 k_symbol AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
                 coalesce(n_repeat_words, 0) AS n_repeat_words, js_c.js AS js_chars, js_w.js AS js_words
             FROM d JOIN k USING (r) LEFT JOIN n USING (r) LEFT JOIN rows_ USING (r) LEFT JOIN again USING (r)
             LEFT JOIN js_c USING (r) LEFT JOIN js_w USING (r))
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
        n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
        NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
            AND coalesce(js_chars, 0) <= {CHARS_LIMIT} AND coalesce(js_words, 0) <= {WORDS_LIMIT} AS kept,
        round(js_chars, 6) AS js_chars, round(js_words, 6) AS js_words FROM base"""


# The remainder of a polynomial division, a byte (0 or more) or a bit (-1) at a time.
_CRC = """xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''),
    lambda x: [CAST(ascii(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END), 4294967295)"""

TRIE = f"""
    WITH t AS (SELECT conv_id, len(role) || ':' || role || txt AS turn, len(txt) AS size,
                   row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, txt) AS i
               FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS txt FROM conversations
                     WHERE conv_id IS NOT NULL)),
    c AS (SELECT conv_id, conv_id - conv_id % 100 AS home, {_CRC} % 6 AS h FROM (SELECT DISTINCT conv_id FROM t)),
    r AS (SELECT c.conv_id, 0 AS own, i, turn, size FROM c JOIN t ON t.conv_id = home AND i <= h
          UNION ALL SELECT c.conv_id, 1, i, turn, size FROM c JOIN t ON t.conv_id = c.conv_id AND i > h),
    p AS (SELECT conv_id, list(turn ORDER BY own, i) AS turns, list(size ORDER BY own, i) AS sizes FROM r GROUP BY conv_id),
    a AS (SELECT c.conv_id, coalesce(turns, []) AS turns, coalesce(sizes, []) AS sizes FROM c LEFT JOIN p USING (conv_id)),
    m AS (SELECT conv_id, d, turns[1:d] AS k, turns[1:d - 1] AS up, d = len(turns) AS ended,
              CASE WHEN d > 0 THEN sizes[d] ELSE 0 END AS size
          FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM a)),
    n AS (SELECT k, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(size) AS saved,
              any_value(up) AS up, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)
              FILTER (ended), '')) AS ends_sha256
          FROM m GROUP BY k, d),
    kids AS (SELECT up AS k, depth - 1 AS depth, count(*) AS n FROM n WHERE depth > 0 GROUP BY ALL),
    s AS (SELECT n.*, coalesce(kids.n, 0) AS n_children FROM n LEFT JOIN kids USING (k, depth)),
    below AS (SELECT k[1:d] AS k, d AS depth, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved_tokens
              FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM s) GROUP BY ALL)
    SELECT s.conv_id, s.depth, u.conv_id AS parent_conv_id, s.n_convs, s.n_children, n_leaves,
        CAST(saved_tokens AS BIGINT) AS saved_tokens, s.ends_sha256
    FROM s JOIN below USING (k, depth) LEFT JOIN s u ON u.k = s.up AND u.depth = s.depth - 1"""

_ALPHABET = r"'[^\x00-\x40\x5B-\x60\x7B-\x7F]+'"

SOURCE_DIVERGENCE = f"""
    WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                   regexp_extract_all({_LOWERED}, {_ALPHABET}) AS words FROM documents),
    w AS (SELECT r, lang, source, unnest(words) AS term FROM d),
    kept AS (SELECT lang, term, count(*) AS n FROM w GROUP BY ALL HAVING count(DISTINCT r) >= 3),
    langs AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY ALL),
    c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY ALL),
    totals AS (SELECT lang, source, sum(n) AS n FROM c GROUP BY ALL),
    g AS (SELECT DISTINCT d.lang, d.source, coalesce(v, 0) AS v, coalesce(totals.n, 0) AS n FROM d
          LEFT JOIN langs USING (lang) LEFT JOIN totals USING (lang, source)),
    p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
              CAST(1 + (1000000000 * (coalesce(c.n, 0) + 1)) // (g.n + g.v) AS HUGEINT) AS p,
              CAST(1 + (1000000000 * (k.n + 1)) // (langs.n + langs.v) AS HUGEINT) AS q
          FROM g JOIN kept k USING (lang) JOIN langs USING (lang) LEFT JOIN c USING (lang, source, term)),
    pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
              FROM p a JOIN p b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL),
    ranked AS (
        SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
        FROM g a JOIN g b USING (lang) LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source
            AND pairs.item = b.source WHERE a.source <> b.source
        UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q)
    SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
    FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM ranked)
    WHERE part = 'pair' OR rank <= 200"""
