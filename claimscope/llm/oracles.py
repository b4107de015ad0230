"""DuckDB SQL for the training-data queries that SQL can express on whole tables."""

from __future__ import annotations

from claimscope.llm import rules
from claimscope.llm.decontaminate import LOWER, SIZE, UPPER

# After A-Z have been lower-cased, what separates words is ASCII but for digits and a-z.
_WORDS = f"list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^0-9a-z\\x{{80}}-\\x{{10FFFF}}]+'), lambda x: x <> '')"

DECONTAMINATE = f"""
WITH items AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
places AS (SELECT item_id, w, unnest(range(1, greatest(len(w) - {SIZE - 1}, 1) + 1)) AS i FROM items WHERE len(w) > 0),
windows AS (
    SELECT DISTINCT item_id, least(len(w), {SIZE}) AS n, array_to_string(w[i:i + {SIZE - 1}], ' ') AS win FROM places
),
docs AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
spots AS (
    SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s
    FROM docs JOIN (SELECT DISTINCT n FROM windows) lengths ON len(w) >= n
),
hits AS (
    SELECT spots.r, spots.s, spots.n, windows.item_id
    FROM spots JOIN windows ON windows.n = spots.n AND windows.win = array_to_string(spots.w[spots.s:spots.s + spots.n - 1], ' ')
),
covered AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(s, s + n)) AS p FROM hits) x GROUP BY r),
found AS (
    SELECT r, count(id) AS n, sha256(string_agg(id, ',' ORDER BY id)) AS sha
    FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM hits) x GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(covered.n, 0) AS n_hit, coalesce(found.n, 0) AS n_items,
       coalesce(found.sha, sha256('')) AS items_sha256, covered.n IS NOT NULL AS contaminated
FROM docs LEFT JOIN covered USING (r) LEFT JOIN found USING (r)
"""


def _rules() -> str:
    known = sorted(set(rules.COMMON))
    listed = ", ".join(f"'{w}'" for w in known)
    steps, left = [], "t0"
    for k, (name, pattern) in enumerate(rules.CLASSES, 1):
        quoted = pattern.replace("'", "''")
        steps.append(f"s{k} AS (SELECT *, regexp_replace({left}, '{quoted}', '', 'g') AS t{k} FROM s{k - 1})")
        left = f"t{k}"
    width = len(rules.CLASSES) + 1
    shares = [f"(length(t{k - 1}) - length(t{k})) / size AS c{k - 1}" for k in range(1, width)] + [f"length({left}) / size AS c{width - 1}"]
    cols = ", ".join(f"c{k}" for k in range(width))

    def part(p: str, q: str) -> str:
        def side(a: str, b: str) -> str:
            return f"CASE WHEN {a} > 0 THEN {a} * log2(2.0 * {a} / ({a} + {b})) ELSE 0.0 END"

        return f"0.5 * ({side(p, q)} + {side(q, p)})"

    chars = " + ".join(part(f"d.c{k}", f"l.c{k}") for k in range(width))
    space = [name for name, _ in rules.CLASSES].index("space")
    return f"""
WITH s0 AS (
    SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS text, coalesce(text, '') AS t0,
           CAST(greatest(length(coalesce(text, '')), 1) AS DOUBLE) AS size,
           list_filter(string_split_regex(coalesce(text, ''), '{rules.SPACE}'), lambda x: x <> '') AS w
    FROM documents
),
{", ".join(steps)},
wins AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS win FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM s0) x),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS n FROM wins) x WHERE n > 1),
again AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 3)) AS p FROM twice) x GROUP BY r),
lines AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM s0),
dups AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY r),
d AS (
    SELECT s.r, doc_id, lang, length(text) AS n_chars, len(w) AS n_words,
           length(text) - (length(t{space}) - length(t{space + 1})) AS word_chars,
           length(regexp_replace(text, '{rules.SYMBOLS}', '', 'g')) AS n_symbols,
           coalesce(dups.n, 0) AS n_dup_lines, coalesce(again.n, 0) AS n_repeat_words,
           len(w) < {rules.MIN_WORDS} OR 100 * coalesce(again.n, 0) > {rules.REPEAT_PERCENT} * len(w) AS base_failed,
           {", ".join(shares)}
    FROM s{width - 1} s LEFT JOIN again USING (r) LEFT JOIN dups USING (r)
),
common AS (
    SELECT r, word, count(*) AS n FROM (SELECT r, translate(unnest(w), '.,;:', '') AS word FROM s0) x
    WHERE word IN ({listed}) GROUP BY r, word
),
p AS (SELECT r, word, n / greatest(n_words, 1) AS p FROM common JOIN d USING (r)),
l AS (
    SELECT lang AS ref, count(*) AS docs, {", ".join(f"avg(c{k}) AS c{k}" for k in range(width))}
    FROM d WHERE lang IS NOT NULL AND NOT base_failed GROUP BY lang
),
q AS (
    SELECT lang AS ref, word, sum(p) / any_value(l.docs) AS q
    FROM p JOIN d USING (r) JOIN l ON l.ref = d.lang WHERE NOT base_failed GROUP BY lang, word
),
q_mass AS (SELECT ref, sum(q) AS mass FROM q GROUP BY ref),
met AS (
    SELECT p.r, l.ref, sum(p.p) AS mass, sum({part("p.p", "coalesce(q.q, 0)")}) AS js, sum(coalesce(q.q, 0)) AS seen
    FROM p CROSS JOIN l LEFT JOIN q ON q.ref = l.ref AND q.word = p.word GROUP BY p.r, l.ref
),
near AS (
    SELECT d.r, l.ref,
           CASE WHEN d.n_chars >= {rules.MIN_CHARS_JUDGED} THEN sqrt(greatest({chars}, 0)) END AS c,
           CASE WHEN d.n_words >= {rules.MIN_WORDS_JUDGED} THEN sqrt(greatest(
               coalesce(met.js, 0) + 0.5 * (coalesce(q_mass.mass, 0) - coalesce(met.seen, 0))
               + {part("greatest(1.0 - coalesce(met.mass, 0), 0)", "greatest(1.0 - coalesce(q_mass.mass, 0), 0)")}, 0)) END AS w
    FROM d CROSS JOIN l LEFT JOIN met ON met.r = d.r AND met.ref = l.ref LEFT JOIN q_mass ON q_mass.ref = l.ref
),
best AS (
    SELECT * FROM (
        SELECT *, row_number() OVER (PARTITION BY r ORDER BY coalesce(c, 0) + coalesce(w, 0), ref) AS k FROM near
    ) x WHERE k = 1
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND coalesce(best.c, 0) <= {rules.MAX_CHAR_DISTANCE} AND coalesce(best.w, 0) <= {rules.MAX_WORD_DISTANCE} AS kept
FROM d LEFT JOIN best USING (r)
"""



#: crc32 of a list of byte values, by the reflected polynomial, from a table made by its rule.
_CRC_TABLE = """list_transform(range(0, 256), lambda i: list_reduce(range(0, 8),
    lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i))"""

_RUN = "[A-Za-z\\x{C0}-\\x{FF}]+"

SPELLING = f"""
WITH crc AS (SELECT {_CRC_TABLE} AS t),
runs AS (
    SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc, translate(run, '{UPPER}', '{LOWER}') AS run
    FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{_RUN}')) AS run FROM documents)
),
pairs AS (SELECT doc, run, count(*) AS k, hex(encode(doc || ':' || run)) AS x FROM runs GROUP BY doc, run),
hashed AS (
    SELECT run, k, xor(4294967295, list_reduce(
        list_transform(range(1, length(x), 2), lambda i: CAST('0x' || substr(x, i, 2) AS BIGINT)),
        lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295)) AS h
    FROM pairs, crc
),
words AS (
    SELECT word, CAST(sum(k) AS BIGINT) AS n
    FROM (SELECT k, CASE WHEN h % 199 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2)
                         ELSE run END AS word FROM hashed)
    WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5
),
cuts AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
         FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
    SELECT DISTINCT * FROM (
        SELECT a.word, b.word AS near, b.n AS near_n FROM cuts a JOIN cuts b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
        UNION ALL SELECT a.word, b.word, b.n FROM cuts a JOIN words b ON a.rest = b.word
        UNION ALL SELECT b.word, a.word, a.n FROM cuts a JOIN words b ON a.rest = b.word
    )
),
best AS (SELECT word, count(*) AS n_near, arg_min(near, (-near_n, encode(near))) AS near, max(near_n) AS near_n FROM near GROUP BY word),
told AS (
    SELECT words.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * n THEN near END AS form,
           CASE WHEN near_n >= 5 * n THEN near_n END AS form_n
    FROM words LEFT JOIN best USING (word)
),
ends AS (
    WITH RECURSIVE chain(word, root) AS (
        SELECT word, word FROM told UNION ALL
        SELECT chain.word, told.form FROM chain JOIN told ON told.word = chain.root WHERE told.form IS NOT NULL
    )
    SELECT chain.word, chain.root FROM chain JOIN told ON told.word = chain.root WHERE told.form IS NULL
)
SELECT told.word, form, root, n, n_near, form_n FROM told JOIN ends USING (word)
"""

_TEXT_WORDS = "list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"

FILTER_AUDIT = f"""
WITH texts AS (
    SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, {_TEXT_WORDS} AS w FROM documents
),
marks AS (SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
judged AS (
    SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
           CASE WHEN len(w) < 200 THEN 1 ELSE 0 END
         + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
         + CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t) THEN 4 ELSE 0 END
         + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
         + CASE WHEN coalesce(min(doc_id) OVER (PARTITION BY t) < doc_id, false) THEN 16 ELSE 0 END AS mask
    FROM texts LEFT JOIN marks USING (doc_id)
),
patterns AS (SELECT part, mask, good, toxic, count(*) AS n FROM judged GROUP BY ALL),
letters AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) x(f, bit)),
orders AS (
    SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
    FROM letters a JOIN letters b ON b.f <> a.f JOIN letters c ON c.f NOT IN (a.f, b.f)
    JOIN letters d ON d.f NOT IN (a.f, b.f, c.f) JOIN letters e ON e.f NOT IN (a.f, b.f, c.f, d.f)
),
steps AS (
    SELECT filter_order, step, bits[step] AS bit, CAST(coalesce(list_sum(bits[1:step - 1]), 0) AS INTEGER) AS before
    FROM (SELECT *, unnest(range(1, 6)) AS step FROM orders)
),
told AS (
    SELECT part, filter_order, step, bit,
           sum(n) FILTER (mask & (before | bit) = 0) AS kept,
           sum(n) FILTER (mask & before = 0 AND mask & bit > 0) AS removed,
           sum(n) FILTER (mask & before > 0 AND mask & bit > 0) AS redundant,
           sum(n) FILTER (mask = bit) AS unique_fails,
           sum(n) FILTER (mask & before = 0 AND mask & bit > 0 AND good) AS good_lost,
           sum(n) FILTER (mask & before = 0 AND mask & bit > 0 AND toxic) AS toxic_lost
    FROM patterns, steps GROUP BY ALL
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept,
       CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant,
       CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost,
       CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
       CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM told
"""

ORACLE_SQL = {
    "op4_rules": _rules(), "op8_decontaminate": DECONTAMINATE, "op12_spelling": SPELLING, "op13_filter_audit": FILTER_AUDIT,
}
