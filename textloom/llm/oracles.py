"""SQL for DuckDB of operators that SQL can express, written from their descriptions."""

from __future__ import annotations

from . import licenses, line_rules, suffixes

_WORD = r"'[^\x20\x09-\x0D]+'"


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


PASSAGES = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORD}) AS w FROM documents),
g AS (SELECT doc_id, i, md5(array_to_string(w[i : i + {suffixes.MIN_WORDS - 1}], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - {suffixes.MIN_WORDS - 2})) AS i FROM w)),
m AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS keeper, max(doc_id) OVER (PARTITION BY g) AS other FROM g),
s AS (SELECT doc_id, i, keeper, doc_id <> keeper AS redundant FROM m WHERE keeper <> other),
n AS (SELECT *, CASE WHEN i - lag(i) OVER o <= {suffixes.MIN_WORDS} THEN 0 ELSE 1 END AS fresh FROM s WINDOW o AS (PARTITION BY doc_id, redundant ORDER BY i)),
p AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, redundant ORDER BY i) AS island FROM n)
SELECT doc_id, CAST(min(i) - 1 AS INT) AS start_word, CAST(max(i) + {suffixes.MIN_WORDS - 1} AS INT) AS end_word, redundant, min(keeper) AS keeper FROM p GROUP BY doc_id, redundant, island
"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LICENSES = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
t(t, label, v) AS (VALUES {", ".join(f"({i}, {_text(label)}, string_split({_text(text)}, ' '))" for i, (label, text) in enumerate(licenses.TEMPLATES))}),
ph(p, label) AS (VALUES {", ".join(f"(string_split({_text(p)}, ' '), {_text(label)})" for p, label in licenses.BASE)}),
pos AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d),
base AS (SELECT r, count(*) AS n, min(i) - 1 AS lead, max(i) - 1 AS last, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM pos JOIN ph ON w[i] = p[1] AND w[i : i + len(p) - 1] = p GROUP BY r),
tg AS (SELECT t, label, len(v) AS n, q - 1 AS q, array_to_string(v[q : q + {licenses.K - 1}], ' ') AS g FROM (SELECT t, label, v, unnest(range(1, len(v) - {licenses.K - 2})) AS q FROM t)),
votes AS (SELECT r, t, label, n, i - 1 AS p, q, i - 1 - q AS dia FROM pos JOIN tg ON i + {licenses.K - 1} <= len(w) AND array_to_string(w[i : i + {licenses.K - 1}], ' ') = g),
fresh AS (SELECT r, t, dia, CASE WHEN dia - lag(dia) OVER (PARTITION BY r, t ORDER BY dia) > {licenses.DRIFT} THEN 1 ELSE 0 END AS f FROM (SELECT DISTINCT r, t, dia FROM votes)),
isl AS (SELECT r, t, dia, sum(f) OVER (PARTITION BY r, t ORDER BY dia) AS island FROM fresh),
cov AS (SELECT r, t, label, n, island, count(DISTINCT word) AS words FROM (SELECT r, t, label, n, island, unnest(range(q, q + {licenses.K})) AS word FROM votes JOIN isl USING (r, t, dia)) GROUP BY ALL),
named AS (SELECT r, label, words / n AS share FROM cov WHERE words / n >= {licenses.LEAST}),
best AS (SELECT r, max(share) AS share FROM named GROUP BY r),
lab AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM named UNION ALL SELECT r, unnest(string_split(labels, ',')) FROM base) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(b.n, 0)::BIGINT AS n_base, lead AS first_word, last AS last_word, coalesce(b.labels, '') AS base_labels, coalesce(lab.labels, '') AS labels,
  greatest(coalesce(share, 0.0::DOUBLE), CASE WHEN b.n > 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END) AS score
FROM d LEFT JOIN base b USING (r) LEFT JOIN best USING (r) LEFT JOIN lab USING (r)
"""

LINES = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {_WORD}) AS w FROM documents),
win AS (SELECT r, i, md5(array_to_string(w[i : i + {line_rules.WINDOW - 1}], ' ')) AS g FROM (SELECT r, w, unnest(range(1, len(w) - {line_rules.WINDOW - 2})) AS i FROM d)),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + {line_rules.WINDOW})) AS p FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM win) WHERE c > 1) GROUP BY r),
l AS (SELECT r, k, x, regexp_extract_all(x, {_WORD}) AS w FROM (SELECT r, unnest(s) AS x, unnest(range(len(s))) AS k FROM (SELECT r, string_split(t, chr(10)) AS s FROM d))),
m AS (SELECT r, x, len(w) AS n, w, row_number() OVER (PARTITION BY r, x ORDER BY k) > 1 AS again, translate(x, '{_UPPER}', '{_LOWER}') AS low, len(regexp_extract_all(x, '[.!?;:]')) AS marks, len(regexp_extract_all(x, '[|]')) AS bars,
  len(regexp_extract_all(x, '[A-Z]')) AS upper, len(regexp_extract_all(x, '[A-Za-z]')) AS letters, len(regexp_extract_all(x, '!')) AS calls, len(regexp_extract_all(x, '[#*$%&|<>]')) AS symbols,
  len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS stutter FROM l WHERE len(w) > 0),
b AS (SELECT r, n, again, marks = 0 AND n < {line_rules.SHORT} OR 3 * bars >= n OR n >= 6 AND 10 * upper > 6 * letters OR n > 1 AND 2 * calls >= n OR 2 * symbols >= n OR n > 3 AND 2 * stutter >= n OR again
  OR {" OR ".join(f"contains(low, {_text(p)})" for p in line_rules.PHRASES)} AS bad FROM m),
per AS (SELECT r, count(*) AS lines, count(*) FILTER (bad) AS removed, coalesce(sum(n) FILTER (bad), 0) AS lost, count(*) FILTER (again) AS dup FROM b GROUP BY r),
o AS (SELECT doc_id, len(w) AS n, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS symbols, coalesce(dup, 0) AS dup, coalesce(rep.n, 0) AS rep,
  coalesce(lines, 0) AS lines, coalesce(removed, 0) AS removed, coalesce(lost, 0) AS lost FROM d LEFT JOIN per USING (r) LEFT JOIN rep USING (r))
SELECT doc_id, n::BIGINT AS n_words, chars::BIGINT AS word_chars, symbols::BIGINT AS n_symbols, dup::BIGINT AS n_dup_lines, rep::BIGINT AS n_repeat_words, lines::BIGINT AS n_lines, removed::BIGINT AS n_removed_lines, lost::BIGINT AS lost_words,
  n < 20 OR 100 * rep > 30 * n AS base_failed, NOT (n < 20 OR 100 * rep > 30 * n) AND lost <= {line_rules.MOST_LOST} * n AS kept FROM o
"""
