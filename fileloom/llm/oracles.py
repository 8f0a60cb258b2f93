"""DuckDB SQL of the operators that SQL can express."""

from __future__ import annotations

from fileloom.llm import quality_rules as q

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"

LINKS = rf"""
WITH RECURSIVE docs AS (SELECT doc_id, {WORDS.format(text=f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')")} AS w FROM documents),
sets AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS s FROM docs),
named AS (SELECT s, row_number() OVER () AS t FROM (SELECT s FROM sets GROUP BY s HAVING count(*) > 1)),
tokens AS (SELECT doc_id, t FROM sets JOIN named USING (s)),
n AS (SELECT doc_id, count(*)::BIGINT AS n FROM sets GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM tokens a JOIN tokens b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT a, b FROM ways UNION SELECT reach.a, ways.b FROM reach JOIN ways ON reach.b = ways.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(r.m, d.doc_id))::BIGINT AS component_id
FROM docs d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) r ON r.a = d.doc_id"""


#: Every window of 50 words, those that several documents have, and islands of them.
REPEATS = rf"""
WITH d AS (SELECT doc_id, {WORDS.format(text="coalesce(text, '')")} AS w FROM documents),
windows AS (SELECT doc_id, (i - 1)::INT AS start, array_to_string(w[i:i + 49], ' ') AS key FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d)),
several AS (SELECT key, min(doc_id) AS lo FROM windows GROUP BY key HAVING min(doc_id) < max(doc_id)),
found AS (SELECT doc_id, start, doc_id > lo AS copy FROM windows JOIN several USING (key)),
marked AS (SELECT *, coalesce(start > lag(start) OVER (PARTITION BY doc_id, copy ORDER BY start) + 50, true)::INT AS fresh FROM found),
islands AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, copy ORDER BY start) AS island FROM marked)
SELECT doc_id, min(start) AS start_word, (max(start) + 50 - min(start))::BIGINT AS n_words, copy FROM islands GROUP BY doc_id, copy, island"""


def _quality() -> str:
    refs = q.References()
    patterns = ["a-z", r"\x{C0}-\x{1FFF}\x{3000}-\x{FFFF}", "A-Z", "0-9", r"\x20\x09-\x0D", ".,;:!?''\"()\\-"]
    counts = ", ".join(f"length(regexp_replace(text, '[^{p}]', '', 'g')) AS k{i}" for i, p in enumerate(patterns))
    class_refs = ", ".join(f"('{lang}', {i}, {float(share)!r}::DOUBLE)" for lang, shares in zip(refs.languages, refs.classes, strict=True) for i, share in enumerate(shares))
    word_refs = ", ".join(f"('{lang}', '{w}', {float(share)!r}::DOUBLE)" for lang, own in zip(refs.languages, refs.words, strict=True) for w, share in zip([*q.COMMON_WORDS[lang].split(), "-"], own, strict=True))
    gain = "p * log2(2 * p / (p + q)) + q * log2(2 * q / (p + q)) - q"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, {WORDS.format(text="text")} AS w FROM d),
tri AS (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS c FROM (SELECT r, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda k: w[k] || ' ' || w[k + 1] || ' ' || w[k + 2])) AS s FROM w)),
rep AS (SELECT r, count(DISTINCT j)::BIGINT AS c FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM tri WHERE c > 1) GROUP BY r),
base AS (SELECT d.r, doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
 length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
 (len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))))::BIGINT AS n_dup_lines,
 coalesce(rep.c, 0)::BIGINT AS n_repeat_words FROM d JOIN w USING (r) LEFT JOIN rep USING (r)),
k AS (SELECT r, length(text)::DOUBLE AS n, {counts} FROM d),
far AS (SELECT r, length(regexp_replace(text, '[^\x{{340}}-\x{{1FFF}}\x{{3000}}-\x{{FFFF}}]', '', 'g')) AS far FROM d),
kinds AS (SELECT r, n, unnest([k0, k1, k2, k3, k4, k5, n - k0 - k1 - k2 - k3 - k4 - k5]) AS c, unnest(range(7)) AS i, k0 + k1 + k2 AS letters FROM k),
cd AS (SELECT r, lang, any_value(n) AS n, any_value(letters) AS letters, CASE WHEN any_value(n) = 0 THEN 1 ELSE sqrt(greatest((1 + sum(CASE WHEN c > 0 THEN {gain} ELSE 0 END)) / 2, 0)) END AS class_distance
 FROM (SELECT r, lang, n, letters, c, c / CASE WHEN n = 0 THEN 1 ELSE n END AS p, q FROM kinds JOIN (VALUES {class_refs}) v(lang, i, q) USING (i)) GROUP BY r, lang),
tok AS (SELECT r, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[a-z\x{{80}}-\x{{10FFFF}}]+')) AS t FROM d),
tokn AS (SELECT r, count(*) AS n FROM tok GROUP BY r), ref AS (SELECT * FROM (VALUES {word_refs}) v(lang, t, q)),
hits AS (SELECT r, lang, t, q, count(*) AS c FROM tok JOIN ref USING (t) GROUP BY ALL),
alls AS (SELECT r, lang, q, c FROM hits UNION ALL SELECT tokn.r, ref.lang, ref.q, tokn.n - coalesce(h.c, 0) FROM tokn JOIN ref ON ref.t = '-' LEFT JOIN (SELECT r, lang, sum(c) AS c FROM hits GROUP BY r, lang) h ON h.r = tokn.r AND h.lang = ref.lang),
wd AS (SELECT r, lang, any_value(n) AS n, sqrt(greatest((1 + sum({gain})) / 2, 0)) AS word_distance FROM (SELECT alls.r, lang, n, q, c / n::DOUBLE AS p FROM alls JOIN tokn USING (r) WHERE c > 0) GROUP BY r, lang),
best AS (SELECT cd.r, cd.n, letters, coalesce(wd.n, 0) AS tokens, class_distance, coalesce(word_distance, 1) AS word_distance, row_number() OVER (PARTITION BY cd.r ORDER BY class_distance + coalesce(word_distance, 1), cd.lang) AS place FROM cd LEFT JOIN wd USING (r, lang))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed AS base_failed,
 NOT failed AND (2 * far > letters OR NOT (n >= {q.MIN_LETTERS} AND class_distance > {q.MAX_CLASS_DISTANCE}) AND NOT (letters >= {q.MIN_LETTERS} AND tokens >= {q.MIN_TOKENS} AND word_distance > {q.MAX_WORD_DISTANCE})) AS kept
FROM (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS failed FROM base) JOIN best USING (r) JOIN far USING (r) WHERE place = 1"""


QUALITY = _quality()
