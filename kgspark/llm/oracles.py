"""SQL for DuckDB with the results of the corpus queries that SQL can express."""

from __future__ import annotations

from kgspark.llm.licenses import TEMPLATES, THRESHOLD

ORACLES: dict[str, str] = {}

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

ORACLES["op2_quality_rules"] = rf"""
WITH w AS (SELECT doc_id, source, coalesce(text, '') AS t, {_WORDS} AS ws FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(ws) - 6)) AS i, ws FROM w WHERE len(ws) >= 8),
grams AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS g FROM win),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM grams) WHERE c > 1),
steps AS (SELECT doc_id, least(8, i - lag(i, 1, -8) OVER (PARTITION BY doc_id ORDER BY i)) AS own FROM twice),
rep AS (SELECT doc_id, sum(own) AS n FROM steps GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM w),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT w.doc_id, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN dup USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
h AS (SELECT source, count(*) AS n, sum(CAST(base_failed AS INT)) AS f FROM b WHERE source IS NOT NULL GROUP BY source),
p AS (SELECT avg(f::DOUBLE / n) AS mean, avg((f::DOUBLE / n) * (f::DOUBLE / n)) - avg(f::DOUBLE / n) * avg(f::DOUBLE / n) AS var FROM h),
q AS (SELECT mean, CASE WHEN var > 1e-12 THEN least(greatest(mean * (1 - mean) / var - 1, 1.0), 1e6) ELSE 1e6 END AS weight FROM p),
bad AS (SELECT source FROM h, q WHERE (f + mean * weight) / (n + weight) > 0.8)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND (source IS NULL OR source NOT IN (SELECT source FROM bad)) AS kept FROM b"""

ORACLES["op4_line_dedup"] = rf"""
WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, generate_subscripts(ls, 1) AS i, unnest(ls) AS line FROM s),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), '{_UP}', '{_LOW}') AS key FROM l),
f AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
d AS (SELECT k.doc_id, i, line, f.key IS NOT NULL AND keeper <> k.doc_id AS gone FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM d GROUP BY doc_id"""

ORACLES["op5_mixing"] = rf"""
WITH d AS (SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size, md5(coalesce(doc_id::VARCHAR, 'null')) AS digest FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1 AS weight, 3 * source_size AS cap FROM s),
r AS (SELECT *, row_number() OVER (ORDER BY cap::DOUBLE / weight, encode(source) NULLS LAST) AS rank FROM w),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
  / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS level FROM r),
x AS (SELECT arg_min(level, rank) AS level FROM l WHERE level * weight <= cap),
t AS (SELECT r.source, source_size, least(cap::DOUBLE, coalesce(x.level * weight, cap::DOUBLE)) AS target FROM r, x),
n AS (SELECT d.*, row_number() OVER (PARTITION BY source ORDER BY size, digest) AS k FROM d),
j AS (SELECT n.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS rate,
  CAST('0x' || substr(md5('mix-1|' || coalesce(n.source, 'null')), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM n JOIN t ON n.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(least(floor(rate * k + u) - floor(rate * (k - 1) + u), 3) AS BIGINT) * size AS taken FROM j"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_FORMS = ", ".join(f"({_quoted(name)}, {_quoted(w)})" for name, ws in sorted(TEMPLATES.items()) for w in ws)
ORACLES["op6_license_scan"] = rf"""
WITH v AS (SELECT * FROM (VALUES {_FORMS}) AS v(license, wording)),
f AS (SELECT license, list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS form FROM (SELECT license, list_filter(string_split(regexp_replace(lower(wording), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' '), lambda w: w <> '') AS ws FROM v)),
p AS (SELECT DISTINCT doc_id, passage FROM (SELECT doc_id, unnest(list_append(string_split(coalesce(text, ''), chr(10)), coalesce(text, ''))) AS passage FROM documents)),
w AS (SELECT doc_id, passage, list_filter(string_split(regexp_replace(lower(passage), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' '), lambda w: w <> '') AS ws FROM p),
b AS (SELECT doc_id, list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS pairs, array_to_string(ws, ' ') AS plain FROM w WHERE len(ws) > 1),
s AS (SELECT doc_id, license, plain, 2.0::DOUBLE * len(list_intersect(pairs, form)) / (len(pairs) + len(form)) AS dice FROM b, f WHERE len(pairs) <= 3 * len(form))
SELECT doc_id, license, max(dice) AS score, count(DISTINCT plain) AS n_passages FROM s WHERE dice >= {THRESHOLD} GROUP BY doc_id, license"""

ORACLES["op7_url_filter"] = rf"""
WITH r AS (SELECT * FROM (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')) AS r(verdict, h, p)),
u AS (SELECT page_id, CASE WHEN url LIKE '%://%' THEN regexp_replace(substr(url, strpos(url, '://') + 3), '(?s)[?#].*$', '') ELSE '' END AS rest FROM pages),
x AS (SELECT page_id, translate(split_part(rest, '/', 1), '{_UP}', '{_LOW}') AS host, substr(rest, length(split_part(rest, '/', 1)) + 1) AS path FROM u),
m AS (SELECT page_id, host, path, h || p AS rule, r.verdict, row_number() OVER (PARTITION BY page_id ORDER BY len(string_split(h, '.')) DESC NULLS LAST, length(p) DESC) AS k
  FROM x LEFT JOIN r ON (host = h OR suffix(host, '.' || h)) AND prefix(path, p))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1"""

ORACLES["op11_exact_dedup"] = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256 FROM d"""

ORACLES["op12_source_divergence"] = rf"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), '{_UP}', '{_LOW}') AS t FROM documents),
g AS (SELECT lang, source FROM d GROUP BY ALL),
w AS (SELECT row, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS MATERIALIZED (SELECT lang, term, count(*)::BIGINT AS lang_n FROM w GROUP BY lang, term HAVING count(DISTINCT row) >= 10),
v AS (SELECT lang, count(*)::BIGINT AS v, sum(lang_n)::BIGINT AS lang_total FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*)::BIGINT AS n FROM w JOIN k USING (lang, term) GROUP BY ALL),
s AS (SELECT lang, source, sum(n)::BIGINT AS total FROM c GROUP BY ALL),
p AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n, 1 + 1000000000 * (coalesce(n, 0) + 2) // (coalesce(total, 0) + 2 * v) AS p, 1 + 1000000000 * (lang_n + 2) // (lang_total + 2 * v) AS q
  FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term) LEFT JOIN s USING (lang, source)),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p))::BIGINT AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))::INT AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
WHERE part = 'pair' OR rank <= 10"""

ORACLES["op13_lexical_search"] = rf"""
WITH w AS (SELECT row, doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM (SELECT row_number() OVER () AS row, * FROM documents)),
i AS (SELECT item_id, term, count(*)::BIGINT AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
tf AS MATERIALIZED (SELECT row, doc_id, term, count(*)::BIGINT AS tf FROM w GROUP BY ALL),
size AS (SELECT row, sum(tf)::BIGINT AS n FROM tf GROUP BY row),
all_ AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS total FROM size),
m AS (SELECT row, 25 + (75 * n * docs) // total AS m FROM size, all_),
wt AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, all_ GROUP BY term, docs),
s AS (SELECT item_id, row, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM i JOIN tf USING (term) JOIN wt USING (term) JOIN m USING (row) GROUP BY ALL)
SELECT item_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM s WHERE score > 0) WHERE rank <= 10"""
