"""SQL for DuckDB with the same results as the queries, written on its own."""

from __future__ import annotations

ORACLES: dict[str, str] = {}


def _round(value: str, places: int) -> str:
    """Half up, of the value to nine places."""
    return f"CAST(round(CAST({value} AS DECIMAL(28,9)), {places}) AS DOUBLE)"


def _mean(value: str, places: int) -> str:
    return _round(f"sum(CAST({value} AS DECIMAL(20,10)))::DOUBLE / count(*)", places)


_CB = r"""
lines AS (SELECT doc_id, generate_subscripts(s, 1) - 1 AS position, unnest(s) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents WHERE text IS NOT NULL)),
cb AS (SELECT doc_id, position,
  CASE WHEN length(line) <= 60 THEN 'heading' WHEN (doc_id + position) % 23 = 0 THEN 'code' WHEN (doc_id + position) % 17 = 0 THEN 'list' ELSE 'paragraph' END AS type,
  1 + length(line) % 4 AS hl,
  CASE WHEN length(line) <= 60 THEN line ELSE
    (CASE (doc_id * 31 + position) % 9 WHEN 0 THEN 'It is defined as ' WHEN 1 THEN 'For example, ' WHEN 2 THEN 'It refers to ' WHEN 3 THEN 'Consider ' ELSE '' END)
    || (CASE WHEN (doc_id + position) % 2 = 0 THEN replace(line, ', ', ' therefore ') ELSE line END) END AS text
  FROM lines WHERE trim(line) <> '')"""

_SENTENCES = r"""
plain AS (SELECT *, trim(regexp_replace(text, '\s+', ' ', 'g')) AS p FROM cb),
sents AS (SELECT *, list_filter(string_split(regexp_replace(p, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS s FROM plain)"""

_SECTIONS = r"""
marked AS (SELECT *, sum(CASE WHEN type = 'heading' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY position)
  + CASE WHEN first_value(type) OVER (PARTITION BY doc_id ORDER BY position) = 'heading' THEN 0 ELSE 1 END AS section FROM cb),
secs AS (SELECT doc_id, section AS idx, text AS heading, hl AS level FROM marked WHERE type = 'heading'
  UNION ALL SELECT doc_id, 1, 'Introduction', 1 FROM (SELECT doc_id FROM marked WHERE section = 1 GROUP BY doc_id HAVING sum(CASE WHEN type = 'heading' THEN 1 ELSE 0 END) = 0)),
par AS (SELECT s.doc_id, s.idx, s.heading, s.level, max(p.idx) AS parent FROM secs s LEFT JOIN secs p ON p.doc_id = s.doc_id AND p.idx < s.idx AND p.level < s.level GROUP BY ALL),
tree AS (SELECT doc_id, idx, heading, level, parent, 1 AS depth, heading AS path FROM par WHERE parent IS NULL
  UNION ALL SELECT c.doc_id, c.idx, c.heading, c.level, c.parent, t.depth + 1, t.path || ' > ' || c.heading FROM par c JOIN tree t ON c.doc_id = t.doc_id AND c.parent = t.idx)"""

# Transition, definition and example phrases.
_PHRASES = ("however", "for example", "in contrast", "therefore", "this means", "on the other hand", "furthermore", "moreover", "nevertheless", "consequently", "in addition", "similarly", "alternatively", "specifically", "for instance")
_DEFINES = ("is defined as", "refers to", "is called", "means that", "can be defined as", "is known as", "we define", "definition:")
_SHOWS = ("for example", "for instance", "consider", "let''s say", "suppose", "imagine that", "e.g.", "such as")


def _any(c: str, phrases: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({c}, '{p}')" for p in phrases) + ")"


_CHUNKS = rf"""
body AS (SELECT m.doc_id, m.position, m.type, m.section, m.text, s.p, s.s FROM marked m JOIN sents s USING (doc_id, position) WHERE m.type <> 'heading'),
parts AS (SELECT doc_id, position, type, section, CASE WHEN type = 'code' OR length(p) < 100 OR len(s) <= 2 THEN [CASE WHEN type = 'code' THEN trim(text) ELSE p END] ELSE s END AS s FROM body),
flat AS (SELECT doc_id, position, type, section, generate_subscripts(s, 1) AS n, unnest(s) AS sentence FROM parts),
runs AS (SELECT *, coalesce(sum(CASE WHEN {_any("lower(sentence)", _PHRASES)} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, position ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM flat),
fives AS (SELECT *, (row_number() OVER (PARTITION BY doc_id, position, run ORDER BY n) - 1) // 5 AS part FROM runs),
chunked AS (SELECT doc_id, position, any_value(type) AS type, any_value(section) AS section, run, part, string_agg(sentence, ' ' ORDER BY n) AS text FROM fives GROUP BY doc_id, position, run, part),
chunks AS (SELECT *, row_number() OVER (PARTITION BY doc_id, position ORDER BY run, part) - 1 AS chunk FROM chunked),
sem AS (SELECT c.*, t.parent, row_number() OVER (PARTITION BY c.doc_id ORDER BY c.section, position, chunk) AS ord,
  CASE WHEN type IN ('code', 'list') THEN type WHEN {_any("lower(text)", _DEFINES)} THEN 'definition' WHEN {_any("lower(text)", _SHOWS)} THEN 'example' ELSE 'explanation' END AS block_type,
  CAST(floor(len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) * 1.3) AS INT) AS tokens
  FROM chunks c JOIN tree t ON t.doc_id = c.doc_id AND t.idx = c.section)"""

_SEM = f"WITH RECURSIVE {_CB}, {_SENTENCES}, {_SECTIONS}, {_CHUNKS} "

ORACLES["sentence_split"] = f"WITH {_CB}, {_SENTENCES} SELECT doc_id, position, len(s) AS n_sentences, md5(array_to_string(s, '|')) AS digest FROM sents"
ORACLES["normalized_text"] = r"SELECT doc_id, length(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))) AS n, CAST(floor(len(list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda x: x <> '')) * 1.3) AS INT) AS tokens FROM documents"
ORACLES["semantic_chunks"] = _SEM + "SELECT doc_id, position, chunk, md5(text) AS digest FROM chunks"
ORACLES["section_tree"] = _SEM + "SELECT doc_id, 'sec_' || idx AS section_id, md5(heading) AS heading, level, idx AS order_index, 'sec_' || parent AS parent_section_id FROM tree"
ORACLES["heading_paths"] = _SEM + "SELECT doc_id, 'sec_' || idx AS section_id, depth, md5(path) AS path FROM tree"
ORACLES["semantic_blocks"] = _SEM + "SELECT substr(md5(doc_id || '|' || ord), 1, 12) AS block_id, doc_id, 'sec_' || section AS section_id, md5(text) AS digest, block_type, ord AS order_index, tokens AS token_estimate FROM sem"
ORACLES["block_types"] = _SEM + "SELECT lang, block_type, count(*) AS n_blocks, round(avg(tokens), 1) AS avg_tokens, max(tokens) AS max_tokens, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY lang), 1) AS share FROM sem JOIN documents USING (doc_id) GROUP BY lang, block_type"
ORACLES["sections_roots_only"] = _SEM + "SELECT doc_id, count(*) AS n_blocks, sum(tokens) AS tokens FROM sem WHERE parent IS NULL GROUP BY doc_id"
ORACLES["block_validation"] = _SEM + "SELECT doc_id, substr(md5(doc_id || '|' || ord), 1, 12) AS block_id, 'many tokens' AS rule, 'warning' AS severity FROM sem WHERE tokens >= 350"
ORACLES["max_blocks_per_doc"] = _SEM + "SELECT doc_id, substr(md5(doc_id || '|' || ord), 1, 12) AS block_id, ord AS order_index FROM sem WHERE ord <= 3"
ORACLES["eligible_prompts"] = _SEM + "SELECT s.doc_id, substr(md5(s.doc_id || '|' || ord), 1, 12) AS block_id, md5('Name the concepts that the text explains. Answer with JSON only: {\"concepts\": [{\"name\", \"type\", \"description\", \"confidence\"}]}.' || chr(10) || 'Context: ' || t.path || chr(10) || 'Text: ' || s.text) AS digest FROM sem s JOIN tree t ON t.doc_id = s.doc_id AND t.idx = s.section WHERE length(trim(s.text)) >= 20"

# Pages ---------------------------------------------------------------------

_UNESCAPE = "replace(replace(replace(replace(replace(replace(replace(replace(replace({}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&apos;', ''''), '&nbsp;', ' '), '&middot;', '·'), '&copy;', '©'), '&amp;', '&')"
_CLEAN = r"regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?is)<script\b[^>]*>.*?</script\s*>', '', 'g'), '(?is)<style\b[^>]*>.*?</style\s*>', '', 'g')"
_TITLE = r"coalesce(nullif(trim(regexp_replace(" + _UNESCAPE.format(r"regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)") + r", '\s+', ' ', 'g')), ''), 'Untitled')"
_PATH = r"regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)"
_ROOT = r"regexp_extract(url, '^([a-z]+://[^/?#]*)', 1)"
# The article is one span; its paragraphs end where any other block begins or ends.
_ARTICLE = rf"""
art AS (SELECT page_id, regexp_extract({_CLEAN}, '(?s)<article>(.*?)</article>', 1) AS a FROM pages),
cut AS (SELECT page_id, string_split(regexp_replace(a, '(?i)<(/?)(h[1-6]|p|ul|li|div)\b([^>]*)>', chr(1) || '\1\2' || chr(2), 'g'), chr(1)) AS t FROM art),
toks AS (SELECT page_id, generate_subscripts(t, 1) AS k, unnest(t) AS x FROM cut),
named AS (SELECT page_id, k, regexp_extract(x, '(?s)^([^' || chr(2) || ']*)', 1) AS tag, {_UNESCAPE.format("regexp_replace(regexp_extract(x, '(?s)' || chr(2) || '(.*)$', 1), '<[^>]*>', ' ', 'g')")} AS body FROM toks WHERE k > 1),
blocks AS (SELECT page_id, k, tag, trim(regexp_replace(body, '\s+', ' ', 'g')) AS text FROM named WHERE tag IN ('p', 'h1', 'h2', 'h3', 'h4', 'h5', 'h6')),
lists AS (SELECT o.page_id, o.k, 'ul' AS tag, trim(regexp_replace(string_agg(n.body, ' ' ORDER BY n.k), '\s+', ' ', 'g')) AS text
  FROM named o JOIN named n ON n.page_id = o.page_id AND n.k >= o.k AND n.k < (SELECT min(c.k) FROM named c WHERE c.page_id = o.page_id AND c.k > o.k AND c.tag = '/ul') WHERE o.tag = 'ul' GROUP BY o.page_id, o.k),
pb AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY k) - 1 AS position FROM (SELECT * FROM blocks UNION ALL SELECT * FROM lists) WHERE text <> '')"""

ORACLES["page_title"] = f"SELECT page_id, {_TITLE} AS title FROM pages"
ORACLES["page_blocks"] = f"WITH {_ARTICLE} SELECT page_id, position, CASE WHEN tag LIKE 'h%' THEN 'heading' WHEN tag = 'ul' THEN 'list' ELSE 'paragraph' END AS type, tag, md5(text) AS digest FROM pb"
ORACLES["page_links"] = rf"""WITH h AS (SELECT page_id, url, {_CLEAN} AS html FROM pages),
a AS (SELECT page_id, url, regexp_extract_all(html, '(?is)<a [^>]*href="([^"]*)"[^>]*>(.*?)</a>', 1) AS hrefs, regexp_extract_all(html, '(?is)<a [^>]*href="([^"]*)"[^>]*>(.*?)</a>', 2) AS labels FROM h),
e AS (SELECT page_id, url, generate_subscripts(hrefs, 1) - 1 AS ordinal, unnest(hrefs) AS href, unnest(labels) AS label FROM a)
SELECT page_id, ordinal, {_ROOT} || {_UNESCAPE.format("href")} AS target_url, trim(regexp_replace({_UNESCAPE.format("regexp_replace(label, '<[^>]*>', ' ', 'g')")}, '\s+', ' ', 'g')) AS anchor_text, true AS is_internal FROM e"""
ORACLES["error_pages"] = rf"""SELECT page_id, ({_any(f"lower({_TITLE})", ("404", "not found", "access denied", "forbidden", "just a moment", "attention required", "error", "captcha", "blocked"))}
 OR {_any(f"left(lower(regexp_replace({_CLEAN}, '<[^>]*>', ' ', 'g')), 2000)", ("page not found", "access denied", "forbidden", "just a moment", "attention required", "verify you are human", "captcha", "request blocked", "error 404"))}) AS is_error FROM pages"""
ORACLES["url_domain"] = r"SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS domain, substr(md5(url), 1, 12) AS id, regexp_matches(url, '^[a-z]+://[^/?#]+') AS valid, true AS same FROM pages"
ORACLES["url_normalize"] = rf"""WITH u AS (SELECT page_id, url, {_PATH} AS path, {_ROOT} AS root FROM pages),
f AS (SELECT *, string_split(regexp_replace(path, '[^/]*$', ''), '/') AS dirs FROM u)
SELECT page_id, regexp_replace(url, '#.*$', '') AS plain, CASE page_id % 4
 WHEN 0 THEN root || CASE WHEN len(dirs) > 2 THEN array_to_string(dirs[1:len(dirs) - 2], '/') ELSE '' END || '/a/b?x=1'
 WHEN 1 THEN root || '/up' WHEN 2 THEN root || path || '?q=2' ELSE regexp_extract(url, '^([a-z]+):', 1) || '://other.example/c' END AS resolved FROM f"""
ORACLES["url_strip_tracking"] = rf"""WITH u AS (SELECT page_id, url, regexp_extract(url, '\?([^#]*)', 1) AS q FROM pages),
p AS (SELECT page_id, url, q, list_filter(string_split(q, '&'), lambda x: split_part(x, '=', 2) <> '' AND NOT list_contains(['utm_source','utm_medium','utm_campaign','utm_term','utm_content','fbclid','gclid','msclkid','ref','source'], split_part(x, '=', 1))) AS kept FROM u)
SELECT page_id, CASE WHEN q = '' THEN url ELSE {_ROOT} || {_PATH} || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END END AS clean FROM p"""
ORACLES["url_sanitize"] = "SELECT page_id, CASE WHEN page_id % 3 = 1 THEN url || '(a)' ELSE url END AS clean FROM pages"
# Tokens of a page, tags of one name paired by how deep they nest.
_TAGS = rf"""
tk AS (SELECT page_id, generate_subscripts(t, 1) - 1 AS pos, unnest(t) AS tok FROM (SELECT page_id, regexp_extract_all({_CLEAN}, '(?s)(</?[A-Za-z][^>]*>|[^<]+)') AS t FROM pages)),
tg AS (SELECT *, lower(regexp_extract(tok, '^</?([A-Za-z][A-Za-z0-9]*)', 1)) AS tag, CASE WHEN prefix(tok, '</') THEN -1 ELSE 1 END AS step FROM tk),
dp AS (SELECT *, sum(step) OVER (PARTITION BY page_id, tag ORDER BY pos) + CASE WHEN step < 0 THEN 1 ELSE 0 END AS level FROM tg WHERE tag <> ''),
el AS (SELECT * FROM (SELECT *, coalesce(lead(pos) OVER (PARTITION BY page_id, tag, level ORDER BY pos), 2147483647) AS stop FROM dp) WHERE step > 0),
dn AS (SELECT e.page_id, e.pos AS begin, sum(CASE WHEN t.tag = '' THEN length(trim(regexp_replace({_UNESCAPE.format("t.tok")}, '\s+', ' ', 'g'))) ELSE 0 END) AS chars, count(*) FILTER (t.tag <> '' AND t.step > 0) AS children
  FROM el e JOIN tg t ON t.page_id = e.page_id AND t.pos > e.pos AND t.pos < e.stop WHERE e.tag IN ('div', 'section', 'article', 'main') GROUP BY ALL)"""
ORACLES["density_container"] = f"WITH {_TAGS} SELECT page_id, begin, round(density, 4) AS density FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY density DESC, begin) AS k FROM (SELECT *, chars::DOUBLE / greatest(children, 1) AS density FROM dn WHERE chars > 500)) WHERE k = 1"
ORACLES["main_container"] = f"WITH {_TAGS} SELECT page_id, min(pos) AS begin FROM el WHERE tag = 'article' GROUP BY page_id"
_LINKS = rf"""lk AS (SELECT page_id, generate_subscripts(hrefs, 1) - 1 AS ordinal, {_ROOT} || {_UNESCAPE.format("unnest(hrefs)")} AS target_url, trim(regexp_replace({_UNESCAPE.format("regexp_replace(unnest(labels), '<[^>]*>', ' ', 'g')")}, '\s+', ' ', 'g')) AS anchor_text
  FROM (SELECT page_id, url, regexp_extract_all(a, '(?is)<a [^>]*href="([^"]*)"[^>]*>(.*?)</a>', 1) AS hrefs, regexp_extract_all(a, '(?is)<a [^>]*href="([^"]*)"[^>]*>(.*?)</a>', 2) AS labels FROM art JOIN pages USING (page_id)))"""
_CLEAN_URL = rf"CASE WHEN regexp_extract(url, '\?([^#]*)', 1) = '' THEN regexp_replace(url, '#.*$', '') ELSE {_ROOT} || {_PATH} || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END END"
_CRAWL = rf"""{_ARTICLE}, {_LINKS},
cu AS (SELECT page_id, {_CLEAN_URL} AS clean FROM (SELECT page_id, url, list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda x: split_part(x, '=', 2) <> '' AND NOT list_contains(['utm_source','utm_medium','utm_campaign','utm_term','utm_content','fbclid','gclid','msclkid','ref','source'], split_part(x, '=', 1))) AS kept FROM pages)),
met AS (SELECT clean AS url, 0 AS depth, NULL AS parent FROM cu GROUP BY clean
  UNION ALL SELECT * FROM (SELECT target_url, 1, arg_min(clean, (clean, ordinal)) FROM lk JOIN (SELECT clean, min(page_id) AS page_id FROM cu GROUP BY clean) USING (page_id) GROUP BY target_url) WHERE target_url NOT IN (SELECT clean FROM cu))"""
ORACLES["crawl_frontier"] = f"WITH {_CRAWL} SELECT url, depth, parent FROM met"
ORACLES["crawl_summary"] = f"""WITH {_CRAWL}, first AS (SELECT clean, min(page_id) AS page_id FROM cu GROUP BY clean), n AS (SELECT page_id, count(*) AS n FROM pb GROUP BY page_id), l AS (SELECT page_id, count(*) AS n FROM lk GROUP BY page_id)
SELECT depth, count(*) AS n_pages, CAST(coalesce(sum(n.n), 0) AS BIGINT) AS n_blocks, CAST(coalesce(sum(l.n), 0) AS BIGINT) AS n_links, CAST(coalesce(sum(l.n), 0) AS BIGINT) AS n_internal FROM met LEFT JOIN first ON clean = met.url LEFT JOIN n USING (page_id) LEFT JOIN l USING (page_id) GROUP BY depth"""
_LEVEL = """c{0} AS MATERIALIZED (SELECT root, dst AS node, min((place, ordinal, node)) AS m, any_value(n) AS n FROM v{1} JOIN site ON src = node WHERE depth = {1} AND n < 12 GROUP BY root, dst),
p{0} AS (SELECT *, n + row_number() OVER (PARTITION BY root ORDER BY m, node) AS place FROM c{0} ANTI JOIN v{1} USING (root, node)),
v{0} AS MATERIALIZED (SELECT root, node, depth, parent, place, n FROM v{1} UNION ALL SELECT root, node, {0}, m[3], place, max(place) OVER (PARTITION BY root) FROM p{0} WHERE place <= 12)"""
ORACLES["crawl_by_root"] = rf"""WITH lk AS (SELECT page_id, unnest(h) AS target_url, generate_subscripts(h, 1) - 1 AS ordinal FROM (SELECT page_id, regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1) AS h FROM pages)),
hosted AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host FROM pages),
numbered AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY page_id) - 1 AS k, count(*) OVER (PARTITION BY host) AS n FROM hosted),
site AS MATERIALIZED (SELECT s.page_id AS src, d.page_id AS dst, min(ordinal) AS ordinal FROM lk JOIN numbered s USING (page_id) JOIN numbered d ON d.host = s.host AND d.k = CAST('0x' || left(md5(target_url), 7) AS BIGINT) % s.n GROUP BY ALL),
v0 AS (SELECT page_id AS root, page_id AS node, 0 AS depth, CAST(NULL AS BIGINT) AS parent, 1 AS place, 1 AS n FROM pages),
{", ".join(_LEVEL.format(d, d - 1) for d in range(1, 5))} SELECT root, node, depth, parent, place FROM v4"""
ORACLES["page_documents"] = rf"""WITH {_ARTICLE}, n AS (SELECT page_id, count(*) AS n FROM pb GROUP BY page_id)
SELECT page_id, substr(md5(url), 1, 12) AS id, url, {_TITLE} AS title, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS domain, coalesce(n, 0) AS n_blocks,
 len(regexp_extract_all(regexp_extract({_CLEAN}, '(?s)<article>(.*?)</article>', 1), '<a ')) AS n_links, len(regexp_extract_all(regexp_extract({_CLEAN}, '(?s)<article>(.*?)</article>', 1), '<a ')) AS n_internal FROM pages LEFT JOIN n USING (page_id)"""
# The article's heading, if it has one, comes first; the rest is one section.
_DIGEST = f"""WITH {_ARTICLE}, {_LINKS}, body AS (SELECT page_id, string_agg(text, chr(10) ORDER BY position) FILTER (NOT tag LIKE 'h%') AS content,
  coalesce(max(text) FILTER (tag LIKE 'h%'), 'Introduction') AS heading, coalesce(max(TRY_CAST(substr(tag, 2) AS INT)) FILTER (tag LIKE 'h%'), 1) AS level FROM pb GROUP BY page_id),
links AS (SELECT page_id, count(*) AS n, count(*) FILTER (ordinal < 20) AS n20, string_agg(target_url || ' ' || left(anchor_text, 100), chr(10) ORDER BY ordinal) FILTER (ordinal < 20) AS short, string_agg(target_url || ' ' || anchor_text, chr(10) ORDER BY ordinal) AS long FROM lk GROUP BY page_id),
dg AS (SELECT b.page_id AS doc_id, {_TITLE} AS title, heading, level, content, coalesce(n, 0) AS n, coalesce(n20, 0) AS n20, coalesce(short, '') AS short, coalesce(long, '') AS long FROM body b JOIN pages USING (page_id) LEFT JOIN links USING (page_id) WHERE content IS NOT NULL)"""
_BAD = _any("lower(title)", ("404", "not found", "access denied", "forbidden", "just a moment", "attention required", "error", "captcha", "blocked")) + " OR " + _any("left(lower(@), 2000)", ("page not found", "access denied", "forbidden", "just a moment", "attention required", "verify you are human", "captcha", "request blocked", "error 404"))
_SHORT, _LONG = "'## ' || heading || chr(10) || left(content, 700)", "'## ' || heading || chr(10) || content"
ORACLES["page_digest"] = f"{_DIGEST} SELECT doc_id, title, md5({_SHORT}) AS digest, level || ' ' || heading AS sections, n20 AS n_links, md5(short) AS links, {_BAD.replace('@', _SHORT)} AS is_error FROM dg"
ORACLES["page_full_text"] = f"{_DIGEST} SELECT doc_id, title, length({_LONG}) AS n_chars, md5(left(content, 2000)) AS sections, n AS n_links, md5(long) AS links, {_BAD.replace('@', _LONG)} AS is_error FROM dg"

# Concept candidates --------------------------------------------------------

_WORDS = r"""
wl AS (SELECT doc_id, generate_subscripts(s, 1) - 1 AS position, unnest(s) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents WHERE text IS NOT NULL)),
ws AS (SELECT DISTINCT doc_id, position, word FROM (SELECT doc_id, position, lower(regexp_replace(unnest(string_split(line, ' ')), '[^\p{L}]', '', 'g')) AS word FROM wl) WHERE length(word) >= 7),
dict AS (SELECT word, count(DISTINCT doc_id) AS df FROM ws GROUP BY word HAVING count(DISTINCT doc_id) >= 3),
num AS (SELECT ws.*, row_number() OVER (PARTITION BY doc_id ORDER BY position, word) AS ord FROM ws SEMI JOIN dict USING (word)),
cand AS (SELECT *, CASE ord % 3 WHEN 1 THEN word || 's' WHEN 2 THEN CASE WHEN left(word, 1) BETWEEN 'a' AND 'z' THEN upper(left(word, 1)) ELSE left(word, 1) END || substr(word, 2) ELSE word END AS name,
  CASE length(word) % 5 WHEN 0 THEN 'core_concept' WHEN 1 THEN 'method' WHEN 2 THEN 'tool' WHEN 3 THEN 'metric' ELSE 'theory' END AS type,
  (4 + length(word) % 7) / 10.0 AS conf, doc_id || '_' || position AS block_id,
  row_number() OVER (PARTITION BY doc_id, position ORDER BY word) - 1 AS nth FROM num)"""
_STOP = "('model','data','system','learning','process','method','approach','technique','algorithm','problem','solution','value','result','output','input','parameter','function','variable','training','testing','validation','performance','accuracy','error','loss','feature','sample','dataset','example','task','goal','objective')"
_PARSED = rf"""{_WORDS},
parsed AS (SELECT doc_id, block_id, position, CASE WHEN doc_id % 6 = 5 THEN nth * 2 ELSE nth END AS place, name,
  CASE WHEN doc_id % 6 = 5 THEN 'core_concept' ELSE type END AS type,
  CASE WHEN doc_id % 6 = 5 THEN trim(repeat(name || ' ', 25)) || '...' ELSE name END AS description,
  CAST(CASE WHEN doc_id % 6 = 5 THEN 0.6 ELSE conf END AS DOUBLE) AS confidence FROM cand WHERE doc_id % 6 <> 3),
named AS (SELECT * FROM parsed WHERE trim(name) <> '' AND lower(name) NOT IN {_STOP} AND length(name) >= 3)"""

ORACLES["concept_parse"] = f"WITH {_PARSED} SELECT doc_id, block_id, place, name, type, md5(description) AS description, confidence FROM parsed"
ORACLES["concept_filter"] = f"WITH {_PARSED} SELECT doc_id, block_id, name, confidence FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, block_id, lower(name) ORDER BY confidence DESC, position, place) AS k FROM named WHERE confidence >= 0.6) WHERE k = 1"
ORACLES["concept_dedup_doc"] = f"""WITH {_PARSED}, f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, block_id, lower(name) ORDER BY confidence DESC, position, place) AS k FROM named WHERE confidence >= 0.5) WHERE k = 1)
SELECT doc_id, name, block_id, confidence FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, name ORDER BY confidence DESC, position, place) AS j FROM f) WHERE j = 1"""
ORACLES["concept_counters"] = f"""WITH {_PARSED}, f AS (SELECT doc_id, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, block_id, lower(name) ORDER BY confidence DESC, position, place) AS k FROM named WHERE confidence >= 0.5) WHERE k = 1 GROUP BY doc_id),
r AS (SELECT doc_id, count(*) AS n FROM parsed GROUP BY doc_id), b AS (SELECT doc_id, count(DISTINCT position) AS n FROM cand GROUP BY doc_id)
SELECT b.doc_id, b.n AS n_blocks, 0 AS n_failed, coalesce(r.n, 0) AS n_raw, coalesce(f.n, 0) AS n_kept FROM b LEFT JOIN r USING (doc_id) LEFT JOIN f USING (doc_id)"""
ORACLES["concept_summary"] = f"WITH {_PARSED} SELECT type, count(*) AS n, {_mean('confidence', 4)} AS avg_confidence, round(100.0 * count(*) / sum(count(*)) OVER (), 1) AS share FROM parsed GROUP BY type"
ORACLES["concept_top"] = f"WITH {_PARSED} SELECT doc_id, block_id, name, confidence FROM parsed ORDER BY confidence DESC, name, doc_id, position, place LIMIT 10"

ORACLES["concept_valid"] = f"WITH {_WORDS} SELECT doc_id, ord, ord % 7 <> 0 AND ord % 5 <> 0 AS valid FROM cand"
ORACLES["concept_provenance"] = f"""WITH {_PARSED}, f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, block_id, lower(name) ORDER BY confidence DESC, position, place) AS k FROM named WHERE confidence >= 0.5) WHERE k = 1)
SELECT doc_id, substr(md5(block_id || '|' || lower(name)), 1, 12) AS concept_id, name, block_id AS source_block_id, CASE WHEN position > 0 THEN 'part ' || position // 3 ELSE '' END AS heading_path FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, name ORDER BY confidence DESC, position, place) AS j FROM f) WHERE j = 1"""
ORACLES["reply_failures"] = f"WITH {_WORDS} SELECT doc_id, 'no JSON' AS reason, count(DISTINCT position) AS n FROM cand WHERE doc_id % 6 = 3 GROUP BY doc_id"
ORACLES["completion_join"] = "SELECT d.doc_id AS key, 'quality ' || quality AS raw_output FROM documents d LEFT JOIN labels USING (doc_id)"


def _name_key(c: str) -> str:
    plain = rf"list_filter(string_split_regex(replace(regexp_replace(lower({c}), '[^\p{{L}}\p{{N}}_\s-]', '', 'g'), '-', ' '), '\s+'), lambda w: w <> '')"
    return f"array_to_string(list_transform({plain}, lambda w: CASE WHEN suffix(w, 'es') AND length(w) > 4 THEN left(w, length(w) - 2) WHEN suffix(w, 's') AND length(w) > 3 THEN left(w, length(w) - 1) ELSE w END), ' ')"


_UNIQUE = rf"""{_WORDS},
keyed AS (SELECT *, {_name_key("name")} AS name_key FROM cand),
uniq AS (SELECT doc_id, ord, name, type, position, block_id, CAST(conf AS DOUBLE) AS confidence, name_key FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, name_key ORDER BY conf DESC, ord) AS k FROM keyed) WHERE k = 1)"""
# Chains of neighbours with one beginning are the clusters.
_CLUSTERS = rf"""{_UNIQUE},
clus AS (SELECT *, min(ord) OVER (PARTITION BY doc_id, left(name_key, 4)) AS cluster, count(*) OVER (PARTITION BY doc_id, left(name_key, 4)) AS size FROM uniq)"""
ORACLES["name_keys"] = f"SELECT p_partkey, {_name_key('p_name')} AS name_key FROM part"
ORACLES["exact_dedup"] = f"WITH {_UNIQUE} SELECT doc_id, ord, name_key, confidence FROM uniq"
ORACLES["cosine_pairs"] = """WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings)
SELECT a.label, a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.e, b.e), 6) AS similarity FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.45"""
ORACLES["cosine_pairs_corpus"] = """WITH v AS (SELECT vec_id AS i, embedding::DOUBLE[] AS e FROM embeddings UNION ALL SELECT vec_id + 1000000000, list_prepend((embedding[1] + 0.01::FLOAT)::DOUBLE, embedding[2:]::DOUBLE[]) FROM embeddings)
SELECT a.i AS a, b.i AS b, round(list_cosine_similarity(a.e, b.e), 6) AS similarity FROM v a JOIN v b ON a.i < b.i WHERE list_cosine_similarity(a.e, b.e) >= 0.95"""
ORACLES["cosine_pairs_near"] = """WITH e AS (SELECT vec_id AS i, embedding::DOUBLE[] AS e FROM embeddings), v AS (SELECT i, e FROM e UNION ALL SELECT i + 1000000000, list_prepend(e[1] + sqrt(list_inner_product(e, e)) * (i % 50) * 0.018::DOUBLE, e[2:]) FROM e)
SELECT a.i AS a, b.i AS b, round(list_cosine_similarity(a.e, b.e), 6) AS similarity FROM v a JOIN v b ON a.i < b.i WHERE list_cosine_similarity(a.e, b.e) >= 0.85"""
ORACLES["similarity_graph"] = """WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings)
SELECT a.label, a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.4"""
ORACLES["embedding_texts"] = f"WITH {_WORDS}, t AS (SELECT doc_id, ord, name || '. ' || name AS x FROM cand) SELECT doc_id, ord, md5(x) AS digest, CASE WHEN length(x) % 3 > 0 THEN CAST(length(x) AS INT) END AS first FROM t"
ORACLES["components"] = f"WITH {_CLUSTERS} SELECT doc_id, ord, cluster, size, round(CASE WHEN size = 1 THEN 1.0 ELSE 0.9 * (size - 1) / (size * (size - 1) / 2.0) END, 6) AS similarity FROM clus"
ORACLES["vector_clusters"] = """WITH RECURSIVE v AS (SELECT label, vec_id, embedding::DOUBLE[] AS e FROM embeddings),
p AS MATERIALIZED (SELECT a.label, a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(a.e, b.e) AS sim FROM v a JOIN v b ON a.label = b.label AND a.vec_id < b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.3),
far(x, y) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT x, n.b FROM far JOIN (SELECT a, b FROM p UNION ALL SELECT b, a FROM p) n ON n.a = y),
c AS MATERIALIZED (SELECT label, vec_id, m AS cluster, count(*) OVER (PARTITION BY m) AS size FROM (SELECT x AS vec_id, min(y) AS m FROM far GROUP BY x) JOIN embeddings USING (vec_id)),
s AS (SELECT cluster, sum(sim) AS total FROM p JOIN c ON c.vec_id = p.a GROUP BY cluster)
SELECT label, vec_id, cluster, size, round(CASE WHEN size = 1 THEN 1.0 ELSE coalesce(total, 0) / (size * (size - 1) / 2.0) END, 6) AS similarity FROM c LEFT JOIN s USING (cluster)"""
# Pairs are of neighbours in a row of like names, so a component is a run without gaps.
ORACLES["components_grown"] = f"""WITH {_UNIQUE},
row_ AS (SELECT doc_id, left(name_key, 4) AS l, ord, lag(ord) OVER (PARTITION BY doc_id, left(name_key, 4) ORDER BY ord) AS before, lead(ord) OVER (PARTITION BY doc_id, left(name_key, 4) ORDER BY ord) AS after FROM uniq),
run AS (SELECT *, count(*) FILTER (before IS NULL OR before % 2 = 1) OVER (PARTITION BY doc_id, l ORDER BY ord) AS k FROM row_),
placed AS (SELECT doc_id * 1000000 + ord AS node, doc_id * 1000000 + min(ord) OVER (PARTITION BY doc_id, l) AS component, doc_id * 1000000 + min(ord) OVER (PARTITION BY doc_id, l, k) AS was,
  (after IS NOT NULL AND ord % 2 = 0) OR (before IS NOT NULL AND before % 2 = 0) AS known, before IS NOT NULL OR after IS NOT NULL AS linked FROM run)
SELECT node, component FROM placed WHERE linked AND (NOT known OR was <> component)"""
ORACLES["cluster_stats"] = f"WITH {_CLUSTERS}, c AS (SELECT doc_id, cluster, count(*) AS n FROM clus GROUP BY ALL) SELECT doc_id, count(*) AS n_clusters, count(*) FILTER (n = 1) AS n_single, count(*) FILTER (n > 1) AS n_multi, round(avg(n), 4) AS avg_size, max(n) AS max_size FROM c GROUP BY doc_id"
ORACLES["verdict_split"] = f"WITH {_CLUSTERS} SELECT doc_id, ord, CASE WHEN size > 1 AND cluster % 3 > 0 THEN ord ELSE cluster END AS cluster, CASE WHEN size > 1 AND cluster % 3 > 0 THEN 1 ELSE size END AS size FROM clus"
_NAMES = f"{_CLUSTERS}, best AS (SELECT doc_id, cluster, name AS canonical_name FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, cluster ORDER BY n DESC, length(name), f) AS k FROM (SELECT doc_id, cluster, name, count(*) AS n, min(ord) AS f FROM clus GROUP BY ALL)) WHERE k = 1)"
ORACLES["canonical_names"] = f"WITH {_NAMES} SELECT doc_id, cluster, canonical_name FROM best"
_CANON = f"""{_NAMES}, tot AS (SELECT doc_id, count(*) AS total FROM cand GROUP BY doc_id),
kinds AS (SELECT doc_id, cluster, type FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, cluster ORDER BY n DESC, f) AS k FROM (SELECT doc_id, cluster, type, count(*) AS n, min(ord) AS f FROM clus GROUP BY ALL)) WHERE k = 1),
canon AS (SELECT c.doc_id, c.cluster, any_value(b.canonical_name) AS canonical_name, list_sort(list_distinct(list(c.name))) AS names, any_value(k.type) AS type, list_sort(list_distinct(list(c.block_id))) AS blocks,
  count(*) AS n, count(DISTINCT CASE WHEN position > 0 THEN position // 3 END) AS paths, sum(CAST(c.confidence AS DECIMAL(20,10)))::DOUBLE / count(*) AS conf, any_value(total) AS total
  FROM clus c JOIN best b USING (doc_id, cluster) JOIN kinds k USING (doc_id, cluster) JOIN tot USING (doc_id) GROUP BY c.doc_id, c.cluster)"""
ORACLES["canonical_merge"] = f"""WITH {_CANON} SELECT doc_id, substr(md5(doc_id || '|' || cluster), 1, 12) AS canonical_id, canonical_name, array_to_string(list_filter(names, lambda x: x <> canonical_name), ',') AS aliases, type, array_to_string(blocks, ',') AS source_blocks, CAST(n AS INT) AS occurrence_count,
 {_round("0.4 * least(1.0::DOUBLE, 10.0::DOUBLE * n / total) + 0.3 * least(1.0::DOUBLE, paths / 5.0::DOUBLE) + 0.3 * conf", 3)} AS importance_score FROM canon"""
ORACLES["graph_nodes_of_concepts"] = f"WITH {_CANON} SELECT doc_id, substr(md5(doc_id || '|' || cluster), 1, 12) AS id, canonical_name AS label, type, CAST(len(names) - 1 AS INT) AS n_aliases, CAST(n AS INT) AS occurrence_count FROM canon"
ORACLES["normalization_funnel"] = f"""WITH {_CLUSTERS}, r AS (SELECT doc_id, count(*) AS a FROM cand GROUP BY doc_id), u AS (SELECT doc_id, count(*) AS b, count(DISTINCT cluster) AS c FROM clus GROUP BY doc_id)
SELECT doc_id, a AS n_candidates, b AS n_unique, c AS n_canonical, round(100.0 * (1 - c::DOUBLE / a), 1) AS reduction FROM r JOIN u USING (doc_id)"""
ORACLES["canonical_summary"] = f"WITH {_CANON} SELECT type, count(*) AS n, count(*) FILTER (len(names) > 1) AS n_with_aliases, sum(n) AS occurrences, round(100.0 * count(*) / sum(count(*)) OVER (), 1) AS share FROM canon GROUP BY type"

# Relations -----------------------------------------------------------------

_KNOWN = f"""{_WORDS}, held AS (SELECT doc_id, word, 'c' || substr(md5(word), 1, 10) AS cid, row_number() OVER (PARTITION BY doc_id ORDER BY df DESC, word) AS nth FROM (SELECT DISTINCT doc_id, word FROM ws) JOIN dict USING (word)),
names AS (SELECT doc_id, name, arg_max(cid, nth) AS concept_id FROM (SELECT doc_id, word AS name, cid, nth FROM held UNION ALL SELECT doc_id, word || 's', cid, nth FROM held) GROUP BY doc_id, name)"""
_MENTIONS = f"{_KNOWN}, men AS (SELECT doc_id, block_id, concept_id FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, block_id) AS n FROM (SELECT DISTINCT l.doc_id, l.doc_id || '_' || position AS block_id, concept_id FROM wl l JOIN names USING (doc_id) WHERE contains(lower(line), name))) WHERE n >= 2)"
ORACLES["name_lookup"] = f"WITH {_KNOWN} SELECT doc_id, name, concept_id FROM names"
ORACLES["mention_map"] = f"WITH {_MENTIONS} SELECT doc_id, block_id, concept_id FROM men"
ORACLES["candidate_pairs"] = f"WITH {_MENTIONS} SELECT doc_id, block_id, a.concept_id AS concept_a, b.concept_id AS concept_b FROM men a JOIN men b USING (doc_id, block_id) WHERE a.concept_id < b.concept_id"
ORACLES["candidate_stats"] = f"WITH {_MENTIONS}, p AS (SELECT doc_id, block_id, count(*) AS n FROM men GROUP BY ALL) SELECT (SELECT count(*) FROM wl) AS n_blocks, count(*) AS n_with_two, sum(n * (n - 1) // 2) AS n_pairs, round(avg(n), 4) AS avg_concepts, max(n) AS max_concepts FROM p"
_RELATED = f"""{_KNOWN},
rel0 AS (SELECT *, lead(word) OVER (PARTITION BY doc_id, position ORDER BY ord) AS after FROM cand),
rel1 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, position ORDER BY ord) - 1 AS place FROM rel0 WHERE after IS NOT NULL),
rel AS (SELECT doc_id, block_id, position, place, word AS source, CASE WHEN ord % 8 = 5 THEN 'zzzzzzz' ELSE after END AS target,
  CASE ord % 8 WHEN 0 THEN 'USES' WHEN 2 THEN 'CAUSES' WHEN 3 THEN 'PART_OF' ELSE 'DEPENDS_ON' END AS relation_type,
  CAST(CASE ord % 8 WHEN 6 THEN 1.0 WHEN 7 THEN 0.0 ELSE conf END AS DOUBLE) AS confidence FROM rel1 WHERE doc_id % 6 <> 3 AND ord % 8 NOT IN (1, 4)),
edg AS (SELECT 'e_' || substr(md5(r.doc_id || '|' || r.block_id || '|' || place), 1, 8) AS edge_id, r.doc_id, a.concept_id AS source_concept_id, b.concept_id AS target_concept_id, relation_type, block_id AS evidence_block_id, confidence, position, place
  FROM rel r JOIN names a ON a.doc_id = r.doc_id AND a.name = r.source JOIN names b ON b.doc_id = r.doc_id AND b.name = r.target WHERE a.concept_id <> b.concept_id)"""
ORACLES["relation_parse"] = f"WITH {_RELATED} SELECT doc_id, block_id, place, source, target, relation_type, confidence FROM rel"
# Written once, as each name is looked up for both ends.
_RELATED_ONCE = _RELATED.replace("names AS (", "names AS MATERIALIZED (").replace("rel AS (", "rel AS MATERIALIZED (")
ORACLES["edge_validate"] = f"WITH {_RELATED_ONCE} SELECT edge_id, doc_id, source_concept_id, target_concept_id, relation_type, evidence_block_id, confidence FROM edg"
_MERGED = f"""{_RELATED}, mrg AS (SELECT doc_id, source_concept_id, target_concept_id, relation_type, first(edge_id ORDER BY position, place) AS edge_id, first(evidence_block_id ORDER BY position, place) AS evidence_block_id, {_mean("confidence", 2)} AS confidence FROM edg GROUP BY doc_id, source_concept_id, target_concept_id, relation_type)"""
ORACLES["edge_dedup"] = f"WITH {_MERGED} SELECT * FROM mrg"
ORACLES["graph_edges_of_relations"] = f"WITH {_MERGED} SELECT doc_id, edge_id AS id, source_concept_id AS source, target_concept_id AS target, relation_type, evidence_block_id AS evidence_blocks, row_number() OVER (PARTITION BY doc_id ORDER BY edge_id) AS ord FROM mrg"
ORACLES["edge_summary"] = f"WITH {_RELATED} SELECT relation_type, count(*) AS n, {_mean('confidence', 4)} AS avg_confidence, count(*) FILTER (confidence >= 0.8) AS n_high, count(*) FILTER (confidence >= 0.6 AND confidence < 0.8) AS n_middle, count(*) FILTER (confidence < 0.6) AS n_low FROM edg GROUP BY relation_type"
_TYPES = "DEFINES, CAUSES, DEPENDS_ON, PART_OF, USES, EXTENDS, CONTRASTS_WITH, MEASURED_BY, ASSOCIATED_WITH"
ORACLES["relation_prompts"] = f"""WITH {_MENTIONS}, named AS (SELECT m.doc_id, block_id, array_to_string(list_sort(list(DISTINCT word)), ', ') AS listed FROM men m JOIN held h ON h.doc_id = m.doc_id AND h.cid = m.concept_id GROUP BY m.doc_id, block_id)
SELECT n.doc_id, block_id, md5('Which of these relations does the text state? Types: {_TYPES}. Answer with JSON only.' || chr(10) || 'Concepts: ' || listed || chr(10) || 'Text: ' || line) AS digest FROM named n JOIN wl l ON l.doc_id = n.doc_id AND l.doc_id || '_' || l.position = block_id"""
ORACLES["verification_prompts"] = f"""WITH {_RELATED}, e1 AS MATERIALIZED (SELECT e.*, h.word AS a FROM edg e JOIN held h ON h.doc_id = e.doc_id AND h.cid = source_concept_id), e2 AS MATERIALIZED (SELECT e.*, h.word AS b FROM e1 e JOIN held h ON h.doc_id = e.doc_id AND h.cid = target_concept_id)
SELECT edge_id, e.doc_id, md5('Does the text say that ' || a || ' ' || relation_type || ' ' || b || '? Answer yes or no.' || chr(10) || 'Text: ' || line) AS digest FROM e2 e JOIN wl l ON l.doc_id = e.doc_id AND l.position = e.position"""

# Graph ---------------------------------------------------------------------

_FLAGS = "CASE rf WHEN 'AF' THEN 'CAUSES' WHEN 'AO' THEN 'CONTRASTS_WITH' WHEN 'NF' THEN 'USES' WHEN 'NO' THEN 'PART_OF' WHEN 'RF' THEN 'DEPENDS_ON' WHEN 'RO' THEN 'DEFINES' END AS relation_type"
_SALES = """
tr0 AS (SELECT o_custkey // 100 AS doc_id, s_nationkey AS source, c_nationkey AS target, l_returnflag || l_linestatus AS rf, count(*) AS n, CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS BIGINT) AS cents, min(l_orderkey) AS evidence
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL)"""
_TRADE = f"""{_SALES},
tr AS (SELECT doc_id, source || '_' || target || '_' || rf AS id, source, target, {_FLAGS}, least(10000, 3000 + (500 * cents) // n) / 10000.0::DOUBLE AS confidence, evidence, row_number() OVER (PARTITION BY doc_id ORDER BY source, target, rf) AS ord FROM tr0),
val AS (SELECT * FROM tr WHERE source <> target),
pri AS (SELECT *, CASE relation_type WHEN 'DEFINES' THEN 5 WHEN 'CAUSES' THEN 4 WHEN 'DEPENDS_ON' THEN 3 WHEN 'PART_OF' THEN 3 WHEN 'ASSOCIATED_WITH' THEN 1 ELSE 2 END AS p FROM val),
con AS (SELECT *, row_number() OVER w AS k, max(CASE WHEN relation_type = 'CONTRASTS_WITH' THEN 1 ELSE 0 END) OVER q + max(CASE WHEN relation_type IN ('CAUSES', 'DEFINES', 'PART_OF') THEN 1 ELSE 0 END) OVER q AS clash FROM pri WINDOW w AS (PARTITION BY doc_id, source, target ORDER BY p DESC, confidence DESC, ord), q AS (PARTITION BY doc_id, source, target)),
good AS (SELECT *, row_number() OVER w AS j, max(CASE WHEN relation_type = 'CONTRASTS_WITH' THEN 1 ELSE 0 END) OVER q + max(CASE WHEN relation_type IN ('CAUSES', 'DEFINES', 'PART_OF') THEN 1 ELSE 0 END) OVER q AS clash FROM pri WHERE confidence >= 0.55 WINDOW w AS (PARTITION BY doc_id, source, target ORDER BY p DESC, confidence DESC, ord), q AS (PARTITION BY doc_id, source, target)),
ref AS (SELECT * FROM good WHERE clash < 2 OR j = 1),
arcs AS (SELECT DISTINCT doc_id, source AS u, target AS v FROM ref),
nn AS (SELECT doc_id, id, n_name AS label, coalesce(c, 0) AS occ FROM (SELECT doc_id, source AS id FROM tr0 UNION SELECT doc_id, target FROM tr0) JOIN nation ON n_nationkey = id LEFT JOIN (SELECT c_custkey // 100 AS doc_id, c_nationkey AS id, count(*) AS c FROM customer GROUP BY ALL) USING (doc_id, id)),
sz AS (SELECT doc_id, count(*) AS k FROM nn GROUP BY doc_id)"""
_DEG = "deg AS (SELECT doc_id, id, count(*) AS d FROM (SELECT doc_id, u AS id FROM arcs UNION ALL SELECT doc_id, v FROM arcs) GROUP BY doc_id, id)"
_UND = "und AS (SELECT doc_id, u AS a, v AS b FROM arcs UNION SELECT doc_id, v, u FROM arcs)"
_CLUST = f"""{_UND}, dg AS (SELECT doc_id, a AS id, count(*) AS d FROM und GROUP BY ALL),
tri AS (SELECT x.doc_id, x.a AS id, count(*) AS t FROM und x JOIN und y ON x.doc_id = y.doc_id AND x.a = y.a AND x.b < y.b JOIN und z ON z.doc_id = x.doc_id AND z.a = x.b AND z.b = y.b GROUP BY ALL),
clu AS (SELECT doc_id, id, CASE WHEN d >= 2 THEN 2.0::DOUBLE * coalesce(t, 0) / (d * (d - 1)) ELSE 0 END AS cc FROM nn LEFT JOIN dg USING (doc_id, id) LEFT JOIN tri USING (doc_id, id))"""
_WALK = """
bfs AS (SELECT doc_id, id AS s, id AS v, 0 AS dist FROM nn UNION SELECT b.doc_id, b.s, a.v, b.dist + 1 FROM bfs b JOIN arcs a ON a.doc_id = b.doc_id AND a.u = b.v WHERE b.dist < 24),
short AS (SELECT doc_id, s, v, min(dist) AS dist FROM bfs GROUP BY doc_id, s, v),
ways AS (SELECT doc_id, id AS s, id AS v, 0 AS dist FROM nn UNION ALL SELECT w.doc_id, w.s, a.v, w.dist + 1 FROM ways w JOIN arcs a ON a.doc_id = w.doc_id AND a.u = w.v JOIN short d ON d.doc_id = w.doc_id AND d.s = w.s AND d.v = a.v AND d.dist = w.dist + 1),
sig AS (SELECT doc_id, s, v, dist, count(*)::DOUBLE AS sigma FROM ways GROUP BY doc_id, s, v, dist),
btw AS (SELECT m.doc_id, m.v AS id, sum(m.sigma * r.sigma / t.sigma) AS b FROM sig t JOIN sig m ON m.doc_id = t.doc_id AND m.s = t.s JOIN sig r ON r.doc_id = m.doc_id AND r.s = m.v AND r.v = t.v WHERE t.s <> t.v AND m.v <> t.s AND m.v <> t.v AND m.dist + r.dist = t.dist GROUP BY m.doc_id, m.v)"""
_SCORED = f"""{_TRADE}, {_DEG}, {_WALK},
cent AS (SELECT nn.*, CASE WHEN k > 1 THEN coalesce(d, 0) / (k - 1.0::DOUBLE) ELSE 1.0 END AS dc, CASE WHEN k > 2 THEN coalesce(b, 0) / ((k - 1.0::DOUBLE) * (k - 2)) ELSE 0 END AS bc FROM nn JOIN sz USING (doc_id) LEFT JOIN deg USING (doc_id, id) LEFT JOIN btw USING (doc_id, id)),
scored AS (SELECT *, 0.4 * CASE WHEN max(occ) OVER (PARTITION BY doc_id) > 0 THEN occ::DOUBLE / max(occ) OVER (PARTITION BY doc_id) ELSE 0 END + 0.3 * dc + 0.3 * bc AS imp FROM cent),
refdeg AS (SELECT doc_id, id, count(*) AS d FROM (SELECT doc_id, source AS id FROM ref UNION ALL SELECT doc_id, target FROM ref) GROUP BY ALL),
keep AS (SELECT s.*, row_number() OVER (PARTITION BY doc_id ORDER BY CAST(imp AS DECIMAL(28,9)) DESC, id) AS rank FROM scored s LEFT JOIN refdeg r USING (doc_id, id) WHERE coalesce(r.d, 0) > 0 OR occ > 1)"""
ORACLES["graph_validate"] = f"""WITH {_TRADE} SELECT doc_id, k AS nodes_before, k AS nodes_after, coalesce(a, 0) AS edges_before, coalesce(b, 0) AS edges_after FROM sz LEFT JOIN (SELECT doc_id, count(*) AS a FROM tr GROUP BY 1) USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS b FROM val GROUP BY 1) USING (doc_id)"""
ORACLES["merge_duplicates"] = f"WITH {_TRADE} SELECT doc_id, id, source, target, relation_type, {_round('0.75 * confidence', 6)} AS confidence, CASE WHEN evidence::VARCHAR = '0' THEN '0' WHEN evidence::VARCHAR < '0' THEN evidence || ',0' ELSE '0,' || evidence END AS evidence_blocks FROM tr"
ORACLES["graph_refine"] = f"WITH {_TRADE} SELECT doc_id, id, source, target, relation_type, {_round('confidence', 6)} AS confidence FROM ref"
ORACLES["conflict_resolution"] = f"WITH {_TRADE} SELECT doc_id, id, source, target, relation_type FROM con WHERE clash < 2 OR k = 1"
ORACLES["degree_centrality"] = f"WITH RECURSIVE {_SCORED} SELECT doc_id, id, {_round('dc', 6)} AS degree_centrality FROM cent"
ORACLES["clustering_coefficient"] = f"WITH {_TRADE}, {_CLUST} SELECT doc_id, id, {_round('cc', 6)} AS clustering_coefficient FROM clu"
ORACLES["betweenness"] = f"WITH RECURSIVE {_SCORED} SELECT doc_id, id, {_round('bc', 6)} AS betweenness_centrality FROM cent"
_WHOLE = f"""{_UND}, reach AS (SELECT doc_id, id AS s, id AS v FROM nn UNION SELECT r.doc_id, r.s, u.b FROM reach r JOIN und u ON u.doc_id = r.doc_id AND u.a = r.v), comp AS (SELECT doc_id, s, min(v) AS c FROM reach GROUP BY doc_id, s),
whole AS (SELECT doc_id, k, coalesce(m, 0) AS m, c FROM sz LEFT JOIN (SELECT doc_id, count(*) AS m FROM arcs GROUP BY 1) USING (doc_id) JOIN (SELECT doc_id, count(DISTINCT c) AS c FROM comp GROUP BY 1) USING (doc_id))"""
ORACLES["graph_metrics"] = f"""WITH RECURSIVE {_TRADE}, {_WHOLE}
SELECT doc_id, k AS num_nodes, m AS num_edges, CASE WHEN k > 1 THEN {_round('m::DOUBLE / (k * (k - 1))', 6)} ELSE 0.0 END AS density, {_round('2.0::DOUBLE * m / k', 6)} AS average_degree, c AS num_components FROM whole"""
ORACLES["final_graph_nodes"] = f"WITH RECURSIVE {_SCORED} SELECT doc_id, id, label, CAST(occ AS INT) AS occurrence_count, {_round('imp', 4)} AS importance_score, rank FROM keep"
ORACLES["top_nodes"] = f"WITH RECURSIVE {_SCORED} SELECT doc_id, id, rank FROM keep WHERE rank <= 10"
ORACLES["final_graph_edges"] = f"WITH {_TRADE} SELECT doc_id, source, target, relation_type AS relation, {_round('confidence', 2)} AS weight FROM ref"
ORACLES["final_graph_meta"] = f"""WITH RECURSIVE {_SCORED}, {_WHOLE} SELECT doc_id, k AS num_nodes, m AS num_edges, coalesce(a, 0) AS n_nodes, coalesce(b, 0) AS n_edges, CAST(0.55 AS DOUBLE) AS min_confidence
FROM whole LEFT JOIN (SELECT doc_id, count(*) AS a FROM keep GROUP BY 1) USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS b FROM ref GROUP BY 1) USING (doc_id)"""
ORACLES["final_graph_json"] = f"""WITH RECURSIVE {_SCORED}, {_CLUST},
jn AS (SELECT doc_id, string_agg('{{"id":' || id || ',"label":"' || label || '","type":"core_concept","aliases":[],"occurrence_count":' || occ || ',"importance_score":' || {_round('imp', 3)} || ',"degree_centrality":' || {_round('dc', 3)} || ',"betweenness_centrality":' || {_round('bc', 3)} || ',"clustering_coefficient":' || {_round('cc', 3)} || '}}', ',' ORDER BY rank) AS n FROM keep JOIN clu USING (doc_id, id) GROUP BY doc_id),
je AS (SELECT doc_id, string_agg('{{"id":"' || id || '","source":' || source || ',"target":' || target || ',"relation_type":"' || relation_type || '","confidence":' || {_round('confidence', 2)} || ',"evidence_blocks":["' || evidence || '"]}}', ',' ORDER BY confidence DESC, source, target, relation_type) AS e FROM ref GROUP BY doc_id)
SELECT doc_id, md5('{{"nodes":[' || n || '],"edges":[' || coalesce(e, '') || ']}}') AS digest FROM jn LEFT JOIN je USING (doc_id)"""
ORACLES["prune"] = f"""WITH {_TRADE}, few AS (SELECT * FROM ref WHERE confidence >= 0.7), o AS (SELECT doc_id, source AS id, count(*) AS n FROM few GROUP BY ALL), dg AS (SELECT doc_id, id FROM o UNION SELECT doc_id, target FROM few UNION SELECT doc_id, id FROM nn WHERE id % 3 > 1)
SELECT doc_id, id, coalesce(n, 0) AS n_out FROM dg LEFT JOIN o USING (doc_id, id)"""
ORACLES["relation_summary"] = f"WITH {_TRADE} SELECT relation_type, count(*) AS n, {_mean('confidence', 4)} AS avg_confidence FROM ref GROUP BY 1"
ORACLES["node_degrees"] = f"WITH {_TRADE}, d AS (SELECT doc_id, id, count(*) AS n FROM (SELECT doc_id, source AS id FROM ref UNION ALL SELECT doc_id, target FROM ref) GROUP BY ALL) SELECT doc_id, id, coalesce(n, 0) AS degree FROM nn LEFT JOIN d USING (doc_id, id)"
_NET = f"""{_SALES}, tw AS (SELECT source, target, rf, sum(n) AS n, CAST(sum(cents) AS BIGINT) AS cents FROM tr0 GROUP BY ALL),
net AS (SELECT a.source, a.target, {_FLAGS.replace("CASE rf", "CASE a.rf")}, {_round("least(10000, 3000 + (500 * a.cents) // a.n) / 10000.0::DOUBLE", 2)} AS weight, row_number() OVER (ORDER BY a.source, a.target, a.rf) AS ord
  FROM tw a LEFT JOIN tw b ON b.source = a.target AND b.target = a.source AND b.rf = a.rf WHERE a.source <> a.target AND a.n > coalesce(b.n, 0))"""
ORACLES["node_panel"] = f"WITH {_NET} SELECT source AS node, 'outgoing' AS direction, target AS other, relation_type AS relation, weight FROM net UNION ALL SELECT target, 'incoming', source, relation_type, weight FROM net"
ORACLES["neighbors"] = f"WITH {_NET}, b AS (SELECT source AS node, target AS neighbour FROM net UNION SELECT target, source FROM net) SELECT node, neighbour FROM b JOIN nation ON n_nationkey = node WHERE n_regionkey = 2"
ORACLES["viewer_defaults"] = f"WITH {_NET} SELECT source, target, CASE WHEN source % 3 > 0 THEN relation_type ELSE 'ASSOCIATED_WITH' END AS relation, CASE WHEN target % 3 > 0 THEN weight ELSE 0.5 END AS weight FROM net"
ORACLES["graph_catalog"] = "SELECT 'year_' || year(o_orderdate) AS doc_id, count(DISTINCT o_custkey) AS n_nodes, count(*) AS n_edges, 'Year ' || year(o_orderdate) AS name FROM orders GROUP BY year(o_orderdate)"
ORACLES["graph_by_id"] = "SELECT CAST(year(o_orderdate) AS INT) AS doc_id, o_orderkey FROM orders WHERE year(o_orderdate) = 1996"

# Reasoning -----------------------------------------------------------------

_GRAPH = f"""{_NET},
g AS (SELECT a.n_name AS src, b.n_name AS dst, relation_type AS relation, ord, a.n_nationkey AS i, b.n_nationkey AS j, relation_type IN ('DEPENDS_ON', 'REQUIRES', 'PART_OF') AS dep FROM net JOIN nation a ON a.n_nationkey = source JOIN nation b ON b.n_nationkey = target),
needs AS (SELECT DISTINCT src, dst FROM g WHERE dep), seen AS (SELECT n_name AS name FROM nation WHERE n_regionkey = 1)"""
_HOPS = "hop AS (SELECT src AS s, dst AS c, 1 AS d FROM needs UNION SELECT h.s, n.dst, h.d + 1 FROM hop h JOIN needs n ON n.src = h.c WHERE h.d < {}), dist AS (SELECT s, c, min(d) AS d FROM hop GROUP BY s, c)"
ORACLES["relationships"] = f"WITH {_GRAPH} SELECT src AS concept, dst AS other, relation FROM g UNION ALL SELECT dst, src, relation FROM g"
ORACLES["dependencies"] = f"WITH RECURSIVE {_GRAPH}, {_HOPS.format(2)} SELECT s AS start, c AS concept, d AS distance FROM dist"
ORACLES["dependents"] = f"WITH {_GRAPH} SELECT dst AS concept, src AS dependent FROM g WHERE dep"
ORACLES["related_unexplored"] = f"WITH {_GRAPH} SELECT src AS start, dst AS concept FROM g WHERE NOT dep AND dst NOT IN (SELECT name FROM seen)"
# A walk step by step: the way down, how far each concept on it has been read, concepts met, and the chain.
ORACLES["prereq_chain"] = f"""WITH RECURSIVE {_GRAPH}, adj AS (SELECT src, list(dst ORDER BY f, dst) AS deps FROM (SELECT src, dst, min(ord) AS f FROM g WHERE dep GROUP BY src, dst) GROUP BY src),
w AS (SELECT n_name AS s, [n_name] AS way, [1::BIGINT] AS rd, [n_name] AS met, CAST([] AS VARCHAR[]) AS chain FROM nation
  UNION ALL SELECT s, CASE WHEN d IS NULL THEN way[:-2] WHEN list_contains(met, d) THEN way ELSE list_append(way, d) END,
    CASE WHEN d IS NULL THEN rd[:-2] WHEN list_contains(met, d) THEN list_append(rd[:-2], rd[-1] + 1) ELSE list_append(list_append(rd[:-2], rd[-1] + 1), 1) END,
    CASE WHEN d IS NULL OR list_contains(met, d) THEN met ELSE list_append(met, d) END,
    CASE WHEN d IS NULL AND len(way) > 1 AND NOT list_contains(chain, way[-1]) THEN list_append(chain, way[-1]) WHEN d IS NOT NULL AND list_contains(met, d) AND NOT list_contains(chain, d) THEN list_append(chain, d) ELSE chain END
  FROM (SELECT w.*, deps[rd[-1]] AS d FROM w LEFT JOIN adj ON src = way[-1] WHERE len(way) > 0))
SELECT s AS start, unnest(chain) AS concept, generate_subscripts(chain, 1) AS place FROM w WHERE len(way) = 0"""
_DOC_GRAPH = f"""{_WORDS},
dn AS (SELECT doc_id || ':' || word AS name, any_value(4 + length(word) % 7) / 10.0 AS confidence, min(ord) AS ord FROM num GROUP BY doc_id, word),
dl AS (SELECT doc_id, ord, word AS a, lead(word) OVER (PARTITION BY doc_id, position ORDER BY ord) AS b FROM num),
g AS MATERIALIZED (SELECT doc_id || ':' || CASE WHEN ord % 7 = 6 THEN b ELSE a END AS src, doc_id || ':' || CASE WHEN ord % 7 = 6 THEN a ELSE b END AS dst, ord, ord % 5 > 1 AS dep FROM dl WHERE b IS NOT NULL),
needs AS MATERIALIZED (SELECT src, dst, min(ord) AS f FROM g WHERE dep GROUP BY src, dst),
seen AS (SELECT name FROM dn WHERE length(split_part(name, ':', 2)) % 4 = 0)"""
# Nodes that reach each other are a unit, named by the least; only nodes with arcs both ways can be.
_UNITS = """core AS MATERIALIZED (SELECT DISTINCT src, dst FROM needs WHERE src <> dst AND src IN (SELECT dst FROM needs) AND dst IN (SELECT src FROM needs)),
far(a, b) AS (SELECT src, dst FROM core UNION SELECT a, dst FROM far JOIN core ON src = b),
unit AS MATERIALIZED (SELECT x.a AS node, min(least(x.a, x.b)) AS u FROM far x JOIN far y ON x.a = y.b AND x.b = y.a WHERE x.a <> x.b GROUP BY x.a)"""
ORACLES["document_cycles"] = f"WITH RECURSIVE {_DOC_GRAPH}, {_UNITS} SELECT node AS concept, u AS least, count(*) OVER (PARTITION BY u) AS size FROM unit"
# The walk of prereq_chain over units, from one concept of each document; units have numbers.
ORACLES["document_prerequisites"] = f"""WITH RECURSIVE {_DOC_GRAPH}, {_UNITS},
arcs AS (SELECT coalesce(a.u, src) AS s, coalesce(b.u, dst) AS d, min((f, dst)) AS step FROM needs LEFT JOIN unit a ON a.node = src LEFT JOIN unit b ON b.node = dst WHERE coalesce(a.u, src) <> coalesce(b.u, dst) GROUP BY 1, 2),
ids AS MATERIALIZED (SELECT u, row_number() OVER (ORDER BY u) AS i FROM (SELECT s AS u FROM arcs UNION SELECT d FROM arcs)),
adj AS MATERIALIZED (SELECT x.i AS src, list(y.i ORDER BY step) AS deps FROM arcs JOIN ids x ON x.u = s JOIN ids y ON y.u = d GROUP BY x.i),
first AS (SELECT arg_min(src, (-n, src)) AS start FROM (SELECT src, count(*) AS n FROM needs GROUP BY src) GROUP BY split_part(src, ':', 1)),
begun AS MATERIALIZED (SELECT start, coalesce(u, start) AS su FROM first LEFT JOIN unit ON node = start),
w AS (SELECT start, [i] AS way, [1::BIGINT] AS rd, [i] AS met, CAST([] AS BIGINT[]) AS chain FROM begun JOIN ids ON u = su
  UNION ALL SELECT start, CASE WHEN d IS NULL THEN way[:-2] WHEN list_contains(met, d) THEN way ELSE list_append(way, d) END,
    CASE WHEN d IS NULL THEN rd[:-2] WHEN list_contains(met, d) THEN list_append(rd[:-2], rd[-1] + 1) ELSE list_append(list_append(rd[:-2], rd[-1] + 1), 1) END,
    CASE WHEN d IS NULL OR list_contains(met, d) THEN met ELSE list_append(met, d) END, CASE WHEN d IS NULL THEN list_append(chain, way[-1]) ELSE chain END
  FROM (SELECT w.*, deps[rd[-1]] AS d FROM w LEFT JOIN adj ON src = way[-1] WHERE len(way) > 0)),
listed AS (SELECT start, ids.u, k FROM (SELECT start, unnest(chain) AS i, generate_subscripts(chain, 1) AS k FROM w WHERE len(way) = 0) JOIN ids USING (i)
  UNION ALL SELECT start, su, 1 FROM begun WHERE su NOT IN (SELECT u FROM ids)),
members AS (SELECT start, k, coalesce(node, listed.u) AS concept FROM listed LEFT JOIN unit ON unit.u = listed.u)
SELECT start, concept, CAST(row_number() OVER (PARTITION BY start ORDER BY k, concept = start, concept) AS INT) AS place FROM members
WHERE concept <> start OR start IN (SELECT node FROM unit) OR start IN (SELECT src FROM needs WHERE src = dst)"""
_DOC_HOPS = "h1 AS MATERIALIZED (SELECT src AS s, dst AS c FROM needs), h2 AS MATERIALIZED (SELECT DISTINCT s, dst AS c FROM h1 JOIN needs ON src = c), h3 AS MATERIALIZED (SELECT DISTINCT s, dst AS c FROM h2 JOIN needs ON src = c), h4 AS (SELECT DISTINCT s, dst AS c FROM h3 JOIN needs ON src = c)"
ORACLES["document_dependencies"] = f"WITH {_DOC_GRAPH}, {_DOC_HOPS} SELECT s AS start, c AS concept, min(d)::INT AS distance FROM (SELECT *, 1 AS d FROM h1 UNION ALL SELECT *, 2 FROM h2 UNION ALL SELECT *, 3 FROM h3) GROUP BY s, c"
ORACLES["document_gaps"] = f"""WITH {_DOC_GRAPH}, {_DOC_HOPS}, dist AS (SELECT s, c, min(d) AS d FROM (SELECT *, 1 AS d FROM h1 UNION ALL SELECT *, 2 FROM h2 UNION ALL SELECT *, 3 FROM h3 UNION ALL SELECT *, 4 FROM h4) GROUP BY s, c),
r AS (SELECT s, c, d, CASE d WHEN 2 THEN 1.0 / 3 ELSE 0.5 END AS rel FROM dist ANTI JOIN seen ON name = c)
SELECT s AS start, c AS concept, CAST(round(rel, 4) AS DOUBLE) AS relevance FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY rel DESC, d, c) AS k FROM r) WHERE k <= 5"""
ORACLES["document_next"] = f"""WITH {_DOC_GRAPH}, near AS MATERIALIZED (SELECT src AS s, dst AS c, min(ord) AS f FROM g ANTI JOIN seen ON name = dst WHERE NOT dep GROUP BY 1, 2),
b AS (SELECT near.s, near.c, string_agg(o.c, ', ' ORDER BY o.f, o.c) FILTER (k <= 2) AS needed FROM (SELECT near.*, n.src AS other, row_number() OVER (PARTITION BY near.s, near.c ORDER BY o.f, o.c) AS k FROM near JOIN needs n ON n.dst = near.c AND n.src <> n.dst JOIN near o ON o.s = near.s AND o.c = n.src) near JOIN near o ON o.s = near.s AND o.c = near.other GROUP BY 1, 2),
r AS (SELECT near.s, near.c, near.f, needed, confidence FROM near LEFT JOIN b ON b.s = near.s AND b.c = near.c JOIN dn ON dn.name = near.c)
SELECT s AS start, c AS concept, needed IS NOT NULL AS is_gateway, CAST(confidence AS DOUBLE) AS score, coalesce(needed, '') AS needed_by, CAST(k AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY needed IS NOT NULL DESC, confidence DESC, f, c) AS k FROM r) WHERE k <= 3"""
ORACLES["concept_info"] = "SELECT n_name AS name, CAST(n_nationkey % 10 / 10.0 AS DOUBLE) AS confidence FROM nation WHERE n_regionkey = 1"
ORACLES["knowledge_gaps"] = f"""WITH RECURSIVE {_GRAPH}, {_HOPS.format(4)}, r AS (SELECT s, c, d, CASE d WHEN 1 THEN 0.5 WHEN 2 THEN 1.0 / 3 ELSE 0.5 END AS rel FROM dist WHERE c NOT IN (SELECT name FROM seen))
SELECT s AS start, c AS concept, round(rel, 4) AS relevance FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY rel DESC, d, c) AS k FROM r) WHERE k <= 5"""
ORACLES["suggest_next"] = f"""WITH {_GRAPH}, near AS (SELECT src AS s, dst AS c, min(ord) AS f FROM g WHERE NOT dep AND dst NOT IN (SELECT name FROM seen) GROUP BY 1, 2),
r AS (SELECT s, c, f, EXISTS (SELECT 1 FROM near o JOIN needs n ON n.src = o.c WHERE o.s = near.s AND n.dst = near.c AND n.src <> n.dst) AS gate, (n_nationkey % 10) / 10.0 AS score FROM near JOIN nation ON n_name = c)
SELECT s AS start, c AS concept, gate AS is_gateway, CAST(score AS DOUBLE) AS score, k AS place FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY gate DESC, score DESC, f, c) AS k FROM r) WHERE k <= 3"""
ORACLES["suggestions"] = f"""WITH {_GRAPH}, f AS (SELECT n_name AS c, n_nationkey AS o FROM nation WHERE n_name NOT IN (SELECT name FROM seen) ORDER BY o LIMIT 10), r AS (SELECT c, o, c IN (SELECT src FROM needs) AS has FROM f)
SELECT c AS concept, has AS has_dependencies, CASE WHEN has THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS relevance, k AS place FROM (SELECT *, row_number() OVER (ORDER BY has DESC, o, c) AS k FROM r) WHERE k <= 4"""
ORACLES["question_suggestions"] = rf"""WITH {_WORDS}, f AS (SELECT word, df FROM dict ORDER BY df DESC, word LIMIT 10),
bw AS (SELECT DISTINCT lower(regexp_replace(unnest(string_split(replace(text, chr(10), ' '), ' ')), '[^\p{{L}}]', '', 'g')) AS word FROM benchmark)
SELECT word AS concept FROM f ANTI JOIN bw USING (word) ORDER BY df DESC, word LIMIT 2"""
ORACLES["valid_suggestions"] = "SELECT n_name AS concept, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey <> 1 AND c_acctbal > 0 GROUP BY 1"
ORACLES["exported_graph"] = f"WITH {_GRAPH} SELECT source, target, relation, CAST(0.5 AS DOUBLE) AS weight FROM (SELECT src AS source, dst AS target, relation FROM g UNION SELECT dst, src, relation FROM g)"
ORACLES["claim_verdict"] = """WITH h AS (SELECT user_id AS claim, event_id, least(1.0, value / 500) AS score, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events)
SELECT claim, CASE WHEN max(score) > 0.7 THEN 'SUPPORTED' ELSE 'UNVERIFIED' END AS verdict, CAST(CASE WHEN max(score) > 0.7 THEN 0.7 ELSE 0.4 END AS DOUBLE) AS confidence, string_agg(event_id::VARCHAR, ',' ORDER BY event_id) FILTER (k <= 3) AS sources FROM h GROUP BY claim"""
ORACLES["search_results"] = "SELECT doc_id, md5(left(text, 200)) AS digest FROM documents"

# Sessions ------------------------------------------------------------------

_LAST = "last AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations)"
_STATE = """st AS (SELECT user_id AS session_id, event_type AS concept_name, arg_max(event_id % 2 = 0, (ts, event_id)) AS explored,
 arg_max(CASE WHEN event_id % 3 > 0 THEN least(1.0, value / 500) END, (ts, event_id)) FILTER (event_id % 3 > 0 AND value IS NOT NULL) AS confidence, arg_max(ts, (ts, event_id)) FILTER (event_id % 2 = 0) AS explored_at, min(ts) AS first_mentioned_at FROM events GROUP BY 1, 2)"""
ORACLES["history_last_n"] = f"WITH {_LAST} SELECT conv_id AS session_id, turn AS id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place, role FROM last WHERE k <= 3"
ORACLES["context_string"] = f"WITH {_LAST} SELECT conv_id AS session_id, md5(string_agg(role || ': ' || left(text, 100), chr(10) ORDER BY turn)) AS digest FROM last WHERE k <= 5 GROUP BY conv_id"
ORACLES["concept_state"] = f"WITH {_STATE} SELECT * FROM st"
ORACLES["explored_states"] = f"WITH {_STATE} SELECT session_id, concept_name FROM st WHERE explored"
ORACLES["latest_article"] = "SELECT user_id AS session_id, arg_max(props, (ts, event_id)) AS content_json FROM events WHERE event_id % 2 = 0 GROUP BY 1"
ORACLES["session_updates"] = "SELECT user_id AS session_id, min(ts) AS created_at, max(ts) AS updated_at FROM events GROUP BY 1"
ORACLES["session_list"] = "SELECT user_id AS session_id, min(ts) AS created_at FROM events GROUP BY 1"
ORACLES["session_append"] = "SELECT conv_id AS session_id, role, count(*) AS n FROM conversations GROUP BY ALL"
ORACLES["stored_blocks"] = f"WITH {_CB}, l AS (SELECT DISTINCT doc_id FROM labels) SELECT doc_id::VARCHAR AS doc_id, count(*) AS n_blocks, count(*) FILTER (doc_id % 10 = 7) AS n_again, doc_id IN (SELECT doc_id FROM l) AS labelled FROM cb GROUP BY doc_id"
ORACLES["cascade_delete"] = "SELECT conv_id AS session_id, count(*) AS n FROM conversations WHERE conv_id % 4 <> 1 GROUP BY 1"
ORACLES["constraint_violations"] = """WITH m AS (SELECT conv_id AS s, CASE WHEN conv_id % 3 = 0 THEN 0 ELSE turn END AS id, CASE WHEN conv_id % 5 = 0 THEN 'robot' ELSE role END AS role, text FROM conversations)
SELECT 'unique id' AS rule, s AS session_id, count(*) AS n FROM (SELECT s, id FROM m GROUP BY s, id HAVING count(*) > 1) GROUP BY s
UNION ALL SELECT 'role', s, count(*) FROM m WHERE role NOT IN ('user', 'assistant', 'system') GROUP BY s UNION ALL SELECT 'content', s, count(*) FROM m WHERE text IS NULL GROUP BY s"""
ORACLES["seed_states"] = f"WITH {_STATE}, k AS (SELECT DISTINCT event_type AS c FROM events) SELECT session_id, concept_name, explored FROM st WHERE session_id <> 1 UNION ALL SELECT 1, c, false FROM k"

# Replies -------------------------------------------------------------------

ORACLES["intent_parse"] = """SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'summarize' WHEN 1 THEN 'navigate' ELSE 'unknown' END AS intent, CASE turn % 4 WHEN 0 THEN 'x' ELSE '-' END AS concept,
 CAST(CASE turn % 4 WHEN 0 THEN 0.9 WHEN 3 THEN 0.0 ELSE 0.5 END AS DOUBLE) AS confidence FROM conversations"""
ORACLES["quality_parse"] = """SELECT doc_id AS key, CAST(CASE WHEN toxic = 0 THEN (doc_id % 9 + 1) / 10.0 ELSE 0.5 END AS DOUBLE) AS credibility, CAST(0.5 AS DOUBLE) AS bias, CASE WHEN toxic = 0 THEN 'none' ELSE 'unknown' END AS bias_type, 'unknown' AS readability,
 CASE WHEN toxic = 0 THEN 3 ELSE 0 END AS n_strengths, 0 AS n_weaknesses, 10 AS bar FROM labels"""
ORACLES["prereq_parse"] = "SELECT doc_id AS key, n AS place, n::VARCHAR AS concept, CASE n % 3 WHEN 0 THEN '●○○' WHEN 1 THEN '●●○' ELSE '●●●' END AS marker, 'r' || n AS reason FROM labels, (SELECT unnest(range(6)) AS n) WHERE doc_id % 3 < 2"
_ARTICLES = "art AS (SELECT doc_id, coalesce(text, '') AS c FROM documents)"
ORACLES["prompt_columns"] = f"""WITH {_ARTICLES}, p AS (SELECT doc_id, 'summary' AS kind, 'Summarize in a few sentences. Concepts: a, b' || chr(10) || left(c, 3000) AS p FROM art
 UNION ALL SELECT doc_id, 'explanation', 'Explain from the text: why?' || chr(10) || left(c, 2000) FROM art UNION ALL SELECT doc_id, 'suggestion', 'Suggest what to read next among: a, b' FROM art
 UNION ALL SELECT doc_id, 'answer', 'Answer from the text: why?' || chr(10) || left(c, 2500) FROM art UNION ALL SELECT doc_id, 'quality', 'Rate credibility and bias as JSON.' || chr(10) || left(c, 2500) FROM art)
SELECT doc_id AS key, kind, md5(p) AS digest FROM p"""
ORACLES["answer_fallbacks"] = """WITH k AS (SELECT unnest(['summary', 'explanation', 'suggestion', 'answer', 'quality']) AS kind)
SELECT d.doc_id AS key, kind, CASE WHEN l.quality = 1 THEN 'good' WHEN kind = 'summary' THEN 'No summary is available.' WHEN kind = 'suggestion' THEN 'Try one of the related concepts.' ELSE 'No answer is available.' END AS text
FROM documents d CROSS JOIN k LEFT JOIN labels l ON l.doc_id = d.doc_id AND kind = CASE WHEN toxic = 1 THEN 'answer' ELSE 'summary' END"""
ORACLES["article_graph"] = "SELECT doc_id AS key, 'a' AS source, 'b' AS target, 'R' || doc_id AS relation FROM labels WHERE toxic = 0"
ORACLES["reply_json"] = "SELECT event_id, CASE WHEN event_id % 3 < 2 THEN md5(props) END AS digest FROM events"
ORACLES["ready_documents"] = "SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels"
ORACLES["ready_listing"] = "SELECT doc_id, a AS n_left, b AS n_right FROM (SELECT doc_id, count(*) AS a FROM documents GROUP BY 1) JOIN (SELECT doc_id, count(*) AS b FROM labels GROUP BY 1) USING (doc_id)"

# Stored tables and runs ----------------------------------------------------

ORACLES["session_log"] = "SELECT conv_id AS session_id, count(*) AS n, max(turn) - min(turn) AS seconds FROM conversations WHERE conv_id % 10 <> 3 GROUP BY conv_id"
ORACLES["stored_documents"] = f"""WITH {_CB} SELECT doc_id, CASE WHEN doc_id % 10 = 7 THEN 1 WHEN doc_id % 10 = 8 THEN 2 * count(*) ELSE count(*) END AS n_blocks, CASE WHEN doc_id % 10 = 7 THEN 1 ELSE 0 END AS n_again, CASE WHEN doc_id % 10 = 7 THEN 0 ELSE max(position) END AS last
FROM cb WHERE doc_id % 10 <> 9 GROUP BY doc_id"""
ORACLES["phase_runs"] = f"""WITH {_WORDS},
kept AS (SELECT DISTINCT doc_id, block_id, lower(name) AS name FROM cand WHERE trim(name) <> '' AND lower(name) NOT IN {_STOP} AND length(name) >= 3 AND (doc_id % 6 = 5 OR conf >= 0.5)),
n AS (SELECT doc_id, count(*) AS n FROM kept GROUP BY doc_id), d AS (SELECT doc_id, doc_id IN (SELECT doc_id FROM cand) AS there, coalesce(n, 0) AS n FROM documents LEFT JOIN n USING (doc_id)),
once AS (SELECT *, CASE WHEN NOT there THEN 'missing' WHEN doc_id % 6 = 3 THEN 'failed' ELSE 'done' END AS status FROM d),
log AS (SELECT doc_id, 1 AS turn, status, n FROM once WHERE doc_id % 4 <> 1 UNION ALL SELECT doc_id, 2, status, n FROM once WHERE doc_id % 4 = 1 OR status = 'failed' UNION ALL SELECT doc_id, 3, 'done', n FROM once WHERE status = 'failed')
SELECT doc_id, turn, status, CASE status WHEN 'missing' THEN 'no input' WHEN 'failed' THEN 'no JSON' END AS error, CASE status WHEN 'done' THEN n ELSE 0 END AS n_rows, n AS n_stored FROM log"""
ORACLES["stored_candidates"] = f"WITH {_WORDS} SELECT CAST(doc_id AS VARCHAR) AS doc_id, count(*) AS n, sum(length(name)) AS chars, count(*) FILTER (position > 0) AS n_paths, {_mean('conf', 4)} AS confidence FROM cand GROUP BY doc_id"
ORACLES["stored_canonical"] = f"""WITH {_KNOWN} SELECT CASE WHEN nth % 9 = 0 THEN 'unreadable' ELSE CAST(doc_id AS VARCHAR) END AS doc_id, count(*) AS n, count(*) FILTER (nth % 9 = 0) AS n_corrupt, coalesce(sum(nth) FILTER (nth % 9 > 0), 0) AS total, count(*) FILTER (nth % 9 > 0) AS n_aliases FROM held GROUP BY 1"""
ORACLES["stored_edges"] = f"WITH {_RELATED_ONCE} SELECT CAST(doc_id AS VARCHAR) AS doc_id, relation_type, count(*) AS n, {_mean('confidence', 4)} AS confidence FROM edg GROUP BY doc_id, relation_type"
ORACLES["cluster_prompts"] = f"WITH {_CLUSTERS} SELECT doc_id, cluster, md5('Are these names of one concept? Answer yes or no.' || chr(10) || '- ' || string_agg(name, chr(10) || '- ' ORDER BY ord)) AS digest FROM clus WHERE size > 1 GROUP BY doc_id, cluster"
ORACLES["viewer_nodes"] = """WITH t AS (SELECT o_custkey // 100 AS doc_id, s_nationkey AS s, c_nationkey AS t FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey),
e AS (SELECT doc_id, s AS id FROM t UNION SELECT doc_id, t FROM t), n AS (SELECT c_custkey // 100 AS doc_id, c_nationkey AS id, count(*) AS n FROM customer GROUP BY ALL)
SELECT doc_id, id, n_name AS label, CASE WHEN id % 3 > 0 THEN 'core_concept' ELSE 'unknown' END AS type, CAST(CASE WHEN id % 4 > 1 AND n > 0 THEN n / 10.0 ELSE 0.5 END AS DOUBLE) AS importance FROM e JOIN nation ON n_nationkey = id LEFT JOIN n USING (doc_id, id)"""
ORACLES["exported_nodes"] = f"WITH {_DOC_GRAPH} SELECT name AS id, name AS label, 'core_concept' AS type, CAST(confidence AS DOUBLE) AS importance FROM dn"
ORACLES["article_nodes"] = """SELECT doc_id AS key, source AS id, upper(source) AS label, 0.25::DOUBLE AS importance FROM documents WHERE doc_id % 5 > 0
UNION ALL SELECT doc_id, lang, lang, 0.5::DOUBLE FROM documents WHERE doc_id % 5 > 0"""
# Names are those of the greatest id here, and only blocks with two mentions have replies.
_PHASE = _MENTIONS.replace("arg_max(cid, nth) AS concept_id", "max(cid) AS concept_id").replace("names AS (", "names AS MATERIALIZED (") + ",\n" + _RELATED.split(_KNOWN + ",\n")[1].replace("rel AS (", "rel AS MATERIALIZED (")
ORACLES["relation_phase"] = f"""WITH {_PHASE}, asked AS MATERIALIZED (SELECT DISTINCT doc_id, block_id FROM men),
own AS (SELECT edg.* FROM edg SEMI JOIN asked ON asked.doc_id = edg.doc_id AND asked.block_id = edg.evidence_block_id)
SELECT doc_id, source_concept_id, target_concept_id, relation_type, first(edge_id ORDER BY position, place) AS edge_id, first(evidence_block_id ORDER BY position, place) AS evidence_block_id, {_mean("confidence", 2)} AS confidence FROM own GROUP BY doc_id, source_concept_id, target_concept_id, relation_type"""
