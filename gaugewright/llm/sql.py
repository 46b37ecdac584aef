"""DuckDB SQL for the queries of this subpackage that SQL can express.

Language identification, token files, packing, sharding, language-model scores and whitening have no
such form: tests hold them against held-out accuracy, round trips, brute force and their laws. These texts say what the results are, by
plain joins and counts, and nothing of how the operators find them.
"""

from __future__ import annotations

from gaugewright.llm import divergence, licenses, linededup
from gaugewright.llm.queries import URL_RULES

_SPACE = r"[\x20\x09-\x0D]+"


def _quoted(value) -> str:
    return "'" + str(value).replace("'", "''") + "'"


def _license_scan() -> str:
    wordings = ", ".join(f"({_quoted(name)}, {k}, {_quoted(text)})" for name, texts in sorted(licenses.TEMPLATES.items()) for k, text in enumerate(texts))
    t = licenses.THRESHOLD
    plain = lambda c: f"trim(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g'))"
    pairs = lambda w: f"unnest(list_transform(range(1, len({w})), lambda i: {w}[i] || ' ' || {w}[i + 1]))"
    parts = lambda kind, split: f"SELECT doc_id, '{kind}' AS kind, i AS pos, {plain('p[i]')} AS norm FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT doc_id, {split} AS p FROM d) WHERE len(p) > 1)"
    return f"""WITH x(license, k, wording) AS (VALUES {wordings}), y AS (SELECT license, k, string_split({plain("wording")}, ' ') AS w FROM x),
t AS (SELECT license, k, t_size, bigram, count(*) AS t_count FROM (SELECT license, k, len(w) - 1 AS t_size, {pairs("w")} AS bigram FROM y) GROUP BY ALL),
d AS (SELECT doc_id, lower(text) AS text FROM documents WHERE text IS NOT NULL),
u AS (SELECT doc_id, 'text' AS kind, 0 AS pos, {plain("text")} AS norm FROM d UNION ALL {parts("paragraph", "string_split_regex(text, '\\n[ \\t\\r]*\\n')")} UNION ALL {parts("line", "string_split(text, chr(10))")} UNION ALL {parts("sentence", "string_split_regex(text, '[.!?;:][ \\t\\r\\n]+|\\n[ \\t\\r]*\\n')")}),
w AS (SELECT doc_id, kind, pos, string_split(norm, ' ') AS w FROM u), b AS (SELECT doc_id, kind, pos, len(w) - 1 AS n, {pairs("w")} AS bigram FROM w WHERE len(w) > 1),
c AS (SELECT doc_id, kind, pos, n, license, k, t_size, bigram, t_count, count(*) AS c FROM b JOIN t USING (bigram) GROUP BY ALL),
e AS (SELECT doc_id, kind, pos, license, 2.0::DOUBLE * sum(least(c, t_count)) / (n + t_size) AS dice FROM c GROUP BY doc_id, kind, pos, license, k, n, t_size HAVING 2.0::DOUBLE * sum(least(c, t_count)) / (n + t_size) >= {t}::DOUBLE),
g AS (SELECT doc_id, license, dice FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, kind, pos ORDER BY dice DESC, license) AS rn FROM e) WHERE rn = 1),
k AS (SELECT doc_id, license, dice, row_number() OVER (PARTITION BY doc_id ORDER BY dice DESC, license) AS rn FROM g), f AS (SELECT doc_id, count(DISTINCT license) AS n_licenses FROM g GROUP BY doc_id)
SELECT documents.doc_id, k.license, round(coalesce(k.dice, 0), 6) AS dice, coalesce(f.n_licenses, 0) AS n_licenses FROM documents LEFT JOIN k ON k.doc_id = documents.doc_id AND rn = 1 LEFT JOIN f ON f.doc_id = documents.doc_id"""


_WORDS = f"list_filter(string_split_regex(coalesce(text, ''), '{_SPACE}'), lambda x: x <> '')"
_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_NEAR_DUPLICATES = f"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex({_FOLDED}, '{_SPACE}'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL), e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
r AS (SELECT doc_id AS node, doc_id AS other FROM n UNION SELECT r.node, e.b FROM r JOIN e ON r.other = e.a), c AS (SELECT node, min(other) AS component_id FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id, d.doc_id = coalesce(c.component_id, d.doc_id) AS kept FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.node = d.doc_id"""


def _url_filter() -> str:
    rules = ", ".join(f"({_quoted(k)}, {_quoted(h)}, {_quoted(p)})" for k, h, p in URL_RULES)
    host = lambda u: f"coalesce(lower(regexp_extract({u}, '(?s)^.*?://([^/?#]*)', 1)), '')"
    key = lambda u: f"CASE WHEN contains({u}, '://') THEN {host(u)} || regexp_extract({u}, '(?s)^.*?://[^/?#]*([^#]*)', 1) END"
    link, meta = r"(?is)^<link\b.*\brel\s*=\s*[\"'']?canonical\b", r"(?is)^<meta\b.*\bhttp-equiv\s*=\s*[\"'']?refresh\b"
    value = lambda name: rf"(?is)\b{name}\s*=\s*[\"'']?([^\"''\s>]+)"
    best = lambda source: f"SELECT x.*, r.rule, r.kind FROM {source} x LEFT JOIN LATERAL (SELECT h || p AS rule, kind FROM rules WHERE (x.host = h OR ends_with(x.host, '.' || h)) AND starts_with(x.path, p) ORDER BY length(h || p) DESC, kind, h || p DESC LIMIT 1) r ON true"
    return f"""WITH RECURSIVE rules(kind, h, p) AS (VALUES {rules}),
g AS (SELECT url, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\\b[^>]*>')) AS tag FROM pages WHERE contains(url, '://')),
t AS (SELECT url, replace(trim(CASE WHEN regexp_matches(tag, '{link}') THEN regexp_extract(tag, '{value("href")}', 1) WHEN regexp_matches(tag, '{meta}') THEN regexp_extract(tag, '{value("url")}', 1) END), '&amp;', '&') AS target FROM g),
a AS (SELECT url, CASE WHEN regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN target WHEN starts_with(target, '//') THEN 'http:' || target WHEN starts_with(target, '/') THEN 'http://' || {host("url")} || target END AS target FROM t),
e AS (SELECT {key("url")} AS src, {key("target")} AS dst FROM a WHERE target IS NOT NULL), b AS (SELECT src, dst FROM e WHERE src <> dst UNION SELECT dst, src FROM e WHERE src <> dst),
reach AS (SELECT src AS node, src AS other FROM b UNION SELECT reach.node, b.dst FROM reach JOIN b ON reach.other = b.src),
nodes AS (SELECT DISTINCT other, regexp_extract(other, '(?s)^([^/?]*)', 1) AS host, regexp_extract(other, '(?s)^[^/?]*([^?]*)', 1) AS path FROM reach), judged AS ({best("nodes")}),
spread AS (SELECT node, bool_or(kind = 'allow') AS allowed, bool_or(kind = 'block') AS blocked FROM reach JOIN judged USING (other) GROUP BY node),
own AS (SELECT page_id, {host("url")} AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path, {key("url")} AS key FROM pages), ruled AS ({best("own")})
SELECT page_id, host, path, rule, CASE WHEN kind IS NOT NULL THEN kind WHEN allowed THEN 'allow' WHEN blocked THEN 'block' ELSE 'allow' END AS verdict, CASE WHEN kind IS NOT NULL THEN 'rule' WHEN allowed OR blocked THEN 'alias' ELSE 'default' END AS "by" FROM ruled LEFT JOIN spread ON spread.node = ruled.key"""


_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_DECONTAMINATE = f"""WITH RECURSIVE b AS (SELECT item_id, regexp_extract_all({_FOLDED}, '{_ALNUM}') AS w FROM benchmark), bw AS (SELECT item_id, unnest(CASE WHEN len(w) >= 10 THEN list_transform(range(1, len(w) - 8), lambda i: w[i:i + 9]) WHEN len(w) > 0 THEN [w] ELSE [] END) AS g FROM b),
win AS (SELECT DISTINCT item_id, len(g) AS k, array_to_string(g, ' ') AS g FROM bw), lens AS (SELECT DISTINCT k FROM win), d AS (SELECT doc_id, regexp_extract_all({_FOLDED}, '{_ALNUM}') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d), m AS (SELECT doc_id, i, k, item_id FROM (SELECT doc_id, i, lens.k, array_to_string(w[i:i + lens.k - 1], ' ') AS g FROM p, lens WHERE i + lens.k - 1 <= len(w)) x JOIN win USING (k, g)),
h AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM m) GROUP BY doc_id), q AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM m GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN h USING (doc_id) LEFT JOIN q USING (doc_id)"""

_QUALITY = f"""WITH w AS (SELECT doc_id, {_WORDS} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l, len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]')) AS n_symbols FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)), c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g),
r AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS j FROM c WHERE c > 1) GROUP BY doc_id),
f AS (SELECT w.doc_id, w, l, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words FROM w LEFT JOIN r USING (doc_id)),
h AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, len(list_filter(range(2, n_words + 1), lambda i: w[i] = w[i - 1])) AS stutters, len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z]|[^\\x00-\\x7F]'))) AS lettered, len(list_filter(l, lambda x: regexp_matches(x, '^[\\x20\\x09-\\x0D]*[-*+•]'))) AS bullets FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR 10 * n_symbols > n_words OR 10 * n_dup_lines > 3 * len(l) OR 10 * stutters > 3 * n_words OR word_chars < 2 * n_words OR word_chars > 14 * n_words OR 10 * lettered < 6 * n_words OR 10 * bullets > 9 * len(l)) AS kept FROM h"""

_LINE_DEDUP = f"""WITH d AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS p FROM documents), l AS (SELECT doc_id, source, p[i] AS raw, i AS pos FROM (SELECT *, unnest(range(1, len(p) + 1)) AS i FROM d WHERE text IS NOT NULL)),
t AS (SELECT *, trim(raw, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS line FROM l), k AS (SELECT * FROM t WHERE line <> ''),
s AS (SELECT line, min({{'doc_id': doc_id, 'pos': pos}}) AS first FROM k GROUP BY line HAVING count(DISTINCT source) >= {linededup.MIN_SITES}), x AS (SELECT doc_id, pos FROM k JOIN s USING (line) WHERE {{'doc_id': doc_id, 'pos': pos}} <> first),
o AS (SELECT l.doc_id, count(*) AS n_lines, count(x.pos) AS n_removed, coalesce(string_agg(raw, chr(10) ORDER BY l.pos) FILTER (WHERE x.pos IS NULL), '') AS text FROM l LEFT JOIN x ON x.doc_id = l.doc_id AND x.pos = l.pos GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, CASE WHEN d.text IS NOT NULL THEN o.text END AS text FROM d LEFT JOIN o USING (doc_id)"""

_DIVERGENCE = rf"""WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({_FOLDED}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT rid, lang, source, unnest(w) AS term FROM d), k AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT rid) >= {divergence.MIN_DOCS}), g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY ALL), v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang), x AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n, 1 + {divergence.SCALE}::HUGEINT * (coalesce(n, 0) + 2) // (coalesce(total, 0) + 2 * v) AS p FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term LEFT JOIN x ON x.lang = g.lang AND x.source = g.source),
q AS (SELECT lang, term, 1 + {divergence.SCALE}::HUGEINT * (sum(n) + 2) // (sum(sum(n)) OVER (PARTITION BY lang) + 2 * count(*) OVER (PARTITION BY lang)) AS q FROM c GROUP BY lang, term),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
f AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
UNION ALL SELECT p.lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM f) WHERE part = 'pair' OR rank <= {divergence.TOP_TERMS}"""

ORACLES: dict[str, str] = {
    "op1_license_scan": _license_scan(),
    "op6_near_duplicates": _NEAR_DUPLICATES,
    "op7_url_filter": _url_filter(),
    "op8_decontaminate": _DECONTAMINATE,
    "op9_quality_cascade": _QUALITY,
    "op10_line_dedup": _LINE_DEDUP,
    "op13_source_divergence": _DIVERGENCE,
}
