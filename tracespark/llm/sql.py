"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

from tracespark.llm.licenses import BASE, NOTICES, LicenseIndex
from tracespark.llm.url_filters import RULES

WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP1 = """
WITH crc AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t),
d AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 8 AS size, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'),
    lambda h: strpos('0123456789ABCDEF', h[1]) * 16 - 17 + strpos('0123456789ABCDEF', h[2])) AS octets FROM documents),
p AS (SELECT d.doc_id, d.size, CASE WHEN len(octets) = 0 THEN 0 ELSE xor(list_reduce(octets, lambda c, x: xor(c >> 8, crc.t[xor(c & 255, x) + 1]), 4294967295), 4294967295) END AS text_crc32,
    sum(d.size) OVER (ORDER BY doc_id) - d.size AS before, sum(d.size) OVER () AS total FROM d, crc),
s AS (SELECT *, least(23, ((2 * before + size) * 24) // (2 * total))::INT AS shard FROM p)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'bytes' AS law, shard,
    row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, NULL::INT AS grown_shard FROM s
"""


def _lists(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def op2() -> str:
    base = ", ".join(f"({_lists(p.split())}, '{label}')" for p, label in BASE.items())
    notices = []
    for k, (label, notice, keys) in enumerate(NOTICES):
        words, key = notice.split(), keys[0].split()
        at, last = (LicenseIndex._place(words, q.split()) for q in (keys[0], keys[-1]))
        notices.append(f"({k}, '{label}', {_lists(words)}, {_lists(key)}, {at}, {_lists(keys[-1].split())}, {last})")
    return f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
base(phrase, label) AS (VALUES {base}),
notice(k, label, words, key, skip, also, skip_also) AS (VALUES {', '.join(notices)}),
i AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM d),
b AS (SELECT i.doc_id, i.i, label FROM i JOIN base ON i.word = phrase[1] JOIN d ON d.doc_id = i.doc_id WHERE d.w[i.i + 1 : i.i + len(phrase)] = phrase),
n AS (SELECT i.doc_id, notice.*, i.i - skip AS start, d.w FROM i JOIN notice ON i.word = key[1] JOIN d ON d.doc_id = i.doc_id WHERE d.w[i.i + 1 : i.i + len(key)] = key
    AND i.i - skip + skip_also >= 0 AND d.w[i.i - skip + skip_also + 1 : i.i - skip + skip_also + len(also)] = also),
s AS (SELECT doc_id, label, list_sum(list_transform(range(len(words)), lambda x: (start + x >= 0 AND start + x < len(w) AND w[start + x + 1] = words[x + 1])::INT)) / len(words) AS share FROM n),
bs AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word FROM b GROUP BY 1),
l AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM b GROUP BY 1),
al AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM b UNION SELECT doc_id, label FROM s WHERE share >= 0.8) GROUP BY 1),
sc AS (SELECT doc_id, max(share) AS score FROM s WHERE share >= 0.8 GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
    coalesce(labels, '') AS labels, coalesce(score, CASE WHEN n_base > 0 THEN 0.5 ELSE 0 END)::DOUBLE AS score
FROM d LEFT JOIN bs USING (doc_id) LEFT JOIN l USING (doc_id) LEFT JOIN al USING (doc_id) LEFT JOIN sc USING (doc_id)
"""


def op4() -> str:
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    host = lower.format(r"regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1)")
    target = lower.format(r"regexp_extract(b, '(?s)^.*?://([^/?#]*)', 1)")

    def canonical(url: str, host: str) -> str:
        path = rf"regexp_extract({url}, '(?s)^.*?://[^/?#]*([^?#]*)', 1)"
        query = rf"regexp_extract({url}, '(?s)^.*?://[^?#]*\?([^#]*)', 1)"
        kept = rf"array_to_string(list_sort(list_filter(string_split({query}, '&'), lambda q: q <> '' AND NOT regexp_matches(q, '^(utm_[a-z]+|ref|source|fbclid|gclid)='))), '&')"
        return (rf"regexp_replace(regexp_replace({host}, ':(80|443)$', ''), '^(www|m)\.', '') || regexp_replace({path}, '(/index\.html?|\.html?|/+)$', '')"
                rf" || CASE WHEN {kept} <> '' THEN '?' || {kept} ELSE '' END")

    # RE2 has no lookahead: the tag is cut out first, then its link.
    link = r"""SELECT url, regexp_extract(tag, '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1) AS b FROM (SELECT url, unnest(regexp_extract_all(html, '(?is)<link\b[^>]*>')) AS tag FROM pages) WHERE regexp_matches(tag, '(?is)\brel\s*=\s*["'']?canonical\b')
    UNION ALL SELECT url, regexp_extract(tag, '(?is)\bcontent\s*=\s*["''][^"''>]*?url\s*=\s*([^"''\s>]+)', 1) FROM (SELECT url, unnest(regexp_extract_all(html, '(?is)<meta\b[^>]*>')) AS tag FROM pages) WHERE regexp_matches(tag, '(?is)\bhttp-equiv\s*=\s*["'']?refresh\b')"""
    absolute = r"""SELECT url, CASE WHEN contains(b, '://') THEN b WHEN starts_with(b, '//') THEN regexp_replace(regexp_extract(url, '(?s)^(.*?://)', 1), '//$', '') || b
    WHEN starts_with(b, '/') THEN regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) || b ELSE regexp_extract(url, '(?s)^(.*?://[^/?#]*(?:[^?#]*/)?)', 1) || b END AS b FROM link WHERE b <> ''"""
    return f"""
WITH RECURSIVE u AS (SELECT page_id, url, coalesce({host}, '') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path, coalesce({canonical('url', host)}, '') AS page FROM pages),
rules(verdict, rhost, rpath) AS (VALUES {rules}),
fit AS (SELECT page_id, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS verdict FROM u JOIN rules
    ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id),
link AS ({link}), absolute AS ({absolute}),
edge AS (SELECT {canonical('url', host)} AS a, {canonical('b', target)} AS b FROM absolute),
both_ AS (SELECT a, b FROM edge WHERE a <> b AND a <> '' AND b <> '' UNION SELECT b, a FROM edge WHERE a <> b AND a <> '' AND b <> ''),
reach AS (SELECT a AS node, a AS other FROM both_ UNION SELECT reach.node, both_.b FROM reach JOIN both_ ON reach.other = both_.a),
root AS (SELECT node, min(other) AS root FROM reach GROUP BY node),
r AS (SELECT u.*, rule, verdict, coalesce(root.root, page) AS root FROM u LEFT JOIN fit USING (page_id) LEFT JOIN root ON page = node),
said AS (SELECT root, bool_or(verdict = 'allow') AS allowed, bool_or(verdict = 'block') AS blocked FROM r WHERE verdict IS NOT NULL AND root <> '' GROUP BY root)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN blocked AND NOT allowed THEN 'block' END, 'allow') AS verdict FROM r LEFT JOIN said ON r.root = said.root
"""


OP9 = f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, {WORDS} AS w FROM benchmark),
p AS (SELECT DISTINCT item, w[i + 1 : i + least(10, len(w))] AS pat FROM b, unnest(range(greatest(1, len(w) - 9))) AS u(i) WHERE len(w) > 0),
n AS (SELECT DISTINCT len(pat) AS n FROM p),
win AS (SELECT doc_id, i, n, w[i + 1 : i + n] AS pat FROM d, n, unnest(range(len(w) - n + 1)) AS u(i) WHERE len(w) >= n),
hit AS (SELECT win.doc_id, win.i, win.n, p.item FROM win JOIN p ON win.pat = p.pat),
pos AS (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS i FROM hit),
h AS (SELECT doc_id, count(*) AS n_hit FROM pos GROUP BY 1),
it AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN it USING (doc_id)
"""

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP11 = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, pos, line, {LOWER.format("trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key
    FROM (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM d)),
s AS (SELECT key, min(doc_id) AS first FROM l WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
k AS (SELECT l.doc_id, l.pos, l.line, s.first IS NOT NULL AND s.first <> l.doc_id AS gone FROM l LEFT JOIN s ON l.key = s.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM k GROUP BY doc_id
"""

OP12 = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({LOWER.format("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, array_to_string(w[i + 1 : i + k], ' ') AS phrase FROM w, unnest(range(1, 5)) AS s(k), unnest(range(len(w) - k + 1)) AS t(i) WHERE len(w) >= k),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k >= 2),
cut AS (SELECT c.lang, c.phrase, a, cut, l.f AS l, r.f AS r, ((2000000::HUGEINT * a) // (l.f + r.f))::BIGINT AS score
    FROM c, unnest(range(1, c.k)) AS s(cut) JOIN f AS l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1 : cut], ' ')
    JOIN f AS r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[cut + 1 : c.k], ' ')),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inner_ AS (SELECT lang, array_to_string(w[i + 1 : i + size], ' ') AS phrase, max(a) AS longer FROM c, unnest(range(2, k)) AS s(size), unnest(range(k - size + 1)) AS t(i) GROUP BY 1, 2),
kept AS (SELECT best.* FROM best LEFT JOIN inner_ USING (lang, phrase) WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept QUALIFY rank <= 2000)
SELECT lang, rank, phrase, a, l, r, n, score FROM r JOIN n USING (lang)
"""

OP13 = f"""
WITH t AS (SELECT row_number() OVER () AS row, doc_id, {WORDS} AS w FROM documents),
d AS (SELECT row, doc_id, len(w) AS n FROM t WHERE len(w) > 0),
total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS len FROM d),
tf AS (SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(w) AS term FROM t) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
q AS (SELECT DISTINCT item_id, unnest({WORDS}) AS term FROM benchmark),
s AS (SELECT item_id, doc_id, row, sum(floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::BIGINT * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // len))))::BIGINT AS score
    FROM q JOIN tf USING (term) JOIN df USING (term) JOIN d USING (row), total GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 10
"""

SQL = {"op13_lexical_search": OP13, "op12_collocations": OP12, "op11_line_dedup": OP11, "op1_sharding": OP1, "op2_licenses": op2(), "op4_url_filters": op4(), "op9_decontamination": OP9}
