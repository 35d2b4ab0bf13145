"""The same results in SQL (DuckDB), where SQL can express them over whole tables."""

from __future__ import annotations

from . import line_templates, phrases, repetition, secret_scan

_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"
_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_LOWER.format("coalesce(text, '')"))} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) c ON c.a = d.doc_id"""

_MASKED = "CASE WHEN regexp_matches({0}, '[0-9]') THEN '<*>' ELSE {0} END"
_LEAST = line_templates.MIN_TEXTS
OP4 = f"""
WITH a AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT *, ls[i] AS line, coalesce(ls[i - 1], '<none>') AS before, coalesce(ls[i + 1], '<none>') AS after FROM (SELECT doc_id, text, ls, unnest(range(1, len(ls) + 1)) AS i FROM a)),
w AS (SELECT doc_id, text, i, before, after, list_transform({_WORDS.format("line")}, lambda x: {_MASKED.format("x")}) AS ws FROM l),
f AS (SELECT *, len(ws) || ' ' || array_to_string(ws[1:{line_templates.DEPTH}], ' ') AS leaf FROM w WHERE len(ws) > 0),
n AS (SELECT * FROM f WHERE leaf IN (SELECT leaf FROM f GROUP BY leaf HAVING count(*) >= {_LEAST})),
t AS (SELECT doc_id, text, i, before, after, leaf, p, ws[p] AS word FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS p FROM n)),
c AS (SELECT leaf, p, word, true AS fixed FROM t GROUP BY leaf, p, word HAVING count(*) >= {_LEAST}),
m AS (SELECT doc_id, text, i, before, after, leaf, string_agg(CASE WHEN fixed THEN word ELSE '<*>' END, ' ' ORDER BY p) AS template, count(*) FILTER (WHERE fixed AND word <> '<*>') AS known, count(*) AS size
  FROM t LEFT JOIN c USING (leaf, p, word) GROUP BY doc_id, text, i, before, after, leaf),
k AS (SELECT * FROM m WHERE known >= {line_templates.MIN_CONSTANT}::DOUBLE * size),
r AS (SELECT leaf, template FROM k GROUP BY leaf, template HAVING count(DISTINCT text) >= {_LEAST} AND greatest(count(DISTINCT before), count(DISTINCT after)) >= {line_templates.MIN_SPREAD} * count(DISTINCT text)),
g AS (SELECT doc_id, list(i) AS spots FROM k JOIN r USING (leaf, template) GROUP BY doc_id)
SELECT a.doc_id, CASE WHEN spots IS NULL THEN text ELSE array_to_string(list_transform(list_filter(range(1, len(ls) + 1), lambda i: NOT list_contains(spots, i)), lambda i: ls[i]), chr(10)) END AS text,
  coalesce(len(ls), 0)::BIGINT AS n_lines, coalesce(len(spots), 0)::BIGINT AS n_dropped FROM a LEFT JOIN g USING (doc_id)"""

OP6 = f"""
WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(ws) - 11)) AS i, ws FROM w WHERE len(ws) >= 13),
k AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k FROM g),
f AS (SELECT k, min(doc_id) AS m FROM k GROUP BY k),
gone AS (SELECT DISTINCT doc_id, i + unnest(range(13)) AS i FROM k JOIN f USING (k) WHERE m < doc_id),
x AS (SELECT doc_id, list(i) AS spots FROM gone GROUP BY doc_id),
z AS (SELECT w.doc_id, ws, CASE WHEN spots IS NULL THEN ws ELSE list_transform(list_filter(range(1, len(ws) + 1), lambda i: NOT list_contains(spots, i)), lambda i: ws[i]) END AS kept FROM w LEFT JOIN x USING (doc_id))
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - len(kept))::BIGINT AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM z"""

OP8 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
o AS (SELECT b, max(page_id) AS owner FROM p WHERE octet_length(b) >= 1000 GROUP BY b)
SELECT page_id, octet_length(p.b)::BIGINT AS payload_bytes, sha1(p.b) AS payload_digest, CASE WHEN owner <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN owner <> page_id THEN owner END AS refers_to
FROM p LEFT JOIN o ON o.b = p.b"""

# a word lies in a repeat of at least n words where a window of n words over it is found twice,
# and the longest repeat is over a limit where a window one longer than it is found twice
_TWICE = "SELECT doc_id, unnest(spots) AS i FROM (SELECT doc_id, list(i) AS spots FROM (SELECT doc_id, i, array_to_string(ws[i:i + {0} - 1], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {0} + 2)) AS i FROM w WHERE len(ws) >= {0})) GROUP BY doc_id, k HAVING count(*) > 1)"
_COVERED = "SELECT doc_id, count(DISTINCT i + j) AS n FROM ({0}), (SELECT unnest(range({1})) AS j) GROUP BY doc_id"
_MIN, _LONG = repetition.MIN_REPEAT, repetition.MAX_LONGEST + 1
OP9 = f"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
r3 AS ({_COVERED.format(_TWICE.format(3), 3)}), rm AS ({_COVERED.format(_TWICE.format(_MIN), _MIN)}), rl AS (SELECT DISTINCT doc_id, true AS too_long FROM ({_TWICE.format(_LONG)})),
b AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  coalesce(l.n, 0)::BIGINT AS n_dup_lines, coalesce(r3.n, 0)::BIGINT AS n_repeat_words, coalesce(rm.n, 0) AS covered, coalesce(too_long, false) AS too_long
  FROM w LEFT JOIN l USING (doc_id) LEFT JOIN r3 USING (doc_id) LEFT JOIN rm USING (doc_id) LEFT JOIN rl USING (doc_id)),
v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > {repetition.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND 100 * covered <= {repetition.MAX_COVERED_PERCENT} * n_words AND NOT too_long AS kept FROM v"""


def _spans(rule: secret_scan.Rule, rank: int) -> tuple[str, str]:
    """A rule's matches in text t, by running sums over gaps and matches; and which of them don't count."""
    pattern = "'" + rule.pattern.replace("'", "''") + "'"
    m, gaps = f"regexp_extract_all(t, {pattern}, 0)", f"string_split_regex(t, {pattern})"
    size = "coalesce(list_sum(list_transform({0}, lambda x: length(x))), 0)::BIGINT"
    one = f"{{'s': {size.format('gaps[1:i]')} + {size.format('m[1:i - 1]')}, 'k': {rank}, 'kind': '{rule.name}', 'e': {size.format('gaps[1:i]')} + {size.format('m[1:i]')}, 'n': length(v[i])}}"
    return f"SELECT doc_id, unnest(list_transform(range(1, len(m) + 1), lambda i: {one})) AS x FROM (SELECT doc_id, {m} AS m, {gaps} AS gaps, regexp_extract_all(t, {pattern}, {rule.group}) AS v FROM d)", f"x.k = {rank} AND x.n < {rule.least}"


_FOUND = [_spans(rule, i) for i, rule in enumerate(secret_scan.RULES, 1)]
_LISTED = "string_agg(x.kind || ':' || x.s || ':' || x.e, ',' ORDER BY x.s, x.k)"
OP12 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS (SELECT * FROM ({" UNION ALL ".join(x for x, _ in _FOUND)}) WHERE NOT ({" OR ".join(x for _, x in _FOUND)})),
g AS (SELECT doc_id, {", ".join(f"count(*) FILTER (WHERE x.k = {i}) AS n{i}" for i in (1, 2, 3))}, {_LISTED} AS spans, {_LISTED} FILTER (WHERE x.k <= 3) AS base FROM f GROUP BY doc_id)
SELECT doc_id, coalesce(n1, 0) AS n_assign, coalesce(n2, 0) AS n_access, coalesce(n3, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (doc_id)"""

OP13 = f"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM d),
f AS (SELECT lang, p, count(*) AS f FROM (SELECT lang, unnest(flatten(list_transform(range(1, {phrases.MAX_WORDS} + 1), lambda k: list_transform(range(1, len(ws) - k + 2), lambda i: ws[i:i + k - 1])))) AS p FROM w) GROUP BY ALL),
c AS (SELECT lang, p, f AS a FROM f WHERE len(p) > 1 AND f >= {phrases.LEAST}),
s AS (SELECT c.*, k, l.f AS l, r.f AS r, ({phrases.SCALE}::HUGEINT * a * a // (l.f::HUGEINT * r.f))::BIGINT AS score FROM (SELECT *, unnest(range(1, len(p))) AS k FROM c) c JOIN f l ON l.lang = c.lang AND l.p = c.p[1:k] JOIN f r ON r.lang = c.lang AND r.p = c.p[k + 1:]),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, p ORDER BY score, k) AS o FROM s),
i AS (SELECT lang, p[i:i + m - 1] AS p, max(a) AS longer FROM (SELECT lang, p, a, m, unnest(range(1, len(p) - m + 2)) AS i FROM (SELECT *, unnest(range(2, len(p))) AS m FROM c)) GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE len(p) = 1 GROUP BY lang),
t AS (SELECT lang, array_to_string(p, ' ') AS phrase, a, l, r, score FROM b LEFT JOIN i USING (lang, p) WHERE o = 1 AND (longer IS NULL OR 100 * longer < {phrases.CONTAINED_PERCENT} * a))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM t JOIN n USING (lang) QUALIFY rank <= {phrases.LIMIT}"""

ORACLES = {"op1_ngram_jaccard": OP1, "op4_line_dedup": OP4, "op6_substring_dedup": OP6, "op8_warc": OP8, "op9_quality_rules": OP9, "op12_secret_scan": OP12, "op13_phrase_mining": OP13}
