"""DuckDB SQL that says what queries return, written from the contracts and not from the Spark plans."""

from __future__ import annotations

from . import license_join, mix, url_rules


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def merkle() -> str:
    nl = "chr(10)"
    piece = f"'[^.!?' || {nl} || ']{{1,48}}[.!?' || {nl} || ']{{0,64}}|[.!?' || {nl} || ']{{1,64}}'"
    parts = lambda t, ends: f"string_split(regexp_replace({t}, '({ends}+)', '\\1' || chr(1), 'g'), chr(1))"
    section, paragraph = f"' || {nl} || {nl} || '", f"' || {nl} || '"
    leaf = f"list_transform(regexp_extract_all(p, {piece}), lambda x: sha256(x))"
    tree = lambda t: f"list_transform({parts(t, section)}, lambda s: list_transform({parts('s', paragraph)}, lambda p: sha256(array_to_string({leaf}, ''))))"
    pieces = lambda t: f"regexp_extract_all({t}, {piece})"
    root = lambda t: f"sha256(array_to_string(list_transform({t}, lambda s: sha256(array_to_string(s, ''))), ''))"
    weight = lambda ps: f"coalesce(list_sum(list_transform({ps}, lambda p: length(p))), 0)"
    return f"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id) AS id, doc_id, coalesce(text, '') AS a, length(coalesce(text, '')) AS n FROM documents),
e AS (SELECT *, coalesce(lead(a) OVER (ORDER BY id), first_value(a) OVER (ORDER BY id)) AS b FROM d),
f AS (SELECT *, left(a, n - n // 2) || left(b, n // 2) AS c FROM e),
g AS (SELECT *, {tree("a")} AS t_a, {tree("b")} AS t_b, {tree("c")} AS t_c, {pieces("a")} AS p_a, {pieces("b")} AS p_b, {pieces("c")} AS p_c FROM f),
counts AS (SELECT id, kind, x, count(*) AS k FROM (SELECT id, 'a' AS kind, unnest(p_a) AS x FROM g UNION ALL SELECT id, 'b', unnest(p_b) FROM g UNION ALL SELECT id, 'c', unnest(p_c) FROM g) GROUP BY ALL),
common AS (SELECT l.id, r.kind, sum(length(l.x) * least(l.k, r.k)) AS m FROM counts l JOIN counts r ON l.id = r.id AND l.x = r.x AND l.kind = 'a' AND r.kind <> 'a' GROUP BY ALL),
h AS (SELECT g.*, coalesce(x.m, 0) AS m_b, coalesce(y.m, 0) AS m_c, len(list_filter(flatten(list_filter(t_c, lambda s: NOT list_contains(t_a, s))), lambda p: NOT list_contains(flatten(t_a), p))) AS changed
  FROM g LEFT JOIN common x ON x.id = g.id AND x.kind = 'b' LEFT JOIN common y ON y.id = g.id AND y.kind = 'c')
SELECT doc_id, n AS n_chars, sha256(c) AS edited_sha256, {root("t_a")} AS fingerprint, {root("t_c")} AS edited_fingerprint,
  (CASE WHEN a = c THEN 1 ELSE least(2 * m_c / greatest({weight("p_a")} + {weight("p_c")}, 1), 0.999999) END)::DOUBLE AS near_edited,
  (CASE WHEN a = b THEN 1 ELSE least(2 * m_b / greatest({weight("p_a")} + {weight("p_b")}, 1), 0.999999) END)::DOUBLE AS near_next, changed::INTEGER AS changed
FROM h"""


def url_filter() -> str:
    """Aliases by whole URLs in quoted attributes only, which is all that the tables can hold; tests have the others."""
    rules = ", ".join(f"({_quoted(v)}, {_quoted(h)}, {_quoted(p)})" for v, h, p in url_rules.RULES)
    rest = lambda u: f"substr({u}, strpos({u}, '://') + 3)"
    host = lambda u: f"CASE WHEN contains({u}, '://') THEN lower(regexp_extract({rest(u)}, '^[^/?#]*')) ELSE '' END"
    path = lambda u: f"CASE WHEN contains({u}, '://') THEN regexp_extract({rest(u)}, '^[^/?#]*([^?#]*)', 1) ELSE '' END"
    return f"""
WITH RECURSIVE rules(v, rh, rp) AS (VALUES {rules}),
links AS (SELECT url, unnest(regexp_extract_all(html, '<link rel="canonical" href="(https?://[^"]*)"', 1)) AS target FROM pages WHERE contains(url, '://')),
urls AS (SELECT DISTINCT u, {host("u")} AS h, {path("u")} AS p, split_part({rest("u")}, '#', 1) AS k FROM (SELECT url AS u FROM pages UNION SELECT target FROM links) WHERE contains(u, '://')),
fits AS (SELECT u, k, v, rh || rp AS rule, row_number() OVER (PARTITION BY u ORDER BY length(rh || rp) DESC, v DESC) AS r FROM urls, rules WHERE (h = rh OR ends_with(h, '.' || rh)) AND starts_with(p, rp)),
direct AS (SELECT * FROM fits WHERE r = 1),
edges AS (SELECT x.k AS a, y.k AS b FROM links JOIN urls x ON x.u = url JOIN urls y ON y.u = target),
reach(k) AS (SELECT k FROM direct WHERE v = 'block' UNION SELECT CASE WHEN a = reach.k THEN b ELSE a END FROM reach JOIN edges ON reach.k IN (a, b)),
j AS (SELECT page_id, coalesce({host("url")}, '') AS host, coalesce({path("url")}, '') AS path, d.rule, d.v, d.rule IS NULL AND q.k IN (FROM reach) AS alias
  FROM pages LEFT JOIN direct d ON d.u = url LEFT JOIN urls q ON q.u = url)
SELECT page_id, host, path, rule, CASE WHEN alias THEN 'block' ELSE coalesce(v, 'allow') END AS verdict, coalesce(alias, false) AS alias FROM j"""


def source_mix() -> str:
    w = ", ".join(map(str, mix.WEIGHTS))
    return f"""
WITH d AS (SELECT doc_id, source, text, coalesce(len(regexp_extract_all(text, '{mix.WORD}')), 0) AS size,
    coalesce(len(regexp_extract_all(text, '{mix.PUNCTUATION}')), 0) AS marks FROM documents),
k AS (SELECT *, -ln((('0x' || substr(md5(concat_ws('|', 'mix', doc_id::VARCHAR, md5(text))), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0)
    / CASE WHEN length(text) > 0 THEN greatest(0.1, 1 - 4 * (marks / length(text))) ELSE 0.1 END AS key FROM d),
s AS (SELECT source, sum(size)::BIGINT AS n, row_number() OVER (ORDER BY source NULLS LAST) AS r FROM d GROUP BY source),
c AS (SELECT source, n, 2.0 * n AS cap, [{w}][(r - 1) % 3 + 1]::DOUBLE AS w FROM s),
o AS (SELECT *, coalesce(sum(cap) OVER b, 0) AS full_caps, coalesce(sum(w) OVER b, 0) AS full_w FROM c WINDOW b AS (ORDER BY cap / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT max((1.5 * (SELECT sum(n) FROM c) - full_caps) / ((SELECT sum(w) FROM c) - full_w)) AS level FROM o
  WHERE (1.5 * (SELECT sum(n) FROM c) - full_caps) / ((SELECT sum(w) FROM c) - full_w) < cap / w),
g AS (SELECT source, n, least(cap, w * coalesce((SELECT level FROM t), 0)) AS target FROM c),
h AS (SELECT *, CASE WHEN n > 0 THEN floor(target / n) ELSE 0 END AS epochs FROM g),
p AS (SELECT k.*, n, target, epochs, sum(size) OVER (PARTITION BY k.source ORDER BY key ROWS UNBOUNDED PRECEDING) AS upto
  FROM k JOIN h ON k.source IS NOT DISTINCT FROM h.source)
SELECT doc_id, size::BIGINT AS size, n AS source_size, round(target, 6) AS target,
  (size * (epochs + (upto - size / 2 <= target - epochs * n AND target - epochs * n > 0)::INT))::BIGINT AS taken, source FROM p"""


def license_scan(threshold: float = 0.8) -> str:
    word = "'[0-9a-z\\x{80}-\\x{10FFFF}]+'"
    low = lambda t: f"translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    stands = lambda phrase: " AND ".join(f"ws[i + {k + 1}] = {_quoted(w)}" for k, w in enumerate(phrase.split()))
    places = " || ".join(f"list_transform(list_filter(range(0, len(ws)), lambda i: {stands(p)}), lambda i: {{'at': i, 'label': {_quoted(name)}}})" for p, name in license_join.PHRASES)
    rows = [(k, name, license_join.template_words(text), telling.split()) for k, (name, text, telling) in enumerate(license_join.TEMPLATES)]
    templates = ", ".join(f"({k}, {_quoted(name)}, {words}, {must}::VARCHAR[])" for k, name, words, must in rows)
    reach = max(len(text.split()) for _, text, _ in license_join.TEMPLATES)
    return f"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text FROM documents),
t(k, label, tw, must) AS (VALUES {templates}),
w AS (SELECT id, doc_id, regexp_extract_all({low("text")}, {word}) AS ws, text FROM d),
p AS (SELECT id, doc_id, len(ws) AS n, {places} AS places FROM w),
l0 AS (SELECT id, regexp_extract_all({low("line")}, {word}) AS lw, nr FROM (SELECT id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS nr FROM d)),
l AS (SELECT id, lw, row_number() OVER o AS i, sum(len(lw)) OVER o AS upto FROM l0 WHERE len(lw) > 0 WINDOW o AS (PARTITION BY id ORDER BY nr)),
win AS (SELECT a.id, a.i, max(b.i) AS last, list_distinct(flatten(list(b.lw))) AS bw FROM l a JOIN l b ON a.id = b.id AND (b.i = a.i OR (b.i > a.i AND b.upto - len(b.lw) - a.upto < {reach})) GROUP BY a.id, a.i),
m AS (SELECT id, i, last, label, list_intersect(tw, bw) AS hit, len(list_intersect(tw, bw)) / len(tw) AS c, len(tw) AS size FROM win JOIN t ON len(list_intersect(tw, bw)) >= ceil({threshold} * len(tw) - 1e-9) AND list_has_all(bw, must)),
s AS (SELECT * FROM m x WHERE NOT EXISTS (FROM m y WHERE y.id = x.id AND (y.c > x.c OR (y.c = x.c AND y.size > x.size)) AND x.i <= y.last AND y.i <= x.last AND list_has_all(y.hit, x.hit))),
f AS (SELECT id, list(DISTINCT label) AS found FROM s GROUP BY id), g AS (SELECT id, max(c) AS best FROM m GROUP BY id)
SELECT doc_id, n AS n_words, len(places)::BIGINT AS n_base, list_min(list_transform(places, lambda x: x.at)) AS first_word, list_max(list_transform(places, lambda x: x.at)) AS last_word,
  coalesce(array_to_string(list_sort(list_distinct(list_transform(places, lambda x: x.label))), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_transform(places, lambda x: x.label) || coalesce(found, []))), ','), '') AS labels,
  (CASE WHEN len(places) > 0 THEN 1 ELSE coalesce(best, 0) END)::DOUBLE AS score
FROM p LEFT JOIN f USING (id) LEFT JOIN g USING (id)"""


def oracle_sql() -> dict[str, str]:
    return {"op2_merkle_fingerprints": merkle(), "op4_url_filter": url_filter(), "op9_source_mix": source_mix(), "op10_license_scan": license_scan()}
