"""DuckDB SQL for the queries in front.py, as relations of blocks and lines: a role is a row that is picked, what it owns is
anti-joined from then on, and folds are recursive."""

from __future__ import annotations

from ..operators import checks, typography
from ..operators.blocks import FONT_ROLES, READING_ORDER
from ..operators.frontpage import SINGLE
from ..settings import Settings
from .front import CANDIDATES
from .oracles import _MEETS, BLOCKS, CLASSIFIED, NOISY, STACKED, _case, _dehyphenated, _iou, _paragraphs, titled

_SAID = (
    (1, "'N:o 87 / 1976' || chr(10) || text"), (2, "'TIISTAINA 13. PNÄ'"), (3, "'***'"), (4, "'1 mk (sis. lvv)' || chr(10) || text"), (5, "'Jatkuu takasivulle' || chr(10) || text"),
    (6, "'JO 39 KUOLONUHRIA' || chr(10) || 'TEHDASRÄJÄYKSESSÄ' || chr(10) || text"), (7, "'LAPUA ERISTETTIIN' || chr(10) || text"), (8, "'Kuvateksti: Murhe kasvol ' || text || ' uhrien raunioista'"),
    (9, "text || chr(10) || text || ' too'"), (10, "'ILTA-SANOMAT'"), (11, "'Kuva erikois'"),
)
_WHENS = " ".join(f"WHEN {k} THEN {v}" for k, v in _SAID)
#: The blocks that sources.pages.front_blocks makes.
FRONT = BLOCKS + f""",
f0 AS (SELECT page // 16 AS page, row_number() OVER (PARTITION BY page // 16 ORDER BY page, pos) AS pos, label, text, x1, y1, x2, y2 FROM blocks),
front AS (SELECT page, pos::INT AS pos, label, CASE WHEN pos % 13 = 12 THEN '' ELSE CASE pos % 17 {_WHENS} ELSE text || '. ' || text || chr(10) || reverse(text) END END AS text, x1, y1, x2, y2, 0.5 + (pos % 5) / 10 AS confidence,
  CASE WHEN pos % 5 <> 0 THEN (x1 * 3 + y1) % 40 END AS block_order FROM f0)"""
_TITLE = "(label = 'paragraph_title' OR (bw > 0.55 AND bh > 0.02))"


def typed(source: str, name: str) -> str:
    """Classified blocks, with their page's type and place in reading order."""
    return f""",
{name}_r AS (SELECT *, y1 / 1200.0 AS ry, (x1 + x2) / 2 / 1000.0 AS rx, (x2 - x1) / 1000.0 AS bw, (y2 - y1) / 1200.0 AS bh, lower(text) AS low FROM {source}),
{name}_t AS (SELECT *, CASE WHEN label = 'image' AND bw * bh > 0.04 THEN 'hero_image' WHEN label = 'image' THEN 'image_caption' WHEN contains(low, 'jatkuu') AND ry > 0.75 THEN 'continuation_box'
  WHEN ry < 0.08 AND bw > 0.5 AND bh < 0.035 THEN 'issue_meta' WHEN ry < 0.08 AND bw > 0.5 AND (contains(low, 'kuva') OR contains(low, 'sanomat')) THEN 'newspaper_name' WHEN ry < 0.08 AND bw > 0.5 THEN 'masthead_logo'
  WHEN {_TITLE} AND ry < 0.22 THEN 'main_headline' WHEN {_TITLE} AND ry < 0.35 THEN 'secondary_headline' WHEN {_TITLE} AND ry > 0.65 THEN 'bottom_headline'
  WHEN rx > 0.68 AND bw < 0.28 AND ry < 0.8 THEN 'right_sidebar' WHEN ry > 0.68 AND bw < 0.28 THEN 'bottom_columns' WHEN ry > 0.92 THEN 'footer_bar' ELSE 'body_text' END AS block_type FROM {name}_r),
{name}_p AS (SELECT page, 2 * bool_or(block_type IN ('main_headline', 'secondary_headline'))::INT + 2 * bool_or(block_type = 'hero_image')::INT + 2 * bool_or(block_type = 'right_sidebar')::INT + bool_or(block_type = 'bottom_columns')::INT + 1 >= 4 AS paper FROM {name}_t GROUP BY page),
{name} AS (SELECT t.*, row_number() OVER (PARTITION BY page ORDER BY CASE WHEN paper THEN {_case({t: i for i, t in enumerate(READING_ORDER)}, "block_type", "99")} ELSE 0 END,
  CASE WHEN paper AND block_type = 'bottom_columns' THEN x1 ELSE y1 END, CASE WHEN paper AND block_type = 'bottom_columns' THEN y1 ELSE x1 END, pos) - 1 AS ord FROM {name}_t t JOIN {name}_p USING (page))"""


_FIX = "replace(replace({}, 'kasvol', 'kasvoi'), 'KASVOL', 'KASVOI')"
_STRIPPED = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"


def _first(order: str, where: str, source: str, columns: str = "*") -> str:
    return f"(SELECT {columns} FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY {order}) AS first_of FROM {source} WHERE {where}) WHERE first_of = 1)"


def _free(step: int, alias: str = "b") -> str:
    return f"NOT EXISTS (FROM taken{step} k WHERE k.page = {alias}.page AND k.id = {alias}.id)"


def _left(step: int, alias: str = "l") -> str:
    return f"NOT EXISTS (FROM gone{step} g WHERE g.page = {alias}.page AND g.mark = {alias}.mark)"


#: Lines of a role's text, as marks.
def _marks(source: str) -> str:
    return f"SELECT page, unnest(list_transform(string_split(text, chr(10)), lambda s: upper(trim(regexp_replace(s, '\\s+', ' ', 'g'))))) AS mark FROM {source}"


_CAPTION = f"trim(regexp_replace(regexp_replace({_FIX.format('trim(text)')}, '^(?i)kuvateksti\\s*:?\\s*', ''), '^[A-Za-zÅÄÖåäö]+\\s+(Murhe\\b)', '\\1'))"
_KEYS = ("murhe", "uhrien", "raunioista", "tietojen mukaan", "kasvoi", "löytyessä")
_HITS = " + ".join(f"contains(lower(caption), '{k}')::INT" for k in _KEYS)
_MARKED = " OR ".join(f"contains(upper(caption), '{m}')" for m in ("KUOLONUHRIA", "TEHDASR", "LAPUA ERISTET", "JATKUU"))
_META = " OR ".join(f"contains(upper(caption), '{m}')" for m in ("MK (SIS", "N:O ", "PNÄ", "TIISTAINA HUHTIKUUN"))
_DAYS = " OR ".join(f"contains(upper(s), '{d}')" for d in ("TIISTAI", "KESKIVII", "TORSTAI", "PERJANTAI", "LAUANTAI", "SUNNUNTAI", "MAANANTAI", "PNÄ"))
_BEFORE = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"

MODEL = (
    FRONT
    + typed("front", "fb")
    + f""",
tb AS (SELECT page, pos AS id, ord, block_type, text, upper(trim(text)) AS up, x1, y1, x2, y2, confidence, (y1 + y2) / 2 / 1200 AS cy, (x1 + x2) / 2 / 1000 AS cx, {_CAPTION} AS caption FROM fb WHERE block_type <> 'hero_image' AND trim(text) <> ''),
b AS (SELECT *, length(caption) >= 25 AND NOT ({_MARKED} OR {_META}) AND ({_HITS} >= 2 OR (contains(lower(caption), 'murhe') AND contains(lower(caption), 'uhri'))) AS captionish,
  cy BETWEEN 0.17 AND 0.23 AND (y2 - y1) / 1200 <= 0.04 AND NOT ((x2 - x1) / 1000 > 0.85 AND length(text) > 120) AS strip FROM tb),
l0 AS (SELECT page, id, ord, block_type, y1, cy, cx, strip, trim(unnest(string_split(text, chr(10)))) AS s, generate_subscripts(string_split(text, chr(10)), 1) AS j FROM b),
l1 AS (SELECT *, upper({_BEFORE.format('s')}) AS mark, contains(upper(s), 'N:O') AS issue, {_DAYS} AS dated, regexp_matches(s, '^[*☆★ ]{{1,6}}$') AS stars, contains(upper(s), 'MK') AND (contains(upper(s), 'SIS.') OR contains(upper(s), 'LVV') OR contains(upper(s), 'ALV')) AS price FROM l0 WHERE s <> ''),
l AS (SELECT *, issue OR dated OR stars OR price AS metadata, price AND cy <= 0.38 AND (cx > 0.55 OR cy <= 0.23 OR length(s) < 30) AS priced, row_number() OVER (PARTITION BY page, id ORDER BY j) AS nr FROM l1),
pages AS (SELECT DISTINCT page FROM b),
firsts AS (SELECT page, id, s AS line FROM l WHERE nr = 1),
bf AS (SELECT b.*, line FROM b JOIN firsts USING (page, id)),
mast AS {_first("ord DESC", "y1 / 1200 <= 0.17 AND (block_type = 'masthead_logo' OR (block_type <> 'newspaper_name' AND NOT contains(up, 'SANOMAT') AND contains(up, 'KUVA') AND contains(up, 'ERIKOIS')))", "bf")},
nam AS {_first("ord DESC", "y1 / 1200 <= 0.17 AND block_type <> 'masthead_logo' AND (block_type = 'newspaper_name' OR contains(up, 'SANOMAT'))", "bf")},
named AS (SELECT n.*, m.page IS NULL AND contains(upper(n.line), 'KUVA') AND contains(upper(n.line), 'ERIKOIS') AS as_label FROM nam n LEFT JOIN mast m USING (page)),
r_masthead AS (SELECT p.page, coalesce({_FIX.format('m.line')}, 'KUVA ERIKOIS') AS text, coalesce(m.id, CASE WHEN n.as_label THEN n.id END) AS id, coalesce(m.confidence, CASE WHEN n.as_label THEN n.confidence END, 0.85) AS confidence FROM pages p LEFT JOIN mast m USING (page) LEFT JOIN named n USING (page)),
r_newspaper_name AS (SELECT p.page, coalesce({_FIX.format('n.line')}, 'ILTA-SANOMAT') AS text, n.id, coalesce(n.confidence, 0.85) AS confidence FROM pages p LEFT JOIN (FROM named WHERE NOT as_label) n USING (page)),
taken1 AS (SELECT page, id FROM r_masthead WHERE id IS NOT NULL UNION ALL SELECT page, id FROM r_newspaper_name WHERE id IS NOT NULL),
gone1 AS ({_marks("r_masthead")} UNION ALL {_marks("r_newspaper_name")}),
ml AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY y1, ord, j) AS rn FROM l WHERE (strip OR block_type = 'issue_meta') AND {_free(1, "l")}),
m1 AS (SELECT page, min(rn) FILTER (issue) AS a FROM ml GROUP BY page), m2 AS (SELECT ml.page, any_value(a) AS a, min(rn) FILTER (dated AND rn IS DISTINCT FROM a) AS d FROM ml JOIN m1 USING (page) GROUP BY ml.page),
m3 AS (SELECT ml.page, any_value(a) AS a, any_value(d) AS d, min(rn) FILTER (stars AND rn IS DISTINCT FROM a AND rn IS DISTINCT FROM d) AS t FROM ml JOIN m2 USING (page) GROUP BY ml.page),
m4 AS (SELECT ml.page, any_value(a) AS a, any_value(d) AS d, any_value(t) AS t, min(rn) FILTER (priced AND rn IS DISTINCT FROM a AND rn IS DISTINCT FROM d AND rn IS DISTINCT FROM t) AS e FROM ml JOIN m3 USING (page) GROUP BY ml.page),
picked AS (SELECT ml.*, CASE rn WHEN a THEN 'issue_meta' WHEN d THEN 'date_meta' WHEN t THEN 'stars_meta' WHEN e THEN 'price_meta' END AS role FROM ml JOIN m4 USING (page) WHERE rn IN (a, d, t, e)),
gone2 AS (FROM gone1 UNION ALL SELECT page, CASE WHEN role = 'stars_meta' AND regexp_matches(s, '[☆★]') THEN '***' ELSE mark END FROM picked),
taken2 AS (FROM taken1 UNION ALL SELECT DISTINCT p.page, p.id FROM picked p WHERE p.block_type = 'issue_meta' OR NOT EXISTS (FROM l WHERE l.page = p.page AND l.id = p.id AND NOT l.metadata AND {_left(2)})),
orphans AS (SELECT * FROM l WHERE {_free(2, "l")} AND {_left(2)}),
picked2 AS (SELECT *, 'price_meta' AS role FROM {_first("ord, j", "priced AND NOT EXISTS (FROM picked p WHERE p.page = o.page AND p.role = 'price_meta')", "orphans o")} UNION ALL
  SELECT *, 'stars_meta' FROM {_first("ord, j", "stars AND strip AND NOT EXISTS (FROM picked p WHERE p.page = o.page AND p.role = 'stars_meta')", "orphans o")}),
metas AS (SELECT page, id, s, role FROM picked UNION ALL SELECT page, id, s, role FROM picked2),
"""
    + "".join(
        f"""r_{r} AS (SELECT p.page, coalesce({"CASE WHEN regexp_matches(m.s, '[☆★]') THEN '***' ELSE m.s END" if r == "stars_meta" else _FIX.format("m.s")}, '{d}') AS text, m.id, coalesce(b.confidence, 0.85) AS confidence FROM pages p LEFT JOIN (FROM metas WHERE role = '{r}') m USING (page) LEFT JOIN b ON b.page = m.page AND b.id = m.id),
"""
        for r, d in (("issue_meta", "N:o 87 — 1976"), ("date_meta", "TIISTAINA HUHTIKUUN 13. PNÄ"), ("stars_meta", "***"), ("price_meta", "1 mk (sis. lvv)"))
    )
    + f"""gone3 AS (FROM gone2 {" ".join(f"UNION ALL {_marks(f'r_{r}')}" for r in ("issue_meta", "date_meta", "stars_meta", "price_meta"))}),
hb AS (SELECT b.*, line, l2.s AS second FROM bf b LEFT JOIN (SELECT page, id, s FROM l WHERE nr = 2) l2 USING (page, id) WHERE cy <= 0.38 AND {_free(2)}),
hm AS {_first("ord DESC", "block_type = 'main_headline'", "hb")}, hs AS {_first("ord DESC", "block_type = 'secondary_headline'", "hb")},
fl AS (SELECT * FROM l WHERE {_free(2, "l")}),
fm AS {_first("ord, j", "contains(upper(s), 'KUOLONUHRIA') AND length(s) < 45", "fl")}, fs AS {_first("ord, j", "contains(upper(s), 'TEHDASR') AND contains(upper(s), 'YKSESS') AND length(s) < 45", "fl")},
hh AS (SELECT p.page, coalesce(hm.id, fm.id) AS mid, coalesce(hm.line, fm.s, 'JO 39 KUOLONUHRIA') AS mt, coalesce(hs.id, CASE WHEN hm.second IS NULL THEN fs.id END) AS sid, coalesce(hs.line, hm.second, fs.s, 'TEHDASRÄJÄYKSESSÄ') AS st
  FROM pages p LEFT JOIN hm USING (page) LEFT JOIN hs USING (page) LEFT JOIN fm USING (page) LEFT JOIN fs USING (page)),
r_main_headline AS (SELECT hh.page, {_FIX.format('mt')} AS text, mid AS id, coalesce(b.confidence, 0.85) AS confidence FROM hh LEFT JOIN b ON b.page = hh.page AND b.id = mid),
r_secondary_headline AS (SELECT hh.page, {_FIX.format('st')} AS text, sid AS id, CASE WHEN sid = mid THEN 0.85 ELSE coalesce(b.confidence, 0.85) END AS confidence FROM hh LEFT JOIN b ON b.page = hh.page AND b.id = sid),
taken3 AS (FROM taken2 UNION ALL SELECT page, mid FROM hh WHERE mid IS NOT NULL UNION ALL SELECT page, sid FROM hh WHERE sid IS NOT NULL),
gone4 AS (FROM gone3 UNION ALL {_marks("r_main_headline")} UNION ALL {_marks("r_secondary_headline")}),
hero AS {_first("(x2 - x1) * (y2 - y1) DESC, ord", "block_type = 'hero_image'", "fb", "page, x1 AS hx1, y1 AS hy1, x2 AS hx2, y2 AS hy2")},
bh AS (SELECT b.*, hx1, hx2, hy2, CASE WHEN hy2 IS NULL THEN cy BETWEEN 0.45 AND 0.72 ELSE y1 >= hy2 - 36 END AS under FROM b LEFT JOIN hero USING (page)),
c0 AS (SELECT *, 0 AS kind FROM bh WHERE block_type = 'image_caption' OR (captionish AND under) UNION ALL
  SELECT *, 1 FROM bh WHERE hy2 IS NOT NULL AND captionish AND y1 BETWEEN hy2 + 6 AND hy2 + 144 AND x2 >= hx1 - 20 AND x2 - x1 <= 1.25 * (hx2 - hx1)),
c1 AS (SELECT *, CASE WHEN hy2 IS NULL THEN 0 ELSE CASE WHEN y1 >= hy2 - 24 THEN 3.0 ELSE 0 END + CASE WHEN hx2 > hx1 AND (x2 - x1) / (hx2 - hx1) BETWEEN 0.45 AND 1.6 THEN 2 ELSE 0 END - CASE WHEN cy > 0.62 THEN 5 ELSE 0 END + CASE WHEN (y2 - y1) / 1200 < 0.05 THEN 2 ELSE 0 END END
  + 2.0 * ({_HITS}) - CASE WHEN {_MARKED} THEN 5 ELSE 0 END - CASE WHEN {_META} THEN 5 ELSE 0 END - CASE WHEN length(caption) > 220 THEN 2 ELSE 0 END AS score, row_number() OVER (PARTITION BY page ORDER BY kind, ord) AS k FROM c0 WHERE caption <> ''),
c2 AS (SELECT page, k, {{'score': score::DOUBLE, 'norm': lower(regexp_replace(caption, '\\s+', ' ', 'g')), 'text': caption}} AS c FROM c1),
c3 AS (SELECT page, 1 AS k, [c] AS kept FROM c2 WHERE k = 1 UNION ALL
  SELECT n.page, n.k, CASE WHEN len(list_filter(kept, lambda e: contains(e.norm[:80], c.norm[:40]) OR contains(c.norm[:80], e.norm[:40]))) = 0 THEN list_append(kept, c)
    ELSE list_transform(kept, lambda e, i: CASE WHEN i = list_position(list_transform(kept, lambda x: x.norm[:30]), c.norm[:30]) AND c.score > e.score THEN c ELSE e END) END FROM c3 JOIN c2 n ON n.page = c3.page AND n.k = c3.k + 1),
captions AS (SELECT page, arg_max(kept, k) AS kept FROM c3 GROUP BY page),
kept_one AS (SELECT page, unnest(kept) AS c, generate_subscripts(kept, 1) AS i FROM captions),
best AS (SELECT page, c.text AS text FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY c.score DESC, i) AS k FROM kept_one) WHERE k = 1 AND c.score >= 1.0),
cm AS {_first("ord", "q.caption[:30] = q.best[:30]", f"(SELECT b.*, t.text AS best FROM b JOIN best t USING (page) WHERE {_free(3)}) q")},
ct AS {_first("ord", f"block_type = 'image_caption' AND caption <> '' AND NOT EXISTS (FROM best t WHERE t.page = b.page) AND {_free(3)}", "b")},
r_image_caption AS (SELECT t.page, t.text, cm.id, coalesce(cm.confidence, 0.85) AS confidence FROM best t LEFT JOIN cm USING (page) UNION ALL SELECT page, caption, id, confidence FROM ct),
taken4 AS (FROM taken3 UNION ALL SELECT page, id FROM r_image_caption WHERE id IS NOT NULL),
gone5 AS (FROM gone4 UNION ALL {_marks("r_image_caption")}),
lt AS {_first("ord", f"block_type = 'bottom_headline' AND ((contains(upper(line), 'LAPUA') AND contains(upper(line), 'ERISTET')) OR (length(line) <= 55 AND NOT line LIKE '%.' AND contains(upper(line), 'LAPUA'))) AND {_free(4, 'bf')}", "bf")},
ll AS {_first("ord, j", f"cy >= 0.65 AND contains(upper(s), 'LAPUA') AND contains(upper(s), 'ERISTET') AND length(s) < 50 AND {_free(4, 'l')}", "l")},
r_lower_headline AS (SELECT p.page, coalesce({_FIX.format('lt.line')}, {_FIX.format('ll.s')}, 'LAPUA ERISTETTIIN') AS text, coalesce(lt.id, ll.id) AS id, coalesce(b.confidence, 0.85) AS confidence FROM pages p LEFT JOIN lt USING (page) LEFT JOIN ll USING (page) LEFT JOIN b ON b.page = p.page AND b.id = coalesce(lt.id, ll.id)),
taken5 AS (FROM taken4 UNION ALL SELECT page, id FROM r_lower_headline WHERE id IS NOT NULL),
gone6 AS (FROM gone5 UNION ALL {_marks("r_lower_headline")}),
sl AS (SELECT page, id, list({{'s': s, 'mark': mark}} ORDER BY j) AS ls FROM l WHERE NOT metadata AND {_left(6)} GROUP BY page, id),
s0 AS (SELECT b.*, coalesce(ls, []) AS ls FROM b LEFT JOIN sl USING (page, id) WHERE {_free(5)}),
s1 AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY y1, ord) AS k FROM s0 WHERE block_type = 'right_sidebar' OR (cx > 0.62 AND cy < 0.72 AND cy > 0.38)),
s2 AS (SELECT page, 0 AS k, []::VARCHAR[] AS seen, NULL::VARCHAR AS text, NULL::INT AS id, NULL::DOUBLE AS confidence FROM pages UNION ALL
  SELECT page, k, CASE WHEN good THEN seen || list_transform(string_split(said, chr(10)), lambda s: upper({_BEFORE.format('s')})) ELSE seen END, CASE WHEN good THEN said END, id, confidence FROM (
    SELECT *, length(said) >= 40 AND NOT (contains(upper(said), 'KUOLONUHRIA') OR contains(upper(said), 'TEHDASR') OR contains(upper(said), 'LAPUA ERISTET') OR contains(upper(said), 'JATKUU') OR contains(upper(said), 'LATAAMORAKENNU')) AND cy <= 0.68 AS good FROM (
      SELECT n.page, n.k, seen, n.id, n.cy, n.confidence, {_FIX.format("coalesce(array_to_string(list_transform(list_filter(n.ls, lambda x: NOT list_contains(seen, x.mark)), lambda x: x.s), chr(10)), '')")} AS said FROM s2 JOIN s1 n ON n.page = s2.page AND n.k = s2.k + 1))),
r_right_sidebar AS (SELECT page, text, id, confidence, row_number() OVER (PARTITION BY page ORDER BY k) - 1 AS n FROM s2 WHERE text IS NOT NULL),
taken6 AS (FROM taken5 UNION ALL SELECT page, id FROM r_right_sidebar),
gone7 AS (FROM gone6 UNION ALL {_marks("r_right_sidebar")}),
kl AS (SELECT page, id, list({{'s': s, 'mark': mark}} ORDER BY j) AS ls FROM l WHERE NOT metadata AND {_left(7)} GROUP BY page, id),
k0 AS (SELECT b.*, ls FROM b LEFT JOIN kl USING (page, id) WHERE {_free(6)}),
k1 AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY x1, ord) AS k, count(*) OVER (PARTITION BY page) AS many FROM k0 WHERE block_type = 'bottom_columns'),
k2 AS (SELECT page, 0 AS k, []::VARCHAR[] AS seen, NULL::VARCHAR AS text, NULL::INT AS id, NULL::DOUBLE AS confidence FROM pages UNION ALL
  SELECT page, k, CASE WHEN said <> '' THEN seen || list_transform(string_split(said, chr(10)), lambda s: upper({_BEFORE.format('s')})) ELSE seen END, CASE WHEN said <> '' THEN said END, id, confidence FROM (
    SELECT n.page, n.k, seen, n.id, n.confidence, {_FIX.format("coalesce(array_to_string(list_transform(list_filter(coalesce(n.ls, []), lambda x: NOT list_contains(seen, x.mark)), lambda x: x.s), chr(10)), '')")} AS said FROM k2 JOIN k1 n ON n.page = k2.page AND n.k = k2.k + 1 WHERE n.many >= 2)),
k3 AS (SELECT page, id, ord, array_to_string(list_transform(ls, lambda x: x.s), chr(10)) AS said, row_number() OVER (PARTITION BY page ORDER BY ord) - 1 AS i FROM k0 WHERE block_type = 'body_text' AND cy >= 0.68 AND len(coalesce(ls, [])) > 0 AND NOT EXISTS (FROM k1 WHERE k1.page = k0.page AND k1.many >= 2)),
r_bottom_column AS (SELECT page, text, id, confidence, row_number() OVER (PARTITION BY page ORDER BY k) - 1 AS n FROM k2 WHERE text IS NOT NULL UNION ALL
  SELECT page, {_FIX.format("string_agg(said, chr(10) || chr(10) ORDER BY i)")}, NULL, 0.85, i % 5 FROM k3 GROUP BY page, i % 5),
taken7 AS (FROM taken6 UNION ALL SELECT page, id FROM r_bottom_column WHERE id IS NOT NULL UNION ALL SELECT page, id FROM k3),
jb AS {_first("ord", f"contains(upper(line), 'JATKUU') AND {_free(7, 'bf')}", "bf")},
r_continuation_box AS (SELECT p.page, coalesce({_FIX.format('upper(jb.line)')}, 'JATKUU TAKASIVULLE') AS text, jb.id, coalesce(jb.confidence, 0.85) AS confidence FROM pages p LEFT JOIN jb USING (page)),
taken8 AS (SELECT DISTINCT page, id FROM (FROM taken7 UNION ALL SELECT page, id FROM r_continuation_box WHERE id IS NOT NULL)),
roles AS ({" UNION ALL ".join(f"SELECT page, '{r}' AS role, 0 AS n, text, id, confidence FROM r_{r}" for r in SINGLE)} UNION ALL SELECT page, 'right_sidebar', n, text, id, confidence FROM r_right_sidebar UNION ALL SELECT page, 'bottom_column', n, text, id, confidence FROM r_bottom_column),
seen AS (SELECT page, bool_or(cx >= 0.62 AND cy BETWEEN 0.34 AND 0.78 AND (starts_with(up, 'JO 39') OR contains(up, 'LÖYDETTY KUOLE') OR (block_type = 'right_sidebar' AND length(text) >= 40))) AS sidebar_seen FROM b GROUP BY page),
model AS (SELECT p.page, {", ".join(f"max(text) FILTER (role = '{r}') AS {r}" for r in SINGLE)}, coalesce(string_agg(text, chr(10) || chr(10) ORDER BY n) FILTER (role = 'right_sidebar'), '') AS sidebar, coalesce(list(text ORDER BY n) FILTER (role = 'bottom_column'), []) AS cols,
  any_value(sidebar_seen) AS sidebar_seen, any_value(coalesce(len(kept), 0)) AS many FROM pages p JOIN roles USING (page) JOIN seen USING (page) LEFT JOIN captions USING (page) GROUP BY p.page)"""
)


_COMPACT = typography.zones(Settings())
_TALL = {z: (b - a) * 714.0 for z, (a, b) in _COMPACT.items()}
_WIDE = 595.0 - 2 * 595.0 * Settings().structural_margin_ratio


def _fit(text: str, width: float, height: float, start: float, least: float, factor: float) -> str:
    """The first size from start down, by halves, that fits."""
    ok = f"{start!r} - k * 0.5 >= {least!r} AND length({text}) <= greatest(1, floor({width!r} / (({start!r} - k * 0.5) * {factor!r}))) AND ({start!r} - k * 0.5) * 1.15 <= {height!r}"
    return f"CASE WHEN trim({text}) = '' THEN {start!r} ELSE coalesce({start!r} - list_filter(range(0, 200), lambda k: {ok})[1] * 0.5, {least!r}) END"


SIZED = MODEL + f""",
sz0 AS (SELECT *, {_fit("upper(masthead)", _WIDE, _TALL["masthead"] * 0.38, min(24.0, _TALL["masthead"] * 0.34), 14.0, 0.48)} AS z_label, {_fit("newspaper_name", _WIDE * 0.98, _TALL["masthead"] * 0.58, min(56.0, _TALL["masthead"] * 0.50), 30.0, 0.46)} AS z_name0,
  {_fit("upper(main_headline)", _WIDE, _TALL["headline"] * 0.55, min(42.0, _TALL["headline"] * 0.42), 18.0, 0.52)} AS z_main, {_fit("upper(secondary_headline)", _WIDE, _TALL["headline"] * 0.40, min(34.0, _TALL["headline"] * 0.34), 14.0, 0.52)} AS z_second,
  {_fit("lower_headline", _WIDE, _TALL["lower"] * 0.7, min(28.0, _TALL["lower"] * 0.55), 14.0, 0.55)} AS z_lower FROM model),
sz1 AS (SELECT *, CASE WHEN z_name0 > 30 THEN z_name0 - 0.5 * list_filter(range(0, 200), lambda k: z_name0 - k * 0.5 <= 30 OR z_label * 1.15 + (z_name0 - k * 0.5) * 1.12 <= {_TALL["masthead"] * 0.90!r})[1] ELSE z_name0 END AS z_name FROM sz0),
sized AS (SELECT * EXCLUDE (z_label), CASE WHEN z_label > 14 THEN z_label - 0.5 * list_filter(range(0, 200), lambda k: z_label - k * 0.5 <= 14 OR (z_label - k * 0.5) * 1.15 + z_name * 1.12 <= {_TALL["masthead"] * 0.90!r})[1] ELSE z_label END AS z_label FROM sz1)"""
#: Roles' sizes in sized, and constants.
_SIZES = {"masthead_label": "z_label", "newspaper_name": "z_name", "main_headline": "z_main", "secondary_headline": "z_second", "lower_headline": "z_lower", "issue_meta": "6.0", "hero_sidebar_body": "7.0", "image_caption": "5.5", "bottom_column_body": "5.5", "continuation_box": "8.5"}
_NL = "chr(10)"
OUT = SIZED + f""",
out0 AS (SELECT *, coalesce(image_caption, '') AS caption, concat_ws({_NL}, '**' || masthead || ' — ' || newspaper_name || '**' || {_NL}, issue_meta, date_meta, {_NL} || '---' || {_NL}, price_meta, {_NL} || '# ' || main_headline || {_NL}, '## ' || secondary_headline, CASE WHEN sidebar <> '' THEN {_NL} || sidebar END,
  CASE WHEN image_caption <> '' THEN {_NL} || '*Kuvateksti: ' || image_caption || '*' END, {_NL} || '## ' || lower_headline, CASE WHEN len(cols) > 0 THEN array_to_string(list_transform(cols, lambda t: {_NL} || t), {_NL}) END, {_NL} || '**' || continuation_box || '**') AS markdown,
  CASE WHEN contains(upper(secondary_headline), 'TEHDASR') THEN sidebar ELSE '' END AS body,
  concat_ws({_NL}, upper(masthead), newspaper_name, issue_meta || '   ' || date_meta || '   ' || stars_meta || '   ' || price_meta, upper(main_headline), upper(secondary_headline), CASE WHEN sidebar <> '' THEN sidebar END, image_caption, lower_headline, CASE WHEN len(cols) > 0 THEN array_to_string(cols, {_NL}) END, upper(continuation_box)) AS pdf_text FROM sized),
out AS (SELECT *, (z_name < 38 OR z_label < 16) AS unlike, concat_ws(',', CASE WHEN sidebar_seen AND sidebar = '' THEN 'main_story.sidebar_text' END, CASE WHEN many > 0 AND image_caption IS NULL THEN 'main_story.caption' END) AS missing,
  sidebar = '' OR contains(upper(pdf_text), upper(sidebar[:24])) OR contains(upper(pdf_text), 'JO 39') AS sidebar_shown, CASE WHEN caption <> '' THEN contains(upper(pdf_text), 'MURHE') OR contains(upper(pdf_text), 'UHRIEN') OR contains(lower(pdf_text), lower(caption[:20])) ELSE many = 0 END AS caption_shown FROM out0)"""


def _phrase(p: str) -> str:
    return f"(contains(upper(markdown), '{p}') OR contains(upper(markdown), '{p.replace('Ä', 'A')}'))"


_CHECKS = [
    ("price_meta_exists", "contains(upper(price_meta), 'MK')", None), ("price_occurrences_in_markdown", "(length(upper(markdown)) - length(replace(upper(markdown), '1 MK', ''))) = 4", None), ("price_occurrences_in_sidebar", "NOT contains(upper(sidebar), '1 MK') AND NOT contains(upper(sidebar)[:40], '(SIS.')", None),
    ("stars_occurrences_in_body", "NOT contains(body, '***') AND NOT contains(body, '☆')", None), ("issue_number_occurrences_in_body", "NOT contains(replace(upper(body), ' ', ''), 'N:O')", None), ("date_occurrences_in_body", "NOT contains(upper(body), 'PNÄ') AND NOT contains(upper(body), 'HUHTIKUUN')", None),
    ("metadata_blocks_consumed_before_story", "true", None), ("no_consumed_block_reused", "true", None), ("price_text_in_page_model", "contains(upper(price_meta), '1 MK')", None), ("sidebar_does_not_start_with_price", "NOT starts_with(upper(sidebar[:20]), '1 MK') AND NOT contains(upper(sidebar[:20]), 'SIS.')", None),
    *[("markdown_contains_" + p.replace(" ", "_").lower(), _phrase(p), None) for p in ("JO 39 KUOLONUHRIA", "TEHDASRÄJÄYKSESSÄ", "LAPUA ERISTETTIIN")],
    ("text_cleanup_pass", "NOT regexp_matches(markdown || chr(10) || pdf_text, '(?im)1\\s*mk\\s*\\([^)]*$')", None),
    ("main_story_sidebar_in_page_model", "sidebar <> '' OR NOT sidebar_seen", None), ("main_story_sidebar_rendered_in_pdf", "sidebar_shown", None), ("image_caption_selected_when_candidates_exist", "many = 0 OR caption <> ''", None), ("image_caption_rendered_in_pdf", "caption = '' OR caption_shown", None),
    ("markdown_contains_image_caption", "caption = '' OR (contains(lower(markdown), 'kuvateksti:') AND contains(lower(markdown), lower(caption[:15])))", None), ("caption_contains_murhe", "contains(lower(caption), 'murhe')", "caption <> ''"), ("sidebar_not_truncated_at_vapaaehtoiset", "NOT ends_with(sidebar, 'vapaaehtoiset')", "sidebar <> ''"),
    ("content_loss_detected", "NOT (missing <> '' OR (sidebar_seen AND sidebar = '') OR NOT sidebar_shown OR (many > 0 AND caption = '') OR (caption <> '' AND NOT caption_shown))", None),
    ("style_debug_exists", "true", None), ("main_headline_font_size_gt_3x_body", "z_main > 21", None), ("lower_headline_font_size_gt_2x_body", "z_lower > 14", None), ("caption_font_size_lte_body", "true", None), ("bottom_column_font_size_gte_minimum", "true", None), ("masthead_not_plain_body_font", "true", None),
    ("image_caption_exists_when_vl_found", "caption <> ''", "image_caption IS NOT NULL"), ("typography_main_headline_font_size_below_3x_body_warning", "false", "z_main < 21"), ("typography_lower_headline_font_size_below_2x_body_warning", "false", "z_lower < 14"), ("typography_masthead_similarity_below_target_warning", "false", "unlike"),
]
GATE = OUT + ",\ngate AS (" + " UNION ALL ".join(f"SELECT page, '{n}' AS name, {e} AS passed FROM out" + (f" WHERE {w}" if w else "") for n, e, w in _CHECKS) + ")"
_SEGMENTS = {
    "masthead": "masthead || chr(10) || newspaper_name", "meta": "concat_ws(chr(10), issue_meta, date_meta, price_meta)", "main_headline": "main_headline", "secondary_headline": "secondary_headline", "main_story_sidebar": "sidebar",
    "image_caption": "coalesce(image_caption, '')", "lower_headline": "lower_headline", "continuation": "continuation_box",
}
#: The audit's phrases as they stand after corrections.
_WANTED = {"masthead": ("kuva erikois", "ilta-sanomat"), "meta": ("n:o 87", "tiistaina", "1 mk"), "main_headline": ("jo 39 kuolonuhria",), "secondary_headline": ("tehdasrajayksessa",), "image_caption": ("murhe kasvoi",), "lower_headline": ("lapua eristet",), "continuation": ("jatkuu takasivulle",)}
_SHOWN = {"meta": ("N:o 87", "Tiistaina", "1 mk"), "masthead": ("KUVA ERIKOIS", "ILTA-SANOMAT"), "main_headline": ("JO 39 KUOLONUHRIA",), "secondary_headline": ("TEHDASRAJAYKSESSA",), "image_caption": ("murhe KASVOL",), "lower_headline": ("LAPUA ERISTET",), "continuation": ("JATKUU TAKASIVULLE",)}


def _has(text: str, phrase: str) -> str:
    low = f"lower(regexp_replace({text}, '\\s+', ' ', 'g'))"
    return f"(contains({low}, '{phrase}') OR contains(translate({low}, 'äö', 'ao'), '{phrase}'))"


def _audited(name: str) -> str:
    lost = ", ".join(f"CASE WHEN NOT {_has(_SEGMENTS[name], p)} THEN '{s}' END" for p, s in zip(_WANTED[name], _SHOWN[name], strict=True))
    good = " AND ".join(_has(t, p) for p in _WANTED[name] for t in (_SEGMENTS[name], "markdown", "pdf_text"))
    return f"'{name}:' || CASE WHEN {good} THEN 'PASS' ELSE 'FAIL' END || ':' || concat_ws('|', {lost})"


_LOSS = " AND ".join(_has(t, p) for name in _WANTED for p in _WANTED[name] for t in (_SEGMENTS[name], "markdown", "pdf_text"))
_TIMES = "(length({0}) - length(replace({0}, '{1}', ''))) / length('{1}') > 1"
_SPRING = "(regexp_matches(markdown, '(?i)\\bspring\\b') OR regexp_matches(pdf_text, '(?i)\\bspring\\b'))"
_SEG_ROWS = ", ".join(f"{{'id': '{n}', 't': {t}}}" for n, t in list(_SEGMENTS.items())[:7])
AUDITED = GATE + f""",
aud0 AS (SELECT *, concat_ws(',', {", ".join(_audited(n) for n in _WANTED)}) AS segments, NOT ({_LOSS}) AS content_loss, concat_ws(',', CASE WHEN {_SPRING} THEN 'spring' END, CASE WHEN contains(lower(markdown), 'blue ste') OR contains(lower(pdf_text), 'blue ste') THEN 'blue ste' END) AS forbidden_found,
  concat_ws(',', CASE WHEN {_TIMES.format("upper(body)", "LUOVUTTAAKSEEN VERTAAN")} THEN 'luovuttaakseen vertaan' END, CASE WHEN {_TIMES.format("upper(markdown)", "LAPUA ERISTET")} THEN 'LAPUA ERISTET' END{{extra}}) AS duplicates,
  array_to_string(list_transform(list_filter([{_SEG_ROWS}] || list_transform(cols, lambda c, i: {{{{'id': 'lower_story_column_' || (i - 1), 't': c}}}}) || [{{{{'id': 'continuation', 't': continuation_box}}}}], lambda s: regexp_matches(s.t, '(?i)\\balmond\\b')), lambda s: s.id), ',') AS truncated_segments,
  concat_ws(',', CASE WHEN contains(upper(sidebar), upper(lower_headline)) THEN 'lower_headline_in_sidebar' END, CASE WHEN contains(upper(sidebar), 'LATAAMORAKENNU') THEN 'lower_story_in_sidebar' END, CASE WHEN contains(upper(sidebar), 'LAPUA ERISTET') THEN 'lower_headline_leak_in_sidebar' END,
    CASE WHEN caption <> '' AND contains(sidebar, caption[:30]) THEN 'caption_in_sidebar' END, CASE WHEN len(list_filter(cols, lambda c: contains({_BEFORE.format("upper(sidebar)")}, {_BEFORE.format("upper(c[:80])")}))) > 0 THEN array_to_string(list_transform(list_filter(cols, lambda c: contains({_BEFORE.format("upper(sidebar)")}, {_BEFORE.format("upper(c[:80])")})), lambda c: 'duplicate_sidebar_lower_column'), ',') END) AS misassigned FROM out),
aud AS (SELECT *, CASE WHEN content_loss OR forbidden_found <> '' OR duplicates <> '' OR truncated_segments <> '' OR misassigned <> '' THEN 'FAIL' ELSE 'PASS' END AS content_quality FROM aud0)""".replace("{{", "{").replace("}}", "}")
_SOFT = ", ".join(f"'{n}'" for n in checks.SOFT)
_KUOLON = ", CASE WHEN " + _TIMES.format("upper(markdown)", "KUOLONUHRIA") + " THEN 'KUOLONUHRIA' END"
#: The zones' and their stack's SQL over the front blocks.
FRONT_STACKED = FRONT + typed("front", "fb") + ",\ntyped AS (FROM fb)" + STACKED[len(CLASSIFIED) :].replace("FROM blocks)", "FROM typed)")
_GAPS = """g AS (SELECT page, max(y) FILTER (zone = 'hero') AS ph, max(y + h) FILTER (zone = 'hero') AS bh, max(y + h) FILTER (zone = 'headline') AS be, max(y) FILTER (zone = 'caption') AS pc, max(y + h) FILTER (zone = 'caption') AS bc,
  max(y) FILTER (zone = 'lower') AS pl, max(y + h) FILTER (zone = 'lower') AS bl, max(y) FILTER (zone = 'columns') AS pk, max(y + h) AS used, max(share) FILTER (zone = 'hero') AS hw, max(share) FILTER (zone = 'sidebar') AS sw FROM placed GROUP BY page),
v AS (SELECT page, (ph - be) / 714 AS a, (pc - bh) / 714 AS b, (pl - bc) / 714 AS c, (pk - bl) / 714 AS d, greatest(0, 672.35 - (used - 20.825)) / 672.35 AS e, hw, sw, CASE WHEN page % 3 = 0 THEN 5.0 ELSE 6.5 END AS size FROM g)"""
_VISUAL = [
    ("visual_metrics_exists", "true", None), ("masthead_overlap", "true", None), ("hero_image_width_ratio_gte_0_70", "hw >= 0.70", None), ("right_sidebar_width_ratio_gte_0_18", "sw >= 0.18", None), ("bottom_column_font_size_gte_5_5", "size >= 5.5", None), ("bottom_columns_readability_fail", "false", "size < 5.5"),
    ("headline_to_hero_gap_visual_warning", "a <= 0.045", None), ("hero_to_caption_gap_visual_warning", "b <= 0.022", None), ("caption_to_lower_headline_gap_visual_warning", "c <= 0.035", None), ("lower_headline_to_columns_gap_visual_warning", "d <= 0.025", None), ("total_vertical_whitespace_visual_warning", "e <= 0.15", None),
    ("masthead_render_mode_ok", "true", None), ("masthead_similarity_visual_warning", "false", "page % 5 = 0"), ("bottom_columns_readability_warn", "false", "size >= 5.5 AND page % 7 = 0"), ("visual_layout_headline_to_hero_gap_too_large_warning", "false", "a > 0.045"), ("visual_layout_hero_to_caption_gap_too_large_warning", "false", "b > 0.022"),
    ("visual_layout_caption_to_lower_headline_gap_too_large_warning", "false", "c > 0.035"), ("visual_layout_lower_headline_to_columns_gap_too_large_warning", "false", "d > 0.025"), ("visual_layout_total_vertical_whitespace_too_high_warning", "false", "e > 0.15"), ("visual_layout_hero_image_too_narrow_warning", "false", "hw < 0.70"), ("visual_layout_sidebar_too_narrow_warning", "false", "sw < 0.18"),
]
TYPED = FRONT + typed("front", "fb")
_COVER = "greatest(0, least(a.x2, t.x2) - greatest(a.x1, t.x1)) * greatest(0, least(a.y2, t.y2) - greatest(a.y1, t.y1))"
CROPS = TYPED + f""",
cov AS (SELECT a.page, a.pos, least(1.0, coalesce(sum({_COVER}), 0) / any_value((a.x2 - a.x1) * (a.y2 - a.y1))) AS coverage FROM fb a LEFT JOIN (FROM fb WHERE trim(text) <> '') t ON t.page = a.page WHERE a.block_type = 'hero_image' GROUP BY a.page, a.pos),
crop AS (SELECT f.page, f.pos, f.block_type, coverage, f.block_type = 'hero_image' AND coalesce(coverage, 1) <= 0.15 AND NOT (length(trim(text)) > 12 AND length(regexp_replace(text, '[^\\p{{L}}]', '', 'g')) / length(text) > 0.35) AS can_crop FROM fb f LEFT JOIN cov USING (page, pos))"""
#: Documents of blocks: in their order, a title, a photo, and each text block's side of a split of the narrow ones.
DOCS = FRONT + """,
ob AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY coalesce(block_order, 9999)::INT, y1, pos) AS place, trim(text) AS t FROM front),
bod AS (SELECT *, x2 - x1 AS wd, (x1 + x2) / 2 AS c FROM ob WHERE label = 'text' AND NOT regexp_matches(t, '(?i)^Sivu\\s+\\d+$')),
cnt AS (SELECT page, count(*) AS n, count(*) FILTER (wd < 620) AS lean FROM bod GROUP BY page),
ply AS (SELECT bod.* FROM bod JOIN cnt USING (page) WHERE n >= 2 AND (lean < 2 OR wd < 620)),
ext AS (SELECT *, greatest(1.0, max(x2) OVER (PARTITION BY page) - min(x1) OVER (PARTITION BY page)) AS extent FROM ply),
gap AS (SELECT page, c, extent, lag(c) OVER (PARTITION BY page ORDER BY c, place) AS before, count(*) OVER (PARTITION BY page) AS n FROM ext WHERE wd < 0.62 * extent),
spl AS (SELECT page, (c + before) / 2 AS split FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY c - before DESC, c) AS k FROM gap WHERE before IS NOT NULL) WHERE k = 1 AND n >= 3 AND c - before > 0 AND c - before >= 0.12 * extent),
pho AS (SELECT page, x1::INT AS px, y1::INT AS py, (x2 - x1)::INT AS pw, (y2 - y1)::INT AS ph FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY (x2 - x1) * (y2 - y1) DESC, place) AS k FROM ob WHERE label = 'image' AND (x2 - x1) * (y2 - y1) BETWEEN 20000 AND 550000) WHERE k = 1),
tit AS (SELECT page, arg_min(CASE WHEN label = 'text' THEN split_part(t, '.', 1)[:120] ELSE t END, (label = 'text')::INT * 100000 + place) AS title FROM ob WHERE label IN ('text', 'paragraph_title') AND t <> '' GROUP BY page),
sid AS (SELECT bod.page, place, y1, t, CASE WHEN split IS NULL AND px < 450 AND c > 450 THEN 'right' WHEN split IS NULL OR wd >= 620 THEN 'full' WHEN c < split THEN 'left' ELSE 'right' END AS side FROM bod LEFT JOIN spl USING (page) LEFT JOIN pho USING (page) WHERE t <> ''),
blk AS (SELECT page, side, min(y1) AS y, list(t ORDER BY y1, place) AS ps, CASE side WHEN 'left' THEN 0 WHEN 'right' THEN 1 ELSE 2 END AS rank FROM sid GROUP BY page, side),
doc AS (SELECT p.page, coalesce(title, 'Asiakirja') AS title, px, py, pw, ph, coalesce(string_agg(side, ',' ORDER BY y, rank), '') AS kinds, string_agg(CASE side WHEN 'left' THEN '## Vasen palsta' WHEN 'right' THEN '## Oikea palsta' ELSE '## Leveä lohko' END || chr(10) || chr(10) || array_to_string(ps, chr(10) || chr(10)), chr(10) || chr(10) ORDER BY y, rank) AS md,
  string_agg(array_to_string(ps, chr(10) || chr(10)), chr(10) || chr(10) ORDER BY y, rank) AS flow, count(side) FILTER (side IN ('left', 'right')) AS ncol, count(side) AS nblk FROM (SELECT DISTINCT page FROM front) p LEFT JOIN tit USING (page) LEFT JOIN pho USING (page) LEFT JOIN blk USING (page) GROUP BY p.page, title, px, py, pw, ph),
docs AS (SELECT *, ncol >= 2 OR (px IS NOT NULL AND ncol > 0) AS multi FROM doc)"""
_LINES2 = "string_split(text, chr(10))"
RESULTS = f"""d AS (SELECT doc_id AS k, text, trim({_LINES2}[1]) AS f, coalesce(trim({_LINES2}[2]), '') AS o FROM documents),
s AS (SELECT k, CASE WHEN k % 11 = 0 THEN 'Asiakirja' ELSE f END AS title, '# ' || CASE WHEN k % 11 = 0 THEN 'Asiakirja' ELSE f END || chr(10) || chr(10) || text[:60] AS md, CASE k % 3 WHEN 0 THEN [[f], [o]] WHEN 1 THEN [[o]] ELSE []::VARCHAR[][] END AS bl, k % 4 = 1 AS photo, k % 3 = 0 AS lay, (k % 10) / 10 AS conf, f, o FROM d WHERE k % 7 <> 0),
t AS (SELECT k, o AS title, CASE WHEN k % 4 = 0 THEN f || chr(10) || chr(10) || 'Two.' WHEN k % 13 = 1 THEN '' ELSE '# ' || o || chr(10) || chr(10) || 'One.' || chr(10) || chr(10) || '## Oikea palsta' || chr(10) || f || chr(10) || chr(10) || 'Three.' END AS md,
  CASE WHEN k % 2 = 0 THEN [[f]] ELSE []::VARCHAR[][] END AS bl, k % 6 = 1 AS photo, list_filter(CASE WHEN k % 4 = 0 THEN [f, 'Two.'] WHEN k % 13 = 1 THEN []::VARCHAR[] WHEN o = '' THEN ['#', 'One.', f, 'Three.'] ELSE ['One.', f, 'Three.'] END, lambda p: p <> '') AS ps, CASE WHEN k % 4 = 0 OR k % 13 = 1 THEN '' ELSE o END AS mt, f, o FROM d WHERE k % 5 <> 0)"""


_ROLE = _case(FONT_ROLES, "block_type", "'body'")
_OF = lambda least, most, share: f"least({most}, greatest({least}, hp * {share}))"
#: What a structural plan draws, in order.
PLANNED = TYPED + f""",
lns AS (SELECT *, list_filter(list_transform(string_split(text, chr(10)), lambda s: trim(s)), lambda s: s <> '') AS ls FROM fb),
ex0 AS (SELECT *, unnest(CASE WHEN block_type = 'main_headline' AND len(ls) > 1 THEN ls ELSE [text] END) AS said, generate_subscripts(CASE WHEN block_type = 'main_headline' AND len(ls) > 1 THEN ls ELSE [text] END, 1) - 1 AS sub FROM lns),
ex AS (SELECT page, pos, sub, CASE WHEN sub > 0 THEN 'secondary_headline' ELSE block_type END AS block_type, said, x1, y1, x2, y2, (y2 - y1) * 0.595 AS hp FROM ex0),
dr0 AS (SELECT *, CASE block_type WHEN 'hero_image' THEN 0 WHEN 'continuation_box' THEN 3 ELSE 1 END AS z, trim(said) <> '' AND block_type <> 'hero_image' AS shown, CASE {_ROLE} WHEN 'masthead' THEN {_OF(10.0, 28.0, 0.55)} WHEN 'headline' THEN {_OF(12.0, 36.0, 0.65)} WHEN 'caption' THEN {_OF(7.0, 12.0, 0.45)} WHEN 'meta' THEN {_OF(7.0, 12.0, 0.45)} ELSE {_OF(7.0, 11.0, 0.42)} END AS size FROM ex),
dr AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY z, y1, x1, pos, sub) AS rn FROM dr0),
plan0 AS (SELECT *, rn * 3 AS n, 'image' AS op, pos::VARCHAR AS text, NULL AS colour FROM dr WHERE block_type = 'hero_image' UNION ALL SELECT *, rn * 3, 'rect', NULL, 'black' FROM dr WHERE shown AND block_type = 'continuation_box'
  UNION ALL SELECT *, rn * 3 + (block_type = 'continuation_box')::INT, 'text', said, CASE WHEN block_type = 'continuation_box' THEN 'white' ELSE 'black' END FROM dr WHERE shown),
plan AS (SELECT page, z, n::INT AS n, op, round(x1 * 0.595, 6) AS x, round(y1 * 0.595 + sub * 14, 6) AS y, round((x2 - x1) * 0.595, 6) AS w, round(hp, 6) AS h, text, round(size, 6) AS size, colour FROM plan0),
facts AS (SELECT page, coalesce(string_agg(text, chr(10) ORDER BY z, n) FILTER (op = 'text'), '') AS pdf_text, count(*) FILTER (op = 'image') AS images, arg_min(y, -w * h * 1000000 + n) FILTER (op = 'image') AS image_top, coalesce(max(w * h) FILTER (op = 'image'), 0) >= 0.9 * 595 * 714 AS full_page,
  bool_or(op = 'text' AND colour = 'white') AND bool_or(op = 'rect' AND colour = 'black') AS white_box FROM plan GROUP BY page)"""


def oracle_sql() -> dict[str, str]:
    gate = " UNION ALL ".join(f"SELECT page, '{n}' AS name, {e} AS passed FROM v" + (f" WHERE {w}" if w else "") for n, e, w in _VISUAL)
    audited = AUDITED.replace("{extra}", _KUOLON)
    plain = AUDITED.replace("{extra}", "")
    turn = "(SELECT conv_id, turn, min(text) AS text FROM conversations GROUP BY ALL)"
    path = "'p' || conv_id || CASE conv_id % 4 WHEN 0 THEN '.JPG' WHEN 1 THEN '.pdf' WHEN 2 THEN '.txt' ELSE '.tiff' END"
    label = "CASE turn % 5 WHEN 4 THEN 'header' WHEN 3 THEN 'image' ELSE 'text' END"
    return {
        "page_model_roles": f"WITH RECURSIVE {MODEL} SELECT page, role, n::INT AS n, text, coalesce(id::VARCHAR, '') AS ids, round(confidence, 6) AS confidence FROM roles",
        "newspaper_markdown": f"WITH RECURSIVE {OUT} SELECT page, markdown, body, pdf_text FROM out",
        "content_segments": f"WITH RECURSIVE {MODEL}, u AS ({' UNION ALL '.join(f'SELECT page, {chr(39)}{n}{chr(39)} AS id, {chr(39)}{n}{chr(39)} AS role, trim({t}) AS text FROM model' for n, t in _SEGMENTS.items())} UNION ALL SELECT page, 'lower_story_column_' || (generate_subscripts(cols, 1) - 1), 'lower_story_column', trim(unnest(cols)) FROM model) SELECT page, id, role, text, text AS normalized, role AS owner, role AS target FROM u WHERE text <> ''",
        "content_ownership": f"""WITH RECURSIVE {plain}, tk AS (SELECT page, string_agg(id, ',' ORDER BY id) AS taken FROM taken8 GROUP BY page),
mi AS (SELECT page, string_agg(id, ',' ORDER BY o) AS metadata_ids FROM (SELECT page, id, min(o) AS o FROM (SELECT page, id, CASE role WHEN 'issue_meta' THEN 1 WHEN 'date_meta' THEN 2 WHEN 'stars_meta' THEN 3 ELSE 4 END AS o FROM picked UNION ALL SELECT page, id, 5 FROM picked2 WHERE role = 'price_meta') GROUP BY ALL) GROUP BY page)
SELECT page, coalesce(taken, '') AS taken, coalesce(metadata_ids, '') AS metadata_ids, misassigned, sidebar_seen OR sidebar <> '' AS sidebar_detected, many AS caption_candidates, caption <> '' AS caption_selected, missing <> '' AS content_loss, missing FROM aud0 LEFT JOIN tk USING (page) LEFT JOIN mi USING (page)""",
        "gate_checks": f"WITH RECURSIVE {GATE} SELECT * FROM gate",
        "gate_verdicts": f"""WITH RECURSIVE {plain}, g AS (SELECT page, bool_or(NOT passed AND NOT (name IN ({_SOFT}) OR ends_with(name, '_warning') OR starts_with(name, 'content_'))) AS hard, bool_or(NOT passed AND (name IN ({_SOFT}) OR ends_with(name, '_warning'))) AS soft, count(*) FILTER (NOT passed) AS n FROM gate GROUP BY page)
SELECT page, CASE WHEN hard THEN 'FAIL' ELSE 'PASS' END AS layout_quality, content_quality, CASE WHEN hard OR content_quality = 'FAIL' THEN 'FAIL' ELSE 'PASS' END AS quality_result, CASE WHEN hard OR content_quality = 'FAIL' THEN 'FAIL' WHEN soft THEN 'PASS_WITH_WARNINGS' ELSE 'PASS' END AS status, 'PASS' AS readability,
  (n + (content_quality = 'FAIL')::INT + content_loss::INT + (misassigned <> '')::INT + (truncated_segments <> '' OR forbidden_found <> '')::INT + (duplicates <> '')::INT + 2 * (hard OR content_quality = 'FAIL')::INT)::INT AS n_failed FROM aud JOIN g USING (page)""",
        "content_audit": f"WITH RECURSIVE {audited} SELECT page, segments, forbidden_found, duplicates, truncated_segments, misassigned AS misassignments, content_loss, content_quality, content_quality AS quality_result FROM aud",
        "typography_plan": f"""WITH RECURSIVE {OUT}, mc AS (SELECT page, avg(confidence) AS confidence FROM roles WHERE role LIKE '%_meta' GROUP BY page), mb AS (SELECT r.page, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2 FROM roles r JOIN b ON b.page = r.page AND b.id = r.id WHERE role LIKE '%_meta' GROUP BY r.page)
SELECT page, round(z_label, 6) AS masthead_label, round(z_name, 6) AS newspaper_name, 6.0 AS issue_meta, round(z_main, 6) AS main_headline, round(z_second, 6) AS secondary_headline, 7.0 AS hero_sidebar_body, 5.5 AS image_caption, round(z_lower, 6) AS lower_headline, 5.5 AS bottom_column_body, 8.5 AS continuation_box,
  concat_ws(',', CASE WHEN z_main < 21 THEN 'main_headline_font_size_below_3x_body' END, CASE WHEN z_lower < 14 THEN 'lower_headline_font_size_below_2x_body' END, CASE WHEN unlike THEN 'masthead_similarity_below_target' END) AS warnings, unlike AS masthead_unlike, round(confidence, 9) AS confidence,
  x1 AS meta_x1, y1 AS meta_y1, x2 AS meta_x2, y2 AS meta_y2, CASE WHEN caption <> '' THEN caption END AS caption FROM out JOIN mc USING (page) LEFT JOIN mb USING (page)""",
        "visual_checks": f"WITH {FRONT_STACKED}, {_GAPS} {gate}",
        "crop_policy": f"WITH {CROPS} SELECT page, pos, block_type, round(coverage, 9) AS coverage, can_crop FROM crop",
        "block_documents": f"WITH {DOCS} SELECT page, title, px AS photo_x, py AS photo_y, pw AS photo_width, ph AS photo_height, kinds, multi, CASE WHEN multi THEN greatest(ncol, 1) ELSE 1 END AS columns, nblk > 0 OR (px IS NOT NULL AND title NOT IN ('', 'Asiakirja')) AS sufficient, title IN ('', 'Asiakirja') OR (nblk = 0 AND px IS NULL) AS weak, multi OR px IS NOT NULL AS uses_layout FROM docs",
        "structured_markdown": f"WITH {DOCS}, m AS (SELECT page, '# ' || title || coalesce(chr(10) || chr(10) || md, '') || chr(10) AS structured, '# ' || title || coalesce(chr(10) || chr(10) || flow, '') || chr(10) AS flowing, multi OR px IS NOT NULL AS lay FROM docs) SELECT page, structured, flowing, md5(CASE WHEN lay THEN structured ELSE flowing END) AS auto FROM m",
        "engine_choice": f"""WITH {RESULTS}, j AS (SELECT coalesce(t.k, s.k) AS k, t.k IS NOT NULL AS has_t, s.k IS NOT NULL AS has_s, coalesce(t.md, s.md) AS p, coalesce(CASE WHEN t.k IS NULL THEN s.title ELSE t.mt END, '') AS pt, s.title AS st, t.title AS tt, s.bl AS sb, t.bl AS tb, s.lay AS lay, s.conf AS conf,
  CASE WHEN t.k IS NULL THEN CASE WHEN s.title = '' THEN ['#'] ELSE [] END || list_filter(list_transform(string_split_regex(s.md[length('# ' || s.title) + 1:], '\\n\\s*\\n'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') ELSE t.ps END AS ps FROM t FULL JOIN s ON s.k = t.k),
q AS (SELECT *, CASE WHEN NOT has_s THEN 'text' WHEN trim(p) = '' THEN 'layout' ELSE 'merged' END AS document FROM j)
SELECT k AS doc_id, CASE WHEN has_t THEN 'text_engine' ELSE 'layout_engine' END AS text_source, CASE WHEN has_s THEN 'layout_engine' ELSE 'text_engine' END AS layout_source, CASE WHEN has_t THEN 'text_engine' ELSE 'layout_engine' END AS order_source, p AS markdown, coalesce(lay, false) AS uses_layout, CASE WHEN pt <> '' THEN pt ELSE coalesce(st, '') END AS title,
  round(CASE WHEN has_t AND has_s THEN (0.85::DOUBLE + conf) / 2 WHEN has_t THEN 0.85 ELSE conf END, 9) AS confidence, document,
  CASE document WHEN 'text' THEN array_to_string(list_transform(tb, lambda b: array_to_string(b, '|')), '/') WHEN 'layout' THEN array_to_string(list_transform(sb, lambda b: array_to_string(b, '|')), '/')
    ELSE coalesce(CASE WHEN len(ps) = 0 THEN array_to_string(list_transform(sb, lambda b: array_to_string(b, '|')), '/') WHEN len(sb) = 1 THEN array_to_string(ps, '|') WHEN len(sb) = 2 THEN ps[1] || '/' || CASE WHEN len(ps) > 1 THEN array_to_string(ps[2:], '|') ELSE sb[2][1] END END, '') END AS paragraphs FROM q""",
        "text_engine_confidence": "WITH p AS (SELECT conv_id AS doc_id, CASE WHEN turn % 3 = 0 THEN CASE WHEN length(text) % 2 > 0 THEN 0.85 ELSE 0 END ELSE ((length(text) % 10) / 10.0::DOUBLE + (length(text) % 7) / 7.0::DOUBLE) / 2 END AS c FROM conversations WHERE text IS NOT NULL) SELECT doc_id, round(avg(c), 9) AS confidence FROM p GROUP BY doc_id",
        "engine_summary": f"WITH {RESULTS} SELECT k AS doc_id, 'text' AS engine, true AS ran, 0.85::DOUBLE AS confidence, 2 AS pages, length(md) AS chars FROM t UNION ALL SELECT k, 'layout', true, round(conf, 9), 1, length(md) FROM s",
        "json_reports": f"""WITH {RESULTS} SELECT t.k AS doc_id, '{{"engine":"' || CASE WHEN s.k IS NULL THEN 'text' ELSE 'layout' END || '","pages":"2","chars":"' || coalesce(length(s.md), length(t.md)) || '","uses_layout":' || coalesce('"' || s.lay::VARCHAR || '"', 'null') || '}}' AS report FROM t LEFT JOIN s USING (k)""",
        "layout_metrics": f"WITH {TYPED}, m AS (SELECT page, bool_or(block_type IN ('main_headline', 'secondary_headline')) AS headline_found, bool_or(block_type = 'hero_image') AS hero_found, bool_or(block_type = 'right_sidebar') AS sidebar_found, bool_or(block_type = 'bottom_columns') AS columns_found, any_value(fb_p.paper) AS front_page FROM fb JOIN fb_p USING (page) GROUP BY page) SELECT page, CASE WHEN front_page THEN 'newspaper_front_page' ELSE 'generic' END AS document_type, round(1000 / 1200.0, 9) AS source_aspect, round(595 / 714.0, 9) AS pdf_aspect, headline_found, hero_found, sidebar_found, columns_found, concat_ws(',', CASE WHEN front_page THEN 'reflow_used_on_newspaper_page' END, CASE WHEN NOT hero_found THEN 'hero_image_not_found' END) AS warnings FROM m",
        "zone_order_checks": f"""WITH {TYPED}, h AS (SELECT page, y1 / 1200 AS hero FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY (x2 - x1) * (y2 - y1) DESC, pos) AS k FROM fb WHERE block_type = 'hero_image') WHERE k = 1),
z AS (SELECT page, min(y1) FILTER (block_type = 'main_headline') / 1200 AS main, min(y1) FILTER (block_type = 'secondary_headline') / 1200 AS second, min(y1) FILTER (block_type IN ('masthead_logo', 'newspaper_name')) / 1200 AS mast, min(y1) FILTER (block_type = 'bottom_headline') / 1200 AS bottom FROM fb GROUP BY page), a AS (FROM z LEFT JOIN h USING (page))
SELECT page, 'hero_image_in_middle_zone' AS name, hero BETWEEN 0.28 - 0.02 AND 0.75 + 0.02 AS passed FROM a WHERE hero IS NOT NULL UNION ALL SELECT page, 'main_headline_above_hero', main < hero FROM a WHERE main + hero IS NOT NULL UNION ALL SELECT page, 'secondary_headline_above_hero', second < hero FROM a WHERE second + hero IS NOT NULL
UNION ALL SELECT page, 'bottom_headline_below_hero', hero < bottom FROM a WHERE bottom + hero IS NOT NULL UNION ALL SELECT page, 'masthead_above_headline', mast < main FROM a WHERE mast + main IS NOT NULL""",
        "page_json_blocks": f"WITH c AS (SELECT *, {path} AS path, (row_number() OVER (PARTITION BY conv_id ORDER BY turn))::INT AS pos FROM {turn} WHERE conv_id % 6 < 2) SELECT path, pos - 1 AS pos, {label} AS label, coalesce(text, '') AS content, CASE WHEN turn % 2 = 0 THEN turn::DOUBLE END AS x1, CASE WHEN turn % 2 = 0 THEN turn * 10::DOUBLE END AS y1, CASE WHEN turn % 2 = 0 THEN turn + 50::DOUBLE END AS x2, CASE WHEN turn % 2 = 0 THEN turn * 10 + 9::DOUBLE END AS y2, CASE WHEN turn % 2 = 0 THEN turn::DOUBLE END AS block_order FROM c",
        "page_json_lines": f"WITH c AS (SELECT *, {path} AS path, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS idx, turn / 10 AS s FROM {turn} WHERE conv_id % 6 IN (2, 3, 4)) SELECT path, idx, coalesce(text, '') AS text, s AS score, CASE WHEN turn % 2 = 0 THEN s ELSE 0 END AS x_min, CASE WHEN turn % 2 = 0 THEN s ELSE idx END AS y_min, CASE WHEN turn % 2 = 0 THEN s + 3 ELSE 100 END AS x_max, CASE WHEN turn % 2 = 0 THEN s + 1 ELSE idx + 1 END AS y_max FROM c",
        "page_json_text": f"""WITH c AS (SELECT *, {path} AS path FROM {turn}), p AS (SELECT path, any_value(conv_id) % 6 AS k, string_agg(trim(text), chr(10) || chr(10) ORDER BY turn) FILTER (turn % 5 < 3 AND trim(text) <> '') AS b, regexp_replace(string_agg(coalesce(text, ''), chr(10) ORDER BY turn), '^\\s+|\\s+$', '', 'g') AS l, avg(turn / 10) AS s FROM c GROUP BY path)
SELECT path, CASE WHEN k < 2 THEN b WHEN k < 5 THEN l END AS text, round(CASE WHEN k BETWEEN 2 AND 4 THEN s ELSE 0 END, 9) AS confidence, k = 5 AS corrupt, CASE WHEN path LIKE '%.txt' THEN 'unknown' WHEN path LIKE '%.pdf' THEN 'pdf' ELSE 'image' END AS kind FROM p UNION ALL SELECT 'missing.png', NULL, 0, false, 'image'""",
        "output_manifest": f"""WITH c AS (SELECT DISTINCT {path} AS doc_id FROM conversations), s AS (SELECT doc_id, regexp_replace(doc_id, '[.][^.]*$', '') AS st, doc_id LIKE '%.JPG' OR doc_id LIKE '%.tiff' AS image FROM c)
SELECT doc_id, 'markdown' AS output, '/in/a.b/' || st || '.md' AS path FROM s UNION ALL SELECT doc_id, o, '/in/a.b/' || p || st || '_' || o || '.pdf' FROM s, (VALUES ('structural', ''), ('clean', ''), ('debug_overlay', 'ocr/'), ('debug_search_layer', 'ocr/')) v(o, p) WHERE image""",
        "output_hygiene": """SELECT doc_id, name, CASE name WHEN 'markdown_exists' THEN doc_id % 3 > 0 WHEN 'structural_pdf_exists' THEN doc_id % 4 <> 0 WHEN 'no_test_pdf_in_root' THEN doc_id % 4 <> 0 WHEN 'no_facsimile_in_root' THEN NOT (doc_id % 5 = 0 AND doc_id % 7 = 0) ELSE NOT (doc_id % 5 <> 0 AND doc_id % 7 = 0) END AS passed
FROM documents, (VALUES ('markdown_exists'), ('structural_pdf_exists'), ('no_test_pdf_in_root'), ('no_facsimile_in_root'), ('no_facsimile_in_ocr_by_default')) v(name)""",
        "error_log": f"WITH RECURSIVE {GATE} SELECT page AS doc_id, 'gate_' || name AS error_id, '' AS message FROM gate WHERE NOT passed AND starts_with(name, 'markdown_contains_') AND name <> 'markdown_contains_image_caption'",
        "structural_plan": f"WITH {PLANNED} FROM plan",
        "render_facts": f"""WITH {PLANNED}, r AS (SELECT page, bool_or(block_type = 'main_headline' AND trim(said) <> '') AS main_as_text, bool_or(block_type = 'secondary_headline' AND trim(said) <> '') AS secondary_as_text, bool_or(block_type = 'bottom_headline' AND trim(said) <> '') AS bottom_as_text, bool_or(block_type = 'hero_image') AS hero_is_crop,
  bool_or(block_type = 'right_sidebar' AND trim(said) <> '') AS sidebar_found, count(*) FILTER (block_type = 'bottom_columns') AS bottom_columns FROM ex GROUP BY page) SELECT page, md5(pdf_text) AS pdf_text, images, image_top, full_page, white_box, r.* EXCLUDE (page) FROM facts JOIN r USING (page)""",
        "crop_checks": f"""WITH {PLANNED}, {CROPS[len(TYPED) + 2 :]}, p AS (SELECT page, count(*) FILTER (block_type = 'hero_image') AS photos, count(*) FILTER (block_type = 'hero_image' AND NOT can_crop) AS bad FROM crop GROUP BY page), a AS (FROM p JOIN facts USING (page))
{" UNION ALL ".join(f"SELECT page, '{n}' AS name, {e} AS passed FROM a" for n, e in (("text_crops_used", "true"), ("photo_crops_used", "photos > 0"), ("forbidden_text_crop_blocks_empty", "bad = 0"), ("masthead_render_mode_text", "true"), ("newspaper_name_render_mode_text", "true"), *[("pdf_text_contains_" + w.replace(" ", "_").lower(), f"contains(upper(pdf_text), '{w}')") for w in ("ILTA-SANOMAT", "JO 39 KUOLONUHRIA", "TEHDASR", "LAPUA ERISTET", "JATKUU")], ("structural_pdf_only_photo_crops", "images BETWEEN 1 AND 2")))}""",
        "page_layout": f"""WITH {FRONT}, ob AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY coalesce(block_order, 9999)::INT, y1, pos) AS place FROM front), oth AS (SELECT page, pos, trim(text || ' seen') AS text, x1 + 15 AS x1, y1, x2 + 15 AS x2, y2 FROM front WHERE pos % 3 <> 0),
m AS (SELECT a.page, a.pos, b.text, {_iou("a", "b")} AS iou, row_number() OVER (PARTITION BY a.page, a.pos ORDER BY {_iou("a", "b")} DESC, b.pos) AS k FROM ob a JOIN oth b ON a.page = b.page AND {_MEETS}),
res AS (SELECT o.page, o.pos, label, o.x1, o.y1, o.x2, o.y2, block_order, confidence, place, {_STRIPPED.format("CASE WHEN iou >= 0.15 THEN m.text ELSE o.text END")} AS text FROM ob o LEFT JOIN (FROM m WHERE k = 1) m USING (page, pos)) {typed("res", "ty")},
own AS (SELECT page, 's' || (row_number() OVER (PARTITION BY page ORDER BY y1, place) - 1) AS id, row_number() OVER (PARTITION BY page ORDER BY y1, place) - 1 AS reading_order, block_type, text, 'layout_engine' AS engine, x1, y1, x2, y2 FROM ty),
ca(n, block_type, x1, y1, x2, y2) AS (VALUES {", ".join(f"({i}, '{t}', {', '.join(f'{v}::DOUBLE' for v in b)})" for i, (t, b) in enumerate(CANDIDATES))}),
fc AS (SELECT *, row_number() OVER (PARTITION BY block_type ORDER BY n) AS k FROM ca), pg AS (SELECT page, count(*) AS many FROM own GROUP BY page),
new AS (SELECT page, 'cv' || n AS id, many + n AS reading_order, block_type, '' AS text, 'candidates' AS engine, x1, y1, x2, y2 FROM pg, fc WHERE block_type IN ('bottom_columns', 'continuation_box') OR (k = 1 AND NOT EXISTS (FROM own WHERE own.page = pg.page AND own.block_type = fc.block_type)))
SELECT page, id, reading_order::INT AS reading_order, block_type, {_ROLE} AS font_role, CASE block_type WHEN 'hero_image' THEN 'image' WHEN 'continuation_box' THEN 'box' ELSE 'text' END AS render_mode, text, engine, round(x1 * 0.595, 6) AS px1, round(714 - y2 * 0.595, 6) AS py1, round(x2 * 0.595, 6) AS px2, round(714 - y1 * 0.595, 6) AS py2 FROM (FROM own UNION ALL FROM new)""",
        "line_flags": f"""WITH {FRONT}, q AS (SELECT page, pos, CASE pos % 19 WHEN 3 THEN 'Sivu 12' WHEN 4 THEN text || ' aaaa' ELSE text END AS s FROM front), r AS (SELECT *, s AS text, list_filter(list_transform(string_split(s, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ls FROM q),
f AS (SELECT *, contains(upper(s), 'N:O') AS issue, {_DAYS} AS dated, regexp_matches(trim(s), '^[*☆★ ]{{1,6}}$') AS stars, contains(upper(s), 'MK') AND (contains(upper(s), 'SIS.') OR contains(upper(s), 'LVV') OR contains(upper(s), 'ALV')) AS price, {_BEFORE.format("s")} AS flat FROM r)
SELECT page, pos, contains(upper(s), 'ERISTETTHIN') OR len(list_filter(range(1, length(s) - 2), lambda i: s[i] = s[i + 1] AND s[i] = s[i + 2] AND s[i] = s[i + 3] AND s[i] <> chr(10))) > 0 AS noise, issue, dated AS date, stars, price,
  len(list_filter(ls[:3], lambda l: contains(upper(l), 'N:O') OR {_DAYS.replace("(s)", "(l)")} OR regexp_matches(l, '^[*☆★ ]*$') OR (contains(upper(l), 'MK') AND (contains(upper(l), 'SIS.') OR contains(upper(l), 'LVV') OR contains(upper(l), 'ALV'))))) > 0 AS starts, regexp_matches(trim(s), '^(?i)sivu\\s+[0-9]+$') AS page_number,
  regexp_matches(s, '(?i)\\balmond\\b') OR contains(lower(s), 'ste') AS truncated, CASE WHEN length(flat) > 72 THEN flat[:71] || '…' ELSE flat END AS preview, array_to_string(ls, chr(10)) AS segment, coalesce(ls[1], '') AS first, {_CAPTION} AS caption FROM f""",
        "overlay_plan": f"""WITH {TYPED}, o AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY y1, x1, pos) * 2 AS rn FROM fb)
SELECT page, 1 AS z, (rn + i)::INT AS n, CASE i WHEN 0 THEN 'rect' ELSE 'text' END AS op, round(x1 * 0.595, 6) AS x, round(y1 * 0.595, 6) AS y, round((x2 - x1) * 0.595, 6) AS w, round((y2 - y1) * 0.595, 6) AS h, CASE i WHEN 1 THEN block_type END AS text, 6.0::DOUBLE AS size, 'red' AS colour FROM o, (VALUES (0), (1)) v(i)""",
        "facsimile_plan": f"""WITH {TYPED}, o AS (SELECT *, (y2 - y1) * 0.595 AS hp, row_number() OVER (PARTITION BY page ORDER BY y1, x1, pos) AS rn FROM fb)
SELECT page, 1 AS z, rn::INT AS n, 'hidden' AS op, round(x1 * 0.595, 6) AS x, round(y1 * 0.595, 6) AS y, round((x2 - x1) * 0.595, 6) AS w, round(hp, 6) AS h, text, round(CASE {_ROLE} WHEN 'masthead' THEN {_OF(10.0, 28.0, 0.55)} WHEN 'headline' THEN {_OF(12.0, 36.0, 0.65)} WHEN 'caption' THEN {_OF(7.0, 12.0, 0.45)} WHEN 'meta' THEN {_OF(7.0, 12.0, 0.45)} ELSE {_OF(7.0, 11.0, 0.42)} END, 6) AS size, NULL AS colour FROM o WHERE block_type <> 'hero_image' AND trim(text) <> ''
UNION ALL SELECT DISTINCT page, 0, 0, 'image', 0.0, 0.0, 595.0, 714.0, 'page', NULL, NULL FROM fb""",
        "typography_styles": "WITH RECURSIVE " + SIZED + " " + " UNION ALL ".join(f"SELECT '{r}' AS role, '{f}' AS font, '{w}' AS weight, '{al}' AS align, {up} AS upper, {c} AS condensed, '{col}' AS colour, count(*) AS pages, round(avg({_SIZES.get(r, r)}), 6) AS size FROM sized" for r, f, _, w, c, up, col, al, _, _ in typography.STYLES),
        "engine_documents": f"""WITH {RESULTS}, one AS (SELECT k, len(list_filter(flatten(bl), lambda p: trim(p) <> '')) > 0 AS text_there, photo, title, md FROM t), two AS (SELECT k, len(list_filter(flatten(bl), lambda p: trim(p) <> '')) > 0 AS text_there, photo, title, md, conf FROM s),
src AS (SELECT coalesce(one.k, two.k) AS k, one.k IS NOT NULL AS has_t, coalesce(one.text_there OR (one.photo AND trim(one.title) NOT IN ('', 'Asiakirja')), false) AS own, coalesce(two.text_there OR (two.photo AND trim(two.title) NOT IN ('', 'Asiakirja')), false) AS other FROM one FULL JOIN two ON one.k = two.k),
bod AS (SELECT t.k, t.mt, s.title AS st, lower(trim(regexp_replace(array_to_string(t.ps, ' '), '\\s+', ' ', 'g'))) AS tb, lower(trim(regexp_replace(CASE WHEN s.title = '' THEN '# ' ELSE '' END || array_to_string(list_filter(list_transform(string_split_regex(s.md[length('# ' || s.title) + 1:], '\\n\\s*\\n'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> ''), ' '), '\\s+', ' ', 'g'))) AS sb FROM t JOIN s USING (k)),
con AS (SELECT k, concat_ws(',', CASE WHEN k % 3 = 0 THEN 'layout:layout_engine' END, CASE WHEN tb <> sb AND tb <> '' AND sb <> '' THEN 'text:text_engine' END, CASE WHEN trim(mt) <> '' AND trim(st) <> '' AND lower(trim(regexp_replace(mt, '\\s+', ' ', 'g'))) <> lower(trim(regexp_replace(st, '\\s+', ' ', 'g'))) THEN 'title:text_engine' END) AS conflicts FROM bod)
SELECT src.k AS doc_id, CASE WHEN own THEN 'text' WHEN other THEN 'merged' WHEN has_t THEN 'text' ELSE 'none' END AS source, coalesce(conflicts, '') AS conflicts, conf < 0.6 OR trim(two.title) IN ('', 'Asiakirja') OR NOT (two.text_there OR two.photo) AS weak, CASE WHEN two.k IS NULL THEN NULL WHEN two.k % 3 = 0 THEN 2 ELSE 1 END AS columns FROM src LEFT JOIN con USING (k) LEFT JOIN two ON two.k = src.k""",
        "drawn_checks": f"""WITH {PLANNED} SELECT page, 'no_full_page_background' AS name, NOT full_page AS passed FROM facts UNION ALL SELECT page, 'continuation_box_white_text', white_box FROM facts UNION ALL SELECT -1 - page, unnest(['no_full_page_background', 'continuation_box_white_text']), false FROM facts""",
        "sidebar_cleanup": f"""WITH RECURSIVE {MODEL}, n AS (SELECT page, sidebar, cols, lower_headline, unnest(string_split(sidebar || chr(10) || lower_headline || chr(10) || sidebar, chr(10))) AS s, generate_subscripts(string_split(sidebar || chr(10) || lower_headline || chr(10) || sidebar, chr(10)), 1) AS i FROM model),
k AS (SELECT page, s, min(i) AS i FROM n WHERE trim(s) <> '' AND upper(s) <> upper(lower_headline) AND NOT (contains(upper(s), 'LAPUA') AND contains(upper(s), 'ERISTET')) AND NOT contains(upper(s), 'LATAAMORAKENNU') GROUP BY page, s), j AS (SELECT page, string_agg(s, chr(10) || chr(10) ORDER BY i) AS t FROM k GROUP BY page),
c AS (SELECT page, 0 AS i, coalesce(t, '') AS t, cols FROM model LEFT JOIN j USING (page) UNION ALL SELECT page, i + 1, CASE WHEN length(trim(cols[i + 1])[:40]) > 18 THEN regexp_replace(replace(t, trim(cols[i + 1])[:40], ''), '^\\s+|\\s+$', '', 'g') ELSE t END, cols FROM c WHERE i < len(cols)),
z AS (SELECT page, arg_max(t, i) AS t FROM c GROUP BY page)
SELECT page, regexp_replace(t, '\\n{{3,}}', chr(10) || chr(10), 'g') AS sidebar, CASE WHEN p > 0 AND NOT contains(lower(c1), 'murhe') THEN trim(c1 || ' ' || trim(substr(blob, greatest(1, p - 5), p + 10 - greatest(1, p - 5)))) ELSE c1 END AS caption FROM (
  SELECT page, t, trim(coalesce(image_caption, '') || ' ' || trim(right('Ja sitten ' || main_headline || ' ', 8) || 'viimein loppui ')) AS c1, 'Ja sitten ' || main_headline || ' viimein loppui kaikki' AS blob, strpos(lower('Ja sitten ' || main_headline || ' viimein loppui kaikki'), 'murhe') AS p FROM z JOIN model USING (page))""",
        "line_documents": f"""WITH RECURSIVE {NOISY}, sl AS (SELECT *, CASE WHEN doc_id % 3 = 1 AND idx % 4 = 1 THEN 60.0::DOUBLE ELSE 0 END AS x_min FROM noisy), setl AS (SELECT *, CASE WHEN doc_id % 3 = 1 AND idx % 4 <> 3 THEN x_min + 40 ELSE 100.0 END AS x_max FROM sl), {titled("setl", True)},
ex AS (SELECT *, x_max - x_min AS wd, (x_min + x_max) / 2 AS c, greatest(1.0, max(x_max) OVER (PARTITION BY doc_id) - min(x_min) OVER (PARTITION BY doc_id)) AS extent FROM kept),
gp AS (SELECT doc_id, c, extent, lag(c) OVER (PARTITION BY doc_id ORDER BY c, idx) AS before, count(*) OVER (PARTITION BY doc_id) AS n FROM ex WHERE wd < 0.62 * extent),
sp AS (SELECT doc_id, (c + before) / 2 AS split FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY c - before DESC, c) AS k FROM gp WHERE before IS NOT NULL) WHERE k = 1 AND n >= 3 AND c - before > 0 AND c - before >= 0.12 * extent),
sd AS (SELECT doc_id * 3 + CASE WHEN split IS NULL OR wd >= 0.62 * extent THEN 2 WHEN c < split THEN 0 ELSE 1 END AS doc_id, idx, text, x_min, x_max, y_min, y_max FROM ex LEFT JOIN sp USING (doc_id) WHERE NOT regexp_matches(trim(text), '^(?i)sivu\\s+[0-9]+$')), {_dehyphenated("sd", "se", True)}, {_paragraphs("se")},
bl AS (SELECT s.doc_id // 3 AS doc_id, s.doc_id % 3 AS side, any_value(y) AS y, string_agg(p.text, chr(10) || chr(10) ORDER BY par) AS ps FROM (SELECT doc_id, min(y_min) AS y FROM se GROUP BY doc_id) s JOIN pars p ON p.doc_id = s.doc_id AND p.text <> '' GROUP BY s.doc_id),
dm AS (SELECT doc_id, string_agg(CASE side WHEN 0 THEN 'left' WHEN 1 THEN 'right' ELSE 'full' END, ',' ORDER BY y, side) AS kinds, count(*) FILTER (side < 2) >= 2 AS multi, string_agg(CASE side WHEN 0 THEN '## Vasen palsta' WHEN 1 THEN '## Oikea palsta' ELSE '## Leveä lohko' END || chr(10) || chr(10) || ps, chr(10) || chr(10) ORDER BY y, side) AS md FROM bl GROUP BY doc_id)
SELECT doc_id, CASE WHEN md IS NULL THEN split_part(title, '.', 1)[:120] ELSE title END AS title, coalesce(kinds, 'full') AS kinds, coalesce(multi, false) AS multi, '# ' || trim(CASE WHEN md IS NULL THEN split_part(title, '.', 1)[:120] ELSE title END) || chr(10) || chr(10) || coalesce(md, '## Leveä lohko' || chr(10) || chr(10) || trim(title)) || chr(10) AS markdown FROM tt LEFT JOIN dm USING (doc_id)""",
        "near_blocks": f"""WITH {BLOCKS}, p AS (SELECT a.page, a.pos, b.pos AS other, a.x1, a.y1, a.x2, a.y2, greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) AS dx, greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS dy, a.x2 - a.x1 AS wa, b.x2 - b.x1 AS wb, a.y2 - a.y1 AS ha, b.y2 - b.y1 AS hb,
  greatest(0, greatest(a.x1, b.x1) - least(a.x2, b.x2)) AS gap, abs(a.x1 + a.x2 - b.x1 - b.x2) / 2 AS ox, abs(a.y1 + a.y2 - b.y1 - b.y2) / 2 AS oy FROM blocks a JOIN blocks b ON a.page = b.page AND a.pos < b.pos)
SELECT page, pos, other, round(x1 / 1000, 9) AS rel_x, round(y1 / 1200, 9) AS rel_y, round(wa / 1000, 9) AS rel_w, round(ha / 1200, 9) AS rel_h, least(x1, 699)::INT AS x, least(y1, 599)::INT AS y, greatest(1, least(wa, 700 - least(x1, 699)))::INT AS width, greatest(1, least(ha, 600 - least(y1, 599)))::INT AS height
FROM p WHERE dx * dy > 0.12 * (wa * ha + wb * hb - dx * dy) OR (dy / greatest(1, least(ha, hb)) > 0.35 AND gap < 0.5 * greatest(wa, wb)) OR (ox < 0.6 * greatest(wa, wb) AND oy < 0.6 * greatest(ha, hb))""",
        "language_codes": """WITH d AS (SELECT doc_id, lang, CASE doc_id % 5 WHEN 0 THEN upper(lang) WHEN 1 THEN lang || '_XX' WHEN 2 THEN ' ' || lang || '-yy ' WHEN 3 THEN 'fi' ELSE '' END AS said FROM documents), c AS (SELECT *, split_part(replace(lower(trim(said)), '_', '-'), '-', 1) AS code FROM d)
SELECT doc_id, code, CASE WHEN code IN ('en', 'sv', 'de', 'fr', 'es', 'it', 'nl', 'pl', 'pt', 'da', 'no', 'cs', 'hu', 'ro', 'tr', 'vi', 'id', 'ch') THEN code ELSE 'sv' END AS model, concat_ws(',', nullif(code, ''), CASE WHEN code <> 'sv' THEN 'sv' END, CASE WHEN code <> 'en' THEN 'en' END, CASE WHEN lang NOT IN (code, 'sv', 'en') THEN lang END) AS priority FROM c""",
    }
