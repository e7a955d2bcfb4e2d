"""DuckDB SQL for the catalog's queries, written apart from the plans."""

from __future__ import annotations

from ..functions.text import DATE_WORDS
from ..lexicon import CLEANUP_ISSUES, FINAL_CORRECTIONS, LITERAL_FIXES
from ..lexicon import CORRECTIONS as PAIRS
from ..operators.blocks import FONT_ROLES, READING_ORDER, ZONE_TYPES, ZONES
from ..operators.quality import DRIFT
from .catalog import CORRECTIONS, SHORT_PHRASES

LINES = "lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS idx FROM documents)"
NOISY = LINES + """,
noisy AS (SELECT doc_id, idx, CASE WHEN (doc_id + idx) % 5 = 0 THEN text || '-' ELSE text END AS text, (12 * idx + 20 * (idx // 4))::DOUBLE AS y_min,
  (12 * idx + 20 * (idx // 4))::DOUBLE + CASE WHEN doc_id % 3 = 0 AND idx % 11 = 0 THEN 24.0 ELSE 10.0 END AS y_max FROM lines)"""


def _dehyphenated(source: str, name: str, wide: bool = False) -> str:
    """Line by line: what has come together so far either ends in '-' and takes in the next line, or is done. wide: boxes'
    left and right edges are joined too."""
    low, high = ("y_min", *["x_min"] * wide), ("y_max", *["x_max"] * wide)
    edges = ", ".join(low + high)
    joined = ", ".join(f"CASE WHEN j THEN {f}(r.{c}, n.{c}) ELSE n.{c} END" for f, cs in (("least", low), ("greatest", high)) for c in cs)
    return f"""{name}_n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS i FROM {source}),
{name}_r AS (SELECT doc_id, i, idx, text, {edges}, 1 AS g FROM {name}_n WHERE i = 1 UNION ALL
  SELECT n.doc_id, n.i, CASE WHEN j THEN r.idx ELSE n.idx END, CASE WHEN j THEN left(rtrim(r.text), length(rtrim(r.text)) - 1) || ltrim(n.text) ELSE n.text END, {joined}, r.g + (NOT j)::INT
  FROM (SELECT *, rtrim(text) LIKE '%-' AS j FROM {name}_r) r JOIN {name}_n n ON n.doc_id = r.doc_id AND n.i = r.i + 1),
{name} AS (SELECT doc_id, idx, text, {edges} FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, g ORDER BY i DESC) AS k FROM {name}_r) WHERE k = 1)"""


def _median(source: str, name: str) -> str:
    return f"""{name}_h AS (SELECT doc_id, list_sort(list(greatest(1.0, y_max - y_min))) AS hs FROM {source} GROUP BY doc_id),
{name} AS (SELECT s.*, greatest(1.0, y_max - y_min) AS height, hs[len(hs) // 2 + 1] AS median FROM {source} s JOIN {name}_h USING (doc_id))"""


def _headline(source: str) -> str:
    return _median(source, "hm") + """,
tall AS (SELECT * FROM hm WHERE height >= 2 * median),
gaps AS (SELECT *, CASE WHEN y_min - lag(y_max) OVER (PARTITION BY doc_id ORDER BY idx) > 2.5 * median THEN 1 ELSE 0 END AS b FROM tall),
runs AS (SELECT *, sum(b) OVER (PARTITION BY doc_id ORDER BY idx) AS run FROM gaps),
totals AS (SELECT doc_id, run, sum(height) AS total FROM runs GROUP BY ALL),
bests AS (SELECT doc_id, arg_min(run, -total * 100000 + run) AS run FROM totals GROUP BY doc_id),
head AS (SELECT runs.* FROM runs JOIN bests USING (doc_id, run))"""


def _paragraphs(source: str) -> str:
    return _median(source, "pm") + """,
pg AS (SELECT *, CASE WHEN y_min - lag(y_max) OVER (PARTITION BY doc_id ORDER BY idx) > 1.25 * median THEN 1 ELSE 0 END AS b FROM pm),
pn AS (SELECT *, sum(b) OVER (PARTITION BY doc_id ORDER BY idx) AS par FROM pg),
pars AS (SELECT doc_id, par::BIGINT AS par, coalesce(string_agg(trim(text), ' ' ORDER BY idx) FILTER (trim(text) <> ''), '') AS text FROM pn GROUP BY doc_id, par)"""


def _signature(t: str) -> str:
    letters = f"length(regexp_replace({t}, '[^\\p{{L}}]', '', 'g'))"
    return f"(length({t}) >= 3 AND {t} LIKE '%.' AND {letters} > 0 AND length(regexp_replace({t}, '[^\\p{{Lu}}]', '', 'g')) >= 0.85 * {letters})"


def _dateline(t: str) -> str:
    words = "|".join(DATE_WORDS)
    return f"(length({t}) > 0 AND NOT {_signature(t)} AND regexp_matches({t}, '\\b(18|19|20)[0-9]{{2}}\\b') AND (contains({t}, ',') OR regexp_matches(lower({t}), '{words}')))"


def _trailing(source: str) -> str:
    both = "trim(two || ' ' || one)"
    return f"""tr AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY idx DESC) AS r, trim(text) AS t FROM {source}),
tl AS (SELECT doc_id, max(t) FILTER (r = 1) AS t1, max(t) FILTER (r = 2) AS t2, max(t) FILTER (r = 3) AS t3 FROM tr GROUP BY doc_id),
ts AS (SELECT doc_id, t1, coalesce({_signature("t1")}, false) AS signed, t2, t3 FROM tl),
td AS (SELECT doc_id, t1, signed, CASE WHEN signed THEN t2 ELSE t1 END AS one, CASE WHEN signed THEN t3 ELSE t2 END AS two FROM ts),
tf AS (SELECT *, coalesce({_dateline("one")}, false) AS single, coalesce({_dateline(both)}, false) AS pair FROM td),
tails AS (SELECT doc_id, CASE WHEN single THEN one WHEN pair THEN {both} END AS dateline, CASE WHEN signed THEN t1 END AS signature,
  signed::INT + CASE WHEN single THEN 1 WHEN pair THEN 2 ELSE 0 END AS used FROM tf)"""


BLOCKS = """lb AS (SELECT l_orderkey AS page, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS pos,
    (l_partkey * 37) % 600 AS x1, (l_partkey * 91 + l_suppkey * 53) % 1150 AS y1, 40 + (l_partkey * 13) % 700 AS w, 10 + (l_suppkey * 11) % 120 AS h, l_partkey,
    CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'paragraph_title' WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'image' ELSE 'text' END AS label FROM lineitem),
blocks AS (SELECT page, pos::INT AS pos, x1::DOUBLE AS x1, y1::DOUBLE AS y1, (x1 + w)::DOUBLE AS x2, (y1 + h)::DOUBLE AS y2, label, p_name AS text FROM lb LEFT JOIN part ON p_partkey = l_partkey)"""
SHIFTED = "shifted AS (SELECT page, pos, x1 + 15 AS x1, y1 + 9 AS y1, x2 + 15 AS x2, y2 + 9 AS y2, label, CASE WHEN pos % 3 = 0 THEN text || ' b' ELSE text END AS text FROM blocks)"


def _case(pairs: dict, key: str, otherwise: str) -> str:
    whens = " ".join(f"WHEN '{k}' THEN {v if isinstance(v, int) else repr(v)}" for k, v in pairs.items())
    return f"CASE {key} {whens} ELSE {otherwise} END"


_TITLE = "(label = 'paragraph_title' OR (bw > 0.55 AND bh > 0.02))"
CLASSIFIED = BLOCKS + f""",
rel AS (SELECT *, y1 / 1200.0 AS ry, (x1 + x2) / 2 / 1000.0 AS rx, (x2 - x1) / 1000.0 AS bw, (y2 - y1) / 1200.0 AS bh FROM blocks),
typed AS (SELECT *, CASE WHEN label = 'image' AND bw * bh > 0.04 THEN 'hero_image' WHEN label = 'image' THEN 'image_caption'
  WHEN ry < 0.08 AND bw > 0.5 AND bh < 0.035 THEN 'issue_meta' WHEN ry < 0.08 AND bw > 0.5 THEN 'masthead_logo'
  WHEN {_TITLE} AND ry < 0.22 THEN 'main_headline' WHEN {_TITLE} AND ry < 0.35 THEN 'secondary_headline' WHEN {_TITLE} AND ry > 0.65 THEN 'bottom_headline'
  WHEN rx > 0.68 AND bw < 0.28 AND ry < 0.8 THEN 'right_sidebar' WHEN ry > 0.68 AND bw < 0.28 THEN 'bottom_columns' WHEN ry > 0.92 THEN 'footer_bar' ELSE 'body_text' END AS block_type FROM rel)"""
SCORED = CLASSIFIED + """,
scores AS (SELECT page, (2 * bool_or(block_type IN ('main_headline', 'secondary_headline'))::INT + 2 * bool_or(block_type = 'hero_image')::INT + 2 * bool_or(block_type = 'right_sidebar')::INT
  + bool_or(block_type = 'bottom_columns')::INT + 1)::INT AS score FROM typed GROUP BY page),
types AS (SELECT page, score, CASE WHEN score >= 4 THEN 'newspaper_front_page' ELSE 'generic' END AS document_type FROM scores)"""
ORDERED = SCORED + f""",
ordered AS (SELECT t.*, (row_number() OVER (PARTITION BY page ORDER BY CASE WHEN paper THEN {_case({t: i for i, t in enumerate(READING_ORDER)}, "block_type", "99")} ELSE 0 END,
  CASE WHEN paper AND block_type = 'bottom_columns' THEN x1 ELSE y1 END, CASE WHEN paper AND block_type = 'bottom_columns' THEN y1 ELSE x1 END, pos) - 1)::INT AS reading_order
  FROM (SELECT typed.*, document_type = 'newspaper_front_page' AS paper FROM typed JOIN types USING (page)) t)"""
ZONED = CLASSIFIED + f""",
zd(zone, dx, dy, dw, dh) AS (VALUES {", ".join(f"('{z}', {b[0]}::DOUBLE, {b[1]}::DOUBLE, {b[2]}::DOUBLE, {b[3]}::DOUBLE)" for z, b in ZONES.items())}),
zs AS (SELECT page, {_case(ZONE_TYPES | {"image_caption": "caption"}, "block_type", "NULL")} AS zone, min(x1) AS a, min(y1) AS b, max(x2) AS c, max(y2) AS d FROM typed
  WHERE block_type NOT IN ('masthead_logo', 'newspaper_name') OR y2 <= 0.16 * 1200 GROUP BY ALL),
zb AS (SELECT p.page, zd.zone, coalesce(a / 1000.0, dx) AS x, coalesce(b / 1200.0, dy) AS y, coalesce((c - a) / 1000.0, dw) AS w, coalesce((d - b) / 1200.0, dh) AS h, a IS NOT NULL AS found
  FROM (SELECT DISTINCT page FROM blocks) p CROSS JOIN zd LEFT JOIN zs ON zs.page = p.page AND zs.zone = zd.zone),
zones AS (FROM zb UNION ALL SELECT zb.page, 'caption', coalesce(a / 1000.0, x), coalesce(b / 1200.0, y + h + 0.004), coalesce((c - a) / 1000.0, w), coalesce((d - b) / 1200.0, 0.028), a IS NOT NULL
  FROM zb LEFT JOIN zs ON zs.page = zb.page AND zs.zone = 'caption' WHERE zb.zone = 'hero')"""
#: Heights and shares by zone, tops one below the other, then all pressed into the usable page.
STACKED = ZONED + """,
zw AS (SELECT page, max(h) FILTER (zone = 'masthead') * 714 AS m0, max(h) FILTER (zone = 'meta') * 714 AS m1, max(h) FILTER (zone = 'headline') * 714 AS m2, max(h) FILTER (zone = 'hero') * 714 AS m3,
  max(h) FILTER (zone = 'lower') * 714 AS m5, max(h) FILTER (zone = 'columns') * 714 AS m6, max(h) FILTER (zone = 'continuation') * 714 AS m7, max(y) FILTER (zone = 'columns') * 714 * 0.98 AS cy,
  least(0.78, greatest(0.72, max(w) FILTER (zone = 'hero'))) AS wh, least(0.22, greatest(0.18, max(w) FILTER (zone = 'sidebar'))) AS ws, least(0.26, greatest(0.20, max(w) FILTER (zone = 'continuation'))) AS wc FROM zones GROUP BY page),
zh AS (SELECT page, cy, greatest(67.83, m0) AS h0, greatest(15.708, m1) AS h1, greatest(64.26, m2) AS h2, greatest(199.92, m3) AS h3, 19.992::DOUBLE AS h4, greatest(22.848, m5) AS h5, greatest(71.4, m6) AS h6, greatest(19.992, m7) AS h7,
  wh / greatest(1.0, wh + ws + 0.012) AS wh, ws / greatest(1.0, wh + ws + 0.012) AS ws, wc FROM zw),
zt AS (SELECT *, 12.495::DOUBLE AS y0, y0 + h0 + 0.9639 AS y1, y1 + h1 + 0.9639 AS y2, y2 + h2 + 5.7834 AS y3, y3 + h3 + 1.2852 AS y4, y4 + h4 + 4.8195 AS y5, greatest(y5 + h5 + 3.213, cy) AS y6, y6 + h6 - h7 AS y7 FROM zh),
zp AS (SELECT *, least(1.0, 689.01 / greatest(y6 + h6, y5 + h5)) AS p FROM zt),
placed AS (SELECT page, u.zone, u.x, 10.4125 + (u.y - 10.4125) * p AS y, u.share * 553.35 AS w, u.h * p AS h, u.share FROM (SELECT page, p, unnest([
  {'zone': 'masthead', 'x': 20.825::DOUBLE, 'y': y0, 'h': h0, 'share': 1.0::DOUBLE}, {'zone': 'meta', 'x': 20.825, 'y': y1, 'h': h1, 'share': 1.0}, {'zone': 'headline', 'x': 20.825, 'y': y2, 'h': h2, 'share': 1.0},
  {'zone': 'hero', 'x': 20.825, 'y': y3, 'h': h3, 'share': wh}, {'zone': 'sidebar', 'x': 20.825 + (wh + 0.012) * 553.35, 'y': y3, 'h': h3, 'share': ws}, {'zone': 'caption', 'x': 20.825, 'y': y4, 'h': h4, 'share': wh},
  {'zone': 'lower', 'x': 20.825, 'y': y5, 'h': h5, 'share': 1.0}, {'zone': 'columns', 'x': 20.825, 'y': y6, 'h': h6, 'share': 0.78}, {'zone': 'continuation', 'x': 574.175 - wc * 553.35, 'y': y7, 'h': h7, 'share': wc}]) AS u FROM zp))"""
SPLIT = BLOCKS + """,
ext AS (SELECT *, max(x2) OVER (PARTITION BY page) - min(x1) OVER (PARTITION BY page) AS extent FROM blocks),
nar AS (SELECT page, pos, extent, (x1 + x2) / 2 AS c FROM ext WHERE x2 - x1 < 0.62 * extent),
nb AS (SELECT *, lag(c) OVER (PARTITION BY page ORDER BY c, pos) AS before, count(*) OVER (PARTITION BY page) AS n FROM nar),
rk AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY c - before DESC, c) AS k FROM nb WHERE before IS NOT NULL AND n >= 3),
split AS (SELECT page, (c + before) / 2 AS split FROM rk WHERE k = 1 AND c - before >= 0.12 * extent)"""
_CUT = "greatest(0, least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1)) * greatest(0, least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1))"


def _iou(a: str, b: str) -> str:
    cut = _CUT.format(a=a, b=b)
    return f"({cut}) / (({a}.x2 - {a}.x1) * ({a}.y2 - {a}.y1) + ({b}.x2 - {b}.x1) * ({b}.y2 - {b}.y1) - ({cut}))"


_MEETS = "least(a.x2, b.x2) > greatest(a.x1, b.x1) AND least(a.y2, b.y2) > greatest(a.y1, b.y1)"
_FINGER = "lower(trim(regexp_replace({}, '\\s+', ' ', 'g')))"


def _corrected() -> str:
    t = "text"
    for bad, good in CORRECTIONS:
        t = f"replace(replace({t}, '{bad}', '{good}'), '{bad.upper()}', '{good.upper()}')"
    return t


def titled(source: str, wide: bool = False) -> str:
    """Titles (tt), what ends a document (tails), and the lines between (kept)."""
    cut120 = "CASE WHEN length(f) > 120 THEN rtrim(left(f, 117)) || '...' ELSE f END"
    return f"""{_headline(source)},
headed AS (SELECT DISTINCT doc_id FROM head), {_dehyphenated("head", "hd")},
ht AS (SELECT doc_id, string_agg(trim(text), ' ' ORDER BY idx) FILTER (trim(text) <> '') AS title FROM hd GROUP BY doc_id),
rest AS (SELECT * FROM {source} ANTI JOIN head USING (doc_id, idx)), {_dehyphenated("rest", "rd", wide)},
num AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS n FROM rd),
tops AS (SELECT doc_id, trim(max(text) FILTER (n = 1)) AS f, max(trim(text)) FILTER (n = 2) AS s FROM num ANTI JOIN headed USING (doc_id) GROUP BY doc_id),
ft AS (SELECT doc_id, CASE WHEN length(f) < 10 AND s IS NOT NULL THEN rtrim(left(trim(f || ' ' || s), 120)) WHEN f = '' THEN 'Asiakirja' ELSE {cut120} END AS title,
  CASE WHEN length(f) < 10 AND s IS NOT NULL THEN 2 ELSE 1 END AS used FROM tops),
body AS (SELECT num.* FROM num LEFT JOIN ft USING (doc_id) WHERE n > coalesce(used, 0)), {_trailing("body")},
kept AS (SELECT tr.* FROM tr JOIN tails USING (doc_id) WHERE r > used), tt AS (SELECT doc_id, title FROM ht UNION ALL SELECT doc_id, title FROM ft)"""


def _replaced(t: str, table: tuple) -> str:
    for bad, good in table:
        for x, y in dict.fromkeys(((bad, good), (bad.upper(), good.upper()))):
            t = "replace({}, '{}', '{}')".format(t, x.replace("\n", "' || chr(10) || '"), y)
    return t


def _finalized(t: str) -> str:
    return f"regexp_replace({_replaced(_replaced(t, PAIRS), FINAL_CORRECTIONS)}, '(?i)\\betta\\b', 'että', 'g')"


def oracle_sql() -> dict[str, str]:
    flowing = f"""WITH RECURSIVE {NOISY}, {titled("noisy")}, {_paragraphs("kept")},
pb AS (SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY par) AS body FROM pars WHERE text <> '' GROUP BY doc_id)
SELECT doc_id, concat_ws(chr(10) || chr(10), '# ' || trim(title), body, dateline, '**' || signature || '**') || chr(10) AS markdown FROM tt LEFT JOIN pb USING (doc_id) LEFT JOIN tails USING (doc_id)"""
    tail = "CASE doc_id % 4 WHEN 0 THEN chr(10) || 'Porvoo, 3 May 1987' WHEN 1 THEN chr(10) || 'OULU 1901,' || chr(10) || 'as told' || chr(10) || 'A. B. EDITOR.' WHEN 2 THEN chr(10) || 'THE BOARD.' ELSE '' END"
    cover = _CUT.format(a="a", b="b")
    tries = ", ".join(f"({i}, '{x}')" for i, x in enumerate(("en", "de", "fr", "es")))
    drift = ", ".join(f"('{z}', '{m}', {t}::DOUBLE)" for z, m, t in DRIFT)
    fold = "translate({}, 'äö', 'ao')".format(_FINGER.format("text"))
    norm = "trim(regexp_replace(regexp_replace(lower(text), '[^\\p{L}\\p{N}_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
    noise = "regexp_replace(text, ' (the|de|la) ', '-' || chr(10) || '\\1 ', 'g') || chr(173) || chr(1) || ' kasvol etta' || chr(10) || ' 1 mk (sis. lvv ' || chr(10) || 'pelätään. vielä on- nettomuus'"
    clean = f"nfc_normalize(regexp_replace(replace({_finalized('t')}, chr(173), ''), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F\\x{{FFFD}}]', '', 'g'))"
    for _ in range(4):
        clean = f"regexp_replace(regexp_replace({clean}, '([\\p{{L}}\\p{{N}}_]{{2,}})-\\s*\\n\\s*([\\p{{L}}\\p{{N}}_]{{2,}})', '\\1\\2', 'g'), '([\\p{{L}}\\p{{N}}_]{{2,}})-\\s+([\\p{{L}}\\p{{N}}_]{{2,}})', '\\1\\2', 'g')"
    clean = _replaced(clean, LITERAL_FIXES)
    price = "CASE WHEN contains(lower(l), 'mk') AND contains(lower(l), 'sis.') AND contains(l, '(') AND NOT contains(l, ')') THEN regexp_replace(l, '\\s*$', '') || ')' || regexp_extract(l, '\\s*$') ELSE l END"
    issues = [("control_or_replacement_chars", "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F\\x{FFFD}]"), ("soft_hyphen_present", "\\x{AD}"), *((n, f"(?i){p}") for n, p in CLEANUP_ISSUES)]
    found = ", ".join(f"CASE WHEN regexp_matches(t, '{p}') THEN '{n}' END" for n, p in issues)
    ocr = f"""dl AS (SELECT doc_id, unnest(string_split('# Title ' || doc_id || chr(10) || chr(10) || '---' || chr(10) || '## Part' || chr(10) || '> a' || chr(10) || '> b' || chr(10) || chr(10) || text, chr(10))) AS line,
  generate_subscripts(string_split('# Title ' || doc_id || chr(10) || chr(10) || '---' || chr(10) || '## Part' || chr(10) || '> a' || chr(10) || '> b' || chr(10) || chr(10) || text, chr(10)), 1) AS idx FROM documents)"""
    return {
        "doc_flowing_markdown": flowing,
        "line_dehyphenate": f"WITH RECURSIVE {NOISY}, {_dehyphenated('noisy', 'd')} SELECT doc_id, idx, text, y_min, y_max FROM d",
        "paragraph_groups": f"WITH {NOISY}, {_paragraphs('noisy')} SELECT * FROM pars",
        "headline_runs": f"WITH {NOISY}, {_headline('noisy')} SELECT doc_id, idx, text FROM head",
        "trailing_signature_dateline": f"WITH {LINES.replace('text, chr(10)', f'text || {tail}, chr(10)')}, {_trailing('lines')} SELECT doc_id, dateline, signature FROM tails",
        "line_fingerprint_dedup": f"WITH {LINES}, f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, {_FINGER.format('text')} ORDER BY idx) AS k FROM lines WHERE {_FINGER.format('text')} <> '') SELECT doc_id, idx, text FROM f WHERE k = 1",
        "column_split": f"WITH {SPLIT} SELECT * FROM split",
        "column_assign": f"WITH {SPLIT} SELECT page, pos, CASE WHEN split IS NULL OR x2 - x1 >= 0.62 * extent THEN 'full' WHEN (x1 + x2) / 2 < split THEN 'left' ELSE 'right' END AS side FROM ext LEFT JOIN split USING (page)",
        "classify_blocks": f"WITH {CLASSIFIED} SELECT page, pos, block_type, {_case(FONT_ROLES, 'block_type', repr('body'))} AS font_role, CASE block_type WHEN 'hero_image' THEN 'image' WHEN 'continuation_box' THEN 'box' ELSE 'text' END AS render_mode FROM typed",
        "page_type_score": f"WITH {SCORED} SELECT * FROM types",
        "reading_order": f"WITH {ORDERED} SELECT page, pos, reading_order FROM ordered",
        "photo_candidate": f"WITH {BLOCKS}, k AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY (x2 - x1) * (y2 - y1) DESC, pos) AS k FROM blocks WHERE label = 'image' AND (x2 - x1) * (y2 - y1) BETWEEN 20000 AND 550000) SELECT page, pos, x1::INT AS x, y1::INT AS y, (x2 - x1)::INT AS width, (y2 - y1)::INT AS height FROM k WHERE k = 1",
        "zone_union": f"WITH {ZONED} SELECT * FROM zones",
        "zone_stacking": f"WITH {STACKED} SELECT page, zone, round(x, 6) AS x, round(y, 6) AS y, round(w, 6) AS w, round(h, 6) AS h, round(share, 6) AS share FROM placed",
        "visual_layout_metrics": f"""WITH {STACKED}, g AS (SELECT page, max(y) FILTER (zone = 'hero') AS ph, max(y + h) FILTER (zone = 'hero') AS bh, max(y + h) FILTER (zone = 'headline') AS be, max(y) FILTER (zone = 'caption') AS pc, max(y + h) FILTER (zone = 'caption') AS bc,
  max(y) FILTER (zone = 'lower') AS pl, max(y + h) FILTER (zone = 'lower') AS bl, max(y) FILTER (zone = 'columns') AS pk, max(y + h) AS used, max(share) FILTER (zone = 'hero') AS hero_width, max(share) FILTER (zone = 'sidebar') AS sidebar_width FROM placed GROUP BY page),
v AS (SELECT page, (ph - be) / 714 AS headline_hero, (pc - bh) / 714 AS hero_caption, (pl - bc) / 714 AS caption_lower, (pk - bl) / 714 AS lower_columns, greatest(0, 672.35 - (used - 20.825)) / 672.35 AS whitespace, hero_width, sidebar_width FROM g)
SELECT page, concat_ws(',', CASE WHEN headline_hero > 0.045 THEN 'headline_to_hero_gap_too_large' END, CASE WHEN hero_caption > 0.022 THEN 'hero_to_caption_gap_too_large' END, CASE WHEN caption_lower > 0.035 THEN 'caption_to_lower_headline_gap_too_large' END,
  CASE WHEN lower_columns > 0.025 THEN 'lower_headline_to_columns_gap_too_large' END, CASE WHEN whitespace > 0.15 THEN 'total_vertical_whitespace_too_high' END, CASE WHEN hero_width < 0.70 THEN 'hero_image_too_narrow' END, CASE WHEN sidebar_width < 0.18 THEN 'sidebar_too_narrow' END) AS warnings,
  round(headline_hero, 6) AS headline_hero, round(hero_caption, 6) AS hero_caption, round(caption_lower, 6) AS caption_lower, round(lower_columns, 6) AS lower_columns, round(whitespace, 6) AS whitespace, round(hero_width, 6) AS hero_width, round(sidebar_width, 6) AS sidebar_width FROM v""",
        "photo_scores": f"""WITH {BLOCKS}, a AS (SELECT *, (x2 - x1) * (y2 - y1) / 490000 AS s, (x2 - x1) / greatest(1, y2 - y1) AS r, (x1 <= 8)::INT + (y1 <= 8)::INT + (x2 >= 692)::INT + (y2 >= 692)::INT AS sides FROM blocks WHERE label = 'image'),
p AS (SELECT page, pos, s + CASE WHEN r BETWEEN 0.55 AND 1.8 THEN 0.08 ELSE 0 END + CASE WHEN s BETWEEN 0.10 AND 0.30 THEN 0.10 ELSE 0 END + CASE WHEN x1 < 385 THEN 0.03 ELSE 0 END AS score FROM a WHERE s BETWEEN 0.04 AND 0.55 AND r BETWEEN 0.35 AND 2.8 AND sides < 3)
SELECT page, pos, round(score, 9) AS score FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY round(score, 12) DESC, pos) AS k FROM p) WHERE k = 1""",
        "round_robin_columns": f"WITH {LINES} SELECT doc_id, (idx % 5)::INT AS \"column\", string_agg(text, chr(10) || chr(10) ORDER BY idx) AS text FROM lines GROUP BY ALL",
        "text_coverage_crop_policy": f"WITH {BLOCKS}, c AS (SELECT a.page, a.pos, least(1.0, coalesce(sum(CASE WHEN b.page IS NOT NULL THEN {cover} END), 0) / any_value((a.x2 - a.x1) * (a.y2 - a.y1))) AS coverage FROM blocks a LEFT JOIN blocks b ON a.page = b.page AND b.label <> 'image' AND trim(coalesce(b.text, '')) <> '' WHERE a.label = 'image' GROUP BY a.page, a.pos) SELECT *, coverage <= 0.15 AS can_crop FROM c",
        "bbox_pdf_coords": f"WITH {BLOCKS} SELECT page, pos, round(x1 * 0.595, 6) AS px1, round(714.0 - y2 * 0.595, 6) AS py1, round(x2 * 0.595, 6) AS px2, round(714.0 - y1 * 0.595, 6) AS py2 FROM blocks",
        "caption_candidates_topk": f"""WITH {BLOCKS}, hero AS (SELECT page, x1 AS hx1, x2 AS hx2, y2 AS hy2 FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY (x2 - x1) * (y2 - y1) DESC, pos) AS k FROM blocks WHERE label = 'image') WHERE k = 1),
s AS (SELECT page, pos, CASE WHEN trim(coalesce(text, '')) = '' THEN -10.0 ELSE CASE WHEN y1 >= hy2 - 24 THEN 3.0 ELSE 0 END + CASE WHEN (x2 - x1) / (hx2 - hx1) BETWEEN 0.45 AND 1.6 THEN 2.0 ELSE 0 END - CASE WHEN (y1 + y2) / 2 > 744 THEN 5.0 ELSE 0 END
  + CASE WHEN y2 - y1 < 60 THEN 2.0 ELSE 0 END + 2.0 * contains(lower(text), 'blue')::INT + 2.0 * contains(lower(text), 'steel')::INT - CASE WHEN contains(upper(text), 'RED') THEN 5.0 ELSE 0 END - CASE WHEN contains(upper(text), 'GREEN') THEN 5.0 ELSE 0 END
  - CASE WHEN length(trim(text)) > 220 THEN 2.0 ELSE 0 END END::DOUBLE AS score FROM blocks JOIN hero USING (page) WHERE label <> 'image')
SELECT page, pos, score FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY score DESC, pos) AS k FROM s) WHERE k = 1 AND score >= 1.0""",
        "role_segments": f"WITH {ORDERED}, r AS (SELECT page, {_case(ZONE_TYPES | {'image_caption': 'caption'}, 'block_type', 'NULL')} AS role, reading_order, text FROM ordered) SELECT page, role, string_agg(text, chr(10) ORDER BY reading_order) AS text FROM r WHERE role IS NOT NULL AND trim(coalesce(text, '')) <> '' GROUP BY page, role",
        "iou_text_merge": f"""WITH {BLOCKS}, {SHIFTED}, p AS (SELECT a.page, a.pos, b.text, {_iou("a", "b")} AS iou, row_number() OVER (PARTITION BY a.page, a.pos ORDER BY {_iou("a", "b")} DESC, b.pos) AS k FROM blocks a JOIN shifted b ON a.page = b.page AND {_MEETS})
SELECT page, pos, CASE WHEN p.iou >= 0.15 THEN p.text ELSE blocks.text END AS text, round(coalesce(p.iou, 0), 9) AS iou FROM blocks LEFT JOIN (FROM p WHERE k = 1) p USING (page, pos)""",
        "unmatched_blocks_anti": f"WITH {BLOCKS}, {SHIFTED} SELECT page, pos, text FROM shifted b WHERE length(trim(coalesce(text, ''))) >= 4 AND NOT EXISTS (FROM blocks a WHERE a.page = b.page AND a.pos % 2 = 0 AND {_MEETS} AND {_iou('a', 'b')} >= 0.12)",
        "paragraph_zip_merge": f"WITH {LINES}, m AS (SELECT doc_id, least(3, max(idx) + 1) AS last FROM lines GROUP BY doc_id) SELECT doc_id, least(idx + 1, last) AS n, string_agg(text, chr(10) ORDER BY idx) AS text FROM lines JOIN m USING (doc_id) GROUP BY ALL",
        "engine_conflicts": f"""WITH d AS (SELECT doc_id, string_split(text, chr(10))[1] AS t, text FROM documents)
SELECT doc_id, 'title' AS type, 'first' AS resolution FROM d WHERE doc_id % 4 = 0 AND trim(t) <> '' AND {_FINGER.format("t")} <> {_FINGER.format("t || ' x'")}
UNION ALL SELECT doc_id, 'text', 'first' FROM d WHERE doc_id % 5 = 0 AND trim(text) <> '' UNION ALL SELECT doc_id, 'layout', 'second' FROM d WHERE doc_id % 3 = 1""",
        "engine_blend_confidence": "SELECT doc_id, (0.5 + 0.25 * quality + CASE WHEN toxic = 0 THEN 0.75 ELSE 0 END)::DOUBLE / (1 + (toxic = 0)::INT) AS confidence FROM labels",
        "language_argmax": f"""WITH a(attempt, lang) AS (VALUES {tries}), t AS (SELECT doc_id, attempt, a.lang, CASE WHEN d.lang = a.lang THEN 0.92::DOUBLE ELSE 0.0 END + ((doc_id * (attempt + 3)) % 17) / 100.0::DOUBLE AS confidence FROM documents d CROSS JOIN a),
m AS (SELECT *, coalesce(bool_or(confidence >= 0.9) OVER (PARTITION BY doc_id ORDER BY attempt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS done FROM t),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, attempt DESC) AS k FROM m WHERE NOT done) SELECT doc_id, lang, round(confidence, 6) AS confidence FROM r WHERE k = 1""",
        "lowconf_fallback": f"WITH {LINES}, s AS (SELECT doc_id, ((doc_id * 7 + idx * 13) % 100) / 100.0::DOUBLE AS score FROM lines), g AS (SELECT doc_id, avg(score) AS c, avg((score < 0.6)::INT) AS l FROM s GROUP BY doc_id) SELECT doc_id, round(c, 6) AS confidence, round(l, 6) AS low_share, c < 0.6 OR l > 0.2 AS fallback FROM g",
        "quality_gate": "WITH c AS (SELECT doc_id, length(text) <= 20 AS a, length(text) - length(replace(text, '@', '')) > 1 AS b, length(text) >= 4000 AS w FROM documents) SELECT doc_id, CASE WHEN a OR b THEN 'FAIL' WHEN w THEN 'PASS_WITH_WARNINGS' ELSE 'PASS' END AS status, (a::INT + b::INT + w::INT)::BIGINT AS n_failed FROM c",
        "layout_drift": f"WITH {ZONED}, l(zone, measure, lim) AS (VALUES {drift}), d AS (SELECT page, zone, measure, lim, CASE measure WHEN 'w' THEN abs(w - greatest(0.18, least(0.72, w))) ELSE abs(h - greatest(0.09, h)) END AS difference FROM zones JOIN l USING (zone)) SELECT page, zone, measure, round(difference, 9) AS difference, difference > lim AS warning FROM d",
        "phrase_coverage_audit": f"""WITH q AS (SELECT item_id, text FROM benchmark UNION ALL SELECT * FROM (VALUES {", ".join(f"({i}, '{p}')" for i, p in SHORT_PHRASES)})),
k AS (SELECT item_id, {fold} AS phrase FROM q), d AS (SELECT {fold} AS t FROM documents) SELECT item_id, (SELECT count(*) FROM d WHERE contains(t, phrase)) AS n_docs FROM k""",
        "exact_text_dedup": f"""WITH {BLOCKS}, b AS (SELECT page // 50 AS page, text, (row_number() OVER (PARTITION BY page // 50 ORDER BY x1, y1, x2, y2, label, text))::INT AS pos FROM blocks), n AS (SELECT *, {norm} AS norm, length(trim(text)) + 17.0 AS q FROM b)
SELECT page, pos, first_value(pos) OVER (PARTITION BY page, norm ORDER BY q DESC, pos) AS kept_pos FROM n WHERE norm <> ''""",
        "correction_table_apply": f"SELECT doc_id, md5({_corrected()}) AS digest FROM documents",
        "final_text_cleanup": f"""WITH d AS (SELECT doc_id, {noise} AS t FROM documents), c AS (SELECT doc_id, t, {clean} AS c FROM d),
e AS (SELECT doc_id, t, array_to_string(list_transform(string_split(c, chr(10)), lambda l: {price}), chr(10)) AS e FROM c)
SELECT doc_id, md5(regexp_replace(e, '^\\s+|\\s+$', '', 'g')) AS digest, array_to_string(list_filter([{found}], lambda x: x IS NOT NULL), ',') AS issues FROM e""",
        "phrase_context": """WITH a AS (SELECT doc_id, text, strpos(lower(text), 'license') AS i FROM documents)
SELECT doc_id, CASE WHEN i > 0 THEN regexp_replace(substring(text, greatest(1, i - 60), i + 67 - greatest(1, i - 60)), '^\\s+|\\s+$', '', 'g') ELSE '' END AS context FROM a""",
        "mojibake_repair": """SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN replace(replace(text, '–', '-'), '—', '-') || ' pÃ¤ivÃ¤Ã¤ - ' WHEN 1 THEN CASE WHEN regexp_full_match(text, '[\\x00-\\x7F]*') THEN text || ' päivä é' ELSE replace(replace(text, '–', '-'), '—', '-') || ' pÃ¤ivÃ¤ Ã©' END ELSE text END AS text FROM documents""",
        "markdown_elements": f"""WITH {ocr}, s AS (SELECT doc_id, idx, trim(line) AS s FROM dl),
k AS (SELECT *, CASE WHEN s = '' THEN 'blank' WHEN regexp_matches(s, '^(---+|\\*\\*\\*+)$') THEN 'hr' WHEN s LIKE '## %' THEN 'h2' WHEN s LIKE '# %' THEN 'h1' WHEN s LIKE '> %' THEN 'quote' ELSE 'p' END AS kind FROM s),
b AS (SELECT *, (kind <> 'blank' AND (kind IN ('hr', 'h1', 'h2') OR kind <> coalesce(lag(kind) OVER (PARTITION BY doc_id ORDER BY idx), 'blank')))::INT AS st FROM k), g AS (SELECT *, sum(st) OVER (PARTITION BY doc_id ORDER BY idx) AS n FROM b)
SELECT doc_id, n::BIGINT AS n, any_value(kind) AS kind, string_agg(CASE kind WHEN 'hr' THEN '' WHEN 'h2' THEN s[4:] WHEN 'h1' THEN s[3:] WHEN 'quote' THEN s[3:] ELSE s END, ' ' ORDER BY idx) AS text FROM g WHERE kind <> 'blank' GROUP BY doc_id, n""",
        "page_consolidate": "WITH p AS (SELECT conv_id, turn, min(text) AS text FROM conversations GROUP BY ALL) SELECT conv_id AS doc_id, string_agg('<!-- page: ' || turn || ' -->' || chr(10) || chr(10) || text, chr(10) || chr(10) ORDER BY turn) || chr(10) AS markdown FROM p WHERE text IS NOT NULL AND trim(text) <> '' GROUP BY conv_id",
    }
