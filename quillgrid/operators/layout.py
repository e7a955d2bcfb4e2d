"""Placing zones on a page in points, origin top left, and what a placed page looks like."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..sources.pages import IMAGE_LABELS, PAGE_HEIGHT, PAGE_WIDTH
from .blocks import box

#: Zones from the top down, their least height and the gap below, both as shares of the page's height.
STACK = (("masthead", 0.095, 0.003), ("meta", 0.022, 0.003), ("headline", 0.09, 0.018), ("hero", 0.28, 0.004), ("caption", 0.022, 0.015), ("lower", 0.032, 0.010), ("columns", 0.10, 0.0))
#: Margin by width, gaps' scale, gutter by content width, share of the page that may be used.
MARGIN, GAP_SCALE, GUTTER, USABLE = 0.035, 0.45, 0.012, 0.965
#: Least and largest width by content width.
WIDTHS = {"hero": (0.72, 0.78), "sidebar": (0.18, 0.22), "continuation": (0.20, 0.26)}
#: The caption's and the continuation box's heights, the columns' width.
CAPTION_HEIGHT, CONTINUATION_HEIGHT, COLUMNS_WIDTH = 0.028, 0.028, 0.78
#: The largest gap between two zones, as a share of the page's height, and its warning.
GAPS = (
    ("headline", "hero", 0.045, "headline_to_hero_gap_too_large"), ("hero", "caption", 0.022, "hero_to_caption_gap_too_large"),
    ("caption", "lower", 0.035, "caption_to_lower_headline_gap_too_large"), ("lower", "columns", 0.025, "lower_headline_to_columns_gap_too_large"),
)
#: Largest share of white space, least widths of hero and sidebar.
WHITESPACE, HERO_WIDTH, SIDEBAR_WIDTH = 0.15, 0.70, 0.18


def _fixed(x: float) -> float:
    """A product of fixed values as the decimal number it stands for: else its last bits decide what lies on a limit."""
    return round(x, 9)


def _pdf_height(w: float, h: float) -> float:
    return _fixed(h * G.PDF_WIDTH / w)


def stacked(zones: DataFrame, w: float = PAGE_WIDTH, h: float = PAGE_HEIGHT) -> DataFrame:
    """(page, zone, x, y, w, h, share): zones (page, zone, x, y, w, h relative) one below the other, each at least as high
    as its minimum, the sidebar beside the hero and the continuation box at the columns' foot; what goes beyond the
    usable page is pressed together. share: of the content's width. One aggregation by page, the rest is arithmetic."""
    wide, tall = G.PDF_WIDTH, _pdf_height(w, h)
    margin = _fixed(wide * MARGIN)
    content, top = _fixed(wide - 2 * margin), _fixed(margin * 0.6)
    of = lambda zone, measure: F.max(F.when(F.col("zone") == zone, F.col(measure)))
    rows = zones.groupBy("page").agg(
        *[of(z, "h").alias(f"h_{z}") for z, _, _ in STACK if z != "caption"], F.lit(CAPTION_HEIGHT).alias("h_caption"),
        of("continuation", "h").alias("h_continuation"), *[of(z, "w").alias(f"w_{z}") for z in WIDTHS], of("columns", "y").alias("y_columns"),
    )
    least = {z: m for z, m, _ in STACK} | {"continuation": CONTINUATION_HEIGHT}
    rows = rows.withColumns({f"h_{z}": F.greatest(F.lit(_fixed(tall * m)), F.col(f"h_{z}") * tall) for z, m in least.items()} | {f"w_{z}": G.clamp(F.col(f"w_{z}"), *v) for z, v in WIDTHS.items()})
    rows = rows.withColumn("tight", F.greatest(F.lit(1.0), F.col("w_hero") + F.col("w_sidebar") + GUTTER))
    rows = rows.withColumns({f"w_{z}": F.col(f"w_{z}") / F.col("tight") for z in ("hero", "sidebar")})
    y: Column = F.lit(top)
    tops = {}
    for z, _, gap in STACK:
        tops[z] = F.greatest(y, F.col("y_columns") * tall * 0.98) if z == "columns" else y
        y = y + F.col(f"h_{z}") + _fixed(tall * gap * GAP_SCALE)
    rows = rows.withColumns({f"y_{z}": v for z, v in tops.items()})
    foot = F.col("y_columns") + F.col("h_columns")
    bottom = F.greatest(foot, F.col("y_lower") + F.col("h_lower"))
    rows = rows.withColumn("press", F.least(F.lit(1.0), _fixed(tall * USABLE) / bottom)).withColumn("y_continuation", foot - F.col("h_continuation"))
    shares = {z: F.lit(1.0) for z, _, _ in STACK} | {"columns": F.lit(COLUMNS_WIDTH), "hero": F.col("w_hero"), "sidebar": F.col("w_sidebar"), "caption": F.col("w_hero"), "continuation": F.col("w_continuation")}
    lefts = {"sidebar": margin + (F.col("w_hero") + GUTTER) * content, "continuation": _fixed(wide - margin) - F.col("w_continuation") * content}
    placed, origin = [], _fixed(margin * 0.5)
    for z, share in shares.items():
        beside = "hero" if z == "sidebar" else z
        at = origin + (F.col(f"y_{beside}") - origin) * F.col("press")
        placed.append(F.struct(F.lit(z).alias("zone"), lefts.get(z, F.lit(margin)).alias("x"), at.alias("y"), (share * content).alias("w"), (F.col(f"h_{beside}") * F.col("press")).alias("h"), share.alias("share")))
    return rows.select("page", F.explode(F.array(*placed)).alias("z")).select("page", "z.*")


def visual_metrics(placed: DataFrame, w: float = PAGE_WIDTH, h: float = PAGE_HEIGHT) -> DataFrame:
    """(page, a gap for each of GAPS, whitespace, hero_width, sidebar_width, warnings) of stacked zones; gaps and white
    space are shares of the page's and the content's height."""
    tall, margin = _pdf_height(w, h), _fixed(G.PDF_WIDTH * MARGIN)
    of = lambda zone, value: F.max(F.when(F.col("zone") == zone, value))
    gaps = {f"{a}_{b}": (of(b, F.col("y")) - of(a, F.col("y") + F.col("h"))) / tall for a, b, _, _ in GAPS}
    inner = _fixed(tall - 2 * margin)
    whitespace = F.greatest(F.lit(0.0), inner - (F.max(F.col("y") + F.col("h")) - margin)) / inner
    rows = placed.groupBy("page").agg(*[v.alias(n) for n, v in gaps.items()], whitespace.alias("whitespace"), of("hero", F.col("share")).alias("hero_width"), of("sidebar", F.col("share")).alias("sidebar_width"))
    bad = [(F.col(f"{a}_{b}") > most, name) for a, b, most, name in GAPS]
    bad += [(F.col("whitespace") > WHITESPACE, "total_vertical_whitespace_too_high"), (F.col("hero_width") < HERO_WIDTH, "hero_image_too_narrow"), (F.col("sidebar_width") < SIDEBAR_WIDTH, "sidebar_too_narrow")]
    return rows.withColumn("warnings", F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in bad])), ","))


def photo_scores(blocks: DataFrame, w: float = PAGE_WIDTH, h: float = PAGE_HEIGHT) -> DataFrame:
    """(page, pos, score): the likeliest photo among image blocks of 4 to 55 % of the page, of a photo's aspect and not at
    the page's border on three sides; the first among equals (to 12 places). Points for size, aspect and standing to the left."""
    size = G.area(box()) / (w * h)
    aspect = (F.col("x2") - F.col("x1")) / F.greatest(F.lit(1.0), F.col("y2") - F.col("y1"))
    rows = blocks.where(F.col("label").isin(*IMAGE_LABELS)).where(size.between(0.04, 0.55) & aspect.between(0.35, 2.8) & ~G.touches_border(box(), F.lit(w), F.lit(h)))
    point = lambda c, v: F.when(c, v).otherwise(0.0)
    score = size + point(aspect.between(0.55, 1.8), 0.08) + point(size.between(0.10, 0.30), 0.10) + point(F.col("x1") / w < 0.55, 0.03)
    best = rows.groupBy("page").agg(F.min(F.struct((-F.round(score, 12)).alias("s"), "pos", score.alias("score"))).alias("m"))
    return best.select("page", "m.pos", "m.score")


def round_robin(pars: DataFrame, columns: int = 5) -> DataFrame:
    """(doc_id, column, text): paragraphs (doc_id, n from 1, text) dealt to columns in turn, a blank line between. n comes
    with the rows, so a document's paragraphs need no window."""
    dealt = pars.groupBy("doc_id", ((F.col("n") - 1) % columns).alias("column")).agg(F.array_sort(F.collect_list(F.struct("n", "text"))).alias("p"))
    return dealt.select("doc_id", "column", F.array_join(F.transform("p", lambda s: s["text"]), "\n\n").alias("text"))
