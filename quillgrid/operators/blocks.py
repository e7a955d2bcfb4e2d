"""Blocks of a page: page, pos, label, text, x1, y1, x2, y2. Every operator is one window or aggregation by page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as T
from ..lexicon import FRONT_PAGE, Lexicon
from ..sources.pages import IMAGE_LABELS, PAGE_HEIGHT, PAGE_WIDTH, SKIP_LABELS, TITLE_LABELS
from .frontpage import caption_score

#: Block types in newspaper reading order.
READING_ORDER = (
    "masthead_logo", "newspaper_name", "issue_meta", "main_headline", "secondary_headline", "image_caption", "right_sidebar",
    "body_text", "bottom_headline", "bottom_columns", "continuation_box", "footer_bar", "margin_artifact", "unknown",
)
#: Font roles by type; the others are body.
FONT_ROLES = {
    "masthead_logo": "masthead", "newspaper_name": "masthead", "main_headline": "headline", "secondary_headline": "headline",
    "bottom_headline": "headline", "image_caption": "caption", "issue_meta": "meta", "continuation_box": "meta",
}
#: Patterns, in lower case, of what names a newspaper and of what tells where a story goes on.
NAME_WORDS, CONTINUATION_WORDS = "kuva|sanomat", "jatkuu"
#: Relative x, y, width, height of zones that a page doesn't show; a caption lies under the hero then.
ZONES = {
    "masthead": (0.04, 0.02, 0.92, 0.11), "meta": (0.04, 0.13, 0.92, 0.035), "headline": (0.04, 0.17, 0.92, 0.14), "hero": (0.04, 0.33, 0.58, 0.36),
    "sidebar": (0.66, 0.33, 0.28, 0.36), "lower": (0.04, 0.72, 0.92, 0.05), "columns": (0.04, 0.78, 0.78, 0.16), "continuation": (0.72, 0.90, 0.22, 0.035),
}
CAPTION_GAP, CAPTION_HEIGHT, MASTHEAD_BOTTOM = 0.004, 0.028, 0.16
#: zones' block types.
ZONE_TYPES = {
    "masthead_logo": "masthead", "newspaper_name": "masthead", "issue_meta": "meta", "main_headline": "headline", "secondary_headline": "headline",
    "hero_image": "hero", "right_sidebar": "sidebar", "bottom_headline": "lower", "bottom_columns": "columns", "continuation_box": "continuation",
}


def box() -> Column:
    return G.box("x1", "y1", "x2", "y2")


def looked_up(pairs: dict[str, object], key: Column, otherwise: object) -> Column:
    """pairs' value for key. A constant map, so that key, which may be a long rule cascade, stands in the plan once."""
    table = F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])
    return F.coalesce(F.try_element_at(table, key), F.lit(otherwise))


def classify(blocks: DataFrame, name_words: str = NAME_WORDS, continuation_words: str = CONTINUATION_WORDS, w: float = PAGE_WIDTH, h: float = PAGE_HEIGHT) -> DataFrame:
    """Adds block_type, font_role and render_mode: the first rule that holds, by label, place, size and keywords."""
    ry, rx = F.col("y1") / h, (F.col("x1") + F.col("x2")) / 2 / w
    bw, bh = (F.col("x2") - F.col("x1")) / w, (F.col("y2") - F.col("y1")) / h
    image, low = F.col("label").isin(*IMAGE_LABELS), F.lower(F.coalesce("text", F.lit("")))
    title = F.col("label").isin(*TITLE_LABELS) | ((bw > 0.55) & (bh > 0.02))
    top = (ry < 0.08) & (bw > 0.5)
    kind = (
        F.when(image & (bw * bh > 0.04), "hero_image").when(image, "image_caption")
        .when(low.rlike(continuation_words) & (ry > 0.75), "continuation_box")
        .when(top & (bh < 0.035), "issue_meta").when(top & low.rlike(name_words), "newspaper_name").when(top, "masthead_logo")
        .when(title & (ry < 0.22), "main_headline").when(title & (ry < 0.35), "secondary_headline").when(title & (ry > 0.65), "bottom_headline")
        .when((rx > 0.68) & (bw < 0.28) & (ry < 0.8), "right_sidebar").when((ry > 0.68) & (bw < 0.28), "bottom_columns")
        .when(ry > 0.92, "footer_bar").otherwise("body_text")
    )
    t = F.col("block_type")
    return blocks.withColumn("block_type", kind).withColumn("font_role", looked_up(FONT_ROLES, t, "body")).withColumn("render_mode", F.when(t == "hero_image", "image").when(t == "continuation_box", "box").otherwise("text"))


def page_types(blocks: DataFrame, w: float = PAGE_WIDTH, h: float = PAGE_HEIGHT) -> DataFrame:
    """(page, score, document_type) of classified blocks: a newspaper front page from 4 points."""
    has = lambda *t: F.max(F.col("block_type").isin(*t).cast("int"))
    shape = 1 if 0.65 <= w / h <= 1.4 else 0
    score = 2 * has("main_headline", "secondary_headline") + 2 * has("hero_image") + 2 * has("right_sidebar") + has("bottom_columns") + shape
    return blocks.groupBy("page").agg(score.alias("score")).withColumn("document_type", F.when(F.col("score") >= 4, "newspaper_front_page").otherwise("generic"))


def reading_order(blocks: DataFrame) -> DataFrame:
    """Adds reading_order, from 0: newspapers by type's rank, columns from left to right; other pages from top down."""
    types = page_types(blocks).select("page", "document_type")
    paper, columns = F.col("document_type") == "newspaper_front_page", F.col("block_type") == "bottom_columns"
    rank = F.when(paper, looked_up({t: i for i, t in enumerate(READING_ORDER)}, F.col("block_type"), 99)).otherwise(0)
    one, two = F.when(paper & columns, F.col("x1")).otherwise(F.col("y1")), F.when(paper & columns, F.col("y1")).otherwise(F.col("x1"))
    order = Window.partitionBy("page").orderBy(rank, one, two, "pos")
    return blocks.join(types, "page").withColumn("reading_order", F.row_number().over(order) - 1).drop("document_type")


def column_split(blocks: DataFrame, narrow: float = 0.62, least_gap: float = 0.12, least: int = 3) -> DataFrame:
    """(page, split): the middle of the widest gap between centres of narrow blocks, the first among equals; only for
    pages with `least` of them and a gap of `least_gap` of the page's extent."""
    extent = Window.partitionBy("page")
    rows = blocks.withColumn("extent", F.max("x2").over(extent) - F.min("x1").over(extent)).where((F.col("x2") - F.col("x1")) < narrow * F.col("extent"))
    rows = rows.withColumn("c", (F.col("x1") + F.col("x2")) / 2)
    order = Window.partitionBy("page").orderBy("c", "pos")
    rows = rows.withColumn("before", F.lag("c").over(order)).withColumn("n", F.count("*").over(extent)).withColumn("gap", F.col("c") - F.col("before"))
    best = rows.where(F.col("before").isNotNull() & (F.col("n") >= least)).groupBy("page").agg(F.min(F.struct(-F.col("gap"), "c", F.col("before").alias("b"), "extent")).alias("m"))
    gap = F.col("m.c") - F.col("m.b")
    return best.where(gap >= least_gap * F.col("m.extent")).select("page", ((F.col("m.c") + F.col("m.b")) / 2).alias("split"))


def assign_columns(blocks: DataFrame, narrow: float = 0.62) -> DataFrame:
    """Adds side: full for wide blocks and pages without a split, else left or right of it."""
    extent = Window.partitionBy("page")
    rows = blocks.withColumn("extent", F.max("x2").over(extent) - F.min("x1").over(extent)).join(column_split(blocks, narrow), "page", "left")
    wide = F.col("split").isNull() | ((F.col("x2") - F.col("x1")) >= narrow * F.col("extent"))
    side = F.when(wide, "full").when((F.col("x1") + F.col("x2")) / 2 < F.col("split"), "left").otherwise("right")
    return rows.withColumn("side", side).drop("extent", "split")


def photo_candidates(blocks: DataFrame, w: float = PAGE_WIDTH) -> DataFrame:
    """(page, pos, rect): the largest image block whose area is 2 to 55 % of the page's width squared; first of equals."""
    size = G.area(box())
    rows = blocks.where(F.col("label").isin(*IMAGE_LABELS)).withColumn("area", size).where((F.col("area") >= 0.02 * w * w) & (F.col("area") <= 0.55 * w * w))
    best = rows.groupBy("page").agg(F.min(F.struct(-F.col("area"), "pos", box().alias("box"))).alias("m"))
    return best.select("page", F.col("m.pos").alias("pos"), G.crop_rect(F.col("m.box")).alias("rect"))


def zones(blocks: DataFrame, w: float = PAGE_WIDTH, h: float = PAGE_HEIGHT) -> DataFrame:
    """(page, zone, x, y, w, h, found): the relative box around each zone's classified blocks, or the zone's default; a
    caption that isn't found lies under the hero. Masthead blocks count in the page's top 16 % only. One aggregation by
    page."""
    types: dict[str, list[str]] = {}
    for t, z in (ZONE_TYPES | {"image_caption": "caption"}).items():
        types.setdefault(z, []).append(t)
    edges = (("a", F.min, "x1"), ("b", F.min, "y1"), ("c", F.max, "x2"), ("d", F.max, "y2"))

    def there(z: str) -> Column:
        inside = F.col("block_type").isin(*types[z])
        return inside & (F.col("y2") <= MASTHEAD_BOTTOM * h) if z == "masthead" else inside

    rows = blocks.groupBy("page").agg(*[f(F.when(there(z), F.col(c))).alias(f"{z}_{n}") for z in types for n, f, c in edges])
    box_of = {z: dict(zip("xywh", v, strict=True)) for z, v in ZONES.items()}
    seen = lambda z: {"x": F.col(f"{z}_a") / w, "y": F.col(f"{z}_b") / h, "w": (F.col(f"{z}_c") - F.col(f"{z}_a")) / w, "h": (F.col(f"{z}_d") - F.col(f"{z}_b")) / h}
    at = {z: {n: F.coalesce(v, F.lit(box_of[z][n])) for n, v in seen(z).items()} for z in box_of}
    hero = at["hero"]
    under = {"x": hero["x"], "y": hero["y"] + hero["h"] + CAPTION_GAP, "w": hero["w"], "h": F.lit(CAPTION_HEIGHT)}
    at["caption"] = {n: F.coalesce(v, under[n]) for n, v in seen("caption").items()}
    every = F.array(*[F.struct(F.lit(z).alias("zone"), *[v.alias(n) for n, v in of.items()], F.col(f"{z}_a").isNotNull().alias("found")) for z, of in at.items()])
    return rows.select("page", F.explode(every).alias("z")).select("page", "z.*")


#: Roles that may be cut out as images; parts of names of roles that are text; text that a crop may hold,
#: as a share of its area, and of its own text as letters if that is longer than so many characters.
PHOTO_ROLES = ("hero_image", "photo", "illustration", "map", "figure")
TEXT_ROLES = ("text", "headline", "masthead", "meta", "caption", "body", "continuation", "sidebar", "newspaper", "issue", "footer")
MOST_TEXT, MOST_LETTERS, CHARS = 0.15, 0.35, 12


def can_crop(role: Column, coverage: Column, text: Column, render_text_as_image: bool = False, allow_text_crops: bool = False, allow_photo_crops: bool = True) -> Column:
    """Whether a region may be cut out as an image: a photo's role, hardly any text over it, and hardly any letters in its
    own. Nothing may if text is drawn as images, or photos aren't cut out."""
    if render_text_as_image or allow_text_crops or not allow_photo_crops:
        return F.lit(False)
    low, said = F.lower(role), F.coalesce(text, F.lit(""))
    texty = F.lit(False)
    for part in TEXT_ROLES:
        texty |= F.contains(low, F.lit(part))
    letters = F.length(F.regexp_replace(said, r"[^\p{L}]", "")) / F.greatest(F.length(said), F.lit(1))
    wordy = (F.length(T.strip(said)) > CHARS) & (letters > MOST_LETTERS)
    return ~texty & low.isin(*PHOTO_ROLES) & (coverage <= MOST_TEXT) & ~wordy


def crop_policy(blocks: DataFrame, **policy: bool) -> DataFrame:
    """(page, pos, block_type, coverage, can_crop) of classified blocks: coverage is the common area with all blocks of the
    page that hold text, by the block's own area, 1 at most (1 for no area). Only heroes are joined with others."""
    heroes = blocks.where(F.col("block_type") == "hero_image").select("page", "pos", box().alias("a"))
    texts = blocks.where(T.strip(F.coalesce("text", F.lit(""))) != "").select("page", box().alias("b"))
    common = F.coalesce(F.sum(F.when(F.col("b").isNotNull(), G.intersection(F.col("a"), F.col("b")))), F.lit(0.0))
    covered = heroes.join(texts, "page", "left").groupBy("page", "pos", "a").agg(common.alias("common"))
    share = F.when(G.area(F.col("a")) > 0, F.least(F.lit(1.0), F.col("common") / G.area(F.col("a")))).otherwise(1.0)
    covered = covered.select("page", "pos", share.alias("coverage"))
    rows = blocks.select("page", "pos", "block_type", "text").join(covered, ["page", "pos"], "left")
    allowed = F.coalesce(can_crop(F.col("block_type"), F.col("coverage"), F.col("text"), **policy), F.lit(False))
    return rows.select("page", "pos", "block_type", "coverage", ((F.col("block_type") == "hero_image") & allowed).alias("can_crop"))


def text_coverage(blocks: DataFrame) -> DataFrame:
    """(page, pos, coverage, can_crop) of image blocks: the common area with blocks of text by their own, 1 at most; 1 for
    no area. Text blocks' overlaps count each. A crop may hold 15 % of text."""
    a = blocks.where(F.col("label").isin(*IMAGE_LABELS)).select("page", "pos", box().alias("a"))
    b = blocks.where(~F.col("label").isin(*IMAGE_LABELS) & (F.trim(F.coalesce("text", F.lit(""))) != "")).select("page", box().alias("b"))
    common = F.coalesce(F.sum(F.when(F.col("b").isNotNull(), G.intersection(F.col("a"), F.col("b")))), F.lit(0.0))
    rows = a.join(b, "page", "left").groupBy("page", "pos", "a").agg(common.alias("common"))
    share = F.when(G.area(F.col("a")) > 0, F.least(F.lit(1.0), F.col("common") / G.area(F.col("a")))).otherwise(1.0)
    return rows.select("page", "pos", share.alias("coverage"), (share <= 0.15).alias("can_crop"))


def caption_candidates(blocks: DataFrame, words: Lexicon = FRONT_PAGE, w: float = PAGE_WIDTH, h: float = PAGE_HEIGHT) -> DataFrame:
    """(page, pos, score): the best-scored block (frontpage.caption_score) as the caption of the page's largest image, if 1
    or more; the first among equals."""
    image = F.col("label").isin(*IMAGE_LABELS)
    hero = F.min(F.when(image, F.struct((-G.area(box())).alias("s"), "pos", "x1", "y1", "x2", "y2"))).over(Window.partitionBy("page"))
    rows = blocks.withColumn("hero", hero).where(~image & F.col("hero").isNotNull())
    c = F.struct(T.normalized_caption(F.coalesce("text", F.lit("")), words).alias("text"), "x1", "y1", "x2", "y2")
    rows = rows.withColumn("c", c).withColumn("score", caption_score(F.col("c"), F.col("hero"), words, w, h))
    best = rows.groupBy("page").agg(F.min(F.struct(-F.col("score"), "pos", "score")).alias("m"))
    return best.select("page", "m.pos", "m.score").where("score >= 1.0")


def pdf_boxes(blocks: DataFrame, w: float = PAGE_WIDTH, h: float = PAGE_HEIGHT) -> DataFrame:
    """(page, pos, px1, py1, px2, py2) in points from the bottom left."""
    b = G.to_pdf(box(), G.pdf_scale(F.lit(w), F.lit(h)))
    return blocks.select("page", "pos", *[b[n].alias(f"p{n}") for n in ("x1", "y1", "x2", "y2")])


def segments(blocks: DataFrame) -> DataFrame:
    """(page, role, text): each block goes to the one role of its type; a role's texts in reading order, by line."""
    rows = reading_order(blocks).withColumn("role", looked_up(ZONE_TYPES | {"image_caption": "caption"}, F.col("block_type"), None)).where("role is not null and trim(coalesce(text, '')) <> ''")
    texts = F.transform(F.array_sort(F.collect_list(F.struct("reading_order", "text"))), lambda s: s["text"])
    return rows.groupBy("page", "role").agg(F.array_join(texts, "\n").alias("text"))


def with_candidates(blocks: DataFrame, candidates: DataFrame) -> DataFrame:
    """blocks and, of a page's candidates (page, n, block_type, x1..y2) from another eye, those of types that it lacks, the
    first of each; columns and continuation boxes always. They have no text and come last in order."""
    types = blocks.groupBy("page").agg(F.collect_set("block_type").alias("types"), F.count("*").alias("many"))
    rows = candidates.join(types, "page").withColumn("k", F.row_number().over(Window.partitionBy("page", "block_type").orderBy("n")))
    new = rows.where(F.col("block_type").isin("bottom_columns", "continuation_box") | ((F.col("k") == 1) & ~F.array_contains("types", F.col("block_type"))))
    last = (F.col("many") + F.col("n")).cast("int")
    new = new.select("page", F.concat(F.lit("cv"), F.col("n").cast("string")).alias("id"), last.alias("reading_order"), "block_type", F.lit("").alias("text"), F.lit("candidates").alias("engine"), "x1", "y1", "x2", "y2")
    return blocks.select("page", "id", "reading_order", "block_type", "text", "engine", "x1", "y1", "x2", "y2").unionByName(new)


def page_layout(blocks: DataFrame, others: DataFrame | None = None, candidates: DataFrame | None = None, w: float = PAGE_WIDTH, h: float = PAGE_HEIGHT) -> DataFrame:
    """A page's layout: (page, id, reading_order, block_type, font_role, render_mode, text, engine, confidence, x1..y2,
    px1..py2 in points). blocks: page, pos, label, text, x1..y2, block_order; running heads and blocks without a box are
    left out, the others' texts are those of the best overlapping block of others, order is by top. candidates:
    with_candidates()."""
    from .documents import in_block_order
    from .merge import best_overlap

    rows = in_block_order(blocks.where(~F.col("label").isin(*SKIP_LABELS[:-1]) & F.col("x1").isNotNull()))
    if others is not None:
        said = others.withColumn("text", T.strip(T.repair_mojibake(F.col("text")))).where("text <> '' and x1 is not null")
        rows = rows.join(best_overlap(rows, said).select("page", "pos", F.col("text").alias("best")), ["page", "pos"]).withColumn("text", F.col("best")).drop("best")
    rows = rows.withColumn("text", T.strip(T.repair_mojibake(F.coalesce("text", F.lit("")))))
    rows = rows.withColumn("reading_order", F.row_number().over(Window.partitionBy("page").orderBy("y1", "place")) - 1)
    rows = classify(rows, w=w, h=h).select("page", F.concat(F.lit("s"), F.col("reading_order").cast("string")).alias("id"), "reading_order", "block_type", "text", F.lit("layout_engine").alias("engine"), "x1", "y1", "x2", "y2")
    if candidates is not None:
        rows = with_candidates(rows, candidates)
    t = F.col("block_type")
    rows = rows.withColumn("font_role", looked_up(FONT_ROLES, t, "body")).withColumn("render_mode", F.when(t == "hero_image", "image").when(t == "continuation_box", "box").otherwise("text")).withColumn("confidence", F.lit(0.85))
    b = G.to_pdf(box(), G.pdf_scale(F.lit(w), F.lit(h)))
    return rows.select("*", *[b[n].alias(f"p{n}") for n in ("x1", "y1", "x2", "y2")])


def layout_metrics(blocks: DataFrame, reflow_used: bool = False, visible_text: bool = False, debug_boxes: bool = False, w: float = PAGE_WIDTH, h: float = PAGE_HEIGHT) -> DataFrame:
    """(page, document_type, source_aspect, pdf_aspect, headline_found, hero_found, sidebar_found, columns_found, warnings) of
    classified blocks."""
    has = lambda *t: F.max(F.col("block_type").isin(*t).cast("int")) == 1
    rows = blocks.groupBy("page").agg(has("main_headline", "secondary_headline").alias("headline_found"), has("hero_image").alias("hero_found"), has("right_sidebar").alias("sidebar_found"), has("bottom_columns").alias("columns_found"))
    rows = rows.join(page_types(blocks, w, h).select("page", "document_type"), "page")
    tall = h * G.PDF_WIDTH / w
    tests = ((F.lit(reflow_used) & (F.col("document_type") == "newspaper_front_page"), "reflow_used_on_newspaper_page"), (~F.col("hero_found"), "hero_image_not_found"), (F.lit(visible_text), "visible_text_overlay_on_facsimile"), (F.lit(debug_boxes), "debug_boxes_on_facsimile"))
    warnings = F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in tests]))
    return rows.select("page", "document_type", F.lit(w / max(1.0, h)).alias("source_aspect"), F.lit(G.PDF_WIDTH / max(1.0, tall)).alias("pdf_aspect"), "headline_found", "hero_found", "sidebar_found", "columns_found", warnings.alias("warnings"))
