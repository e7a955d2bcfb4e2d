"""Documents built from a page's blocks or a text's lines: a title, a photo, and blocks of paragraphs by column.

Blocks: page, pos, label, text, x1, y1, x2, y2 (null without a box), block_order. Everything is a window or aggregation
by page, so that one exchange serves all steps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.pages import IMAGE_LABELS, TEXT_LABELS, TITLE_LABELS
from . import lines as L

#: Share of the width from which a block is no column's; least gap between columns; where a photo is on the
#: left; a page's width if nothing shows it; the place of blocks without an order.
FULL_WIDTH, COLUMN_GAP, LEFT_PHOTO, DEFAULT_WIDTH, NO_ORDER = 0.62, 0.12, 0.45, 1280.0, 9999
#: Headings of columns and wide blocks.
HEADINGS = {"left": "## Vasen palsta", "right": "## Oikea palsta", "full": "## Leveä lohko"}
_BLOCKS = "array<struct<y_min:double,rank:int,kind:string,paragraphs:array<string>>>"


def in_block_order(blocks: DataFrame) -> DataFrame:
    """place: from 1, by the engine's order (those without last), then by top; the first given among equals."""
    order = F.coalesce(F.col("block_order").cast("int"), F.lit(NO_ORDER))
    return blocks.withColumn("place", F.row_number().over(Window.partitionBy("page").orderBy(order, F.coalesce("y1", F.lit(0.0)), "pos")))


def with_split(rows: DataFrame, key: str, narrow: Column, x1: str, x2: str, order: str) -> DataFrame:
    """split: the middle of the widest gap between centres of narrow rows, the first among equals; null unless three rows
    are narrow by their own extent and the gap is COLUMN_GAP of it."""
    of = Window.partitionBy(key, "in_play")
    rows = rows.withColumn("in_play", narrow)
    rows = rows.withColumn("extent", F.greatest(F.lit(1.0), F.max(x2).over(of) - F.min(x1).over(of)))
    rows = rows.withColumn("slim", F.col("in_play") & ((F.col(x2) - F.col(x1)) < FULL_WIDTH * F.col("extent"))).withColumn("c", (F.col(x1) + F.col(x2)) / 2)
    before = F.lag("c").over(Window.partitionBy(key, "slim").orderBy("c", order))
    rows = rows.withColumn("before", F.when(F.col("slim"), before))
    best = F.min(F.when(F.col("before").isNotNull(), F.struct((F.col("before") - F.col("c")).alias("g"), "c", "before", "extent"))).over(Window.partitionBy(key))
    rows = rows.withColumn("best", best).withColumn("n_slim", F.sum(F.col("slim").cast("int")).over(Window.partitionBy(key)))
    wide = (F.col("n_slim") >= 3) & (-F.col("best.g") > 0) & (-F.col("best.g") >= COLUMN_GAP * F.col("best.extent"))
    return rows.withColumn("split", F.when(wide, (F.col("best.c") + F.col("best.before")) / 2)).drop("in_play", "extent", "slim", "c", "before", "best", "n_slim")


def _gathered(rows: DataFrame, key: str, paragraph: Column, order: tuple[str, ...], kept: dict[str, Column]) -> DataFrame:
    """Of rows (key, side, y, text): blocks of paragraphs, by top, columns from left to right, wide blocks last."""
    parts = F.when(paragraph != "", F.struct(*order, paragraph.alias("t")))
    by_side = {s: F.array_sort(F.collect_list(F.when(F.col("side") == s, parts))) for s in HEADINGS}
    tops = {s: F.min(F.when(F.col("side") == s, F.col("y"))) for s in HEADINGS}
    out = rows.groupBy(key).agg(*[v.alias(k) for k, v in kept.items()], *[v.alias(f"p_{s}") for s, v in by_side.items()], *[v.alias(f"y_{s}") for s, v in tops.items()])
    block = lambda i, s: F.when(F.size(f"p_{s}") > 0, F.struct(F.col(f"y_{s}").alias("y_min"), F.lit(i).alias("rank"), F.lit(s).alias("kind"), F.transform(f"p_{s}", lambda p: p["t"]).alias("paragraphs")))
    return out.withColumn("blocks", F.array_sort(F.array_compact(F.array(*[block(i, s) for i, s in enumerate(HEADINGS)])))).drop(*[f"{x}_{s}" for s in HEADINGS for x in "py"])


def first_sentence(t: Column) -> Column:
    """Up to the first full stop, 120 characters at most."""
    return F.substring(F.split_part(t, F.lit("."), F.lit(1)), 1, 120)


def from_blocks(blocks: DataFrame, width: float = 0.0) -> DataFrame:
    """(page, title, photo, blocks, width) of each page: title: the first title block, else the first text's beginning,
    else L.NO_TITLE; photo: the largest image block of 2 to 55 % of the width squared; blocks: left, right, full. width:
    the page's; 0: not known, then the blocks' right edge counts (and no photo is small enough)."""
    text, label, page = T.strip(F.coalesce("text", F.lit(""))), F.col("label"), Window.partitionBy("page")
    rows = in_block_order(blocks).withColumn("text", text)
    boxed = F.col("x1").isNotNull() & F.col("y1").isNotNull() & F.col("x2").isNotNull() & F.col("y2").isNotNull()
    rows = rows.withColumn("boxed", boxed).withColumn("body", label.isin(*TEXT_LABELS) & ~T.is_page_number(F.col("text")))
    edge = F.floor(F.max(F.when(F.col("boxed"), F.col("x2"))).over(page))
    rows = rows.withColumn("width", F.lit(float(width)) if width else F.when(edge > 0, edge.cast("double")).otherwise(DEFAULT_WIDTH))
    w, h = F.greatest(F.lit(1), (F.col("x2") - F.col("x1")).cast("int")), F.greatest(F.lit(1), (F.col("y2") - F.col("y1")).cast("int"))
    area, whole = w.cast("double") * h, max(1.0, float(width) ** 2)
    photo = F.when(label.isin(*IMAGE_LABELS) & F.col("boxed") & (area >= 0.02 * whole) & (area <= 0.55 * whole), F.struct((-area).alias("s"), "place", F.greatest(F.lit(0), F.col("x1").cast("int")).alias("x"), F.greatest(F.lit(0), F.col("y1").cast("int")).alias("y"), w.alias("width"), h.alias("height")))
    rows = rows.withColumn("photo", F.min(photo).over(page))
    lean = F.col("body") & F.col("boxed") & (F.col("x2") - F.col("x1") < FULL_WIDTH * F.col("width"))
    rows = rows.withColumn("lean", lean).withColumn("n_lean", F.sum(F.col("lean").cast("int")).over(page)).withColumn("n_boxed", F.sum((F.col("body") & F.col("boxed")).cast("int")).over(page))
    in_play = (F.col("n_boxed") >= 2) & F.when(F.col("n_lean") >= 2, F.col("lean")).otherwise(F.col("body") & F.col("boxed"))
    rows = with_split(rows, "page", in_play, "x1", "x2", "place")
    centre, split = (F.col("x1") + F.col("x2")) / 2, F.col("split")
    beside = split.isNull() & (F.col("photo.x") < LEFT_PHOTO * F.col("width")) & (centre > LEFT_PHOTO * F.col("width"))
    wide = ~F.col("boxed") | split.isNull() | (F.col("x2") - F.col("x1") >= FULL_WIDTH * F.col("width"))
    side = F.when(F.col("boxed") & F.coalesce(beside, F.lit(False)), "right").when(wide, "full").when(centre < split, "left").otherwise("right")
    rows = rows.withColumn("side", F.when(F.col("body") & (F.col("text") != ""), side)).withColumn("y", F.when(F.col("boxed"), F.col("y1")).otherwise(0.0))
    titled = F.when(F.col("text") != "", F.when(label.isin(*TITLE_LABELS), F.struct(F.lit(0).alias("k"), "place", F.col("text").alias("t"))).when(label.isin(*TEXT_LABELS), F.struct(F.lit(1).alias("k"), "place", first_sentence(F.col("text")).alias("t"))))
    out = _gathered(rows, "page", F.col("text"), ("y", "place"), {"title": F.min(titled), "photo": F.min("photo"), "width": F.min("width")})
    return out.withColumn("title", T.repair_mojibake(F.coalesce("title.t", F.lit(L.NO_TITLE)))).withColumn("photo", F.when(F.col("photo").isNotNull(), F.struct("photo.x", "photo.y", "photo.width", "photo.height")))


def from_lines(lines: DataFrame, masthead: str | None = None) -> DataFrame:
    """(doc_id, title, photo, blocks) of lines: the body without title, hyphens and tail, by columns; a document of
    nothing but a title has it as its only paragraph."""
    rows = L.with_tail(L.titled(L.in_reading_order(lines), masthead), ("kind",))
    rows = rows.withColumn("in_body", (F.col("kind") == "body") & F.col("tail").isNull())
    rows = with_split(rows, "doc_id", F.col("in_body"), "x_min", "x_max", "idx")
    extent = Window.partitionBy("doc_id", "in_body")
    rows = rows.withColumn("extent", F.greatest(F.lit(1.0), F.max("x_max").over(extent) - F.min("x_min").over(extent)))
    wide = F.col("split").isNull() | (F.col("x_max") - F.col("x_min") >= FULL_WIDTH * F.col("extent"))
    side = F.when(wide, "full").when((F.col("x_min") + F.col("x_max")) / 2 < F.col("split"), "left").otherwise("right")
    rows = rows.withColumn("side", F.when(F.col("in_body") & ~T.is_page_number(F.col("text")), side))
    title = F.max("title").over(Window.partitionBy("doc_id"))
    rows = rows.select("doc_id", "idx", "text", "x_min", "x_max", "y_min", "y_max", F.coalesce("side", F.lit("")).alias("side"), title.alias("title"))
    again = L.dehyphenate(rows, ("title", "side"))
    pars = L.paragraphs(again, ("title", "side")).withColumn("order", F.col("par"))
    tops = again.groupBy("doc_id", "side").agg(F.min("y_min").alias("y"))
    out = _gathered(pars.join(tops, ["doc_id", "side"]), "doc_id", F.col("text"), ("order",), {"title": F.max("title")})
    alone = (F.size("blocks") == 0) & (F.col("title") != "")
    only = F.array(F.struct(F.lit(0.0).alias("y_min"), F.lit(2).alias("rank"), F.lit("full").alias("kind"), F.array("title").alias("paragraphs")))
    none = F.lit(None).cast("struct<x:int,y:int,width:int,height:int>")
    return out.select("doc_id", F.when(alone, first_sentence(F.col("title"))).otherwise(F.col("title")).alias("title"), none.alias("photo"), F.when(alone, only).otherwise(F.col("blocks")).cast(_BLOCKS).alias("blocks"))


def _kinds() -> Column:
    return F.filter(F.transform("blocks", lambda b: b["kind"]), lambda k: k.isin("left", "right"))


def is_multi_column() -> Column:
    """Two columns, or one beside a photo."""
    return (F.size(F.array_distinct(_kinds())) >= 2) | (F.col("photo").isNotNull() & (F.size(_kinds()) > 0))


def column_count() -> Column:
    return F.when(is_multi_column(), F.greatest(F.size(F.array_distinct(_kinds())), F.lit(1))).otherwise(1)


def has_text() -> Column:
    return F.exists("blocks", lambda b: F.exists(b["paragraphs"], lambda p: T.strip(p) != ""))


def is_sufficient() -> Column:
    """Whether a document is enough to lay out: it has text, or a photo and a real title."""
    return has_text() | (F.col("photo").isNotNull() & ~T.strip(F.col("title")).isin("", L.NO_TITLE))


def is_weak(confidence: Column, least: float) -> Column:
    """Whether a result should be tried again: unsure, without a real title, or empty."""
    return (confidence < least) | T.strip(F.col("title")).isin("", L.NO_TITLE) | (~has_text() & F.col("photo").isNull())


def _markdown(parts: Column) -> Column:
    text = F.array_join(F.concat(F.array(F.concat(F.lit("# "), T.strip(F.col("title")))), parts), "\n\n")
    return T.repair_mojibake(F.concat(F.regexp_replace(text, r"\s+$", ""), F.lit("\n")))


def _paragraphs(b: Column) -> Column:
    return F.filter(F.transform(b["paragraphs"], T.strip), lambda p: p != "")


def structured_markdown() -> Column:
    """Title, and by block its heading and paragraphs."""
    heading = lambda b: F.try_element_at(F.create_map(*[F.lit(x) for kv in HEADINGS.items() for x in kv]), b["kind"])
    return _markdown(F.flatten(F.transform("blocks", lambda b: F.concat(F.array(heading(b)), _paragraphs(b)))))


def flowing_markdown() -> Column:
    """Title and paragraphs, blocks from the top down."""
    return _markdown(F.flatten(F.transform("blocks", _paragraphs)))


def uses_layout(mode: str = "auto") -> Column:
    """Whether the page's layout is kept: never when flowing, always when structural, else for columns and photos."""
    return {"flowing": F.lit(False), "structural": F.lit(True)}.get(mode, is_multi_column() | F.col("photo").isNotNull())


def markdown(mode: str = "auto") -> Column:
    return F.when(uses_layout(mode), structured_markdown()).otherwise(flowing_markdown())


def with_paragraphs_of(pars: Column) -> Column:
    """The document's blocks with other paragraphs (array<string>): the n-th block takes the n-th; blocks beyond keep
    theirs; what is left over goes to the last block. A document without blocks, or no paragraphs, change nothing."""
    n = F.size("blocks")
    own = lambda b, i: F.when(i < F.size(pars), F.when(i == n - 1, F.slice(pars, i + 1, F.size(pars))).otherwise(F.array(F.get(pars, i)))).otherwise(b["paragraphs"])
    return F.when((n > 0) & (F.size(pars) > 0), F.transform("blocks", lambda b, i: b.withField("paragraphs", own(b, i)))).otherwise(F.col("blocks"))
