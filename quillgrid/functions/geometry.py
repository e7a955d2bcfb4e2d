"""Boxes as columns: struct<x1, y1, x2, y2> in pixels, origin top left."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

PDF_WIDTH = 595.0


def box(x1, y1, x2, y2) -> Column:
    return F.struct(*[F.col(c).cast("double").alias(n) if isinstance(c, str) else c.cast("double").alias(n) for c, n in zip((x1, y1, x2, y2), ("x1", "y1", "x2", "y2"), strict=True)])


def poly_box(poly: Column) -> Column:
    """The box around an array of points; points of fewer than two numbers are left out, no points give null."""
    good = F.filter(poly, lambda p: F.size(p) >= 2)
    x, y = F.transform(good, lambda p: p[0]), F.transform(good, lambda p: p[1])
    return F.when(F.size(good) > 0, box(F.array_min(x), F.array_min(y), F.array_max(x), F.array_max(y)))


def width(b: Column) -> Column:
    return F.greatest(F.lit(0.0), b["x2"] - b["x1"])


def height(b: Column) -> Column:
    return F.greatest(F.lit(0.0), b["y2"] - b["y1"])


def area(b: Column) -> Column:
    return width(b) * height(b)


def centre_x(b: Column) -> Column:
    return (b["x1"] + b["x2"]) / 2


def centre_y(b: Column) -> Column:
    return (b["y1"] + b["y2"]) / 2


def intersection(a: Column, b: Column) -> Column:
    """Common area; 0 without one."""
    w = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    h = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    return F.when((w > 0) & (h > 0), w * h).otherwise(0.0)


def iou(a: Column, b: Column) -> Column:
    """Common area by joint area; 0 if either is."""
    common = intersection(a, b)
    joint = area(a) + area(b) - common
    return F.when((common > 0) & (joint > 0), common / joint).otherwise(0.0)


def overlaps(a: Column, b: Column) -> Column:
    return (F.least(a["x2"], b["x2"]) > F.greatest(a["x1"], b["x1"])) & (F.least(a["y2"], b["y2"]) > F.greatest(a["y1"], b["y1"]))


def near(a, b, zero=None, least: Callable = F.least, greatest: Callable = F.greatest, absolute: Callable = F.abs):
    """Overlapping (an IoU of over 0.12), beside each other on a line, or with centres close by. Of columns; of plain
    boxes too, with 0.0, min, max and abs."""
    zero = F.lit(0.0) if zero is None else zero
    wide, tall = (greatest(zero, r["x2"] - r["x1"]) for r in (a, b)), (greatest(zero, r["y2"] - r["y1"]) for r in (a, b))
    (wa, wb), (ha, hb) = tuple(wide), tuple(tall)
    dx, dy = greatest(zero, least(a["x2"], b["x2"]) - greatest(a["x1"], b["x1"])), greatest(zero, least(a["y2"], b["y2"]) - greatest(a["y1"], b["y1"]))
    common = dx * dy
    over = common > 0.12 * (wa * ha + wb * hb - common)
    gap = greatest(zero, greatest(a["x1"], b["x1"]) - least(a["x2"], b["x2"]))
    beside = (dy > 0.35 * greatest(zero + 1.0, least(ha, hb))) & (gap < 0.5 * greatest(wa, wb))
    off_x, off_y = (absolute(a[p] + a[q] - b[p] - b[q]) / 2 for p, q in (("x1", "x2"), ("y1", "y2")))
    return over | beside | ((off_x < 0.6 * greatest(wa, wb)) & (off_y < 0.6 * greatest(ha, hb)))


def pdf_scale(page_width: Column, page_height: Column) -> Column:
    """struct<width, height, scale_x, scale_y> in points: a fixed width, the aspect kept; null without a size."""
    ratio = F.lit(PDF_WIDTH) / page_width
    tall = page_height * ratio
    return F.when((page_width > 0) & (page_height > 0), F.struct(F.lit(PDF_WIDTH).alias("width"), tall.alias("height"), ratio.alias("scale_x"), (tall / page_height).alias("scale_y")))


def to_pdf(b: Column, scale: Column) -> Column:
    """Points with the origin at the bottom left."""
    return box(b["x1"] * scale["scale_x"], scale["height"] - b["y2"] * scale["scale_y"], b["x2"] * scale["scale_x"], scale["height"] - b["y1"] * scale["scale_y"])


def to_relative(b: Column, page_width: Column, page_height: Column) -> Column:
    return F.struct((b["x1"] / page_width).alias("x"), (b["y1"] / page_height).alias("y"), (width(b) / page_width).alias("w"), (height(b) / page_height).alias("h"))


def clamp(v: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), v))


def crop_rect(b: Column) -> Column:
    """Whole pixels, truncated, 1 wide and high at least."""
    x, y = b["x1"].cast("int"), b["y1"].cast("int")
    return F.struct(x.alias("x"), y.alias("y"), F.greatest(F.lit(1), b["x2"].cast("int") - x).alias("width"), F.greatest(F.lit(1), b["y2"].cast("int") - y).alias("height"))


def touches_border(b: Column, page_width: Column, page_height: Column, margin: float = 8.0) -> Column:
    """Whether three sides or more lie at the page's border."""
    sides = (b["x1"] <= margin, b["y1"] <= margin, b["x2"] >= page_width - margin, b["y2"] >= page_height - margin)
    return sum(s.cast("int") for s in sides) >= 3


def clamp_rect(rect: Column, width: Column, height: Column) -> Column:
    """A rectangle (x, y, width, height) moved and cut so that it lies within an image, 1 wide and high at least."""
    x, y = F.greatest(F.lit(0), F.least(rect["x"], width - 1)), F.greatest(F.lit(0), F.least(rect["y"], height - 1))
    side = lambda wanted, room: F.greatest(F.lit(1), F.least(wanted, room))
    return F.struct(x.alias("x"), y.alias("y"), side(rect["width"], width - x).alias("width"), side(rect["height"], height - y).alias("height"))


def fit_text(text: Column, box_width: Column, box_height: Column, start: Column, least: float, char_width: float = 0.52, line_height: float = 1.15) -> Column:
    """The first size, in steps of half a point down from start, at which text fits as one line; least if none does;
    start for a blank text."""
    size = lambda k: start - k * 0.5
    fits = lambda k: (size(k) >= least) & (F.length(text) <= F.greatest(F.lit(1), F.floor(box_width / (size(k) * char_width)))) & (size(k) * line_height <= box_height)
    steps = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((start - least) * 2).cast("int")))
    at = F.get(F.filter(steps, fits), F.lit(0))
    return F.when(F.trim(text) == "", start).when(at.isNotNull(), size(at)).otherwise(float(least)).cast("double")


def fit_stack(label: Column, name: Column, height: Column, least_label: float = 14.0, least_name: float = 30.0) -> tuple[Column, Column]:
    """Two sizes, one above the other, shrunk by half points until they fit into 90 % of a height: the name first, down to
    its least, then the label."""
    room = height * 0.90

    def shrunk(size: Column, least: float, fits) -> Column:
        steps = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((size - least) * 2).cast("int")))
        at = F.get(F.filter(steps, lambda k: (size - k * 0.5 <= least) | fits(size - k * 0.5)), F.lit(0))
        return F.when(size > least, size - at * 0.5).otherwise(size)

    name = shrunk(name, least_name, lambda s: label * 1.15 + s * 1.12 <= room)
    return shrunk(label, least_label, lambda s: s * 1.15 + name * 1.12 <= room), name


def role_font_size(font_role: Column, height: Column) -> Column:
    """Points for a block's text, from its role and its box's height in points."""
    of = lambda least, most, share: F.least(F.lit(most), F.greatest(F.lit(least), height * share))
    return F.when(font_role == "masthead", of(10.0, 28.0, 0.55)).when(font_role == "headline", of(12.0, 36.0, 0.65)).when(font_role.isin("caption", "meta"), of(7.0, 12.0, 0.45)).otherwise(of(7.0, 11.0, 0.42))
