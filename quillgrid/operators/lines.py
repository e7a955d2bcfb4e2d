"""Lines to flowing text. Lines: doc_id, idx, text, x_min, x_max, y_min, y_max; idx is the order within doc_id.

Everything is a window or an aggregation by doc_id (and what a line belongs to), so one exchange by doc_id serves all
steps, results go along as columns instead of being joined back, and a document of any length may spill.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Fixed value: the title of a document without any.
NO_TITLE = "Asiakirja"
#: Half, and so little more that of an even number the upper middle one is taken.
UPPER_HALF = 0.5 + 1e-9


def _by(*order: str | Column, also: tuple[str, ...] = ()):
    return Window.partitionBy("doc_id", *also).orderBy(*order)


def _joined(column: str, order: str, gap: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, column))), lambda s: s[column]), gap)


def in_reading_order(lines: DataFrame) -> DataFrame:
    """idx anew, by top and left edge; lines that stand alike keep their order."""
    return lines.withColumn("idx", F.row_number().over(_by("y_min", "x_min", "idx")) - 1)


def dehyphenate(lines: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """A line that ends in '-' loses it and takes in the next, and so on while what has come together ends in '-'; boxes
    are joined. The last line may keep one. also: columns beside doc_id that keep lines apart.

    A line of other characters has as many hyphens to lose as it ends in (white space between them doesn't count); blank
    lines and lines of hyphens only lose one of what is pending and add their own. So pending hyphens are a queue that
    each line shortens by one, and a line begins anew where the queue is empty: a sum and its least value so far.
    """
    bare = F.regexp_replace("text", r"[-\s]+$", "")
    own = F.length(F.regexp_replace(F.substring("text", F.length(bare) + 1, F.length("text")), r"\s", ""))
    lines = lines.withColumn("_solid", (bare != "").cast("int")).withColumn("_own", own)
    order = _by("idx", also=also)
    lines = lines.withColumn("_part", F.sum("_solid").over(order))
    inner = _by("idx", also=(*also, "_part"))
    lines = lines.withColumn("_sum", F.sum(F.col("_own") - 1).over(inner))
    pending = F.col("_sum") - F.least(F.lit(0), F.min("_sum").over(inner))  # what would be left after one more line
    before = F.coalesce(F.lag("_left").over(inner), F.lit(0))
    lines = lines.withColumn("_left", pending).withColumn("_queue", before + F.col("_own"))
    lines = lines.withColumn("_group", F.sum((F.coalesce(F.lag("_queue").over(order), F.lit(0)) == 0).cast("int")).over(order))
    pieces = F.array_sort(F.collect_list(F.struct("idx", "text", "_solid")))
    keys = ["doc_id", *also]
    out = lines.groupBy(*keys, "_group").agg(
        pieces.alias("_pieces"), F.min("idx").alias("idx"), F.min("x_min").alias("x_min"), F.max("x_max").alias("x_max"), F.min("y_min").alias("y_min"), F.max("y_max").alias("y_max")
    )
    text = F.col("_pieces")
    cut = lambda s: F.regexp_replace(s, r"-\s*$", "")
    start = lambda s: F.regexp_replace(s, r"^\s+", "")
    last = F.size(text) - 1
    plain = F.array_join(F.transform(text, lambda p, i: F.when(i == 0, p["text"]).otherwise(start(p["text"]))), "\x00")
    plain = F.regexp_replace(plain, "-\\s*\x00", "")  # each solid line's last hyphen
    folded = F.aggregate(F.slice(text, F.lit(2), F.greatest(last, F.lit(0))), F.get(text, F.lit(0))["text"], lambda a, p: F.concat(cut(a), start(p["text"])))
    simple = F.forall(F.slice(text, F.lit(2), F.greatest(last, F.lit(0))), lambda p: p["_solid"] == 1) & ~F.exists(text, lambda p: F.contains(p["text"], F.lit("\x00")))
    return out.withColumn("text", F.when(last == 0, F.get(text, F.lit(0))["text"]).when(simple, plain).otherwise(folded)).drop("_group", "_pieces")


def with_median_height(lines: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """The upper median of a document's line heights, each 1 at least, on every line."""
    lines = lines.withColumn("height", F.greatest(F.lit(1.0), F.col("y_max") - F.col("y_min")))
    return lines.withColumn("median", F.expr(f"percentile_disc({UPPER_HALF!r}) WITHIN GROUP (ORDER BY height)").over(Window.partitionBy("doc_id", *also)))


def with_paragraph(lines: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """par: a gap of over 1.25 median heights begins a new one."""
    gap = F.col("y_min") - F.lag("y_max").over(_by("idx", also=also))
    return with_median_height(lines, also).withColumn("par", F.sum(F.when(gap > 1.25 * F.col("median"), 1).otherwise(0)).over(_by("idx", also=also)))


def paragraphs(lines: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, also, par, text): trimmed lines of a paragraph are joined by spaces, blank ones left out."""
    lines = with_paragraph(lines, also).withColumn("piece", T.strip(F.col("text")))
    pieces = F.when(F.col("piece") != "", F.struct("idx", "piece"))
    return lines.groupBy("doc_id", *also, "par").agg(F.array_join(F.transform(F.array_sort(F.collect_list(pieces)), lambda s: s["piece"]), " ").alias("text"))


def with_headline(lines: DataFrame, masthead: str | None = None) -> DataFrame:
    """head: whether a line is of its document's headline: of the runs of lines twice the median height (a gap of over
    2.5 medians ends a run), the one of the greatest total height, the first among equals. masthead: a pattern of lines
    that are none."""
    tall = F.col("height") >= 2 * F.col("median")
    if masthead:
        tall &= ~F.col("text").rlike(masthead)
    lines = with_median_height(lines).withColumn("tall", tall)
    above = F.last(F.when(F.col("tall"), F.col("y_max")), ignorenulls=True).over(_by("idx").rowsBetween(Window.unboundedPreceding, -1))
    apart = F.col("tall") & (F.col("y_min") - above > 2.5 * F.col("median"))
    lines = lines.withColumn("run", F.sum(F.coalesce(apart, F.lit(False)).cast("int")).over(_by("idx")))
    lines = lines.withColumn("total", F.sum(F.when(F.col("tall"), F.col("height"))).over(Window.partitionBy("doc_id", "run")))
    best = F.min(F.when(F.col("tall"), F.struct(-F.col("total"), "run"))).over(Window.partitionBy("doc_id"))
    return lines.withColumn("head", F.col("tall") & (F.col("run") == best["run"])).drop("tall", "run", "total", "height", "median")


def headline_lines(lines: DataFrame, masthead: str | None = None) -> DataFrame:
    """Lines of each document's headline."""
    return with_headline(lines, masthead).where("head").drop("head")


def titled(lines: DataFrame, masthead: str | None = None) -> DataFrame:
    """Lines without hyphens, and title and kind: head, top (a title's line where there is no headline: the first, or two
    if it is short) or body."""
    rows = dehyphenate(with_headline(lines, masthead), ("head",))
    order = _by("idx", also=("head",))
    rows = rows.withColumn("n", F.row_number().over(order)).withColumn("headed", F.max("head").over(Window.partitionBy("doc_id")))
    whole = Window.partitionBy("doc_id")
    # more than 120 characters of a line are never needed, so no row carries them
    nth = lambda i: F.max(F.when(~F.col("head") & (F.col("n") == i), F.substring(T.strip(F.col("text")), 1, 125))).over(whole)
    rows = rows.withColumns({"first": nth(1), "second": nth(2)})
    piece = F.when(F.col("head") & (T.strip(F.col("text")) != ""), F.struct("idx", T.strip(F.col("text")).alias("t")))
    head = F.array_join(F.transform(F.array_sort(F.collect_list(piece).over(whole)), lambda s: s["t"]), " ")
    short = (F.length("first") < 10) & F.col("second").isNotNull()
    both = F.regexp_replace(F.substring(T.strip(F.concat("first", F.lit(" "), "second")), 1, 120), r"\s+$", "")
    cut = F.when(F.length("first") > 120, F.concat(F.regexp_replace(F.substring("first", 1, 117), r"\s+$", ""), F.lit("..."))).otherwise(F.col("first"))
    other = F.when(short, both).when(cut == "", NO_TITLE).otherwise(cut)
    used = F.when(F.col("headed"), 0).when(short, 2).otherwise(1)
    kind = F.when(F.col("head"), "head").when(F.col("n") <= used, "top").otherwise("body")
    # the title is needed once a document, on its first line; collecting it there only keeps rows small
    title = F.when(F.row_number().over(_by("idx")) == 1, F.when(F.col("headed"), head).otherwise(other))
    return rows.withColumn("title", title).withColumn("kind", kind).drop("n", "headed", "first", "second", "head")


def with_tail(lines: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """tail: signature for the last line if it is one, dateline for the last line before it, or the last two together;
    and on these lines the texts as dateline and signature."""
    order = _by("idx", also=also)
    r = F.count("*").over(Window.partitionBy("doc_id", *also)) - F.row_number().over(order) + 1
    rows = lines.withColumn("r", r).withColumn("t", T.strip(F.col("text")))
    away = lambda k: F.col("t") if not k else (F.lead("t", k) if k > 0 else F.lag("t", -k)).over(order)
    # the last, last but one and third last line, seen from each of them
    rows = rows.withColumns({f"t{i}": F.when(F.col("r") == 1, away(1 - i)).when(F.col("r") == 2, away(2 - i)).when(F.col("r") == 3, away(3 - i)) for i in (1, 2, 3)})
    near = F.col("r") <= 3
    signed = F.coalesce(T.is_signature(F.col("t1")), F.lit(False))
    rows = rows.withColumn("signed", near & signed)
    one, two = F.when(F.col("signed"), F.col("t2")).otherwise(F.col("t1")), F.when(F.col("signed"), F.col("t3")).otherwise(F.col("t2"))
    rows = rows.withColumns({"one": F.when(near, one), "two": F.when(near, two)})
    both = T.strip(F.concat("two", F.lit(" "), "one"))
    rows = rows.withColumn("single", F.coalesce(T.is_dateline(F.col("one")), F.lit(False)))
    rows = rows.withColumn("pair", ~F.col("single") & F.coalesce(T.is_dateline(both), F.lit(False)))
    at = F.col("r") - F.col("signed").cast("int")
    dated = (at >= 1) & ((F.col("single") & (at == 1)) | (F.col("pair") & (at <= 2)))
    tail = F.when(F.col("signed") & (F.col("r") == 1), "signature").when(dated, "dateline")
    rows = rows.withColumn("tail", tail)
    rows = rows.withColumn("dateline", F.when(F.col("tail") == "dateline", F.when(F.col("single"), F.col("one")).otherwise(both)))
    return rows.withColumn("signature", F.when(F.col("tail") == "signature", F.col("t1"))).drop("r", "t", "t1", "t2", "t3", "signed", "one", "two", "single", "pair")


def trailing(lines: DataFrame) -> DataFrame:
    """(doc_id, dateline, signature): a signature is the last line; a dateline the last line before it, or the last two
    together."""
    return with_tail(lines).groupBy("doc_id").agg(F.max("dateline").alias("dateline"), F.max("signature").alias("signature"))


def flowing_markdown(lines: DataFrame, masthead: str | None = None) -> DataFrame:
    """(doc_id, markdown): title, paragraphs, dateline, signature in bold, a blank line after each; mojibake repaired. One
    exchange by doc_id: every step is a window within it."""
    rows = with_tail(titled(lines, masthead), ("kind",))
    rows = rows.withColumn("part", F.when(F.col("kind") == "body", F.coalesce("tail", F.lit("body"))).otherwise(F.col("kind")))
    rows = with_paragraph(rows, ("part",)).withColumn("piece", T.strip(F.col("text")))
    # a paragraph's first line with text opens it: lines are joined by spaces, paragraphs by blank lines
    inside = (F.col("part") == "body") & (F.col("piece") != "")
    opens = F.row_number().over(Window.partitionBy("doc_id", "part", "par", "piece_in").orderBy("idx")) == 1
    rows = rows.withColumn("piece_in", inside).withColumn("glue", F.when(opens, "\n\n").otherwise(" "))
    pieces = F.when(F.col("piece_in"), F.struct("idx", F.concat("glue", "piece").alias("s")))
    tail = lambda c: F.max(F.when(F.col("kind") == "body", F.col(c)))
    grouped = rows.groupBy("doc_id").agg(F.max("title").alias("title"), F.array_sort(F.collect_list(pieces)).alias("pieces"), tail("dateline").alias("dateline"), tail("signature").alias("signature"))
    body = F.array_join(F.transform("pieces", lambda p: p["s"]), "")
    title = F.concat(F.lit("# "), T.strip(F.col("title")))
    tails = F.array_compact(F.array(F.col("dateline"), F.when(F.col("signature").isNotNull(), F.concat(F.lit("**"), "signature", F.lit("**")))))
    text = F.array_join(F.concat(F.array(F.concat(title, body)), tails), "\n\n")
    whole = grouped.select("doc_id", F.concat(F.regexp_replace(text, r"\s+$", ""), F.lit("\n")).alias("m"))
    return whole.select("doc_id", T.repair_mojibake(F.col("m")).alias("markdown"))


def line_distinct(lines: DataFrame) -> DataFrame:
    """Lines whose fingerprint hasn't stood earlier in the document; blank ones are left out."""
    lines = lines.withColumn("mark", T.fingerprint(F.col("text"))).where("mark <> ''")
    return lines.withColumn("k", F.row_number().over(Window.partitionBy("doc_id", "mark").orderBy("idx"))).where("k = 1").drop("k", "mark")
