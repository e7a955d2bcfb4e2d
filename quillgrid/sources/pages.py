"""Page JSON, and views of the driver's tables that stand in for a layout model's output."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PAGE_WIDTH, PAGE_HEIGHT = 1000.0, 1200.0
_BLOCK = "struct<block_label:string,label:string,block_content:string,content:string,block_bbox:array<double>,bbox:array<double>,block_order:double>"
_OCR = "rec_texts:array<string>,rec_scores:array<double>,rec_polys:array<array<array<double>>>"
_PAGE = f"width:int,height:int,{_OCR},parsing_res_list:array<{_BLOCK}>,overall_ocr_res:struct<{_OCR}>"
PAGE_SCHEMA = f"struct<{_PAGE},res:struct<{_PAGE}>>"
#: Labels by what they hold.
SKIP_LABELS = ("header", "footer", "number", "footnote", "header_image", "footer_image", "formula_number")
TITLE_LABELS = ("doc_title", "paragraph_title", "content_title", "abstract_title", "reference_title", "figure_title", "table_title")
IMAGE_LABELS = ("image", "figure")
TEXT_LABELS = ("text", "content", "abstract", "reference_content", "aside_text")
IMAGE_SUFFIXES = ("jpg", "jpeg", "png", "webp", "bmp", "tif", "tiff", "heic")


def input_kind(path: Column) -> Column:
    """image, pdf or unknown, by suffix."""
    suffix = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.when(suffix.isin(*IMAGE_SUFFIXES), "image").when(suffix == "pdf", "pdf").otherwise("unknown")


def read_page_json(spark: SparkSession, path: str) -> DataFrame:
    """One row per JSON file: path, page (PAGE_SCHEMA, a `res` wrapper taken off), corrupt for what isn't an object."""
    return parse_page_json(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("json")))


def parse_page_json(texts: DataFrame) -> DataFrame:
    """texts: path, json. Fields of another type than expected are null, and what isn't JSON is an empty page: corrupt."""
    own = texts.withColumn("p", F.from_json("json", PAGE_SCHEMA))
    names = [x.split(":")[0] for x in ("width", "height", "rec_texts", "rec_scores", "rec_polys", "parsing_res_list", "overall_ocr_res")]
    merged = F.struct(*[F.coalesce(F.col(f"p.res.{n}"), F.col(f"p.{n}")).alias(n) for n in names], F.col("p.res").alias("res"))
    return own.select("path", merged.alias("page"), (F.col("p").isNull() | ~F.coalesce(F.trim("json").startswith("{"), F.lit(False))).alias("corrupt"))


def pages_of(paths: DataFrame, pages: DataFrame) -> DataFrame:
    """Every path's page; a path without a file has one without blocks."""
    return paths.select("path").join(pages.select("path", "page", "corrupt"), "path", "left").withColumn("corrupt", F.coalesce("corrupt", F.lit(False)))


def _label(b: Column) -> Column:
    return F.coalesce(b["block_label"], b["label"], F.lit(""))


def _content(b: Column) -> Column:
    return F.coalesce(b["block_content"], b["content"], F.lit(""))


def page_blocks(pages: DataFrame) -> DataFrame:
    """(path, pos, label, content, x1..y2, block_order) of each block; alternate keys resolved, nulls left out. A box of
    under four numbers is none, whatever the other key holds."""
    none = F.array().cast(f"array<{_BLOCK}>")
    rows = pages.select("path", F.posexplode(F.filter(F.coalesce("page.parsing_res_list", none), lambda b: b.isNotNull())).alias("pos", "b"))
    bbox = F.coalesce("b.block_bbox", "b.bbox")
    at = lambda i: F.when(F.size(bbox) >= 4, F.get(bbox, F.lit(i)))
    return rows.select("path", "pos", _label(F.col("b")).alias("label"), _content(F.col("b")).alias("content"), *[at(i).alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))], F.col("b.block_order").alias("block_order"))


def _recognised(name: str) -> Column:
    """A recognition field from the first nesting that has texts: the page's own, its wrapper's, the whole-page result's."""
    places = ("page", "page.res", "page.overall_ocr_res", "page.res.overall_ocr_res")
    return F.coalesce(*[F.when(F.size(F.col(f"{p}.rec_texts")) > 0, F.col(f"{p}.{name}")) for p in places])


def page_lines(pages: DataFrame) -> DataFrame:
    """(path, idx, text, score, x_min, y_min, x_max, y_max) of the recognised lines. Points of a polygon of under two
    numbers are left out; a line without points lies at height idx, 100 wide and 1 high."""
    from ..functions.geometry import poly_box

    rows = pages.select("path", _recognised("rec_scores").alias("s"), _recognised("rec_polys").alias("p"), F.posexplode(_recognised("rec_texts")).alias("idx", "text"))
    rows = rows.withColumn("b", poly_box(F.get("p", F.col("idx"))))
    default = {"x1": F.lit(0.0), "y1": F.col("idx").cast("double"), "x2": F.lit(100.0), "y2": F.col("idx") + 1.0}
    names = {"x1": "x_min", "y1": "y_min", "x2": "x_max", "y2": "y_max"}
    return rows.select("path", "idx", "text", F.get("s", F.col("idx")).alias("score"), *[F.coalesce(F.col(f"b.{k}"), v).alias(names[k]) for k, v in default.items()])


def mean_score(pages: DataFrame) -> DataFrame:
    """(path, confidence): the mean of a page's recognition scores, 0 without any."""
    scores = F.coalesce(_recognised("rec_scores"), F.array().cast("array<double>"))
    total = F.aggregate(scores, F.lit(0.0), lambda a, x: a + x)
    return pages.select("path", F.when(F.size(scores) > 0, total / F.size(scores)).otherwise(0.0).alias("confidence"))


def page_text(pages: DataFrame) -> DataFrame:
    """(path, text): the blocks but for skipped and image labels, a blank line between; else the lines; else null. Mojibake
    is repaired."""
    from ..functions.text import repair_mojibake, strip

    keep = lambda b: b.isNotNull() & ~_label(b).isin(*SKIP_LABELS[:4], *IMAGE_LABELS)
    texts = F.filter(F.transform(F.filter("page.parsing_res_list", keep), lambda b: strip(_content(b))), lambda t: t != "")
    lines = _recognised("rec_texts")
    text = F.coalesce(F.when(F.size(texts) > 0, F.array_join(texts, "\n\n")), F.when(F.size(lines) > 0, strip(F.array_join(lines, "\n"))))
    return pages.select("path", repair_mojibake(text).alias("text"))


def derived_blocks(lineitem: DataFrame, part: DataFrame) -> DataFrame:
    """(page, pos, label, text, x1, y1, x2, y2): integer geometry from order lines, for tests and benchmarks."""
    from pyspark.sql import Window

    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    x1 = (F.col("l_partkey") * 37) % 600
    y1 = (F.col("l_partkey") * 91 + F.col("l_suppkey") * 53) % 1150
    label = F.when((F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "F"), "paragraph_title").when((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F"), "image").otherwise("text")
    rows = lineitem.select(
        F.col("l_orderkey").alias("page"), F.row_number().over(order).alias("pos"), label.alias("label"), "l_partkey",
        x1.cast("double").alias("x1"), y1.cast("double").alias("y1"), (x1 + 40 + (F.col("l_partkey") * 13) % 700).cast("double").alias("x2"), (y1 + 10 + (F.col("l_suppkey") * 11) % 120).cast("double").alias("y2"),
    )
    names = part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("text"))
    return rows.join(names, "l_partkey", "left").drop("l_partkey")


def front_blocks(lineitem: DataFrame, part: DataFrame) -> DataFrame:
    """derived_blocks with some sixteen blocks a page and texts of several lines, some of which speak like a front page's:
    metadata, headlines, a caption, a name. For tests and benchmarks."""
    from pyspark.sql import Window

    order = Window.partitionBy("page").orderBy("order_page", "order_pos")
    blocks = derived_blocks(lineitem, part).withColumnsRenamed({"page": "order_page", "pos": "order_pos"})
    blocks = blocks.withColumn("page", F.floor(F.col("order_page") / 16)).withColumn("pos", F.row_number().over(order))
    name = F.col("text")
    said = {
        1: F.concat(F.lit("N:o 87 / 1976\n"), name), 2: F.lit("TIISTAINA 13. PNÄ"), 3: F.lit("***"), 4: F.concat(F.lit("1 mk (sis. lvv)\n"), name), 5: F.concat(F.lit("Jatkuu takasivulle\n"), name),
        6: F.concat(F.lit("JO 39 KUOLONUHRIA\nTEHDASRÄJÄYKSESSÄ\n"), name), 7: F.concat(F.lit("LAPUA ERISTETTIIN\n"), name), 8: F.concat(F.lit("Kuvateksti: Murhe kasvol "), name, F.lit(" uhrien raunioista")),
        9: F.concat(name, F.lit("\n"), name, F.lit(" too")), 10: F.lit("ILTA-SANOMAT"), 11: F.lit("Kuva erikois"),
    }
    text = F.concat(name, F.lit(". "), name, F.lit("\n"), F.reverse(name))
    for k, v in said.items():
        text = F.when(F.col("pos") % 17 == k, v).otherwise(text)
    order_of = F.when(F.col("pos") % 5 != 0, ((F.col("x1") * 3 + F.col("y1")) % 40).cast("double"))
    return blocks.select("page", "pos", "label", F.when(F.col("pos") % 13 != 12, text).otherwise("").alias("text"), "x1", "y1", "x2", "y2", (0.5 + F.col("pos") % 5 / 10).alias("confidence"), order_of.alias("block_order"))


def document_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, idx, text, x_min, x_max, y_min, y_max) of each text's lines, without boxes: line idx at height idx."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("idx", "text"))
    return lines.select("doc_id", "idx", "text", F.lit(0.0).alias("x_min"), F.lit(100.0).alias("x_max"), F.col("idx").cast("double").alias("y_min"), (F.col("idx") + 1).cast("double").alias("y_max"))


def noisy_lines(docs: DataFrame) -> DataFrame:
    """document_lines with made-up heights, gaps, headlines and line-end hyphens, the same on every run."""
    lines = document_lines(docs)
    idx, doc = F.col("idx"), F.col("doc_id")
    top = (12 * idx + 20 * F.floor(idx / 4)).cast("double")
    tall = F.when((doc % 3 == 0) & (idx % 11 == 0), 24.0).otherwise(10.0)
    text = F.when((doc + idx) % 5 == 0, F.concat("text", F.lit("-"))).otherwise(F.col("text"))
    return lines.select("doc_id", "idx", text.alias("text"), "x_min", "x_max", top.alias("y_min"), (top + tall).alias("y_max"))


#: What each engine's provider gives for files (path, content): pages as JSON.
ENGINES = ("layout", "text", "recognition")


def inferred(paths: DataFrame, provider: Callable | None, schema: str = "path string, json string", engine: str = "layout") -> DataFrame:
    """Page JSON from files by an engine's model: provider maps batches of (path, content) to rows of schema. Raises without
    one: no placeholder results are made."""
    if engine not in ENGINES:
        raise ValueError(f"engine must be one of {', '.join(ENGINES)}: {engine!r}")
    if provider is None:
        raise RuntimeError(f"no model for the {engine} engine is installed: pass a provider that maps (path, content) to page rows")
    return paths.select("path", "content").mapInPandas(provider, schema)


def saved_result(files: DataFrame) -> DataFrame:
    """(source, path): of result files (source, path) the one that counts for each source, the first by path."""
    return files.groupBy("source").agg(F.min("path").alias("path"))
