"""Queries of the page model and what is made from it, over blocks and texts derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as T
from ..operators import blocks as B
from ..operators import checks as C
from ..operators import documents as D
from ..operators import engines as E
from ..operators import frontpage as N
from ..operators import layout as Y
from ..operators import markdown as M
from ..operators import render as X
from ..operators import reports as S
from ..operators import search as R
from ..operators import typography as K
from ..session import stored
from ..settings import Settings
from ..sources import pages as P

PDF_HEIGHT = P.PAGE_HEIGHT * G.PDF_WIDTH / P.PAGE_WIDTH


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.front_blocks(_table(spark, sf_dir, "lineitem"), _table(spark, sf_dir, "part"))


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.reading_order(B.classify(_raw(spark, sf_dir))).withColumns({"id": F.col("pos"), "ord": F.col("reading_order")})


def _model(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = _classified(spark, sf_dir)
    return stored(N.page_model(every.where("render_mode <> 'image' and trim(text) <> ''"), layout=every), "model")


def page_model_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = N.roles(_model(spark, sf_dir))
    return out.select("page", "role", "n", "text", F.array_join("ids", ",").alias("ids"), F.round("confidence", 6).alias("confidence"))


def _outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model with its Markdown, and the text that a rendered page would show."""
    model = K.with_sizes(_model(spark, sf_dir), G.PDF_WIDTH, PDF_HEIGHT, Settings())
    meta = F.array_join(F.array(*[N.text_of(f"{r}_meta") for r in ("issue", "date", "stars", "price")]), "   ")
    up = lambda r: F.upper(N.text_of(r))
    shown = F.concat(F.array(up("masthead"), N.text_of("newspaper_name"), meta, up("main_headline"), up("secondary_headline"), F.col("sidebar_text"), N.text_of("image_caption"), N.text_of("lower_headline")), N.column_texts(), F.array(up("continuation_box")))
    model = model.withColumn("pdf_text", F.array_join(F.filter(shown, lambda t: F.trim(t) != ""), "\n"))
    return stored(model.withColumn("markdown", M.primary(F.lit("newspaper_front_page"), M.newspaper(), F.lit("none"))), "outputs")


def newspaper_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _outputs(spark, sf_dir).select("page", "markdown", M.story_body(F.col("markdown")).alias("body"), "pdf_text")


def content_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _model(spark, sf_dir).select("page", F.explode(C.segments()).alias("s")).select("page", "s.*")
    return out.select("page", "id", "role", "text", "normalized", "owner", "target")


def content_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the model owns, lacks and misplaces, page by page."""
    report = C.story_report()
    out = _model(spark, sf_dir).withColumn("r", report)
    return out.select("page", F.array_join("taken", ",").alias("taken"), F.array_join("metadata_ids", ",").alias("metadata_ids"), F.array_join(C.misassigned(), ",").alias("misassigned"), "r.sidebar_detected", "r.caption_candidates", "r.caption_selected", "r.content_loss", F.array_join("r.missing", ",").alias("missing"))


PHRASES = ("JO 39 KUOLONUHRIA", "TEHDASRÄJÄYKSESSÄ", "LAPUA ERISTETTIIN")


def gate_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata, phrases, cleanup, story and typography checks, a row each."""
    rows = _outputs(spark, sf_dir)
    return C.exploded(rows, F.concat(C.metadata(), C.phrases_in_markdown(PHRASES), C.cleanup(), C.story(), C.typography())).select("page", "name", "passed")


def gate_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict over a page's checks and its content."""
    rows = _outputs(spark, sf_dir).withColumn("checks", F.concat(C.metadata(), C.phrases_in_markdown(PHRASES), C.cleanup(), C.story(), C.typography()))
    rows = C.audit(rows.withColumn("layout_quality", C.layout_quality(F.col("checks"))), required=REQUIRED, forbidden=FORBIDDEN, truncated=TRUNCATED)
    rows = rows.withColumn("checks", F.concat("checks", C.audit_checks()))
    failed = F.size(F.filter("checks", lambda c: ~c["passed"]))
    return rows.select("page", "layout_quality", "content_quality", "quality_result", C.verdict(F.col("checks"), F.col("content_quality")).alias("status"), C.readability(F.col("checks")).alias("readability"), failed.alias("n_failed"))


#: The audit's phrases and fragments for the derived pages.
REQUIRED = {"masthead": ("KUVA ERIKOIS", "ILTA-SANOMAT"), "meta": ("N:o 87", "Tiistaina", "1 mk"), "main_headline": ("JO 39 KUOLONUHRIA",), "secondary_headline": ("TEHDASRAJAYKSESSA",), "image_caption": ("murhe KASVOL",), "lower_headline": ("LAPUA ERISTET",), "continuation": ("JATKUU TAKASIVULLE",)}
FORBIDDEN = (("spring", True), ("blue ste", False), ("no such", False))
TRUNCATED = (("almond", True),)


def content_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.audit(_outputs(spark, sf_dir).withColumn("layout_quality", F.lit("PASS")), required=REQUIRED, forbidden=FORBIDDEN, truncated=TRUNCATED, once=("LAPUA ERISTET", "KUOLONUHRIA"))
    one = F.transform("segment_audit", lambda s: F.concat_ws(":", s["name"], s["status"], F.array_join(s["missing"], "|")))
    joined = {c: F.array_join(c, ",") for c in ("forbidden_found", "duplicates", "truncated_segments", "misassignments")}
    return rows.select("page", F.array_join(one, ",").alias("segments"), *[v.alias(c) for c, v in joined.items()], "content_loss", "content_quality", "quality_result")


def sidebar_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sidebar with lines repeated and the lower headline put in, cleaned; and the caption with what a blob adds."""
    model = _model(spark, sf_dir)
    noisy = F.concat_ws("\n", "sidebar_text", F.col("lower_headline.text"), "sidebar_text", F.lit("Lataamorakennuksen luona"))
    caption = N.enriched(N.text_of("image_caption"), F.concat(F.lit("Ja sitten "), F.col("main_headline.text"), F.lit(" viimein loppui kaikki")), (("viimein", 8), ("murhe", 5)))
    return model.withColumn("sidebar_text", noisy).select("page", N.clean_sidebar().alias("sidebar"), caption.alias("caption"))


def drawn_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = _classified(spark, sf_dir)
    facts = X.facts(X.structural(every)).unionByName(X.facts(X.facsimile(every)).withColumn("page", -1 - F.col("page")))
    return C.exploded(facts, C.drawn()).select("page", "name", "passed")


def typography_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = K.with_sizes(_model(spark, sf_dir), G.PDF_WIDTH, PDF_HEIGHT, Settings())
    box = K.metadata_box()
    sizes = [F.round(f"size_{r}", 6).alias(r) for r, *_ in K.STYLES]
    return rows.select("page", *sizes, F.array_join("type_warnings", ",").alias("warnings"), "masthead_unlike", F.round(K.metadata_confidence(), 9).alias("confidence"), *[box[c].alias(f"meta_{c}") for c in ("x1", "y1", "x2", "y2")], K.caption_shown().alias("caption"))


def typography_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Styles of a page without any text of its own: a model of one empty page."""
    out = K.styles(K.with_sizes(_model(spark, sf_dir), G.PDF_WIDTH, PDF_HEIGHT, Settings()))
    return out.groupBy("role", "font", "weight", "align", "upper", "condensed", "colour").agg(F.count("*").alias("pages"), F.round(F.avg("size"), 6).alias("size"))


def visual_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = Y.visual_metrics(Y.stacked(B.zones(_classified(spark, sf_dir))))
    rows = placed.withColumns({"size_bottom_column_body": F.when(F.col("page") % 3 == 0, 5.0).otherwise(6.5), "masthead_mode": F.lit("text"), "masthead_unlike": F.col("page") % 5 == 0})
    return C.exploded(rows, C.visual(F.col("page") % 7 == 0)).select("page", "name", "passed")


def crop_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.crop_policy(_classified(spark, sf_dir)).withColumn("coverage", F.round("coverage", 9))


def block_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of the derived pages, of a page 1,000 wide, and what is told from them."""
    out = D.from_blocks(_raw(spark, sf_dir), 1000.0)
    kinds = F.array_join(F.transform("blocks", lambda b: b["kind"]), ",")
    return out.select("page", "title", *[F.col(f"photo.{c}").alias(f"photo_{c}") for c in ("x", "y", "width", "height")], kinds.alias("kinds"), D.is_multi_column().alias("multi"), D.column_count().alias("columns"), D.is_sufficient().alias("sufficient"), D.is_weak(F.lit(0.7), 0.6).alias("weak"), D.uses_layout().alias("uses_layout"))


def structured_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.from_blocks(_raw(spark, sf_dir), 1000.0).select("page", D.structured_markdown().alias("structured"), D.flowing_markdown().alias("flowing"), F.md5(D.markdown()).alias("auto"))


def _set_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every third document set in two columns, with wide ones between."""
    lines = P.noisy_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    idx, two = F.col("idx"), F.col("doc_id") % 3 == 1
    left = F.when(two & (idx % 4 == 1), 60.0).otherwise(0.0)
    right = F.when(two & (idx % 4 != 3), left + 40.0).otherwise(100.0)
    return lines.withColumns({"x_min": left, "x_max": right})


def line_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = D.from_lines(_set_lines(spark, sf_dir))
    return out.select("doc_id", "title", F.array_join(F.transform("blocks", lambda b: b["kind"]), ",").alias("kinds"), D.is_multi_column().alias("multi"), D.structured_markdown().alias("markdown"))


def _results(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A text engine's and a layout engine's results; each lacks some documents, and some are poor."""
    docs, k = _table(spark, sf_dir, "documents"), F.col("doc_id")
    lines = F.split("text", "\n")
    first, other = F.trim(F.get(lines, F.lit(0))), F.coalesce(F.trim(F.get(lines, F.lit(1))), F.lit(""))
    block = lambda i, kind, *ps: F.struct(F.lit(float(i)).alias("y_min"), F.lit(i).alias("rank"), F.lit(kind).alias("kind"), F.array(*ps).alias("paragraphs"))
    none = F.array().cast("array<struct<y_min:double,rank:int,kind:string,paragraphs:array<string>>>")
    photo = lambda c: F.when(c, F.struct(F.lit(1).alias("x"), F.lit(2).alias("y"), F.lit(3).alias("width"), F.lit(4).alias("height")))
    blocks = F.when(k % 3 == 0, F.array(block(0, "left", first), block(1, "right", other))).when(k % 3 == 1, F.array(block(2, "full", other))).otherwise(none)
    title = F.when(k % 11 == 0, "Asiakirja").otherwise(first)
    layout = docs.where("doc_id % 7 <> 0").select("doc_id", F.concat(F.lit("# "), title, F.lit("\n\n"), F.substring("text", 1, 60)).alias("markdown"), title.alias("title"), photo(k % 4 == 1).alias("photo"), blocks.alias("blocks"), (k % 3 == 0).alias("uses_layout"), ((k % 10) / 10).alias("confidence"), F.lit(1).alias("pages"))
    markdown = F.when(k % 4 == 0, F.concat(first, F.lit("\n\nTwo."))).when(k % 13 == 1, "").otherwise(F.concat(F.lit("# "), other, F.lit("\n\nOne.\n\n## Oikea palsta\n"), first, F.lit("\n\nThree.")))
    text = docs.where("doc_id % 5 <> 0").select("doc_id", markdown.alias("markdown"), other.alias("title"), photo(k % 6 == 1).alias("photo"), F.when(k % 2 == 0, F.array(block(2, "full", first))).otherwise(none).alias("blocks"), F.lit(False).alias("uses_layout"), F.lit(0.85).alias("confidence"), F.lit(2).alias("pages"))
    return text, layout


def engine_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whose words and layout count, and the paragraphs that are laid out."""
    out = E.choose(*_results(spark, sf_dir), Settings())
    paragraphs = F.array_join(F.transform(F.coalesce("blocks", F.array().cast("array<struct<y_min:double,rank:int,kind:string,paragraphs:array<string>>>")), lambda b: F.array_join(b["paragraphs"], "|")), "/")
    return out.select("doc_id", "text_source", "layout_source", "order_source", "markdown", "uses_layout", "title", F.round("confidence", 9).alias("confidence"), "document", paragraphs.alias("paragraphs"))


def engine_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whose document is laid out if the layout engine only helps, and where the engines differ."""
    text, layout = _results(spark, sf_dir)
    picked = E.pick_document(text, layout)
    found = E.conflicts(text, layout, Settings()).groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "type", "resolution"))), ",").alias("conflicts"))
    weak = layout.select("doc_id", D.is_weak(F.col("confidence"), 0.6).alias("weak"), D.column_count().alias("columns"))
    return picked.join(found, "doc_id", "left").join(weak, "doc_id", "left").select("doc_id", "source", F.coalesce("conflicts", F.lit("")).alias("conflicts"), "weak", "columns")


def engine_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    text, layout = _results(spark, sf_dir)
    return E.summary(text, "text").union(E.summary(layout, "layout")).withColumn("confidence", F.round("confidence", 9)).drop("uses_layout")


def text_engine_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = _table(spark, sf_dir, "conversations").where("text is not null")
    scores = F.when(F.col("turn") % 3 == 0, F.array().cast("array<double>")).otherwise(F.array((F.length("text") % 10) / 10.0, (F.length("text") % 7) / 7.0))
    pages = talks.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), scores.alias("scores"), (F.length("text") % 2).alias("n_blocks"))
    return E.text_engine_confidence(pages).withColumn("confidence", F.round("confidence", 9))


def page_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _raw(spark, sf_dir)
    others = raw.withColumns({"text": F.concat("text", F.lit(" seen")), "x1": F.col("x1") + 15, "x2": F.col("x2") + 15}).where("pos % 3 <> 0")
    kinds = F.array(*[F.struct(F.lit(i).alias("n"), F.lit(t).alias("block_type"), *[F.lit(float(v)).alias(c) for c, v in zip(("x1", "y1", "x2", "y2"), b, strict=True)]) for i, (t, b) in enumerate(CANDIDATES)])
    candidates = raw.select("page").distinct().select("page", F.explode(kinds).alias("k")).select("page", "k.*")
    out = B.page_layout(raw, others, candidates)
    return out.select("page", "id", "reading_order", "block_type", "font_role", "render_mode", "text", "engine", *[F.round(c, 6).alias(c) for c in ("px1", "py1", "px2", "py2")])


CANDIDATES = (("main_headline", (10, 20, 900, 90)), ("hero_image", (50, 264, 620, 864)), ("right_sidebar", (720, 216, 970, 936)), ("bottom_columns", (0, 864, 230, 1140)), ("bottom_columns", (250, 864, 480, 1140)), ("hero_image", (0, 0, 9, 9)), ("continuation_box", (780, 1056, 970, 1164)))


def layout_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = B.layout_metrics(_classified(spark, sf_dir), reflow_used=True)
    return out.withColumns({"warnings": F.array_join("warnings", ","), "source_aspect": F.round("source_aspect", 9), "pdf_aspect": F.round("pdf_aspect", 9)})


def search_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third block read by a second engine too, moved and changed a little, beside blocks that only it has seen."""
    every = stored(_classified(spark, sf_dir), "classified")
    raw = every.select("page", "pos", "label", "text", "x1", "y1", "x2", "y2")
    others = raw.withColumns({"text": F.concat(F.lit("the "), "text"), "y1": F.col("y1") + F.when(F.col("pos") % 6 == 0, 300).otherwise(9), "y2": F.col("y2") + F.when(F.col("pos") % 6 == 0, 300).otherwise(9)}).where("pos % 3 = 0")
    out = R.search_text(every, others)
    return out.select("page", "full_text", F.size("removed").alias("n_removed"), "n_before", "n_after")


def structural_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.structural(_classified(spark, sf_dir)).withColumn("size", F.round("size", 6))


def render_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = _classified(spark, sf_dir)
    plan = X.structural(every)
    out = X.facts(plan).join(X.render_report(plan, every).drop("full_page"), "page")
    return out.withColumn("pdf_text", F.md5("pdf_text")).withColumn("image_top", F.round("image_top", 6))


def zone_order_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J: whether headlines and photo lie as they should, by the tops of the page's blocks."""
    top = lambda *t: F.min(F.when(F.col("block_type").isin(*t), F.col("y1")))
    hero = F.min(F.when(F.col("block_type") == "hero_image", F.struct((-G.area(B.box())).alias("a"), "pos", "y1")))["y1"]
    rows = _classified(spark, sf_dir).groupBy("page").agg(hero.alias("hero"), top("main_headline").alias("main"), top("secondary_headline").alias("secondary"), top("masthead_logo", "newspaper_name").alias("masthead"), top("bottom_headline").alias("bottom"))
    return C.exploded(rows, C.order({k: F.col(k) for k in ("hero", "main", "secondary", "masthead", "bottom")}, F.lit(1200.0))).select("page", "name", "passed")


def template_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No SQL of its own: zones, sizes and texts have theirs. Held by tests."""
    every = _classified(spark, sf_dir)
    sized = K.with_sizes(_model(spark, sf_dir), G.PDF_WIDTH, PDF_HEIGHT, Settings())
    return X.overflow(X.template(sized, Y.stacked(B.zones(every))))


def reflow_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("# Title\n\n---\n"), "text").alias("markdown"))
    return X.reflow(docs, columns=2)


def overlay_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.overlay(_classified(spark, sf_dir))


def facsimile_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.facsimile(_classified(spark, sf_dir)).withColumn("size", F.round("size", 6))


def crop_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = _classified(spark, sf_dir)
    policy = B.crop_policy(every).groupBy("page").agg(F.sum((F.col("block_type") == "hero_image").cast("int")).alias("photo_crops"), F.array_sort(F.collect_list(F.when((F.col("block_type") == "hero_image") & ~F.col("can_crop"), F.col("pos").cast("string")))).alias("forbidden"))
    rows = policy.join(X.facts(X.structural(every)), "page").withColumns({"text_crops": F.lit(0), "masthead_mode": F.lit("text")})
    return C.exploded(rows, C.crops()).select("page", "name", "passed")


def _json_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, json): a page object of each conversation, in several shapes; some aren't pages."""
    talks = _table(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    label = F.when(F.col("turn") % 5 == 4, "header").when(F.col("turn") % 5 == 3, "image").otherwise("text")
    n = F.col("turn").cast("double")
    block = F.when(F.col("turn") % 2 == 0, F.to_json(F.struct(label.alias("block_label"), F.col("text").alias("block_content"), F.array(n, n * 10, n + 50, n * 10 + 9).alias("block_bbox"), n.alias("block_order")))).otherwise(F.to_json(F.struct(label.alias("label"), F.col("text").alias("content"), F.array(n, n).alias("bbox"))))
    rows = talks.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", block.alias("b"), F.coalesce("text", F.lit("")).alias("t"), (n / 10).alias("s")))).alias("r"))
    blocks = F.concat(F.lit('{"width": 100, "parsing_res_list": [null, '), F.array_join(F.transform("r", lambda x: x["b"]), ", "), F.lit("]}"))
    ocr = F.to_json(F.struct(F.transform("r", lambda x: x["t"]).alias("rec_texts"), F.transform("r", lambda x: x["s"]).alias("rec_scores"), F.transform("r", lambda x: F.when(x["turn"] % 2 == 0, F.array(F.array(x["s"], x["s"]), F.array(x["s"] + 3, x["s"] + 1), F.array(x["s"])))).alias("rec_polys")))
    k = F.col("conv_id") % 6
    json = F.when(k == 0, F.concat(F.lit('{"res": '), blocks, F.lit("}"))).when(k == 1, blocks).when(k == 2, ocr).when(k == 3, F.concat(F.lit('{"overall_ocr_res": '), ocr, F.lit("}"))).when(k == 4, F.concat(F.lit('{"res": {"overall_ocr_res": '), ocr, F.lit("}}"))).otherwise("[1, 2")
    return rows.select(F.concat(F.lit("p"), F.col("conv_id").cast("string"), F.element_at(F.array(F.lit(".JPG"), F.lit(".pdf"), F.lit(".txt"), F.lit(".tiff")), (F.col("conv_id") % 4 + 1).cast("int"))).alias("path"), json.alias("json"))


def page_json_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.page_blocks(P.parse_page_json(_json_pages(spark, sf_dir)))


def page_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.page_lines(P.parse_page_json(_json_pages(spark, sf_dir)))


def page_json_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's text, mean score, kind of input and whether it is a page; one path has no file."""
    pages = _json_pages(spark, sf_dir)
    more = pages.select("path").union(spark.createDataFrame([("missing.png",)], "path string"))
    parsed = P.pages_of(more, P.parse_page_json(pages))
    rows = P.page_text(parsed).join(P.mean_score(parsed), "path").join(parsed.select("path", "corrupt"), "path")
    return rows.select("path", "text", F.round("confidence", 9).alias("confidence"), "corrupt", P.input_kind(F.col("path")).alias("kind"))


def output_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _json_pages(spark, sf_dir).select("path", F.concat(F.lit("/in/a.b/"), "path").alias("full"))
    return S.manifest(docs.select(F.col("path").alias("doc_id"), F.col("full").alias("path")), Settings(emit_clean=True, emit_debug_pdf=True))


def output_hygiene(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(
        F.struct(F.lit("root").alias("place"), F.lit("a.md").alias("name"), (F.col("doc_id") % 3).alias("bytes")), F.struct(F.lit("root").alias("place"), F.when(F.col("doc_id") % 4 == 0, "a_test.pdf").otherwise("a_structural.pdf").alias("name"), F.lit(9).cast("long").alias("bytes")),
        F.struct(F.when(F.col("doc_id") % 5 == 0, "root").otherwise("debug").alias("place"), F.when(F.col("doc_id") % 7 == 0, "a_facsimile.pdf").otherwise("b.json").alias("name"), F.lit(9).cast("long").alias("bytes")),
    )).alias("f")).select("doc_id", "f.*")
    return S.hygiene_checks(files, emit_facsimile=False).select("doc_id", "name", "passed")


def error_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _outputs(spark, sf_dir).select("page", "markdown", F.explode(C.phrases_in_markdown(PHRASES)).alias("c"))
    return S.error_rows(rows.select(F.col("page").alias("doc_id"), "c.*"), "gate_")


def json_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Engine summaries as JSON, with fields of the second put into the first's."""
    text, layout = _results(spark, sf_dir)
    side = lambda r, e, extra: E.summary(r, e).select("doc_id", F.map_concat(F.create_map(F.lit("engine"), F.lit(e), F.lit("chars"), F.col("chars").cast("string")), extra).alias("fields"))
    both = E.merged_fields(side(text, "text", F.create_map(F.lit("pages"), F.col("pages").cast("string"))), side(layout, "layout", F.create_map(F.lit("uses_layout"), F.col("uses_layout").cast("string"))))
    return both.select("doc_id", S.report("report", F.col("fields")["engine"].alias("engine"), F.col("fields")["pages"].alias("pages"), F.col("fields")["chars"].alias("chars"), F.col("fields")["uses_layout"].alias("uses_layout")))


def near_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page, pos, other) of blocks near each other, and their relative and cut boxes."""
    blocks = P.derived_blocks(_table(spark, sf_dir, "lineitem"), _table(spark, sf_dir, "part"))
    a, b = blocks.select("page", "pos", B.box().alias("a")), blocks.select("page", F.col("pos").alias("other"), B.box().alias("b"))
    pairs = a.join(b, "page").where((F.col("pos") < F.col("other")) & G.near(F.col("a"), F.col("b")))
    rel, rect = G.to_relative(F.col("a"), F.lit(1000.0), F.lit(1200.0)), G.clamp_rect(G.crop_rect(F.col("a")), F.lit(700), F.lit(600))
    return pairs.select("page", "pos", "other", *[F.round(rel[c], 9).alias(f"rel_{c}") for c in "xywh"], *[rect[c].alias(c) for c in ("x", "y", "width", "height")])


def line_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Noise, metadata, page numbers, truncation, previews and segments of the front blocks' texts and documents' lines."""
    text = F.col("text")
    rows = _raw(spark, sf_dir).select("page", "pos", F.when(F.col("pos") % 19 == 3, "Sivu 12").when(F.col("pos") % 19 == 4, F.concat(text, F.lit(" aaaa"))).otherwise(text).alias("text"))
    return rows.select("page", "pos", T.is_noise(text).alias("noise"), T.is_issue_line(text).alias("issue"), T.is_date_line(text).alias("date"), T.is_stars_line(text).alias("stars"), T.is_price_line(text).alias("price"), T.starts_with_metadata(text).alias("starts"), T.is_page_number(text).alias("page_number"), C.looks_truncated(text, (("almond", True), ("ste", False))).alias("truncated"), T.preview(text).alias("preview"), T.normalized_segment(text).alias("segment"), T.first_line(text).alias("first"), T.normalized_caption(text).alias("caption"))


def language_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    said = F.element_at(F.array(F.upper("lang"), F.concat("lang", F.lit("_XX")), F.concat(F.lit(" "), "lang", F.lit("-yy ")), F.lit("fi"), F.lit("")), (F.col("doc_id") % 5 + 1).cast("int"))
    return docs.select("doc_id", T.language_code(said).alias("code"), T.model_language(said).alias("model"), F.array_join(T.language_priority(said, F.array(F.lit("sv"), F.lit("EN"), F.col("lang"))), ",").alias("priority"))


def queries() -> dict:
    return {n: f for n, f in globals().items() if callable(f) and getattr(f, "__module__", "") == __name__ and not n.startswith("_") and n != "queries"}
