"""Two engines' results for a document: whose text, layout, title and Markdown count.

Results: doc_id, markdown, title, photo, blocks (documents), uses_layout, confidence, pages. An engine that didn't run has
no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..settings import Settings
from . import documents as D
from . import markdown as M


def text_engine_confidence(pages: DataFrame, with_blocks: float = 0.85, without_pages: float = 0.75) -> DataFrame:
    """(doc_id, confidence) of pages (doc_id, page, scores, n_blocks): the mean over pages of their scores' mean, or
    with_blocks for pages without scores that have blocks, else 0. Documents come with a row of null page if they have
    no page: without_pages."""
    mean = F.when(F.size("scores") > 0, F.aggregate("scores", F.lit(0.0), lambda a, s: a + s, lambda a: a / F.size("scores")))
    one = F.when(F.col("page").isNotNull(), F.coalesce(mean, F.when(F.col("n_blocks") > 0, with_blocks), F.lit(0.0)))
    return pages.groupBy("doc_id").agg(F.coalesce(F.avg(one), F.lit(without_pages)).alias("confidence"))


def summary(results: DataFrame, engine: str) -> DataFrame:
    """(doc_id, engine, ran, confidence, pages, chars, uses_layout)."""
    return results.select("doc_id", F.lit(engine).alias("engine"), F.lit(True).alias("ran"), "confidence", "pages", F.length("markdown").alias("chars"), "uses_layout")


def merged_fields(report: DataFrame, extra: DataFrame) -> DataFrame:
    """report (doc_id, fields: map) with extra's fields put in; the later value of a name counts. Documents without a
    report get none."""
    both = report.join(extra.select("doc_id", F.col("fields").alias("more")), "doc_id", "left")
    old = F.map_filter("fields", lambda k, _: ~F.coalesce(F.map_contains_key(F.col("more"), k), F.lit(False)))
    return both.select("doc_id", F.when(F.col("more").isNull(), F.col("fields")).otherwise(F.map_concat(old, "more")).alias("fields"))


def _side(results: DataFrame, name: str) -> DataFrame:
    return results.select("doc_id", F.struct("markdown", "title", "photo", "blocks", "uses_layout", "confidence").alias(name))


def pick_document(text: DataFrame, layout: DataFrame, helper: bool = True) -> DataFrame:
    """(doc_id, source): whose document is laid out: the text engine's if it is sufficient, else the layout engine's with
    the text engine's words if that is; none if neither has one."""
    own = text.select("doc_id", D.is_sufficient().alias("own"))
    other = layout.select("doc_id", D.is_sufficient().alias("other"))
    both = own.join(other, "doc_id", "full")
    merged = F.coalesce("other", F.lit(False)) & helper
    return both.select("doc_id", F.when(F.coalesce("own", F.lit(False)), "text").when(merged, "merged").when(F.col("own").isNotNull(), "text").otherwise("none").alias("source"))


def choose(text: DataFrame, layout: DataFrame, settings: Settings, mode: str = "auto") -> DataFrame:
    """One row per document of either engine: text_source, layout_source, order_source, title, markdown, uses_layout,
    confidence, document (whose blocks are laid out: text, layout or merged, with blocks and photo)."""
    rows = _side(text, "t").join(_side(layout, "s"), "doc_id", "full")
    has_t, has_s = F.col("t").isNotNull(), F.col("s").isNotNull()
    by = lambda c: F.when(c, "text_engine").otherwise("layout_engine")
    text_source = by((has_t & settings.use_text_engine_for_text) | ~has_s)
    has_document = has_t & F.col("t.blocks").isNotNull()
    layout_source = by(~(has_s & settings.use_layout_engine_for_layout) & (has_document | ~has_s))
    order_source = by(has_t & settings.use_text_engine_for_reading_order)
    rows = rows.withColumns({"text_source": text_source, "layout_source": layout_source, "order_source": order_source})
    primary = F.coalesce(F.when(F.col("text_source") == "text_engine", F.col("t.markdown")).otherwise(F.col("s.markdown")), F.lit(""))
    rows = rows.withColumn("primary", primary)
    rows = rows.withColumn("primary_title", F.coalesce(M.title(F.col("primary")), F.lit(""))).withColumn("pars", M.body_paragraphs(F.col("primary")))
    # blocks and photo of the document that is laid out
    geometry = has_s & settings.use_layout_engine_for_pdf_geometry
    document = F.when(~geometry, F.when(has_document, "text").when(has_s, "layout")).when(T.strip(F.col("primary")) == "", "layout").otherwise("merged")
    rows = rows.withColumn("document", document).withColumns({c: F.when(F.col("document") == "text", F.col(f"t.{c}")).otherwise(F.col(f"s.{c}")) for c in ("blocks", "photo")})
    merged = F.col("document") == "merged"
    rows = rows.withColumn("blocks", F.when(merged, D.with_paragraphs_of(F.col("pars"))).otherwise(F.col("blocks")))
    own_title = F.when(F.col("document") == "text", F.col("t.title")).otherwise(F.col("s.title"))
    rows = rows.withColumn("title", F.when(merged & (F.col("primary_title") != ""), F.col("primary_title")).otherwise(own_title))
    kept = F.coalesce(F.col("s.uses_layout"), F.lit(False))
    structural = F.lit(mode == "structural") & has_s & F.col("document").isNotNull()
    if settings.use_text_engine_for_text:
        markdown, uses = F.when(structural, D.structured_markdown()).otherwise(F.col("primary")), F.when(structural, F.lit(True)).otherwise(kept)
    else:
        markdown, uses = F.when(has_s, F.col("s.markdown")).otherwise(F.col("primary")), kept
    title = F.when(F.col("primary_title") != "", F.col("primary_title")).otherwise(F.coalesce("s.title", F.lit("")))
    sure = F.coalesce((F.col("t.confidence") + F.col("s.confidence")) / 2, "t.confidence", "s.confidence")
    return rows.select("doc_id", "text_source", "layout_source", "order_source", markdown.alias("markdown"), uses.alias("uses_layout"), title.alias("title"), sure.alias("confidence"), "document", "blocks", "photo")


def conflicts(text: DataFrame, layout: DataFrame, settings: Settings) -> DataFrame:
    """(doc_id, type, resolution) where both ran and differ, after case and white space: in the title and body text (the
    text engine counts), or in the number of columns (the layout engine counts)."""
    side = lambda r, n: r.select("doc_id", M.title(F.col("markdown")).alias(f"{n}md"), F.col("title").alias(f"{n}title"), F.array_join(M.body_paragraphs(F.col("markdown")), " ").alias(f"{n}body"), D.column_count().alias(f"{n}columns"))
    both = side(text, "t").join(side(layout, "s"), "doc_id")
    unlike = lambda a, b: (T.fingerprint(a) != T.fingerprint(b)) & (T.strip(a) != "") & (T.strip(b) != "")
    tests: list[tuple[Column, str, str]] = [(unlike(F.col("tmd"), F.col("stitle")), "title", "text_engine")]
    if settings.use_text_engine_for_text:
        tests.append((unlike(F.col("tbody"), F.col("sbody")), "text", "text_engine"))
    if settings.use_layout_engine_for_layout:
        tests.append((F.col("tcolumns") != F.col("scolumns"), "layout", "layout_engine"))
    found = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(t).alias("type"), F.lit(r).alias("resolution"))) for c, t, r in tests]))
    return both.select("doc_id", F.explode(found).alias("c")).select("doc_id", "c.*")
