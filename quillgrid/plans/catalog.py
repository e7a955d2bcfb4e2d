"""Queries of the layout operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..lexicon import Lexicon
from ..operators import blocks as B
from ..operators import layout as Y
from ..operators import lines as L
from ..operators import markdown as M
from ..operators import merge as J
from ..operators import quality as Q
from ..sources import pages as P

#: Phrases for the query, and literal corrections for its own noise.
SHORT_PHRASES = [(-1, "the"), (-2, "of The"), (-3, "ation"), (-4, ""), (-5, "no such phrase at all"), (-6, "e of the l")]
CORRECTIONS = (("tione", "tion e"), ("erth", "earth"), ("lich", "light"))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", "text")


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.derived_blocks(_table(spark, sf_dir, "lineitem"), _table(spark, sf_dir, "part"))


def _shifted(blocks: DataFrame) -> DataFrame:
    """A second engine's copy: moved, and every third block's text changed."""
    text = F.when(F.col("pos") % 3 == 0, F.concat("text", F.lit(" b"))).otherwise(F.col("text"))
    moved = [(F.col(c) + d).alias(c) for c, d in (("x1", 15), ("y1", 9), ("x2", 15), ("y2", 9))]
    return blocks.select("page", "pos", "label", text.alias("text"), *moved)


def doc_flowing_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.flowing_markdown(P.noisy_lines(_docs(spark, sf_dir)))


def line_dehyphenate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.dehyphenate(P.noisy_lines(_docs(spark, sf_dir))).select("doc_id", "idx", "text", "y_min", "y_max")


def paragraph_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.paragraphs(P.noisy_lines(_docs(spark, sf_dir)))


def headline_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.headline_lines(P.noisy_lines(_docs(spark, sf_dir))).select("doc_id", "idx", "text")


def trailing_signature_dateline(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    tail = F.when(F.col("doc_id") % 4 == 0, "\nPorvoo, 3 May 1987").when(F.col("doc_id") % 4 == 1, "\nOULU 1901,\nas told\nA. B. EDITOR.").when(F.col("doc_id") % 4 == 2, "\nTHE BOARD.").otherwise("")
    return L.trailing(P.document_lines(docs.select("doc_id", F.concat("text", tail).alias("text"))))


def line_fingerprint_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.line_distinct(P.document_lines(_docs(spark, sf_dir))).select("doc_id", "idx", "text")


def column_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.column_split(_blocks(spark, sf_dir))


def column_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.assign_columns(_blocks(spark, sf_dir)).select("page", "pos", "side")


def classify_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.classify(_blocks(spark, sf_dir)).select("page", "pos", "block_type", "font_role", "render_mode")


def page_type_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.page_types(B.classify(_blocks(spark, sf_dir)))


def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.reading_order(B.classify(_blocks(spark, sf_dir))).select("page", "pos", "reading_order")


def photo_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.photo_candidates(_blocks(spark, sf_dir)).select("page", "pos", "rect.*")


def zone_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.zones(B.classify(_blocks(spark, sf_dir)))


def zone_stacking(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = Y.stacked(B.zones(B.classify(_blocks(spark, sf_dir))))
    return placed.select("page", "zone", *[F.round(c, 6).alias(c) for c in ("x", "y", "w", "h", "share")])


def visual_layout_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = Y.visual_metrics(Y.stacked(B.zones(B.classify(_blocks(spark, sf_dir)))))
    return out.select("page", "warnings", *[F.round(c, 6).alias(c) for c in out.columns if c not in ("page", "warnings")])


def photo_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On a page small enough for the derived blocks to be photos of it."""
    return Y.photo_scores(_blocks(spark, sf_dir), 700.0, 700.0).withColumn("score", F.round("score", 9))


def round_robin_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = P.document_lines(_docs(spark, sf_dir))
    return Y.round_robin(lines.select("doc_id", (F.col("idx") + 1).alias("n"), "text"))


def text_coverage_crop_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.text_coverage(_blocks(spark, sf_dir))


def bbox_pdf_coords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.pdf_boxes(_blocks(spark, sf_dir)).select("page", "pos", *[F.round(c, 6).alias(c) for c in ("px1", "py1", "px2", "py2")])


def caption_candidates_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = Lexicon(caption_keywords=("blue", "steel"), headline_markers=("RED",), metadata_markers=("GREEN",))
    return B.caption_candidates(_blocks(spark, sf_dir), words)


def role_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.segments(B.classify(_blocks(spark, sf_dir)))


def iou_text_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = _blocks(spark, sf_dir)
    return J.best_overlap(blocks, _shifted(blocks)).withColumn("iou", F.round("iou", 9))


def unmatched_blocks_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = _blocks(spark, sf_dir)
    return J.unmatched(blocks.where("pos % 2 = 0"), _shifted(blocks)).select("page", "pos", "text")


def paragraph_zip_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = P.document_lines(_docs(spark, sf_dir))
    blocks = lines.where("idx < 3").select("doc_id", (F.col("idx") + 1).alias("n"), F.concat(F.lit("block "), F.col("idx").cast("string")).alias("text"))
    return J.zip_paragraphs(blocks, lines.select("doc_id", (F.col("idx") + 1).alias("n"), F.col("text").alias("par")))


def engine_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    first = F.get(F.split("text", "\n"), F.lit(0))
    a = docs.select("doc_id", first.alias("title"), F.col("text").alias("body"), F.lit(2).alias("columns"))
    b = docs.select("doc_id", F.when(F.col("doc_id") % 4 == 0, F.concat(first, F.lit(" x"))).otherwise(F.concat(F.lit("  "), first)).alias("title"), F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("body"), (F.col("doc_id") % 3).cast("int").alias("columns"))
    return J.conflicts(a, b)


def engine_blend_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _table(spark, sf_dir, "labels")
    one, two = labels.select("doc_id", (F.lit(0.5) + 0.25 * F.col("quality")).alias("confidence")), labels.select("doc_id", F.when(F.col("toxic") == 0, F.lit(0.75)).alias("confidence"))
    return J.blended_confidence(one.unionByName(two))


def language_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    tries = F.array(*[F.struct(F.lit(i).alias("attempt"), F.lit(x).alias("lang"), (F.when(F.col("lang") == x, 0.92).otherwise(0.0) + ((F.col("doc_id") * (i + 3)) % 17) / 100.0).alias("confidence")) for i, x in enumerate(("en", "de", "fr", "es"))])
    out = J.best_language(docs.select("doc_id", F.explode(tries).alias("t")).select("doc_id", "t.*"))
    return out.withColumn("confidence", F.round("confidence", 6))


def lowconf_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = P.document_lines(_docs(spark, sf_dir)).select("doc_id", (((F.col("doc_id") * 7 + F.col("idx") * 13) % 100) / 100.0).alias("score"))
    return Q.needs_fallback(lines).withColumn("confidence", F.round("confidence", 6)).withColumn("low_share", F.round("low_share", 6))


def quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    checks = F.array(
        F.struct(F.lit("text_exists").alias("name"), (F.length("text") > 20).alias("passed")),
        F.struct(F.lit("price_once").alias("name"), (T.occurrences(F.col("text"), "@") <= 1).alias("passed")),
        F.struct(F.lit("length_warning").alias("name"), (F.length("text") < 4000).alias("passed")),
    )
    return Q.verdicts(docs.select("doc_id", F.explode(checks).alias("c")).select("doc_id", "c.*"))


def layout_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = B.zones(B.classify(_blocks(spark, sf_dir)))
    rendered = source.withColumn("w", F.greatest(F.lit(0.18), F.least(F.lit(0.72), F.col("w")))).withColumn("h", F.greatest(F.lit(0.09), F.col("h")))
    return Q.drift(source, rendered).withColumn("difference", F.round("difference", 9))


def phrase_coverage_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark's passages, and short phrases: of one or two words, parts of words, and none."""
    short = spark.createDataFrame(SHORT_PHRASES, "item_id long, text string")
    return Q.phrase_coverage(_docs(spark, sf_dir), _table(spark, sf_dir, "benchmark").select("item_id", "text").union(short))


def exact_text_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = _blocks(spark, sf_dir).withColumn("page", F.floor(F.col("page") / 50)).withColumn("confidence", F.lit(0.85))
    from pyspark.sql import Window

    blocks = blocks.withColumn("pos", F.row_number().over(Window.partitionBy("page").orderBy("x1", "y1", "x2", "y2", "label", "text")))
    return J.exact_duplicates(blocks)


def fuzzy_block_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = B.classify(_blocks(spark, sf_dir))
    both = blocks.withColumn("confidence", F.lit(0.85)).withColumnRenamed("font_role", "region").select("page", "pos", "text", "region", "confidence", "x1", "y1", "x2", "y2")
    copy = _shifted(blocks).select("page", (F.col("pos") + 1000).alias("pos"), "text", F.lit("body").alias("region"), F.lit(0.9).alias("confidence"), "x1", "y1", "x2", "y2")
    return J.fuzzy_duplicates(both.unionByName(copy))


def correction_table_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.md5(T.corrected(F.col("text"), CORRECTIONS)).alias("digest"))


def final_text_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    noisy = F.concat(F.regexp_replace("text", " (the|de|la) ", "-\n$1 "), F.lit("\u00ad\x01 kasvol etta\n 1 mk (sis. lvv \npelätään. vielä on- nettomuus"))
    docs = _docs(spark, sf_dir).select("doc_id", noisy.alias("t"))
    return docs.select("doc_id", F.md5(T.cleaned(F.col("t"))).alias("digest"), F.array_join(T.cleanup_issues(F.col("t")), ",").alias("issues"))


def phrase_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", T.phrase_context(F.col("text"), "license").alias("context"))


def wrap_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.document_lines(_docs(spark, sf_dir)).select("doc_id", "idx", F.array_join(T.wrapped(F.col("text"), 40), "\n").alias("text"))


def mojibake_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit(" pÃ¤ivÃ¤Ã¤ – �"))).when(F.col("doc_id") % 3 == 1, F.concat("text", F.lit(" pÃ¤ivÃ¤ Ã©"))).otherwise(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", T.repair_mojibake(t).alias("text"))


def markdown_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).select("doc_id", F.concat(F.lit("# Title "), F.col("doc_id").cast("string"), F.lit("\n\n---\n## Part\n> a\n> b\n\n"), F.col("text")).alias("markdown"))
    return M.elements(docs)


def page_consolidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page")).agg(F.min("text").alias("text"))
    return M.consolidate(pages)


def queries() -> dict:
    skip = {"queries"}
    return {n: f for n, f in globals().items() if callable(f) and getattr(f, "__module__", "") == __name__ and not n.startswith("_") and n not in skip}
