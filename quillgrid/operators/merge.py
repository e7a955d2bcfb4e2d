"""Two engines' results on the same pages, joined by page and overlap: never more pairs than a page's blocks allow."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as T
from ..functions.fuzzy import distinct
from .blocks import box


def best_overlap(blocks: DataFrame, other: DataFrame, least: float = 0.15) -> DataFrame:
    """(page, pos, text, iou): a block's text, or that of the other engine's block of the highest IoU, the first among
    equals, if it reaches least."""
    a = blocks.select("page", "pos", F.col("text").alias("own"), box().alias("a"))
    b = other.select("page", F.col("pos").alias("other_pos"), F.col("text").alias("theirs"), box().alias("b"))
    pairs = a.join(b, "page").where(G.overlaps(F.col("a"), F.col("b"))).withColumn("iou", G.iou(F.col("a"), F.col("b")))
    best = pairs.groupBy("page", "pos").agg(F.min(F.struct((-F.col("iou")).alias("s"), "other_pos", "theirs")).alias("m"))
    iou = F.coalesce(-F.col("m.s"), F.lit(0.0))
    return a.join(best, ["page", "pos"], "left").select("page", "pos", F.when(iou >= least, F.col("m.theirs")).otherwise(F.col("own")).alias("text"), iou.alias("iou"))


def unmatched(blocks: DataFrame, other: DataFrame, most: float = 0.12, chars: int = 4) -> DataFrame:
    """The other engine's blocks of `chars` characters or more that no block reaches with an IoU of `most`."""
    a = blocks.select("page", box().alias("a"))
    b = other.where(F.length(F.trim(F.coalesce("text", F.lit("")))) >= chars).withColumn("b", box())
    return b.join(a, (b["page"] == a["page"]) & G.overlaps(a["a"], b["b"]) & (G.iou(a["a"], b["b"]) >= most), "left_anti").drop("b")


def zip_paragraphs(blocks: DataFrame, pars: DataFrame) -> DataFrame:
    """(doc_id, n, text): paragraph n becomes block n's text; blocks beyond keep theirs; what is left over is added to the
    last block, a line each. blocks: doc_id, n, text (n from 1); pars: doc_id, n, par."""
    count = blocks.groupBy("doc_id").agg(F.max("n").alias("last"))
    placed = pars.join(count, "doc_id").select("doc_id", F.least("n", "last").alias("n"), F.col("n").alias("k"), "par")
    new = placed.groupBy("doc_id", "n").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "par"))), lambda s: s["par"]), "\n").alias("new"))
    return blocks.join(new, ["doc_id", "n"], "left").select("doc_id", "n", F.coalesce("new", "text").alias("text"))


def conflicts(a: DataFrame, b: DataFrame) -> DataFrame:
    """(doc_id, type, resolution): where two engines differ in title or text (after case and white space: the first
    engine's is taken), or in the number of columns (the second's). a, b: doc_id, title, body, columns."""
    both = a.alias("a").join(b.alias("b"), "doc_id")
    unlike = lambda c: (T.fingerprint(F.col(f"a.{c}")) != T.fingerprint(F.col(f"b.{c}"))) & (T.strip(F.col(f"a.{c}")) != "") & (T.strip(F.col(f"b.{c}")) != "")
    columns = (F.col("a.columns") > 0) & (F.col("b.columns") > 0) & (F.col("a.columns") != F.col("b.columns"))
    found = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(t).alias("type"), F.lit(r).alias("resolution"))) for c, t, r in ((unlike("title"), "title", "first"), (unlike("body"), "text", "first"), (columns, "layout", "second"))]))
    return both.select("doc_id", F.explode(found).alias("c")).select("doc_id", "c.*")


def blended_confidence(scores: DataFrame, default: float = 0.0) -> DataFrame:
    """(doc_id, confidence): the mean of the engines that have one."""
    return scores.groupBy("doc_id").agg(F.coalesce(F.avg("confidence"), F.lit(default)).alias("confidence"))


def best_language(attempts: DataFrame, enough: float = 0.9) -> DataFrame:
    """(doc_id, lang, confidence): attempts (doc_id, attempt, lang, confidence) stop after the first that is enough; of
    those made, the highest confidence wins, the last among equals."""
    order = Window.partitionBy("doc_id").orderBy("attempt").rowsBetween(Window.unboundedPreceding, -1)
    made = attempts.withColumn("done", F.coalesce(F.max((F.col("confidence") >= enough).cast("int")).over(order), F.lit(0))).where("done = 0")
    best = made.groupBy("doc_id").agg(F.max(F.struct("confidence", "attempt", "lang")).alias("m"))
    return best.select("doc_id", "m.lang", "m.confidence")


def quality(text: Column, confidence: Column, of_text_engine: Column | None = None) -> Column:
    """A block's worth: its length, 20 for full confidence, 15 if the text engine read it, less 25 for noise."""
    bonus = F.lit(0.0) if of_text_engine is None else F.when(of_text_engine, 15.0).otherwise(0.0)
    return F.length(F.trim(text)) + 20 * F.coalesce(confidence, F.lit(0.0)) + bonus - F.when(T.is_noise(text), 25.0).otherwise(0.0)


def exact_duplicates(blocks: DataFrame) -> DataFrame:
    """(page, pos, kept_pos): for each block whose normalised text stands on the page, the block that is kept of them:
    that of the best quality (length and confidence), the first among equals."""
    rows = blocks.withColumn("norm", T.normalized_for_match(F.col("text"))).where("norm <> ''").withColumn("quality", quality(F.col("text"), F.col("confidence")))
    best = F.min(F.struct((-F.col("quality")).alias("q"), "pos")).over(Window.partitionBy("page", "norm"))
    return rows.select("page", "pos", best["pos"].alias("kept_pos"))


def fuzzy_duplicates(blocks: DataFrame) -> DataFrame:
    """(page, pos, kept_pos, similarity) of removed blocks, greedily by pos: a block like one that is kept (fuzzy.alike) goes,
    or takes its place if its quality is higher. Sequential by its semantics, so a page is one row. Blocks: page, pos, text,
    region, confidence, x1..y2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for page, rows in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                out += [(page, gone["pos"], kept["pos"], score) for kept, gone, score in distinct(rows)[1]]
            columns = list(zip(*out, strict=True)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.float64()), strict=True)], names=["page", "pos", "kept_pos", "similarity"])

    rows = blocks.select(F.col("page").cast("long").alias("page"), F.col("pos").cast("int").alias("pos"), T.normalized_for_match(F.col("text")).alias("norm"), F.coalesce("region", F.lit("")).alias("region"), "x1", "y1", "x2", "y2", quality(F.col("text"), F.col("confidence")).alias("quality"))
    whole = rows.where("norm <> ''").groupBy("page").agg(F.array_sort(F.collect_list(F.struct("pos", "norm", "region", "x1", "y1", "x2", "y2", "quality"))).alias("rows"))
    return whole.mapInArrow(run, "page long, pos int, kept_pos int, similarity double")
