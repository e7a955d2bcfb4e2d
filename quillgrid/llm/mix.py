"""Mixing sources to target weights: Efraimidis-Spirakis keys within each source, in SQL functions only.

A document's key is -ln(u) / w for a hashed u in (0, 1) and its quality weight w: ascending keys are weighted sampling
without replacement. Whole epochs of a source come first; what its target has left goes to its documents by key until
their prefix sum reaches it. A hot source is never sorted in one task: the prefix sum is found first over CELLS ranges
of keys, then over as many parts of the one range in which the target is reached, and by rows only in the part of a part
that is left. A range holds a hundredth of a source's rows at most and a part of it 1/CELLS of that, whatever the
weights; only rows with one key, which are the same in doc_id and text, can be more, and those are dealt by file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

WORD = r"[^\x20\x09-\x0D]+"
PUNCTUATION = r"[!-/:-@\[-`{-~]"
WEIGHTS = (5, 2, 1)
#: The least quality weight.
LEAST_WEIGHT = 0.1
CELLS = 1024


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """0.1 to 1, a document's default weight: falls with the share of ASCII punctuation; 0.1 for null or empty texts."""
    share = F.regexp_count(text, F.lit(PUNCTUATION)) / F.length(text)
    return F.when(F.length(text) > 0, F.greatest(F.lit(LEAST_WEIGHT), 1 - 4 * share)).otherwise(F.lit(LEAST_WEIGHT))


def sampling_key(doc_id: Column, text: Column, weight: Column, seed: str) -> Column:
    """-ln(u) / weight, u from 48 bits of the md5 of seed, doc_id and the text's md5: reruns agree."""
    bits = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), doc_id.cast("string"), F.md5(text))), 1, 12), 16, 10).cast("double")
    return -F.log((bits + 0.5) / F.lit(float(1 << 48))) / weight


def key_cell(key: Column) -> Column:
    """0 to CELLS squared - 1, rising with the key. exp(-LEAST_WEIGHT * key) is even in (0, 1) for the least weight, and
    at most 1 / LEAST_WEIGHT times as dense anywhere for others up to 1."""
    cells = CELLS * CELLS
    return F.least(F.floor((1 - F.exp(-LEAST_WEIGHT * key)) * cells), F.lit(cells - 1)).cast("int")


def measured(docs: DataFrame, seed: str, weight: Column | None = None) -> DataFrame:
    """docs (doc_id, text, source and more) and _size, _key and _cell. weight: of a document, LEAST_WEIGHT to 1."""
    weight = quality_weight(F.col("text")) if weight is None else weight
    docs = docs.withColumn("_size", n_words(F.col("text"))).withColumn("_key", sampling_key(F.col("doc_id"), F.col("text"), weight, seed))
    return docs.withColumn("_cell", key_cell(F.col("_key")))


def targets(sources: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple = WEIGHTS) -> DataFrame:
    """sources (source, source_size) and target.

    Sources by code point, null last, weigh as weights repeat. The ranks come from a range partitioning and its
    partitions' counts; what is reshared is found from three sums a round, never from a collected table.
    """
    order = F.col("source").asc_nulls_last()
    placed = written(sources.repartitionByRange(order).sortWithinPartitions(order).withColumn("at", F.monotonically_increasing_id()), "sources")
    placed = placed.withColumn("p", F.shiftright("at", 33)).withColumn("i", F.col("at").bitwiseAND((1 << 33) - 1))
    before = placed.groupBy("p").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("p")) - F.col("n")).drop("n")
    by_rank = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("before") + F.col("i")) % len(weights) + 1).cast("int"))
    placed = written(placed.join(before, "p").select("source", "source_size", by_rank.alias("w"), (F.col("source_size") * most).alias("cap")), "weighted")
    total, every = placed.agg(F.sum("source_size"), F.sum("w")).first()
    budget = share * (total or 0)
    level = budget / every if every else 0.0
    while every:
        above = F.col("cap") <= F.col("w") * level
        full, left = placed.agg(F.sum(F.when(above, F.col("cap"))), F.sum(F.when(~above, F.col("w")))).first()
        if not left or (now := (budget - (full or 0.0)) / left) <= level:
            break
        level = now
    return placed.select("source", "source_size", F.least("cap", F.col("w") * level).alias("target"))


def _at_edge(rows: DataFrame, edge: DataFrame, same: Column) -> DataFrame:
    """rows of edge's sources and places; edge's columns are e_*."""
    edge = edge.select(*[F.col(c).alias(f"e_{c}") for c in edge.columns])
    return rows.join(edge, F.col("source").eqNullSafe(F.col("e_source")) & same)


def _reached(sums: DataFrame, place: str) -> DataFrame:
    """(source, place, before, rest): of sums (source, place, n, start, rest) the first place in which rest is reached;
    start is what comes before a source's first place."""
    by_place = Window.partitionBy("source").orderBy(place)
    sums = sums.withColumn("before", F.col("start") + F.sum("n").over(by_place) - F.col("n"))
    edge = sums.where("before <= rest and rest < before + n").groupBy("source").agg(F.min(F.struct(place, "before", "rest")).alias("e"))
    return edge.select("source", "e.*")


def plan(rows: DataFrame, **options) -> DataFrame:
    """Of rows (source, _size, _key, _cell, _file, _row; a written table), per source: source_size, target, epochs, and
    what is taken once more than epochs: cells under edge_cell and, in that cell, keys under edge_key and `ties` of the
    rows with that key. edge_cell is null where the whole source (all) or nothing more is taken."""
    coarse = F.floor(F.col("_cell") / CELLS).cast("int")
    sums = written(rows.groupBy("source", coarse.alias("range")).agg(F.sum("_size").alias("n")), "ranges")
    goal = targets(sums.groupBy("source").agg(F.sum("n").alias("source_size")), **options)
    goal = goal.withColumn("epochs", F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0)).cast("long"))
    goal = written(goal.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")), "targets")
    wanted = goal.where("rest > 0").select(F.col("source").alias("s"), "rest")
    sums = sums.join(wanted, F.col("source").eqNullSafe(F.col("s"))).withColumn("start", F.lit(0).cast("long"))
    edge = written(_reached(sums, "range"), "edges")
    cells = _at_edge(rows, edge, coarse == F.col("e_range")).groupBy("source", "_cell").agg(F.sum("_size").alias("n"), F.first("e_before").alias("start"), F.first("e_rest").alias("rest"))
    edge = written(_reached(cells, "_cell"), "cells")
    keys = _at_edge(rows, edge, F.col("_cell") == F.col("e__cell")).groupBy("source", "_key").agg(
        F.sum("_size").alias("n"), F.max("_size").alias("size"), F.first("_cell").alias("_cell"), F.first("e_before").alias("start"), F.first("e_rest").alias("rest")
    )
    keys = keys.withColumn("before", F.col("start") + F.sum("n").over(Window.partitionBy("source").orderBy("_key")) - F.col("n"))
    # the key in which rest is reached; of its rows, those whose middle lies under rest
    last = keys.where("n > 0 and before <= rest").groupBy("source").agg(F.max(F.struct("_key", "_cell", "before", "rest", "size")).alias("e")).select("source", "e.*")
    ties = F.floor((F.col("rest") - F.col("before")) / F.col("size") + 0.5).cast("long")
    last = last.select(F.col("source").alias("s"), F.col("_cell").alias("edge_cell"), F.col("_key").alias("edge_key"), ties.alias("ties"))
    out = goal.join(last, F.col("source").eqNullSafe(F.col("s")), "left")
    return written(out.select("source", "source_size", "target", "epochs", (F.col("rest") >= F.col("source_size")).alias("all"), "edge_cell", "edge_key", "ties"), "mix")


def taken(rows: DataFrame, goal: DataFrame) -> DataFrame:
    """rows with source_size, target and copies. Rows with the edge's own key are counted by file, so that no task holds
    them all."""
    goal = goal.withColumnRenamed("source", "s")
    rows = rows.join(goal, F.col("source").eqNullSafe(F.col("s")))
    tied = F.col("_cell").eqNullSafe(F.col("edge_cell")) & (F.col("_key") == F.col("edge_key"))
    under = F.coalesce((F.col("_cell") < F.col("edge_cell")) | ((F.col("_cell") == F.col("edge_cell")) & (F.col("_key") < F.col("edge_key"))), F.col("all"))
    edge = rows.where(tied).groupBy("source", "_file").agg(F.count("*").alias("n"))
    edge = edge.withColumn("passed", F.sum("n").over(Window.partitionBy("source").orderBy("_file")) - F.col("n"))
    own = rows.where(tied).select("source", "_file", "_row", "ties").withColumn("k", F.row_number().over(Window.partitionBy("source", "_file").orderBy("_row")))
    edge = edge.select(F.col("source").alias("e_source"), F.col("_file").alias("e_file"), "passed")
    picked = own.join(edge, F.col("source").eqNullSafe(F.col("e_source")) & (F.col("_file") == F.col("e_file"))).where("passed + k <= ties")
    picked = written(picked.select(F.col("_file").alias("p_file"), F.col("_row").alias("p_row")), "picked")
    rows = rows.join(picked, (F.col("_file") == F.col("p_file")) & (F.col("_row") == F.col("p_row")), "left")
    more = F.when(tied, F.col("p_row").isNotNull()).otherwise(F.coalesce(under, F.lit(False)))
    return rows.withColumn("copies", F.col("epochs") + more.cast("int"))


def _placed(table: DataFrame) -> DataFrame:
    """A written table with each row's file and its place there."""
    return table.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))


def mix(docs: DataFrame, seed: str = "mix", weight: Column | None = None, **options) -> DataFrame:
    """(row, size, source_size, target, copies): row is a struct of all of docs' columns, whatever their names; copies
    is how often the mix takes the document (0 to 2).

    docs: doc_id, text, source and more. Null or empty texts have size 0 and stay out of the last, partial epoch's
    account. A source without words has target 0. Repeated rows have one key; as many of them are taken as the target
    asks for. An empty table gives no rows.
    """
    whole = docs.select("doc_id", "text", "source", F.struct("*").alias("row"))
    rows = _placed(written(measured(whole, seed, weight).drop("doc_id", "text"), "measured"))
    slim = rows.drop("row")
    return taken(rows, plan(slim, **options)).select("row", F.col("_size").alias("size"), "source_size", "target", "copies")


def mixed_sizes(docs: DataFrame, seed: str = "mix", **options) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken (words, repeats counted), without reading texts twice."""
    rows = _placed(written(measured(docs.select("doc_id", "text", "source"), seed).drop("text"), "measured"))
    out = taken(rows, plan(rows, **options))
    return out.select("doc_id", F.col("_size").alias("size"), "source_size", F.round("target", 6).alias("target"), (F.col("_size") * F.col("copies")).alias("taken"), "source")
