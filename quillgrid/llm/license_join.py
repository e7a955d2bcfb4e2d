"""License scans: an exact set-similarity join of text blocks with license templates, in SQL functions only.

A block is a line of a text; for scan, a line with those after it that a notice wrapped from it can reach. It meets a
template if it holds at least `threshold` of the template's distinct words; scan also asks for a template's telling words.
Words are ordered by how many documents hold them (rarest first, ties by code point), so that a template's prefix of
size - overlap + 1 words must meet the block (prefix filter); blocks with too few template words are left out before
(length filter), and a first common word too far along either side can't be followed by enough others (positional
filter). What is left is counted exactly. The templates are a parameter and so is their size; corpus-sized tables are
only ever scanned, or shuffled as counts and matches.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, written

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Up to this size of its words the templates' index is broadcast; a larger one is joined by shuffling.
BROADCAST_BYTES = 4 << 20

#: Phrases whose places are counted, and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Public license notices, and the words without which one isn't told from its like.
TEMPLATES = (
    ("mit", "Released under the MIT License.", "mit"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", ""),
    ("apache", "Licensed under the Apache License, Version 2.0.", "apache"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at", ""),
    ("gpl", "This work is licensed under the GNU General Public License, version 3.", ""),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License", ""),
    ("lgpl", "under the terms of the GNU Lesser General Public License", "lesser"),
    ("agpl", "under the terms of the GNU Affero General Public License", "affero"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted", ""),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0.", "nc"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0.", "sa"),
    ("cc-by", "Licensed under CC BY 4.0.", "cc"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License", "mozilla"),
)
#: label, text and, if any, telling words.
Templates = Sequence[tuple[str, ...]]


def template_words(text: str) -> list[str]:
    return sorted(set(re.findall("[0-9a-z]+", text.lower())))


def _lowered(text: Column) -> Column:
    """For matching ASCII words: lower() but for the two characters that it would turn into ASCII letters."""
    odd = F.contains(text, F.lit("K")) | F.contains(text, F.lit("İ"))
    return F.when(odd, lower_ascii(text)).otherwise(F.lower(text))


def words(text: Column) -> Column:
    return F.regexp_extract_all(_lowered(text), F.lit(WORD), F.lit(0))


def phrase_places(text: Column, phrases: Sequence[tuple[str, str]] = PHRASES) -> Column:
    """array<struct<at, label>>: where phrases stand, as word indices; texts without a phrase's words aren't cut up."""
    low = _lowered(text)
    maybe = F.lit(False)
    for phrase, _ in phrases:
        every = F.lit(True)
        for w in phrase.split():
            every &= F.contains(low, F.lit(w))
        maybe |= every
    none = F.array().cast("array<string>")
    found = F.transform(F.array(F.when(maybe, F.regexp_extract_all(low, F.lit(WORD), F.lit(0))).otherwise(none)), lambda ws: _places(ws, phrases))
    return F.flatten(found)


def _places(ws: Column, phrases: Sequence[tuple[str, str]]) -> Column:
    def stands(phrase: str, i: Column) -> Column:
        out = F.lit(True)
        for k, w in enumerate(phrase.split()):
            out &= F.coalesce(F.get(ws, i + k) == w, F.lit(False))
        return out

    def found(phrase: str, label: str) -> Column:
        at = F.transform(ws, lambda _, i: F.when(stands(phrase, i), F.struct(i.alias("at"), F.lit(label).alias("label"))))
        return F.filter(at, lambda x: x.isNotNull())

    return F.concat(*[found(*x) for x in phrases])


def held_words(docs: DataFrame, vocabulary: Sequence[str], phrases: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """(doc_id, h, places, lines) as a written table: each line's number of words and which of the vocabulary it holds.
    The one pass that cuts texts into words; a line's end parts words, so lines' words are the text's."""
    known = F.array(*[F.lit(w) for w in sorted(vocabulary)]).cast("array<string>")
    cut = F.transform(F.split("text", "\n"), words)
    lines = F.transform(cut, lambda ws, i: F.struct(F.size(ws).alias("n"), F.array_intersect(known, ws).alias("held"), i.alias("last")))
    places = phrase_places(F.col("text"), phrases) if phrases else F.array().cast("array<struct<at:int,label:string>>")
    return written(docs.select("doc_id", F.xxhash64("text").alias("h"), places.alias("places"), lines.alias("lines")), "held")


def frequencies(held: DataFrame) -> DataFrame:
    """(word, n): in how many documents each word of the vocabulary stands; summed before the shuffle."""
    every = F.array_distinct(F.flatten(F.col("lines.held")))
    return held.select(F.explode(every).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def vocabulary_of(templates: Templates) -> list[str]:
    return sorted({w for t in templates for w in template_words(t[1])})


def word_order(held: DataFrame, templates: Templates) -> list[str]:
    """The templates' words, rarest in docs first; collects one count per word of the templates."""
    vocabulary = vocabulary_of(templates)
    n = dict(frequencies(held).collect()) if vocabulary else {}
    return sorted(vocabulary, key=lambda w: (n.get(w, 0), w))


def join_templates(docs: DataFrame, templates: Templates = TEMPLATES, threshold: float = 0.8) -> DataFrame:
    """(doc_id, h, block, template, label, containment, size) for every block that meets a template; h: the text's
    xxhash64; size: the template's distinct words.

    docs: doc_id, text. Null texts have no blocks; equal rows give their matches once. A template without words is
    met by nothing.
    """
    met = _joined(held_words(docs, vocabulary_of(templates)), templates, threshold)
    return met.select("doc_id", "h", "block", "template", "label", "containment", "size").distinct()


def _windows(held: DataFrame, templates: Templates, threshold: float) -> DataFrame:
    """held's rows that can meet a template, once each, with windows for lines: each line that has words, and those after
    it within the longest template's length in words. Any run of that many words lies in the window of its first line."""
    whole = F.struct(F.lit(0).alias("n"), F.array_distinct(F.flatten("lines.held")).alias("held"), F.lit(0).alias("last"))
    some = _joined(held.select("doc_id", "h", F.array(whole).alias("lines")), templates, threshold).select(F.col("doc_id").alias("_doc"), F.col("h").alias("_h")).distinct()
    rows = held.join(some, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("h") == F.col("_h")), "left_semi").dropDuplicates(["doc_id", "h"])
    rows = rows.select("doc_id", "h", F.filter("lines", lambda x: x["n"] > 0).alias("lines"))
    reach = max((len(re.findall("[0-9a-z]+", t.lower())) for _, t, *_ in templates), default=0)

    def window(line: Column, i: Column) -> Column:
        # every line that is left has a word, so `reach` of them are enough
        after = F.slice(F.col("lines"), i + 2, F.lit(reach))
        start = F.struct(F.lit(0).alias("n"), line["held"].alias("held"), i.alias("last"))
        add = lambda a, x: F.when(a["n"] < reach, F.struct((a["n"] + x["n"]).alias("n"), F.array_union(a["held"], x["held"]).alias("held"), (a["last"] + 1).alias("last"))).otherwise(a)
        return F.aggregate(after, start, add)

    return written(rows.select("doc_id", "h", F.transform("lines", window).alias("lines")), "windows")


def _joined(held: DataFrame, templates: Templates, threshold: float) -> DataFrame:
    """join_templates of what held_words gives for the templates' vocabulary, with each block's last line and the words
    of the template that it holds."""
    order = word_order(held, templates)
    rank = {w: i for i, w in enumerate(order)}
    index = []
    for k, (label, text, *_) in enumerate(templates):
        ws = sorted(template_words(text), key=rank.get)
        need = max(1, math.ceil(threshold * len(ws) - 1e-9))
        index += [(w, k, label, ws, i, need) for i, w in enumerate(ws[: len(ws) - need + 1])]
    least = min((x[-1] for x in index), default=1)
    prefixes = held.sparkSession.createDataFrame(index, "word string, template int, label string, words array<string>, i int, need int")
    if sum(len(w.encode()) + 8 for x in index for w in x[3]) <= BROADCAST_BYTES:
        prefixes = F.broadcast(prefixes)
    known = F.array(*[F.lit(w) for w in order]).cast("array<string>")
    blocks = held.select("doc_id", "h", F.posexplode("lines").alias("block", "line")).where(F.size("line.held") >= least)
    blocks = blocks.select("doc_id", "h", "block", "line.last", F.col("line.held").alias("some"))
    blocks = blocks.select("doc_id", "h", "block", "last", F.array_intersect(known, F.col("some")).alias("held"))
    firsts = blocks.select("*", F.posexplode(F.slice("held", F.lit(1), F.size("held") - (least - 1))).alias("j", "word"))
    pairs = firsts.join(prefixes, "word").where(1 + F.least(F.size("words") - F.col("i") - 1, F.size("held") - F.col("j") - 1) >= F.col("need"))
    met = pairs.withColumn("matched", F.array_intersect("held", "words")).where(F.size("matched") >= F.col("need"))
    containment = F.size("matched") / F.size("words")
    return met.select("doc_id", "h", "block", "last", "template", "label", containment.alias("containment"), F.size("words").alias("size"), "matched").distinct()


def scan(docs: DataFrame, templates: Templates = TEMPLATES, phrases: Sequence[tuple[str, str]] = PHRASES, threshold: float = 0.8) -> DataFrame:
    """One row per document: doc_id, n_words, the phrases' places (n_base, first_word, last_word), labels and score.

    base_labels: labels of the phrases found; labels: those and those of the templates that a block meets with their
    telling words, but for one whose words there are all among those of a better met template (of equals the larger) in
    the same lines; both distinct, sorted, comma-joined, empty where there are none. score: 1 if a phrase stands, else
    the best containment of such a template, else 0. join_templates gives every pair that meets the threshold. Null texts count as empty; repeated rows come back as often as they came; an empty table
    gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    held = held_words(docs, vocabulary_of(templates), phrases)
    met = _joined(_windows(held, templates, threshold), templates, threshold)
    telling = F.array(*[F.array(*[F.lit(w) for w in (t[2] if len(t) > 2 else "").split()]).cast("array<string>") for t in templates])
    met = met.where(F.size(F.array_except(F.get(telling, F.col("template")), F.col("matched"))) == 0) if templates else met
    met = met.groupBy("doc_id", "h").agg(F.collect_set(F.struct("block", "last", "label", "containment", "size", "matched")).alias("every"))

    def outdone(x: Column, y: Column) -> Column:
        better = F.struct(y["containment"], y["size"]) > F.struct(x["containment"], x["size"])
        beside = (x["block"] <= y["last"]) & (y["block"] <= x["last"])
        return better & beside & (F.size(F.array_except(x["matched"], y["matched"])) == 0)

    stay = F.filter("every", lambda x: ~F.exists("every", lambda y: outdone(x, y)))
    found = F.array_distinct(F.transform(stay, lambda x: x["label"])).alias("found")
    met = met.select("doc_id", "h", found, F.array_max(F.transform("every", lambda x: x["containment"])).alias("best"))
    met = written(met.withColumnsRenamed({"doc_id": "_doc", "h": "_h"}), "licenses")
    n_words = F.aggregate("lines.n", F.lit(0).cast("long"), lambda a, n: a + n)
    base = held.select("doc_id", "h", n_words.alias("n_words"), "places")
    rows = base.join(met, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("h") == F.col("_h")), "left")
    at = lambda f: f(F.transform("places", lambda p: p["at"])).cast("long")
    own = F.array_sort(F.array_distinct(F.transform("places", lambda p: p["label"])))
    every = F.array_sort(F.array_union(own, F.coalesce("found", F.array().cast("array<string>"))))
    return rows.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        at(F.array_min).alias("first_word"),
        at(F.array_max).alias("last_word"),
        F.array_join(own, ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )
