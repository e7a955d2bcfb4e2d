"""Document fingerprints: Merkle trees over sections, paragraphs and pieces, in SQL functions only.

A section ends after a blank line, a paragraph after a line end, a piece after a sentence end or 48 characters (and 64
end signs at most). Nothing is cut away, so the pieces of a text spell it. Pieces are the leaves: a paragraph's hash is
the SHA-256 of its leaves' hashes, a section's that of its paragraphs', the root that of its sections': equal roots mean
equal texts, and comparing trees from the root down finds all branches that differ, wherever they stand. Leaves also keep
a 48-bit hash and their length, so that two trees can be likened by the share of text that their leaves have in common.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import RangeBuckets

SECTION_END = r"(?<=\n\n)(?!\n)"
PARAGRAPH_END = r"(?<=\n)(?!\n)"
PIECE = r"[^.!?\n]{1,48}[.!?\n]{0,64}|[.!?\n]{1,64}"


def tree(text: Column) -> Column:
    """struct<root, sections: array<struct<hash, paragraphs: array<struct<hash, leaves: array<bigint>>>>>>; a leaf is a
    48-bit hash, then the piece's length in 16 bits. Null counts as the empty text."""
    text = F.coalesce(text, F.lit(""))
    leaf = lambda p: F.shiftleft(F.xxhash64(p), 16).bitwiseOR(F.length(p).cast("long"))
    sha = lambda hashes: F.sha2(F.array_join(hashes, ""), 256)
    pieces = lambda paragraph: F.regexp_extract_all(paragraph, F.lit(PIECE), F.lit(0))
    paragraph = lambda ps: F.struct(sha(F.transform(ps, lambda p: F.sha2(p, 256))).alias("hash"), F.transform(ps, leaf).alias("leaves"))
    section = lambda ps: F.struct(sha(F.transform(ps, lambda p: p["hash"])).alias("hash"), ps.alias("paragraphs"))
    cut = F.transform(F.split(text, SECTION_END), lambda s: F.transform(F.transform(F.split(s, PARAGRAPH_END), pieces), paragraph))
    return F.transform(F.array(F.transform(cut, section)), lambda ss: F.struct(sha(F.transform(ss, lambda x: x["hash"])).alias("root"), ss.alias("sections")))[0]


def _paragraphs(t: Column) -> Column:
    return F.flatten(F.transform(t["sections"], lambda s: s["paragraphs"]))


def leaves(t: Column) -> Column:
    """A tree's distinct leaves, each with how often it stands: sorted array<struct<leaf, n>>."""
    every = F.array(F.array_sort(F.flatten(F.transform(_paragraphs(t), lambda p: p["leaves"]))))

    def runs(xs: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(xs)), lambda i: (i == 0) | ~F.get(xs, i).eqNullSafe(F.get(xs, i - 1)))
        return F.transform(F.array(starts), lambda at: F.transform(F.slice(at, F.lit(1), F.size(at) - 1), lambda i, k: F.struct(F.get(xs, i).alias("leaf"), (F.get(at, k + 1) - i).alias("n"))))[0]

    return F.transform(every, lambda xs: F.when(F.size(xs) > 0, runs(xs)).otherwise(F.array().cast("array<struct<leaf:bigint,n:int>>")))[0]


def _weight(found: Column) -> Column:
    """Characters of leaves."""
    return F.aggregate(found, F.lit(0).cast("long"), lambda a, x: a + x["leaf"].bitwiseAND(F.lit(65535)) * x["n"])


def likeness(root_a: Column, leaves_a: Column, root_b: Column, leaves_b: Column) -> Column:
    """1 for equal roots, else twice the common leaves' characters, repeats counted, by both texts' (under 1)."""
    # both sides' leaves sorted together: what they have in common stands side by side
    both = F.array(F.array_sort(F.concat(leaves_a, leaves_b)))
    shared = lambda xs: F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.size(xs) - 1, F.lit(1))), F.lit(0).cast("long"),
        lambda a, i: a + F.when(F.get(xs, i)["leaf"] == F.get(xs, i - 1)["leaf"], F.get(xs, i)["leaf"].bitwiseAND(F.lit(65535)) * F.least(F.get(xs, i)["n"], F.get(xs, i - 1)["n"])).otherwise(0),
    )
    common = F.transform(both, shared)[0]
    return F.when(root_a == root_b, F.lit(1.0)).otherwise(F.least(2 * common / F.greatest(_weight(leaves_a) + _weight(leaves_b), F.lit(1)), F.lit(0.999999)))


def _among(known: Column, x: Column) -> Column:
    """Whether x is in known, a sorted array, by binary search."""
    step = lambda span, _: F.when(F.get(known, F.shiftright(span["low"] + span["high"], 1)) <= x, F.struct(F.shiftright(span["low"] + span["high"], 1).alias("low"), span["high"].alias("high"))).otherwise(
        F.struct(span["low"].alias("low"), F.shiftright(span["low"] + span["high"], 1).alias("high"))
    )
    steps = F.sequence(F.lit(1), F.ceil(F.log2((F.size(known) + 1).cast("double"))).cast("int") + 1)
    whole = F.struct(F.lit(0).alias("low"), F.size(known).alias("high"))
    return F.coalesce(F.aggregate(steps, whole, step, lambda span: F.get(known, span["low"]) == x), F.lit(False))


def changed(a: Column, b: Column) -> Column:
    """array<struct<section, paragraph>>, 0-based: all paragraphs of tree b that tree a doesn't have, found through the
    sections that it doesn't have. What stands in both trees at other places is unchanged."""
    hashes = lambda nodes: F.array(F.array_sort(F.transform(nodes, lambda n: n["hash"])))

    def walk(sections: Column, paragraphs: Column) -> Column:
        below = lambda s, i: F.when(_among(sections, s["hash"]), F.array().cast("array<struct<section:int,paragraph:int>>")).otherwise(
            F.filter(F.transform(s["paragraphs"], lambda p, j: F.when(~_among(paragraphs, p["hash"]), F.struct(i.alias("section"), j.alias("paragraph")))), lambda x: x.isNotNull())
        )
        return F.flatten(F.transform(b["sections"], below))

    return F.transform(hashes(a["sections"]), lambda ss: F.transform(hashes(_paragraphs(a)), lambda ps: walk(ss, ps))[0])[0]


def with_next(docs: DataFrame, rows_each: int = 256) -> DataFrame:
    """Each row's doc_id, text, bucket and the text of the next in ascending doc_id; the last is followed by the first.

    One shuffle of the texts, into range buckets; the first rows of a bucket are also sent to the bucket before, and
    the first rows of all to the last. Ties of doc_id are ordered by text hash. Rows without a doc_id have no place in
    the order: an empty text follows them and they follow none; they are dealt by text hash.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    cut = RangeBuckets(docs, "doc_id", rows_each)
    last = max(len(cut.starts) - 1, 0)
    least = F.lit(cut.starts[0] if cut.starts else None).cast("long")
    place = lambda b, kind: F.struct(b.cast("int").alias("b"), F.lit(kind).alias("kind"))
    b = cut.bucket(F.col("doc_id"))
    first = cut.is_start(F.col("doc_id"), b) & (b > 0)
    loose = -1 - F.pmod(F.xxhash64("text"), F.lit(1 << 12))
    places = F.array(
        F.when(F.col("doc_id").isNull(), place(loose, 0)).otherwise(place(b, 0)),
        F.when(first, place(b - 1, 1)),
        F.when(F.col("doc_id") == least, place(F.lit(last), 2)),
    )
    dealt = docs.select("doc_id", "text", F.explode(F.filter(places, lambda p: p.isNotNull())).alias("p")).select("doc_id", "text", "p.b", "p.kind")
    return dealt.repartition("b")


def fingerprint_documents(docs: DataFrame, rows_each: int = 256) -> DataFrame:
    """Per row: doc_id, n_chars, fingerprint (the root) of its text and of its edited text, and how alike trees are.

    The edited text has the last floor(n_chars / 2) characters replaced by the first as many (or all) of the next
    document's. changed: how many of the edited tree's paragraphs the tree doesn't have; changed_at: where (section and
    paragraph, 0-based). Null texts count as empty; an empty text's edited text is empty too. Extra columns are not
    looked at; repeated rows come back as often as they came; an empty table gives no rows.
    """
    order = Window.partitionBy("b").orderBy("kind", "doc_id", F.xxhash64("text"))
    dealt = with_next(docs, rows_each).withColumn("tree", tree(F.col("text"))).withColumn("leaves", leaves(F.col("tree")))
    following = F.when(F.col("b") >= 0, F.lead(F.struct("text", F.col("tree.root").alias("root"), "leaves"), 1).over(order))
    rows = dealt.withColumn("next_doc", following).where("kind = 0")
    empty = F.struct(F.lit("").alias("text"), tree(F.lit(""))["root"].alias("root"), leaves(tree(F.lit(""))).alias("leaves"))
    rows = rows.withColumn("next_doc", F.coalesce("next_doc", empty)).withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.col("text").substr(F.lit(1), F.col("n_chars").cast("int") - half), F.col("next_doc.text").substr(F.lit(1), half))
    rows = rows.withColumn("edited", edited).withColumn("edited_tree", tree(F.col("edited"))).withColumn("edited_leaves", leaves(F.col("edited_tree")))
    rows = rows.withColumn("changed_at", changed(F.col("tree"), F.col("edited_tree")))
    root = F.col("tree.root")
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        root.alias("fingerprint"),
        F.col("edited_tree.root").alias("edited_fingerprint"),
        likeness(root, F.col("leaves"), F.col("edited_tree.root"), F.col("edited_leaves")).alias("near_edited"),
        likeness(root, F.col("leaves"), F.col("next_doc.root"), F.col("next_doc.leaves")).alias("near_next"),
        F.size("changed_at").alias("changed"),
        "changed_at",
    )
