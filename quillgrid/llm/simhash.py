"""SimHash near-duplicates: BK-trees over shards of fingerprints, linked into connected components.

A shard holds the distinct fingerprints that agree on a mask of bits. Three masks cover all 64 bits, so two
fingerprints that differ in at most two bits agree on one of them: every link lies within some shard, and no pair is
sought outside one. A shard of over `shard_rows` members is dealt again under three finer masks (the same argument
over the bits not yet used), up to three levels; the last level's shards can't exceed 2**19 values. Each shard's
BK-tree is built and searched in the task that reads it: a cluster-wide broadcast of all trees would grow with the
corpus. Copies never meet in a shard, as only distinct fingerprints enter one.

For a similarity of sets instead of two bits, similar_documents takes every link between fingerprints, keeps those whose
sets have the similarity, and has the exact join of sets (shingle_join) find what they leave apart: no radius in
fingerprints would find all pairs of a similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, settled, written
from .components import connected_components
from .shingle_join import features, similar_pairs

RADIUS = 2
#: Above any doc_id: nodes of fingerprints whose documents all lack a doc_id.
NO_ID = 1 << 62


#: Bytes of UTF-8 with A-Z lower-cased.
_FOLD = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))


def shingle_hashes(utf8: bytes | None, width: int) -> np.ndarray:
    """XXH64 (seed 42) of every width-word shingle, repeats included; bytes.split() cuts at exactly [\x20\x09-\x0D]."""
    words = (utf8 or b"").translate(_FOLD).split()
    if not words:
        return np.empty(0, np.uint64)
    h = xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([h(b" ".join(words), 42)], np.uint64)
    runs = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    return np.fromiter((h(x, 42) for x in runs), np.uint64, len(words) - width + 1)


def majority_bits(hashes: np.ndarray) -> int:
    """A signed 64-bit fingerprint: bit set where over half the hashes have it; 0 for none."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):  # constant memory for any text
        part = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(ones * 2 > len(hashes), bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp) for every row: null or wordless texts have fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [majority_bits(shingle_hashes(t, width)) for t in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, fp long")


def _thirds(bits: list[int]) -> list[list[int]]:
    n = len(bits)
    return [bits[: n // 3], bits[n // 3 : 2 * n // 3], bits[2 * n // 3 :]]


def mask_tree(levels: int = 3) -> list[dict[int, list[int]]]:
    """By level: mask -> the finer masks under it; -1 (no mask yet) has the three coarsest."""
    out, now = [], [0]
    for _ in range(levels):
        step = {}
        for used in now:
            rest = [i for i in range(64) if not used >> i & 1]
            step[used] = [used | sum(1 << i for i in third) for third in _thirds(rest)]
        out.append(step)
        now = [m for ms in step.values() for m in ms]
    return out


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


class BKTree:
    """Children are keyed by their Hamming distance to the parent."""

    def __init__(self):
        self.root = None

    def add(self, value: int, radius: int) -> list[int]:
        """Adds value; returns the members within radius of it, found along the edges that can lead to them."""
        if self.root is None:
            self.root = (value, {})
            return []
        near, stack = [], [self.root]
        while stack:
            at, children = stack.pop()
            d = (at ^ value).bit_count()
            if d <= radius:
                near.append(at)
            for e in range(d - radius, d + radius + 1):
                if e in children:
                    stack.append(children[e])
        at, children = self.root
        while True:
            d = (at ^ value).bit_count()
            if d not in children:
                children[d] = (value, {})
                return near
            at, children = children[d]


def shard_links(members: list[tuple[int, int]], radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links within a shard of (fp, node), fp not negative: as few pairs as keep all that is connected so."""
    tree, up, node, out = BKTree(), {}, {}, []

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for fp, n in members:
        near = tree.add(fp, radius)
        up[fp], node[fp] = fp, n
        for other in near:
            a, b = top(fp), top(other)
            if a != b:
                up[max(a, b, key=node.get)] = min(a, b, key=node.get)
                out.append((node[fp], node[other]))
    return out


def _searched(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, members = None, []

        def found():
            u, v = zip(*x, strict=True) if (x := shard_links(members, radius)) else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

        for b in batches:
            for mask, part, fp, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (mask, part) != key:
                    if len(members) > 1:
                        yield found()
                    key, members = (mask, part), []
                members.append((fp & (1 << 64) - 1, n))
        if len(members) > 1:
            yield found()

    return run


def links(nodes: DataFrame, radius: int = RADIUS, shard_rows: int = 512) -> DataFrame:
    """(u, v) between nodes (fp, node), distinct in fp, that connect exactly what all pairs within radius (at most 2)
    connect."""
    if radius > 2:
        raise ValueError("three masks cover a radius of 2")
    levels, out = mask_tree(), None
    left = nodes.select(F.lit(0).cast("long").alias("mask"), "fp", "node")
    for depth, step in enumerate(levels):
        finer = F.create_map(*[F.lit(_signed(x)) if not isinstance(x, list) else F.array(*[F.lit(_signed(m)) for m in x]) for kv in step.items() for x in kv])
        dealt = left.select(F.explode(finer[F.col("mask")]).alias("mask"), "fp", "node").withColumn("part", F.col("mask").bitwiseAND(F.col("fp")))
        sizes = written(dealt.groupBy("mask", "part").agg(F.count("*").alias("n")).where("n > 1"), f"shards{depth}")
        dealt = dealt.join(sizes, ["mask", "part"])
        last = depth == len(levels) - 1
        more = [] if last else sizes.where(F.col("n") > shard_rows).take(1)
        small = (dealt.where(F.col("n") <= shard_rows) if more else dealt).select("mask", "part", "fp", "node")
        pairs = mapped(small.repartition("mask", "part").sortWithinPartitions("mask", "part", "node"), _searched(radius), "u long, v long")
        out = pairs if out is None else out.union(pairs)
        if not more:
            break
        left = written(dealt.where(F.col("n") > shard_rows).select("mask", "fp", "node"), f"large{depth}")
    return out


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = RADIUS, shard_rows: int = 512) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (least doc_id linked to it, itself too).

    Null, empty and wordless texts share fingerprint 0 and are linked like any other. Repeated rows come back as often
    as they came. Rows without a doc_id take part; a component of only such rows has a null component_id. Other columns
    are not looked at. An empty table gives no rows.
    """
    fps = written(fingerprints(docs, width), "fingerprints")
    nodes = written(
        fps.groupBy("fp").agg(F.min("doc_id").alias("least")).select("fp", F.coalesce("least", F.shiftrightunsigned("fp", 2) + F.lit(NO_ID)).alias("node")), "nodes"
    )
    found = connected_components(links(nodes, radius, shard_rows))
    classes = written(nodes.join(found.withColumnRenamed("component", "c"), "node", "left").select("fp", F.coalesce("c", "node").alias("c")), "classes")
    named = F.when(F.col("c") < NO_ID, F.col("c")).alias("component_id")
    return fps.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), named)


def fingerprint_pairs(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(u, v), u less, between nodes (node, fp) that connect exactly what all pairs within radius connect."""
    least = written(nodes.groupBy("fp").agg(F.min("node").alias("node")), "fingerprints")
    same = nodes.join(least.withColumnRenamed("node", "u"), "fp").where("u <> node").select("u", F.col("node").alias("v"))
    return same.union(links(least, radius).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")))


def similar_documents(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, h, component) of every row: h is its text's xxhash64, component the least node of its class.

    Texts are linked if the Jaccard similarity of their sets of width-word shingles is at least similarity; every such
    link counts: those between SimHashes first, then all others (shingle_join). Null and wordless texts are one class. Repeated rows come back as often as they came; an
    empty table gives no rows; a text of any length is one row.
    """

    def classes() -> DataFrame:
        texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text")
        hashes = partial(shingle_hashes, width=width)
        rows = written(features(texts, hashes, majority_bits), "features")
        # a class of texts without any doc_id gets a node from its least hash
        node = F.coalesce(F.min("doc_id"), F.shiftrightunsigned(F.min("h"), 2) + F.lit(NO_ID)).alias("node")
        nodes = written(rows.groupBy("key").agg(node, F.min("h").alias("h"), *[F.first(c).alias(c) for c in ("fp", "size", "bits", "wide", "bands")]), "nodes")
        found = connected_components(similar_pairs(nodes, texts, hashes, similarity, fingerprint_pairs(nodes.select("node", "fp"))))
        named = nodes.select("key", "node").join(found.withColumnRenamed("component", "c"), "node", "left").select("key", F.coalesce("c", "node").alias("component"))
        return rows.select("doc_id", "h", "key").join(named, "key").select("doc_id", "h", "component")

    return settled(docs.sparkSession, "classes", classes)


def one_of_each(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs' rows, all columns, of which one stays for each class of near-duplicates: that of the least doc_id (of equal
    ones that of the least hash of all columns). Null and wordless texts are one class; an empty table gives no rows."""
    classes = similar_documents(docs, width, similarity)
    stays = classes.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("s"))
    stays = stays.select(F.col("s.doc_id").alias("doc"), F.col("s.h").alias("hash"))
    whole = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("h"), F.xxhash64("*").alias("all"), F.struct("*").alias("row"))
    kept = whole.join(stays, F.col("id").eqNullSafe(F.col("doc")) & (F.col("h") == F.col("hash")))
    return kept.groupBy("doc", "hash").agg(F.min_by("row", "all").alias("row")).select("row.*")
