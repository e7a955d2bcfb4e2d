"""An exact similarity self-join: every pair of sets of shingles whose Jaccard similarity reaches a threshold.

First, pairs that the caller found (by their SimHashes), and nodes that share a band of MinHash values with the least node
of that band, are compared, and the pairs that have the similarity are linked: that finds most copies, at a few rows a node, and decides nothing about the others. Then a
prefix filter finds every pair that those links leave apart: two sets of at least the similarity share one of the first
size - ceil(similarity * size) + 1 shingles of each, in any one order of all shingles. The order is by hash, but what many
of the components' first texts hold, counted in one text of SHARE, comes last: that bears on the work, never on the
result. A shingle that only nodes of one component hold tells nothing new and goes. The others' nodes are compared, across components, by size and by a
bitmap of the parities of their hashes, whose distance is at most the sets' symmetric difference; neither loses a pair.
What is left is compared by bitmaps as wide as the sets ask for, then verified on the sets themselves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, written
from .components import connected_components

#: One in so many texts, by hash, is counted for the order of shingles; so many frequent ones may come last in it.
SHARE, FREQUENT = 4, 1 << 19
#: Bits of a bitmap; a set of over half as many hashes has a wide one too, of twice as many bits as hashes up to 2**WIDEST.
BITMAP, WIDEST = 512, 17
#: MinHash bands of the first links, and values in each.
BANDS, BAND_VALUES = 6, 3
#: Words of 64 bits in the filter that tells which texts a join can need.
FILTER_WORDS = 1 << 20

Hashes = Callable[[bytes | None], np.ndarray]


def bitmap(hashes: np.ndarray) -> bytes:
    """By bit, whether an odd number of the distinct hashes falls on it."""
    return np.packbits(np.bincount((hashes >> np.uint64(55)).astype(np.int64), minlength=BITMAP) & 1, bitorder="little").astype(np.uint8).tobytes()


def wide_bitmap(hashes: np.ndarray) -> bytes | None:
    """bitmap, of a power of two of bits that suits the set; None for small sets."""
    if 2 * len(hashes) <= BITMAP:
        return None
    bits = min((2 * len(hashes) - 1).bit_length(), WIDEST)
    return np.packbits(np.bincount((hashes >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits) & 1, bitorder="little").astype(np.uint8).tobytes()


def apart(a: bytes, b: bytes) -> int:
    """At least this many hashes are in one of two sets only, by their wide bitmaps; the wider is folded to the other."""
    x, y = (np.unpackbits(np.frombuffer(s, np.uint8), bitorder="little") for s in (a, b))
    while len(x) > len(y):
        x = x[::2] ^ x[1::2]
    while len(y) > len(x):
        y = y[::2] ^ y[1::2]
    return int((x ^ y).sum(dtype=np.int64))


def room(a, b, similarity: float):
    """The largest symmetric difference of sets of sizes a and b that have the similarity."""
    return a + b - 2 * np.ceil(similarity / (1 + similarity) * (a + b) - 1e-9)


def bands(s: np.ndarray) -> np.ndarray:
    """One hash for each band of MinHash values of a set of hashes; none for the empty set."""
    if not len(s):
        return np.empty(0, np.int64)
    odd = np.random.default_rng(21).integers(1, 1 << 63, (BANDS * BAND_VALUES, 2), np.uint64) | np.uint64(1)
    least = np.array([((s ^ (s >> np.uint64(29))) * a + b).min() for a, b in odd])
    rows = least.reshape(BANDS, BAND_VALUES)
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), i) for i, r in enumerate(rows)], np.uint64).view(np.int64)


def _texts(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def frequent_shingles(texts: DataFrame, first: DataFrame, hashes: Hashes) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the shingles that stand in most texts of (h, text), and in how many of them; counted are those of
    first (h), one in SHARE of them. At most FREQUENT, and none that stands once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [np.unique(hashes(t)) for t in _texts(b.column(0))]
            if found:
                token, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(n)], names=["token", "n"])

    some = F.pmod("h", F.lit(SHARE)) == 0
    one = texts.where(some).join(first.where(some).select("h"), "h", "left_semi").groupBy("h").agg(F.first("text").alias("text"))
    found = mapped(one.select("text"), run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where("n > 1")
    rows = found.orderBy(F.desc("n"), "token").limit(FREQUENT).toArrow()
    token, n = rows.column("token").to_numpy().view(np.uint64), rows.column("n").to_numpy()
    at = np.argsort(token)
    return token[at], n[at].astype(np.int32)


def _prefix(s: np.ndarray, frequent: tuple[np.ndarray, np.ndarray], similarity: float) -> np.ndarray:
    token, n = frequent
    often = np.zeros(len(s), np.int64)
    if len(token):
        at = np.minimum(np.searchsorted(token, s), len(token) - 1)
        often = np.where(token[at] == s, n[at], 0)
    return s[np.lexsort((s, often))[: len(s) - int(np.ceil(similarity * len(s) - 1e-9)) + 1 if len(s) else 0]]


def features(texts: DataFrame, hashes: Hashes, fingerprint: Callable[[np.ndarray], int]) -> DataFrame:
    """(doc_id, h, key, fp, size, bits, wide, bands) of (doc_id, h, text): key and fp are the same for the same set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 1024):
                part = b.slice(i, 1024)
                sets = [np.unique(hashes(t)) for t in _texts(part.column(2))]
                columns = [
                    pa.array([xxhash.xxh128_digest(s.tobytes()) for s in sets], pa.binary()),
                    pa.array([fingerprint(s) for s in sets], pa.int64()),
                    pa.array([len(s) for s in sets], pa.int32()),
                    pa.array([bitmap(s) for s in sets], pa.binary()),
                    pa.array([wide_bitmap(s) for s in sets], pa.binary()),
                    pa.array([bands(s) for s in sets], pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns], names=["doc_id", "h", "key", "fp", "size", "bits", "wide", "bands"])

    return mapped(texts.select("doc_id", "h", "text"), run, "doc_id long, h long, key binary, fp long, size int, bits binary, wide binary, bands array<long>")


def prefixes(nodes: DataFrame, texts: DataFrame, hashes: Hashes, similarity: float, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """nodes (h and more) and prefix: the shingles of which one is shared with every set of the similarity."""
    sent = texts.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 1024):
                part = b.slice(i, 1024)
                found = [_prefix(np.unique(hashes(t)), sent.value, similarity).view(np.int64) for t in _texts(part.column(1))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.list_(pa.int64()))], names=["h", "prefix"])

    every = mapped(texts.select("h", "text"), run, "h long, prefix array<long>")
    return every.groupBy("h").agg(F.first("prefix").alias("prefix")).join(nodes, "h")


def _by_token(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole groups of rows sorted by token, and where each group starts (and the last one ends)."""
    held: list[pa.RecordBatch] = []

    def whole(batches: list[pa.RecordBatch]) -> tuple[pa.Table, np.ndarray]:
        table = pa.Table.from_batches(batches).combine_chunks()
        token = table.column("token").to_numpy()
        return table, np.concatenate([[0], np.flatnonzero(token[1:] != token[:-1]) + 1, [len(token)]])

    for b in batches:
        if not b.num_rows:
            continue
        token = b.column(0).to_numpy()
        cut = int(np.searchsorted(token, token[-1]))
        if cut or held and held[-1].column(0)[-1].as_py() != token[0]:
            if cut:
                held.append(b.slice(0, cut))
            yield whole(held)
            held = []
        held.append(b.slice(cut))
    if held:
        yield whole(held)


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose token nodes of several components hold."""
    for table, starts in _by_token(batches):
        component = table.column("component").to_numpy()
        unlike = np.maximum.reduceat(component, starts[:-1]) != np.minimum.reduceat(component, starts[:-1])
        yield from table.filter(pa.array(np.repeat(unlike, np.diff(starts)))).to_batches()


class _Group:
    """Sizes, bitmaps and nodes of rows sorted by token and size."""

    def __init__(self, table: pa.Table, similarity: float):
        self.similarity = similarity
        self.node, self.size = table.column("node").to_numpy(), table.column("size").to_numpy().astype(np.int64)
        self.bits = np.frombuffer(b"".join(table.column("bits").to_pylist()), np.uint64).reshape(len(self.node), -1)

    def near(self, i, j) -> np.ndarray:
        """Which pairs of rows can have the similarity: none that has it is left out."""
        t, a, b = self.similarity, self.size[i], self.size[j]
        return (np.minimum(a, b) >= t * np.maximum(a, b) - 1e-9) & (np.bitwise_count(self.bits[i] ^ self.bits[j]).sum(axis=1, dtype=np.int64) <= room(a, b, t))

    def reach(self, i: int, rows: np.ndarray) -> np.ndarray:
        """Of rows, sorted, those whose size allows the similarity to row i."""
        size = self.size[rows]
        low, high = np.searchsorted(size, [self.similarity * self.size[i] - 1e-6, self.size[i] / self.similarity + 1e-6])
        return rows[low:high]

    def pairs(self, i, j) -> pa.RecordBatch:
        u, v = self.node[i], self.node[j]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v), pa.int64()), pa.array(np.maximum(u, v), pa.int64())], names=["u", "v"])


def _across(similarity: float, every: int = 16):
    """Pairs to verify: of each token's rows, sorted by size, those of different components that can have the
    similarity. Groups of up to `every` rows are compared many at a time, larger ones row by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in _by_token(batches):
            g, component, n = _Group(table, similarity), table.column("component").to_numpy(), np.diff(starts)
            ends = np.repeat(np.where(n <= every, starts[1:], 0), n)
            for d in range(1, every):
                i = np.flatnonzero(np.arange(len(ends)) + d < ends)
                if not len(i):
                    break
                i = i[component[i] != component[i + d]]
                i = i[g.near(i, i + d)]
                yield g.pairs(i, i + d)
            for start, end in zip(starts[:-1][n > every], starts[1:][n > every], strict=True):
                rows = np.arange(start, end)
                _, which, count = np.unique(component[start:end], return_inverse=True, return_counts=True)
                rest = which != count.argmax()
                for i in rows[rest]:
                    j = g.reach(i, rows)
                    j = j[(component[j] != component[i]) & ((j > i) | ~rest[j - start])]
                    j = j[g.near(np.full(len(j), i), j)]
                    if len(j):
                        yield g.pairs(np.full(len(j), i), j)

    return run


def _sets(nodes: DataFrame, texts: DataFrame, hashes: Hashes) -> DataFrame:
    """(node, s) of nodes (node, h): their sets, cut from the texts again."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 1024):
                part = b.slice(i, 1024)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([np.unique(hashes(t)).tobytes() for t in _texts(part.column(1))], pa.binary())], names=["node", "s"])

    # texts that no node needs are left out before the shuffle, by a filter of at most FILTER_WORDS words
    bit = f"pmod(h, {FILTER_WORDS * 64})"
    word, at = F.expr(f"shiftright({bit}, 6)").alias("word"), f"cast({bit} & 63 as int)"
    words = nodes.groupBy(word).agg(F.expr(f"bit_or(shiftleft(1L, {at}))").alias("set"))
    some = texts.select("h", "text", word).join(F.broadcast(words), "word").where(F.expr(f"shiftright(set, {at}) & 1 = 1")).select("h", "text")
    # grouped by what the join is dealt by: texts are shuffled once
    one = some.join(nodes, "h").groupBy("h", "node").agg(F.min("text").alias("text"))
    return written(mapped(one.select("node", "text"), cut, "node long, s binary"), "sets")


def _verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, hashes: Hashes, similarity: float) -> DataFrame:
    """The pairs (u, v) whose sets have the similarity."""

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                a, b = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
                common = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(common >= similarity * (len(a) + len(b) - common) - 1e-9)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    def can(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            most = room(b.column(2).to_numpy(), b.column(3).to_numpy(), similarity)
            keep = [not (x.is_valid and y.is_valid) or apart(x.as_py(), y.as_py()) <= m for x, y, m in zip(b.column(4), b.column(5), most, strict=True)]
            yield b.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    side = lambda end, n: nodes.select(F.col("node").alias(end), F.col("size").alias(f"size{n}"), F.col("wide").alias(f"wide{n}"))
    both = pairs.join(side("u", 1), "u").join(side("v", 2), "v").where(F.least("size1", "size2") >= similarity * F.greatest("size1", "size2") - 1e-9)
    pairs = written(mapped(both.select("u", "v", "size1", "size2", "wide1", "wide2"), can, "u long, v long"), "near")
    wanted = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct().join(nodes.select("node", "h"), "node")
    sets = _sets(wanted, texts, hashes)
    both = pairs.join(sets.select(F.col("node").alias("u"), F.col("s").alias("a")), "u").join(sets.select(F.col("node").alias("v"), F.col("s").alias("b")), "v")
    return written(mapped(both.select("u", "v", "a", "b"), alike, "u long, v long"), "alike")


def similar_pairs(nodes: DataFrame, texts: DataFrame, hashes: Hashes, similarity: float, first: DataFrame, every: int = 16) -> DataFrame:
    """(u, v) between nodes that connect exactly what all pairs of at least the similarity connect.

    nodes: node, h, size, bits, wide, bands, one for each set; texts: h, text, among them each node's h; first: (u, v),
    u less, pairs to compare before any others are sought.
    """
    banded = nodes.select("node", F.explode("bands").alias("band"))
    least = banded.groupBy("band").agg(F.min("node").alias("u"), F.count("*").alias("n")).where("n > 1")
    pairs = banded.join(written(least.select("band", "u"), "bands"), "band").where("u <> node").select("u", F.col("node").alias("v")).union(first.select("u", "v")).distinct()
    links = _verified(written(pairs, "first"), nodes, texts, hashes, similarity)
    found = connected_components(links)
    linked = nodes.select("node", "h", "size").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    linked = written(linked, "linked")
    frequent = frequent_shingles(texts, linked.where("node = component").select("h"), hashes)
    tokens = prefixes(linked, texts, hashes, similarity, frequent).select(F.explode("prefix").alias("token"), "component", "node", "size").repartition("token").sortWithinPartitions("token")
    tokens = written(mapped(tokens, _met, "token long, component long, node long, size int"), "tokens")
    rows = tokens.join(nodes.select("node", "bits"), "node").select("token", "component", "node", "size", "bits")
    rows = rows.repartition("token").sortWithinPartitions("token", "size", "node")
    rest = written(mapped(rows, _across(similarity, every), "u long, v long").distinct(), "rest")
    return links.union(_verified(rest, nodes, texts, hashes, similarity)) if rest.take(1) else links
