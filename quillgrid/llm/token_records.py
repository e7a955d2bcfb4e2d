"""Token ids as length-delimited binary records, with an offset index for shuffled reads.

A file is a sequence of frames, each followed by MARK:
  0x01 | length u64 | masked CRC of the length u32 | payload | masked CRC of the payload u32        (little-endian)
  payload: mask byte | flags (1: has doc_id, 2: four-byte ids) | doc_id i64 | ids, two bytes each or four
All of the payload behind the mask byte is XORed with it; the writer takes the first mask (0 as a rule) under which MARK
occurs nowhere in the frame, so a reader can start at any MARK and files can be split. MARK's first byte occurs in it
once, so no frame's end can feign one. Checksums are CRC-32, masked by rotation and addition, so that a checksum of
bytes that hold checksums is not degenerate.
Files go through Spark's own writer and readers: any store will do, and lost tasks are committed once.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import RangeBuckets, fresh_path, mapped, written

MARK = "\x1e<record-mark:01>"
_MARK = MARK.encode()
#: Bytes of pieces that are known by their ids, and of an entry beside its text.
CACHED_BYTES, ENTRY = 192 << 20, 160


def masked(crc: int) -> int:
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: np.ndarray) -> bytes:
    """One record; ids as two bytes each if all are below 65,536."""
    wide = bool(len(ids)) and int(ids.max()) > 0xFFFF
    body = struct.pack("<Bq", (doc_id is not None) | wide << 1, doc_id or 0) + ids.astype("<u4" if wide else "<u2").tobytes()
    for mask in range(256):
        payload = bytes([mask]) + (body if not mask else (np.frombuffer(body, np.uint8) ^ np.uint8(mask)).tobytes())
        length = struct.pack("<Q", len(payload))
        out = b"\x01" + length + struct.pack("<I", masked(zlib.crc32(length))) + payload + struct.pack("<I", masked(zlib.crc32(payload)))
        if _MARK not in out:
            return out
    raise ValueError("no mask keeps the record mark out of this frame")


def unframe(data: bytes) -> tuple[int | None, np.ndarray]:
    """doc_id and ids (u32) of one frame; raises ValueError if a length or checksum is wrong."""
    if len(data) < 27 or data[0] != 1:
        raise ValueError("not a record frame")
    (length,), (length_crc,) = struct.unpack("<Q", data[1:9]), struct.unpack("<I", data[9:13])
    payload = data[13:-4]
    if masked(zlib.crc32(data[1:9])) != length_crc or length != len(payload):
        raise ValueError("damaged record length")
    if masked(zlib.crc32(payload)) != struct.unpack("<I", data[-4:])[0]:
        raise ValueError("damaged record payload")
    body = payload[1:] if not payload[0] else (np.frombuffer(payload, np.uint8)[1:] ^ np.uint8(payload[0])).tobytes()
    flags, doc_id = struct.unpack("<Bq", body[:9])
    return doc_id if flags & 1 else None, np.frombuffer(body, "<u4" if flags & 2 else "<u2", offset=9).astype("<u4")


class WordEncoder:
    """The library's encoding of whole texts, each distinct piece encoded once.

    Only for tokenizers that compose (NFC), lower-case, drop white space and split by PIECE. Texts of Latin letters,
    which composing leaves alone, are cut by that pattern; others at spaces and line ends, which no step looks across.
    Pieces that aren't known yet are sent to the library many at a time, as one text, and its offsets tell them apart.
    """

    #: The tokenizer's own pattern over lower-cased text up to U+024F, where letters, numbers and white space are these.
    LETTER, NUMBER, SPACE = "a-zA-Zªµº\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", "0-9²³¹¼½¾", " \t\n\x0b\x0c\r\x85\xa0"
    PIECE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[{NUMBER}]|[^{SPACE}{LETTER}{NUMBER}]+").findall
    #: The same over lower-cased ASCII.
    ASCII_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+", re.ASCII).findall
    #: Characters that composing may change.
    ODD = re.compile("[^\x00-\u024f]").search

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.kind = "<u2" if self.library.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"
        self.known: dict[str, bytes] = {}
        self.held = 0  # bytes of known, about
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def pieces(self, text: str) -> tuple[list[str], bool]:
        """The text's pieces, and whether each is exactly one word of the tokenizer."""
        low, ascii = text.lower(), text.isascii()
        if "<|" in low or not ascii and self.ODD(low):  # the beginning of a special token, or what composing may change
            return text.replace("\n", " ").split(" "), False
        return (self.ASCII_PIECE if ascii else self.PIECE)(low), True

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        every = [self.pieces(t) for t in texts]
        if self.held > CACHED_BYTES:
            self.known.clear()
            self.held = 0
        known = self.known
        for whole in (True, False):
            new = list(set().union(*(ps for ps, w in every if w == whole)).difference(known))
            for i in range(0, len(new), 4000):
                some = new[i : i + 4000]
                known.update(zip(some, self._encoded(some, whole), strict=True))
                self.held += ENTRY * len(some) + sum(map(len, some))
        return [np.frombuffer(b"".join(map(known.__getitem__, ps)), self.kind) for ps, _ in every]

    def _encoded(self, pieces: list[str], whole: bool) -> list[bytes]:
        text = " ".join(pieces)
        ids = np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)
        ends = self.ends[ids]
        if whole and ends.sum() == len(pieces):
            at = np.flatnonzero(ends) + 1
        else:
            found = self.library.encode(text, add_special_tokens=False)
            ids, stops = np.array(found.ids, self.kind), np.cumsum([len(p) + 1 for p in pieces])
            at = np.searchsorted([a for a, _ in found.offsets], stops)
        packed = ids.tobytes()
        at = (at * ids.itemsize).tolist()
        return [packed[a:b] for a, b in zip([0, *at], at, strict=False)]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def _framed(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(path)
        for b in batches:
            for i in range(0, b.num_rows, 64):
                part = b.slice(i, 64)
                encoded = words.encode([t or "" for t in part.column(2).to_pylist()])
                frames = [frame(doc_id, np.append(ids, np.array([end_id], words.kind))) for doc_id, ids in zip(part.column(1).to_pylist(), encoded, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(frames, pa.binary())], names=["shard", "doc_id", "frame"])

    return run


def write_records(docs: DataFrame, out: str, tokenizer: str, end_id: int = 1, rows_each: int = 1024) -> None:
    """Writes each document's ids and end_id as one record under out, in ascending doc_id: shard=0, shard=1, ... hold
    ranges of doc_id, one file each. Documents of one doc_id are in the order of their records' bytes. Rows without a
    doc_id come last, dealt over shards of their own by hash; null texts have the end id only."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    cut = RangeBuckets(docs, "doc_id", rows_each)
    loose = max(1, min(1 << 16, -(-docs.where("doc_id is null").count() // rows_each)))
    shard = F.when(F.col("doc_id").isNull(), len(cut.starts) + F.pmod(F.xxhash64("text", F.monotonically_increasing_id()), F.lit(loose))).otherwise(cut.bucket(F.col("doc_id")))
    framed = mapped(docs.select(shard.cast("int").alias("shard"), "doc_id", "text"), _framed(tokenizer, end_id), "shard int, doc_id long, frame binary")
    dealt = framed.repartition("shard").sortWithinPartitions("shard", F.col("doc_id").asc_nulls_last(), "frame")
    # bytes as a string column: the text writer copies them as they are
    dealt.select("shard", F.col("frame").cast("string").alias("value")).write.partitionBy("shard").option("lineSep", MARK).text(out)


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, n, crc, length = [], [], [], []
        for data in b.column(0):
            data = data.as_py()
            doc_id, tokens = unframe(data)
            ids.append(doc_id)
            n.append(len(tokens))
            crc.append(zlib.crc32(tokens.tobytes()))
            length.append(len(data))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([*b.columns[1:], *(pa.array(x, k) for x, k in zip((ids, n, crc, length), kinds, strict=True))], names=["shard", "file", "block", "row", "doc_id", "n_tokens", "ids_crc32", "length"])


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Reads the records under path, checks every length and checksum, and says where each lies: shard, file, offset,
    length, doc_id, start (ids before it, over all files in order), n_tokens, ids_crc32."""
    if not spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path").where("path like '%/part-%'").take(1):
        return spark.createDataFrame([], "shard int, file string, offset long, length long, doc_id long, start long, n_tokens long, ids_crc32 long")
    lines = spark.read.schema("value string, shard int").option("lineSep", MARK).text(path)
    raw = lines.select(F.col("value").cast("binary").alias("value"), "shard", F.concat(F.lit("shard="), F.col("shard").cast("string"), F.lit("/"), F.col("_metadata.file_name")).alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    found = mapped(raw, _parsed, "shard int, file string, block long, row long, doc_id long, n_tokens long, ids_crc32 long, length long")
    found = written(found, "records")
    shards = found.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    shards = shards.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))  # as many rows as RangeBuckets has starts
    order = Window.partitionBy("shard").orderBy("file", "block", "row")
    before = lambda c: F.sum(c).over(order) - F.col(c)
    found = found.withColumn("start", before("n_tokens")).withColumn("offset", before("length") + len(_MARK) * (F.row_number().over(order) - 1))
    out = found.join(shards, "shard").withColumn("start", F.col("start") + F.col("before"))
    return out.select("shard", "file", "offset", "length", "doc_id", "start", "n_tokens", "ids_crc32")


def write_index(spark: SparkSession, path: str, index: str) -> DataFrame:
    """Writes read_index(path) as a table of its own, apart from the records, and returns it."""
    read_index(spark, path).write.parquet(index)
    return spark.read.parquet(index)


def shuffled(index: DataFrame, epoch: int) -> DataFrame:
    """The index in a reading order that a hash of place and epoch gives: reruns agree, epochs differ."""
    return index.orderBy(F.xxhash64("shard", "file", "offset", F.lit(epoch)), "shard", "file", "offset")


def read_frames(spark: SparkSession, path: str, index: DataFrame) -> DataFrame:
    """(file, offset, doc_id, ids) of index's rows (file, offset, length), each cut from its file by offset and length and
    checked. A file is read once, whatever the order of its rows; for shuffled reading order the result as shuffled()
    orders the index."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    files = files.select(F.regexp_extract("path", r"(shard=\d+/[^/]+)$", 1).alias("file"), "content")
    wanted = index.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("offset", "length"))).alias("places"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, places, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                data = memoryview(content.as_buffer())
                for i in range(0, len(places), 256):
                    part = places[i : i + 256]
                    found = [unframe(bytes(data[p["offset"] : p["offset"] + p["length"]])) for p in part]
                    columns = [pa.array([file] * len(part)), pa.array([p["offset"] for p in part], pa.int64()), pa.array([d for d, _ in found], pa.int64()), pa.array([x.astype(np.int64) for _, x in found], pa.list_(pa.int64()))]
                    yield pa.RecordBatch.from_arrays(columns, names=["file", "offset", "doc_id", "ids"])

    return mapped(files.join(wanted, "file").select("file", "places", "content"), run, "file string, offset long, doc_id long, ids array<long>")


def record_table(docs: DataFrame, tokenizer: str, end_id: int = 1, rows_each: int = 1024) -> DataFrame:
    """Writes docs' records to the shared folder and returns the index read back from them.

    An empty table writes no record and gives no rows. Repeated rows have a record each; extra columns aren't read.
    """
    spark = docs.sparkSession
    path = fresh_path(spark, "records")
    write_records(docs, path, tokenizer, end_id, rows_each)
    return write_index(spark, path, fresh_path(spark, "index"))
