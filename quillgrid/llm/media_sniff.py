"""Media columns: types by signature, confirmed by structure and lengths; embedded media are carved.

An Aho-Corasick automaton over all formats' magic bytes finds every place where a medium may begin, in one pass. A
validator for each format then follows the structure from there and says how long the medium is, or that it is none.
What begins at byte 0 and validates is the column's type, whatever was declared; what lies inside is carved, outermost
first.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, written

FRAME = 576
RATE = 8000
UNKNOWN = "application/octet-stream"


def _wav(b: bytes, at: int) -> int:
    """RIFF of WAVE: chunks within the declared length, a format chunk before the data, whole sample frames."""
    if b[at + 8 : at + 12] != b"WAVE" or len(b) < at + 12:
        return 0
    end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
    pos, width = at + 12, 0
    while pos + 8 <= end <= len(b):
        name, size = b[pos : pos + 4], struct.unpack_from("<I", b, pos + 4)[0]
        if pos + 8 + size > end:
            return 0
        if name == b"fmt " and size >= 16:
            width = struct.unpack_from("<H", b, pos + 20)[0]
        if name == b"data":
            return end - at if width and not size % width else 0
        pos += 8 + size + size % 2
    return 0


def _png(b: bytes, at: int) -> int:
    pos, first = at + 8, True
    while pos + 12 <= len(b):
        size, name = struct.unpack_from(">I4s", b, pos)
        if first and (name != b"IHDR" or size != 13) or pos + 12 + size > len(b):
            return 0
        if zlib.crc32(b[pos + 4 : pos + 8 + size]) != struct.unpack_from(">I", b, pos + 8 + size)[0]:
            return 0
        pos, first = pos + 12 + size, False
        if name == b"IEND":
            return pos - at
    return 0


def _gif(b: bytes, at: int) -> int:
    if len(b) < at + 14:
        return 0
    flags = b[at + 10]
    pos = at + 13 + (3 << (flags & 7) + 1 if flags & 128 else 0)

    def blocks(pos: int) -> int:
        while pos < len(b) and b[pos]:
            pos += 1 + b[pos]
        return pos + 1

    images = 0
    while pos < len(b):
        if b[pos] == 0x3B:
            return pos + 1 - at if images else 0
        if b[pos] == 0x21:
            pos = blocks(pos + 2)
        elif b[pos] == 0x2C and pos + 10 < len(b):
            flags = b[pos + 9]
            pos = blocks(pos + 11 + (3 << (flags & 7) + 1 if flags & 128 else 0))
            images += 1
        else:
            return 0
    return 0


def _bmp(b: bytes, at: int) -> int:
    if len(b) < at + 26:
        return 0
    size, reserved, start, header = struct.unpack_from("<IIII", b, at + 2)
    good = not reserved and header in (12, 40, 52, 56, 108, 124) and 14 + header <= start < size <= len(b) - at
    return size if good else 0


def _jpeg(b: bytes, at: int) -> int:
    pos, scan = at + 2, False
    while pos + 4 <= len(b):
        if b[pos] != 0xFF:
            return 0
        mark = b[pos + 1]
        if mark == 0xD9:
            return pos + 2 - at if scan else 0
        pos += 2 + struct.unpack_from(">H", b, pos + 2)[0]
        if mark == 0xDA:
            scan = True
            while pos + 1 < len(b) and not (b[pos] == 0xFF and b[pos + 1] not in (0, *range(0xD0, 0xD8))):
                pos = b.find(b"\xff", pos + 1)
                if pos < 0:
                    return 0
    return pos + 2 - at if scan and b[pos : pos + 2] == b"\xff\xd9" else 0


def _gzip(b: bytes, at: int) -> int:
    """Inflates, in steps of bounded memory, up to the checksum that ends the member."""
    if len(b) < at + 18 or b[at + 3] & 0xE0:
        return 0
    machine, pos = zlib.decompressobj(31), at
    try:
        while not machine.eof:
            step = machine.unconsumed_tail
            if not step:
                step, pos = b[pos : pos + 65536], pos + 65536
                if not step:
                    return 0
            machine.decompress(step, 1 << 20)
    except zlib.error:
        return 0
    return min(pos, len(b)) - len(machine.unused_data) - at


class Marks:
    """Where zip directories end and PDF marks stand, found once for a medium: no validator looks for them again."""

    def __init__(self, b: bytes):
        every = lambda mark: [m.start() for m in re.finditer(re.escape(mark), b)]
        #: A zip's first byte, as a directory's end says -> that end, the first one of the same start.
        self.zips: dict[int, int] = {}
        for end in every(b"PK\x05\x06") if b"PK\x05\x06" in b else []:
            if end + 22 <= len(b):
                size, start, note = struct.unpack_from("<IIH", b, end + 12)
                at = end - size - start
                if at >= 0 and end >= at + 30 and end + 22 + note <= len(b) and b[at + start : at + start + 2] == b"PK":
                    self.zips.setdefault(at, end + 22 + note)
        self.pdfs, self.ends, self.refs = (every(m) if m in b else [] for m in (b"%PDF-", b"%%EOF", b"startxref"))


def _zip(b: bytes, at: int, marks: Marks) -> int:
    return marks.zips.get(at, at) - at


def _pdf(b: bytes, at: int, marks: Marks) -> int:
    """Up to the last end mark before the next PDF begins."""
    if not b[at + 5 : at + 6].isdigit() or bisect_left(marks.refs, at) == len(marks.refs):
        return 0
    after = bisect_right(marks.pdfs, at)
    limit = marks.pdfs[after] if after < len(marks.pdfs) else len(b)
    last = bisect_right(marks.ends, limit - 5) - 1
    return marks.ends[last] + 5 - at if last >= 0 and marks.ends[last] >= at else 0


def _flac(b: bytes, at: int) -> int:
    """The metadata blocks; frames have no length of their own, so the stream lasts to the end."""
    pos, first = at + 4, True
    while pos + 4 <= len(b):
        kind, size = b[pos], int.from_bytes(b[pos + 1 : pos + 4], "big")
        if first and (kind & 127 or size != 34) or pos + 4 + size > len(b):
            return 0
        pos, first = pos + 4 + size, False
        if kind & 128:
            return len(b) - at
    return 0


#: Magic bytes and types.
FORMATS: dict[bytes, tuple[str, Callable[..., int]]] = {
    b"RIFF": ("audio/wav", _wav),
    b"\x89PNG\r\n\x1a\n": ("image/png", _png),
    b"GIF87a": ("image/gif", _gif),
    b"GIF89a": ("image/gif", _gif),
    b"BM": ("image/bmp", _bmp),
    b"\xff\xd8\xff": ("image/jpeg", _jpeg),
    b"\x1f\x8b\x08": ("application/gzip", _gzip),
    b"PK\x03\x04": ("application/zip", _zip),
    b"%PDF-": ("application/pdf", _pdf),
    b"fLaC": ("audio/flac", _flac),
}
_automaton: list = []


def automaton():
    if not _automaton:
        a = ahocorasick.Automaton()
        for magic in FORMATS:
            a.add_word(magic.decode("latin-1"), magic)
        a.make_automaton()
        _automaton.append(a)
    return _automaton[0]


@dataclass
class Found:
    kind: str
    at: int
    length: int


def carve(data: bytes) -> list[Found]:
    """Every valid medium in data by place; none inside another but for what lies within one at byte 0."""
    out, clear, marks = [], 0, None
    for end, magic in automaton().iter(data.decode("latin-1")):
        at = end + 1 - len(magic)
        if at and at < clear:
            continue
        kind, validate = FORMATS[magic]
        try:
            if validate in (_zip, _pdf):
                marks = marks or Marks(data)
                length = validate(data, at, marks)
            else:
                length = validate(data, at)
        except (struct.error, IndexError):
            length = 0
        if length:
            out.append(Found(kind, at, length))
            clear = at + length if at else 0
    return out


def sniff(data: bytes, declared: str | None) -> tuple[str, int, bool, list[Found]]:
    """Type, the length its structure gives (or all of data), whether declared was wrong, and embedded media."""
    found = carve(data)
    own = next((f for f in found if not f.at), None)
    kind, length = (own.kind, own.length) if own else (UNKNOWN, len(data))
    return kind, length, kind != (declared or UNKNOWN), [f for f in found if f.at]


def as_wav(payload: bytes) -> bytes:
    """A one-channel RIFF/WAVE of 8-bit samples: the payload's bytes."""
    fmt = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8)
    pad = b"\0" * (len(payload) % 2)
    return struct.pack("<4sI4s", b"RIFF", 4 + len(fmt) + 8 + len(payload) + len(pad), b"WAVE") + fmt + struct.pack("<4sI", b"data", len(payload)) + payload + pad


def wav_samples(media: bytes) -> bytes:
    pos = 12
    while media[pos : pos + 4] != b"data":
        size = struct.unpack_from("<I", media, pos + 4)[0]
        pos += 8 + size + size % 2
    return media[pos + 8 : pos + 8 + struct.unpack_from("<I", media, pos + 4)[0]]


def padded(raw: bytes) -> bytes:
    """raw and bytes 255 up to a positive multiple of FRAME."""
    return raw + b"\xff" * (-len(raw) % FRAME or (0 if raw else FRAME))


def text_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, declared (a generic type), media: each text's UTF-8 as samples of a WAVE; null counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 128):
                part = b.slice(i, 128)
                raw = [x or b"" for x in part.column(1).cast(pa.binary()).to_pylist()]
                media = pa.array([as_wav(padded(x)) for x in raw], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array([UNKNOWN] * len(raw)), media], names=["doc_id", "n_bytes", "declared", "media"])

    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, n_bytes long, declared string, media binary")


def features(media: bytes, declared: str | None) -> tuple[bytes, str]:
    """The payload of a medium and a string of its type, its correction, its samples' statistics and what is carved."""
    kind, length, corrected, inside = sniff(media, declared)
    payload = wav_samples(media[:length]) if kind == "audio/wav" else media
    x = np.frombuffer(payload, np.uint8)
    total = int(x.sum(dtype=np.int64))
    # whole numbers, so that equal bytes give equal strings on any machine
    spread = sum(int((x[i : i + (1 << 20)].astype(np.int64) ** 2).sum()) for i in range(0, len(x), 1 << 20))
    changes = int((x[1:] != x[:-1]).sum())
    carved = ",".join(f"{f.kind}@{f.at}+{f.length}" for f in inside)
    return payload, f"{kind};corrected={int(corrected)};length={length};frames={len(x) // FRAME};sum={total};squares={spread};changes={changes};carved=[{carved}]"


def examine(media: DataFrame) -> DataFrame:
    """From doc_id, n_bytes, declared, media: payload_bytes, payload_sha256, tail_crc32 (of its last 32 bytes),
    media_bytes, media_sha256, feature. A null medium counts as an empty one of no type."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for declared, m in zip(b.column(2).to_pylist(), b.column(3), strict=True):
                m = m.as_py() or b""
                payload, feature = features(m, declared)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(m), hashlib.sha256(m).hexdigest(), feature))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    fields = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return mapped(media.select("doc_id", "n_bytes", "declared", "media"), run, fields)


def stored_and_examined(docs: DataFrame) -> DataFrame:
    """One row per document: its text stored as a medium of undeclared type in a table, then read from there, sniffed and
    measured.

    Equal texts give equal values. Repeated rows come back as often as they came; extra columns aren't read; an empty
    table gives no rows. A medium is one row, whatever its length; it is read once from front to back but for inflating.
    """
    return examine(written(text_media(docs), "media"))
