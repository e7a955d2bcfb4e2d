"""BPE encoding as a bounded-lookahead streaming transducer, and incremental decoding.

Byte sequences have one BPE encoding, and each prefix has its own. Two neighbouring tokens can stand together exactly
if merging their joint bytes gives the two again; a sequence whose neighbours all can is the encoding. The transducer
therefore walks longest tokens first, steps back where no token can follow, and needs no priority queue.

Lookahead: what is appended to a text can change a token boundary only through a chain of merges, each of a later rank
than the one on its right whose left part it takes in. The longest such chain, in bytes, plus the longest token is
enough to look ahead; tokens that end further back than that are stable and are emitted. Memory is that many bytes and
one block, whatever the text's length.
"""

from __future__ import annotations

import codecs
import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped

#: Fixed value: the pattern that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Runs of a class, for a pretoken that goes on in the next chunk.
RUNS = [regex.compile(p) for p in (r"\p{L}*", r"\p{N}*", r"\s*", r"[^\s\p{L}\p{N}]*")]
SPACE = RUNS[2]
LONG, BLOCK, CHUNK = 1 << 10, 1 << 12, 1 << 16
CACHED, PAIRS = 400_000, 400_000
#: Entries of them that a worker may keep between tasks.
KEPT = 50_000


def byte_letters() -> dict[str, int]:
    """The vocabulary file's letter for each byte: printable bytes stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """A byte-level merge list: tokens, ranks, which tokens can stand together, and the lookahead that suffices."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        letters = byte_letters()
        as_bytes = lambda s: bytes(letters[c] for c in s)
        self.specials = {t["content"]: t["id"] for t in model.get("added_tokens") or []}
        self.ids = {as_bytes(s): i for s, i in model["model"]["vocab"].items() if s not in self.specials}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["model"]["merges"]]
        self.merges = [(as_bytes(a), as_bytes(b)) for a, b in pairs]
        self.rank = {m: r for r, m in enumerate(self.merges)}
        self.parts = {}
        for m in self.merges:
            self.parts.setdefault(m[0] + m[1], m)
        self.token = dict(zip(self.ids.values(), self.ids, strict=True)) | {i: s.encode() for s, i in self.specials.items()}
        self.longest = max(map(len, self.ids))
        self.split = regex.compile(PATTERN).findall
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) or r"(?!)")
        self.held = max(map(len, self.specials), default=1) - 1
        self.reach = {}  # by up to a token's first four bytes: the longest token with them
        for t in self.ids:
            for n in range(1, min(4, len(t)) + 1):
                self.reach[t[:n]] = max(self.reach.get(t[:n], 1), len(t))
        self.lookahead = self.longest + self.longest_chain()
        self.spines: dict[bytes, tuple] = {}
        self.fits: dict[int, bool] = {}
        self.known: dict[str, tuple] = {}

    def forget(self) -> None:
        """Gives back what a task has learned, but for little, so that workers that wait hold little memory."""
        for cache in (self.known, self.fits):
            if len(cache) > KEPT:
                cache.clear()

    def longest_chain(self) -> int:
        """Bytes that the longest chain of merges covers: from the last rank down, the best continuation of each merge
        is the best later one whose right part starts with this one's left part."""
        best: dict[bytes, int] = {}
        most = 0
        for left, right in reversed(self.merges):
            here = len(left) + best.get(left, 0)
            most = max(most, here)
            for n in range(1, len(right) + 1):
                if best.get(right[:n], 0) < here:
                    best[right[:n]] = here
        return most

    def _spines(self, token: bytes) -> tuple:
        """Of a token's merge tree: its right edge and its left edge, from the byte up, as (part, rank that takes it in)."""
        if (found := self.spines.get(token)) is None:
            edges = []
            for side in (1, 0):
                edge, at, taken = [], token, len(self.merges)
                while True:
                    edge.append((at, taken))
                    if len(at) == 1:
                        break
                    taken = self.rank[self.parts[at]]
                    at = self.parts[at][side]
                edges.append(edge[::-1])
            found = self.spines[token] = tuple(edges)
        return found

    def fit(self, a: bytes, b: bytes) -> bool:
        """Whether merging a + b gives a, b again: follows what stands on both sides of the boundary, in rank order, and
        finds no merge across it that would come first (on the left the lower rank, on the right an equal one too)."""
        left, right = self._spines(a)[0], self._spines(b)[1]
        i = j = 0
        while True:
            (x, x_until), (y, y_until) = left[i], right[j]
            across = self.rank.get((x, y))
            if across is not None and across < x_until and across <= y_until:
                return False
            if i + 1 == len(left) and j + 1 == len(right):
                return True
            if x_until <= y_until:
                i += 1
            else:
                j += 1

    def longest_at(self, s: bytes, at: int) -> int:
        """No token of s at this place is longer."""
        reach = self.reach
        for n in (4, 3, 2):
            if most := reach.get(s[at : at + n]):
                return most if n == 4 else n if len(s) - at >= 4 else most
        return 1

    def walk(self, s: bytes, before: bytes | None) -> list[int]:
        """The tokens of s, which follow the token before, as ids."""
        ids, fits = self.ids, self.fits
        out: list[int] = []
        starts: list[int] = []
        dead: set[int] = set()
        at, n = 0, len(s)
        last = -1 if before is None else ids[before]
        first = last
        most = self.longest_at(s, 0)
        while at < n:
            while most:
                i = ids.get(t := s[at : at + most])
                if i is not None and not (dead and at + len(t) in dead):
                    if last < 0:
                        break
                    if (fit := fits.get(key := last << 20 | i)) is None:
                        if len(fits) >= PAIRS:
                            fits.clear()
                        fit = fits[key] = self.fit(self.token[last], t)
                    if fit:
                        break
                most = len(t) - 1
            if most:
                out.append(i)
                starts.append(at)
                last = i
                at += len(t)
                if at < n:
                    most = self.longest_at(s, at)
            else:
                dead.add(at)
                out.pop()
                most = at - starts[-1] - 1
                at = starts.pop()
                last = out[-1] if out else first
        return out

    def pretoken(self, text: str) -> tuple:
        if (found := self.known.get(text)) is None:
            if len(self.known) >= CACHED:
                self.known.clear()
            found = tuple(self.walk(text.encode(), None))
            if len(text) <= 64:
                self.known[text] = found
        return found


class OpenPretoken:
    """A pretoken that arrives in parts: holds no more than the lookahead and a block."""

    def __init__(self, merges: Merges):
        self.merges, self.rest, self.context = merges, b"", None

    def feed(self, part: bytes) -> list[int]:
        out = []
        for i in range(0, len(part), BLOCK):
            self.rest += part[i : i + BLOCK]
            if len(self.rest) > self.merges.lookahead + BLOCK:
                out += self._emit(len(self.rest) - self.merges.lookahead)
        return out

    def finish(self) -> list[int]:
        return self._emit(len(self.rest))

    def _emit(self, stable: int) -> list[int]:
        out, end = [], 0
        for i in self.merges.walk(self.rest, self.context):
            t = self.merges.token[i]
            if end + len(t) > stable:
                break
            out.append(i)
            end += len(t)
            self.context = t
        self.rest = self.rest[end:]
        return out


class Encoder:
    """Text in chunks to token ids: feed() gives the ids that no later text can change, finish() the others."""

    def __init__(self, merges: Merges):
        self.merges, self.buffer = merges, ""
        self.open: OpenPretoken | None = None
        self.run = None
        self.split, self.special, self.held = merges.split, merges.special, merges.held

    def feed(self, chunk: str) -> list[int]:
        return self._take(self.buffer + chunk, False)

    def finish(self) -> list[int]:
        return self._take(self.buffer, True)

    def _take(self, text: str, final: bool) -> list[int]:
        out: list[int] = []
        at = 0
        for m in self.special.finditer(text):
            self._segment(text[at : m.start()], True, out)
            out.append(self.merges.specials[m.group()])
            at = m.end()
        rest = text[at:] if at else text
        held = 0
        if not final:  # the end may be the beginning of a special token
            held = next((n for n in range(min(self.held, len(rest)), 0, -1) if any(s.startswith(rest[-n:]) for s in self.merges.specials)), 0)
        body = rest[: len(rest) - held]
        self.buffer = self._segment(body, final, out) + rest[len(rest) - held :]
        return out

    def _segment(self, text: str, final: bool, out: list[int]) -> str:
        """Adds the ids of text; returns the end of it that must wait."""
        if self.open:
            run = self.run.match(text).group()
            if len(run) == len(text) and not final:
                keep = 1 if self.run is SPACE and run else 0  # a last space belongs to what follows
                out += self.open.feed(run[: len(run) - keep].encode())
                return run[len(run) - keep :]
            if self.run is SPACE and len(run) < len(text):
                run = run[:-1]
            out += self.open.feed(run.encode())
            out += self.open.finish()
            self.open, text = None, text[len(run) :]
        tokens = self.split(text)
        wait = ""
        if tokens and not final:
            wait = tokens.pop()
        known, encode = self.merges.known, self.merges.pretoken
        for t in tokens:
            out += known.get(t) or encode(t)
        if len(wait) > LONG:
            self.run = next(r for r in RUNS if r.match(wait[-1]).group())
            self.open = OpenPretoken(self.merges)
            keep = 1 if self.run is SPACE else 0
            out += self.open.feed(wait[: len(wait) - keep].encode())
            wait = wait[len(wait) - keep :]
        return wait


class Decoder:
    """Token ids in chunks to text: a UTF-8 state machine that holds the bytes of an unfinished character only."""

    def __init__(self, merges: Merges):
        self.token = merges.token
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: list[int]) -> str:
        return self.machine.decode(b"".join(map(self.token.__getitem__, ids)))

    def finish(self) -> str:
        return self.machine.decode(b"", True)


_loaded: dict[str, Merges] = {}


def merges(path: str) -> Merges:
    """The merge list at path, read once a process."""
    if path not in _loaded:
        _loaded[path] = Merges(path)
    return _loaded[path]


def stream(text: str, m: Merges, chunk: int = CHUNK) -> Iterator[list[int]]:
    encoder = Encoder(m)
    for i in range(0, len(text), chunk):
        yield encoder.feed(text[i : i + chunk])
    yield encoder.finish()


def round_trip(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256 (of the text decoded from the ids), same (text regained),
    and with_ids the ids themselves.

    Ids and decoded text pass through hashes chunk by chunk, so a text of any length needs constant memory beside
    itself (and its ids, if asked for). Null texts count as empty; repeated rows come back as often as they came; extra
    columns aren't read; an empty table gives no rows.
    """
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "same", "ids"][: 5 + with_ids]
    kinds = (pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.list_(pa.int32()))

    def one(text: str, m: Merges) -> tuple:
        n, of_ids, of_text, decoder, every = 0, hashlib.sha256(), hashlib.sha256(), Decoder(m), []
        for ids in stream(text, m):
            n += len(ids)
            packed = np.array(ids, "<u4")
            of_ids.update(packed.tobytes())
            of_text.update(decoder.feed(ids).encode())
            if with_ids:
                every.append(packed.astype(np.int32))
        of_text.update(decoder.finish().encode())
        row = n, of_ids.hexdigest(), of_text.hexdigest(), of_text.digest() == hashlib.sha256(text.encode()).digest()
        return (*row, np.concatenate(every)) if with_ids else row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merges(path)
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                columns = zip(*(one(t.as_py() or "", m) for t in part.column(1)), strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=False))], names=names)
        m.forget()

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return mapped(docs, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, same boolean" + ", ids array<int>" * with_ids)
