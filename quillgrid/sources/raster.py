"""Page images: PNG (8 bits, not interlaced) and PNM files as arrays, crops, likeness, and the search for a photo on a page.
Other formats need a decoder of one's own; none is feigned."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Fixed values of the photo search: brightness of margins, texture that shows (and that shows a photo's core), the box
#: around text, shares of the page, aspects, border, least core.
MARGIN, TEXTURE, CORE_TEXTURE, AROUND, SHARES, ASPECTS, BORDER, CORE = 245, 4.0, 12.0, 33, (0.04, 0.55), (0.35, 2.8), 8, 5000


def decode(data: bytes) -> np.ndarray:
    """(height, width, 3) bytes, red first; raises ValueError for anything but PNG and PNM of 8 bits."""
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return _png(data)
    if data[:2] in (b"P5", b"P6"):
        return _pnm(data)
    raise ValueError("only PNG and PNM images can be read: pass a decoder for others")


def _pnm(data: bytes) -> np.ndarray:
    fields, at = [], 2
    while len(fields) < 3:
        while data[at : at + 1].isspace() or data[at : at + 1] == b"#":
            at = data.index(b"\n", at) + 1 if data[at : at + 1] == b"#" else at + 1
        end = at
        while not data[end : end + 1].isspace():
            end += 1
        fields.append(int(data[at:end]))
        at = end
    w, h, most = fields
    depth = 3 if data[:2] == b"P6" else 1
    if most != 255 or len(data) < at + 1 + w * h * depth:
        raise ValueError("a PNM image of 8 bits with all its pixels is needed")
    pixels = np.frombuffer(data, np.uint8, w * h * depth, at + 1).reshape(h, w, depth)
    return np.repeat(pixels, 3, 2) if depth == 1 else pixels.copy()


def _png(data: bytes) -> np.ndarray:
    at, packed, palette, head = 8, b"", None, None
    while at + 8 <= len(data):
        size, name = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + size]
        if name == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif name == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif name == b"IDAT":
            packed += body
        at += 12 + size
    if head is None or head[2] != 8 or head[6] or head[3] not in (0, 2, 3, 4, 6):
        raise ValueError("only PNG images of 8 bits that aren't interlaced can be read")
    w, h, _, kind = head[:4]
    depth = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[kind]
    rows = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(h, 1 + w * depth)
    out, above = np.zeros((h, w * depth), np.uint8), np.zeros(w * depth, np.int32)
    for y, row in enumerate(rows):
        line, how = row[1:].astype(np.int32), row[0]
        if how == 2:
            line = line + above
        elif how in (1, 3, 4):
            for x in range(0, w * depth, depth):  # each pixel leans on the one before
                left = line[x - depth : x] if x else np.zeros(depth, np.int32)
                up, corner = above[x : x + depth], above[x - depth : x] if x else np.zeros(depth, np.int32)
                if how == 1:
                    guess = left
                elif how == 3:
                    guess = (left + up) // 2
                else:
                    p = left + up - corner
                    a, b, c = abs(p - left), abs(p - up), abs(p - corner)
                    guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
                line[x : x + depth] = (line[x : x + depth] + guess) & 255
        above = line & 255
        out[y] = above
    pixels = out.reshape(h, w, depth)
    if kind == 3:
        return palette[pixels[:, :, 0]]
    return np.repeat(pixels[:, :, :1], 3, 2) if depth < 3 else pixels[:, :, :3].copy()


def encode(pixels: np.ndarray) -> bytes:
    """A PNG of (height, width, 3) bytes."""
    h, w = pixels.shape[:2]
    part = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    rows = np.concatenate([np.zeros((h, 1), np.uint8), pixels.reshape(h, -1)], axis=1).tobytes()
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(rows)) + part(b"IEND", b"")


def grey(pixels: np.ndarray) -> np.ndarray:
    return (pixels.astype(np.float64) @ [0.299, 0.587, 0.114]).round().astype(np.uint8)


def crop(pixels: np.ndarray, x: int, y: int, width: int, height: int) -> np.ndarray:
    """The part of an image within a rectangle that is moved and cut to lie in it."""
    h, w = pixels.shape[:2]
    x, y = max(0, min(x, w - 1)), max(0, min(y, h - 1))
    return pixels[y : y + max(1, min(height, h - y)), x : x + max(1, min(width, w - x))]


def resized(pixels: np.ndarray, width: int, height: int) -> np.ndarray:
    """An image of another size, each pixel the mean of the area that it stands for."""

    def along(a: np.ndarray, n: int) -> np.ndarray:
        total = np.concatenate([np.zeros((1, *a.shape[1:])), np.cumsum(a, axis=0)])
        edges = np.linspace(0, len(a), n + 1)
        low = np.minimum(edges.astype(int), len(a) - 1)
        at = total[low] + (edges - low)[:, None, None] * a[low]
        return np.diff(at, axis=0) * n / len(a)

    return along(along(pixels.astype(np.float64), height).swapaxes(0, 1), width).swapaxes(0, 1)


def similarity(source: np.ndarray, rendered: np.ndarray) -> float:
    """1 less the mean difference of pixels by 255, after source is brought to the other's size."""
    h, w = rendered.shape[:2]
    return 1.0 - float(np.abs(np.round(resized(source, w, h)) - rendered).mean()) / 255.0


def filled(width: int, height: int, polygons: Sequence[Sequence[Sequence[float]]]) -> np.ndarray:
    """Where polygons of three points or more lie, by the rule of crossings; their edges too."""
    mask = np.zeros((height, width), bool)
    for poly in polygons:
        p = np.array([[int(a[0]), int(a[1])] for a in poly if len(a) >= 2])
        if len(p) < 3:
            continue
        x1, y1 = np.maximum(p.min(axis=0), 0)
        x2, y2 = np.minimum(p.max(axis=0), [width - 1, height - 1])
        if x2 < x1 or y2 < y1:
            continue
        gx, gy = np.meshgrid(np.arange(x1, x2 + 1), np.arange(y1, y2 + 1))
        inside, edge = np.zeros(gx.shape, bool), np.zeros(gx.shape, bool)
        for (ax, ay), (bx, by) in zip(p, np.roll(p, -1, axis=0), strict=True):
            cross = (bx - ax) * (gy - ay) - (by - ay) * (gx - ax)
            edge |= (cross == 0) & (gx >= min(ax, bx)) & (gx <= max(ax, bx)) & (gy >= min(ay, by)) & (gy <= max(ay, by))
            if ay != by:
                inside ^= ((ay > gy) != (by > gy)) & (gx < (bx - ax) * (gy - ay) / (by - ay) + ax)
        mask[y1 : y2 + 1, x1 : x2 + 1] |= inside | edge
    return mask


def _spread_wide(mask: np.ndarray, wide: int, tall: int) -> np.ndarray:
    """mask with a box of these odd sizes around each of its points."""
    total = np.pad(mask.astype(np.int64), ((tall // 2,) * 2, (wide // 2,) * 2)).cumsum(0).cumsum(1)
    total = np.pad(total, ((1, 0), (1, 0)))
    return total[tall:, wide:] - total[:-tall, wide:] - total[tall:, :-wide] + total[:-tall, :-wide] > 0


def _spread(mask: np.ndarray, size: int) -> np.ndarray:
    return _spread_wide(mask, size, size)


def texture(g: np.ndarray) -> np.ndarray:
    """How much each pixel differs from its four neighbours, mirrored at the border."""
    a = np.pad(g.astype(np.float64), 1, mode="reflect")
    return np.abs(a[:-2, 1:-1] + a[2:, 1:-1] + a[1:-1, :-2] + a[1:-1, 2:] - 4 * a[1:-1, 1:-1])


def parts(mask: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(x, y, width, height, pixels) of each connected part, corners included, by runs of rows."""
    up: list[int] = []
    boxes: list[list[int]] = []

    def top(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    before: list[tuple[int, int, int]] = []
    for y, row in enumerate(mask):
        edges = np.flatnonzero(np.diff(np.concatenate([[0], row.view(np.int8), [0]])))
        here = []
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            mine = len(up)
            up.append(mine)
            boxes.append([a, y, b, y + 1, b - a])
            here.append((a, b, mine))
            for c, d, other in before:
                if c > b:
                    break
                if d >= a and (p := top(other)) != (q := top(mine)):
                    up[max(p, q)] = min(p, q)
        before = here
    joined: dict[int, list[int]] = {}
    for i, (a, y, b, e, n) in enumerate(boxes):
        t = joined.setdefault(top(i), [a, y, b, e, 0])
        t[:] = [min(t[0], a), min(t[1], y), max(t[2], b), max(t[3], e), t[4] + n]
    return [(a, y, b - a, e - y, n) for a, y, b, e, n in joined.values()]


def photo_box(pixels: np.ndarray, text: Sequence[Sequence[Sequence[float]]] = ()) -> tuple[int, int, int, int] | None:
    """x, y, width and height of the likeliest photo on a page: a part with texture, away from text and not as bright as
    margins, of a photo's size and shape and not at the border on three sides; then its core, if it has one."""
    h, w = pixels.shape[:2]
    g, words = grey(pixels), filled(w, h, text)
    best, most = None, 0.0
    for x, y, pw, ph, _ in parts(~_spread(words, AROUND) & (g < MARGIN) & (texture(g) > TEXTURE)):
        share, aspect = pw * ph / (w * h), pw / max(ph, 1)
        sides = (x <= BORDER) + (y <= BORDER) + (x + pw >= w - BORDER) + (y + ph >= h - BORDER)
        if not (SHARES[0] <= share <= SHARES[1] and ASPECTS[0] <= aspect <= ASPECTS[1]) or sides >= 3:
            continue
        score = share + 0.08 * (0.55 <= aspect <= 1.8) + 0.10 * (0.10 <= share <= 0.30) + 0.03 * (x < 0.55 * w)
        if score > most:
            best, most = (x, y, pw, ph), score
    if best is None:
        return None
    x, y, pw, ph = best
    core, most = best, 0.0
    for cx, cy, cw, ch, n in parts((texture(g[y : y + ph, x : x + pw]) > CORE_TEXTURE) & ~words[y : y + ph, x : x + pw]):
        aspect = cw / max(ch, 1)
        if n < max(CORE, int(pw * ph * 0.08)) or not 0.45 <= aspect <= 1.9:
            continue
        if (score := n * (1.15 if 0.65 <= aspect <= 1.35 else 1.0)) > most:
            core, most = (x + cx, y + cy, cw, ch), score
    return core


def dark(g: np.ndarray) -> np.ndarray:
    """Which pixels of a blurred page are dark, by the threshold that parts its brightness best (Otsu)."""
    kernel = np.array([1, 4, 6, 4, 1]) / 16
    blurred = g.astype(np.float64)
    for axis in (0, 1):
        padded = np.pad(blurred, [(2, 2) if a == axis else (0, 0) for a in (0, 1)], mode="reflect")
        blurred = sum(k * np.take(padded, range(i, i + g.shape[axis]), axis) for i, k in enumerate(kernel))
    blurred = blurred.round().astype(np.uint8)
    n = np.bincount(blurred.ravel(), minlength=256).astype(np.float64)
    below, total = np.cumsum(n), np.cumsum(n * np.arange(256))
    with np.errstate(divide="ignore", invalid="ignore"):
        apart = (total[-1] * below / below[-1] - total) ** 2 / (below * (below[-1] - below))
    return blurred <= int(np.nanargmax(np.where(np.isfinite(apart), apart, -1)))


def regions(pixels: np.ndarray) -> list[tuple[str, float, float, float, float]]:
    """(block type, x1, y1, x2, y2) of coarse regions of a front page: up to two wide dark bands in its upper part among the
    twelve largest parts, a lively middle, a dark right side, a dark foot in four columns, and always the place of the
    continuation box."""
    h, w = pixels.shape[:2]
    g = grey(pixels)
    ink = dark(g)
    wide = max(15, w // 40) | 1
    closed = ~_spread_wide(~_spread_wide(ink, wide, 3), wide, 3)
    out: list[tuple[str, float, float, float, float]] = []
    for x, y, pw, ph, _ in sorted(parts(closed), key=lambda p: -p[4])[:12]:
        if pw >= 0.45 * w and 0.015 * h <= ph <= 0.12 * h and y <= 0.45 * h and len(out) < 2:
            out.append((("main_headline", "secondary_headline")[len(out)], float(x), float(y), float(x + pw), float(y + ph)))
    middle = g[int(h * 0.18) : int(h * 0.72), int(w * 0.05) : int(w * 0.62)]
    if middle.size and middle.astype(np.float64).var() > 900:
        out.append(("hero_image", w * 0.05, h * 0.22, w * 0.62, h * 0.72))
    if (right := ink[:, int(w * 0.72) :]).size and 255 * right.mean() > 12:
        out.append(("right_sidebar", w * 0.72, h * 0.18, w * 0.97, h * 0.78))
    if (foot := ink[int(h * 0.72) :, :]).size and 255 * foot.mean() > 10:
        out += [("bottom_columns", i * w / 4, h * 0.72, (i + 1) * w / 4 - w * 0.02, h * 0.95) for i in range(4)]
    return [*out, ("continuation_box", w * 0.78, h * 0.88, w * 0.97, h * 0.97)]


def candidates(files: DataFrame, decoder: Callable[[bytes], np.ndarray] = decode) -> DataFrame:
    """(path, n, block_type, x1, y1, x2, y2): regions of image files (path, content), in order; none for files that can't be
    read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                try:
                    rows += [(path, n, *r) for n, r in enumerate(regions(decoder(content.as_py())))]
                except (ValueError, struct.error, zlib.error):
                    continue
            columns = list(zip(*rows, strict=True)) if rows else [()] * 7
            kinds = (pa.string(), pa.int32(), pa.string(), *[pa.float64()] * 4)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["path", "n", "block_type", "x1", "y1", "x2", "y2"])

    return files.select("path", "content").mapInArrow(run, "path string, n int, block_type string, x1 double, y1 double, x2 double, y2 double")


def sizes(files: DataFrame, decoder: Callable[[bytes], np.ndarray] = decode) -> DataFrame:
    """(path, width, height) of image files (path, content); nulls for what can't be read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for content in b.column(1):
                try:
                    h, w = decoder(content.as_py()).shape[:2]
                    found.append((w, h))
                except (ValueError, struct.error, zlib.error):
                    found.append((None, None))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([f[i] for f in found], pa.int32()) for i in (0, 1))], names=["path", "width", "height"])

    return files.select("path", "content").mapInArrow(run, "path string, width int, height int")


def photos(files: DataFrame, decoder: Callable[[bytes], np.ndarray] = decode) -> DataFrame:
    """(path, x, y, width, height, png) of image files (path, content, polys): the photo on each and its pixels; pages
    without one, and files that can't be read, give no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for path, content, polys in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                try:
                    pixels = decoder(content.as_py())
                except (ValueError, struct.error, zlib.error):
                    continue
                if (box := photo_box(pixels, polys or ())) is not None:
                    out.append((path, *box, encode(crop(pixels, *box))))
            columns = list(zip(*out, strict=True)) if out else [()] * 6
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["path", "x", "y", "width", "height", "png"])

    return files.select("path", "content", "polys").mapInArrow(run, "path string, x int, y int, width int, height int, png binary")
