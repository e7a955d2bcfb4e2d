import struct
import zlib

import numpy as np
import pytest

from quillgrid.sources import raster as R


def page(seed=1):
    rng = np.random.default_rng(seed)
    pixels = np.full((400, 500, 3), 255, np.uint8)
    pixels[60:220, 80:300] = rng.integers(0, 230, (160, 220, 3))
    pixels[300:320, 40:460] = rng.integers(0, 200, (20, 420, 1))
    return pixels


def test_png_and_pnm_come_back():
    pixels = page()
    assert (R.decode(R.encode(pixels)) == pixels).all()
    assert (R.decode(b"P6 # note\n500 400\n255\n" + pixels.tobytes()) == pixels).all()
    assert (R.decode(b"P5 500 400 255\n" + pixels[:, :, 0].tobytes())[:, :, 2] == pixels[:, :, 0]).all()
    for bad in (b"JFIF", b"P6 9 9 255\n123", R.encode(pixels)[:24] + b"\x10" + R.encode(pixels)[25:]):
        with pytest.raises(ValueError):
            R.decode(bad)


def test_filters_of_png_rows():
    rng = np.random.default_rng(2)
    pixels = rng.integers(0, 256, (5, 7, 3), np.uint8)
    raw = b""
    flat = pixels.reshape(5, -1).astype(int)
    for y, how in enumerate((0, 1, 2, 3, 4)):
        row = []
        for x in range(21):
            a, b = flat[y][x - 3] if x >= 3 else 0, flat[y - 1][x] if y else 0
            c = flat[y - 1][x - 3] if y and x >= 3 else 0
            paeth = min((a, b, c), key=lambda v: (abs(a + b - c - v), (a, b, c).index(v)))
            row.append((flat[y][x] - (0, a, b, (a + b) // 2, paeth)[how]) % 256)
        raw += bytes([how, *row])
    part = lambda n, d: struct.pack(">I", len(d)) + n + d + b"\0\0\0\0"
    png = b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", 7, 5, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")
    assert (R.decode(png) == pixels).all()


def test_likeness():
    pixels = page()
    assert R.similarity(pixels, pixels) == 1.0 and R.similarity(pixels, 255 - pixels) < 0.5
    assert R.similarity(np.repeat(np.repeat(pixels, 2, 0), 2, 1), pixels) == pytest.approx(1.0)
    assert R.resized(pixels, 250, 100).shape == (100, 250, 3) and R.resized(np.full((9, 9, 3), 7), 4, 5).round(6).min() == 7


def test_parts_equal_flood_fill():
    mask = np.random.default_rng(3).random((30, 40)) < 0.45
    seen, want = np.zeros(mask.shape, bool), []
    for y, x in zip(*np.nonzero(mask), strict=True):
        if seen[y, x]:
            continue
        stack, cells = [(y, x)], []
        seen[y, x] = True
        while stack:
            a, b = stack.pop()
            cells.append((a, b))
            for p in range(max(a - 1, 0), min(a + 2, 30)):
                for q in range(max(b - 1, 0), min(b + 2, 40)):
                    if mask[p, q] and not seen[p, q]:
                        seen[p, q] = True
                        stack.append((p, q))
        ys, xs = zip(*cells, strict=True)
        want.append((min(xs), min(ys), max(xs) - min(xs) + 1, max(ys) - min(ys) + 1, len(cells)))
    assert sorted(R.parts(mask)) == sorted(want)


def test_a_photo_is_found_apart_from_text(spark):
    text = [[[40.0, 300.0], [460.0, 300.0], [460.0, 320.0], [40.0, 320.0]]]
    x, y, w, h = R.photo_box(page(), text)
    assert abs(x - 80) <= 2 and abs(y - 60) <= 2 and abs(w - 220) <= 4 and abs(h - 160) <= 4
    assert R.photo_box(np.full((100, 100, 3), 255, np.uint8)) is None
    assert R.filled(20, 20, [[[2, 2], [10, 2], [10, 8], [2, 8]], [[1, 1], [2, 2]]]).sum() == 63
    rows = [("a", bytearray(R.encode(page())), text), ("b", bytearray(b"none"), None)]
    files = spark.createDataFrame(rows, "path string, content binary, polys array<array<array<double>>>")
    assert {r["path"]: (r["width"], r["height"]) for r in R.sizes(files).collect()} == {"a": (500, 400), "b": (None, None)}
    found = R.photos(files).collect()
    assert [(r["path"], r["x"], r["width"]) for r in found] == [("a", x, w)] and R.decode(bytes(found[0]["png"])).shape == (h, w, 3)


def test_regions_of_a_page(spark):
    pixels = np.full((600, 500, 3), 255, np.uint8)
    pixels[40:70, 50:390] = 0
    pixels[90:115, 60:380] = 10
    pixels[200:400, 60:280] = np.random.default_rng(4).integers(0, 255, (200, 220, 3))
    kinds = R.regions(pixels)
    assert [k for k, *_ in kinds] == ["main_headline", "secondary_headline", "hero_image", "continuation_box"]
    assert kinds[0][1] < 60 and kinds[0][3] > 380 and abs(kinds[0][2] - 40) <= 3
    pixels[450:, ::3] = 0
    assert [k for k, *_ in R.regions(pixels)].count("bottom_columns") == 4
    files = spark.createDataFrame([("a", bytearray(R.encode(pixels))), ("b", bytearray(b""))], "path string, content binary")
    assert {r["path"] for r in R.candidates(files).collect()} == {"a"}
