"""Image measures on images that the tests draw."""

import zlib

import numpy as np
import pytest
from folia.functions import pixels


def filtered(image, kinds):
    """A PNG whose lines go through the given filters, one after another."""
    import struct

    h, w, n = image.shape
    lines, flat = [], image.reshape(h, -1).astype(int)
    for y in range(h):
        kind, x = kinds[y % len(kinds)], flat[y]
        a = np.concatenate([np.zeros(n, int), x[:-n]])
        b = flat[y - 1] if y else np.zeros_like(x)
        c = np.concatenate([np.zeros(n, int), b[:-n]])
        p = a + b - c
        near = np.where((abs(p - a) <= abs(p - b)) & (abs(p - a) <= abs(p - c)), a, np.where(abs(p - b) <= abs(p - c), b, c))
        guess = [0 * x, a, b, (a + b) // 2, near][kind]
        lines.append(bytes([kind]) + ((x - guess) % 256).astype(np.uint8).tobytes())
    part = lambda k, body: struct.pack(">I", len(body)) + k + body + struct.pack(">I", zlib.crc32(k + body))
    head = struct.pack(">IIBBBBB", w, h, 8, {1: 0, 2: 4, 3: 2, 4: 6}[n], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(b"".join(lines))) + part(b"IEND", b"")


def test_png():
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 4):
        image = rng.integers(0, 256, (13, 9, n), np.uint8)
        want = image[:, :, 0] if n < 3 else np.array([[(int(r) * 19595 + int(g) * 38470 + int(b) * 7471 + 0x8000) >> 16 for r, g, b in line] for line in image[:, :, :3].tolist()])
        got = pixels.grey(filtered(image, [0, 1, 2, 3, 4]))
        assert (got == want).all()
    plain = rng.integers(0, 256, (5, 7), np.uint8)
    assert (pixels.grey(pixels.png(plain)) == plain).all() and pixels.png_size(pixels.png(plain)) == (7, 5)
    with pytest.raises(ValueError):
        pixels.grey(b"GIF89a")


def test_blobs():
    mask = np.zeros((12, 20), bool)
    mask[1:4, 1:3] = True  # 3 x 2
    mask[5, 5], mask[6, 6], mask[7, 5] = True, True, True  # touch at corners
    mask[9, 10:19] = mask[10, [10, 18]] = mask[11, 10:19] = True  # a ring of three lines
    assert sorted(map(tuple, pixels.blobs(mask).tolist())) == [(3, 2, 3), (3, 2, 6), (3, 9, 20)]
    rng = np.random.default_rng(1)
    for _ in range(20):
        mask = rng.random((15, 17)) < 0.4
        left = {tuple(p) for p in np.argwhere(mask)}
        want = []
        while left:
            todo = [left.pop()]
            blob = list(todo)
            while todo:
                y, x = todo.pop()
                for q in [(y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]:
                    if q in left:
                        left.remove(q)
                        todo.append(q)
                        blob.append(q)
            ys, xs = zip(*blob)
            want.append((max(ys) - min(ys) + 1, max(xs) - min(xs) + 1, len(blob)))
        assert sorted(map(tuple, pixels.blobs(mask).tolist())) == sorted(want)


def test_measures(spark):
    page = np.full((400, 600), 235, np.uint8)
    page[:, 300:] = 200  # a tint is no ink
    assert pixels.ink(page) < 0.03 and pixels.glyph_height(page) is None
    for y in range(20, 380, 30):
        for x in range(10, 590, 20):
            page[y : y + 12, x : x + 7] = 20
    assert pixels.glyph_height(page) == 12.0 and 0.05 < pixels.ink(page) < 0.2
    assert (pixels.shrunk(page, 300, 200) == np.rint(page.reshape(200, 2, 300, 2).mean((1, 3)))).mean() > 0.999
    flat = pixels.equalised(page)
    assert flat.shape == page.shape and flat[26, 13] < flat[5, 5]
    sharp = pixels.enhanced(page)
    assert sharp.dtype == np.uint8 and np.ptp(sharp.astype(int)) >= np.ptp(flat.astype(int))
    df = spark.createDataFrame([(1, bytearray(pixels.png(page))), (2, bytearray(b"no image"))], "k int, raw binary").select("k", pixels.measured("raw").alias("m"))
    got = {r.k: r.m for r in df.collect()}
    assert (got[1].w, got[1].h, got[1].glyph, got[1].error) == (600, 400, 12.0, None) and got[2].w is None and got[2].error.startswith("ValueError")
