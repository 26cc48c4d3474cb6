"""Measures and transforms of page images in numpy: ink, glyph height, scaling and contrast. Images are PNG bytes or grey pixels;
nothing but the standard library decodes them."""

from __future__ import annotations

import struct as binary
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Window, weight and offset of the local background, the longest side that is measured, and the shapes of blobs that
#: are glyphs.
WINDOW, SIGMA, OFFSET, MEASURED = 31, 5.0, 10, 2600
GLYPHS = {"height": (2, 60), "width": (1, 60), "area": 4, "shape": (0.08, 6.0), "least": 50}
#: Contrast limit and tiles, and the sharpening's weight and radius.
CLIP, TILES, SHARPER, RADIUS = 2.0, 8, 0.8, 1.2
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


# -- PNG ----------------------------------------------------------------------------------------------------------


def png_size(raw: bytes) -> tuple[int, int]:
    """Width and height, from the header alone."""
    if raw[:8] != b"\x89PNG\r\n\x1a\n" or raw[12:16] != b"IHDR":
        raise ValueError("no PNG")
    return binary.unpack(">II", raw[16:24])


def _unfiltered(rows: np.ndarray, kinds: np.ndarray, step: int) -> np.ndarray:
    """Scan lines as they were before PNG's filters: each byte was sent less one guessed from its left, upper and upper left."""
    out = np.zeros((len(rows) + 1, rows.shape[1] + step), np.uint8)
    for y, (kind, line) in enumerate(zip(kinds.tolist(), rows, strict=True), 1):
        above, here = out[y - 1], out[y]
        if kind in (0, 2):
            here[step:] = line + above[step:] if kind else line
        elif kind == 1:
            here[step:] = np.cumsum(line.reshape(-1, step), axis=0, dtype=np.uint8).reshape(-1)
        else:
            up, now, sent = above.tolist(), [0] * len(here), line.tolist()
            for x in range(step, len(now)):
                a, b, c = now[x - step], up[x], up[x - step]
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    guess = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
                now[x] = sent[x - step] + guess & 255
            here[:] = now
    return out[1:, step:]


def grey(raw: bytes) -> np.ndarray:
    """Luminance of a PNG of 8 bits a channel without interlacing."""
    png_size(raw)
    at, data, palette, head = 8, [], None, None
    while at + 8 <= len(raw):
        size, kind = binary.unpack(">I4s", raw[at : at + 8])
        body = raw[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = binary.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            data.append(body)
        at += size + 12
    width, height, depth, colour, *_, interlaced = head
    if depth != 8 or interlaced or colour not in CHANNELS:
        raise ValueError("only PNGs of 8 bits a channel without interlacing are read")
    n = CHANNELS[colour]
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, 1 + width * n)
    pixels = _unfiltered(lines[:, 1:], lines[:, 0], n).reshape(height, width, n)
    pixels = palette[pixels[:, :, 0]] if colour == 3 else pixels
    if pixels.shape[2] < 3:
        return pixels[:, :, 0]
    # the usual weights, in 16 bits
    return ((pixels[:, :, :3].astype(np.uint32) @ np.array([19595, 38470, 7471], np.uint32) + 0x8000) >> 16).astype(np.uint8)


def png(pixels: np.ndarray) -> bytes:
    """Grey pixels as a PNG."""
    part = lambda kind, body: binary.pack(">I", len(body)) + kind + body + binary.pack(">I", zlib.crc32(kind + body))
    lines = np.concatenate([np.zeros((len(pixels), 1), np.uint8), pixels], axis=1).tobytes()
    head = binary.pack(">IIBBBBB", pixels.shape[1], pixels.shape[0], 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(lines)) + part(b"IEND", b"")


# -- measures -----------------------------------------------------------------------------------------------------


def _blurred(pixels: np.ndarray, taps: np.ndarray) -> np.ndarray:
    """A symmetric filter along both axes; the edge goes on beyond itself."""
    out, half = pixels.astype(np.float32), len(taps) // 2
    for axis in (0, 1):
        wide = np.pad(out, [(half, half) if a == axis else (0, 0) for a in (0, 1)], mode="edge")
        parts = (w * np.take(wide, np.arange(k, k + out.shape[axis]), axis) for k, w in enumerate(taps))
        out = sum(parts)
    return out


def bell(size: int, sigma: float) -> np.ndarray:
    x = np.exp(-((np.arange(size) - size // 2) ** 2) / (2 * sigma * sigma))
    return (x / x.sum()).astype(np.float32)


def shrunk(pixels: np.ndarray, width: int, height: int) -> np.ndarray:
    """Each pixel the mean of what it covers, parts of pixels by their share."""

    def along(x: np.ndarray, n: int) -> np.ndarray:  # the first axis
        upto = np.concatenate([np.zeros((1, x.shape[1])), np.cumsum(x, axis=0)])
        edges = np.linspace(0, len(x), n + 1)
        low = np.minimum(edges.astype(int), len(x) - 1)
        sums = upto[low] + (edges - low)[:, None] * x[low]
        return np.diff(sums, axis=0) * (n / len(x))

    return np.clip(np.rint(along(along(pixels.astype(float), height).T, width).T), 0, 255).astype(np.uint8)


def ink_mask(pixels: np.ndarray) -> tuple[np.ndarray, float]:
    """Pixels darker than their surroundings, and the scale at which they were measured."""
    scale = min(1.0, MEASURED / max(pixels.shape))
    if scale < 1:
        pixels = shrunk(pixels, int(pixels.shape[1] * scale), int(pixels.shape[0] * scale))
    return pixels <= np.rint(_blurred(pixels, bell(WINDOW, SIGMA))) - OFFSET, scale


def ink(pixels: np.ndarray) -> float:
    """The share of ink: paper's tint and shading are none."""
    return float(ink_mask(pixels)[0].mean())


def blobs(mask: np.ndarray) -> np.ndarray:
    """Height, width and area of each connected blob, diagonals included. Runs of a line are linked to those they touch in
    the next, and all links are followed at once."""
    edges = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    y, first = np.nonzero(edges == 1)
    last = np.nonzero(edges == -1)[1]
    wide = mask.shape[1] + 2
    start, end = y * wide + first, y * wide + last  # of the run, and after it
    # runs of the next line from the first that ends at the run's start or later to the last that starts at its end
    touched = np.searchsorted(end, start + wide, "left")
    n = np.maximum(np.searchsorted(start, end + wide, "right") - touched, 0)
    left = np.repeat(np.arange(len(y)), n)
    right = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(touched, n)
    same = y[right] == y[left] + 1
    left, right, root = left[same], right[same], np.arange(len(y))
    while (apart := root[left] != root[right]).any():
        x, z = root[left[apart]], root[right[apart]]
        np.minimum.at(root, np.maximum(x, z), np.minimum(x, z))
        while (up := root[root]).tobytes() != root.tobytes():
            root = up
    _, of = np.unique(root, return_inverse=True)
    size = of.max(initial=-1) + 1
    low, high = np.full((2, size), 1 << 30), np.full((2, size), -1)
    for k, (v, w) in enumerate(((y, y), (first, last - 1))):
        np.minimum.at(low[k], of, v)
        np.maximum.at(high[k], of, w)
    return np.stack([*(high - low + 1), np.bincount(of, last - first, size).astype(int)], axis=1)


def glyph_height(pixels: np.ndarray) -> float | None:
    """The median height of blobs shaped like glyphs, in the image's own pixels; None if there are too few."""
    mask, scale = ink_mask(pixels)
    h, w, area = blobs(mask).T
    within = lambda x, name: (x >= GLYPHS[name][0]) & (x <= GLYPHS[name][1])
    glyphs = h[within(h, "height") & within(w, "width") & (area >= GLYPHS["area"]) & within(w / np.maximum(h, 1), "shape")]
    return float(np.median(glyphs)) / max(scale, 1e-6) if len(glyphs) >= GLYPHS["least"] else None


def equalised(pixels: np.ndarray, clip: float = CLIP, tiles: int = TILES) -> np.ndarray:
    """Contrast evened out by tiles: each has its own clipped histogram's curve, and a pixel takes a mean of the four around it."""
    h, w = pixels.shape
    th, tw = -(-h // tiles), -(-w // tiles)
    wide = np.pad(pixels, ((0, th * tiles - h), (0, tw * tiles - w)), mode="reflect") if (h % tiles or w % tiles) else pixels
    parts = wide.reshape(tiles, th, tiles, tw).transpose(0, 2, 1, 3).reshape(tiles * tiles, -1)
    counts = np.stack([np.bincount(p, minlength=256) for p in parts])
    limit = max(int(clip * th * tw / 256), 1)
    over = np.maximum(counts - limit, 0).sum(1)
    counts = np.minimum(counts, limit) + (over // 256)[:, None]
    for row, rest in zip(counts, (over % 256).tolist(), strict=True):  # what is left, evenly spread
        if rest:
            row[np.arange(0, 256, max(256 // rest, 1))[:rest]] += 1
    curves = np.clip(np.rint(np.cumsum(counts, axis=1) * (255 / (th * tw))), 0, 255).reshape(tiles, tiles, 256)

    def around(n: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.arange(n) / size - 0.5
        low = np.floor(at).astype(int)
        return np.clip(low, 0, tiles - 1), np.clip(low + 1, 0, tiles - 1), at - low

    (y0, y1, fy), (x0, x1, fx) = around(h, th), around(w, tw)
    pick = lambda y, x: curves[y[:, None], x[None, :], pixels]
    top = pick(y0, x0) * (1 - fx) + pick(y0, x1) * fx
    low = pick(y1, x0) * (1 - fx) + pick(y1, x1) * fx
    return np.clip(np.rint(top * (1 - fy)[:, None] + low * fy[:, None]), 0, 255).astype(np.uint8)


def enhanced(pixels: np.ndarray) -> np.ndarray:
    """Local contrast, then sharper edges."""
    even = equalised(pixels)
    size = int(round(RADIUS * 6 + 1)) | 1
    return np.clip(np.rint(even * (1 + SHARPER) - _blurred(even, bell(size, RADIUS)) * SHARPER), 0, 255).astype(np.uint8)


MEASURES = T.StructType([T.StructField(n, t) for n, t in (("w", T.IntegerType()), ("h", T.IntegerType()), ("ink", T.DoubleType()), ("glyph", T.DoubleType()), ("error", T.StringType()))])


@F.pandas_udf(MEASURES)
def measured(raw: pd.Series) -> pd.DataFrame:
    """Size, ink and glyph height of PNGs; an image that can't be read is a row with its error."""
    rows = []
    for x in raw:
        try:
            page = grey(bytes(x))
            rows.append((page.shape[1], page.shape[0], ink(page), glyph_height(page), None))
        except Exception as e:  # a measure never fails a page
            rows.append((None, None, None, None, f"{type(e).__name__}: {e}"))
    return pd.DataFrame(rows, columns=MEASURES.names).astype({"w": "Int32", "h": "Int32", "glyph": "float64", "ink": "float64"})
