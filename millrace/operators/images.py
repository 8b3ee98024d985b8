"""Image arrays: perceptual hash, palette counts, boxes and objects of masks, quality flags.

The kernels take numpy arrays; the columns are opaque bytes, so a decoder is passed in (an image library is optional).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Decoder = Callable[[bytes], np.ndarray]


def cosine_basis(n: int) -> np.ndarray:
    """Rows of the orthonormal DCT-II."""
    k, x = np.arange(n)[:, None], np.arange(n)[None, :]
    m = np.cos(np.pi * (2 * x + 1) * k / (2 * n)) * np.sqrt(2 / n)
    m[0] /= np.sqrt(2)
    return m


def perceptual_hash(grey: np.ndarray) -> int:
    """63 bits of a 32 by 32 grey image: which of the lowest 8 by 8 frequencies but the constant exceed their median."""
    c = cosine_basis(32)
    low = (c @ np.asarray(grey, float) @ c.T)[:8, :8].ravel()[1:]
    return int("".join("1" if b else "0" for b in low > np.median(low)), 2)


def palette_counts(rgba: np.ndarray) -> list[tuple[int, int]]:
    """(packed colour, pixels) of an h by w by 4 image, by colour."""
    packed = rgba.astype(np.uint32) @ np.array([1 << 24, 1 << 16, 1 << 8, 1], np.uint32)
    return [(int(a), int(n)) for a, n in zip(*np.unique(packed, return_counts=True))]


def mask_box(mask: np.ndarray) -> list[float] | None:
    """x, y, w, h around the pixels that are not zero."""
    y, x = np.nonzero(mask)
    return [float(x.min()), float(y.min()), float(x.max() - x.min() + 1), float(y.max() - y.min() + 1)] if len(x) else None


def quality_flags(width: int, height: int, brightness: float, edge_variance: float) -> list[str]:
    out = ["low_resolution"] if min(width, height) < 512 else []
    out += ["underexposed"] if brightness < 35 else ["overexposed"] if brightness > 220 else []
    return out + (["blur"] if edge_variance < 45 else [])


def decode_png(data: bytes) -> np.ndarray:
    """Height by width by 4 pixels of a PNG of 8 bits a channel (grey, grey and alpha, colour, palette, colour and alpha),
    not interlaced."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, packed, palette, alpha, head = 8, b"", None, None, None
    while at + 8 <= len(data):
        n, kind = int.from_bytes(data[at : at + 4]), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            alpha = np.frombuffer(body, np.uint8)
        elif kind == b"IDAT":
            packed += body
        at += 12 + n
    if head is None or head[2] != 8 or head[6] or head[3] not in (0, 2, 3, 4, 6):
        raise ValueError("unsupported PNG")
    width, height, _, kind = head[:4]
    step = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[kind]
    try:
        raw = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(height, 1 + width * step)
    except zlib.error as e:
        raise ValueError("broken PNG") from e
    out = np.zeros((height, width * step), np.uint8)
    up = np.zeros(width * step, np.int64)
    for y in range(height):
        f, line = raw[y, 0], raw[y, 1:].astype(np.int64)
        if f == 1:  # each byte adds the one before it in its channel
            line = np.cumsum(line.reshape(width, step), axis=0).ravel() & 255
        elif f == 2:
            line = line + up & 255
        elif f in (3, 4):
            for x in range(len(line)):
                a, b, c = (line[x - step] if x >= step else 0), up[x], (up[x - step] if x >= step else 0)
                if f == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                line[x] = line[x] + guess & 255
        out[y] = up = line
    px = out.reshape(height, width, step)
    full = np.full((height, width, 1), 255, np.uint8)
    if kind == 3:
        clear = np.concatenate([alpha if alpha is not None else np.empty(0, np.uint8), np.full(256, 255, np.uint8)])
        return np.concatenate([palette[px[..., 0]], clear[px]], axis=2)
    if kind in (0, 4):
        return np.concatenate([px[..., :1]] * 3 + [px[..., 1:2] if kind == 4 else full], axis=2)
    return px if kind == 6 else np.concatenate([px, full], axis=2)


def grey(rgba: np.ndarray) -> np.ndarray:
    """Luma of pixels, 0 to 255."""
    return np.floor(rgba[..., :3].astype(float) @ [0.299, 0.587, 0.114] + 0.5)


def _lanczos(n: int, m: int, reach: int = 3) -> np.ndarray:
    """Weights (m by n) that resample n values to m; a filter as wide as the scale where values get fewer."""
    scale = max(n / m, 1.0)
    middle = (np.arange(m) + 0.5) * n / m
    x = (np.arange(n)[None, :] + 0.5 - middle[:, None]) / scale
    w = np.where(np.abs(x) < reach, np.sinc(x) * np.sinc(x / reach), 0.0)
    return w / w.sum(axis=1, keepdims=True)


def resized(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """A grey image resampled by Lanczos windows, 0 to 255."""
    return np.clip(np.floor(_lanczos(image.shape[0], height) @ image @ _lanczos(image.shape[1], width).T + 0.5), 0, 255)


def image_hash(rgba: np.ndarray) -> int:
    """perceptual_hash of an image of any size."""
    return perceptual_hash(resized(grey(rgba), 32, 32))


def thumbnail(rgba: np.ndarray, side: int = 128) -> list[float]:
    """A grey square of an image, row by row, 0 to 1."""
    return (resized(grey(rgba), side, side) / 255).ravel().tolist()


def colour_masks(rgba: np.ndarray, background: int = 0x000000FF) -> list[tuple[int, int, list[float]]]:
    """(packed colour, pixels, x y w h around them) of each colour but the background, by colour."""
    packed = rgba.astype(np.uint32) @ np.array([1 << 24, 1 << 16, 1 << 8, 1], np.uint32)
    return [(int(c), int((packed == c).sum()), mask_box(packed == c)) for c in np.unique(packed) if c != background]


def edge_variance(luma: np.ndarray) -> float:
    """Variance of the differences of pixels from their eight neighbours, cut to 0..255; pixels at the border stay as they are."""
    out = luma.astype(float).copy()
    around = sum(luma[1 + dy : luma.shape[0] - 1 + dy, 1 + dx : luma.shape[1] - 1 + dx] for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx)
    out[1:-1, 1:-1] = np.clip(8 * luma[1:-1, 1:-1] - around, 0, 255)
    return float(out.var())


def quality_of(rgba: np.ndarray) -> list[str]:
    """quality_flags of an image."""
    luma = grey(rgba)
    return quality_flags(luma.shape[1], luma.shape[0], float(luma.mean()), edge_variance(luma))


_AROUND = ((1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1))  # clockwise, y down


def outlines(mask: np.ndarray, least_area: float = 2.0) -> list[list[list[int]]]:
    """Outer outlines of a mask's objects (joined by sides or corners) as polygons of pixel centres, corners only, by their
    topmost pixel; those of a smaller area or under three corners are left out."""
    live = np.pad(np.asarray(mask, bool), 1)
    seen = np.zeros_like(live)
    out = []
    for y, x in zip(*np.nonzero(live)):
        if seen[y, x]:
            continue
        todo = [(y, x)]
        seen[y, x] = True
        while todo:
            a, b = todo.pop()
            for dx, dy in _AROUND:
                if live[a + dy, b + dx] and not seen[a + dy, b + dx]:
                    seen[a + dy, b + dx] = True
                    todo.append((a + dy, b + dx))
        ring, at, came, first = [(int(x), int(y))], (int(x), int(y)), 4, None
        while True:  # walk round, looking from the side it came from
            for k in range(1, 9):
                d = (came + k) % 8
                nx, ny = at[0] + _AROUND[d][0], at[1] + _AROUND[d][1]
                if live[ny, nx]:
                    break
            else:
                break
            if (at, d) == first:
                break
            first = first or (at, d)
            at, came = (nx, ny), (d + 4) % 8
            ring.append(at)
        ring = ring[:-1] if len(ring) > 1 else ring
        n = len(ring)
        turn = lambda i: (ring[i][0] - ring[i - 1][0]) * (ring[(i + 1) % n][1] - ring[i][1]) != (ring[i][1] - ring[i - 1][1]) * (ring[(i + 1) % n][0] - ring[i][0])  # noqa: B023, E731
        corners = [[px - 1, py - 1] for i, (px, py) in enumerate(ring) if turn(i)]
        area = abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(corners, corners[1:] + corners[:1]))) / 2
        if len(corners) >= 3 and area >= least_area:
            out.append(corners)
    return out


def rasterise(points: np.ndarray, height: int, width: int) -> np.ndarray:
    """A polygon's pixels by the even-odd rule at pixel centres."""
    yy, xx = np.mgrid[0:height, 0:width] + 0.5
    inside = np.zeros((height, width), bool)
    x, y = points[:, 0], points[:, 1]
    for i in range(len(points)):
        j = i - 1
        with np.errstate(divide="ignore", invalid="ignore"):
            cross = (x[j] - x[i]) * (yy - y[i]) / (y[j] - y[i]) + x[i]
        inside ^= ((y[i] > yy) != (y[j] > yy)) & (xx < cross)
    return inside


def map_images(rows: DataFrame, content: str, decode: Decoder, kernel: Callable[[np.ndarray], object], out: str, kind: str) -> DataFrame:
    """rows with column out: kernel of each decoded image, null for bytes that do not decode."""

    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            got = []
            for b in s:
                try:
                    got.append(None if b is None else kernel(decode(bytes(b))))
                except (ValueError, OSError):
                    got.append(None)
            yield pd.Series(got, dtype=object)

    return rows.withColumn(out, run(F.col(content)))
