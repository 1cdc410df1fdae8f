"""Functions of whole pictures and maps: signatures, outlines as cells, regions of a map."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

WHITE, LEAST_PIXELS = 235, 50


def shrink(gray: np.ndarray, h: int, w: int) -> np.ndarray:
    """Means of the h x w equal fields of a picture, parted pixels by their share."""

    def weights(n: int, parts: int) -> np.ndarray:
        edge = np.linspace(0, n, parts + 1)
        at = np.arange(n)
        return np.clip(np.minimum(at + 1, edge[1:, None]) - np.maximum(at, edge[:-1, None]), 0, 1) * (parts / n)

    return weights(gray.shape[0], h) @ gray @ weights(gray.shape[1], w).T


def signature(gray: np.ndarray) -> tuple[int, int]:
    """64 bits of brightness steps to the right and 64 of brightness above the mean, of the part of a grey picture that isn't white."""
    gray = np.asarray(gray, np.float64)
    dark = gray < WHITE
    if dark.sum() > LEAST_PIXELS:
        r, c = np.flatnonzero(dark.any(axis=1)), np.flatnonzero(dark.any(axis=0))
        gray = gray[r[0] : r[-1] + 1, c[0] : c[-1] + 1]
    steps, means = shrink(gray, 8, 9), shrink(gray, 8, 8)
    bits = lambda b: int.from_bytes(np.packbits(b.ravel()).tobytes(), "big", signed=True)
    return bits(steps[:, 1:] > steps[:, :-1]), bits(means > means.mean())


def image_signatures(pictures: DataFrame) -> DataFrame:
    """uid, sig_d, sig_a of grey pictures (uid, height, width, pixels: binary of height * width bytes); null where the bytes don't fit."""

    def sign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for uid, h, w, p in zip(f["uid"], f["height"], f["width"], f["pixels"], strict=True):
                ok = p is not None and h and w and len(p) == h * w
                out.append((uid, *(signature(np.frombuffer(p, np.uint8).reshape(int(h), int(w))) if ok else (None, None))))
            d = pd.DataFrame(out, columns=["uid", "sig_d", "sig_a"])
            yield d.astype({"sig_d": "Int64", "sig_a": "Int64"})

    return pictures.select("uid", "height", "width", "pixels").mapInPandas(sign, "uid string, sig_d long, sig_a long")


def rasterise(rings: list[np.ndarray], h: int, w: int) -> np.ndarray:
    """Cells of an h x w grid whose centre lies in an odd number of rings' insides, for each ring on its own, joined."""
    out = np.zeros((h, w), bool)
    y, x = np.mgrid[0:h, 0:w] + 0.5
    for ring in rings:
        p = np.asarray(ring, np.float64)
        if len(p) < 3:
            continue
        q = np.roll(p, -1, axis=0)
        inside = np.zeros((h, w), bool)
        for (x1, y1), (x2, y2) in zip(p, q, strict=True):
            if y1 != y2:
                crosses = (y1 > y) != (y2 > y)
                inside ^= crosses & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
        out |= inside
    return out


def regions(values: np.ndarray, thr: float, least: int) -> list[tuple[float, int, int, int, int]]:
    """(peak, x1, y1, x2, y2) of the 8-connected regions at or above thr with enough cells; labels spread until they rest."""
    on = values >= thr
    label = np.where(on, np.arange(1, on.size + 1).reshape(on.shape), 0)
    while True:
        pad = np.pad(label, 1)
        best = label
        for dy in (0, 1, 2):
            for dx in (0, 1, 2):
                best = np.maximum(best, pad[dy : dy + on.shape[0], dx : dx + on.shape[1]])
        best = np.where(on, best, 0)
        if (best == label).all():
            break
        label = best
    out = []
    for i in np.unique(label[on]):
        r, c = np.nonzero(label == i)
        if len(r) >= least:
            out.append((float(values[r, c].max()), int(c.min()), int(r.min()), int(c.max()) + 1, int(r.max()) + 1))
    return sorted(out, key=lambda p: (-p[0], p[1:]))


PROPOSAL = T.StructType([T.StructField("uid", T.LongType()), T.StructField("k", T.LongType()), T.StructField("peak", T.DoubleType()), *[T.StructField(c, T.DoubleType()) for c in ("x1", "y1", "x2", "y2")]])


def proposals(maps: DataFrame, h: int, w: int, thr: float, top: int, least: int = 2, cell: float = 1.0, fallback: float = 0.05, z0: float = 3.0) -> DataFrame:
    """uid, k (from 0), peak, box: the top regions of maps (uid, values: h * w numbers by row; null or absent: none).

    With a column z (h * w anomaly scores, null: none) a cell's value is the larger of its own and
    the logistic of z - z0. Where no region of `least` cells reaches thr but the map's peak reaches
    `fallback`, regions of any size from half the peak on (`fallback` at least) are proposed.
    """
    both = "z" in maps.columns

    def find(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for uid, v, z in zip(f["uid"], f["values"], f["z"] if both else [None] * len(f), strict=True):
                layers = [] if v is None else [np.asarray(v, np.float64)]
                if z is not None:
                    layers.append(1 / (1 + np.exp(z0 - np.asarray(z, np.float64))))
                if not layers:
                    continue
                m = np.max(layers, axis=0).reshape(h, w)
                found = regions(m, thr, least) or regions(m, max(fallback, 0.5 * float(m.max())), 1)
                out += [(uid, k, p, *(cell * x for x in b)) for k, (p, *b) in enumerate(found[:top])]
            yield pd.DataFrame(out, columns=PROPOSAL.names)

    return maps.select("uid", "values", *(["z"] if both else [])).mapInPandas(find, PROPOSAL)


def edges(light: np.ndarray) -> np.ndarray:
    """Strength of the 3 x 3 Sobel gradient, the picture mirrored at its edges."""
    p = np.pad(light, 1, mode="reflect" if min(light.shape) > 1 else "edge")
    smooth = lambda m, axis: np.take(m, range(0, m.shape[axis] - 2), axis) + 2 * np.take(m, range(1, m.shape[axis] - 1), axis) + np.take(m, range(2, m.shape[axis]), axis)
    step = lambda m, axis: np.take(m, range(2, m.shape[axis]), axis) - np.take(m, range(0, m.shape[axis] - 2), axis)
    return np.hypot(step(smooth(p, 0), 1), step(smooth(p, 1), 0))


def _blurred(m: np.ndarray, sigma: float) -> np.ndarray:
    radius = max(1, round(4 * sigma))
    w = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    w /= w.sum()
    for axis in (0, 1):
        pad = np.pad(m, [(radius, radius) if i == axis else (0, 0) for i in (0, 1)], mode="symmetric")
        m = sum(k * np.take(pad, range(i, i + m.shape[axis]), axis=axis) for i, k in enumerate(w))
    return m


# Shares of red, green and blue in brightness.
LIGHT = np.array([0.299, 0.587, 0.114])


def clutter_map(rgb: np.ndarray, size: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Density plus half the relative edge strength of a picture (h, w, 3 bytes) on a size x size grid, smoothed, and where the bag is."""
    small = np.stack([shrink(rgb[..., i].astype(np.float64) / 255, size, size) for i in range(3)], axis=2)
    top = small.max(axis=2)
    e = _blurred(edges(small @ LIGHT), 1.5)
    return _blurred(1 - top, 1.5) + 0.5 * e / (e.max() + 1e-6), _blurred((top < 0.92).astype(float), 1.0) > 0.3


def ring_clutter(rgb: np.ndarray, box: tuple[float, float, float, float], ring: float = 0.5) -> tuple[float | None, float | None]:
    """(clutter of the ring around a box, density of the box); the ring is as wide as `ring` of the box's sides.

    A ring of fewer than 10 pixels is replaced by the whole region; None where the region or the box is empty.
    """
    h, w = rgb.shape[:2]
    x1, y1, x2, y2 = box
    dx, dy = ring * (x2 - x1), ring * (y2 - y1)
    left, upper = int(max(0, x1 - dx)), int(max(0, y1 - dy))
    right, lower = int(min(w, np.ceil(x2 + dx))), int(min(h, np.ceil(y2 + dy)))
    if right <= left or lower <= upper:
        return None, None
    part = rgb[upper:lower, left:right].astype(np.float64) / 255
    ys, xs = np.mgrid[upper:lower, left:right]
    inner = (xs >= int(x1)) & (xs < np.ceil(x2)) & (ys >= int(y1)) & (ys < np.ceil(y2))
    outer = ~inner if (~inner).sum() >= 10 else np.ones_like(inner)
    density = 1 - part.max(axis=2)
    return float(density[outer].mean() + 0.5 * edges(part @ LIGHT)[outer].mean()), float(density[inner].mean()) if inner.any() else None


def decode_png(data: bytes) -> np.ndarray | None:
    """(h, w, channels) bytes of an 8-bit PNG that isn't interlaced; palettes are looked up. None for anything else or broken data."""
    import struct
    import zlib

    try:
        if data[:8] != b"\x89PNG\r\n\x1a\n":
            return None
        at, body, palette, head = 8, b"", None, None
        while at < len(data):
            n, kind = struct.unpack(">I4s", data[at : at + 8])
            chunk = data[at + 8 : at + 8 + n]
            if kind == b"IHDR":
                head = struct.unpack(">IIBBBBB", chunk)
            elif kind == b"PLTE":
                palette = np.frombuffer(chunk, np.uint8).reshape(-1, 3)
            elif kind == b"IDAT":
                body += chunk
            elif kind == b"IEND":
                break
            at += 12 + n
        w, h, depth, colour, _, _, interlaced = head
        channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
        if depth != 8 or interlaced:
            return None
        lines = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, 1 + w * channels)
        out = np.zeros((h, w * channels), np.uint8)
        up = np.zeros(w * channels, np.uint8)
        for i, line in enumerate(lines):
            out[i] = up = _unfiltered(int(line[0]), line[1:], up, channels)
        picture = out.reshape(h, w, channels)
        return palette[picture[..., 0]] if colour == 3 else picture
    except (struct.error, zlib.error, KeyError, ValueError, TypeError, IndexError):
        return None


def _unfiltered(kind: int, line: np.ndarray, up: np.ndarray, channels: int) -> np.ndarray:
    """A line of a PNG from its differences: none, to the left, to the line above, to their mean, or to the nearest of three."""
    if kind == 0:
        return line
    if kind == 2:
        return line + up
    if kind == 1:
        return np.cumsum(line.reshape(-1, channels), axis=0, dtype=np.uint8).ravel()
    out = [0] * len(line)
    for i, v in enumerate(line.tolist()):
        a, b, c = (out[i - channels], int(up[i]), int(up[i - channels])) if i >= channels else (0, int(up[i]), 0)
        if kind == 3:
            guess = (a + b) // 2
        elif kind == 4:
            p = a + b - c
            guess = min((a, b, c), key=lambda x: abs(p - x))
        else:
            raise ValueError(f"line of kind {kind}")
        out[i] = (v + guess) & 255
    return np.array(out, np.uint8)


def mask_of(text: str | None) -> np.ndarray | None:
    """0 and 1 by pixel of a mask given as a PNG in base64: set where any channel is."""
    import base64
    import binascii

    try:
        picture = decode_png(base64.b64decode(text or "", validate=False))
    except (binascii.Error, ValueError):
        return None
    return None if picture is None else (picture.max(axis=2) > 0).astype(np.uint8)
