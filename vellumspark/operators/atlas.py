"""Glyphs as three-channel distance fields, packed on pages; their reference coverage; PNG pictures."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from .geometry import Edge, bounds, distance, winding

#: Fixed: the pairs of channels that edges take in turn.
PAIRS = (0b110, 0b101, 0b011)


def colours(n: int) -> list[int]:
    """A pair of channels for each edge of a contour: neighbours differ, and the last from the first where a pair is left."""
    out = []
    for i in range(n):
        taken = {out[-1]} if out else set()
        if i and i + 1 == n:
            taken.add(out[0])
        out.append(PAIRS[0] if i == 0 else next((p for p in PAIRS if p not in taken), PAIRS[0]))
    return out


def scaled(contours: list[list[Edge]], scale: float) -> list[list[Edge]]:
    move = lambda p: None if p is None else (p[0] * scale, p[1] * scale)
    return [[tuple(move(p) for p in e) for e in c] for c in contours]


def inside(contours: list[list[Edge]], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Non-zero winding."""
    total = np.zeros(np.shape(x), int)
    for c in contours:
        for e in c:
            total = total + winding(e, x, y)
    return total != 0


def box(contours: list[list[Edge]], scale: float, padding: float) -> tuple[float, float, int, int] | None:
    """First column and row, width and height in texels; rows run down."""
    b = bounds(contours)
    if b is None:
        return None
    x0, x1 = np.floor(b[0] * scale) - padding, np.ceil(b[2] * scale) + padding
    y0, y1 = np.floor(-b[3] * scale) - padding, np.ceil(-b[1] * scale) + padding
    return float(x0), float(y0), int(x1 - x0) + 1, int(y1 - y0) + 1


def render(contours: list[list[Edge]], scale: float, padding: float) -> tuple[np.ndarray, tuple[float, float]] | None:
    """((height, width, 4) bytes, first texel) of a glyph's distance field: 0.5 on the edge, more inside, a unit per texel.

    Interpolation errors where channels meet aren't corrected.
    """
    at = box(contours, scale, padding)
    if at is None:
        return None
    x0, y0, w, h = at
    px, py = np.meshgrid(x0 + np.arange(w) + 0.5, -(y0 + np.arange(h) + 0.5))
    shape = scaled(contours, scale)
    sign = np.where(inside(shape, px, py), 1.0, -1.0)
    margin = padding + 1e-9
    best = np.full((3, h, w), np.inf)
    for contour in shape:
        for e, pair in zip(contour, colours(len(contour))):
            lo_x, lo_y, hi_x, hi_y = bounds([[e]])
            near = (px >= lo_x - margin) & (px <= hi_x + margin) & (py >= lo_y - margin) & (py <= hi_y + margin)
            if not near.any():
                continue
            d = np.full((h, w), np.inf)
            d[near] = distance(e, px[near], py[near])
            for k in range(3):
                if pair >> k & 1:
                    best[k] = np.minimum(best[k], d)
    value = np.clip(0.5 + sign * np.where(np.isfinite(best), best, margin), 0, 1).astype(np.float32).astype(float)
    out = np.full((h, w, 4), 255, np.uint8)
    out[..., :3] = np.moveaxis(np.floor(value * 255 + 0.5), 0, -1)
    return out, (x0, y0)


def coverage(contours: list[list[Edge]], scale: float, first: tuple[float, float], width: int, height: int, samples: int) -> np.ndarray:
    """The share of samples by samples points of each texel that lie inside."""
    k = (np.arange(samples) + 0.5) / samples
    x = (first[0] + np.arange(width)[:, None] + k).ravel()
    y = (first[1] + np.arange(height)[:, None] + k).ravel()
    px, py = np.meshgrid(x, -y)
    hit = inside(scaled(contours, scale), px, py)
    return hit.reshape(height, samples, width, samples).mean((1, 3)).astype(np.float32)


def reconstruct(pixels: np.ndarray, width_texels: float = 1.0, dx: float = 0.0, dy: float = 0.0) -> np.ndarray:
    """Coverage from a distance field at offsets: the median of bilinear samples, through a smooth step."""
    h, w = pixels.shape[:2]

    def axis(n: int, d: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.arange(n) + d
        low = np.maximum(np.floor(at), 0).astype(int)
        return np.minimum(low, n - 1), np.minimum(low + 1, n - 1), np.clip(at - low, 0, 1)

    x0, x1, u = axis(w, dx)
    y0, y1, v = axis(h, dy)
    f = pixels[..., :3].astype(float)
    rows = f[y0] + (f[y1] - f[y0]) * v[:, None, None]
    value = rows[:, x0] + (rows[:, x1] - rows[:, x0]) * u[None, :, None]
    median = np.sort(value / 255, axis=2)[..., 1]
    t = np.clip((median - 0.5 + width_texels / 2) / width_texels, 0, 1)
    return (t * t * (3 - 2 * t)).astype(np.float32)


def pack(sizes: list[tuple[int, int]], width: int, height: int) -> list[tuple[int, int, int]]:
    """(x, y, page) of rectangles, in turn: the lowest place on the current page's skyline, leftmost of these, else a new page.

    A rectangle larger than a page gets a page number of its own and its corner, and the skyline of the page before stays.
    """
    sky = np.zeros(width, np.int64)
    page, out = 0, []
    for w, h in sizes:
        if w > width or h > height:
            page = min(page + 1, 65535)
            out.append((0, 0, page))
            continue
        starts = np.concatenate([[0], np.flatnonzero(np.diff(sky)) + 1])
        found = [(int(sky[x : x + w].max(initial=0)) if w else int(sky[x]), int(x)) for x in starts.tolist() if x + w <= width]
        found = [f for f in found if f[0] + h <= height]
        if found:
            y, x = min(found)
        else:
            page, y, x = min(page + 1, 65535), 0, 0
            sky = np.zeros(width, np.int64)
        sky[x : x + w] = y + h
        out.append((x, y, page))
    return out


def page_of(glyphs: list[np.ndarray], places: list[tuple[int, int, int]], width: int, height: int) -> list[np.ndarray]:
    """Pages with the glyphs' texels in their places."""
    pages = [np.zeros((height, width, 4), np.uint8) for _ in range(max((p for *_, p in places), default=-1) + 1)]
    for g, (x, y, p) in zip(glyphs, places):
        pages[p][y : y + g.shape[0], x : x + g.shape[1]] = g
    return pages


class ImageError(ValueError):
    pass


def decode_png(data: bytes, most: int = 16384) -> dict:
    """width, height, format ('rgb8', 'rgba8'), data of an 8-bit PNG with three or four channels, interlaced ones excepted."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ImageError("unsupported format" if data[:3] != b"\xff\xd8\xff" else "JPEG isn't supported")
    at, head, packed = 8, None, b""
    while at + 12 <= len(data):
        (n,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + n]
        if len(body) < n or zlib.crc32(kind + body) != struct.unpack_from(">I", data, at + 8 + n)[0]:
            raise ImageError("decode failed")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed += body
        elif kind == b"IEND":
            break
        at += 12 + n
    if head is None:
        raise ImageError("decode failed")
    w, h, depth, colour, _, _, interlace = head
    if not w or not h or max(w, h) > most:
        raise ImageError("too large")
    if depth != 8 or colour not in (2, 6) or interlace:
        raise ImageError("decode failed")
    bpp = 3 if colour == 2 else 4
    try:
        raw = zlib.decompress(packed)
    except zlib.error as e:
        raise ImageError("decode failed") from e
    if len(raw) != h * (1 + w * bpp):
        raise ImageError("decode failed")
    rows = np.frombuffer(raw, np.uint8).reshape(h, 1 + w * bpp)
    out = np.zeros((h, w * bpp), np.uint8)
    above = np.zeros(w * bpp, np.uint8)
    for j in range(h):
        out[j] = above = unfilter(int(rows[j, 0]), rows[j, 1:], above, bpp)
    return {"width": w, "height": h, "format": "rgb8" if bpp == 3 else "rgba8", "data": out.tobytes()}


def unfilter(kind: int, row: np.ndarray, above: np.ndarray, bpp: int) -> np.ndarray:
    if kind == 0:
        return row.copy()
    if kind == 2:
        return row + above
    if kind == 1:
        return np.cumsum(row.reshape(-1, bpp), axis=0, dtype=np.uint8).ravel()
    if kind not in (3, 4):
        raise ImageError("decode failed")
    out = bytearray(row.tobytes())
    up = above.tobytes()
    for i in range(len(out)):
        a, b, c = (out[i - bpp] if i >= bpp else 0), up[i], (up[i - bpp] if i >= bpp else 0)
        if kind == 3:
            guess = (a + b) // 2
        else:
            p = a + b - c
            guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
        out[i] = (out[i] + guess) & 255
    return np.frombuffer(bytes(out), np.uint8)
