"""Geometry, distance fields, packing and pictures, on shapes made here."""

import math
import struct
import zlib

import numpy as np
import pytest

from vellumspark.operators import atlas as A
from vellumspark.operators import geometry as G

SQUARE = [((0.0, 0.0), None, (10.0, 0.0)), ((10.0, 0.0), None, (10.0, 10.0)), ((10.0, 10.0), None, (0.0, 10.0)), ((0.0, 10.0), None, (0.0, 0.0))]


def circle(r=10.0, n=8):
    at = lambda k, s=1.0: (r * s * math.cos(k * 2 * math.pi / n), r * s * math.sin(k * 2 * math.pi / n))
    return [(at(k), at(k + 0.5, 1 / math.cos(math.pi / n)), at(k + 1)) for k in range(n)]


@pytest.mark.parametrize("shape", [SQUARE, circle()])
def test_field_reconstructs_coverage(shape):
    pixels, first = A.render([shape], 2.0, 2.0)
    want = A.coverage([shape], 2.0, first, pixels.shape[1], pixels.shape[0], 8)
    for dx, dy in ((0, 0), (0.25, 0), (0, -0.25)):
        want = A.coverage([shape], 2.0, (first[0] + dx, first[1] + dy), pixels.shape[1], pixels.shape[0], 8)
        got = A.reconstruct(pixels, 1.0, dx, dy)
        assert math.sqrt(np.mean((got - want) ** 2)) < 0.1 and np.abs(got - want).max() < 0.6


def test_distance_and_winding():
    rng = np.random.default_rng(0)
    x, y = rng.uniform(-5, 12, 300), rng.uniform(-5, 12, 300)
    for e in (((0, 0), (3, 8), (7, -2)), ((0, 0), None, (5, 5)), ((1, 1), (2, 2), (3, 3))):
        u, v = G.evaluate(e, np.linspace(0, 1, 20001))
        want = np.array([np.hypot(u - a, v - b).min() for a, b in zip(x, y)])
        assert np.abs(G.distance(e, x, y) - want).max() < 1e-3
    assert (A.inside([SQUARE], x, y) == ((x >= 0) & (x < 10) & (y >= 0) & (y < 10))).all()
    near = np.hypot(x, y)
    sure = np.abs(near - 10) > 0.3
    assert (A.inside([circle()], x, y) == (near < 10))[sure].all()


def test_cubic_as_quadratics():
    p = ((0, 0), (0, 10), (10, 10), (10, 0))
    parts = G.quadratics(*p, 0.01)
    t = np.linspace(0, 1, 2001)
    cx, cy = (sum(c * q[k] for c, q in zip(((1 - t) ** 3, 3 * (1 - t) ** 2 * t, 3 * (1 - t) * t * t, t**3), p)) for k in (0, 1))
    d = np.min([G.distance(e, cx, cy) for e in parts], axis=0)
    assert d.max() < 0.011


def test_colours_and_packing():
    assert A.colours(1) == [6] and A.colours(2) == [6, 5] and A.colours(4) == [6, 5, 6, 5] and A.colours(3) == [6, 5, 3]
    assert A.pack([(5, 5), (5, 3), (10, 4), (20, 1), (3, 3)], 10, 10) == [(0, 0, 0), (5, 0, 0), (0, 5, 0), (0, 0, 1), (0, 0, 2)]
    rng = np.random.default_rng(1)
    sizes = [tuple(map(int, rng.integers(1, 20, 2))) for _ in range(200)]
    taken = {}
    for (w, h), (x, y, p) in zip(sizes, A.pack(sizes, 64, 64)):
        page = taken.setdefault(p, np.zeros((64, 64), bool))
        assert not page[y : y + h, x : x + w].any() and x + w <= 64 and y + h <= 64
        page[y : y + h, x : x + w] = True


def png(w, h, bpp, rows):
    part = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    head = struct.pack(">IIBBBBB", w, h, 8, 2 if bpp == 3 else 6, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(rows)) + part(b"IEND", b"")


def test_png():
    raw = bytes(range(24))
    assert A.decode_png(png(4, 2, 3, b"\0" + raw[:12] + b"\0" + raw[12:]))["data"] == raw
    up = bytes((b - a) % 256 for a, b in zip(raw[:12], raw[12:]))
    assert A.decode_png(png(4, 2, 3, b"\0" + raw[:12] + b"\2" + up))["data"] == raw
    left = bytes((raw[i] - (raw[i - 3] if i >= 3 else 0)) % 256 for i in range(12))
    assert A.decode_png(png(4, 1, 3, b"\1" + left))["data"] == raw[:12]
    for bad in (b"\xff\xd8\xff", b"x", png(4, 2, 3, b"\0" + raw[:12])):
        with pytest.raises(A.ImageError):
            A.decode_png(bad)
