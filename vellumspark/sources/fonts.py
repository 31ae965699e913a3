"""TrueType fonts: metrics, characters, outlines, kerning; and a registry of faces with nearest weights."""

from __future__ import annotations

import struct
from collections.abc import Iterable

from vellumspark.operators.geometry import Edge


from pyspark.sql import SparkSession
from pyspark.sql import functions as F


class FontError(ValueError):
    pass


def _u16(d: bytes, at: int) -> int:
    return struct.unpack_from(">H", d, at)[0]


def _i16(d: bytes, at: int) -> int:
    return struct.unpack_from(">h", d, at)[0]


def _u32(d: bytes, at: int) -> int:
    return struct.unpack_from(">I", d, at)[0]


class Font:
    """A font file's tables, read when they are asked for."""

    def __init__(self, data: bytes):
        try:
            if data[:4] not in (b"\0\1\0\0", b"true"):
                raise FontError("no TrueType outlines")
            self.tables = {}
            for i in range(_u16(data, 4)):
                tag, _, at, n = struct.unpack_from(">4sIII", data, 12 + 16 * i)
                self.tables[tag.decode("latin-1")] = data[at : at + n]
            head, hhea = self.tables["head"], self.tables["hhea"]
            self.units = _u16(head, 18)
            self.long_offsets = _i16(head, 50) == 1
            self.n_glyphs = _u16(self.tables["maxp"], 4)
            self.n_metrics = _u16(hhea, 34)
            self.cmap = self._cmap()
        except (struct.error, KeyError, IndexError) as e:
            raise FontError("not a font") from e
        if not self.units:
            raise FontError("no units per em")

    # metrics

    def metrics(self) -> dict[str, float]:
        """In em: the typographic ones of OS/2 if they are there, else those of hhea; descent counts down."""
        hhea, os2 = self.tables["hhea"], self.tables.get("OS/2", b"")
        if len(os2) >= 74 and (_i16(os2, 68) or _i16(os2, 70)):
            up, down, gap = _i16(os2, 68), _i16(os2, 70), _i16(os2, 72)
        else:
            up, down, gap = _i16(hhea, 4), _i16(hhea, 6), _i16(hhea, 8)
        x, cap = (_i16(os2, 86), _i16(os2, 88)) if len(os2) >= 90 else (0, 0)
        em = lambda v: max(0, v) / self.units
        return {"ascent": em(up), "descent": em(-down), "line_gap": em(gap), "cap_height": em(cap), "x_height": em(x), "units_per_em": float(self.units)}

    def family(self) -> str | None:
        name = self.tables.get("name", b"")
        if len(name) < 6:
            return None
        base = _u16(name, 4)
        found = {}
        for i in range(_u16(name, 2)):
            platform, _, _, kind, n, at = struct.unpack_from(">6H", name, 6 + 12 * i)
            raw = name[base + at : base + at + n]
            if platform in (0, 3):
                found.setdefault(kind, raw.decode("utf-16-be", "replace"))
        return found.get(16) or found.get(1)

    def advance(self, glyph: int) -> int:
        return _u16(self.tables["hmtx"], 4 * min(glyph, self.n_metrics - 1))

    def bearing(self, glyph: int) -> int:
        hmtx = self.tables["hmtx"]
        return _i16(hmtx, 4 * glyph + 2) if glyph < self.n_metrics else _i16(hmtx, 4 * self.n_metrics + 2 * (glyph - self.n_metrics))

    # characters

    def _cmap(self) -> dict[int, int]:
        t = self.tables["cmap"]
        best: dict[int, int] = {}
        places = sorted((struct.unpack_from(">HHI", t, 4 + 8 * i) for i in range(_u16(t, 2))), key=lambda p: (p[0] == 3) + 2 * (p[:2] in ((3, 10), (0, 4))))
        for platform, encoding, at in places:
            if platform not in (0, 3) or (platform == 3 and encoding not in (1, 10)):
                continue
            kind = _u16(t, at)
            if kind == 4:
                n = _u16(t, at + 6)
                for i in range(0, n, 2):
                    end, start = _u16(t, at + 14 + i), _u16(t, at + 16 + n + i)
                    delta, place = _u16(t, at + 16 + 2 * n + i), at + 16 + 3 * n + i
                    shift = _u16(t, place)
                    for c in range(start, min(end, 0xFFFE) + 1):
                        g = (_u16(t, place + shift + 2 * (c - start)) or -delta) if shift else c
                        best[c] = (g + delta) & 0xFFFF
            elif kind == 12:
                for i in range(_u32(t, at + 12)):
                    first, last, g = struct.unpack_from(">III", t, at + 16 + 12 * i)
                    best.update((c, g + c - first) for c in range(first, min(last, 0x10FFFF) + 1))
        return {c: g for c, g in best.items() if 0 < g < self.n_glyphs}

    # outlines

    def _glyph(self, glyph: int) -> bytes:
        loca = self.tables["loca"]
        a, b = (_u32(loca, 4 * glyph), _u32(loca, 4 * glyph + 4)) if self.long_offsets else (2 * _u16(loca, 2 * glyph), 2 * _u16(loca, 2 * glyph + 2))
        return self.tables["glyf"][a:b]

    def outline(self, glyph: int, depth: int = 0) -> list[list[Edge]]:
        """Contours in font units; none for a blank."""
        d = self._glyph(glyph)
        if len(d) < 10 or depth > 8:
            return []
        n = _i16(d, 0)
        return self._simple(d, n) if n >= 0 else self._composite(d, depth)

    def _simple(self, d: bytes, n: int) -> list[list[Edge]]:
        ends = [_u16(d, 10 + 2 * i) for i in range(n)]
        count = ends[-1] + 1 if ends else 0
        at = 10 + 2 * n
        at += 2 + _u16(d, at)
        flags: list[int] = []
        while len(flags) < count:
            f = d[at]
            at += 1
            repeat = 1
            if f & 8:
                repeat += d[at]
                at += 1
            flags += [f] * repeat
        axes = []
        for short, same in ((2, 16), (4, 32)):
            v, out = 0, []
            for f in flags[:count]:
                if f & short:
                    v += d[at] if f & same else -d[at]
                    at += 1
                elif not f & same:
                    v += _i16(d, at)
                    at += 2
                out.append(v)
            axes.append(out)
        contours, first = [], 0
        for e in ends:
            points = [(float(axes[0][i]), float(axes[1][i]), bool(flags[i] & 1)) for i in range(first, e + 1)]
            first = e + 1
            if len(points) > 1:
                contours.append(contour(points))
        return contours

    def _composite(self, d: bytes, depth: int) -> list[list[Edge]]:
        out: list[list[Edge]] = []
        at = 10
        while True:
            flags, glyph = _u16(d, at), _u16(d, at + 2)
            at += 4
            dx, dy = struct.unpack_from(">hh" if flags & 1 else ">bb", d, at)
            at += 4 if flags & 1 else 2
            a, b, c, e = 1.0, 0.0, 0.0, 1.0
            part = lambda k: _i16(d, at + 2 * k) / 16384
            if flags & 8:
                a = e = part(0)
                at += 2
            elif flags & 64:
                a, e = part(0), part(1)
                at += 4
            elif flags & 128:
                a, b, c, e = (part(k) for k in range(4))
                at += 8
            if not flags & 2:
                dx = dy = 0
            move = lambda p: None if p is None else (a * p[0] + c * p[1] + dx, b * p[0] + e * p[1] + dy)
            out += [[tuple(move(p) for p in edge) for edge in k] for k in self.outline(glyph, depth + 1)]
            if not flags & 32:
                return out

    # kerning

    def kerning(self, codepoints: Iterable[int]) -> dict[tuple[int, int], int]:
        """Units that pairs of characters move together or apart, from GPOS and the older kern table; none that are zero."""
        of = {self.cmap[c]: c for c in sorted(codepoints) if c in self.cmap}
        pairs: dict[tuple[int, int], int] = {}
        for table, read in (("GPOS", gpos_pairs), ("kern", kern_pairs)):
            if table in self.tables:
                try:
                    for (a, b), v in read(self.tables[table], sorted(of)).items():
                        key = of[a], of[b]
                        pairs[key] = pairs.get(key, 0) + v
                except (struct.error, IndexError):
                    continue
        return {k: v for k, v in sorted(pairs.items()) if v}


def contour(points: list[tuple[float, float, bool]]) -> list[Edge]:
    """A closed contour of on- and off-curve points; between two off-curve points lies one on the curve."""
    full: list[tuple[float, float, bool]] = []
    for p, q in zip(points, [*points[1:], points[0]]):
        full.append(p)
        if not p[2] and not q[2]:
            full.append(((p[0] + q[0]) / 2, (p[1] + q[1]) / 2, True))
    k = next(i for i, p in enumerate(full) if p[2])
    full = [*full[k:], *full[: k + 1]]
    out: list[Edge] = []
    i = 0
    while i + 1 < len(full):
        a, b = full[i], full[i + 1]
        if b[2]:
            if a[:2] != b[:2]:
                out.append((a[:2], None, b[:2]))
            i += 1
        else:
            out.append((a[:2], b[:2], full[i + 2][:2]))
            i += 2
    return out


def kern_pairs(d: bytes, used: list[int]) -> dict[tuple[int, int], int]:
    keep, out = set(used), {}
    at = 4
    for _ in range(_u16(d, 2)):
        n, cover = _u16(d, at + 2), _u16(d, at + 4)
        if cover >> 8 == 0 and cover & 1:
            for i in range(_u16(d, at + 6)):
                a, b, v = struct.unpack_from(">HHh", d, at + 14 + 6 * i)
                if a in keep and b in keep:
                    out[a, b] = out.get((a, b), 0) + v
        at += max(n, 6)
    return out


def coverage(d: bytes, at: int) -> list[int]:
    n = _u16(d, at + 2)
    if _u16(d, at) == 1:
        return [_u16(d, at + 4 + 2 * i) for i in range(n)]
    return [g for i in range(n) for g in range(_u16(d, at + 4 + 6 * i), _u16(d, at + 6 + 6 * i) + 1)]


def classes(d: bytes, at: int) -> dict[int, int]:
    if _u16(d, at) == 1:
        first = _u16(d, at + 2)
        return {first + i: _u16(d, at + 6 + 2 * i) for i in range(_u16(d, at + 4))}
    return {g: _u16(d, at + 8 + 6 * i) for i in range(_u16(d, at + 2)) for g in range(_u16(d, at + 4 + 6 * i), _u16(d, at + 6 + 6 * i) + 1)}


def gpos_pairs(d: bytes, used: list[int]) -> dict[tuple[int, int], int]:
    """Pair adjustments of all lookups, added up: both values' horizontal advances."""
    out: dict[tuple[int, int], int] = {}
    lookups = _u16(d, 8)
    for i in range(_u16(d, lookups)):
        at = lookups + _u16(d, lookups + 2 + 2 * i)
        kind = _u16(d, at)
        for j in range(_u16(d, at + 4)):
            sub = at + _u16(d, at + 6 + 2 * j)
            k = kind
            if k == 9:
                k, sub = _u16(d, sub + 2), sub + _u32(d, sub + 4)
            if k == 2:
                for key, v in pair_subtable(d, sub, used).items():
                    out[key] = out.get(key, 0) + v
    return out


def pair_subtable(d: bytes, at: int, used: list[int]) -> dict[tuple[int, int], int]:
    first = {g: i for i, g in enumerate(coverage(d, at + _u16(d, at + 2)))}
    formats = _u16(d, at + 4), _u16(d, at + 6)
    sizes = [2 * f.bit_count() for f in formats]

    def value(place: int) -> int:
        total = 0
        for f, size in zip(formats, sizes):
            if f & 4:
                total += _i16(d, place + 2 * (f & 3).bit_count())
            place += size
        return total

    out: dict[tuple[int, int], int] = {}
    if _u16(d, at) == 1:
        keep = set(used)
        for a in used:
            if a in first:
                s = at + _u16(d, at + 10 + 2 * first[a])
                step = 2 + sum(sizes)
                for i in range(_u16(d, s)):
                    b = _u16(d, s + 2 + step * i)
                    if b in keep:
                        out[a, b] = value(s + 4 + step * i)
        return out
    left, right = classes(d, at + _u16(d, at + 8)), classes(d, at + _u16(d, at + 10))
    n1, n2 = _u16(d, at + 12), _u16(d, at + 14)
    for a in used:
        if a in first:
            for b in used:
                p, q = left.get(a, 0), right.get(b, 0)
                if p < n1 and q < n2:
                    out[a, b] = value(at + 16 + (p * n2 + q) * sum(sizes))
    return out


# Family names that mean the default family, and the range of weights.
DEFAULT_FAMILY = "Noto Sans"
GENERIC = ("sans-serif", "serif")
LIGHTEST, HEAVIEST = 100, 900
#: Bytes of all faces of a registry at most: each Python worker holds them.
MOST_BYTES = 256_000_000


def clamped(weight: int) -> int:
    return min(max(weight, LIGHTEST), HEAVIEST)


class Registry:
    """Faces by family, weight and slant. The first of equal ones stays. Supplementary faces serve what a face lacks, in order."""

    def __init__(self):
        self.faces: dict[tuple[str, int, bool], bytes] = {}
        self.supplement: list[bytes] = []

    def add(self, family: str, weight: int, italic: bool, data: bytes) -> None:
        self.faces.setdefault((family.lower(), clamped(weight), italic), data)
        if sum(map(len, [*self.faces.values(), *self.supplement])) > MOST_BYTES:
            raise FontError(f"faces of more than {MOST_BYTES} bytes")

    def add_file(self, data: bytes) -> None:
        """A font file under the family, weight and slant that it names."""
        font = Font(data)
        os2, head = font.tables.get("OS/2", b""), font.tables["head"]
        weight = _u16(os2, 4) if len(os2) >= 6 else 700 if _u16(head, 44) & 1 else 400
        slant = _u16(os2, 62) & 1 if len(os2) >= 64 else _u16(head, 44) >> 1 & 1
        self.add(font.family() or DEFAULT_FAMILY, weight, bool(slant), data)

    def resolve(self, family: str, weight: int, italic: bool) -> bytes:
        """The face, or the one of the nearest weight with the same slant, the heavier of two as near."""
        name, weight = (DEFAULT_FAMILY if family.lower() in GENERIC else family).lower(), clamped(weight)
        found = [(abs(w - weight), -w) for f, w, i in self.faces if f == name and i == italic]
        if not found:
            raise FontError(f"no face {family} {'italic' if italic else 'upright'}")
        return self.faces[name, -min(found)[1], italic]

    def families(self) -> list[str]:
        return sorted({f for f, _, _ in self.faces})


def read_folder(spark: SparkSession, folder: str) -> Registry:
    """The .ttf files of a folder, in order of path; those below its folder `supplement` are supplementary."""
    out = Registry()
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.ttf").option("recursiveFileLookup", "true").load(folder)
    if (files.agg(F.sum("length")).head()[0] or 0) > MOST_BYTES:
        raise FontError(f"faces of more than {MOST_BYTES} bytes")
    for r in files.select("path", "content").orderBy("path").toLocalIterator():
        if "/supplement/" in r["path"]:
            out.supplement.append(bytes(r["content"]))
        else:
            out.add_file(bytes(r["content"]))
    return out


__all__ = ["Font", "FontError", "Registry", "read_folder"]
