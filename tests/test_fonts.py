"""A font made here: two squares, a curve, a composite and a blank, with both kinds of kerning."""

import struct

import pytest

from vellumspark.operators import atlas as A
from vellumspark.plans import atlases, packages
from vellumspark.plans.compile import Corpus
from vellumspark.sources.fonts import Font, FontError, Registry


def simple(contours):
    ends, flags, xs, ys, x, y, k = b"", b"", b"", b"", 0, 0, -1
    for c in contours:
        k += len(c)
        ends += struct.pack(">H", k)
        for px, py, on in c:
            flags += bytes([int(on)])
            xs += struct.pack(">h", px - x)
            ys += struct.pack(">h", py - y)
            x, y = px, py
    d = struct.pack(">h4h", len(contours), 0, 0, 0, 0) + ends + struct.pack(">H", 0) + flags + xs + ys
    return d + b"\0" * (-len(d) % 4)


def font():
    square = [(100, 0, True), (100, 700, True), (800, 700, True), (800, 0, True)]
    disc = [(0, 0, False), (0, 600, False), (600, 600, False), (600, 0, False)]
    both = struct.pack(">h4h", -1, 0, 0, 0, 0) + struct.pack(">HHhh", 1 | 2 | 32, 1, 10, 20) + struct.pack(">HHbb", 2, 2, 5, 5)
    both = struct.pack(">h4h", -1, 0, 0, 0, 0) + struct.pack(">HHhh", 1 | 2 | 32, 1, 10, 20) + struct.pack(">HHbb", 2, 2, 5, 5) + b"\0\0"
    glyphs = [b"", simple([square]), simple([disc]), both, b""]
    glyf, loca = b"", [0]
    for g in glyphs:
        glyf += g
        loca.append(len(glyf))
    cmap4 = [(32, 32, 4 - 32), (65, 67, 1 - 65), (0xFFFF, 0xFFFF, 1)]
    n = len(cmap4) * 2
    sub = struct.pack(">7H", 4, 16 + 4 * n, 0, n, 0, 0, 0) + b"".join(struct.pack(">H", e) for _, e, _ in cmap4) + b"\0\0" + b"".join(struct.pack(">H", s) for s, _, _ in cmap4)
    sub += b"".join(struct.pack(">H", d & 0xFFFF) for *_, d in cmap4) + b"\0\0" * len(cmap4)
    pairs = struct.pack(">HHHH", 1, 0, 0, 0) + struct.pack(">HHh", 1, 2, -50)
    kern = struct.pack(">HH", 0, 1) + struct.pack(">HHH", 0, 6 + len(pairs), 1) + pairs
    pair_set = struct.pack(">HHhHh", 2, 2, -30, 3, 40)
    pair_pos = struct.pack(">5HH", 1, 12 + len(pair_set), 4, 0, 1, 12) + pair_set + struct.pack(">HHH", 1, 1, 1)
    lookup = struct.pack(">HHHH", 2, 0, 1, 8) + pair_pos
    gpos = struct.pack(">HHHHH", 1, 0, 0, 0, 10) + struct.pack(">HH", 1, 4) + lookup
    tables = {
        b"head": b"\0" * 18 + struct.pack(">H", 1000) + b"\0" * 30 + struct.pack(">hh", 1, 0), b"hhea": b"\0" * 4 + struct.pack(">hhh", 800, -200, 90) + b"\0" * 24 + struct.pack(">H", 5),
        b"maxp": struct.pack(">IH", 0x10000, 5), b"hmtx": b"".join(struct.pack(">Hh", 900 + g, g) for g in range(5)), b"loca": b"".join(struct.pack(">I", x) for x in loca), b"glyf": glyf,
        b"cmap": struct.pack(">HHHHI", 0, 1, 3, 1, 12) + sub, b"kern": kern, b"GPOS": gpos,
    }
    out, body = struct.pack(">IHHHH", 0x10000, len(tables), 0, 0, 0), b""
    for tag, d in tables.items():
        out += struct.pack(">4sIII", tag, 0, 12 + 16 * len(tables) + len(body), len(d))
        body += d + b"\0" * (-len(d) % 4)
    return out + body


def test_font():
    f = Font(font())
    assert f.cmap == {32: 4, 65: 1, 66: 2, 67: 3}
    assert f.outline(1)[0][0] == ((100.0, 0.0), None, (100.0, 700.0)) and len(f.outline(1)[0]) == 4
    assert len(f.outline(2)[0]) == 4 and f.outline(2)[0][0] == ((0.0, 300.0), (0.0, 600.0), (300.0, 600.0))
    assert f.outline(3)[0][0][0] == (110.0, 20.0) and len(f.outline(3)) == 2 and f.outline(4) == []
    assert f.metrics()["ascent"] == 0.8 and f.metrics()["descent"] == 0.2 and f.advance(3) == 903 and f.bearing(3) == 3
    assert f.kerning([65, 66, 67]) == {(65, 66): -80, (65, 67): 40}
    for bad in (b"", b"\0\1\0\0", font()[:200], b"OTTO" + font()[4:]):
        with pytest.raises(FontError):
            Font(bad)


def test_registry():
    r = Registry()
    for w in (300, 500, 500):
        r.add("My Sans", w, False, b"%d" % w)
    assert r.resolve("my sans", 400, False) == b"500" and r.resolve("MY SANS", 100, False) == b"300" and r.families() == ["my sans"]
    for family, italic in (("other", False), ("my sans", True)):
        with pytest.raises(FontError):
            r.resolve(family, 400, italic)


def test_atlases_make_packages_valid(spark, tmp_path):
    r = Registry()
    for w in (400, 700):
        r.add("Noto Sans", w, False, font())
    docs = spark.createDataFrame([(1, "markdown", "# AB\n\nBA CZ"), (2, "markdown", "A")], "doc_id long, kind string, source string")
    c = Corpus(docs, keep=f"file://{tmp_path}/parsed")
    atlases.build(c, r).write.parquet(f"file://{tmp_path}/atlases")
    built = spark.read.parquet(f"file://{tmp_path}/atlases")
    rows = {(x["doc_id"], x["font_id"]): x for x in built.collect()}
    assert set(rows) == {(1, 0), (1, 1), (2, 0)} and rows[1, 0]["missing"] == [90]
    a = rows[1, 1]["atlas"]
    assert [g["codepoint"] for g in a["glyphs"]] == [65, 66] and [(k["left"], k["right"]) for k in a["kerning"]] == [(65, 66)]
    pixels, _ = A.render(Font(font()).outline(1), 0.04, 4)
    g = a["glyphs"][0]
    page = A.np.frombuffer(a["pages"][g["page_index"]], A.np.uint8).reshape(a["page_height"], a["page_width"], 4)
    assert (page[g["box_y"] : g["box_y"] + g["box_h"], g["box_x"] : g["box_x"] + g["box_w"]] == pixels).all()
    packages.pack(c, docs, built).write.parquet(f"file://{tmp_path}/packed")
    assert packages.validate(spark.read.parquet(f"file://{tmp_path}/packed")).collect() == []


def test_faces_by_joins(spark):
    """What faces lack, and which face each one gets, as the registry and the atlases tell it."""
    from vellumspark.plans import faces

    r = Registry()
    for family, w in (("Noto Sans", 400), ("noto sans", 900), ("My Sans", 300), ("My Sans", 500)):
        r.add(family, w, False, font())
    docs = spark.createDataFrame([(1, "markdown", "# AB\n\nBA CZ é"), (2, "markdown", "A\n\n- Q *R*"), (3, "html", "<p style='font-family: my sans; font-weight: 400'>AY<p style='font-family: none'>N")], "doc_id long, kind string, source string")
    c = Corpus(docs)
    want = sorted((x["doc_id"], x["cp"]) for x in atlases.missing_codepoints(atlases.build(c, r)).collect())
    assert sorted((x["doc_id"], x["cp"]) for x in faces.missing_codepoints(c, r).collect()) == want and len(want) > 3
    table, maps, _ = faces.tables(spark, r)
    assert sorted((x["first"], x["last"], x["value"]) for x in maps.where("face = 0").collect()) == [(32, 32, 4), (65, 67, 1)]
    asked = [(f, w, False) for f in ("my sans", "MY SANS", "serif", "other") for w in (-5, 100, 399, 400, 401, 650, 651, 2000)]
    got = {(x["family"], x["weight"], x["italic"]): x["face"] for x in faces.resolved(spark.createDataFrame(asked, "family string, weight int, italic boolean"), table).collect()}
    number = {(x["name"], x["weight"], x["italic"]): x["face"] for x in table.collect()}
    for family, weight, italic in asked:
        name = "noto sans" if family == "serif" else family.lower()
        have = sorted((abs(w - min(max(weight, 100), 900)), -w) for n, w, _ in number if n == name)
        assert got.get((family, weight, italic)) == (number[name, -have[0][1], False] if have else None)


def test_nearest_over_many_ranges(spark):
    """One key with many values is many tasks; the answers are those of brute force."""
    import random

    from vellumspark.operators import relational as R

    rng = random.Random(2)
    wanted = [(k, rng.randint(0, 400), i) for i, k in enumerate(["hot"] * 600 + ["b"] * 40 + ["none"] * 5)] + [("hot", None, -1)]
    have = [("hot", rng.randint(0, 100) + 150 * rng.randint(0, 2)) for _ in range(40)] + [("b", 7), ("b", 7), ("c", 1), ("b", None)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = R.nearest(spark.createDataFrame(wanted, "k string, v int, i int"), spark.createDataFrame(have, "k string, x int"), ["k"], "v", "x").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    marks = {}
    for k, x in have:
        if x is not None:
            marks.setdefault(k, []).append(x)
    want = {i: min(marks[k], key=lambda x: (abs(x - v), -x)) for k, v, i in wanted if k in marks and v is not None}
    assert {r["i"]: r["x"] for r in got} == want and len(got) == 640


def test_kerning_by_joins(spark):
    from vellumspark.operators import glyphs as G

    use = spark.createDataFrame([("f", 65, 1), ("f", 66, 2), ("f", 97, 2), ("g", 65, 1)], "face string, cp long, glyph long")
    pairs = spark.createDataFrame([("f", 1, 2, -50), ("f", 1, 2, -30), ("f", 2, 1, 9), ("f", 2, 1, -9), ("f", 1, 7, 4), ("g", 1, 1, 3), ("h", 1, 1, 3)], "face string, left long, right long, adjust long")
    assert sorted(map(tuple, G.kerned(use, pairs).collect())) == [("f", 65, 97, -80), ("g", 65, 65, 3)]


def test_glyphs_by_ranges(spark):
    from vellumspark.operators import glyphs as G

    rows = [("a", c, 5 + c) for c in range(250, 600)] + [("a", 700, 9), ("a", 701, 10), ("a", 702, 30), ("b", 3, 1)]
    spans = G.intervals(spark.createDataFrame(rows, "face string, cp long, glyph long"), ["face"], "cp", "glyph")
    assert sorted(map(tuple, spans.collect())) == [("a", 250, 599, 255), ("a", 700, 701, 9), ("a", 702, 702, 30), ("b", 3, 3, 1)]
    more = spark.createDataFrame([(0, 600, 650, 1), (1, 640, 900, 500)], "ord int, first long, last long, value long")
    wanted = spark.createDataFrame([(f, c) for f in "ab" for c in (2, 3, 250, 599, 600, 645, 700, 702, 900, 901)] + [("a", 3)], "face string, cp long")
    have = {(f, c): (-1, g) for f, c, g in rows}
    for f in "ab":
        for c in range(600, 901):
            have.setdefault((f, c), (0, c - 599) if c <= 650 else (1, c - 140))
    got = {(r["face"], r["cp"]): (r["source"], r["glyph"]) for r in G.mapped(wanted, spans, more).collect()}
    assert len(got) == 20 and got == {k: have.get(k, (None, None)) for k in got}


def test_field_errors(spark):
    """Masks of the test glyphs: what the expressions say of them is what numpy says, and small."""
    r = Registry()
    r.add("Noto Sans", 400, False, font())
    faces = spark.createDataFrame([("Noto Sans", 400, False, cp) for cp in (32, 65, 66, 67, 90)] + [("none", 400, False, 65)], "family string, weight int, italic boolean, cp int")
    got = {(x["cp"], x["dx"], x["dy"]): x for x in atlases.field_errors(faces, r).collect()}
    assert {k[0] for k in got} == {65, 66, 67} and len(got) == 15
    pixels, first = A.render(Font(font()).outline(2), 0.04, 4)
    want = A.coverage(Font(font()).outline(2), 0.04, (first[0] + 0.25, first[1]), pixels.shape[1], pixels.shape[0], 8)
    d = A.reconstruct(pixels, 1.0, 0.25, 0).astype("f4") - want.astype("f4")
    x = got[66, 0.25, 0.0]
    assert abs(x["rmse"] - float((d.astype(float) ** 2).mean() ** 0.5)) < 1e-6 and abs(x["worst"] - float(abs(d).max())) < 1e-6
    assert all(x["rmse"] < 0.1 and x["worst"] < 0.6 for x in got.values())
