"""Inheritance without a walk: what the shapes of a document's requests (operators.partition) come to, inside the document's row.

A shape inherits from the one above it, that one from its own, and so on. The ways up are made by pointers that double: each round
joins a stretch with the one that it leads to, so a tree of depth d takes as many rounds as d has bits. Along them go font sizes, as
factors applied from the top down, then the nearest value of each field.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellumspark.functions.css_columns import let

#: Declarations with a length or a number, and those with a code or a word: name, field.
LENGTHS = {"margin-top": "margin_top", "margin-bottom": "margin_bottom", "text-indent": "text_indent", "letter-spacing": "letter_spacing"}
CODES = {
    "font-weight": "font_weight", "font-style": "italic", "color": "color", "background-color": "background", "text-align": "text_align", "list-style-type": "list_style", "white-space": "white_space",
    "text-decoration": "underline",
}
NAMES = ["font-size", "line-height", "font-family", *LENGTHS, *CODES]
#: Rounds of doubling: a way up has two shapes at most for each level of a tree, which has 128 (operators.tree).
ROUNDS = 9


def f32(x: float) -> Column:
    return F.lit(x).cast("float")


def px(number: Column, unit: Column, size: Column) -> Column:
    """A length against a font size, in 32-bit floats, a step at a time."""
    return F.when(unit == "em", number * size).when(unit == "%", number * size / f32(100)).when(unit == "pt", number * f32(96) / f32(72)).otherwise(number).cast("float")


def clamped(size: Column, smallest: float, largest: float) -> Column:
    """A NaN stays one."""
    return F.when(F.isnan(size), size).otherwise(F.least(F.greatest(size, f32(smallest)), f32(largest)))


def declared(found: Column) -> Column:
    """For each declaration its winning value, null where there is none: the last of its name in found, an array of (inline, spec, ord, declarations)."""
    last = F.flatten(F.transform(F.sort_array(found, False), lambda r: F.reverse(r["declarations"])))
    value = lambda d: F.struct(d["number"].cast("float").alias("number"), d["unit"].alias("unit"), d["code"].alias("code"), d["word"].alias("word"))
    return let(last, lambda ds: F.struct(*[value(F.get(F.filter(ds, lambda d: d["name"] == n), F.lit(0))).alias(n) for n in NAMES]))  # noqa: B023


def ways(shapes: Column) -> Column:
    """For each of shapes the shapes that it inherits from, itself first, then the one above it, and so on."""
    start = F.struct(F.transform(shapes, lambda s: s["above"]).alias("to"), F.transform(shapes, lambda s: F.array(s["shape"])).alias("way"))

    def longer(s: Column, _: Column) -> Column:
        to, way = s["to"], s["way"]
        on = F.transform(way, lambda x, i: F.when(F.get(to, i) >= 0, F.concat(x, F.get(way, F.get(to, i)))).otherwise(x))
        return F.struct(F.transform(to, lambda t: F.when(t >= 0, F.get(to, t)).otherwise(-1)).alias("to"), on.alias("way"))

    # a fold, as its state is made once a round, where an expression over expressions would be made again at each place
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, longer)["way"]


def font_sizes(shapes: Column, way: Column, default: float, smallest: float, largest: float) -> Column:
    """The declared sizes on the way of each shape, from the top down, each taken at the one before."""

    def next_size(size: Column, up: Column) -> Column:
        d = F.get(shapes, up)["says"]["font-size"]
        return F.when(d["number"].isNull(), size).otherwise(clamped(px(d["number"], d["unit"], size), smallest, largest))

    return F.transform(way, lambda w: F.aggregate(F.reverse(w), f32(default), next_size))


def computed(shapes: Column, default: dict, types: dict[str, str], smallest: float, largest: float) -> Column:
    """shape, seqs, marks and the style of each of shapes: an array of (shape, base: (above, code, marks, seqs), above, says: as declared gives it), shape k at place k.

    Everything inherits. A field's value is that of the nearest shape, itself included, that declares it; a length is taken at
    the font size of the shape that declares it.
    """
    fields = [k for k in types if k != "font_size_px"]

    def own(s: Column, size: Column) -> Column:
        of = lambda name: s["says"][name]
        values = {"line_height": of("line-height")["number"], "font_family": of("font-family")["word"], "code": F.when(s["base"]["code"], True)}
        values |= {field: px(of(name)["number"], of(name)["unit"], size) for name, field in LENGTHS.items()}
        values |= {field: of(name)["code"] for name, field in CODES.items()}
        return F.struct(*[values[k].cast(types[k]).alias(k) for k in fields])

    def nearest(way: Column, owns: Column) -> Column:
        none = F.struct(*[F.lit(None).cast(types[k]).alias(k) for k in fields])
        return F.aggregate(way, none, lambda a, up: let(F.get(owns, up), lambda o: F.struct(*[F.coalesce(a[k], o[k]).alias(k) for k in fields])))

    def style(s: Column, size: Column, near: Column) -> Column:
        value = lambda k: size if k == "font_size_px" else F.coalesce(near[k], F.lit(default[k]).cast(types[k]))
        return F.struct(s["shape"].alias("shape"), s["base"]["seqs"].alias("seqs"), s["base"]["marks"].alias("marks"), *[value(k).alias(k) for k in types])

    def styles(way: Column, sizes: Column, owns: Column) -> Column:
        return F.transform(shapes, lambda s, i: let(nearest(F.get(way, i), owns), lambda near: style(s, F.get(sizes, i), near)))

    with_owns = lambda way, sizes: let(F.transform(shapes, lambda s, i: own(s, F.get(sizes, i))), lambda owns: styles(way, sizes, owns))
    return let(ways(shapes), lambda way: let(font_sizes(shapes, way, default["font_size_px"], smallest, largest), lambda sizes: with_owns(way, sizes)))
