"""Values of style declarations, read from their texts by expressions; functions.css_values says the same of one value in Python."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import css_values as V
from .text import JAVA_WHITE

VALUE = "struct<number: float, unit: string, code: bigint, word: string>"
TYPED = "array<struct<idx: int, name: string, number: float, unit: string, code: bigint, word: string>>"
NUMBER = r"\A[+-]?(?i:inf|infinity|nan|(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?)\z"


def let(x: Column, then: Callable[[Column], Column]) -> Column:
    """An expression over x that names it once: written out at each place, expressions over expressions double and the driver plans megabytes."""
    return F.get(F.transform(F.array(x), then), F.lit(0))


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, rf"\A{JAVA_WHITE}|{JAVA_WHITE}\z", "")


def value(number: Column | None = None, unit: Column | None = None, code: Column | None = None, word: Column | None = None) -> Column:
    parts = [(number, "number", "float"), (unit, "unit", "string"), (code, "code", "bigint"), (word, "word", "string")]
    return F.struct(*[(F.lit(None) if x is None else x).cast(kind).alias(name) for x, name, kind in parts])


def number(text: Column) -> Column:
    """A number in 32 bits, rounded from one in 64; null for what isn't written as one."""
    plain = F.when(text.rlike(r"(?i)nan\z"), F.lit(float("nan"))).when(text.rlike(r"(?i)inf(inity)?\z"), F.when(text.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf")))).otherwise(text.try_cast("double"))
    return F.when(text.rlike(NUMBER), plain.cast("float"))


def length(text: Column) -> Column:
    """A number with px, em, % or pt, or a bare 0."""
    unit = F.when(text.endswith("px"), "px").when(text.endswith("em"), "em").when(text.endswith("%"), "%").when(text.endswith("pt"), "pt")

    def measured(n: Column, unit: Column) -> Column:
        finite = n.isNotNull() & ~F.isnan(n) & (F.abs(n) < float("inf"))
        return F.when(text == "0", value(F.lit(0.0), F.lit("px"))).when(unit.isNotNull() & finite, value(n, unit))

    return let(unit, lambda u: let(let(trimmed(F.substring(text, F.lit(1), F.length(text) - F.length(u))), number), lambda n: measured(n, u)))


def named(table: dict[str, int], text: Column) -> Column:
    code = F.element_at(F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v).cast("long"))]), F.lower(text))
    return let(code, lambda c: F.when(c.isNotNull(), value(code=c)))


def family(text: Column) -> Column:
    bare = lambda x: F.regexp_replace(F.regexp_replace(trimmed(x), r'\A"+|"+\z', ""), r"\A'+|'+\z", "")
    parts = F.filter(F.transform(F.split(text, ","), bare), lambda x: (x != "") & ~F.lower(x).isin(*V.GENERIC_FAMILIES))
    return let(F.get(parts, F.lit(0)), lambda first: F.when(first.isNotNull(), value(word=first)))


def weight(text: Column) -> Column:
    hundreds = F.regexp_extract(text, r"\A\+?0*([1-9]00)\z", 1)
    return F.coalesce(named(V.WEIGHTS, text), F.when(hundreds != "", value(code=hundreds.try_cast("long"))))


def color(text: Column) -> Column:
    digits = F.regexp_extract(text, r"\A#([0-9a-fA-F]{3}|[0-9a-fA-F]{6}|[0-9a-fA-F]{8})\z", 1)
    whole = lambda x: F.when(F.length(x) == 3, F.regexp_replace(x, "(.)", "$1$1")).otherwise(x)
    hexed = let(digits, lambda x: F.when(x != "", value(code=F.conv(F.rpad(whole(x), 8, "f"), 16, 10).cast("long"))))
    return F.when(text.startswith("#"), hexed).otherwise(named(V.COLORS, text))


def line_height(text: Column, size: Column) -> Column:
    """size: the text read as a length."""
    return F.when(size["unit"].isin("px", "em", "%"), value(size["number"])).otherwise(let(number(text), lambda n: F.when(n.isNotNull(), value(n))))


def declared(name: Column, text: Column) -> Column:
    """The value of a declaration as a struct; null for an unknown property or a value that it doesn't take."""
    return let(trimmed(text), lambda t: let(length(t), lambda size: _declared(name, t, size)))


def _declared(name: Column, t: Column, size: Column) -> Column:
    readers = {
        "font-family": family(t), "line-height": line_height(t, size), "font-weight": weight(t), "font-style": named({"italic": 1, "oblique": 1, "normal": 0}, t), "text-align": named(V.ALIGN, t),
        "list-style-type": named({n: k for k, n in enumerate(V.LIST_STYLES)}, t), "letter-spacing": F.when(F.lower(t) == "normal", value(F.lit(0.0), F.lit("px"))).otherwise(size), "white-space": named(V.WHITE_SPACE, t),
        "text-decoration": named({"underline": 1, "none": 0}, t),
    }
    out = F.when(name.isin("font-size", "margin-top", "margin-bottom", "text-indent"), size)
    out = out.when(name.isin("color", "background-color"), color(t))
    for n, read in readers.items():
        out = out.when(name == n, read)
    return out


def typed(declarations: Column) -> Column:
    """An array of (idx, name, text) as one of typed values, less those that aren't understood."""
    read = F.transform(declarations, lambda d: F.struct(d["idx"].alias("idx"), d["name"].alias("name"), declared(d["name"], d["text"]).alias("v")))
    known = F.filter(read, lambda d: d["v"].isNotNull())
    return F.transform(known, lambda d: F.struct(d["idx"].alias("idx"), d["name"].alias("name"), *[d["v"][f].alias(f) for f in ("number", "unit", "code", "word")])).cast(TYPED)
