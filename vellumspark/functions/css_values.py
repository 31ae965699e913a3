"""Values of the supported style properties."""

from __future__ import annotations

import math
import re
from typing import NamedTuple

import numpy as np

from .text import trim

# Names, codes and colours that every style depends on.
GENERIC_FAMILIES = ("serif", "sans-serif", "monospace", "cursive", "fantasy", "system-ui", "inherit")
COLORS = {
    "black": 0x000000FF, "silver": 0xC0C0C0FF, "gray": 0x808080FF, "grey": 0x808080FF, "white": 0xFFFFFFFF, "maroon": 0x800000FF,
    "red": 0xFF0000FF, "purple": 0x800080FF, "fuchsia": 0xFF00FFFF, "green": 0x008000FF, "lime": 0x00FF00FF, "olive": 0x808000FF,
    "yellow": 0xFFFF00FF, "navy": 0x000080FF, "blue": 0x0000FFFF, "teal": 0x008080FF, "aqua": 0x00FFFFFF, "orange": 0xFFA500FF,
    "brown": 0xA52A2AFF, "pink": 0xFFC0CBFF, "transparent": 0x00000000,
}
ALIGN = {"left": 0, "start": 0, "center": 1, "right": 2, "end": 2, "justify": 3}
LIST_STYLES = ("none", "disc", "circle", "square", "decimal", "lower-alpha", "upper-alpha", "lower-roman", "upper-roman")
WHITE_SPACE = {"normal": 0, "pre": 1, "pre-wrap": 1, "pre-line": 1, "nowrap": 2}
WEIGHTS = {"normal": 400, "bold": 700, "bolder": 700, "lighter": 300}
LENGTHS = ("margin-top", "margin-bottom", "text-indent", "letter-spacing")

_FLOAT = re.compile(r"[+-]?(?:inf|infinity|nan|(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?)", re.I | re.A)


class Value(NamedTuple):
    """A declared value: a number with a unit, a whole number, or a word."""

    number: float | None = None
    unit: str | None = None
    code: int | None = None
    word: str | None = None


def number(text: str) -> float | None:
    """A 32-bit float, written as the language of style sheets and of numbers allows."""
    return float(np.float32(text)) if _FLOAT.fullmatch(text) else None


def length(text: str) -> Value | None:
    """A number with px, em, % or pt, or a bare 0. rem isn't understood: its last two letters are read as em."""
    text = trim(text)
    if text == "0":
        return Value(0.0, "px")
    for unit in ("px", "em", "%", "pt"):
        if text.endswith(unit):
            n = number(trim(text[: -len(unit)]))
            return Value(n, unit) if n is not None and math.isfinite(n) else None
    return None


def family(text: str) -> Value | None:
    for part in text.split(","):
        part = trim(part).strip('"').strip("'")
        if part and part.lower() not in GENERIC_FAMILIES:
            return Value(word=part)
    return None


def weight(text: str) -> Value | None:
    text = trim(text).lower()
    if text in WEIGHTS:
        return Value(code=WEIGHTS[text])
    if re.fullmatch(r"\+?\d+", text, re.A) and int(text) in range(100, 901, 100):
        return Value(code=int(text))
    return None


def color(text: str) -> Value | None:
    text = trim(text)
    if text.startswith("#"):
        digits = text[1:]
        if not re.fullmatch(r"(?:[0-9a-fA-F]{3}|[0-9a-fA-F]{6}|[0-9a-fA-F]{8})", digits):
            return None
        if len(digits) == 3:
            digits = "".join(2 * d for d in digits)
        return Value(code=int(digits.ljust(8, "f"), 16))
    return Value(code=COLORS[text.lower()]) if text.lower() in COLORS else None


def line_height(text: str) -> Value | None:
    """A multiplier; a length's unit (px, em, %) is dropped and its number taken for one."""
    got = length(text)
    if got is not None and got.unit in ("px", "em", "%"):
        return Value(got.number)
    n = number(text)
    return None if n is None else Value(n)


def coded(table: dict[str, int]):
    return lambda text: Value(code=table[text.lower()]) if text.lower() in table else None


PARSERS = {
    "font-family": family,
    "font-size": length,
    "line-height": line_height,
    "font-weight": weight,
    "font-style": coded({"italic": 1, "oblique": 1, "normal": 0}),
    "color": color,
    "background-color": color,
    "margin-top": length,
    "margin-bottom": length,
    "text-align": coded(ALIGN),
    "text-indent": length,
    "list-style-type": coded({name: k for k, name in enumerate(LIST_STYLES)}),
    "letter-spacing": lambda t: Value(0.0, "px") if t.lower() == "normal" else length(t),
    "white-space": coded(WHITE_SPACE),
    "text-decoration": coded({"underline": 1, "none": 0}),
}


def declared(name: str, text: str) -> Value | None:
    """The value of a declaration; None for an unknown property or a value that it doesn't take."""
    parser = PARSERS.get(name)
    return None if parser is None else parser(trim(text))
