"""Style sheets: the supported grammar, strictly; an error has a place and a reason."""

from __future__ import annotations

import re
from typing import NamedTuple

LIMIT = 1 << 20  # bytes of a sheet


class CssError(ValueError):
    pass


class Simple(NamedTuple):
    tag: str | None
    id: str | None
    classes: tuple[str, ...]

    def specificity(self) -> tuple[int, int, int]:
        return (int(self.id is not None), len(self.classes), int(self.tag is not None))


class Rule(NamedTuple):
    selectors: list[list[Simple]]
    declarations: list[tuple[str, str]]


_BLANK = re.compile(r"[ \t\n\r\f]*(?:/\*.*?\*/[ \t\n\r\f]*)*", re.S)
_IDENT = re.compile(r"[A-Za-z_-][A-Za-z0-9_-]*")


class Reader:
    def __init__(self, text: str):
        if len(text.encode("utf-8", "surrogatepass")) > LIMIT:
            raise CssError("style sheet too large")
        self.s, self.i = text, 0

    def fail(self, what: str):
        raise CssError(f"{what} at byte {len(self.s[: self.i].encode('utf-8', 'surrogatepass'))}")

    def blank(self) -> bool:
        """Skip white space and comments; whether there were any."""
        start = self.i
        self.i = _BLANK.match(self.s, self.i).end()
        if self.s.startswith("/*", self.i):
            self.fail("unterminated comment")
        return self.i > start

    def peek(self) -> str:
        return self.s[self.i : self.i + 1]

    def eat(self, c: str) -> bool:
        if self.peek() == c and c:
            self.i += 1
            return True
        return False

    def ident(self) -> str:
        m = _IDENT.match(self.s, self.i)
        if not m:
            self.fail("expected an identifier")
        self.i = m.end()
        return m[0]

    def simple(self) -> Simple:
        tag = id_ = None
        classes: list[str] = []
        while True:
            c = self.peek()
            if c == "#":
                self.i += 1
                if id_ is not None:
                    self.fail("duplicate id")
                id_ = self.ident()
            elif c == ".":
                self.i += 1
                classes.append(self.ident())
            elif c.isascii() and c.isalpha():
                if tag is not None:
                    self.fail("duplicate tag")
                tag = self.ident().lower()
            else:
                return Simple(tag, id_, tuple(classes))

    def selector(self) -> list[Simple]:
        chain = [self.simple()]
        while self.blank():
            c = self.peek()
            if not (c in ("#", ".") and c or (c.isascii() and c.isalpha())):
                break
            chain.append(self.simple())
        return chain

    def declaration(self) -> tuple[str, str]:
        name = self.ident().lower()
        self.blank()
        if not self.eat(":"):
            self.fail("expected ':'")
        self.blank()
        start, quoted = self.i, False
        while self.i < len(self.s):
            c = self.s[self.i]
            if c == "\\":
                self.i += 2
                continue
            if c in "\"'":
                quoted = not quoted
            elif c in ";}" and not quoted:
                break
            self.i += 1
        self.i = min(self.i, len(self.s))
        value = self.s[start : self.i].strip()
        if not value:
            self.fail("empty value")
        return name, value

    def rule(self) -> Rule:
        selectors = [self.selector()]
        self.blank()
        while self.eat(","):
            self.blank()
            selectors.append(self.selector())
            self.blank()
        if not self.eat("{"):
            self.fail("expected '{'")
        declarations = []
        while True:
            self.blank()
            if self.eat("}"):
                return Rule(selectors, declarations)
            if self.eat(";"):
                continue
            if self.i >= len(self.s):
                self.fail("unterminated rule")
            declarations.append(self.declaration())
            self.blank()
            if not self.eat(";") and self.peek() != "}":
                self.fail("expected ';' or '}'")


def stylesheet(text: str) -> list[Rule]:
    r, rules = Reader(text), []
    r.blank()
    while r.i < len(r.s):
        rules.append(r.rule())
        r.blank()
    return rules


def inline(text: str) -> list[tuple[str, str]]:
    """The declarations of a style attribute."""
    r, out = Reader(text), []
    while True:
        r.blank()
        if r.i >= len(r.s):
            return out
        if r.eat(";"):
            continue
        out.append(r.declaration())
        r.blank()
        if r.i < len(r.s) and not r.eat(";"):
            r.fail("expected ';'")
