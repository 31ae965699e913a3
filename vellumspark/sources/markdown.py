"""CommonMark with tables, by the public specification, to the semantic tree."""

from __future__ import annotations

import html
import re
import unicodedata

from vellumspark.operators.tree import MAX_DEPTH, Node, TreeError, finish, normalise_leaves

FENCE = re.compile(r" {0,3}(`{3,}(?=[^`]*$)|~{3,})\s*(.*)$")
ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
RULE = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
SETEXT = re.compile(r" {0,3}(=+|-+)[ \t]*$")
BULLET = re.compile(r"( {0,3})([-+*])(?=[ \t]|$)")
NUMBER = re.compile(r"( {0,3})(\d{1,9})([.)])(?=[ \t]|$)", re.A)
QUOTE = re.compile(r" {0,3}> ?")
DELIMITER_ROW = re.compile(r" {0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
DEFINITION = re.compile(r" {0,3}\[((?:[^\[\]\\]|\\.)+)\]:[ \t]*\n?[ \t]*(?:<([^<>\n]*)>|(\S+))(?:[ \t]*(?:\n[ \t]*)?(?:(?<=\s)(?:\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\))))?[ \t]*(?:\n|$)")
HTML_NAMES = "address article aside base basefont blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hr html iframe legend li link main menu menuitem nav noframes ol optgroup option p param search section summary table tbody td tfoot th thead title tr track ul".replace(" ", "|")
ATTRIBUTE = r"""(?:\s+[A-Za-z_:][\w.:-]*(?:\s*=\s*(?:[^\s"'=<>`]+|'[^']*'|"[^"]*"))?)"""
TAG = rf"(?:<[A-Za-z][A-Za-z0-9-]*{ATTRIBUTE}*\s*/?>|</[A-Za-z][A-Za-z0-9-]*\s*>)"
#: How a block of HTML starts, how it ends (None: at a blank line), and whether it may end a paragraph.
HTML_BLOCKS = [
    (re.compile(r" {0,3}<(?:pre|script|style|textarea)(?:\s|>|$)", re.I), re.compile(r"</(?:pre|script|style|textarea)>", re.I), True),
    (re.compile(r" {0,3}<!--"), re.compile(r"-->"), True),
    (re.compile(r" {0,3}<\?"), re.compile(r"\?>"), True),
    (re.compile(r" {0,3}<![A-Za-z]"), re.compile(r">"), True),
    (re.compile(r" {0,3}<!\[CDATA\["), re.compile(r"\]\]>"), True),
    (re.compile(rf" {{0,3}}</?(?:{HTML_NAMES})(?:\s|/?>|$)", re.I), None, True),
    (re.compile(rf" {{0,3}}{TAG}\s*$"), None, False),
]
INLINE_HTML = re.compile(rf"{TAG}|<!-->|<!--->|<!--.*?-->|<\?.*?\?>|<![A-Za-z][^>]*>|<!\[CDATA\[.*?\]\]>", re.S)
AUTOLINK = re.compile(r"<([A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*)>|<([A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]+@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)*)>")
ENTITY = re.compile(r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);")
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
ESCAPE = re.compile(r"\\([!-/:-@\[-`{-~])")


def unescape(text: str) -> str:
    """Backslash escapes and references, as in targets."""
    return re.sub(r"\\([!-/:-@\[-`{-~])|(&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);)", lambda m: m[1] or html.unescape(m[2]), text)


def label(text: str) -> str:
    return re.sub(r"\s+", " ", text.strip()).casefold()


def expand(line: str) -> str:
    """Tabs that indent, as blanks to the next multiple of four."""
    if "\t" not in line:
        return line
    out, column = "", 0
    for i, c in enumerate(line):
        if c == "\t":
            n = 4 - column % 4
            out, column = out + " " * n, column + n
        elif c == " ":
            out, column = out + c, column + 1
        else:
            return out + line[i:]
    return out


def indent(line: str) -> int:
    return len(line) - len(line.lstrip(" "))


def cells(row: str) -> list[str]:
    row = row.strip(" \t")
    row = row[1:] if row.startswith("|") else row
    if row.endswith("|") and not row.endswith("\\|"):
        row = row[:-1]
    out, held, i = [], "", 0
    while i < len(row):
        if row[i] == "\\" and row[i + 1 : i + 2] == "|":
            held += "|"
            i += 2
            continue
        if row[i] == "|":
            out.append(held.strip())
            held = ""
        else:
            held += row[i]
        i += 1
    return [*out, held.strip()]


class Parser:
    def __init__(self):
        self.targets: dict[str, str] = {}
        self.later: list[tuple[Node, str]] = []  # blocks whose content is still text

    # blocks

    def interrupts(self, line: str, in_list: bool = False) -> bool:
        """Whether a line ends a paragraph that it would otherwise go on."""
        if indent(line) >= 4:
            return False
        if ATX.match(line) or RULE.match(line) or FENCE.match(line) or QUOTE.match(line):
            return True
        if any(ends and start.match(line) for start, _, ends in HTML_BLOCKS):
            return True
        m = BULLET.match(line)
        if m and line[m.end() :].strip():
            return True
        m = NUMBER.match(line)
        return bool(m and line[m.end() :].strip() and (in_list or int(m[2]) == 1))

    def definitions(self, text: str) -> str:
        while True:
            m = DEFINITION.match(text)
            if not m or not m[1].strip():
                return text
            self.targets.setdefault(label(m[1]), unescape(m[2] if m[2] is not None else m[3]))
            text = text[m.end() :]

    def paragraph(self, lines: list[str], out: list[Node], kind: str = "paragraph", level: int = 0) -> None:
        text = self.definitions("\n".join(x.lstrip(" ") for x in lines))
        if text.strip():
            node = Node(kind, level=level)
            self.later.append((node, text.rstrip()))
            out.append(node)

    def blocks(self, lines: list[str], depth: int) -> list[Node]:
        if depth >= MAX_DEPTH:
            raise TreeError("tree too deep")
        out: list[Node] = []
        held: list[str] = []
        i, n = 0, len(lines)

        def flush() -> None:
            if held:
                self.paragraph(held, out)
                held.clear()

        while i < n:
            line = expand(lines[i])
            if not line.strip():
                flush()
                i += 1
                continue
            if held and indent(line) >= 4:
                held.append(line)
                i += 1
                continue
            if indent(line) >= 4:
                code = []
                while i < n and (indent(expand(lines[i])) >= 4 or not lines[i].strip()):
                    code.append(expand(lines[i])[4:])
                    i += 1
                while code and not code[-1].strip():
                    code.pop()
                out.append(Node("code_block", "".join(x + "\n" for x in code)))
                continue
            m = SETEXT.match(line)
            if m and held and self.definitions("\n".join(held)).strip():
                self.paragraph(list(held), out, "heading", 1 if m[1][0] == "=" else 2)
                held.clear()
                i += 1
                continue
            m = FENCE.match(line)
            if m:
                flush()
                i = self.fenced(lines, i, m, indent(line), out)
                continue
            m = ATX.match(line)
            if m:
                flush()
                node = Node("heading", level=len(m[1]))
                content = m[2] or ""
                self.later.append((node, "" if re.fullmatch(r"#+", content) else content.strip()))
                out.append(node)
                i += 1
                continue
            if RULE.match(line):
                flush()
                out.append(Node("rule"))
                i += 1
                continue
            if QUOTE.match(line):
                flush()
                i = self.quote(lines, i, depth, out)
                continue
            m = BULLET.match(line) or NUMBER.match(line)
            if m and not (held and not self.interrupts(line)):
                flush()
                i = self.items(lines, i, depth, out)
                continue
            block = next(((end, ends) for start, end, ends in HTML_BLOCKS if start.match(line) and (ends or not held)), None)
            if block:
                flush()
                i = self.html_block(lines, i, block[0])
                continue
            if i + 1 < n and "|" in line and not held and DELIMITER_ROW.match(expand(lines[i + 1])) and len(cells(line)) == len(cells(lines[i + 1])) and "-" in lines[i + 1]:
                i = self.table(lines, i, out)
                continue
            held.append(line)
            i += 1
        flush()
        return out

    def fenced(self, lines: list[str], i: int, m: re.Match, by: int, out: list[Node]) -> int:
        mark = m[1]
        end = re.compile(rf" {{0,3}}{re.escape(mark[0])}{{{len(mark)},}}[ \t]*$")
        code = []
        i += 1
        while i < len(lines) and not end.match(lines[i]):
            line = lines[i]
            code.append(line[min(by, indent(line)) :])
            i += 1
        out.append(Node("code_block", "".join(x + "\n" for x in code)))
        return i + 1

    def html_block(self, lines: list[str], i: int, end: re.Pattern | None) -> int:
        """Blocks of HTML have no content here."""
        while i < len(lines):
            if end is None and not lines[i].strip():
                return i
            if end is not None and end.search(lines[i]):
                return i + 1
            i += 1
        return i

    def goes_on(self, held: list[str]) -> bool:
        """Whether the last block of a container's lines is a paragraph, which a line without the container's mark may go on."""
        if not held or not held[-1].strip():
            return False
        fence = None
        for x in held:
            m = FENCE.match(x)
            if m and fence is None:
                fence = m[1]
            elif m and m[1][0] == fence[0] and len(m[1]) >= len(fence) and not m[2]:
                fence = None
        last = expand(held[-1])
        while QUOTE.match(last) or BULLET.match(last) or NUMBER.match(last):
            m = QUOTE.match(last) or BULLET.match(last) or NUMBER.match(last)
            last = last[m.end() :].lstrip(" ")
        return fence is None and bool(last.strip()) and not (ATX.match(last) or RULE.match(last) or (indent(last) >= 4 and len(held) == 1))

    def quote(self, lines: list[str], i: int, depth: int, out: list[Node]) -> int:
        inner: list[str] = []
        while i < len(lines):
            line = expand(lines[i])
            m = QUOTE.match(line)
            if m:
                inner.append(line[m.end() :])
            elif line.strip() and self.goes_on(inner) and not self.interrupts(line) and not SETEXT.match(line):
                inner.append(line.lstrip(" "))
            else:
                break
            i += 1
        out.append(Node("quote", kids=self.blocks(inner, depth + 1)))
        return i

    def items(self, lines: list[str], i: int, depth: int, out: list[Node]) -> int:
        def mark(line: str):
            m = BULLET.match(line)
            if m and not RULE.match(line):
                return m, m[2], None
            m = NUMBER.match(line)
            return (m, m[3], int(m[2])) if m else (None, None, None)

        _, kind, start = mark(expand(lines[i]))
        node = Node("ordered_list" if start is not None else "unordered_list", start=start)
        loose, blank_before = False, False
        found: list[list[str]] = []
        while i < len(lines):
            line = expand(lines[i])
            m, k, _ = mark(line)
            if m is None or k != kind:
                break
            loose = loose or blank_before
            rest = line[m.end() :]
            by = m.end() + (indent(rest) if rest.strip() and indent(rest) <= 4 else 1)
            inner = [line[by:] if rest.strip() else ""]
            i += 1
            blank_before = False
            while i < len(lines):
                line = expand(lines[i])
                if not line.strip():
                    if len(inner) == 1 and not inner[0].strip():
                        break
                    inner.append("")
                    i += 1
                    continue
                if indent(line) >= by:
                    inner.append(line[by:])
                elif inner[-1].strip() and self.goes_on(inner) and not self.interrupts(line, True) and mark(line)[0] is None:
                    inner.append(line.lstrip(" "))
                else:
                    break
                i += 1
            while inner and not inner[-1].strip():
                inner.pop()
                blank_before = True
            while i < len(lines) and not lines[i].strip():
                blank_before = True
                i += 1
            found.append(inner)
            loose = loose or self.parted(inner)
        for inner in found:
            kids = self.blocks(inner, depth + 2)
            item = Node("list_item")
            for k in kids:
                item.kids.append(Node("_tight", kids=[k]) if k.kind == "paragraph" and not loose else k)
            node.kids.append(item)
        out.append(node)
        return i

    def parted(self, lines: list[str]) -> bool:
        """Whether a blank line stands between two blocks of an item itself."""
        fence = None
        deep = False
        for k, x in enumerate(lines):
            m = FENCE.match(x)
            if m and fence is None:
                fence = m[1]
            elif m and fence and m[1][0] == fence[0] and len(m[1]) >= len(fence):
                fence = None
            if BULLET.match(x) or NUMBER.match(x):
                deep = True
            if not x.strip() and fence is None and k + 1 < len(lines):
                after = next((y for y in lines[k + 1 :] if y.strip()), "")
                if not (deep and (indent(expand(after)) >= 2 or BULLET.match(after) or NUMBER.match(after))):
                    return True
        return False

    def table(self, lines: list[str], i: int, out: list[Node]) -> int:
        width = len(cells(lines[i]))
        node = Node("table")
        rows = [cells(lines[i])]
        i += 2
        while i < len(lines) and lines[i].strip() and not self.interrupts(expand(lines[i])):
            rows.append(cells(lines[i]))
            i += 1
        for row in rows:
            tr = Node("table_row")
            for text in (row + [""] * width)[:width]:
                td = Node("table_cell")
                self.later.append((td, text))
                tr.kids.append(td)
            node.kids.append(tr)
        out.append(node)
        return i

    # inlines

    def inlines(self, s: str) -> list[Node]:
        items: list[list] = []  # ['text', str], ['node', Node], ['run', char, count, can open, can close, original count]
        brackets: list[tuple[int, bool, int, bool]] = []  # (item, is image, place after it, active)
        i, n = 0, len(s)

        def text(t: str) -> None:
            if items and items[-1][0] == "text" and len(items) - 1 not in {b[0] for b in brackets}:
                items[-1][1] += t
            elif t:
                items.append(["text", t])

        while i < n:
            c = s[i]
            if c == "\\":
                if s[i + 1 : i + 2] == "\n":
                    items.append(["node", Node("hard_break")])
                    i = n if i + 2 >= n else i + 2 + indent(s[i + 2 :])
                elif i + 1 < n and s[i + 1] in PUNCTUATION:
                    text(s[i + 1])
                    i += 2
                else:
                    text(c)
                    i += 1
            elif c == "`":
                m = re.compile(r"`+").match(s, i)
                end = re.compile(rf"(?<!`){m[0]}(?!`)").search(s, m.end())
                if end:
                    code = s[m.end() : end.start()].replace("\n", " ")
                    if code.startswith(" ") and code.endswith(" ") and code.strip(" "):
                        code = code[1:-1]
                    items.append(["node", Node("inline_code", code)])
                    i = end.end()
                else:
                    text(m[0])
                    i = m.end()
            elif c in "*_":
                m = re.compile(re.escape(c) + "+").match(s, i)
                before, after = (s[i - 1] if i else "\n"), (s[m.end()] if m.end() < n else "\n")
                blank = lambda x: x.isspace()
                punct = lambda x: x in PUNCTUATION or unicodedata.category(x)[0] in "PS"
                left = not blank(after) and (not punct(after) or blank(before) or punct(before))
                right = not blank(before) and (not punct(before) or blank(after) or punct(after))
                opens = left and (c == "*" or not right or punct(before))
                closes = right and (c == "*" or not left or punct(after))
                items.append(["run", c, len(m[0]), opens, closes, len(m[0])])
                i = m.end()
            elif c == "[" or s.startswith("![", i):
                k = 1 + (c == "!")
                items.append(["text", s[i : i + k]])
                brackets.append((len(items) - 1, c == "!", i + k, True))
                i += k
            elif c == "]":
                i = self.close_bracket(s, i, items, brackets)
            elif c == "<":
                m = AUTOLINK.match(s, i)
                if m:
                    items.append(["node", Node("link", href=m[1] if m[1] else "mailto:" + m[2], kids=[Node("transparent", m[1] or m[2])])])
                    i = m.end()
                    continue
                m = INLINE_HTML.match(s, i)
                text(m[0] if m else c)
                i = m.end() if m else i + 1
            elif c == "&":
                m = ENTITY.match(s, i)
                t = html.unescape(m[0]) if m else c
                text(t)
                i = m.end() if m else i + 1
            elif c == "\n":
                hard = bool(items) and items[-1][0] == "text" and items[-1][1].endswith("  ")
                if items and items[-1][0] == "text":
                    items[-1][1] = items[-1][1].rstrip(" ")
                items.append(["node", Node("hard_break")] if hard else ["text", " "])
                i += 1
                while i < n and s[i] == " ":
                    i += 1
            else:
                m = re.compile(r"[^\\`*_\[\]!<&\n]+|!").match(s, i)
                text(m[0])
                i = m.end()
        return self.emphasis(items)

    def close_bracket(self, s: str, i: int, items: list[list], brackets: list) -> int:
        if not brackets:
            items.append(["text", "]"])
            return i + 1
        at, image, start, active = brackets.pop()
        if not active:
            items.append(["text", "]"])
            return i + 1
        target, end = None, i + 1
        m = re.compile(r"\(\s*(?:<((?:[^<>\n\\]|\\.)*)>|((?:[^\s()\\<]|\\.|\((?:[^\s()\\]|\\.|\((?:[^\s()\\]|\\.)*\))*\))(?:[^\s()\\]|\\.|\((?:[^\s()\\]|\\.|\((?:[^\s()\\]|\\.)*\))*\))*)?)(?:\s+(?:\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\)))?\s*\)", re.S).match(s, i + 1)
        if m:
            target, end = unescape(m[1] if m[1] is not None else m[2] or ""), m.end()
        else:
            m = re.compile(r"\[((?:[^\[\]\\]|\\.)*)\]").match(s, i + 1)
            name = m[1] if m and m[1].strip() else s[start:i]
            target = self.targets.get(label(name))
            end = m.end() if m and target is not None else i + 1
        if target is None:
            items.append(["text", "]"])
            return i + 1
        kids = self.emphasis(items[at + 1 :])
        del items[at:]
        if image:
            # the alternative text is the text inside; code and breaks inside stay, as children
            alt, inside = [], []

            def walk(nodes: list[Node]) -> None:
                for k in nodes:
                    if k.kind in ("inline_code", "hard_break"):
                        inside.append(k)
                    elif k.kind == "image":
                        alt.append(k.alt or "")
                    else:
                        alt.append(k.text)
                        walk(k.kids)

            walk(kids)
            items.append(["node", Node("image", src=target, alt="".join(alt), kids=inside)])
        else:
            items.append(["node", Node("link", href=target, kids=kids)])
            brackets[:] = [(a, im, st, act and im) for a, im, st, act in brackets]
        return end

    def emphasis(self, items: list[list]) -> list[Node]:
        """Pair the runs of * and _ by the rules of the specification."""
        items = [list(x) for x in items]
        k = 0
        while k < len(items):
            it = items[k]
            if it[0] != "run" or not it[4] or it[2] == 0:
                k += 1
                continue
            o = k - 1
            while o >= 0:
                x = items[o]
                odd = x[0] == "run" and (it[3] or x[4]) and (x[5] + it[5]) % 3 == 0 and not (x[5] % 3 == 0 and it[5] % 3 == 0)
                if x[0] == "run" and x[1] == it[1] and x[3] and x[2] > 0 and not odd:
                    break
                o -= 1
            if o < 0:
                k += 1
                continue
            n = 2 if items[o][2] >= 2 and it[2] >= 2 else 1
            kids = self.plain(items[o + 1 : k])
            node = Node("strong" if n == 2 else "emphasis", kids=kids)
            items[o][2] -= n
            it[2] -= n
            items[o + 1 : k] = [["node", node]]
            k = o + 2
        return self.plain(items)

    @staticmethod
    def plain(items: list[list]) -> list[Node]:
        out: list[Node] = []
        for it in items:
            if it[0] == "node":
                out.append(it[1])
                continue
            t = it[1] * it[2] if it[0] == "run" else it[1]
            if not t:
                continue
            if out and out[-1].kind == "transparent" and not out[-1].kids:
                out[-1].text += t
            else:
                out.append(Node("transparent", t))
        return out


def untighten(node: Node) -> None:
    out: list[Node] = []
    for k in node.kids:
        if k.kind == "_tight":
            out += k.kids[0].kids
        else:
            untighten(k)
            out.append(k)
    node.kids = out


def parse(source: str, fold: bool = True) -> Node:
    p = Parser()
    root = Node("document", kids=p.blocks(source.replace("\0", "�").replace("\r\n", "\n").replace("\r", "\n").split("\n"), 1))
    for node, text in p.later:
        node.kids = p.inlines(text)
    untighten(root)
    check_depth(root)
    normalise_leaves(root)
    return finish(root) if fold else root


def check_depth(root: Node) -> None:
    level, depth = [root], 0
    while level:
        depth += 1
        if depth > MAX_DEPTH:
            raise TreeError("tree too deep")
        level = [k for x in level for k in x.kids]
