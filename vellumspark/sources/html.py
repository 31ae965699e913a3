"""HTML text to a small document tree, by the public HTML standard's tree construction.

Covered: implied and omitted tags, the list of active formatting elements with its three-copies bound, the adoption of
misnested formatting, foster parenting out of tables, raw and escapable raw text, character references. Left out, as nothing
here keeps their result: frames, quirks mode, scripting, and the inner rules of select and of foreign content.
"""

from __future__ import annotations

import html as _entities
import re

VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
RAW = frozenset("style script xmp iframe noembed noframes noscript".split())
ESCAPABLE = frozenset("title textarea".split())
IN_HEAD = frozenset("base basefont bgsound link meta title style script noscript noframes template".split())
#: Block starts that end an open paragraph.
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer header hgroup main menu nav ol p search section summary ul pre listing form table hr xmp plaintext".split()
)
SPECIAL = ENDS_P | HEADINGS | VOID | RAW | ESCAPABLE | frozenset(
    "applet body button caption col colgroup dd dt frameset head html li marquee object select tbody td template tfoot th thead tr".split()
)
IMPLIED_END = frozenset("dd dt li optgroup option p rb rp rt rtc".split())
SCOPE = frozenset("applet caption html table td th marquee object template svg math".split())
BUTTON_SCOPE = SCOPE | {"button"}
LIST_SCOPE = SCOPE | {"ol", "ul"}
TABLE_SCOPE = frozenset("html table template".split())
TABLE_PARTS = frozenset("table tbody tfoot thead tr".split())
SECTIONS = frozenset("tbody tfoot thead".split())
CELLS = frozenset("td th".split())
#: What ends foreign content.
BREAKOUT = (ENDS_P | HEADINGS | {"b", "big", "body", "br", "code", "dd", "dt", "em", "embed", "head", "i", "img", "li", "meta", "nobr", "ruby", "s", "small", "span", "strong", "strike", "sub", "sup", "tt", "u", "var"}) - {"form", "fieldset"}
BLANK = "\t\n\f\r "

TAG_NAME = re.compile(r"[^\t\n\f />]*")
ATTRIBUTE = re.compile(r"""[\t\n\f /]*(?:([^\t\n\f />=][^\t\n\f />=]*|=[^\t\n\f />=]*)(?:[\t\n\f ]*=[\t\n\f ]*(?:"([^"]*)(?:"|$)|'([^']*)(?:'|$)|([^\t\n\f >]*)))?)?""")
REFERENCE = re.compile(r"&(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*;?)(?=(.?))", re.S)


class Element:
    __slots__ = ("attrs", "kids", "tag", "up")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None):
        self.tag, self.attrs, self.kids, self.up = tag, attrs or {}, [], None

    def text(self) -> str:
        return "".join(k if isinstance(k, str) else k.text() for k in self.kids)


def attribute_value(text: str) -> str:
    """References in an attribute; without a semicolon, before a letter, digit or =, a name stays as it is."""

    def one(m: re.Match) -> str:
        name, after = m[1], m[2]
        if name[0] != "#" and not name.endswith(";") and (after == "=" or (after.isascii() and after.isalnum())):
            return m[0]
        return _entities.unescape(m[0])

    return REFERENCE.sub(one, text) if "&" in text else text


def tokens(source: str):
    """('text', str), ('start', tag, attrs, closed) and ('end', tag). Raw text elements give their text whole."""
    s = source.replace("\r\n", "\n").replace("\r", "\n")
    n, i = len(s), 0
    while i < n:
        lt = s.find("<", i)
        if lt < 0:
            yield "text", _entities.unescape(s[i:])
            return
        nxt = s[lt + 1 : lt + 2]
        if not (nxt.isascii() and nxt.isalpha()) and nxt not in ("/", "!", "?"):
            # a lone < is text
            end = s.find("<", lt + 1)
            end = n if end < 0 else end
            yield "text", _entities.unescape(s[i:end])
            i = end
            continue
        if lt > i:
            yield "text", _entities.unescape(s[i:lt])
        if nxt == "!":
            if s.startswith("<!--", lt):
                if s.startswith(("<!-->", "<!--->"), lt):
                    i = s.index(">", lt) + 1
                    continue
                m = re.compile(r"--!?>").search(s, lt + 4)
                i = m.end() if m else n
            else:
                end = s.find(">", lt)
                i = n if end < 0 else end + 1
            continue
        if nxt == "?":
            end = s.find(">", lt)
            i = n if end < 0 else end + 1
            continue
        close = nxt == "/"
        at = lt + 1 + close
        if close and not (s[at : at + 1].isascii() and s[at : at + 1].isalpha()):
            if at >= n:
                yield "text", "</"
                return
            end = s.find(">", lt)
            i = n if end < 0 else end + 1
            continue
        m = TAG_NAME.match(s, at)
        tag, at = m[0].lower(), m.end()
        attrs: dict[str, str] = {}
        while at < n and s[at] != ">":
            m = ATTRIBUTE.match(s, at)
            if m.end() == at:
                at += 1
                continue
            if m[1]:
                value = next((v for v in m.group(2, 3, 4) if v is not None), "")
                attrs.setdefault(m[1].lower(), attribute_value(value))
            at = m.end()
        if at >= n:
            return  # a tag that isn't closed is dropped
        closed = s[at - 1] == "/"
        i = at + 1
        if close:
            yield "end", tag
            continue
        yield "start", tag, attrs, closed
        if tag in RAW or tag in ESCAPABLE:
            m = re.compile(rf"</{tag}(?=[\t\n\f />])", re.I).search(s, i)
            body = s[i : m.start()] if m else s[i:]
            if body:
                yield "raw", _entities.unescape(body) if tag in ESCAPABLE else body
            i = m.start() if m else n
        elif tag == "plaintext":
            yield "raw", s[i:]
            return


class Builder:
    def __init__(self):
        self.root = Element("html")
        self.open: list[Element] = [self.root]
        self.formatting: list[Element | None] = []  # None is a marker
        self.head: Element | None = None
        self.body: Element | None = None
        self.head_open = False
        self.foster = False
        self.skip_newline = False

    # the stack of open elements

    def top(self) -> Element:
        return self.open[-1]

    def has(self, tags, scope=SCOPE) -> bool:
        tags = {tags} if isinstance(tags, str) else tags
        for e in reversed(self.open):
            if e.tag in tags:
                return True
            if e.tag in scope:
                return False
        return False

    def pop_to(self, tags) -> None:
        tags = {tags} if isinstance(tags, str) else tags
        while len(self.open) > 1:
            if self.open.pop().tag in tags:
                return

    def implied(self, but: str = "") -> None:
        while self.top().tag in IMPLIED_END and self.top().tag != but:
            self.open.pop()

    def close_p(self) -> None:
        if self.has("p", BUTTON_SCOPE):
            self.implied("p")
            self.pop_to("p")

    # insertion

    def place(self) -> tuple[Element, int]:
        """Where the next node goes: into the current node, or before the table that fosters it out."""
        if self.foster and self.top().tag in TABLE_PARTS:
            for k in range(len(self.open) - 1, -1, -1):
                if self.open[k].tag == "table":
                    table = self.open[k]
                    if table.up is not None:
                        return table.up, next(i for i, x in enumerate(table.up.kids) if x is table)
                    return self.open[k - 1], len(self.open[k - 1].kids)
            return self.open[0], len(self.open[0].kids)
        return self.top(), len(self.top().kids)

    def insert(self, tag: str, attrs: dict[str, str]) -> Element:
        e = Element(tag, attrs)
        at, i = self.place()
        at.kids.insert(i, e)
        e.up = at
        self.open.append(e)
        return e

    def write(self, text: str) -> None:
        at, i = self.place()
        if i > 0 and isinstance(at.kids[i - 1], str):
            at.kids[i - 1] += text
        else:
            at.kids.insert(i, text)

    def start_body(self) -> None:
        if self.body is None:
            if self.head is None:
                self.head = Element("head")
                self.root.kids.append(self.head)
                self.head.up = self.root
            self.open = [self.root]
            self.head_open = False
            self.body = self.insert("body", {})

    # active formatting elements

    def reconstruct(self) -> None:
        f = self.formatting
        if not f or f[-1] is None or f[-1] in self.open:
            return
        k = len(f) - 1
        while k > 0 and f[k - 1] is not None and f[k - 1] not in self.open:
            k -= 1
        for i in range(k, len(f)):
            f[i] = self.insert(f[i].tag, dict(f[i].attrs))

    def remember(self, e: Element) -> None:
        same = []
        for x in reversed(self.formatting):
            if x is None:
                break
            if x.tag == e.tag and x.attrs == e.attrs:
                same.append(x)
        if len(same) >= 3:
            self.formatting.remove(same[-1])
        self.formatting.append(e)

    def forget_to_marker(self) -> None:
        while self.formatting and self.formatting.pop() is not None:
            pass

    def adopt(self, tag: str) -> bool:
        """End tag of a formatting element. False: treat it as any other end tag."""
        if self.top().tag == tag and self.top() not in self.formatting:
            self.open.pop()
            return True
        for _ in range(8):
            e = None
            for x in reversed(self.formatting):
                if x is None:
                    break
                if x.tag == tag:
                    e = x
                    break
            if e is None:
                return False
            if e not in self.open:
                self.formatting.remove(e)
                return True
            k = self.open.index(e)
            if any(x.tag in SCOPE for x in self.open[k + 1 :]):
                return True
            far = next((i for i in range(k + 1, len(self.open)) if self.open[i].tag in SPECIAL), None)
            if far is None:
                del self.open[k:]
                self.formatting.remove(e)
                return True
            block, above, mark = self.open[far], self.open[k - 1], self.formatting.index(e)
            last, at, inner = block, far, 0
            while True:
                inner += 1
                at -= 1
                node = self.open[at]
                if node is e:
                    break
                if inner > 3 and node in self.formatting:
                    if self.formatting.index(node) < mark:
                        mark -= 1
                    self.formatting.remove(node)
                if node not in self.formatting:
                    del self.open[at]
                    continue
                copy = Element(node.tag, dict(node.attrs))
                self.formatting[self.formatting.index(node)] = copy
                self.open[at] = copy
                if last is block:
                    mark = self.formatting.index(copy) + 1
                self.move(last, copy)
                last = copy
            if above.tag in TABLE_PARTS:
                kept, self.foster = self.foster, True
                stack, self.open = self.open, self.open[: self.open.index(above) + 1]
                to, i = self.place()
                self.open, self.foster = stack, kept
                self.detach(last)
                to.kids.insert(min(i, len(to.kids)), last)
                last.up = to
            else:
                self.move(last, above)
            copy = Element(e.tag, dict(e.attrs))
            for kid in block.kids:
                if not isinstance(kid, str):
                    kid.up = copy
            copy.kids, block.kids = block.kids, [copy]
            copy.up = block
            old = self.formatting.index(e)
            self.formatting.remove(e)
            self.formatting.insert(mark - (old < mark), copy)
            self.open.remove(e)
            self.open.insert(self.open.index(block) + 1, copy)
        return True

    @staticmethod
    def detach(e: Element) -> None:
        if e.up is not None:
            e.up.kids = [x for x in e.up.kids if x is not e]

    def move(self, e: Element, to: Element) -> None:
        self.detach(e)
        to.kids.append(e)
        e.up = to

    # tokens

    def text(self, t: str) -> None:
        if self.skip_newline:
            self.skip_newline = False
            t = t.removeprefix("\n")
        if self.body is None:
            if not self.head_open or self.top().tag in ("html", "head"):
                rest = t.lstrip(BLANK)
                if self.head is not None and len(rest) < len(t):
                    self.write(t[: len(t) - len(rest)])
                if not rest:
                    return
                t = rest
            self.start_body()
        t = t.replace("\0", "")
        if not t:
            return
        if self.top().tag in TABLE_PARTS:
            if t.strip(BLANK):
                self.foster = True
                self.reconstruct()
                self.write(t)
                self.foster = False
            else:
                self.write(t)
            return
        if self.top().tag == "colgroup":
            if not t.strip(BLANK):
                self.write(t)
                return
            self.open.pop()
            self.text(t)
            return
        self.reconstruct()
        self.write(t)

    def raw(self, t: str) -> None:
        if self.skip_newline:
            self.skip_newline = False
            t = t.removeprefix("\n")
        at = self.top()
        if t:
            at.kids.append(t)

    def start(self, tag: str, attrs: dict[str, str], closed: bool) -> None:
        self.skip_newline = False
        if tag == "html":
            for k, v in attrs.items():
                self.root.attrs.setdefault(k, v)
            return
        if self.body is None:
            if tag == "head":
                if self.head is None:
                    self.head = self.insert("head", attrs)
                    self.head_open = True
                return
            if tag in IN_HEAD:
                if self.head is None:
                    self.head = self.insert("head", {})
                    self.head_open = True
                into = self.top() if self.top().tag == "template" else self.head
                e = Element(tag, attrs)
                into.kids.append(e)
                e.up = into
                if tag not in VOID:
                    self.open.append(e)
                return
            if tag == "body":
                self.start_body()
                self.body.attrs.update(attrs)
                return
            self.start_body()
        if tag in ("head", "frame", "frameset"):
            return
        if tag == "body":
            for k, v in attrs.items():
                self.body.attrs.setdefault(k, v)
            return
        if any(e.tag in ("svg", "math") for e in self.open):
            if tag not in BREAKOUT:
                self.insert(tag, attrs)
                if closed:
                    self.open.pop()
                return
            while self.top().tag not in ("svg", "math") and any(e.tag in ("svg", "math") for e in self.open):
                self.open.pop()
            while self.top().tag in ("svg", "math"):
                self.open.pop()
        if any(e.tag == "select" for e in self.open[-6:]) and tag not in ("option", "optgroup", "script", "template"):
            if tag not in ("select", "input", "keygen", "textarea", "table", "caption", "tbody", "tfoot", "thead", "tr", "td", "th"):
                return
            self.pop_to("select")
            if tag == "select":
                return
        if self.in_table(tag, attrs):
            return
        self.foster = self.top().tag in TABLE_PARTS
        self.in_body(tag, attrs, closed)
        self.foster = False

    def clear_to(self, tags) -> None:
        while self.top().tag not in tags and self.top().tag not in ("html", "template"):
            self.open.pop()

    def end_cell(self) -> None:
        if self.has(CELLS, TABLE_SCOPE):
            self.implied()
            self.pop_to(CELLS)
            self.forget_to_marker()

    def end_caption(self) -> None:
        if self.has("caption", TABLE_SCOPE):
            self.implied()
            self.pop_to("caption")
            self.forget_to_marker()

    def in_table(self, tag: str, attrs: dict[str, str]) -> bool:
        """Start tags that tables have rules for; True if this was one."""
        if tag not in ("caption", "colgroup", "col", "tbody", "tfoot", "thead", "tr", "td", "th", "table"):
            return False
        if not self.has("table", TABLE_SCOPE):
            return tag != "table"  # parts outside a table are dropped
        if tag == "table":
            if self.top().tag in TABLE_PARTS or self.top().tag == "colgroup":
                self.pop_to("table")
            return False
        self.end_caption()
        if self.top().tag == "colgroup" and tag != "col":
            self.open.pop()
        self.end_cell()
        if tag in CELLS:
            if not self.has("tr", TABLE_SCOPE):
                self.in_table("tr", {})
            self.clear_to({"tr"})
            self.insert(tag, attrs)
            self.formatting.append(None)
            return True
        if self.has("tr", TABLE_SCOPE):
            self.clear_to({"tr"})
            self.open.pop()
        if tag == "tr":
            if not self.has(SECTIONS, TABLE_SCOPE):
                self.in_table("tbody", {})
            self.clear_to(SECTIONS)
            self.insert(tag, attrs)
            return True
        if tag == "col":
            if self.top().tag != "colgroup":
                self.in_table("colgroup", {})
            self.insert(tag, attrs)
            self.open.pop()
            return True
        self.clear_to({"table"})
        self.insert(tag, attrs)
        if tag == "caption":
            self.formatting.append(None)
        return True

    def in_body(self, tag: str, attrs: dict[str, str], closed: bool) -> None:
        if tag in ENDS_P:
            self.close_p()
            if tag == "form" and self.has("form", frozenset()):
                return
            self.insert(tag, attrs)
            if tag == "hr":
                self.open.pop()
            self.skip_newline = tag in ("pre", "listing")
        elif tag in HEADINGS:
            self.close_p()
            if self.top().tag in HEADINGS:
                self.open.pop()
            self.insert(tag, attrs)
        elif tag in ("li", "dd", "dt"):
            ends = {"li"} if tag == "li" else {"dd", "dt"}
            for e in reversed(self.open):
                if e.tag in ends:
                    self.implied(e.tag)
                    self.pop_to(e.tag)
                    break
                if e.tag in SPECIAL and e.tag not in ("address", "div", "p"):
                    break
            self.close_p()
            self.insert(tag, attrs)
        elif tag == "button":
            if self.has("button"):
                self.implied()
                self.pop_to("button")
            self.reconstruct()
            self.insert(tag, attrs)
        elif tag in FORMATTING:
            if tag == "a":
                for x in reversed(self.formatting):
                    if x is None:
                        break
                    if x.tag == "a":
                        self.adopt("a")
                        if x in self.formatting:
                            self.formatting.remove(x)
                        if x in self.open:
                            self.open.remove(x)
                        break
            self.reconstruct()
            if tag == "nobr" and self.has("nobr"):
                self.adopt("nobr")
                self.reconstruct()
            self.remember(self.insert(tag, attrs))
        elif tag in ("applet", "marquee", "object"):
            self.reconstruct()
            self.insert(tag, attrs)
            self.formatting.append(None)
        elif tag in ("param", "source", "track"):
            self.insert(tag, attrs)
            self.open.pop()
        elif tag in VOID or tag == "image":
            if tag not in ("base", "basefont", "bgsound", "link", "meta"):
                self.reconstruct()
            self.insert("img" if tag == "image" else tag, attrs)
            self.open.pop()
        elif tag in RAW or tag in ESCAPABLE:
            self.insert(tag, attrs)
            self.skip_newline = tag == "textarea"
        elif tag in ("optgroup", "option"):
            if self.top().tag == "option":
                self.open.pop()
            self.reconstruct()
            self.insert(tag, attrs)
        elif tag in ("rb", "rtc", "rp", "rt"):
            if self.has("ruby"):
                self.implied("rtc" if tag in ("rp", "rt") else "")
            self.insert(tag, attrs)
        else:
            self.reconstruct()
            self.insert(tag, attrs)
            if closed and tag in ("svg", "math"):
                self.open.pop()

    def end(self, tag: str) -> None:
        self.skip_newline = False
        if self.top().tag in RAW | ESCAPABLE and self.top().tag == tag:
            self.open.pop()
            return
        if self.body is None:
            if tag == "head":
                while len(self.open) > 1:
                    self.open.pop()
                self.head_open = False
                if self.head is None:
                    self.head = Element("head")
                    self.root.kids.append(self.head)
                    self.head.up = self.root
            elif tag == "template" and self.has("template", frozenset()):
                self.pop_to("template")
            elif tag in ("body", "html", "br"):
                self.start_body()
                if tag == "br":
                    self.start("br", {}, False)
            return
        if tag in ("body", "html"):
            return  # what follows still belongs to the body
        if tag in ("caption", "table", "tbody", "tfoot", "thead", "tr", "td", "th"):
            if not self.has(tag, TABLE_SCOPE):
                return
            if tag in CELLS:
                self.implied()
                self.pop_to(tag)
                self.forget_to_marker()
                return
            if tag == "caption":
                self.end_caption()
                return
            self.end_caption()
            self.end_cell()
            self.pop_to(tag)
            return
        if tag == "colgroup":
            if self.top().tag == "colgroup":
                self.open.pop()
            return
        if tag == "p":
            if not self.has("p", BUTTON_SCOPE):
                self.foster = self.top().tag in TABLE_PARTS
                self.insert("p", {})
                self.foster = False
            self.implied("p")
            self.pop_to("p")
        elif tag == "br":
            self.start("br", {}, False)
        elif tag == "li":
            if self.has("li", LIST_SCOPE):
                self.implied("li")
                self.pop_to("li")
        elif tag in ("dd", "dt"):
            if self.has(tag):
                self.implied(tag)
                self.pop_to(tag)
        elif tag in HEADINGS:
            if self.has(HEADINGS):
                self.implied()
                self.pop_to(HEADINGS)
        elif tag in FORMATTING:
            if not self.adopt(tag):
                self.other_end(tag)
        elif tag in ("applet", "marquee", "object"):
            if self.has(tag):
                self.implied()
                self.pop_to(tag)
                self.forget_to_marker()
        elif tag in ENDS_P or tag in ("button",):
            if self.has(tag):
                self.implied()
                self.pop_to(tag)
        elif tag == "select":
            if any(e.tag == "select" for e in self.open):
                self.pop_to("select")
        else:
            self.other_end(tag)

    def other_end(self, tag: str) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                self.implied(tag)
                del self.open[min(k, len(self.open)) :]
                return
            if self.open[k].tag in SPECIAL:
                return


def parse(source: str) -> Element:
    """The html element of a document."""
    b = Builder()
    for t in tokens(source):
        if t[0] == "text":
            b.text(t[1])
        elif t[0] == "raw":
            b.raw(t[1])
        elif t[0] == "start":
            b.start(t[1], t[2], t[3])
        else:
            b.end(t[1])
    b.start_body()
    return b.root
