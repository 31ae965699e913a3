"""The semantic tree of one document, and its clean-up: what both front ends hand on."""

from __future__ import annotations

from vellumspark.functions.text import collapse, nfc, trim
from vellumspark.sources import html as html_source

MAX_DEPTH, MAX_CHILDREN = 128, 1 << 20

INLINE = frozenset({"link", "emphasis", "strong", "inline_code", "soft_break", "hard_break"})
BLOCK = frozenset(
    {"heading", "paragraph", "quote", "ordered_list", "unordered_list", "list_item", "code_block", "table", "table_row", "table_cell", "image", "caption", "rule"}
)
BREAKS = frozenset({"soft_break", "hard_break"})
FLOWING = INLINE | {"transparent"}

# Which element is which kind, and what is no prose.
KINDS = {
    **{f"h{k}": "heading" for k in range(1, 7)},
    "p": "paragraph", "blockquote": "quote", "ul": "unordered_list", "ol": "ordered_list", "li": "list_item", "pre": "code_block",
    "table": "table", "tr": "table_row", "th": "table_cell", "td": "table_cell", "img": "image", "figcaption": "caption",
    "caption": "caption", "a": "link", "em": "emphasis", "i": "emphasis", "strong": "strong", "b": "strong", "code": "inline_code",
    "br": "hard_break", "hr": "rule",
}
NO_PROSE = frozenset(
    "script noscript meta link base form input button select textarea option iframe svg canvas audio video embed object template dialog math".split()
)


class TreeError(ValueError):
    pass


class Node:
    __slots__ = ("alt", "classes", "colspan", "hidden", "href", "id", "inline", "kids", "kind", "level", "rowspan", "src", "start", "text")

    def __init__(self, kind: str, text: str = "", kids: list[Node] | None = None, **more):
        self.kind, self.text, self.kids = kind, text, kids if kids is not None else []
        self.level, self.href, self.src, self.alt, self.start = 0, None, None, None, None
        self.colspan = self.rowspan = 1
        self.classes, self.id, self.inline, self.hidden = [], None, None, False
        for k, v in more.items():
            setattr(self, k, v)

    def like(self) -> Node:
        """An empty node of the same kind and hints."""
        return Node(self.kind, level=self.level, classes=list(self.classes), id=self.id, inline=self.inline, hidden=self.hidden)

    def display(self) -> str:
        return (self.text if self.kind in FLOWING else "") + "".join(k.display() for k in self.kids)


def whole(text: str | None, bits: int) -> int | None:
    """An unsigned whole number of so many bits, as a program reads one: digits, at most one plus sign before them."""
    if text is None:
        return None
    digits = text.removeprefix("+")
    return int(digits) if digits.isascii() and digits.isdigit() and int(digits) < 1 << bits else None


class Reading:
    """What a document says about itself besides its content."""

    def __init__(self):
        self.title: str | None = None
        self.lang: str | None = None
        self.sheets: list[str] = []

    def kids(self, e: html_source.Element, depth: int) -> list[Node]:
        out: list[Node] = []
        for k in e.kids:
            if depth >= MAX_DEPTH:
                raise TreeError("tree too deep")
            if isinstance(k, str):
                text = collapse(k)
                if text:
                    out.append(Node("transparent", text))
            else:
                out += self.element(k, depth + 1)
            if len(out) > MAX_CHILDREN:
                raise TreeError("too many children")
        return out

    def element(self, e: html_source.Element, depth: int) -> list[Node]:
        tag, a = e.tag, e.attrs
        if tag == "title":
            if trim(e.text()):
                self.title = nfc(trim(e.text()))
            return []
        if tag == "style":
            self.sheets.append(e.text())
            return []
        if tag == "html" and "lang" in a:
            self.lang = a["lang"]
        if tag in NO_PROSE:
            return []
        if tag == "head":
            self.kids(e, depth)
            return []
        kids = self.kids(e, depth)
        kind = KINDS.get(tag, "transparent")
        if kind in ("hard_break", "rule"):
            return [Node(kind)]
        node = Node(kind, classes=list(dict.fromkeys(a.get("class", "").split())), id=a.get("id"), inline=a.get("style"), hidden="hidden" in a)
        if kind == "image":
            node.src = a.get("src")
            node.alt = nfc(a["alt"]) if "alt" in a else None
            return [node]
        if kind == "code_block":
            node.text = nfc(e.text())
            return [node]
        node.kids = kids
        if kind == "heading":
            node.level = int(tag[1])
        elif kind == "link":
            node.href = a.get("href")
        elif kind == "table_cell":
            node.colspan = max(1, whole(a.get("colspan"), 32) or 1)
            node.rowspan = max(1, whole(a.get("rowspan"), 32) or 1)
        elif kind == "ordered_list":
            node.start = whole(a.get("start"), 64)
        return [node]


def splice_wrappers(node: Node) -> None:
    """Containers without a class, id or style, like body or a bare div, give their children to their parent."""
    out: list[Node] = []
    for k in node.kids:
        splice_wrappers(k)
        if k.kind == "transparent" and not k.classes and k.id is None and k.inline is None and not k.text:
            out += k.kids
        else:
            out.append(k)
    node.kids = out


def from_html(source: str, fold: bool = True) -> tuple[Node, Reading]:
    """The tree of a page. fold: white space is folded and images stand where blocks do."""
    reading = Reading()
    root = html_source.parse(source)
    tree = Node("document", kids=reading.element(root, 1))
    splice_wrappers(tree)
    normalise_leaves(tree)
    return finish(tree) if fold else tree, reading


def normalise_leaves(node: Node) -> None:
    node.text = nfc(node.text)
    for k in node.kids:
        normalise_leaves(k)


def finish(tree: Node) -> Node:
    fold_white_space(tree)
    tree.kids = hoist(tree.kids)
    return tree


# White space, as browsers show it: the flowing content of a block is a line of leaves, parted by breaks and images.


def leaves(node: Node, out: list[Node | None]) -> list[Node | None]:
    """The leaves with text of a block's flowing content, in order; None is a line's end."""
    for k in node.kids:
        if k.kind in BREAKS or k.kind == "image":
            out.append(None)
        elif k.kind in FLOWING:
            if k.kids:
                leaves(k, out)
            elif k.text:
                out.append(k)
    return out


def fold_white_space(node: Node) -> None:
    for k in node.kids:
        fold_white_space(k)
    if node.kind not in BLOCK and node.kind != "document":
        return
    line = leaves(node, [])
    open_ = True  # a blank would be the first of its line, or follow another
    for i, leaf in enumerate(line):
        if leaf is None:
            open_ = True
            continue
        text = collapse(leaf.text)
        if text[0] == " " and open_:
            text = text[1:]
        if text.endswith(" ") and (i + 1 == len(line) or line[i + 1] is None):
            text = text[:-1]
        leaf.text = text
        if text:
            open_ = text[-1] == " "
    last = next((x for x in reversed(line) if x is not None and x.text), None)
    if last is not None:
        last.text = last.text.removesuffix(" ")
    drop_empty(node)


def drop_empty(node: Node) -> None:
    for k in node.kids:
        drop_empty(k)
    node.kids = [k for k in node.kids if k.kids or k.text or k.kind not in FLOWING or k.kind in BREAKS]


# Images are blocks: they leave the links and paragraphs they stand in.


def pull_images(node: Node) -> list[Node]:
    """Take the images out of a flowing container; one that leaves a link takes its target along."""
    out, kept = [], []
    for k in node.kids:
        if k.kind == "image":
            if node.kind == "link" and k.href is None:
                k.href = node.href
            out.append(k)
        elif k.kind in FLOWING:
            inner = pull_images(k)
            if k.kids or k.text or k.kind in BREAKS:
                kept.append(k)
            out += inner
        else:
            kept.append(k)
    node.kids = kept
    return out


def holds_image(node: Node) -> bool:
    return any(k.kind == "image" or holds_image(k) for k in node.kids)


def part_at_images(block: Node) -> list[Node]:
    """A paragraph, caption or heading as the parts between its images, and these."""
    if not holds_image(block):
        return [block]
    out, part = [], block.like()

    def close() -> None:
        nonlocal part
        if part.kids:
            out.append(part)
            part = block.like()

    for k in block.kids:
        images = [k] if k.kind == "image" else pull_images(k) if k.kind in FLOWING else []
        if k.kind != "image" and (k.kids or k.text or k.kind in BREAKS or k.kind not in FLOWING):
            part.kids.append(k)
        if images:
            close()
            out += images
    close()
    return out


def hoist(kids: list[Node]) -> list[Node]:
    out: list[Node] = []
    for k in kids:
        k.kids = hoist(k.kids)
        if k.kind in ("link", "emphasis", "strong", "inline_code"):
            images = pull_images(k)
            if k.kids or k.text:
                out.append(k)
            out += images
        elif k.kind in ("paragraph", "caption", "heading"):
            out += part_at_images(k)
        else:
            out.append(k)
    return out
