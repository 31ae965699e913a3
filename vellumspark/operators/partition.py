"""From the semantic tree to chunks: which chunk each node makes, and where its style is asked for.

Styles aren't resolved here. Wherever a chunk, an ancestor or an item's marker needs one, a style request is written down:
the node, the request whose style it inherits, and the chain of nodes that descendant selectors see, nearest first. The plan
matches the requests with the rules as a join. Below some kinds a node stands in its own children's chain twice, and some
nodes ask twice, the second time inheriting from the first; both are part of the results.

Requests that no rule and no inheritance can tell apart share a shape, and styles are worked out for shapes: the items of a long
list are one.
"""

from __future__ import annotations

from .tree import BLOCK, Node

# The code of each chunk kind, those that are structure alone, and the tag that selectors know a node by.
CHUNK_CODES = {
    name: code
    for code, name in enumerate(
        "document heading1 heading2 heading3 heading4 heading5 heading6 paragraph quote list list_item code_block table table_row table_cell image caption run link br hr".split(),
        1,
    )
}
STRUCTURAL = frozenset({"document", "list", "table", "table_row"})
TAGS = {
    "document": "document", "paragraph": "p", "quote": "blockquote", "ordered_list": "ol", "unordered_list": "ul", "list_item": "li",
    "code_block": "pre", "table": "table", "table_row": "tr", "table_cell": "td", "image": "img", "caption": "caption", "link": "a",
    "emphasis": "em", "strong": "strong", "inline_code": "code", "soft_break": "br", "hard_break": "br", "rule": "hr",
}
EXTRA_CODES = {"link_target": 1, "cell_span": 2, "list_item_value": 3, "image_alt": 4}


def tag_of(node: Node) -> str | None:
    return f"h{node.level}" if node.kind == "heading" else TAGS.get(node.kind)


class Partition:
    """Rows of one document: nodes (in pre-order), requests, chunks and extras."""

    def __init__(self, root: Node):
        self.nodes: list[tuple] = []
        self.number: dict[int, int] = {}
        self.requests: list[dict] = []
        self.shapes: list[dict] = []
        self.hints: list[int] = []
        self.known: dict[tuple, int] = {}
        self.chunks: list[dict] = []
        self.extras: list[dict] = []
        self.open: list[int] = []
        self.images = 0
        self.clock = 0
        self.walk(root, -1, ())
        self.block(root, -1, ())
        self.close()

    def walk(self, node: Node, parent: int, path: tuple[int, ...]) -> None:
        me = len(self.nodes)
        self.number[id(node)] = me
        self.nodes.append((me, parent, path, node))
        self.hints.append(self.named("hint", tag_of(node), node.id, tuple(node.classes or ())))
        for i, k in enumerate(node.kids):
            self.walk(k, me, (*path, i))

    def tick(self) -> int:
        self.clock += 1
        return self.clock

    # styles

    def ask(self, node: Node, above: int, chain: tuple[int, ...], keep: bool) -> int:
        """A style request. keep: it takes a place among the document's styles even if no chunk shows it."""
        self.requests.append({"request": len(self.requests), "node": self.number[id(node)], "seq": self.tick() if keep else None, "marks": False, "shape": self.shape(node, above, chain)})
        return len(self.requests) - 1

    def shape(self, node: Node, above: int, chain: tuple[int, ...]) -> int:
        """The number of all that a style depends on: the shape above, what selectors see of the node and of its chain, its inline style and whether it is code."""
        me, code = self.number[id(node)], node.kind in ("inline_code", "code_block")
        over = self.requests[above]["shape"] if above >= 0 else -1
        seen = self.known.get(("chain", chain))
        if seen is None:
            seen = self.known["chain", chain] = self.named("seen", *[self.hints[n] for n in chain])
        key = ("shape", over, self.hints[me], seen, node.inline, code)
        if key not in self.known:
            self.known[key] = len(self.shapes)
            self.shapes.append({"shape": len(self.shapes), "above": over, "node": me, "chain": list(chain), "code": code, "marks": False, "seqs": []})
        return self.known[key]

    def named(self, *key) -> int:
        """A number for what is equal."""
        return self.known.setdefault(key, len(self.known))

    def close(self) -> None:
        """Tell shapes and chunks what their requests came to."""
        for r in self.requests:
            s = self.shapes[r["shape"]]
            s["marks"] |= r["marks"]
            if r["seq"] is not None:
                s["seqs"].append(r["seq"])
        for c in self.chunks:
            r = self.requests[c["request"]] if c["request"] >= 0 else None
            c["shape"], c["asked"] = (r["shape"], r["seq"]) if r else (-1, None)

    def shown(self, request: int) -> int:
        if self.requests[request]["seq"] is None:
            self.requests[request]["seq"] = self.tick()
        return request

    # chunks

    def chunk(self, kind: str, node: Node, request: int, text: str | None = None, image: bool = False) -> int:
        me = len(self.chunks) + 1
        self.chunks.append({
            "chunk_id": me, "kind": kind, "hidden": node.hidden, "parent_id": self.open[-1] if self.open else 0, "depth": len(self.open), "request": request,
            "text": text, "image": self.images if image else None, "src": node.src or "" if image else None, "seq": self.tick() if text is not None or image else None, "node": self.number[id(node)],
        })
        self.images += image
        return me

    def extra(self, chunk: int, kind: str, text: str | None = None, a: int | None = None, b: int | None = None) -> None:
        self.extras.append({"chunk_id": chunk, "kind": kind, "text": text, "a": a, "b": b})

    def inside(self, chunk: int):
        return _Open(self.open, chunk)

    def image(self, node: Node, request: int) -> int:
        me = self.chunk("image", node, request, image=True)
        if node.alt is not None:
            self.extra(me, "image_alt", node.alt)
        if node.href is not None:
            self.extra(me, "link_target", node.href)
        return me

    # the walk: what stands where blocks stand

    def block(self, node: Node, above: int, chain: tuple[int, ...]) -> None:
        me = self.ask(node, above, chain, True)
        own = (self.number[id(node)], *chain)
        twice = (own[0], *own)
        k = node.kind
        if k in ("document", "quote", "table", "table_row"):
            with self.inside(self.chunk(k, node, me)):
                for kid in node.kids:
                    self.block(kid, me, twice)
        elif k in ("heading", "paragraph", "caption"):
            with self.inside(self.chunk(f"heading{node.level}" if k == "heading" else k, node, me)):
                for kid in node.kids:
                    self.inline(kid, me, own)
        elif k == "code_block":
            self.chunk("code_block", node, me, text=node.text or None)
        elif k in ("ordered_list", "unordered_list"):
            with self.inside(self.chunk("list", node, me)):
                value = node.start if node.start is not None else 1
                for kid in node.kids:
                    if kid.kind == "list_item":
                        self.item(kid, me, own, value if k == "ordered_list" else None)
                        value = min(value + 1, (1 << 64) - 1)
                    else:
                        self.block(kid, me, own)
        elif k == "list_item":
            self.item(node, me, own, None)
        elif k == "table_cell":
            cell = self.chunk(k, node, me)
            if node.colspan > 1 or node.rowspan > 1:
                self.extra(cell, "cell_span", a=node.colspan % 65536, b=node.rowspan % 65536)
            with self.inside(cell):
                self.mixed(node, me, own)
        elif k == "image":
            with self.inside(self.image(node, me)):
                for kid in node.kids:
                    self.block(kid, me, twice)
        elif k == "rule":
            self.chunk("hr", node, me)
        elif k == "transparent" and not node.text:
            self.mixed(node, me, chain)
        else:  # flowing content among blocks is a paragraph of its own
            with self.inside(self.chunk("paragraph", node, me)):
                self.inline(node, me, own)

    def item(self, node: Node, above: int, chain: tuple[int, ...], value: int | None) -> None:
        me = self.ask(node, above, chain, True)
        self.requests[me]["marks"] = True
        item = self.chunk("list_item", node, me)
        if value is not None:
            self.extra(item, "list_item_value", a=value % (1 << 32))
        with self.inside(item):
            self.mixed(node, me, (self.number[id(node)], *chain))

    def mixed(self, node: Node, above: int, chain: tuple[int, ...]) -> None:
        """Children where blocks are expected: what flows, between blocks, shares a paragraph, whose flags are its first node's."""
        own = (self.number[id(node)], *chain)
        group: list[Node] = []

        def close() -> None:
            if group:
                with self.inside(self.chunk("paragraph", group[0], above)):
                    for kid in group:
                        self.inline(kid, above, own)
                group.clear()

        for kid in node.kids:
            if kid.kind in BLOCK:
                close()
                self.block(kid, above, own)
            else:
                group.append(kid)
        close()

    # the walk: what stands where text stands

    def inline(self, node: Node, above: int, chain: tuple[int, ...]) -> list[int]:
        """Returns the chunks that a link around this node marks."""
        me = self.ask(node, above, chain, False)
        own = (self.number[id(node)], *chain)
        if node.kind == "image":
            self.shown(me)
            image = self.image(node, me)
            # its place among the contents comes before its style's among the styles; neither order sees the other
            with self.inside(image):
                for kid in node.kids:
                    self.inline(kid, me, own)
            return [image]
        if node.kind == "hard_break":
            self.chunk("br", node, -1)
            return []
        text_first = node.kind == "transparent"
        if node.text and (text_first or not node.kids):
            made = [self.chunk("run", node, self.shown(me), text=node.text)]
        else:
            made = [c for kid in node.kids for c in self.inline(kid, me, own)]
        if node.kind == "link" and node.href is not None:
            for c in made:
                self.extra(c, "link_target", node.href)
        return made


class _Open:
    def __init__(self, stack: list[int], chunk: int):
        self.stack, self.chunk = stack, chunk

    def __enter__(self) -> None:
        self.stack.append(self.chunk)

    def __exit__(self, *_) -> None:
        self.stack.pop()
