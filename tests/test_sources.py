"""Front ends: literals with pinned outcomes."""

import pytest

from vellumspark.functions import css_values as V
from vellumspark.operators.partition import Partition
from vellumspark.operators.tree import Node, TreeError, from_html
from vellumspark.sources import css, html, markdown


def dom(e):
    return e if isinstance(e, str) else f"<{e.tag}>" + "".join(map(dom, e.kids)) + f"</{e.tag}>"


def body(source):
    text = dom(html.parse(source))
    return text[text.index("<body>") + 6 : -len("</body></html>")]


def flat(node: Node):
    return [(n.kind, n.text) for n in walk(node) if n.text]


def walk(node):
    yield node
    for k in node.kids:
        yield from walk(k)


@pytest.mark.parametrize(
    ("source", "expected"),
    [
        ("<p>a<p><b>x<br><p>y", "<p>a</p><p><b>x<br></br></b></p><p><b>y</b></p>"),
        ("<p>1<b>2<i>3</b>4</i>5</p>", "<p>1<b>2<i>3</i></b><i>4</i>5</p>"),
        ("<b>1<p>2</b>3</p>", "<b>1</b><p><b>2</b>3</p>"),
        ("<table><tr><td>a<td>b<b>x</table>c", "<table><tbody><tr><td>a</td><td>b<b>x</b></td></tr></tbody></table>c"),
        ("<table>foo<tr><td>x</table>", "foo<table><tbody><tr><td>x</td></tr></tbody></table>"),
        ("<ul><li>a<li>b<ul><li>c</ul></ul>", "<ul><li>a</li><li>b<ul><li>c</li></ul></li></ul>"),
        ("<a>q<a>w", "<a>q</a><a>w</a>"),
        ("a &lt; b &amp c <3 </> <!-- x --> &notit;", "a < b & c <3   ¬it;"),
        ("<p><b><b><b><b>x</p>y", "<p><b><b><b><b>x</b></b></b></b></p><b><b><b>y</b></b></b>"),
    ],
)
def test_tree_construction(source, expected):
    assert body(source) == expected


def test_metadata():
    tree, reading = from_html('<html lang="de"><title> a &amp;\n b </title><style>p{}</style><body><script>var t="</p>"</script><p>x')
    assert (reading.title, reading.lang, reading.sheets) == ("a &\n b", "de", ["p{}"])
    assert flat(tree) == [("transparent", "x")]


@pytest.mark.parametrize(
    ("source", "expected"),
    [
        ("<p>  a\n\n   b  <em>  c  </em>  </p>", ["a b ", "c"]),
        ("<p>Hello<em> world</em></p>", ["Hello", " world"]),
        ("<p>a b  c</p>", ["a b c"]),
        ("<p>a <br> b</p>", ["a", "b"]),
    ],
)
def test_white_space(source, expected):
    assert [t for _, t in flat(from_html(source)[0])] == expected


def test_no_phantom_paragraph_and_images_part_paragraphs():
    assert [k.kind for k in from_html("<body>\n<h1>x</h1>\n\n<p>y</p>\n</body>")[0].kids] == ["heading", "paragraph"]
    kids = from_html('<p>a <img src="x.png" alt="pic"> b</p>')[0].kids
    assert [k.kind for k in kids] == ["paragraph", "image", "paragraph"]
    image = markdown.parse("[![alt](img.png)](https://e.test)").kids[0]
    assert (image.kind, image.src, image.alt, image.href) == ("image", "img.png", "alt", "https://e.test")
    assert [k.kind for k in from_html("<table><caption>c</caption><tr><td>1</table>")[0].kids[0].kids] == ["caption", "table_row"]


@pytest.mark.parametrize(
    ("source", "kinds"),
    [
        ("# T\n\nx *y* **z** `c`", {"heading", "paragraph", "emphasis", "strong", "inline_code"}),
        ("- a\n- b\n\n1. c", {"unordered_list", "ordered_list", "list_item"}),
        ("> q\nlazy", {"quote", "paragraph"}),
        ("| a |\n|---|\n| b |", {"table", "table_row", "table_cell"}),
        ("a\n===\n\n***\n\n    code", {"heading", "rule", "code_block"}),
        ("a  \nb\\\nc", {"paragraph", "hard_break"}),
    ],
)
def test_markdown_kinds(source, kinds):
    assert {n.kind for n in walk(markdown.parse(source))} - {"document", "transparent"} == kinds


def test_markdown_text():
    text = lambda s: "".join(n.text for n in walk(markdown.parse(s)))
    assert text("word*** ### &&& a | b") == "word*** ### &&& a | b"
    assert text("<div>\nx\n</div>\n\na <b>c</b>") == "a <b>c</b>"
    assert markdown.parse("```\nfn main() {}\n```").kids[0].text == "fn main() {}\n"
    assert markdown.parse("3. third\n4. fourth").kids[0].start == 3
    assert [k.kind for k in markdown.parse("- a\n\n- b").kids[0].kids[0].kids] == ["paragraph"]
    assert [k.kind for k in markdown.parse("- a\n- b").kids[0].kids[0].kids] == ["transparent"]


def test_deep_nesting_is_an_error_or_valid():
    for source in ("> " * 200 + "x", "<div class=a>" * 300):
        try:
            (markdown.parse if source[0] == ">" else from_html)(source)
        except TreeError:
            pass


def test_css():
    sheet = css.stylesheet("/* c */ h1, .a#b p { color: #369; ; font-family: 'X;Y' }")
    assert [[s.specificity() for s in c] for c in sheet[0].selectors] == [[(0, 0, 1)], [(1, 1, 0), (0, 0, 1)]]
    assert sheet[0].declarations == [("color", "#369"), ("font-family", "'X;Y'")]
    for bad in ("p { color: ", "p > a {}", "a.b#c#d {}", "p { color }", "p { color: ; }", "@media x {}", "/* x"):
        with pytest.raises(css.CssError):
            css.stylesheet(bad)
    assert css.stylesheet("{color: red}")[0].selectors == [[css.Simple(None, None, ())]]


@pytest.mark.parametrize(
    ("name", "text", "expected"),
    [
        ("font-size", "2rem", None), ("font-size", "0", V.Value(0.0, "px")), ("margin-top", "1.5em", V.Value(1.5, "em")), ("line-height", "24px", V.Value(24.0)), ("line-height", "12pt", None),
        ("color", "#36c", V.Value(code=0x3366CCFF)), ("color", "#11223344", V.Value(code=0x11223344)), ("color", "rgb(1,2,3)", None), ("font-family", "serif, 'A B', C", V.Value(word="A B")),
        ("font-family", "sans-serif", None), ("font-weight", "450", None), ("font-weight", "BOLD", V.Value(code=700)), ("white-space", "pre-wrap", V.Value(code=1)), ("margin", "0", None),
    ],
)
def test_values(name, text, expected):
    assert V.declared(name, text) == expected


def chunks(source, kind="html"):
    p = Partition(from_html(source)[0] if kind == "html" else markdown.parse(source))
    return [(c["kind"], c["parent_id"]) for c in p.chunks], p


def test_partition():
    assert len(chunks("# Title\n\nHello *world*!", "markdown")[0]) == 7
    assert chunks("", "markdown")[0] == [("document", 0)]
    _, p = chunks("3. third\n4. fourth", "markdown")
    assert [(x["kind"], x["a"]) for x in p.extras] == [("list_item_value", 3), ("list_item_value", 4)]
    _, p = chunks("[a *b* c](https://e.test)", "markdown")
    assert [(x["kind"], x["chunk_id"], x["text"]) for x in p.extras] == [("link_target", k, "https://e.test") for k in (3, 4, 5)]
    got, _ = chunks("<ul><li>a <b>b</b><p>c</ul>")
    assert [k for k, _ in got] == ["document", "list", "list_item", "paragraph", "run", "run", "paragraph", "run"]
    got, _ = chunks("<div class=a><div class=b><p>x</p><p>y</p></div></div>")
    assert [k for k, _ in got] == ["document", "paragraph", "run", "run"]
    got, p = chunks("<table><tr><td colspan=3>x</table>")
    assert [k for k, _ in got] == ["document", "table", "table_row", "table_cell", "paragraph", "run"] and p.extras[0]["a"] == 3
