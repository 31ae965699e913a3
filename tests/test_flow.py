import random

from vellumspark.operators.tree import FLOWING
from vellumspark.plans import flow
from vellumspark.plans.compile import Corpus

SOURCES = [
    ("html", "<p>  a\n\n   b  <em>  c  </em>  </p>"), ("html", "<p>Hello<em> world</em></p>"), ("html", "<p>a b  c</p>"), ("html", "<p>a <br> b</p>"), ("html", "<p> <em> </em> <b>x</b> <i> </i></p>"),
    ("html", '<p>a <img src="x.png" alt="pic"> b</p>'), ("html", "<ul><li>one <b>two</b><p>three</p> four<li> <ul><li>x</ul> y </ul>"), ("html", "<div class=k> a <p>b</p> c <i> d</i></div>e<table><tr><td>f<td> <p>g</table>"),
    ("html", "<blockquote>q <b>r</b><p>s</p>t</blockquote>"), ("html", ""), ("markdown", "- a\n- b *c* \n\n  d\n\n> q\nlazy  \nx\n\n| a | b |\n|---|---|\n| c | |"), ("markdown", "![x](y.png) t *u* ![](z.png)\n\n# h *i* "),
]


def pages(rng):
    """Random nests of elements and blanks."""
    out = []
    for _ in range(120):
        parts = []
        for _ in range(rng.randint(1, 14)):
            parts.append(rng.choice(["<p>", "</p>", "<em>", "</em>", "<b>", "</b>", "<br>", " ", "\n ", "a", " b", "c ", " d ", "<li>", "<ul>", "</ul>", "<div class=x>", "</div>", "<img src=i>", "<blockquote>", "</blockquote>", "<td>", "<tr>", "<table>", "</table>", "<a href=q>", "</a>"]))
        out.append(("html", "".join(parts)))
    return out


def docs_of(spark):
    rows = SOURCES + pages(random.Random(5))
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, kind string, source string")


def test_folded_leaves_are_those_of_the_kernel(spark):
    docs = docs_of(spark)
    got = {}
    for r in sorted(flow.folded(flow.raw(docs)).collect(), key=lambda r: (r["doc_id"], r["node_id"])):
        got.setdefault(r["doc_id"], []).append(r["text"])
    want = {}
    for r in Corpus(docs).nodes.where("text <> ''").orderBy("doc_id", "node_id").collect():
        if r["kind"] in FLOWING:
            want.setdefault(r["doc_id"], []).append(r["text"])
    # images move out of what they stand in afterwards, and texts with them; the texts themselves are the same
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert sum(map(len, got.values())) > 120
    assert got[0] == ["a b ", "c"] and got[1] == ["Hello", " world"] and got[3] == ["a", "b"]


def test_paragraphs_are_those_of_the_chunks(spark):
    c = Corpus(docs_of(spark))
    got = {}
    for r in sorted(flow.paragraphs(c.nodes).collect(), key=lambda r: (r["doc_id"], r["node_id"])):
        got.setdefault(r["doc_id"], []).append(r["text"])
    chunks = {}
    for r in c.chunks.orderBy("doc_id", "chunk_id").collect():
        chunks.setdefault(r["doc_id"], {})[r["chunk_id"]] = r
    want = {}
    for doc, by in chunks.items():
        for k, x in by.items():
            if x["kind"] == "paragraph":
                below = lambda i: "".join((y["text"] or "") + below(j) for j, y in by.items() if y["parent_id"] == i)  # noqa: B023, E731
                want.setdefault(doc, []).append(below(k))
    assert got == want and sum(map(len, got.values())) > 60


def test_numbers_of_items_are_those_of_the_extras(spark):
    lists = [("html", "<ol><li>a<p>x</p><li>b<ol start=9><li>c<li>d</ol><li>e</ol><ul><li>f</ul>"), ("html", "<ol start=18446744073709551614><li>a<li>b<li>c</ol>"), ("markdown", "7. a\n8. b\n\n- c\n  1. d")]
    c = Corpus(spark.createDataFrame([(i, *r) for i, r in enumerate(lists)], "doc_id long, kind string, source string"))
    got = sorted((r["doc_id"], r["value"]) for r in flow.list_values(c.nodes).collect())
    want = sorted((r["doc_id"], r["a"]) for r in c.extras.where("kind = 'list_item_value'").collect())
    assert got == want and len(want) == 11
