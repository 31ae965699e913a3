"""The compile plan, packages, validation and the queries against their SQL."""

import os

import duckdb
import pandas as pd
import pytest

from vellumspark.plans import packages as K
from vellumspark.plans import queries as Q
from vellumspark.plans.compile import Corpus
from vellumspark.sources import package as P

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
DOCS = [
    (1, "markdown", "# Title\n\nHello *world*!"),
    (2, "html", '<style>.red{color:red} li li {color: lime} p .red {margin-top:50%}</style><p>a <span class="red">b</span> c</p><ul><li>x<li style="margin-top:2em">y</ul>'),
    (3, "markdown", ""),
    (4, "html", "<style>p{</style>x"),
    (5, "html", None),
    (6, "html", '<p style="line-height:24px; font-size: 200%"><span style="font-size:2em">q</span><p>q<p hidden>q'),
    (7, "html", "<blockquote><ul><li>q</ul></blockquote>"),
    (8, "html", "<style>li li {color: lime}</style><li>z"),
]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    docs = spark.createDataFrame(DOCS, "doc_id long, kind string, source string")
    return docs, Corpus(docs, css=["h1 { text-align: center }"], keep=f"file://{tmp_path_factory.mktemp('p')}/parsed")


def test_report(corpus):
    got = {r["doc_id"]: r for r in corpus[1].report.collect()}
    assert (got[1]["chunk_count"], got[1]["style_count"], got[1]["content_count"], got[1]["atlas_count"]) == (7, 4, 4, 3)
    assert got[3]["chunk_count"] == 1 and got[3]["atlas_count"] == 0
    assert got[4]["error"].startswith("css: ") and got[5]["error"] == "no source"


def test_links_and_styles(corpus):
    rows = {r["chunk_id"]: r for r in corpus[1].chunks.where("doc_id = 1").collect()}
    assert (rows[1]["first_child_id"], rows[1]["last_child_id"]) == (2, 4)
    assert (rows[2]["next_id"], rows[4]["prev_id"], rows[6]["depth"], rows[7]["content_index"]) == (4, 2, 2, 4)
    styles = {(r["doc_id"], r["style_id"]): r for r in corpus[1].styles.collect()}
    of = lambda doc, text: styles[doc, next(r["style_id"] for r in corpus[1].chunks.where(f"doc_id = {doc}").collect() if r["text"] == text)]
    assert of(2, "b")["color"] == 0xFF0000FF and of(2, "b")["margin_top"] == 8.0
    assert of(2, "x")["color"] == 0x000000FF and of(8, "z")["color"] == 0x00FF00FF  # a bare item is its own ancestor
    assert of(2, "y")["margin_top"] == 32.0
    assert of(1, "Title")["text_align"] == 1 and of(1, "Title")["font_size_px"] == 32.0
    q = [r for r in corpus[1].chunks.where("doc_id = 6 and kind = 'run'").orderBy("chunk_id").collect()]
    assert styles[6, q[0]["style_id"]]["font_size_px"] == 64.0 and styles[6, q[0]["style_id"]]["line_height"] == 24.0
    assert len({r["content_index"] for r in q}) == 1
    assert [r["flags"] for r in corpus[1].chunks.where("doc_id = 6 and kind = 'paragraph'").orderBy("chunk_id").collect()] == [0, 0, 1]


def test_packages(corpus, spark, tmp_path):
    docs, c = corpus
    packed = K.pack(c, docs)
    packed.write.parquet(f"file://{tmp_path}/packed")
    packed = spark.read.parquet(f"file://{tmp_path}/packed")
    got = {r["doc_id"]: r for r in packed.collect()}
    assert got[4]["bytes"] is None and got[4]["error"].startswith("css")
    issues = {(r["doc_id"], r["section"], r["message"]) for r in K.validate(packed).collect()}
    assert (7, "CHNK", "chunk 3: list in quote") in issues
    assert (1, "GLYF", "document contains text but no glyph atlas") in issues
    assert not [i for i in issues if i[0] == 3]
    report = {(r["topic"], r["name"]): r["n"] for r in K.inspect(packed).where("doc_id = 2").collect()}
    assert report["chunks", "list_item"] == 2 and report["content", "text bytes"] == 7
    data = bytes(got[1]["bytes"])
    _, payloads = P.parse(data)
    chunks, _ = P.decode_chunks(payloads[2])
    assert [c["kind"] for c in chunks] == ["document", "heading1", "run", "paragraph", "run", "run", "run"]
    for i in range(len(data)):
        with pytest.raises(P.PackageError):
            P.parse(data[:i])
        flipped = bytearray(data)
        flipped[i] ^= 0x55
        try:
            P.parse(bytes(flipped))
        except P.PackageError:
            pass


def test_container_rules():
    info = P.encode_info({k: 1 for k in P.INFO_NUMBERS} | {k: "ab" for k in P.INFO_TEXTS})
    assert P.decode_info(info)["document_id"] == "ab"
    ok = P.build([("INFO", info), (99, b"later")])
    assert P.parse(ok)[1][99] == b"later"
    with pytest.raises(P.PackageError, match="unknown_critical"):
        P.parse(P.build([("INFO", info), (99, b"later")], critical=True))
    with pytest.raises(P.PackageError, match="missing_section"):
        P.parse(P.build([("CONT", P.encode_content([]))]))
    with pytest.raises(P.PackageError, match="duplicate"):
        P.build([("INFO", info), ("INFO", info)])


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    got = Q.QUERIES[name](spark, DATA).toPandas()
    want = con.sql(Q.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda df: sorted(tuple("" if pd.isna(v) else str(int(v)) if isinstance(v, float) and v.is_integer() else str(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))
    assert rows(got) == rows(want)


def test_all_dangling_references(spark):
    part, items = (pd.read_parquet(f"{DATA}/{t}.parquet") for t in ("part", "lineitem"))
    there = set(part.p_partkey[part.p_size > 10])
    want = items[items.l_partkey.notna() & ~items.l_partkey.isin(there)]
    got = Q.QUERIES["dangling_refs"](spark, DATA).collect()
    assert (want.l_partkey % 7 != 0).any()
    assert sorted(map(tuple, got)) == sorted(zip(want.l_orderkey, want.l_linenumber))


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.ORACLES)))
def test_query_has_rows(spark, name):
    assert Q.QUERIES[name](spark, DATA).limit(5).count() > 0


def test_tree_issues(spark):
    from vellumspark.operators.shape import tree_issues

    docs = spark.createDataFrame([(1, "html", "<p>ok <b>x</b></p><ul><li><p>y</ul>"), (2, "html", "<blockquote><p>a</p></blockquote><table><caption>c</caption><tr><td><p>z</table>"), (3, "markdown", "# T")], "doc_id long, kind string, source string")
    got = {(r["doc_id"], r["issue"]) for r in tree_issues(Corpus(docs).nodes).collect()}
    assert got == {(2, "caption in table"), (2, "paragraph in table_cell")}


def test_images(spark, tmp_path):
    from .test_atlas import png

    from vellumspark.plans import images

    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.png").write_bytes(png(4, 2, 3, b"\0" * 26))
    (tmp_path / "bad.png").write_bytes(b"\x89PNG\r\n\x1a\n")
    docs = spark.createDataFrame([(1, "markdown", "![one](a/x.png) ![two](none.png)"), (2, "html", "<img src=a/x.png><img src=bad.png>")], "doc_id long, kind string, source string")
    rows = images.load(Corpus(docs), images.read_folder(spark, f"file://{tmp_path}")).collect()
    got = {(r["doc_id"], r["image_id"]): (r["width"], r["error"]) for r in rows}
    assert got == {(1, 0): (4, None), (1, 1): (None, "image not found: none.png"), (2, 0): (4, None), (2, 1): (None, "decode failed")}
