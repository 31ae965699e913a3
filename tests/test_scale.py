"""What a plan must not do as tables grow: frames made anew for each row, one task for a small file, long plans and many rows held."""

from vellumspark.operators import relational as R


def test_nearest_has_no_frame_to_the_end(spark, capsys):
    """Spark makes a frame that ends unbounded anew for each row."""
    wanted = spark.createDataFrame([("a", 1, 4), ("a", 2, 7), ("b", 3, 0)], "k string, i int, v int")
    have = spark.createDataFrame([("a", 1), ("a", 5), ("a", 9)], "k string, x int")
    got = R.nearest(wanted, have, ["k"], "v", "x")
    got.explain(True)
    assert "unboundedfollowing" not in capsys.readouterr().out.lower()
    assert sorted((r["i"], r["x"]) for r in got.collect()) == [(1, 5), (2, 9)]


def test_a_small_file_is_parsed_by_many_tasks(spark):
    from vellumspark.plans import flow
    from vellumspark.sources import documents

    docs = spark.createDataFrame([(i, "html", f"<p>{i}") for i in range(40)], "doc_id long, kind string, source string").coalesce(1)
    for made in (documents.parse(docs), flow.raw(docs)):
        assert made.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1
        assert sorted(r["doc_id"] for r in made.collect()) == list(range(40))


def test_numbers_of_items_come_from_one_parse(spark):
    """The query's plan reads nodes that were written; none of its branches parses."""
    import os

    from vellumspark.plans import queries as Q

    plan = Q.catalog_numbers(spark, os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))._jdf.queryExecution().toString()
    assert "MapInArrow" not in plan


def test_a_small_file_is_no_reason_to_broadcast(spark):
    """20,000 equal rows of a kilobyte are a small file and 20 MB on the driver."""
    from pyspark.sql import functions as F

    from vellumspark.sources import shared

    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
    t = shared.written(spark.range(20_000).select("id", F.repeat(F.lit("x"), 1000).alias("v")), "wide")
    met = spark.range(400_000).join(t, "id")
    assert met.select(F.sum(F.length("v"))).head()[0] == 20_000_000
    met.collect()
    assert "BroadcastHashJoin" not in met._jdf.queryExecution().executedPlan().toString()


def test_a_parse_hands_on_few_documents_at_a_time(spark):
    """Sixty documents of 10,000 characters are one batch for Spark and several for the parse."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    from vellumspark.sources import documents

    batch = pa.RecordBatch.from_pylist([{"doc_id": i, "kind": "markdown", "source": "word " * 2000} for i in range(60)])
    got = list(documents.parsed(batch, to_arrow_schema(spark.createDataFrame([], documents.SCHEMA).schema)))
    assert len(got) > 1 and max(map(len, got)) < 60
    assert [i for b in got for i in b.column("doc_id").to_pylist()] == list(range(60))


def test_styles_are_worked_out_for_shapes(spark):
    """A list of 300 links asks for hundreds of styles and has a handful of shapes; what selectors tell apart stays apart."""
    from vellumspark.plans.compile import Corpus

    items = "".join(f"<li><a href='/{i}'>x</a>" for i in range(300))
    odd = "<li class=hot><a>y</a><li style='color: #00f'><a>z</a>"
    docs = spark.createDataFrame([(1, "html", f"<ul>{items}{odd}</ul><p><a>w</a>"), (2, "html", f"<ul>{items}</ul>")], "doc_id long, kind string, source string")
    c = Corpus(docs, ["li a { font-size: 50% } .hot { color: #f00 } .hot a { font-weight: 700 }"])
    asked = {r["doc_id"]: r["n"] for r in c.requests.groupBy("doc_id").count().withColumnRenamed("count", "n").collect()}
    assert asked[2] > 600 and c.shape_styles.where("doc_id = 2").count() < 10
    runs = c.parsed.selectExpr("doc_id", "inline(chunks)").where("kind = 'run'").select("doc_id", "request", "text")
    got = runs.join(c.computed, ["doc_id", "request"]).select("doc_id", "text", "font_size_px", "font_weight", "color").distinct().collect()
    assert sorted(tuple(r) for r in got) == [
        (1, "w", 16.0, 400, 0x000000FF), (1, "x", 8.0, 400, 0x000000FF), (1, "y", 8.0, 700, 0xFF0000FF), (1, "z", 8.0, 400, 0x0000FFFF), (2, "x", 8.0, 400, 0x000000FF),
    ]


def test_alike_requests_with_a_nan_keep_styles_of_their_own(spark):
    """A NaN equals no other, so each item has its style, though all share a shape."""
    from vellumspark.plans.compile import Corpus

    c = Corpus(spark.createDataFrame([(1, "html", "<ul><li>a<li>b<li>c</ul>")], "doc_id long, kind string, source string"), ["li { line-height: nan }"])
    items = c.chunks.where("kind = 'list_item'").select("style_id").collect()
    assert len({r["style_id"] for r in items} - {0}) == 3


def test_packages_are_handed_on_in_batches(spark):
    """Small packages share a batch, many don't; rows are those of Arrow's own reading."""
    import pyarrow as pa

    from vellumspark.plans import packages

    kind = pa.list_(pa.struct([("chunk_id", pa.int32()), ("kind", pa.string())]))
    docs = [{"doc_id": 1, "title": "a", "chunks": [{"chunk_id": 1, "kind": "run"}, {"chunk_id": 2, "kind": None}]}, {"doc_id": None, "title": None, "chunks": None}, {"doc_id": 3, "title": "", "chunks": []}, {"doc_id": 4, "title": "d", "chunks": [{"chunk_id": 7, "kind": "br"}]}]
    batch = pa.RecordBatch.from_pylist(docs, schema=pa.schema([("doc_id", pa.int64()), ("title", pa.string()), ("chunks", kind)]))
    assert list(packages.documents_of(batch)) == docs
    assert list(packages.documents_of(batch.slice(2))) == docs[2:]
    schema = pa.schema([("k", pa.int64())])
    sizes = [len(b) for b in packages.handed_on(iter([({"k": k}, packages.HELD // 10) for k in range(100)]), schema)]
    assert sum(sizes) == 100 and 5 < len(sizes) < 20


def test_a_written_table_leaves_no_shuffle_files(spark):
    import glob

    from vellumspark.sources import shared

    folders = list(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    files = lambda: {f for d in folders for f in glob.glob(f"{d}/*/shuffle_*")}
    df = spark.range(10_000).selectExpr("id % 7 as k").groupBy("k").count()
    setting = spark.conf.get(shared.FREED)
    before = files()
    t = shared.written(df, "counts")
    assert not files() - before
    assert t.count() == df.count() == 7
    assert spark.conf.get(shared.FREED) == setting


def test_steps_of_a_walk_go_as_it_goes_on(spark, monkeypatch):
    """A chain of 60 chunks that is broken at its end takes six rounds; one round's table stands beside the next at most."""
    import glob

    from vellumspark.plans import chains
    from vellumspark.sources import shared

    folder = shared.shared_dir(spark).removeprefix("file://")
    old, most = set(glob.glob(f"{folder}/*")), {}

    def watched(df, name, *more):
        out = shared.written(df, name, *more)
        most[name] = max(most.get(name, 0), len(set(glob.glob(f"{folder}/{name}-*")) - old))
        return out

    monkeypatch.setattr(chains, "written", watched)
    c = [(1, 0, 0, 0, 2, 60)] + [(i, 1, i - 1 if i > 2 else 0, i + 1, 0, 0) for i in range(2, 61)]
    links = ["chunk_id", "parent_id", "prev_id", "next_id", "first_child_id", "last_child_id"]
    schema = f"doc_id long, chunks array<struct<{', '.join(f'{x}: long' for x in links)}>>"
    said = [r["message"] for r in chains.issues(spark.createDataFrame([(7, c)], schema)).collect()]
    assert said == ["chunk 61 in wrong chain"]
    assert most["steps"] <= 3 and most["chains"] <= 2  # the walk's steps and the chains' are two tables


def test_packages_are_broken_without_being_written(spark, monkeypatch, tmp_path):
    """Thirty copies of all packages would be thirty times their disk."""
    from pyspark.sql import functions as F

    from vellumspark.plans import queries as Q

    spark.createDataFrame([(i, f"<title>{i}</title><body><ul><li><a href='/{i}'>{i}</a></ul><h1>{i}</h1><p>x") for i in range(4)], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    names, written = [], Q.written
    monkeypatch.setattr(Q, "written", lambda df, name, *more: names.append(name) or written(df, name, *more))
    monkeypatch.setattr(Q.packages, "validate", lambda _, rows: rows.select("doc_id", F.coalesce("error", F.lit("")).alias("section"), F.size("chunks").cast("string").alias("message")))
    said = Q.broken_packages(spark, str(tmp_path)).collect()
    assert names == ["packed", "sound"]
    assert sorted({r["page_id"] for r in said}) == [0, 1, 2, 3] and len(said) == 4 * 30 == len({(r["page_id"], r["way"]) for r in said})
    by = {r["way"]: (r["section"], r["message"]) for r in said}
    assert by["no chunks"] == ("", "0") and by["depth"][1] != "0" and by["cut"][0] == "too_short" and by["magic"][0] == "bad_magic" and by["end"][0] == "out_of_bounds: section 7"


def test_documents_that_are_alike_are_styled_once(spark, monkeypatch):
    from vellumspark.plans import compile as C

    pages = [
        "<style>li { color: red }</style><ul><li>a</ul><p>b", "<style>li { color: red }</style><ul><li>c<li>d<li>e</ul><p>f<p>g", "<style>li { color: blue }</style><ul><li>a</ul><p>b",
        "<style>li { color: red }</style><ul><li class=x>a</ul><p>b", "<style>li { color: red }</style><ul><li style='color: lime'>a</ul><p>b", "<style>li { color: red }</style><ul id=u><li>h</ul><p>b", "", None,
    ]
    docs = spark.createDataFrame([(i, "html", p) for i, p in enumerate(pages)], "doc_id long, kind string, source string")
    counts, written = {}, C.written
    monkeypatch.setattr(C, "written", lambda df, name, *more: (t := written(df, name, *more), counts.__setitem__(name, t.count()))[0])
    sheet = ["#u li { font-size: 3px } .x { text-indent: 2em }"]
    shared, single = C.Corpus(docs, sheet), C.Corpus(docs, sheet, keep=False)
    rows = lambda c: sorted(map(str, c.shape_styles.collect()))
    assert rows(shared) == rows(single) and shared.shape_styles.schema.simpleString() == single.shape_styles.schema.simpleString()
    assert counts["few"] < counts["kinds"] and counts["few"] - 5 in (0, 1)  # an empty page may have shapes of its own


def test_rows_are_read_some_documents_at_a_time(monkeypatch):
    import pyarrow as pa

    from vellumspark.plans import packages

    inner = pa.struct([("a", pa.int64()), ("b", pa.list_(pa.struct([("c", pa.string())])))])
    cells = [[{"a": 1, "b": [{"c": "x"}, None]}, None], None, [], [{"a": None, "b": None}] * 3, [{"a": 5, "b": []}]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array([[], [], *cells], pa.list_(inner))], ["doc_id", "rows"])
    made = []
    plain = packages.plain
    monkeypatch.setattr(packages, "READ", 2)
    monkeypatch.setattr(packages, "plain", lambda a: made.append(len(a)) or plain(a))
    for b in (batch, batch.slice(2), batch.slice(3, 2), batch.slice(0, 0)):
        assert list(packages.documents_of(b)) == b.to_pylist()
    assert packages.plain(batch.column("rows")) == batch.column("rows").to_pylist()


def test_a_style_sheet_that_documents_share_is_parsed_once(monkeypatch):
    from vellumspark.sources import css, documents

    asked, stylesheet = [], css.stylesheet
    monkeypatch.setattr(css, "stylesheet", lambda text: asked.append(text) or stylesheet(text))
    sheet, long = "p.only-here { color: red }", "p { color: red }" * documents.SHORT
    made = [documents.compiled(i, "html", f"<style>{s}</style><p style='color: red'>{i}") for s in (sheet, long) for i in range(3)]
    assert asked.count(sheet) == 1 and asked.count(long) == 3
    assert made[0]["rules"] == made[1]["rules"] == made[2]["rules"] and len(made[3]["rules"]) == documents.SHORT
    assert [r["error"] for r in (documents.compiled(1, "html", "<style>}</style>x") for _ in range(2))] == [documents.compiled(1, "html", "<style>}</style>x")["error"]] * 2
