"""Documents in, parsed once: one row per document, with its tree, chunks, style requests and rules as arrays."""

from __future__ import annotations

import decimal
import gc
import sys
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from vellumspark.functions.css_values import PARSERS
from vellumspark.operators.partition import Partition, tag_of
from vellumspark.operators.tree import TreeError, from_html

from . import css, markdown
from .shared import spread

HINT = "tag: string, id: string, classes: array<string>"
DECLARATION = "idx: int, name: string, text: string"
SCHEMA = f"""doc_id long, kind string, title string, lang string, sheets array<string>, error string,
nodes array<struct<node_id: int, parent_id: int, path: array<int>, depth: int, kind: string, level: int, text: string, href: string, src: string, alt: string,
  colspan: long, rowspan: long, list_start: decimal(20,0), hidden: boolean, {HINT}, inline: string>>,
requests array<struct<request: int, node: int, seq: int, marks: boolean, shape: int>>,
shapes array<struct<shape: int, above: int, node: int, chain: array<int>, code: boolean, marks: boolean, seqs: array<int>>>,
chunks array<struct<chunk_id: int, kind: string, hidden: boolean, parent_id: int, depth: int, request: int, text: string, image: int, src: string, seq: int, node: int, shape: int, asked: int>>,
extras array<struct<chunk_id: int, kind: string, text: string, a: long, b: long>>,
inline array<struct<node: int, {DECLARATION}>>,
rules array<struct<ord: int, spec: array<int>, chain: array<struct<{HINT}>>, declarations: array<struct<{DECLARATION}>>>>"""

#: The sheet that comes before all others. Fixed: every style starts from it.
DEFAULT_SHEET = """
h1 { font-size: 2em; font-weight: 700; margin-top: 0.67em; margin-bottom: 0.67em; }
h2 { font-size: 1.5em; font-weight: 700; margin-top: 0.83em; margin-bottom: 0.83em; }
h3 { font-size: 1.17em; font-weight: 700; margin-top: 1em; margin-bottom: 1em; }
h4 { font-size: 1em; font-weight: 700; margin-top: 1.33em; margin-bottom: 1.33em; }
h5 { font-size: 0.83em; font-weight: 700; margin-top: 1.67em; margin-bottom: 1.67em; }
h6 { font-size: 0.67em; font-weight: 700; margin-top: 2.33em; margin-bottom: 2.33em; }
p { margin-bottom: 1em; }
blockquote { margin-top: 1em; margin-bottom: 1em; }
ul, ol { margin-bottom: 1em; }
ul { list-style-type: disc; }
ol { list-style-type: decimal; }
li { margin-bottom: 0.25em; }
pre { white-space: pre; margin-top: 1em; margin-bottom: 1em; }
img { margin-top: 1em; margin-bottom: 1em; }
caption { font-size: 0.83em; }
table { margin-bottom: 1em; }
em { font-style: italic; }
strong { font-weight: 700; }
a { text-decoration: underline; }
"""
#: Characters of source whose rows a task holds as Python objects, which take many times the room, before it hands them on.
HELD = 200_000
#: Style sheets and attributes that a worker keeps parsed, and the characters that each of them has at most.
CACHED, SHORT = 1_000, 2_000
#: Rules are numbered in this order: the default sheet's, the document's, the user's.
DOCUMENT_RULES, USER_RULES = 1_000_000, 1_000_000_000


def declarations(pairs: list[tuple[str, str]]) -> list[dict]:
    """Those of known properties, with their texts; functions.css_columns reads the values."""
    return [{"idx": i, "name": name, "text": text} for i, (name, text) in enumerate(pairs) if name in PARSERS]


def rules(text: str, first: int) -> list[dict]:
    """A row for each selector of each rule. Selectors know classes, ids and tags; the last compound alone weighs."""
    out = []
    for k, rule in enumerate(css.stylesheet(text)):
        decls = declarations(rule.declarations)
        for chain in rule.selectors:
            out.append({"ord": first + k, "spec": list(chain[-1].specificity()), "chain": [{"tag": s.tag, "id": s.id, "classes": list(s.classes)} for s in chain], "declarations": decls})
    return out


@lru_cache(CACHED)
def _cached_rules(text: str, first: int) -> list[dict]:
    return rules(text, first)


def rules_of(text: str, first: int) -> list[dict]:
    """rules, not to be changed: documents share sheets, and a short one is parsed once."""
    return _cached_rules(text, first) if len(text) <= SHORT else rules(text, first)


@lru_cache(CACHED)
def _cached_inline(text: str) -> list[dict] | None:
    try:
        return declarations(css.inline(text))
    except css.CssError:
        return None


def inline_of(text: str) -> list[dict] | None:
    """The declarations of a style attribute, not to be changed; none where it has an error."""
    return _cached_inline(text) if len(text) <= SHORT else _cached_inline.__wrapped__(text)


def compiled(doc_id: int | None, kind: str, source: str | None) -> dict:
    row: dict = {"doc_id": doc_id, "kind": kind, "title": None, "lang": None, "sheets": [], "error": None}
    empty = {k: [] for k in ("nodes", "requests", "shapes", "chunks", "extras", "inline", "rules")}
    if source is None:
        return {**row, **empty, "error": "no source"}
    try:
        if kind == "html":
            tree, reading = from_html(source)
            row |= {"title": reading.title, "lang": reading.lang, "sheets": reading.sheets}
        elif kind == "markdown":
            tree = markdown.parse(source)
        else:
            return {**row, **empty, "error": f"unknown kind: {kind}"}
        own, at = [], DOCUMENT_RULES
        for sheet in row["sheets"]:
            found = rules_of(sheet, at)
            at = found[-1]["ord"] + 1 if found else at
            own += found
    except (TreeError, css.CssError, RecursionError) as e:
        return {**row, **empty, "error": f"{'css' if isinstance(e, css.CssError) else 'tree'}: {e}"}
    p = Partition(tree)
    inline = []
    nodes = []
    for me, parent, path, n in p.nodes:
        nodes.append({
            "node_id": me, "parent_id": parent, "path": list(path), "depth": len(path), "kind": n.kind, "level": n.level, "text": n.text, "href": n.href, "src": n.src, "alt": n.alt,
            "colspan": n.colspan, "rowspan": n.rowspan, "list_start": n.start, "hidden": n.hidden, "tag": tag_of(n), "id": n.id, "classes": n.classes, "inline": n.inline,
        })
        if n.inline is not None:
            # a style attribute with an error counts as none
            inline += [{"node": me, **d} for d in inline_of(n.inline) or []]
    return {**row, "nodes": nodes, "requests": p.requests, "shapes": p.shapes, "chunks": p.chunks, "extras": p.extras, "inline": inline, "rules": own}


def parsed(batch: pa.RecordBatch, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The rows of a batch's documents, handed on whenever HELD characters of source are done."""
    rows: list[dict] = []
    size = 0
    for cells in zip(*(batch.column(c) for c in ("doc_id", "kind", "source"))):
        doc_id, kind, source = (x.as_py() for x in cells)
        row = compiled(doc_id, kind, source)
        for n in row["nodes"]:
            n["list_start"] = None if n["list_start"] is None else decimal.Decimal(n["list_start"])
        rows.append(row)
        size += len(source or "")
        if size > HELD:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)
            rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


@contextmanager
def seldom_collected() -> Iterator[None]:
    """For rows of many small objects that live until they are handed on: each early look at them is in vain."""
    before = gc.get_threshold()
    gc.set_threshold(50_000, 20, 50)
    try:
        yield
    finally:
        gc.set_threshold(*before)


def parse(docs: DataFrame) -> DataFrame:
    """docs(doc_id, kind, source) with kind 'html' or 'markdown', parsed and partitioned; a document that fails has an error and empty arrays."""
    spark = docs.sparkSession
    empty = spark.createDataFrame([], SCHEMA)
    schema = to_arrow_schema(empty.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sys.setrecursionlimit(max(sys.getrecursionlimit(), 5000))
        with seldom_collected():
            for b in batches:
                yield from parsed(b, schema)

    return spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "kind", "source")).mapInArrow(run, empty.schema)


def kind_of(path: F.Column) -> F.Column:
    """A file's kind by its extension; null for an unknown one."""
    extension = F.lower(F.regexp_extract(path, r"\.([^./\\]*)$", 1))
    return F.when(extension.isin("md", "markdown"), "markdown").when(extension.isin("html", "htm"), "html")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """path, kind, source, error of text files, whole. A file that isn't UTF-8 or of no known kind has an error and no source."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    text = F.when(F.expr("is_valid_utf8(cast(content as string))"), F.col("content").cast("string"))
    kind = kind_of(F.col("path"))
    error = F.when(kind.isNull(), "unknown extension").when(text.isNull(), "invalid UTF-8")
    return files.select("path", kind.alias("kind"), F.when(error.isNull(), text).alias("source"), error.alias("error"))
