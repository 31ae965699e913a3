"""White space and paragraphs as windows over the rows of a tree.

A block's flowing content is a line of leaves. What a leaf does to the line depends on one thing, whether a blank may stand there,
and it leaves that either as it was or as it says itself: so its state is that of the last leaf before it that says anything, and
the whole fold is a window, not a walk.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from vellumspark.functions.text import collapse_column
from vellumspark.operators import relational as R
from vellumspark.operators.tree import BLOCK, BREAKS, FLOWING, Node, TreeError, from_html
from vellumspark.sources import markdown
from vellumspark.sources.shared import spread, written

RAW = "doc_id long, error string, nodes array<struct<node_id: int, parent_id: int, block: int, kind: string, text: string, leaf: boolean>>"
#: Whose children stand where blocks stand, and whose children are blocks with flowing content between.
HOLDS_BLOCKS = ("document", "quote", "table", "table_row", "ordered_list", "unordered_list", "image")
HOLDS_BOTH = ("list_item", "table_cell")


def raw_rows(root: Node) -> list[dict]:
    """A tree as rows, in pre-order; block is the nearest node above that isn't flowing, leaf: whether it is a flowing node without children."""
    out: list[dict] = []
    todo = [(root, -1, -1)]
    while todo:
        n, parent, block = todo.pop()
        me = len(out)
        out.append({"node_id": me, "parent_id": parent, "block": block, "kind": n.kind, "text": n.text, "leaf": n.kind in FLOWING and n.kind not in BREAKS and not n.kids})
        below = block if n.kind in FLOWING else me
        todo += [(k, me, below) for k in reversed(n.kids)]
    return out


def raw(docs: DataFrame) -> DataFrame:
    """doc_id, error, nodes: the trees of docs(doc_id, kind, source) as the front ends read them, before white space is folded."""
    schema = docs.sparkSession.createDataFrame([], RAW).schema
    arrow = to_arrow_schema(schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc_id, kind, source in zip(*(b.column(c).to_pylist() for c in ("doc_id", "kind", "source"))):
                row = {"doc_id": doc_id, "error": None, "nodes": []}
                try:
                    if source is None:
                        raise TreeError("no source")
                    row["nodes"] = raw_rows(from_html(source, fold=False)[0] if kind == "html" else markdown.parse(source, fold=False))
                except (TreeError, RecursionError) as e:
                    row["error"] = f"tree: {e}"
                yield pa.RecordBatch.from_pylist([row], schema=arrow)

    return spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "kind", "source")).mapInArrow(read, schema)


def folded(trees: DataFrame) -> DataFrame:
    """doc_id, node_id, block, text: the leaves of trees(doc_id, nodes) that keep a text, with their white space folded.

    Runs of white space are one blank. A blank goes at a line's beginning and end, at breaks and images, and after another blank. A
    leaf of nothing but a blank says nothing about the state if the blank goes.
    """
    n = trees.select("doc_id", F.inline("nodes"))
    ends = F.col("kind").isin(*BREAKS, "image")
    line = n.where(ends | (F.col("leaf") & (F.col("text") != ""))).where("block >= 0")
    line = line.select("doc_id", "block", "node_id", F.when(~ends, collapse_column(F.col("text"))).alias("t"))
    order = W.partitionBy("doc_id", "block").orderBy("node_id")
    last = F.lead("t").over(order).isNull()
    line = line.withColumn("last", last)
    blank = F.col("t") == " "
    # whether a blank after this leaf would go: null where the leaf leaves that as it was
    says = F.when(F.col("t").isNull(), True).when(blank, F.when(~F.col("last"), True)).otherwise(F.col("t").endswith(" ") & ~F.col("last"))
    line = line.withColumn("says", says)
    open_ = F.coalesce(F.last("says", True).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(True))
    line = line.withColumn("open", open_).where("t is not null")
    text = F.when(F.col("open") & F.col("t").startswith(" "), F.expr("substring(t, 2)")).otherwise(F.col("t"))
    line = line.withColumn("t", text)
    line = line.withColumn("t", F.when(F.col("last") & F.col("t").endswith(" "), F.expr("substring(t, 1, length(t) - 1)")).otherwise(F.col("t"))).where("t <> ''")
    # the last text of a block ends without a blank
    final = F.lead("node_id").over(order).isNull()
    line = line.withColumn("t", F.when(final & F.col("t").endswith(" "), F.expr("substring(t, 1, length(t) - 1)")).otherwise(F.col("t")))
    return line.where("t <> ''").select("doc_id", "node_id", "block", F.col("t").alias("text"))


def doubled(rows: DataFrame, keep: list[str], gather) -> DataFrame:
    """rows(doc_id, request, above, ...) with each one's `keep` columns gathered from all above it. above: the next request that isn't
    gathered yet, -1 for none. gather(own, upper): the column that two neighbouring stretches come to. Each round doubles the way."""
    while rows.where("above >= 0").head() is not None:
        upper = rows.select("doc_id", F.col("request").alias("above"), F.col("above").alias("_above"), *[F.col(f"`{c}`").alias(f"_{c}") for c in keep])
        others = [F.col(f"`{c}`") for c in rows.columns if c not in ("above", *keep)]
        on = rows.where("above >= 0").join(upper, ["doc_id", "above"]).select(*others, F.col("_above").alias("above"), *[gather(F.col(f"`{c}`"), F.col(f"`_{c}`")).alias(c) for c in keep])
        rows = written(rows.where("above < 0").unionByName(on), "inherited")
    return rows


def paragraphs(nodes: DataFrame) -> DataFrame:
    """doc_id, node_id, implied, text: the paragraphs of nodes(doc_id, node_id, parent_id, kind, text), which are in pre-order, named by their first node.

    Below what holds flowing content nothing is a block, however deep: whether a node stands where blocks do is gathered from all above
    it (doubled). A paragraph is a node of that kind there, or implied: what flows between blocks in an item, a cell or a wrapper shares one, and what flows
    among blocks elsewhere is one each. Break marks stand at blocks; islands between them, under one parent, are paragraphs.
    A text belongs to the last mark before it in pre-order.
    """
    up = nodes.select("doc_id", F.col("node_id").alias("parent_id"), F.col("kind").alias("in_kind"), F.col("parent_id").alias("above"), (F.col("text") == "").alias("bare"))
    rows = nodes.select("doc_id", "node_id", "parent_id", "kind", "text").join(up, ["doc_id", "parent_id"], "left")
    over = nodes.select("doc_id", F.col("node_id").alias("above"), F.col("kind").alias("over_kind"))
    rows = rows.join(over, ["doc_id", "above"], "left")
    block = F.col("kind").isin(*BLOCK, "document")
    wrapper = (F.col("in_kind") == "transparent") & F.col("bare") & F.col("over_kind").isin(*HOLDS_BLOCKS)
    both = F.coalesce(F.col("in_kind").isin(*HOLDS_BOTH) | wrapper, F.lit(False))
    among = F.coalesce(F.col("in_kind").isin(*HOLDS_BLOCKS), F.lit(False))
    rows = rows.withColumn("is_block", block).withColumn("both", both).withColumn("among", among)
    here = F.col("parent_id").isNull() | (F.col("parent_id") < 0) | F.col("among") | (F.col("both") & F.col("is_block"))
    place = rows.select("doc_id", F.col("node_id").alias("request"), F.col("parent_id").alias("above"), here.alias("here"))
    place = doubled(written(place, "places"), ["here"], lambda own, upper: own & upper).select("doc_id", F.col("request").alias("node_id"), "here")
    # what stands in a block that stands among blocks, and itself
    rows = rows.join(place, ["doc_id", "node_id"]).join(place.select("doc_id", F.col("node_id").alias("parent_id"), F.col("here").alias("in_here")), ["doc_id", "parent_id"], "left")
    rows = written(rows.withColumn("is_block", F.col("is_block") & F.col("here")).withColumn("both", F.col("both") & F.coalesce("in_here", F.lit(False))).withColumn("among", F.col("among") & F.coalesce("in_here", F.lit(False))), "placed")
    # between the children of one parent
    shared = R.islands(rows.where("both"), ["doc_id", "parent_id"], "node_id", F.col("is_block"), "island").where("not is_block")
    shared = shared.groupBy("doc_id", "parent_id", "island").agg(F.min("node_id").alias("node_id")).select("doc_id", "node_id", F.lit(True).alias("implied"))
    alone = rows.where("among and not is_block and not (kind = 'transparent' and text = '')").select("doc_id", "node_id", F.lit(True).alias("implied"))
    named = rows.where("kind = 'paragraph' and here").select("doc_id", "node_id", F.lit(False).alias("implied"))
    begins = shared.unionByName(alone).unionByName(named)
    marks = rows.select("doc_id", "node_id", "kind", "text", "is_block").join(begins, ["doc_id", "node_id"], "left")
    line = W.partitionBy("doc_id").orderBy("node_id")
    mark = F.when(F.col("implied").isNotNull() | F.col("is_block"), F.struct("node_id", "implied"))
    marks = marks.withColumn("mark", F.last(mark, True).over(line.rowsBetween(W.unboundedPreceding, 0))).where("mark.implied is not null")
    piece = F.when(~F.col("is_block") & (F.col("text") != ""), F.struct("node_id", "text"))
    out = marks.groupBy("doc_id", F.col("mark.node_id").alias("node_id"), F.col("mark.implied").alias("implied")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda x: x["text"]), "").alias("text"))
    return out


def list_values(nodes: DataFrame) -> DataFrame:
    """doc_id, node_id, value: what the items of ordered lists are numbered, from nodes(doc_id, node_id, parent_id, kind, list_start): from the list's start, or 1, on; what is no item doesn't count."""
    lists = nodes.where("kind = 'ordered_list'").select("doc_id", F.col("node_id").alias("parent_id"), F.coalesce("list_start", F.lit(1).cast("decimal(20,0)")).alias("start"))
    kids = nodes.select("doc_id", "node_id", "parent_id", "kind").join(lists, ["doc_id", "parent_id"])
    return R.numbered(kids, ["doc_id", "parent_id"], "node_id", F.col("kind") == "list_item", F.col("start")).where("value is not null").select("doc_id", "node_id", "value")
