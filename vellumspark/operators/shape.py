"""Which node may stand in which, and the tree checks that follow from it, as queries over the node table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumspark.functions.text import nfc_column

from .tree import BLOCK, INLINE, MAX_CHILDREN, MAX_DEPTH

# The children that each kind of node takes; a transparent node takes and goes anywhere, but not in a leaf.
_BLOCKS, _FLOW = sorted(BLOCK), sorted(INLINE)
ALLOWED: dict[str, list[str]] = {
    "document": _BLOCKS, "quote": _BLOCKS, **{k: _FLOW for k in ("heading", "paragraph", "caption", "table_cell", "link", "emphasis", "strong", "inline_code")},
    "ordered_list": ["list_item"], "unordered_list": ["list_item"], "list_item": ["ordered_list", "unordered_list", "paragraph", "quote", "code_block", "table", "image"],
    "table": ["table_row"], "table_row": ["table_cell"], "image": ["caption"],
}
LEAVES = ("code_block", "soft_break", "hard_break", "rule")


def tree_issues(nodes: DataFrame) -> DataFrame:
    """doc_id, node_id, issue of nodes(doc_id, node_id, parent_id, depth, kind, text): too deep, too many children, not in NFC, out of place, a root that is no document.

    Allowed pairs are a small table, joined against.
    """
    spark = nodes.sparkSession
    pairs = [(p, c) for p, kinds in ALLOWED.items() for c in [*kinds, "transparent"]]
    pairs += [("transparent", c) for c in [*_BLOCKS, *_FLOW, "transparent", "document"]]
    allowed = F.broadcast(spark.createDataFrame(pairs, "parent_kind string, kind string"))
    parents = nodes.select("doc_id", F.col("node_id").alias("parent_id"), F.col("kind").alias("parent_kind"))
    placed = nodes.where("parent_id >= 0").join(parents, ["doc_id", "parent_id"])
    odd = placed.join(allowed, ["parent_kind", "kind"], "left_anti")
    issue = lambda df, text: df.select("doc_id", "node_id", text.alias("issue"))
    form = nodes.select("doc_id", "node_id", "text", nfc_column(F.col("text")).alias("nfc"))
    many = nodes.where("parent_id >= 0").groupBy("doc_id", F.col("parent_id").alias("node_id")).agg(F.count("*").alias("n"))
    return (
        issue(odd, F.concat_ws(" ", "kind", F.lit("in"), "parent_kind"))
        .unionByName(issue(nodes.where(F.col("depth") >= MAX_DEPTH), F.lit("too deep")))
        .unionByName(issue(many.where(F.col("n") > MAX_CHILDREN), F.lit("too many children")))
        .unionByName(issue(form.where("text <> nfc"), F.lit("not in NFC")))
        .unionByName(issue(nodes.where("parent_id < 0 and kind <> 'document'"), F.lit("root is no document")))
    )
