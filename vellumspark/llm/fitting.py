"""Labelled samples of bounded size, for the classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Ranges of hashes in which rows are counted, as bits.
RANGE_BITS = 14


def fold(parts: int) -> F.Column:
    """crc32 of the id as text, modulo parts; null ids count as the text ''."""
    return F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "utf-8")) % parts


def sample_ids(rows: DataFrame, label: str, each: int, most: int) -> DataFrame:
    """(doc_id, label): up to `each` ids of every label, or most / labels where that is less, first by a hash of the id. One label for each id.

    Rows are counted by label and range of hashes; of the range in which a label's sample ends some rows are taken, of those
    before it all. So no task ranks more than the rows of one range.
    """
    rows = rows.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).alias(label))
    rows = rows.withColumn("_h", F.xxhash64("doc_id")).withColumn("_range", F.shiftright("_h", 64 - RANGE_BITS))
    ranges = rows.groupBy(label, "_range").agg(F.count("*").alias("_n"))
    labels = F.size(F.collect_set(label).over(W.partitionBy()))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(label).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    some = ranges.groupBy(label).agg(F.lit(1)).select(label, F.least(F.lit(each), F.greatest(F.lit(1), F.floor(F.lit(most) / labels))).cast("long").alias("_each"))
    ranges = ranges.withColumn("_before", before).join(F.broadcast(some), label).where("_before < _each")
    # a label has about each ranges left, or all of the 2 ** RANGE_BITS
    rows = rows.join(ranges.drop("_n"), [label, "_range"])
    rank = F.row_number().over(W.partitionBy(label, "_range").orderBy("_h", "doc_id"))
    return rows.withColumn("_k", rank).where(F.col("_before") + F.col("_k") <= F.col("_each")).orderBy("_h", "doc_id").limit(most).select("doc_id", label)


def labelled_texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The texts of a bounded set of ids, one row each: the smallest text where ids repeat."""
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids), "doc_id")
    return found.groupBy("doc_id", *[c for c in ids.columns if c != "doc_id"]).agg(F.min("text").alias("text"))
