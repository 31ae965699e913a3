"""The relational operators that compiling, checking and reporting are made of, for any table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellumspark.sources.shared import written


def sibling_links(df: DataFrame, parent: Sequence[str], key: str, ends: bool = True) -> DataFrame:
    """df with prev_id, next_id and, with ends, first_id and last_id of key among the rows of a parent, in order of key; 0 for none."""
    line = W.partitionBy(*parent).orderBy(key)
    whole = W.partitionBy(*parent)
    zero = lambda x: F.coalesce(x, F.lit(0))
    more = [F.min(key).over(whole).alias("first_id"), F.max(key).over(whole).alias("last_id")] if ends else []
    return df.select("*", zero(F.lag(key).over(line)).alias("prev_id"), zero(F.lead(key).over(line)).alias("next_id"), *more)


def first_seen(df: DataFrame, group: Sequence[str], value: Sequence[str], order: str, name: str, start: int = 0) -> DataFrame:
    """The distinct values of a group with dense ids from start, by first occurrence in `order`."""
    first = df.groupBy(*group, *value).agg(F.min(order).alias("_first"))
    return dense_ids(first, group, "_first", name, start).drop("_first")


def dense_ids(df: DataFrame, group: Sequence[str], order: str, name: str, start: int = 0) -> DataFrame:
    """df with dense ids of the values of `order` in a group, from start; null where it is null."""
    rank = F.dense_rank().over(W.partitionBy(*group).orderBy(F.col(order).asc_nulls_last()))
    return df.withColumn(name, F.when(F.col(order).isNotNull(), rank + (start - 1)))


def last_wins(df: DataFrame, group: Sequence[str], value: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The value columns of each group's row that comes last in an order."""
    return df.groupBy(*group).agg(F.max_by(F.struct(*value), F.struct(*order)).alias("_v")).select(*group, "_v.*")


def numbered(df: DataFrame, group: Sequence[str], order: str, is_item: Column, start: Column, name: str = "value") -> DataFrame:
    """Items of a group numbered from start, the largest 64-bit number at most, shown in 32 bits; other rows don't count and get null."""
    before = F.sum(is_item.cast("long")).over(W.partitionBy(*group).orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    value = F.least(start.cast("decimal(20,0)") + before - 1, F.lit(str(2**64 - 1)).cast("decimal(20,0)"))
    return df.withColumn(name, F.when(is_item, (value % F.lit(2**32)).cast("long")))


def islands(df: DataFrame, group: Sequence[str], order: str, breaks: Column, name: str = "segment") -> DataFrame:
    """df with the number of breaks up to a row in its group: rows between breaks share it."""
    return df.withColumn(name, F.sum(breaks.cast("long")).over(W.partitionBy(*group).orderBy(order).rowsBetween(W.unboundedPreceding, 0)))


def nearest(wanted: DataFrame, have: DataFrame, on: Sequence[str], want: str, got: str) -> DataFrame:
    """Each wanted row with the nearest `got` of the rows of have that agree on `on`; the larger one of two as near. Rows without any, or without a value, stay away.

    Distinct values of both sides go in one order, dealt to tasks by ranges of it, so that a key with many values is many tasks. In a range
    the nearest is the last of have before a value or the first after it; the last before a range and the first after it are
    carried over from a table of a row for each key and range. Answers are joined back to the rows that ask.
    """
    fields = [c for c in wanted.columns if c not in on]
    asked = wanted.where(F.col(want).isNotNull())
    kind = have.schema[got].dataType
    points = asked.select(*on, F.col(want).alias("_v"), F.lit(None).cast(kind).alias("_got")).distinct()
    marks = have.where(F.col(got).isNotNull()).select(*on, F.col(got).alias("_v"), F.col(got).alias("_got")).distinct()
    order = [*on, "_v"]
    # written, as the ranges must stay the same wherever they are read
    both = written(points.unionByName(marks).repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    ends = both.groupBy(*on, "_range").agg(F.min("_got").alias("_first"), F.max("_got").alias("_last"))
    # what follows is what precedes from the other end: a frame that ends unbounded is made anew for every row, in the square of a range's rows
    before = lambda column, end, group, *order: F.last(column, True).over(W.partitionBy(*group).orderBy(*order).rowsBetween(W.unboundedPreceding, end))
    ends = ends.select(*on, "_range", before("_last", -1, on, "_range").alias("_before"), before("_first", -1, on, F.desc("_range")).alias("_after"))
    bare, line = F.col("_got").isNull(), [*on, "_range"]
    both = both.withColumn("_below", before("_got", 0, line, "_v", bare)).withColumn("_above", before("_got", 0, line, F.desc("_v"), bare.desc()))
    both = both.where("_got is null").join(ends, [*on, "_range"]).withColumn("_below", F.coalesce("_below", "_before")).withColumn("_above", F.coalesce("_above", "_after"))
    both = both.where("_below is not null or _above is not null")
    up = F.col("_below").isNull() | (F.col("_above").isNotNull() & (F.col("_above") - F.col("_v") <= F.col("_v") - F.col("_below")))
    answers = both.select(*on, "_v", F.when(up, F.col("_above")).otherwise(F.col("_below")).alias("_near"))
    return asked.withColumn("_v", F.col(want)).join(answers, [*on, "_v"]).select(*on, *fields, F.col("_near").alias(got))


def dangling(df: DataFrame, ref: Column, other: DataFrame, key: str) -> DataFrame:
    """Rows whose ref isn't null and isn't found in other's key."""
    return df.withColumn("_ref", ref).where("_ref is not null").join(other.select(F.col(key).alias("_ref")), "_ref", "left_anti").drop("_ref")


def top(df: DataFrame, group: Sequence[str], order: Sequence, n: int) -> DataFrame:
    """The first n rows of each group."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*group).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, and how often."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def page_size(glyphs: Column) -> Column:
    """The least power of two, from 64 to 2048, that holds so many glyphs of 40 by 40 texels at three quarters full."""
    side = F.floor(F.greatest(F.lit(64.0), F.ceil(F.sqrt(glyphs * 1600 / F.lit(0.75)))))
    out = F.lit(2048)
    for p in (1024, 512, 256, 128, 64):
        out = F.when(side <= p, p).otherwise(out)
    return out


def coverage_error(df: DataFrame, group: Sequence[str], a: Column, b: Column) -> DataFrame:
    """rmse and worst: the root mean square and the largest difference of two masks."""
    return df.groupBy(*group).agg(F.sqrt(F.avg((a - b) * (a - b))).alias("rmse"), F.max(F.abs(a - b)).alias("worst"))
