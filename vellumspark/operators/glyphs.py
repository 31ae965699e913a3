"""Which glyph shows a codepoint, and how pairs of glyphs are set, as joins over the tables of faces."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import relational as R

#: Codepoints of a bucket: an interval is a row in each bucket that it touches.
BUCKET = 256


def intervals(rows: DataFrame, group: Sequence[str], point: str, value: str) -> DataFrame:
    """The group's columns, first, last, value: runs of points that follow each other and whose values do too. rows: a value for each point of a group."""
    run = F.col(point) - F.col(value)
    line = R.islands(rows.select(*group, F.col(point).cast("long").alias("_p"), F.col(value).cast("long").alias("_g"), run.alias("_d")), group, "_p", F.lit(True), "_n")
    # points that follow each other keep their distance to their number, and values to the points
    runs = line.groupBy(*group, "_d", (F.col("_p") - F.col("_n")).alias("_k")).agg(F.min("_p").alias("first"), F.max("_p").alias("last"), F.min("_g").alias("value"))
    return runs.drop("_d", "_k")


def within(points: DataFrame, spans: DataFrame, on: Sequence[str], point: str, bucket: int = BUCKET) -> DataFrame:
    """points joined with the spans(first, last, ...) of the same `on` that hold them: an equality join on buckets, then the bounds."""
    at = points.withColumn("_bucket", F.floor(F.col(point) / bucket))
    parts = spans.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("first") / bucket), F.floor(F.col("last") / bucket))))
    return at.join(parts, [*on, "_bucket"]).where(F.col(point).between(F.col("first"), F.col("last"))).drop("_bucket")


def mapped(wanted: DataFrame, maps: DataFrame, supplement: DataFrame) -> DataFrame:
    """face, cp, source, glyph for each distinct row of wanted(face, cp).

    maps(face, first, last, value): a face's character map; value is the glyph of `first`. supplement(ord, first, last, value): maps of the faces
    that serve what a face lacks, the first by ord that has it. source: -1 the face itself, else the supplementary face's ord; both
    null, and the glyph, where no face has the codepoint. Spans of one map don't overlap.
    """
    wanted = wanted.select("face", "cp").distinct()
    glyph = (F.col("value") + F.col("cp") - F.col("first")).alias("glyph")
    own = within(wanted, maps, ["face"], "cp").select("face", "cp", F.lit(-1).cast("long").alias("source"), glyph)
    rest = wanted.join(own, ["face", "cp"], "left_anti")
    # what faces lack is asked of the supplement once for all faces
    served = within(rest.select("cp").distinct(), supplement, [], "cp").select("cp", F.col("ord").cast("long").alias("source"), glyph)
    served = served.groupBy("cp").agg(F.min(F.struct("source", "glyph")).alias("s")).select("cp", "s.source", "s.glyph")
    return own.unionByName(rest.join(served, "cp", "left").select("face", "cp", "source", "glyph"))


def kerned(glyphs: DataFrame, pairs: DataFrame) -> DataFrame:
    """face, left, right, adjust: how far pairs of codepoints move together or apart, over all lookups.

    glyphs(face, cp, glyph): those in use; of codepoints that share a glyph the last stands for it. pairs(face, left, right, adjust): glyphs, a row
    for each lookup. Pairs with both ends in use are kept, added up, and dropped if nothing remains.
    """
    use = glyphs.groupBy("face", "glyph").agg(F.max("cp").alias("cp"))
    end = lambda name: use.select("face", F.col("glyph").alias(name), F.col("cp").alias(f"{name}_cp"))
    # lookups are added up before either join
    sums = pairs.groupBy("face", "left", "right").agg(F.sum("adjust").alias("adjust")).where("adjust <> 0")
    met = sums.join(end("left"), ["face", "left"]).join(end("right"), ["face", "right"])
    return met.select("face", F.col("left_cp").alias("left"), F.col("right_cp").alias("right"), "adjust")
