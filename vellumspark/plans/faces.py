"""Faces of a registry as tables, and which of them a corpus asks for and what they lack, by joins; nothing is drawn."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumspark.operators import glyphs as G
from vellumspark.operators import relational as R
from vellumspark.sources.fonts import DEFAULT_FAMILY, GENERIC, HEAVIEST, LIGHTEST, Font, FontError, Registry

from .compile import Corpus


def spans(cmap: dict[int, int]) -> list[tuple[int, int, int]]:
    """(first, last, glyph of the first): runs of a character map whose glyphs follow each other."""
    out: list[list[int]] = []
    for cp, g in sorted(cmap.items()):
        if out and cp == out[-1][1] + 1 and g == out[-1][2] + cp - out[-1][0]:
            out[-1][1] = cp
        else:
            out.append([cp, cp, g])
    return [tuple(x) for x in out]


def tables(spark: SparkSession, fonts: Registry) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(faces: name, weight, italic, face), (maps: face, first, last, value), (supplement: ord, first, last, value) of a registry.

    A registry is of bounded size (sources.fonts.MOST_BYTES), and so are these. A file that can't be read as a font has no map.
    """
    faces, maps, more = [], [], []
    for k, ((family, weight, italic), data) in enumerate(sorted(fonts.faces.items())):
        faces.append((family, weight, italic, k))
        try:
            maps += [(k, *s) for s in spans(Font(data).cmap)]
        except FontError:
            continue
    for k, data in enumerate(fonts.supplement):
        more += [(k, *s) for s in spans(Font(data).cmap)]
    return (
        spark.createDataFrame(faces, "name string, weight int, italic boolean, face int"),
        spark.createDataFrame(maps, "face int, first long, last long, value long"),
        spark.createDataFrame(more, "ord int, first long, last long, value long"),
    )


def resolved(wanted: DataFrame, faces: DataFrame) -> DataFrame:
    """family, weight, italic, face: the face that each row of wanted(family, weight, italic) gets, of the nearest weight; rows without any stay away."""
    name = F.when(F.lower("family").isin(*GENERIC), F.lit(DEFAULT_FAMILY.lower())).otherwise(F.lower("family"))
    asked = wanted.select("family", "weight", "italic").distinct().withColumn("name", name).withColumn("want", F.least(F.greatest("weight", F.lit(LIGHTEST)), F.lit(HEAVIEST)))
    got = R.nearest(asked, faces.withColumnRenamed("weight", "got"), ["name", "italic"], "want", "got")
    return got.join(faces.select("name", "italic", F.col("weight").alias("got"), "face"), ["name", "italic", "got"]).select("family", "weight", "italic", "face")


def shown(corpus: Corpus, fonts: Registry) -> DataFrame:
    """family, weight, italic, cp, face, source, glyph: what shows each codepoint that a corpus asks its faces for; face is null where no font fits, glyph where none has it."""
    faces, maps, more = tables(corpus.spark, fonts)
    used = corpus.codepoints.select("family", "weight", "italic", F.col("cp").cast("long").alias("cp")).distinct()
    used = used.join(resolved(used, faces), ["family", "weight", "italic"], "left")
    found = G.mapped(used.where("face is not null"), maps, more)
    return used.join(found, ["face", "cp"], "left").select("family", "weight", "italic", "cp", "face", "source", "glyph")


def missing_codepoints(corpus: Corpus, fonts: Registry) -> DataFrame:
    """doc_id, cp: the codepoints of each document that neither its face nor a supplementary one has. Faces that no font fits aren't asked."""
    lacking = shown(corpus, fonts).where("face is not null and glyph is null").select("family", "weight", "italic", F.col("cp").cast("int").alias("cp"))
    return corpus.codepoints.join(lacking, ["family", "weight", "italic", "cp"]).select("doc_id", "cp").distinct()
