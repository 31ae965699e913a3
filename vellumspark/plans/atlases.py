"""Glyph atlases of a corpus: a face's glyphs are drawn once for all documents, and packed for each."""

from __future__ import annotations

from collections.abc import Iterator
from math import isfinite

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from vellumspark.operators import atlas as A
from vellumspark.operators import masks as M
from vellumspark.operators import relational as R
from vellumspark.operators.geometry import bounds
from vellumspark.sources.fonts import Font, FontError, Registry

from .compile import Corpus

TEXELS, PADDING = 40.0, 4
GLYPH = "codepoint: long, advance: float, bearing_x: float, bearing_y: float, box_x: int, box_y: int, box_w: int, box_h: int, page_index: int, flags: int"
ATLAS = (
    f"struct<font_id: int, padding: int, texels_per_em: long, ascent: float, descent: float, line_gap: float, cap_height: float, x_height: float, units_per_em: float, family: string, weight: int, "
    f"italic: boolean, page_width: int, page_height: int, glyphs: array<struct<{GLYPH}>>, kerning: array<struct<left: long, right: long, adjust: float>>, pages: array<binary>>"
)


def drawn(faces: DataFrame, fonts: Registry, texels: float = TEXELS, padding: int = PADDING) -> DataFrame:
    """family, weight, italic, cp and the glyph: box, pixels and metrics, or an error. faces: distinct family, weight, italic, cp over all documents."""
    shared = faces.sparkSession.sparkContext.broadcast(fonts)
    schema = "family string, weight int, italic boolean, cp int, advance float, bearing_x float, bearing_y float, width int, height int, pixels binary, error string"

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_: dict[tuple, Font | str] = {}
        more = [Font(d) for d in shared.value.supplement]
        for pdf in batches:
            rows = []
            for family, weight, italic, cp in pdf[["family", "weight", "italic", "cp"]].itertuples(index=False):
                key = (family, int(weight), bool(italic))
                if key not in open_:
                    try:
                        open_[key] = Font(shared.value.resolve(*key))
                    except FontError as e:
                        open_[key] = str(e)
                font = open_[key]
                if not isinstance(font, str) and cp not in font.cmap:
                    font = next((f for f in more if cp in f.cmap), font)
                if isinstance(font, str):
                    rows.append((*key, cp, None, None, None, None, None, None, font))
                elif cp not in font.cmap:
                    rows.append((*key, cp, None, None, None, None, None, None, "missing"))
                else:
                    g = font.cmap[cp]
                    outline = font.outline(g)
                    got = A.render(outline, texels / font.units, padding)
                    if got is None:
                        rows.append((*key, cp, font.advance(g) / font.units, 0.0, 0.0, 0, 0, None, None))
                    else:
                        b = bounds(outline)
                        rows.append((*key, cp, font.advance(g) / font.units, b[0] / font.units, b[3] / font.units, got[0].shape[1], got[0].shape[0], got[0].tobytes(), None))
            yield pd.DataFrame(rows, columns=["family", "weight", "italic", "cp", "advance", "bearing_x", "bearing_y", "width", "height", "pixels", "error"])

    return faces.select("family", "weight", "italic", "cp").mapInPandas(draw, schema)


def field_errors(faces: DataFrame, fonts: Registry, texels: float = TEXELS, padding: int = PADDING, shift: float = 0.25, finer: int = 8) -> DataFrame:
    """family, weight, italic, cp, dx, dy, rmse, worst: how far the coverage that a glyph's field gives is from that of its outline.

    faces: distinct family, weight, italic, cp. Each glyph is compared in place and moved by `shift` texels each way. Masks are made by the
    kernels that draw, `finer` samples a side; what they come to is an expression over the two arrays. Glyphs without a face or an outline stay away.
    """
    shared = faces.sparkSession.sparkContext.broadcast(fonts)
    schema = "family string, weight int, italic boolean, cp int, dx double, dy double, got array<float>, want array<float>"

    def masks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for family, weight, italic, cp in pdf[["family", "weight", "italic", "cp"]].itertuples(index=False):
                try:
                    font = Font(shared.value.resolve(family, int(weight), bool(italic)))
                except FontError:
                    continue
                outline = font.outline(font.cmap[cp]) if cp in font.cmap else []
                drawn_ = A.render(outline, texels / font.units, padding) if outline else None
                if drawn_ is None:
                    continue
                pixels, first = drawn_
                for dx, dy in ((0.0, 0.0), (shift, 0.0), (-shift, 0.0), (0.0, shift), (0.0, -shift)):
                    want = A.coverage(outline, texels / font.units, (first[0] + dx, first[1] + dy), pixels.shape[1], pixels.shape[0], finer)
                    rows.append((family, weight, italic, cp, dx, dy, A.reconstruct(pixels, 1.0, dx, dy).astype(np.float32).ravel(), want.astype(np.float32).ravel()))
            yield pd.DataFrame(rows, columns=["family", "weight", "italic", "cp", "dx", "dy", "got", "want"])

    made = faces.select("family", "weight", "italic", "cp").mapInPandas(masks, schema)
    return made.withColumn("e", M.error(F.col("got"), F.col("want"))).select("family", "weight", "italic", "cp", "dx", "dy", "e.rmse", "e.worst")


def build(corpus: Corpus, fonts: Registry, texels: float = TEXELS, padding: int = PADDING) -> DataFrame:
    """doc_id, font_id, atlas, missing array<int>: an atlas for each face of each document. A face that no font fits has no atlas."""
    if not (isfinite(texels) and texels > 0):
        raise ValueError("texels per em must be a positive number")
    if padding < 1:
        raise ValueError("padding must be one texel at least")
    used = corpus.codepoints
    glyphs = drawn(used.select("family", "weight", "italic", "cp").distinct(), fonts, texels, padding)
    rows = used.join(glyphs, ["family", "weight", "italic", "cp"]).join(corpus.faces, ["doc_id", "family", "weight", "italic"])
    side = R.page_size(F.size("rows"))
    by = rows.groupBy("doc_id", "font_id", "family", "weight", "italic").agg(F.sort_array(F.collect_list(F.struct("cp", "advance", "bearing_x", "bearing_y", "width", "height", "pixels", "error"))).alias("rows")).withColumn("side", side)
    shared = corpus.spark.sparkContext.broadcast(fonts)

    def assemble(batches: Iterator) -> Iterator:
        for b in batches:
            out = []
            for r in b.to_pylist():
                have = [g for g in r["rows"] if g["error"] is None]
                missing = [g["cp"] for g in r["rows"] if g["error"] == "missing"]
                if not have and not missing:
                    continue
                font = Font(shared.value.resolve(r["family"], r["weight"], r["italic"]))
                side = r["side"]
                boxes = [g for g in have if g["pixels"] is not None]
                side = max([side, *(max(g["width"], g["height"]) for g in boxes)])
                order = sorted(range(len(boxes)), key=lambda i: (-boxes[i]["height"], i))
                placed = A.pack([(boxes[i]["width"], boxes[i]["height"]) for i in order], side, side)
                at = {boxes[i]["cp"]: p for i, p in zip(order, placed)}
                pixels = [np.frombuffer(boxes[i]["pixels"], np.uint8).reshape(boxes[i]["height"], boxes[i]["width"], 4) for i in order]
                pages = A.page_of(pixels, placed, side, side) or [np.zeros((side, side, 4), np.uint8)]
                records = [{
                    "codepoint": g["cp"], "advance": g["advance"], "bearing_x": g["bearing_x"], "bearing_y": g["bearing_y"], "box_x": at.get(g["cp"], (0, 0, 0))[0], "box_y": at.get(g["cp"], (0, 0, 0))[1],
                    "box_w": g["width"] or 1, "box_h": g["height"] or 1, "page_index": at.get(g["cp"], (0, 0, 0))[2], "flags": int(g["pixels"] is None) | 2 * (g["advance"] == 0),
                } for g in have]
                kerning = [{"left": a, "right": c, "adjust": v / font.units} for (a, c), v in font.kerning(g["cp"] for g in have).items()]
                atlas = {
                    "font_id": r["font_id"], "padding": padding, "texels_per_em": round(texels * 1024), **font.metrics(), "family": r["family"], "weight": r["weight"], "italic": r["italic"], "page_width": side, "page_height": side,
                    "glyphs": records, "kerning": kerning, "pages": [p.tobytes() for p in pages],
                }
                out.append({"doc_id": r["doc_id"], "font_id": r["font_id"], "atlas": atlas, "missing": missing})
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    schema = corpus.spark.createDataFrame([], f"doc_id long, font_id int, atlas {ATLAS}, missing array<int>").schema
    arrow = to_arrow_schema(schema)
    return by.mapInArrow(assemble, schema)


def missing_codepoints(atlases: DataFrame) -> DataFrame:
    """doc_id, cp: what no face of a document's atlases, nor a supplementary one, has."""
    return atlases.select("doc_id", F.explode("missing").alias("cp")).distinct()
