"""Pictures of a corpus: each source looked up among files, decoded once, and given to the documents that show it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumspark.operators.atlas import ImageError, decode_png

from .compile import Corpus


def decoded(files: DataFrame) -> DataFrame:
    """path, width, height, format, data, error of files(path, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    m = decode_png(bytes(content))
                    rows.append((path, m["width"], m["height"], m["format"], m["data"], None))
                except ImageError as e:
                    rows.append((path, None, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "width", "height", "format", "data", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, width int, height int, format string, data binary, error string")


def read_folder(spark: SparkSession, folder: str) -> DataFrame:
    """path, content of the files below a folder, by their path inside it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    root = "/" + folder.split(":", 1)[-1].strip("/") + "/"
    return files.select(F.regexp_replace("path", "^.*?" + "".join("\\" + c if not c.isalnum() else c for c in root), "").alias("path"), "content")


def load(corpus: Corpus, files: DataFrame) -> DataFrame:
    """doc_id, image_id, src, width, height, format, data, error: the pictures of each document. One that no file matches has an error."""
    wanted = files.join(corpus.images.select(F.col("src").alias("path")).distinct(), "path", "left_semi")
    got = decoded(wanted)
    out = corpus.images.join(got, corpus.images["src"] == got["path"], "left")
    found = F.col("path").isNotNull()
    return out.select("doc_id", "image_id", "src", "width", "height", "format", "data", F.when(~found, F.concat(F.lit("image not found: "), "src")).otherwise(F.col("error")).alias("error"))
