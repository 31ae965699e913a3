"""Documents as they arrive: files parsed, compiled and packed row by row, each document once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumspark.sources import documents

FILE = "path string, modificationTime timestamp, length long, content binary"


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """A stream of (doc_id, path, kind, source, arrived) from a folder of HTML and Markdown files; doc_id is a hash of the path."""
    files = spark.readStream.format("binaryFile").schema(FILE).load(path)
    text = F.when(F.expr("is_valid_utf8(cast(content as string))"), F.col("content").cast("string"))
    return files.select(F.xxhash64("path").alias("doc_id"), "path", documents.kind_of(F.col("path")).alias("kind"), text.alias("source"), F.col("modificationTime").alias("arrived"))


def chunk_counts(stream: DataFrame) -> DataFrame:
    """(doc_id, kind, n) of each arriving document: parsing keeps no state, so each batch stands alone."""
    parsed = documents.parse(stream.where("kind is not null"))
    per = F.aggregate("chunks", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<int>")), lambda m, c: F.map_concat(F.map_filter(m, lambda k, _: k != c["kind"]), F.create_map(c["kind"], F.coalesce(m[c["kind"]], F.lit(0)) + 1)))
    return parsed.select("doc_id", F.explode(per).alias("kind", "n"))


def distinct_sources(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """The stream with source_digest, each content once within the delay."""
    return stream.withColumn("source_digest", F.sha2("source", 256)).withWatermark("arrived", delay).dropDuplicatesWithinWatermark(["source_digest"])
