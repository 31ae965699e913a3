"""Canonical exact document fingerprints. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import join_bounded, keep, read

#: Ids in a bucket whose texts are ordered together; a bucket's rows are what one window buffers.
IDS = 1024
#: Ranges of buckets, and so rows that meet on the driver, when the bucket after each is looked up.
RANGES = 256


def canonical(text: Column) -> Column:
    """NFKC, case folding (upper, then lower, sharp s as ss, one sigma), every run of Unicode white space one space, none at the ends.

    Texts of ASCII alone skip the normaliser. It is the one of ICU, which Spark brings; Spark SQL has no function for it.
    """
    fold = F.lower(F.upper(text))
    nfkc = lambda x: F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), x, F.lit(True))
    other = nfkc(F.translate(F.replace(F.lower(F.upper(nfkc(text))), F.lit("ß"), F.lit("ss")), "ς", "σ"))
    full = F.when(text.rlike(r"[^\x00-\x7F]"), other).otherwise(fold)
    return F.trim(F.regexp_replace(full, r"[\s\x1C-\x1F\x85\p{Z}]+", " "))


def wide(text: Column) -> Column:
    """128 bits of xxhash as 32 hex digits."""
    digits = lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")
    return F.concat(digits(F.xxhash64(text)), digits(F.xxhash64(F.lit("second"), text, F.length(text))))


def next_buckets(heads: DataFrame) -> DataFrame:
    """heads(bucket) and the bucket before it (null for the first), without sorting all buckets in one task."""
    cuts = heads.stat.approxQuantile("b", [i / RANGES for i in range(1, RANGES)], 0.5 / RANGES) if heads.head() else []
    cuts = sorted({int(c) for c in cuts})
    part = F.lit(0)
    if cuts:
        part = F.aggregate(F.array(*[F.lit(c).cast("long") for c in cuts]), F.lit(0), lambda n, c: n + (c <= F.col("bucket")).cast("int"))
    heads = heads.withColumn("part", part)
    ends = {r["part"]: r["z"] for r in heads.groupBy("part").agg(F.max("bucket").alias("z")).collect()}
    last, before = {}, None
    for p in sorted(ends):
        last[p], before = before, ends[p]
    first = F.lit(None).cast("long")
    for p, z in last.items():
        if z is not None:
            first = F.when(F.col("part") == p, F.lit(z).cast("long")).otherwise(first)
    return heads.withColumn("before", F.coalesce(F.lag("bucket").over(W.partitionBy("part").orderBy("bucket")), first))


def pairs(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, canon, ...) with the columns of the next row as next_*: by doc_id, then a hash of the text; the first after the last.

    Texts shuffle once, by bucket of ids; the first row of each bucket also goes to the bucket before. Null ids come last, in
    buckets of their own by the leading bits of that hash, as many as their number asks for.
    """
    bits = (docs.where("doc_id is null").count() // IDS).bit_length()
    spare = F.lit((1 << 63) // IDS)
    if bits:
        spare += F.shiftright(F.xxhash64("text"), 64 - bits) + (1 << bits - 1)
    docs = docs.withColumn("bucket", F.coalesce(F.expr(f"doc_id div {IDS}"), spare).cast("long"))
    heads = keep(docs.groupBy("bucket").agg(F.min(F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("id"), F.xxhash64("text").alias("h"))).alias("x")).select("bucket", "x.id", "x.h"), "heads")
    order = next_buckets(heads.withColumn("b", F.col("bucket").cast("double")))
    end = heads.agg(F.max("bucket")).head()[0]
    order = order.select(F.col("id").alias("_id"), F.col("h").alias("_h"), F.coalesce("before", F.lit(end)).cast("long").alias("goes"))
    docs = docs.withColumn("_id", F.coalesce("doc_id", F.lit((1 << 63) - 1))).withColumn("_h", F.xxhash64("text"))
    both = join_bounded(docs, order, ["_id", "_h"], "left")
    # each row in its bucket; the head of a bucket once more, behind the rows of the bucket before
    both = both.withColumn("place", F.explode(F.when(F.col("goes").isNull(), F.array(F.struct(F.col("bucket").alias("at"), F.lit(0).alias("tail")))).otherwise(F.array(F.struct(F.col("bucket").alias("at"), F.lit(0).alias("tail")), F.struct(F.col("goes").alias("at"), F.lit(1).alias("tail"))))))
    line = W.partitionBy("at").orderBy("tail", "_id", "_h")
    both = both.select(F.col("place.at").alias("at"), F.col("place.tail").alias("tail"), "_id", "_h", "doc_id", "text", "canon", "hash")
    for c in ("text", "canon", "hash"):
        both = both.withColumn(f"next_{c}", F.lead(c).over(line))
    return both.where("tail = 0").drop("at", "tail", "_id", "_h")


def fingerprints(docs: DataFrame) -> DataFrame:
    """A row for each of docs(doc_id, text): doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Method: the text is made canonical and digested to 128 bits of xxhash. Where several texts share a digest their
    canonical bytes are compared; a bucket that holds different ones (a collision) adds the SHA-256 of the canonical text to
    the fingerprints in it. An exact digest knows no degrees: likeness is 1.0 for equal canonical texts and else 0.0.

    Null text: empty. One document is its own next. Repeated rows follow one another, rows that share an id in the order of a
    hash of their texts. Null ids come last, ordered likewise. Empty table: no rows. Other columns aren't read. Texts that
    differ in case, white space or compatibility forms alone are equal.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    d = d.withColumn("canon", canonical(F.col("text"))).withColumn("hash", wide(F.col("canon")))
    p = pairs(d)
    half = F.floor(F.length("text") / 2).cast("int")
    p = p.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(F.col("next_text"), F.lit(1), half)))
    p = p.select("doc_id", "text", "canon", "hash", "next_canon", "edited").withColumn("edited_canon", canonical(F.col("edited")))
    p = keep(
        p.select(
            "doc_id",
            F.length("text").cast("long").alias("n_chars"),
            F.sha2(F.col("edited"), 256).alias("edited_sha256"),
            "hash",
            wide(F.col("edited_canon")).alias("edited_hash"),
            F.sha2(F.col("canon"), 256).alias("sha"),
            F.sha2(F.col("edited_canon"), 256).alias("edited_sha"),
            (F.col("canon") == F.col("edited_canon")).cast("double").alias("near_edited"),
            (F.col("canon") == F.col("next_canon")).cast("double").alias("near_next"),
        ),
        "fingerprints",
    )
    collided = collisions(d.select("hash", "canon"), p)
    if collided.head() is not None:
        for h, s in (("hash", "sha"), ("edited_hash", "edited_sha")):
            p = join_bounded(p, collided.select(F.col("hash").alias(h), F.lit(True).alias("hit")), [h], "left")
            p = p.withColumn(h, F.when(F.col("hit"), F.concat(h, F.lit("-"), s)).otherwise(F.col(h))).drop("hit")
    return p.select("doc_id", "n_chars", "edited_sha256", F.col("hash").alias("fingerprint"), F.col("edited_hash").alias("edited_fingerprint"), "near_edited", "near_next")


def collisions(texts: DataFrame, p: DataFrame) -> DataFrame:
    """Digests shared by different canonical texts: by bytes among the documents, by SHA-256 where edited texts take part.

    Only texts whose digest repeats are grouped, by digest and bytes; equal texts meet in the map side of that sum.
    """
    shared = p.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash")
    same = join_bounded(texts, shared, ["hash"], "left_semi").groupBy("hash", "canon").agg(F.lit(1).alias("one"))
    by_bytes = same.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash")
    all_ = p.select("hash", "sha").unionByName(p.select(F.col("edited_hash").alias("hash"), F.col("edited_sha").alias("sha")))
    by_sha = all_.groupBy("hash").agg(F.min("sha").alias("a"), F.max("sha").alias("z")).where("a <> z").select("hash")
    return keep(by_bytes.unionByName(by_sha).distinct(), "collisions")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(read(spark, sf_dir, "documents"))
