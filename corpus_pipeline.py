"""A corpus, from documents to packed sequences, in five stages. Each is written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumspark.llm import jaccard, language, linededup, mixing, packing
from vellumspark.llm.common import join_bounded, keep, scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known: those that the classifier, fitted on their own labels, calls `und` go, which are null
    and empty texts and texts without a letter. Without labels to fit on these go too. Null and repeated ids are rows of their
    own. Empty table: no rows. Columns other than those of documents are left out."""
    docs = docs.select(*COLUMNS)
    model = language.learn(docs)
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    return language.identify(docs, model).where(F.col("lang_pred") != language.NONE).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less the chunks of lines that occur earlier. One that has lost chunks and keeps no word goes. Of equal texts the
    one of the smallest id keeps its lines. Null and empty texts and rows with a null id stay as they are; rows that repeat an id
    lose their own chunks. Empty table: no rows."""
    out = linededup.dedup(docs.select(*COLUMNS))
    out = out.where((F.col("n_dropped") == 0) | F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(True)))
    return out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def row_hash() -> Column:
    """A hash of a row's columns; only equal rows share it."""
    return F.xxhash64(*COLUMNS, *(F.col(c).isNull() for c in COLUMNS))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, 0.8): the one of the smallest id. Rows whose id is null or repeated
    are documents of their own, which stand behind those of other ids; of equal rows one stays. Null and empty texts resemble
    nothing and stay. Empty table: no rows."""
    docs = docs.select(*COLUMNS)
    odd = keep(docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").select("doc_id"), "odd")
    if odd.head() is None:
        return left_of(docs, "doc_id")
    docs = join_bounded(docs, odd.where("doc_id is not null").withColumn("_odd", F.lit(True)), ["doc_id"], "left")
    docs = docs.withColumn("_odd", F.col("doc_id").isNull() | F.col("_odd").isNotNull())
    # keys from 2 ** 62 on
    own = row_hash().bitwiseAND(F.lit(2**62 - 1)).bitwiseOR(F.lit(2**62))
    left = left_of(docs.withColumn("_row", F.when(F.col("_odd"), own).otherwise(F.col("doc_id"))), "_row")
    return left.where("not _odd").select(*COLUMNS).unionByName(left.where("_odd").select(*COLUMNS).dropDuplicates())


def left_of(docs: DataFrame, key: str) -> DataFrame:
    """docs less those that resemble one of a smaller key."""
    with scratch() as stays:
        classes = jaccard.similarity_classes(docs.select(F.col(key).alias("doc_id"), "text"), words_each=5, percent=80)
        gone = keep(classes.where("doc_id <> component_id").select(F.col("doc_id").alias(key)).distinct(), "gone")
        stays.append(gone)
    return join_bounded(docs, gone, [key], "left_anti")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in whole documents: the words taken over the document's words, rounded. Rows whose
    id is null or repeated have takes of their own; equal rows share theirs. Null and empty texts have no word to take and go.
    Null sources are a source of their own. Empty table: no rows."""
    docs = docs.select(*COLUMNS).withColumn("_row", row_hash()).withColumn("_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")))
    with scratch() as stays:
        taken = times(docs)
        stays.append(taken)
    out = join_bounded(docs, taken, ["_id", "_row"])
    if taken.where("_n > 1").head() is not None:
        out = out.where("_n = 1").unionByName(out.where("_n > 1").dropDuplicates())
    return out.withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(*COLUMNS)


def times(docs: DataFrame) -> DataFrame:
    """_id, _row, how many rows share them, and how often each of these is taken."""
    taken = mixing.mix(docs, carry=["_row"]).where("size > 0").withColumn("_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")))
    taken = taken.groupBy("_id", "_row").agg(F.sum(F.round(F.col("taken") / F.col("size"))).cast("int").alias("_times"), F.count("*").alias("_n"))
    return keep(taken.where("_times > 0"), "times")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces and their places in sequences. Null text is empty, and an empty text one piece of the end id alone.
    Null and repeated ids are rows of their own. Empty table: no rows."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language", identified),
    ("line dedup", lines),
    ("n-gram jaccard", distinct),
    ("source mix", mixed),
    ("best-fit packing", packed),
]
#: Some stages have no counterpart in SQL; they are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents that pass the stages, packed. Nulls, repeats and empty tables: as each stage says."""
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        df = stage(spark, df, sf_dir)
        if k < len(STAGES) - 1:
            df = keep(df, f"stage-{k}")
    return df
