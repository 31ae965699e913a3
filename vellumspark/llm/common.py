"""Shared folders, bounded joins, connected components."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of at most so many bytes is broadcast; beyond it the join shuffles. A narrow side (a few numbers a row) counts 16
#: bytes a row and 8 a column; the size of one with arrays or bytes is summed.
BROADCAST_BYTES = 2_000_000
#: Bits of a sieve at most: 4 MB.
SIEVE_BITS = 25
#: Characters of a plan that the driver keeps of each query it has run, for its status pages. A session of thousands of queries holds
#: a thousand of them, and again at each step that they are planned anew.
PLAN_TEXT = 4096


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, or the one the context was given. Where both are unset a local master (tests, one
    machine) gets a new temporary folder; on a cluster no folder of one machine would do, so that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="vellumspark-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


_made: list[list[DataFrame]] = []


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: lineage ends there, and a lost executor costs nothing."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.maxPlanStringLength", str(PLAN_TEXT))
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    kept._kept_at = path
    for made in _made:
        made.append(kept)
    return kept


def discard(*tables: DataFrame) -> None:
    """Delete tables that keep() wrote and that nothing to come reads. Spark removes shuffle files of plans that are garbage on
    the driver, so it is asked to collect that."""
    for df in tables:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._kept_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
    for df in tables[:1]:
        tidy(df.sparkSession)


def tidy(spark: SparkSession) -> None:
    """Have the driver collect garbage: shuffle files of plans that nothing refers to go with it."""
    gc.collect()
    spark._jvm.System.gc()


@contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """Tables that keep() writes inside are deleted at the end, but for those put into the list that is given."""
    spared: list[DataFrame] = []
    _made.append([])
    try:
        yield spared
    finally:
        made = _made.pop()
        discard(*[t for t in made if not any(t is s for s in spared)])


def small_batches(spark: SparkSession) -> None:
    """Python stages see at most 1,000 rows at a time, so a batch of long texts stays small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def fits(small: DataFrame) -> int:
    """Rows of a narrow side that are broadcast at most."""
    return BROADCAST_BYTES // (16 + 8 * len(small.columns))


def join_bounded(big: DataFrame, small: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join with a narrow side that is counted first: up to BROADCAST_BYTES it is broadcast, beyond that both sides shuffle by the key."""
    if small.limit(fits(small) + 1).count() <= fits(small):
        return big.join(F.broadcast(small), list(on), how)
    return big.join(small.hint("merge"), list(on), how)


@dataclass
class Sieve:
    """Which hashes of a set of keys occur, as a bitmap of SIEVE_BITS at most: every key of the set passes, and few others."""

    words: Broadcast
    shift: int

    def passes(self, keys: Sequence[str]) -> Column:
        words, shift = self.words, np.uint64(self.shift)

        @F.pandas_udf("boolean")
        def ask(h: pd.Series) -> pd.Series:
            at = h.to_numpy(np.int64).view(np.uint64) >> shift
            return pd.Series((words.value[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1)

        return ask(F.xxhash64(*keys))


def sieve(keys: DataFrame, n: int, least: int = 1) -> Sieve | None:
    """A sieve of n keys, or of those that occur `least` times; None if they are so many that half of it would pass anything."""
    bits = min(SIEVE_BITS, max(12, (16 * n).bit_length()))
    if n > 1 << (bits - 1):
        return None
    at = keys.select(F.shiftrightunsigned(F.xxhash64(*keys.columns), 64 - bits).alias("at"))
    if least > 1:
        at = at.groupBy("at").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    got = at.groupBy(F.shiftright("at", 6).alias("k")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("w")).toArrow()
    words = np.zeros(1 << (bits - 6), np.uint64)
    words[got["k"].to_numpy()] = got["w"].to_numpy().view(np.uint64)
    return Sieve(keys.sparkSession.sparkContext.broadcast(words), 64 - bits)


def join_sifted(big: DataFrame, small: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """join_bounded that shuffles, where the side is too large to be broadcast, only rows of big that a sieve of its keys lets through.

    how: inner, left, left_semi or left_anti. A sieve asks Python for each row of big; the keys have the same types on both sides.
    """
    on = list(on)
    n = small.count()
    if n <= fits(small):
        return big.join(F.broadcast(small), on, how)
    s = sieve(small.select(*on), n)
    if s is None:
        return big.join(small.hint("merge"), on, how)
    asked = big.withColumn("_may", s.passes(on))
    met = asked.where("_may").drop("_may").join(small.hint("merge"), on, how)
    if how in ("inner", "left_semi"):
        return met
    return met.unionByName(asked.where("not _may").drop("_may"), allowMissingColumns=True)


def small_enough(side: DataFrame, width: Column) -> DataFrame:
    """A side with the hint that its summed size allows: broadcast up to BROADCAST_BYTES, a merge join beyond. width: bytes of a row."""
    n = side.agg(F.sum(width + 40)).head()[0] or 0
    return F.broadcast(side) if n <= BROADCAST_BYTES else side.hint("merge")


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """Connected components of edges(a long, b long) as (node, component): the smallest node of each.

    Alternates large-star and small-star contractions, each written to the shared folder, until nothing changes. A node
    without edges does not appear. Null ends and self loops are ignored.
    """
    e = keep(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        "edges",
    )
    before = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("x"))
        old, e = e, keep(small.select("x.u", "x.v").where("u <> v").distinct(), "edges")
        discard(old)
        now = e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).head()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    low = e.groupBy("u").agg(F.min("v").alias("c"))
    return low.select(F.col("u").alias("node"), F.col("c").alias("component")).unionByName(
        low.select(F.col("c").alias("node"), F.col("c").alias("component")).distinct()
    )
