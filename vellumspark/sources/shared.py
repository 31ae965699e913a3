"""Tables that are written once and read by many views, and go when they have served."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Bytes of a join's side, as measured when it is shuffled, up to which it is broadcast. The size of its file says little of a table of
#: arrays, repeated values or built columns, and what is broadcast passes through the driver.
BROADCAST = "2m"
#: Whether the files of an execution's shuffles go when it ends; else they stay until the driver's garbage is collected.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


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


_scopes: list[dict[str, SparkSession]] = []


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """df, written to a path or to a new one in the shared folder and read again. One in the shared folder goes at the end of the scope that it was written in."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", BROADCAST)
    at = path or f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    # for this write alone: rows that an iterator still fetches must stay
    before = spark.conf.get(FREED, "false")
    spark.conf.set(FREED, "true")
    try:
        df.write.mode("overwrite").parquet(at)
    finally:
        spark.conf.set(FREED, before)
    out = spark.read.schema(df.schema).parquet(at)
    if path is None:
        out._written_at = at
        if _scopes:
            _scopes[-1][at] = spark
    return out


def _deleted(spark: SparkSession, at: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def dropped(*dfs: DataFrame) -> None:
    """Tables that written() made inside a scope are deleted now; those of no scope stay."""
    for df in dfs:
        for made in _scopes:
            if spark := made.pop(df._written_at, None):
                _deleted(spark, df._written_at)


def spread(df: DataFrame) -> DataFrame:
    """df dealt evenly over as many tasks as a shuffle has. A table of a few megabytes may be one file of one row group, so one task, and yet be hours of parsing."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


@contextmanager
def scope() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that written() makes inside are deleted at the end, but for those passed to the function that is given, which belong to the scope around."""
    made: dict[str, SparkSession] = {}
    _scopes.append(made)

    def spare(df: DataFrame) -> DataFrame:
        if spark := made.pop(df._written_at, None):
            if len(_scopes) > 1:
                _scopes[-2][df._written_at] = spark
        return df

    try:
        yield spare
    finally:
        _scopes.pop()
        for at, spark in made.items():
            _deleted(spark, at)
