"""Maximum inner product search: score-aware anisotropic quantisation, four-bit table scans, exact reranking."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import keep, read

#: Rows that the codebooks are fitted on, at most; every row is encoded and scanned.
FIT_ROWS = 10_000
#: Rows and queries in a block; a task scans one block against another.
ROWS, QUERIES = 16_384, 4_096
#: Rows that are reranked exactly for each query, over all blocks, and of each block at least.
RERANK, RERANK_BLOCK = 512, 64
#: Further rows are reranked down to the k-th best exact score less so many times the root mean square error of the tables.
MARGIN = 2.0
#: Inner products over this share of a vector's norm are what the quantiser is to keep right.
THRESHOLD = 0.2


@dataclass
class Codebooks:
    """Sixteen codewords for each pair of dimensions; dimensions are padded with zeros to a multiple of four."""

    words: np.ndarray  # (pairs, 16, 2)
    penalty: float  # of the squared error along the vector, where the error across it counts 1

    def pad(self, x: np.ndarray) -> np.ndarray:
        return np.pad(x.astype(np.float32), ((0, 0), (0, 2 * len(self.words) - x.shape[1])))

    def assign(self, x: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """Codes (rows, pairs) by coordinate descent on the anisotropic loss, from the nearest codewords."""
        pairs = len(self.words)
        unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)
        codes = np.empty((len(x), pairs), np.uint8)
        along = np.empty((len(x), pairs), np.float32)
        for m in range(pairs):
            e = x[:, None, 2 * m : 2 * m + 2] - self.words[m]
            codes[:, m] = (e**2).sum(2).argmin(1)
            e = x[:, 2 * m : 2 * m + 2] - self.words[m][codes[:, m]]
            along[:, m] = (e * unit[:, 2 * m : 2 * m + 2]).sum(1)
        total = along.sum(1)
        for _ in range(sweeps):
            for m in range(pairs):
                e = x[:, None, 2 * m : 2 * m + 2] - self.words[m]
                p = (e * unit[:, None, 2 * m : 2 * m + 2]).sum(2)
                rest = total - along[:, m]
                loss = (e**2).sum(2) + (self.penalty - 1) * (rest[:, None] + p) ** 2
                k = loss.argmin(1)
                codes[:, m] = k
                along[:, m] = np.take_along_axis(p, k[:, None], 1)[:, 0]
                total = rest + along[:, m]
        return codes


def fit(x: np.ndarray, threshold: float = THRESHOLD, rounds: int = 4) -> Codebooks:
    """Lloyd's codewords per pair, then rounds of anisotropic assignment and its least-squares codewords."""
    d = x.shape[1]
    pairs = 2 * -(-d // 4)
    penalty = max(1.0, (d - 1) * threshold**2 / (1 - threshold**2))
    book = Codebooks(np.zeros((pairs, 16, 2), np.float32), penalty)
    x = book.pad(x)
    spread = np.random.default_rng(7)
    for m in range(pairs):
        y = x[:, 2 * m : 2 * m + 2]
        c = y[spread.choice(len(y), 16, replace=len(y) < 16)].copy()
        for _ in range(10):
            k = ((y[:, None] - c) ** 2).sum(2).argmin(1)
            n = np.bincount(k, minlength=16)
            for j in range(2):
                c[:, j] = np.where(n > 0, np.bincount(k, y[:, j], 16) / np.maximum(n, 1), c[:, j])
        book.words[m] = c
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)
    for _ in range(rounds):
        codes = book.assign(x, 1)
        decoded = np.concatenate([book.words[m][codes[:, m]] for m in range(pairs)], 1)
        total = ((x - decoded) * unit).sum(1)
        for m in range(pairs):
            y, u = x[:, 2 * m : 2 * m + 2], unit[:, 2 * m : 2 * m + 2]
            own = ((y - book.words[m][codes[:, m]]) * u).sum(1)
            rest = total - own
            for k in range(16):
                s = codes[:, m] == k
                if s.any():
                    left = np.eye(2) * s.sum() + (penalty - 1) * u[s].T @ u[s]
                    right = y[s].sum(0) + (penalty - 1) * (u[s] * (rest[s] + (u[s] * y[s]).sum(1))[:, None]).sum(0)
                    book.words[m][k] = np.linalg.solve(left, right)
            total = rest + ((y - book.words[m][codes[:, m]]) * u).sum(1)
    return book


def scan(book: Codebooks, q: np.ndarray, qid: np.ndarray, x: np.ndarray, ids: np.ndarray, codes: np.ndarray, k: int, rerank: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query's place, places, exact scores) of each query's k best rows of a block; rows are in order of id, which breaks ties."""
    small = book.pad(q)
    pairs = len(book.words)
    packed = codes  # one byte holds the codes of two pairs
    for a in range(0, len(q), 128):
        part = small[a : a + 128]
        table = np.einsum("qmd,mkd->qmk", part.reshape(len(part), pairs, 2), book.words).astype(np.float32)
        two = table[:, 0::2, :, None] + table[:, 1::2, None, :]
        two = np.ascontiguousarray(two.reshape(len(part), pairs // 2, 256))
        near = np.zeros((len(part), len(x)), np.float32)
        for m in range(pairs // 2):
            near += np.take(two[:, m], packed[:, m], axis=1)
        for i in range(len(part)):
            s = near[i]
            s[ids == qid[a + i]] = -np.inf
            if len(s) > rerank:
                cut = -np.partition(-s, rerank - 1)[rerank - 1]
                over = np.flatnonzero(s > cut)
                best = np.concatenate([over, np.flatnonzero(s == cut)[: rerank - len(over)]])
            else:
                best = np.arange(len(s))
            best = best[ids[best] != qid[a + i]]
            exact = (x[best] * q[a + i]).sum(1)
            if len(s) > rerank and len(best) > k:
                # rows that the tables' error may have kept out: many rows can be about as near as the k-th
                least = np.partition(exact, len(exact) - k)[len(exact) - k]
                margin = MARGIN * np.sqrt(np.mean((s[best] - exact) ** 2))
                s[best] = -np.inf
                more = np.flatnonzero(s >= least - margin)
                best = np.concatenate([best, more])
                exact = np.concatenate([exact, (x[more] * q[a + i]).sum(1)])
            order = np.lexsort((ids[best], -exact))[:k]
            yield a + i, best[order], exact[order]


def usable(vectors: DataFrame) -> DataFrame:
    """Rows (vec_id, v array<double>) whose vector takes part: of the most frequent length, finite, not zero."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    ok = F.forall("v", lambda y: y.isNotNull() & ~F.isnan(y) & (F.abs(y) < float("inf"))) & F.exists("v", lambda y: y != 0)
    v = v.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(ok)
    most = v.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").head()
    return v.where(F.size("v") == (most["d"] if most else 0))


def search(vectors: DataFrame, k: int = 20, every: int = 20, rerank: int = RERANK) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for each row of vectors(vec_id, embedding) whose id is divisible by `every`.

    Method: codebooks of sixteen words per pair of dimensions are fitted on a sample of FIT_ROWS rows by the anisotropic
    loss, in which error along the vector costs more than error across it. Every row is encoded in four bits a pair. Blocks
    of queries meet blocks of rows; there a query's tables give each row's approximate inner product, the best rows, `rerank` over all blocks
    and RERANK_BLOCK of each at least, and those within MARGIN errors of the k-th best, are compared exactly, in double precision on the original vectors, and the best k of all blocks are kept.

    Ties go to the smaller vec_id. Vectors null, empty, zero, with null, NaN or infinite components, or of another length
    than most, take no part; nor do null ids. Rows with the query's own id aren't its candidates; other repeated ids are
    candidates each. Rows that repeat a query's id with another vector are queries of their own, each with its ranking from 1
    on under that id; repeats of one vector are one query. Fewer than k candidates: all of them. No usable vector: no rows.
    Other columns aren't read.
    """
    spark = vectors.sparkSession
    v = keep(usable(vectors), "vectors")
    n = v.count()
    schema = "query_id long, query long, vec_id long, score double"
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    queries = v.where(F.col("vec_id") % every == 0)
    sample = v.select("v").orderBy(F.xxhash64("vec_id"), "vec_id").limit(FIT_ROWS).toPandas()
    shared = spark.sparkContext.broadcast(fit(np.stack(sample["v"].to_numpy())))
    row_blocks = -(-n // ROWS)
    rerank = max(RERANK_BLOCK, k, -(-rerank // row_blocks))
    query_blocks = max(1, -(-queries.count() // QUERIES))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = shared.value
        for b in batches:
            if len(b):
                x = np.asarray(b.column("v").flatten(), np.float64).reshape(len(b), -1)
                c = book.assign(book.pad(x))
                c = (c[:, 0::2] << 4) | c[:, 1::2]
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array([r.tobytes() for r in x], pa.binary()), pa.array([r.tobytes() for r in c], pa.binary())], names=["vec_id", "x", "codes"])

    def meet(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(asked):
            return pd.DataFrame({"query_id": [], "query": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "query": "int64", "vec_id": "int64"})
        rows = rows.sort_values("vec_id", kind="stable")
        # of equal vectors only the k smallest ids, and the query's own, can be among the k nearest
        rows = rows[rows.groupby("x")["vec_id"].rank("dense") <= k + 1]
        ids = rows["vec_id"].to_numpy(np.int64)
        x = np.frombuffer(b"".join(rows["x"]), np.float64).reshape(len(rows), -1)
        codes = np.frombuffer(b"".join(rows["codes"]), np.uint8).reshape(len(rows), -1)
        q = np.stack(asked["v"].to_numpy()).astype(np.float64)
        qid, own = asked["vec_id"].to_numpy(np.int64), asked["query"].to_numpy(np.int64)
        out = [(np.full(len(at), qid[i]), np.full(len(at), own[i]), ids[at], s) for i, at, s in scan(shared.value, q, qid, x, ids, np.ascontiguousarray(codes), k, rerank)]
        return pd.DataFrame({c: np.concatenate([o[k] for o in out]) for k, c in enumerate(("query_id", "query", "vec_id", "score"))})

    coded = keep(v.mapInArrow(encode, "vec_id long, x binary, codes binary"), "codes")
    left = coded.withColumn("rb", F.pmod(F.xxhash64("vec_id", "x"), F.lit(row_blocks)).cast("int")).withColumn("qb", F.explode(F.array(*map(F.lit, range(query_blocks))) if query_blocks <= 64 else F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    right = queries.dropDuplicates(["vec_id", "v"]).withColumn("query", F.xxhash64("v")).withColumn("qb", F.pmod(F.xxhash64("vec_id"), F.lit(query_blocks)).cast("int")).withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))))
    best = left.groupBy("rb", "qb").cogroup(right.groupBy("rb", "qb")).applyInPandas(meet, schema)
    line = W.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(line)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read(spark, sf_dir, "embeddings"))
