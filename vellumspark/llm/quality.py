"""Quality by supervised subword embeddings: hashed word and character n-gram vectors, averaged, softmax."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep, read, small_batches
from .fitting import fold, labelled_texts, sample_ids
from .textkernel import BLOCK, LOWER, U, blocks, words

#: Labelled rows to learn from, of each label; passes over them.
EACH, EPOCHS = 1200, 12
#: Hash buckets of all features, and dimensions of their vectors.
BITS, DIM = 16, 12
#: Features of all sampled texts together at most (a hash bucket that occurs in a text is one): what the driver fits on. Texts
#: beyond it, by a hash of their id, are left out of the sample.
FIT_FEATURES = 20_000_000
#: Lengths, in characters of lower-case text, of the character n-grams.
LENGTHS = (2, 3, 4)
#: A text is taken for good from this probability on.
LIMIT = 0.3


def features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every word and character n-gram of a block of texts; n-grams hold blanks and punctuation too."""
    low = LOWER[data]
    starts = np.concatenate([[0], np.cumsum((low & 0xC0) != 0x80)])
    size = np.diff(starts[at])
    low = np.frombuffer(low.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
    owner = np.repeat(np.arange(len(at) - 1, dtype=np.int32), size)
    _, _, row, h = words(data, at)
    rows, buckets = [row.astype(np.int32)], [(h >> U(64 - BITS)).astype(np.int32)]
    x = np.zeros(len(low), np.uint32)
    for n in range(1, max(LENGTHS) + 1):
        if len(low) < n:
            break
        x = x[: len(low) - n + 1] * np.uint32(0x01000193) + low[n - 1 :] * np.uint32(0x9E3779B1) + np.uint32(n)
        if n in LENGTHS:
            y = x ^ (x >> np.uint32(15))
            y *= np.uint32(0x85EBCA6B)
            inside = owner[: len(x)] == owner[n - 1 :]
            rows.append(owner[: len(x)][inside])
            buckets.append((y >> np.uint32(32 - BITS)).astype(np.int32)[inside])
    return np.concatenate(rows), np.concatenate(buckets)


@dataclass
class Model:
    vectors: np.ndarray  # (buckets, dim)
    out: np.ndarray  # (dim, 2)
    bias: np.ndarray

    def logits(self) -> np.ndarray:
        """What each bucket adds to the difference of the two outputs: the mean of vectors, then a product, is a mean of these."""
        return (self.vectors @ (self.out[:, 1] - self.out[:, 0])).astype(np.float32)


def fit(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 1) -> Model:
    """Stochastic gradient descent, one text at a time, with a falling rate. bags: (buckets, shares) of each text. Labels weigh
    alike in sum, so a score of one half is where both are equally likely before a text is seen."""
    spread = np.random.default_rng(seed)
    share_of = np.bincount(labels, minlength=2) / max(len(labels), 1)
    weight = np.minimum(1, share_of[::-1] / np.maximum(share_of, 1e-9))
    m = Model(spread.normal(0, 0.1, (1 << BITS, DIM)).astype(np.float32), spread.normal(0, 0.1, (DIM, 2)).astype(np.float32), np.zeros(2, np.float32))
    steps, done = EPOCHS * len(bags), 0
    for _ in range(EPOCHS):
        for i in spread.permutation(len(bags)):
            rate = 1.0 * (1 - done / steps)
            done += 1
            ids, share = bags[i]
            if not len(ids):
                continue
            h = share @ m.vectors[ids]
            z = h @ m.out + m.bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            p *= weight[labels[i]]
            back = m.out @ p
            m.out -= rate * 0.3 * np.outer(h, p)
            m.bias -= rate * 0.03 * p
            # shares are small; dividing by their norm keeps a step on the mean the same for short and long texts
            m.vectors[ids] -= np.outer(share * (rate / float(share @ share)), back) * 0.3
    return m


def learn(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Fit on a bounded sample of labels(doc_id, quality), none of the held-out fold; None if there is no label."""
    ids = keep(sample_ids(labels.where(fold(5) != 0), "quality", EACH, 2 * EACH), "sample")

    def bag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, at in blocks(b.column("text")):
                row, bucket = features(data, at)
                key, n = np.unique(row.astype(np.int64) << BITS | bucket, return_counts=True)
                cut = np.searchsorted(key, np.arange(j - i + 1) << BITS)
                out = [((key[a:z] & ((1 << BITS) - 1)).astype("<u4").tobytes(), n[a:z].astype("<u4").tobytes()) for a, z in zip(cut[:-1], cut[1:])]
                yield pa.RecordBatch.from_arrays([b.column("quality").slice(i, j - i), b.column("doc_id").slice(i, j - i), pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.binary())], names=["quality", "doc_id", "ids", "n"])

    all_ = keep(labelled_texts(docs, ids).select("quality", "doc_id", "text").mapInArrow(bag, "quality int, doc_id long, ids binary, n binary"), "bags")
    size = all_.select("doc_id", (F.octet_length("ids") / 4).alias("n"), F.xxhash64("doc_id").alias("h")).toPandas().sort_values(["h", "doc_id"])
    if size["n"].sum() > FIT_FEATURES:
        fitting = size.loc[size["n"].cumsum() <= FIT_FEATURES, "doc_id"].tolist()
        all_ = all_.where(F.col("doc_id").isin(fitting))
    got = all_.toPandas().sort_values("doc_id")
    if not len(got):
        return None
    bags = []
    for a, n in zip(got["ids"], got["n"]):
        share = np.frombuffer(n, "<u4").astype(np.float32)
        bags.append((np.frombuffer(a, "<u4").astype(np.int64), share / max(share.sum(), 1)))
    return fit(bags, (got["quality"] == 1).to_numpy(int))


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score, predicted for every row of docs(doc_id, text).

    Method: the hashed vectors of a whole text's words and character n-grams are averaged and go through a softmax of two
    outputs; vectors and outputs are learned together by stochastic gradient descent in numpy. As all is linear up to the
    softmax, scoring reads one number per bucket.

    Null or empty text: the score of the outputs' bias. No label: score 1, as nothing speaks against a text. Null and
    repeated ids: rows of their own. Empty table: no rows. Other columns aren't read.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(None if model is None else (model.logits(), float(model.bias[1] - model.bias[0])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = np.ones(len(b))
            if shared.value is not None:
                table, bias = shared.value
                for i, j, data, at in blocks(b.column("text"), BLOCK // 2):
                    row, bucket = features(data, at)
                    n = np.bincount(row, minlength=j - i)
                    z = np.bincount(row, table[bucket], j - i) / np.maximum(n, 1) + bias
                    p[i:j] = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(p), pa.array((p >= LIMIT).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, predicted int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, learn(docs, read(spark, sf_dir, "labels").select("doc_id", "quality")))
    return out.select("doc_id", (fold(5) == 0).alias("held_out"), "score", "predicted")
