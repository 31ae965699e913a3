"""Language identification with a blended-spectrum string kernel, Nystrom landmarks and one-versus-rest ridge regression."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import keep, read, small_batches
from .fitting import fold, labelled_texts, sample_ids

#: Character n-grams up to this length, together hashed to so many features.
LONGEST, BITS = 4, 14
#: Labelled rows to learn from, for each language and in all, and how many of them are landmarks.
EACH, FIT_ROWS, LANDMARKS = 500, 3000, 256
RIDGE = 1e-2
NONE = "und"
#: Characters handled at once.
RUN = 400_000


def presence(texts: list[str]) -> np.ndarray:
    """(texts, 2**BITS) of 0 and 1: which hashed n-grams occur in each whole text, in lower case."""
    out = np.zeros((len(texts), 1 << BITS), np.uint8)
    flat = out.reshape(-1)
    low = [t.lower() for t in texts]
    size = np.array([len(t) for t in low], np.int64)
    u = np.frombuffer("".join(low).encode("utf-32-le", "replace"), np.uint32)
    base = np.repeat(np.arange(len(low), dtype=np.int64) << BITS, size)
    h = np.zeros(len(u), np.uint32)
    for n in range(1, LONGEST + 1):
        if len(u) < n:
            break
        h = h[: len(u) - n + 1] * np.uint32(0x01000193) + u[n - 1 :] * np.uint32(0x9E3779B1) + np.uint32(n)
        x = h ^ (h >> np.uint32(15))
        x *= np.uint32(0x85EBCA6B)
        inside = base[: len(h)] == base[n - 1 :]
        at = base[: len(h)] + (x >> np.uint32(32 - BITS))
        flat[at[inside]] = 1
    return out


def runs(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts): rows of about RUN characters together; null is empty."""
    held: list[str] = []
    n = first = 0
    for i, t in enumerate(column.to_pylist()):
        held.append(t or "")
        n += len(held[-1])
        if n >= RUN or len(held) >= 256:
            yield first, held
            held, n, first = [], 0, i + 1
    if held:
        yield first, held


@dataclass
class Model:
    names: list[str]
    landmarks: np.ndarray  # (features, landmarks), scaled to length 1
    weights: np.ndarray  # (landmarks, names)
    sharpness: float

    def kernel(self, x: np.ndarray) -> np.ndarray:
        norm = np.sqrt(np.maximum(x.sum(1, dtype=np.int64), 1)).astype(np.float32)
        return (x.astype(np.float32) @ self.landmarks) / norm[:, None]

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        s = self.kernel(x) @ self.weights
        p = np.exp(self.sharpness * (s - s.max(1, keepdims=True)))
        return s.argmax(1), 1 / p.sum(1)


def fit(x: np.ndarray, labels: list[str]) -> Model:
    """Kernel ridge regression on Nystrom features. x: presence rows, by a random order."""
    names = sorted(set(labels))
    y = np.array([names.index(n) for n in labels])
    m = min(LANDMARKS, len(x))
    z = x[:m].astype(np.float32)
    model = Model(names, np.ascontiguousarray((z / np.sqrt(np.maximum(z.sum(1, keepdims=True), 1))).T), np.zeros((m, len(names)), np.float32), 1.0)
    k = np.concatenate([model.kernel(x[a : a + 256]) for a in range(0, len(x), 256)]).astype(np.float64)
    values, vectors = np.linalg.eigh(k[:m])
    root = vectors / np.sqrt(np.maximum(values, 1e-6 * max(values.max(), 1e-6)))
    phi = k @ root
    target = np.where(y[:, None] == np.arange(len(names)), 1.0, -1.0)
    w = np.linalg.solve(phi.T @ phi + RIDGE * len(x) / m * np.eye(m), phi.T @ target)
    model.weights = (root @ w).astype(np.float32)
    s = k @ model.weights
    best = (np.inf, 1.0)
    for t in (0.5, 1, 2, 3, 4, 6, 8):
        e = np.exp(t * (s - s.max(1, keepdims=True)))
        best = min(best, (float(-np.log(np.maximum((e / e.sum(1, keepdims=True))[np.arange(len(y)), y], 1e-12)).mean()), float(t)))
    model.sharpness = best[1]
    return model


def learn(docs: DataFrame) -> Model | None:
    """Fit on labelled rows of docs(doc_id, text, lang) outside the held-out fold; None if there are none."""
    ids = keep(sample_ids(docs.select("doc_id", "lang").where(fold(4) != 2), "lang", EACH, FIT_ROWS), "sample")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, texts in runs(b.column("text")):
                bits = np.packbits(presence(texts), axis=1)
                yield pa.RecordBatch.from_arrays([b.column("lang").slice(first, len(texts)), b.column("h").slice(first, len(texts)), pa.array([r.tobytes() for r in bits], pa.binary())], names=["lang", "h", "bits"])

    texts = labelled_texts(docs, ids).select("lang", F.xxhash64(F.lit("order"), "doc_id").alias("h"), "text")
    got = texts.mapInArrow(features, "lang string, h long, bits binary").toPandas().sort_values(["h", "lang"], kind="stable")
    if not len(got):
        return None
    x = np.unpackbits(np.frombuffer(b"".join(got["bits"]), np.uint8).reshape(len(got), -1), axis=1)
    return fit(x, got["lang"].tolist())


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with lang_pred string and score double after its columns.

    Method: a text is the set of its character n-grams of 1 to 4 characters; two texts' kernel is the cosine of their sets,
    over a blend of all lengths. Landmarks are a sample of the training texts; a ridge regression per language is solved on
    the Nystrom features of the training rows, and a batch of texts is scored by two matrix products. The score is the
    softmax of the regressions' outputs, with a sharpness fitted on the training rows.

    Null text, and text without a letter: `und`, score 0. No labelled row: all `und`. Empty table: no rows. Whole texts are
    read. A column of docs named lang_pred or score is replaced.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            names: list[str] = []
            scores: list[float] = []
            for _, texts in runs(b.column(at)):
                if model is None:
                    names += [NONE] * len(texts)
                    scores += [0.0] * len(texts)
                    continue
                k, s = model.predict(presence(texts))
                for t, i, v in zip(texts, k, s):
                    letters = any(map(str.isalpha, t))
                    names.append(model.names[i] if letters else NONE)
                    scores.append(float(v) if letters else 0.0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*b.schema.names, "lang_pred", "score"])

    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(predict, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = identify(docs.select("doc_id", "text"), learn(docs.select("doc_id", "text", "lang")))
    return out.select("doc_id", (fold(4) == 2).alias("held_out"), "lang_pred", "score")
