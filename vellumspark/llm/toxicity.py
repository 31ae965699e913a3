"""Toxic passages as maximal scoring segments of token log-odds, judged by extreme-value statistics."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep, read, small_batches
from .fitting import fold, labelled_texts, sample_ids
from .textkernel import LOWER, PUNCT, U, blocks, mix, spans, words

#: Labelled rows to learn from, of each label; two thirds of them give the counts, the others the calibration.
EACH = 4000
#: Tokens in fewer of the counted texts are unknown; so many are kept at most, by evidence.
LEAST, TOKENS = 3, 60_000
#: Weights of the Dirichlet prior, as shares of all counts, and what is taken from every token's log-odds so that a neutral passage
#: scores below zero: those to choose from, by the calibration rows' log-loss.
PRIORS, DRIFTS = (0.1, 0.2, 0.4), (0.5, 1.0, 1.5)
#: Bytes of a word's stems, which are tokens too; the token of the strongest log-odds stands for the word.
STEMS = (3, 4, 5, 6)


def tokens(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """(first byte, end byte, row, hashes of the word and of its stems) of every word between punctuation."""
    a, b, row, h = words(data, at, PUNCT)
    low = LOWER[data]
    return a, b, row, [h, *(mix(spans(low, a, np.minimum(b, a + n)) + U(n)) for n in STEMS if len(a))]


def segments(s: np.ndarray) -> list[tuple[float, int, int]]:
    """All maximal scoring segments (score, first, end) of a sequence of token scores, in linear time.

    A segment starts at a low and ends at a high of the running total. `back` leads to the last open segment with a smaller
    low, past those that can't be extended; where there is none, all open segments are final.
    """
    total = np.concatenate([[0.0], np.cumsum(s)])
    done: list[tuple[float, float, int, int]] = []
    open_: list[tuple[float, float, int, int]] = []  # low, high, first, end
    back: list[int] = []
    for i in np.flatnonzero(s > 0).tolist():
        low, high, first = float(total[i]), float(total[i + 1]), i
        j = len(open_) - 1
        while j >= 0 and open_[j][0] >= low:
            j = back[j]
        while j >= 0 and open_[j][1] < high:
            low, first = open_[j][0], open_[j][2]
            up = back[j]
            del open_[j:], back[j:]
            j = up
        if j < 0:
            done += open_
            open_, back = [], []
        open_.append((low, high, first, i + 1))
        back.append(j)
    return [(z - a, f, e) for a, z, f, e in done + open_]


@dataclass
class Model:
    known: np.ndarray  # hashes of tokens, sorted
    scores: np.ndarray
    rate: float  # lambda and log K of the extreme-value law of neutral texts
    log_k: float
    slope: float = 1.0
    shift: float = 0.0
    drift: float = 0.7

    def token_scores(self, hashes: list[np.ndarray]) -> np.ndarray:
        s = np.zeros(len(hashes[0]))
        if len(self.known):
            for x in hashes:
                k = np.minimum(np.searchsorted(self.known, x), len(self.known) - 1)
                v = np.where(self.known[k] == x, self.scores[k], 0)
                s = np.where(np.abs(v) > np.abs(s), v, s)
        return s - self.drift

    def evidence(self, s: np.ndarray) -> tuple[float, list[tuple[float, int, int]]]:
        """(evidence, the segments it rests on): the best over r of the r best segments' summed normalised scores."""
        found = sorted(segments(s), reverse=True)
        base = self.log_k + math.log(max(len(s), 1))
        best, sum_, n = -base, 0.0, 0
        for r, (score, _, _) in enumerate(found, 1):
            sum_ += self.rate * score - base
            if r == 1 or sum_ > best:
                best, n = sum_, r
            elif self.rate * score < base:
                break
        return best, found[:n]

    def probability(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, self.slope * evidence + self.shift))))


def per_text(b: pa.RecordBatch, models: list[Model]) -> Iterator[tuple[int, int, float, list[tuple[float, int, int]], np.ndarray, np.ndarray, int]]:
    """(model, row, evidence, segments, token starts, token ends, first byte) of each text of a batch under each model."""
    for i, j, data, at in blocks(b.column("text")):
        a, z, row, hashes = tokens(data, at)
        cut = np.searchsorted(row, np.arange(j - i + 1))
        for m, model in enumerate(models):
            s = model.token_scores(hashes)
            for r in range(j - i):
                own = slice(cut[r], cut[r + 1])
                evidence, found = model.evidence(s[own])
                yield m, i + r, evidence, found, a[own], z[own], int(at[r])


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on a bounded sample of labels(doc_id, toxic), none of the held-out fold. The prior's weight and the drift are those of PRIORS and
    DRIFTS under which the sample's calibration rows, which gave no counts, have the least log-loss."""
    ids = keep(sample_ids(labels.where(fold(5) != 0), "toxic", EACH, 2 * EACH), "sample")
    texts = keep(labelled_texts(docs, ids).withColumn("part", F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.lit(3))), "texts")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            toxic = b.column("toxic").to_numpy(zero_copy_only=False)
            for i, j, data, at in blocks(b.column("text")):
                _, _, row, hashes = tokens(data, at)
                h, row = np.concatenate(hashes), np.tile(row, len(hashes))
                # a text counts once for each of its tokens
                order = np.lexsort((h, row))
                h, row = h[order], row[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
                h, y = h[new], (toxic[i:j] == 1)[row[new]]
                for kind in (0, 1):
                    v, n = np.unique(h[y == kind], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(v.view(np.int64)), pa.array(np.full(len(v), kind, np.int64)), pa.array(n.astype(np.int64))], names=["token", "kind", "n"])

    counts = texts.where("part > 0").select("toxic", "text").mapInArrow(count, "token long, kind long, n long")
    counts = counts.groupBy("token").agg(F.sum(F.when(F.col("kind") == 1, F.col("n")).otherwise(0)).alias("y"), F.sum(F.when(F.col("kind") == 0, F.col("n")).otherwise(0)).alias("x"))
    counts = keep(counts, "counts")
    sums = counts.agg(F.sum("y"), F.sum("x")).head()
    ny, nx = float(sums[0] or 0), float(sums[1] or 0)
    if not ny or not nx:
        return Model(np.zeros(0, U), np.zeros(0), 1.0, 0.0, 1.0, -1.0)
    expect = (F.col("y") + F.col("x")) * F.lit(ny / (ny + nx))
    top = counts.where(F.col("y") + F.col("x") >= LEAST).withColumn("z", F.abs(F.col("y") - expect) / F.sqrt(expect)).orderBy(F.desc("z"), "token").limit(TOKENS).toPandas()
    y, x = top["y"].to_numpy(float), top["x"].to_numpy(float)
    known = top["token"].to_numpy(np.int64).view(U)
    order = np.argsort(known)
    models = []
    for weight in PRIORS:
        # log-odds with the prior, drawn toward zero by one standard error
        prior = weight * (ny + nx)
        a, b = y + weight * (y + x), x + weight * (y + x)
        odds = np.log(a / (ny + prior - a)) - np.log(b / (nx + prior - b))
        scores = np.sign(odds) * np.maximum(0, np.abs(odds) - np.sqrt(1 / a + 1 / b))
        for drift in DRIFTS:
            models.append(Model(known[order], scores[order], root_rate(np.append(x, max(0.0, nx - x.sum())), np.append(scores, 0.0) - drift), 0.0, 1.0, -1.0, drift))
    calibrated = texts.where("part = 0").select("toxic", "text")

    def measured() -> pd.DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(models)

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out = [(m, r, e, len(a), max((x[0] for x in found), default=0.0)) for m, r, e, found, a, _, _ in per_text(b, shared.value)]
                kind = b.column("toxic").take(pa.array([o[1] for o in out], pa.int32()))
                yield pa.RecordBatch.from_arrays([kind, *(pa.array([o[k] for o in out], t) for k, t in ((0, pa.int32()), (2, pa.float64()), (3, pa.int64()), (4, pa.float64())))], names=["toxic", "model", "e", "n", "best"])

        return calibrated.mapInArrow(measure, "toxic int, model int, e double, n long, best double").toPandas()

    for m, got in measured().groupby("model"):
        clean = got[(got["toxic"] != 1) & (got["n"] > 0)]
        if len(clean):
            models[m].log_k = float((models[m].rate * clean["best"] - np.log(clean["n"])).mean()) - 0.5772
    # the sum of r segments depends on K, so the evidence is measured again with it
    best = None
    for m, got in measured().groupby("model"):
        e, is_toxic = got["e"].to_numpy(), (got["toxic"] == 1).to_numpy(float)
        if not ((got["toxic"] != 1) & (got["n"] > 0)).any():
            continue
        model = models[m]
        model.slope, model.shift = logistic(e, is_toxic)
        p = np.clip(1 / (1 + np.exp(-np.clip(model.slope * e + model.shift, -500, 500))), 1e-9, 1 - 1e-9)
        loss = float(-(is_toxic * np.log(p) + (1 - is_toxic) * np.log(1 - p)).mean())
        if best is None or loss < best[0]:
            best = loss, model
    return best[1] if best else models[0]


def root_rate(weight: np.ndarray, value: np.ndarray) -> float:
    """Lambda: the positive root of E exp(lambda * score) = 1 over the neutral texts' tokens."""
    weight = weight / weight.sum()
    if not (value > 0).any():
        return 1.0
    lo, hi = 1e-6, 50.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if (weight * np.exp(np.minimum(mid * value, 700))).sum() > 1 else (mid, hi)
    return max(lo, 0.05)


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift by Newton's method, with a small ridge."""
    m, d = float(x.mean()), float(x.std()) or 1.0
    z = np.stack([(x - m) / d, np.ones(len(x))], 1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (p - y) + 1e-2 * w * [1, 0]
        h = (z * (p * (1 - p))[:, None]).T @ z + 1e-2 * np.diag([1, 0.01])
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0] / d), float(w[1] - w[0] * m / d)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted, passages array<struct<first, end, score>> (byte ranges) for every row of docs(doc_id, text).

    Method: each word's score is its log-odds between toxic and other texts, with a Dirichlet prior from both, less a drift;
    of a word and its stems the strongest counts. A linear scan finds all maximal scoring segments of the whole text. Their
    scores are normalised by the extreme-value law of neutral texts (lambda by its equation, K by moments), the best sum of
    r segments is the text's evidence, and a logistic curve fitted on held-back labelled rows makes it a probability.

    Null or empty text: no passage, the score of no evidence. No labelled row of both kinds: a score under one half for
    all. Null and repeated ids: rows of their own. Empty table: no rows. Other columns aren't read.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    passage = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            p, where = [], []
            for _, _, evidence, found, a, z, zero in per_text(b, [model]):
                p.append(model.probability(evidence))
                # positions in the row's own bytes
                where.append([{"first": int(a[f]) - zero, "end": int(z[e - 1]) - zero, "score": s} for s, f, e in found] if p[-1] >= 0.5 else [])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(p, pa.float64()), pa.array([int(x >= 0.5) for x in p], pa.int32()), pa.array(where, passage)], names=["doc_id", "score", "predicted", "passages"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, predicted int, passages array<struct<first: long, end: long, score: double>>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, learn(docs, read(spark, sf_dir, "labels").select("doc_id", "toxic")))
    return out.select("doc_id", (fold(5) == 0).alias("held_out"), "score", "predicted", F.size("passages").alias("n_passages"))
