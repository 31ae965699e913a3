"""Vector compression to codes of parts: whole-number k-means, assigned through a lexicographic trie over distinct parts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import join_bounded, keep, read

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: A component's whole number is held to this, so that sums of squares stay in 64 bits: x to 524,288 either way.
LARGEST = 1 << 27
#: Distinct parts below a node of the trie that are expanded together; fuller nodes are descended into one child after the other.
LEAVES = 4096


def walk(parts: np.ndarray, entries: np.ndarray, leaves: int = LEAVES) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first, end, squared distances to all entries) for runs of the distinct parts, which come in lexicographic order.

    The trie over the parts is walked depth first. A node stands for a prefix of components and holds the distances summed over
    these, for each entry; what lies below it adds its own components, so a prefix is summed once however many parts share it.
    A subtree of at most `leaves` parts is expanded as a whole, a component at a time.
    """
    n, width = parts.shape
    # where a prefix of so many components, and one more, begins
    begins = np.ones((width, n), bool)
    if n > 1 and width:
        begins[:, 1:] = np.logical_or.accumulate(parts[1:] != parts[:-1], axis=1).T
    stack = [(0, n, 0, np.zeros(len(entries), np.int64))]
    while stack:
        a, z, depth, total = stack.pop()
        if depth < width and z - a > leaves:
            first = a + np.flatnonzero(begins[depth, a:z])
            first[0] = a
            for k, end in zip(first[::-1].tolist(), np.append(first[1:], z)[::-1].tolist()):
                stack.append((k, end, depth + 1, total + (parts[k, depth] - entries[:, depth]) ** 2))
            continue
        node, sums = np.zeros(z - a, np.int64), total[None, :]
        for j in range(depth, width):
            new = begins[j, a:z].copy()
            new[0] = True
            at = np.flatnonzero(new)
            sums = sums[node[at]] + (parts[a + at, j][:, None] - entries[:, j]) ** 2
            node = np.cumsum(new) - 1
        yield a, z, sums[node]


def assigned(parts: np.ndarray, entries: np.ndarray, leaves: int = LEAVES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each part's distinct part, and of the distinct ones: the part, how often it occurs, its nearest entry (the first of those as near) and the squared distance."""
    n, width = parts.shape
    order = np.lexsort(parts.T[::-1]) if width else np.arange(n)
    s = parts[order]
    new = np.append(True, (s[1:] != s[:-1]).any(1))
    first = np.flatnonzero(new)
    of = np.empty(n, np.int64)
    of[order] = np.cumsum(new) - 1
    s, often = s[first], np.diff(np.append(first, n))
    nearest, error = np.empty(len(s), np.int64), np.empty(len(s), np.int64)
    for a, z, d in walk(s, entries, leaves):
        k = d.argmin(1)
        nearest[a:z], error[a:z] = k, np.take_along_axis(d, k[:, None], 1)[:, 0]
    return of, s, often, nearest, error


class Books:
    """A codebook (entries, width) for each part, and the vectors' length."""

    def __init__(self, length: int, entries: np.ndarray):
        self.length, self.entries = length, entries  # (PARTS, entries, width)
        self.width = -(-length // PARTS)

    def parts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(rows of the books' length, their whole numbers (rows, PARTS, width)); a length that isn't a multiple of PARTS is filled with zeros."""
        size = np.diff(column.offsets.to_numpy())
        x = np.asarray(column.flatten(), np.float64)
        rows = np.flatnonzero(size == self.length)
        at = np.append(0, np.cumsum(size))[rows]
        x = x[at[:, None] + np.arange(self.length)] if self.length else np.zeros((len(rows), 0))
        return rows, whole(x)


def whole(x: np.ndarray) -> np.ndarray:
    """floor(SCALE x) of vectors (rows, length), cut into parts (rows, PARTS, width)."""
    width = -(-x.shape[1] // PARTS)
    v = np.clip(np.floor(SCALE * x), -LARGEST, LARGEST).astype(np.int64)
    return np.pad(v, ((0, 0), (0, PARTS * width - x.shape[1]))).reshape(len(x), PARTS, width)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, label, v array<double> of the rows whose vector isn't null and holds no null or non-finite component."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast("array<double>").alias("v"))
    return v.where(F.col("v").isNotNull()).where(F.forall("v", lambda y: y.isNotNull() & ~F.isnan(y) & (F.abs(y) < float("inf"))))


def replaced(books: Books, kept: DataFrame) -> Books:
    """The books after one round: each entry the mean, rounded down, of the parts nearest to it; unused ones stay."""
    shared = kept.sparkSession.sparkContext.broadcast(books)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        entries = books.entries.shape[1]
        sums, often = np.zeros(books.entries.shape, np.int64), np.zeros((PARTS, entries), np.int64)
        for b in batches:
            _, x = books.parts(b.column("v"))
            for p in range(PARTS) if len(x) else ():
                _, s, n, nearest, _ = assigned(x[:, p], books.entries[p])
                np.add.at(sums[p], nearest, s * n[:, None])
                np.add.at(often[p], nearest, n)
        # a row for each entry's count, at -1, and for each sum
        both = np.concatenate([often[:, :, None], sums], 2)
        p, e, j = np.nonzero(np.broadcast_to(often[:, :, None] > 0, both.shape))
        yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array((j - 1).astype(np.int32)), pa.array(both[p, e, j])], names=["part", "entry", "place", "total"])

    got = kept.select("v").mapInArrow(gather, "part int, entry int, place int, total long")
    totals = {(r.part, r.entry, r.place): int(r.total) for r in got.groupBy("part", "entry", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).toLocalIterator()}
    new = books.entries.copy()
    for (p, e, j), total in totals.items():
        if j >= 0:
            new[p, e, j] = total // totals[p, e, -1]
    return Books(books.length, new)


def compress(vectors: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 for every usable row of vectors(vec_id, embedding, label).

    Method: a vector's whole numbers, floor(256 x), are cut into 16 parts. Each part's codebook starts as that part of the `entries`
    smallest vec_ids. In each round every task puts its distinct parts in lexicographic order and walks the trie over them
    depth first; distances to all entries are summed along shared prefixes, a leaf takes the nearest entry and
    adds itself, as often as it occurs, to the entry's sums. These, of bounded size, are all that leaves the tasks. After the last round
    parts are assigned again.

    Rows whose vector is null, or holds null or non-finite components, are left out. The books' length is that of the smallest
    vec_id's vector; a vector of another length can't be coded by them, and has a null code and error. A length that is no
    multiple of 16 is filled up with zeros. Whole numbers are held to 2 ** 27 either way. Repeated ids are rows of their own, by their vectors
    in the books; null ids come last. Fewer rows than entries: so many entries. Null labels are one label. No usable row: no
    rows. Other columns aren't read.
    """
    spark = vectors.sparkSession
    kept = usable(vectors)
    label = kept.schema["label"]
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "v").select("v").head()
    if first is None:
        none = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("code", T.StringType()), *(T.StructField(c, T.LongType()) for c in ("error", "label_error")), T.StructField("codebooks_sha256", T.StringType())])
        return spark.createDataFrame([], none)
    length = len(first["v"])
    start = kept.where(F.size("v") == length).orderBy(F.col("vec_id").asc_nulls_last(), "v").select("v").limit(entries).collect()
    books = Books(length, whole(np.array([r["v"] for r in start], np.float64).reshape(len(start), length)).transpose(1, 0, 2).copy())
    for _ in range(rounds):
        books = replaced(books, kept)
    coded = keep(encoded(books, kept, label), "codes")
    named = lambda df: df.withColumn("_none", F.col("label").isNull()).withColumn("_label", F.coalesce(F.col("label").cast("string"), F.lit("")))
    sums = keep(named(coded).groupBy("_none", "_label").agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("label_error")), "labels")
    out = join_bounded(named(coded), sums, ["_none", "_label"])
    digest = hashlib.sha256(",".join(map(str, books.entries.reshape(-1).tolist())).encode()).hexdigest()
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def encoded(books: Books, kept: DataFrame, label: T.StructField) -> DataFrame:
    """vec_id, label, code, error under the books."""
    shared = kept.sparkSession.sparkContext.broadcast(books)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        for b in batches:
            rows, x = books.parts(b.column("v"))
            codes, error = np.zeros((len(rows), PARTS), np.uint8), np.zeros(len(rows), np.int64)
            for p in range(PARTS) if len(x) else ():
                of, _, _, nearest, far = assigned(x[:, p], books.entries[p])
                codes[:, p] = nearest[of]
                error += far[of]
            code: list[str | None] = [None] * len(b)
            for r, c in zip(rows.tolist(), codes):
                code[r] = c.tobytes().hex()
            all_, known = np.zeros(len(b), np.int64), np.zeros(len(b), bool)
            all_[rows], known[rows] = error, True
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array(code, pa.string()), pa.array(all_, mask=~known)], names=["vec_id", "label", "code", "error"])

    schema = T.StructType([T.StructField("vec_id", T.LongType()), label, T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    return kept.select("vec_id", "label", "v").mapInArrow(encode, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(read(spark, sf_dir, "embeddings"))


def _round(k: int, last: bool) -> str:
    """One assignment, by the books of round k, and unless it is the last the books after it."""
    near = f"""
d{k} as (select x.r, x.part, b.entry, sum((x.x - b.x) * (x.x - b.x)) as d from x join b{k} b on x.part = b.part and x.place = b.place group by x.r, x.part, b.entry),
a{k} as (select r, part, entry, d from (select *, row_number() over (partition by r, part order by d, entry) as n from d{k}) where n = 1)"""
    if last:
        return near
    return near + f""",
m{k} as (select a.part, a.entry, x.place, sum(x.x) as s, count(*) as n from a{k} a join x on a.r = x.r and a.part = x.part group by a.part, a.entry, x.place),
b{k + 1} as (select b.part, b.entry, b.place, coalesce(case when m.s % m.n < 0 then m.s // m.n - 1 else m.s // m.n end, b.x)::bigint as x from b{k} b left join m{k} m on b.part = m.part and b.entry = m.entry and b.place = m.place),"""


#: The same rows by all distances, for tables whose usable vectors have one length, a multiple of 16.
ORACLE = f"""
with v as (select row_number() over (order by vec_id nulls last, embedding) as r, vec_id, label, embedding as v from embeddings
    where embedding is not null and len(list_filter(embedding, lambda y: y is null or not isfinite(y))) = 0),
y as (select r, unnest(v) as y, unnest(range(len(v))) as k, len(v) // {PARTS} as width from v),
x as (select r, k // width as part, k % width as place, floor({SCALE} * y::double)::bigint as x from y),
b0 as (select part, r - 1 as entry, place, x from x where r <= {ENTRIES}),{_round(0, False)}{_round(1, False)}{_round(2, True)},
h as (select sha256(string_agg(x::varchar, ',' order by part, entry, place)) as codebooks_sha256 from b2),
c as (select r, string_agg(printf('%02x', entry), '' order by part) as code, sum(d)::bigint as error from a2 group by r)
select v.vec_id, c.code, c.error, (sum(c.error) over (partition by v.label))::bigint as label_error, h.codebooks_sha256 from v join c on v.r = c.r, h
"""
