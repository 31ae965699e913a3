"""Packing token pieces into sequences: best-fit decreasing, certified by lower bounds, repacked where a gap is left."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import keep, read, small_batches

#: Pieces that are packed together in one task, about.
GROUP = 20_000
#: Rounds in which groups with a gap exchange pieces.
ROUNDS = 2
END_ID = 2
VOCABULARY = "byte_bpe_50k"


class Encoder:
    """Ids of a text, as `tokenizers` gives them for the .json file with add_special_tokens=False.

    The same vocabulary as ranks (the .tiktoken file) is five times as fast. It is used for texts of code points under
    0x250 that hold no special token, where both split words alike; all others go through `tokenizers`.
    """

    def __init__(self, folder: str | None = None):
        import base64
        import re

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        at = (lambda name: f"{folder}/{name}") if folder else public_tokenizers.path
        self.exact = Tokenizer.from_file(at(f"{VOCABULARY}.json"))
        with open(at(f"{VOCABULARY}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        special = [t.content for t in self.exact.get_added_tokens_decoder().values()]
        self.odd = re.compile("|".join([r"[^\x00-ɏ]", *map(re.escape, special)]))

    def __call__(self, text: str) -> np.ndarray:
        if self.odd.search(text):
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, "<u4")
        return np.array(self.fast.encode_ordinary(text), "<u4")


_encoders: dict[str | None, Encoder] = {}


def encoder(folder: str | None) -> Encoder:
    if folder not in _encoders:
        _encoders[folder] = Encoder(folder)
    return _encoders[folder]


def pieces(docs: DataFrame, size: int = 1024, folder: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each text's ids and the end id, whole if they fit, else cut so that only the first piece is shorter than `size`."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(folder)
        for b in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text")):
                ids = np.append(encode(text.as_py() or ""), np.array([END_ID], "<u4")).astype("<u4")
                n, a, k = len(ids), 0, 0
                z = n % size or size
                z = min(z, n)
                while a < n:
                    rows.append((doc_id, k, a, z - a, zlib.crc32(ids[a:z].tobytes())))
                    a, z, k = z, z + size, k + 1
            columns = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[2:])], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def bound(lengths: np.ndarray, size: int) -> int:
    """A lower bound on the bins: the best of the dual-feasible functions u(k), k to 40, and f(e), e to size / 2, summed over the lengths."""
    count = np.bincount(lengths, minlength=size + 1).astype(np.int64)
    x = np.arange(size + 1, dtype=np.int64)
    best = -(-int((count * x).sum()) // size)
    for k in range(1, 41):
        # u(k) times k times size, in whole numbers
        whole = (k + 1) * x % size == 0
        u = np.where(whole, k * x, (k + 1) * x // size * size)
        best = max(best, -(-int((count * u).sum()) // (k * size)))
    for e in range(1, size // 2 + 1):
        total = int(count[size - e + 1 :].sum()) * size + int((count * x)[e : size - e + 1].sum())
        best = max(best, -(-total // size))
    return best


def best_fit(lengths: np.ndarray, size: int) -> np.ndarray:
    """Each length's bin under best-fit decreasing; ties in order of place."""
    room: list[list[int]] = [[] for _ in range(size + 1)]
    open_ = 0  # bit r: some bin has room r
    out = np.zeros(len(lengths), np.int64)
    bins = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = open_ >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                open_ &= ~(1 << r)
        else:
            r, b = size, bins
            bins += 1
        out[i] = b
        room[r - n].append(b)
        if r > n:
            open_ |= 1 << (r - n)
    return out


def pack(pieces: DataFrame, size: int = 1024, group: int = GROUP, rounds: int = ROUNDS) -> DataFrame:
    """pieces(doc_id, piece, start, length, ...) with sequence_id, offset and certified: whether their group meets its lower bound.

    Method: full pieces are sequences of their own. The others are dealt to groups by a hash of their place in the table and packed best-fit decreasing.
    A group whose bins equal the bound from dual-feasible functions is final. From groups with a gap the bins that aren't
    full go, whole, to new groups and are packed again; a group keeps the old bins unless the new ones are fewer.
    """
    columns = pieces.columns
    full = pieces.where(F.col("length") >= size).withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long")).withColumn("certified", F.lit(True))
    rest = pieces.where(F.col("length") < size)
    schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in pieces.schema)}, bin string, fill long, certified boolean"

    def again(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable", ignore_index=True)
        lengths = pdf["length"].to_numpy(np.int64)
        new = best_fit(lengths, size)
        least = bound(lengths, size)
        old = pdf["bin"].nunique() if pdf["bin"].notna().all() else None
        if old is None or new.max() + 1 < old:
            pdf["bin"] = [f"{pdf['tag'].iat[0]}-{b}" for b in new]
            bins = int(new.max()) + 1
        else:
            bins = old
        pdf["fill"] = pdf.groupby("bin")["length"].transform("sum").astype("int64")
        pdf["certified"] = bins == least
        return pdf[[*columns, "bin", "fill", "certified"]]

    done: list[DataFrame] = []
    todo = rest.withColumn("bin", F.lit(None).cast("string"))
    for r in range(rounds + 1):
        n = todo.count()
        if not n:
            break
        groups = max(1, -(-n // group))
        # equal pieces are told apart by their places in the table
        key = F.xxhash64(F.lit(r), *(["bin"] if r else [F.monotonically_increasing_id()]))
        dealt = todo.withColumn("g", F.pmod(key, F.lit(groups))).withColumn("tag", F.concat(F.lit(f"{r}-"), F.col("g").cast("string")))
        got = keep(dealt.groupBy("g").applyInPandas(again, schema), "packed")
        final = F.col("certified") | (F.col("fill") == size)
        done.append(got if r == rounds else got.where(final))
        todo = got.where(~final).drop("fill", "certified")
    if not done:
        return full
    packed = done[0]
    for d in done[1:]:
        packed = packed.unionByName(d)

    # bins are named round-group-number; as one number, and the places in a bin are its running lengths
    part = lambda i: F.split("bin", "-")[i].cast("long")
    packed = packed.withColumn("sequence_id", (part(0) * (1 << 31) + part(1)) * (1 << 28) + part(2))
    line = W.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "piece", "ids_crc32").rowsBetween(W.unboundedPreceding, -1)
    packed = packed.withColumn("offset", F.coalesce(F.sum("length").over(line), F.lit(0)).cast("long"))
    return full.select(*columns, "sequence_id", "offset", "certified").unionByName(packed.select(*columns, "sequence_id", "offset", "certified"))


def pack_documents(docs: DataFrame, size: int = 1024, folder: str | None = None) -> DataFrame:
    """The pieces of every row of docs(doc_id, text) and their places in sequences of at most `size` ids.

    Null text: empty, one piece that holds the end id alone. Null and repeated ids: rows of their own. Empty table: no
    rows. Other columns aren't read.
    """
    return pack(keep(pieces(docs, size, folder), "pieces"), size)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"))
