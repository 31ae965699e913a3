"""Removal of runs of lines that repeat across documents; windows of two lines roll over every text, so no run keeps its edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import join_bounded, keep, read, small_batches
from .textkernel import SPACE, blocks, spans

#: A line of so many words is looked up by itself; shorter ones in windows of two.
LONG = 50


def lines(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, first byte, end byte, words) of all lines of a block of texts; a line keeps its break."""
    n = len(data)
    z = np.zeros(0, np.int64)
    if n == 0:
        return z, z, z, z
    cut = np.zeros(n + 1, bool)
    cut[1:] = data == 10
    cut[at] = True
    start = np.flatnonzero(cut[:n])
    end = np.append(start[1:], n)
    row = np.searchsorted(at, start, "right") - 1
    full = ~SPACE[data]
    first = full.copy()
    first[1:] &= ~full[:-1] | cut[1:n]
    count = np.concatenate([[0], np.cumsum(first)])
    return row, start, end, count[end] - count[start]


def windows(row: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number in its row, first line, last line) of all windows, in order: a line with words and the next one in its row (with the
    blank lines between), and each line of LONG words. The number is twice the place of the first line, and 1 more for a line alone."""
    full = np.flatnonzero(words > 0)
    pair = np.flatnonzero(row[full[1:]] == row[full[:-1]])
    alone = np.flatnonzero(words >= LONG)
    a, z = np.concatenate([full[pair], alone]), np.concatenate([full[pair + 1], alone])
    number = 2 * (a - np.searchsorted(row, row[a])) + (a == z)
    order = np.lexsort((number, row[a]))
    return number[order], a[order], z[order]


def window_hashes(data: np.ndarray, a: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of the byte ranges [a, z) less a break at their end."""
    z = z - (data[z - 1] == 10) if len(z) else z
    return spans(data, a, z).view(np.int64), spans(data ^ np.uint8(0x5A), a, z).view(np.int64)


def looked_up(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, bytes, window's row, number in it, first byte, end byte without the break, two hashes) of all windows."""
    for i, _, data, at in blocks(column):
        row, start, end, words = lines(data, at)
        number, first, last = windows(row, words)
        a, z = start[first], end[last]
        h, g = window_hashes(data, a, z)
        yield i, data, row[first], number, a, z - (data[z - 1] == 10) if len(z) else z, h, g


def repeated(docs: DataFrame) -> DataFrame:
    """doc_id, drop array<struct<window, h, g>>: the numbers and hashes of the windows of docs(doc_id, text) that occur earlier, by id and number."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("doc_id")
            for i, _, row, number, _, _, h, g in looked_up(b.column("text")):
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(row + i)), pa.array(number.astype(np.int32)), pa.array(h), pa.array(g)], names=["doc_id", "window", "h", "g"])

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, want = b.column("doc_id"), b.column("want")
            for i, data, row, number, a, z, h, g in looked_up(b.column("text")):
                raw = data.tobytes()
                wanted = [set(want[i + r].as_py()) for r in range(int(row.max()) + 1)] if len(row) else []
                at = [k for k in range(len(row)) if int(number[k]) in wanted[row[k]]]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(row[at] + i)), pa.array(number[at].astype(np.int32)), pa.array(h[at]), pa.array(g[at]), pa.array([raw[a[k] : z[k]] for k in at], pa.binary())], names=["doc_id", "window", "h", "g", "bytes"])

    found = keep(docs.where("doc_id is not null").mapInArrow(digest, "doc_id long, window int, h long, g long"), "windows")
    many = keep(found.groupBy("h", "g").agg(F.count("*").alias("n")).where("n > 1").drop("n"), "repeats")
    suspects = join_bounded(found, many, ["h", "g"], "left_semi")
    suspects = keep(suspects.groupBy("doc_id").agg(F.sort_array(F.collect_set("window")).alias("want")), "suspects")
    # the bytes of windows whose hashes repeat; equal bytes, not hashes, decide
    bytes_ = join_bounded(docs, suspects, ["doc_id"]).select("doc_id", "text", "want").mapInArrow(texts, "doc_id long, window int, h long, g long, bytes binary")
    same = keep(bytes_.withColumn("key", F.sha2("bytes", 256)), "bytes")
    first = same.groupBy("h", "g", "bytes").agg(F.min(F.struct("doc_id", "window")).alias("kept"), F.first("key").alias("key"), F.count("*").alias("n")).where("n > 1")
    out = same.drop("bytes").join(first.select("h", "g", "key", "kept"), ["h", "g", "key"])
    out = out.where((F.col("doc_id") != F.col("kept.doc_id")) | (F.col("window") != F.col("kept.window")))
    return out.groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("window", "h", "g"))).alias("drop"))


def dedup(docs: DataFrame) -> DataFrame:
    """docs with their texts less the runs of lines that repeat, and n_chunks, n_dropped and dropped_words after their columns.

    Method: a rolling hash goes over each text by windows of two lines with words (and the blank lines between them); a line
    of LONG words or more is a window alone too. All windows are digested; where a digest repeats, anywhere, the bytes are
    compared, and the lines of all but the first of equal windows (by doc_id, then place) go, each with its break. A run of two
    lines or more that occurs earlier is the union of its windows, and each of them occurs earlier: so exactly the maximal
    repeated runs of two lines or more, or of a line of LONG words, go, whole, whatever stands around them. Every line that
    goes has an equal one that stays.

    The chunks of a text are its longest runs of lines that go or stay alike: n_chunks of them, n_dropped of which go.

    Null text stays null. Rows that repeat an id lose the windows whose number and hashes agree, so unlike texts
    under one id lose their own only; equal ones lose the same. Null ids stay as they
    are. Short single lines stay, however often they occur. Empty table: no rows. Columns of docs named like the new ones
    are replaced.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop("n_chunks", "n_dropped", "dropped_words", "_drop")
    drop = keep(repeated(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")), "dropped")
    both = join_bounded(docs, drop.select("doc_id", F.col("drop").alias("_drop")), ["doc_id"], "left").select(*docs.columns, "_drop")
    at = docs.columns.index("text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column, drop = b.column(at), b.column(len(b.schema) - 1)
            total = np.zeros(len(b), np.int32)
            gone, lost = total.copy(), np.zeros(len(b), np.int64)
            new: list[str | None] | None = None
            for i, j, data, off in blocks(column):
                total[i:j] = off[1:] > off[:-1]
                mine = [r for r in range(j - i) if drop[i + r].is_valid]
                if not mine:
                    continue
                row, start, end, words = lines(data, off)
                number, first, last = windows(row, words)
                bounds, places = np.searchsorted(row, np.arange(j - i + 1)), np.searchsorted(row[first], np.arange(j - i + 1))
                h, g = window_hashes(data, start[first], end[last])
                new = column.to_pylist() if new is None else new
                for r in mine:
                    low, high = bounds[r], bounds[r + 1]
                    own = np.arange(places[r], places[r + 1])
                    # the windows of another row with this id have other hashes
                    want = {(w["window"], w["h"], w["g"]) for w in drop[i + r].as_py()}
                    own = own[np.array([k in want for k in zip(number[own].tolist(), h[own].tolist(), g[own].tolist())], bool)]
                    # lines inside a window: more windows begin than have ended
                    step = np.zeros(high - low + 1, np.int64)
                    np.add.at(step, first[own] - low, 1)
                    np.add.at(step, last[own] + 1 - low, -1)
                    go = np.cumsum(step[:-1]) > 0
                    new[i + r] = b"".join(data[a:z].tobytes() for a, z in zip(start[low:high][~go], end[low:high][~go])).decode("utf-8", "replace")
                    begins = np.append(True, go[1:] != go[:-1])[: len(go)]
                    total[i + r], gone[i + r], lost[i + r] = begins.sum(), (begins & go).sum(), words[low:high][go].sum()
            columns = [c for k, c in enumerate(b.columns) if k < len(b.schema) - 1]
            if new is not None:
                columns[at] = pa.array(new, b.schema.field(at).type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(total), pa.array(gone), pa.array(lost)], names=[*b.schema.names[:-1], "n_chunks", "n_dropped", "dropped_words"])

    schema = T.StructType([*docs.schema.fields, T.StructField("n_chunks", T.IntegerType()), T.StructField("n_dropped", T.IntegerType()), T.StructField("dropped_words", T.LongType())])
    return both.mapInArrow(cut, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(read(spark, sf_dir, "documents").select("doc_id", "text"))
