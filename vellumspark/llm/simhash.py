"""SimHash near-duplicates through a Gray-order hierarchical index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, join_bounded, join_sifted, keep, read, small_batches

BITS, SEED = 64, 42
#: Fingerprints under one upper node that a task holds at most; fuller nodes are split by further masks.
BLOCK = 16_384
#: Children of a node of the index, rows that are indexed at once, and pairs of nodes that are expanded at once.
FAN, ROWS, PAIRS = 8, 1 << 16, 4096
#: Shingles of a text whose bits are counted at once.
COUNTED = 1 << 16
U = np.uint64
FULL = U(2**64 - 1)


def fingerprint(text: bytes, words_each: int = 3) -> int:
    """The SimHash of a text's shingles, repeats included: a bit is set if over half of their hashes have it. No words: 0."""
    words = text.lower().split()  # of bytes: A-Z alone, and ASCII white space
    if not words:
        return 0
    joined = b" ".join(words)
    gap = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    start, end = np.append(0, gap + 1), np.append(gap, len(joined))
    size = min(words_each, len(words))
    start, end = start[: len(start) - size + 1].tolist(), end[size - 1 :].tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for i in range(0, len(start), COUNTED):
        h = np.array([digest(joined[a:z], SEED) for a, z in zip(start[i : i + COUNTED], end[i : i + COUNTED])], "<u8")
        ones += np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, BITS).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(start), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words_each: int = 3) -> DataFrame:
    """doc_id, fp: the fingerprint of each row of docs(doc_id, text), as a signed number."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").cast(pa.large_binary())
            fp = [fingerprint(t.as_py() or b"", words_each) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.array(fp, U).view(np.int64))], names=["doc_id", "fp"])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(sign, "doc_id long, fp long")


def gray_rank(x: Column) -> Column:
    """The place of a code word in the binary-reflected Gray code: neighbours there differ in one bit."""
    for k in (1, 2, 4, 8, 16, 32):
        x = x.bitwiseXOR(F.shiftrightunsigned(x, k))
    return x


def masks_below(mask: int, most: int) -> list[int]:
    """mask with each of most + 1 equal shares of its other bits. Of two words that agree in mask and differ in `most` bits,
    one of the shares has none of these, so they agree in one of the masks given."""
    free = [b for b in range(BITS) if not mask >> b & 1]
    cut = [len(free) * k // (most + 1) for k in range(most + 2)]
    return [mask | sum(1 << b for b in free[a:z]) for a, z in zip(cut, cut[1:])]


def signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


class Index:
    """A forest over fingerprints in Gray order, one tree for each upper node: FAN neighbours share a node above them, which
    holds the bits they agree in (`same`) and these bits' pattern."""

    def __init__(self, node: np.ndarray, x: np.ndarray):
        """node: the upper node of each fingerprint, as numbers that don't fall; x: the fingerprints, in Gray order under a node."""
        n = len(x)
        every = np.arange(n)
        self.x, self.label = x, every.copy()
        self.child, self.end, self.same, self.pattern = [every], [every + 1], [np.full(n, FULL)], [x]
        low, high = x, x
        while len(node) > 1 and (node[1:] == node[:-1]).any():
            new = np.append(True, node[1:] != node[:-1])
            first = np.flatnonzero(new)
            place = np.arange(len(node)) - first[np.cumsum(new) - 1]
            start = np.flatnonzero(place % FAN == 0)
            low, high, node = np.bitwise_and.reduceat(low, start), np.bitwise_or.reduceat(high, start), node[start]
            self.child.append(start)
            self.end.append(np.append(start[1:], len(place)))
            self.same.append(~(low ^ high))
            self.pattern.append(low)
        self.top = len(self.child) - 1

    def relabel(self) -> None:
        """The least and greatest component below each node."""
        self.least, self.greatest = [self.label], [self.label]
        for start in self.child[1:]:
            self.least.append(np.minimum.reduceat(self.least[-1], start))
            self.greatest.append(np.maximum.reduceat(self.greatest[-1], start))

    def linked(self, node: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of fingerprints under the same node that differ in at most `most` bits: as many as connect all that are linked.

        Neighbours in Gray order are linked first. Then pairs of nodes are followed downwards, each from the roots, with the
        differences found so far: only bits that both nodes newly share are compared. A pair with more than `most` differences
        is dropped with all below it; so is one whose fingerprints are in one component already.
        """
        n = len(self.x)
        near = (node[1:] == node[:-1]) & (np.bitwise_count(self.x[1:] ^ self.x[:-1]) <= most)
        self.label = np.maximum.accumulate(np.where(np.append(True, ~near), np.arange(n), 0))
        a, b = [np.flatnonzero(near)], [np.flatnonzero(near) + 1]
        self.relabel()
        roots = np.arange(len(self.child[-1]))
        stack = [(self.top, roots, roots, np.zeros(len(roots), np.int64), np.zeros(len(roots), U))]
        while stack:
            level, i, j, d, shared = stack.pop()
            if len(i) > PAIRS:
                stack += [(level, i[k : k + PAIRS], j[k : k + PAIRS], d[k : k + PAIRS], shared[k : k + PAIRS]) for k in range(0, len(i), PAIRS)]
                continue
            least, greatest = self.least[level], self.greatest[level]
            apart = (least[i] != greatest[j]) | (greatest[i] != least[j])
            if level == 0:
                p, q = self.join(i[apart], j[apart])
                a.append(p)
                b.append(q)
                continue
            i, j, d, shared = i[apart], j[apart], d[apart], shared[apart]
            child, end = self.child[level], self.end[level]
            step = np.arange(FAN)
            p, q = (child[i][:, None] + step)[:, :, None], (child[j][:, None] + step)[:, None, :]
            there = (p < end[i][:, None, None]) & (q < end[j][:, None, None]) & ((i != j)[:, None, None] | (p < q) | ((p == q) & (level > 1)))
            of, k, m = np.nonzero(there)
            p, q = p[of, k, 0], q[of, 0, m]
            same, pattern = self.same[level - 1], self.pattern[level - 1]
            fresh = same[p] & same[q] & ~shared[of]
            d = d[of] + np.bitwise_count((pattern[p] ^ pattern[q]) & fresh)
            on = d <= most
            stack.append((level - 1, p[on], q[on], d[on], shared[of][on] | fresh[on]))
        return np.concatenate(a), np.concatenate(b)

    def join(self, i: np.ndarray, j: np.ndarray) -> tuple[list[int], list[int]]:
        """Of linked pairs those that put two components together."""
        if not len(i):
            return [], []
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while (y := up.get(x, x)) != x:
                up[x] = up.get(y, y)
                x = y
            return x

        _, first = np.unique(self.label[i] * len(self.x) + self.label[j], return_index=True)
        out: tuple[list[int], list[int]] = ([], [])
        for p, q in zip(i[first].tolist(), j[first].tolist()):
            r, s = root(int(self.label[p])), root(int(self.label[q]))
            if r != s:
                up[max(r, s)] = min(r, s)
                out[0].append(p)
                out[1].append(q)
        if out[0]:
            to = np.arange(len(self.x))
            for x in list(up):
                to[x] = root(x)
            self.label = to[self.label]
            self.relabel()
        return out


def linked_within(entries: DataFrame, most: int, whole: bool) -> DataFrame:
    """a, b: links of entries(mask, pattern, gray, fp), sorted by these in their partitions, that connect what is linked under a node.

    whole: nodes are whole in a partition, and hold BLOCK fingerprints at most. Otherwise links are looked for in runs of
    ROWS rows, which are neighbours in Gray order.
    """

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def links(rows: np.ndarray) -> pa.RecordBatch:
            node = np.concatenate([[0], np.cumsum((rows[1:, :2] != rows[:-1, :2]).any(1))]) if len(rows) else np.zeros(0, np.int64)
            x = np.ascontiguousarray(rows[:, 2]).view(U)
            a, b = Index(node, x).linked(node, most) if len(rows) else (np.zeros(0, np.int64),) * 2
            a, b = a.astype(np.int64), b.astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(x[a].view(np.int64)), pa.array(x[b].view(np.int64))], names=["a", "b"])

        for b in batches:
            held.append(np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in ("mask", "pattern", "fp")], 1).astype(np.int64))
            if sum(map(len, held)) >= ROWS:
                rows = np.concatenate(held)
                cut = len(rows)
                if whole:  # the last node may go on
                    last = np.flatnonzero((rows[:, :2] != rows[-1, :2]).any(1))
                    cut = last[-1] + 1 if len(last) else 0
                yield links(rows[:cut])
                held = [rows[cut:]]
        if held:
            yield links(np.concatenate(held))

    return entries.select("mask", "pattern", "fp").mapInArrow(link, "a long, b long").where("a <> b")


def links_of(fps: DataFrame, most: int = 3, block: int | None = None) -> DataFrame:
    """a, b: pairs of the distinct fps(fp) that differ in at most `most` bits: enough of them to connect all that are linked.

    The upper nodes of the index are masked patterns, each the rows of a shuffle key. One that holds over `block` fingerprints
    is cut into runs by Gray rank, whatever its size, and what is linked in a run is connected. If that leaves several components,
    its fingerprints go on to nodes of larger masks.
    """
    block = block or BLOCK
    masks, found = [0], []
    todo = fps.select("fp", F.lit(0).cast("long").alias("mask"))
    while True:
        below = {m: masks_below(m, most) for m in masks}
        into = F.create_map(*[x for m, new in below.items() for x in (F.lit(signed(m)), F.array(*[F.lit(signed(k)) for k in new]))])
        asked = todo.select("fp", F.explode(into[F.col("mask")]).alias("mask")).select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("pattern"), gray_rank(F.col("fp")).alias("gray"), "fp")
        masks = [k for new in below.values() for k in new]
        node, order = ["mask", "pattern"], ["mask", "pattern", "gray"]
        wide = keep(asked.groupBy(*node).agg(F.count("*").alias("n")).where(F.col("n") > block).select(*node), "wide")
        some = wide.head() is not None
        narrow = join_bounded(asked, wide, node, "left_anti") if some else asked
        found.append(keep(linked_within(narrow.repartition(*node).sortWithinPartitions(*order), most, True), "links"))
        if not some:
            break
        full = keep(join_bounded(asked, wide, node, "left_semi"), "full")
        found.append(keep(linked_within(full.repartitionByRange(*order).sortWithinPartitions(*order), most, False), "links"))
        labels = keep(components(union(found)), "labels")
        named = join_sifted(full.select(*node, "fp"), labels.select(F.col("node").alias("fp"), "component"), ["fp"], "left").withColumn("of", F.coalesce("component", "fp"))
        split = keep(named.groupBy(*node).agg(F.min("of").alias("x"), F.max("of").alias("y")).where("x <> y").select(*node), "split")
        if split.head() is None:
            break
        todo = keep(join_bounded(full, split, node, "left_semi").select("fp", "mask"), "todo")
    return union(found)


def union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def near_duplicates(docs: DataFrame, words_each: int = 3, most: int = 3) -> DataFrame:
    """doc_id, fingerprint, component_id for every row of docs(doc_id, text): SimHash fingerprints, linked at `most` differing bits or fewer.

    Method: equal fingerprints are one row of the index. Its upper nodes are masked bit patterns: `most` + 1 masks share out the
    64 bits, so two linked fingerprints agree in one of them wholly and meet under its pattern. Under a node fingerprints
    are sorted by Gray rank, and neighbours share further nodes, which hold the bits they agree in. Pairs of nodes are
    compared from above, by what they newly share, and dropped as a group when the differences found are too many, or
    when all below is one component. So components are exact, and a group of near copies yields no more links than
    it has fingerprints under each node. An overfull node is never whole in a task (links_of).

    Words part at ASCII white space, with A-Z in lower case; with fewer words than a shingle the whole sequence is one. Null,
    empty and blank texts have fingerprint zero and are linked like any other. Rows that repeat an id are rows of their own,
    each with the component of its own text. A row without an id has a fingerprint, a null component, and takes no part in links.
    Empty table: no rows. Other columns aren't read.
    """
    rows = keep(fingerprints(docs, words_each), "fingerprints")
    distinct = keep(rows.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")), "distinct")
    found = keep(components(links_of(distinct.select("fp"), most)).withColumnRenamed("node", "fp"), "components")
    # of each component the smallest id; a fingerprint without links is named if several rows have it
    firsts = join_sifted(distinct, found, ["fp"], "left").where("component is not null or copies > 1")
    firsts = keep(firsts.select("fp", F.coalesce("component", "fp").alias("component"), "first"), "firsts")
    names = keep(firsts.groupBy("component").agg(F.min("first").alias("component_id")), "names")
    named = keep(join_bounded(firsts.select("fp", "component"), names, ["component"]).select("fp", "component_id"), "named")
    out = join_sifted(rows, named, ["fp"], "left")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return out.select("doc_id", hexed.alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))
