"""Phrase collocations: windows of leading words, counted once at the longest order and summed to shorter phrases by ROLLUP."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SIEVE_BITS, join_bounded, keep, read, small_batches
from .textkernel import LOWER, U, blocks, mix, spans, words

#: Words of the longest phrase, occurrences of a candidate at least, phrases of a language.
LONGEST, LEAST, TOP, UNKNOWN = 5, 100, 2000, "und"
#: Bytes of text handled at once: the more, the fewer repeats are sent.
BLOCK = 8_000_000
#: Rows of which the first of a language are taken together, about.
SHARE = 500_000
SALTS = (0, 0x5A, 0x33)
BREAK = np.zeros(256, bool)
BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
GAP = BREAK.copy()
GAP[[0x20, 0x09]] = True
COLUMNS = [f"w{k}" for k in range(1, LONGEST + 1)]


@dataclass
class Words:
    """The words of a block of texts, in order."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    h: np.ndarray  # a hash of language and word, never 0
    joined: np.ndarray  # whether the next word is in the same piece


def tokens(column: pa.Array, langs: pa.Array, salt: int) -> Iterator[tuple[int, int, Words]]:
    """(first row, end row, words) for blocks of texts."""
    names = langs.dictionary_encode()
    code = names.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    # a hash for each language; the last one is that of null, which is UNKNOWN's
    each = mix(np.array([_text_hash(x) for x in [*names.dictionary.to_pylist(), UNKNOWN]], U) ^ U(0xA0761D6478BD642F))
    for i, j, data, at in blocks(column, BLOCK):
        start, end, row, h = words(data, at, GAP)
        if salt:
            h = spans(LOWER[data] ^ np.uint8(salt), start, end)
        h = mix(h + each[code[i:j]][row])
        h = np.where(h == 0, U(1), h)
        joined = np.zeros(len(h), bool)
        if len(h) > 1:
            piece = np.concatenate([[0], np.cumsum(BREAK[data])])[start]
            joined[:-1] = (row[1:] == row[:-1]) & (piece[1:] == piece[:-1])
        yield i, j, Words(data, start, end, row, h, joined)


def _text_hash(x: str) -> int:
    raw = np.frombuffer(x.encode(), np.uint8)
    return int(spans(raw, np.array([0]), np.array([len(raw)]))[0])


@dataclass
class Passing:
    """A bitmap that passes every hash of a set, and few others; None passes all."""

    bits: Broadcast | None
    shift: int = 0

    def __call__(self, h: np.ndarray) -> np.ndarray:
        if self.bits is None:
            return np.ones(len(h), bool)
        at = h >> U(self.shift)
        return (self.bits.value[at >> U(6)] >> (at & U(63))) & U(1) == 1


def passing(hashes: DataFrame) -> Passing:
    """Of hashes(h). Of so many that half of a bitmap of SIEVE_BITS would pass anything there is none, and all pass: what isn't in
    the set costs time alone."""
    n = hashes.count()
    bits = min(SIEVE_BITS, max(12, (16 * n).bit_length()))
    if n > 1 << (bits - 1):
        return Passing(None)
    at = F.shiftrightunsigned("h", 64 - bits)
    got = hashes.groupBy(F.shiftright(at, 6).alias("k")).agg(F.expr(f"bit_or(shiftleft(1L, cast(shiftrightunsigned(h, {64 - bits}) & 63 as int)))").alias("w")).toArrow()
    out = np.zeros(1 << (bits - 6), U)
    out[got["k"].to_numpy()] = got["w"].to_numpy().view(U)
    return Passing(hashes.sparkSession.sparkContext.broadcast(out), 64 - bits)


def distinct_words(t: Words, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """(place of one, how often it occurs) of each distinct word. Words of one hash that another hash tells apart are two."""
    other = spans(LOWER[t.data] ^ np.uint8(salt ^ 0x77), t.start, t.end)
    order = np.lexsort((other, t.h))
    new = np.ones(len(order), bool)
    new[1:] = (t.h[order[1:]] != t.h[order[:-1]]) | (other[order[1:]] != other[order[:-1]])
    first = np.flatnonzero(new)
    return order[first], np.diff(np.append(first, len(order)))


def vocabulary(docs: DataFrame, salt: int) -> DataFrame:
    """lang, word, h, n: how often each word occurs in a language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs = b.column("lang")
            for i, _, t in tokens(b.column("text"), langs, salt):
                at, n = distinct_words(t, salt)
                h, raw = t.h[at], LOWER[t.data].tobytes()
                found = [raw[a:z] for a, z in zip(t.start[at].tolist(), t.end[at].tolist())]
                yield pa.RecordBatch.from_arrays([langs.take(pa.array(i + t.row[at])).fill_null(UNKNOWN), pa.array(found, pa.binary()).cast(pa.string()), pa.array(h.view(np.int64)), pa.array(n)], names=["lang", "word", "h", "n"])

    return docs.mapInArrow(count, "lang string, word string, h long, n long").groupBy("lang", "word", "h").agg(F.sum("n").alias("n"))


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * U(0x9E3779B97F4A7C15) ^ mix(b))


def pairs(docs: DataFrame, salt: int, known: Passing, least: int) -> DataFrame:
    """h: hashes of two words that stand together `least` times at least (and of some that don't)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, t in tokens(b.column("text"), b.column("lang"), salt):
                good = known(t.h)
                at = np.flatnonzero(t.joined[:-1] & good[:-1] & good[1:]) if len(good) else np.zeros(0, np.int64)
                h, n = np.unique(pair_hash(t.h[at], t.h[at + 1]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int32))], names=["h", "n"])

    return docs.mapInArrow(count, "h long, n int").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("h")


def windows(docs: DataFrame, salt: int, known: Passing, met: Passing) -> DataFrame:
    """w1 to w5, n: the lead windows of all words, how often each occurs in a block.

    A window is a word and those that follow, LONGEST at most, and ends where the piece does or where two words don't stand together
    often enough to be in any candidate; it is padded with nulls. Windows of one word are left out: the vocabulary counts these.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, t in tokens(b.column("text"), b.column("lang"), salt):
                n = len(t.h)
                on = np.zeros(n, bool)
                if n > 1:
                    good = known(t.h)
                    on[:-1] = t.joined[:-1] & good[:-1] & good[1:]
                    at = np.flatnonzero(on)
                    on[at] = met(pair_hash(t.h[at], t.h[at + 1]))
                start = np.flatnonzero(on)
                lead = [t.h[start]]
                more = np.ones(len(start), bool)
                for k in range(1, LONGEST):
                    more = more & on[np.minimum(start + k - 1, n - 1)]
                    lead.append(np.where(more, t.h[np.minimum(start + k, n - 1)], U(0)))
                key = lead[0]
                for x in lead[1:]:
                    key = pair_hash(key, x)
                order = np.argsort(key)
                lead = [x[order] for x in lead]
                new = np.ones(len(start), bool)
                new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in lead])
                first = np.flatnonzero(new)
                often = np.diff(np.append(first, len(start)))
                yield pa.RecordBatch.from_arrays([*(pa.array(x[first].view(np.int64), mask=x[first] == 0) for x in lead), pa.array(often)], names=[*COLUMNS, "n"])

    return docs.mapInArrow(count, ", ".join(f"{c} long" for c in COLUMNS) + ", n long")


def counted(rows: DataFrame, least: int) -> DataFrame:
    """w1 to w5 (0 past its end), size, f: phrases of two words and more that occur `least` times, each order the ROLLUP of the next."""
    sums = rows.rollup(*COLUMNS).agg(F.sum("n").alias("f"), F.grouping_id().alias("level")).where(F.col("f") >= least)
    # the level names the columns that are summed over; what remains must be a phrase, not a padded window
    size = F.lit(LONGEST) - F.bit_count("level")
    last = F.element_at(F.array(*COLUMNS), F.greatest(size, F.lit(1)).cast("int"))
    return sums.where((size >= 2) & last.isNotNull()).select(*[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in COLUMNS], size.cast("int").alias("size"), "f")


def part(first: Column, size: Column) -> list[Column]:
    """The columns of a phrase's words from `first` (0-based) on, `size` of them, padded with 0."""
    own = F.array(*COLUMNS)
    return [F.when(F.lit(k) < size, F.get(own, first + k)).otherwise(F.lit(0).cast("long")).alias(c) for k, c in enumerate(COLUMNS)]


def scored(candidates: DataFrame, counts: DataFrame) -> DataFrame:
    """candidates(lang, w1.., size, a, n) with l, r, score of their lowest-scoring cut."""
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    side = lambda name: counts.select(*[F.col(c).alias(f"{name}{c}") for c in COLUMNS], F.col("f").alias(name))
    cuts = cuts.select("*", *[x.alias(f"l{c}") for c, x in zip(COLUMNS, part(F.lit(0), F.col("k")))], *[x.alias(f"r{c}") for c, x in zip(COLUMNS, part(F.col("k"), F.col("size") - F.col("k")))])
    cuts = keep(join_bounded(cuts, side("l"), [f"l{c}" for c in COLUMNS]).drop(*[f"l{c}" for c in COLUMNS]), "left")
    cuts = join_bounded(cuts, side("r"), [f"r{c}" for c in COLUMNS]).drop(*[f"r{c}" for c in COLUMNS])
    exact = lambda x: f"cast({x} as decimal(19,0))"
    score = F.expr(f"cast(1000 as decimal(4,0)) * cast({exact('a')} * {exact('n')} as decimal(34,0)) div cast({exact('l')} * {exact('r')} as decimal(38,0))")
    cuts = cuts.withColumn("score", score)
    lowest = cuts.groupBy("lang", *COLUMNS, "size", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"))
    return lowest.select("lang", *COLUMNS, "size", "a", "n", "c.l", "c.r", "c.score")


def within(candidates: DataFrame) -> DataFrame:
    """w1 to w5, most: the phrases of two words and more inside longer candidates, and how often the most frequent of these occurs."""
    longer = candidates.where("size > 2")
    cut = F.expr("flatten(transform(sequence(2, size - 1), m -> transform(sequence(0, size - m), s -> struct(s as s, m as m))))")
    inner = longer.withColumn("c", F.explode(cut)).select(*part(F.col("c.s"), F.col("c.m")), "a")
    return inner.groupBy(*COLUMNS).agg(F.max("a").alias("most"))


def phrased(phrases: DataFrame, names: DataFrame) -> DataFrame:
    """phrases with phrase, their words joined by spaces; names: h, word."""
    own = [c for c in phrases.columns if c not in COLUMNS]
    word = phrases.select(*COLUMNS, F.posexplode(F.array(*COLUMNS)).alias("k", "h")).where("h <> 0")
    word = join_bounded(word, names, ["h"]) if names.limit(20_001).count() <= 20_000 else word.join(names.hint("merge"), "h")
    text = word.groupBy(*COLUMNS).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    return phrases.join(text.hint("merge"), COLUMNS).select(*own, "phrase")


def first_of(rows: DataFrame, top: int) -> DataFrame:
    """The first rows of each language, ranked: of shares of it first, so that no task ranks a language."""
    order = [F.desc("score"), F.desc("a"), "phrase"]
    shares = max(1, -(-rows.count() // SHARE))
    if shares > 1:
        rows = rows.withColumn("_s", F.pmod(F.xxhash64("phrase"), F.lit(shares)))
        rows = rows.withColumn("rank", F.row_number().over(W.partitionBy("lang", "_s").orderBy(*order))).where(F.col("rank") <= top).drop("_s")
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the phrases of two to five words that hold together best, `top` of each language of docs(text, lang).

    Method: the vocabulary is counted first. Each word that occurs `least` times leads a window of five columns, padded where
    the piece ends; windows also end before words, and between pairs of words, that are too rare to be in any candidate (as
    bitmaps of at most 4 MB say, which pass too much rather than too little). Only these longest windows are
    counted, and Spark's ROLLUP over the columns sums them to all their prefixes: every phrase is the prefix of the windows that start
    where it does. Cuts and phrases inside longer ones are joins on these counts.

    Words are kept as 64-bit hashes of language and word until phrases are named. All words of the corpus are
    checked for two that share one; if any do, the next of three hashes is taken.

    A-Z count as lower case. Pieces end at . , ; : ! ? and line breaks, words at spaces and tabs. Null text is empty; null lang
    counts as `und`. Ids aren't read, so null and repeated ones are rows like others, and equal rows count as often as they occur.
    No candidate: no rows. Other columns aren't read. Products are whole numbers of 38 digits.
    """
    small_batches(docs.sparkSession)
    docs = docs.select("text", F.col("lang").cast("string").alias("lang"))
    for salt in SALTS:
        vocab = keep(vocabulary(docs, salt), "vocabulary")
        if vocab.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").head() is None:
            break
    else:
        raise RuntimeError("words of the corpus share a hash under each of the salts")
    often = keep(vocab.where(F.col("n") >= least).select("h", "word", "lang", F.col("n").alias("f")), "often")
    known = passing(often.select("h"))
    met = passing(keep(pairs(docs, salt, known, least), "pairs"))
    phrases = keep(counted(windows(docs, salt, known, met), least), "phrases")
    zero = F.lit(0).cast("long")
    single = often.select(F.col("h").alias("w1"), *[zero.alias(c) for c in COLUMNS[1:]], F.lit(1).alias("size"), "f")
    counts = keep(phrases.unionByName(single), "counts")

    totals = vocab.groupBy("lang").agg(F.sum("n").alias("n"))
    lang = keep(join_bounded(often.select("h", "lang"), keep(totals, "totals"), ["lang"]), "languages")
    candidates = phrases.withColumnRenamed("f", "a")
    kept = candidates.join(within(candidates).hint("merge"), COLUMNS, "left").where("most is null or most < a").drop("most")
    kept = keep(kept.join(lang.withColumnRenamed("h", "w1").hint("merge"), "w1"), "candidates")
    named = keep(phrased(scored(kept, counts.drop("size")), often.select("h", "word")), "named")
    ranked = first_of(named, top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read(spark, sf_dir, "documents"))


#: The same rows from an explosion of all n-grams.
ORACLE = rf"""
with p as (select row_number() over () as d, coalesce(lang, '{UNKNOWN}') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
q as (select lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) as t from p),
w as (select lang, regexp_extract_all(t, '[^\x20\x09]+') as w from q),
g as (select lang, unnest(flatten(list_transform(range(1, 6), lambda k: list_transform(range(1, greatest(1, len(w) - k + 2)), lambda i: w[i:i + k - 1])))) as x from w),
f as (select lang, x, count(*)::bigint as f from g group by lang, x),
n as (select lang, sum(f)::bigint as n from f where len(x) = 1 group by lang),
c as (select * from f where len(x) >= 2 and f >= {LEAST}),
s as (select lang, f, x, unnest(flatten(list_transform(range(2, len(x)), lambda m: list_transform(range(1, len(x) - m + 2), lambda i: x[i:i + m - 1])))) as y from c where len(x) > 2),
o as (select lang, y, max(f) as most from s group by lang, y),
k as (select c.lang, c.x, c.f as a, unnest(range(1, len(c.x))) as k from c left join o on c.lang = o.lang and c.x = o.y where o.most is null or o.most < c.f),
l as (select k.*, b.f as l, e.f as r, n.n, (1000::hugeint * k.a * n.n) // (b.f::hugeint * e.f) as score from k join f b on k.lang = b.lang and b.x = k.x[:k.k] join f e on k.lang = e.lang and e.x = k.x[k.k + 1:] join n on k.lang = n.lang),
m as (select *, row_number() over (partition by lang, x order by score, k) as i from l),
z as (select lang, array_to_string(x, ' ') as phrase, a, l, r, n, score::bigint as score from m where i = 1)
select * from (select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score from z) where rank <= {TOP}
"""
