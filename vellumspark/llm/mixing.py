"""Mixing sources to target weights by a low-discrepancy schedule. DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import join_bounded, keep, read

#: Words in a block of a source's shuffled stream.
BLOCK_WORDS = 512
#: The fractional part of the golden ratio in 52 bits; point i of the schedule is the last 52 bits of i times it, which whole
#: numbers keep exact for i under 2 ** 37, where doubles lose the low ones.
GOLDEN = 0x9E3779B97F4A7
#: Slots ranked together, so that no task ranks all slots of one source.
SLOT_CHUNK = 65_536
#: Places of the cumulative targets in a range.
PLACES = 64
WORD = r"[^\x20\x09-\x0D]+"


def named(source: Column) -> Column:
    """The source as a key that is never null."""
    return F.when(source.isNull(), F.lit("")).otherwise(F.concat(F.lit("."), source))


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def targets(sizes: DataFrame, weights: list[float], share: float, most: float) -> DataFrame:
    """Per source (null is one): source_size, target. A row for each source, and only these, meets in one task.

    Sources by code point, null last, weigh weights[0], weights[1], ... repeating. The targets share `share` times all
    sizes; none is above `most` times its source's size, and the excess goes to the others by weight. In closed form: a
    source is at its bound if most * size / weight is under the level that the rest then share.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by = by.withColumn("k", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    by = by.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.col("k") % len(weights) + 1).cast("int")))
    by = by.withColumn("r", F.lit(float(most)) * F.col("source_size") / F.col("w"))
    up = W.orderBy("r", "k")
    before = up.rowsBetween(W.unboundedPreceding, -1)
    rest = up.rowsBetween(0, W.unboundedFollowing)
    by = by.withColumn("bound", F.coalesce(F.sum("source_size").over(before), F.lit(0)))
    by = by.withColumn("weight", F.sum("w").over(rest))
    by = by.withColumn("all", F.sum("source_size").over(W.partitionBy()))
    by = by.withColumn("level", (F.lit(share) * F.col("all") - F.lit(float(most)) * F.col("bound")) / F.col("weight"))
    # the first source, by r, whose own r isn't under the level of those from it on sets the level for all of them
    by = by.withColumn("level", F.min(F.when(F.col("level") <= F.col("r"), F.struct("r", "k", "level"))).over(W.partitionBy())["level"])
    target = F.when(F.col("level").isNull() | (F.col("r") < F.col("level")), F.lit(float(most)) * F.col("source_size")).otherwise(F.col("level") * F.col("w"))
    return by.select("source", "k", "source_size", target.cast("double").alias("target"))


def ranked(df: DataFrame, group: str, chunk: str, order: list, value: Column, name: str) -> DataFrame:
    """A running sum of value, before each row, in `group` by (chunk, order). Chunks are summed first: no task holds a whole group."""
    one = W.partitionBy(group, chunk)
    df = df.withColumn("_in", F.coalesce(F.sum(value).over(one.orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long")))
    sums = df.groupBy(group, chunk).agg(F.sum(value).alias("_n"))
    sums = sums.withColumn("_before", F.coalesce(F.sum("_n").over(W.partitionBy(group).orderBy(chunk).rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long")))
    return df.join(sums.drop("_n"), [group, chunk]).withColumn(name, F.col("_before") + F.col("_in")).drop("_in", "_before")


def mix(docs: DataFrame, weights: list[float] = (5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0, block: int = BLOCK_WORDS, carry: Sequence[str] = ()) -> DataFrame:
    """Every row of docs(doc_id, source, text) with size, source_size, target, taken, n_slots and first_slot, and the columns named in carry.

    Method: the documents of a source are shuffled (by the MD5 of their id) into one stream of words, cut into blocks of
    `block` words, of which the last may be shorter. Point i of the golden-ratio sequence, mapped through the cumulative
    targets, gives slot i of the mix to a source; the slots of a source are ranked, and rank r takes block r modulo the
    number of blocks. A source's slots end with its target: the last is cut there, and slots that the sequence still owes a
    source follow at the end. A document's `taken` is the sum over the slots that take words of it, `n_slots` their number and
    `first_slot` the place in the mix of the first of them (null: none), by which a reader orders the documents of the mix.

    Null text: size 0, taken 0. Null source: a source of its own, last. No documents or only empty ones: targets and taken
    are 0. Repeated rows are rows of their own. Other columns aren't read. Reruns agree. Columns in carry tell rows apart whose
    id is null or repeated: they order them in the stream.
    """
    sizes = keep(docs.select(F.col("doc_id"), F.col("source"), n_words(F.col("text")).alias("size"), *carry), "sizes")
    sources = keep(targets(sizes, list(weights), share, most), "targets")
    plan = sources.withColumn("take", F.floor("target").cast("long")).withColumn("blocks", F.ceil(F.col("source_size") / block).cast("long"))
    last = F.col("source_size") - (F.col("blocks") - 1) * block
    # slots a source needs: whole passes, then what is left, cut in its last slot
    plan = plan.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("take") / F.col("source_size"))).otherwise(0).cast("long"))
    plan = plan.withColumn("left", F.col("take") - F.col("passes") * F.col("source_size"))
    plan = plan.withColumn("need", F.col("passes") * F.col("blocks") + F.ceil(F.col("left") / block).cast("long")).withColumn("last", last)
    plan = plan.where("need > 0").select("k", "source_size", "take", "blocks", "passes", "left", "need", "last")
    upto = W.orderBy("k")
    plan = plan.withColumn("hi", F.sum("need").over(upto)).withColumn("lo", F.col("hi") - F.col("need"))
    total = plan.agg(F.max("hi")).head()[0] or 0
    slots = schedule(plan, total)
    length = F.when(F.col("rank") == F.col("need") - 1, F.when(F.col("left") > 0, F.col("left") - F.col("b") * block).otherwise(F.col("last"))).when(F.col("b") == F.col("blocks") - 1, F.col("last")).otherwise(F.lit(block))
    slots = slots.withColumn("b", F.col("rank") % F.col("blocks")).withColumn("len", length.cast("long"))
    full = F.when(F.col("b") == F.col("blocks") - 1, F.col("last")).otherwise(F.lit(block))
    whole = F.col("len") >= full
    used = slots.groupBy("k", "b").agg(F.sum(whole.cast("long")).alias("times"), F.max(F.when(~whole, F.col("len"))).alias("part"), F.min(F.when(whole, F.col("place"))).alias("first"), F.min(F.when(~whole, F.col("place"))).alias("part_at"))

    d = join_bounded(sizes.withColumn("source", named(F.col("source"))), sources.withColumn("source", named(F.col("source"))), ["source"]).select("doc_id", "k", "size", "source_size", "target", *carry)
    d = d.withColumn("h", F.md5(F.coalesce(F.col("doc_id").cast("string"), *(F.col(c).cast("string") for c in carry), F.lit("")))).withColumn("chunk", F.substring("h", 1, 3))
    d = ranked(d, "k", "chunk", ["h", "size", *carry], F.col("size"), "start").drop("h", "chunk")
    d = keep(d, "streams")
    pieces = d.where("size > 0").withColumn("b", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))))
    a = F.greatest(F.col("start") - F.col("b") * block, F.lit(0))
    z = F.least(F.col("start") + F.col("size") - F.col("b") * block, F.lit(block))
    pieces = pieces.select("k", "start", "b", a.alias("a"), z.alias("z")).join(used, ["k", "b"])
    got = F.col("times") * (F.col("z") - F.col("a")) + F.greatest(F.lit(0), F.least(F.col("z"), F.coalesce(F.col("part"), F.lit(0))) - F.col("a"))
    in_part = F.coalesce(F.col("part") > F.col("a"), F.lit(False))
    got = pieces.groupBy("k", "start").agg(F.sum(got).alias("taken"), F.sum(F.col("times") + in_part.cast("long")).alias("n_slots"), F.min(F.least("first", F.when(in_part, F.col("part_at")))).alias("first_slot"))
    # only one document of a positive size starts at a place of a source's stream
    some = d.where("size > 0").join(got, ["k", "start"], "left")
    both = some.unionByName(d.where("size = 0"), allowMissingColumns=True)
    number = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return both.select("doc_id", "size", "source_size", "target", number("taken"), number("n_slots"), "first_slot", *carry)


def schedule(plan: DataFrame, total: int) -> DataFrame:
    """The slots of the mix: plan's columns, the rank, from 0, of each slot in its source, and its place in the mix; every source gets exactly `need`.

    A source owns the places [lo, hi) out of `total`. Places are dealt into ranges of PLACES, sources and points are joined
    by range, and a point takes the source whose places it falls in; no range has more than PLACES sources.
    """
    points = plan.sparkSession.range(total)
    low, high = GOLDEN & ((1 << 26) - 1), GOLDEN >> 26
    wrap = lambda x, bits: F.pmod(x, F.lit(1 << bits))
    f = wrap(wrap(F.col("id") * low, 52) + wrap(F.col("id") * high, 26) * (1 << 26), 52)
    u = F.floor(f.cast("double") * float(total) / float(1 << 52))
    points = points.withColumn("u", F.least(u, F.lit(total - 1))).withColumn("g", F.floor(F.col("u") / PLACES))
    owns = plan.select("k", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / PLACES), F.floor((F.col("hi") - 1) / PLACES))).alias("g"))
    points = points.join(owns, "g").where("lo <= u and u < hi").select("id", "k", F.floor(F.col("id") / SLOT_CHUNK).alias("chunk"))
    slots = ranked(points, "k", "chunk", ["id"], F.lit(1).cast("long"), "rank").select("k", "rank", F.col("id").alias("place"))
    slots = join_bounded(slots, plan.select("k", "need"), ["k"]).where("rank < need").select("k", "rank", "place")
    # what the sequence owes: its discrepancy, a few slots a source
    have = slots.groupBy("k").agg(F.count("*").alias("have"))
    owed = plan.select("k", "need").join(have, "k", "left").withColumn("have", F.coalesce("have", F.lit(0).cast("long"))).where("have < need")
    owed = owed.withColumn("after", F.sum(F.col("need") - F.col("have")).over(W.orderBy("k")) - F.col("need") + total)
    owed = owed.select("k", "after", F.explode(F.expr("sequence(have, need - 1)")).alias("rank")).select("k", "rank", (F.col("after") + F.col("rank")).alias("place"))
    return join_bounded(slots.unionByName(owed), plan.drop("hi", "lo"), ["k"])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents"))


#: The same rows, and the same schedule, over ranges of whole sources.
ORACLE = r"""
with s as (select row_number() over () as r, doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents),
b as (select source, sum(size)::bigint as source_size from s group by source),
k as (select *, row_number() over (order by source nulls last) - 1 as k from b),
r as (select *, case k % 3 when 0 then 5.0::double when 1 then 2.0::double else 1.0::double end as w from k),
q as (select *, 2.0::double * source_size / w as r from r),
l as (select *, coalesce(sum(source_size) over (order by r, k rows between unbounded preceding and 1 preceding), 0) as bound,
             sum(w) over (order by r, k rows between current row and unbounded following) as weight, sum(source_size) over () as total from q),
v as (select *, (1.5::double * total::double - 2.0::double * bound::double) / weight as level from l),
m as (select first(level order by r, k) as level from v where level <= r),
t as (select v.k, v.source, v.source_size, case when m.level is null or v.r < m.level then 2.0::double * v.source_size else m.level * v.w end as target
      from v left join m on true),
o as (select s.r, s.doc_id, s.size, t.k, t.source_size, t.target, floor(t.target)::bigint as take,
             coalesce(sum(s.size) over (partition by s.source order by md5(coalesce(s.doc_id::varchar, '')), s.size rows between unbounded preceding and 1 preceding), 0)::bigint as start
      from s join t on s.source is not distinct from t.source),
n1 as (select k, source_size, floor(target)::bigint as take, (source_size + 511) // 512 as blocks from t where source_size > 0),
n2 as (select *, take // source_size as passes, take % source_size as rest, source_size - (blocks - 1) * 512 as last from n1),
n3 as (select *, passes * blocks + (rest + 511) // 512 as need from n2),
p as (select *, (sum(need) over (order by k))::bigint as hi, (sum(need) over (order by k))::bigint - need as lo from n3 where need > 0),
a as (select max(hi) as total from p),
i as (select total, unnest(range(total)) as id from a),
f as (select total, id, (id * 60290215 % 4503599627370496 + id * 41475558 % 67108864 * 67108864) % 4503599627370496 as f from i),
u as (select id, least(floor(f::double * total::double / 4503599627370496::double)::bigint, total - 1) as u from f),
c as (select p.k, u.id, row_number() over (partition by p.k order by u.id) - 1 as rank from u join p on u.u >= p.lo and u.u < p.hi),
d as (select c.k, c.rank, c.id as place from c join p on c.k = p.k where c.rank < p.need),
h as (select p.k, p.need, count(d.k) as have from p left join d on p.k = d.k group by p.k, p.need),
w as (select *, (sum(need - have) over (order by k))::bigint - (need - have) as before from h),
x as (select k, unnest(range(have, need)) as rank, have, before from w),
e as (select * from d union all select x.k, x.rank, a.total + x.before + x.rank - x.have from x, a),
g as (select e.k, e.place, e.rank % p.blocks as b, case when e.rank % p.blocks = p.blocks - 1 then p.last else 512 end as whole,
             case when e.rank = p.need - 1 and p.rest > 0 then p.rest - e.rank % p.blocks * 512 end as cut from e join p on e.k = p.k),
z as (select k, b, count(*) filter (where cut is null or cut >= whole) as times, max(cut) filter (where cut < whole) as part,
             min(place) filter (where cut is null or cut >= whole) as first, min(place) filter (where cut < whole) as part_at from g group by k, b),
y as (select r, k, start, unnest(range(start // 512, (start + size - 1) // 512 + 1)) as b from o where size > 0),
j as (select y.r, sum(z.times + (case when z.part > greatest(0, y.start - y.b * 512) then 1 else 0 end))::bigint as n_slots,
             min(least(z.first, case when z.part > greatest(0, y.start - y.b * 512) then z.part_at end))::bigint as first_slot
      from y join z on y.k = z.k and y.b = z.b group by y.r)
select o.doc_id, o.size, o.source_size, o.target,
       (case when o.source_size = 0 then 0 else (o.take // o.source_size) * o.size + greatest(0, least(o.size, o.take % o.source_size - o.start)) end)::bigint as taken,
       coalesce(j.n_slots, 0)::bigint as n_slots, j.first_slot
from o left join j on o.r = j.r
"""
