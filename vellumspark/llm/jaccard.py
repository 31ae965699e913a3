"""Similarity join on word n-grams by prefixes under several token orders."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import components, discard, fits, join_bounded, join_sifted, keep, read, sieve, small_batches, small_enough, tidy
from .textkernel import U, blocks, mix, shingles, words

#: Shingles that the orders place last, by count: this many at most, and only from this count on. Any order gives right
#: results, so the bound on this list costs time alone.
FREQUENT, LEAST = 50_000, 8
#: Shingles gathered in a task before their counts are folded.
FOLD = 2_000_000
#: Slots of a tally at most.
SLOTS = 2048
#: Bytes of a shingle's hash that are sent for a comparison of whole sets. Two sets of 1,000 agree in a shingle that only one
#: has with a chance of 4e-9.
SENT = 6
#: Seeds of the token orders. The first makes the index; the others must confirm a candidate.
ORDERS = (0x1B873593, 0x85EBCA6B, 0xC2B2AE35)
SIGNED = np.int64


def count_frequent(docs: DataFrame, words_each: int) -> dict[int, int]:
    """Counts of shingles that repeat within a task's rows, summed over all tasks: a summary of all data of bounded size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        total = (np.zeros(0, U), np.zeros(0, np.int64))

        def fold() -> tuple[np.ndarray, np.ndarray]:
            v, c = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, U), np.zeros(0, np.int64))
            v, c = v[c > 1], c[c > 1]
            v, at = np.unique(np.concatenate([total[0], v]), return_inverse=True)
            return v, np.bincount(at, np.concatenate([total[1], c]), len(v)).astype(np.int64)

        for b in batches:
            for i, j, data, at in blocks(b.column("text")):
                _, _, row, h = words(data, at)
                held.append(shingles(h, row, j - i, words_each)[0])
                n += len(held[-1])
                if n > FOLD:
                    total, held, n = fold(), [], 0
        v, c = fold()
        yield pa.RecordBatch.from_arrays([pa.array(v.view(SIGNED)), pa.array(c)], names=["token", "n"])

    top = docs.select("text").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST)
    return {r["token"]: r["n"] for r in top.orderBy(F.desc("n"), "token").limit(FREQUENT).collect()}


def signatures(docs: DataFrame, words_each: int, percent: int, frequent: dict[int, int]) -> DataFrame:
    """doc_id, n, and of each document's set: two digests, its prefix under each order, and how many tokens of the first prefix aren't frequent; these come first."""
    known = np.array(sorted(frequent), SIGNED)
    weight = np.array([min(frequent[int(k)], 65_535) for k in known], U)
    known = known.view(U)
    by_value = np.argsort(known)
    known, weight = known[by_value], weight[by_value]
    shared = docs.sparkSession.sparkContext.broadcast((known, weight))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, weight = shared.value
        for b in batches:
            ids = b.column("doc_id")
            for i, j, data, at in blocks(b.column("text")):
                _, _, row, h = words(data, at)
                x, off = shingles(h, row, j - i, words_each)
                n = np.diff(off)
                rare = np.zeros(len(x), U)
                if len(known) and len(x):
                    k = np.minimum(np.searchsorted(known, x), len(known) - 1)
                    rare = np.where(known[k] == x, weight[k], U(0))
                out = [ids.slice(i, j - i), pa.array(n)]
                for seed in (11, 13):
                    s = np.concatenate([[U(0)], np.cumsum(mix(x + U(seed)))])
                    out.append(pa.array(mix(s[off[1:]] - s[off[:-1]]).view(SIGNED)))
                most = np.where(n > 0, n - -(-percent * n // 100) + 1, 0)
                ends = np.concatenate([[0], np.cumsum(most)]).astype(np.int32)
                for k, seed in enumerate(ORDERS):
                    # frequent shingles last, by count; the others, and equal counts, by a hash
                    order = rare << U(48) | mix(x ^ U(seed * 0x9E3779B1)) >> U(16)
                    head = np.empty(ends[-1], U)
                    plain = np.zeros(j - i, np.int32)
                    for r in np.flatnonzero(n):
                        own, m = order[off[r] : off[r + 1]], most[r]
                        first = np.argpartition(own, m - 1)[:m] if m < len(own) else np.arange(m)
                        first = first[np.argsort(own[first])]
                        head[ends[r] : ends[r + 1]] = x[off[r] : off[r + 1]][first]
                        plain[r] = np.count_nonzero(own[first] < U(1 << 48))
                    if k == 0:
                        unlisted = pa.array(plain)
                    head = head.view(SIGNED)
                    # confirming needs no more than 16 bits: a false meeting only costs a comparison
                    out.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(head.astype(np.int16) if k else head)))
                yield pa.RecordBatch.from_arrays([*out, unlisted], names=["doc_id", "n", "s1", "s2", "p0", "p1", "p2", "plain"])

    return docs.select("doc_id", "text").mapInArrow(sign, "doc_id long, n long, s1 long, s2 long, p0 array<long>, p1 array<short>, p2 array<short>, plain int")


def chosen(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The texts of nodes(node); others may be among them. Only where nodes are too many for a sieve do texts shuffle."""
    ids = nodes.select(F.col("node").alias("doc_id"))
    n = ids.count()
    held = sieve(ids, n) if n > fits(ids) else None
    return docs.select("doc_id", "text").where(held.passes(["doc_id"])) if held else join_bounded(docs.select("doc_id", "text"), ids, ["doc_id"], "left_semi")


def sets_of(docs: DataFrame, nodes: DataFrame, words_each: int) -> DataFrame:
    """node, grams binary: the shingles of each document in nodes(node, text's doc_id), and perhaps of others, in SENT bytes each."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("doc_id")
            for i, j, data, at in blocks(b.column("text")):
                _, _, row, h = words(data, at)
                x, off = shingles(h, row, j - i, words_each)
                raw = x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :SENT].tobytes()
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array([raw[SENT * a : SENT * z] for a, z in zip(off[:-1], off[1:])], pa.binary())], names=["node", "grams"])

    return chosen(docs, nodes).mapInArrow(gather, "node long, grams binary")


def received(grams: bytes) -> np.ndarray:
    out = np.zeros((len(grams) // SENT, 8), np.uint8)
    out[:, :SENT] = np.frombuffer(grams, np.uint8).reshape(-1, SENT)
    return np.unique(out.view("<u8"))


def tallies(docs: DataFrame, nodes: DataFrame, words_each: int) -> DataFrame:
    """node, n, tally binary: how many shingles fall in each of as many slots as the power of two up to n, SLOTS at most; a byte each."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("doc_id")
            for i, j, data, at in blocks(b.column("text")):
                _, _, row, h = words(data, at)
                x, off = shingles(h, row, j - i, words_each)
                n = np.diff(off)
                out = []
                for a, z in zip(off[:-1], off[1:]):
                    slots = min(SLOTS, 1 << max(0, int(z - a).bit_length() - 1))
                    t = np.bincount((x[a:z] & U(slots - 1)).astype(np.int64), minlength=slots)
                    out.append(t.astype(np.uint8).tobytes() if t.max(initial=0) < 256 else None)
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array(n), pa.array(out, pa.binary())], names=["node", "n", "tally"])

    return chosen(docs, nodes).mapInArrow(tally, "node long, n long, tally binary")


def plausible(docs: DataFrame, pairs: DataFrame, words_each: int, percent: int) -> DataFrame:
    """pairs(a, b) whose tallies allow enough common shingles: slot by slot, no more than the smaller tally are common."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y, n, m in zip(*(batch.column(c) for c in ("x", "y", "n", "m"))):
                n, m = n.as_py(), m.as_py()
                if x.is_valid and y.is_valid:
                    x, y = sorted((np.frombuffer(x.as_py(), np.uint8).astype(np.int64), np.frombuffer(y.as_py(), np.uint8).astype(np.int64)), key=len)
                    both = int(np.minimum(x, y.reshape(-1, len(x)).sum(0)).sum())
                else:
                    both = min(n, m)
                good.append(100 * both >= percent * (n + m - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    nodes = keep(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct(), "nodes")
    t = keep(tallies(docs, nodes, words_each), "tallies")
    width = F.octet_length("tally")
    rows = pairs.join(small_enough(t, width).select(F.col("node").alias("a"), "n", F.col("tally").alias("x")), "a")
    rows = rows.join(small_enough(t, width).select(F.col("node").alias("b"), F.col("n").alias("m"), F.col("tally").alias("y")), "b")
    out = keep(rows.select("a", "b", "x", "y", "n", "m").mapInArrow(check, "a long, b long"), "plausible")
    discard(pairs, nodes, t)
    return out


def compared(docs: DataFrame, pairs: DataFrame, words_each: int, percent: int, differ: bool = False) -> DataFrame:
    """pairs(a, b) that are linked, by their whole sets.

    With differ: all pairs, with linked, b's size n, d, the number of shingles that only one of the two has, and of these
    the first by a hash, as many as two sets that are alike must meet in if they are compared by what sets them apart from a.
    """

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, apart, sizes = [], [], []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = received(x.as_py()), received(y.as_py())
                rest = np.setxor1d(x, y, assume_unique=True)
                both = (len(x) + len(y) - len(rest)) // 2
                good.append(100 * both >= percent * (both + len(rest)) and both > 0)
                sizes.append((len(y), len(rest)))
                if differ:
                    most = min(len(rest), len(y) * (100 - percent) // percent + 1)
                    rest = rest[np.argsort(mix(rest))[:most]].view(SIGNED)
                apart.append(rest if differ else None)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(good, pa.bool_()), pa.array(apart, pa.list_(pa.int64())), *(pa.array([z[k] for z in sizes], pa.int64()) for k in (0, 1))], names=["a", "b", "linked", "apart", "n", "d"])

    nodes = keep(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct(), "nodes")
    # one exchange of the sets serves both sides
    sets = sets_of(docs, nodes, words_each).repartition("node")
    rows = pairs.join(sets.select(F.col("node").alias("a"), F.col("grams").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("grams").alias("y")), "b")
    rows = rows.select("a", "b", "x", "y").mapInArrow(check, "a long, b long, linked boolean, apart array<long>, n long, d long")
    out = keep(rows if differ else rows.where("linked").select("a", "b"), "compared")
    discard(pairs, nodes)
    return out


def similarity_classes(docs: DataFrame, words_each: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs(doc_id, text), by Jaccard likeness of at least `percent` / 100.

    Method: documents with equal sets form a class, of which the smallest id stands for all. Under each of three token
    orders (shingles known to be frequent last, by count, then by a seeded hash) two alike sets share a token among the
    first n - ceil(percent * n / 100) + 1 of each. The first order makes the index, with the tokens' positions; a pair must
    meet under all three before its whole sets are compared.

    In the index each token's smallest member, its leader, is compared with the others, so a large group of near copies
    costs as many pairs as it has members. A member that was compared with its leader, not linked with it, and is not in the
    leader's component by another way either is a stray. Where a leader's strays and members make fewer pairs than the shingles
    that set them apart from it are, these pairs are taken. Elsewhere members are alike to a stray only if some shingle sets both apart
    from the leader; strays are joined on those, first with the smallest that has such a shingle, then across the components
    that are left. So no leader costs more than its members' prefixes. Leaders without a stray have nothing to join. Members that didn't reach a
    comparison with their leader meet the token's other members outside their component; of these pairs only those are compared
    whose tallies by hash slot, an upper bound on what is common, allow a link. So components are exact, without all pairs of
    a group.

    Words part at ASCII white space, with A-Z in lower case; with fewer words than a shingle the whole sequence is one. No
    words or null text: size 0, linked with nothing, own id as component. Rows that repeat an id count as one document with
    the text of each row compared; null ids are left alone. Empty table: no rows. Other columns aren't read. Sets hold
    64-bit hashes of the shingles.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = keep(signatures(docs, words_each, percent, count_frequent(docs, words_each)), "signatures")
    full = signed.where("n > 0 and doc_id is not null")
    classes = keep(full.groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies")), "classes")
    # most sets occur once; where one has copies, a row of the smallest id stands for them
    copied = classes.where("copies > 1").select("n", "s1", "s2", "node")
    alone = join_sifted(full, copied.drop("node"), ["n", "s1", "s2"], "left_anti").withColumnRenamed("doc_id", "node")
    among = join_sifted(full, copied, ["n", "s1", "s2"]).where("doc_id = node").dropDuplicates(["n", "s1", "s2"]).select(*alone.columns)
    nodes = alone.unionByName(among)

    tidy(spark)
    entries = keep(index(nodes), "index")
    tidy(spark)
    # the first prefixes, most of the table, are in the index now
    nodes, rows, full = keep(nodes.select("node", "n", "p1", "p2"), "prefixes"), keep(signed.select("doc_id", "n", "s1", "s2"), "rows"), signed
    discard(full)
    star = entries.where((F.col("node") > F.col("lead.node")) & reach("n", "pos", "lead.n", "lead.pos", percent))
    star = keep(star.select(F.col("lead.node").alias("a"), F.col("node").alias("b")).distinct(), "star")
    tested = compared(docs, confirmed(star, nodes, percent), words_each, percent, differ=True)
    discard(star)
    links = keep(tested.where("linked").select("a", "b"), "links")
    labels = keep(components(links), "labels")

    # where all pairs of a leader's members are fewer than what sets these apart, the pairs are taken
    pairs, many = paired(tested, labels, percent)
    # the other strays first meet the smallest member that differs from their leader alike
    strays, rest = apart(many, labels)
    least = [F.min(F.when(F.col("stray") == kind, F.struct("b", "n", "d", "pos"))).alias(f"lead{kind:d}") for kind in (True, False)]
    leads = strays.withColumn("stray", F.lit(True)).unionByName(rest.withColumn("stray", F.lit(False))).groupBy("a", "gram").agg(F.count("*").alias("k"), *least)
    leads = leads.where("k > 1 and lead1 is not null").select("a", "gram", F.explode(F.array_compact(F.array("lead1", "lead0"))).alias("lead"))
    led = strays.join(leads, ["a", "gram"]).select(F.col("lead.b").alias("c"), F.col("lead.n").alias("m"), F.col("lead.d").alias("e"), F.col("lead.pos").alias("at"), "b", "n", "d", "pos")
    led = led.where((F.col("b") != F.col("c")) & differ_alike(percent)).select(F.least("b", "c").alias("a"), F.greatest("b", "c").alias("b"))
    led = keep(led.unionByName(pairs).distinct(), "led")
    near = compared(docs, plausible(docs, confirmed(led, nodes, percent), words_each, percent), words_each, percent)
    old, links = links, keep(links.unionByName(near.select("a", "b")), "links")
    discard(pairs, strays, rest, led, near, old, labels)
    labels = keep(components(links), "labels")

    # then all members in other components
    strays, rest = apart(many, labels)
    other = strays.select("a", "gram", F.col("b").alias("c"), F.col("n").alias("m"), F.col("d").alias("e"), F.col("pos").alias("at"), F.col("of").alias("other"))
    near = strays.withColumn("stray", F.lit(True)).unionByName(rest.withColumn("stray", F.lit(False))).join(other, ["a", "gram"])
    near = near.where((F.col("of") != F.col("other")) & (~F.col("stray") | (F.col("b") < F.col("c"))) & differ_alike(percent))
    near = near.select(F.least("b", "c").alias("a"), F.greatest("b", "c").alias("b"))

    # members that weren't compared with their token's leader meet all others of the token, outside their component
    met = tested.select(F.col("a").alias("l"), F.col("b").alias("node"), F.lit(True).alias("met"))
    named = labels.select("node", F.col("component").alias("of"))
    whole = join_sifted(join_sifted(entries.withColumn("l", F.col("lead.node")).drop("lead"), named, ["node"], "left"), met, ["l", "node"], "left")
    whole = keep(whole.select("token", "node", "n", "pos", F.coalesce("of", "node").alias("of"), (F.col("met").isNotNull() | (F.col("node") == F.col("l"))).alias("met")), "open")
    discard(entries)
    by = whole.groupBy("token").agg(F.min("of").alias("x"), F.max("of").alias("y"), F.min("met").alias("met")).where("x <> y and not met").select("token")
    by = keep(by, "tokens")
    # other tokens that pass have nothing to join below
    held = sieve(by, by.count())
    open_ = keep(whole.where(held.passes(["token"])) if held else whole.join(by.hint("merge"), "token", "left_semi"), "unsettled")
    discard(whole, by)
    lone = open_.where("not met").select("token", F.col("node").alias("c"), F.col("n").alias("m"), F.col("pos").alias("at"), F.col("of").alias("other"))
    late = open_.join(lone, "token").where((F.col("of") != F.col("other")) & (F.col("met") | (F.col("node") < F.col("c"))) & reach("n", "pos", "m", "at", percent))
    late = late.select(F.least("node", "c").alias("a"), F.greatest("node", "c").alias("b"))
    late = keep(late.unionByName(near).distinct(), "late")
    discard(open_, strays, rest, tested, many, labels)
    more = compared(docs, plausible(docs, confirmed(late, nodes, percent), words_each, percent), words_each, percent)
    discard(late)
    found = keep(components(links.unionByName(more.select("a", "b"))), "components")
    discard(links, more)
    # only classes that are linked or have copies need a name; any other document is its own
    named = classes.join(found, "node", "left").where("component is not null or copies > 1")
    named = keep(named.select("n", "s1", "s2", F.coalesce("component", "node").alias("component_id")), "named")
    discard(classes, found)
    discard(nodes)
    rows = join_sifted(rows.select("doc_id", F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), F.col("n")).alias("n"), "s1", "s2", F.col("n").alias("n_shingles")), named, ["n", "s1", "s2"], "left")
    return rows.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def index(nodes: DataFrame) -> DataFrame:
    """node, n, token, pos, lead: the prefix tokens with two members at least, each with its smallest member as leader.

    A frequent token may be in a third of all prefixes. There are FREQUENT of them at most, so their leaders are aggregated
    and broadcast; only the others, which are rarer than all of these, are grouped whole.
    """
    entries = nodes.select("node", "n", "plain", F.posexplode("p0").alias("pos", "token"))
    members = W.partitionBy("token")
    entry = F.struct("node", "n", "pos")
    rare = entries.where("pos < plain").drop("plain").withColumn("members", F.count("*").over(members)).withColumn("lead", F.min(entry).over(members))
    often = entries.where("pos >= plain").drop("plain")
    leads = often.groupBy("token").agg(F.count("*").alias("members"), F.min(entry).alias("lead"))
    return rare.unionByName(often.join(F.broadcast(leads), "token")).where("members > 1").drop("members")


def homes(tested: DataFrame, labels: DataFrame) -> DataFrame:
    """tested with home, the component of the leader a, and of, that of the member b."""
    named = lambda df, node, name: join_sifted(df, labels.select(F.col("node").alias(node), F.col("component").alias(name)), [node], "left").withColumn(name, F.coalesce(name, node))
    return named(named(tested, "a", "home"), "b", "of")


def paired(tested: DataFrame, labels: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """The pairs (a, b) of a leader's strays with its members in other components that may be alike, of the leaders where a pair of each
    stray with each member is no more than the shingles listed in `apart`; and tested for the leaders where it is more.

    So a leader's rows follow the square of its members only as far as that is the smaller figure.
    """
    placed = keep(homes(tested.select("a", "b", "n", "d", F.size("apart").alias("size")), labels), "members")
    stray = F.col("of") != F.col("home")
    by = placed.groupBy("a").agg(F.count("*").alias("k"), F.count_if(stray).alias("strays"), F.sum("size").alias("size")).where("k > 1 and strays > 0")
    by = keep(by.select("a", (F.col("k") * F.col("strays") <= F.col("size")).alias("few")), "leaders")
    held = keep(join_sifted(placed, by.where("few").select("a"), ["a"], "left_semi").withColumn("stray", stray).withColumn("pos", F.lit(0)), "members")
    other = held.where("stray").select("a", F.col("b").alias("c"), F.col("n").alias("m"), F.col("d").alias("e"), F.col("pos").alias("at"), F.col("of").alias("other"))
    met = held.join(other.hint("merge"), "a").where((F.col("of") != F.col("other")) & (~F.col("stray") | (F.col("b") < F.col("c"))))
    met = met.where((F.least("n", "m") >= needed("n", "m", percent)) & differ_alike(percent))
    pairs = keep(met.select(F.least("b", "c").alias("a"), F.greatest("b", "c").alias("b")).distinct(), "pairs")
    many = keep(join_sifted(tested, by.where("not few").select("a"), ["a"], "left_semi"), "many")
    discard(placed, by, held)
    return pairs, many


def apart(tested: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of leaders with a stray and another member, what sets members apart: (a, gram, b, n, d, pos, of) of the strays, and of the other members.

    tested: the pairs of a leader a and a member b; labels: components so far. A shingle is listed only if sieves say that a
    stray of the leader, and another member, may have it too.
    """
    placed = keep(homes(tested.select("a", "b"), labels).distinct(), "placed")
    asked = placed.groupBy("a").agg(F.count("*").alias("k"), F.max(F.col("of") != F.col("home")).alias("any")).where("k > 1 and any").select("a")
    placed, old = keep(join_sifted(placed, asked, ["a"], "left_semi"), "placed"), placed
    listed = join_sifted(tested.select("a", "b", "n", "d", "apart"), placed, ["a", "b"])
    columns = ["a", "b", "n", "d", "of", F.posexplode("apart").alias("pos", "gram")]
    strays = keep(listed.where("of <> home").select(*columns), "strays")
    n = strays.count()
    held = sieve(strays.select("a", "gram"), n)
    rest = listed.where("of = home").select(*columns)
    rest = keep(rest.where(held.passes(["a", "gram"])) if held else rest, "others")
    n += rest.count()
    held = sieve(strays.select("a", "gram").unionByName(rest.select("a", "gram")), n, least=2)
    discard(old, placed)
    if held is None:
        return strays, rest
    fewer = [keep(x.where(held.passes(["a", "gram"])), "apart") for x in (strays, rest)]
    discard(strays, rest)
    return fewer[0], fewer[1]


def differ_alike(percent: int) -> F.Column:
    """Whether sets of n and m, which differ from a third one in d and e shingles and meet in the one at pos and at, can be alike.

    Alike sets differ in so many shingles at most; what both have apart from the third makes up for the rest.
    """
    most = F.floor((F.col("n") + F.col("m")) * (100 - percent) / (100 + percent))
    return 2 * F.least(F.col("d") - F.col("pos"), F.col("e") - F.col("at")) >= F.col("d") + F.col("e") - most


def needed(n: str, m: str, percent: int) -> F.Column:
    """Shingles that sets of n and m have in common if they are alike."""
    return F.ceil((F.col(n) + F.col(m)) * percent / (100 + percent))


def reach(n: str, pos: str, m: str, at: str, percent: int) -> F.Column:
    """Whether sets of n and m, whose first common token is at pos and at, can be alike."""
    return F.least(F.col(n) - F.col(pos), F.col(m) - F.col(at)) >= needed(n, m, percent)


def confirmed(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs whose prefixes, as long as their sizes ask for, meet under the other orders too. One order after the other: most pairs end at the first."""
    for i in (1, 2):
        ends = keep(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct(), "ends")
        sides = keep(join_sifted(nodes.select("node", "n", F.col(f"p{i}").alias("p")), ends, ["node"], "left_semi"), "sides")
        held = small_enough(sides, 2 * F.size("p"))
        side = lambda k: held.select(F.col("node").alias(k), F.col("n").alias(f"{k}n"), F.col("p").alias(f"{k}p"))  # noqa: B023, E731
        head = lambda k: F.slice(f"{k}p", F.lit(1), F.greatest(F.lit(0), F.col(f"{k}n") - needed("an", "bn", percent) + 1).cast("int"))
        both = pairs.join(side("a"), "a").join(side("b"), "b")
        old, pairs = pairs, keep(both.where(F.arrays_overlap(head("a"), head("b"))).select("a", "b"), "confirmed")
        discard(ends, sides, *[old] * (i - 1))
    return pairs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_classes(read(spark, sf_dir, "documents"), words_each=3, percent=90)
