import random
import re

import pytest

from vellumspark.llm.jaccard import similarity_classes

SCHEMA = "text string, doc_id long, node string, n int, token string"


def shingles(text, k):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, k, percent):
    sets = {i: shingles(t, k) for i, t in rows}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a, i in enumerate(ids):
        for j in ids[a + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                p, q = sorted((root(i), root(j)))
                up[q] = p
    return {i: (len(sets[i]), root(i)) for i in ids}


def corpus(seed):
    """Groups of near copies at many distances, chains, copies, small texts and unrelated ones."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 3)))
    out = []
    for _ in range(4):
        base = [word() for _ in range(rng.choice([12, 40, 90]))]
        for _ in range(60):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
                t[rng.randrange(len(t))] = word()
            out.append(" ".join(t))
        for _ in range(15):  # a chain: each differs a little from the one before
            base = list(base)
            base[rng.randrange(len(base))] = word()
            out.append("  ".join(base) + "\n")
    out += [" ".join(word() for _ in range(rng.randint(0, 30))) for _ in range(60)]
    out += ["The SAME words here", "the same WORDS\there", "a", "A", "b", "", " ", "a b", None]
    rng.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize(("seed", "k", "percent"), [(1, 3, 90), (2, 5, 80), (3, 1, 70)])
def test_components_are_those_of_all_pairs(spark, seed, k, percent):
    rows = corpus(seed)
    df = spark.createDataFrame([(t, i, "x", 1, "y") for i, t in rows], SCHEMA)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in similarity_classes(df, k, percent).collect()}
    assert got == brute(rows, k, percent)


def test_empty_and_null(spark):
    assert similarity_classes(spark.createDataFrame([], SCHEMA)).collect() == []
    df = spark.createDataFrame([(None, 1), ("a b c d e f", None), ("a b c d e f", 3), ("a b c d e f", 3), ("a b c d e f", 2)], "text string, doc_id long")
    got = sorted(map(tuple, similarity_classes(df).collect()), key=str)
    assert got == sorted([(1, 0, 1), (None, 2, None), (3, 2, 2), (3, 2, 2), (2, 2, 2)], key=str)


def strays(spark, members, size, kept):
    """A leader 0 and members that each differ from it in all but `kept` of its shingles, every two neighbours alike, none linked yet."""
    apart = [[1000 * (i // 2) + j for j in range(size)] for i in range(members)]
    rows = [(0, i + 1, False, apart[i], 100, size + 100 - kept) for i in range(members)]
    return spark.createDataFrame(rows, "a long, b long, linked boolean, apart array<long>, n long, d long")


def test_few_members_meet_as_pairs_and_many_by_shingles(spark):
    """Eight members of 40 shingles each are 64 pairs, not 320 rows of shingles; a hundred with two each are 200, not 10,000."""
    from vellumspark.llm.jaccard import paired

    labels = spark.createDataFrame([], "node long, component long")
    pairs, many = paired(strays(spark, 8, 40, 90), labels, 90)
    assert many.count() == 0 and pairs.count() == 28
    pairs, many = paired(strays(spark, 100, 2, 90), labels, 90)
    assert many.count() == 100 and pairs.count() == 0


def test_paired_leaves_out_sizes_that_cannot_be_alike(spark):
    from vellumspark.llm.jaccard import paired

    rows = [(0, 1, False, [1] * 9, 100, 50), (0, 2, False, [2] * 9, 100, 55), (0, 3, False, [3] * 9, 150, 50), (0, 4, True, [4] * 9, 100, 45)]
    tested = spark.createDataFrame(rows, "a long, b long, linked boolean, apart array<long>, n long, d long")
    labels = spark.createDataFrame([(0, 0), (4, 0)], "node long, component long")
    pairs, _ = paired(tested, labels, 90)
    assert sorted(map(tuple, pairs.collect())) == [(1, 2), (1, 4), (2, 4)]
