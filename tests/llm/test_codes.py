import hashlib
import math
import random

import numpy as np
import pytest

from vellumspark.llm.codes import assigned, compress, walk

SCHEMA = "label int, vec_id long, embedding array<float>, code string, error string, part int"


def brute(rows, entries=64, rounds=2):
    """rows: (vec_id, label, vector), usable ones of one length."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    parts = []
    for _, _, v in rows:
        x = [math.floor(256 * float(np.float32(y))) for y in v]
        x += [0] * (-len(x) % 16)
        w = len(x) // 16
        parts.append([x[p * w : p * w + w] for p in range(16)])
    books = [[list(r[p]) for r in parts[:entries]] for p in range(16)]
    d = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))

    def near(p, x):
        return min(range(len(books[p])), key=lambda e: (d(books[p][e], x), e))

    for _ in range(rounds):
        for p in range(16):
            held = {}
            for r in parts:
                held.setdefault(near(p, r[p]), []).append(r[p])
            for e, xs in held.items():
                books[p][e] = [sum(c) // len(xs) for c in zip(*xs)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out = []
    for (i, label, _), r in zip(rows, parts):
        codes = [near(p, r[p]) for p in range(16)]
        out.append((i, label, "".join(f"{c:02x}" for c in codes), sum(d(books[p][c], r[p]) for p, c in enumerate(codes))))
    sums = {}
    for _, label, _, error in out:
        sums[label] = sums.get(label, 0) + error
    return sorted(((i, code, error, sums[label], digest) for i, label, code, error in out), key=str)


def told(df):
    return sorted(((r["vec_id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in df.collect()), key=str)


@pytest.mark.parametrize(("n", "width"), [(150, 48), (20, 16), (90, 20)])
def test_codes_against_brute_force(spark, n, width):
    rng = random.Random(n)
    base = [[rng.gauss(0, 0.1) for _ in range(width)] for _ in range(n)]
    rows = [(rng.choice([0, 1, None]), i, v) for i, v in enumerate(base)]
    rows += [(7, 1000 + k, base[3]) for k in range(40)] + [(7, 5, base[9]), (None, None, base[8]), (2, -4, [0.0] * width)]
    odd = [(0, 900, None), (0, 901, [1.0, float("nan")] + [0.0] * (width - 2)), (1, 902, [float("inf")] * width), (1, 903, [None] * width)]
    table = spark.createDataFrame([(label, i, v, "c", "e", 1) for label, i, v in rows + odd], SCHEMA).repartition(3)
    assert told(compress(table)) == brute([(i, label, v) for label, i, v in rows])


def test_odd_vectors(spark):
    assert compress(spark.createDataFrame([], SCHEMA)).collect() == []
    assert compress(spark.createDataFrame([(1, 1, None, "", "", 0)], SCHEMA)).collect() == []
    rows = [(1, 1, [0.5] * 16), (1, 2, [0.25] * 32), (None, 3, []), (1, 4, [3e38] * 16)]
    got = {r["vec_id"]: r for r in compress(spark.createDataFrame(rows, "label int, vec_id long, embedding array<float>")).collect()}
    assert set(got) == {1, 2, 3, 4} and got[1]["code"] == "00" * 16 and got[4]["code"] == "01" * 16
    assert got[2]["code"] is None and got[2]["error"] is None and got[2]["label_error"] == 0 and got[3]["label_error"] is None


@pytest.mark.parametrize("leaves", [1, 3, 10_000])
def test_the_trie_gives_all_distances(leaves):
    rng = np.random.default_rng(leaves)
    parts = rng.integers(-3, 3, (400, 5))
    entries = rng.integers(-3, 3, (9, 5))
    want = ((parts[:, None] - entries) ** 2).sum(2)
    of, s, often, nearest, error = assigned(parts, entries, leaves)
    assert (s[of] == parts).all() and (often == np.bincount(of)).all()
    assert (nearest[of] == want.argmin(1)).all() and (error[of] == want.min(1)).all()
    spans = [(a, z) for a, z, d in walk(s, entries, leaves) if (d == ((s[a:z, None] - entries) ** 2).sum(2)).all()]
    assert spans[0][0] == 0 and spans[-1][1] == len(s) and all(x[1] == y[0] for x, y in zip(spans, spans[1:]))
