import random
import re

import numpy as np
import pytest
import xxhash

from vellumspark.llm import simhash
from vellumspark.llm.simhash import Index, links_of, near_duplicates

SCHEMA = "text string, doc_id long, fp long, mask string, component string"


def brute_fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_components(fps):
    up = list(range(len(fps)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return [root(i) for i in range(len(fps))]


def words(seed):
    """Fingerprints in dense balls, in chains and far apart."""
    rng = random.Random(seed)
    out = {0, 7, 15, 2**64 - 1, 2**63}
    for _ in range(6):
        centre = rng.getrandbits(64)
        weak = rng.sample(range(64), 9)
        out |= {centre ^ sum(1 << b for b in rng.sample(weak, rng.randint(0, 6))) for _ in range(50)}
        for _ in range(20):
            centre ^= sum(1 << b for b in rng.sample(range(64), rng.choice([2, 3, 3, 4])))
            out.add(centre)
    return sorted(out | {rng.getrandbits(64) for _ in range(150)})


def grouped(fps, pairs):
    up = {x: x for x in fps}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    least = {}
    for i, x in enumerate(fps):
        least.setdefault(root(x), i)
    return [least[root(x)] for x in fps]


@pytest.mark.parametrize("seed", range(4))
def test_index_against_all_pairs(seed):
    fps = words(seed)
    rank = lambda x: [x := x ^ x >> k for k in (1, 2, 4, 8, 16, 32)][-1]
    x = np.array(sorted(fps, key=rank), np.uint64)
    node = np.zeros(len(x), np.int64)
    a, b = Index(node, x).linked(node, 3)
    assert (np.bitwise_count(x[a.astype(int)] ^ x[b.astype(int)]) <= 3).all() and len(a) < len(x)
    assert grouped(fps, zip(x[a.astype(int)].tolist(), x[b.astype(int)].tolist())) == brute_components(fps)


@pytest.mark.parametrize("block", [16_384, 12])
def test_links_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "ROWS", 64)
    fps = words(9)
    as_long = lambda x: x - 2**64 if x >> 63 else x
    rows = links_of(spark.createDataFrame([(as_long(x),) for x in fps], "fp long"), block=block).collect()
    pairs = [(r.a % 2**64, r.b % 2**64) for r in rows]
    assert all(bin(a ^ b).count("1") <= 3 for a, b in pairs)
    assert grouped(fps, pairs) == brute_components(fps)


def corpus():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeXé") for _ in range(rng.randint(1, 4)))
    texts = [None, "", " \t\n", "one", "One two", "one\x0btwo", "a b c", "A  b\nc", "  x", "x " * 70_000]
    for _ in range(8):
        base = [word() for _ in range(rng.choice([5, 60, 300]))]
        texts += [" ".join(base)] * 3
        for _ in range(20):
            t = list(base)
            t[rng.randrange(len(t))] = word()
            texts.append(" ".join(t))
    return texts


def test_near_duplicates_against_brute_force(spark):
    rows = [(t, 1000 - i, 1, "m", "c") for i, t in enumerate(corpus())]
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    ids = sorted(by)
    texts = {r[1]: r[0] for r in rows}
    fps = [brute_fingerprint(texts[i]) for i in ids]
    assert [by[i].fingerprint for i in ids] == [f"{f:016x}" for f in fps]
    assert [by[i].component_id for i in ids] == [ids[k] for k in brute_components(fps)]


def test_odd_rows(spark):
    text = "some words that stand in a row of their own here"
    rows = [(text, 5), (text, 5), (text, None), ("quite other words, and nothing like the rest of it", 5), (text, 9), (None, None), (None, 7)]
    got = sorted(((r.doc_id, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, "text string, doc_id long")).collect()), key=str)
    assert got == sorted([(5, 5), (5, 5), (None, None), (5, 5), (9, 5), (None, None), (7, 7)], key=str)
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
