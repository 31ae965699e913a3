import random
import re

import pyarrow as pa
import pytest

from vellumspark.llm import collocations as C

SCHEMA = "lang string, doc_id long, text string, w1 int, n int, phrase string, score int, h long"


def brute(rows, least, top):
    low = str.maketrans({chr(65 + k): chr(97 + k) for k in range(26)})
    f, n = {}, {}
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(low)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] = n.get(lang, 0) + len(w)
            for k in range(1, 6):
                for i in range(len(w) - k + 1):
                    key = lang, tuple(w[i : i + k])
                    f[key] = f.get(key, 0) + 1
    cand = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    gone = set()
    for (lang, x), a in cand.items():
        for m in range(2, len(x)):
            for i in range(len(x) - m + 1):
                if 100 * a >= 100 * cand[lang, x[i : i + m]]:
                    gone.add((lang, x[i : i + m]))
    out = {}
    for (lang, x), a in cand.items():
        if (lang, x) in gone:
            continue
        score, _, l, r = min((1000 * a * n[lang] // (f[lang, x[:k]] * f[lang, x[k:]]), k, f[lang, x[:k]], f[lang, x[k:]]) for k in range(1, len(x)))
        out.setdefault(lang, []).append((-score, -a, " ".join(x).encode(), l, r))
    return sorted((lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, xs in out.items() for i, (s, a, p, l, r) in enumerate(sorted(xs)[:top]))


def corpus(seed):
    rng = random.Random(seed)
    words = {lang: [f"{lang}{'é' * (k % 3)}{k}" for k in range(12)] + ["und", lang, "The"] for lang in ("en", "de")}
    out = []
    for k in range(160):
        lang = rng.choice(["en", "en", "de", None])
        own = words[lang or "de"]
        text = ""
        for _ in range(rng.randint(0, 60)):
            text += rng.choice(["", "", "", "A bird in the hand ", "x y x y "]) + rng.choice(own) + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\x0b", " "])
        out.append((lang, text))
    return out + [("en", None), ("fr", ""), (None, " \t"), ("en", "a-b " * 30_000), ("de", "one. two! three?"), ("en", "w" * 600 + " tail ")] + [("fr", "tic tac toe tic")] * 9


def told(rows):
    return sorted((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in rows.collect())


@pytest.mark.parametrize(("least", "top", "share"), [(8, 2000, 500_000), (8, 7, 20), (2, 40, 500_000)])
def test_collocations_against_all_ngrams(spark, monkeypatch, least, top, share):
    monkeypatch.setattr(C, "SHARE", share)
    monkeypatch.setattr(C, "BLOCK", 3000)
    rows = corpus(least)
    docs = spark.createDataFrame([(lang, k % 9, text, 1, 1, "p", 1, 1) for k, (lang, text) in enumerate(rows)], SCHEMA).repartition(4)
    want = brute(rows, least, top)
    assert told(C.collocations(docs, least, top)) == want and len(want) > 20


def test_without_bitmaps_the_result_is_the_same(spark, monkeypatch):
    """Words and pairs beyond the bitmaps' size all pass."""
    monkeypatch.setattr(C, "SIEVE_BITS", 3)
    rows = corpus(1)
    docs = spark.createDataFrame([(lang, text) for lang, text in rows], "lang string, text string")
    assert told(C.collocations(docs, 8, 50)) == brute(rows, 8, 50)


def test_large_products(spark):
    """Products past 64 bits are exact."""
    n, a = 9_007_199_254_740_993, 9_007_199_254_740_881
    cols = ["lang", *C.COLUMNS, "size", "a", "n"]
    cand = spark.createDataFrame([("x", 1, 2, 0, 0, 0, 2, a, n)], ", ".join(f"{c} {'string' if c == 'lang' else 'int' if c == 'size' else 'long'}" for c in cols))
    counts = spark.createDataFrame([(1, 0, 0, 0, 0, a + 7), (2, 0, 0, 0, 0, 3 * 10**6 + 1)], ", ".join(f"{c} long" for c in [*C.COLUMNS, "f"]))
    got = C.scored(cand, counts).head()
    assert got["score"] == 1000 * a * n // ((a + 7) * (3 * 10**6 + 1))


def test_nothing(spark):
    assert C.collocations(spark.createDataFrame([], SCHEMA)).collect() == []
    assert C.collocations(spark.createDataFrame([(None, None), ("en", "")], "lang string, text string")).collect() == []


def test_words_that_share_a_hash_stay_apart():
    """So that the check for them sees both, and takes the next salt."""
    _, _, t = next(C.tokens(pa.array(["one two one two one two three", "one"]), pa.array(["en", None]), 0))
    t.h[:] = 5
    at, n = C.distinct_words(t, 0)
    found = {t.data[t.start[k] : t.end[k]].tobytes(): int(m) for k, m in zip(at, n)}
    assert found == {b"one": 4, b"two": 3, b"three": 1}
    first, second = (next(C.tokens(pa.array(["one two"]), pa.array(["en"]), salt))[2].h for salt in C.SALTS[:2])
    assert not set(first.tolist()) & set(second.tolist())
