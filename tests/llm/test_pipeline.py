import corpus_pipeline
from vellumspark.llm.common import keep


def test_stages(spark):
    poem = "\n".join(f"line {i} of a passage that several documents share, word after word after word" for i in range(12))
    rows = [(i, f"document {i} says {' '.join(f'w{i}x{j}' for j in range(60))}", "en", f"s{i % 3}", 100) for i in range(60)]
    rows += [(100 + i, f"own words {i} {' '.join(f'v{i}y{j}' for j in range(80))}\n{poem}", "en", "s0", 100) for i in range(4)]
    rows += [(200, rows[0][1], "en", "s1", 100), (201, rows[1][1] + " more", "en", "s1", 100), (300, "12 34 %%", "en", None, 8), (301, None, None, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    counts = []
    for name, stage in corpus_pipeline.STAGES:
        docs = keep(stage(spark, docs, ""), "test")
        ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
        counts.append((name, ids, docs.columns))
    assert not counts[0][1] & {300, 301} and 200 in counts[0][1]
    assert 200 in counts[1][1] or counts[1][1] >= set(range(60))
    assert not counts[2][1] & {200, 201} and counts[2][1] >= set(range(60))
    assert all(c[2] == corpus_pipeline.COLUMNS for c in counts[:-1]) and "sequence_id" in counts[-1][2]
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        empty = keep(stage(spark, empty, ""), "test")
    assert empty.collect() == []


def test_null_and_repeated_ids_keep_their_own_decisions(spark):
    text = lambda i, n=60: " ".join(f"w{i}x{j}" for j in range(n))
    rows = [(i, text(i), "en", f"s{i % 3}", 100) for i in range(20)]
    rows += [(None, text(100 + i), "en", "s0", 100) for i in range(5)] + [(5, text(200), "en", "s1", 100), (5, text(200), "en", "s1", 100)]
    rows += [(None, text(1), "en", "s0", 100), (6, text(2), "en", "s0", 100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    left = [tuple(r) for r in corpus_pipeline.distinct(spark, docs, "").collect()]
    assert sorted(r[1] for r in left) == sorted({r[1] for r in rows})
    assert {r[0] for r in left if r[1] in (text(1), text(2))} == {1, 2}
    # of one source all documents are taken once at least, whatever their ids
    one = [(*r[:3], "s", *r[4:]) for r in rows]
    got = [tuple(r) for r in corpus_pipeline.mixed(spark, spark.createDataFrame(one, docs.schema), "").collect()]
    assert set(got) == set(one) and all(one.count(r) <= got.count(r) <= 2 * one.count(r) for r in got)
    assert abs(len(got) - 1.5 * len(one)) <= 1


def test_unlabelled_corpus_stays(spark):
    rows = [(1, "some words", None), (2, "12 %% 34", None), (3, None, None), (4, "été", None), (5, "", None), (6, "日本", None)]
    docs = spark.createDataFrame([(*r, "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in corpus_pipeline.identified(spark, docs, "").collect()) == [1, 4, 6]
