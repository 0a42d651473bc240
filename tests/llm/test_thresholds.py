"""The pipeline takes near copies from similarity 0.8, op5 from 0.85."""

import math

import corpus_pipeline
from plumbline.llm import minhash


def test_pipeline_takes_near_copies_from_080(spark):
    words = [f"w{k}" for k in range(104)]  # 100 shingles
    near = words[:92] + [f"x{k}" for k in range(12)]  # 88 shared of 112: 0.786
    copy = words[:94] + [f"x{k}" for k in range(10)]  # 90 shared of 110: 0.818
    rows = [(1, " ".join(words), "en", "a", 9), (2, " ".join(copy), "en", "a", 9), (3, " ".join(w + "z" for w in words), "en", "a", 9), (4, " ".join(w + "z" for w in near), "en", "a", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()} == {1, 3, 4}
    assert {r["doc_id"]: r["kept"] for r in minhash.near_duplicates(docs, percent=85).collect()} == dict.fromkeys((1, 2, 3, 4), True)


def test_bands_follow_the_threshold():
    assert minhash.banding(85) == (32, 8)
    for percent in (30, 50, 70, 80, 90, 100):
        bands, rows = minhash.banding(percent)
        assert (1 - (percent / 100) ** rows) ** bands <= minhash.MISSED or math.isclose(percent, 100)


def test_pipeline_stage_equals_brute_force_at_080(spark):
    from test_operators import shingles

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    sets = {r["doc_id"]: shingles(r["text"]) for r in docs.collect()}
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    between = 0
    for i in sets:
        for j in sets:
            both, either = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if j < i and either and 100 * both >= 80 * either:
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
                between += 100 * both < 85 * either
    assert between  # the fixture has pairs that 0.85 leaves
    assert {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()} == {i for i in sets if top(i) == i}
