"""The pipeline against its stages applied by brute force."""

from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F

from plumbline.llm import langid, mixing, queries, secrets, sentencepieces


def test_pipeline_equals_brute_force(spark):
    small = "/root/testdata/sf0.001"
    rows = sorted(spark.read.parquet(f"{small}/documents.parquet").collect(), key=lambda r: r["doc_id"])
    docs = spark.createDataFrame(rows)
    names, score = langid.fit_languages(docs).decide([r["text"] or "" for r in rows])
    rows = [r.asDict() for r, n, s in zip(rows, names, score) if n != langid.UNDETERMINED and s >= corpus_pipeline.LEAST_SCORE]
    assert len(rows) >= 0.98 * len(names)  # clean documents stay
    from test_operators import shingles

    sets = [shingles(r["text"]) for r in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    rows = [r for i, r in enumerate(rows) if top(i) == i]
    for r in rows:
        if r["text"]:
            r["text"] = secrets.redact(r["text"], secrets.scan(r["text"]))
    mixed = mixing.mix_sources(spark.createDataFrame(rows, docs.schema)).collect()
    times = {r["doc_id"]: r["entries"] for r in mixed}
    vocab = sentencepieces.vocabulary(queries.PIECE_MODEL)
    want = Counter()
    for r in rows:
        want[(r["doc_id"], len(vocab.encode(r["text"])))] += times[r["doc_id"]]
    got = Counter((r["doc_id"], r["n_tokens"]) for r in corpus_pipeline.run(spark, small).collect())
    assert got == +want
    assert corpus_pipeline.ORACLE_SQL is None


def test_stages_on_empty(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
    assert docs.count() == 0


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def _text(k, n=40):
    return " ".join(f"w{k}x{j}" for j in range(n))


def test_repeated_ids_lose_no_document(spark):
    rows = [(1, _text(1), "en", "a", 9), (1, _text(2), "en", "a", 9), (1, _text(2), "en", "a", 9), (2, _text(2), "en", "a", 9), (3, _text(3), "en", "a", 9), (3, _text(3), None, "a", 9)]
    rows += [(None, _text(4), "en", "a", 9), (None, _text(4), "en", "a", 9), (5, None, "en", "a", 0), (6, "", "en", "a", 0), (7, None, None, None, None)]
    docs = spark.createDataFrame(rows, COLUMNS).withColumn("key", F.lit("clash")).withColumn("kept", F.lit(False))
    for order in (docs, docs.orderBy(F.desc("text")), docs.repartition(3)):
        got = sorted((tuple(r) for r in corpus_pipeline.near_duplicates(spark, order, "").collect()), key=str)
        # text 2 is a near-duplicate group of (1, 2) and the repeats of id 1: one of it stays, and text 1 stays as well
        assert Counter(r[1] for r in got) == Counter([_text(1), _text(2), _text(3), _text(4), _text(4), None, "", None])
        assert (3, _text(3), None, "a", 9) in got


def test_mixture_takes_what_the_mix_gives(spark):
    rows = [(k, _text(k, 10 + k), "en", "a", 9) for k in range(30)] + [(None, _text(100 + k, 12), "en", "b", 9) for k in range(7)] + [(50, _text(50, 8), "en", "b", 9)] * 5
    rows += [(60, None, "en", "a", 0), (61, "", None, None, 0), (62, _text(62, 5), "en", None, 1)]
    docs = spark.createDataFrame(rows, COLUMNS).withColumn("size", F.lit("clash")).withColumn("place", F.lit(1))
    mixed = mixing.mix_sources(docs.select("doc_id", "source", "text"), keep=("source",)).collect()
    want = Counter()
    for r in mixed:
        want[(r["doc_id"], r["source"], r["size"])] += r["entries"]
    got = Counter()
    for r in corpus_pipeline.mixture(spark, docs, "").collect():
        got[(r["doc_id"], r["source"], len(r["text"].split()))] += 1
    assert got == +want


def test_stages_on_awkward_rows(spark):
    rows = [(None, None, None, None, None), (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, " \n\t ", "en", None, 3), (4, "x" * 50_000, "en", "a", 50_000), (5, "é ñ 日本 \x00", "fr", "b", 9)]
    rows += [(6, "the same words again and again and again", "en", "a", 40)] * 3 + [(None, "no id but some words in here", "en", "a", 30)]
    docs = spark.createDataFrame(rows, COLUMNS)
    for c in ("kept", "size", "score", "spans", "block", "key", "entries", "lang_pred"):
        docs = docs.withColumn(c, F.lit("clash"))
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        out.collect()
        if stage is not corpus_pipeline.STAGES[-1][1]:
            assert out.columns == list(corpus_pipeline.COLUMNS)
            docs = out
