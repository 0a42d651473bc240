"""The Pitman-Yor model against brute force: seating customer by customer, Stirling numbers, sums of probabilities."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.llm import language_model as lm
from plumbline.llm import pitman_yor as py


def test_stirling_numbers():
    for d in (0.2, 0.5, 0.8):
        table = py.stirling_table(d, 1500)
        assert np.exp(table[3, 1:4]) == pytest.approx([(1 - d) * (2 - d), 3 * (1 - d), 1])
        t = np.unique(np.geomspace(1, 1499, 60).astype(int))
        off = np.abs(py.log_stirling(np.full(len(t), 1500), t, d) - table[1500, t])
        assert off[t < 1490].max() < 0.02 and off.max() < 0.1  # worst where all customers but a few sit alone


def _seat_by_customer(rng, counts, chance, strength, d, sweeps, burn):
    """Remove and seat again every single customer, sweep after sweep; mean tables of each dish."""
    sizes = [[int(c)] for c in counts]
    total = np.zeros(len(counts))
    for k in range(sweeps):
        for w, c in enumerate(counts):
            for _ in range(c):
                mine = sizes[w]
                at = rng.choice(len(mine), p=np.array(mine) / sum(mine))
                mine[at] -= 1
                if not mine[at]:
                    mine.pop(at)
                opened = sum(map(len, sizes))
                mass = np.array([x - d for x in mine] + [(strength + d * opened) * chance[w]])
                at = rng.choice(len(mass), p=mass / mass.sum())
                if at == len(mine):
                    mine.append(1)
                else:
                    mine[at] += 1
        if k >= burn:
            total += [len(s) for s in sizes]
    return total / (sweeps - burn)


def test_tables_equal_seating_by_customer():
    rng = np.random.default_rng(1)
    counts, chance, strength, d = np.array([20, 9, 4, 2, 1]), np.array([0.5, 0.2, 0.05, 0.01, 0.1]), 3.0, 0.6
    want = _seat_by_customer(rng, counts, chance, strength, d, 2500, 100)
    seating, t, total = py.Seating(d), np.ones(5, int), np.zeros(5)
    for k in range(20_100):
        g = py.spread(rng, np.array([t.sum()]), strength, d)
        t = seating.draw(rng, counts, d * g[0] * chance, t)
        total += t * (k >= 100)
    assert total / 20_000 == pytest.approx(want, rel=0.03)


def test_many_customers_like_the_table(monkeypatch):
    rng = np.random.default_rng(3)
    counts, weight = np.full(400, 900), np.full(400, 30.0)
    exact = py.Seating(0.7)
    want = exact.draw(rng, counts, weight, counts)
    monkeypatch.setattr(py, "TABLE", 500)
    t = exact.first(counts, weight)
    for _ in range(20):
        t = exact.draw(rng, counts, weight, t)
    assert t.mean() == pytest.approx(want.mean(), rel=0.02) and t.std() == pytest.approx(want.std(), rel=0.2)
    million = exact.draw(rng, np.full(50, 10**9), np.full(50, 0.5), np.ones(50, int), steps=200)  # as many as a third of a huge corpus
    assert (million >= 1).all() and million.mean() < 100


def _part(layout, pairs):
    context, word, count = (np.array(x) for x in zip(*pairs))
    order = np.lexsort((word, context))
    context, word, count = context[order].astype(np.uint64), word[order].astype(np.uint64), count[order].astype(np.uint32)
    starts = np.flatnonzero(np.r_[True, context[1:] != context[:-1]])
    payload = lm._press(*lm._coded(context[starts], layout.frequent), np.diff(np.r_[starts, len(context)]).astype(np.uint32), *lm._coded(word, layout.frequent), count)
    return lm.Part(pa.table({"block": pa.array([0], pa.int64()), "part": pa.array([0], pa.int64()), "payload": pa.array([payload], pa.binary())}), layout)


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(2)
    none = np.zeros(0, np.int64)
    layout = lm.Layout(np.arange(5, dtype=np.uint64), none.astype(np.uint64), none, none, 8, 8, 100)
    vocabulary = 60
    pairs = [(u, w, int(rng.zipf(1.5)) % 3000 if rng.random() < 0.3 and u < 4 else 0) for u in range(5) for w in range(vocabulary)]
    part = _part(layout, pairs)
    levels = lm.Levels(2.0, 0.7, 0.6, {})
    chance = rng.dirichlet(np.ones(vocabulary + 1))
    by_word = dict(zip(part.dishes.tolist(), range(vocabulary)))
    own = np.array([chance[int(w)] for w in part.dishes])
    got = lm.predictive(part, own, levels, 5, 4, 1)
    opened = np.bincount(part.context, part.tables, 5)
    for u in range(5):  # the last context was never seen in training
        mine = part.context == u
        assert len(by_word) == mine.sum() == vocabulary
        rest = (2.0 + 0.7 * opened[u]) / (2.0 + part.total[u]) * chance[-1]  # the unknown word's, for the last sample
        assert got[mine].sum() + rest == pytest.approx(1.0, abs=0.02 if u < 4 else 1e-9)
    one = lm.predictive(part, own, levels, 5, 1, 0)
    opened = np.bincount(part.context, part.tables, 5)
    for u in range(5):
        rest = (2.0 + 0.7 * opened[u]) / (2.0 + part.total[u]) * chance[-1]
        assert one[part.context == u].sum() + rest == pytest.approx(1.0, abs=1e-9)


def test_layout_leaves_counts_alone(spark):
    """Contexts dealt over many parts, rare codes and more rounds change no count, and the score only by its draws."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    wide = {r["doc_id"]: r for r in lm.score_language(docs).collect()}
    narrow = {r["doc_id"]: r for r in lm.score_language(docs, tokens_per_part=2000, rounds=3).collect()}
    assert wide.keys() == narrow.keys()
    for i, r in wide.items():
        assert [r[k] for k in ("held_out", "n_tokens", "n_known", "train_tokens")] == [narrow[i][k] for k in ("held_out", "n_tokens", "n_known", "train_tokens")]
        assert r["base_score"] == pytest.approx(narrow[i]["base_score"], rel=1e-12)
    assert sum(r["score"] for r in wide.values()) == pytest.approx(sum(r["score"] for r in narrow.values()), rel=0.02)
    again = {r["doc_id"]: r["score"] for r in lm.score_language(docs).collect()}
    assert all(again[i] == r["score"] for i, r in wide.items())


def test_more_contexts_with_more_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    near = docs.select((F.col("doc_id") * 2 + 1_000_000).alias("doc_id"), F.regexp_replace("text", "e", "ë").alias("text"))
    few = lm.score_language(docs).agg(F.sum("score")).first()[0]
    both = lm.score_language(docs.unionByName(near)).where("doc_id < 1000000").agg(F.sum("score")).first()[0]
    assert both == pytest.approx(few, rel=0.2)
