"""The operators on embeddings: extreme and mixed vectors, the index against brute force, work that the index saves."""

import numpy as np
import pytest

from plumbline.llm import embeddings, neighbours


def test_extreme_norms_lose_no_link():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(100, 8))
    x[50:] = x[:50] * (1 + 0.01 * rng.normal(size=(50, 8)))
    want = {(i, i + 50) for i in range(50)}
    for far in (1e-200, 1e200, 5e-324, 1.7e308):
        y = np.vstack([x, np.full((1, 8), far), np.full((1, 8), far)])
        got = {(int(i), int(j)) for r, c in embeddings.tile_pairs(y, y, 0.9) for i, j in zip(r, c) if i < j}
        assert want <= got and (100, 101) in got
    huge = np.vstack([x * 1e200, x * 1e-250])  # every norm over- or underflows when squared
    got = {(int(i), int(j)) for r, c in embeddings.tile_pairs(huge, huge, 0.9) for i, j in zip(r, c)}
    assert all((i, i + 100) in got for i in range(100))


def test_long_vectors_have_exact_products():
    rng = np.random.default_rng(2)
    q = np.where(rng.random((6, 5000)) < 0.9, 127, -127).astype(np.int8)
    assert (embeddings.tile_products(q, q) == q.astype(np.int64) @ q.T.astype(np.int64)).all()
    assert q.astype(np.int64)[0] @ q.astype(np.int64)[0] > 2**24  # beyond what one product in single precision holds


def test_bounds_hold_by_brute_force():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 12)) + 2 * rng.normal(size=(1, 12))
    n = x / np.linalg.norm(x, axis=1)[:, None]
    for threshold in (0.5, 0.9, 0.99):
        got = np.zeros((400, 400), bool)
        for r, c in embeddings.tile_pairs(x, x, threshold):
            got[r, c] = True
        sure = np.abs(n @ n.T - threshold) > 1e-12
        assert (got == (n @ n.T >= threshold))[sure].all()


def test_lengths_are_searched_apart(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=4 if i % 3 else 7).tolist()) for i in range(120)] + [(120, [1.0]), (140, [2.0] * 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.nearest(df, k=5).collect()
    by_id = dict(rows)
    for q in range(0, 120, 20):
        mine = [r["vec_id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])]
        same = [i for i, v in rows if len(v) == len(by_id[q]) and i != q]
        best = sorted(same, key=lambda i: (-np.dot(by_id[i], by_id[q]), i))[:5]
        assert len(mine) == 5 and len(set(mine) & set(best)) >= 4
    assert not [r for r in got if r["query_id"] in (120, 140)]  # nothing of their length


def test_norms_count(spark):
    """Largest inner product, not smallest angle: long vectors win. Sizes may be far from one."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 16)) * np.exp(rng.normal(size=(400, 1)))
    for size in (1.0, 1e150, 1e-150):
        df = spark.createDataFrame([(i, (v * size).tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
        got = neighbours.nearest(df, k=10).collect()
        hits = 0
        for q in range(0, 400, 20):
            score = x @ x[q]
            score[q] = -np.inf
            hits += len({r["vec_id"] for r in got if r["query_id"] == q} & set(np.argsort(-score)[:10].tolist()))
        assert hits >= 0.9 * 200


def test_probing_finds_all_within_its_radius():
    rng = np.random.default_rng(6)
    values = rng.integers(0, 1 << 6, (2000, 10)).astype(np.uint16)
    index = neighbours.MultiIndex(values, 6)
    for k in range(30):
        code = values[k].copy()
        for bit in rng.choice(60, 20, replace=False):
            code[bit // 6] ^= 1 << (bit % 6)
        apart = np.bitwise_count(values ^ code).sum(axis=1)
        rows = index.probed(code)
        assert set(np.flatnonzero(apart < 10 * (neighbours.REACH + 1))) <= set(rows.tolist())  # pigeonhole
        near = (np.bitwise_count(values ^ code) <= neighbours.REACH).any(axis=1)
        assert rows.tolist() == np.flatnonzero(near).tolist() and (index.apart(code, rows) == apart[rows]).all()


@pytest.mark.parametrize("name", ["sf0.1", "check_s"])
def test_recall_and_share_visited(spark, name):
    df = spark.read.parquet(f"/root/testdata/{name}/embeddings.parquet")
    rows = [r for r in df.collect() if r["embedding"] is not None and np.isfinite(np.array(r["embedding"], float)).all() and any(r["embedding"])]
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    got: dict[int, list] = {}
    for r in neighbours.nearest(df).collect():
        got.setdefault(r["query_id"], []).append(r)
    hits = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        score = x @ x[q]
        score[ids == ids[q]] = -np.inf
        hits += len({r["vec_id"] for r in got[ids[q]]} & set(ids[np.argsort(-score)[:20]].tolist()))
        total += 20
    visited = np.mean([r[0]["visited"] for r in got.values()]) / len(ids)
    print(name, "recall", hits / total, "visited", visited, "reranked", np.mean([r[0]["reranked"] for r in got.values()]) / len(ids))
    assert hits / total >= 0.95 and visited < 0.45
