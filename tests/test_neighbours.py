"""Exact neighbours through pivots against plain comparison of all pairs."""

from __future__ import annotations

import numpy as np
import pytest

from lumenfield.operators.neighbours import similar


def plain(x, ids, queries, k):
    out = {}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for i in queries:
        d = np.floor((1.0 - u @ u[i]) * 1e9 + 0.5001) / 1e9
        order = [j for j in np.lexsort((ids, d)) if ids[j] != ids[i]][:k]
        out[int(ids[i])] = [(int(ids[j]), float(d[j])) for j in order]
    return out


def answers(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.photo_id, r.distance))
    return out


@pytest.mark.parametrize("spread,pivots", [(0.05, 40), (5.0, 7), (0.05, 1)])
def test_pivots_lose_nothing(spark, spread, pivots):
    """Tight clusters, where cells are ruled out, and shapeless vectors, where none are; copies make ties."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(15, 8))[rng.integers(0, 15, 700)] + spread * rng.normal(size=(700, 8))
    x[100:130] = x[99]
    ids = rng.permutation(5000)[:700]
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "photo_id long, embedding array<double>").repartition(3)
    ask = df.where("photo_id % 10 = 0 or photo_id = " + str(int(ids[110])))
    got = answers(similar(df, ask, 12, pivots))
    want = plain(x, ids, [i for i in range(700) if ids[i] % 10 == 0 or i == 110], 12)
    assert got.keys() == want.keys()
    for q, found in want.items():
        assert [i for i, _ in got[q]] == [i for i, _ in found]
        assert np.allclose([d for _, d in got[q]], [d for _, d in found], atol=2e-9)


def test_odd_vectors_take_no_part(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, None), (4, [0.0, 0.0]), (None, [1.0, 1.0]), (5, [3.0, 3.0]), (6, [float("inf"), 1.0])]
    df = spark.createDataFrame(rows, "photo_id long, embedding array<double>")
    got = answers(similar(df, df, 5))
    assert got.keys() == {1, 2, 5} and [i for i, _ in got[1]] == [5, 2] and [i for i, _ in got[5]] == [1, 2]
    assert similar(df.limit(0), df, 5).count() == similar(df, df.limit(0), 5).count() == 0
