"""One key with most of the rows, and groups above every size threshold, stay exact."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumenfield.operators import quantile, scan, selection
from lumenfield.streaming import twins


@pytest.fixture
def small_brackets(monkeypatch):
    monkeypatch.setattr(quantile, "SMALL", 50)
    monkeypatch.setattr(quantile, "ACCURACY", 200)


@pytest.mark.parametrize("shape", ["normal", "ties", "heavy"])
def test_exact_quantiles_of_large_groups(spark, small_brackets, shape):
    rng = np.random.default_rng(5)
    v = {"normal": rng.normal(size=6000), "ties": rng.integers(0, 4, 6000).astype(float), "heavy": rng.pareto(0.4, 6000)}[shape]
    g = np.where(np.arange(6000) % 3 == 0, 1, np.arange(6000) % 7 + 10)
    df = spark.createDataFrame(pd.DataFrame({"g": g, "v": v}))
    probs = {"lo": 0.0, "a": 0.25, "m": 0.5, "z": 0.9985, "hi": 1.0}
    got = quantile.exact_quantiles(df, ["g"], "v", probs).toPandas().set_index("g")
    for k in np.unique(g):
        want = np.percentile(v[g == k], [100 * p for p in probs.values()])
        assert np.allclose(got.loc[k, list(probs)].to_numpy(float), want, rtol=1e-12)
    mm = quantile.median_mad(df, ["g"], "v").toPandas().set_index("g")
    one = v[g == 1]
    assert np.isclose(mm.loc[1, "mad"], np.median(np.abs(one - np.median(one))))


def _events(n=4000):
    rng = np.random.default_rng(7)
    t = np.sort(rng.integers(0, 40 * 86400, n))
    return pd.DataFrame(
        {"event_id": np.arange(n), "user_id": np.where(rng.random(n) < 0.4, 0, rng.integers(1, 30, n)), "ts": pd.to_datetime(t, unit="s")}
    )


def test_rolling_count_matches_brute_force(spark):
    pdf = _events()
    got = scan.rolling_count(spark.createDataFrame(pdf), ["user_id"], "ts", "event_id").toPandas().set_index("event_id")
    sec = pdf.ts.astype("int64").to_numpy() // 10**9 if pdf.ts.dtype == "datetime64[ns]" else pdf.ts.astype("datetime64[s]").astype("int64").to_numpy()
    u = pdf.user_id.to_numpy()
    for i in range(0, len(pdf), 37):
        want = ((u == u[i]) & (sec <= sec[i]) & (sec > sec[i] - 86400)).sum()
        assert got.loc[i, "n_window"] == want


def test_running_storage_matches_fold(spark):
    rng = np.random.default_rng(3)
    pdf = _events(3000).rename(columns={"event_id": "change_id", "user_id": "owner_id"})
    pdf["change"] = rng.choice(["insert", "delete", "soft_delete", "restore", "update"], len(pdf))
    pdf["bytes"] = rng.integers(1, 1000, len(pdf))
    pdf["was_deleted"] = rng.random(len(pdf)) < 0.3
    got = twins.running_storage(spark.createDataFrame(pdf)).toPandas().set_index("change_id")["used_bytes"]
    used: dict[int, int] = {}
    for r in pdf.sort_values(["ts", "change_id"]).itertuples():
        d = 0
        if r.change == "insert" and not r.was_deleted:
            d = r.bytes
        elif r.change in ("delete", "soft_delete") and not r.was_deleted:
            d = -r.bytes
        elif r.change == "restore" and r.was_deleted:
            d = r.bytes
        used[r.owner_id] = max(0, used.get(r.owner_id, 0) + d)
        assert got[r.change_id] == used[r.owner_id]


def _brute_selection(c, target, min_q):
    """Plain restatement of the greedy rule for one job."""

    def solved(f):
        return f["x"] is not None and f["s"] is not None and f["s"] > 0

    def dist(a, b):
        if not (solved(a) and solved(b)):
            return 0.0
        t = [min(abs(a[k] - b[k]), 1 - abs(a[k] - b[k])) for k in "xy"]
        return 0.7 * min(1, np.hypot(*t) / np.sqrt(0.5)) + 0.3 * min(1, abs(np.log2(a["s"] / b["s"])) / 2)

    ok = sorted((f for f in c if f["q"] >= min_q), key=lambda f: f["id"])
    pool = [f for f in ok if solved(f)]
    if len(pool) < target:
        pool = ok
    chosen = []
    while pool and len(chosen) < target:
        score = [f["q"] if not chosen else 0.65 * f["q"] + 0.35 * min(dist(f, s) for s in chosen) for f in pool]
        chosen.append(pool.pop(int(np.argmax(score))))
    return [f["id"] for f in chosen]


@pytest.mark.parametrize("target,min_q,solved_share", [(5, 0.0, 0.8), (12, 0.4, 0.3), (40, 0.2, 0.5)])
def test_selection_matches_brute_force(spark, target, min_q, solved_share):
    rng = np.random.default_rng(target)
    rows = []
    for job in range(4):
        for i in range(30):
            s = rng.random() < solved_share
            rows.append((job, i, target, float(rng.random()), *([float(v) for v in (*rng.random(2), 1 + 3 * rng.random())] if s else (None, None, None))))
    df = spark.createDataFrame(rows, "job_id long, photo_id long, target_count int, quality_score double, dither_phase_x double, dither_phase_y double, pixel_scale_arcsec double")
    got = selection.select_frames(df, min_quality=min_q).toPandas()
    assert len(got) == len(rows)
    for job in range(4):
        c = [{"id": r[1], "q": r[3], "x": r[4], "y": r[5], "s": r[6]} for r in rows if r[0] == job]
        mine = got[(got.job_id == job) & got.is_selected].sort_values("rank").photo_id.tolist()
        assert mine == _brute_selection(c, target, min_q)


def test_diversity_refuses_oversized_selection(spark):
    df = spark.range(20).select(F.lit(1).alias("job_id"), F.lit(0.1).alias("dither_phase_x"), F.lit(0.2).alias("dither_phase_y"), F.lit(1.0).alias("pixel_scale_arcsec"))
    assert selection.diversity(df).collect()[0].phase_diversity == 0.0
    with pytest.raises(Exception, match="selection above 10"):
        selection.diversity(df, limit=10).collect()
