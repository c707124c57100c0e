"""What the review of round four found: copies and wide rows in spatial joins, apertures that unfold in the driver."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumenfield.functions import geo
from lumenfield.operators import audit, crossmatch


def _nodes(plan):
    if plan.nodeName() == "AdaptiveSparkPlan":
        plan = plan.initialPlan()
    yield plan
    for i in range(plan.children().size()):
        yield from _nodes(plan.children().apply(i))


def _exchanged(df) -> list[str]:
    """Columns of each exchange but broadcasts."""
    nodes = _nodes(df._jdf.queryExecution().executedPlan())
    return [n.output().mkString(" ") for n in nodes if n.nodeName() == "Exchange"]


def _sep(ra1, dec1, ra2, dec2):
    a, b, c, d = (math.radians(v) for v in (ra1, dec1, ra2, dec2))
    return math.degrees(math.acos(max(-1.0, min(1.0, math.sin(b) * math.sin(d) + math.cos(b) * math.cos(d) * math.cos(a - c)))))


def _sky(spark, n, crowded):
    rng = np.random.default_rng(21)
    ra, dec = np.r_[rng.uniform(0, 360, n), rng.uniform(40, 41, crowded)], np.r_[rng.uniform(-90, 90, n), rng.uniform(10, 11, crowded)]
    photos = pd.DataFrame({"photo_id": range(n + crowded), "ra_deg": ra, "dec_deg": dec})
    targets = pd.DataFrame({"target_id": range(60), "t_ra": np.r_[rng.uniform(0, 360, 28), 10.0, 20.0, rng.uniform(40, 41, 30)], "t_dec": np.r_[rng.uniform(-90, 90, 28), 90.0, -90.0, rng.uniform(10, 11, 30)], "radius_deg": rng.uniform(0.2, 9, 60)})
    return photos, targets, spark.createDataFrame(photos), spark.createDataFrame(targets)


@pytest.mark.parametrize("pairs", [40, 50_000_000])
def test_cone_match_splits_crowded_cells_both_ways(spark, pairs):
    photos, targets, p, t = _sky(spark, 150, 100)
    odd = spark.createDataFrame([(None, 40.5, 10.5, 1.0), (70, None, 1.0, 1.0), (71, 40.5, None, 1.0), (72, 40.5, 10.5, None)], t.schema)
    got = crossmatch.cone_match(t.unionByName(odd), p, crowd=7, pairs=pairs).select("target_id", "photo_id").collect()
    want = {(a.target_id, b.photo_id) for a in targets.itertuples() for b in photos.itertuples() if _sep(a.t_ra, a.t_dec, b.ra_deg, b.dec_deg) <= a.radius_deg}
    want |= {(None, b.photo_id) for b in photos.itertuples() if _sep(40.5, 10.5, b.ra_deg, b.dec_deg) <= 1.0}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_cone_match_copies_no_targets_for_few_pairs_and_shuffles_lean_rows(spark, monkeypatch):
    seen = []
    spread = getattr(crossmatch, "spread", None)
    monkeypatch.setattr(crossmatch, "spread", lambda df, *keys: (seen.append((df, keys)), spread(df, *keys))[1], raising=False)
    _, _, p, t = _sky(spark, 0, 3000)
    found = crossmatch.cone_match(t.where("target_id >= 30"), p, crowd=1000)
    assert not any(c in x for x in _exchanged(found) for c in ("_tu", "_u#", "_near"))
    sent = next(d for d, keys in seen if keys == ("_zcell",) and "target_id" in d.columns)
    assert sent.count() == sent.distinct().count() == sent.select("target_id", "_zcell").distinct().count()
    # one copy of a target for each cell with photos that it reaches: those lie in two cells at most
    assert sent.groupBy("target_id").count().agg(F.max("count")).first()[0] <= 2


def test_place_match_is_the_same_in_pieces(spark):
    rng = np.random.default_rng(5)
    photos = spark.createDataFrame(pd.DataFrame({"photo_id": range(200), "lat_deg": np.r_[rng.uniform(-90, 90, 100), rng.uniform(47, 49, 100)], "lon_deg": np.r_[rng.uniform(-180, 180, 100), rng.uniform(10, 12, 100)]}))
    sites = spark.createDataFrame(pd.DataFrame({"site_id": range(30), "s_lat": np.r_[rng.uniform(-90, 90, 20), rng.uniform(47, 49, 10)], "s_lon": np.r_[rng.uniform(-180, 180, 20), rng.uniform(10, 12, 10)], "km": rng.uniform(50, 6000, 30)}))
    m = geo.geodesic_m(F.col("lat_deg"), F.col("lon_deg"), F.col("s_lat"), F.col("s_lon"))
    want = sorted(map(tuple, sites.crossJoin(photos).where(m <= F.col("km") * 1000.0).select("site_id", "photo_id").collect()))
    for pairs in (30, crossmatch.PAIRS):
        assert sorted(map(tuple, crossmatch.place_match(sites, photos, crowd=5, pairs=pairs).select("site_id", "photo_id").collect())) == want


def test_targets_unfold_to_the_cells_of_their_caps(spark):
    rows = [(1, 0.0, 0.0, 3.0), (2, 89.5, 10.0, 2.0), (3, -90.0, 0.0, 1.0), (4, 10.0, 359.9, 1.0), (5, 30.0, -179.9, 6.0), (6, 5.0, 5.0, 120.0), (7, None, 5.0, 1.0), (8, 5.0, None, 1.0), (9, 5.0, 5.0, None), (10, 2.0, 4.0, 0.0)]
    d = spark.createDataFrame(rows, "i bigint, lat double, lon double, r double")
    for height in (2.0, 7.0):
        cells = d.select("i", F.explode(geo.cap_cells(F.col("lat"), F.col("lon"), F.col("r"), height)).alias("c")).select("i", crossmatch._place(F.col("c.zone"), F.col("c.cell")).alias("at"))
        made = crossmatch._unfold(d, "lat", "lon", F.col("r"), height).select("i", "_zcell")
        assert sorted(map(tuple, made.collect())) == sorted(map(tuple, cells.collect()))


def _pair(spark):
    rng = np.random.default_rng(3)
    y, x = np.mgrid[0:24, 0:24]
    star = sum(90.0 * np.exp(-((x - a) ** 2 + (y - b) ** 2) / 4.0) for a, b in ((6, 7), (17, 12)))
    a, b = star + rng.normal(0, 1, x.shape), star + rng.normal(0, 1, x.shape)
    pdf = pd.DataFrame({"stack_id": 1, "x": x.ravel(), "y": y.ravel(), "a": a.ravel(), "b": b.ravel()})
    return pdf, spark.createDataFrame(pdf, "stack_id bigint, x bigint, y bigint, a double, b double")


def test_apertures_are_not_broadcast(spark):
    pdf, pair = _pair(spark)
    places = spark.createDataFrame([(1, 0, 6.0, 7.0), (1, 1, 22.6, 1.0)], "stack_id bigint, source_id bigint, x double, y double")
    sums = audit.aperture_sums(pair, places, 3)
    assert not any("Broadcast" in n.nodeName() for n in _nodes(sums._jdf.queryExecution().executedPlan()))
    for r in sums.collect():
        cx, cy = ((6, 7), (23, 1))[r.source_id]
        near = pdf[(abs(pdf.x - cx) <= 3) & (abs(pdf.y - cy) <= 3)]
        assert abs(r.fa - near.a.sum()) < 1e-9 and abs(r.fb - near.b.sum()) < 1e-9


def test_a_compared_pair_is_made_once(spark):
    pdf, pair = _pair(spark)
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(len(b))
            yield b

    frames = spark.createDataFrame([(1, 1, 24, 24)], "stack_id bigint, frame_id bigint, width int, height int")
    size = audit.image_size(frames)
    got = audit.compare_report(pair.mapInPandas(count, pair.schema), audit.lattice(size, 9, [100.0], margin=6), size).collect()
    assert len(got) == 1 and got[0].n_apertures == 9 and got[0].n_sources_a == 2
    assert abs(got[0].flux_ratio - pdf.a.sum() / pdf.b.sum()) < 1e-9
    assert made.value <= 2 * len(pdf)  # a checkpoint may look twice
