"""Tiles with margins, and clipping on them, against whole images in NumPy."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumenfield.operators import clip, fourier, kernels, stack, tiles


def stack_of(seed, frames, width, height, hit=40):
    """A smooth scene with noise, outliers, a streak and holes: (rows, cube, sigma, good)."""
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[:height, :width]
    scene = 100 + 60 * np.exp(-((x - width / 3) ** 2 + (y - height / 2) ** 2) / 18)
    cube = scene + rng.normal(0, 3, (frames, height, width))
    for _ in range(hit):
        cube[rng.integers(frames), rng.integers(height), rng.integers(width)] += rng.choice([-80, 60, 200])
    f = frames // 2
    line = np.abs(2 * y - x - 4) <= 1
    cube[f][line] += 90
    good = rng.random(cube.shape) > 0.05
    sigma = np.full(cube.shape, 3.0)
    at = np.nonzero(rng.random(cube.shape) > 0.03)  # some samples are not there at all
    there = np.zeros(cube.shape, bool)
    there[at] = True
    pdf = pd.DataFrame({"stack_id": 7, "frame_id": at[0] + 1, "x": at[2], "y": at[1], "value": cube[at], "variance": sigma[at] ** 2, "is_masked": ~good[at], "is_saturated": False})
    return pdf, np.where(there, cube, np.nan), sigma, good & there


def frames_of(spark, n, width, height):
    pdf = pd.DataFrame({"stack_id": 7, "frame_id": range(1, n + 1), "width": width, "height": height, "noise_sigma": 3.0, "transparency": 1.0, "photometrically_unreliable": False, "fwhm_px": 2.0, "psf_eccentricity": 0.0})
    return spark.createDataFrame(pdf.astype({"stack_id": "int64", "frame_id": "int64", "width": "int64", "height": "int64"}))


def whole_clip(cube, sigma, keep, rounds=3, low=5.0, high=3.0, factor=1.2):
    """The rule on whole images, pixel by pixel medians, edges closed."""
    n = len(cube)
    wide = np.sqrt(1 + np.pi / (2 * n))
    for _ in range(rounds):
        centre = np.zeros(cube.shape[1:])
        for i, j in np.ndindex(*centre.shape):
            v = cube[keep[:, i, j], i, j]
            centre[i, j] = np.median(v) if len(v) else 0.0
        step = np.max([np.abs(centre - np.roll(centre, s, a)) for a in (0, 1) for s in (1, -1)], axis=0) * factor
        r = cube - centre
        trial = keep & (r <= high * sigma * wide + step) & (r >= -(low * sigma * wide + step))
        keep = np.where(trial.sum(axis=0) < 2, keep, trial)
    return keep


def test_tiles_cover_every_place_once(spark):
    """Cores partition the image; a margin holds exactly the neighbours, also across closed edges."""
    w, h, m = 50, 37, 3
    df = spark.range(w * h).select((F.col("id") % w).alias("x"), F.floor(F.col("id") / w).cast("bigint").alias("y"), F.lit(w).alias("width"), F.lit(h).alias("height"))
    for wrap in (True, False):
        got = tiles.deal(df, m, 8, wrap).toPandas()
        core = got[(got.px >= 0) & (got.px < got.cx) & (got.py >= 0) & (got.py < got.cy)]
        assert len(core) == w * h and not core.duplicated(["x", "y"]).any() and core.cx.min() >= 8
        assert not got.duplicated(["tx", "ty", "px", "py"]).any()
        for (_, _), t in got.groupby(["tx", "ty"]):
            c = t[(t.px >= 0) & (t.px < t.cx) & (t.py >= 0) & (t.py < t.cy)]
            x0, y0, cx, cy = c.x.min(), c.y.min(), int(t.cx.iloc[0]), int(t.cy.iloc[0])
            places = {(p, q): (x, y) for p, q, x, y in zip(t.px, t.py, t.x, t.y, strict=True)}
            for q in range(-m, cy + m):
                for p in range(-m, cx + m):
                    x, y = x0 + p, y0 + q
                    inside = 0 <= x < w and 0 <= y < h
                    want = (x % w, y % h) if wrap or inside else None
                    assert places.get((p, q)) == want


@pytest.mark.parametrize("size", [(24, 24, 7), (61, 45, 5), (40, 70, 12)])
def test_clipping_on_tiles_is_clipping_of_the_image(spark, size):
    width, height, n = size
    pdf, cube, sigma, good = stack_of(3, n, width, height)
    frames = frames_of(spark, n, width, height)
    rows = stack._variance_samples(spark.createDataFrame(pdf), frames)
    got = {(r.frame_id - 1, r.y, r.x): r.above for r in clip.clipped(rows, samples_per_tile=n * 22 * 22).collect()}
    keep = whole_clip(cube, sigma, good)
    want = {tuple(int(v) for v in p) for p in np.argwhere(good & ~keep)}
    assert want and set(got) == want
    for p, above in got.items():
        assert above == (cube[p] > np.nanmedian(cube[:, p[1], p[2]]))


def test_mad_rounds_match_the_image(spark):
    """Without variances the scale comes from the samples, and rounds that take nothing change nothing."""
    pdf, cube, _, good = stack_of(5, 9, 30, 28)
    cols = stack.pixel_columns(spark.createDataFrame(pdf), frames_of(spark, 9, 30, 28))
    got = stack.samples(stack.sigma_clip(cols, use_variance=False, iterations=2)).where("good and not keep").collect()
    keep = good.copy()
    for _ in range(2):
        v = np.where(keep, cube, np.nan)
        centre = np.nanmedian(v, axis=0)
        scale = 1.4826 * 1.107 * np.nanmedian(np.abs(v - centre), axis=0)
        keep = whole_clip(cube, np.broadcast_to(scale, cube.shape), keep, rounds=1)
    assert {(r.frame_id - 1, r.y, r.x) for r in got} == {tuple(int(a) for a in p) for p in np.argwhere(good & ~keep)}


def test_default_coadds_leave_a_streak_out(spark):
    """The faint ends of a trail are below the clip; grown from the found part, the trail leaves both coadds."""
    pdf, _, _, _ = stack_of(8, 8, 60, 40, hit=0)
    df, frames = spark.createDataFrame(pdf), frames_of(spark, 8, 60, 40)
    marks = stack.rejections(df, frames).toPandas()
    line = lambda d: (2 * d.y - d.x - 4).abs() <= 1
    assert marks[marks.trail].frame_id.eq(5).all() and line(marks[marks.trail]).sum() >= 40
    ones = df.withColumn("weight", F.lit(1.0))
    clean = stack.combine(ones, frames).toPandas().set_index(["x", "y"]).image
    left = stack.combine(ones, frames, "mean").toPandas().set_index(["x", "y"]).image
    on = [(x, y) for x, y in clean.index if abs(2 * y - x - 4) <= 1 and not (12 <= x <= 28 and 12 <= y <= 28)]
    assert np.median(left[on]) - np.median(clean[on]) > 8 and abs(np.median(clean[on]) - 100) < 1
    k = kernels.gaussian(frames)
    one = fourier.optimal_coadd(df, frames, k).toPandas().set_index(["x", "y"]).image
    two = fourier.optimal_coadd(df, frames, k, reject=False).toPandas().set_index(["x", "y"]).image
    assert np.median(two[on]) - np.median(one[on]) > 5


def test_rejection_of_odd_stacks(spark):
    """Nulls, NaN and empty tables: what is not usable is never clipped, two frames have no trails, no rows give none."""
    rows = [(1, f, x, 0, v, 1.0, False, False) for f, vs in ((1, [1.0, None, float("nan")]), (2, [1.0, 2.0, 500.0])) for x, v in enumerate(vs)]
    names = "stack_id long, frame_id long, x long, y long, value double, variance double, is_masked boolean, is_saturated boolean"
    df = spark.createDataFrame(rows, names)
    frames = spark.createDataFrame([(1, 1, 3, 1), (1, 2, 3, 1)], "stack_id long, frame_id long, width long, height long")
    d = {(r.frame_id, r.x): r for r in stack.combined_rejection(df, frames).collect()}
    assert len(d) == 6 and not any(r.clipped or r.trail for r in d.values())
    assert not d[1, 1].good and not d[1, 2].good and d[2, 2].good
    assert stack.combined_rejection(df.limit(0), frames).count() == 0
    assert stack.combine(df.limit(0), frames).count() == 0


def test_drops_of_a_batch_send_few_rows(spark):
    """The sums of all sub-drops, point by point in Python, from at most five rows a pixel."""
    from lumenfield.operators import drizzle

    rng = np.random.default_rng(1)
    n = 400
    at = np.arange(n)
    cols = {
        "stack_id": np.full(n, 3), "out_width": np.full(n, 31), "out_height": np.full(n, 33), "xo": 1.5 * (at % 20) + rng.random(n), "yo": 1.5 * (at // 20) + rng.random(n),
        "dxdx": np.full(n, 1.48), "dxdy": np.full(n, 0.1), "dydx": np.full(n, -0.1), "dydy": np.full(n, 1.48), "area": np.full(n, 2.2), "value": rng.normal(size=n), "variance": rng.random(n) + 0.5, "fw": rng.random(n),
    }
    df = spark.createDataFrame(pd.DataFrame(cols)).coalesce(1)
    parts = df.mapInArrow(drizzle._footprints(0.7, 5), drizzle.TOUCHED)
    assert parts.count() <= 5 * n
    want = {}
    side = [((i + 0.5) / 5 - 0.5) * 0.7 for i in range(5)]
    for k in range(n):
        r = {c: v[k] for c, v in cols.items()}
        for u in side:
            for v in side:
                p = (round(r["xo"] + r["dxdx"] * u + r["dxdy"] * v), round(r["yo"] + r["dydx"] * u + r["dydy"] * v))
                if 0 <= p[0] < 31 and 0 <= p[1] < 33:
                    s = want.setdefault(p, [0.0, 0.0, 0.0, 0])
                    f = r["fw"] / 25
                    for i, x in enumerate((f * r["value"] / r["area"], f, f * f * r["variance"] / r["area"] ** 2, 1)):
                        s[i] += x
    got = {(r.ox, r.oy): (r.num, r.weight, r.var_num, r.context) for r in parts.groupBy("ox", "oy").agg(*[F.sum(c).alias(c) for c in ("num", "weight", "var_num", "context")]).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[p], want[p]) for p in want)
    assert df.limit(0).mapInArrow(drizzle._footprints(0.7, 5), drizzle.TOUCHED).count() == 0


@pytest.mark.parametrize("flip", [False, True])
def test_convolution_on_tiles_is_the_sum_over_offsets(spark, flip):
    """Two images of different sizes, places and kernels, with holes, on tiles that are smaller than they are."""
    rng = np.random.default_rng(4)
    rows, stamps, want = [], [], {}
    for key, (w, h, r, x0, y0) in {1: (45, 33, 3, 0, 0), 2: (12, 60, 5, 100, -7)}.items():
        image = rng.normal(size=(h, w)) * 100
        there = rng.random((h, w)) > 0.1
        kernel = rng.random((2 * r + 1, 2 * r + 1))
        rows += [(key, int(x0 + x), int(y0 + y), float(image[y, x])) for y, x in np.argwhere(there)]
        stamps += [(key, dx, dy, float(kernel[dy + r, dx + r])) for dx in range(-r, r + 1) for dy in range(-r, r + 1)]
        image = np.pad(np.where(there, image, 0.0), r)
        for y, x in np.argwhere(there):
            part = image[y : y + 2 * r + 1, x : x + 2 * r + 1]
            want[key, x0 + x, y0 + y] = (part * (kernel if flip else kernel[::-1, ::-1])).sum()
    df = spark.createDataFrame(rows, "stack_id long, x long, y long, image double")
    ker = spark.createDataFrame(stamps, "stack_id long, dx int, dy int, w double")
    got = {(r.stack_id, r.x, r.y): r.filtered for r in kernels.convolve(df, ker, ["stack_id"], flip=flip, tile=10).collect()}
    assert got.keys() == want.keys()
    assert max(abs(got[p] - want[p]) for p in want) < 1e-9
    bad = kernels.convolve(df.withColumn("image", F.when(F.expr("stack_id = 1 and x = 20 and y = 20"), float("nan")).otherwise(F.col("image"))), ker, ["stack_id"], flip=flip, tile=10)
    lost = {(r.x, r.y) for r in bad.where("isnan(filtered)").collect()}
    assert lost == {(x, y) for k, x, y in want if k == 1 and abs(x - 20) <= 3 and abs(y - 20) <= 3}
    assert kernels.convolve(df.limit(0), ker, ["stack_id"]).count() == kernels.convolve(df, ker.limit(0), ["stack_id"]).count() == 0
