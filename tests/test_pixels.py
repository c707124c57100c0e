"""Physics and tiling of the pixel operators on a small seeded star field."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumenfield.operators import audit, background, cosmic, detect, drizzle, fourier, kernels, pixels as px, stack

SIZE, N = 48, 8


def _gauss(fwhm, r=12):
    y, x = np.mgrid[-r : r + 1, -r : r + 1]
    s = fwhm / 2.3548200450309493
    k = np.exp(-0.5 * (x**2 + y**2) / s**2)
    return k / k.sum()


def star_field(fwhm, sigma, stars=True, seed=101):
    """(N, SIZE, SIZE) frames of the same sky, one width and noise per frame."""
    rng = np.random.default_rng(seed)
    pos = [(12, 12, 3000.0), (33, 14, 6000.0), (15, 34, 9000.0), (36, 36, 1500.0)]
    out = []
    for f, s in zip(fwhm, sigma, strict=True):
        img = np.zeros((SIZE, SIZE))
        if stars:
            k = _gauss(f)
            for x, y, flux in pos:
                img[y - 12 : y + 13, x - 12 : x + 13] += flux * k[: min(25, SIZE - y + 12), : min(25, SIZE - x + 12)]
        out.append(img + rng.normal(0, s, img.shape))
    return np.array(out), pos


def tables(spark, cube, fwhm, sigma):
    f, y, x = np.indices(cube.shape)
    pdf = pd.DataFrame({"stack_id": 0, "frame_id": f.ravel(), "x": x.ravel(), "y": y.ravel(), "value": cube.ravel()})
    p = spark.createDataFrame(pdf).withColumns({"is_masked": F.lit(False), "is_saturated": F.lit(False)})
    fr = spark.createDataFrame(
        [(0, i, SIZE, SIZE, float(s), 1.0, 30.0, float(w), False, 1.0, 3.0) for i, (w, s) in enumerate(zip(fwhm, sigma, strict=True))],
        "stack_id long, frame_id long, width long, height long, noise_sigma double, transparency double, exposure_seconds double,"
        " fwhm_px double, photometrically_unreliable boolean, gain_e_per_adu double, read_noise_e double",
    ).withColumn("psf_eccentricity", F.lit(0.0))
    p = p.join(F.broadcast(fr.select("frame_id", (F.col("noise_sigma") ** 2).alias("variance"))), "frame_id")
    return p, fr


def image(df, col="image"):
    d = df.toPandas()
    a = np.zeros((SIZE, SIZE))
    a[d.y.astype(int), d.x.astype(int)] = d[col]
    return a


def test_noise_falls_with_root_n_and_sigma_is_honest(spark):
    cube, _ = star_field([3.0] * N, [10.0] * N, stars=False)
    p, f = tables(spark, cube, [3.0] * N, [10.0] * N)
    w = p.join(px.frame_weights(f).select("stack_id", "frame_id", "weight"), ["stack_id", "frame_id"])
    d = stack.combine(w, f, "mean").cache()
    assert abs(image(d).std() / (10 / np.sqrt(N)) - 1) < 0.08
    assert abs(image(d, "sigma").mean() / image(d).std() - 1) < 0.08


def test_clip_removes_a_hit_and_keeps_star_flux(spark):
    fw = [2.5] * 4 + [4.0] * 4
    cube, pos = star_field(fw, [5.0] * N)
    clean = cube.mean(axis=0)[10:15, 10:15].sum()
    cube[3, 24, 24] += 2000.0
    p, f = tables(spark, cube, fw, [5.0] * N)
    w = p.withColumn("weight", F.lit(1.0 / N))
    img = image(stack.combine(w, f, "sigma-clip"))
    assert abs(img[24, 24]) < 15 and abs(img[10:15, 10:15].sum() / clean - 1) < 0.06
    cols = stack.pixel_columns(p, f).cache()
    core = "keep and x between 10 and 14 and y between 10 and 14"
    kept = [stack.samples(stack.sigma_clip(cols, structure_factor=k)).where(core).count() for k in (0.0, 1.2)]
    assert kept[1] > kept[0]


def test_optimal_coadd_gain(spark):
    for fw, sg, low, high in (([3.0] * N, [8.0] * N, 0.93, 1.07), ([2.0] * 4 + [6.0] * 4, [8.0] * N, 1.06, 3.0)):
        cube, pos = star_field(fw, sg)
        p, f = tables(spark, cube, fw, sg)
        ker = kernels.gaussian(f, 12)
        opt = fourier.optimal_coadd(p, f, ker)
        wts = px.frame_weights(f)
        mean = stack.combine(p.join(wts.select("stack_id", "frame_id", "weight"), ["stack_id", "frame_id"]), f, "mean")
        where = spark.createDataFrame([(0, i, float(x), float(y)) for i, (x, y, _) in enumerate(pos)], "stack_id long, source_id long, x double, y double")
        base = kernels.matched_filter(mean, where, stack.mean_psf(ker, wts), ["stack_id"], ["source_id"]).toPandas().set_index("source_id").snr
        score = image(opt, "score")
        gain = np.median([score[y, x] / base[i] for i, (x, y, _) in enumerate(pos)])
        assert low < gain < high
        assert abs(image(opt).sum() / cube.mean(axis=0).sum() - 1) < 0.05


def test_injection_is_linear_and_empty_field_stays_empty(spark):
    fw, sg = [3.0] * N, [4.0] * N
    cube, _ = star_field(fw, sg, stars=False, seed=9)
    p, f = tables(spark, cube, fw, sg)
    wts = px.frame_weights(f)
    ker = kernels.gaussian(f, 8)
    w = p.join(wts.select("stack_id", "frame_id", "weight"), ["stack_id", "frame_id"])
    src = audit.lattice(audit.image_size(f), 9, [200.0, 800.0, 3200.0], margin=12)
    before = stack.combine(w, f, "mean")
    delta = audit.difference(stack.combine(audit.inject(w, src, ker), f, "mean"), before)
    rep = audit.injection_recovery(delta, src, stack.mean_psf(ker, wts))[1].collect()[0]
    assert rep.is_linear and abs(rep.slope - 1) < 0.02 and list(rep.notes) == []
    fp = audit.false_positives(before, stack.mean_psf(ker, wts), audit.image_size(f), 5.0, 8).collect()[0]
    assert fp.n_detections == 0


def test_detection_finds_the_stars_with_any_tiling(spark):
    fw, sg = [3.0] * 2, [3.0] * 2
    cube, pos = star_field(fw, sg, seed=4)
    cube = cube[:2]
    p, f = tables(spark, cube, fw, sg)
    results = []
    for tile in (7, 16, 256):
        d = detect.detect_sources(p, 8.0, 4, tile).toPandas().sort_values(["frame_id", "y", "x"]).reset_index(drop=True)
        results.append(d[["frame_id", "x", "y", "flux", "npix", "a", "b"]])
        for i in range(2):
            one = d[d.frame_id == i]
            assert all(np.hypot(one.x - x, one.y - y).min() < 0.5 for x, y, _ in pos)
    pd.testing.assert_frame_equal(results[0], results[1])
    pd.testing.assert_frame_equal(results[0], results[2])


def test_trails_are_long_thin_groups(spark):
    line = [(0, 1, i, i // 3 + 5) for i in range(40)]
    blob = [(0, 1, x, y) for x in range(30, 35) for y in range(30, 35)]
    df = spark.createDataFrame(line + blob, "stack_id long, frame_id long, x long, y long")
    got = {(r.x, r.y) for r in detect.trail_pixels(df, tile=11).collect()}
    assert {(x, y) for *_, x, y in line} <= got and (32, 32) not in got and (0, 7) in got


def test_cosmic_rays_do_not_depend_on_tiles(spark):
    cube, _ = star_field([3.0], [4.0], seed=2)
    rng = np.random.default_rng(8)
    hits = [(int(a), int(b)) for a, b in rng.integers(3, SIZE - 3, (12, 2))]
    for x, y in hits:
        cube[0, y, x] += 900.0
    p, f = tables(spark, cube + 100.0, [3.0], [4.0])
    whole = cosmic.flag(cube[0] + 100.0, 1.0, 3.0, 4.5, 0.3, 5.0, 4)
    for tile in (9, 20, 512):
        got = {(r.x, r.y) for r in cosmic.cosmic_rays(p, f, tile=tile).collect()}
        assert got == {(int(x), int(y)) for y, x in zip(*np.nonzero(whole), strict=True)}
    assert sum(whole[y, x] for x, y in hits) >= 11


def test_background_removes_a_gradient(spark):
    y, x = np.mgrid[0:SIZE, 0:SIZE]
    cube = np.array([100 + 0.8 * x + 0.3 * y + np.random.default_rng(1).normal(0, 1, x.shape)])
    p, f = tables(spark, cube, [3.0], [1.0])
    d = background.subtract(p, SIZE, SIZE, box=8)
    left = image(d, "value")[16:-16, 16:-16]
    assert abs(left.mean()) < 0.2 and left.std() < 1.3
    g = background.background_report(d).collect()[0]
    assert 25 < g.gradient < 55
    kept = image(background.subtract(p, SIZE, SIZE, box=8, keep_pedestal=True), "value")
    assert abs(np.median(kept) - np.median(cube)) < 2.0


def _spline_by_definition(grid, u, v):
    """Cubic B-spline through a grid mirrored at its cell edges: a periodic one over the grid and its mirror image."""
    both = np.block([[grid, grid[:, ::-1]], [grid[::-1], grid[::-1, ::-1]]])
    for axis in (0, 1):
        n = both.shape[axis]
        kernel = np.zeros(n)
        for k, w in ((0, 4 / 6), (1, 1 / 6), (-1, 1 / 6)):
            kernel[k % n] += w
        shape = [-1 if i == axis else 1 for i in (0, 1)]
        both = np.fft.ifft(np.fft.fft(both, axis=axis) / np.fft.fft(kernel).reshape(shape), axis=axis).real
    out = 0.0
    for j in range(-2, 4):
        for i in range(-2, 4):
            ky, kx = int(np.floor(v)) + j, int(np.floor(u)) + i
            bump = [(2 / 3 - t * t + t**3 / 2) if t < 1 else max(0.0, 2 - t) ** 3 / 6 for t in (abs(v - ky), abs(u - kx))]
            out += bump[0] * bump[1] * both[ky % both.shape[0], kx % both.shape[1]]
    return out


@pytest.mark.parametrize("shape", [(1, 1), (1, 4), (2, 3), (6, 9)])
def test_background_spline(spark, shape):
    """Values between the cells, on the edges and at the centres, for meshes of one cell and more."""
    grid = np.random.default_rng(3).normal(100, 5, shape)
    m = spark.createDataFrame([(1, 1, x, y, float(grid[y, x]), 2.0) for y, x in np.ndindex(*shape)], "stack_id long, frame_id long, cx long, cy long, level double, rms double")
    rng = np.random.default_rng(4)
    at = [(int(x), int(y)) for x, y in zip(rng.integers(0, 9 * shape[1], 60), rng.integers(0, 9 * shape[0], 60), strict=True)]
    p = spark.createDataFrame([(1, 1, x, y) for x, y in {*at, (0, 0), (9 * shape[1] - 1, 9 * shape[0] - 1)}], "stack_id long, frame_id long, x long, y long")
    for r in background.with_background(p, m, 9).collect():
        want = _spline_by_definition(grid, (r.x + 0.5) / 9 - 0.5, (r.y + 0.5) / 9 - 0.5)
        assert abs(r.background - np.clip(want, grid.min(), grid.max())) < 1e-9 and abs(r.background_rms - 2.0) < 1e-9


def test_background_of_masked_cells_and_sizes(spark):
    """A cell without good pixels takes its level from others, an image without any has no sky, sizes may differ."""
    rows = []
    for frame, (w, h) in {1: (40, 24), 2: (23, 50), 3: (30, 30)}.items():
        for y, x in np.ndindex(h, w):
            rows.append((1, frame, x, y, 50.0 + frame, frame == 3 or (frame == 1 and x < 8 and y < 8), False))
    p = spark.createDataFrame(rows, "stack_id long, frame_id long, x long, y long, value double, is_masked boolean, is_saturated boolean")
    d = background.subtract(p).groupBy("frame_id").agg(F.count("*").alias("n"), F.min("background").alias("lo"), F.max("background").alias("hi"), F.max("background_rms").alias("rms"))
    got = {r.frame_id: (r.n, r.lo, r.hi, r.rms) for r in d.collect()}
    for frame, n in ((1, 960), (2, 1150)):
        assert got[frame][0] == n and np.allclose(got[frame][1:], (50 + frame, 50 + frame, 1e-6))
    assert got[3] == (900, None, None, None)
    holes = spark.createDataFrame([(1, 1, x, 0, float(x), 1.0) for x in (0, 1, 4)], "stack_id long, frame_id long, cx long, cy long, level double, rms double")
    filled = background.fill_mesh(holes, spark.createDataFrame([(1, 1, 5, 1)], "stack_id long, frame_id long, nx long, ny long"))
    levels = [r.level for r in filled.orderBy("cx").collect()]
    assert np.allclose(levels, [0, 1, (0 / 2 + 1 / 1 + 4 / 2) / 2, (0 / 3 + 1 / 2 + 4 / 1) / (1 / 3 + 1 / 2 + 1), 4])


def test_drizzle_conserves_flux_on_its_own_grid(spark):
    cube, _ = star_field([3.0] * 2, [0.0] * 2)
    p, f = tables(spark, cube[:2], [3.0] * 2, [1.0] * 2)
    f = f.withColumns({"crval_ra": F.lit(10.0), "crval_dec": F.lit(20.0), "crpix_x": 24.5 + F.col("frame_id") * 0.37, "crpix_y": F.lit(24.5),
                       "scale_arcsec": F.lit(1.5), "rotation_deg": F.lit(0.0), "is_solved": F.lit(True)})
    g = drizzle.output_grids(f)
    over = g.collect()[0].oversample
    d = drizzle.finish(drizzle.drizzle(p, f, g, pixfrac=1.0)).toPandas()
    # drizzle spreads each pixel's flux, interpolation samples a surface
    assert abs(d.image.sum() / cube[0].sum() - 1) < 0.01
    r = drizzle.reproject(p, f, g).where("frame_id = 0").toPandas()
    assert abs(r.value.sum() / over**2 / cube[0].sum() - 1) < 0.05


def test_checksums_do_not_depend_on_order(spark, cat):
    from lumenfield.operators.digest import pixel_checksums

    a = sorted(pixel_checksums(cat.pixels).collect())
    b = sorted(pixel_checksums(cat.pixels.orderBy(F.desc("value")).repartition(5)).collect())
    assert a == b


def test_unknown_methods_are_refused(spark, cat):
    for bad in (lambda: stack.combine(cat.pixels, cat.frames, "best"), lambda: px.frame_weights(cat.frames, "best"),
                lambda: drizzle.drizzle(cat.pixels, cat.frames, cat.frames, pixfrac=0.0)):
        with pytest.raises(ValueError):
            bad()
