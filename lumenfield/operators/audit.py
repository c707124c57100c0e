"""Image comparison, recovery audits and quality reports."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfield.functions import photometry as P
from lumenfield.operators import kernels as K
from lumenfield.operators.detect import detect_sources, local_maxima, with_shape
from lumenfield.operators.pixels import CELL, FRAME, robust_sigma
from lumenfield.operators.quantile import exact_quantiles
from lumenfield.operators.skew import spread
from lumenfield.session import reliable_checkpoint

STACK = ["stack_id"]


def image_size(frames: DataFrame) -> DataFrame:
    return frames.groupBy("stack_id").agg(F.max("width").alias("width"), F.max("height").alias("height"), F.count("*").alias("depth"))


def dense(image: DataFrame, size: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Every pixel of the image; missing values become zero."""
    keys = keys or STACK
    one = F.lit(1).cast("bigint")
    grid = size.withColumn("x", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("width") - one)))
    # columns are dealt out before they unfold, so one large image is laid out by many tasks
    grid = spread(grid, *keys, "x")
    grid = grid.withColumn("y", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("height") - one)))
    d = grid.select(*keys, "x", "y").join(image, [*keys, "x", "y"], "left")
    return d.fillna(0.0)


def psnr(pair: DataFrame) -> DataFrame:
    """Peak signal-to-noise of ``a`` against the reference ``b``."""
    g = pair.groupBy("stack_id").agg(
        F.avg(F.pow(F.col("a") - F.col("b"), F.lit(2.0))).alias("mse"), (F.max("b") - F.min("b")).alias("range")
    )
    span = F.when(F.col("range") == 0, 1.0).otherwise(F.col("range"))
    return g.select("stack_id", F.when(F.col("mse") > 0, 10.0 * F.log10(span * span / F.col("mse"))).alias("psnr_db"))


def rolling_sums(image: DataFrame, columns: dict[str, Column], radius: int) -> DataFrame:
    """Square window sums, first along rows and then along columns; one partition is one line."""
    wx = Window.partitionBy("stack_id", "y").orderBy("x").rangeBetween(-radius, radius)
    wy = Window.partitionBy("stack_id", "x").orderBy("y").rangeBetween(-radius, radius)
    d = image.select(*CELL, *[v.alias(k) for k, v in columns.items()])
    d = d.select(*CELL, *[F.sum(k).over(wx).alias(k) for k in columns])
    return d.select(*CELL, *[F.sum(k).over(wy).alias(k) for k in columns])


def ssim(pair: DataFrame, size: DataFrame, window: int = 7, k1: float = 0.01, k2: float = 0.03) -> DataFrame:
    """Mean structural similarity with a uniform window, borders left out."""
    r, n = window // 2, window * window
    d = dense(pair, size)
    a, b = F.col("a"), F.col("b")
    w = rolling_sums(d, {"sa": a, "sb": b, "saa": a * a, "sbb": b * b, "sab": a * b}, r)
    span = d.groupBy("stack_id").agg((F.max("b") - F.min("b")).alias("range"))
    w = w.join(span, "stack_id").join(size, "stack_id")
    w = w.where(F.col("x").between(r, F.col("width") - 1 - r) & F.col("y").between(r, F.col("height") - 1 - r))
    L = F.when(F.col("range") == 0, 1.0).otherwise(F.col("range"))
    c1, c2 = F.pow(k1 * L, F.lit(2.0)), F.pow(k2 * L, F.lit(2.0))
    ma, mb = F.col("sa") / n, F.col("sb") / n
    f = n / (n - 1.0)
    va, vb, cab = f * (F.col("saa") / n - ma * ma), f * (F.col("sbb") / n - mb * mb), f * (F.col("sab") / n - ma * mb)
    top = (2 * ma * mb + c1) * (2 * cab + c2)
    bottom = F.greatest((ma * ma + mb * mb + c1) * (va + vb + c2), F.lit(1e-30))
    return w.groupBy("stack_id").agg(F.avg(top / bottom).alias("ssim"))


def flux_ratio(pair: DataFrame) -> DataFrame:
    """Total flux of ``a`` over ``b``."""
    g = pair.groupBy("stack_id").agg(F.sum("a").alias("_a"), F.sum("b").alias("_b"))
    return g.select("stack_id", F.when(F.abs("_b") > 1e-30, F.col("_a") / F.col("_b")).alias("flux_ratio"))


def aperture_sums(pair: DataFrame, positions: DataFrame, radius: int) -> DataFrame:
    """Sums of ``a`` and ``b`` in square apertures, clipped at the image edge.

    Positions unfold into the pixels of their apertures, of which the planner knows nothing, so that they must never be
    broadcast.
    """
    side = F.sequence(F.lit(-radius), F.lit(radius))
    p = positions.select("stack_id", "source_id", F.rint("x").cast("bigint").alias("_ix"), F.rint("y").cast("bigint").alias("_iy"))
    p = p.withColumn("_i", F.explode(side)).withColumn("_j", F.explode(side))
    p = p.select("stack_id", "source_id", (F.col("_ix") + F.col("_i")).alias("x"), (F.col("_iy") + F.col("_j")).alias("y"))
    d = p.hint("merge").join(pair, CELL)
    return d.groupBy("stack_id", "source_id").agg(F.sum("a").alias("fa"), F.sum("b").alias("fb"))


def flux_consistency(pair: DataFrame, positions: DataFrame, radius: int = 5) -> DataFrame:
    """Total ratio, and median and scatter of the per-aperture ratios."""
    s = aperture_sums(pair, positions, radius).where(F.abs("fb") > 1e-30).withColumn("ratio", F.col("fa") / F.col("fb"))
    g = s.groupBy("stack_id").agg(F.stddev_pop("ratio").alias("scatter"), F.count("*").alias("n_apertures"))
    med = exact_quantiles(s, STACK, "ratio", {"median_ratio": 0.5})
    return flux_ratio(pair).join(med, "stack_id", "left").join(g, "stack_id", "left")


def image_quality(pair: DataFrame, size: DataFrame, threshold: float = 8.0, min_area: int = 5) -> DataFrame:
    """Noise and median source width of both images: ``noise_a, noise_b, fwhm_a, fwhm_b`` and source counts.

    Widths of sources that are no stars (under half a pixel, over a quarter of the image) count only where there
    are no others.
    """
    sides = F.array(*[F.struct(F.lit(i).cast("bigint").alias("frame_id"), F.col(n).alias("value")) for i, n in enumerate("ab")])
    d = pair.select(*CELL, F.explode(sides).alias("e")).select("stack_id", "e.frame_id", "x", "y", "e.value", F.lit(False).alias("is_masked"), F.lit(False).alias("is_saturated"))
    d = reliable_checkpoint(d)
    noise = robust_sigma(d, FRAME)
    found = with_shape(detect_sources(d, threshold, min_area)).join(size, "stack_id")
    found = reliable_checkpoint(found.withColumn("_star", (F.col("fwhm") > 0.5) & (F.col("fwhm") < 0.25 * F.least("width", "height"))))
    wide = exact_quantiles(found, FRAME, "fwhm", {"_all": 0.5}).join(exact_quantiles(found.where("_star"), FRAME, "fwhm", {"_stars": 0.5}), FRAME, "left")
    n = found.groupBy(*FRAME).agg(F.count("*").alias("n"))
    facts = noise.join(wide, FRAME, "left").join(n, FRAME, "left").withColumn("fwhm", F.coalesce("_stars", "_all")).fillna(0, ["n"])
    take = lambda what, i: F.max(F.when(F.col("frame_id") == i, F.col(what)))
    names = {"noise": "sigma", "fwhm": "fwhm", "n_sources": "n"}
    return facts.groupBy("stack_id").agg(*[take(v, i).alias(f"{k}_{s}") for k, v in names.items() for i, s in enumerate("ab")])


def compare_report(pair: DataFrame, positions: DataFrame, size: DataFrame, radius: int = 3, threshold: float = 8.0) -> DataFrame:
    """Likeness, flux and, for each image, noise and source width.

    The pair is written out once: each measure would combine all frames again, and the driver would hold the plans, the
    broadcasts and the shuffle maps of all of them.
    """
    pair = reliable_checkpoint(pair)
    d = psnr(pair).join(ssim(pair, size), "stack_id").join(flux_consistency(pair, positions, radius), "stack_id")
    return d.join(image_quality(pair, size, threshold), "stack_id", "left")


def snr_gain(rows: DataFrame) -> DataFrame:
    """Gain in dB over the median source; ``coadd_snr`` against ``base_snr``."""
    d = rows.where("base_snr > 0").withColumn("_r", F.col("coadd_snr") / F.col("base_snr"))
    m = exact_quantiles(d, STACK, "_r", {"_m": 0.5})
    return m.select("stack_id", F.when(F.col("_m") > 0, 20.0 * F.log10("_m")).alias("snr_gain_db"))


def run_evaluation(
    coadd: DataFrame, coadd_psf: DataFrame, base: DataFrame, base_psf: DataFrame, positions: DataFrame, frames: DataFrame
) -> DataFrame:
    """Coadd against an honest baseline, each with its own kernel and its own measured noise."""

    def significance(image: DataFrame, psf: DataFrame, name: str) -> DataFrame:
        image = reliable_checkpoint(image)
        noise = robust_sigma(image.where("weight > 0"), STACK, "image")
        d = image.join(noise.withColumnRenamed("sigma", "_sig"), "stack_id")
        m = K.matched_filter(d, positions, psf, STACK, ["source_id"], "image", "_sig")
        return m.select("stack_id", "source_id", F.col("snr").alias(name))

    both = significance(coadd, coadd_psf, "coadd_snr").join(significance(base, base_psf, "base_snr"), ["stack_id", "source_id"])
    both = reliable_checkpoint(both)
    med = exact_quantiles(both, STACK, "coadd_snr", {"median_snr": 0.5}).join(
        exact_quantiles(both, STACK, "base_snr", {"base_median_snr": 0.5}), "stack_id"
    )
    width = frames.groupBy("stack_id").agg(
        F.min("fwhm_px").alias("fwhm_best"), F.median("fwhm_px").alias("fwhm_median"), F.max("fwhm_px").alias("fwhm_worst")
    )
    return med.join(snr_gain(both), "stack_id").join(width, "stack_id")


# --- injection -----------------------------------------------------------------------------------


def lattice(size: DataFrame, n_sources: int, fluxes: list[float], margin: int = 16) -> DataFrame:
    """Sources on whole pixels of a regular lattice inside the margin, fluxes in turn."""
    c = F.col
    cols = F.greatest(F.lit(1), F.ceil(F.sqrt(n_sources * c("width") / c("height")))).cast("int")
    d = size.withColumn("_cols", cols)
    d = d.withColumn("_rows", F.ceil(F.lit(n_sources) / c("_cols")).cast("int"))
    d = d.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n_sources - 1))))

    def line(i: Column, n: Column, length: Column) -> Column:
        step = F.when(n > 1, (length - 1.0 - 2.0 * margin) / F.greatest(n - 1, F.lit(1))).otherwise(0.0)
        return F.floor(margin + i * step + 0.5).cast("bigint")

    flux = F.get(F.array(*[F.lit(float(f)) for f in fluxes]), (c("k") % len(fluxes)).cast("int"))
    return d.select(
        "stack_id", c("k").cast("bigint").alias("source_id"),
        line(c("k") % c("_cols"), c("_cols"), c("width")).alias("x"),
        line(F.floor(c("k") / c("_cols")), c("_rows"), c("height")).alias("y"), flux.alias("flux"),
    )


def inject(pixels: DataFrame, sources: DataFrame, kernels: DataFrame) -> DataFrame:
    """Add every source to every frame of its stack with that frame's own kernel."""
    s = sources.join(kernels, "stack_id").select(
        *FRAME, (F.col("x") + F.col("dx")).alias("x"), (F.col("y") + F.col("dy")).alias("y"), (F.col("flux") * F.col("w")).alias("_add")
    )
    s = s.groupBy(*FRAME, "x", "y").agg(F.sum("_add").alias("_add"))
    d = pixels.join(s, [*FRAME, "x", "y"], "left")
    return d.withColumn("value", F.col("value") + F.coalesce("_add", F.lit(0.0))).drop("_add")


def difference(after: DataFrame, before: DataFrame) -> DataFrame:
    """Image after minus image before; a pixel missing on one side counts as zero there."""
    b = before.select(*CELL, F.col("image").alias("_b"))
    d = after.join(b, CELL, "full")
    delta = F.coalesce("image", F.lit(0.0)) - F.coalesce("_b", F.lit(0.0))
    return d.select(*CELL, delta.alias("image"), F.coalesce("sigma", F.lit(0.0)).alias("sigma"))


def injection_recovery(
    delta: DataFrame, sources: DataFrame, psf: DataFrame, threshold: float = 5.0
) -> tuple[DataFrame, DataFrame]:
    """(per-source recovery, per-stack report) from a difference image."""
    delta = reliable_checkpoint(delta)
    med = exact_quantiles(delta.where("sigma > 0"), STACK, "sigma", {"_med": 0.5})
    d = delta.join(med, "stack_id", "left")
    d = d.withColumn("sigma", F.when(F.col("sigma") > 0, F.col("sigma")).otherwise(F.coalesce("_med", F.lit(1.0))))
    m = K.matched_filter(d, sources, psf, STACK, ["source_id"])
    rows = sources.select("stack_id", "source_id", F.col("flux").alias("injected")).join(m, ["stack_id", "source_id"])
    rows = rows.select("stack_id", "source_id", "injected", F.col("flux").alias("recovered"), "snr", (F.col("snr") >= threshold).alias("detected"))
    rows = reliable_checkpoint(rows)
    fit = rows.groupBy("stack_id").agg(
        F.count("*").alias("n_sources"), F.regr_slope("recovered", "injected").alias("slope"),
        F.regr_intercept("recovered", "injected").alias("intercept"), F.regr_r2("recovered", "injected").alias("r_squared"),
        F.avg(F.col("detected").cast("double")).alias("detection_fraction"),
    )
    seen = rows.groupBy("stack_id", "injected").agg(F.avg(F.col("detected").cast("double")).alias("_f"))
    half = seen.groupBy("stack_id").agg(F.min(F.when(F.col("_f") >= 0.5, F.col("injected"))).alias("completeness_50"))
    typical = exact_quantiles(rows, STACK, "injected", {"_typ": 0.5})
    d = fit.join(half, "stack_id").join(typical, "stack_id")
    off = F.abs(F.col("slope") - 1.0)
    notes = F.array_compact(
        F.array(
            F.when(off > 0.15, F.when(F.col("slope") < 1, "loses_flux").otherwise("adds_flux")),
            F.when((F.col("intercept") > 0) & (F.col("intercept") / F.greatest("_typ", F.lit(1e-30)) > 0.1), "positive_intercept"),
        )
    )
    d = d.withColumns({"is_linear": (off < 0.15) & (F.col("r_squared") > 0.95), "notes": notes}).drop("_typ")
    return rows, d


#: room for the number of frames in the id of a virtual stack
VIRTUAL = 1 << 20


def first_frames(pixels: DataFrame, frames: DataFrame, shares=(0.125, 0.25, 0.5, 1.0)) -> tuple[DataFrame, DataFrame]:
    """Virtual stacks of the first n frames: ``stack_id * VIRTUAL + n`` for each distinct n."""
    depth = frames.groupBy("stack_id").agg(F.count("*").alias("_depth"))
    n = F.array_distinct(F.transform(F.array(*[F.lit(float(s)) for s in shares]), lambda s: F.greatest(F.lit(1.0), F.rint(F.col("_depth") * s)).cast("bigint")))
    w = Window.partitionBy("stack_id").orderBy("frame_id")
    f = frames.withColumn("_rank", F.row_number().over(w)).join(depth, "stack_id").withColumn("_n", F.explode(n))
    f = f.where(F.col("_rank") <= F.col("_n")).withColumn("_vid", F.col("stack_id") * VIRTUAL + F.col("_n"))
    vf = f.drop("stack_id", "_rank", "_depth", "_n").withColumnRenamed("_vid", "stack_id")
    vp = pixels.join(f.select("stack_id", "frame_id", "_vid"), FRAME).drop("stack_id").withColumnRenamed("_vid", "stack_id")
    return vp, vf


def depth_curve(snr: DataFrame) -> DataFrame:
    """Median significance per number of frames, next to the square-root law."""
    m = exact_quantiles(snr, STACK, "snr", {"median_snr": 0.5})
    n = F.col("stack_id") % VIRTUAL
    return m.select(F.floor(F.col("stack_id") / VIRTUAL).alias("stack_id"), n.alias("n_frames"), "median_snr", F.sqrt(n.cast("double")).alias("sqrt_n"))


def false_positives(image: DataFrame, psf: DataFrame, size: DataFrame, threshold: float, radius: int) -> DataFrame:
    """Matched-filter detections with the noise calibrated on the filtered image itself."""
    norm = psf.groupBy("stack_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("_l2"), F.sum("w").alias("_sum"))
    unit = psf.join(norm, "stack_id").select("stack_id", "dx", "dy", (F.col("w") / F.col("_l2")).alias("w"))
    f = reliable_checkpoint(K.convolve(image, unit, STACK, "image", flip=True))
    f = f.join(robust_sigma(f, STACK, "filtered"), "stack_id")
    f = f.withColumn("score", F.col("filtered") / F.greatest("sigma", F.lit(1e-12)))
    f = local_maxima(f, STACK, "score", 2).join(size, "stack_id")
    border = radius + 1
    inner = F.col("x").between(border, F.col("width") - 1 - border) & F.col("y").between(border, F.col("height") - 1 - border)
    g = f.groupBy("stack_id").agg(
        F.count_if(inner & F.col("is_peak") & (F.col("score") >= threshold)).alias("n_detections"),
        F.max(F.when(inner, F.col("score"))).alias("max_score"), F.max("sigma").alias("sigma"),
        ((F.max("width") - 2 * border) * (F.max("height") - 2 * border)).alias("_n"),
    )
    beam = F.greatest(F.col("_sum") * F.col("_sum") / (F.col("_l2") * F.col("_l2")), F.lit(1.0))
    return g.join(norm, "stack_id").select("stack_id", "n_detections", "max_score", "sigma", (F.col("_n") / beam).alias("n_beams"))


# --- training-style losses, uncertainty, tone -------------------------------------------------------


def patch_flux(pair: DataFrame, patch: int, size: DataFrame) -> DataFrame:
    """Global and patch-wise flux disagreement of ``a`` against ``b``; partial patches are left out."""
    eps = 1e-8
    d = dense(pair, size)
    tot = d.groupBy("stack_id").agg(F.sum("a").alias("_a"), F.sum("b").alias("_b"))
    d = d.join(size, "stack_id")
    px, py = F.floor(F.col("x") / patch), F.floor(F.col("y") / patch)
    full = (px < F.floor(F.col("width") / patch)) & (py < F.floor(F.col("height") / patch))
    p = d.where(full).groupBy("stack_id", px.alias("px"), py.alias("py")).agg(F.sum("a").alias("pa"), F.sum("b").alias("pb"))
    loc = p.groupBy("stack_id").agg(F.avg(F.abs(F.col("pa") - F.col("pb")) / (F.abs("pb") + eps)).alias("flux_local"))
    g = F.abs(F.col("_a") - F.col("_b")) / (F.abs("_b") + eps)
    return tot.select("stack_id", g.alias("flux_global")).join(loc, "stack_id")


def shape_moments(image: DataFrame, column: str) -> DataFrame:
    """Unweighted second moments as two ellipticities and a size."""
    v = F.greatest(F.col(column), F.lit(0.0))
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    g = image.groupBy("stack_id").agg(
        F.sum(v).alias("t"), F.sum(v * x).alias("sx"), F.sum(v * y).alias("sy"), F.sum(v * x * x).alias("sxx"),
        F.sum(v * y * y).alias("syy"), F.sum(v * x * y).alias("sxy"),
    )
    t = F.when(F.col("t") > 1e-12, F.col("t"))
    cx, cy = F.col("sx") / t, F.col("sy") / t
    qxx, qyy, qxy = F.col("sxx") / t - cx * cx, F.col("syy") / t - cy * cy, F.col("sxy") / t - cx * cy
    r2 = qxx + qyy
    zero = F.lit(0.0)
    return g.select(
        "stack_id", F.coalesce((qxx - qyy) / (r2 + 1e-12), zero).alias("e1"),
        F.coalesce(2.0 * qxy / (r2 + 1e-12), zero).alias("e2"), F.coalesce(r2, zero).alias("r2"),
    )


def forward_model(estimate: DataFrame, observed: DataFrame, kernels: DataFrame, frames: DataFrame) -> DataFrame:
    """Mean squared misfit, in units of sigma, of the estimate pushed through every frame's kernel."""
    est = estimate.select(*CELL, "image").join(frames.select(*FRAME), "stack_id")
    model = K.convolve(est, kernels, FRAME, "image")
    d = model.join(observed.select(*FRAME, "x", "y", "value"), [*FRAME, "x", "y"]).join(frames.select(*FRAME, "noise_sigma"), FRAME)
    z = (F.col("filtered") - F.col("value")) / F.greatest("noise_sigma", F.lit(1e-12))
    per = d.groupBy(*FRAME).agg(F.avg(z * z).alias("_c"))
    return per.groupBy("stack_id").agg(F.avg("_c").alias("chi2"))


def combined_loss(pair: DataFrame, size: DataFrame, chi2: DataFrame, patch: int = 16) -> DataFrame:
    """L1, flux, shape and forward-model terms with their weighted total."""
    l1 = pair.groupBy("stack_id").agg(F.avg(F.abs(F.col("a") - F.col("b"))).alias("l1"))
    ma = shape_moments(pair, "a").select("stack_id", F.col("e1").alias("a1"), F.col("e2").alias("a2"), F.col("r2").alias("ar"))
    mb = shape_moments(pair, "b")
    d = l1.join(patch_flux(pair, patch, size), "stack_id").join(ma, "stack_id").join(mb, "stack_id").join(chi2, "stack_id")
    ell = F.pow(F.col("a1") - F.col("e1"), F.lit(2.0)) + F.pow(F.col("a2") - F.col("e2"), F.lit(2.0))
    d = d.withColumns({"shape_ellipticity": ell, "shape_size": F.abs(F.col("ar") - F.col("r2")) / (F.abs("r2") + 1e-8)})
    tot = F.col("l1") + 0.5 * (F.col("flux_global") + F.col("flux_local")) + 0.5 * (F.col("shape_ellipticity") + F.col("shape_size")) + F.col("chi2")
    return d.select("stack_id", "l1", "flux_global", "flux_local", "shape_ellipticity", "shape_size", "chi2", tot.alias("total"))


def sample_uncertainty(samples: DataFrame, aleatoric: str | None = None) -> DataFrame:
    """Spread of posterior samples per pixel, combined with the declared noise."""
    al = F.max(aleatoric) if aleatoric else F.lit(0.0)
    g = samples.groupBy(*CELL).agg(F.stddev_pop("value").alias("epistemic"), al.alias("aleatoric"), F.count("*").alias("n_samples"))
    return g.withColumn("total_sigma", F.hypot("epistemic", "aleatoric"))


def uncertainty_summary(maps: DataFrame) -> DataFrame:
    return exact_quantiles(maps, STACK, "total_sigma", {"median_total_sigma": 0.5, "p95_total_sigma": 0.95})


def residual_gamma(
    pixels: DataFrame, frames: DataFrame, patch: int = 24, min_patches: int = 24, max_error: float = 0.3,
    bounds: tuple[float, float] = (0.5, 6.0),
) -> DataFrame:
    """Residual power law of a frame from patch mean against first-difference variance.

    The fit is accepted on the standard error of its slope; otherwise gamma is one and the reason
    says why.
    """
    c = F.col
    d = dense(pixels.select(*FRAME, "x", "y", "value"), frames.select(*FRAME, "width", "height"), FRAME)
    d = d.join(frames.select(*FRAME, "width", "height"), FRAME)
    d = d.withColumns({"px": F.floor(c("x") / patch), "py": F.floor(c("y") / patch)})
    d = d.where((c("px") < F.floor(c("width") / patch)) & (c("py") < F.floor(c("height") / patch)))
    w = Window.partitionBy(*FRAME, "px", "py", "y").orderBy("x")
    d = d.withColumn("_d", F.abs(c("value") - F.lag("value").over(w)))
    p = d.groupBy(*FRAME, "px", "py").agg(F.avg("value").alias("m"), F.median("_d").alias("_md"))
    p = p.withColumn("v", F.pow(P.MAD_TO_SIGMA * c("_md") / math.sqrt(2.0), F.lit(2.0)))
    keep = p.where((c("m") > 1e-4) & (c("m") < 0.85) & (c("v") > 1e-12))
    cut = exact_quantiles(keep, FRAME, "m", {"_cut": 0.9})
    k = keep.join(cut, FRAME)
    n = k.groupBy(*FRAME).agg(F.count("*").alias("_n"), F.count_if(c("m") <= c("_cut")).alias("_sel"))
    k = k.join(n, FRAME).where((c("m") <= c("_cut")) | (c("_sel") < min_patches))
    lx, ly = F.log("m"), F.log("v")
    fit = k.groupBy(*FRAME).agg(
        F.count("*").alias("used"), F.regr_slope(ly, lx).alias("slope"), F.regr_r2(ly, lx).alias("r_squared"),
        F.regr_sxx(ly, lx).alias("_sxx"), F.regr_syy(ly, lx).alias("_syy"), F.regr_sxy(ly, lx).alias("_sxy"),
        (F.max(lx) - F.min(lx)).alias("_span"),
    )
    d = frames.select(*FRAME).join(n, FRAME, "left").join(fit, FRAME, "left")
    sse = F.greatest(c("_syy") - c("_sxy") * c("_sxy") / F.nullif(c("_sxx"), F.lit(0.0)), F.lit(0.0))
    err = F.sqrt(sse / F.nullif(c("used") - 2, F.lit(0)) / F.nullif(c("_sxx"), F.lit(0.0)))
    d = d.withColumns({"slope_error": err, "_g": 2.0 - c("slope")})
    reason = (
        F.when(F.coalesce("_n", F.lit(0)) < min_patches, "too_few_patches")
        .when(c("_span") < 0.15, "too_flat")
        .when(~c("_g").between(*bounds), "out_of_bounds")
        .when(c("slope_error") > max_error, "poorly_constrained")
        .otherwise("ok")
    )
    d = d.withColumn("reason", reason)
    fitted = ~c("reason").isin("too_few_patches", "too_flat")
    return d.select(
        *FRAME, F.when(c("reason") == "ok", c("_g")).otherwise(1.0).alias("gamma"), "reason",
        F.when(fitted, c("slope")).otherwise(0.0).alias("slope"), F.when(fitted, c("slope_error")).alias("slope_error"),
    )


