"""Output grids, reprojection and drizzle on tangent-plane grids."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfield.functions import wcs
from lumenfield.functions import photometry as P
from lumenfield.operators.pixels import FRAME, robust_sigma
from lumenfield.operators.quantile import exact_quantiles
from lumenfield.operators.skew import spread
from lumenfield.session import reliable_checkpoint


def dither_diversity(frames: DataFrame) -> DataFrame:
    """How well the frames of a stack fill the sub-pixel plane, 0 to 1.

    One sky point, the centre of the first solved frame, is placed in every frame; the share of
    occupied bins of its fractional position is the score.
    """
    solved = frames.where("is_solved")
    first = solved.groupBy("stack_id").agg(
        F.min_by(F.struct("crval_ra", "crval_dec", "scale_arcsec", "crpix_x", "crpix_y", "rotation_deg", "width", "height"), "frame_id").alias("r"),
        F.count("*").alias("n"),
    )
    d = solved.join(first, "stack_id")
    sky = wcs.pixel_to_sky(wcs.frame_grid("r."), F.col("r.width") / 2.0, F.col("r.height") / 2.0)
    # snapped to a millionth of a pixel, so a point on a bin edge falls the same way on every run
    px, py = (F.floor(v * 1e6 + 0.5) / F.lit(1e6) for v in wcs.sky_to_pixel(wcs.frame_grid(), *sky))
    k = F.greatest(F.lit(2), F.ceil(F.sqrt(F.col("n"))).cast("int"))
    d = d.select("stack_id", "n", k.alias("k"), px.alias("px"), py.alias("py"))
    cell = lambda v: F.least(F.col("k") - 1, F.floor((F.col(v) - F.floor(v)) * F.col("k"))).cast("int")
    g = d.groupBy("stack_id").agg(
        F.count_distinct(cell("px"), cell("py")).alias("_b"), F.max("n").alias("n"), F.max("k").alias("k")
    )
    score = F.when(F.col("n") < 2, 0.0).otherwise(F.col("_b") / F.least(F.col("n"), F.col("k") * F.col("k")))
    return g.select("stack_id", score.alias("dither_score"))


def corner_rows(frames: DataFrame) -> DataFrame:
    """Four sky corners per solved frame."""
    w, h = F.col("width") - 1.0, F.col("height") - 1.0
    zero = F.lit(0.0)
    corners = F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in ((zero, zero), (w, zero), (w, h), (zero, h))])
    d = frames.where("is_solved").withColumn("c", F.explode(corners))
    ra, dec = wcs.pixel_to_sky(wcs.frame_grid(), F.col("c.x"), F.col("c.y"))
    return d.select("stack_id", "frame_id", ra.alias("ra"), dec.alias("dec"))


def output_grids(
    frames: DataFrame, scale_quantile: float = 0.25, max_oversample: float = 2.0, pad: float = 0.02,
    max_pixels: float = 64e6,
) -> DataFrame:
    """Common grid per stack: scale, oversampling granted by the dither score, centre and size."""
    # one scale for each frame of a stack, so they fit one buffer
    scale = frames.where("is_solved").groupBy("stack_id").agg(
        F.percentile("scale_arcsec", F.lit(scale_quantile)).alias("base_scale")
    )
    d = scale.join(dither_diversity(frames), "stack_id")
    over = F.when(F.col("dither_score") >= 0.7, min(2.0, max_oversample)).when(
        F.col("dither_score") >= 0.4, min(1.5, max_oversample)
    ).otherwise(1.0)
    d = d.withColumn("oversample", over).withColumn("scale", F.col("base_scale") / F.col("oversample"))
    corners = corner_rows(frames)
    a, b = F.radians("ra"), F.radians("dec")
    centre = corners.groupBy("stack_id").agg(
        F.avg(F.cos(b) * F.cos(a)).alias("vx"), F.avg(F.cos(b) * F.sin(a)).alias("vy"), F.avg(F.sin(b)).alias("vz")
    )
    az = F.degrees(F.atan2("vy", "vx"))
    centre = centre.select(
        "stack_id", (az - F.floor(az / 360.0) * 360.0).alias("ra0"),
        F.degrees(F.atan2(F.col("vz"), F.hypot("vx", "vy"))).alias("dec0"),
    )
    d = d.join(centre, "stack_id")
    probe = wcs.tangent_grid(F.col("ra0"), F.col("dec0"), F.col("scale"), F.lit(8.0), F.lit(8.0))
    px, py = wcs.sky_to_pixel(probe, F.col("ra"), F.col("dec"))
    span = corners.join(d, "stack_id").select("stack_id", px.alias("px"), py.alias("py")).groupBy("stack_id").agg(
        (F.max("px") - F.min("px")).alias("sx"), (F.max("py") - F.min("py")).alias("sy")
    )
    d = d.join(span, "stack_id")

    def odd(v: str) -> Column:
        n = F.ceil(F.col(v) * (1.0 + pad)).cast("int")
        return F.greatest(F.when(n % 2 == 0, n + 1).otherwise(n), F.lit(8))

    d = d.withColumns({"w0": odd("sx"), "h0": odd("sy")})
    shrink = F.greatest(F.lit(1.0), F.sqrt(F.col("w0") * F.col("h0") / F.lit(float(max_pixels))))
    d = d.withColumn("shrink", shrink)
    d = reliable_checkpoint(d)
    size = lambda v: F.when(F.col("shrink") > 1, F.greatest(F.lit(8), F.floor(F.col(v) / F.col("shrink")).cast("int"))).otherwise(F.col(v))
    return d.select(
        "stack_id", F.col("ra0").alias("out_ra"), F.col("dec0").alias("out_dec"),
        (F.col("scale") * F.col("shrink")).alias("out_scale"), (F.col("oversample") / F.col("shrink")).alias("oversample"),
        "dither_score", size("w0").cast("bigint").alias("out_width"), size("h0").cast("bigint").alias("out_height"),
    )


def out_grid() -> wcs.Grid:
    """Grid columns of an :func:`output_grids` row; the tangent point is the image centre."""
    return wcs.tangent_grid(
        F.col("out_ra"), F.col("out_dec"), F.col("out_scale"),
        F.col("out_width") / 2.0 - 0.5, F.col("out_height") / 2.0 - 0.5,
    )


def with_pixel_map(pixels: DataFrame, frames: DataFrame, grids: DataFrame) -> DataFrame:
    """Output position and local Jacobian of every input pixel.

    The map is closed-form, so the Jacobian takes differences of the map itself, central inside and
    one-sided at the edge, without looking at neighbouring rows.
    """
    maps = frames.where("is_solved").join(grids, "stack_id")
    maps = maps.select(
        *FRAME, "width", "height", "out_width", "out_height",
        *[v.alias(k) for k, v in wcs.homography(wcs.frame_grid(), out_grid()).items()],
    )
    d = pixels.join(reliable_checkpoint(maps), FRAME)
    c, one, zero = F.col, F.lit(1.0), F.lit(0.0)
    dx, dy = c("x") - c("hpx"), c("y") - c("hpy")
    d = d.withColumns(
        {
            "_w": c("hw0") + c("hwx") * dx + c("hwy") * dy,
            "_X": c("hX0") + c("hXx") * dx + c("hXy") * dy,
            "_Y": c("hY0") + c("hYx") * dx + c("hYy") * dy,
            "_l": F.when(c("x") > 0, one).otherwise(zero),
            "_r": F.when(c("x") < c("width") - 1, one).otherwise(zero),
            "_d": F.when(c("y") > 0, one).otherwise(zero),
            "_u": F.when(c("y") < c("height") - 1, one).otherwise(zero),
        }
    )

    def step(axis: str, coef: str, back: str, ahead: str) -> Column:
        num, den = c("_" + axis), c("_w")
        hi = (num + c("h" + axis + coef) * c(ahead)) / (den + c("hw" + coef) * c(ahead))
        lo = (num - c("h" + axis + coef) * c(back)) / (den - c("hw" + coef) * c(back))
        return (hi - lo) / (c(back) + c(ahead))

    d = d.withColumns(
        {
            "xo": c("hqx") + c("_X") / c("_w"), "yo": c("hqy") + c("_Y") / c("_w"),
            "dxdx": step("X", "x", "_l", "_r"), "dydx": step("Y", "x", "_l", "_r"),
            "dxdy": step("X", "y", "_d", "_u"), "dydy": step("Y", "y", "_d", "_u"),
        }
    )
    det = F.abs(F.col("dxdx") * F.col("dydy") - F.col("dxdy") * F.col("dydx"))
    return d.withColumn("area", F.when(det > 1e-12, det)).drop(
        "width", "height", "_w", "_X", "_Y", "_l", "_r", "_d", "_u", *wcs.MAP_COLUMNS
    )


def drizzle(
    pixels: DataFrame, frames: DataFrame, grids: DataFrame, pixfrac: float = 0.7, subsample: int = 5,
    weights: DataFrame | None = None,
) -> DataFrame:
    """Coadd on the output grid: shrunken drops carry flux and weight together.

    The ``subsample ** 2`` points of a drop are laid out and counted per output pixel inside one batch of input
    pixels, so a batch sends one row for each output pixel it touches, whatever the number of points.
    """
    if not 0.0 < pixfrac <= 1.0:
        raise ValueError("pixfrac must lie in (0, 1]")
    d = with_pixel_map(pixels.where(P.good_pixel()), frames, grids).where("area is not null")
    if weights is not None:
        d = d.join(weights.select(*FRAME, F.col("weight").alias("fw")), FRAME)
    else:
        d = d.withColumn("fw", F.lit(1.0))
    d = d.withColumn("variance", F.greatest("variance", F.lit(P.VARIANCE_FLOOR))).select(*FOOTPRINT)
    parts = d.mapInArrow(_footprints(pixfrac, subsample), TOUCHED)
    return parts.groupBy("stack_id", "ox", "oy").agg(*[F.sum(n).alias(n) for n in ("num", "weight", "var_num", "context")])


FOOTPRINT = ["stack_id", "out_width", "out_height", "xo", "yo", "dxdx", "dxdy", "dydx", "dydy", "area", "value", "variance", "fw"]
TOUCHED = "stack_id bigint, ox bigint, oy bigint, num double, weight double, var_num double, context bigint"


def _footprints(pixfrac: float, subsample: int):
    """Sums per output pixel over one batch of drops, as a function over Arrow batches."""
    side = ((np.arange(subsample) + 0.5) / subsample - 0.5) * pixfrac
    u, v = np.repeat(side, subsample), np.tile(side, subsample)
    names = [n.split()[0] for n in TOUCHED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            c = {n: b.column(n).to_numpy(zero_copy_only=False) for n in FOOTPRINT}
            wide = {n: c[n][:, None] for n in FOOTPRINT[3:9]}
            ox = np.rint(wide["xo"] + wide["dxdx"] * u + wide["dxdy"] * v)
            oy = np.rint(wide["yo"] + wide["dydx"] * u + wide["dydy"] * v)
            inside = (ox >= 0) & (ox < c["out_width"][:, None]) & (oy >= 0) & (oy < c["out_height"][:, None])
            row, _ = np.nonzero(inside)
            stacks, which = np.unique(c["stack_id"], return_inverse=True)
            w, h = int(c["out_width"].max()), int(c["out_height"].max())
            cell = (which[row] * h + oy[inside].astype(np.int64)) * w + ox[inside].astype(np.int64)
            cells, at = np.unique(cell, return_inverse=True)
            share = c["fw"][row] / (subsample * subsample)
            total = lambda x: np.bincount(at, x, len(cells))
            sums = [total(share * c["value"][row] / c["area"][row]), total(share), total(share * share * c["variance"][row] / c["area"][row] ** 2)]
            arrays = [stacks[cells // (h * w)], cells % w, cells // w % h, *sums, np.bincount(at, minlength=len(cells))]
            yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names)

    return run


def finish(acc: DataFrame) -> DataFrame:
    w = F.when(F.col("weight") > 0, F.col("weight"))
    return acc.select(
        "stack_id", "ox", "oy", F.coalesce(F.col("num") / w, F.lit(0.0)).alias("image"), "weight",
        F.coalesce(F.sqrt(F.col("var_num")) / w, F.lit(0.0)).alias("sigma"), "context",
    )


def coverage(acc: DataFrame, grids: DataFrame) -> DataFrame:
    """Covered share and hole share of each output grid."""
    n = acc.where("weight > 0").groupBy("stack_id").agg(F.count("*").alias("n"))
    d = grids.join(n, "stack_id", "left")
    share = F.coalesce("n", F.lit(0)) / (F.col("out_width") * F.col("out_height"))
    return d.select("stack_id", share.alias("coverage_fraction"), (1.0 - share).alias("hole_fraction"))


def drizzle_weights(frames: DataFrame) -> DataFrame:
    """Scalar inverse variance per frame, relative to the best frame of the stack."""
    d = frames.withColumn("_w", 1.0 / (F.col("noise_sigma") * F.col("noise_sigma")))
    best = d.groupBy("stack_id").agg(F.max("_w").alias("_m"))
    return d.join(best, "stack_id").select(*FRAME, (F.col("_w") / F.col("_m")).alias("weight"))


def reproject(pixels: DataFrame, frames: DataFrame, grids: DataFrame) -> DataFrame:
    """Bilinear resampling of each frame onto its stack's grid, with coverage.

    Output pixels are laid out from the grid, mapped back into the frame, and meet their four input
    neighbours through one equi join on the cell they fall in.
    """
    d = frames.where("is_solved").join(grids, "stack_id").select(
        *FRAME, "width", "height", "out_width", "out_height",
        *[v.alias(k) for k, v in wcs.homography(out_grid(), wcs.frame_grid()).items()],
    )
    d = reliable_checkpoint(d)
    one = F.lit(1).cast("bigint")
    d = d.withColumn("ox", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("out_width") - one)))
    d = spread(d, *FRAME, "ox")
    d = d.withColumn("oy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("out_height") - one)))
    ix, iy = wcs.apply_map(F.col("ox").cast("double"), F.col("oy").cast("double"))
    d = d.select(*FRAME, "ox", "oy", ix.alias("ix"), iy.alias("iy"), "width", "height")
    d = d.where((F.col("ix") >= 0) & (F.col("ix") <= F.col("width") - 1) & (F.col("iy") >= 0) & (F.col("iy") <= F.col("height") - 1))
    d = d.withColumns({"qx": F.floor("ix"), "qy": F.floor("iy")})
    squares = _squares(pixels)
    d = d.join(squares, [*FRAME, "qx", "qy"])
    fx, fy = F.col("ix") - F.col("qx"), F.col("iy") - F.col("qy")
    w = [(1 - fx) * (1 - fy), fx * (1 - fy), (1 - fx) * fy, fx * fy]
    need = [(w[k] > 0) & F.col(f"v{k}").isNull() for k in range(4)]
    hole = need[0] | need[1] | need[2] | need[3]
    mix = lambda p: sum((w[k] * F.coalesce(F.col(f"{p}{k}"), F.lit(0.0)) for k in range(4)), F.lit(0.0))
    return d.where(~hole).select(*FRAME, "ox", "oy", mix("v").alias("value"), mix("n").alias("variance"))


def _squares(pixels: DataFrame) -> DataFrame:
    """For each input square its four corner values and variances, good pixels only."""
    parts = F.array(
        *[
            F.struct((F.col("x") - i).alias("qx"), (F.col("y") - j).alias("qy"), F.lit(2 * j + i).alias("k"))
            for i in (0, 1) for j in (0, 1)
        ]
    )
    d = pixels.where(P.good_pixel()).select(*FRAME, "value", "variance", F.explode(parts).alias("q"))
    take = lambda col, k: F.max(F.when(F.col("q.k") == k, F.col(col)))
    return d.groupBy(*FRAME, F.col("q.qx").alias("qx"), F.col("q.qy").alias("qy")).agg(
        *[take("value", k).alias(f"v{k}") for k in range(4)], *[take("variance", k).alias(f"n{k}") for k in range(4)]
    )


def rescale_variance(resampled: DataFrame) -> DataFrame:
    """Scale each frame's variance to the noise measured after resampling."""
    resampled = reliable_checkpoint(resampled)
    sigma = robust_sigma(resampled, FRAME)
    med = exact_quantiles(resampled, FRAME, "variance", {"_med": 0.5})
    d = resampled.join(sigma, FRAME).join(med, FRAME)
    factor = F.when((F.col("sigma") > 0) & (F.col("_med") > 0), F.col("sigma") * F.col("sigma") / F.col("_med"))
    return d.withColumn("variance", F.col("variance") * F.coalesce(factor, F.lit(1.0))).drop("_med")
