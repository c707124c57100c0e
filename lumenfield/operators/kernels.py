"""Point-spread kernels as tables ``(stack_id, frame_id, dx, dy, w)`` and joins with them."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfield.functions.photometry import FWHM_PER_SIGMA
from lumenfield.operators import tiles
from lumenfield.operators.pixels import FRAME
from lumenfield.operators.skew import spread
from lumenfield.session import reliable_checkpoint


def _offsets(d: DataFrame, radius: Column) -> DataFrame:
    side = F.sequence(-radius, radius)
    return d.withColumn("dx", F.explode(side)).withColumn("dy", F.explode(side))


def _unit_sum(d: DataFrame) -> DataFrame:
    """Kernels scaled to one. They unfold from one row per frame, so no join here or later may broadcast them."""
    total = d.groupBy(*FRAME).agg(F.sum("k").alias("_t"))
    return d.hint("merge").join(total, FRAME).select(*FRAME, "dx", "dy", (F.col("k") / F.col("_t")).alias("w")).hint("merge")


def gaussian(frames: DataFrame, radius: int | None = None) -> DataFrame:
    """Elliptical Gaussian of each frame's width, eccentricity and orientation."""
    sigma = F.greatest("fwhm_px", F.lit(1e-3)) / FWHM_PER_SIGMA
    r = F.lit(radius) if radius is not None else F.greatest(F.lit(1), F.ceil(4.0 * sigma).cast("int"))
    ecc = F.least(F.lit(0.99), F.greatest(F.lit(0.0), F.coalesce("psf_eccentricity", F.lit(0.0))))
    theta = F.coalesce("psf_theta", F.lit(0.0)) if "psf_theta" in frames.columns else F.lit(0.0)
    ratio = F.sqrt(F.greatest(1.0 - ecc * ecc, F.lit(1e-4)))
    d = frames.select(
        *FRAME, (sigma / F.sqrt(ratio)).alias("_sa"), (sigma * F.sqrt(ratio)).alias("_sb"), theta.alias("_th"), r.alias("_r")
    )
    d = _offsets(d, F.col("_r"))
    u = F.col("dx") * F.cos("_th") + F.col("dy") * F.sin("_th")
    v = -F.col("dx") * F.sin("_th") + F.col("dy") * F.cos("_th")
    q = F.pow(u / F.col("_sa"), F.lit(2.0)) + F.pow(v / F.col("_sb"), F.lit(2.0))
    return _unit_sum(d.withColumn("k", F.exp(-0.5 * q)))


def moffat(frames: DataFrame, beta: float = 3.5, radius: int | None = None) -> DataFrame:
    alpha = F.greatest("fwhm_px", F.lit(1e-3)) / (2.0 * math.sqrt(2.0 ** (1.0 / beta) - 1.0))
    r = F.lit(radius) if radius is not None else F.greatest(F.lit(1), F.ceil(4.0 * alpha).cast("int"))
    d = _offsets(frames.select(*FRAME, alpha.alias("_a"), r.alias("_r")), F.col("_r"))
    q = (F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")) / F.pow("_a", F.lit(2.0))
    return _unit_sum(d.withColumn("k", F.pow(1.0 + q, F.lit(-beta))))


def noise_equivalent_width(kernels: DataFrame, keys: list[str]) -> DataFrame:
    """Width of a kernel from its L2 norm, which sets point-source detection."""
    g = kernels.groupBy(*keys).agg(F.sum("w").alias("_t"), F.sum(F.col("w") * F.col("w")).alias("_q"))
    l2 = F.sqrt("_q") / F.col("_t")
    return g.select(*keys, F.when(F.col("_t") > 0, math.sqrt(2.0 * math.log(2.0) / math.pi) / l2).alias("width"))


def stamps(positions: DataFrame, kernels: DataFrame, keys: list[str], ident: list[str]) -> DataFrame:
    """Kernel pixels around each position (``x``, ``y`` rounded to even halves), ready to join pixels."""
    d = positions.select(*keys, *ident, F.rint("x").cast("bigint").alias("_ix"), F.rint("y").cast("bigint").alias("_iy"))
    d = d.join(kernels, keys)
    return d.select(
        *keys, *ident, (F.col("_ix") + F.col("dx")).alias("x"), (F.col("_iy") + F.col("dy")).alias("y"), "w"
    )


def matched_filter(
    image: DataFrame, positions: DataFrame, kernels: DataFrame, keys: list[str], ident: list[str],
    value: str = "image", sigma: str = "sigma",
) -> DataFrame:
    """Maximum-likelihood flux and its significance at each position, each image with its own kernel."""
    s = F.greatest(F.col(sigma), F.lit(1e-12))
    d = stamps(positions, kernels, keys, ident).join(image.select(*keys, "x", "y", F.col(value).alias("_v"), s.alias("_s")), [*keys, "x", "y"])
    g = d.groupBy(*keys, *ident).agg(
        F.sum(F.col("w") * F.col("_v") / (F.col("_s") * F.col("_s"))).alias("_n"),
        F.sum(F.col("w") * F.col("w") / (F.col("_s") * F.col("_s"))).alias("_d"),
    )
    den = F.when(F.col("_d") > 0, F.col("_d"))
    return g.select(*keys, *ident, (F.col("_n") / den).alias("flux"), (F.col("_n") / F.sqrt(den)).alias("snr"))


def _overlap_save(image: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """The part of a convolution that needs nothing from outside ``image``, by one pair of transforms.

    A value that is not finite makes the pixels in reach of the kernel NaN, as a sum over them would.
    """
    r = kernel.shape[0] // 2
    shape = image.shape
    placed = np.zeros(shape)
    placed[: 2 * r + 1, : 2 * r + 1] = kernel
    spectrum = np.fft.rfft2(placed)
    through = lambda x, s: np.fft.irfft2(np.fft.rfft2(x) * s, shape)[2 * r :, 2 * r :]
    bad = ~np.isfinite(image)
    if not bad.any():
        return through(image, spectrum)
    reach = through(bad.astype(float), np.fft.rfft2((placed != 0).astype(float))) > 0.5
    return np.where(reach, np.nan, through(np.where(bad, 0.0, image), spectrum))


def convolve(image: DataFrame, kernels: DataFrame, keys: list[str], value: str = "image", flip: bool = False, tile: int = tiles.TILE) -> DataFrame:
    """Convolution (or correlation with ``flip``) at the pixels of the image; what is outside or null counts as zero.

    Images are cut into tiles with a margin as wide as their kernel, each convolved by one pair of transforms, so
    there are no rows per pixel and kernel offset. A tile with its margin is at most twice as wide as its core.
    """
    c = F.col
    reach = kernels.groupBy(*keys).agg(F.max(F.greatest(F.abs("dx"), F.abs("dy"))).cast("bigint").alias("_r"))
    box = image.groupBy(*keys).agg(F.min("x").alias("_x0"), F.min("y").alias("_y0"), F.max("x").alias("_x1"), F.max("y").alias("_y1"))
    size = reliable_checkpoint(box.join(reach, keys))
    d = image.select(*keys, "x", "y", F.coalesce(c(value).cast("double"), F.lit(0.0)).alias("level")).join(size, keys)
    d = d.select(
        *keys, (c("x") - c("_x0")).alias("x"), (c("y") - c("_y0")).alias("y"), "level", "_x0", "_y0", "_r",
        (c("_x1") - c("_x0") + 1).alias("width"), (c("_y1") - c("_y0") + 1).alias("height"),
    )
    d = tiles.deal(d, c("_r"), F.greatest(F.lit(tile), 2 * c("_r")))
    slots = [*keys, "tx", "ty"]
    here = spread(d.select(*slots, "x", "y", "level", "_x0", "_y0", "_r", "px", "py", "cx", "cy"), *slots)
    used = here.select(*slots).distinct()
    sign = -1 if flip else 1
    stamps_ = used.join(kernels.select(*keys, (sign * c("dx")).cast("int").alias("dx"), (sign * c("dy")).cast("int").alias("dy"), c("w").cast("double").alias("w")), keys)
    stamps_ = stamps_.toDF(*[f"k_{n}" for n in slots], "dx", "dy", "w")  # both sides may stem from one table
    kinds = {f.name: f.dataType.simpleString() for f in image.schema.fields}
    schema = ", ".join([*[f"{k} {kinds[k]}" for k in keys], "x bigint", "y bigint", "filtered double"])
    names = [*keys, "x", "y", "filtered"]

    def run(pixels: pa.Table, stamp: pa.Table) -> pa.Table:
        if not pixels.num_rows or not stamp.num_rows:
            return pa.table([pa.array([], pixels.schema.field(k).type) for k in keys] + [pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64())], names)
        at = {n: pixels.column(n).to_numpy() for n in ("x", "y", "px", "py", "level", "_x0", "_y0")}
        r, cx, cy = (pixels.column(n)[0].as_py() for n in ("_r", "cx", "cy"))
        kernel = np.zeros((2 * r + 1, 2 * r + 1))
        np.add.at(kernel, (stamp.column("dy").to_numpy() + r, stamp.column("dx").to_numpy() + r), stamp.column("w").to_numpy())
        block = np.zeros((cy + 2 * r, cx + 2 * r))
        np.add.at(block, (at["py"] + r, at["px"] + r), at["level"])
        made = _overlap_save(block, kernel)
        core = np.flatnonzero((at["px"] >= 0) & (at["px"] < cx) & (at["py"] >= 0) & (at["py"] < cy))
        own = [pixels.column(k).take(pa.array(core)) for k in keys]
        return pa.table([*own, *[pa.array((at[n] + at[f"_{n}0"])[core]) for n in ("x", "y")], pa.array(made[at["py"][core], at["px"][core]])], names)

    return here.groupBy(*slots).cogroup(stamps_.groupBy(*[f"k_{n}" for n in slots])).applyInArrow(run, schema)
