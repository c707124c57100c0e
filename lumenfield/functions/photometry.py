"""Per-pixel and per-source formulas."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenfield.functions.sky import clamp

MAD_TO_SIGMA = 1.4826
FWHM_PER_SIGMA = 2.0 * math.sqrt(2.0 * math.log(2.0))
VARIANCE_FLOOR = 1e-12


def good_pixel(value: str = "value", masked: str = "is_masked", saturated: str = "is_saturated") -> Column:
    """Finite, not masked and not saturated."""
    v = F.col(value)
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    return finite & ~F.coalesce(masked, F.lit(False)) & ~F.coalesce(saturated, F.lit(False))


def effective_variance(variance: Column, background_rms: Column) -> Column:
    """Declared variance above a floor, else the background variance."""
    return F.greatest(F.coalesce(variance, background_rms * background_rms), F.lit(VARIANCE_FLOOR))


def gain_variance(value: Column, gain: Column, read_noise: Column) -> Column:
    rn = F.coalesce(read_noise, F.lit(0.0)) / gain
    return F.greatest(value, F.lit(0.0)) / gain + rn * rn


def background_variance(value: Column, rms: Column, level: Column) -> Column:
    """Flat background variance with shot noise where the signal dominates."""
    excess = F.greatest(value - level, F.lit(0.0))
    return rms * rms * (1.0 + excess / F.greatest(level, F.lit(1e-6)))


def srgb_to_linear(x: Column) -> Column:
    u = clamp(x)
    return F.when(u <= 0.04045, u / 12.92).otherwise(F.pow((u + 0.055) / 1.055, F.lit(2.4)))


def power_curve(x: Column, gamma: Column) -> Column:
    """Undo a residual power law; a gamma of one leaves the value alone."""
    return F.when(F.abs(gamma - 1.0) > 1e-3, F.pow(clamp(x), gamma)).otherwise(x)


def asinh_stretch(x: Column, low: Column, high: Column, softening: float = 0.02) -> Column:
    span = F.when(high <= low, F.lit(1e-6)).otherwise(high - low)
    return F.asinh(clamp((x - low) / span) / softening) / math.asinh(1.0 / softening)


def confidence(value: Column, sigma: Column, saturation: Column, knee: float = 0.75, floor_sigma: float = 1.0) -> Column:
    """Taper to zero at saturation and at the noise floor; no saturation level, no upper taper."""
    room = F.greatest(saturation * (1.0 - knee), F.lit(1e-9))
    hi = F.coalesce(clamp((saturation - value) / room), F.lit(1.0))
    return hi * clamp(value / F.greatest(floor_sigma * sigma, F.lit(1e-9)))


def source_fwhm(a: Column, b: Column) -> Column:
    return FWHM_PER_SIGMA * F.sqrt(F.greatest(a * b, F.lit(1e-12)))


def source_eccentricity(a: Column, b: Column) -> Column:
    ratio = clamp(b / F.greatest(a, F.lit(1e-12)))
    return F.sqrt(F.greatest(1.0 - ratio * ratio, F.lit(0.0)))


def instrumental_magnitude(flux: Column) -> Column:
    return -2.5 * F.log10(F.greatest(flux, F.lit(1e-30)))
