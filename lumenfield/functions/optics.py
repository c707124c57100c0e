"""Optics, sampling, sub-pixel phase and time normalisation as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ARCSEC_PER_RADIAN = 206264.80624709636


def _positive(x: Column) -> Column:
    return F.when(x > 0, x)


def diffraction_limit(aperture_mm: Column, wavelength_nm: float = 550.0) -> Column:
    """Rayleigh limit in arcsec; null without a positive aperture."""
    return 1.22 * (wavelength_nm * 1e-9) / (_positive(aperture_mm) * 1e-3) * ARCSEC_PER_RADIAN


def pixel_scale(focal_mm: Column, pitch_um: Column, binning: int = 1) -> Column:
    return (
        ARCSEC_PER_RADIAN * (_positive(pitch_um) * 1e-6 * binning) / (_positive(focal_mm) * 1e-3)
    )


def pixel_pitch(pitch_um: Column, sensor_width_mm: Column, width_px: Column) -> Column:
    return F.coalesce(pitch_um, sensor_width_mm * 1000.0 / _positive(width_px))


def aperture(focal_mm: Column, focal_ratio: Column) -> Column:
    return _positive(focal_mm) / _positive(focal_ratio)


def sampling_ratio(focal_mm: Column, pitch_um: Column, aperture_mm: Column) -> Column:
    return pixel_scale(focal_mm, pitch_um) / diffraction_limit(aperture_mm)


def toroidal_delta(a: Column, b: Column) -> Column:
    d = F.abs((a - F.floor(a)) - (b - F.floor(b)))
    return F.least(d, 1.0 - d)


def phase_distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    d = F.hypot(toroidal_delta(ax, bx), toroidal_delta(ay, by)) / F.sqrt(F.lit(0.5))
    return F.coalesce(F.least(F.lit(1.0), d), F.lit(0.0))


def scale_distance(a: Column, b: Column, span: float = 4.0) -> Column:
    octaves = F.abs(F.log2(_positive(a) / _positive(b)))
    return F.coalesce(F.least(F.lit(1.0), octaves / F.log2(F.lit(span))), F.lit(0.0))


def local_to_utc(local: Column, offset_minutes: Column) -> Column:
    return local - F.make_dt_interval(mins=F.coalesce(offset_minutes, F.lit(0)).cast("int"))


def gps_degrees(num: Column, den: Column, ref: Column) -> Column:
    """Degrees, minutes, seconds held as arrays of numerators and denominators, plus hemisphere."""

    def part(i: int) -> Column:
        return F.coalesce(F.try_divide(F.get(num, F.lit(i)), F.get(den, F.lit(i))), F.lit(0.0))

    value = part(0) + part(1) / 60.0 + part(2) / 3600.0
    return F.when(F.upper(ref).isin("S", "W"), -value).otherwise(value)
