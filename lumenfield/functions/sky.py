"""Closed-form astronomy as column expressions (angles in degrees, instants in UTC)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lunar series (Meeus, Astronomical Algorithms, ch. 47), truncated.
# Each row is (coefficient, multiples of D, M, M', F).
MOON_LONGITUDE = (
    (6.288774, 0, 0, 1, 0),
    (1.274027, 2, 0, -1, 0),
    (0.658314, 2, 0, 0, 0),
    (0.213618, 0, 0, 2, 0),
    (-0.185116, 0, 1, 0, 0),
    (-0.114332, 0, 0, 0, 2),
    (0.058793, 2, 0, -2, 0),
    (0.057066, 2, -1, -1, 0),
    (0.053322, 2, 0, 1, 0),
    (0.045758, 2, -1, 0, 0),
)
MOON_LATITUDE = (
    (5.128122, 0, 0, 0, 1),
    (0.280602, 0, 0, 1, 1),
    (0.277693, 0, 0, 1, -1),
    (0.173237, 2, 0, 0, -1),
    (0.055413, 2, 0, -1, 1),
    (0.046271, 2, 0, -1, -1),
)
MOON_DISTANCE = (
    (-20905.355, 0, 0, 1, 0),
    (-3699.111, 2, 0, -1, 0),
    (-2955.968, 2, 0, 0, 0),
    (-569.925, 0, 0, 2, 0),
)
# Mean arguments D, M, M', F and mean longitude as (offset, rate per century).
MOON_ARGUMENTS = (
    (297.8501921, 445267.1114034),
    (357.5291092, 35999.0502909),
    (134.9633964, 477198.8675055),
    (93.2720950, 483202.0175233),
)
MOON_MEAN_LONGITUDE = (218.3164477, 481267.88123421)
MOON_MEAN_DISTANCE_KM = 385000.56
AU_KM = 149597870.7


def clamp(x: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.when(x.isNotNull(), F.least(F.lit(hi), F.greatest(F.lit(lo), x)))


def bounded(x: Column, lo: float = -1.0, hi: float = 1.0) -> Column:
    """Clamp for expressions whose nulls the caller handles; names its input once."""
    return F.least(F.lit(hi), F.greatest(F.lit(lo), x))


def wrap360(x: Column) -> Column:
    return F.pmod(x, F.lit(360.0))


def _sind(x: Column) -> Column:
    return F.sin(F.radians(x))


def _cosd(x: Column) -> Column:
    return F.cos(F.radians(x))


def julian_date(when: Column) -> Column:
    return F.unix_micros(when) / F.lit(86400e6) + F.lit(2440587.5)


def centuries(when: Column) -> Column:
    return (julian_date(when) - 2451545.0) / 36525.0


def airmass(altitude: Column, model: str = "pickering") -> Column:
    """Relative air mass; +inf at or below the horizon."""
    h = F.least(F.lit(90.0), F.greatest(altitude, F.lit(1e-9)))
    if model == "pickering":
        value = 1.0 / _sind(h + 244.0 / (165.0 + 47.0 * F.pow(h, F.lit(1.1))))
    elif model == "kasten-young":
        value = 1.0 / (_sind(h) + 0.50572 * F.pow(h + 6.07995, F.lit(-1.6364)))
    else:
        raise ValueError(f"unknown airmass model {model!r}")
    return F.when(altitude.isNull(), None).when(altitude <= 0, float("inf")).otherwise(value)


def sidereal_time(when: Column) -> Column:
    """Greenwich mean sidereal time."""
    d = julian_date(when) - 2451545.0
    t = d / 36525.0
    return wrap360(
        280.46061837 + 360.98564736629 * d + 0.000387933 * t * t - t * t * t / 38710000.0
    )


def hour_angle(ra: Column, lon: Column, when: Column) -> Column:
    return wrap360(wrap360(sidereal_time(when) + lon) - ra)


def alt_az(ra: Column, dec: Column, lat: Column, lon: Column, when: Column) -> Column:
    """Struct of geometric altitude and azimuth (north through east)."""
    ha = hour_angle(ra, lon, when)
    sin_alt = _sind(dec) * _sind(lat) + _cosd(dec) * _cosd(lat) * _cosd(ha)
    az = F.atan2(
        -_cosd(dec) * _sind(ha), _sind(dec) * _cosd(lat) - _cosd(dec) * _sind(lat) * _cosd(ha)
    )
    known = ra.isNotNull() & dec.isNotNull() & lat.isNotNull() & lon.isNotNull() & when.isNotNull()
    return F.when(
        known,
        F.struct(
            F.degrees(F.asin(bounded(sin_alt))).alias("altitude_deg"),
            wrap360(F.degrees(az)).alias("azimuth_deg"),
        ),
    )


def parallactic_angle(ra: Column, dec: Column, lat: Column, lon: Column, when: Column) -> Column:
    """Standard two-argument form, so the quadrant is kept."""
    ha = hour_angle(ra, lon, when)
    return F.degrees(
        F.atan2(_sind(ha) * _cosd(lat), _sind(lat) * _cosd(dec) - _cosd(lat) * _sind(dec) * _cosd(ha))
    )


def separation(ra1: Column, dec1: Column, ra2: Column, dec2: Column) -> Column:
    """Angular distance, stable at small and at antipodal separations."""
    d = ra2 - ra1
    num = F.hypot(
        _cosd(dec2) * _sind(d), _cosd(dec1) * _sind(dec2) - _sind(dec1) * _cosd(dec2) * _cosd(d)
    )
    den = _sind(dec1) * _sind(dec2) + _cosd(dec1) * _cosd(dec2) * _cosd(d)
    return F.degrees(F.atan2(num, den))


def obliquity(t: Column) -> Column:
    return 23.439291 - 0.0130042 * t - 1.64e-7 * t * t + 5.04e-7 * t * t * t


def sun_apparent(t: Column) -> Column:
    """Struct of ecliptic longitude and distance of the Sun."""
    m = 357.52911 + 35999.05029 * t - 0.0001537 * t * t
    e = 0.016708634 - 0.000042037 * t
    c = (
        (1.914602 - 0.004817 * t - 0.000014 * t * t) * _sind(m)
        + (0.019993 - 0.000101 * t) * _sind(2 * m)
        + 0.000289 * _sind(3 * m)
    )
    lon = wrap360(280.46646 + 36000.76983 * t + 0.0003032 * t * t + c)
    radius = 1.000001018 * (1 - e * e) / (1 + e * _cosd(m + c))
    return F.struct(lon.alias("lon_deg"), radius.alias("radius_au"))


def _series(rows, args, fn) -> Column:
    total = None
    for coef, *mult in rows:
        angle = None
        for n, a in zip(mult, args, strict=True):
            if n:
                angle = n * a if angle is None else angle + n * a
        term = coef * fn(angle)
        total = term if total is None else total + term
    return total


def with_moon(df, when: str = "captured_at_utc", name: str = "moon"):
    """Add a struct ``moon``; intermediate series are columns, so each is evaluated once."""
    t = F.col("_t")
    df = df.withColumn("_t", centuries(F.col(when)))
    args = [F.lit(o) + r * t for o, r in MOON_ARGUMENTS]
    df = df.select(
        "*",
        wrap360(
            F.lit(MOON_MEAN_LONGITUDE[0]) + MOON_MEAN_LONGITUDE[1] * t
            + _series(MOON_LONGITUDE, args, _sind)
        ).alias("_lon"),
        _series(MOON_LATITUDE, args, _sind).alias("_lat"),
        (MOON_MEAN_DISTANCE_KM + _series(MOON_DISTANCE, args, _cosd)).alias("_dist"),
        obliquity(t).alias("_eps"),
        sun_apparent(t).alias("_sun"),
    )
    lon, lat, eps = F.col("_lon"), F.col("_lat"), F.col("_eps")
    sun_lon, sun_r = F.col("_sun.lon_deg"), F.col("_sun.radius_au")
    df = df.withColumn("_elong", F.acos(bounded(_cosd(lat) * _cosd(lon - sun_lon))))
    elong = F.col("_elong")
    df = df.withColumn(
        "_phase",
        F.atan2(sun_r * F.sin(elong), F.col("_dist") / AU_KM - sun_r * F.cos(elong)),
    )
    moon = F.struct(
        wrap360(
            F.degrees(
                F.atan2(_sind(lon) * _cosd(eps) - F.tan(F.radians(lat)) * _sind(eps), _cosd(lon))
            )
        ).alias("ra_deg"),
        F.degrees(
            F.asin(bounded(_sind(lat) * _cosd(eps) + _cosd(lat) * _sind(eps) * _sind(lon)))
        ).alias("dec_deg"),
        lon.alias("ecliptic_lon_deg"),
        lat.alias("ecliptic_lat_deg"),
        F.col("_dist").alias("distance_km"),
        ((1 + F.cos(F.col("_phase"))) / 2).alias("illumination"),
        F.degrees(F.col("_phase")).alias("phase_angle_deg"),
        F.degrees(elong).alias("elongation_deg"),
    )
    out = df.withColumn(name, F.when(F.col(when).isNotNull(), moon))
    return out.drop("_t", "_lon", "_lat", "_dist", "_eps", "_sun", "_elong", "_phase")
