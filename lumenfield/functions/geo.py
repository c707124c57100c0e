"""Distances on the WGS84 ellipsoid and equal-height zone cells on the sphere."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# WGS84.
WGS84_A = 6378137.0
WGS84_F = 1 / 298.257223563


def geodesic_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Lambert's closed form; metre-level against the exact geodesic below 1000 km."""
    b1 = F.atan((1 - WGS84_F) * F.tan(F.radians(lat1)))
    b2 = F.atan((1 - WGS84_F) * F.tan(F.radians(lat2)))
    half_dlon = F.radians(lon2 - lon1) / 2
    q = (b2 - b1) / 2
    p = (b1 + b2) / 2
    hav = F.pow(F.sin(q), F.lit(2.0)) + F.cos(b1) * F.cos(b2) * F.pow(F.sin(half_dlon), F.lit(2.0))
    sin2 = F.when(hav.isNotNull(), F.least(F.lit(1.0), hav))
    sigma = 2 * F.asin(F.sqrt(sin2))
    cos2 = F.greatest(F.lit(1e-12), 1 - hav)
    x = (sigma - F.sin(sigma)) * F.pow(F.sin(p) * F.cos(q), F.lit(2.0)) / cos2
    y = (sigma + F.sin(sigma)) * F.pow(F.cos(p) * F.sin(q), F.lit(2.0)) / F.greatest(sin2, F.lit(1e-300))
    return WGS84_A * (sigma - WGS84_F / 2 * (x + y))


def zone(lat: Column, height: float) -> Column:
    """Index of the latitude (or declination) zone of ``height`` degrees."""
    return F.floor((lat + 90.0) / height).cast("int")


def cells_in_zone(zone_id: Column, height: float) -> Column:
    """Number of roughly square cells along a zone, from its widest parallel."""
    lo = zone_id * height - 90.0
    hi = lo + height
    nearest = F.when((lo <= 0) & (hi >= 0), 0.0).otherwise(F.least(F.abs(lo), F.abs(hi)))
    return F.greatest(
        F.lit(1), F.floor(360.0 * F.cos(F.radians(nearest)) / height)
    ).cast("int")


def cell(lon: Column, zone_id: Column, height: float) -> Column:
    n = cells_in_zone(zone_id, height)
    wrapped = F.pmod(lon, F.lit(360.0))
    return F.least(n - 1, F.floor(wrapped / 360.0 * n).cast("int"))


def half_width(lat: Column, radius: Column) -> Column:
    """Half-width in longitude of a cap; 180 when the cap touches a pole. Slightly generous."""
    reach = F.abs(lat) + radius
    ratio = F.sin(F.radians(radius)) / F.greatest(F.lit(1e-12), F.cos(F.radians(lat)))
    return F.when(reach >= 89.999, 180.0).otherwise(
        F.degrees(F.asin(F.least(F.lit(1.0), ratio))) + 1e-6
    )


def cap_zones(lat: Column, radius: Column, height: float) -> tuple[Column, Column]:
    """First and last zone that a cap touches."""
    z0 = F.greatest(F.lit(0), F.floor((lat - radius - 1e-6 + 90.0) / height).cast("int"))
    z1 = F.least(
        F.lit(int(math.ceil(180.0 / height))),
        F.floor((lat + radius + 1e-6 + 90.0) / height).cast("int"),
    )
    return z0, z1


def zone_span(lon: Column, width: Column, n: Column) -> tuple[Column, Column]:
    """First and last cell, modulo ``n``, that a cap of half-width ``width`` touches in a zone of ``n`` cells; none twice."""
    first = F.floor((lon - width) / 360.0 * n).cast("int")
    last = F.floor((lon + width) / 360.0 * n).cast("int")
    return first, F.least(last, first + n - 1)


def cap_cells(lat: Column, lon: Column, radius: Column, height: float) -> Column:
    """Array of ``(zone, cell)`` structs that cover a cap, each once."""
    width = half_width(lat, radius)

    def in_zone(z: Column) -> Column:
        n = cells_in_zone(z, height)
        return F.transform(
            F.sequence(*zone_span(lon, width, n)),
            lambda c: F.struct(z.alias("zone"), F.pmod(c, n).cast("int").alias("cell")),
        )

    return F.flatten(F.transform(F.sequence(*cap_zones(lat, radius, height)), in_zone))
