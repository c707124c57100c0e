"""Tangent-plane projection as column expressions.

A grid is a dict of columns: ``ra``, ``dec`` (degrees, of the tangent point), ``px``, ``py``
(zero-based pixel of the tangent point) and the matrix ``cd11 cd12 cd21 cd22`` in degrees per pixel.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Grid = dict[str, Column]


def tangent_grid(
    ra: Column, dec: Column, scale_arcsec: Column, px: Column, py: Column,
    rotation_deg: Column | None = None, parity: int = -1,
) -> Grid:
    """Grid from scale, rotation and parity; parity -1 has right ascension growing to the left."""
    s = scale_arcsec / 3600.0
    rot = F.radians(rotation_deg) if rotation_deg is not None else F.lit(0.0)
    flip = -1.0 if parity < 0 else 1.0
    return {
        "ra": ra, "dec": dec, "px": px, "py": py,
        "cd11": flip * s * F.cos(rot), "cd12": -s * F.sin(rot),
        "cd21": flip * s * F.sin(rot), "cd22": s * F.cos(rot),
    }


def frame_grid(prefix: str = "") -> Grid:
    """Grid of a row of the frames table."""
    c = lambda n: F.col(prefix + n)
    return tangent_grid(
        c("crval_ra"), c("crval_dec"), c("scale_arcsec"), c("crpix_x") - 1.0, c("crpix_y") - 1.0, c("rotation_deg")
    )


def pixel_to_sky(g: Grid, x: Column, y: Column) -> tuple[Column, Column]:
    """(ra, dec) in degrees."""
    dx, dy = x - g["px"], y - g["py"]
    xi = F.radians(g["cd11"] * dx + g["cd12"] * dy)
    eta = F.radians(g["cd21"] * dx + g["cd22"] * dy)
    sd, cd = F.sin(F.radians(g["dec"])), F.cos(F.radians(g["dec"]))
    ra = g["ra"] + F.degrees(F.atan2(xi, cd - eta * sd))
    dec = F.degrees(F.atan2(sd + eta * cd, F.hypot(xi, cd - eta * sd)))
    return F.pmod(ra, F.lit(360.0)), dec


def sky_to_pixel(g: Grid, ra: Column, dec: Column) -> tuple[Column, Column]:
    d = F.radians(ra - g["ra"])
    sd, cd = F.sin(F.radians(g["dec"])), F.cos(F.radians(g["dec"]))
    s, c = F.sin(F.radians(dec)), F.cos(F.radians(dec))
    w = s * sd + c * cd * F.cos(d)
    xi = F.degrees(c * F.sin(d) / w)
    eta = F.degrees((s * cd - c * sd * F.cos(d)) / w)
    det = g["cd11"] * g["cd22"] - g["cd12"] * g["cd21"]
    return (
        g["px"] + (g["cd22"] * xi - g["cd12"] * eta) / det,
        g["py"] + (g["cd11"] * eta - g["cd21"] * xi) / det,
    )


def homography(src: Grid, out: Grid) -> dict[str, Column]:
    """Coefficients of the exact map between two tangent-plane grids.

    Two gnomonic images of one sphere differ by a projective map, so all trigonometry is done once
    per frame and a pixel costs two divisions (:func:`apply_map`). Offsets are taken from the source
    tangent point, where the map is best conditioned.
    """
    d = F.radians(src["ra"] - out["ra"])
    s, c = F.sin(F.radians(src["dec"])), F.cos(F.radians(src["dec"]))
    so, co = F.sin(F.radians(out["dec"])), F.cos(F.radians(out["dec"]))
    sd, cd = F.sin(d), F.cos(d)
    # rows: component along the output axis (centre, east, north);
    # columns: source tangent point, source east, source north
    centre = (s * so + c * co * cd, -co * sd, c * so - s * co * cd)
    east = (c * sd, cd, -s * sd)
    north = (s * co - c * so * cd, so * sd, c * co + s * so * cd)

    def affine(row) -> tuple[Column, Column, Column]:
        ex, ey = F.radians(src["cd11"]), F.radians(src["cd12"])
        nx, ny = F.radians(src["cd21"]), F.radians(src["cd22"])
        return row[0], row[1] * ex + row[2] * nx, row[1] * ey + row[2] * ny

    w, e, n = affine(centre), affine(east), affine(north)
    det = out["cd11"] * out["cd22"] - out["cd12"] * out["cd21"]
    names = ("0", "x", "y")
    coef = {f"hw{k}": w[i] for i, k in enumerate(names)}
    coef |= {f"hX{k}": F.degrees(out["cd22"] * e[i] - out["cd12"] * n[i]) / det for i, k in enumerate(names)}
    coef |= {f"hY{k}": F.degrees(out["cd11"] * n[i] - out["cd21"] * e[i]) / det for i, k in enumerate(names)}
    return coef | {"hpx": src["px"], "hpy": src["py"], "hqx": out["px"], "hqy": out["py"]}


MAP_COLUMNS = [f"h{p}{k}" for p in "wXY" for k in "0xy"] + ["hpx", "hpy", "hqx", "hqy"]


def apply_map(x: Column, y: Column) -> tuple[Column, Column]:
    """Output pixel of (x, y) from the columns of :func:`homography`."""
    c = F.col
    dx, dy = x - c("hpx"), y - c("hpy")
    w = c("hw0") + c("hwx") * dx + c("hwy") * dy
    return (
        c("hqx") + (c("hX0") + c("hXx") * dx + c("hXy") * dy) / w,
        c("hqy") + (c("hY0") + c("hYx") * dx + c("hYy") * dy) / w,
    )


def describe(g: Grid, width: Column, height: Column) -> dict[str, Column]:
    """Scale, position angle, parity, centre and field radius."""
    from lumenfield.functions.sky import separation

    centre = pixel_to_sky(g, width / 2.0 - 0.5, height / 2.0 - 0.5)
    corner = pixel_to_sky(g, F.lit(0.0), F.lit(0.0))
    sx, sy = F.hypot(g["cd11"], g["cd21"]), F.hypot(g["cd12"], g["cd22"])
    det = g["cd11"] * g["cd22"] - g["cd12"] * g["cd21"]
    return {
        "ra_deg": centre[0],
        "dec_deg": centre[1],
        "pixel_scale_arcsec": (sx + sy) / 2.0 * 3600.0,
        "orientation_deg": F.degrees(F.atan2(g["cd12"], g["cd22"])),
        "parity": F.when(det < 0, -1).otherwise(1),
        "field_radius_deg": separation(*centre, *corner),
    }


def affine_grid(ref: Grid, m: dict[str, Column], width: Column, height: Column) -> Grid:
    """Grid of a frame whose pixels map onto ``ref`` by ``x' = a x + b y + tx, y' = c x + d y + ty``."""
    cx, cy = width / 2.0, height / 2.0
    rx = m["a"] * cx + m["b"] * cy + m["tx"]
    ry = m["c"] * cx + m["d"] * cy + m["ty"]
    ra, dec = pixel_to_sky(ref, rx, ry)
    return {
        "ra": ra, "dec": dec, "px": cx, "py": cy,
        "cd11": ref["cd11"] * m["a"] + ref["cd12"] * m["c"],
        "cd12": ref["cd11"] * m["b"] + ref["cd12"] * m["d"],
        "cd21": ref["cd21"] * m["a"] + ref["cd22"] * m["c"],
        "cd22": ref["cd21"] * m["b"] + ref["cd22"] * m["d"],
    }
