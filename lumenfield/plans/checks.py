"""Formula texts for the checking SQL."""

from __future__ import annotations

from lumenfield.functions import sky
from lumenfield.plans.registry import s6

def s1(e: str) -> str:
    return f"(floor(({e}) * 10 + 0.5001) / 10)"


def s3(e: str) -> str:
    return f"(floor(({e}) * 1e3 + 0.5001) / 1e3)"


def rad(x: str) -> str:
    return f"radians({x})"


def mod360(x: str) -> str:
    return f"(({x}) - floor(({x}) / 360.0::double) * 360)"


def vincenty(ra1, dec1, ra2, dec2) -> str:
    a, b, d = rad(dec1), rad(dec2), f"(radians({ra2}) - radians({ra1}))"
    y1 = f"cos({b}) * sin({d})"
    y2 = f"(cos({a}) * sin({b}) - sin({a}) * cos({b}) * cos({d}))"
    x = f"(sin({a}) * sin({b}) + cos({a}) * cos({b}) * cos({d}))"
    return f"degrees(atan2(sqrt(power({y1}, 2) + power({y2}, 2)), {x}))"


def lambert(lat1, lon1, lat2, lon2) -> str:
    f = "(1 / 298.257223563::double)"
    b1, b2 = f"atan((1 - {f}) * tan(radians({lat1})))", f"atan((1 - {f}) * tan(radians({lat2})))"
    q, p = f"((({b2}) - ({b1})) / 2)", f"((({b1}) + ({b2})) / 2)"
    h = (
        f"least(1::double, power(sin({q}), 2) + cos({b1}) * cos({b2})"
        f" * power(sin(radians(({lon2}) - ({lon1})) / 2), 2))"
    )
    s = f"(2 * asin(sqrt({h})))"
    x = f"({s} - sin({s})) * power(sin({p}) * cos({q}), 2) / greatest(1e-12, 1 - {h})"
    y = f"({s} + sin({s})) * power(cos({p}) * sin({q}), 2) / greatest(1e-300, {h})"
    return f"(6378137::double * ({s} - {f} / 2 * ({x} + {y})))"


def jd(ts: str) -> str:
    return f"(epoch_us({ts}) / 86400e6 + 2440587.5::double)"


def gmst(ts: str) -> str:
    d = f"({jd(ts)} - 2451545)"
    t = f"({d} / 36525)"
    return mod360(
        f"280.46061837::double + 360.98564736629::double * {d} + 0.000387933::double * {t} * {t}"
        f" - {t} * {t} * {t} / 38710000"
    )


def hour_angle(ra, lon, ts) -> str:
    return f"radians({mod360(mod360(gmst(ts) + ' + ' + lon) + ' - ' + ra)})"


def altitude(ra, dec, lat, ha: str) -> str:
    """``ha`` in radians."""
    return (
        f"degrees(asin(greatest(-1, least(1, sin(radians({dec})) * sin(radians({lat}))"
        f" + cos(radians({dec})) * cos(radians({lat})) * cos({ha})))))"
    )


def _series(rows, fn) -> str:
    names = ("d", "m", "mp", "f")
    out = []
    for coef, *mult in rows:
        angle = " + ".join(f"({n}) * {a}" for n, a in zip(mult, names, strict=True) if n)
        out.append(f"({coef}::double) * {fn}(radians({angle}))")
    return " + ".join(out)


def moon_cte(src: str, ts: str = "captured_at_utc") -> str:
    """CTEs ``m3``: every row of ``src`` with Sun and Moon columns."""
    (d0, d1), (m0, m1), (p0, p1), (f0, f1) = sky.MOON_ARGUMENTS
    l0, l1 = sky.MOON_MEAN_LONGITUDE
    return f"""
    m0 as (select *, ({jd(ts)} - 2451545) / 36525 as t from {src} where {ts} is not null),
    m1 as (select *, {d0}::double + {d1}::double * t as d, {m0}::double + {m1}::double * t as m,
      {p0}::double + {p1}::double * t as mp, {f0}::double + {f1}::double * t as f,
      23.439291::double - 0.0130042::double * t - 1.64e-7 * t * t + 5.04e-7 * t * t * t as eps,
      357.52911::double + 35999.05029::double * t - 0.0001537::double * t * t as sm,
      0.016708634::double - 0.000042037::double * t as se from m0),
    m2 as (select *, {mod360(f"{l0}::double + {l1}::double * t + " + _series(sky.MOON_LONGITUDE, "sin"))} as mlon,
      {_series(sky.MOON_LATITUDE, "sin")} as mlat,
      {sky.MOON_MEAN_DISTANCE_KM}::double + {_series(sky.MOON_DISTANCE, "cos")} as mdist,
      (1.914602::double - 0.004817::double * t - 0.000014::double * t * t) * sin(radians(sm))
       + (0.019993::double - 0.000101::double * t) * sin(radians(2 * sm))
       + 0.000289::double * sin(radians(3 * sm)) as sc from m1),
    m3 as (select *, {mod360("280.46646::double + 36000.76983::double * t + 0.0003032::double * t * t + sc")} as slon,
      1.000001018::double * (1 - se * se) / (1 + se * cos(radians(sm + sc))) as sr from m2),
    m4 as (select *, acos(greatest(-1, least(1, cos(radians(mlat)) * cos(radians(mlon - slon))))) as el,
      {mod360("degrees(atan2(sin(radians(mlon)) * cos(radians(eps)) - tan(radians(mlat)) * sin(radians(eps)), cos(radians(mlon))))")} as mra,
      degrees(asin(greatest(-1, least(1, sin(radians(mlat)) * cos(radians(eps))
        + cos(radians(mlat)) * sin(radians(eps)) * sin(radians(mlon)))))) as mdec from m3),
    m5 as (select *, atan2(sr * sin(el), mdist / {sky.AU_KM}::double - sr * cos(el)) as ph from m4),
    moon as (select *, (1 + cos(ph)) / 2 as illum from m5)"""


def airmass_sql(h: str, model: str = "pickering") -> str:
    hh = f"least(90, {h})"
    if model == "pickering":
        v = f"1 / sin(radians({hh} + 244 / (165 + 47 * power({hh}, 1.1::double))))"
    else:
        v = f"1 / (sin(radians({hh})) + 0.50572::double * power({hh} + 6.07995::double, -1.6364::double))"
    return f"case when {h} > 0 then {v} end"


def clamp(x: str) -> str:
    return f"least(1::double, greatest(0::double, {x}))"


def quality_sql(fwhm, ecc, snr, stars, airmass, illum, sep, bortle) -> tuple[str, str, dict]:
    """(score, missing list text, sub-score texts)."""
    q = {
        "fwhm": (fwhm, "0.30", clamp(f"(8 - {fwhm}) / 6.5::double")),
        "snr": (snr, "0.22", f"case when {snr} <= 3 then 0 else {clamp(f'log10({snr} / 3::double) / log10(100 / 3::double)')} end"),
        "airmass": (airmass, "0.12", f"case when {airmass} >= 5 then 0 else {clamp(f'exp(-0.35::double * (greatest(1, {airmass}) - 1))')} end"),
        "eccentricity": (ecc, "0.10", clamp(f"1 - {ecc} / 0.6::double")),
        "moon": (illum, "0.10", clamp(f"1 - {clamp(illum)} * case when {sep} is null then 1 else {clamp(f'(90 - {sep}) / 75::double')} end")),
        "star_count": (stars, "0.08", f"case when {stars} <= 0 then 0 else {clamp(f'log10(1::double + {stars}) / log10(2001::double)')} end"),
        "bortle": (bortle, "0.08", clamp(f"(9 - {bortle}) / 8::double")),
    }
    num = " + ".join(f"coalesce({w}::double * case when {v} is not null then {s} end, 0)" for v, w, s in q.values())
    den = " + ".join(f"case when {v} is null then 0 else {w}::double end" for v, w, _ in q.values())
    score = f"case when ({den}) <= 0 then 0.5::double else ({num}) / ({den}) end"
    missing = "concat_ws(',', " + ", ".join(f"case when {v} is null then '{k}' end" for k, (v, _, _) in q.items()) + ")"
    subs = {k: f"case when {v} is not null then {s} end" for k, (v, _, s) in q.items()}
    return score, missing, subs
