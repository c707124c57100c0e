"""Queries over single frames: pixels, calibration, geometry, detection and background."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from lumenfield.functions import photometry as P
from lumenfield.functions import wcs
from lumenfield.operators import background, cosmic, detect, kernels, pixels as px
from lumenfield.plans.checks import s6, vincenty
from lumenfield.plans.registry import check, query, r6, round_all

c = F.col
FR = ["stack_id", "frame_id"]
GOOD = "value is not null and not is_masked and not is_saturated"


@query("usable_pixels", "P20", check("pixels", f"select stack_id, frame_id, x, y, {GOOD} as is_good from pixels"))
def usable_pixels(t):
    return px.usable(t.pixels).select(*FR, "x", "y", "is_good")


@query("pixel_rows", "S6", check("pixels", """select r.stack_id, r.frame_id, r.y, r.x, p.value from (select stack_id, frame_id, y, unnest(range(m + 1)) as x from (select stack_id, frame_id, y, max(x) as m from pixels group by all)) r
 left join pixels p on p.stack_id = r.stack_id and p.frame_id = r.frame_id and p.y = r.y and p.x = r.x"""))
def pixel_rows(t):
    d = px.rows_from_arrays(px.arrays_from_rows(t.pixels))
    return d.select(*FR, "y", c("x").cast("bigint").alias("x"), "value")


@query("bayer_green_plane", "S13", check("pixels", f"""select stack_id, frame_id, x // 2 as x, y // 2 as y, {s6('avg(value) filter ((x + y) % 2 = 1)')} as value, '1,0;0,1' as offsets
 from pixels group by stack_id, frame_id, x // 2, y // 2 having count(*) = 4"""))
def bayer_green_plane(t):
    codes = {(0, 0): 0, (1, 0): 1, (0, 1): 1, (1, 1): 2}
    d = px.bayer_plane(t.pixels, codes, (1,))
    return round_all(d).select(*FR, "x", "y", "value", "offsets")


@query("luminance_channel", "S14", check("pixels", f"""select stack_id, x, y, {s6('avg(value)')} as value from pixels where frame_id <= 3 group by all"""))
def luminance_channel(t):
    d = t.pixels.withColumn("channel", F.get(F.array(F.lit("N"), F.lit("R"), F.lit("G"), F.lit("B")), c("frame_id").cast("int")))
    return round_all(px.select_channel(d, "L"))


@query("poisson_variance", "F24", check("pixels frames", f"""
select stack_id, frame_id, x, y, {s6('case when g is not null then greatest(value, 0) / g + power(read_noise_e / g, 2) else power(rms, 2) * (1 + greatest(value - med, 0) / greatest(med, 1e-6)) end')} as variance
from (select *, case when (stack_id + frame_id) % 3 <> 0 then gain_e_per_adu end as g from pixels join frames using (stack_id, frame_id)) p
 left join (select stack_id, frame_id, any_value(med) as med, 1.4826::double * median(abs(value - med)) as rms from (select *, median(value) over (partition by stack_id, frame_id) as med from pixels) group by all) b using (stack_id, frame_id)"""))
def poisson_variance(t):
    f = t.frames.withColumn("gain_e_per_adu", F.when((c("stack_id") + c("frame_id")) % 3 != 0, c("gain_e_per_adu")))
    d = px.with_variance(t.pixels, f)
    return d.select(*FR, "x", "y", r6("model_variance").alias("variance"))


_SRGB = "case when u <= 0.04045 then u / 12.92::double else power((u + 0.055::double) / 1.055::double, 2.4::double) end"


@query("linearised_tone", "F25", check("pixels", f"""select stack_id, frame_id, x, y, {s6(_SRGB)} as lin, {s6(f'power({_SRGB}, 1.8::double)')} as undone from (select *, least(1, value / 1000) as u from pixels)"""))
def linearised_tone(t):
    lin = P.srgb_to_linear(c("value") / 1000.0)
    return t.pixels.select(*FR, "x", "y", r6(lin).alias("lin"), r6(P.power_curve(lin, F.lit(1.8))).alias("undone"))


@query("asinh_display", "F26", check("pixels", f"""select stack_id, frame_id, x, y, {s6('asinh(least(1, greatest(0, (value - lo) / (hi - lo))) / 0.02::double) / asinh(50::double)')} as display
 from pixels join (select stack_id, frame_id, quantile_cont(value, 0.25) as lo, quantile_cont(value, 0.9985) as hi from pixels group by all) using (stack_id, frame_id)"""))
def asinh_display(t):
    return px.stretch(t.pixels).select(*FR, "x", "y", r6("display").alias("display"))


@query("pixel_confidence", "F32 F39", check("pixels frames", f"""select stack_id, frame_id, x, y, {s6('greatest(coalesce(case when x % 5 <> 0 then variance end, noise_sigma * noise_sigma), 1e-12)')} as variance,
 {s6('least(1, greatest(0, (990 - value) / 247.5::double)) * least(1, greatest(0, value / noise_sigma))')} as tapered, {s6('least(1, greatest(0, value / noise_sigma))')} as unsaturated from pixels join frames using (stack_id, frame_id)"""))
def pixel_confidence(t):
    d = t.pixels.join(t.frames.select(*FR, "noise_sigma"), FR)
    var = P.effective_variance(F.when(c("x") % 5 != 0, c("variance")), c("noise_sigma"))
    return d.select(*FR, "x", "y", r6(var).alias("variance"), r6(P.confidence(c("value"), c("noise_sigma"), F.lit(990.0))).alias("tapered"),
        r6(P.confidence(c("value"), c("noise_sigma"), F.lit(None).cast("double"))).alias("unsaturated"))


_W = {"inverse-variance": "1 / power(noise_sigma, 2)", "transparency-variance": "case when photometrically_unreliable then 1 else transparency end / power(noise_sigma, 2)", "exposure": "exposure_seconds", "uniform": "1::double"}


@query("frame_weights", "A17", check("frames", " union all ".join(f"select stack_id, frame_id, '{k}' as scheme, {s6(f'({v}) / sum({v}) over (partition by stack_id)')} as weight from frames" for k, v in _W.items())))
def frame_weights(t):
    parts = [px.frame_weights(t.frames, k).select(*FR, F.lit(k).alias("scheme"), r6("weight").alias("weight")) for k in _W]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("robust_sigma", "A28", check("pixels", f"""select stack_id, frame_id, {s6(f'1.4826::double * median(abs(value - med)) / 0.89325736754014::double')} as sigma from (select *, median(value) over (partition by stack_id, frame_id) as med
 from (select *, quantile_cont(value, 0.9) over (partition by stack_id, frame_id) as cut from pixels) where value <= cut) group by all"""))
def robust_sigma(t):
    return round_all(px.robust_sigma(t.pixels, FR))


@query("frame_statistics", "A29 A51", check("pixels", f"""select stack_id, frame_id, {s6('any_value(med)')} as background, {s6('any_value(noise)')} as noise, {s6('case when any_value(noise) > 0 then greatest(0, (quantile_cont(value, 0.999) - any_value(med)) / any_value(noise)) end')} as snr,
 count(*) filter (value > med + 5 * noise) as bright_pixels, {s6('min(value)')} as min_value, {s6('max(value)')} as max_value, count(*) filter (is_saturated) as saturated_pixels
 from (select *, 1.4826::double * median(abs(value - med)) over (partition by stack_id, frame_id) as noise from (select *, median(value) over (partition by stack_id, frame_id) as med from pixels)) group by all"""))
def frame_statistics(t):
    return round_all(px.frame_statistics(t.pixels))


def _kinds(t):
    names = F.array(*[F.lit(k) for k in ("", "bias", "bias", "dark", "dark", "flat", "flat", "flat")])
    d = t.pixels.withColumn("kind", F.get(names, c("frame_id").cast("int")))
    return d.withColumn("value", F.when(c("kind") == "bias", c("value") / 100).otherwise(c("value")))


def _clip_sql(src, keys, n=3):
    out, cur = [], src
    for i in range(n):
        out.append(f"""k{i} as (select * exclude (med, dev, keep, any_kept) from (select *, bool_or(keep) over (partition by {keys}) as any_kept from (select *, dev <= 0 or abs(value - med) <= 3 * dev as keep
          from (select *, 1.4826::double * median(abs(value - med)) over (partition by {keys}) as dev from (select *, median(value) over (partition by {keys}) as med from {cur})))) where keep or not any_kept)""")
        cur = f"k{i}"
    return ", ".join(out), cur


_CLIP, _LAST = _clip_sql("kinds", "stack_id, kind, x, y")
_MASTER = f"""kinds as (select stack_id, x, y, kind, case when kind = 'bias' then value / 100 else value end as value from (select *, case when frame_id <= 2 then 'bias' when frame_id <= 4 then 'dark' else 'flat' end as kind from pixels)),
 {_CLIP}, m0 as (select stack_id, x, y, median(value) filter (kind = 'bias') as bias, median(value) filter (kind = 'dark') as rdark, median(value) filter (kind = 'flat') as rflat from {_LAST} group by all),
 m1 as (select *, rdark - coalesce(bias, 0) as dark, rflat - coalesce(bias, 0) as f from m0),
 m2 as (select *, median(dark) over (partition by stack_id) as med, median(f) filter (f > 0) over (partition by stack_id) as norm from m1),
 master as (select stack_id, x, y, bias, dark, f / norm as flat, coalesce(dev > 0 and abs(dark - med) > 2 * dev, false) as is_bad from (select *, 1.4826::double * median(abs(dark - med)) over (partition by stack_id) as dev from m2))"""


@query("calibration_masters", "A22", check("pixels", f"select stack_id, x, y, {s6('bias')} as bias, {s6('dark')} as dark, {s6('flat')} as flat, is_bad from master", _MASTER))
def calibration_masters(t):
    return round_all(px.masters(_kinds(t), bad_pixel_sigma=2.0))


@query("calibrated_pixels", "J16", check("pixels frames", f"""select stack_id, frame_id, x, y, {s6('(value - coalesce(bias, 0) - coalesce(dark * exposure_seconds / 120, 0)) / safe')} as value, {s6('variance / (safe * safe)')} as variance,
 is_masked or coalesce(flat < 0.5, false) or coalesce(is_bad, false) as is_masked from (select *, case when flat is null or flat < 0.5 then 1 else flat end as safe from pixels left join master using (stack_id, x, y) join frames using (stack_id, frame_id))""", _MASTER))
def calibrated_pixels(t):
    d = px.calibrate(t.pixels, px.masters(_kinds(t), bad_pixel_sigma=2.0), t.frames, 120.0, 0.5)
    return round_all(d.select(*FR, "x", "y", "value", "variance", "is_masked"))


# --- kernels and geometry ----------------------------------------------------------------------------
_SIG = "fwhm_px / (2 * sqrt(2 * ln(2)))"
_ALPHA = "fwhm_px / (2 * sqrt(power(2::double, 1 / 3.5::double) - 1))"
_KER = f"""off as (select unnest(range(-60, 61)) as v), ker as (select stack_id, frame_id, a.v as dx, b.v as dy, exp(-0.5::double * (power(a.v / (sg / sqrt(ra)), 2) + power(b.v / (sg * sqrt(ra)), 2))) as g
   from (select *, {_SIG} as sg, sqrt(1 - power(coalesce(psf_eccentricity, 0), 2)) as ra from frames), off a, off b where greatest(abs(a.v), abs(b.v)) <= greatest(1, ceil(4 * sg)))"""
_KMOF = f"""kmof as (select stack_id, frame_id, a.v as dx, b.v as dy, power(1 + (a.v * a.v + b.v * b.v) / power(al, 2), -3.5::double) as m
   from (select *, {_ALPHA} as al from frames), off a, off b where greatest(abs(a.v), abs(b.v)) <= greatest(1, ceil(4 * al)))"""


@query("psf_kernels", "F29", check("frames", f"""select stack_id, frame_id, dx, dy, {s6('g')} as gaussian, {s6('m')} as moffat from (select stack_id, frame_id, dx, dy, m / sum(m) over w as m from kmof window w as (partition by stack_id, frame_id))
 left join (select stack_id, frame_id, dx, dy, g / sum(g) over w as g from ker window w as (partition by stack_id, frame_id)) using (stack_id, frame_id, dx, dy)""", _KER + ", " + _KMOF))
def psf_kernels(t):
    g = kernels.gaussian(t.frames).withColumnRenamed("w", "gaussian")
    m = kernels.moffat(t.frames, 3.5).withColumnRenamed("w", "moffat")
    d = m.join(g, [*FR, "dx", "dy"], "left")
    return d.select(*FR, c("dx").cast("bigint").alias("dx"), c("dy").cast("bigint").alias("dy"), r6("gaussian").alias("gaussian"), r6("moffat").alias("moffat"))


@query("kernel_widths", "A42", check("frames", f"select stack_id, frame_id, {s6('sqrt(2 * ln(2) / pi()) / (sqrt(sum(g * g)) / sum(g))')} as width from ker group by all", _KER))
def kernel_widths(t):
    return round_all(kernels.noise_equivalent_width(kernels.gaussian(t.frames), FR))


@query("source_shapes", "F30 F31", check("sources", f"""select source_id, {s6('2 * sqrt(2 * ln(2)) * sqrt(greatest(a * b, 1e-12))')} as fwhm, {s6('sqrt(greatest(1 - power(least(1, greatest(0, b / greatest(a, 1e-12))), 2), 0))')} as eccentricity,
 {s6('-2.5::double * log10(greatest(flux, 1e-30))')} as magnitude from sources"""))
def source_shapes(t):
    d = detect.with_shape(t.sources)
    return d.select("source_id", r6("fwhm").alias("fwhm"), r6("eccentricity").alias("eccentricity"), r6(P.instrumental_magnitude(c("flux"))).alias("magnitude"))


@query("brightest_sources", "W11", check("sources", "select stack_id, frame_id, source_id, n::bigint as rank from (select *, row_number() over (partition by stack_id, frame_id order by flux desc, source_id) as n from sources) where n <= 50"))
def brightest_sources(t):
    return detect.brightest(t.sources, 50).select(*FR, "source_id", c("rank").cast("bigint").alias("rank"))


def sky_sql(x, y):
    """(ra, dec) text for pixel (x, y) of a frames row."""
    s = "(scale_arcsec / 3600)"
    r = "radians(rotation_deg)"
    dx, dy = f"({x} - (crpix_x - 1))", f"({y} - (crpix_y - 1))"
    xi = f"radians(-{s} * cos({r}) * {dx} - {s} * sin({r}) * {dy})"
    eta = f"radians(-{s} * sin({r}) * {dx} + {s} * cos({r}) * {dy})"
    d0 = "radians(crval_dec)"
    den = f"(cos({d0}) - {eta} * sin({d0}))"
    ra = f"(crval_ra + degrees(atan2({xi}, {den})))"
    return f"({ra} - floor({ra} / 360) * 360)", f"degrees(atan2(sin({d0}) + {eta} * cos({d0}), sqrt(power({xi}, 2) + power({den}, 2))))"


def pixel_sql(ra, dec, ra0, dec0, scale, px0, py0, rot="0::double"):
    """(x, y) text of a sky position on a grid."""
    d, d0, e = f"radians({ra} - {ra0})", f"radians({dec0})", f"radians({dec})"
    w = f"(sin({e}) * sin({d0}) + cos({e}) * cos({d0}) * cos({d}))"
    xi = f"(degrees(cos({e}) * sin({d}) / {w}) / ({scale} / 3600))"
    eta = f"(degrees((sin({e}) * cos({d0}) - cos({e}) * sin({d0}) * cos({d})) / {w}) / ({scale} / 3600))"
    r = f"radians({rot})"
    return f"({px0} - cos({r}) * {xi} - sin({r}) * {eta})", f"({py0} - sin({r}) * {xi} + cos({r}) * {eta})"


_RA, _DEC = sky_sql("x", "y")


@query("pixel_sky_positions", "F27", check("pixels frames", f"""select stack_id, frame_id, x, y, {s6('ra')} as ra_deg, {s6('dec')} as dec_deg, {s6(pixel_sql('ra', 'dec', 'crval_ra', 'crval_dec', '1::double', '100::double', '100::double')[0])} as out_x,
 {s6(pixel_sql('ra', 'dec', 'crval_ra', 'crval_dec', '1::double', '100::double', '100::double')[1])} as out_y from (select *, {_RA} as ra, {_DEC} as dec from pixels join frames using (stack_id, frame_id))"""))
def pixel_sky_positions(t):
    d = t.pixels.join(t.frames, FR)
    ra, dec = wcs.pixel_to_sky(wcs.frame_grid(), c("x"), c("y"))
    out = wcs.tangent_grid(c("crval_ra"), c("crval_dec"), F.lit(1.0), F.lit(100.0), F.lit(100.0))
    d = d.withColumns(wcs.homography(wcs.frame_grid(), out))
    ox, oy = wcs.apply_map(c("x"), c("y"))
    return d.select(*FR, "x", "y", r6(ra).alias("ra_deg"), r6(dec).alias("dec_deg"), r6(ox).alias("out_x"), r6(oy).alias("out_y"))


_CRA, _CDEC = sky_sql("(width / 2 - 0.5::double)", "(height / 2 - 0.5::double)")
_ZRA, _ZDEC = sky_sql("0::double", "0::double")
_ARA, _ADEC = sky_sql("(0.99::double * width / 2 + 0.01::double * height / 2 + 1.5::double)", "(-0.01::double * width / 2 + 0.99::double * height / 2 - 0.5::double)")


@query("wcs_summary", "F28", check("frames", f"""select stack_id, frame_id, {s6(_CRA)} as ra_deg, {s6(_CDEC)} as dec_deg, {s6('scale_arcsec')} as pixel_scale_arcsec, {s6('degrees(atan2(-sin(radians(rotation_deg)), cos(radians(rotation_deg))))')} as orientation_deg,
 -1::bigint as parity, {s6(vincenty(_CRA, _CDEC, _ZRA, _ZDEC))} as field_radius_deg, {s6(_ARA)} as affine_ra_deg, {s6(_ADEC)} as affine_dec_deg from frames"""))
def wcs_summary(t):
    g = wcs.frame_grid()
    info = wcs.describe(g, c("width"), c("height"))
    m = {k: F.lit(v) for k, v in {"a": 0.99, "b": 0.01, "tx": 1.5, "c": -0.01, "d": 0.99, "ty": -0.5}.items()}
    moved = wcs.affine_grid(g, m, c("width"), c("height"))
    cols = [r6(v).alias(k) if k != "parity" else v.cast("bigint").alias(k) for k, v in info.items()]
    return t.frames.select(*FR, *cols, r6(moved["ra"]).alias("affine_ra_deg"), r6(moved["dec"]).alias("affine_dec_deg"))


# --- detection ---------------------------------------------------------------------------------------
_SRC = f"""gp as (select *, median(value) over (partition by stack_id, frame_id) as med from pixels where {GOOD}),
 th as (select * from (select *, value - med as v, 1.4826::double * median(abs(value - med)) over (partition by stack_id, frame_id) as rms from gp) where v > 1.2::double * rms),
 conn as (select stack_id, frame_id, x, y, y * 100000 + x as lab from th union
   select t.stack_id, t.frame_id, t.x, t.y, c.lab from conn c join th t on t.stack_id = c.stack_id and t.frame_id = c.frame_id and abs(t.x - c.x) <= 1 and abs(t.y - c.y) <= 1),
 lab as (select stack_id, frame_id, x, y, min(lab) as lab from conn group by all),
 mom as (select stack_id, frame_id, lab, count(*) as npix, sum(v) as flux, max(v) as peak, sum(v * x) / sum(v) as cx, sum(v * y) / sum(v) as cy, sum(v * x * x) / sum(v) - power(sum(v * x) / sum(v), 2) as cxx,
   sum(v * y * y) / sum(v) - power(sum(v * y) / sum(v), 2) as cyy, sum(v * x * y) / sum(v) - sum(v * x) / sum(v) * (sum(v * y) / sum(v)) as cxy, any_value(rms) as rms from th join lab using (stack_id, frame_id, x, y) group by all having count(*) >= 5)"""


@query("detected_sources", "X2", check("pixels", f"""select stack_id, frame_id, npix, {s6('flux')} as flux, {s6('peak')} as peak, {s6('cx')} as x, {s6('cy')} as y,
 {s6('sqrt((cxx + cyy) / 2 + sqrt(power((cxx - cyy) / 2, 2) + cxy * cxy))')} as a, {s6('sqrt(greatest((cxx + cyy) / 2 - sqrt(power((cxx - cyy) / 2, 2) + cxy * cxy), 0))')} as b, {s6('rms')} as background_rms from mom""", _SRC))
def detected_sources(t):
    d = detect.detect_sources(t.pixels, threshold=1.2, min_area=5, tile=8)
    return round_all(d.drop("label", "theta"))


_SHAPE = """shp as (select *, 2 * sqrt(2 * ln(2)) * sqrt(greatest(a * b, 1e-12)) as fw, sqrt(greatest(1 - power(least(1, b / a), 2), 0)) as ec, least(2, floor(x / 24 * 3))::bigint as cell_x, least(2, floor(y / 24 * 3))::bigint as cell_y from sources),
 fm as (select stack_id, frame_id, cell_x, cell_y, count(*) as n, median(fw) as fwhm, median(ec) as eccentricity, atan2(median(sin(2 * theta)), median(cos(2 * theta))) / 2 as theta from shp group by all having count(*) >= 3)"""


@query("psf_field_maps", "A38", check("sources", f"select stack_id, frame_id, cell_x, cell_y, n, {s6('fwhm')} as fwhm, {s6('eccentricity')} as eccentricity, {s6('theta')} as theta from fm", _SHAPE))
def psf_field_maps(t):
    d = detect.field_maps(t.sources, t.frames)
    return round_all(d.withColumns({"cell_x": c("cell_x").cast("bigint"), "cell_y": c("cell_y").cast("bigint")}))


@query("frame_characterisation", "A39", check("sources frames", f"""select stack_id, frame_id, count(*) as star_count, {s6('coalesce(median(fw) filter (ok), median(fw))')} as fwhm, {s6('coalesce(median(ec) filter (ok), 0)')} as eccentricity,
 {s6('coalesce(atan2(median(sin(2 * theta)) filter (ok), median(cos(2 * theta)) filter (ok)) / 2, 0)')} as theta, coalesce(any_value(vary), false) as is_field_varying from (select s.*, fw > 0.5 and fw < 6 as ok, vary from shp s
 left join (select stack_id, frame_id, count(*) >= 4 and stddev_pop(fwhm) / avg(fwhm) > 0.15 as vary from fm group by all) using (stack_id, frame_id)) group by all""", _SHAPE))
def frame_characterisation(t):
    return round_all(detect.characterise(t.sources, t.frames))


@query("mixed_psf_stacks", "A39", check("frames", "select stack_id, count(distinct frame_id % (1 + stack_id % 2)) > 1 as is_mixed from frames group by 1"))
def mixed_psf_stacks(t):
    return detect.mixed_psf_sources(t.frames.withColumn("psf_source", c("frame_id") % (1 + c("stack_id") % 2)))


@query("cosmic_ray_flags", "X4 W8")
def cosmic_ray_flags(t):
    return cosmic.cosmic_rays(t.pixels, t.frames, clip=1.0, contrast=1.0, tile=16)


# --- background ---------------------------------------------------------------------------------------
def _spline_sql(cells):
    """Rows (n, i, k, g): the weight of value k in spline coefficient i of n mirrored cells."""
    out = []
    for n in cells:
        a = np.diag([4.0] * n) + np.diag([1.0] * (n - 1), 1) + np.diag([1.0] * (n - 1), -1)
        a[0, 0] = a[-1, -1] = 5
        out += [f"({n}, {i}, {k}, {v!r}::double)" for (i, k), v in zip(np.ndindex(n, n), np.linalg.inv(a / 6).ravel().tolist(), strict=True)]
    return f"(values {', '.join(out)}) g(n, i, k, g)"


def _mesh_sql(source):
    k = "stack_id, frame_id, cx, cy"
    b = "least(256, greatest(16, greatest(w, h) // 8))"
    steps = [f"px as materialized ({source})"]
    steps.append(f"sz as (select *, (w + box - 1) // box as nx, (h + box - 1) // box as ny from (select *, case when least(w, h) < 3 * {b} then greatest(8, least(w, h) // 3) else {b} end as box from (select stack_id, frame_id, max(x) + 1 as w, max(y) + 1 as h from px group by all)))")
    steps.append(f"b0 as (select *, x // box as cx, y // box as cy from px join sz using (stack_id, frame_id) where least(w, h) >= 24 and {GOOD})")
    cur = "b0"
    for i in range(1, 6):
        steps.append(f"b{i} as (select * exclude (m, s) from (select *, median(value) over w as m, stddev_pop(value) over w as s from {cur} window w as (partition by {k})) where abs(value - m) <= 3 * s)")
        cur = f"b{i}"
    steps.append(f"ms as (select {k}, any_value(m) as level, 1.4826::double * median(abs(value - m)) as rms from (select *, median(value) over (partition by {k}) as m from {cur}) group by all)")
    steps.append("sm as (select a.stack_id, a.frame_id, a.cx, a.cy, median(b.level) as level, median(b.rms) as rms from ms a join ms b on a.stack_id = b.stack_id and a.frame_id = b.frame_id and abs(a.cx - b.cx) <= 1 and abs(a.cy - b.cy) <= 1 group by all)")
    g = _spline_sql((3, 5))
    steps.append(f"co as (select stack_id, frame_id, gx.i as cx, gy.i as cy, sum(gx.g * gy.g * level) as level, sum(gx.g * gy.g * rms) as rms from sm join sz using (stack_id, frame_id) join {g.replace('g(n', 'gx(n')} on gx.n = nx and gx.k = cx join {g.replace('g(n', 'gy(n')} on gy.n = ny and gy.k = cy group by all)")
    steps.append("lim as (select stack_id, frame_id, min(level) as l0, max(level) as l1, min(rms) as r0, max(rms) as r1 from sm group by all)")
    mirror = lambda q, n: f"case when {q} < 0 then -1 - ({q}) when {q} >= {n} then 2 * {n} - 1 - ({q}) else {q} end"
    bump = lambda t: f"case when abs({t}) < 1 then 2 / 3::double - power({t}, 2) + power(abs({t}), 3) / 2 else power(2 - abs({t}), 3) / 6 end"
    steps.append("uv as (select stack_id, frame_id, x, y, value, nx, ny, (x + 0.5::double) / box - 0.5::double as u, (y + 0.5::double) / box - 0.5::double as v from px join sz using (stack_id, frame_id) where least(w, h) >= 24)")
    steps.append(f"taps as (select stack_id, frame_id, x, y, value, {mirror('floor(u) + i', 'nx')} as cx, {mirror('floor(v) + j', 'ny')} as cy, ({bump('(u - floor(u) - i)')}) * ({bump('(v - floor(v) - j)')}) as weight from uv, range(-1, 3) a(i), range(-1, 3) b(j))")
    steps.append("cub as (select stack_id, frame_id, x, y, any_value(value) as value, sum(weight * level) as l, sum(weight * rms) as r from taps join co using (stack_id, frame_id, cx, cy) group by all)")
    steps.append("med as (select stack_id, frame_id, any_value(m) as m, greatest(1.4826::double * median(abs(value - m)), 1e-6) as r from (select *, median(value) over (partition by stack_id, frame_id) as m from px join sz using (stack_id, frame_id) where least(w, h) < 24 and " + GOOD + ") group by all)")
    steps.append("bg as (select stack_id, frame_id, x, y, value, least(l1, greatest(l0, l)) as background, greatest(least(r1, greatest(r0, r)), 1e-6) as background_rms from cub join lim using (stack_id, frame_id) union all select stack_id, frame_id, x, y, value, m, r from px join med using (stack_id, frame_id))")
    return ", ".join(steps)


_BG = _mesh_sql("select * from pixels")
_MIXED = _mesh_sql("""select stack_id, 1 as frame_id, x + 24 * ((frame_id - 1) % 2) as x, y + 24 * ((frame_id - 1) // 2) as y, value, is_masked, is_saturated from pixels where frame_id <= 6
 union all select stack_id, 2, x, y, value, is_masked, is_saturated from pixels where frame_id = 7 and x < 20 and y < 22 union all select stack_id, 3, x, y, value, is_masked, is_saturated from pixels where frame_id = 7""")


@query("background_mesh", "A27 W8", check("pixels", f"select stack_id, frame_id, cx, cy, {s6('level')} as level, {s6('rms')} as rms from sm", _BG))
def background_mesh(t):
    return round_all(background.smooth_mesh(background.mesh(t.pixels, 8)))


@query("background_subtracted", "A27", check("pixels", f"select stack_id, frame_id, x, y, {s6('value - background')} as value, {s6('background_rms')} as background_rms from bg", _BG))
def background_subtracted(t):
    d = background.subtract(t.pixels)
    return round_all(d.select(*FR, "x", "y", "value", "background_rms"))


@query("background_mixed_sizes", "A27", check("pixels", f"select stack_id, frame_id, x, y, {s6('background')} as background, {s6('background_rms')} as background_rms from bg", _MIXED))
def background_mixed_sizes(t):
    """Mosaics of six frames, corners too small for a mesh, and single frames, in one call."""
    six = t.pixels.where("frame_id <= 6").withColumns({"x": c("x") + 24 * ((c("frame_id") - 1) % 2), "y": c("y") + 24 * F.floor((c("frame_id") - 1) / 2)})
    last = t.pixels.where("frame_id = 7")
    parts = [d.withColumn("frame_id", F.lit(i).cast("bigint")) for i, d in enumerate((six, last.where("x < 20 and y < 22"), last), 1)]
    d = background.subtract(parts[0].unionByName(parts[1]).unionByName(parts[2]))
    return round_all(d.select(*FR, "x", "y", "background", "background_rms"))


@query("background_report", "A27", check("pixels", f"select stack_id, frame_id, {s6('median(background)')} as level, {s6('median(background_rms)')} as rms, {s6('max(background) - min(background)')} as gradient from bg group by all", _BG))
def background_report(t):
    return round_all(background.background_report(background.subtract(t.pixels)))
