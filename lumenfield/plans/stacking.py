"""Queries over stacks: rejection, coadds, drizzle, optimal coadd and HDR."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenfield.operators import drizzle, fourier, hdr, kernels, pixels as px, stack
from lumenfield.sources import tables
from lumenfield.plans.checks import s1, s3, s6
from lumenfield.plans.image import _KER, pixel_sql, sky_sql
from lumenfield.plans.registry import check, query, r1, r3, r6, round_all

c = F.col
FR = ["stack_id", "frame_id"]
CELL = ["stack_id", "x", "y"]
GOOD = "value is not null and not is_masked and not is_saturated"
MADC = "case depth when 1 then 1 when 2 then 1.196 when 3 then 1.495 when 4 then 1.363 when 5 then 1.206 when 6 then 1.2 when 7 then 1.14 when 8 then 1.129 when 9 then 1.107 else depth / (depth - 0.8) end::double"
_BASE = f"""dep as (select stack_id, count(*) as depth from frames group by 1), wts as (select stack_id, frame_id, (1 / power(noise_sigma, 2)) / sum(1 / power(noise_sigma, 2)) over (partition by stack_id) as weight from frames),
 p0 as (select p.*, depth, weight, {GOOD} as good, {GOOD} as keep from pixels p join dep using (stack_id) join wts using (stack_id, frame_id))"""


def weighted(t):
    w = px.frame_weights(t.frames)
    return t.pixels.join(w.select(*FR, "weight"), FR)


def clip_sql(src="p0", low=5, high=3, n=3, scale="sqrt(variance)"):
    """CTEs of the unrolled clipping; the last one is ``c{n}`` with ``keep``."""
    out, cur = [], src
    for i in range(1, n + 1):
        spare = "" if scale != "mad" else f""", sc{i} as (select stack_id, x, y, 1.4826::double * {MADC} * mad as scale from (select stack_id, x, y, any_value(depth) as depth, median(abs(value - centre)) filter (keep) as mad from {cur} join ce{i} using (stack_id, x, y) group by all)),
          sp{i} as (select stack_id, x, y, case when scale > 0 then scale else median(scale) filter (scale > 0) over (partition by stack_id) end as scale from sc{i})"""
        est = "scale" if scale == "mad" else scale
        join = f"join sp{i} using (stack_id, x, y)" if scale == "mad" else ""
        out.append(f"""ce{i} as (select stack_id, x, y, coalesce(median(value) filter (keep), 0) as centre from {cur} group by all){spare},
          st{i} as (select a.stack_id, a.x, a.y, any_value(a.centre) as centre, max(abs(a.centre - coalesce(b.centre, 0))) as st from ce{i} a, (values (1, 0), (-1, 0), (0, 1), (0, -1)) o(dx, dy) left join ce{i} b on b.stack_id = a.stack_id and b.x = (a.x + dx + 24) % 24 and b.y = (a.y + dy + 24) % 24 group by all),
          t{i} as (select p.*, keep and value - centre <= {high} * ({est}) * sqrt(1 + pi() / (2 * depth)) + 1.2::double * st and value - centre >= -({low} * ({est}) * sqrt(1 + pi() / (2 * depth)) + 1.2::double * st) as trial from {cur} p join st{i} using (stack_id, x, y) {join}),
          c{i} as (select * exclude (keep, trial, nk), case when nk < least(2, depth) then keep else trial end as keep from (select *, count(*) filter (trial) over (partition by stack_id, x, y) as nk from t{i}))""")
        cur = f"c{i}"
    return ", ".join(out)


@query("pixel_centre_scale", "A18", check("pixels frames", f"""select stack_id, x, y, {s6('centre')} as centre, {s6('case when scale > 0 then scale else coalesce(median(scale) filter (scale > 0) over (partition by stack_id), 1) end')} as scale
 from (select stack_id, x, y, any_value(centre) as centre, 1.4826::double * any_value({MADC}) * median(abs(value - centre)) filter (keep) as scale from (select *, median(value) filter (keep) over (partition by stack_id, x, y) as centre from p0) group by all)""", _BASE))
def pixel_centre_scale(t):
    d = stack.with_robust_scale(stack.with_centre(stack.pixel_columns(t.pixels, t.frames)))
    return d.select(*CELL, r6("centre").alias("centre"), r6("scale").alias("scale"))


_SIG = check("pixels frames", "select stack_id, frame_id, x, y, keep from c3", _BASE + ", " + clip_sql())


@query("sigma_clip", "A19 W4", _SIG)
def sigma_clip(t):
    d = stack.samples(stack.sigma_clip(stack.pixel_columns(t.pixels, t.frames)))
    return d.select(*FR, "x", "y", "keep")


@query("sigma_clip_mad", "A19 A18", check("pixels frames", "select stack_id, frame_id, x, y, keep from c2", _BASE + ", " + clip_sql(low=2, high=2, n=2, scale="mad")))
def sigma_clip_mad(t):
    d = stack.sigma_clip(stack.pixel_columns(t.pixels, t.frames), 2.0, 2.0, 2, use_variance=False)
    return stack.samples(d).select(*FR, "x", "y", "keep")


_PCT = "pc as (select *, good and (value - med) / case when abs(med) > 1e-12 then abs(med) else 1 end between -0.4 and 0.3 as pk from (select *, median(value) filter (good) over (partition by stack_id, x, y) as med from p0))"


@query("percentile_clip", "A20", check("pixels frames", "select stack_id, frame_id, x, y, coalesce(pk, false) as keep from pc", _BASE + ", " + _PCT))
def percentile_clip(t):
    d = stack.samples(stack.percentile_clip(stack.pixel_columns(t.pixels, t.frames)))
    return d.select(*FR, "x", "y", "keep")


def trail_sql(pixels, elongation, length):
    """CTEs from outliers ``po`` to the grown trail pixels ``grow``."""
    return f"""conn as (select stack_id, frame_id, x, y, y * 100000 + x as lab from po union select t.stack_id, t.frame_id, t.x, t.y, c.lab from conn c join po t on t.stack_id = c.stack_id and t.frame_id = c.frame_id and abs(t.x - c.x) <= 1 and abs(t.y - c.y) <= 1),
 lab as (select stack_id, frame_id, x, y, min(lab) as lab from conn group by all),
 comp as (select stack_id, frame_id, lab, count(*) as n, greatest((var_samp(x) + var_samp(y)) / 2 + sqrt(power((var_samp(x) - var_samp(y)) / 2, 2) + power(covar_samp(x, y), 2)), 1e-9) as big,
   greatest((var_samp(x) + var_samp(y)) / 2 - sqrt(power((var_samp(x) - var_samp(y)) / 2, 2) + power(covar_samp(x, y), 2)), 1e-9) as small from lab group by all having count(*) >= {pixels}),
 hit as (select stack_id, frame_id, x, y from lab join comp using (stack_id, frame_id, lab) where sqrt(big / small) >= {elongation} and 4 * sqrt(big) >= {length}),
 grow as (select distinct stack_id, frame_id, x + dx as x, y + dy as y from hit, (select a.v as dx, b.v as dy from range(-2, 3) a(v), range(-2, 3) b(v) where abs(a.v) + abs(b.v) <= 2))"""


_TR = trail_sql(4, 2.05, 4.05)


@query("trail_pixels", "X3", check("pixels frames", "select * from grow", _BASE + ", " + _PCT + ", po as (select stack_id, frame_id, x, y from (select *, median(value) over (partition by stack_id, x, y) as am from pc) where good and not coalesce(pk, false) and value > am), " + _TR))
def trail_pixels(t):
    from lumenfield.operators.detect import trail_pixels as find

    d = stack.combined_rejection(t.pixels, t.frames, method="percentile", trails=False)
    m = stack.pixel_columns(t.pixels, t.frames).select(*CELL, stack.arrays.median(F.transform("s", lambda e: e["value"])).alias("am"))
    out = d.where("clipped").join(m, CELL).where("value > am")
    return find(out, min_length=4.05, min_elongation=2.05, min_pixels=4, tile=8)


_TRAIL = {"min_length": 4.05, "min_elongation": 2.05, "min_pixels": 4, "tile": 8}
_OUT = ", po as (select stack_id, frame_id, x, y from (select *, median(value) over (partition by stack_id, x, y) as am from pc) where good and not coalesce(pk, false) and value > am and depth >= 3), "


@query("combined_rejection", "A21", check("pixels frames", f"""select stack_id, frame_id, count(*) filter (good and not coalesce(pk, false)) as n_clipped, count(*) filter (tr) as n_trail, {s6('avg(rejected::int)')} as rejected_fraction
 from (select *, case when nk < least(2, depth) then not good else rej end as rejected from (select *, count(*) filter (good and not rej) over (partition by stack_id, x, y) as nk
  from (select p.*, g.x is not null as tr, good and (not coalesce(pk, false) or g.x is not null) as rej from pc p left join grow g on g.stack_id = p.stack_id and g.frame_id = p.frame_id and g.x = p.x and g.y = p.y))) group by all""", _BASE + ", " + _PCT + _OUT + _TR))
def combined_rejection(t):
    d = stack.combined_rejection(t.pixels, t.frames, method="percentile", trail_options=_TRAIL)
    return round_all(stack.rejection_report(d))


# a streak of two pixels' width through one frame of each stack, for the default thresholds of trails
_STREAK = "frame_id = 1 + stack_id % 7 and 2 * y - x between 5 and 8"
_STREAKED = f"streaked as (select * replace (value + case when {_STREAK} then 5000::double else 0 end as value) from pixels), " + _BASE.replace("pixels p", "streaked p")
_REJ = f"po as (select stack_id, frame_id, x, y from (select *, median(value) over (partition by stack_id, x, y) as am from c3) where good and not keep and value > am and depth >= 3), {trail_sql(10, 4, 12)}, " + """
 rj as (select p.*, g.x is not null as tr, good and (not keep or g.x is not null) as rej from c3 p left join grow g on g.stack_id = p.stack_id and g.frame_id = p.frame_id and g.x = p.x and g.y = p.y),
 rk as (select *, case when nk < least(2, depth) then not good else rej end as rejected from (select *, count(*) filter (good and not rej) over (partition by stack_id, x, y) as nk from rj))"""


def streaked(t):
    return t.pixels.withColumn("value", c("value") + F.when(F.expr(_STREAK), 5000.0).otherwise(0.0))


@query("rejected_streaks", "A21 X3", check("pixels frames", f"""select stack_id, frame_id, count(*) filter (good and not keep) as n_clipped, count(*) filter (tr) as n_trail, {s6('avg(rejected::int)')} as rejected_fraction from rk group by all""", _STREAKED + ", " + clip_sql() + ", " + _REJ))
def rejected_streaks(t):
    return round_all(stack.rejection_report(stack.combined_rejection(streaked(t), t.frames)))


def _combine_sql(method, base=_BASE):
    clips = method in ("sigma-clip", "winsorized")
    src = "(select * replace (good and not rejected as keep) from rk)" if clips else "p0"
    ctes = base + (", " + clip_sql() + ", " + _REJ if clips else "")
    mid = f"u as (select *, median(value) over (partition by stack_id, x, y) as med from {src} where keep), v as (select *, 1.4826::double * median(abs(value - med)) over (partition by stack_id, x, y) as sc from u)"
    val = "case when sc > 0 then least(med + 2.5 * sc, greatest(med - 2.5 * sc, value)) else value end" if method == "winsorized" else "value"
    image = "any_value(med)" if method == "median" else f"sum(weight * {val}) / sum(weight)"
    infl = "pi() / 2" if method == "median" else "1"
    return check("pixels frames", f"""select a.stack_id, a.x, a.y, {s6('coalesce(image, 0)')} as image, {s6('coalesce(wsum, 0)')} as weight, {s6('coalesce(sigma, 0)')} as sigma, coalesce(n, 0) as n_used from (select distinct stack_id, x, y from p0) a
      left join (select stack_id, x, y, {image} as image, sum(weight) as wsum, sqrt(sum(weight * weight * variance) * {infl}) / sum(weight) as sigma, count(*) as n from v group by all) b on a.stack_id = b.stack_id and a.x = b.x and a.y = b.y""", ctes + ", " + mid)


def _combine(method):
    def run(t):
        d = stack.combine(weighted(t), t.frames, method)
        return round_all(d.withColumn("n_used", c("n_used").cast("bigint")))

    return run


for _m in stack.METHODS:
    query("coadd_" + _m.replace("-", "_"), "A16", _combine_sql(_m))(_combine(_m))


@query("coadd_without_streaks", "A16 X3", _combine_sql("sigma-clip", _STREAKED))
def coadd_without_streaks(t):
    w = px.frame_weights(t.frames)
    d = stack.combine(streaked(t).join(w.select(*FR, "weight"), FR), t.frames)
    return round_all(d.withColumn("n_used", c("n_used").cast("bigint")))


_PLANES = """cw as (select stack_id, x, y, sum(weight * value) / sum(weight) as image, sum(weight) as weight, sqrt(sum(weight * weight * variance)) / sum(weight) as sigma from p0 where keep group by all),
 ca as (select z.stack_id, z.x, z.y, coalesce(image, 0) as image, coalesce(weight, 0) as weight, coalesce(sigma, 0) as sigma from (select distinct stack_id, x, y from p0) z left join cw using (stack_id, x, y)),
 pl as (select stack_id, x, y, 'SCI' as plane, image as value from ca union all select stack_id, x, y, 'WEIGHT', weight from ca union all select stack_id, x, y, 'UNCERT', sigma from ca)"""


@query("result_planes", "S7", check("pixels frames", f"select stack_id, x, y, plane, {s6('value')} as value from pl", _BASE + ", " + _PLANES))
def result_planes(t):
    return round_all(tables.result_planes(stack.combine(weighted(t), t.frames, "mean")))


@query("plane_checksums", "S7 A47", check("pixels frames", """select stack_id, plane, sha256(string_agg(y || ':' || d, ',' order by y)) as digest from (select stack_id, plane, y, sha256(string_agg(x || ':' || floor(value * 1e4 + 0.5001)::bigint, ',' order by x)) as d from pl group by all) group by all""", _BASE + ", " + _PLANES))
def plane_checksums(t):
    return tables.plane_checksums(tables.result_planes(stack.combine(weighted(t), t.frames, "mean")))


@query("filled_pixels", "A25", check("pixels frames", f"""select stack_id, frame_id, x, y, {s6('case when good then value else coalesce(sum(value / variance) filter (good) over w / sum(1 / variance) filter (good) over w, 0) end')} as value from p0 window w as (partition by stack_id, x, y)""", _BASE))
def filled_pixels(t):
    return stack.fill_masked(t.pixels, t.frames).select(*FR, "x", "y", r6("value").alias("value"))


_PSFM = "psfm as (select stack_id, dx, dy, sum(weight * gn) as w from (select *, g / sum(g) over (partition by stack_id, frame_id) as gn from ker) k join wts using (stack_id, frame_id) group by all)"


@query("mean_psf", "A49", check("frames", f"select stack_id, dx, dy, {s6('w / sum(w) over (partition by stack_id)')} as w from psfm", _KER + ", wts as (select stack_id, frame_id, (1 / power(noise_sigma, 2)) / sum(1 / power(noise_sigma, 2)) over (partition by stack_id) as weight from frames), " + _PSFM))
def mean_psf(t):
    d = stack.mean_psf(kernels.gaussian(t.frames), px.frame_weights(t.frames))
    return d.select("stack_id", c("dx").cast("bigint").alias("dx"), c("dy").cast("bigint").alias("dy"), r6("w").alias("w"))


# --- grids and drizzle ----------------------------------------------------------------------------
_CRA, _CDEC = sky_sql("(width / 2::double)", "(height / 2::double)")
_SKX, _SKY = pixel_sql("r.ra", "r.dec", "f.crval_ra", "f.crval_dec", "f.scale_arcsec", "(f.crpix_x - 1)", "(f.crpix_y - 1)", "f.rotation_deg")
_KX, _KY = sky_sql("cx", "cy")
_GX, _GY = pixel_sql("c.ra", "c.dec", "ra0", "dec0", "scale", "8::double", "8::double")
_GRID = f"""sol as (select * from frames where is_solved), rf as (select stack_id, arg_min(ra, frame_id) as ra, arg_min(dec, frame_id) as dec, count(*) as n from (select *, {_CRA} as ra, {_CDEC} as dec from sol) group by 1),
 ph as (select f.stack_id, n, greatest(2, ceil(sqrt(n))::int) as k, floor({_SKX} * 1e6 + 0.5) / 1e6 as px, floor({_SKY} * 1e6 + 0.5) / 1e6 as py from sol f join rf r on r.stack_id = f.stack_id),
 dd as (select stack_id, case when n < 2 then 0 else count(distinct (least(k - 1, floor((px - floor(px)) * k)), least(k - 1, floor((py - floor(py)) * k)))) / least(n, k * k)::double end as score from ph group by stack_id, n, k),
 cor as (select stack_id, frame_id, {_KX} as ra, {_KY} as dec from (select *, unnest([0, width - 1, width - 1, 0])::double as cx, unnest([0, 0, height - 1, height - 1])::double as cy from sol)),
 cen as (select stack_id, degrees(atan2(avg(cos(radians(dec)) * sin(radians(ra))), avg(cos(radians(dec)) * cos(radians(ra))))) as az,
   degrees(atan2(avg(sin(radians(dec))), sqrt(power(avg(cos(radians(dec)) * sin(radians(ra))), 2) + power(avg(cos(radians(dec)) * cos(radians(ra))), 2)))) as dec0 from cor group by 1),
 g0 as (select stack_id, score, over, base / over as scale, az - floor(az / 360) * 360 as ra0, dec0 from (select *, case when score >= 0.7 then 2::double when score >= 0.4 then 1.5 else 1 end as over from (select stack_id, quantile_cont(scale_arcsec, 0.25) as base from sol group by 1) join dd using (stack_id) join cen using (stack_id))),
 grid as (select g.*, greatest(8, w | 1) as ow, greatest(8, h | 1) as oh from (select stack_id, ceil((max(gx) - min(gx)) * 1.02::double)::bigint as w, ceil((max(gy) - min(gy)) * 1.02::double)::bigint as h from (select c.stack_id, {_GX} as gx, {_GY} as gy from cor c join g0 on g0.stack_id = c.stack_id) group by 1) s join g0 g using (stack_id))"""


@query("dither_diversity", "A14", check("frames", f"select stack_id, {s6('score')} as dither_score from dd", _GRID))
def dither_diversity(t):
    return round_all(drizzle.dither_diversity(t.frames))


@query("output_grids", "A15", check("frames", f"select stack_id, {s6('ra0')} as out_ra, {s6('dec0')} as out_dec, {s6('scale')} as out_scale, over as oversample, {s6('score')} as dither_score, ow as out_width, oh as out_height from grid", _GRID))
def output_grids(t):
    return round_all(drizzle.output_grids(t.frames))


def _map_sql(x, y, name):
    ra, dec = sky_sql(x, y)
    mx, my = pixel_sql("ra", "dec", "ra0", "dec0", "scale", "(ow / 2 - 0.5::double)", "(oh / 2 - 0.5::double)")
    return f"(select struct_pack(x := {mx}, y := {my}) from (select {ra} as ra, {dec} as dec)) as {name}"


_LX, _HX = "greatest(p.x - 1, 0)::double", "least(p.x + 1, width - 1)::double"
_LY, _HY = "greatest(p.y - 1, 0)::double", "least(p.y + 1, height - 1)::double"
_MAP = f"""mp as (select *, m.x as xo, m.y as yo, (hx.x - lx.x) / (hx0 - lx0) as dxdx, (hx.y - lx.y) / (hx0 - lx0) as dydx, (hy.x - ly.x) / (hy0 - ly0) as dxdy, (hy.y - ly.y) / (hy0 - ly0) as dydy from (
  select p.stack_id, p.frame_id, p.x, p.y, p.value, p.variance, ow, oh, {_LX} as lx0, {_HX} as hx0, {_LY} as ly0, {_HY} as hy0,
   {_map_sql('p.x', 'p.y', 'm')}, {_map_sql(_LX, 'p.y', 'lx')}, {_map_sql(_HX, 'p.y', 'hx')}, {_map_sql('p.x', _LY, 'ly')}, {_map_sql('p.x', _HY, 'hy')}
  from (select * from pixels where {GOOD}) p join sol f on f.stack_id = p.stack_id and f.frame_id = p.frame_id join grid g on g.stack_id = p.stack_id)),
 mq as (select *, abs(dxdx * dydy - dxdy * dydx) as area from mp)"""


@query("pixel_map_jacobian", "W5", check("pixels frames", f"""select stack_id, frame_id, x, y, {s6('xo')} as xo, {s6('yo')} as yo, {s6('dxdx')} as dxdx, {s6('dxdy')} as dxdy, {s6('dydx')} as dydx, {s6('dydy')} as dydy, {s6('area')} as area from mq""", _GRID + ", " + _MAP))
def pixel_map_jacobian(t):
    d = drizzle.with_pixel_map(t.pixels.where(stack.P.good_pixel()), t.frames, drizzle.output_grids(t.frames))
    return round_all(d.select(*FR, "x", "y", "xo", "yo", "dxdx", "dxdy", "dydx", "dydy", "area"))


_DRZ = """dz as (select stack_id, round_even(xo + dxdx * u + dxdy * v, 0)::bigint as ox, round_even(yo + dydx * u + dydy * v, 0)::bigint as oy, value, variance, area, ow, oh, fw
   from (select mq.*, fw from mq join dw using (stack_id, frame_id)) m, (select ((i + 0.5) / 5 - 0.5)::double * 0.7::double as u from range(5) r(i)) a, (select ((i + 0.5) / 5 - 0.5)::double * 0.7::double as v from range(5) r(i)) b),
 ac as (select stack_id, ox, oy, sum(fw / 25 * value / area) as num, sum(fw / 25) as weight, sum(fw / 25 * fw / 25 * variance / (area * area)) as vn, count(*) as context from dz where ox between 0 and ow - 1 and oy between 0 and oh - 1 group by all)"""
_DW = "dw as (select stack_id, frame_id, (1 / (noise_sigma * noise_sigma)) / max(1 / (noise_sigma * noise_sigma)) over (partition by stack_id) as fw from frames)"


@query("drizzle", "A23", check("pixels frames", f"select stack_id, ox, oy, {s1('num / weight')} as image, {s6('weight')} as weight, {s3('sqrt(vn) / weight')} as sigma, context from ac", _GRID + ", " + _MAP + ", " + _DW + ", " + _DRZ))
def drizzled(t):
    acc = drizzle.drizzle(t.pixels, t.frames, drizzle.output_grids(t.frames), weights=drizzle.drizzle_weights(t.frames))
    d = drizzle.finish(acc)
    return d.select("stack_id", "ox", "oy", r1("image").alias("image"), r6("weight").alias("weight"), r3("sigma").alias("sigma"), "context")


@query("drizzle_coverage", "A23", check("pixels frames", f"select stack_id, {s6('count(ox) / (any_value(g.ow) * any_value(g.oh))::double')} as coverage_fraction, {s6('1 - count(ox) / (any_value(g.ow) * any_value(g.oh))::double')} as hole_fraction from grid g left join ac using (stack_id) group by 1", _GRID + ", " + _MAP + ", " + _DW + ", " + _DRZ))
def drizzle_coverage(t):
    g = drizzle.output_grids(t.frames)
    return round_all(drizzle.coverage(drizzle.drizzle(t.pixels, t.frames, g), g))


_ORA = """(ra0 + degrees(atan2(xi, cos(radians(dec0)) - eta * sin(radians(dec0)))))"""
_IX, _IY = pixel_sql("ra", "dec", "crval_ra", "crval_dec", "scale_arcsec", "(crpix_x - 1)", "(crpix_y - 1)", "rotation_deg")
_REP = f"""og as (select f.*, g.scale, ra0, dec0, ow, oh, ox, unnest(range(oh)) as oy from (select *, unnest(range(ow)) as ox from grid) g join sol f using (stack_id)),
 oi as (select *, radians(-(scale / 3600) * (ox - (ow / 2 - 0.5::double))) as xi, radians((scale / 3600) * (oy - (oh / 2 - 0.5::double))) as eta from og),
 os as (select *, {_ORA} as ra, degrees(atan2(sin(radians(dec0)) + eta * cos(radians(dec0)), sqrt(power(xi, 2) + power(cos(radians(dec0)) - eta * sin(radians(dec0)), 2)))) as dec from oi),
 oq as (select *, floor(ix)::bigint as qx, floor(iy)::bigint as qy from (select stack_id, frame_id, width, height, ox, oy, {_IX} as ix, {_IY} as iy from os) where ix between 0 and width - 1 and iy between 0 and height - 1),
 rp as (select q.stack_id, q.frame_id, ox, oy, sum((1 - abs(ix - p.x)) * (1 - abs(iy - p.y)) * value) as value, sum((1 - abs(ix - p.x)) * (1 - abs(iy - p.y)) * variance) as variance, sum((1 - abs(ix - p.x)) * (1 - abs(iy - p.y))) as w
  from oq q join (select * from pixels where {GOOD}) p on p.stack_id = q.stack_id and p.frame_id = q.frame_id and p.x between qx and qx + 1 and p.y between qy and qy + 1 group by all)"""


@query("reprojected_frames", "X5", check("pixels frames", f"select stack_id, frame_id, ox, oy, {s1('value')} as value, {s1('variance')} as variance from rp where w > 1 - 1e-9", _GRID + ", " + _REP))
def reprojected_frames(t):
    d = drizzle.reproject(t.pixels, t.frames, drizzle.output_grids(t.frames))
    return d.select(*FR, "ox", "oy", r1("value").alias("value"), r1("variance").alias("variance"))


@query("reprojected_noise", "X5", check("pixels frames", f"""select stack_id, frame_id, any_value(n) as n, {s3(f'1.4826::double * median(abs(value - med)) / 0.89325736754014::double')} as sigma from (select *, median(value) over (partition by stack_id, frame_id) as med from (
  select *, count(*) over (partition by stack_id, frame_id) as n, quantile_cont(value, 0.9) over (partition by stack_id, frame_id) as cut from rp where w > 1 - 1e-9) where value <= cut) group by stack_id, frame_id""", _GRID + ", " + _REP))
def reprojected_noise(t):
    d = drizzle.rescale_variance(drizzle.reproject(t.pixels, t.frames, drizzle.output_grids(t.frames)))
    g = d.groupBy(*FR).agg(F.count("*").alias("n"), F.max("sigma").alias("sigma"))
    return g.withColumn("sigma", r3("sigma"))


# --- optimal coadd ----------------------------------------------------------------------------------
def fft_sql(usable):
    """The optimal coadd as plain sums over modes; ``usable`` names the samples that take part."""
    return f"""sc as (select stack_id, frame_id, case when photometrically_unreliable then 1 else transparency end as f, noise_sigma as s from frames),
 dn as (select z.stack_id, f.frame_id, z.x, z.y, coalesce(p.value, z.cons) as value, p.value is not null as usable from (select stack_id, x, y, coalesce(sum(value / variance) filter (used) / sum(1 / variance) filter (used), 0) as cons from {usable} group by all) z
   join frames f using (stack_id) left join (select * from {usable} where used) p on p.stack_id = z.stack_id and p.frame_id = f.frame_id and p.x = z.x and p.y = z.y),
 kk as (select a.v as ky, b.v as kx from range(24) a(v), range(13) b(v)),
 fm as (select stack_id, frame_id, ky, kx, sum(value * cos(2 * pi() * (kx * x + ky * y) / 24)) as mr, -sum(value * sin(2 * pi() * (kx * x + ky * y) / 24)) as mi from dn, kk group by all),
 fp as (select stack_id, frame_id, ky, kx, sum(g * cos(2 * pi() * (kx * dx + ky * dy) / 24)) / sum(g) as pr from ker, kk group by all),
 md as (select stack_id, ky, kx, sum(f / (s * s) * pr * mr) as re, sum(f / (s * s) * pr * mi) as im, sum(f * f / (s * s) * pr * pr) as d from fm join fp using (stack_id, frame_id, ky, kx) join sc using (stack_id, frame_id) group by all),
 mr as (select *, d + 1e-4 * max(d) over (partition by stack_id) as dr, case when kx in (0, 12) then 1 else 2 end as mult from md),
 sx as (select stack_id, sqrt(sum(f * f / (s * s))) as f_r, sum(f / (s * s)) as ideal from sc group by 1), nz as (select stack_id, sqrt(sum(mult * d / dr) / 576) as sr from mr group by 1),
 gx as (select a.v as x, b.v as y from range(24) a(v), range(24) b(v)),
 im as (select stack_id, x, y, sum(mult * (re * cos(2 * pi() * (kx * x + ky * y) / 24) - im * sin(2 * pi() * (kx * x + ky * y) / 24)) / sqrt(dr)) / 576 as r from mr, gx group by all),
 cv as (select stack_id, x, y, sum(f / (s * s)) as seen from dn join sc using (stack_id, frame_id) where usable group by all)"""


_FFT = fft_sql("(select *, good as used from p0)")
_CLEAN = clip_sql() + ", " + _REJ + ", " + _KER + ", " + fft_sql("(select *, good and not rejected as used from rk)")


@query("fourier_modes", "A24", check("pixels frames", f"select stack_id, ky, kx, {s6('re')} as re, {s6('im')} as im, {s6('d')} as d from md", _BASE + ", " + _KER + ", " + _FFT))
def fourier_modes(t):
    d = fourier.modes(fourier.dense_samples(t.pixels, t.frames), kernels.gaussian(t.frames), fourier.frame_scalars(t.frames))
    return round_all(d.withColumns({"ky": c("ky").cast("bigint"), "kx": c("kx").cast("bigint")}))


_OPTIMAL = f"""select stack_id, x, y, {s6('case when seen > 0 then r / f_r else 0 end')} as image, {s6('coalesce(seen / ideal, 0)')} as coverage, {s6('case when seen > 0 then sr / f_r / sqrt(greatest(seen / ideal, 1e-6)) else 0 end')} as sigma
 from im join sx using (stack_id) join nz using (stack_id) left join cv using (stack_id, x, y)"""


@query("optimal_coadd", "A24", check("pixels frames", _OPTIMAL, _BASE + ", " + _CLEAN))
def optimal_coadd(t):
    d = fourier.optimal_coadd(t.pixels, t.frames, kernels.gaussian(t.frames))
    return round_all(d.select(*CELL, "image", "coverage", "sigma"))


@query("optimal_coadd_without_streaks", "A24 X3", check("pixels frames", _OPTIMAL, _STREAKED + ", " + _CLEAN))
def optimal_coadd_without_streaks(t):
    d = fourier.optimal_coadd(streaked(t), t.frames, kernels.gaussian(t.frames))
    return round_all(d.select(*CELL, "image", "coverage", "sigma"))


@query("optimal_coadd_unclipped", "A24", check("pixels frames", _OPTIMAL, _BASE + ", " + _KER + ", " + _FFT))
def optimal_coadd_unclipped(t):
    d = fourier.optimal_coadd(t.pixels, t.frames, kernels.gaussian(t.frames), reject=False)
    return round_all(d.select(*CELL, "image", "coverage", "sigma"))


# --- HDR --------------------------------------------------------------------------------------------
_HDR = f"""lv as (select stack_id, frame_id, min(value) filter (is_saturated) as lvl from pixels group by all),
 uc as (select stack_id, frame_id, count(*) filter (value > 0 and good and (lvl is null or value < lvl * 0.75)) as n from p0 join lv using (stack_id, frame_id) group by all),
 rr as (select stack_id, arg_max(frame_id, (n, -frame_id)) as ref_id from uc group by 1),
 ok as (select p0.*, ref_id, exposure_seconds, noise_sigma from p0 join lv using (stack_id, frame_id) join rr using (stack_id) join frames using (stack_id, frame_id) where good and (lvl is null or value < lvl * 0.9) and value > 5 * noise_sigma),
 pr as (select a.stack_id, a.frame_id, count(*) as n, median(b.value / a.value) as ratio from ok a join ok b on a.stack_id = b.stack_id and a.x = b.x and a.y = b.y and b.frame_id = b.ref_id where a.frame_id <> a.ref_id group by all),
 scl as (select f.stack_id, f.frame_id, rr.ref_id, coalesce(n, 0) as n_overlap, case when f.frame_id = rr.ref_id then 1 when coalesce(n, 0) >= 380 then ratio else e.exposure_seconds / f.exposure_seconds end as scale from frames f join rr using (stack_id) join frames e on e.stack_id = f.stack_id and e.frame_id = rr.ref_id left join pr on pr.stack_id = f.stack_id and pr.frame_id = f.frame_id),
 hx as (select *, variance * scale * scale as v, case when good then coalesce(least(1, greatest(0, (lvl - value) / greatest(lvl * 0.25, 1e-9))), 1) * least(1, greatest(0, value / noise_sigma)) else 0 end as conf, exposure_seconds >= median(exposure_seconds) over (partition by stack_id) as lng0
   from p0 join lv using (stack_id, frame_id) join scl using (stack_id, frame_id) join frames using (stack_id, frame_id)),
 ty as (select stack_id, median(exposure_seconds) as typ from frames group by 1),
 hc as (select stack_id, x, y, sum(conf / v * value * scale) as num, sum(conf / v) as weight, sum(power(conf / v, 2) * v) as vn, bool_or(exposure_seconds >= typ and conf > 0) as lng from hx join ty using (stack_id) group by all),
 hi as (select stack_id, x, y, case when weight > 0 then num / weight else 0 end as image, weight, case when weight > 0 then sqrt(vn) / weight else 0 end as sigma, weight > 0 and not lng as is_recovered from hc)"""


def _hdr(t):
    lv = hdr.saturation_levels(t.pixels, t.frames)
    sc = hdr.relative_scales(t.pixels, t.frames, lv, hdr.reference_frames(t.pixels, lv), min_pixels=380)
    return lv, sc


@query("hdr_scales", "J17 A26", check("pixels frames", f"select stack_id, frame_id, ref_id, {s6('scale')} as scale, n_overlap from scl", _BASE + ", " + _HDR))
def hdr_scales(t):
    return round_all(_hdr(t)[1])


@query("hdr_composite", "A26", check("pixels frames", f"select stack_id, x, y, {s6('image')} as image, {s6('weight')} as weight, {s6('sigma')} as sigma, is_recovered from hi", _BASE + ", " + _HDR))
def hdr_composite(t):
    return round_all(hdr.composite(t.pixels, t.frames, *_hdr(t)))


@query("hdr_report", "A26", check("pixels frames", f"select stack_id, {s6('log2(quantile_cont(image, 0.9999) filter (image > 0) / quantile_cont(image, 0.01) filter (image > 0))')} as stops, {s6('count(*) filter (is_recovered) / 576::double')} as recovered_fraction from hi group by 1", _BASE + ", " + _HDR))
def hdr_report(t):
    return round_all(hdr.composite_report(hdr.composite(t.pixels, t.frames, *_hdr(t)), t.frames))
