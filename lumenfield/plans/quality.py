"""Queries over image comparison, recovery audits and uncertainty."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenfield.operators import audit, drizzle, fourier, kernels, pixels as px, stack
from lumenfield.plans.checks import s6
from lumenfield.plans.image import _KER, _SRC
from lumenfield.plans.registry import check, query, r6, round_all
from lumenfield.plans.stacking import _BASE, _PSFM, weighted

c = F.col
FR = ["stack_id", "frame_id"]
CELL = ["stack_id", "x", "y"]
GOOD = "value is not null and not is_masked and not is_saturated"


def _images(t):
    """Weighted mean ``a`` against median ``b`` per stack."""
    w = weighted(t)
    a = stack.combine(w, t.frames, "mean").select(*CELL, c("image").alias("a"))
    b = stack.combine(w, t.frames, "median").select(*CELL, c("image").alias("b"))
    return a.join(b, CELL)


_PAIR = """pair as (select stack_id, x, y, coalesce(sum(weight * value) filter (keep) / sum(weight) filter (keep), 0) as a, coalesce(median(value) filter (keep), 0) as b from p0 group by all)"""
_B2 = _BASE + ", " + _PAIR


def _positions(t):
    """Five positions per stack on the image lattice."""
    size = audit.image_size(t.frames)
    return audit.lattice(size, 9, [100.0], margin=6)


_POS = """pos as (select stack_id, k as source_id, floor(6 + (k % 3) * 5.5::double + 0.5)::bigint as x, floor(6 + (k // 3) * 5.5::double + 0.5)::bigint as y, [{fl}][k % {n} + 1]::double as flux from (select distinct stack_id from frames), range(9) r(k))"""
_POS1 = _POS.replace("{fl}", "100").replace("{n}", "1")


@query("psnr", "A30", check("pixels frames", f"select stack_id, {s6('10 * log10(power(max(b) - min(b), 2) / avg(power(a - b, 2)))')} as psnr_db from pair group by 1", _B2))
def psnr(t):
    return round_all(audit.psnr(_images(t)))


_SSIM = """dg as (select g.stack_id, g.x, g.y, coalesce(a, 0) as a, coalesce(b, 0) as b from (select stack_id, i.v as x, j.v as y from (select distinct stack_id from frames), range(24) i(v), range(24) j(v)) g left join pair p on p.stack_id = g.stack_id and p.x = g.x and p.y = g.y),
 rg as (select stack_id, max(b) - min(b) as r from dg group by 1),
 ws as (select c.stack_id, c.x, c.y, avg(n.a) as ma, avg(n.b) as mb, 49 / 48::double * (avg(n.a * n.a) - power(avg(n.a), 2)) as va, 49 / 48::double * (avg(n.b * n.b) - power(avg(n.b), 2)) as vb, 49 / 48::double * (avg(n.a * n.b) - avg(n.a) * avg(n.b)) as cab
   from dg c join dg n on n.stack_id = c.stack_id and abs(n.x - c.x) <= 3 and abs(n.y - c.y) <= 3 where c.x between 3 and 20 and c.y between 3 and 20 group by all),
 ss as (select stack_id, avg((2 * ma * mb + power(0.01::double * r, 2)) * (2 * cab + power(0.03::double * r, 2)) / ((ma * ma + mb * mb + power(0.01::double * r, 2)) * (va + vb + power(0.03::double * r, 2)))) as ssim from ws join rg using (stack_id) group by 1)"""


@query("ssim", "A31 W6", check("pixels frames", f"select stack_id, {s6('ssim')} as ssim from ss", _B2 + ", " + _SSIM))
def ssim(t):
    return round_all(audit.ssim(_images(t), audit.image_size(t.frames)))


_AP = "ap as (select p.stack_id, source_id, sum(a) as fa, sum(b) as fb from pos p join pair i on i.stack_id = p.stack_id and abs(i.x - p.x) <= 3 and abs(i.y - p.y) <= 3 group by all)"
_FC = "fc as (select stack_id, median(fa / fb) as med, stddev_pop(fa / fb) as sd, count(*) as n from ap group by 1), fr as (select stack_id, sum(a) / sum(b) as ratio from pair group by 1)"


@query("aperture_fluxes", "J14", check("pixels frames", f"select stack_id, source_id, {s6('fa')} as fa, {s6('fb')} as fb from ap", _B2 + ", " + _POS1 + ", " + _AP))
def aperture_fluxes(t):
    return round_all(audit.aperture_sums(_images(t), _positions(t), 3))


@query("flux_consistency", "A32 A33", check("pixels frames", f"select stack_id, {s6('ratio')} as flux_ratio, {s6('med')} as median_ratio, {s6('sd')} as scatter, n as n_apertures from fr join fc using (stack_id)", _B2 + ", " + _POS1 + ", " + _AP + ", " + _FC))
def flux_consistency(t):
    return round_all(audit.flux_consistency(_images(t), _positions(t), 3))


_IQ = "imgs as (select stack_id, x, y, unnest([0, 1]) as frame_id, unnest([a, b]) as value from pair), " + _SRC.replace(f"from pixels where {GOOD}", "from imgs") + """,
 wid as (select stack_id, frame_id, count(*) as n, coalesce(median(fw) filter (fw > 0.5 and fw < 6), median(fw)) as fwhm from (select *, 2 * sqrt(2 * ln(2)) * sqrt(greatest(sqrt((cxx + cyy) / 2 + sqrt(power((cxx - cyy) / 2, 2) + cxy * cxy)) * sqrt(greatest((cxx + cyy) / 2 - sqrt(power((cxx - cyy) / 2, 2) + cxy * cxy), 0)), 1e-12)) as fw from mom) group by all),
 noi as (select stack_id, frame_id, 1.4826::double * median(abs(value - med)) / 0.89325736754014::double as noise from (select *, median(value) over (partition by stack_id, frame_id) as med from (select *, quantile_cont(value, 0.9) over (partition by stack_id, frame_id) as cut from imgs) where value <= cut) group by all),
 iq as (select stack_id, max(noise) filter (frame_id = 0) as noise_a, max(noise) filter (frame_id = 1) as noise_b, max(fwhm) filter (frame_id = 0) as fwhm_a, max(fwhm) filter (frame_id = 1) as fwhm_b,
   max(coalesce(n, 0)) filter (frame_id = 0) as n_sources_a, max(coalesce(n, 0)) filter (frame_id = 1) as n_sources_b from noi left join wid using (stack_id, frame_id) group by 1)"""


@query("image_comparison", "A52", check("pixels frames", f"""select stack_id, {s6('psnr')} as psnr_db, {s6('ssim')} as ssim, {s6('ratio')} as flux_ratio, {s6('med')} as median_ratio, {s6('sd')} as scatter, n as n_apertures,
  {s6('noise_a')} as noise_a, {s6('noise_b')} as noise_b, {s6('fwhm_a')} as fwhm_a, {s6('fwhm_b')} as fwhm_b, n_sources_a, n_sources_b
 from fr join fc using (stack_id) join ss using (stack_id) join (select stack_id, 10 * log10(power(max(b) - min(b), 2) / avg(power(a - b, 2))) as psnr from pair group by 1) using (stack_id) join iq using (stack_id)""", _B2 + ", " + _POS1 + ", " + _AP + ", " + _FC + ", " + _SSIM + ", " + _IQ))
def image_comparison(t):
    return round_all(audit.compare_report(_images(t), _positions(t), audit.image_size(t.frames), threshold=1.2))


_MEAN = "cm as (select stack_id, x, y, sum(weight * value) / sum(weight) as image, sum(weight) as weight, sqrt(sum(weight * weight * variance)) / sum(weight) as sigma from p0 where keep group by all)"
_MF = "mf as (select p.stack_id, source_id, any_value(flux) as flux, sum(k.w * image / (sigma * sigma)) / sum(k.w * k.w / (sigma * sigma)) as est, sum(k.w * image / (sigma * sigma)) / sqrt(sum(k.w * k.w / (sigma * sigma))) as snr from pos p join psfu k using (stack_id) join cm i on i.stack_id = p.stack_id and i.x = p.x + k.dx and i.y = p.y + k.dy group by all)"
_PSFU = _PSFM + ", psfu as (select stack_id, dx, dy, w / sum(w) over (partition by stack_id) as w from psfm)"


def _mean_psf(t):
    return stack.mean_psf(kernels.gaussian(t.frames), px.frame_weights(t.frames))


@query("matched_filter", "A34 J15", check("pixels frames", f"select stack_id, source_id, {s6('est')} as flux, {s6('snr')} as snr from mf", _BASE + ", " + _MEAN + ", " + _KER + ", " + _PSFU + ", " + _POS1 + ", " + _MF))
def matched_filter(t):
    image = stack.combine(weighted(t), t.frames, "mean")
    return round_all(kernels.matched_filter(image.where("weight > 0"), _positions(t), _mean_psf(t), ["stack_id"], ["source_id"]))


def _robust_sql(name, src):
    t = "0.89325736754014"
    return f"""{name} as (select stack_id, 1.4826::double * median(abs(image - med)) / {t}::double as sig from (select *, median(image) over (partition by stack_id) as med from (select *, quantile_cont(image, 0.9) over (partition by stack_id) as cut from {src}) where image <= cut) group by 1)"""


_EVAL = f"""cu as (select stack_id, x, y, avg(value) as image from p0 where keep group by all), {_robust_sql('rc', 'cm')}, {_robust_sql('rb', 'cu')},
 pu as (select stack_id, dx, dy, w / sum(w) over (partition by stack_id) as w from (select stack_id, dx, dy, sum(gn) as w from (select *, g / sum(g) over (partition by stack_id, frame_id) as gn from ker) group by all)),
 sc1 as (select p.stack_id, source_id, sum(k.w * image) / (any_value(sig) * sqrt(sum(k.w * k.w))) as snr from pos p join psfu k using (stack_id) join cm i on i.stack_id = p.stack_id and i.x = p.x + k.dx and i.y = p.y + k.dy join rc on rc.stack_id = p.stack_id group by all),
 sb1 as (select p.stack_id, source_id, sum(k.w * image) / (any_value(sig) * sqrt(sum(k.w * k.w))) as snr from pos p join pu k using (stack_id) join cu i on i.stack_id = p.stack_id and i.x = p.x + k.dx and i.y = p.y + k.dy join rb on rb.stack_id = p.stack_id group by all)"""


@query("run_evaluation", "A50 A35", check("pixels frames", f"""select stack_id, {s6('median(a.snr)')} as median_snr, {s6('median(b.snr)')} as base_median_snr, {s6('20 * log10(median(a.snr / b.snr))')} as snr_gain_db, any_value(lo) as fwhm_best, any_value(me) as fwhm_median, any_value(hi) as fwhm_worst
 from sc1 a join sb1 b using (stack_id, source_id) join (select stack_id, min(fwhm_px) as lo, median(fwhm_px) as me, max(fwhm_px) as hi from frames group by 1) using (stack_id) group by 1""", _BASE + ", " + _MEAN + ", " + _KER + ", " + _PSFU + ", " + _POS1 + ", " + _EVAL))
def run_evaluation(t):
    even = px.frame_weights(t.frames, "uniform")
    ker = kernels.gaussian(t.frames)
    base = stack.combine(t.pixels.join(even.select(*FR, "weight"), FR), t.frames, "mean")
    coadd = stack.combine(weighted(t), t.frames, "mean")
    d = audit.run_evaluation(coadd, _mean_psf(t), base, stack.mean_psf(ker, even), _positions(t), t.frames)
    return round_all(d)


# --- injection -------------------------------------------------------------------------------------
FLUXES = [500.0, 2000.0, 8000.0, 32000.0]
_POSF = _POS.replace("{fl}", "500, 2000, 8000, 32000").replace("{n}", "4")


@query("injection_lattice", "X7", check("frames", "select stack_id, source_id, x, y, flux from pos", _POSF))
def injection_lattice(t):
    return audit.lattice(audit.image_size(t.frames), 9, FLUXES, margin=6)


_INJ = """kn as (select stack_id, frame_id, dx, dy, g / sum(g) over (partition by stack_id, frame_id) as w from ker),
 ad as (select k.stack_id, k.frame_id, p.x + k.dx as x, p.y + k.dy as y, sum(flux * w) as add from pos p join kn k using (stack_id) group by all),
 pj as (select p0.* exclude (value), value + coalesce(add, 0) as value from p0 left join ad using (stack_id, frame_id, x, y))"""


@query("injected_pixels", "X7", check("pixels frames", f"select stack_id, frame_id, x, y, {s6('value')} as value from pj", _BASE + ", " + _KER + ", " + _POSF + ", " + _INJ))
def injected_pixels(t):
    src = audit.lattice(audit.image_size(t.frames), 9, FLUXES, margin=6)
    return round_all(audit.inject(t.pixels, src, kernels.gaussian(t.frames)).select(*FR, "x", "y", "value"))


def _recovery(t):
    src = audit.lattice(audit.image_size(t.frames), 9, FLUXES, margin=6)
    ker = kernels.gaussian(t.frames)
    w = weighted(t)
    after = stack.combine(audit.inject(w, src, ker), t.frames, "mean")
    delta = audit.difference(after, stack.combine(w, t.frames, "mean"))
    return delta, src


_DEL = "df as (select stack_id, x, y, coalesce(sum(weight * j.value) / sum(weight), 0) - coalesce(sum(weight * o.value) / sum(weight), 0) as image, sqrt(sum(weight * weight * variance)) / sum(weight) as sigma from (select * from pj where keep) j join (select stack_id, frame_id, x, y, value from p0) o using (stack_id, frame_id, x, y) group by all), dl as (select z.stack_id, z.x, z.y, coalesce(image, 0) as image, coalesce(sigma, 0) as sigma from (select distinct stack_id, x, y from p0) z left join df using (stack_id, x, y))"
_RCV = "ds as (select stack_id, x, y, image, case when sigma > 0 then sigma else median(sigma) filter (sigma > 0) over (partition by stack_id) end as sigma from dl), " + _MF.replace("join cm i", "join ds i")
_ALLI = _BASE + ", " + _KER + ", " + _POSF + ", " + _INJ + ", " + _DEL + ", " + _PSFU + ", " + _RCV


@query("difference_image", "J18", check("pixels frames", f"select stack_id, x, y, {s6('image')} as image, {s6('sigma')} as sigma from dl", _BASE + ", " + _KER + ", " + _POSF + ", " + _INJ + ", " + _DEL))
def difference_image(t):
    return round_all(_recovery(t)[0])


@query("injection_recovery", "A36", check("pixels frames", f"""select stack_id, n_sources, {s6('slope')} as slope, {s6('icept')} as intercept, {s6('r2')} as r_squared, {s6('det')} as detection_fraction, c50 as completeness_50, abs(slope - 1) < 0.15 and r2 > 0.95 as is_linear,
  concat_ws(',', case when abs(slope - 1) > 0.15 then case when slope < 1 then 'loses_flux' else 'adds_flux' end end, case when icept > 0 and icept / typ > 0.1 then 'positive_intercept' end) as notes
 from (select stack_id, count(*) as n_sources, regr_slope(est, flux) as slope, regr_intercept(est, flux) as icept, regr_r2(est, flux) as r2, avg((snr >= 5)::int) as det, median(flux) as typ from mf group by 1)
 join (select stack_id, min(flux) filter (f >= 0.5) as c50 from (select stack_id, flux, avg((snr >= 5)::int) as f from mf group by all) group by 1) using (stack_id)""", _ALLI))
def injection_recovery(t):
    delta, src = _recovery(t)
    d = audit.injection_recovery(delta, src, _mean_psf(t))[1]
    return round_all(d.withColumn("notes", F.array_join("notes", ",")))


@query("depth_curve", "A37", check("pixels frames", f"""select stack_id, n_frames, {s6('median(snr)')} as median_snr, {s6('sqrt(n_frames)')} as sqrt_n from (
 select q.stack_id, q.n as n_frames, p.source_id, sum(k.w * image / (sigma * sigma)) / sqrt(sum(k.w * k.w / (sigma * sigma))) as snr from qi q join qk k on k.stack_id = q.stack_id and k.n = q.n join pos p on p.stack_id = q.stack_id and q.x = p.x + k.dx and q.y = p.y + k.dy group by all) group by stack_id, n_frames""",
    _BASE + ", " + _KER + ", " + _POS1 + """, rk as (select stack_id, frame_id, 1 / power(noise_sigma, 2) as iv, row_number() over (partition by stack_id order by frame_id) as r, count(*) over (partition by stack_id) as nf from frames),
 cn as (select distinct rk.*, greatest(1, round_even(nf * s, 0))::bigint as n from rk, (values (0.125::double), (0.25), (0.5), (1)) v(s)), cr as (select *, iv / sum(iv) over (partition by stack_id, n) as wn from cn where r <= n),
 qi as (select p.stack_id, n, x, y, sum(wn * value) / sum(wn) as image, sqrt(sum(wn * wn * variance)) / sum(wn) as sigma from p0 p join cr using (stack_id, frame_id) where keep group by all),
 qk as (select stack_id, n, dx, dy, sum(wn * gn) as w from (select *, g / sum(g) over (partition by stack_id, frame_id) as gn from ker) join cr using (stack_id, frame_id) group by all)"""))
def depth_curve(t):
    vp, vf = audit.first_frames(t.pixels, t.frames)
    wts = px.frame_weights(vf)
    image = stack.combine(vp.join(wts.select(*FR, "weight"), FR), vf, "mean").where("weight > 0")
    psf = stack.mean_psf(kernels.gaussian(vf), wts)
    pos = audit.lattice(audit.image_size(vf), 9, [100.0], margin=6)
    m = kernels.matched_filter(image, pos, psf, ["stack_id"], ["source_id"])
    return round_all(audit.depth_curve(m))


_FP = f"""l2 as (select stack_id, sqrt(sum(w * w)) as l2, sum(w) as sw from psfu group by 1), ci as (select distinct z.stack_id, z.x, z.y, coalesce(image, 0) as image from p0 z left join cm using (stack_id, x, y)),
 fi as (select c.stack_id, c.x, c.y, sum(n.image * w) / any_value(l2) as image from ci c join psfu k using (stack_id) join l2 using (stack_id) join ci n on n.stack_id = c.stack_id and n.x = c.x + k.dx and n.y = c.y + k.dy group by all),
 {_robust_sql('fs', 'fi')}, sco as (select fi.*, image / sig as score, sig from fi join fs using (stack_id)),
 pk as (select c.stack_id, c.x, c.y, any_value(c.score) as score, any_value(c.sig) as sig, any_value(c.score) = max(n.score) as peak from sco c join sco n on n.stack_id = c.stack_id and abs(n.x - c.x) <= 2 and abs(n.y - c.y) <= 2 group by all)"""


@query("matched_filter_detections", "X6 W7", check("pixels frames", f"""select stack_id, count(*) filter (inner_px and peak and score >= 3) as n_detections, {s6('max(score) filter (inner_px)')} as max_score, {s6('any_value(sig)')} as sigma, {s6('144 / greatest(any_value(sw) * any_value(sw) / power(any_value(l2), 2), 1)')} as n_beams
 from (select *, x between 6 and 17 and y between 6 and 17 as inner_px from pk join l2 using (stack_id)) group by 1""", _BASE + ", " + _MEAN + ", " + _KER + ", " + _PSFU + ", " + _FP))
def matched_filter_detections(t):
    image = stack.combine(weighted(t), t.frames, "mean")
    return round_all(audit.false_positives(image, _mean_psf(t), audit.image_size(t.frames), 3.0, 5))


# --- losses, uncertainty, tone ------------------------------------------------------------------------
_LOSS = _SSIM.split(",\n rg as")[0] + """, pt as (select stack_id, sum(a) as pa, sum(b) as pb from dg group by stack_id, x // 8, y // 8),
 gl as (select stack_id, abs(sum(a) - sum(b)) / (abs(sum(b)) + 1e-8) as g from dg group by 1), lc as (select stack_id, avg(abs(pa - pb) / (abs(pb) + 1e-8)) as l from pt group by 1)"""


def _mom(v, n):
    v = f"greatest({v}, 0)"
    q = lambda e: f"(sum({v} * {e}) / sum({v}))"
    return f"{n} as (select stack_id, (xx - yy) / (xx + yy + 1e-12) as e1, 2 * xy / (xx + yy + 1e-12) as e2, xx + yy as r2 from (select stack_id, {q('x * x')} - power({q('x')}, 2) as xx, {q('y * y')} - power({q('y')}, 2) as yy, {q('x * y')} - {q('x')} * {q('y')} as xy from pair group by 1))"


@query("patch_flux", "A40", check("pixels frames", f"select stack_id, {s6('g')} as flux_global, {s6('l')} as flux_local from gl join lc using (stack_id)", _B2 + ", " + _LOSS))
def patch_flux(t):
    return round_all(audit.patch_flux(_images(t), 8, audit.image_size(t.frames)))


@query("shape_moments", "A40", check("pixels frames", f"select stack_id, {s6('e1')} as e1, {s6('e2')} as e2, {s6('r2')} as r2 from ma", _B2 + ", " + _mom("a", "ma")))
def shape_moments(t):
    return round_all(audit.shape_moments(_images(t), "a"))


_CHI = """kn as (select stack_id, frame_id, dx, dy, g / sum(g) over (partition by stack_id, frame_id) as w from ker),
 md as (select k.stack_id, k.frame_id, p.x + k.dx as x, p.y + k.dy as y, sum(p.a * k.w) as m from pair p join kn k using (stack_id) group by all),
 ch as (select stack_id, avg(c) as chi2 from (select stack_id, frame_id, avg(power((m - value) / noise_sigma, 2)) as c from md join pixels using (stack_id, frame_id, x, y) join frames using (stack_id, frame_id) group by all) group by 1)"""


@query("combined_loss", "A40", check("pixels frames", f"""select stack_id, {s6('l1')} as l1, {s6('g')} as flux_global, {s6('l')} as flux_local, {s6('ell')} as shape_ellipticity, {s6('sz')} as shape_size, {s6('chi2')} as chi2, {s6('l1 + (g + l) / 2 + (ell + sz) / 2 + chi2')} as total
 from (select stack_id, l1, g, l, power(ma.e1 - mb.e1, 2) + power(ma.e2 - mb.e2, 2) as ell, abs(ma.r2 - mb.r2) / (abs(mb.r2) + 1e-8) as sz, chi2 from (select stack_id, avg(abs(a - b)) as l1 from pair group by 1) join gl using (stack_id) join lc using (stack_id) join ma using (stack_id) join mb using (stack_id) join ch using (stack_id))""",
    _B2 + ", " + _LOSS + ", " + _mom("a", "ma") + ", " + _mom("b", "mb") + ", " + _KER + ", " + _CHI))
def combined_loss(t):
    pair = _images(t)
    chi = audit.forward_model(pair.select(*CELL, c("a").alias("image")), t.pixels, kernels.gaussian(t.frames), t.frames)
    return round_all(audit.combined_loss(pair, audit.image_size(t.frames), chi, 8))


_UNC = "un as (select stack_id, x, y, stddev_pop(value) as ep, sqrt(max(variance)) as al, count(*) as n from pixels group by all)"


@query("sample_uncertainty", "A41", check("pixels", f"select stack_id, x, y, {s6('ep')} as epistemic, {s6('sqrt(ep * ep + al * al)')} as total_sigma, n as n_samples from un", _UNC))
def sample_uncertainty(t):
    d = audit.sample_uncertainty(t.pixels.withColumn("al", F.sqrt("variance")), "al")
    return round_all(d.drop("aleatoric"))


@query("uncertainty_summary", "A41", check("pixels", f"select stack_id, {s6('median(sqrt(ep * ep + al * al))')} as median_total_sigma, {s6('quantile_cont(sqrt(ep * ep + al * al), 0.95)')} as p95_total_sigma from un group by 1", _UNC))
def uncertainty_summary(t):
    return round_all(audit.uncertainty_summary(audit.sample_uncertainty(t.pixels.withColumn("al", F.sqrt("variance")), "al")))


@query("confidence_mask", "P23", check("pixels frames", "select stack_id, x, y, image / greatest(sigma, 1e-12) >= 25 as is_confident from cm", _BASE + ", " + _MEAN))
def confidence_mask(t):
    d = stack.combine(weighted(t), t.frames, "mean").where("weight > 0")
    return d.select(*CELL, px.confidence_mask(c("image"), c("sigma"), 25.0).alias("is_confident"))


_TONE = """tg as (select f.stack_id, f.frame_id, i.v as x, j.v as y, coalesce(p.value / 1000, 0) as value from frames f, range(24) i(v), range(24) j(v) left join pixels p on p.stack_id = f.stack_id and p.frame_id = f.frame_id and p.x = i.v and p.y = j.v),
 td as (select *, x // 4 as px, y // 4 as py, abs(value - lag(value) over (partition by stack_id, frame_id, y, x // 4 order by x)) as d from tg),
 tp as (select stack_id, frame_id, avg(value) as m, power(1.4826::double * median(d) / sqrt(2), 2) as v from td group by stack_id, frame_id, px, py),
 tk as (select *, quantile_cont(m, 0.9) over (partition by stack_id, frame_id) as cut, count(*) over (partition by stack_id, frame_id) as n from tp where m > 1e-4 and m < 0.85 and v > 1e-12),
 ts as (select *, count(*) filter (m <= cut) over (partition by stack_id, frame_id) as sel from tk),
 tf as (select stack_id, frame_id, any_value(n) as n, count(*) as used, regr_slope(ln(v), ln(m)) as slope, regr_syy(ln(v), ln(m)) - power(regr_sxy(ln(v), ln(m)), 2) / regr_sxx(ln(v), ln(m)) as sse, regr_sxx(ln(v), ln(m)) as sxx, max(ln(m)) - min(ln(m)) as span from ts where m <= cut or sel < 24 group by all),
 tr as (select *, sqrt(greatest(sse, 0) / (used - 2) / sxx) as err, case when n < 24 then 'too_few_patches' when span < 0.15 then 'too_flat' when not 2 - slope between 0.5 and 6 then 'out_of_bounds' when sqrt(greatest(sse, 0) / (used - 2) / sxx) > 2 then 'poorly_constrained' else 'ok' end as reason from tf)"""


@query("residual_gamma", "A43 W9", check("pixels frames", f"""select stack_id, frame_id, {s6("case when reason = 'ok' then 2 - slope else 1 end")} as gamma, reason, {s6("case when reason in ('too_few_patches', 'too_flat') then 0 else slope end")} as slope, {s6("case when reason not in ('too_few_patches', 'too_flat') then err end")} as slope_error from tr""", _TONE))
def residual_gamma(t):
    d = audit.residual_gamma(t.pixels.withColumn("value", c("value") / 1000.0), t.frames, patch=4, max_error=2.0)
    return round_all(d)


@query("prior_contribution", "X8", check("pixels frames", f"""select stack_id, {s6('sum(pw) filter (otf < 0.5 * mx) / sum(pw)')} as prior from (select *, max(otf) over (partition by stack_id) as mx from (select stack_id, ky, kx, power(sum((a - mean) * cos(2 * pi() * (kx * x + ky * y) / 24)), 2) + power(sum((a - mean) * sin(2 * pi() * (kx * x + ky * y) / 24)), 2) as pw
  from (select *, avg(a) over (partition by stack_id) as mean from dg), kk group by all) join (select stack_id, ky, kx, abs(sum(w * cos(2 * pi() * (kx * dx + ky * dy) / 24))) as otf from psfu, kk group by all) using (stack_id, ky, kx)) group by 1""", _B2 + ", " + _SSIM.split(",\n rg as")[0] + ", " + _KER + ", " + _PSFU + ", kk as (select a.v as ky, b.v as kx from range(24) a(v), range(13) b(v))"))
def prior_contribution(t):
    image = _images(t).select(*CELL, c("a").alias("image"))
    d = fourier.prior_contribution(image, _mean_psf(t), audit.image_size(t.frames), limit=0.5)
    return round_all(d)
