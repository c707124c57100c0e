"""Queries over the column functions: astronomy, optics, quality and ingest."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenfield.functions import geo, optics, sky
from lumenfield.functions.quality import with_quality
from lumenfield.operators import ingest
from lumenfield.plans import checks as K
from lumenfield.plans.checks import s6
from lumenfield.plans.registry import check, query, r3, r6, round_all

c = F.col


@query("julian_date", "F1", check("photos", f"""
select photo_id, {s6(K.jd('captured_at_utc'))} as jd from photos where captured_at_utc is not null"""))
def julian_date(t):
    d = t.photos.where(c("captured_at_utc").isNotNull())
    return d.select("photo_id", r6(sky.julian_date(c("captured_at_utc"))).alias("jd"))


@query("airmass_models", "F2", check("photos", f"""
select photo_id, {s6(K.airmass_sql('h'))} as pickering,
  {s6(K.airmass_sql('h', 'kasten-young'))} as kasten_young
from (select photo_id, (photo_id % 950) / 10::double - 5 as h from photos)"""))
def airmass_models(t):
    d = t.photos.select("photo_id", ((c("photo_id") % 950) / 10.0 - 5).alias("h"))
    up = c("h") > 0
    return d.select(
        "photo_id",
        r6(F.when(up, sky.airmass(c("h")))).alias("pickering"),
        r6(F.when(up, sky.airmass(c("h"), "kasten-young"))).alias("kasten_young"),
    )


_LOCATED = "ra_deg is not null and lat_deg is not null and captured_at_utc is not null"
_HA = f"""hz as (select *, {K.hour_angle('ra_deg', 'lon_deg', 'captured_at_utc')} as ha
  from photos where {_LOCATED})"""


@query("altitude_azimuth", "F3 F4", check("photos", f"""
select photo_id, {s6(K.gmst('captured_at_utc'))} as gmst_deg,
  {s6(K.altitude('ra_deg', 'dec_deg', 'lat_deg', 'ha'))} as altitude_deg,
  {s6(K.mod360('''degrees(atan2(-cos(radians(dec_deg)) * sin(ha), sin(radians(dec_deg)) * cos(radians(lat_deg))
    - cos(radians(dec_deg)) * sin(radians(lat_deg)) * cos(ha)))'''))} as azimuth_deg from hz""", _HA))
def altitude_azimuth(t):
    d = t.photos.where(_LOCATED)
    hz = sky.alt_az(c("ra_deg"), c("dec_deg"), c("lat_deg"), c("lon_deg"), c("captured_at_utc"))
    d = d.withColumn("hz", hz)
    return d.select(
        "photo_id", r6(sky.sidereal_time(c("captured_at_utc"))).alias("gmst_deg"),
        r6("hz.altitude_deg").alias("altitude_deg"), r6("hz.azimuth_deg").alias("azimuth_deg"),
    )


@query("separation_from_object", "F5", check("photos objects", f"""
select photo_id, {s6(K.vincenty('p.ra_deg', 'p.dec_deg', 'o.ra_deg', 'o.dec_deg'))} as separation_deg
from photos p join objects o using (object_id) where p.ra_deg is not null"""))
def separation_from_object(t):
    o = t.objects.select("object_id", c("ra_deg").alias("o_ra"), c("dec_deg").alias("o_dec"))
    d = t.photos.where("ra_deg is not null").join(o, "object_id")
    sep = sky.separation(c("ra_deg"), c("dec_deg"), c("o_ra"), c("o_dec"))
    return d.select("photo_id", r6(sep).alias("separation_deg"))


@query("geodesic_to_site", "F6", check("photos", f"""
select photo_id, {K.s3(K.lambert('lat_deg', 'lon_deg', '-24.6::double', '-70.4::double'))} as distance_m
from photos where lat_deg is not null"""))
def geodesic_to_site(t):
    d = t.photos.where("lat_deg is not null")
    m = geo.geodesic_m(c("lat_deg"), c("lon_deg"), F.lit(-24.6), F.lit(-70.4))
    return d.select("photo_id", r3(m).alias("distance_m"))


@query("sun_and_moon", "F7 F8 F9", check("photos", f"""
select photo_id, {s6('eps')} as obliquity_deg, {s6('slon')} as sun_lon_deg, {s6('sr')} as sun_au,
  {s6('mra')} as moon_ra_deg, {s6('mdec')} as moon_dec_deg, {s6('mlon')} as moon_lon_deg,
  {s6('mlat')} as moon_lat_deg, {K.s3('mdist')} as moon_km, {s6('illum')} as illumination,
  {K.s3('degrees(ph)')} as phase_deg, {s6('degrees(el)')} as elongation_deg,
  {s6(K.vincenty('ra_deg', 'dec_deg', 'mra', 'mdec'))} as moon_separation_deg from moon""", K.moon_cte("photos")))
def sun_and_moon(t):
    d = sky.with_moon(t.photos.where(c("captured_at_utc").isNotNull()))
    tt = sky.centuries(c("captured_at_utc"))
    sun = sky.sun_apparent(tt)
    sep = sky.separation(c("ra_deg"), c("dec_deg"), c("moon.ra_deg"), c("moon.dec_deg"))
    return d.select(
        "photo_id", r6(sky.obliquity(tt)).alias("obliquity_deg"),
        r6(sun["lon_deg"]).alias("sun_lon_deg"), r6(sun["radius_au"]).alias("sun_au"),
        r6("moon.ra_deg").alias("moon_ra_deg"), r6("moon.dec_deg").alias("moon_dec_deg"),
        r6("moon.ecliptic_lon_deg").alias("moon_lon_deg"),
        r6("moon.ecliptic_lat_deg").alias("moon_lat_deg"),
        r3("moon.distance_km").alias("moon_km"),
        r6("moon.illumination").alias("illumination"),
        r3("moon.phase_angle_deg").alias("phase_deg"),
        r6("moon.elongation_deg").alias("elongation_deg"), r6(sep).alias("moon_separation_deg"),
    )


_PITCH = "coalesce(pixel_pitch_um, sensor_width_mm * 1000 / width_px)"
_SCALE = f"206264.80624709636::double * ({_PITCH} * 1e-6) / (focal_length_mm * 1e-3)"
_DIFF = "1.22::double * (550e0 * 1e-9) / ((focal_length_mm / focal_ratio) * 1e-3) * 206264.80624709636::double"


@query("optics_limits", "F10 F11 F16", check("photos", f"""
select photo_id, {s6('focal_length_mm / focal_ratio')} as aperture_mm, {s6(_DIFF)} as diffraction_arcsec,
  {s6(_PITCH)} as pitch_um, {s6(_SCALE)} as pixel_scale_arcsec, {s6(f'({_SCALE}) / ({_DIFF})')} as sampling,
  {s6(f'2 * ({_SCALE})')} as binned_scale_arcsec from photos"""))
def optics_limits(t):
    d = ingest.with_optics(t.photos)
    f, p, a = c("focal_length_mm"), c("pixel_pitch_um"), c("aperture_mm")
    return d.select(
        "photo_id", r6(a).alias("aperture_mm"),
        r6(optics.diffraction_limit(a)).alias("diffraction_arcsec"), r6(p).alias("pitch_um"),
        r6(optics.pixel_scale(f, p)).alias("pixel_scale_arcsec"),
        r6(optics.sampling_ratio(f, p, a)).alias("sampling"),
        r6(optics.pixel_scale(f, p, binning=2)).alias("binned_scale_arcsec"),
    )


@query("parallactic_angle", "F12", check("photos", f"""
select photo_id, {s6('degrees(atan2(sin(ha) * cos(radians(lat_deg)), sin(radians(lat_deg)) * cos(radians(dec_deg)) - cos(radians(lat_deg)) * sin(radians(dec_deg)) * cos(ha)))')} as parallactic_deg,
  {s6(K.airmass_sql(K.altitude('ra_deg', 'dec_deg', 'lat_deg', 'ha'), 'kasten-young'))} as airmass from hz""", _HA))
def parallactic_angle(t):
    d = t.photos.where(_LOCATED)
    args = [c("ra_deg"), c("dec_deg"), c("lat_deg"), c("lon_deg"), c("captured_at_utc")]
    d = d.withColumn("alt", sky.alt_az(*args)["altitude_deg"])
    return d.select(
        "photo_id", r6(sky.parallactic_angle(*args)).alias("parallactic_deg"),
        r6(F.when(c("alt") > 0, sky.airmass(c("alt"), "kasten-young"))).alias("airmass"),
    )


_SEP = "case when photo_id % 5 <> 0 then (photo_id % 181)::double end"
_ILL = "case when photo_id % 4 <> 0 then (photo_id % 100) / 100::double end"
_AIR = "case when photo_id % 3 <> 0 then 1 + (photo_id % 60) / 10::double end"
_Q = K.quality_sql("fwhm_arcsec", "eccentricity", "snr_estimate", "star_count", "ax", "ill", "sep", "bortle_estimate")


@query("quality_breakdown", "F13 F14", check("photos", f"""
select photo_id, {s6(_Q[0])} as quality, {_Q[1]} as missing,
  {", ".join(f"{s6(v)} as q_{k}" for k, v in _Q[2].items())}
from (select *, {_AIR} as ax, {_ILL} as ill, {_SEP} as sep from photos)"""))
def quality_breakdown(t):
    k = c("photo_id")
    d = t.photos.withColumns({
        "ax": F.when(k % 3 != 0, 1 + (k % 60) / 10.0),
        "ill": F.when(k % 4 != 0, (k % 100) / 100.0),
        "sep": F.when(k % 5 != 0, (k % 181).cast("double")),
    })
    drop = [n for n in d.columns if n.startswith("q_")]
    d = with_quality(d.drop(*drop), {"airmass": "ax", "moon_illumination": "ill", "moon_separation_deg": "sep"})
    qs = [r6(n).alias(n) for n in d.columns if n.startswith("q_")]
    return d.select("photo_id", r6("quality").alias("quality"), F.array_join("missing", ",").alias("missing"), *qs)


@query("dither_distances", "F15", check("photos", f"""
select a.photo_id, {s6("coalesce(least(1, sqrt(power(least(abs(a.dither_phase_x - b.dither_phase_x), 1 - abs(a.dither_phase_x - b.dither_phase_x)), 2) + power(least(abs(a.dither_phase_y - b.dither_phase_y), 1 - abs(a.dither_phase_y - b.dither_phase_y)), 2)) / sqrt(0.5::double)), 0)")} as phase_distance,
  {s6("coalesce(least(1, abs(log2(a.pixel_scale_arcsec / b.pixel_scale_arcsec)) / 2), 0)")} as scale_distance
from photos a join photos b on b.photo_id = a.photo_id + 1"""))
def dither_distances(t):
    p = t.photos.select("photo_id", c("dither_phase_x").alias("x"), c("dither_phase_y").alias("y"), c("pixel_scale_arcsec").alias("s"))
    nxt = p.select((c("photo_id") - 1).alias("photo_id"), c("x").alias("x2"), c("y").alias("y2"), c("s").alias("s2"))
    d = p.join(nxt, "photo_id")
    return d.select(
        "photo_id", r6(optics.phase_distance(c("x"), c("y"), c("x2"), c("y2"))).alias("phase_distance"),
        r6(optics.scale_distance(c("s"), c("s2"))).alias("scale_distance"),
    )


_QD = K.quality_sql("fwhm_arcsec", "eccentricity", "snr_estimate", "star_count", "ax", "illum", "sep", "coalesce(bortle_estimate, 5)")
_METRICS = f"""{K.moon_cte('photos')},
lit as (select photo_id, illum, {K.vincenty('ra_deg', 'dec_deg', 'mra', 'mdec')} as sep from moon),
alt as (select photo_id, {K.altitude('ra_deg', 'dec_deg', 'lat_deg', 'ha')} as altitude from hz),
joined as (select p.*, lit.illum, lit.sep, alt.altitude, {K.airmass_sql('alt.altitude')} as ax
  from photos p left join lit using (photo_id) left join alt using (photo_id))"""


@query("derived_metrics", "F17", check("photos", f"""
select photo_id, {s6('altitude')} as altitude_deg, {s6('ax')} as airmass, {s6('illum')} as illumination,
  {s6('sep')} as moon_separation_deg, {s6('focal_length_mm / focal_ratio')} as aperture_mm,
  {s6(_DIFF)} as diffraction_arcsec,
  {s6('206264.80624709636::double * (pixel_pitch_um * 1e-6) / (focal_length_mm * 1e-3)')} as pixel_scale_arcsec,
  {s6(_QD[0])} as quality_score from joined""", _HA + ", " + _METRICS))
def derived_metrics(t):
    d = ingest.derived_metrics(t.photos.drop("pixel_scale_arcsec"))
    return d.select(
        "photo_id", r6("d_altitude_deg").alias("altitude_deg"), r6("d_airmass").alias("airmass"),
        r6("d_moon_illumination").alias("illumination"),
        r6("d_moon_separation_deg").alias("moon_separation_deg"),
        r6("d_aperture_mm").alias("aperture_mm"), r6("d_diffraction_arcsec").alias("diffraction_arcsec"),
        r6("d_pixel_scale_arcsec").alias("pixel_scale_arcsec"), r6("d_quality_score").alias("quality_score"),
    )


@query("user_wins_merge", "F18", check("photos analysis", f"""
select photo_id, coalesce(p.width_px, a.width_px) as width_px,
  {s6('coalesce(p.focal_length_mm, a.focal_length_mm)')} as focal_length_mm,
  {s6('coalesce(p.snr_estimate, a.snr_estimate)')} as snr_estimate,
  coalesce(p.star_count, a.star_count) as star_count, {s6('coalesce(p.fwhm_arcsec, a.fwhm_arcsec)')} as fwhm_arcsec,
  {s6('coalesce(p.eccentricity, a.eccentricity)')} as eccentricity
from photos p left join analysis a using (photo_id)"""))
def user_wins_merge(t):
    d = ingest.merge_analysis(t.photos, t.analysis)
    return round_all(d.select("photo_id", "width_px", "focal_length_mm", "snr_estimate", "star_count", "fwhm_arcsec", "eccentricity"))


@query("local_time_to_utc", "F19", check("photos analysis", """
select photo_id, strftime(case when use and utc_offset_minutes is not null
    then captured_at_local - to_minutes(cast(utc_offset_minutes as bigint))
    when use and utc_offset_minutes is null and captured_at_utc is null then captured_at_local
    else captured_at_utc end, '%Y-%m-%d %H:%M:%S') as utc,
  case when use and utc_offset_minutes is null and captured_at_utc is null then 'inferred'
    when use then 'exif' else time_source end as time_source
from (select *, coalesce(time_source, '') <> 'user' and captured_at_local is not null as use
  from photos p join analysis a using (photo_id))"""))
def local_time_to_utc(t):
    a = t.analysis.select("photo_id", "captured_at_local", "utc_offset_minutes", "time_source")
    d = ingest.with_utc(t.photos.join(a, "photo_id"))
    return d.select("photo_id", F.date_format("captured_at_utc", "yyyy-MM-dd HH:mm:ss").alias("utc"), "time_source")


@query("gps_to_degrees", "F20", check("analysis", f"""
select photo_id, {s6('''case when upper(gps_ref) in ('S', 'W') then -1 else 1 end * (gps_num[1]::double / gps_den[1]
  + coalesce(gps_num[2]::double / nullif(gps_den[2], 0), 0) / 60 + gps_num[3]::double / gps_den[3] / 3600)''')} as degrees
from analysis"""))
def gps_to_degrees(t):
    return t.analysis.select("photo_id", r6(optics.gps_degrees(c("gps_num"), c("gps_den"), c("gps_ref"))).alias("degrees"))
