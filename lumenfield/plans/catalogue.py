"""Queries over the photo catalogue: search, objects, coverage, privacy, validation, text forms."""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import functions as F

from lumenfield.functions import text
from lumenfield.functions.licences import with_licence_flags
from lumenfield.functions.privacy import CENTROIDS, with_published_location
from lumenfield.operators import coverage, objects, search, validate
from lumenfield.operators.search import Near, PhotoSearch
from lumenfield.plans import checks as K
from lumenfield.plans.checks import s6
from lumenfield.plans.registry import check, query, r6, round_all

c = F.col
VIS = "deleted_at is null and status = 'ready'"
# RA, Dec, radius: ordinary field, RA wrap on both sides, both poles, and very wide cones
CONES = ((180.0, 10.0, 5.0), (0.5, -20.0, 4.0), (359.5, 30.0, 4.0), (90.0, 89.0, 6.0), (200.0, -88.5, 7.0), (45.0, 45.0, 45.0), (300.0, -10.0, 90.0))


@query("photo_scan", "S1", check("photos", f"""
select photo_id, {s6('lat_deg')} as lat_deg, {s6('lon_deg')} as lon_deg, {s6('quality_score')} as quality_score,
  strftime(captured_at_utc, '%Y-%m-%d %H:%M:%S') as captured from photos"""))
def photo_scan(t):
    return t.photos.select("photo_id", r6("lat_deg").alias("lat_deg"), r6("lon_deg").alias("lon_deg"),
        r6("quality_score").alias("quality_score"), F.date_format("captured_at_utc", "yyyy-MM-dd HH:mm:ss").alias("captured"))


@query("photo_licence_flags", "S2 J2", check("photos licences", """
select photo_id, code as license, allows_commercial, allows_derivatives, requires_attribution, requires_sharealike,
  restrictiveness::bigint as restrictiveness from photos join licences on code = license"""))
def photo_licence_flags(t):
    d = with_licence_flags(t.photos.select("photo_id", "license"))
    return d.select("photo_id", "license", "allows_commercial", "allows_derivatives", "requires_attribution",
        "requires_sharealike", c("restrictiveness").cast("bigint").alias("restrictiveness"))


@query("visible_photos", "P1", check("photos", f"""
select photo_id, 'public' as scope from photos where {VIS}
union all select photo_id, 'owner' from photos where deleted_at is null and (status = 'ready' or owner_id = 7)"""))
def visible_photos(t):
    pub = t.photos.where(search.visible()).select("photo_id", F.lit("public").alias("scope"))
    return pub.unionByName(search.visible_to(t.photos, 7).select("photo_id", F.lit("owner").alias("scope")))


def _found(t, **kw):
    return search.apply_filters(t.photos, PhotoSearch(**kw), t.objects)


@query("photos_of_object", "P2", check("photos", f"select photo_id from photos where {VIS} and object_id = 7"))
def photos_of_object(t):
    return _found(t, object_id=7).select("photo_id")


@query("resolve_object_tokens", "P3", check("objects", """select token, coalesce((select min(object_id) from objects where object_id::varchar = token),
  (select min(object_id) from objects where upper(catalog || catalog_number) = upper(replace(token, ' ', ''))
    or upper(common_name) = upper(token) or upper(common_name_es) = upper(token) or list_contains(aliases, token))) as object_id
from tok""", """tok as (select distinct case object_id % 5 when 0 then lower(catalog) || ' ' || catalog_number
  when 1 then upper(common_name) when 2 then aliases[2] when 3 then object_id::varchar else common_name_es end as token from objects)"""))
def resolve_object_tokens(t):
    o = t.objects
    m = c("object_id") % 5
    token = (F.when(m == 0, F.concat(F.lower("catalog"), F.lit(" "), "catalog_number")).when(m == 1, F.upper("common_name"))
        .when(m == 2, F.element_at("aliases", 2)).when(m == 3, c("object_id").cast("string")).otherwise(c("common_name_es")))
    return objects.resolve_tokens(o.select(token.alias("token")), o)


@query("owner_photos", "P4", check("photos", f"""
select photo_id, 'listed' as how from photos where {VIS} and owner_id = 11
union all select photo_id, 'by_id' from photos where photo_id = 34
union all select photo_id, 'by_id_live' from photos where photo_id = 34 and deleted_at is null"""))
def owner_photos(t):
    p = t.photos
    parts = [_found(t, owner_id=11).select("photo_id", F.lit("listed").alias("how")),
        search.by_id(p, 34, include_deleted=True).select("photo_id", F.lit("by_id").alias("how")),
        search.by_id(p, 34).select("photo_id", F.lit("by_id_live").alias("how"))]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("sky_cone", "P5", check("photos", " union all ".join(
    f"select {i} as cone, photo_id from photos where {VIS} and ra_deg is not null and {K.vincenty('ra_deg', 'dec_deg', f'{ra}::double', f'{de}::double')} <= {r}"
    for i, (ra, de, r) in enumerate(CONES))))
def sky_cone(t):
    parts = [_found(t, ra=ra, dec=de, radius=r).select(F.lit(i).alias("cone"), "photo_id") for i, (ra, de, r) in enumerate(CONES)]
    return reduce(lambda a, b: a.unionByName(b), parts)


_NEAR = ((-24.6, -70.4, 900.0), (28.3, -16.5, 1500.0), (0.0, 179.9, 700.0))


@query("near_place", "P6", check("photos", " union all ".join(
    f"select {i} as place, photo_id from photos where {VIS} and lat_deg is not null and {K.lambert('lat_deg', 'lon_deg', f'({la})::double', f'({lo})::double')} <= {km * 1000}"
    for i, (la, lo, km) in enumerate(_NEAR))))
def near_place(t):
    parts = [_found(t, near=Near(*n)).select(F.lit(i).alias("place"), "photo_id") for i, n in enumerate(_NEAR)]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("date_range", "P7", check("photos", f"""select photo_id from photos where {VIS}
 and captured_at_utc >= timestamp '1997-03-01 00:00:00' and captured_at_utc <= timestamp '1997-05-31 23:59:59.999999'"""))
def date_range(t):
    return _found(t, date_from=date(1997, 3, 1), date_to=date(1997, 5, 31)).select("photo_id")


@query("focal_range", "P8", check("photos", f"select photo_id from photos where {VIS} and focal_length_mm between 48 and 400"))
def focal_range(t):
    return _found(t, min_focal=48.0, max_focal=400.0).select("photo_id")


@query("shot_filters", "P9", check("photos", f"""select photo_id from photos where {VIS} and filter_name = 'Ha'
 and quality_score >= 0.5 and is_tracked and is_plate_solved"""))
def shot_filters(t):
    return _found(t, filter_name="Ha", min_quality=0.5, tracked=True, plate_solved=True).select("photo_id")


@query("licence_filter", "P10 U2", check("photos licences", f"""
select photo_id, 'commercial' as use from photos where {VIS} and license in (select code from licences where allows_commercial)
union all select photo_id, 'derivatives' from photos where {VIS} and license in (
  select code from licences where allows_derivatives intersect select * from (values ('CC-BY-4.0'), ('ARR'), ('CC-BY-NC-4.0')))"""))
def licence_filter(t):
    a = _found(t, usable_for="commercial").select("photo_id", F.lit("commercial").alias("use"))
    b = _found(t, usable_for="derivatives", licenses=("CC-BY-4.0", "ARR", "CC-BY-NC-4.0"))
    return a.unionByName(b.select("photo_id", F.lit("derivatives").alias("use")))


@query("stacking_filter", "P11", check("photos licences", f"""select photo_id from photos where {VIS}
 and license in (select code from licences where allows_derivatives) and allow_derivatives_in_stacks"""))
def stacking_filter(t):
    return _found(t, usable_for="stacking").select("photo_id")


@query("stack_candidates", "P12", check("photos", f"""select * from (select object_id, photo_id,
  row_number() over (partition by object_id order by quality_score desc nulls last, photo_id) as rank from photos
  where {VIS} and is_plate_solved and object_id is not null and (quality_score is null or quality_score >= 0.3)) where rank <= 40"""))
def stack_candidates(t):
    return search.stack_candidates(t.photos, 40, 0.3).select("object_id", "photo_id", "rank")


@query("object_text_search", "P13 L5", check("objects", """select object_id, catalog from objects
 where common_name ilike '%ring%' or common_name_es ilike '%ring%' or catalog_number ilike '%ring%'
 order by catalog, object_id limit 31"""))
def object_text_search(t):
    return objects.list_objects(t.objects, " ring ", 30).select("object_id", "catalog")


@query("object_list_second_page", "L5", check("objects", """select object_id, catalog from objects
 where (catalog, object_id) > ('IC', 500) order by catalog, object_id limit 51"""))
def object_list_second_page(t):
    return objects.list_objects(t.objects, None, 50, after=("IC", 500)).select("object_id", "catalog")


@query("photo_validation", "P14 W10", check("photos", """
select photo_id, concat_ws(',', case when not quality_score between 0 and 1 then 'quality_range' end,
  case when not bortle_estimate between 1 and 9 then 'bortle_range' end, case when dup then 'duplicate' end) as reasons
from (select *, row_number() over (partition by owner_id, checksum order by created_at, photo_id) > 1 as dup
  from photos where deleted_at is null)"""))
def photo_validation(t):
    return validate.validate_photos(t.photos).select("photo_id", F.array_join("reasons", ",").alias("reasons"))


@query("duplicate_uploads", "W10", check("photos", """
select photo_id, owner_id, checksum from (select *, row_number() over (partition by owner_id, checksum order by created_at, photo_id) as n
  from photos where deleted_at is null) where n > 1"""))
def duplicate_uploads(t):
    return validate.duplicates(t.photos).where("is_duplicate").select("photo_id", "owner_id", "checksum")


@query("provenance_validation", "P14", check("job_inputs", """
select job_id, photo_id, concat_ws(',', case when not weight between 0 and 1 then 'weight_range' end,
 case when count(*) over (partition by job_id, photo_id) > 1 then 'duplicate_input' end) as reasons from job_inputs"""))
def provenance_validation(t):
    return validate.validate_inputs(t.job_inputs).select("job_id", "photo_id", F.array_join("reasons", ",").alias("reasons"))


_CENT = "cent(code, clat, clon) as (values " + ", ".join(f"('{a}', {b}::double, {d}::double)" for a, b, d in CENTROIDS) + ")"
_PUB = f"""{_CENT}, pub as (select p.*, case when lat_deg is null then null when own then 'exact' when location_precision = 'exact' then 'exact'
    when location_precision = 'city' then 'city' when location_precision = 'country' and code is not null then 'country' end as shown
  from (select *, owner_id = 7 as own from photos) p left join cent on code = country_code)"""
_PLAT = "case shown when 'exact' then lat_deg when 'city' then round(round_even(lat_deg / 0.1::double, 0) * 0.1::double, 6) when 'country' then clat end"
_PLON = _PLAT.replace("lat_deg", "lon_deg").replace("clat", "clon")


@query("published_locations", "F23 J19", check("photos", f"""
select photo_id, shown as precision, {s6(_PLAT)} as lat, {s6(_PLON)} as lon,
 case shown when 'exact' then location_accuracy_m when 'city' then round(sqrt(power(5566::double, 2) + power(coalesce(location_accuracy_m, 0), 2)), 1) end as accuracy_m,
 case shown when 'exact' then elevation_m when 'city' then round_even(elevation_m / 100, 0) * 100 end as elevation_m,
 case when shown is not null then country_code end as country_code
from pub left join cent on code = country_code""", _PUB.replace("owner_id = 7 as own", "false as own")))
def published_locations(t):
    d = with_published_location(t.photos)
    L = "location."
    return d.select("photo_id", c(L + "precision").alias("precision"), r6(L + "lat").alias("lat"), r6(L + "lon").alias("lon"),
        c(L + "accuracy_m").alias("accuracy_m"), c(L + "elevation_m").alias("elevation_m"), c(L + "country_code").alias("country_code"))


@query("public_photo_projection", "P17", check("photos", f"""
select photo_id, {s6(_PLAT)} as lat, {s6(_PLON)} as lon, {s6('focal_length_mm / focal_ratio')} as aperture_mm,
 {s6('1.22::double * 550e-9 / (focal_length_mm / focal_ratio * 1e-3) * 206264.80624709636::double')} as diffraction,
 {s6('ra_deg')} as ra, quality_score is null as unrated, license, allow_ai_training
from pub left join cent on code = country_code where deleted_at is null and (status = 'ready' or owner_id = 7)""", _PUB))
def public_photo_projection(t):
    d = search.public_projection(search.visible_to(t.photos, 7), 7)
    return d.select("photo_id", r6("location.lat").alias("lat"), r6("location.lon").alias("lon"),
        r6("optics.aperture_mm").alias("aperture_mm"), r6("optics.diffraction_limit_arcsec").alias("diffraction"),
        r6("astrometry.ra_deg").alias("ra"), c("quality.quality_score").isNull().alias("unrated"),
        c("licence.license").alias("license"), c("licence.allow_ai_training").alias("allow_ai_training"))


@query("photos_by_alias", "J1", check("photos objects", f"""select photo_id from photos where {VIS} and object_id in (
 select object_id from objects where list_contains(aliases, 'Obj-7') or lower(common_name) = 'obj-7' or catalog || catalog_number = 'Obj-7')"""))
def photos_by_alias(t):
    return _found(t, object_alias="Obj-7").select("photo_id")


@query("photos_in_given_order", "J4 J21", check("photos collection_items", """
select collection_id, photo_id, position from collection_items join photos using (photo_id) where deleted_at is null"""))
def photos_in_given_order(t):
    d = search.get_many(t.photos, t.collection_items, ["collection_id", "position"])
    return d.select("collection_id", "photo_id", c("position").cast("bigint").alias("position"))


@query("unavailable_photos", "J5 U3", check("photos collection_items", """
select collection_id, i.photo_id, case when p.photo_id is null then 'not_found' else 'not_ready' end as reason
from collection_items i left join (select * from photos where deleted_at is null) p using (photo_id)
where p.photo_id is null or p.status <> 'ready'"""))
def unavailable_photos(t):
    return search.unavailable(t.collection_items, t.photos).select("collection_id", "photo_id", "reason")


def _page(order, cond=""):
    return check("photos", f"select photo_id from photos where {VIS} {cond} order by {order} limit 25")


@query("search_page_quality", "W1 L1 P15", _page("quality_score desc nulls last, photo_id desc"))
def search_page_quality(t):
    return search.search(t.photos, PhotoSearch()).select("photo_id")


@query("search_page_after_cursor", "W1 F36", _page("quality_score desc nulls last, photo_id desc",
    "and (quality_score < 0.625 or (quality_score = 0.625 and photo_id < 9000) or quality_score is null)"))
def search_page_after_cursor(t):
    q = PhotoSearch(cursor=search.encode_cursor(0.625, 9000))
    return search.search(t.photos, q).select("photo_id")


@query("search_page_null_tail", "W1", _page("quality_score desc nulls last, photo_id desc", "and quality_score is null and photo_id < 9000"))
def search_page_null_tail(t):
    return search.search(t.photos, PhotoSearch(cursor=search.encode_cursor(None, 9000))).select("photo_id")


@query("search_page_recent", "W1 L1", _page("captured_at_utc desc nulls last, photo_id desc"))
def search_page_recent(t):
    return search.search(t.photos, PhotoSearch(sort="recent")).select("photo_id")


@query("search_page_nearest", "W1 L1", _page(f"{K.lambert('lat_deg', 'lon_deg', '40.2::double', '(-3.6)::double')}, photo_id",
    f"and lat_deg is not null and {K.lambert('lat_deg', 'lon_deg', '40.2::double', '(-3.6)::double')} <= 3000000"))
def search_page_nearest(t):
    return search.search(t.photos, PhotoSearch(sort="nearest", near=Near(40.2, -3.6, 3000.0))).select("photo_id")


@query("cursor_round_trip", "F36", check("photos", "select photo_id, star_count::varchar as v, photo_id::varchar as id from photos"))
def cursor_round_trip(t):
    cur = search.cursor_column(c("star_count"), c("photo_id"))
    d = t.photos.select("photo_id", search.cursor_fields(cur).alias("k"))
    return d.select("photo_id", c("k.v").alias("v"), c("k.id").alias("id"))


# --- coverage ----------------------------------------------------------------------------------
_EDGES = coverage.FOCAL_EDGES
_LOG = "case " + " ".join(f"when coalesce(focal_length_mm, 0) >= {e} then {e}" for e in reversed(_EDGES)) + " end"
_EQ = "[" + ", ".join(map(str, _EDGES)) + "][least(8, floor(coalesce(focal_length_mm, 0) / 400)::int) + 1]"


def _hist(band):
    return f"""hist as (select object_id, coalesce(strftime(captured_at_utc, '%Y-%m'), 'unknown') as period,
      coalesce(case when location_precision <> 'hidden' then floor(lat_deg / 15)::bigint * 15 end, -999) as lat_bin,
      {band} as focal_bin, count(*) as n, max(quality_score) as best
      from photos where {VIS} and object_id is not null group by all)"""


def _hist_df(d):
    return d.select("object_id", "period", c("lat_bin").cast("bigint").alias("lat_bin"), c("focal_bin").cast("bigint").alias("focal_bin"), "n", r6("best_quality").alias("best_quality"))


_HSEL = f"select object_id, period, lat_bin, focal_bin::bigint as focal_bin, n, {s6('best')} as best_quality from hist"


@query("coverage_histogram", "A2", check("photos", _HSEL, _hist(_LOG)))
def coverage_histogram(t):
    return _hist_df(coverage.histogram(t.photos))


@query("coverage_histogram_equal_width", "A2", check("photos", _HSEL, _hist(_EQ)))
def coverage_histogram_equal_width(t):
    return _hist_df(coverage.histogram(t.photos, "equal_width"))


_RAW = f"""raw as (select object_id, lat_deg, lon_deg, location_precision, country_code, max(location_accuracy_m) as location_accuracy_m,
   max(elevation_m) as elevation_m, count(*) as n from photos where {VIS} and object_id is not null and lat_deg is not null
   and location_precision <> 'hidden' group by all)"""


@query("raw_sites", "A3", check("photos", f"""select object_id, {s6('lat_deg')} as lat_deg, {s6('lon_deg')} as lon_deg, location_precision,
 country_code, location_accuracy_m, elevation_m, n from raw""", _RAW))
def raw_sites(t):
    return round_all(coverage.raw_sites(t.photos), ("location_accuracy_m", "elevation_m"))


_SITES = _RAW + ", " + _CENT + """, shown as (select object_id, n, list_position(['exact', 'city', 'country', 'hidden'], location_precision) as rank,
   case location_precision when 'exact' then lat_deg when 'city' then round_even(lat_deg / 0.1::double, 0) * 0.1::double else clat end as la,
   case location_precision when 'exact' then lon_deg when 'city' then round_even(lon_deg / 0.1::double, 0) * 0.1::double else clon end as lo
   from raw left join cent on code = country_code)"""


@query("published_sites", "A4", check("photos", f"""select object_id, {s6('lat')} as lat, {s6('lon')} as lon, n, ['exact', 'city', 'country', 'hidden'][rank] as precision from (
  select object_id, round(la, 6) as lat, round(lo, 6) as lon, sum(n)::bigint as n, max(rank) as rank from shown where la is not null group by all)""", _SITES))
def published_sites(t):
    return round_all(coverage.published_sites(coverage.raw_sites(t.photos)))


_SUM = _hist(_LOG) + """, tot as (select object_id, sum(n)::bigint as total, coalesce(sum(n) filter (lat_bin >= 0), 0)::bigint as north,
   coalesce(sum(n) filter (lat_bin < 0 and lat_bin <> -999), 0)::bigint as south, min(focal_bin) filter (focal_bin > 0)::double as focal_min,
   max(focal_bin) filter (focal_bin > 0)::double as focal_max, count(distinct period) filter (period <> 'unknown') as periods from hist group by 1),
 summ as (select *, coalesce(least(1, log2(focal_max / focal_min) / 2), 0) as scale_diversity from tot)"""


@query("coverage_summary", "A5", check("photos", f"select * exclude (scale_diversity), {s6('scale_diversity')} as scale_diversity from summ", _SUM))
def coverage_summary(t):
    return round_all(coverage.summary(coverage.histogram(t.photos)))


@query("coverage_gaps", "A6", check("photos objects", """
select object_id, total, unnest(list_filter([case when north + south > 0 and south < (north + south) * 0.2 then 'hemisphere_south'
   when north + south > 0 and north < (north + south) * 0.2 then 'hemisphere_north' end,
   case when scale_diversity < 0.25 and total > 0 then 'focal' end, case when periods > 0 and periods < 3 then 'temporal' end,
   case when total = 0 then 'empty' end], lambda x: x is not null)) as gap
from (select object_id, coalesce(total, 0) as total, coalesce(north, 0) as north, coalesce(south, 0) as south,
  coalesce(periods, 0) as periods, coalesce(scale_diversity, 0) as scale_diversity from objects left join summ using (object_id))""", _SUM))
def coverage_gaps(t):
    return coverage.gaps(t.objects, coverage.summary(coverage.histogram(t.photos)))


@query("public_totals", "A1", check("photos objects jobs", f"""
select (select count(*) from photos where {VIS}) as photo_count, (select count(distinct owner_id) from photos where {VIS}) as contributor_count,
 (select coalesce(sum(exposure_seconds), 0) from photos where {VIS}) as exposure_seconds, (select count(*) from objects) as object_count,
 (select count(*) from jobs where status = 'succeeded' and is_public) as reconstruction_count"""))
def public_totals(t):
    return coverage.public_totals(t.photos, t.objects, t.jobs)


@query("object_counts", "A11", check("photos objects jobs", f"""select object_id, coalesce(p.n, 0) as photo_count, coalesce(j.n, 0) as reconstruction_count
 from objects left join (select object_id, count(*) as n from photos where {VIS} group by 1) p using (object_id)
 left join (select object_id, count(*) as n from jobs where status = 'succeeded' and is_public group by 1) j using (object_id)"""))
def object_counts(t):
    return objects.with_counts(t.objects, t.photos, t.jobs).select("object_id", "photo_count", "reconstruction_count")


# --- text forms ----------------------------------------------------------------------------------


@query("object_designations", "F33", check("objects", """select object_id, case when catalog = 'M' then catalog || catalog_number
 else catalog || ' ' || catalog_number end as designation from objects"""))
def object_designations(t):
    return t.objects.select("object_id", objects.designation(c("catalog"), c("catalog_number")).alias("designation"))


@query("attribution_lines", "F34", check("photos users", """select photo_id, '"' || coalesce(title, 'Foto ' || photo_id) || '" — ' ||
 coalesce(attribution_name, display_name) || ' (' || license || ')' as line from photos join users on user_id = owner_id"""))
def attribution_lines(t):
    d = t.photos.join(t.users, c("user_id") == c("owner_id"))
    line = text.attribution_line(c("title"), c("photo_id"), c("attribution_name"), c("display_name"), c("license"))
    return d.select("photo_id", line.alias("line"))


_EXP = "exposure_seconds * (photo_id % 40) / 8::double"


@query("sky_text_forms", "F35", check("photos", f"""
select photo_id, lpad((rn // 360000)::varchar, 2, '0') || 'h ' || lpad((rn // 6000 % 60)::varchar, 2, '0') || 'm ' || lpad((rn % 6000 // 100)::varchar, 2, '0') || '.' || lpad((rn % 100)::varchar, 2, '0') || 's' as ra_text,
 case when dec_deg < 0 then '−' else '+' end || lpad((dn // 36000)::varchar, 2, '0') || '° ' || lpad((dn // 600 % 60)::varchar, 2, '0') || '′ ' || lpad((dn % 600 // 10)::varchar, 2, '0') || '.' || (dn % 10)::varchar || '″' as dec_text,
 case when e <= 0 then '0 s' when e < 1 then '1/' || floor(1 / e + 0.5)::bigint || ' s'
   when e < 60 then regexp_replace(printf('%.2f', floor(e * 100 + 0.5) / 100), '\\.?0+$', '') || ' s'
   when floor(e / 60) < 60 then floor(e / 60)::bigint || ' min ' || lpad(floor(e - floor(e / 60) * 60 + 0.5)::bigint::varchar, 2, '0') || ' s'
   else floor(floor(e / 60) / 60)::bigint || ' h ' || lpad((floor(e / 60)::bigint % 60)::varchar, 2, '0') || ' min' end as exposure_text,
 case when quality_score is null then 'unrated' when quality_score < 0.35 then 'low' when quality_score < 0.6 then 'fair' when quality_score < 0.82 then 'good' else 'excellent' end as tier
from (select *, floor(ra_deg / 15 * 360000 + 0.5)::bigint % 8640000 as rn, floor(abs(dec_deg) * 36000 + 0.5)::bigint as dn, {_EXP} as e from photos)"""))
def sky_text_forms(t):
    e = c("exposure_seconds") * (c("photo_id") % 40) / 8.0
    return t.photos.select("photo_id", text.format_ra(c("ra_deg")).alias("ra_text"), text.format_dec(c("dec_deg")).alias("dec_text"),
        text.format_exposure(e).alias("exposure_text"), text.quality_tier(c("quality_score")).alias("tier"))


def _ascii_sql(x):
    for a, b in text.ASCII_SUBSTITUTES:
        x = f"replace({x}, '{a}', '{b.replace(chr(39), chr(39) * 2)}')" if a not in "‘’" else f"replace({x}, '{a}', '''')"
    return f"left(regexp_replace(regexp_replace({x}, '[^\\x00-\\x7F]', '?', 'g'), '[^\\x20-\\x7E]', ' ', 'g'), 72)"


@query("header_safe_text", "F38", f"select doc_id, {_ascii_sql('text')} as card from documents")
def header_safe_text(t):
    return t.given("documents").select("doc_id", text.ascii_safe(c("text")).alias("card"))


@query("json_fields", "F41", "select event_id, json_extract_string(props, '$.k')::bigint as k from events where json_valid(props)")
def json_fields(t):
    d = t.given("events").select("event_id", F.from_json("props", "k bigint").alias("p"))
    return d.select("event_id", c("p.k").alias("k"))
