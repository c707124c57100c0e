"""Catalogue tables derived from the given tables, as one SQL text per table.

Every rule is deterministic arithmetic on the source keys, so a derived table grows with its source.
``1e-1`` style literals are doubles in both dialects.
"""

from __future__ import annotations

from collections.abc import Callable

from lumenfield.sources.dialect import SparkText, frac

LICENCE_ORDER = (
    "CC0-1.0",
    "CC-BY-4.0",
    "CC-BY-SA-4.0",
    "CC-BY-NC-4.0",
    "CC-BY-NC-SA-4.0",
    "CC-BY-ND-4.0",
    "CC-BY-NC-ND-4.0",
    "ARR",
)
#: pixel grid of a derived frame, and orders per derived stack
GRID = 24
ORDERS_PER_STACK = 2500


def _pick(expr: str, values) -> str:
    arms = " ".join(f"when {i} then {v}" for i, v in enumerate(values))
    return f"case {expr} {arms} end"


def _text(values) -> list[str]:
    return [f"'{v}'" for v in values]


def photos(d: SparkText) -> str:
    k, c = "o_orderkey", "o_custkey"
    base = f"""
    select {k} as photo_id, {c} as owner_id,
      case when {k} % 13 = 0 then null else {c} % 50 end as object_id,
      case {k} % 10 when 0 then 'processing' when 1 then 'failed' else 'ready' end as status,
      case when {k} % 17 = 0 then {d.ts('o_orderdate')} end as deleted_at,
      {d.ts('o_orderdate')} as created_at,
      case when {k} % 29 = 0 then null else {d.plus_minutes(d.ts('o_orderdate'), f'{k} % 1440')} end
        as captured_at_utc,
      {k} % 7 <> 0 as is_plate_solved,
      case when {k} % 7 <> 0 then 36e1 * {frac(f'{k} * 7548776662e-10')} end as ra_deg,
      case when {k} % 7 <> 0 then degrees(asin(2e0 * {frac(f'{k} * 5698402910e-10')} - 1e0)) end
        as dec_deg,
      case when {k} % 11 = 0 then null
        else degrees(asin(2e0 * {frac(f'{k} * 7320508076e-10')} - 1e0)) end as lat_deg,
      case when {k} % 11 = 0 then null else 36e1 * {frac(f'{k} * 4142135624e-10')} - 18e1 end
        as lon_deg,
      {_pick(f'{k} % 4', _text(['exact', 'city', 'country', 'hidden']))} as location_precision,
      {_pick(f'{c} % 8', _text(['ES', 'CL', 'AU', 'US', 'DE', 'JP', 'ZZ']))} as country_code,
      case when {k} % 6 = 0 then null else cast(5 + {k} % 50 as double) end as location_accuracy_m,
      case when {k} % 9 = 0 then null else cast(({k} * 37) % 3000 as double) end as elevation_m,
      case when {k} % 31 = 0 then null else 24e0 * power(2e0, cast({k} % 8 as double)) end
        as focal_length_mm,
      cast(2 + {k} % 6 as double) as focal_ratio,
      case when {k} % 37 = 0 then null else 3e0 + 5e-1 * ({k} % 4) end as pixel_pitch_um,
      cast(20 + {k} % 16 as double) as sensor_width_mm,
      case when {k} % 41 = 0 then null else 4000 + 100 * ({k} % 20) end as width_px,
      cast(cast(floor(o_totalprice) as bigint) % 600 as double) as exposure_seconds,
      case substr(o_orderpriority, 1, 1) when '1' then 'L' when '2' then 'R' when '3' then 'G'
        when '4' then 'B' else 'Ha' end as filter_name,
      {k} % 3 <> 0 as is_tracked,
      case when {c} % 50 % 3 = 0 then {_pick(f'{k} % 5', _text(LICENCE_ORDER[:5]))} else {_pick(f'{k} % 8', _text(LICENCE_ORDER))} end as license,
      {c} % 50 % 3 = 0 or {k} % 19 <> 0 as allow_derivatives_in_stacks,
      {k} % 5 <> 0 as allow_ai_training,
      case when {k} % 4 = 0 then null else concat('Author ', cast({c} as varchar(20))) end
        as attribution_name,
      case when {k} % 6 = 0 then null else concat('Field ', cast({k} as varchar(20))) end as title,
      case when {k} % 21 = 0 then null else 1e0 + ({k} % 80) / 1e1 end as fwhm_arcsec,
      case when {k} % 22 = 0 then null else ({k} % 70) / 1e2 end as eccentricity,
      case when {k} % 24 = 0 then null else cast(1 + ({k} * 7) % 150 as double) end as snr_estimate,
      case when {k} % 26 = 0 then null else ({k} * 13) % 3000 end as star_count,
      case when {k} % 27 = 0 then null else 1 + {k} % 9 end as bortle_estimate,
      case when {k} % 7 <> 0 then {frac(f'{k} * 6180339887e-10')} end as dither_phase_x,
      case when {k} % 7 <> 0 then {frac(f'{k} * 4142135624e-10')} end as dither_phase_y,
      concat('sha', cast({k} % 16 as varchar(20))) as checksum,
      cast(floor(o_totalprice) as bigint) * 1000 as original_bytes,
      cast(null as double) as airmass, cast(null as double) as moon_illumination
    from {d.src('orders')}"""
    sub = """
    select *,
      case when is_plate_solved then 206264806e-6 * pixel_pitch_um / focal_length_mm end
        as pixel_scale_arcsec,
      least(1e0, greatest(0e0, (8e0 - fwhm_arcsec) / 65e-1)) as q_fwhm,
      least(1e0, greatest(0e0, 1e0 - eccentricity / 6e-1)) as q_ecc,
      case when snr_estimate <= 3e0 then 0e0
        else least(1e0, ln(snr_estimate / 3e0) / ln(1e2 / 3e0)) end as q_snr,
      case when star_count <= 0 then 0e0
        else least(1e0, ln(1e0 + star_count) / ln(2001e0)) end as q_stars,
      (9e0 - bortle_estimate) / 8e0 as q_bortle
    from (""" + base + ") b"
    terms = [
        ("fwhm_arcsec", "q_fwhm", "30e-2"),
        ("snr_estimate", "q_snr", "22e-2"),
        ("eccentricity", "q_ecc", "10e-2"),
        ("star_count", "q_stars", "8e-2"),
        ("bortle_estimate", "q_bortle", "8e-2"),
    ]
    num = " + ".join(f"case when {v} is null then 0e0 else {w} * {q} end" for v, q, w in terms)
    den = " + ".join(f"case when {v} is null then 0e0 else {w} end" for v, _, w in terms)
    return f"""
    select *, case when photo_id % 23 = 0 then null
      when ({den}) <= 0e0 then 5e-1 else ({num}) / ({den}) end as quality_score
    from ({sub}) s"""


def objects(d: SparkText) -> str:
    p = "p_partkey"
    key = f"cast({p} as varchar(20))"
    return f"""
    select {p} as object_id,
      {_pick(f'{p} % 6', _text(['M', 'NGC', 'IC', 'Sh2', 'B', 'C']))} as catalog,
      {key} as catalog_number, p_name as common_name, concat('es ', p_name) as common_name_es,
      {d.array(f"concat('HIP ', {key})", f"concat('Obj-', cast({p} % 40 as varchar(20)))")} as aliases,
      36e1 * {frac(f'{p} * 7548776662e-10')} as ra_deg,
      degrees(asin(2e0 * {frac(f'{p} * 5698402910e-10')} - 1e0)) as dec_deg,
      lower(p_type) as object_type, p_retailprice / 1e2 as magnitude
    from {d.src('part')}"""


def users(d: SparkText) -> str:
    return f"""
    select c_custkey as user_id, c_name as display_name,
      (cast(floor(c_acctbal) as bigint) + 1000) * 500000 as quota_bytes
    from {d.src('customer')}"""


def jobs(d: SparkText) -> str:
    s = "s_suppkey"
    pipe = _pick(f"{s} % 3", _text(["classical-stack-v1", "drizzle-v1", "burst-sr-v1"]))
    status = _pick(f"{s} % 5", _text(["queued", "running", "succeeded", "failed", "cancelled"]))
    return f"""
    select {s} as job_id, {s} % 50 as object_id, {s} % 17 as requested_by, {pipe} as pipeline,
      {status} as status, {s} % 4 <> 0 as is_public,
      {d.plus_minutes("cast('2024-01-01 00:00:00' as timestamp)", f'({s} * 97) % 43200')} as created_at,
      case when {s} % 6 = 0 then {s} % 30 end as model_id,
      case when {s} % 9 = 0 then null else concat('r/', s_name) end as key_result,
      case when {s} % 2 = 0 then null else concat('u/', s_name) end as key_uncertainty,
      case when {s} % 11 = 0 then '' else concat('a/', s_name) end as key_attribution,
      2 + {s} % 20 as target_count
    from {d.src('supplier')}"""


def job_inputs(d: SparkText) -> str:
    return f"""
    select l_suppkey as job_id, l_orderkey as photo_id,
      max(case when l_returnflag = 'R' then 1 else 0 end) = 1 as was_rejected,
      (l_orderkey % 100) / 1e2 as weight,
      {_pick('l_orderkey % 8', _text(LICENCE_ORDER))} as snapshot_license
    from {d.src('lineitem')} group by l_suppkey, l_orderkey"""


def collection_items(d: SparkText) -> str:
    return f"""
    select l_partkey as collection_id, l_orderkey as photo_id, min(l_linenumber) as position
    from {d.src('lineitem')} group by l_partkey, l_orderkey"""


def models(d: SparkText) -> str:
    c = "c_custkey"
    return f"""
    select {c} as model_id, c_mktsegment as architecture,
      case when {c} % 9 = 0 then null else {c} % 120 end as training_run_id,
      {d.plus_minutes("cast('2024-01-01 00:00:00' as timestamp)", f'({c} * 37) % 43200')} as created_at,
      {c} % 4 = 0 as activate_requested
    from {d.src('customer')}"""


def training_runs(d: SparkText) -> str:
    return f"""
    select s_suppkey as training_run_id, case when s_suppkey % 7 = 0 then null
      else s_suppkey % 30 end as snapshot_id, s_acctbal as val_loss from {d.src('supplier')}"""


def snapshots(d: SparkText) -> str:
    return f"select n_nationkey as snapshot_id, n_name as label from {d.src('nation')}"


def embeddings(d: SparkText) -> str:
    return f"select vec_id as photo_id, embedding, label from {d.src('embeddings')}"


def activity(d: SparkText) -> str:
    """Views and downloads, uploads, job requests and failures as one event feed."""
    return f"""
    select event_id, {d.ts('ts')} as ts, user_id, event_type, value,
      {d.json_int('props', 'k')} as k, event_id % 1000 as photo_id
    from {d.src('events')}"""


def progress(d: SparkText) -> str:
    """Polled job states: one row per poll, job and time."""
    return f"""
    select user_id as job_id, {d.ts('ts')} as ts, event_id as poll_id,
      case event_type when 'signup' then 'queued' when 'purchase' then 'succeeded'
        when 'error' then 'failed' else 'running' end as status,
      floor(value / 1e1) / 1e1 as progress
    from {d.src('events')}"""


def storage_changes(d: SparkText) -> str:
    """Signed storage changes per owner: inserts, deletions, soft deletions and restores."""
    return f"""
    select event_id as change_id, user_id as owner_id, {d.ts('ts')} as ts,
      case event_type when 'signup' then 'insert' when 'error' then 'delete'
        when 'purchase' then 'restore' when 'click' then 'soft_delete' else 'update' end as change,
      case when event_id % 25 = 0 then null else cast(floor(value * 1e2) as bigint) end as bytes,
      event_id % 12 = 0 as was_deleted
    from {d.src('events')}"""


def pixels(d: SparkText) -> str:
    """Long pixel table: a 24 x 24 grid, seven frames per stack, one stack per 2500 orders.

    Cell values are integer cents averaged by integer division, so both engines agree exactly.
    """
    cents = "cast(floor(l_extendedprice * 1e2 + 5e-1) as bigint)"
    value = d.idiv(f"sum({cents})", "count(*)")
    return f"""
    select stack_id, frame_id, x, y, value, 9e2 + 4e0 * value as variance,
      (x * 7 + y * 3 + frame_id) % 97 = 0 as is_masked, value >= 99e1 as is_saturated
    from (select {d.idiv('l_orderkey', str(ORDERS_PER_STACK))} as stack_id,
        cast(l_linenumber as bigint) as frame_id, l_partkey % {GRID} as x,
        ((l_suppkey * 7 + l_orderkey) % {GRID}) as y, cast({value} as bigint) / 1e4 as value
      from {d.src('lineitem')}
      group by {d.idiv('l_orderkey', str(ORDERS_PER_STACK))}, l_linenumber, l_partkey % {GRID},
        ((l_suppkey * 7 + l_orderkey) % {GRID})) c"""


def frames(d: SparkText) -> str:
    """Per-frame scalars, one row per (stack, frame) that has pixels."""
    s = "(stack_id * 7 + frame_id)"
    return f"""
    select stack_id, frame_id, {GRID} as width, {GRID} as height,
      2e1 + 3e0 * ({s} % 5) as noise_sigma, 7e-1 + 5e-2 * ({s} % 7) as transparency,
      cast(3e1 * frame_id as double) as exposure_seconds, 2e0 + 5e-1 * (frame_id % 4) as fwhm_px,
      {s} % 6 = 0 as photometrically_unreliable, 15e-1 as gain_e_per_adu, 4e0 as read_noise_e,
      1e1 + stack_id % 340 as crval_ra, -5e1 + (stack_id * 13) % 100 as crval_dec,
      125e-1 + 6180339887e-10 * frame_id - floor(6180339887e-10 * frame_id) as crpix_x,
      125e-1 + 3247179572e-10 * frame_id - floor(3247179572e-10 * frame_id) as crpix_y,
      12e-1 + 1e-1 * (frame_id % 3) as scale_arcsec, 2e0 * frame_id as rotation_deg,
      {s} % 9 <> 0 as allow_ai_training, {s} % 11 <> 0 as is_solved,
      case when {s} % 5 = 0 then null else 1e0 + ({s} % 8) / 1e1 end as airmass,
      case when {s} % 8 = 0 then null else 2e1 + ({s} % 6) / 1e1 end as zero_point,
      case when {s} % 10 = 0 then null else ({s} % 60) / 1e2 end as psf_eccentricity,
      1e2 + ({s} % 9) as background_adu
    from (select distinct {d.idiv('l_orderkey', str(ORDERS_PER_STACK))} as stack_id,
      cast(l_linenumber as bigint) as frame_id from {d.src('lineitem')}) f"""


def sources(d: SparkText) -> str:
    """A source list per frame: star positions on the 24 x 24 grid with shapes."""
    return f"""
    select {d.idiv('o_orderkey', str(ORDERS_PER_STACK))} as stack_id, 1 + o_orderkey % 7 as frame_id,
      o_orderkey as source_id, 24e0 * {frac('o_orderkey * 7548776662e-10')} as x,
      24e0 * {frac('o_orderkey * 5698402910e-10')} as y,
      cast(cast(floor(o_totalprice * 1e2 + 5e-1) as bigint) as double) / 1e2 as flux,
      cast(o_orderkey % 900 as double) as peak, 8e-1 + (o_orderkey % 50) / 3e1 as a,
      5e-1 + (o_orderkey % 31) / 1e2 as b, (o_orderkey % 314) / 1e2 - 157e-2 as theta,
      5 + o_orderkey % 40 as npix
    from {d.src('orders')}"""


def analysis(d: SparkText) -> str:
    """What the automatic analysis of each upload measured."""
    k = "l_orderkey"
    return f"""
    select {k} as photo_id, 1000 + 10 * max(l_linenumber) as width_px,
      cast(max(l_quantity) as double) as focal_ratio,
      cast(case when {k} % 3 = 0 then null else 50 + 10 * max(l_linenumber) end as double)
        as focal_length_mm,
      cast(max(l_quantity) * 2e0 as double) as snr_estimate, 100 + min(l_linenumber) as star_count,
      cast(min(l_quantity) / 8e0 as double) as fwhm_arcsec,
      cast(max(l_discount) as double) as eccentricity,
      {d.ts('max(l_shipdate)')} as captured_at_local,
      case when {k} % 5 = 0 then null else ({k} % 25 - 12) * 60 end as utc_offset_minutes,
      case {k} % 3 when 0 then 'user' when 1 then 'exif' end as time_source,
      {d.array(f'{k} % 90', f'{k} % 60', f'{k} % 6000')} as gps_num,
      {d.array('cast(1 as bigint)', f'{k} % 2', 'cast(100 as bigint)')} as gps_den,
      case {k} % 4 when 0 then 'N' when 1 then 'S' when 2 then 'E' else 'w' end as gps_ref
    from {d.src('lineitem')} group by {k}"""


TABLES: dict[str, tuple[Callable[[SparkText], str], tuple[str, ...]]] = {
    "photos": (photos, ("orders",)),
    "objects": (objects, ("part",)),
    "analysis": (analysis, ("lineitem",)),
    "users": (users, ("customer",)),
    "jobs": (jobs, ("supplier",)),
    "job_inputs": (job_inputs, ("lineitem",)),
    "collection_items": (collection_items, ("lineitem",)),
    "models": (models, ("customer",)),
    "training_runs": (training_runs, ("supplier",)),
    "snapshots": (snapshots, ("nation",)),
    "vectors": (embeddings, ("embeddings",)),
    "activity": (activity, ("events",)),
    "progress": (progress, ("events",)),
    "storage_changes": (storage_changes, ("events",)),
    "pixels": (pixels, ("lineitem",)),
    "frames": (frames, ("lineitem",)),
    "sources": (sources, ("orders",)),
}
