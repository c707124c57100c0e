"""Queries over stacking jobs: licences, plans, selection, provenance, quotas and records."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenfield.functions import licences as L
from lumenfield.operators import digest, jobs, records, scan, search, selection, training
from lumenfield.plans.checks import s6
from lumenfield.plans.registry import check, query, r6, round_all

c = F.col
VIS = "deleted_at is null and status = 'ready'"


_CAND = f"""best as (select *, row_number() over (partition by object_id order by quality_score desc nulls last, photo_id) as rk from photos
   where {VIS} and is_plate_solved and object_id is not null and (quality_score is null or quality_score >= 0)),
 cand as (select j.job_id, j.target_count as target, b.* from jobs j join best b using (object_id) where rk <= least(2000, 4 * j.target_count + 200)),
 pool0 as (select c.*, coalesce(quality_score, 0.5) as q, dither_phase_x is not null and dither_phase_y is not null and coalesce(pixel_scale_arcsec, 0) > 0 as solved from cand c)"""


def _inputs(t):
    """Candidates of every selector job, with licence and consent: what the licence gate judges."""
    return selection.job_candidates(t.jobs, t.photos)


_IN = _CAND + """, ins as (select job_id, photo_id, license, allow_derivatives_in_stacks,
  l.*, case when not allows_derivatives then 'no_derivatives' when not allow_derivatives_in_stacks then 'stack_opt_out' end as reason
  from cand join licences l on code = license)"""


@query("resolved_licences", "A7", check("photos jobs licences", """
select job_id, count(*) as n_inputs, count(reason) as n_blocked, case when count(reason) > 0 then null
  when bool_or(not allows_commercial) and bool_or(requires_sharealike) then 'CC-BY-NC-SA-4.0'
  when bool_or(not allows_commercial) then 'CC-BY-NC-4.0' when bool_or(requires_sharealike) then 'CC-BY-SA-4.0'
  else arg_max(license, restrictiveness) end as resulting_license, true as requires_attribution from ins group by 1""", _IN))
def resolved_licences(t):
    return jobs.resolve_licence(_inputs(t))


@query("blocked_inputs", "A7", check("photos jobs licences", "select job_id, photo_id, license, reason from ins where reason is not null", _IN))
def blocked_inputs(t):
    return jobs.blocked_inputs(_inputs(t))


@query("most_restrictive_licence", "A8", check("photos jobs licences", "select job_id, arg_max(license, restrictiveness) as most_restrictive from ins group by 1", _IN))
def most_restrictive_licence(t):
    return jobs.most_restrictive(_inputs(t))


_NEW = "['" + "', '".join(r[0] for r in L.LICENCES) + "'][(photo_id % 5 + photo_id % 3 + 1)::int]"


@query("licence_changes", "F21 F22", check("photos licences", f"""
select photo_id, locked is null or b.restrictiveness <= a.restrictiveness as allowed,
  case when a.restrictiveness = b.restrictiveness then 'unchanged' when locked is null then 'not_locked'
   when b.restrictiveness < a.restrictiveness then 'relaxed' else 'locked' end as reason,
  a.allows_derivatives and allow_derivatives_in_stacks as consent
from (select *, {_NEW} as wanted, case when photo_id % 2 = 0 then created_at end as locked from photos)
 join licences a on a.code = license join licences b on b.code = wanted"""))
def licence_changes(t):
    codes = F.array(*[F.lit(r[0]) for r in L.LICENCES])
    d = t.photos.withColumn("wanted", F.element_at(codes, (c("photo_id") % 5 + c("photo_id") % 3 + 1).cast("int")))
    d = d.withColumn("locked", F.when(c("photo_id") % 2 == 0, c("created_at")))
    d = L.with_licence_flags(d)
    new = L.licence_table(t.spark).select(c("code").alias("wanted"), c("restrictiveness").alias("new_rank"))
    d = d.join(F.broadcast(new), "wanted")
    args = (c("restrictiveness"), c("new_rank"), c("locked"))
    return d.select("photo_id", L.change_allowed(*args).alias("allowed"), L.change_reason(*args).alias("reason"),
        L.stack_consent(c("allows_derivatives"), c("allow_derivatives_in_stacks")).alias("consent"))


_ENTRY = """entries as (select photo_id, case when photo_id % 9 = 0 then ' cc-by-nd' when photo_id % 14 = 0 then null else license end as license,
  allow_derivatives_in_stacks as consent from photos)"""


@query("manifest_gate", "P21", check("photos", """select photo_id, case when not consent then 'stack_opt_out'
  when trim(coalesce(license, '')) <> '' and (trim(license) in ('CC-BY-ND-4.0', 'CC-BY-NC-ND-4.0', 'ND', 'ARR', 'all-rights-reserved')
   or upper(license) like '%-ND-%' or upper(trim(license)) like '%-ND') then 'no_derivatives: ' || trim(license) end as reason from entries""", _ENTRY))
def manifest_gate(t):
    k = c("photo_id")
    code = F.when(k % 9 == 0, " cc-by-nd").when(k % 14 == 0, None).otherwise(c("license"))
    return t.photos.select("photo_id", L.manifest_rejection(code, c("allow_derivatives_in_stacks")).alias("reason"))


@query("job_request_rules", "P16", check("jobs job_inputs", """
select job_id, concat_ws(',', case when (n is not null) = (job_id % 4 = 0) then 'one_source' end, case when n < 2 then 'too_few' end,
  case when d < n then 'duplicates' end, case when pipeline not in ('burst-sr-v1', 'classical-stack-v1', 'drizzle-v1') then 'unknown_pipeline' end) as problems
from (select job_id, case when job_id % 7 = 0 then 'other' else pipeline end as pipeline from jobs)
 left join (select job_id, count(*) as n, count(distinct photo_id) as d from (
   select job_id, case when job_id % 5 = 0 then photo_id // 2 else photo_id end as photo_id from job_inputs where job_id % 3 <> 0) group by 1) using (job_id)"""))
def job_request_rules(t):
    r = t.jobs.withColumn("has_selector", c("job_id") % 4 == 0)
    r = r.withColumn("pipeline", F.when(c("job_id") % 7 == 0, "other").otherwise(c("pipeline")))
    w = t.job_inputs.where(c("job_id") % 3 != 0).withColumn("photo_id", F.when(c("job_id") % 5 == 0, F.floor(c("photo_id") / 2)).otherwise(c("photo_id")))
    d = jobs.request_problems(r, w)
    return d.select("job_id", F.array_join("problems", ",").alias("problems"))


_TOR = "sqrt(power(least(abs(e.x - b.x), 1 - abs(e.x - b.x)), 2) + power(least(abs(e.y - b.y), 1 - abs(e.y - b.y)), 2))"
_DIST = f"case when e.solved and b.solved then 0.7::double * least(1, {_TOR} / sqrt(0.5::double)) + 0.3::double * least(1, abs(log2(e.s / b.s)) / 2) else 0 end"
_GREEDY = f"""pool as (select *, solved or count(*) filter (solved) over (partition by job_id) < target as inpool from pool0 join licences on code = license where allows_derivatives and allow_derivatives_in_stacks),
 r as (select job_id, target, 0 as step, list({{'id': photo_id, 'q': q, 'x': dither_phase_x, 'y': dither_phase_y, 's': pixel_scale_arcsec, 'solved': solved, 'n': 1e300, 'sel': -1}} order by photo_id) as c from pool where inpool group by all
  union all select job_id, target, step + 1, list_transform(c, lambda e: {{'id': e.id, 'q': e.q, 'x': e.x, 'y': e.y, 's': e.s, 'solved': e.solved, 'n': least(e.n, {_DIST}), 'sel': case when e.id = b.id then step else e.sel end}})
   from (select *, list_reduce(list_filter(c, lambda e: e.sel < 0), lambda f, g: case when case when step = 0 then g.q else 0.65::double * g.q + 0.35::double * g.n end > case when step = 0 then f.q else 0.65::double * f.q + 0.35::double * f.n end then g else f end) as b
     from r where step < target and len(list_filter(c, lambda e: e.sel < 0)) > 0)),
 fin as (select job_id, unnest(arg_max(c, step)) as e from r group by 1),
 picks as (select job_id, e.id as photo_id, e.sel as rank, e.q as q from fin where e.sel >= 0)"""


_BLOCK = """, blk as (select job_id, count(*) filter (not (allows_derivatives and allow_derivatives_in_stacks)) as nb from pool0 join licences on code = license group by 1),
 npick as (select job_id, count(*) as ns from picks group by 1)"""


@query("plan_stacks", "W2 X1 S10 J8 U1 A12", check("photos jobs licences", f"""select job_id, photo_id, {s6("case when picks.rank is null then 0 when sum(picks.q) over w > 0 then picks.q / sum(picks.q) over w else 1 / count(picks.q) over w end")} as weight, picks.rank is null as was_rejected,
 case when picks.rank is null then case when inpool then 'not_selected' else 'unsolved' end end as rejection_reason, coalesce(picks.rank, -1) as rank, license as snapshot_license, attribution_name as snapshot_attribution_name
 from pool left join picks using (job_id, photo_id) join blk using (job_id) join npick using (job_id) where nb = 0 and ns >= 2 window w as (partition by job_id, picks.rank is null)""", _CAND + ", " + _GREEDY + _BLOCK))
def plan_stacks(t):
    return round_all(jobs.plan_stacks(t.jobs, t.photos).withColumn("rank", c("rank").cast("bigint")))


@query("plan_preview", "W2 X1 U1 S10", check("photos jobs licences", """select job_id, photo_id, case when picks.rank is not null then 'selected' else 'rejected' end as state,
  case when picks.rank is null then case when inpool then 'not_selected' else 'unsolved' end end as reason, coalesce(picks.rank, -1) as rank
 from pool left join picks using (job_id, photo_id)
 union all select job_id, photo_id, 'blocked', case when not allows_derivatives then 'no_derivatives' else 'stack_opt_out' end, -1
 from pool0 join licences on code = license where not (allows_derivatives and allow_derivatives_in_stacks)""", _CAND + ", " + _GREEDY))
def plan_preview(t):
    return jobs.preview(selection.job_candidates(t.jobs, t.photos)).select("job_id", "photo_id", "state", "reason", c("rank").cast("bigint").alias("rank"))


_FLOOR = "case when job_id % 6 = 0 then null else (job_id % 6) / 10::double end"
_FLOORED = f"""own as (select * exclude (rk) from (select j.job_id, j.target_count as target, b.*, row_number() over (partition by j.job_id order by quality_score desc nulls last, photo_id) as rk
   from jobs j join photos b using (object_id) where {VIS.replace('status', 'b.status')} and is_plate_solved and (quality_score is null or quality_score >= coalesce({_FLOOR}, 0.35::double))) where rk <= least(2000, 4 * target + 200)),
 pool0 as (select c.*, coalesce(quality_score, 0.5) as q, dither_phase_x is not null and dither_phase_y is not null and coalesce(pixel_scale_arcsec, 0) > 0 as solved from own c)"""
_STATES = """select job_id, photo_id, case when picks.rank is not null then 'selected' else 'rejected' end as state,
  case when picks.rank is null then case when inpool then 'not_selected' else 'unsolved' end end as reason, coalesce(picks.rank, -1) as rank
 from pool left join picks using (job_id, photo_id)
 union all select job_id, photo_id, 'blocked', case when not allows_derivatives then 'no_derivatives' else 'stack_opt_out' end, -1
 from pool0 join licences on code = license where not (allows_derivatives and allow_derivatives_in_stacks)"""


def _states(rows):
    return rows.select("job_id", "photo_id", "state", "reason", c("rank").cast("bigint").alias("rank"))


@query("plan_preview_own_floors", "W2 X1 P12", check("photos jobs licences", _STATES, _FLOORED + ", " + _GREEDY))
def plan_preview_own_floors(t):
    """Every selector with its own least quality; some jobs name none."""
    floor = F.when(c("job_id") % 6 != 0, (c("job_id") % 6) / 10.0)
    return _states(jobs.preview(selection.job_candidates(t.jobs.withColumn("min_quality", floor), t.photos, 0.35)))


# lists of each owner's photos; some name photos that are not ready, some photos that are blocked
_LISTED = f"({VIS} or owner_id % 4 = 0) and (allow_derivatives_in_stacks and license not in ('ARR', 'CC-BY-ND-4.0', 'CC-BY-NC-ND-4.0') or owner_id % 7 = 0)"
_EXPLICIT = f"""want as (select owner_id as job_id, count(*) over (partition by owner_id) as target, count(*) filter ({VIS}) over (partition by owner_id) as live, * from photos where owner_id is not null and {_LISTED}),
 pool0 as (select *, coalesce(quality_score, 0.5) as q, dither_phase_x is not null and dither_phase_y is not null and coalesce(pixel_scale_arcsec, 0) > 0 as solved from want where live = target)"""


def _listed(t):
    wanted = t.photos.where(f"owner_id is not null and {_LISTED}").select(c("owner_id").alias("job_id"), "photo_id")
    return jobs.explicit_candidates(wanted, t.photos)


@query("plan_preview_listed", "W2 X1 P16", check("photos licences", _STATES, _EXPLICIT + ", " + _GREEDY))
def plan_preview_listed(t):
    return _states(jobs.preview(_listed(t)))


@query("plan_stacks_listed", "X1 S10 J8", check("photos licences", f"""select job_id, photo_id, {s6("case when picks.rank is null then 0 when sum(picks.q) over w > 0 then picks.q / sum(picks.q) over w else 1 / count(picks.q) over w end")} as weight, picks.rank is null as was_rejected, license as snapshot_license
 from pool left join picks using (job_id, photo_id) join blk using (job_id) join npick using (job_id) where nb = 0 and ns >= 2 window w as (partition by job_id, picks.rank is null)""", _EXPLICIT + ", " + _GREEDY + _BLOCK))
def plan_stacks_listed(t):
    """Provenance of jobs that list their photos; a list with an unready or blocked photo gives none."""
    d = jobs.provenance_rows(jobs.preview(_listed(t)), t.photos)
    return round_all(d.select("job_id", "photo_id", "weight", "was_rejected", "snapshot_license"))


_LICENCE = """, lic as (select job_id, case when bool_or(not (allows_derivatives and allow_derivatives_in_stacks)) then null
  when bool_or(not allows_commercial) and bool_or(requires_sharealike) then 'CC-BY-NC-SA-4.0' when bool_or(not allows_commercial) then 'CC-BY-NC-4.0'
  when bool_or(requires_sharealike) then 'CC-BY-SA-4.0' else arg_max(license, restrictiveness) end as resulting_license
  from pool0 join licences on code = license group by 1)"""


@query("plan_status", "A7 A8 X1 P16", check("photos jobs licences", """select job_id, coalesce(ns, 0) as n_selected, coalesce(nb, 0) as n_blocked, resulting_license,
  case when coalesce(nb, 0) > 0 then 'licence_blocked' when coalesce(ns, 0) < 2 then 'too_few' else 'planned' end as status
 from jobs left join blk using (job_id) left join npick using (job_id) left join lic using (job_id)""", _CAND + ", " + _GREEDY + _BLOCK + _LICENCE))
def plan_status(t):
    return jobs.plan_status(t.jobs, selection.job_candidates(t.jobs, t.photos))


@query("selection_partition", "U5", check("photos jobs", """select job_id, n as candidates, least(target, case when ns >= target then ns else ne end) as selected, n - least(target, case when ns >= target then ns else ne end) as rejected, 0::bigint as both
 from (select job_id, any_value(target) as target, count(*) as n, count(*) filter (q >= 0.3) as ne, count(*) filter (q >= 0.3 and solved) as ns from pool0 group by 1)""", _CAND))
def selection_partition(t):
    """Per job: candidates, selected, rejected, and both at once (always zero)."""
    cand = selection.job_candidates(t.jobs, t.photos)
    s = selection.select_frames(cand, min_quality=0.3)
    n = cand.groupBy("job_id").agg(F.count("*").alias("candidates"))
    g = s.groupBy("job_id", "photo_id").agg(F.count_if("is_selected").alias("s"), F.count_if(~c("is_selected")).alias("r"))
    g = g.groupBy("job_id").agg(F.sum("s").alias("selected"), F.sum("r").alias("rejected"), F.count_if((c("s") > 0) & (c("r") > 0)).alias("both"))
    return n.join(g, "job_id")


_TOP = _CAND + ", " + _GREEDY + """, top as (select k.job_id, k.photo_id, dither_phase_x as x, dither_phase_y as y, pixel_scale_arcsec as s, focal_length_mm, focal_ratio
   from picks k join photos using (photo_id)),
 pairs as (select a.job_id, coalesce(least(1, sqrt(power(least(abs(a.x - b.x), 1 - abs(a.x - b.x)), 2) + power(least(abs(a.y - b.y), 1 - abs(a.y - b.y)), 2)) / sqrt(0.5::double)), 0) as p,
   coalesce(least(1, abs(log2(a.s / b.s)) / 2), 0) as o from top a join top b on a.job_id = b.job_id and a.photo_id < b.photo_id where a.s > 0 and b.s > 0 and a.x is not null and b.x is not null),
 div as (select job_id, coalesce(avg(p), 0) as phase, coalesce(avg(o), 0) as scale from (select distinct job_id from top) left join pairs using (job_id) group by 1)"""


def _top(t):
    """The frames that each job's preview selects, with their optics and dither."""
    rows = jobs.preview(selection.job_candidates(t.jobs, t.photos)).where("state = 'selected'").select("job_id", "photo_id")
    return rows.join(t.photos, "photo_id")


@query("pairwise_diversity", "A13 J13", check("photos jobs licences", f"select job_id, {s6('phase')} as phase_diversity, {s6('scale')} as scale_diversity from div", _TOP))
def pairwise_diversity(t):
    return round_all(selection.diversity(_top(t)))


@query("selection_weights", "A12", check("photos", f"""select object_id as job_id, photo_id,
 {s6('case when sum(q) over w > 0 then q / sum(q) over w else 1 / count(*) over w end')} as weight
 from (select *, coalesce(quality_score, 0.5) as q from photos where {VIS} and object_id is not null) window w as (partition by object_id)"""))
def selection_weights(t):
    d = t.photos.where(search.visible() & c("object_id").isNotNull())
    d = d.select(c("object_id").alias("job_id"), "photo_id", F.coalesce("quality_score", F.lit(0.5)).alias("quality"))
    return selection.with_weights(d).select("job_id", "photo_id", r6("weight").alias("weight"))


@query("plan_estimates", "A45", check("photos jobs licences", f"""
select job_id, n, {s6('phase')} as phase_diversity, {s6('scale')} as scale_diversity, sec * n as compute_seconds, {s6('sec * n * 0.000012::double')} as cost_usd,
 {s6('case when n >= 2 then 10 * log10(n::double) end')} as snr_gain_db, {s6('lim')} as best_limit_arcsec, {s6('finest / (1 + phase / 2)')} as reachable_scale_arcsec,
 concat_ws(',', case when phase < 0.15 then 'low_dither' end, case when finest < lim / 2 then 'oversampled' end, case when lim is not null then 'diffraction_ceiling' end, case when n < 5 then 'few_frames' end) as warnings,
 pipeline = 'burst-sr-v1' as uses_learned_model
from (select jobs.*, coalesce(n, 0) as n, coalesce(phase, 0) as phase, coalesce(scale, 0) as scale, finest, 1.22::double * 550e-9 / (ap * 1e-3) * 206264.80624709636::double as lim, case pipeline when 'classical-stack-v1' then 1.5::double when 'drizzle-v1' then 4 else 12 end as sec
 from jobs left join (select job_id, count(*) as n, max(focal_length_mm / focal_ratio) as ap, min(s) as finest from top group by 1) using (job_id) left join div using (job_id))""", _TOP))
def plan_estimates(t):
    d = jobs.plan_estimates(_top(t), t.jobs)
    return round_all(d.withColumn("warnings", F.array_join("warnings", ",")))


@query("publish_gate", "P19", check("jobs", """select job_id, concat_ws(',', case when coalesce(key_result, '') = '' then 'missing_result' end,
 case when (model_id is not null or pipeline = 'burst-sr-v1') and coalesce(key_uncertainty, '') = '' then 'missing_uncertainty_map' end,
 case when coalesce(key_attribution, '') = '' then 'missing_attribution' end) as violations from jobs"""))
def publish_gate(t):
    return jobs.publish_violations(t.jobs).select("job_id", F.array_join("violations", ",").alias("violations"))


@query("job_visibility", "P22", check("jobs", "select job_id from jobs where is_public or requested_by = 4"))
def job_visibility(t):
    return jobs.visible_jobs(t.jobs, 4).select("job_id")


@query("job_gallery", "L4 P22", check("jobs", """(select job_id, 'public' as list from jobs where is_public and status = 'succeeded' order by created_at desc, job_id desc limit 11)
 union all (select job_id, 'mine' from jobs where requested_by = 4 and (created_at, job_id) < (timestamp '2024-01-20 00:00:00', 50) order by created_at desc, job_id desc limit 6)"""))
def job_gallery(t):
    a = jobs.gallery(t.jobs, 10).select("job_id", F.lit("public").alias("list"))
    b = jobs.gallery(t.jobs, 5, mine=4, after=("2024-01-20 00:00:00", 50)).select("job_id", F.lit("mine").alias("list"))
    return a.unionByName(b)


@query("photos_in_published_jobs", "J3", check("job_inputs jobs", "select distinct photo_id from job_inputs join jobs using (job_id) where not was_rejected and status = 'succeeded'"))
def photos_in_published_jobs(t):
    return jobs.published_photos(t.job_inputs, t.jobs)


@query("best_single_frame", "J6", check("job_inputs photos", f"""select job_id, photo_id, {s6('quality_score')} as quality_score from (select *, row_number() over (
 partition by job_id order by coalesce(quality_score, -1) desc, photo_id) as n from job_inputs join photos using (photo_id)
 where not was_rejected and deleted_at is null) where n = 1"""))
def best_single_frame(t):
    return round_all(jobs.best_single_frame(t.job_inputs, t.photos))


@query("model_lineage", "J7 L5", check("models training_runs snapshots", """select model_id, training_run_id, snapshot_id, label, strftime(created_at, '%Y-%m-%d %H:%M') as created
 from models left join training_runs using (training_run_id) left join snapshots using (snapshot_id) order by created_at desc, model_id desc"""))
def model_lineage(t):
    d = jobs.model_lineage(t.models, t.training_runs, t.snapshots).orderBy(F.desc("created_at"), F.desc("model_id"))
    return d.select("model_id", "training_run_id", c("snapshot_id").cast("bigint").alias("snapshot_id"), "label", F.date_format("created_at", "yyyy-MM-dd HH:mm").alias("created"))


@query("frozen_provenance", "J8 L3 S10", check("job_inputs photos", """select job_id, photo_id, was_rejected, weight, license as snapshot_license, attribution_name as snapshot_attribution_name
 from job_inputs join photos using (photo_id) order by job_id, was_rejected, weight desc, photo_id"""))
def frozen_provenance(t):
    return jobs.provenance_order(jobs.freeze(t.job_inputs.drop("snapshot_license"), t.photos))


@query("user_counts", "A9", check("users photos jobs", """select user_id, coalesce(p.photos, 0) as photos, coalesce(pub, 0) as public_photos, coalesce(act, 0) as active_jobs, coalesce(day, 0) as jobs_24h
 from users left join (select owner_id as user_id, count(*) filter (deleted_at is null) as photos, count(*) filter (deleted_at is null and status = 'ready') as pub from photos group by 1) p using (user_id)
 left join (select requested_by as user_id, count(*) filter (status in ('queued', 'running')) as act, count(*) filter (created_at >= timestamp '2024-01-29 00:00:00') as day from jobs group by 1) j using (user_id)"""))
def user_counts(t):
    return jobs.user_counts(t.users, t.photos, t.jobs, "2024-01-30 00:00:00")


@query("storage_headroom", "A10", check("users photos", """select user_id, coalesce(used, 0)::bigint as used_bytes, (quota_bytes - coalesce(used, 0))::bigint as free_bytes from users
 left join (select owner_id as user_id, sum(original_bytes) filter (deleted_at is null) as used from photos group by 1) using (user_id)"""))
def storage_headroom(t):
    return jobs.storage_used(t.users, t.photos).select("user_id", "used_bytes", "free_bytes")


@query("active_models", "W3", check("models", """select model_id, architecture, activate_requested and row_number() over (partition by architecture, activate_requested order by created_at desc, model_id desc) = 1 as is_active from models"""))
def active_models(t):
    return jobs.activate(t.models).select("model_id", "architecture", "is_active")


@query("rolling_job_count", "W12", check("activity", """select event_id, count(*) over (partition by user_id order by epoch_us(ts) range between 86399999999 preceding and current row) as n_24h from activity where event_type = 'purchase'"""))
def rolling_job_count(t):
    d = scan.rolling_count(t.activity.where("event_type = 'purchase'"), ["user_id"], "ts", "event_id")
    return d.select("event_id", c("n_window").alias("n_24h"))


# --- records -------------------------------------------------------------------------------------


@query("attribution_rows", "S9", check("job_inputs photos", """select job_id, photo_id, '| `' || photo_id || '` | ' || coalesce(attribution_name, 'unknown') || ' | ' || snapshot_license || ' | ' || printf('%.6f', weight) || ' |' as line
 from job_inputs join photos using (photo_id) where not was_rejected"""))
def attribution_rows(t):
    return records.attribution_rows(t.job_inputs, t.photos.select("photo_id", "attribution_name"))


def _tree(src, key, text, groups="", levels=7):
    g = groups + ", " if groups else ""
    q = f"select {g}{key} as k, {text} as digest from {src}"
    for _ in range(levels):
        q = f"select {g}k // 1000 as k, sha256(string_agg(digest, ',' order by k)) as digest from ({q}) group by all"
    return f"select {g}digest from ({q})"


@query("run_checksums", "A47 S8", check("job_inputs jobs", f"""select job_id, sha256(concat_ws('|', job_id, pipeline, object_id, digest)) as run_checksum
 from jobs join ({_tree('job_inputs', 'photo_id', "concat_ws(':', photo_id, was_rejected, snapshot_license)", 'job_id')}) using (job_id)"""))
def run_checksums(t):
    return records.run_checksums(t.jobs, t.job_inputs)


@query("frame_checksums", "A47 S7 L6", check("pixels", """select stack_id, frame_id, sha256(string_agg(y || ':' || d, ',' order by y)) as digest from (
 select stack_id, frame_id, y, sha256(string_agg(x || ':' || floor(value * 1e4 + 0.5)::bigint, ',' order by x)) as d from pixels group by all) group by all"""))
def frame_checksums(t):
    return digest.pixel_checksums(t.pixels)


@query("provenance_record", "S8", check("job_inputs jobs", f"""select job_id, '{{"schema":"provenance/1","run_checksum":"' || sha256(concat_ws('|', job_id, pipeline, object_id, digest))
 || '","deterministic":{{"job_id":' || job_id || ',"pipeline":"' || pipeline || '","object_id":' || object_id || '}},"volatile":{{"status":"' || status || '"}}}}' as record
 from jobs join ({_tree('job_inputs', 'photo_id', "concat_ws(':', photo_id, was_rejected, snapshot_license)", 'job_id')}) using (job_id)"""))
def provenance_record(t):
    return records.provenance_json(t.jobs, t.job_inputs, F.struct("status"))


@query("audit_entries", "S11", check("activity", """select event_id, user_id as actor_id, 'photo.' || event_type as action,
 case when event_id % 7 <> 0 then sha256('salt:10.0.' || user_id || '.' || k) end as ip_hash from activity"""))
def audit_entries(t):
    ip = F.when(c("event_id") % 7 != 0, F.concat_ws(".", F.lit("10.0"), "user_id", "k"))
    return records.audit_rows(t.activity.withColumn("ip", ip), "salt")


@query("training_consent", "P18 U4", check("photos", "select photo_id, allow_ai_training as is_kept from photos"))
def training_consent(t):
    return records.consent_split(t.photos).select("photo_id", "is_kept")


@query("dataset_snapshot", "A44 S12", check("photos", f"""select sha256(digest || '|' || 'filter=all') as checksum,
 (select count(*) from photos where allow_ai_training) as photo_count, (select count(*) from photos where not allow_ai_training) as excluded
 from ({_tree('(select * from photos where allow_ai_training)', 'photo_id', 'photo_id::varchar')})"""))
def dataset_snapshot(t):
    return records.snapshot(t.photos, "filter=all")


def _seed(*labels):
    return f"('0x' || left(sha256(concat_ws('/', {', '.join(labels)})), 15))::bigint"


@query("label_seeds", "F37", check("photos", f"select photo_id, {_seed(chr(39) + '42' + chr(39), 'photo_id', 'filter_name')} as seed from photos"))
def label_seeds(t):
    return t.photos.select("photo_id", training.sub_seed(42, c("photo_id"), c("filter_name")).alias("seed"))


@query("training_bursts", "X9", check("frames", f"""
select stack_id, sample, frame_id, case when n < 9 then 1 else 3::double / n end as overlap_fraction from (select *, row_number() over (partition by stack_id, sample order by {_seed("'7'", 'stack_id', 'sample', 'frame_id')}, frame_id) as r
 from (select *, count(*) over (partition by stack_id) as n from frames where allow_ai_training), (select unnest(range(8)) as sample) where n >= 3) where r <= 3"""))
def training_bursts(t):
    d = training.bursts(t.frames, 3, 8, 7)
    return d.withColumn("sample", c("sample").cast("bigint"))


@query("conditioning_vectors", "F40", check("frames", """select stack_id, frame_id, noise_sigma as f0, fwhm_px as f1, coalesce(psf_eccentricity, 0) as f2, coalesce(airmass, 1) as f3,
 coalesce(zero_point, 0) as f4, background_adu as f5, photometrically_unreliable::int::double as f6 from frames"""))
def conditioning_vectors(t):
    d = training.conditioning(t.frames)
    return d.select("stack_id", "frame_id", *[c("features")[i].alias(f"f{i}") for i in range(7)])


@query("release_verdicts", "A48", check("users", """select user_id, concat_ws(',', case when a then 'flux_linearity' end, case when b then 'empty_field' end, case when p then 'prior_contribution' end, case when u then 'uncertainty' end) as passed,
 concat_ws(',', case when not a then 'flux_linearity' end, case when not b then 'empty_field' end, case when not p then 'prior_contribution' end, case when not u then 'uncertainty' end) as failed, a and b and p and u as verdict
 from (select user_id, abs(0.8 + (user_id % 40) / 100 - 1) < 0.15 and 0.9 + (user_id % 10) / 100 > 0.95 as a, user_id % 3 <= 0.5 as b, (user_id % 50) / 100 <= 0.35 as p, coalesce(case when user_id % 6 > 0 then 0.98 + (user_id % 4) / 200 end > 0.99, false) as u from users)"""))
def release_verdicts(t):
    k = c("user_id")
    m = t.users.select("user_id", (0.8 + (k % 40) / 100).alias("slope"), (0.9 + (k % 10) / 100).alias("r_squared"), (k % 3).alias("spurious"),
        F.lit(1000.0).alias("beams"), ((k % 50) / 100).alias("prior"), F.when(k % 6 > 0, 0.98 + (k % 4) / 200).alias("finite_fraction"))
    d = training.release_verdict(m, "user_id")
    return d.select("user_id", F.array_join("passed", ",").alias("passed"), F.array_join("failed", ",").alias("failed"), "verdict")


@query("stage_flux_flags", "A53", check("activity", """select user_id as job_id, event_type as stage, bool_and(k % 90 <> 0) as flux_preserving, count(*) as n_notes from activity group by all"""))
def stage_flux_flags(t):
    note = F.when(c("k") % 90 == 0, "resampled NOT-flux-preserving").otherwise("resampled")
    return training.stage_flux_flags(t.activity.select(c("user_id").alias("job_id"), c("event_type").alias("stage"), note.alias("note")))
