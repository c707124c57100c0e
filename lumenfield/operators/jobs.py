"""Stacking jobs: requests, licences, plans, provenance, visibility, quotas and lineage."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfield.functions.licences import block_reason, with_licence_flags
from lumenfield.functions.optics import diffraction_limit
from lumenfield.operators import selection

PIPELINES = ("burst-sr-v1", "classical-stack-v1", "drizzle-v1")
LEARNED = ("burst-sr-v1",)
# Planning estimates.
SECONDS_PER_FRAME = {"classical-stack-v1": 1.5, "drizzle-v1": 4.0, "burst-sr-v1": 12.0}
DEFAULT_SECONDS = 3.0
USD_PER_SECOND = 0.000012
QUEUE_SECONDS = 180.0
MAX_ACTIVE, MAX_PER_DAY = 5, 20
TERMINAL = ("succeeded", "failed", "cancelled")


@dataclass(frozen=True)
class JobRequest:
    """Arguments of one job; exactly one source of photos, a target and a known pipeline."""

    pipeline: str
    photo_ids: Sequence[int] | None = None
    selector_object: str | None = None
    object_id: int | None = None
    has_selector: bool = False
    target_count: int = 50

    def validate(self) -> JobRequest:
        broken = [text for text, holds in REQUEST_RULES if not holds(self)]
        if broken:
            raise ValueError("; ".join(broken))
        return self


#: what must hold for a request
REQUEST_RULES = (
    ("photos come from a list or from a selector", lambda r: r.has_selector != (r.photo_ids is not None)),
    ("a list holds two photos or more", lambda r: r.photo_ids is None or len(r.photo_ids) > 1),
    ("a list holds no photo twice", lambda r: r.photo_ids is None or len(r.photo_ids) == len(set(r.photo_ids))),
    ("a selector names its object", lambda r: not r.has_selector or bool(r.selector_object) or r.object_id is not None),
    ("the pipeline is known", lambda r: r.pipeline in PIPELINES),
    ("the target lies within the limit of inputs", lambda r: 0 < r.target_count <= selection.MAX_INPUTS),
)


def request_problems(requests: DataFrame, wanted: DataFrame) -> DataFrame:
    """Batch form of the request rules; ``wanted`` has one row per (job, requested photo)."""
    ids = wanted.groupBy("job_id").agg(
        F.count("*").alias("n_ids"), F.count_distinct("photo_id").alias("n_distinct")
    )
    d = requests.join(ids, "job_id", "left")
    has_ids = F.col("n_ids").isNotNull()
    problems = F.array(
        F.when(has_ids == F.col("has_selector"), "one_source"),
        F.when(has_ids & (F.col("n_ids") < 2), "too_few"),
        F.when(F.col("n_distinct") < F.col("n_ids"), "duplicates"),
        F.when(~F.col("pipeline").isin(*PIPELINES), "unknown_pipeline"),
        F.when(F.col("has_selector") & ~has_ids & F.col("object_id").isNull(), "no_object"),
    )
    return d.withColumn("problems", F.array_compact(problems))


# --- licences ------------------------------------------------------------------------------------


def blocked_inputs(inputs: DataFrame) -> DataFrame:
    """Every input that may not enter its job, one row each, with the reason."""
    d = with_licence_flags(inputs)
    reason = block_reason(F.col("allows_derivatives"), F.col("allow_derivatives_in_stacks"))
    return d.withColumn("reason", reason).where("reason is not null").select(
        "job_id", "photo_id", "license", "reason"
    )


def resolve_licence(inputs: DataFrame) -> DataFrame:
    """Output licence per job, or null with the number of blocked inputs."""
    d = with_licence_flags(inputs)
    reason = block_reason(F.col("allows_derivatives"), F.col("allow_derivatives_in_stacks"))
    g = d.groupBy("job_id").agg(
        F.count("*").alias("n_inputs"),
        F.count(reason).alias("n_blocked"),
        F.bool_or(~F.col("allows_commercial")).alias("nc"),
        F.bool_or(F.col("requires_sharealike")).alias("sa"),
        F.max_by("license", "restrictiveness").alias("strictest"),
    )
    code = (
        F.when(F.col("n_blocked") > 0, None)
        .when(F.col("nc") & F.col("sa"), "CC-BY-NC-SA-4.0")
        .when(F.col("nc"), "CC-BY-NC-4.0")
        .when(F.col("sa"), "CC-BY-SA-4.0")
        .otherwise(F.col("strictest"))
    )
    return g.select(
        "job_id", "n_inputs", "n_blocked", code.alias("resulting_license"),
        F.lit(True).alias("requires_attribution"),
    )


def most_restrictive(inputs: DataFrame) -> DataFrame:
    """Strictest code per job; a presentation aid, not the combination rule."""
    d = with_licence_flags(inputs)
    return d.groupBy("job_id").agg(F.max_by("license", "restrictiveness").alias("most_restrictive"))


# --- plans ---------------------------------------------------------------------------------------


def explicit_candidates(wanted: DataFrame, photos: DataFrame) -> DataFrame:
    """Candidates of jobs that list their photos (``job_id, photo_id``): all of them, if all are live and ready.

    A job with a missing or unready photo has no candidates at all; ``search.unavailable`` names the photos.
    """
    ready = photos.where("deleted_at is null and status = 'ready'").drop("job_id", "target_count")
    size = wanted.groupBy("job_id").agg(F.count("*").cast("int").alias("target_count"))
    found = wanted.select("job_id", "photo_id").join(ready, "photo_id")
    whole = found.groupBy("job_id").agg(F.count("*").alias("_n")).join(size, "job_id").where("_n = target_count").drop("_n")
    return found.join(whole, "job_id")


def preview(candidates: DataFrame) -> DataFrame:
    """Every candidate of every job once: ``selected``, ``rejected`` or ``blocked``, with reason and rank.

    Selection runs among the photos whose licence and owner allow it. Blocked ones are reported. ``n_selected`` and
    ``n_blocked`` are totals of the job; a job holds a bounded number of candidates, so they are a window.
    """
    facts = with_licence_flags(candidates)
    blocked = block_reason(F.col("allows_derivatives"), F.col("allow_derivatives_in_stacks"))
    facts = facts.withColumn("_blocked", blocked)
    chosen = selection.select_frames(facts.where("_blocked is null"))
    state = F.when(F.col("is_selected"), "selected").otherwise("rejected")
    rows = chosen.select("job_id", "photo_id", state.alias("state"), "reason", "rank", "quality").unionByName(
        facts.where("_blocked is not null").select(
            "job_id", "photo_id", F.lit("blocked").alias("state"), F.col("_blocked").alias("reason"), F.lit(-1).alias("rank"),
            F.coalesce("quality_score", F.lit(selection.UNKNOWN_QUALITY)).alias("quality"),
        )
    )
    job = Window.partitionBy("job_id")
    return rows.select(
        "*", F.count(F.when(F.col("state") == "selected", 1)).over(job).alias("n_selected"),
        F.count(F.when(F.col("state") == "blocked", 1)).over(job).alias("n_blocked"),
    )


def can_run() -> Column:
    return (F.col("n_blocked") == 0) & (F.col("n_selected") >= 2)


def plan_status(jobs: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row per job: ``planned``, ``licence_blocked`` or ``too_few``, and the licence its result would have."""
    n = preview(candidates).groupBy("job_id").agg(F.first("n_selected").alias("n_selected"), F.first("n_blocked").alias("n_blocked"))
    licence = resolve_licence(candidates).select("job_id", "resulting_license")
    d = jobs.select("job_id").join(n, "job_id", "left").join(licence, "job_id", "left").fillna(0, ["n_selected", "n_blocked"])
    status = F.when(F.col("n_blocked") > 0, "licence_blocked").when(F.col("n_selected") < 2, "too_few").otherwise("planned")
    return d.select("job_id", "n_selected", "n_blocked", "resulting_license", status.alias("status"))


def plan_stacks(jobs: DataFrame, photos: DataFrame) -> DataFrame:
    """Candidates, licence gate, selection and weights of all selector jobs in one plan.

    A job that holds a blocked candidate, or fewer than two usable frames, is refused as a whole; the rest
    get one provenance row per candidate, selected with its weight or rejected with the reason, with
    licence and author frozen.
    """
    return provenance_rows(preview(selection.job_candidates(jobs, photos)), photos)


def provenance_rows(rows: DataFrame, photos: DataFrame) -> DataFrame:
    """Provenance of the jobs that can run, from their preview, with the photo's licence and author at this moment.

    Both kinds come from one pass over the choice: a job's candidates are bounded, so its quality
    total is a window over them and the choice is never computed twice.
    """
    job = Window.partitionBy("job_id")
    picked = F.col("state") == "selected"
    total = F.sum(F.when(picked, F.col("quality"))).over(job)
    share = F.when(total > 0, F.try_divide(F.col("quality"), total)).otherwise(1.0 / F.col("n_selected"))
    made = rows.where(can_run()).select(
        "job_id", "photo_id", F.when(picked, share).otherwise(0.0).alias("weight"),
        (~picked).alias("was_rejected"), F.col("reason").alias("rejection_reason"), "rank",
    )
    return freeze(made, photos)


def freeze(rows: DataFrame, photos: DataFrame) -> DataFrame:
    snap = photos.select(
        "photo_id",
        F.col("license").alias("snapshot_license"),
        F.col("attribution_name").alias("snapshot_attribution_name"),
    )
    return rows.join(snap, "photo_id")


def plan_estimates(selected: DataFrame, jobs: DataFrame) -> DataFrame:
    """Size, cost, expected gain, limits and honest warnings of each plan.

    ``selected`` has one row per (job, photo) with optics and dither columns; a job without any is estimated too.
    """
    c = F.col
    size = selected.groupBy("job_id").agg(
        F.count("*").alias("n"),
        F.max(F.when(c("focal_ratio") > 0, c("focal_length_mm") / c("focal_ratio"))).alias("aperture"),
        F.min(F.when(c("pixel_scale_arcsec") > 0, c("pixel_scale_arcsec"))).alias("finest"),
    )
    d = jobs.select("job_id", "pipeline").join(size, "job_id", "left").join(selection.diversity(selected), "job_id", "left")
    d = d.fillna(0, ["n"]).fillna(0.0, ["phase_diversity", "scale_diversity"])
    per_frame = F.lit(DEFAULT_SECONDS)
    for name, sec in SECONDS_PER_FRAME.items():
        per_frame = F.when(c("pipeline") == name, sec).otherwise(per_frame)
    limit = diffraction_limit(c("aperture"))
    warnings = F.array(
        F.when(c("phase_diversity") < 0.15, "low_dither"),
        F.when(c("finest") < limit / 2, "oversampled"),
        F.when(limit.isNotNull(), "diffraction_ceiling"),
        F.when(c("n") < 5, "few_frames"),
    )
    return d.select(
        "job_id", "n", "phase_diversity", "scale_diversity",
        (per_frame * c("n")).alias("compute_seconds"),
        (per_frame * c("n") * USD_PER_SECOND).alias("cost_usd"),
        F.when(c("n") >= 2, 10.0 * F.log10(c("n").cast("double"))).alias("snr_gain_db"),
        limit.alias("best_limit_arcsec"),
        (c("finest") / (1.0 + 0.5 * c("phase_diversity"))).alias("reachable_scale_arcsec"),
        F.array_compact(warnings).alias("warnings"),
        c("pipeline").isin(*LEARNED).alias("uses_learned_model"),
    )


# --- publication and visibility -----------------------------------------------------------------


def uses_learned_model(pipeline: Column, model_id: Column) -> Column:
    return model_id.isNotNull() | pipeline.isin(*LEARNED)


def publish_violations(jobs: DataFrame) -> DataFrame:
    """All reasons why a result may not be published; an empty array means it may."""

    def missing(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit("")) == ""

    learned = uses_learned_model(F.col("pipeline"), F.col("model_id"))
    found = F.array(
        F.when(missing("key_result"), "missing_result"),
        F.when(learned & missing("key_uncertainty"), "missing_uncertainty_map"),
        F.when(missing("key_attribution"), "missing_attribution"),
    )
    return jobs.withColumn("violations", F.array_compact(found))


def visible_jobs(jobs: DataFrame, viewer: int | None) -> DataFrame:
    own = F.lit(False) if viewer is None else F.col("requested_by") == viewer
    return jobs.where(F.col("is_public") | own)


def gallery(jobs: DataFrame, limit: int, mine: int | None = None, after=None) -> DataFrame:
    """Newest first with the id as tie-break on every page."""
    d = jobs.where(F.col("requested_by") == mine) if mine is not None else jobs.where(
        F.col("is_public") & (F.col("status") == "succeeded")
    )
    if after is not None:
        at, last = after
        t = F.lit(at).cast("timestamp")
        d = d.where((F.col("created_at") < t) | ((F.col("created_at") == t) & (F.col("job_id") < last)))
    return d.orderBy(F.desc("created_at"), F.desc("job_id")).limit(limit + 1)


def published_photos(inputs: DataFrame, jobs: DataFrame) -> DataFrame:
    """Photos that took part in a succeeded job; their licence is frozen and deletion refused."""
    done = jobs.where("status = 'succeeded'").select("job_id")
    used = inputs.where("not was_rejected").join(done, "job_id", "left_semi")
    return used.select("photo_id").distinct()


def provenance_order(inputs: DataFrame) -> DataFrame:
    return inputs.orderBy("job_id", "was_rejected", F.desc("weight"), "photo_id")


def best_single_frame(inputs: DataFrame, photos: DataFrame) -> DataFrame:
    """Best frame really used per job; ties go to the smaller id."""
    live = photos.where("deleted_at is null").select("photo_id", "quality_score")
    used = inputs.where("not was_rejected").join(live, "photo_id")
    key = F.struct(F.coalesce("quality_score", F.lit(-1.0)), -F.col("photo_id"))
    best = F.max_by(F.struct("photo_id", "quality_score"), key)
    return used.groupBy("job_id").agg(best.alias("b")).select("job_id", "b.photo_id", "b.quality_score")


# --- users, quota, lineage ------------------------------------------------------------------------


def user_counts(users: DataFrame, photos: DataFrame, jobs: DataFrame, now: str) -> DataFrame:
    live = F.col("deleted_at").isNull()
    p = photos.groupBy(F.col("owner_id").alias("user_id")).agg(
        F.count_if(live).alias("photos"),
        F.count_if(live & (F.col("status") == "ready")).alias("public_photos"),
    )
    since = F.lit(now).cast("timestamp") - F.expr("interval 1 day")
    j = jobs.groupBy(F.col("requested_by").alias("user_id")).agg(
        F.count_if(F.col("status").isin("queued", "running")).alias("active_jobs"),
        F.count_if(F.col("created_at") >= since).alias("jobs_24h"),
    )
    d = users.select("user_id").join(p, "user_id", "left").join(j, "user_id", "left")
    return d.fillna(0, ["photos", "public_photos", "active_jobs", "jobs_24h"])


def storage_used(users: DataFrame, photos: DataFrame) -> DataFrame:
    used = photos.groupBy(F.col("owner_id").alias("user_id")).agg(
        F.sum(F.when(F.col("deleted_at").isNull(), F.col("original_bytes"))).alias("used_bytes")
    )
    d = users.join(used, "user_id", "left").fillna(0, ["used_bytes"])
    return d.withColumn("free_bytes", F.col("quota_bytes") - F.col("used_bytes"))


def activate(models: DataFrame) -> DataFrame:
    """Exactly one active model per architecture: the newest that asked for it.

    The winner is found by a pre-aggregated maximum and matched by its id, so an architecture that
    holds most models is never sorted.
    """
    win = models.where("activate_requested").groupBy("architecture").agg(
        F.max_by("model_id", F.struct("created_at", "model_id")).alias("model_id")
    )
    flag = win.select("model_id", F.lit(True).alias("is_active"))
    return models.join(flag, "model_id", "left").fillna(False, ["is_active"])


def model_lineage(models: DataFrame, runs: DataFrame, snapshots: DataFrame) -> DataFrame:
    return models.join(runs, "training_run_id", "left").join(snapshots, "snapshot_id", "left")
