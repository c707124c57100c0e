"""Greedy quality-and-diversity frame selection for many jobs at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenfield.functions.optics import phase_distance, scale_distance
from lumenfield.operators.skew import SALTS, spread

QUALITY_WEIGHT = 0.65
PHASE_WEIGHT, SCALE_WEIGHT = 0.7, 0.3
SCALE_OCTAVES = 2.0
MAX_INPUTS = 500
UNKNOWN_QUALITY = 0.5

SELECTION_SCHEMA = (
    "job_id bigint, photo_id bigint, is_selected boolean, rank int, diversity_gain double,"
    " quality double, reason string"
)


def candidate_limit(target: int) -> int:
    """How many candidates a job looks at; the bound that makes one job fit one task."""
    return min(4 * MAX_INPUTS, 4 * target + 200)


#: padded cells of jobs that are chosen for at once
BLOCK = 200_000


def _distances(x, y, s, at) -> np.ndarray:
    """Diversity distance of every frame of each job (a row) to the job's frame at ``at``."""
    pick = lambda v: np.take_along_axis(v, at, 1)
    dx = np.abs(x - pick(x)) % 1.0
    dy = np.abs(y - pick(y)) % 1.0
    phase = np.hypot(np.minimum(dx, 1 - dx), np.minimum(dy, 1 - dy)) / np.sqrt(0.5)
    scale = np.abs(np.log2(s / pick(s))) / SCALE_OCTAVES
    return PHASE_WEIGHT * np.minimum(1.0, phase) + SCALE_WEIGHT * np.minimum(1.0, scale)


def _rounds(q, x, y, s, solved, free, turns, weight: float) -> tuple[np.ndarray, np.ndarray]:
    """Rank (-1: not taken) and gain of each frame of several jobs, one job a row; ``turns`` frames are taken from each."""
    order, gain = np.full(q.shape, -1, np.int32), np.zeros(q.shape)
    job, col = np.arange(len(q))[:, None], np.broadcast_to(np.arange(q.shape[1]), q.shape)
    nearest = np.full(q.shape, np.inf)
    for rank in range(int(turns.max(initial=0))):
        live = turns > rank
        left = int(free.sum(1).max())
        if not live.all() or (left > 32 and 2 * left <= free.shape[1]):
            # jobs that are done, and frames that are taken, drop out; the others keep their order
            keep = np.argsort(~free[live], axis=1, kind="stable")[:, :left]
            q, x, y, s, solved, free, nearest, col = (np.take_along_axis(v[live], keep, 1) for v in (q, x, y, s, solved, free, nearest, col))
            job, turns = job[live], turns[live]
        score = q if rank == 0 else weight * q + (1 - weight) * nearest
        at = np.argmax(np.where(free, score, -np.inf), axis=1)[:, None]
        to = np.take_along_axis(col, at, 1)
        order[job, to] = rank
        gain[job, to] = 1.0 if rank == 0 else np.take_along_axis(nearest, at, 1)
        np.put_along_axis(free, at, False, 1)
        d = np.where(np.take_along_axis(solved, at, 1), _distances(x, y, s, at), 0.0)
        nearest = np.minimum(nearest, np.where(solved, d, 0.0))
    return order, gain


def choose(rows: pa.Table, min_quality: float, weight: float) -> pa.Table:
    """A row per candidate of whole jobs, ordered by job and photo: selected with rank or rejected with a reason."""
    q, x, y, s = (rows.column(n).to_numpy().astype(float) for n in ("quality", "dither_phase_x", "dither_phase_y", "pixel_scale_arcsec"))
    solved = np.isfinite(x) & np.isfinite(y) & np.isfinite(s) & (np.nan_to_num(s) > 0)
    starts = _starts(rows.column("job_id"))
    size = np.diff(starts, append=len(q))
    low = q < min_quality
    per_job = lambda flags: np.add.reduceat(flags.astype(np.int64), starts) if len(starts) else np.zeros(0, np.int64)
    target = np.maximum(1, rows.column("target_count").take(pa.array(starts)).to_numpy().astype(np.int64))
    narrow = np.repeat(per_job(solved & ~low) >= target, size)
    pool = ~low & (solved | ~narrow)
    turns = np.minimum(target, per_job(pool))
    order, gain = np.full(len(q), -1, np.int32), np.zeros(len(q))
    by_size = np.argsort(size, kind="stable")
    a = 0
    while a < len(by_size):
        # jobs of like size are chosen for side by side, padded to the largest
        b = a + 1
        while b < len(by_size) and size[by_size[b]] <= 2 * size[by_size[a]] and (b + 1 - a) * size[by_size[b]] <= BLOCK:
            b += 1
        jobs, wide = by_size[a:b], int(size[by_size[b - 1]])
        at = starts[jobs][:, None] + np.arange(wide)
        real = np.arange(wide) < size[jobs][:, None]
        at = np.where(real, at, starts[jobs][:, None])
        own = solved[at] & real
        o, g = _rounds(q[at], x[at] % 1.0, y[at] % 1.0, np.where(own, s[at], 1.0), own, pool[at] & real, turns[jobs], weight)
        order[at[real]], gain[at[real]] = o[real], g[real]
        a = b
    taken = order >= 0
    reason = np.where(low, "too_low_quality", np.where(pool, "not_selected", "unsolved"))
    columns = [rows.column("job_id"), rows.column("photo_id"), taken, order, gain, q, pa.array(reason, mask=taken)]
    return pa.table([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], [f.split()[0] for f in SELECTION_SCHEMA.split(", ")])


def _starts(job: pa.ChunkedArray) -> np.ndarray:
    """Where each job begins, in rows ordered by job; null is one job."""
    none, ident = job.is_null().to_numpy(), job.fill_null(0).to_numpy()
    if not len(ident):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.r_[True, (ident[1:] != ident[:-1]) | (none[1:] != none[:-1])])


def select_frames(
    candidates: DataFrame, min_quality: float = 0.0, quality_weight: float = QUALITY_WEIGHT
) -> DataFrame:
    """Select per ``job_id`` up to ``target_count`` frames.

    Jobs come sorted through a task, which chooses for many small ones at once and holds no more than one large one.
    """
    if not 0.0 <= quality_weight <= 1.0:
        raise ValueError("quality_weight must lie in [0, 1]")

    def run(batches):
        held, n = [], 0
        for batch in batches:
            held, n = [*held, pa.Table.from_batches([batch])], n + batch.num_rows
            if n < BLOCK // 4:
                continue
            rows = pa.concat_tables(held)
            last = int(_starts(rows.column("job_id"))[-1]) if n else 0  # the last job may go on
            if last:
                yield from choose(rows.slice(0, last), min_quality, quality_weight).to_batches()
            held, n = [rows.slice(last)], n - last
        if n:
            yield from choose(pa.concat_tables(held), min_quality, quality_weight).to_batches()

    need = candidates.select(
        F.col("job_id").cast("bigint").alias("job_id"), F.col("photo_id").cast("bigint").alias("photo_id"), "target_count",
        F.coalesce("quality_score", F.lit(UNKNOWN_QUALITY)).cast("double").alias("quality"),
        *[F.col(n).cast("double").alias(n) for n in ("dither_phase_x", "dither_phase_y", "pixel_scale_arcsec")],
    )
    return spread(need, "job_id").sortWithinPartitions("job_id", "photo_id").mapInArrow(run, SELECTION_SCHEMA)


def with_weights(rows: DataFrame, group: str = "job_id", quality: str = "quality") -> DataFrame:
    """Share of the group's quality, or an equal share when the total is zero."""
    totals = rows.groupBy(group).agg(F.sum(quality).alias("_q"), F.count("*").alias("_n"))
    d = rows.join(totals, group)
    share = F.when(F.col("_q") > 0, F.try_divide(F.col(quality), F.col("_q")))
    return d.withColumn("weight", F.coalesce(share, 1.0 / F.col("_n"))).drop("_q", "_n")


def diversity(selected: DataFrame, group: str = "job_id", limit: int = MAX_INPUTS) -> DataFrame:
    """Mean pairwise phase and scale distance of each selection.

    A selection holds at most ``limit`` frames, so its pairs are folded inside one array and never
    become rows; a larger group is refused, not cut.
    """
    item = F.struct(
        F.col("dither_phase_x").alias("x"),
        F.col("dither_phase_y").alias("y"),
        F.col("pixel_scale_arcsec").alias("s"),
    )
    ok = F.col("dither_phase_x").isNotNull() & (F.col("pixel_scale_arcsec") > 0)
    d = selected.groupBy(group).agg(F.collect_list(F.when(ok, item)).alias("f"))
    n = F.size("f")
    d = d.withColumn(
        "f",
        F.when(n <= limit, F.col("f")).otherwise(F.raise_error(F.lit(f"selection above {limit} frames"))),
    )

    def total(metric):
        def inner(a, i):
            rest = F.slice("f", i + 2, F.greatest(n - i - 1, F.lit(0)))
            return F.aggregate(rest, F.lit(0.0), lambda acc, b: acc + metric(a, b))

        return F.aggregate(F.transform("f", inner), F.lit(0.0), lambda acc, v: acc + v)

    pairs = n * (n - 1) / 2
    phase = total(lambda a, b: phase_distance(a["x"], a["y"], b["x"], b["y"]))
    scale = total(lambda a, b: scale_distance(a["s"], b["s"]))
    return d.select(
        group,
        F.coalesce(F.try_divide(phase, pairs), F.lit(0.0)).alias("phase_diversity"),
        F.coalesce(F.try_divide(scale, pairs), F.lit(0.0)).alias("scale_diversity"),
    )


def job_candidates(jobs: DataFrame, photos: DataFrame, min_quality: float = 0.0) -> DataFrame:
    """Candidate photos of every selector job: the best of its object, up to the job's limit.

    A column ``min_quality`` of ``jobs`` is each job's own floor; null takes ``min_quality``. Photos without a score pass
    any floor and come last, so the best of either kind are found per object, before jobs meet them.
    """
    from lumenfield.operators.search import stack_candidates

    most = candidate_limit(MAX_INPUTS)
    limit = F.least(F.lit(4 * MAX_INPUTS), 4 * F.col("target_count") + 200)
    wanted = jobs.select("job_id", "object_id", "target_count", limit.alias("_limit"), *(["min_quality"] if "min_quality" in jobs.columns else []))
    if "min_quality" not in jobs.columns:
        best = stack_candidates(photos, most, min_quality)
        return wanted.join(best, "object_id").where(F.col("rank") <= F.col("_limit")).drop("_limit", "rank")
    scored, unscored = (stack_candidates(photos.where(w), most, float("-inf")) for w in ("quality_score is not null", "quality_score is null"))
    floor = F.coalesce("min_quality", F.lit(min_quality))
    d = wanted.join(scored.unionByName(unscored).drop("rank"), "object_id")
    d = d.where(F.col("quality_score").isNull() | (F.col("quality_score") >= floor))
    # a job meets at most twice its limit here, so ranking it is one small sort
    w = Window.partitionBy("job_id").orderBy(F.desc_nulls_last("quality_score"), F.asc("photo_id"))
    return d.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= F.col("_limit")).drop("_limit", "_rank", "min_quality")


def rank_within(df: DataFrame, group: list[str], order: list, limit: int, ident: str, salts: int = SALTS) -> DataFrame:
    """First ``limit`` rows per group: first within salted parts of it, then among what the parts kept.

    No task sorts a whole group; the second sort sees at most ``salts * limit`` rows of one.
    """
    salt = F.pmod(F.xxhash64(ident), F.lit(salts))
    parts = Window.partitionBy(*group, "_salt").orderBy(*order)
    d = df.withColumn("_salt", salt).withColumn("rank", F.row_number().over(parts)).where(F.col("rank") <= limit).drop("_salt")
    w = Window.partitionBy(*group).orderBy(*order)
    return d.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
