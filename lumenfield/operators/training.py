"""Training-side tables the catalogue keeps: burst draws, conditioning vectors, release verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sub_seed(root: int, *labels: Column) -> Column:
    """Whole number derived from a root seed and labels; equal labels give equal seeds."""
    text = F.concat_ws("/", F.lit(str(root)), *labels)
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("bigint")


def bursts(frames: DataFrame, burst_size: int, n_samples: int, seed: int, disjoint: bool = True) -> DataFrame:
    """Seeded size-k draws of consented frames per stack, with the recorded overlap share."""
    ok = frames.where("allow_ai_training").select("stack_id", "frame_id")
    n = ok.groupBy("stack_id").agg(F.count("*").alias("n")).where(F.col("n") >= burst_size)
    d = ok.join(n, "stack_id").withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(n_samples - 1))))
    draw = sub_seed(seed, F.col("stack_id"), F.col("sample"), F.col("frame_id"))
    w = Window.partitionBy("stack_id", "sample").orderBy("_draw", "frame_id")
    d = d.withColumn("_draw", draw).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= burst_size)
    share = F.lit(float(burst_size)) / F.col("n")
    overlap = F.when(F.lit(disjoint) & (F.col("n") < 3 * burst_size), 1.0).otherwise(share)
    return d.select("stack_id", "sample", "frame_id", overlap.alias("overlap_fraction"))


def conditioning(frames: DataFrame) -> DataFrame:
    """Seven physical side inputs per frame with neutral defaults."""
    c = F.col
    parts = [
        F.coalesce(F.nullif(c("noise_sigma"), F.lit(0.0)), F.lit(1.0)),
        F.coalesce(c("fwhm_px"), F.lit(0.0)),
        F.coalesce(c("psf_eccentricity"), F.lit(0.0)),
        F.coalesce(F.nullif(c("airmass"), F.lit(0.0)), F.lit(1.0)),
        F.coalesce(c("zero_point"), F.lit(0.0)),
        F.coalesce(c("background_adu"), F.lit(0.0)),
        F.when(c("photometrically_unreliable"), 1.0).otherwise(0.0),
    ]
    return frames.select("stack_id", "frame_id", F.array(*parts).alias("features"))


def release_verdict(metrics: DataFrame, ident: str, max_prior: float = 0.35) -> DataFrame:
    """Passed and failed checks of a release candidate; any failed check is a veto."""
    c = F.col
    allowed = F.greatest(c("beams") * 2.9e-7, F.lit(0.5))
    checks = {
        "flux_linearity": (F.abs(c("slope") - 1.0) < 0.15) & (c("r_squared") > 0.95),
        "empty_field": c("spurious") <= allowed,
        "prior_contribution": c("prior") <= max_prior,
        "uncertainty": F.coalesce(c("finite_fraction") > 0.99, F.lit(False)),
    }
    passed = F.array_compact(F.array(*[F.when(v, k) for k, v in checks.items()]))
    failed = F.array_compact(F.array(*[F.when(~v, k) for k, v in checks.items()]))
    return metrics.select(
        ident, passed.alias("passed"), failed.alias("failed"), (F.size(failed) == 0).alias("verdict")
    )


def stage_flux_flags(history: DataFrame) -> DataFrame:
    """A stage preserves flux when none of its notes says it does not."""
    return history.groupBy("job_id", "stage").agg(
        F.bool_and(~F.contains(F.col("note"), F.lit("NOT-flux-preserving"))).alias("flux_preserving"),
        F.count("*").alias("n_notes"),
    )
