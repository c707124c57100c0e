"""Integrity rules as good rows and quarantine rows with reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LICENCE_STATUS = ("processing", "ready", "failed", "quarantined")


def keepers(df: DataFrame, keys: list[str], order: list[str], ident: str) -> DataFrame:
    """Id of the first row per key. A hot key is reduced before the shuffle, never sorted whole."""
    first = F.min(F.struct(*order, ident))
    out = df.groupBy(*keys).agg(first.alias("_first"), F.count("*").alias("copies"))
    return out.select(*keys, F.col(f"_first.{ident}").alias("keeper_id"), "copies")


def duplicates(photos: DataFrame) -> DataFrame:
    """Live photos with a copy flag per (owner, checksum); the earliest upload is kept.

    Photos are matched to keepers by id, so the join keys are unique even when one checksum holds a
    large share of the table.
    """
    live = photos.where("deleted_at is null")
    keep = keepers(live, ["owner_id", "checksum"], ["created_at"], "photo_id")
    keep = keep.select(F.col("keeper_id").alias("photo_id"), F.lit(True).alias("is_first"))
    return live.join(keep, "photo_id", "left").withColumn(
        "is_duplicate", F.col("is_first").isNull()
    ).drop("is_first")


def photo_reasons() -> Column:
    c = F.col
    return F.array(
        F.when(~c("quality_score").between(0, 1), "quality_range"),
        F.when(~c("bortle_estimate").between(1, 9), "bortle_range"),
        F.when(~c("dec_deg").between(-90, 90), "dec_range"),
        F.when((c("ra_deg") < 0) | (c("ra_deg") >= 360), "ra_range"),
        F.when(~c("status").isin(*LICENCE_STATUS), "status"),
        F.when(c("is_duplicate"), "duplicate"),
    )


def validate_photos(photos: DataFrame) -> DataFrame:
    """All live photos with ``reasons``; an empty array is a good row."""
    return duplicates(photos).withColumn("reasons", F.array_compact(photo_reasons()))


def validate_inputs(inputs: DataFrame) -> DataFrame:
    """Provenance rows: weight in [0, 1] and one row per (job, photo)."""
    n = inputs.groupBy("job_id", "photo_id").agg(F.count("*").alias("_n"))
    d = inputs.join(n, ["job_id", "photo_id"])
    reasons = F.array(
        F.when(~F.col("weight").between(0, 1), "weight_range"),
        F.when(F.col("_n") > 1, "duplicate_input"),
    )
    return d.withColumn("reasons", F.array_compact(reasons)).drop("_n")
