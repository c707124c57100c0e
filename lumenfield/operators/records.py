"""Provenance, attribution, audit and snapshot records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfield.functions.text import hash_ip
from lumenfield.operators.digest import tree_digest


def attribution_rows(inputs: DataFrame, names: DataFrame) -> DataFrame:
    """Credit lines of every job, also when all inputs are public domain; one row per line."""
    d = inputs.where("not was_rejected").join(names, "photo_id")
    wgt = F.when(F.col("weight").isNotNull(), F.format_string("%.6f", "weight")).otherwise("")
    line = F.concat(
        F.lit("| `"), F.col("photo_id").cast("string"), F.lit("` | "),
        F.coalesce("attribution_name", F.lit("unknown")), F.lit(" | "),
        F.coalesce("snapshot_license", F.lit("unspecified")), F.lit(" | "), wgt, F.lit(" |"),
    )
    return d.select("job_id", "photo_id", line.alias("line"))


def write_attribution(rows: DataFrame, jobs: DataFrame, path: str) -> None:
    """Text files partitioned by job: heading, licence line and table in photo order."""
    head = jobs.select(
        "job_id", F.lit(-1).cast("bigint").alias("photo_id"),
        F.explode(
            F.array(
                F.lit("# Attribution"),
                F.concat(F.lit("Derivative work of the `"), "pipeline", F.lit("` pipeline.")),
                F.concat(F.lit("Licence: "), F.coalesce("resulting_license", F.lit("none"))),
                F.lit("| photo_id | author | licence | effective weight |"),
            )
        ).alias("line"),
    )
    lines = head.unionByName(rows).repartitionByRange("job_id", "photo_id").sortWithinPartitions(
        "job_id", "photo_id"
    )
    lines.select("job_id", "line").write.mode("overwrite").partitionBy("job_id").text(path)


def run_checksums(jobs: DataFrame, inputs: DataFrame) -> DataFrame:
    """Checksum of each job's deterministic facts; run times and locations take no part."""
    digest = tree_digest(
        inputs, "photo_id", F.concat_ws(":", "photo_id", "was_rejected", "snapshot_license"),
        groups=("job_id",),
    )
    d = jobs.join(digest, "job_id")
    return d.select(
        "job_id", F.sha2(F.concat_ws("|", "job_id", "pipeline", "object_id", "digest"), 256).alias("run_checksum")
    )


def provenance_json(jobs: DataFrame, inputs: DataFrame, volatile: Column) -> DataFrame:
    """One JSON record per job: deterministic block with its checksum, and the volatile block."""
    d = jobs.join(run_checksums(jobs, inputs), "job_id")
    body = F.struct(
        F.lit("provenance/1").alias("schema"),
        "run_checksum",
        F.struct("job_id", "pipeline", "object_id").alias("deterministic"),
        volatile.alias("volatile"),
    )
    return d.select("job_id", F.to_json(body).alias("record"))


def audit_rows(events: DataFrame, salt: str) -> DataFrame:
    """Append-only audit entries; only a salted digest of the address is kept."""
    return events.select(
        "event_id", F.col("user_id").alias("actor_id"),
        F.concat(F.lit("photo."), "event_type").alias("action"),
        hash_ip(F.col("ip"), salt).alias("ip_hash"),
    )


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def consent_split(photos: DataFrame) -> DataFrame:
    """Every photo once, marked kept or opted out of training."""
    return photos.withColumn("is_kept", F.coalesce("allow_ai_training", F.lit(False)))


def snapshot(photos: DataFrame, filter_query: str) -> DataFrame:
    """Checksum and size of the consented set; equal sets give equal checksums in any order."""
    kept = consent_split(photos).where("is_kept")
    root = tree_digest(kept, "photo_id", F.col("photo_id").cast("string"))
    n = photos.agg(
        F.count_if("allow_ai_training").alias("photo_count"),
        F.count_if(~F.col("allow_ai_training")).alias("excluded"),
    )
    one = F.lit(1).alias("one")
    d = root.select("*", one).join(F.broadcast(n.select("*", one)), "one")
    return d.select(
        F.sha2(F.concat_ws("|", "digest", F.lit(filter_query)), 256).alias("checksum"),
        "photo_count", "excluded",
    )


def write_snapshot(photos: DataFrame, filter_query: str, path: str) -> None:
    """Member rows and header of a snapshot; the member list is a table, never one value."""
    kept = consent_split(photos).where("is_kept").select("photo_id")
    kept.write.mode("overwrite").parquet(f"{path}/members")
    snapshot(photos, filter_query).write.mode("overwrite").json(f"{path}/header")
