"""Stack manifests: a JSON list of inputs, or an object with inputs and an output licence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfield.functions.licences import manifest_rejection
from lumenfield.sources.files import stem

ENTRY = (
    "path string, file string, s3_key_original string, photo_id string, license string,"
    " attribution_name string, allow_derivatives_in_stacks boolean, allow_ai_training boolean,"
    " exposure_seconds double, gain_e_per_adu double, read_noise_e double, focal_length_mm double,"
    " focal_ratio double, pixel_pitch_um double, channel string"
)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Entries with defaults filled in and the manifest's output licence, if it carries one."""
    text = spark.read.text(path, wholetext=True)
    wrapped = F.from_json("value", f"output_license string, inputs array<struct<{_ddl()}>>, photos array<struct<{_ddl()}>>")
    bare = F.from_json("value", f"array<struct<{_ddl()}>>")
    is_list = F.startswith(F.ltrim("value"), F.lit("["))
    d = text.select(
        F.when(~is_list, wrapped["output_license"]).alias("output_license"),
        F.when(is_list, bare).otherwise(F.coalesce(wrapped["inputs"], wrapped["photos"])).alias("e"),
    )
    return with_defaults(d.select("output_license", F.inline("e")))


def _ddl() -> str:
    return ", ".join(f"{n}: {t}" for n, t in (p.split() for p in ENTRY.split(", ")))


def with_defaults(entries: DataFrame) -> DataFrame:
    """Path from its aliases, id from the file stem, consent on unless stated."""
    names = [n for n in ("path", "s3_key_original", "file") if n in entries.columns]
    d = entries.withColumn("path", F.coalesce(*names)).drop("s3_key_original", "file")
    return d.withColumns(
        {
            "photo_id": F.coalesce("photo_id", stem(F.col("path"))),
            "allow_derivatives_in_stacks": F.coalesce("allow_derivatives_in_stacks", F.lit(True)),
        }
    )


def split_manifest(entries: DataFrame, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """(kept in id order, rejected with reason). Strict reading fails on the first rejection."""
    reason = manifest_rejection(F.col("license"), F.col("allow_derivatives_in_stacks"))
    d = entries.withColumn("reason", reason)
    if strict:
        message = F.concat(F.col("photo_id").cast("string"), F.lit(": "), F.col("reason"))
        checked = F.when(F.col("reason").isNotNull(), F.raise_error(message).cast("string"))
        d = d.withColumn("reason", checked)
    return d.where("reason is null").drop("reason").orderBy("photo_id"), d.where("reason is not null")


def duplicate_ids(kept: DataFrame) -> DataFrame:
    return kept.groupBy("photo_id").count().where("count > 1")
