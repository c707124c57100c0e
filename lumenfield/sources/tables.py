"""Stored tables with explicit schemas, and the sinks of finished stacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenfield.functions.text import ascii_safe
from lumenfield.operators.digest import level_digest

_LONG, _DOUBLE, _TEXT, _BOOL, _TIME = T.LongType(), T.DoubleType(), T.StringType(), T.BooleanType(), T.TimestampType()


def _schema(**fields) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


SCHEMAS = {
    "photos": _schema(
        photo_id=_LONG, owner_id=_LONG, object_id=_LONG, status=_TEXT, deleted_at=_TIME, created_at=_TIME,
        captured_at_utc=_TIME, is_plate_solved=_BOOL, ra_deg=_DOUBLE, dec_deg=_DOUBLE, lat_deg=_DOUBLE,
        lon_deg=_DOUBLE, location_precision=_TEXT, country_code=_TEXT, location_accuracy_m=_DOUBLE,
        elevation_m=_DOUBLE, focal_length_mm=_DOUBLE, focal_ratio=_DOUBLE, pixel_pitch_um=_DOUBLE,
        exposure_seconds=_DOUBLE, filter_name=_TEXT, is_tracked=_BOOL, license=_TEXT,
        allow_derivatives_in_stacks=_BOOL, allow_ai_training=_BOOL, attribution_name=_TEXT, title=_TEXT,
        fwhm_arcsec=_DOUBLE, eccentricity=_DOUBLE, snr_estimate=_DOUBLE, star_count=_LONG,
        bortle_estimate=_LONG, dither_phase_x=_DOUBLE, dither_phase_y=_DOUBLE, pixel_scale_arcsec=_DOUBLE,
        quality_score=_DOUBLE, checksum=_TEXT, original_bytes=_LONG,
    ),
    "pixels": _schema(
        stack_id=_LONG, frame_id=_LONG, x=_LONG, y=_LONG, value=_DOUBLE, variance=_DOUBLE,
        is_masked=_BOOL, is_saturated=_BOOL,
    ),
    "inputs": _schema(
        job_id=_LONG, photo_id=_LONG, weight=_DOUBLE, was_rejected=_BOOL, rejection_reason=_TEXT,
        snapshot_license=_TEXT, snapshot_attribution_name=_TEXT,
    ),
}


def read_table(spark: SparkSession, name: str, path: str) -> DataFrame:
    """A stored table read with its declared schema; unused columns are pruned by the scan."""
    return spark.read.schema(SCHEMAS[name]).parquet(path)


def write_photos(photos: DataFrame, path: str) -> None:
    """Photos laid out by declination, so row groups of a cone's range are few."""
    fields = SCHEMAS["photos"].fieldNames()
    photos.select(*fields).repartitionByRange("dec_deg").sortWithinPartitions("dec_deg", "ra_deg").write.mode(
        "overwrite"
    ).parquet(path)


def append_inputs(rows: DataFrame, path: str) -> None:
    """Provenance is only ever added to."""
    rows.select(*SCHEMAS["inputs"].fieldNames()).write.mode("append").parquet(path)


def result_planes(coadd: DataFrame, psf: DataFrame | None = None, ident: str = "stack_id") -> DataFrame:
    """One long table per result: planes SCI, WEIGHT, UNCERT and, with a kernel, PSF."""
    named = coadd.select(
        ident, "x", "y", F.col("image").alias("SCI"), F.col("weight").alias("WEIGHT"), F.col("sigma").alias("UNCERT")
    )
    out = named.unpivot([ident, "x", "y"], ["SCI", "WEIGHT", "UNCERT"], "plane", "value")
    if psf is not None:
        shifted = psf.select(
            ident, F.col("dx").cast("bigint").alias("x"), F.col("dy").cast("bigint").alias("y"),
            F.lit("PSF").alias("plane"), F.col("w").alias("value"),
        )
        out = out.unionByName(shifted)
    return out


def plane_checksums(planes: DataFrame, ident: str = "stack_id") -> DataFrame:
    """Checksum per plane over rounded, ordered values, built row by row of the image."""
    text = F.concat_ws(":", F.col("x"), F.floor(F.col("value") * 1e4 + 0.5001))
    rows = level_digest(planes.withColumn("_v", text), [ident, "plane", "y"], "x", "_v")
    rows = rows.withColumn("_v", F.concat_ws(":", "y", "digest"))
    return level_digest(rows, [ident, "plane"], "y", "_v").select(ident, "plane", "digest")


def header_cards(rows: DataFrame, ident: str, cards: dict[str, Column]) -> DataFrame:
    """Header cards: keys of at most eight capitals, printable values of at most 68 characters."""
    pairs = F.array(
        *[F.struct(F.lit(k[:8].upper()).alias("card"), ascii_safe(v.cast("string"), 68).alias("value")) for k, v in cards.items()]
    )
    return rows.select(ident, F.inline(pairs))


def write_result(planes: DataFrame, cards: DataFrame, path: str, ident: str = "stack_id") -> DataFrame:
    """Planes partitioned by result and plane, header cards beside them; returns the checksums."""
    planes.write.mode("overwrite").partitionBy(ident, "plane").parquet(f"{path}/planes")
    cards.write.mode("overwrite").parquet(f"{path}/header")
    return plane_checksums(planes, ident)
