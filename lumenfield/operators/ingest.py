"""Merging automatic analysis into declared metadata and deriving metrics from the result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfield.functions import optics, sky
from lumenfield.functions.quality import with_quality

MERGED = (
    "width_px height_px bit_depth camera_make camera_model lens_model focal_length_mm focal_ratio"
    " exposure_seconds iso background_adu snr_estimate star_count fwhm_arcsec eccentricity"
).split()
DEFAULT_BORTLE = 5


def merge_analysis(photos: DataFrame, analysis: DataFrame, key: str = "photo_id") -> DataFrame:
    """Declared values win; the analysis fills only what the user left empty."""
    a = analysis.select(key, *[F.col(c).alias("_m_" + c) for c in analysis.columns if c != key])
    joined = photos.join(a, key, "left")
    out = []
    for c in photos.columns:
        measured = "_m_" + c
        if c in MERGED and measured in joined.columns:
            out.append(F.coalesce(F.col(c), F.col(measured)).alias(c))
        else:
            out.append(F.col(c))
    extra = [
        F.col("_m_" + c).alias(c)
        for c in analysis.columns
        if c != key and c not in photos.columns
    ]
    return joined.select(*out, *extra)


def with_utc(
    df: DataFrame,
    local: str = "captured_at_local",
    offset: str = "utc_offset_minutes",
    utc: str = "captured_at_utc",
    source: str = "time_source",
) -> DataFrame:
    """UTC instant and its source: user, exif (offset known) or inferred (UTC assumed)."""
    use = (F.coalesce(F.col(source), F.lit("")) != "user") & F.col(local).isNotNull()
    known = F.col(offset).isNotNull()
    infer = use & ~known & F.col(utc).isNull()
    new_utc = (
        F.when(use & known, optics.local_to_utc(F.col(local), F.col(offset)))
        .when(infer, F.col(local))
        .otherwise(F.col(utc))
    )
    new_source = F.when(infer, "inferred").when(use, "exif").otherwise(F.col(source))
    new_offset = F.when(infer, F.lit(0)).otherwise(F.col(offset))
    return df.withColumns({utc: new_utc, source: new_source, offset: new_offset})


def with_optics(df: DataFrame) -> DataFrame:
    """Fill the aperture from focal length and ratio, and the pitch from the sensor width."""
    return df.withColumns(
        {
            "aperture_mm": optics.aperture(F.col("focal_length_mm"), F.col("focal_ratio")),
            "pixel_pitch_um": optics.pixel_pitch(
                F.col("pixel_pitch_um"), F.col("sensor_width_mm"), F.col("width_px")
            ),
        }
    )


def derived_metrics(df: DataFrame) -> DataFrame:
    """Optics, Moon, altitude, air mass and quality of each photo; missing inputs stay null."""
    c = F.col
    df = df.withColumns(
        {
            "d_aperture_mm": optics.aperture(c("focal_length_mm"), c("focal_ratio")),
            "d_pixel_scale_arcsec": optics.pixel_scale(c("focal_length_mm"), c("pixel_pitch_um")),
        }
    )
    df = df.withColumn("d_diffraction_arcsec", optics.diffraction_limit(c("d_aperture_mm")))
    df = sky.with_moon(df, "captured_at_utc", "_moon")
    horizontal = sky.alt_az(
        c("ra_deg"), c("dec_deg"), c("lat_deg"), c("lon_deg"), c("captured_at_utc")
    )
    df = df.withColumns(
        {
            "d_moon_illumination": c("_moon.illumination"),
            "d_moon_separation_deg": sky.separation(
                c("ra_deg"), c("dec_deg"), c("_moon.ra_deg"), c("_moon.dec_deg")
            ),
            "_hz": horizontal,
        }
    )
    known: Column = c("_hz.altitude_deg").isNotNull()
    x = sky.airmass(c("_hz.altitude_deg"))
    df = df.withColumns(
        {
            "d_altitude_deg": c("_hz.altitude_deg"),
            "d_azimuth_deg": c("_hz.azimuth_deg"),
            "d_airmass": F.when(known & (c("_hz.altitude_deg") > 0), x),
        }
    )
    df = df.withColumns(
        {
            "_airmass": F.coalesce(c("d_airmass"), c("airmass")),
            "_illumination": F.coalesce(c("d_moon_illumination"), c("moon_illumination")),
            "_bortle": F.coalesce(c("bortle_estimate"), F.lit(DEFAULT_BORTLE)),
        }
    )
    df = with_quality(
        df,
        {
            "airmass": "_airmass",
            "moon_illumination": "_illumination",
            "moon_separation_deg": "d_moon_separation_deg",
            "bortle_estimate": "_bortle",
        },
        prefix="_q_",
    )
    return df.withColumnRenamed("quality", "d_quality_score").drop(
        "_moon", "_hz", "_airmass", "_illumination", "_bortle",
        *[n for n in df.columns if n.startswith("_q_")],
    )
