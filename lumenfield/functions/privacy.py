"""Publishing an observer's position at the precision the observer allows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Presentation centroids per country (code, latitude, longitude).
CENTROIDS = (
    ("AR", -35.38, -65.17), ("AT", 47.68, 13.35), ("AU", -25.73, 134.49), ("BE", 50.64, 4.64),
    ("BR", -10.79, -53.09), ("CA", 61.36, -98.31), ("CH", 46.80, 8.21), ("CL", -37.73, -71.38),
    ("CN", 36.56, 103.82), ("CZ", 49.73, 15.31), ("DE", 51.11, 10.39), ("DK", 55.97, 10.03),
    ("ES", 40.24, -3.65), ("FI", 64.50, 26.27), ("FR", 46.56, 2.34), ("GB", 54.12, -2.86),
    ("GR", 39.07, 22.96), ("HU", 47.16, 19.40), ("IE", 53.18, -8.14), ("IN", 22.89, 79.61),
    ("IT", 42.80, 12.07), ("JP", 37.59, 138.03), ("MX", 23.95, -102.52), ("NL", 52.11, 5.28),
    ("NO", 61.15, 8.79), ("NZ", -41.81, 171.48), ("PL", 52.13, 19.39), ("PT", 39.60, -8.50),
    ("RO", 45.85, 24.97), ("SE", 62.78, 16.75), ("TR", 39.06, 35.16), ("US", 45.68, -112.46),
    ("ZA", -29.00, 25.08),
)
CITY_GRID_DEG = 0.1
METERS_PER_DEGREE = 111_320.0
ELEVATION_STEP_M = 100.0


def centroid_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        list(CENTROIDS), "centroid_code string, centroid_lat double, centroid_lon double"
    )


def to_grid(x: Column, step: float) -> Column:
    """Nearest multiple of ``step``, halves to even."""
    return F.round(F.rint(x / step) * step, 6)


def with_published_location(
    df: DataFrame,
    lat: str = "lat_deg",
    lon: str = "lon_deg",
    precision: str = "location_precision",
    country: str = "country_code",
    accuracy: str = "location_accuracy_m",
    elevation: str = "elevation_m",
    owner_view: Column | None = None,
    name: str = "location",
) -> DataFrame:
    """Add a nullable struct with the publishable position; owners see the true one."""
    dim = centroid_table(df.sparkSession)
    df = df.join(F.broadcast(dim), F.upper(F.col(country)) == F.col("centroid_code"), "left")
    p = F.col(precision)
    half_cell = CITY_GRID_DEG * METERS_PER_DEGREE / 2.0
    as_is = F.struct(
        F.col(lat).alias("lat"),
        F.col(lon).alias("lon"),
        F.col(accuracy).alias("accuracy_m"),
        F.col(elevation).alias("elevation_m"),
        F.lit("exact").alias("precision"),
        F.col(country).alias("country_code"),
    )
    city = F.struct(
        to_grid(F.col(lat), CITY_GRID_DEG).alias("lat"),
        to_grid(F.col(lon), CITY_GRID_DEG).alias("lon"),
        F.round(F.hypot(F.lit(half_cell), F.coalesce(F.col(accuracy), F.lit(0.0))), 1).alias(
            "accuracy_m"
        ),
        to_grid(F.col(elevation), ELEVATION_STEP_M).alias("elevation_m"),
        F.lit("city").alias("precision"),
        F.col(country).alias("country_code"),
    )
    nation = F.struct(
        F.col("centroid_lat").alias("lat"),
        F.col("centroid_lon").alias("lon"),
        F.lit(None).cast("double").alias("accuracy_m"),
        F.lit(None).cast("double").alias("elevation_m"),
        F.lit("country").alias("precision"),
        F.col("centroid_code").alias("country_code"),
    )
    located = F.col(lat).isNotNull() & F.col(lon).isNotNull()
    shown = (
        F.when(located & (p == "exact"), as_is)
        .when(located & (p == "city"), city)
        .when(located & (p == "country") & F.col("centroid_code").isNotNull(), nation)
    )
    if owner_view is not None:
        shown = F.when(owner_view & located, as_is).otherwise(shown)
    return df.withColumn(name, shown).drop("centroid_code", "centroid_lat", "centroid_lon")
