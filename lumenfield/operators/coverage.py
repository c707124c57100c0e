"""Coverage of the sky objects: histogram, publishable sites, summary, gaps and public totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfield.functions.privacy import with_published_location
from lumenfield.operators.search import visible

LAT_BAND = 15
UNKNOWN_BAND = -999
FOCAL_EDGES = (0, 24, 50, 100, 200, 400, 800, 1600, 3200)
PRECISIONS = ("exact", "city", "country", "hidden")
HEMISPHERE_RATIO = 0.2


def focal_band(focal: Column, mode: str = "log") -> Column:
    """Lower edge of the focal band; ``equal_width`` cuts 0-3200 mm into eight equal buckets."""
    f = F.coalesce(focal, F.lit(0.0))
    if mode == "log":
        band = F.lit(FOCAL_EDGES[0])
        for e in FOCAL_EDGES[1:]:
            band = F.when(f >= e, e).otherwise(band)
        return band
    if mode == "equal_width":
        width = FOCAL_EDGES[-1] / (len(FOCAL_EDGES) - 1)
        i = F.least(F.lit(len(FOCAL_EDGES) - 1), F.floor(f / width).cast("int"))
        return F.element_at(F.array(*[F.lit(e) for e in FOCAL_EDGES]), i + 1)
    raise ValueError(f"unknown focal mode {mode!r}")


def histogram(photos: DataFrame, mode: str = "log") -> DataFrame:
    """Photos per object, month, latitude band and focal band, with the best quality of each."""
    lat = F.when(F.col("location_precision") != "hidden", F.floor(F.col("lat_deg") / LAT_BAND) * LAT_BAND)
    return (
        photos.where(visible() & F.col("object_id").isNotNull())
        .groupBy(
            "object_id",
            F.coalesce(F.date_format("captured_at_utc", "yyyy-MM"), F.lit("unknown")).alias("period"),
            F.coalesce(lat, F.lit(UNKNOWN_BAND)).cast("int").alias("lat_bin"),
            focal_band(F.col("focal_length_mm"), mode).alias("focal_bin"),
        )
        .agg(F.count("*").alias("n"), F.max("quality_score").alias("best_quality"))
    )


def raw_sites(photos: DataFrame) -> DataFrame:
    """True positions grouped with their precision; for internal use only."""
    return (
        photos.where(
            visible()
            & F.col("object_id").isNotNull()
            & F.col("lat_deg").isNotNull()
            & (F.col("location_precision") != "hidden")
        )
        .groupBy("object_id", "lat_deg", "lon_deg", "location_precision", "country_code")
        .agg(
            F.max("location_accuracy_m").alias("location_accuracy_m"),
            F.max("elevation_m").alias("elevation_m"),
            F.count("*").alias("n"),
        )
    )


def published_sites(sites: DataFrame) -> DataFrame:
    """Obfuscate every group at its own precision first, then merge equal points."""
    d = with_published_location(sites).where("location is not null")
    rank = F.array_position(F.array(*[F.lit(p) for p in PRECISIONS]), F.col("location_precision"))
    merged = d.groupBy(
        "object_id", F.round("location.lat", 6).alias("lat"), F.round("location.lon", 6).alias("lon")
    ).agg(F.sum("n").alias("n"), F.max(rank).alias("coarseness"))
    name = F.element_at(F.array(*[F.lit(p) for p in PRECISIONS]), F.col("coarseness").cast("int"))
    return merged.select("object_id", "lat", "lon", "n", name.alias("precision"))


def summary(hist: DataFrame) -> DataFrame:
    """Totals per object over the histogram cells."""
    located = F.col("lat_bin") != UNKNOWN_BAND
    d = hist.groupBy("object_id").agg(
        F.sum("n").alias("total"),
        F.coalesce(F.sum(F.when(located & (F.col("lat_bin") >= 0), F.col("n"))), F.lit(0)).alias("north"),
        F.coalesce(F.sum(F.when(located & (F.col("lat_bin") < 0), F.col("n"))), F.lit(0)).alias("south"),
        F.min(F.when(F.col("focal_bin") > 0, F.col("focal_bin"))).cast("double").alias("focal_min"),
        F.max(F.when(F.col("focal_bin") > 0, F.col("focal_bin"))).cast("double").alias("focal_max"),
        F.count_distinct(F.when(F.col("period") != "unknown", F.col("period"))).alias("periods"),
    )
    octaves = F.log2(F.col("focal_max") / F.col("focal_min")) / 2.0
    diversity = F.when(octaves.isNull(), 0.0).otherwise(F.least(F.lit(1.0), octaves))
    return d.withColumn("scale_diversity", diversity)


def gaps(objects: DataFrame, totals: DataFrame) -> DataFrame:
    """What each object lacks: hemisphere, focal range, months, or everything."""
    d = objects.select("object_id").join(totals, "object_id", "left").fillna(
        0, ["total", "north", "south", "periods", "scale_diversity"]
    )
    c = F.col
    located = c("north") + c("south")
    few = located * HEMISPHERE_RATIO
    found = F.array(
        F.when((located > 0) & (c("south") < few), "hemisphere_south").when(
            (located > 0) & (c("north") < few), "hemisphere_north"
        ),
        F.when((c("scale_diversity") < 0.25) & (c("total") > 0), "focal"),
        F.when((c("periods") > 0) & (c("periods") < 3), "temporal"),
        F.when(c("total") == 0, "empty"),
    )
    return d.select("object_id", "total", F.explode(F.array_compact(found)).alias("gap"))


def public_totals(photos: DataFrame, objects: DataFrame, jobs: DataFrame) -> DataFrame:
    """One row of public figures; each table is counted on its own, and empty tables give zeros."""
    p = photos.where(visible()).agg(
        F.count("*").alias("photo_count"),
        F.count_distinct("owner_id").alias("contributor_count"),
        F.coalesce(F.sum("exposure_seconds"), F.lit(0.0)).alias("exposure_seconds"),
    )
    o = objects.agg(F.count("*").alias("object_count"))
    j = jobs.where("status = 'succeeded' and is_public").agg(F.count("*").alias("reconstruction_count"))
    one = F.lit(1).alias("one")
    p, o, j = (x.select("*", one) for x in (p, o, j))
    return p.join(F.broadcast(o), "one").join(F.broadcast(j), "one").drop("one")
