"""High-dynamic-range composite of frames with different exposures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfield.functions import photometry as P
from lumenfield.operators.pixels import CELL, FRAME
from lumenfield.operators.quantile import exact_quantiles
from lumenfield.session import reliable_checkpoint

KNEE = 0.75
HEADROOM = 0.9


def saturation_levels(pixels: DataFrame, frames: DataFrame) -> DataFrame:
    """Declared white level, else the smallest saturated value, else null: nothing is clipped."""
    seen = pixels.where("is_saturated").groupBy(*FRAME).agg(F.min("value").alias("_clip"))
    white = F.col("white_level") if "white_level" in frames.columns else F.lit(None).cast("double")
    return frames.join(seen, FRAME, "left").select(*FRAME, F.coalesce(white, "_clip").alias("sat_level"))


def reference_frames(pixels: DataFrame, levels: DataFrame, knee: float = KNEE) -> DataFrame:
    """Per stack the frame with most usable pixels; ties go to the smaller id."""
    d = pixels.join(levels, FRAME)
    below = F.col("sat_level").isNull() | (F.col("value") < F.col("sat_level") * knee)
    n = d.groupBy(*FRAME).agg(F.count_if((F.col("value") > 0) & P.good_pixel() & below).alias("n"))
    key = F.struct(F.col("n"), -F.col("frame_id"))
    return n.groupBy("stack_id").agg(F.max_by("frame_id", key).alias("ref_id"))


def relative_scales(
    pixels: DataFrame, frames: DataFrame, levels: DataFrame, refs: DataFrame, min_pixels: int = 200
) -> DataFrame:
    """Flux scale of each frame to its reference: robust median ratio, else the exposure ratio."""
    info = frames.select(*FRAME, "noise_sigma", "exposure_seconds").join(levels, FRAME).join(refs, "stack_id")
    d = pixels.join(info, FRAME)
    linear = F.col("sat_level").isNull() | (F.col("value") < F.col("sat_level") * HEADROOM)
    ok = P.good_pixel() & linear & (F.col("value") > 5.0 * F.greatest("noise_sigma", F.lit(1e-9)))
    d = d.where(ok).select(*CELL, "frame_id", "ref_id", "value")
    ref = d.where("frame_id = ref_id").select(*CELL, F.col("value").alias("_rv"))
    pairs = d.where("frame_id <> ref_id").join(ref, CELL).withColumn("_ratio", F.col("_rv") / F.col("value"))
    pairs = reliable_checkpoint(pairs.select(*FRAME, "_ratio"))
    n = pairs.groupBy(*FRAME).agg(F.count("*").alias("n_overlap"))
    med = exact_quantiles(pairs, FRAME, "_ratio", {"_median": 0.5})
    own = frames.select(*FRAME, "exposure_seconds").join(refs, "stack_id")
    ref_exp = own.where("frame_id = ref_id").select("stack_id", F.col("exposure_seconds").alias("_re"))
    d = own.join(ref_exp, "stack_id").join(n, FRAME, "left").join(med, FRAME, "left")
    enough = F.coalesce("n_overlap", F.lit(0)) >= min_pixels
    scale = F.when(F.col("frame_id") == F.col("ref_id"), 1.0).when(enough, F.col("_median")).otherwise(
        F.coalesce(F.try_divide("_re", "exposure_seconds"), F.lit(1.0))
    )
    d = reliable_checkpoint(d)
    return d.select(*FRAME, "ref_id", scale.alias("scale"), F.coalesce("n_overlap", F.lit(0)).alias("n_overlap"))


def composite(
    pixels: DataFrame, frames: DataFrame, levels: DataFrame, scales: DataFrame, knee: float = KNEE
) -> DataFrame:
    """Inverse-variance mean tapered at saturation and noise floor, with a recovered-core mark."""
    typical = frames.groupBy("stack_id").agg(F.median("exposure_seconds").alias("_typical"))
    info = frames.select(*FRAME, "noise_sigma", "exposure_seconds").join(levels, FRAME)
    info = info.join(scales.select(*FRAME, "scale"), FRAME).join(typical, "stack_id")
    d = pixels.join(info, FRAME)
    conf = P.confidence(F.col("value"), F.greatest("noise_sigma", F.lit(1e-9)), F.col("sat_level"), knee)
    d = d.withColumn("_conf", F.when(P.good_pixel(), conf).otherwise(0.0))
    var = F.greatest("variance", F.lit(P.VARIANCE_FLOOR)) * F.col("scale") * F.col("scale")
    d = d.withColumn("_v", var).withColumn("_w", F.col("_conf") / F.greatest("_v", F.lit(1e-30)))
    long = F.col("exposure_seconds") >= F.col("_typical")
    g = d.groupBy(*CELL).agg(
        F.sum(F.col("_w") * F.col("value") * F.col("scale")).alias("_n"), F.sum("_w").alias("weight"),
        F.sum(F.col("_w") * F.col("_w") * F.col("_v")).alias("_vn"),
        F.bool_or(long & (F.col("_conf") > 0)).alias("_long"),
    )
    w = F.when(F.col("weight") > 0, F.col("weight"))
    return g.select(
        *CELL, F.coalesce(F.col("_n") / w, F.lit(0.0)).alias("image"), "weight",
        F.coalesce(F.sqrt("_vn") / w, F.lit(0.0)).alias("sigma"),
        (w.isNotNull() & ~F.col("_long")).alias("is_recovered"),
    )


def composite_report(image: DataFrame, frames: DataFrame) -> DataFrame:
    """Dynamic range in stops and the share of pixels recovered from short exposures alone."""
    image = reliable_checkpoint(image)
    pos = exact_quantiles(image.where("image > 0"), ["stack_id"], "image", {"_hi": 0.9999, "_lo": 0.01})
    size = frames.groupBy("stack_id").agg((F.max("width") * F.max("height")).alias("_px"))
    n = image.groupBy("stack_id").agg(F.count_if("is_recovered").alias("_r"))
    d = size.join(n, "stack_id").join(pos, "stack_id", "left")
    stops = F.log2(F.col("_hi") / F.greatest("_lo", F.lit(1e-9)))
    return d.select("stack_id", F.coalesce(stops, F.lit(0.0)).alias("stops"), (F.col("_r") / F.col("_px")).alias("recovered_fraction"))
