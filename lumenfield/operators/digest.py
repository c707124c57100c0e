"""Order-independent checksums built level by level, so no task sees a whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FANOUT = 1000
#: ceil(log(2 ** 63) / log(FANOUT))
LEVELS = 7


def level_digest(df: DataFrame, groups: list[str], key: str, text: str) -> DataFrame:
    ordered = F.sort_array(F.collect_list(F.struct(F.col(key).alias("k"), F.col(text).alias("v"))))
    joined = F.concat_ws(",", F.transform(ordered, lambda s: s["v"]))
    return df.groupBy(*groups).agg(F.sha2(joined, 256).alias("digest"), F.count("*").alias("n"))


def tree_digest(
    df: DataFrame, key: str, text: Column, groups: tuple[str, ...] = ()
) -> DataFrame:
    """Root digest per group over rows with unique whole-number ``key``.

    Each level joins at most ``FANOUT`` neighbours in key order. ``LEVELS`` levels leave one node for
    every 64-bit key; the upper ones hold few rows.
    """
    d = df.select(*groups, F.col(key).cast("bigint").alias("_k"), text.alias("digest"))
    for _ in range(LEVELS):
        d = d.withColumn("_b", F.floor(F.col("_k") / FANOUT).cast("bigint"))
        d = level_digest(d, [*groups, "_b"], "_k", "digest").select(
            *groups, F.col("_b").alias("_k"), "digest"
        )
    return d.select(*groups, "digest")


def pixel_checksums(pixels: DataFrame, value: str = "value") -> DataFrame:
    """Checksum per frame over rounded, ordered values: image rows first, then the frame."""
    text = F.concat_ws(":", F.col("x"), F.floor(F.col(value) * 1e4 + 0.5))
    rows = level_digest(
        pixels.withColumn("_v", text), ["stack_id", "frame_id", "y"], "x", "_v"
    )
    frames = rows.withColumn("_v", F.concat_ws(":", "y", "digest")).select("stack_id", "frame_id", "y", "_v")
    return level_digest(frames, ["stack_id", "frame_id"], "y", "_v").select("stack_id", "frame_id", "digest")
