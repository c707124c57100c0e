"""Sky-object catalogue: designations, token resolution, listing and denormalised counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def designation(catalog: Column, number: Column) -> Column:
    """``M31`` but ``NGC 224``."""
    return F.when(catalog == "M", F.concat(catalog, number)).otherwise(
        F.concat(catalog, F.lit(" "), number)
    )


def _lookup(objects: DataFrame) -> DataFrame:
    """One row per searchable key with the smallest object id, so a popular name stays one row."""
    keys = F.array(
        F.struct(F.lit("id").alias("kind"), F.col("object_id").cast("string").alias("key")),
        F.struct(F.lit("code").alias("kind"), F.upper(F.concat("catalog", "catalog_number")).alias("key")),
        F.struct(F.lit("name").alias("kind"), F.upper("common_name").alias("key")),
        F.struct(F.lit("name").alias("kind"), F.upper("common_name_es").alias("key")),
    )
    aliases = F.transform("aliases", lambda a: F.struct(F.lit("alias").alias("kind"), a.alias("key")))
    rows = objects.select("object_id", F.explode(F.concat(keys, aliases)).alias("k"))
    return rows.groupBy("k.kind", "k.key").agg(F.min("object_id").alias("object_id"))


def resolve_tokens(tokens: DataFrame, objects: DataFrame, token: str = "token") -> DataFrame:
    """Object of each distinct token: by id first, else by designation, name or alias."""
    t = F.trim(F.col(token))
    kinds = F.array(
        F.struct(F.lit("id").alias("kind"), t.alias("key")),
        F.struct(F.lit("code").alias("kind"), F.upper(F.replace(t, F.lit(" "), F.lit(""))).alias("key")),
        F.struct(F.lit("name").alias("kind"), F.upper(t).alias("key")),
        F.struct(F.lit("alias").alias("kind"), t.alias("key")),
    )
    asked = tokens.select(token).distinct().select(token, F.explode(kinds).alias("k"))
    asked = asked.select(token, F.col("k.kind").alias("kind"), F.col("k.key").alias("key"))
    best = F.min(F.struct(F.when(F.col("kind") == "id", 0).otherwise(1).alias("p"), F.col("object_id")))
    return (
        asked.join(_lookup(objects), ["kind", "key"])
        .groupBy(token)
        .agg(best.alias("b"))
        .select(token, F.col("b.object_id").alias("object_id"))
    )


def list_objects(objects: DataFrame, text: str | None, limit: int, after=None) -> DataFrame:
    """Objects by (catalog, id); every page keeps the same total order."""
    if text:
        p = f"%{text.strip()}%"
        objects = objects.where(
            F.col("common_name").ilike(p)
            | F.col("common_name_es").ilike(p)
            | F.col("catalog_number").ilike(p)
        )
    if after is not None:
        cat, oid = after
        objects = objects.where(
            (F.col("catalog") > cat) | ((F.col("catalog") == cat) & (F.col("object_id") > oid))
        )
    return objects.orderBy("catalog", "object_id").limit(limit + 1)


def with_counts(objects: DataFrame, photos: DataFrame, jobs: DataFrame) -> DataFrame:
    """Photo and reconstruction counts per object; zero where nothing points at it."""
    live = photos.where("deleted_at is null and status = 'ready' and object_id is not null")
    n_photos = live.groupBy("object_id").agg(F.count("*").alias("photo_count"))
    done = jobs.where("status = 'succeeded' and is_public")
    n_jobs = done.groupBy("object_id").agg(F.count("*").alias("reconstruction_count"))
    return (
        objects.join(n_photos, "object_id", "left")
        .join(n_jobs, "object_id", "left")
        .fillna(0, ["photo_count", "reconstruction_count"])
    )
