"""Joins that stay even when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfield.session import shuffle_width

SALTS = 16


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition by the group keys at the session's full shuffle width.

    Grouped NumPy work is heavy per byte, so its partitions must not be coalesced by size; the group
    operator that follows reuses this partitioning.
    """
    return df.repartition(shuffle_width(df.sparkSession), *keys)


def salted_lookup(rows: DataFrame, lookup: DataFrame, keys: list[str], ident: str, salts: int = SALTS) -> DataFrame:
    """Left join to a table with one row per key; the big side is spread by a salt of its id."""
    many = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(ident), F.lit(salts)).cast("int"))
    return salted.join(many, [*keys, "_salt"], "left").drop("_salt")
