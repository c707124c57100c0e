"""Licence catalogue and the per-row licence rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Code, allows_commercial, allows_derivatives, requires_attribution,
# requires_sharealike, restrictiveness, version.
LICENCES = (
    ("CC0-1.0", True, True, False, False, 0, "1.0"),
    ("CC-BY-4.0", True, True, True, False, 1, "4.0"),
    ("CC-BY-SA-4.0", True, True, True, True, 2, "4.0"),
    ("CC-BY-NC-4.0", False, True, True, False, 3, "4.0"),
    ("CC-BY-NC-SA-4.0", False, True, True, True, 4, "4.0"),
    ("CC-BY-ND-4.0", True, False, True, False, 5, "4.0"),
    ("CC-BY-NC-ND-4.0", False, False, True, False, 6, "4.0"),
    ("ARR", False, False, True, False, 7, ""),
)
LICENCE_SCHEMA = (
    "code string, allows_commercial boolean, allows_derivatives boolean,"
    " requires_attribution boolean, requires_sharealike boolean, restrictiveness int,"
    " version string"
)


def licence_table(spark: SparkSession) -> DataFrame:
    """The eight-row licence dimension; fixed size, so joins may broadcast it."""
    return spark.createDataFrame(list(LICENCES), LICENCE_SCHEMA)


def with_licence_flags(df: DataFrame, code: str = "license") -> DataFrame:
    """Attach the licence flags of ``code``; an unknown code keeps null flags."""
    dim = licence_table(df.sparkSession).withColumnRenamed("code", code)
    return df.join(F.broadcast(dim), code, "left")


def stack_consent(allows_derivatives: Column, consent: Column) -> Column:
    """A licence without derivatives forces the stacking opt-out."""
    return allows_derivatives & consent


def block_reason(allows_derivatives: Column, consent: Column) -> Column:
    """Why a photo may not enter a stack; the licence reason wins over the consent reason."""
    return F.when(~allows_derivatives, "no_derivatives").when(~consent, "stack_opt_out")


def change_allowed(current_rank: Column, new_rank: Column, locked_at: Column) -> Column:
    """A locked licence may only be relaxed."""
    return locked_at.isNull() | (new_rank <= current_rank)


def change_reason(current_rank: Column, new_rank: Column, locked_at: Column) -> Column:
    return (
        F.when(current_rank == new_rank, "unchanged")
        .when(locked_at.isNull(), "not_locked")
        .when(new_rank < current_rank, "relaxed")
        .otherwise("locked")
    )


def manifest_rejection(licence: Column, consent: Column) -> Column:
    """Why a manifest entry is refused, or null."""
    code = F.trim(F.coalesce(licence, F.lit("")))
    upper = F.upper(code)
    forbidden = (
        code.isin("CC-BY-ND-4.0", "CC-BY-NC-ND-4.0", "ND", "ARR", "all-rights-reserved")
        | F.contains(upper, F.lit("-ND-"))
        | F.endswith(upper, F.lit("-ND"))
    )
    return F.when(~consent, "stack_opt_out").when(
        (code != "") & forbidden, F.concat(F.lit("no_derivatives: "), code)
    )
