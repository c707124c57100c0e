"""Exact interpolated quantiles of large groups without holding a group in one buffer."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenfield.session import reliable_checkpoint

ACCURACY = 10_000
SMALL = 20_000


def exact_quantiles(
    df: DataFrame, keys: list[str], value: str, probs: dict[str, float]
) -> DataFrame:
    """One row per group with an exact linear-interpolated quantile per name in ``probs``.

    A bounded sketch brackets each wanted rank; only distinct values inside the bracket (a few
    ten-thousandths of the group) are then counted and ranked. Groups below ``SMALL`` rows are
    ranked directly by the same path. Nulls and NaNs are ignored.
    """
    if not keys:
        one = exact_quantiles(df.withColumn("_all", F.lit(1)), ["_all"], value, probs)
        return one.drop("_all")
    v = F.col(value).cast("double")
    d = df.select(*keys, v.alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    slack = 2.0 / ACCURACY
    fractions = []
    for p in probs.values():
        fractions += [max(0.0, p - slack), min(1.0, p + slack)]
    sketch = F.percentile_approx("_v", fractions, ACCURACY)
    head = d.groupBy(*keys).agg(
        F.count("*").alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"),
        sketch.alias("_q"),
    )
    small = F.col("_n") <= SMALL
    brackets = []
    for i, p in enumerate(probs.values()):
        brackets.append(
            F.struct(
                F.lit(i).alias("i"),
                F.when(small | F.lit(p <= slack), F.col("_min")).otherwise(F.col("_q")[2 * i]).alias("lo"),
                F.when(small | F.lit(p >= 1 - slack), F.col("_max")).otherwise(F.col("_q")[2 * i + 1]).alias("hi"),
                (F.lit(p) * (F.col("_n") - 1)).alias("r"),
            )
        )
    head = head.select(*keys, F.array(*brackets).alias("_b"))
    j = d.join(head, keys)
    j = j.select(*keys, "_v", F.explode("_b").alias("_b")).where(F.col("_v") <= F.col("_b.hi"))
    inside = F.when(F.col("_v") >= F.col("_b.lo"), F.col("_v"))
    counts = j.groupBy(*keys, F.col("_b.i").alias("_i"), F.col("_b.r").alias("_r"), inside.alias("_v")).agg(
        F.count("*").alias("_c")
    )
    # one exchange on the keys serves both the ranking and the final fold
    counts = counts.repartition(*keys)
    w = Window.partitionBy(*keys, "_i").orderBy(F.asc_nulls_first("_v"))
    counts = counts.withColumn("_cum", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    base, hit = F.floor("_r"), F.col("_v").isNotNull()
    names, folds, results = list(probs), [], []
    for i in range(len(names)):
        mine = F.col("_i") == i
        folds += [
            F.min(F.when(mine & hit & (F.col("_cum") > base), F.col("_v"))).alias(f"_lo{i}"),
            F.min(F.when(mine & hit & (F.col("_cum") > base + 1), F.col("_v"))).alias(f"_hi{i}"),
            F.max(F.when(mine & ~hit, F.col("_cum"))).alias(f"_below{i}"),
            F.max(F.when(mine, F.col("_r"))).alias(f"_r{i}"),
        ]
        lo, hi, r = F.col(f"_lo{i}"), F.col(f"_hi{i}"), F.col(f"_r{i}")
        part = r - F.floor(r)
        missed = lo.isNull() | (F.coalesce(f"_below{i}", F.lit(0)) > F.floor(r)) | ((part > 0) & hi.isNull())
        value = (
            F.when(missed, F.raise_error(F.lit("quantile bracket missed its rank")).cast("double"))
            .when(part > 0, lo + (hi - lo) * part)
            .otherwise(lo)
        )
        results.append(value.alias(names[i]))
    return counts.groupBy(*keys).agg(*folds).select(*keys, *results)


def median_mad(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Group median ``med`` and median absolute deviation ``mad``.

    The medians, one row per group, are written out first; otherwise every further level would scan
    the input three times as often.
    """
    med = reliable_checkpoint(exact_quantiles(df, keys, value, {"med": 0.5}))
    dev = df.join(med, keys).withColumn("_d", F.abs(F.col(value) - F.col("med")))
    return exact_quantiles(dev, [*keys, "med"], "_d", {"mad": 0.5})
