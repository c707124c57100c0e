"""Running totals per key that never sort a whole key in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOUR = 3600


def time_chunk(ts: str, seconds: int = HOUR) -> Column:
    return F.floor(F.unix_micros(ts) / F.lit(seconds * 1_000_000)).cast("bigint")


def running(df: DataFrame, keys: list[str], order: list[str], chunk: Column, value: str) -> DataFrame:
    """Add ``running`` (prefix sum in ``order``) and ``running_low`` (its minimum so far).

    ``chunk`` must rise with ``order``. Rows are sorted only inside one (key, chunk); the chunks of
    a key are linked through one carried total each, so a key with a third of all rows is spread
    over its chunks.
    """
    parts = [*keys, "_chunk"]
    inner = Window.partitionBy(*parts).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    d = df.withColumn("_chunk", chunk).withColumn("_local", F.sum(value).over(inner))
    d = d.withColumn("_local_low", F.min("_local").over(inner))
    totals = d.groupBy(*parts).agg(F.sum(value).alias("_total"), F.min("_local").alias("_low"))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.withColumn("_carry", F.coalesce(F.sum("_total").over(before), F.lit(0)))
    carry = carry.withColumn("_carry_low", F.min(F.col("_carry") + F.col("_low")).over(before))
    d = d.join(carry.select(*parts, "_carry", "_carry_low"), parts)
    total = F.col("_carry") + F.col("_local")
    low = F.least(F.col("_carry_low"), F.col("_carry") + F.col("_local_low"))
    return d.withColumns({"running": total, "running_low": low}).drop(
        "_chunk", "_local", "_local_low", "_carry", "_carry_low"
    )


def rolling_count(
    df: DataFrame, keys: list[str], ts: str, ident: str, seconds: int = 86400, chunk: int = HOUR
) -> DataFrame:
    """Rows of the same key in ``(t - seconds, t]`` for every row, itself included.

    Each row is counted once at its own time and probed once at ``t - seconds``; the count is the
    difference of two prefix sums from :func:`running`.
    """
    base = df.select(*keys, ident, F.unix_micros(ts).alias("_t"))
    marks = F.array(
        F.struct(F.col("_t").alias("at"), F.lit(1).alias("one")),
        F.struct((F.col("_t") - seconds * 1_000_000).alias("at"), F.lit(0).alias("one")),
    )
    rows = base.select(*keys, ident, F.explode(marks).alias("m"))
    rows = rows.select(*keys, ident, F.col("m.at").alias("_at"), F.col("m.one").cast("bigint").alias("_one"))
    # peers at the same instant: all events come before the probes, and ties count in full
    peers = rows.groupBy(*keys, "_at").agg(F.sum("_one").alias("_n"))
    pref = running(
        peers, keys, ["_at"], F.floor(F.col("_at") / F.lit(chunk * 1_000_000)).cast("bigint"), "_n"
    ).select(*keys, "_at", "running")
    both = rows.join(pref, [*keys, "_at"])
    counts = both.groupBy(*keys, ident).agg(
        (F.max(F.when(F.col("_one") == 1, F.col("running")))
         - F.max(F.when(F.col("_one") == 0, F.col("running")))).alias("n_window")
    )
    return df.join(counts.select(ident, "n_window"), ident)


def previous(
    df: DataFrame, keys: list[str], order: list[str], chunk: Column, value: Column, name: str
) -> DataFrame:
    """The preceding row's ``value`` in ``order`` per key, carried over chunk borders."""
    parts = [*keys, "_chunk"]
    d = df.withColumn("_chunk", chunk).withColumn("_value", value)
    w = Window.partitionBy(*parts).orderBy(*order)
    d = d.withColumn("_prev", F.lag(F.struct("_value")).over(w))
    last = d.groupBy(*parts).agg(F.max_by(F.struct("_value"), F.struct(*order)).alias("_last"))
    across = Window.partitionBy(*keys).orderBy("_chunk")
    last = last.select(*parts, F.lag("_last").over(across).alias("_carry"))
    d = d.join(last, parts)
    seen = F.coalesce(F.col("_prev"), F.col("_carry"))
    return d.withColumn(name, seen["_value"]).drop("_chunk", "_value", "_prev", "_carry")
