"""Order statistics of short arrays, evaluated in place without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sorted_quantile(s: Column, p: float) -> Column:
    """Linear-interpolated quantile of a sorted array; null for an empty one."""
    n = F.size(s)
    r = F.lit(p) * (n - 1)
    lo = F.floor(r).cast("int")
    a = F.when(n > 0, F.get(s, F.greatest(lo, F.lit(0))))
    b = F.get(s, F.least(lo + 1, n - 1))
    return a + (b - a) * (r - lo)


def median(a: Column) -> Column:
    s = F.sort_array(a)
    n = F.size(s)
    mid = F.floor((n - 1) / 2).cast("int")
    other = F.floor(n / 2).cast("int")
    return F.when(n > 0, (F.get(s, F.greatest(mid, F.lit(0))) + F.get(s, F.least(other, n - 1))) / 2.0)


def mad(a: Column, centre: Column) -> Column:
    return median(F.transform(a, lambda v: F.abs(v - centre)))


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v)
