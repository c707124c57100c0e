"""Registered queries: name, inventory ids, Spark builder and the checking SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfield.functions.licences import LICENCES, licence_table
from lumenfield.operators.skew import spread
from lumenfield.session import configure, size_shuffles, work_folder
from lumenfield.sources.derive import TABLES
from lumenfield.sources.dialect import CheckText, SparkText


#: derived tables that a pixel archive keeps on disk, and where this application wrote them
STORED = ("pixels", "frames")
_PATHS: dict[tuple[str, str, str], str] = {}


class Catalogue:
    """Lazy access to the given tables and to the tables derived from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = configure(spark)
        self.folder = folder.rstrip("/")
        size_shuffles(spark, self.folder)

    def given(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        if name in STORED:
            return self._stored(name)
        return self._derived(name)

    def _derived(self, name: str) -> DataFrame:
        build, needs = TABLES[name]
        return self.spark.sql(build(SparkText()), **{n: self.given(n) for n in needs})

    def _stored(self, name: str) -> DataFrame:
        """Pixel tables are stored inputs: derived once per application, then read back pruned."""
        key = (self.spark.sparkContext.applicationId, self.folder, name)
        if key not in _PATHS:
            path = work_folder(self.spark, name)
            spread(self._derived(name), "stack_id", "frame_id").write.parquet(path)
            _PATHS[key] = path
        return self.spark.read.parquet(_PATHS[key])

    @cached_property
    def licences(self) -> DataFrame:
        return licence_table(self.spark)


@dataclass(frozen=True)
class Query:
    name: str
    covers: tuple[str, ...]
    build: Callable[[Catalogue], DataFrame]
    sql: str | None

    def __call__(self, spark: SparkSession, folder: str) -> DataFrame:
        return self.build(Catalogue(spark, folder))


QUERIES: dict[str, Query] = {}


def query(name: str, covers: str, sql: str | None = None):
    """Register ``fn(catalogue) -> DataFrame``; ``covers`` lists inventory ids."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = Query(name, tuple(covers.split()), fn, sql)
        return fn

    return add


def r6(col: Column | str) -> Column:
    """Six decimals, with the tie moved off exact decimals so both engines agree."""
    c = F.col(col) if isinstance(col, str) else col
    return F.floor(c * 1e6 + 0.5001) / F.lit(1e6)


def r1(col: Column | str) -> Column:
    """One decimal, for values interpolated at positions that pass through trigonometry."""
    c = F.col(col) if isinstance(col, str) else col
    return F.floor(c * 10.0 + 0.5001) / F.lit(10.0)


def r3(col: Column | str) -> Column:
    """Three decimals, for values that pass through chains of trigonometry."""
    c = F.col(col) if isinstance(col, str) else col
    return F.floor(c * 1e3 + 0.5001) / F.lit(1e3)


def s6(expr: str) -> str:
    return f"(floor(({expr}) * 1e6 + 0.5001) / 1e6)"


def round_all(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Round every double column with :func:`r6`."""
    return df.select(
        *[
            r6(n).alias(n) if t in ("double", "float") and n not in keep else F.col(n)
            for n, t in df.dtypes
        ]
    )


def _licence_cte() -> str:
    rows = ", ".join(
        "('{}', {}, {}, {}, {}, {}, '{}')".format(*[str(v).lower() if isinstance(v, bool) else v for v in r])
        for r in LICENCES
    )
    return (
        "licences(code, allows_commercial, allows_derivatives, requires_attribution,"
        f" requires_sharealike, restrictiveness, version) as (values {rows})"
    )


def check(tables: str, body: str, ctes: str = "") -> str:
    """Checking SQL: the derived tables as CTEs in front of ``body``."""
    parts = []
    for t in tables.split():
        if t == "licences":
            parts.append(_licence_cte())
        else:
            parts.append(f"{t} as materialized ({TABLES[t][0](CheckText())})")
    if ctes:
        parts.append(ctes)
    return ("with recursive " + ", ".join(parts) + " " if parts else "") + body
