"""Rows of a document table found again by key and text, where keys may be null or repeated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfield.session import work_folder


def stored(df: DataFrame, name: str) -> DataFrame:
    """An intermediate written once to the shared folder: cuts the plan, survives lost executors, has a known size."""
    path = work_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def free(name: str, taken: list[str]) -> str:
    """``name``, lengthened until no column of ``taken`` bears it (names are equal in any case)."""
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name += "_"
    return name


def text_hash(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit("")))


def without(docs: DataFrame, gone: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows that ``gone`` (columns ``id``, ``hash``) names; all columns and copies of the rest stay."""
    match = docs[key].eqNullSafe(gone["id"]) & (text_hash(text) == gone["hash"])
    return docs.join(gone, match, "left_anti")
