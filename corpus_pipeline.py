"""The corpus pipeline: each stage reads what its predecessor kept, as a table in the shared folder.

Quality rules, near duplicates, benchmark passages, secrets, and byte-level BPE. The first three drop rows,
the fourth rewrites texts, the last turns texts into ids. All but the last return the columns they were given,
whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfield.llm import bpe, contamination, near, quality, rows, secret_spans
from lumenfield.session import configure, work_folder


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the base rule or lie far outside their language and source.

    Null and empty texts have no words and go; rows with null keys and repeated rows are judged by their texts.
    """
    configure(spark)
    verdict = quality.judge(docs)
    gone = verdict.where(~F.col("kept")).select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"))
    return rows.without(docs, rows.stored(gone, "quality-gone"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each near-duplicate component.

    Null and empty texts and rows with a null key are linked with nothing and stay.
    """
    configure(spark)
    return near.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which at least one word in twenty lies in a benchmark window.

    Null and empty texts have no words and stay; rows are judged one by one, so keys may be null or repeated.
    """
    benchmark = configure(spark).read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    out = rows.free("_contamination", docs.columns)
    found = contamination.find(docs, benchmark, out=out)
    return found.where(~contamination.contaminated(out)).select(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets by a mark; a column of text lengths follows. All rows stay; null and empty texts are untouched."""
    configure(spark)
    clean = secret_spans.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def bpe_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of the texts that are left, with a check that they decode to the text.

    A null text is an empty one, without ids. All rows stay; columns besides key, language and source go.
    """
    configure(spark)
    done = bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"), out="_bpe")
    return done.select(
        "doc_id",
        "lang",
        "source",
        F.size("_bpe.ids").cast("long").alias("n_tokens"),
        F.col("_bpe.ids").alias("ids"),
        F.col("_bpe.decoded").eqNullSafe(F.coalesce("text", F.lit(""))).alias("round_trip"),
    )


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret scan", secret_scan),
    ("bpe", bpe_ids),
]

#: greedy merging and connected similarity are not SQL; tests compare the stages with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and reread."""
    configure(spark)
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        path = work_folder(spark, f"pipeline-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
