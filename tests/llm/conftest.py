from __future__ import annotations

import duckdb
import pytest

from tests.conftest import DATA
from tools.compare import TABLES

#: nulls, empty texts, ties, repeated rows, a text longer than a block, and columns whose names could clash
LONG = " ".join(f"w{i % 4001}x{i}" for i in range(160_000))
ODD = [
    (1, "The quick brown fox. " * 3 + "tail é ü", "en", "a"),
    (1, "The quick brown fox. " * 3 + "tail é ü", "en", "a"),
    (2, None, None, None),
    (3, "", "en", None),
    (None, "no name here token = 'abcdef123456'", None, "b"),
    (None, None, None, None),
    (4, " \t\n\v\f\r ", "en", "a"),
    (5, LONG, "en", "a"),
    (6, LONG + " end", "en", "a"),
    (7, "a <|endoftext|> b\u00a0c e\u0301.\u200d \U0001f469\u200d\U0001f4bb", "xx", "c"),
    (1, "another text under the same id", "en", "a"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="session")
def odd(spark):
    """The odd rows in two partitions, with columns named like inner ones."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ODD, SCHEMA).repartition(2)
    return df.select("*", *[F.lit(1).alias(c) for c in ("id", "hash", "bpe", "contamination", "kept", "row", "block", "n_words", "_text", "text_hash", "spans", "a", "b")])


@pytest.fixture(scope="session")
def docs():
    """Id and text of the given documents."""
    return duckdb.sql(f"select doc_id, coalesce(text, '') from '{DATA}/documents.parquet' order by doc_id").fetchall()


@pytest.fixture(scope="session")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c
