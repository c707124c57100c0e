"""Arrow helpers: add one struct column computed from the text, in blocks of bounded size.

Operators that read whole texts in NumPy take Arrow batches as Spark cuts them, and cut them again into
blocks of about ``BLOCK`` bytes, so that their working arrays stay near 40 bytes per byte of a block. A
single text larger than a block is a block of its own.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK = 1 << 20


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts behind each other, and the n + 1 offsets of the texts; null counts as empty."""
    texts = texts.fill_null("").cast(pa.large_string())
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = texts.buffers()[2] if n else None
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def blocks(batch: pa.RecordBatch, text: str, size: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with about ``size`` bytes of text each."""
    if not batch.num_rows:
        return
    _, offsets = text_bytes(batch.column(text))
    part = offsets[:-1] // size
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(a, b - a)


def give_back() -> None:
    """Return freed memory to the system, so that a worker that waits for its next task holds little."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library can
        ctypes.CDLL(None).malloc_trim(0)


def annotate(
    df: DataFrame,
    text: str,
    out: str,
    kind: T.StructType,
    fn: Callable[[pa.Array], pa.Array],
    carry: list[str] | None = None,
    size: int = BLOCK,
) -> DataFrame:
    """``df`` with a struct column ``out`` of type ``kind``; ``fn`` makes it from an array of texts.

    ``carry`` names the columns that stay (all by default). A column that is already called ``out`` is
    replaced; no other name can clash, because the text travels under a name that is not in ``df``.
    """
    keep = [c for c in (df.columns if carry is None else carry) if c != out]
    own = "_text"
    while own in keep or own == out:
        own += "_"
    source = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias(own))
    schema = T.StructType([*[df.schema[c] for c in keep], T.StructField(out, kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch, own, size):
                made = fn(b.column(own))
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], made], [*keep, out])
        give_back()

    return source.mapInArrow(run, schema)
