"""Blocks of stored documents, and packed columns of numbers that blocks and hash buckets send each other.

Operators that look at every window of every document would shuffle a row for each. Here a block of
documents sends each bucket of the hash space one row that packs all its hashes of that bucket, and a
bucket answers each block with one row. Spark partitions and shuffles the rows; NumPy reads what is packed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfield.llm.batches import BLOCK, blocks, text_bytes
from lumenfield.llm.words import FOLD, split_bytes

TEXT_BLOCK = 2 << 20
_U = np.uint64
_TEXTS = "ids array<long>, bytes array<int>, raw int, n_words long, text binary"


def planes(x: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of each value, byte planes behind each other, so that constant planes compress."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unplaned(raw: bytes, n: int, width: int, at: int = 0) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T
    return out.view("<u8").ravel()


def buckets_of(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> _U(32)) * _U(n) >> _U(32)).astype(np.int64)


def dealt(h: np.ndarray, n_buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Places of the hashes of each bucket, in order."""
    bucket = buckets_of(h, n_buckets)
    order = np.argsort(bucket.astype(np.uint32), kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
    for b in np.flatnonzero(np.diff(cuts)).tolist():
        yield b, order[cuts[b] : cuts[b + 1]]


def _normal(data: np.ndarray, offsets: np.ndarray) -> tuple[bytes, np.ndarray, int]:
    """Words of each text with one blank between; bytes of each text; number of words."""
    w = split_bytes(data, offsets)
    keep = np.zeros(len(data) + 1, np.int64)
    inner = np.ones(len(w.start), bool)
    inner[w.first[:-1][w.count > 0]] = False
    gap = w.start[inner] - 1
    edge = np.zeros(len(data) + 1, np.int32)
    np.add.at(edge, w.start, 1)
    np.add.at(edge, w.end, -1)
    flag = np.cumsum(edge[:-1]) > 0
    flag[gap] = True
    clean = data.copy()
    clean[gap] = 0x20
    np.cumsum(flag, out=keep[1:])
    return clean[flag].tobytes(), np.diff(keep[offsets]), len(w.start)


def text_blocks(df: DataFrame, key: str, text: str, size: int = TEXT_BLOCK) -> DataFrame:
    """Documents in blocks of whole rows: ids, bytes of each text, and all texts compressed."""
    source = df.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=6)
        for batch in batches:
            for b in blocks(batch, "text", size):
                parts = [_normal(*text_bytes(x.column("text"))) for x in blocks(b, "text", BLOCK)]
                raw = b"".join(x for x, _, _ in parts)
                length = np.concatenate([n for _, n, _ in parts]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b.column("id").to_pylist()], pa.list_(pa.int64())), pa.array([length], pa.list_(pa.int32())), pa.array([len(raw)], pa.int32()), pa.array([sum(n for _, _, n in parts)], pa.int64()), pa.array([pack.compress(raw)], pa.binary())],
                    ["ids", "bytes", "raw", "n_words", "text"],
                )

    return source.mapInArrow(run, _TEXTS).withColumn("block", F.monotonically_increasing_id())


class Block:
    """Words of one stored block: hashes of all words, first word of each document."""

    def __init__(self, row: dict, fold: bool = False):
        self.data = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["text"], max(row["raw"], 1)) if row["raw"] else b"", np.uint8)
        if fold:
            self.data = FOLD[self.data]
        self.offsets = np.concatenate([[0], np.cumsum(np.array(row["bytes"], np.int64))])
        self.ids = row["ids"]
        self.known = np.array([x is not None for x in self.ids], bool)
        hashes, counts, a = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
        while a < len(self.ids):  # documents of about BLOCK bytes at a time
            b = max(a + 1, int(np.searchsorted(self.offsets, self.offsets[a] + BLOCK, side="right")) - 1)
            w = split_bytes(self.data[self.offsets[a] : self.offsets[b]], self.offsets[a : b + 1] - self.offsets[a])
            hashes.append(w.hash)
            counts.append(w.count)
            a = b
        self.hash = np.concatenate(hashes)
        self.count = np.concatenate(counts)
        self.first = np.concatenate([[0], np.cumsum(self.count)])

    def places(self, n: int) -> np.ndarray:
        """Words at which a window of n words of one document with an id starts."""
        last = np.repeat(np.where(self.known, self.first[1:] - n, -1), self.count)
        return np.flatnonzero(np.arange(len(self.hash)) <= last)

    def doc(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, at, side="right") - 1

    def text(self, d: int) -> bytes:
        return self.data[self.offsets[d] : self.offsets[d + 1]].tobytes()
