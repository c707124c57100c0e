"""Exact substring duplicates by fixed-block anchors.

Every document is an index of non-overlapping blocks of 25 words, and every rolling window of 25 words
probes that index. A repeat of 50 words or more always holds a whole block of the earlier document, so
each repeat has an anchor. From the anchors hits are extended on both sides: all 50-word windows around
a hit are compared, by 80 bits and more of content, with the smallest document that starts the same
window; the union of the windows that an earlier document has is the maximal repeated text.

Millions of probes meet as packed messages. Documents are stored in blocks of about two megabytes; a
block sends each bucket of the hash space one message with its hashes and word positions, a bucket answers
each block with the positions that met, and the answers are joined to the block. A bucket holds a fixed
share of the hash space, so its size follows the number of shuffle partitions; a passage that a third of
all documents share is a run of equal hashes in one bucket, looked at once, never as pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfield.llm.packed import Block, dealt, planes, text_blocks, unplaned
from lumenfield.llm.rows import stored
from lumenfield.llm.words import grams, mix

WINDOW, ANCHOR = 50, 25
_U = np.uint64
_OPEN = "block long, ids array<long>, words array<int>, sha array<string>, bytes array<int>, raw int, text binary, starts binary"


def _messages(found: Iterator[tuple[int, int, int, bytes]]) -> Iterator[pa.RecordBatch]:
    rows = list(zip(*found, strict=True))
    if rows:
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows[0], pa.int32()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.int32()), pa.array(rows[3], pa.binary())], ["bucket", "block", "n", "body"]
        )


_MESSAGE = "bucket int, block long, n int, body binary"
_ANSWER = "block long, at binary"


def _answers(block: np.ndarray, at: np.ndarray) -> pa.Table:
    order = np.lexsort((at, block))
    block, at = block[order], at[order]
    first = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]) if len(block) else np.zeros(0, np.int64)
    parts = np.split(at.astype("<u4"), first[1:]) if len(block) else []
    return pa.table({"block": pa.array(block[first], pa.int64()), "at": pa.array([x.tobytes() for x in parts], pa.binary())})


def _answered(t: pa.Table) -> np.ndarray:
    """All positions that buckets answered to one block, ascending."""
    return np.sort(np.frombuffer(b"".join(t.column("at").to_pylist()), "<u4").astype(np.int64))


# --- anchors -------------------------------------------------------------------------------------------


def _probes(n_buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                b = Block(row)
                at = b.places(ANCHOR)
                h = grams(b.hash, ANCHOR)[at]
                anchor = (at - b.first[b.doc(at)]) % ANCHOR == 0

                def each(at=at, h=h, anchor=anchor, row=row):
                    for bucket, i in dealt(h, n_buckets):
                        step = np.diff(at[i], prepend=0) * 2 + anchor[i]
                        yield bucket, row["block"], len(i), planes(h[i], 4) + planes(step, 4)

                yield from _messages(each())

    return run


def _meet(t: pa.Table) -> pa.Table:
    """Positions whose 25 words are an anchor block somewhere and occur at another place too."""
    block, n = t.column("block").to_numpy(), t.column("n").to_numpy()
    key, step = [], []
    for size, raw in zip(n.tolist(), t.column("body").to_pylist(), strict=True):
        key.append(unplaned(raw, size, 4).astype(np.uint32))
        step.append(unplaned(raw, size, 4, 4 * size).astype(np.int64))
    anchor = np.concatenate([x & 1 for x in step]).astype(bool)
    at = np.concatenate([np.cumsum(x >> 1) for x in step])
    block, key = np.repeat(block, n), np.concatenate(key)
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[first, len(key)])
    good = (size > 1) & np.logical_or.reduceat(anchor[order], first)
    hit = order[np.repeat(good, size)]
    return _answers(block[hit], at[hit])


def _extend(with_text: bool):
    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        """Windows around the hits of a block; documents without any are finished here."""
        if not texts.num_rows:
            raise ValueError("an answer without its block")
        row = texts.to_pylist()[0]
        b = Block(row)
        hits = _answered(answers)
        # a window starts between 25 words before a hit and the hit itself
        near = np.zeros(len(b.hash) + 1, np.int64)
        np.add.at(near, np.maximum(hits - (WINDOW - ANCHOR), b.first[b.doc(hits)]), 1)
        np.add.at(near, hits + 1, -1)
        at = b.places(WINDOW)
        at = at[np.cumsum(near)[at] > 0]
        open_ = np.zeros(len(b.ids), bool)
        open_[b.doc(at)] = True
        keep = open_ | with_text
        first = np.cumsum(np.where(open_, b.count, 0)) - np.where(open_, b.count, 0)
        if with_text:
            first = b.first[:-1]
        sha = [None if o else hashlib.sha256(b.text(d)).hexdigest() for d, o in enumerate(open_.tolist())]
        raw = b"".join(b.text(d) for d in np.flatnonzero(keep).tolist())
        d = b.doc(at)
        starts = first[d] + at - b.first[d]
        out = {
            "block": [row["block"]], "ids": [b.ids], "words": [b.count.tolist()], "sha": [sha], "bytes": [np.where(keep, np.array(row["bytes"], np.int64), 0).tolist()],
            "raw": [len(raw)], "text": [zstandard.ZstdCompressor(level=3).compress(raw)], "starts": [planes(np.diff(starts, prepend=0), 4)],
        }
        return pa.table(out, schema=_open_schema())

    return run


def _open_schema() -> pa.Schema:
    return pa.schema(
        [("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("words", pa.list_(pa.int32())), ("sha", pa.list_(pa.string())), ("bytes", pa.list_(pa.int32())), ("raw", pa.int32()), ("text", pa.binary()), ("starts", pa.binary())]
    )


def _starts(row: dict) -> np.ndarray:
    return np.cumsum(unplaned(row["starts"], len(row["starts"]) // 4, 4).astype(np.int64))


# --- whole windows -------------------------------------------------------------------------------------


def _windows(n_buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                b, at = Block(row), _starts(row)
                h = grams(b.hash, WINDOW)[at]
                second = mix(grams(mix(b.hash ^ _U(0xC2B2AE3D27D4EB4F)), WINDOW)[at])
                ids = np.array([0 if x is None else x for x in b.ids], np.int64)[b.doc(at)]

                def each(at=at, h=h, second=second, ids=ids, row=row):
                    for bucket, i in dealt(h, n_buckets):
                        body = planes(h[i], 4) + planes(second[i], 6) + planes(np.diff(at[i], prepend=0), 4)
                        yield bucket, row["block"], len(i), body + planes(np.diff(ids[i], prepend=0), 8)

                yield from _messages(each())

    return run


def _earlier(t: pa.Table) -> pa.Table:
    """Window starts whose words also start in a document with a smaller id."""
    block, n = t.column("block").to_numpy(), t.column("n").to_numpy()
    parts = [[], [], [], []]
    for size, raw in zip(n.tolist(), t.column("body").to_pylist(), strict=True):
        for x, width, at in zip(parts, (4, 6, 4, 8), (0, 4 * size, 10 * size, 14 * size), strict=True):
            x.append(unplaned(raw, size, width, at))
    one, two = (np.concatenate(x) for x in parts[:2])
    at, ids = (np.concatenate([np.cumsum(y.view(np.int64)) for y in x]) for x in parts[2:])
    block = np.repeat(block, n)
    order = np.lexsort((two, one))
    one, two = one[order], two[order]
    first = np.flatnonzero(np.r_[True, (one[1:] != one[:-1]) | (two[1:] != two[:-1])])
    least = np.repeat(np.minimum.reduceat(ids[order], first), np.diff(np.r_[first, len(one)]))
    hit = order[ids[order] > least]
    return _answers(block[hit], at[hit])


def _finish(with_text: bool):
    names = ["id", "n_words", "removed", "kept_sha256", "kept"]
    ranges = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(opened: pa.Table, answers: pa.Table) -> pa.Table:
        if not opened.num_rows:
            raise ValueError("an answer without its block")
        row = opened.to_pylist()[0]
        covered = _answered(answers)
        size = np.where(np.array(row["bytes"]) > 0, np.array(row["words"]), 0)
        first = np.concatenate([[0], np.cumsum(size)])
        offsets = np.concatenate([[0], np.cumsum(np.array(row["bytes"], np.int64))])
        data = zstandard.ZstdDecompressor().decompress(row["text"], max(row["raw"], 1)) if row["raw"] else b""
        cuts = np.searchsorted(covered, first)
        removed, sha, kept = [], list(row["sha"]), []
        for d in range(len(row["ids"])):
            spans: list[dict[str, int]] = []
            for s in (covered[cuts[d] : cuts[d + 1]] - first[d]).tolist():
                if spans and s <= spans[-1]["end"]:
                    spans[-1]["end"] = s + WINDOW
                else:
                    spans.append({"start": s, "end": s + WINDOW})
            removed.append(spans)
            text = data[offsets[d] : offsets[d + 1]]
            if spans:
                words, left, at = text.split(b" "), [], 0
                for x in spans:
                    left += words[at : x["start"]]
                    at = x["end"]
                text = b" ".join(left + words[at:])
            if sha[d] is None or spans:
                sha[d] = hashlib.sha256(text).hexdigest()
            kept.append(text.decode() if with_text else None)
        arrays = [pa.array(row["ids"], pa.int64()), pa.array(row["words"], pa.int64()), pa.array(removed, ranges), pa.array(sha, pa.string()), pa.array(kept, pa.string())]
        return pa.table(arrays, names=names)

    return run


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    """One row per row of ``df``: ``id``, ``n_words``, ``removed`` (word ranges), ``kept_sha256``, ``kept``.

    A word is removed if a window of 50 words over it also starts in a document with a smaller id. ``kept``
    is the text that is left, one blank between words (null unless ``with_text``). A null or empty text and
    a text of fewer than 50 words lose nothing. Rows with a null id neither lose words nor count as earlier
    documents. Rows with equal ids do not precede one another, so exact repeats of a row lose the same words.
    An empty table gives no rows. Other columns are not read.
    """
    n_buckets = 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = stored(text_blocks(df, key, text), "substring-blocks")
    hits = texts.mapInArrow(_probes(n_buckets), _MESSAGE).groupBy("bucket").applyInArrow(_meet, _ANSWER)
    opened = texts.groupBy("block").cogroup(hits.groupBy("block")).applyInArrow(_extend(with_text), _OPEN)
    opened = stored(opened, "substring-open")
    found = opened.where(F.length("starts") > 0).mapInArrow(_windows(n_buckets), _MESSAGE).groupBy("bucket").applyInArrow(_earlier, _ANSWER)
    result = "id long, n_words long, removed array<struct<start:int,end:int>>, kept_sha256 string, kept string"
    return opened.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(_finish(with_text), result)


def n_removed(removed: Column) -> Column:
    return F.aggregate(removed, F.lit(0).cast("long"), lambda acc, x: acc + (x["end"] - x["start"]).cast("long"))
