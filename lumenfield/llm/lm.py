"""Language-model scores of all documents by stupid backoff over the corpus's own n-gram counts.

Counts of all n-grams up to ``ORDER`` words are tables partitioned by hash: each block of documents sends a
hash bucket its distinct n-grams with their counts, the bucket adds them up and gives every block the
totals of what it asked for, and the scores of the block's n-grams are summed per document. A block
sends an n-gram once however often it occurs there, so a phrase that a third of all documents hold is a
few rows per block.

A document is scored by the counts of all other documents (its own are taken off), so that long unseen
phrases do back off. The score of a word after its context is the relative frequency in the longest
context that occurs elsewhere, times ``BACKOFF`` for each word of context given up; a word that occurs
nowhere else counts as ``BACKOFF`` occurrences.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfield.llm.packed import Block, planes, text_blocks, unplaned
from lumenfield.llm.rows import stored
from lumenfield.llm.words import grams

ORDER, BACKOFF = 3, 0.4
#: bits of a hash within its bucket. With 256 buckets a hash has 52 bits: of 100 million n-grams about one pair
#: shares its count. The buckets, and so the bits, grow with the cluster.
KEY_BITS = 44
#: larger blocks ask for an n-gram less often
BLOCK_BYTES = 4 << 20
_U = np.uint64
_MESSAGE = "bucket int, block long, body binary"


def _bucket_bits(spark) -> int:
    """Buckets are a power of two, about four for each shuffle partition."""
    return int(4 * int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length()


class Grams:
    """Distinct n-grams of a block, ascending by hash, and the number of each place's n-gram among them."""

    def __init__(self, b: Block, n: int):
        last = np.repeat(b.first[1:] - n, b.count)
        self.at = np.flatnonzero(np.arange(len(b.hash)) <= last)
        self.distinct, self.number = np.unique(grams(b.hash, n)[self.at], return_inverse=True)
        self.doc = b.doc(self.at)

    def own(self) -> np.ndarray:
        """How often each place's n-gram occurs in its own document."""
        _, back, count = np.unique(self.doc * max(len(self.distinct), 1) + self.number, return_inverse=True, return_counts=True)
        return count[back]


#: columns of a question (hash, count) and of an answer (total): bytes of a value, and how many low bytes look random
_ASK, _TELL = ((6, 4), (4, 0)), ((6, 0),)


def _pack(parts: list[tuple[np.ndarray, ...]], columns: tuple[tuple[int, int], ...]) -> bytes:
    """Lengths of the orders, random bytes as they are, and the rest compressed: high bytes and counts repeat."""
    low, high = [], []
    for part in parts:
        for x, (width, plain) in zip(part, columns, strict=True):
            x = x.astype(np.uint64)
            low.append(planes(x, plain))
            high.append(planes(x >> _U(8 * plain), width - plain))
    head = np.array([len(parts), *[len(p[0]) for p in parts]], np.int32).tobytes()
    return head + b"".join(low) + zstandard.ZstdCompressor(level=3).compress(b"".join(high))


def _unpack(raw: bytes, columns: tuple[tuple[int, int], ...]) -> list[list[np.ndarray]]:
    sizes = np.frombuffer(raw, np.int32, int(np.frombuffer(raw, np.int32, 1)[0]), 4).tolist()
    at = 4 + 4 * len(sizes)
    cut = at + sum(n * plain for n in sizes for _, plain in columns)
    high, place, out = zstandard.ZstdDecompressor().decompress(raw[cut:]), 0, []
    for n in sizes:
        row = []
        for width, plain in columns:
            x = unplaned(raw, n, plain, at) | (unplaned(high, n, width - plain, place) << _U(8 * plain))
            at, place = at + n * plain, place + n * (width - plain)
            row.append(x.view(np.int64))
        out.append(row)
    return out


def _questions(order: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.arange(1, 1 << bits, dtype=np.uint64) << _U(64 - bits)
        for batch in batches:
            for row in batch.to_pylist():
                b = Block(row, fold=True)
                each = []
                for n in range(1, order + 1):
                    g = Grams(b, n)
                    cuts = np.concatenate([[0], np.searchsorted(g.distinct, edges), [len(g.distinct)]])
                    each.append(((g.distinct << _U(bits)) >> _U(64 - KEY_BITS), np.bincount(g.number, minlength=len(g.distinct)), cuts))
                bodies = []
                for i in range(1 << bits):
                    parts = [(np.diff(k[c[i] : c[i + 1]], prepend=_U(0)), m[c[i] : c[i + 1]]) for k, m, c in each]
                    bodies.append(_pack(parts, _ASK))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(1 << bits, dtype=np.int32)), pa.array(np.full(1 << bits, row["block"])), pa.array(bodies, pa.binary())], ["bucket", "block", "body"]
                )

    return run


def _totals(t: pa.Table) -> pa.Table:
    """Adds up the counts of one bucket; every block gets the totals in the order of its question."""
    asked = [_unpack(x, _ASK) for x in t.column("body").to_pylist()]
    answers: list[list[tuple[np.ndarray]]] = [[] for _ in asked]
    for n in range(len(asked[0])):
        key = np.concatenate([np.cumsum(x[n][0]) for x in asked])
        count = np.concatenate([x[n][1] for x in asked])
        size = np.array([len(x[n][0]) for x in asked])
        total = np.zeros(len(key), np.int64)
        if len(key):
            by = np.argsort(key, kind="stable")
            first = np.flatnonzero(np.r_[True, key[by][1:] != key[by][:-1]])
            total[by] = np.repeat(np.add.reduceat(count[by], first), np.diff(np.r_[first, len(key)]))
        for a, x in zip(answers, np.split(total, np.cumsum(size)[:-1]), strict=True):
            a.append((x,))
    return pa.table({"bucket": t.column("bucket"), "block": t.column("block"), "body": pa.array([_pack(a, _TELL) for a in answers], pa.binary())})


def _scores(order: int, backoff: float, n_corpus: int):
    names = ["id", "n_words", "log_score", *[f"n_order{n}" for n in range(order, -1, -1)]]

    def run(texts: pa.Table, told: pa.Table) -> pa.Table:
        if not texts.num_rows:
            raise ValueError("an answer without its block")
        b = Block(texts.to_pylist()[0], fold=True)
        told = told.sort_by("bucket")
        answers = [_unpack(x, _TELL) for x in told.column("body").to_pylist()]
        size, docs = len(b.hash), len(b.ids)
        # what the rest of the corpus has of the n-gram that starts at each place
        rest = []
        for n in range(1, order + 1):
            g = Grams(b, n)
            total = np.concatenate([np.zeros(0, np.int64), *[x[n - 1][0] for x in answers]])
            r = np.zeros(size + 1, np.int64)
            r[g.at] = total[g.number] - g.own()
            rest.append(r)
        others = np.maximum(n_corpus - b.count, 1)[np.repeat(np.arange(docs), b.count)]
        place = np.arange(size)
        depth = place - np.repeat(b.first[:-1], b.count)  # words of context there are
        score, level = np.zeros(size), np.full(size, -1)
        for n in range(order, 0, -1):
            usable = (level < 0) & (depth >= n - 1)
            at = place[usable]
            seen = rest[n - 1][at - n + 1]
            hit = at[seen > 0]
            below = others[hit] if n == 1 else rest[n - 2][hit - n + 1]
            score[hit] = seen[seen > 0] / below
            level[hit] = n
        longest = np.minimum(depth + 1, order)
        score[level < 0] = backoff / others[level < 0]
        level[level < 0] = 0
        given_up = longest - np.maximum(level, 1)
        logs = np.log(score) + given_up * np.log(backoff)
        doc = np.repeat(np.arange(docs), b.count)
        columns = [pa.array(b.ids, pa.int64()), pa.array(b.count), pa.array(np.bincount(doc, logs, docs))]
        columns += [pa.array(np.bincount(doc, level == n, docs).astype(np.int64)) for n in range(order, -1, -1)]
        return pa.table(columns, names=names)

    return run


def score(df: DataFrame, key: str = "doc_id", text: str = "text", order: int = ORDER, backoff: float = BACKOFF) -> DataFrame:
    """One row per row of ``df``: ``id``, ``n_words``, ``log_score`` (sum of natural logs), and ``n_order3`` … ``n_order0``.

    Words are separated by ASCII white space, with A-Z lower-cased. ``n_orderK`` counts the words that were
    scored with K-grams; ``n_order0`` are words that occur in no other row. A null or empty text has no
    words and the score 0. Rows with a null id are scored and counted like others; repeated rows count for
    one another. An empty table gives no rows. Other columns are not read.
    """
    spark = df.sparkSession
    bits = _bucket_bits(spark)
    texts = stored(text_blocks(df, key, text, BLOCK_BYTES), "lm-blocks")
    told = texts.mapInArrow(_questions(order, bits), _MESSAGE).groupBy("bucket").applyInArrow(_totals, _MESSAGE)
    n_corpus = texts.select(F.sum("n_words")).first()[0] or 0
    schema = "id long, n_words long, log_score double, " + ", ".join(f"n_order{n} long" for n in range(order, -1, -1))
    return texts.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_scores(order, backoff, n_corpus), schema)
