"""Token-id files with keyed access: raw id payloads in shards, found through a minimal perfect hash.

A shard is one row of a Parquet table, so that any store Spark reaches can hold it and a lost task is
simply written again. ``payload`` holds the raw little-endian ids of consecutive documents. ``index`` maps
a document key to a slot without collisions and without storing the key, in the leveled way: each level
is a bit array in which a bit is set where exactly one remaining key falls; colliding keys go on to the
next level; the number of set bits before a key's bit is its slot. A slot holds a fingerprint of its key,
and the offset and length of its ids. One lookup touches a few bits and one slot, whatever the number of
documents.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenfield.llm.batches import blocks, text_bytes
from lumenfield.llm.words import ALNUM, mix, split_bytes, split_pieces

#: ids and documents after which a shard is closed
SHARD_IDS, SHARD_DOCS = 1 << 20, 1 << 16
CACHE = 3_000_000
LOOKUP_KEYS = 1000
_SHARD = (
    "part int, shard int, local_start long, n_ids long, n_docs int, first_key long, last_key long,"
    " n_null int, width int, keys binary, index binary, payload binary"
)
_U = np.uint64


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys, with room of ``spread`` bits a key on each level."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray, rank: np.ndarray):
        self.sizes, self.bits, self.rank = sizes, bits, rank

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys ^ mix(np.array([level + 1], np.uint64))) % _U(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray, spread: float = 2.0) -> PerfectHash:
        sizes, levels, rest = [], [], keys
        while len(rest):
            size = max(64, -(-int(spread * len(rest)) // 64) * 64)
            at = cls._place(rest, len(sizes), size)
            hits = np.bincount(at, minlength=size)
            levels.append(hits == 1)
            rest = rest[hits[at] > 1]
            sizes.append(size)
        flags = np.concatenate([np.zeros(0, bool), *levels])
        bits = np.packbits(flags, bitorder="little").view(np.uint64)
        rank = np.cumsum(np.bitwise_count(bits), dtype=np.int64) - np.bitwise_count(bits)
        return cls(np.array(sizes, np.int64), bits, rank.astype(np.uint32))

    def slot(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key; of an unknown key some slot or -1."""
        out, open_, base = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes.tolist()):
            at = base + self._place(keys[open_], level, size)
            word, bit = self.bits[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & _U(1) == 1
            below = np.bitwise_count(word & ((_U(1) << bit) - _U(1)))
            out[open_[hit]] = (self.rank[at >> 6] + below)[hit]
            open_, base = open_[~hit], base + size
        return out


def _key_hash(keys: np.ndarray, nulls: int = 0) -> np.ndarray:
    """Repeated keys are told apart by their number within the run of equal keys; null keys come first."""
    keys = keys.astype(np.int64)
    run = np.concatenate([np.arange(nulls), np.arange(len(keys)) - np.searchsorted(keys, keys)]).astype(np.uint64)
    of_key = np.concatenate([np.full(nulls, 0x6E756C6C6B657973, np.uint64), mix(keys.view(np.uint64))])
    return of_key ^ (run * _U(0xD6E8FEB86659FD93))


def _fingerprint(hashes: np.ndarray) -> np.ndarray:
    return (mix(hashes ^ _U(0xA5A5A5A5A5A5A5A5)) >> _U(32)).astype(np.uint32)


def write_index(h: np.ndarray, offset: np.ndarray, length: np.ndarray) -> bytes:
    """``h`` from ``_key_hash``; offsets and lengths count ids within the shard."""
    table = PerfectHash.build(h)
    slot = table.slot(h)
    cells = np.zeros(len(h), [("print", "<u4"), ("offset", "<u4"), ("length", "<u4")])
    cells["print"][slot], cells["offset"][slot], cells["length"][slot] = _fingerprint(h), offset, length
    head = np.array([len(h), len(table.sizes), len(table.bits)], "<i8")
    return b"".join(x.tobytes() for x in (head, table.sizes.astype("<i8"), table.bits.astype("<u8"), table.rank.astype("<u4"), cells))


class Index:
    def __init__(self, raw: bytes):
        n, levels, words = np.frombuffer(raw, "<i8", 3).tolist()
        at = 24
        sizes = np.frombuffer(raw, "<i8", levels, at)
        bits = np.frombuffer(raw, "<u8", words, at := at + 8 * levels)
        rank = np.frombuffer(raw, "<u4", words, at := at + 8 * words)
        self.cells = np.frombuffer(raw, [("print", "<u4"), ("offset", "<u4"), ("length", "<u4")], n, at + 4 * words)
        self.table = PerfectHash(sizes, bits, rank)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether each key is there, and the offset and length of its ids."""
        slot = self.table.slot(hashes)
        if not len(self.cells):
            return np.zeros(len(hashes), bool), slot, slot
        cell = self.cells[slot]
        return (slot >= 0) & (cell["print"] == _fingerprint(hashes)), cell["offset"].astype(np.int64), cell["length"].astype(np.int64)


class WordEncoder:
    """Ids of whole texts through the tokenizers library, asked once for each distinct piece.

    For vocabularies that lower-case, whose words never hold white space, and that mark word ends with
    ``</w>``. There a text can be cut at white space without changing a token, full stops and commas can be
    cut off behind an ASCII letter or digit, and A-Z can be lower-cased first unless a combining mark
    follows. Pieces are found and looked up for many texts at once by 64-bit hashes. Texts with combining
    marks or the start of a special token go to the library as they are. The table of known pieces is
    bounded.
    """

    def __init__(self, path: str, end: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        top = max(end, *vocabulary.values())
        self.kind = np.dtype("<u2" if top < 1 << 16 else "<u4")
        self.end = np.array([end], self.kind).tobytes()
        #: whether an id ends a word
        self.last = np.zeros(top + 1, bool)
        self.last[[i for word, i in vocabulary.items() if word.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        self.hash, self.row = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.size, self.ids = np.zeros(0, np.int64), np.zeros(0, self.kind)

    def encode(self, texts: pa.Array) -> list[bytes]:
        data, offsets = text_bytes(texts)
        odd = (data == 0xCC) | (data == 0xCD)
        odd[:-1] |= (data[:-1] == ord("<")) & (data[1:] == ord("|"))
        apart = np.zeros(len(texts), bool)
        apart[np.searchsorted(offsets, np.flatnonzero(odd), side="right") - 1] = True
        if apart.any():
            out = [b""] * len(texts)
            rest = np.flatnonzero(~apart)
            for i, x in zip(rest.tolist(), self.encode(texts.take(pa.array(rest))), strict=True):
                out[i] = x
            for i in np.flatnonzero(apart).tolist():
                out[i] = np.array(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, self.kind).tobytes() + self.end
            return out
        w = split_bytes(data, offsets, fold=True)
        start, stop = w.start, w.end
        mark = (w.data == ord(".")) | (w.data == ord(","))
        core = np.maximum.accumulate(np.where(mark, -1, np.arange(len(data))))[stop - 1] + 1 if len(stop) else stop
        letter = ALNUM[w.data] & (w.data < 0x80)
        cut = np.flatnonzero((core > start) & (core < stop) & letter[core - 1])
        cuts = np.sort(np.concatenate([start, core[cut]]))
        ends = np.sort(np.concatenate([stop, core[cut]]))
        pieces = split_pieces(w.data, cuts, ends)
        distinct, where, back = np.unique(pieces, return_index=True, return_inverse=True)
        row = self._rows(distinct, lambda new: [w.data[a:b].tobytes().decode() for a, b in zip(cuts[where[new]].tolist(), ends[where[new]].tolist(), strict=True)])
        first = np.cumsum(self.size) - self.size
        row = row[back]
        size = self.size[row]
        total = np.cumsum(size)
        at = np.arange(int(total[-1]) if len(total) else 0) + np.repeat(first[row] - (total - size), size)
        raw = self.ids[at].tobytes()
        bounds = np.concatenate([[0], total])[np.searchsorted(cuts, offsets)] * self.kind.itemsize
        return [raw[a:b] + self.end for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]

    def _rows(self, hashes: np.ndarray, texts) -> np.ndarray:
        """Rows of known pieces; unknown ones are encoded and added."""
        if len(self.hash) > CACHE:
            self._forget()
        at = np.searchsorted(self.hash, hashes)
        known = at < len(self.hash)
        known[known] = self.hash[at[known]] == hashes[known]
        new = np.flatnonzero(~known)
        if len(new):
            made = self._learn(texts(new))
            size = np.array([len(x) for x in made]) // self.kind.itemsize
            row = len(self.size) + np.arange(len(new))
            self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(made), self.kind)])
            self.size = np.concatenate([self.size, size])
            self.hash, self.row = np.insert(self.hash, at[new], hashes[new]), np.insert(self.row, at[new], row)
            at = np.searchsorted(self.hash, hashes)
        return self.row[at]

    def _learn(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece. Pieces of letters alone are asked for together and told apart by the word ends."""
        out = [b""] * len(pieces)
        letters, rest = [], []
        for i, w in enumerate(pieces):
            (letters if w.isalpha() else rest).append(i)
        width = self.kind.itemsize
        for a in range(0, len(letters), 1000):
            group = letters[a : a + 1000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join([pieces[i] for i in group])], add_special_tokens=False)[0].ids, self.kind)
            stop = ((np.flatnonzero(self.last[ids]) + 1) * width).tolist()
            if len(stop) == len(group):  # each has one word end at least, so each has just one
                raw, x = ids.tobytes(), 0
                for i, y in zip(group, stop, strict=True):
                    out[i] = raw[x:y]
                    x = y
            else:
                rest += group
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([pieces[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = np.array(e.ids, self.kind).tobytes()
        return out


@lru_cache(maxsize=2)
def word_encoder(path: str, end: int) -> WordEncoder:
    return WordEncoder(path, end)


def write(df: DataFrame, path: str, folder: str, key: str = "doc_id", text: str = "text", end: int = 1) -> None:
    """Write the ids of every text, each closed by ``end``, in ascending key order to shards below ``folder``.

    Rows are dealt by ranges of the key, and among equal keys by a hash of the text, so that no range is
    larger than its share; each task encodes its sorted rows and closes a shard at ``SHARD_IDS`` ids. Repeated
    keys keep all their rows. Null keys come first and cannot be looked up. A null or empty text has only
    the end id. An empty table writes no shard. Other columns are not read.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(F.col(f"`{key}`").cast("long").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange(n, "key", "tie").sortWithinPartitions("key", "tie")
    rows = rows.select(F.spark_partition_id().alias("part"), "key", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = word_encoder(path, end)
        part = shard = start = 0
        keys: list = []
        ids: list[bytes] = []
        held = 0

        def close() -> pa.RecordBatch:
            nonlocal shard, start, keys, ids, held
            known = np.array([k for k in keys if k is not None], np.int64)
            null = len(keys) - len(known)
            length = np.array([len(x) for x in ids], np.int64) // e.kind.itemsize
            offset = np.cumsum(length) - length
            row = {
                "part": part, "shard": shard, "local_start": start, "n_ids": int(length.sum()), "n_docs": len(keys),
                "first_key": int(known[0]) if len(known) else None, "last_key": int(known[-1]) if len(known) else None,
                "n_null": null, "width": e.kind.itemsize, "keys": known.astype("<i8").tobytes(),
                "index": write_index(_key_hash(known, null), offset, length), "payload": b"".join(ids),
            }
            shard, start, keys, ids, held = shard + 1, start + row["n_ids"], [], [], 0
            return pa.RecordBatch.from_pylist([row], schema)

        for batch in batches:
            for b in blocks(batch, "text"):
                part = b.column("part")[0].as_py()
                for k, x in zip(b.column("key").to_pylist(), e.encode(b.column("text")), strict=True):
                    keys.append(k)
                    ids.append(x)
                    held += len(x) // e.kind.itemsize
                    if held >= SHARD_IDS or len(keys) >= SHARD_DOCS:
                        yield close()
        if keys:
            yield close()

    schema = pa.schema(
        [pa.field(*f) for f in (("part", pa.int32()), ("shard", pa.int32()), ("local_start", pa.int64()), ("n_ids", pa.int64()), ("n_docs", pa.int32()), ("first_key", pa.int64()), ("last_key", pa.int64()), ("n_null", pa.int32()), ("width", pa.int32()), ("keys", pa.binary()), ("index", pa.binary()), ("payload", pa.binary()))]
    )
    rows.mapInArrow(run, _SHARD).write.mode("overwrite").parquet(f"{folder}/shards")
    # a running total over the ranges: one row for each range, of which the session fixes the number
    total = spark.read.parquet(f"{folder}/shards").groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    total.select("part", F.coalesce(before, F.lit(0)).alias("base")).coalesce(1).write.mode("overwrite").parquet(f"{folder}/ranges")


def _shards(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/shards").join(spark.read.parquet(f"{folder}/ranges"), "part")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Every stored document through the index: key, global start, number of ids, ids as little-endian 32-bit bytes.

    Raises if a key's slot does not hold its fingerprint.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys, null = np.frombuffer(row["keys"], "<i8"), row["n_null"]
                found, offset, length = Index(row["index"]).find(_key_hash(keys, null))
                if not found.all():
                    raise ValueError(f"shard {row['part']}/{row['shard']}: a key is missing from its index")
                ids = np.frombuffer(row["payload"], f"<u{row['width']}")
                names = pa.concat_arrays([pa.nulls(null, pa.int64()), pa.array(keys, pa.int64())])
                for i in range(0, len(names), 256):
                    o, n = offset[i : i + 256], length[i : i + 256]
                    raw = [ids[a : a + b].astype("<u4").tobytes() for a, b in zip(o.tolist(), n.tolist(), strict=True)]
                    start = row["base"] + row["local_start"] + o
                    yield pa.RecordBatch.from_arrays([names[i : i + 256], pa.array(start), pa.array(n), pa.array(raw, pa.binary())], ["key", "start", "n_tokens", "raw"])

    cols = ("part", "shard", "local_start", "base", "n_null", "width", "keys", "index", "payload")
    return _shards(spark, folder).select(*cols).mapInArrow(run, "key long, start long, n_tokens long, raw binary")


def lookup(spark: SparkSession, folder: str, keys: list[int]) -> DataFrame:
    """The ids of a few documents by key (first row of a repeated key); absent keys give no row.

    Only shards whose key range holds a wanted key are read; inside one a key costs one probe. More than
    ``LOOKUP_KEYS`` keys are refused: read the table and join instead.
    """
    if len(keys) > LOOKUP_KEYS:
        raise ValueError(f"{len(keys)} keys; at most {LOOKUP_KEYS} at once")
    wanted = F.lit(False)
    for k in keys:
        wanted = wanted | ((F.col("first_key") <= k) & (F.col("last_key") >= k))
    sought = np.array(sorted(set(keys)), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                found, offset, length = Index(row["index"]).find(_key_hash(sought))
                ids = np.frombuffer(row["payload"], f"<u{row['width']}")
                for k, o, n in zip(sought[found].tolist(), offset[found].tolist(), length[found].tolist(), strict=True):
                    if row["first_key"] <= k <= row["last_key"]:
                        yield pa.RecordBatch.from_pylist([{"key": k, "part": row["part"], "shard": row["shard"], "ids": ids[o : o + n].tolist()}], schema)

    schema = pa.schema([("key", pa.int64()), ("part", pa.int32()), ("shard", pa.int32()), ("ids", pa.list_(pa.int32()))])
    cols = ("part", "shard", "first_key", "last_key", "width", "index", "payload")
    found = spark.read.parquet(f"{folder}/shards").where(wanted).select(*cols).mapInArrow(run, "key long, part int, shard int, ids array<int>")
    # a run of equal keys may go on in the next shard; its first row is the one in the earliest shard
    return found.groupBy("key").agg(F.min_by("ids", F.struct("part", "shard")).alias("ids"))
