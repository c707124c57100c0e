"""Benchmark passages in documents: a prefix-filtered join of shingle sets, verified word by word.

Each benchmark item gives its windows (13 words; a shorter item is one window). A window is seen as the
set of its 5-word shingles, and full containment needs every one of them, so a prefix of one shingle is
necessary and enough: the rarest one, by a count over all documents. Documents are probed only at the
places of such prefix shingles. A hit fixes where the window would have to start; the window must lie
within the document (position) and the document must be long enough (length); then its words are
compared one by one.

The index is built from the benchmark in blocks of at most ``BLOCK_WINDOWS`` windows. Only one block is
sent to the executors at a time, so what a task holds is bounded whatever the size of the benchmark;
further blocks are further passes over the documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenfield.llm.batches import annotate, blocks
from lumenfield.llm.words import ALNUM, grams, inside, split

WINDOW, SHINGLE = 13, 5
BLOCK_WINDOWS = 200_000
KIND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("hits", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)
_HITS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def windows(benchmark: DataFrame, item: str = "item_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """Distinct windows with the items that hold them: ``words`` (folded, one blank between), ``n``, ``items``."""
    fold = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    words = F.array_remove(F.split(F.translate(F.col(f"`{text}`"), fold, fold.lower()), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")
    rows = benchmark.select(F.col(f"`{item}`").cast("string").alias("item"), words.alias("w")).where(F.size("w") > 0)
    rows = rows.withColumn("i", F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - size, F.lit(0)))))
    rows = rows.select("item", F.slice("w", F.col("i") + 1, size).alias("w"))
    rows = rows.select("item", F.array_join("w", " ").alias("words"), F.size("w").alias("n")).distinct()
    return rows.groupBy("words", "n").agg(F.collect_set("item").alias("items"))


class Table:
    """Membership of 64-bit values in a small sorted set, with a bitmap in front."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.unique(keys)
        bits = max(16, int(len(self.keys)).bit_length() + 4)
        self.mask = np.uint64((1 << bits) - 1)
        self.flag = np.zeros(1 << bits, bool)
        self.flag[(self.keys & self.mask).astype(np.int64)] = True

    def find(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of ``values`` that are in the set, and their numbers in it."""
        at = np.flatnonzero(self.flag[(values & self.mask).astype(np.int64)])
        number = np.minimum(np.searchsorted(self.keys, values[at]), max(len(self.keys) - 1, 0))
        same = self.keys[number] == values[at] if len(self.keys) else np.zeros(0, bool)
        return at[same], number[same]


def _shingle_sets(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each shingle of each window: window, place, width, hash."""
    w = split(pa.array(texts, pa.string()), ALNUM)
    out = [], [], [], []
    width = np.minimum(w.count, SHINGLE)
    for k in np.unique(width).tolist():
        g, at = grams(w.hash, k), inside(w, k)
        doc = w.doc[at]
        mine = width[doc] == k
        for x, v in zip(out, (doc[mine], (at - w.first[doc])[mine], np.full(int(mine.sum()), k), g[at[mine]]), strict=True):
            x.append(v)
    return tuple(np.concatenate([np.zeros(0, np.int64), *x]) if i < 3 else np.concatenate([np.zeros(0, np.uint64), *x]) for i, x in enumerate(out))


def shingle_counts(df: DataFrame, text: str, tables: dict[int, Table]) -> dict[tuple[int, int], int]:
    """How often each wanted shingle occurs in all documents; one row for each wanted shingle comes back."""
    shared = df.sparkSession.sparkContext.broadcast(tables)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = {k: np.zeros(len(t.keys), np.int64) for k, t in shared.value.items()}
        for batch in batches:
            for b in blocks(batch, "text"):
                w = split(b.column("text"), ALNUM, fold=True)
                for k, t in shared.value.items():
                    at = inside(w, k)
                    count[k] += np.bincount(t.find(grams(w.hash, k)[at])[1], minlength=len(t.keys))
        for k, c in count.items():
            i = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), k)), pa.array(i), pa.array(c[i])], ["k", "i", "n"])

    rows = df.select(F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(run, "k long, i long, n long")
    found = {(r.k, r.i): r.n for r in rows.groupBy("k", "i").agg(F.sum("n").alias("n")).toLocalIterator()}
    shared.unpersist()
    return found


class PrefixIndex:
    """Windows of one block by their rarest shingle."""

    def __init__(self, rows: list[tuple[str, list[str]]], count):
        self.words = [r[0].encode().split(b" ") for r in rows]
        self.items = [sorted(r[1]) for r in rows]
        self.size = np.array([len(w) for w in self.words], np.int64)
        doc, place, width, value = _shingle_sets([r[0] for r in rows])
        tables = {k: Table(value[width == k]) for k in np.unique(width).tolist()}
        often = count(tables)
        seen = np.zeros(len(doc), np.int64)
        for k, t in tables.items():
            mine = np.flatnonzero(width == k)
            n = np.array([often.get((k, i), 0) for i in range(len(t.keys))], np.int64)
            seen[mine] = n[t.find(value[mine])[1]]
        order = np.lexsort((place, value, seen, doc))
        rarest = order[np.unique(doc[order], return_index=True)[1]]
        self.tables, self.lists = {}, {}
        for k in tables:
            r = rarest[width[rarest] == k]
            t = Table(value[r])
            number = np.searchsorted(t.keys, value[r])
            by = np.argsort(number, kind="stable")
            self.tables[k] = t
            self.lists[k] = (np.searchsorted(number[by], np.arange(len(t.keys) + 1)), doc[r[by]], place[r[by]])

    def occurrences(self, texts: pa.Array):
        """Words of the texts; start and window of every occurrence of a window."""
        w = split(texts, ALNUM, fold=True)
        starts, found = [], []
        for k, t in self.tables.items():
            at = inside(w, k)
            hit, number = t.find(grams(w.hash, k)[at])
            first, window, place = self.lists[k]
            many = first[number + 1] - first[number]
            j = np.repeat(first[number], many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
            hit = np.repeat(at[hit], many)
            doc = np.searchsorted(w.first, hit, side="right") - 1
            start, size = hit - place[j], self.size[window[j]]
            fits = (start >= w.first[doc]) & (start + size <= w.first[doc + 1])
            starts += start[fits].tolist()
            found += window[j[fits]].tolist()
        good = [i for i, (s, f) in enumerate(zip(starts, found, strict=True)) if all(w.word(s + n) == x for n, x in enumerate(self.words[f]))]
        return w, np.array([starts[i] for i in good], np.int64), np.array([found[i] for i in good], np.int64)


def _merged(start: np.ndarray, end: np.ndarray) -> list[dict[str, int]]:
    """Union of half-open ranges."""
    out: list[dict[str, int]] = []
    for a, b in sorted(zip(start.tolist(), end.tolist(), strict=True)):
        if out and a <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], b)
        else:
            out.append({"start": a, "end": b})
    return out


def find(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    out: str = "contamination",
    carry: list[str] | None = None,
    block_windows: int = BLOCK_WINDOWS,
) -> DataFrame:
    """Adds ``out``: number of words, merged word ranges that lie in a benchmark window, and the items found.

    Words are runs of a-z, 0-9 and everything beyond ASCII, after lower-casing A-Z. A null or empty text has
    no words and no hits; an item without words is never found; items without an id hit words but are not
    listed; repeated items count once. An empty benchmark leaves all documents clean. Rows are independent,
    other columns pass through, an existing column ``out`` is replaced.
    """
    made = windows(benchmark, item, item_text).withColumn("h", F.xxhash64("words"))
    made.persist()
    n_blocks = max(1, -(-made.count() // block_windows))
    keep = [c for c in (docs.columns if carry is None else carry) if c not in (out, text)]
    with_text = carry is None or text in carry
    result = docs.withColumn(out, F.lit(None).cast(KIND)) if n_blocks > 1 else docs
    for b in range(n_blocks):
        mine = made.where(F.pmod("h", F.lit(n_blocks)) == b).orderBy("words") if n_blocks > 1 else made.orderBy("words")
        rows = [(r.words, r["items"]) for r in mine.toLocalIterator()]
        index = PrefixIndex(rows, lambda tables: shingle_counts(docs, text, tables)) if rows else None
        more = b + 1 < n_blocks
        fields = [*keep, *([text] if with_text or more else [])]
        result = _pass(result, text, out, docs.sparkSession.sparkContext.broadcast(index), fields, b > 0)
    made.unpersist()
    return result


def _pass(df: DataFrame, text: str, out: str, index, fields: list[str], merge: bool) -> DataFrame:
    """One block of the index over all documents; ``merge`` joins its findings to those of earlier blocks."""
    before = "_earlier"
    while before in df.columns:
        before += "_"
    source = df.withColumnRenamed(out, before) if merge else df

    def run(texts: pa.Array) -> pa.Array:
        if index.value is None:
            w = split(texts, ALNUM, fold=True)
            start = found = np.zeros(0, np.int64)
        else:
            w, start, found = index.value.occurrences(texts)
        doc = np.searchsorted(w.first, start, side="right") - 1
        hits: list[list] = [[] for _ in range(len(texts))]
        items: list[list[str]] = [[] for _ in range(len(texts))]
        for d in np.unique(doc).tolist():
            mine = doc == d
            s = start[mine] - w.first[d]
            hits[d] = _merged(s, s + index.value.size[found[mine]])
            items[d] = sorted({x for f in np.unique(found[mine]).tolist() for x in index.value.items[f]})
        return pa.StructArray.from_arrays([pa.array(w.count), pa.array(hits, _HITS), pa.array(items, pa.list_(pa.string()))], ["n_words", "hits", "items"])

    done = annotate(source, text, out, KIND, run, [*fields, *([before] if merge else [])])
    if not merge:
        return done
    ranges = F.array_sort(F.concat(f"{before}.hits", f"{out}.hits"))
    joined = F.aggregate(
        ranges,
        F.array().cast(KIND["hits"].dataType),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= x["start"]),
            F.concat(
                F.slice(acc, 1, F.size(acc) - 1),
                F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], x["end"]).alias("end"))),
            ),
        ).otherwise(F.concat(acc, F.array(x))),
    )
    items = F.array_sort(F.array_union(f"{before}.items", f"{out}.items"))
    return done.withColumn(out, F.struct(F.col(f"{out}.n_words").alias("n_words"), joined.alias("hits"), items.alias("items"))).drop(before)


def n_hit(hits) -> Column:
    """Number of words in merged ranges."""
    return F.aggregate(hits, F.lit(0).cast("long"), lambda acc, x: acc + (x["end"] - x["start"]).cast("long"))


def contaminated(found: str = "contamination") -> Column:
    """The rule of the contract: some word is hit, and at least one word in twenty."""
    n = n_hit(F.col(f"{found}.hits"))
    return (n > 0) & (20 * n >= F.col(f"{found}.n_words"))

