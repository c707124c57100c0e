"""Near duplicates by minhash with tensored tables, every link confirmed on full shingle sets.

``COLLECTIONS`` collections of ``WIDTH`` minhashes are computed once a text. A table key is the pair of two
collections, so 16 collections of two hashes serve 120 tables of four, at 32 minhashes instead of 480. Two
texts meet if any two collections agree; at a similarity of 0.75 that fails once in 25 000 pairs, at 0.8
once in 500 000.

The work never grows with the square of a group:

* texts with the same shingle set are one class, named by its smallest id;
* a collection value that only one class holds can be in no shared key, so most classes leave before any
  key is formed;
* inside a key, every class is compared only with the one that meets most others, the likely original of a
  group of copies. Most groups are connected by this.
  Classes of one key that are still in different components meet once more by an exact prefix join of
  their sets, rarest shingles first, in bands of sizes that the place of the meeting allows. So no link between unconnected texts is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenfield.llm.batches import annotate
from lumenfield.llm.rows import stored
from lumenfield.llm.words import SPACES, grams, inside, mix, pair, split

SHINGLE, PERCENT = 5, 75
COLLECTIONS, WIDTH = 16, 2
PARITY = 16
#: bands of set sizes in a doubling; sets of one band and shingle that one task compares with
BANDS, SPLIT = 8, 2000
_U = np.uint64
_RNG = np.random.Generator(np.random.PCG64(75))
_XOR = _RNG.integers(0, 2**63, COLLECTIONS * WIDTH, dtype=np.uint64)
_MUL = _RNG.integers(0, 2**62, COLLECTIONS * WIDTH, dtype=np.uint64) * _U(2) + _U(1)
FACTS = T.StructType(
    [
        T.StructField("n", T.LongType()),
        T.StructField("d1", T.LongType()),
        T.StructField("d2", T.LongType()),
        T.StructField("c", T.ArrayType(T.LongType())),
    ]
)
SETS = T.StructType([T.StructField("set", T.BinaryType())])


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, and the n + 1 places where each text's begin."""
    w = split(texts, SPACES, fold=True)
    parts = [(w.doc[at := inside(w, SHINGLE)], grams(w.hash, SHINGLE)[at])]
    for n in range(1, SHINGLE):  # a shorter text is one shingle
        at = inside(w, n)
        at = at[w.count[w.doc[at]] == n]
        parts.append((w.doc[at], mix(grams(w.hash, n)[at] + _U(n))))
    doc, h = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    doc, h = doc[new], h[new]
    return h, np.searchsorted(doc, np.arange(len(texts) + 1))


def _facts(texts: pa.Array) -> pa.Array:
    h, first = shingle_sets(texts)
    n = np.diff(first)
    full = np.flatnonzero(n)
    starts = first[:-1][full]
    d = np.zeros((2, len(n)), np.int64)
    hashes = np.zeros((len(n), COLLECTIONS * WIDTH), np.uint32)
    if len(full):
        d[0, full] = np.add.reduceat(mix(h), starts).view(np.int64)
        d[1, full] = np.add.reduceat(mix(h ^ _U(0x5851F42D4C957F2D)), starts).view(np.int64)
        for i in range(COLLECTIONS * WIDTH):
            hashes[full, i] = np.minimum.reduceat(((h ^ _XOR[i]) * _MUL[i]) >> _U(32), starts)
    c = hashes[:, ::WIDTH].astype(np.uint64)
    for i in range(1, WIDTH):
        c = pair(c, hashes[:, i::WIDTH].astype(np.uint64))
    at = pa.array(np.arange(len(n) + 1, dtype=np.int32) * COLLECTIONS)
    lists = pa.ListArray.from_arrays(at, pa.array(c.view(np.int64).ravel()))
    return pa.StructArray.from_arrays([pa.array(n), pa.array(d[0]), pa.array(d[1]), lists], ["n", "d1", "d2", "c"])


def _sets(texts: pa.Array) -> pa.Array:
    h, first = shingle_sets(texts)
    return pa.StructArray.from_arrays([pa.array([h[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)], pa.binary())], ["set"])


@F.pandas_udf(T.LongType())
def _common(a: pd.Series, b: pd.Series) -> pd.Series:
    """Size of the intersection of two sorted sets of 64-bit values."""
    return pd.Series([len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), True)) for x, y in zip(a, b, strict=True)], dtype="int64")


@F.pandas_udf(T.ArrayType(T.LongType()))
def _parity(sets: pd.Series) -> pd.Series:
    """Parities of the number of shingles in each of 1024 parts of the hash space."""
    out = []
    for x in sets:
        odd = np.bincount((np.frombuffer(x, np.uint64) >> _U(54)).astype(np.int64), minlength=64 * PARITY) & 1
        out.append(np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64))
    return pd.Series(out)


def links(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    one, two = sets.toDF("a", "set_a"), sets.toDF("b", "set_b")
    both = pairs.join(one, "a").join(two, "b")
    common = both.select("a", "b", (F.length("set_a") / 8).cast("long").alias("n"), (F.length("set_b") / 8).cast("long").alias("m"), _common("set_a", "set_b").alias("same"))
    return common.where(100 * F.col("same") >= percent * (F.col("n") + F.col("m") - F.col("same"))).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """Nodes of the edges (a, b) with the smallest node they can reach: smallest neighbour, then label of the label."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = stored(both, "near-edges")
    labels = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "node"), "near-labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("least"))
        step = labels.join(near, labels["node"] == near["a"]).select("node", F.col("label").alias("old"), F.least("label", "least").alias("label"))
        over = labels.select(F.col("node").alias("at"), F.col("label").alias("far"))
        step = step.join(over, F.col("label") == F.col("at")).select("node", "old", F.least("label", "far").alias("label"))
        step = stored(step, "near-labels")
        labels = step.select("node", "label")
        if step.where("label <> old").isEmpty():
            return labels


def _table_keys(live: DataFrame) -> DataFrame:
    """Keys (pairs of live collections) of each class."""
    places = list(combinations(range(COLLECTIONS), 2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right = np.array(places, np.int64).T
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                b = batch.slice(at, 2000)
                ids = b.column("id").to_numpy()
                c = np.frombuffer(b.column("c").flatten().cast(pa.int64()).to_numpy(zero_copy_only=False), np.uint64).reshape(len(ids), COLLECTIONS)
                on = b.column("on").to_numpy()
                flag = (on[:, None] >> np.arange(COLLECTIONS)) & 1 == 1
                row, table = np.nonzero(flag[:, left] & flag[:, right])
                key = pair(pair(c[row, left[table]], c[row, right[table]]), table.astype(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(ids[row]), b.column("pull").take(pa.array(row))], ["key", "id", "pull"])

    return live.select("id", "on", "c", "pull").mapInArrow(run, "key long, id long, pull long")


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: key, ``n_shingles``, ``component_id`` (smallest key that links lead to), ``kept``.

    Texts without words, empty or null, have no shingles and are linked with nothing. Rows with a null key
    are not linked either; they are kept, with a null component. Repeated rows are copies of one another.
    Rows that share a key but not a text are nodes of one name: the links of each are links of the key. An
    empty table gives no rows. Other columns are not read.
    """
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    facts = annotate(rows, "text", "f", FACTS, _facts, ["id"]).select("id", "f.*")
    facts = stored(facts, "near-facts")
    filled = facts.where("n > 0 and id is not null")
    # copies: texts with the same set, by two independent 64-bit sums and the size
    classes = stored(filled.groupBy("n", "d1", "d2").agg(F.min("id").alias("class"), F.count(F.lit(1)).alias("copies")), "near-classes")
    first = filled.groupBy("id", "n", "d1", "d2").agg(F.first("c").alias("c"))
    heads = first.join(classes.select("n", "d1", "d2", F.col("class").alias("id")), ["n", "d1", "d2", "id"]).select("id", "n", "c")
    heads = stored(heads, "near-heads")
    # collections whose value another class has too; ``pull`` is how many others a class meets, on a log scale
    values = heads.select("id", F.posexplode("c").alias("i", "v"))
    shared = values.groupBy("i", "v").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    met = values.join(shared, ["i", "v"]).groupBy("id").agg(
        F.bit_or(F.expr("shiftleft(1, i)")).cast("long").alias("on"), F.sum(F.floor(256 * F.log2(F.col("k").cast("double")))).alias("pull")
    )
    live = heads.join(met.where(F.bit_count("on") > 1), "id")
    keys = stored(_table_keys(live), "near-keys")
    # every class against the one of its key that meets most others: the original of a group of copies
    rank = F.struct("pull", (-F.col("id")).alias("id"))
    tops = keys.groupBy("key").agg(F.max(rank).alias("top"), F.min("id").alias("least"), F.max("id").alias("last")).where("last > least")
    tops = stored(tops.select("key", (-F.col("top.id")).alias("top")), "near-tops")
    met = stored(keys.join(tops, "key").select("key", "id", "top"), "near-met")
    pairs = stored(met.where("id <> top").select(F.least("top", "id").alias("a"), F.greatest("top", "id").alias("b")).distinct(), "near-pairs")
    wanted = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    # the wanted ids grow with the documents, so the plan is the one for large tables at every size
    sets = annotate(rows.join(wanted.hint("merge"), "id", "left_semi"), "text", "s", SETS, _sets, ["id"]).select("id", "s.set")
    sets = stored(sets.distinct(), "near-sets")
    edges = stored(links(pairs, sets, percent), "near-links")
    labels = components(edges)
    # classes that still stand apart within a key
    rest = _apart(met, labels, sets, pairs, percent)
    more = links(stored(rest, "near-rest"), sets, percent)
    labels = components(edges.unionByName(more))
    return _result(facts, classes, labels, key)


def _apart(met: DataFrame, labels: DataFrame, sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs of classes that share keys but no component yet, by an exact prefix join of their full sets.

    Two sets this similar share one of their rarest shingles: of n, those with n * percent / 100 or more at
    or behind them by frequency. Shingles of one class alone come first and meet nothing, so passages that many texts
    share are looked at only in texts that hold little else.
    """
    named = met.join(labels, met["id"] == labels["node"], "left").select("key", "id", F.coalesce("label", "id").alias("label"))
    mixed = named.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count(F.lit(1)).alias("k")).where("y > x and k > 2").select("key")
    wanted = stored(named.join(mixed, "key").select("id", "label").distinct(), "near-rest-ids")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, label, raw in zip(*(batch.column(c).to_pylist() for c in ("id", "label", "set")), strict=True):
                h = np.frombuffer(raw, np.int64)
                n = len(h)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, x, np.int64)) for x in (i, label, n)] + [pa.array(h)], ["id", "label", "n", "h"])

    rest = stored(sets.join(wanted, "id").select("id", "label", "set"), "near-rest-sets")
    rows = stored(rest.mapInArrow(each, "id long, label long, n long, h long"), "near-rest-shingles")
    often = rows.groupBy("h").agg(F.count(F.lit(1)).alias("often"), F.min("label").alias("x"), F.max("label").alias("y")).where("x < y")
    shared = rows.join(often.select("h", "often"), "h")
    mine = Window.partitionBy("id")
    # shingles that only the class's own component has rank first and can never be common
    shared = shared.withColumn("s", F.count(F.lit(1)).over(mine)).withColumn("rank", F.row_number().over(mine.orderBy("often", "h")))
    # at the first common shingle of two sets no more than the shingles from there on can be common
    shared = shared.withColumn("ahead", F.col("s") - F.col("rank") + 1).where(100 * F.col("ahead") >= percent * F.col("n"))
    prefix = stored(shared.select("h", "id", "label", "n", "ahead"), "near-rest-prefix")
    parity = rest.select("id", _parity("set").alias("p")).select("id", *[F.get("p", F.lit(i)).alias(f"p{i}") for i in range(PARITY)])
    return _crossing(prefix, parity, percent).join(pairs, ["a", "b"], "left_anti")


def _crossing(prefix: DataFrame, parity: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that meet in a prefix shingle and pass all bounds.

    A set of n shingles, of which ``ahead`` lie at or behind the meeting place, can only be as similar to a set
    of m if ``m <= ahead * (100 + percent) / percent - n``. So the smaller set of a pair looks in the bands of
    sizes from n up to that, and sets whose bound is below n look nowhere. That is the case of texts of one
    size that share a template short of the wanted similarity. The component with most sets at a shingle
    is not compared with itself, and a band with many sets is split among tasks.
    """
    band = lambda c: F.floor(F.log2(F.col(c).cast("double")) * BANDS)
    top = prefix.groupBy("h", "label").agg(F.count(F.lit(1)).alias("k")).groupBy("h").agg(F.max(F.struct("k", "label")).alias("top"), F.count(F.lit(1)).alias("labels"))
    rows = prefix.join(top.where("labels > 1").select("h", F.col("top.label").alias("most")), "h")
    high = F.least(F.floor(F.col("ahead") * (100 + percent) / percent) - F.col("n"), F.floor(100 * F.col("n") / percent))
    rows = rows.select("h", "id", "label", "n", high.alias("high"), (F.col("label") != F.col("most")).alias("minor"), band("n").alias("band"))
    rows = stored(rows, "near-rest-rows")
    parts = rows.groupBy("h", "band", "minor").agg(F.ceil(F.count(F.lit(1)) / SPLIT).alias("parts"))
    larger = rows.join(parts, ["h", "band", "minor"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
    smaller = rows.where("high >= n").withColumn("band", F.explode(F.sequence("band", band("high"))))
    smaller = smaller.withColumn("minor", F.explode(F.when(F.col("minor"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True)))))
    smaller = smaller.join(parts, ["h", "band", "minor"]).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    key = ["h", "band", "minor", "part"]
    names = ["id", "label", "n", "high", *[c for c in parity.columns if c != "id"]]
    one, two = (d.join(parity, "id").select(*key, *[F.col(c).alias(f"{c}_{k}") for c in names]) for k, d in ((1, smaller), (2, larger)))
    above = (F.col("n_1") < F.col("n_2")) | ((F.col("n_1") == F.col("n_2")) & (F.col("id_1") < F.col("id_2")))
    fits = above & (F.col("n_2") <= F.col("high_1")) & (F.col("n_1") <= F.col("high_2")) & (F.col("label_1") != F.col("label_2"))
    # every differing parity is a shingle that one of the two lacks
    differ = reduce(lambda x, y: x + y, [F.bit_count(F.col(f"p{i}_1").bitwiseXOR(F.col(f"p{i}_2"))) for i in range(PARITY)])
    fits = fits & ((100 + percent) * differ <= (100 - percent) * (F.col("n_1") + F.col("n_2")))
    met = one.join(two, key).where(fits)
    return met.select(F.least("id_1", "id_2").alias("a"), F.greatest("id_1", "id_2").alias("b")).distinct()


def _result(facts: DataFrame, classes: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Classes with copies or links are few; all other rows stand for themselves."""
    named = classes.join(labels, classes["class"] == labels["node"], "left")
    named = named.where("copies > 1 or label is not null").select("n", "d1", "d2", F.coalesce("label", "class").alias("component_id"))
    found = facts.select("id", "n", "d1", "d2").join(named, ["n", "d1", "d2"], "left")
    linked = (F.col("n") > 0) & F.col("id").isNotNull()
    component: Column = F.when(linked, F.coalesce("component_id", "id")).otherwise(F.col("id"))
    return found.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True))
    )


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose key names its component, with all columns.

    Rows with a null key stay, as do null and empty texts; of rows that repeat a kept key all stay. An empty table
    gives no rows.
    """
    gone = find(docs, key, text).where(~F.col("kept")).select(key).distinct()
    return docs.join(gone, key, "left_anti")
