"""Exact nearest neighbours by cosine distance, with pivots that spare most comparisons where vectors have structure.

Vectors of length one are points of a metric space, so a point x in the cell of pivot p can be nearer than t to a
query q only if ``|d(q, p) - d(x, p)| <= t``. Every vector stands in the cell of its nearest pivot, with its distance to it.

1. Each query visits the cells around it until they hold more than ``k`` vectors; its k-th distance there bounds t.
2. It then visits exactly the cells whose range of distances the bound cannot rule out.

Queries and vectors are tables on both sides; the driver only sees the pivots and one line for each cell.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfield.session import reliable_checkpoint

PIVOTS = 256
MEMBERS, ASKING = 8192, 4096
#: distances are compared at nine decimals; bounds are loosened by more than that
STEP, SLACK = 1e9, 1e-8
FOUND = "query_id bigint, ids array<bigint>, distances array<double>"


def _flat(column) -> tuple[np.ndarray, np.ndarray]:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)


def _matrix(column) -> np.ndarray:
    at, flat = _flat(column)
    return flat[at[0] : at[-1]].astype(float).reshape(len(at) - 1, -1)


def _lists(rows: list[np.ndarray], kind) -> pa.Array:
    at = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate(rows) if rows else np.zeros(0), kind))


def _units(df: DataFrame, ident: str) -> DataFrame:
    """(ident, unit vector) of the rows with a direction."""
    v = F.col("embedding").cast("array<double>")
    d = df.where("photo_id is not null and embedding is not null").select(F.col("photo_id").cast("bigint").alias(ident), v.alias("v"))
    d = d.withColumn("n", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).where("n > 0 and n < double('infinity')")
    return d.select(ident, F.transform("v", lambda x: x / F.col("n")).alias("v"))


def _chords(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2.0 - 2.0 * a @ b.T, 0.0))


def similar(vectors: DataFrame, queries: DataFrame, k: int, pivots: int | None = None) -> DataFrame:
    """The ``k`` nearest rows of ``vectors`` for every row of ``queries`` (both ``photo_id, embedding``): query_id, photo_id, distance, rank.

    The query's own id takes no part; ties at nine decimals go to the smaller id. Rows without an id, an embedding or a
    direction take no part. Ids are unique on either side and embeddings of one length.
    """
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id bigint, photo_id bigint, distance double, rank int")
    corpus, asked = _units(vectors, "photo_id"), reliable_checkpoint(_units(queries, "query_id"))
    count = corpus.count()
    if not count or asked.isEmpty():
        return empty
    wanted = pivots or int(max(1, min(PIVOTS, np.ceil(np.sqrt(count) / 2))))
    share = min(1.0, 4 * wanted / count)
    drawn = corpus.where(F.pmod(F.xxhash64("photo_id"), F.lit(1 << 30)) <= int(share * (1 << 30))).orderBy(F.xxhash64("photo_id"), "photo_id").limit(wanted)
    centres = np.array([r["v"] for r in drawn.select("v").collect()]).reshape(-1, len(corpus.first()["v"]))
    if not len(centres):
        centres = np.array([corpus.first()["v"]])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                d = _chords(_matrix(b.column("v")), centres)
                cell = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(d[np.arange(len(d)), cell])], ["photo_id", "v", "cell", "off"])

    placed = reliable_checkpoint(corpus.mapInArrow(place, "photo_id bigint, v array<double>, cell bigint, off double"))
    facts = placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("off").alias("low"), F.max("off").alias("high")).collect()
    n, low, high = np.zeros(len(centres), np.int64), np.full(len(centres), np.inf), np.full(len(centres), -np.inf)
    for r in facts:  # one line a pivot
        n[r["cell"]], low[r["cell"]], high[r["cell"]] = r["n"], r["low"], r["high"]

    def ask(first: bool):
        """Rows (query_id, v, reach, cell, off) for the cells a query visits in this round."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                d = _chords(_matrix(b.column("v")), centres)
                order = np.argsort(np.where(n > 0, d, np.inf), axis=1, kind="stable")
                before = np.cumsum(n[order], axis=1) - n[order]
                near = np.zeros(d.shape, bool)
                np.put_along_axis(near, order, (before <= k) & (n[order] > 0), axis=1)
                reach = b.column("reach").to_numpy(zero_copy_only=False)
                if first:
                    go = near
                else:
                    go = ~near & (n > 0) & (d - high <= reach[:, None]) & (low - d <= reach[:, None])
                row, cell = np.nonzero(go)
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([b.column("query_id").take(at), b.column("v").take(at), pa.array(reach[row]), pa.array(cell), pa.array(d[row, cell])], ["query_id", "v", "reach", "cell", "off"])

        return run

    def visit(asks: DataFrame) -> DataFrame:
        sizes = placed.groupBy("cell").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("parts")).join(asks.groupBy("cell").agg(F.ceil(F.count("*") / ASKING).cast("int").alias("groups")), "cell")
        sizes = F.broadcast(sizes)  # one line a pivot
        every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        one = lambda ident, c: F.pmod(F.xxhash64(ident), F.col(c)).cast("int")
        here = placed.join(sizes, "cell").withColumn("part", one("photo_id", "parts")).withColumn("group", every("groups"))
        them = asks.join(sizes, "cell").withColumn("group", one("query_id", "groups")).withColumn("part", every("parts"))
        slots = ["cell", "part", "group"]
        a, b = here.select(*slots, "photo_id", "v", "off"), them.select(*slots, "query_id", "v", "reach", "off").toDF("c", "p", "g", "query_id", "v", "reach", "off")
        return a.groupBy(*slots).cogroup(b.groupBy("c", "p", "g")).applyInArrow(_rank(k), FOUND)

    start = asked.withColumn("reach", F.lit(2.0))
    first = reliable_checkpoint(visit(reliable_checkpoint(start.mapInArrow(ask(True), ASKS))))
    best = _merge(first, k)
    last = F.when(F.size("top") >= k, F.element_at("top", -1)["distance"])
    bound = F.coalesce(F.sqrt(2.0 * (last + SLACK)) + SLACK, F.lit(2.0 + SLACK))
    again = asked.join(best.select("query_id", bound.alias("reach")), "query_id", "left").fillna(2.0 + SLACK, ["reach"])
    second = visit(reliable_checkpoint(again.select("query_id", "v", "reach").mapInArrow(ask(False), ASKS)))
    top = _merge(first.unionByName(second), k)
    d = top.select("query_id", F.posexplode("top").alias("at", "e"))
    return d.select("query_id", F.col("e.id").alias("photo_id"), F.col("e.distance").alias("distance"), (F.col("at") + 1).alias("rank"))


ASKS = "query_id bigint, v array<double>, reach double, cell bigint, off double"


def _merge(found: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of all visited cells; a query has at most one list of ``k`` for each part of a cell."""
    pairs = F.transform(F.arrays_zip("distances", "ids"), lambda e: F.struct(e["distances"].alias("distance"), e["ids"].alias("id")))
    return found.select("query_id", pairs.alias("p")).groupBy("query_id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("p"))), 1, k).alias("top"))


def _rank(k: int):
    def run(here: pa.Table, them: pa.Table) -> pa.Table:
        names = ["query_id", "ids", "distances"]
        if not here.num_rows or not them.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float64()))], names)
        ids, x, off = here.column("photo_id").to_numpy(), _matrix(here.column("v")), here.column("off").to_numpy()
        who, q = them.column("query_id").to_numpy(), _matrix(them.column("v"))
        gap, reach = them.column("off").to_numpy(), them.column("reach").to_numpy()
        order = np.argsort(off, kind="stable")
        ids, x, off = ids[order], x[order], off[order]
        # members whose distance to the pivot lies in reach are one run of the sorted cell
        lows, highs = np.searchsorted(off, gap - reach - SLACK), np.searchsorted(off, gap + reach + SLACK, "right")
        out = []
        for i in range(len(who)):
            a, b = lows[i], highs[i]
            if a >= b:
                continue
            d = np.floor((1.0 - x[a:b] @ q[i]) * STEP + 0.5001) / STEP
            mine = ids[a:b]
            keep = mine != who[i]
            d, mine = d[keep], mine[keep]
            if len(d) > k:
                near = d <= np.partition(d, k - 1)[k - 1]
                d, mine = d[near], mine[near]
            best = np.lexsort((mine, d))[:k]
            out.append((who[i], mine[best], d[best]))
        return pa.table([pa.array([o[0] for o in out], pa.int64()), _lists([o[1] for o in out], pa.int64()), _lists([o[2] for o in out], pa.float64())], names)

    return run
