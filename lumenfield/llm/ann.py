"""Approximate nearest neighbours by inner product: a forest of random-projection trees, one queue a query.

* Vectors get one more entry, so that all have the length of the longest; the largest inner product is then
  the smallest angle. A tree cuts by one random direction a level, at the median of each node, so that every
  vector is projected once a level and a tree is ``2 ** depth`` numbers.
* The medians come from a bounded sample: rows whose id hashes below a fraction, about ``SAMPLE`` of them. Every
  row is placed in one leaf of each tree.
* A query walks all trees through one priority queue. A branch ranks by the smallest signed distance to the cuts
  above it, so the next leaf is the most promising of the whole forest. It takes the first ``visits`` leaves.
* ``visits`` is fitted: ``TRIALS`` queries are compared with all rows, and the leaves where their true neighbours
  stand tell how far the queue must be followed to find ``RECALL`` of them. So recall holds at every size, and
  vectors without structure cost what they must.
* The candidates of the visited leaves are ranked by exact inner products, in the tasks that hold the leaves. A
  task holds one block of neighbouring leaves of a tree, at most about ``MEMBERS`` vectors; larger blocks are dealt
  into parts by id, and queries of a busy block into groups.

Equal vectors are one candidate that carries its smallest ids, and are searched once as queries, so a vector
with a third of all rows is no larger than any other.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfield.llm.rows import stored
from lumenfield.llm.vectors import doubles, finite, matrix

TREES, LEAF, MEMBERS, ASKING = 8, 512, 8192, 4096
#: the fit: sampled rows, compared queries, and the share of true neighbours the queue must reach for them
SAMPLE, TRIALS, RECALL = 1 << 15, 128, 0.97
LEAST = 8
SEED = 11


@dataclass(frozen=True)
class Forest:
    """Directions (trees, depth, dims + 1), cuts (trees, 2 ** depth - 1) in level order, the largest norm."""

    directions: np.ndarray
    cuts: np.ndarray
    norm: float

    @property
    def trees(self) -> int:
        return self.directions.shape[0]

    @property
    def depth(self) -> int:
        return self.directions.shape[1]

    def project(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        """(rows, trees, depth) of vectors lifted to one length; queries have no lift."""
        square = np.einsum("nd,nd->n", x, x)
        if query:
            unit = np.column_stack([x / np.sqrt(square)[:, None], np.zeros(len(x))])
        else:
            unit = np.column_stack([x, np.sqrt(np.maximum(self.norm**2 - square, 0))]) / self.norm
        flat = self.directions.reshape(self.trees * self.depth, self.directions.shape[2])
        return (unit @ flat.T).reshape(len(x), self.trees, self.depth)

    def place(self, x: np.ndarray) -> np.ndarray:
        """(rows, trees): the leaf of every vector, numbered through all trees."""
        p = self.project(x)
        node = np.zeros((len(x), self.trees), np.int64)
        tree = np.arange(self.trees)
        for level in range(self.depth):
            right = p[:, :, level] > self.cuts[tree, (1 << level) - 1 + node]
            node = 2 * node + right
        return node + (tree << self.depth)

    def walk(self, p: np.ndarray, visits: int) -> list[int]:
        """The leaves one query visits, best first; ``p`` are its projections (trees, depth)."""
        last = (1 << self.depth) - 1
        p, cuts = p.tolist(), self.cuts.tolist() if self.depth else []
        queue = [(-np.inf, t, 0) for t in range(self.trees)]
        found: list[int] = []
        while queue and len(found) < visits:
            far, t, at = heapq.heappop(queue)
            if at >= last:
                found.append((t << self.depth) + at - last)
                continue
            margin = p[t][(at + 1).bit_length() - 1] - cuts[t][at]
            heapq.heappush(queue, (max(far, margin), t, 2 * at + 1))
            heapq.heappush(queue, (max(far, -margin), t, 2 * at + 2))
        return found


def fit(sample: np.ndarray, count: int, norm: float, trees: int = TREES, leaf: int = LEAF) -> Forest:
    """Cuts at the medians of a sample; leaves of about ``leaf`` of ``count`` rows, but ``LEAST`` of the sample."""
    dims = sample.shape[1]
    most = np.log2(max(len(sample) / LEAST, 1))
    depth = int(max(0, min(round(np.log2(max(count, 1) / leaf)), np.floor(most))))
    trees = trees if depth else 1
    rng = np.random.Generator(np.random.PCG64(SEED))
    directions = rng.standard_normal((trees, depth, dims + 1))
    directions /= np.linalg.norm(directions, axis=2, keepdims=True)
    cuts = np.zeros((trees, (1 << depth) - 1))
    bare = Forest(directions, cuts, norm)
    p = bare.project(sample)
    for t in range(trees):
        node = np.zeros(len(sample), np.int64)
        for level in range(depth):
            order = np.lexsort((p[:, t, level], node))
            edges = np.searchsorted(node[order], np.arange((1 << level) + 1))
            ranked = p[order, t, level]
            size = np.diff(edges)
            middle = edges[:-1] + size // 2
            below = np.where(size > 0, ranked[np.clip(middle - 1, edges[:-1], len(ranked) - 1)], 0.0)
            above = np.where(size > 0, ranked[np.clip(middle, 0, len(ranked) - 1)], 0.0)
            cut = cuts[t, (1 << level) - 1 : (2 << level) - 1]
            cut[:] = (below + above) / 2
            node = 2 * node + (p[:, t, level] > cut[node])
    return Forest(directions, cuts, norm)


def best(x: np.ndarray, ids: list[np.ndarray], q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` ids of the largest inner products for every query: (counts, ids, scores), ties to the smaller id.

    ``ids`` are sorted ids of equal vectors. Matrix products only choose; what is returned is summed vector by
    vector, so that a pair has the same score wherever it is met.
    """
    least = np.array([i[0] for i in ids])
    rough = q @ x.T
    m = min(k, len(x))
    kth = np.partition(rough, len(x) - m, axis=1)[:, len(x) - m]
    slack = 1e-12 * (1 + np.abs(kth)) * (1 + np.abs(x).max() * np.abs(q).max())
    counts, found, scores = [], [], []
    for r in range(len(q)):
        at = np.flatnonzero(rough[r] >= kth[r] - slack[r])
        exact = (x[at] * q[r]).sum(axis=1)
        order = np.lexsort((least[at], -exact))[:m]
        some = [ids[i] for i in at[order]]
        one = np.concatenate(some)
        score = np.repeat(exact[order], [len(i) for i in some])
        if len(one) > len(order):
            order = np.lexsort((one, -score))[:k]
            one, score = one[order], score[order]
        counts.append(len(one))
        found.append(one)
        scores.append(score)
    return np.array(counts), np.concatenate(found), np.concatenate(scores)


def _lists(counts: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(values))


def _ids(column: pa.Array) -> list[np.ndarray]:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    at, flat = column.offsets.to_numpy(), column.values.to_numpy()
    return [flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def _rows(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, vector as doubles) of the rows that take part; a repeated id keeps its least vector."""
    rows = df.select(F.col(f"`{key}`").cast("long").alias("id"), doubles(df, vector).alias("vector"))
    rows = rows.where(F.col("id").isNotNull() & finite(F.col("vector"))).where(F.exists("vector", lambda v: v != 0))
    return rows.groupBy("id").agg(F.min("vector").alias("vector"))


def _top(found: Column, k: int) -> Column:
    """The ``k`` first of an array of (score, id) by falling score, then rising id; a pair that came twice counts once."""
    flat = F.array_sort(F.array_distinct(F.transform(found, lambda e: F.struct((-e["score"]).alias("far"), e["id"].alias("id")))))
    return F.slice(flat, 1, k)


FOUND = "query long, ids array<long>, scores array<double>"


def _exact(heads: DataFrame, trials: list, dims: int, k: int) -> DataFrame:
    """The true ``k`` best ids of a few query vectors, over all rows."""
    names = np.array([t["query"] for t in trials])
    q = np.stack([np.pad(np.asarray(t["vector"], float), (0, dims - len(t["vector"]))) for t in trials])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                counts, ids, scores = best(matrix(b.column("vector"), dims), _ids(b.column("ids")), q, k)
                yield pa.RecordBatch.from_arrays([pa.array(names), _lists(counts, ids), _lists(counts, scores)], ["query", "ids", "scores"])

    return _merge(heads.select("vector", "ids").mapInArrow(run, FOUND), k)


def _merge(found: DataFrame, k: int) -> DataFrame:
    """(query, top): one row a query, its ``k`` best of all parts; a query has a part for each block it visits."""
    pairs = F.transform(F.arrays_zip("ids", "scores"), lambda e: F.struct(e["scores"].alias("score"), e["ids"].alias("id")))
    return found.select("query", pairs.alias("part")).groupBy("query").agg(_top(F.flatten(F.collect_list("part")), k).alias("top"))


def _visits(forest: Forest, placed: DataFrame, heads: DataFrame, probes: DataFrame, dims: int, k: int, recall: float) -> int:
    """How many leaves the queue must give, so that the compared queries find this share of their true neighbours."""
    trials = probes.orderBy(F.xxhash64("query"), "query").limit(TRIALS).collect()
    all_leaves = forest.trees << forest.depth
    if not forest.depth or not trials:
        return all_leaves
    true = _exact(heads, trials, dims, k + 1).select("query", F.explode("top").alias("t")).select("query", F.col("t.id").alias("id"))
    # only the first ids of equal vectors are listed, and each list stands in the row of its vector
    where = placed.select(F.explode("ids").alias("id"), "leaves")
    rows = where.join(F.broadcast(true), "id").where("id <> query").select("query", "leaves").collect()
    ranks = {}
    for t in trials:
        order = forest.walk(forest.project(np.pad(np.asarray(t["vector"], float), (0, dims - len(t["vector"])))[None], True)[0], all_leaves)
        ranks[t["query"]] = dict(zip(order, range(1, all_leaves + 1), strict=True))
    need = sorted(min(ranks[r["query"]][leaf] for leaf in r["leaves"]) for r in rows)
    return max(forest.trees, need[min(len(need) - 1, int(np.ceil(recall * len(need))) - 1)]) if need else forest.trees


def search(
    base: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 20, recall: float = RECALL, trees: int = TREES, leaf: int = LEAF
) -> DataFrame:
    """The ``k`` nearest rows of ``base`` by inner product for each row of ``queries``: query_id, rank, vec_id, score.

    Both tables have the columns ``key`` and ``vector``. A candidate with the query's own id takes no part; ties go
    to the smaller id. Vectors that are null, zero or hold a null or a value that is not finite take no part on
    either side, nor do rows with a null id. A repeated id keeps its least vector (as arrays compare); shorter
    vectors count as padded with zeros. An empty table on either side gives no rows; other columns are not read.
    """
    spark = base.sparkSession
    rows = _rows(base, key, vector)
    # equal vectors: the k + 1 smallest ids are all that any query can need
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy("vector").orderBy("id"))).where(F.col("n") <= k + 1)
    heads = stored(first.groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids")), "ann-heads")
    asked = stored(_rows(queries, key, vector), "ann-queries")
    probes = stored(asked.groupBy("vector").agg(F.min("id").alias("query")), "ann-probes")
    size = F.size("vector")
    square = F.aggregate("vector", F.lit(0.0), lambda a, v: a + v * v)
    facts = heads.agg(F.count(F.lit(1)).alias("n"), F.max(square).alias("square"), F.max(size).alias("dims")).first()
    wide = probes.agg(F.max(size).alias("dims")).first()["dims"]
    if not facts["n"] or not wide:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dims, norm = max(facts["dims"], wide), float(np.sqrt(facts["square"])) or 1.0
    share = min(1.0, SAMPLE / facts["n"])
    sampled = heads if share == 1 else heads.where(F.pmod(F.xxhash64(F.col("ids")[0], F.lit(SEED)), F.lit(1 << 30)) < int(share * (1 << 30)))
    drawn = sampled.select(F.col("ids")[0].alias("id"), "vector").toArrow().sort_by("id")
    forest = fit(matrix(drawn["vector"], dims), facts["n"], norm, trees, leaf)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaves = forest.place(matrix(b.column("vector"), dims))
            yield pa.RecordBatch.from_arrays([*b.columns, _lists(np.full(len(leaves), forest.trees), leaves.ravel())], ["vector", "ids", "leaves"])

    placed = stored(heads.select("vector", "ids").mapInArrow(place, "vector array<double>, ids array<long>, leaves array<long>"), "ann-placed")
    visits = _visits(forest, placed, heads, probes, dims, k, recall)
    shift = max(0, min(forest.depth, int(np.log2(MEMBERS / leaf))))  # neighbouring leaves of one tree share a block

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q, names, vectors = matrix(b.column("vector"), dims), b.column("query"), b.column("vector")
            row, block, cells = [], [], []
            for r, p in enumerate(forest.project(q, True)):
                leaves = np.sort(np.array(forest.walk(p, visits)))
                cut = np.flatnonzero(np.diff(leaves >> shift)) + 1
                for part in np.split(leaves, cut):
                    row.append(r)
                    block.append(part[0] >> shift)
                    cells.append(part)
            if row:
                lists = _lists(np.array([len(c) for c in cells]), np.concatenate(cells))
                yield pa.RecordBatch.from_arrays([names.take(pa.array(row)), vectors.take(pa.array(row)), pa.array(block), lists], ["query", "vector", "block", "cells"])

    wanted = stored(probes.select("query", "vector").mapInArrow(ask, "query long, vector array<double>, block long, cells array<long>"), "ann-wanted")
    stands = placed.select("vector", "ids", F.explode("leaves").alias("cell")).withColumn("block", F.shiftright("cell", shift))
    # at most a few thousand blocks: their number is bounded by the sample
    parts = lambda df, most, name: df.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias(name))
    sizes = F.broadcast(stored(parts(stands, MEMBERS, "parts").join(parts(wanted, ASKING, "groups"), "block"), "ann-sizes"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    members = stands.join(sizes, "block").withColumn("part", one(F.col("ids")[0], "parts")).withColumn("group", every("groups"))
    asking = wanted.join(sizes, "block").withColumn("group", one(F.col("query"), "groups")).withColumn("part", every("parts"))

    def rank(here: pa.Table, them: pa.Table) -> pa.Table:
        if not here.num_rows or not them.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float64()))], ["query", "ids", "scores"])
        here = here.combine_chunks().sort_by("cell")
        x, ids, cell = matrix(here["vector"], dims), _ids(here["ids"]), here["cell"].to_numpy()
        q, names, cells = matrix(them["vector"], dims), them["query"].to_numpy(), _ids(them["cells"])
        asked_by = np.repeat(np.arange(len(q)), [len(c) for c in cells])
        flat = np.concatenate(cells)
        got: dict[int, list] = {}
        for c in np.unique(cell):
            who = asked_by[flat == c]
            if not len(who):
                continue
            a, b = np.searchsorted(cell, [c, c + 1])
            counts, found, scores = best(x[a:b], ids[a:b], q[who], k + 1)
            at = np.concatenate([[0], np.cumsum(counts)])
            for i, w in enumerate(who):
                got.setdefault(w, []).append((found[at[i] : at[i + 1]], scores[at[i] : at[i + 1]]))
        out = []
        for w, parts in got.items():
            found, scores = (np.concatenate(p) for p in zip(*parts, strict=True))
            order = np.lexsort((found, -scores))[: k + 1]
            out.append((names[w], found[order], scores[order]))
        counts = np.array([len(o[1]) for o in out], np.int64)
        joined = [np.concatenate([o[i] for o in out]) if out else np.zeros(0, (np.int64, float)[i - 1]) for i in (1, 2)]
        return pa.table([pa.array([o[0] for o in out], pa.int64()), _lists(counts, joined[0]), _lists(counts, joined[1])], ["query", "ids", "scores"])

    slots = ["block", "part", "group"]
    pairs = members.select(*slots, "cell", "vector", "ids").groupBy(*slots).cogroup(asking.select(*slots, "query", "vector", "cells").groupBy(*slots))
    top = _merge(pairs.applyInArrow(rank, FOUND), k + 1)
    named = asked.join(probes, "vector").select("id", "query").join(top, "query")
    others = F.slice(F.filter("top", lambda e: e["id"] != F.col("id")), 1, k)
    return named.select("id", F.posexplode(others).alias("at", "e")).select(
        F.col("id").alias("query_id"), (F.col("at") + 1).cast("int").alias("rank"), F.col("e.id").alias("vec_id"), (-F.col("e.far")).alias("score")
    )
