"""Neighbours, whitening and conversation repair against brute force, on the given tables and on odd rows."""

from __future__ import annotations

import hashlib
import itertools
import re
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfield.llm import ann, conversations, whitening
from lumenfield.llm.queries import QUERIES
from tests.conftest import DATA

# --- neighbours ------------------------------------------------------------------------------------------


def vectors(folder=DATA):
    rows = duckdb.sql(f"select vec_id, embedding from '{folder}/embeddings.parquet'").fetchall()
    return [r[0] for r in rows], np.array([r[1] for r in rows], float)


def nearest(ids, x, q, own, k):
    """Ids and scores of the k largest inner products, own id left out, ties to the smaller id."""
    s = (x * q).sum(axis=1)
    order = [i for i in np.lexsort((ids, -s)) if ids[i] != own][:k]
    return [(int(ids[i]), float(s[i])) for i in order]


def answers(df):
    out: dict = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


def recall(got, want):
    hit = [len({i for i, _ in got[q]} & {i for i, _ in w}) for q, w in want.items()]
    return sum(hit) / sum(len(w) for w in want.values())


def test_neighbours_of_the_given_vectors(spark):
    ids, x = vectors()
    got = answers(QUERIES["op11_nearest_neighbours"](spark, DATA))
    want = {i: nearest(np.array(ids), x, x[p], i, 20) for p, i in enumerate(ids) if i % 20 == 0}
    assert got.keys() == want.keys() and recall(got, want) >= 0.9
    for q, found in got.items():
        assert len(found) == 20 and q not in dict(found)
        assert found == sorted(found, key=lambda e: (-e[1], e[0]))
        assert all(abs(s - x[ids.index(i)] @ x[ids.index(q)]) < 1e-12 for i, s in found)


@pytest.mark.parametrize("norms", [False, True])
def test_neighbours_through_a_real_forest(spark, norms):
    """Small leaves make deep trees; lengths that differ move the largest product away from the smallest angle."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 16)) + 2 * rng.normal(size=(12, 16))[rng.integers(0, 12, 3000)]
    x *= rng.lognormal(size=(3000, 1)) if norms else 1 / np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = answers(ann.search(df, df.where("vec_id % 20 = 0"), k=10, leaf=32))
    want = {i: nearest(np.arange(3000), x, x[i], i, 10) for i in range(0, 3000, 20)}
    assert recall(got, want) >= 0.9
    assert all(abs(s - x[i] @ x[q]) < 1e-9 for q, found in got.items() for i, s in found)


def test_neighbours_among_copies_and_ties(spark):
    """A third of all rows is one vector; whole numbers make ties between different vectors."""
    rng = np.random.default_rng(6)
    x = rng.integers(-2, 3, (900, 6)).astype(float)
    x[::3] = [1, 1, 0, 0, 1, 0]
    x[np.abs(x).sum(axis=1) == 0] = 1
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(5)
    got = answers(ann.search(df, df.where("vec_id % 20 = 0"), k=20))
    assert got == {i: nearest(np.arange(900), x, x[i], i, 20) for i in range(0, 900, 20)}


def test_neighbours_odd_rows(spark):
    rows = [
        (0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, [0.0, 0.0]), (4, [None, 1.0]), (5, [float("nan"), 1.0]),
        (6, [float("inf"), 1.0]), (None, [9.0, 9.0]), (7, [2.0]), (8, [0.0, 0.0, 3.0]), (9, []), (10, [5.0, 1.0]), (10, [0.1, 0.1]), (20, [1.0, 0.0]),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").select("*", *[F.lit(1).alias(c) for c in ("id", "vector", "query", "ids", "n", "rank")])
    got = answers(ann.search(df, df, k=3))
    assert got.keys() == {0, 1, 7, 8, 10, 20}
    assert got[0] == [(7, 2.0), (20, 1.0), (1, 0.5)]
    assert got[20] == [(7, 2.0), (0, 1.0), (1, 0.5)]
    assert got[8] == [(0, 0.0), (1, 0.0), (7, 0.0)]
    assert len(got[10]) == 3 and got[10][0] == (7, 0.2)
    empty = df.limit(0)
    assert ann.search(empty, df).count() == ann.search(df, empty).count() == ann.search(empty, empty).count() == 0


def test_walk_takes_leaves_by_the_shared_queue():
    """Every leaf once, in the order of the largest cut distance on the way that had to be crossed."""
    x = np.random.default_rng(2).normal(size=(500, 8))
    forest = ann.fit(x, 500, float(np.linalg.norm(x, axis=1).max()), trees=3, leaf=32)
    p = forest.project(x[:1], True)[0]
    order = forest.walk(p, 10**6)
    assert sorted(order) == list(range(3 << forest.depth))

    def rank(leaf):
        t, at, worst = leaf >> forest.depth, 0, -np.inf
        for level in range(forest.depth):
            bit = (leaf >> (forest.depth - 1 - level)) & 1
            margin = p[t, level] - forest.cuts[t, (1 << level) - 1 + at]
            worst = max(worst, -margin if bit else margin)
            at = 2 * at + bit
        return worst

    ranks = [rank(leaf) for leaf in order]
    assert ranks == sorted(ranks)
    assert set(forest.place(x).ravel()) <= set(order)


# --- whitening -------------------------------------------------------------------------------------------


def test_whitening_of_the_given_vectors(spark):
    ids, x = vectors()
    got = QUERIES["op12_whitening"](spark, DATA).toPandas()
    y = np.floor(64 * x).astype(np.int64) + 1_000_000
    n, s = len(y), y.sum(axis=0)
    values, axes = np.linalg.eigh(np.cov((y - 1_000_000).T, bias=True))
    values, axes = values[::-1], axes[:, ::-1]
    want = (y - s / n) @ axes[:, :32] / np.sqrt(values[:32])
    assert len(got) == 32 * n and (got.n == n).all()
    table = got.pivot(index="vec_id", columns="component", values="whitened").loc[ids].to_numpy()
    signs = np.sign((table * want).sum(axis=0))
    assert np.abs(table - want * signs).max() < 1e-8
    one = got[got.vec_id == ids[0]].sort_values("component")
    assert np.allclose(one.explained, values[:32] / values.sum(), rtol=1e-9)
    assert dict(zip(got.vec_id, got.deviation, strict=True)) == dict(zip(ids, ((n * y - s) ** 2).sum(axis=1).tolist(), strict=True))
    assert got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-10


def determinant(m):
    m, out = [[Fraction(v) for v in row] for row in m], Fraction(1)
    for k in range(len(m)):
        at = next((i for i in range(k, len(m)) if m[i][k]), None)
        if at is None:
            return 0
        if at != k:
            m[k], m[at], out = m[at], m[k], -out
        out *= m[k][k]
        for i in range(k + 1, len(m)):
            f = m[i][k] / m[k][k]
            m[i] = [a - f * b for a, b in zip(m[i], m[k], strict=True)]
    return out


@pytest.mark.parametrize("seed", range(4))
def test_characteristic_polynomial_is_exact(spark, seed):
    """Against determinants in fractions, also for sparse matrices whose reduction meets zero pivots."""
    rng = np.random.default_rng(seed)
    b = rng.integers(-5, 6, (5, 3 if seed == 1 else 7)) * (rng.random((5, 1)) < (0.6 if seed == 2 else 1.1))
    a = (b @ b.T * (10**9 if seed == 3 else 1)).tolist()
    c = whitening.polynomial(spark, a)
    for t in (-3, 0, 2, 10**6):
        want = determinant([[(t if i == j else 0) - a[i][j] for j in range(5)] for i in range(5)])
        assert sum(v * t**i for i, v in enumerate(c)) == want


def test_roots_with_multiplicity_and_close_pairs():
    def product(roots):
        c = [1]
        for r in roots:
            c = [a - r * b for a, b in zip([0, *c], [*c, 0], strict=True)]
        return c

    for want in ([5], [3, 3, 3], [0, 0, 7, 10**12, 10**12 + 1], [1, 2, 2, 4, 10**30]):
        found = whitening.roots(product(want))
        got = [n / 2**b for n, b, k in found for _ in range(k)]
        assert np.allclose(got, sorted((float(r) for r in want if r), reverse=True), rtol=1e-14)
        assert len(found) == len({r for r in want if r})


def test_components_of_equal_variance_are_orthonormal(spark):
    """Four dimensions of one variance, one constant, one copy of another."""
    rows = [(i, [float(a), float(b), float(c), float(d), 2.0, float(a)]) for i, (a, b, c, d) in enumerate(itertools.product((-1, 1), repeat=4))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = whitening.whiten(df).toPandas()
    assert got.component.max() == 4 and len(got) == 64
    w = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert np.abs(w.T @ w / 16 - np.eye(4)).max() < 1e-12 and got.identity_error[0] < 1e-12
    assert np.allclose(sorted(got[got.vec_id == 0].explained), [0.2, 0.2, 0.2, 0.4])


def test_whitening_odd_rows(spark):
    rows = [(1, [1e20, 0.5]), (1, [1e20, 0.5]), (2, None), (3, [None, 1.0]), (4, [float("nan"), 1.0]), (5, [-1e18, 3.0]), (None, [2.5]), (6, []), (7, [0.0, -3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").select("*", *[F.lit(1).alias(c) for c in ("vector", "n", "component", "i")])
    got = whitening.whiten(df).collect()
    assert sorted({r.vec_id or -1 for r in got}) == [-1, 1, 5, 6, 7] and {r.n for r in got} == {6}
    y = [[max(min(int(np.floor(64 * v)), 1 << 61), -(1 << 61)) for v in x] for x in ([1e20, 0.5], [1e20, 0.5], [-1e18, 3.0], [2.5, 0], [0, 0], [0, -3.0])]
    s = [sum(c) for c in zip(*y, strict=True)]
    want = [sum((6 * a - b) ** 2 for a, b in zip(r, s, strict=True)) for r in y]
    assert sorted(int(r.deviation) if r.deviation is not None else -1 for r in got if r.component == 1) == sorted(v if v < 10**38 else -1 for v in want)
    assert whitening.whiten(df.limit(0)).count() == 0 and whitening.whiten(df.limit(1)).count() == 0


# --- conversations ---------------------------------------------------------------------------------------

SPACES = " \t\n\x0b\x0c\r"


def damaged(rows):
    out: dict = {}
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        mine = out.setdefault(conv, [])
        role = "user" if kind == 4 else role
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        mine += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def marked(rows):
    """Rows of one conversation in order, with their first fault."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1].encode(), r[2].encode()))
    seen, out = set(), []
    for turn, role, text in rows:
        body = text.rstrip(SPACES)
        fault = 1 if not body else 2 if (role, text) in seen else 3 if body[-1] not in ".!?" else 0
        seen.add((role, text))
        out.append((turn, role, text, fault))
    return out


def cheapest(rows, limit=None):
    """All edits as lists, by depth-first search; the least (cost, letters) with its lines."""
    best = [(10**9, "", [])]
    most = 4 * len(rows)

    def go(i, roles, cost, letters, lines):
        if cost > min(best[0][0], most):
            return
        if not re.fullmatch("(s(u(au)*a?)?)?|u(au)*a?|", roles):
            return
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            if (cost, letters) < best[0][:2]:
                best[0] = (cost, letters, lines)
        if i < len(rows):
            _, role, text, fault = rows[i]
            late = 3 if fault == 3 else 0
            go(i + 1, roles, cost + 4, letters + "D", lines)
            if fault in (0, 3):
                go(i + 1, roles + (role[:1] if role[:1] in list("sua") else "x"), cost + late, letters + "K", [*lines, f"{role}:{text}"])
                for name in ("user", "assistant"):
                    go(i + 1, roles + name[0], cost + 3 + late, letters + "R", [*lines, f"{name}:{text}"])
        for name in ("user", "assistant"):
            go(i, roles + name[0], cost + 3, letters + "I", [*lines, f"{name}:"])

    go(0, "", 0, "", [])
    cost, letters, lines = best[0]
    return cost, letters, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def brute(rows):
    out = {}
    for conv, mine in damaged(rows).items():
        m = marked(mine)
        turns = [t for t, *_ in m if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        faults = [sum(f == k for *_, f in m) for k in (1, 2, 3)]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(m, m[1:], strict=False))
        out[conv] = (gaps, *faults, illegal, *cheapest(m))
    return out


def reports(df):
    return {r[0]: tuple(r[1:]) for r in df.collect()}


def test_repair_of_the_given_conversations(spark):
    rows = duckdb.sql(f"select conv_id, turn, role, text from '{DATA}/conversations.parquet'").fetchall()
    assert reports(QUERIES["op13_conversation_repair"](spark, DATA)) == brute(rows)


def test_repair_odd_rows(spark):
    rows = [
        (None, None, None, None), (None, 1, "user", "Hi."), (1, None, "system", "Be kind."), (1, None, None, "a"), (1, 5, "user", None), (2, 3, "", "x."), (2, 3, "", "x."),
        (2, 9, "assistant", "  \n"), (3, 0, "su", "é!  "), (3, 1, "user", "Where?\r\n"), (3, 7, "assistant", "Here"), (4, -(2**63), "user", "a."), (4, 2**63 - 1, "ua", "b."),
        (5, 1, "assistant", "One."), (5, 2, "assistant", "Two."), (5, 3, "system", "Three."), (6, 1, "tool", "x" * 300_000),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    df = df.select("*", *[F.lit(1).alias(c) for c in ("copy", "dropped", "fault", "kind", "row", "audit")])
    got, want = reports(conversations.repair(conversations.damage(df))), brute(rows)
    want[4] = (min(want[4][0], 2**63 - 1), *want[4][1:])
    assert got == want
    assert conversations.repair(conversations.damage(df.limit(0))).count() == 0


def test_repair_of_a_conversation_that_is_all_dropped(spark):
    turns = [t for t in range(200) if zlib.crc32(f"7:{t}".encode()) % 20 == 0][:2]
    df = spark.createDataFrame([(7, t, "user", "a.") for t in turns], "conv_id long, turn long, role string, text string")
    assert reports(conversations.repair(conversations.damage(df))) == {7: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


@pytest.mark.parametrize("seed", range(6))
def test_every_short_conversation(seed):
    """Random rows of every role and fault: weights find the same edits as a search through all of them."""
    rng = np.random.default_rng(seed)
    for _ in range(60):
        rows = [(i, str(rng.choice(["system", "user", "assistant", "x"])), f"t{i}.", int(rng.choice([0, 0, 0, 1, 2, 3]))) for i in range(rng.integers(0, 6))]
        r = conversations.Repair()
        for _, role, text, fault in rows:
            r.add(role, text, fault)
        assert r.close() == cheapest(rows)


def by_suffixes(rows):
    """Cost and letters by plain tuples from the last row to the first: another order of the same decisions."""
    turn = {"": "u", "s": "u", "u": "a", "a": "u"}
    inf = (10**12, "")
    after = {"": (0, ""), "a": (0, ""), "s": inf, "u": inf}
    for step in range(2):
        after = {q: min(after[q], (3 + after[turn[q]][0], "I" + after[turn[q]][1])) for q in after}
    for _, role, _, fault in reversed(rows):
        late = 3 if fault == 3 else 0
        here = {}
        for q in after:
            options = [(4 + after[q][0], "D" + after[q][1])]
            if fault in (0, 3):
                i = role[:1]
                if i == turn[q] or (q == "" and i == "s"):
                    options.append((late + after[i][0], "K" + after[i][1]))
                options.append((3 + late + after[turn[q]][0], "R" + after[turn[q]][1]))
            here[q] = min(options)
        for step in range(2):
            here = {q: min(here[q], (3 + here[turn[q]][0], "I" + here[turn[q]][1])) for q in here}
        after = here
    return after[""]


def test_long_conversations_keep_short_weights():
    """Thousands of rows: the letters are right and the weights stay narrow."""
    rng = np.random.default_rng(9)
    for kinds in ([0, 0, 0, 0, 3], [0, 1, 2, 3], [1]):
        rows = [(i, str(rng.choice(["system", "user", "assistant", "x"])), "t.", int(rng.choice(kinds))) for i in range(3000)]
        r = conversations.Repair()
        for _, role, text, fault in rows:
            r.add(role, text, fault)
        assert r.width <= 4 * conversations.WIDTH
        assert r.close()[:2] == by_suffixes(rows)


def test_repaired_turns_are_what_the_digest_says(spark):
    df = spark.read.parquet(f"{DATA}/conversations.parquet")
    rows = conversations.damage(df)
    report = conversations.repair(rows)
    lines: dict = {}
    for r in conversations.repaired_turns(rows, report).orderBy("conv_id", "position").collect():
        lines.setdefault(r.conv_id, []).append(r)
    for r in report.collect():
        mine = lines.get(r.conv_id, [])
        assert re.fullmatch("(s?(ua)+)?", "".join(x.role[:1] for x in mine))
        assert hashlib.sha256("\n".join(f"{x.role}:{x.text}" for x in mine).encode()).hexdigest() == r.repaired_sha256
    assert conversations.repair(conversations.whole(df)).count() == df.select("conv_id").distinct().count()
