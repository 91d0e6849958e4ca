"""Exact neighbours in feature space from the metric tree, against brute force; how its work grows."""

import numpy as np
import pyarrow as pa
import pytest

from lattica.operators import metric_tree as mt


def frame(spark, x, parts=4):
    return spark.createDataFrame(pa.table({"cell_id": pa.array(range(len(x))), "pc": pa.array(list(x))})).repartition(parts)


def brute(x, k):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    return {(i, int(j)) for i in range(len(x)) for j in np.lexsort((np.arange(len(x)), d[i]))[:k] if np.isfinite(d[i, j])}


def clusters(n, dims=6, each=100, seed=0):
    rng = np.random.default_rng(seed)
    many = max(1, n // each)
    return (rng.normal(0, 40, (many, dims))[np.arange(n) % many] + rng.normal(size=(n, dims))).round(3)


CASES = {
    "clusters": clusters(500, each=50),
    "no structure": np.random.default_rng(1).random((300, 8)),
    "piles and ties": np.concatenate((np.zeros((120, 3)), np.random.default_rng(2).integers(0, 3, (200, 3)), np.full((30, 3), 1e6))).astype(float),
    "far from the origin": clusters(200, 3, 40) + 1e7,
    "few": np.arange(8.0).reshape(4, 2),
}


@pytest.mark.parametrize("name", CASES)
def test_exact(spark, monkeypatch, name):
    for key, value in (("LEAF", 16), ("PIVOTS", 5), ("QUERIES", 40), ("SAMPLE", 64)):
        monkeypatch.setattr(mt, key, value)
    x = CASES[name]
    got = mt.feature_knn(frame(spark, x), 7).collect()
    assert {(r.src, r.dst) for r in got} == brute(x, 7)
    by = {}
    for r in sorted(got, key=lambda r: (r.src, r.rk)):
        by.setdefault(r.src, []).append((r.rk, r.dist, r.dst))
        assert r.dist == pytest.approx(np.linalg.norm(x[r.src] - x[r.dst])) and r.w == 1 / (1 + r.dist)
    assert all([v[0] for v in rows] == list(range(1, len(rows) + 1)) and [v[1:] for v in rows] == sorted(v[1:] for v in rows) for rows in by.values())


def test_odd_rows(spark):
    rows = [(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [None, 1.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, None)]
    df = spark.createDataFrame(rows, "cell_id int, pc array<double>")
    assert {(r.src, r.dst) for r in mt.feature_knn(df, 3).collect()} == {(1, 2), (2, 1)}
    assert mt.feature_knn(df.limit(0), 3).count() == 0


def test_work_on_planted_clusters_grows_with_the_rows(spark, monkeypatch):
    """Comparisons of rows with rows and with pivots, counted, grow by a power below 1.2."""
    for key, value in (("LEAF", 32), ("PIVOTS", 16)):
        monkeypatch.setattr(mt, key, value)
    work = []
    for n in (2_000, 8_000):
        x = clusters(n, each=60)
        rows = mt.parted(frame(spark, x).selectExpr("cell_id", "pc", "true as shown"), n)
        leaves = mt.leaves_of(rows)
        told = rows.select("cell_id", "leaf").toPandas()
        of = np.zeros(n, np.int64)
        of[told.cell_id] = told.leaf
        size = dict(zip(*np.unique(of, return_counts=True)))
        total = 0
        for one in leaves.leaf:
            mine = np.flatnonzero(of == one)
            p = x[mine]
            d = np.sqrt(np.maximum(mt._square(p, p)[0], 0))
            r = np.sort(d, axis=1)[:, min(10, len(p) - 1)]
            row, node = leaves.visits(int(one), p, r, np.full((len(p), 1), -1))
            total += len(p) ** 2 + sum(size[leaves.leaf[x]] for x in node)
        work.append(total)
    assert np.log(work[1] / work[0]) / np.log(4) < 1.2


def test_few_leaves_and_blocks_are_visited_without_structure(spark, monkeypatch):
    """Rows of eight columns without clusters visit a small part of the leaves; by pivots with radii it was half of them."""
    monkeypatch.setattr(mt, "LEAF", 32)
    n, rng = 8_000, np.random.default_rng(5)
    x = rng.normal(size=(n, 8))
    rows = mt.parted(frame(spark, x).selectExpr("cell_id", "pc", "true as shown"), n)
    leaves = mt.leaves_of(rows)
    told = rows.select("cell_id", "leaf").toPandas()
    of = np.zeros(n, np.int64)
    of[told.cell_id] = told.leaf
    asks = rng.choice(n, 200, replace=False)
    reach = np.sort(np.sqrt(((x[asks, None] - x[None]) ** 2).sum(axis=2)), axis=1)[:, 10]
    visits = sum(len(leaves.visits(int(of[a]), x[[a]], reach[[i]], np.full((1, 1), -1))[0]) for i, a in enumerate(asks))
    assert visits / 200 < len(leaves.leaf) / 3


@pytest.mark.parametrize("far", [0.0, 1e6])
def test_blocks_leave_out_no_neighbour(far):
    rng = np.random.default_rng(6)
    x = np.concatenate((rng.normal(size=(700, 5)), rng.integers(0, 3, (300, 5)))).astype(float) + far
    number, k = rng.permutation(1000), 9
    at, to, dist = mt._near(x, number, np.full(1000, np.inf), x, number, k)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    full = d.copy()
    np.fill_diagonal(full, np.inf)
    want = [np.lexsort((number, full[i]))[:k] for i in range(1000)]
    assert np.array_equal(to.reshape(1000, k), want) and np.array_equal(dist, d[at, to])
    reach = full[np.arange(1000), [w[4] for w in want]]
    at, to, _ = mt._near(x, number, reach, x, number, k)
    assert all(np.array_equal(to[at == i], [j for j in w if full[i, j] <= reach[i]]) for i, w in enumerate(want))


def test_cuts_are_whole():
    x = np.concatenate((np.zeros((50, 3)), np.random.default_rng(7).normal(size=(400, 3))))
    cut, after = mt.cuts_of(x, 7, 3)
    of = mt.dealt(x, cut)
    assert sorted(set(of)) == list(range(3, after)) and after == 10
    assert mt.cuts_of(np.ones((9, 2)), 4, 5) == (5, 6) and mt.cuts_of(np.zeros((0, 2)), 4, 5) == (5, 6)
