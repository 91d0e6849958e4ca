"""The fitted neighbour search: saved and read again, other cells against it, work in crowded places."""

import math

import numpy as np
import pytest

from lattica.operators import graph, spatial_index
from lattica.operators.spatial_index import SpatialIndex, Tree

from .test_spatial import edges_of, make_cells


def two_sided(xy, queries, k=None, radius=math.inf, samples=None, own=None):
    out = set()
    for i, (x, y) in enumerate(queries):
        near = sorted((math.sqrt((a - x) ** 2 + (b - y) ** 2), j) for j, (a, b) in enumerate(xy) if not samples or samples[j] == own[i])
        out |= {(i, j) for _, j in [n for n in near if n[0] <= radius][:k]}
    return out


def test_other_cells_against_a_saved_index(spark, monkeypatch):
    monkeypatch.setattr(spatial_index, "LEAF", 9)
    rng = np.random.default_rng(4)
    xy = np.concatenate((rng.random((200, 2)), np.full((60, 2), 0.5), rng.normal(0.2, 1e-4, (80, 2)))).round(4).tolist()
    queries = np.concatenate((rng.random((50, 2)) * 1.5, np.full((40, 2), 0.5), [(1e6, -1e6)])).round(4).tolist()
    SpatialIndex.fit(make_cells(spark, xy), most=6).save("fitted", buckets=3)
    try:
        index = SpatialIndex.load(spark, "fitted")
        q = make_cells(spark, queries)
        assert edges_of(index.neighbours(q, 6)) == two_sided(xy, queries, 6)
        assert edges_of(index.neighbours(q, 5, max_radius=0.03)) == two_sided(xy, queries, 5, 0.03)
        assert edges_of(graph.knn_graph(make_cells(spark, xy), 4, index=index)) == edges_of(graph.knn_graph(make_cells(spark, xy), 4))
        plan = index.neighbours(q, 6)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(leaf") == 1  # that of the queries; the index lies in buckets
        with pytest.raises(ValueError):
            index.neighbours(q, 7)
        with pytest.raises(ValueError):
            index.neighbours(q, None, max_radius=1.0)
    finally:
        for t in ("fitted", "fitted_leaves", "fitted_about"):
            spark.sql(f"drop table if exists {t}")


def test_samples_and_radius(spark, monkeypatch):
    monkeypatch.setattr(spatial_index, "LEAF", 8)
    rng = np.random.default_rng(5)
    xy, queries = rng.random((150, 2)).round(3).tolist(), rng.random((40, 2)).round(3).tolist()
    samples, own = ["abc"[i % 3] for i in range(150)], ["bcd"[i % 3] for i in range(40)]
    index = SpatialIndex.fit(make_cells(spark, xy, samples))
    q = make_cells(spark, queries, own)
    assert edges_of(index.neighbours(q, 3)) == two_sided(xy, queries, 3, samples=samples, own=own)
    got = index.neighbours(q, None, max_radius=0.2)
    assert edges_of(got) == two_sided(xy, queries, None, 0.2, samples, own) and "sample" in got.columns
    assert SpatialIndex.fit(make_cells(spark, xy).limit(0)).neighbours(make_cells(spark, queries), 3).count() == 0


def test_work_in_a_crowded_place():
    """A spot with a tenth of the cells is cut as finely as the rest: a search reaches about as many leaves."""

    def reached(xy):
        cuts = tuple(np.unique(np.quantile(xy[:, c], np.linspace(0, 1, 513), method="lower")) for c in (0, 1))
        order = np.argsort(Tree(cuts, np.zeros(0), np.zeros(0), []).codes(xy[:, 0], xy[:, 1]), kind="stable")
        cells = xy[order][: len(xy) // 200 * 200].reshape(-1, 200, 2)
        lo, hi = cells.min(axis=1), cells.max(axis=1)
        total = 0
        for part, a, b in zip(cells, lo, hi):
            d = np.sqrt(((part[:20, None] - part) ** 2).sum(axis=2))
            r = np.partition(d, 15, axis=1)[:, 15]
            gap = np.maximum(np.maximum(lo - part[:20, None], part[:20, None] - hi), 0)
            total += (np.sqrt((gap**2).sum(axis=2)) <= r[:, None]).sum()
        return total / (len(cells) * 20)

    rng = np.random.default_rng(0)
    even = rng.random((60_000, 2))
    spot = np.concatenate((even[:54_600], rng.normal(0.31, 1e-5, (5_400, 2))))
    far = np.concatenate((spot, [(1e9, -1e9), (-1e12, 0.5)]))
    usual = reached(even)
    assert usual < 5 and reached(spot) < 1.3 * usual and reached(far) < 1.3 * usual
