"""Sweeps over settings: all resolutions at once give what each gives alone; a run that broke off goes on where it was."""

import numpy as np
import pytest

from lattica import plans
from lattica.operators import cluster

from .test_spatial import make_cells


def planted(spark, n=90, seed=0):
    rng = np.random.default_rng(seed)
    kind = np.arange(n) % 3
    xy = rng.random((n, 2)) + kind[:, None] * 0.5
    genes = rng.normal(size=(n, 5)) + 4 * np.eye(5)[kind]
    expr = [(i, j, float(genes[i, j])) for i in range(n) for j in range(5)]
    truth = spark.createDataFrame([(i, int(k)) for i, k in enumerate(kind)], "cell_id long, label int")
    return make_cells(spark, xy), spark.createDataFrame(expr, "cell_id long, gene_id int, value double"), truth


@pytest.mark.parametrize("task_edges", [10_000, 10])
def test_all_resolutions_at_once(spark, monkeypatch, task_edges):
    monkeypatch.setattr(cluster, "TASK_EDGES", task_edges)
    monkeypatch.setattr(cluster, "PASSES", 1)
    pairs = [(a + o, b + o) for o in (0, 6, 12) for a in range(5) for b in range(a + 1, 5)] + [(4, 6), (10, 12)]
    edges = spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "src long, dst long, w double").persist()
    cells = spark.range(18).withColumnRenamed("id", "cell_id")
    got = {}
    for r in cluster.leiden_sweep(cells, edges, [0.0, 1.0, 9.0] if task_edges > 10 else [1.0]).collect():
        got.setdefault(r.setting, {})[r.cell_id] = r.label
    if task_edges > 10:
        for i, resolution in enumerate([0.0, 1.0, 9.0]):
            assert got[i] == {r.cell_id: r.label for r in cluster.leiden(cells, edges, resolution).collect()}
        assert len(set(got[0].values())) == 4 and len(set(got[1].values())) == 6 and sorted(got[2].values()) == list(range(18))
    else:
        assert got[0] == {**{i: 0 for i in range(5)}, **{i: 1 for i in range(6, 11)}, **{i: 2 for i in range(12, 17)}, 5: 3, 11: 4, 17: 5}
    edges.unpersist()


def test_a_broken_run_goes_on(spark, tmp_path, monkeypatch):
    cells, expr, truth = planted(spark)
    s = plans.Settings(lambdas=(0.2,), pcs=(3,), resolutions=(0.5, 0.9), feature_neighbours=8, k=5, max_m=0, add_nonspatial=False)
    plain, labels = plans.run(cells, expr, s, truth)
    folder, real, calls = str(tmp_path / "sweep"), plans.lab.modularity, []

    def breaks(*args):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("lost")
        return real(*args)

    monkeypatch.setattr(plans.lab, "modularity", breaks)
    with pytest.raises(RuntimeError):
        plans.run(cells, expr, s, truth, folder)
    again, _ = plans.run(cells, expr, s, truth, folder)
    assert len(calls) == 3 and again.collect() == plain.collect()
    monkeypatch.setattr(plans, "initialize", None)  # everything is there: nothing is built again
    last, kept_labels = plans.run(cells, expr, s, truth, folder)
    assert last.collect() == plain.collect() and len(calls) == 3
    for key, df in labels.items():
        assert sorted(df.collect()) == sorted(kept_labels[key].select("cell_id", "label").collect())


def test_search_walks_step_by_step_and_tries_none_twice(spark, monkeypatch):
    rng = np.random.default_rng(4)
    pairs = [(i, j, 1.0) for i in range(60) for j in range(i + 1, 60) if rng.random() < (0.6 if i // 10 == j // 10 else 0.05)]
    cells, edges = spark.range(60).withColumnRenamed("id", "cell_id"), spark.createDataFrame(pairs, "src long, dst long, w double")
    asked, sweep = [], cluster.leiden_sweep
    monkeypatch.setattr(cluster, "leiden_sweep", lambda *given, **more: asked.append(list(given[2])) or sweep(*given, **more))
    for wanted, most in ((6, 3), (1000, 3), (3, 5)):
        asked.clear()
        resolution, labels = cluster.find_resolution(cells, edges, wanted, start=0.3, step=0.15, max_iter=most)
        tried = [x for many in asked for x in many]
        assert len(tried) == len(set(tried)) and len(asked) <= 3
        at = 0
        for _ in range(most):  # the walk itself, one try at a time
            plain = {r.cell_id: r.label for r in cluster.leiden(cells, edges, 0.3 + at * 0.15).collect()}
            last, many = 0.3 + at * 0.15, len(set(plain.values()))
            if many == wanted:
                break
            at += 1 if many < wanted else -1
        assert resolution == last and {r.cell_id: r.label for r in labels.collect()} == plain


def test_neighbours_are_searched_once(spark, monkeypatch):
    """The search for the weights finds the neighbours of refinement too; further ones are searched for."""
    cells, expr, truth = planted(spark)
    searched, real = [], plans.graph.knn_graph
    monkeypatch.setattr(plans.graph, "knn_graph", lambda c, k, **more: searched.append(k) or real(c, k, **more))
    s = plans.Settings(lambdas=(0.2,), pcs=(3,), resolutions=(0.5,), feature_neighbours=8, k=5, max_m=0, add_nonspatial=False, refine="once", refine_neighbours=4)
    (row,) = plans.run(cells, expr, s, truth)[0].collect()
    assert searched == [5]
    near = real(cells, 4)
    plain = plans.run(cells, expr, plans.Settings(**{**vars(s), "refine": None}), truth)[1]
    better, _, _ = plans.lab.refined(next(iter(plain.values())), near, "once")
    assert row.refined_ari == pytest.approx(plans.lab.ari(truth, better).first()[0])
    searched.clear()
    plans.run(cells, expr, plans.Settings(**{**vars(s), "refine_neighbours": 6}), truth)
    assert searched == [5, 6]
