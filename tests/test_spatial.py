"""Properties and edge cases of the spatial operators against numpy."""

import itertools
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica import plans, sources
from lattica.functions import p_equiv_radius
from lattica.operators import _scale, augment, cluster, graph, labels as lab, qc, reduce as red, spatial_index, stats
from lattica.operators._scale import running


def make_cells(spark, xy, sample=None):
    rows = [(i, float(x), float(y)) + ((sample[i],) if sample else ()) for i, (x, y) in enumerate(xy)]
    return spark.createDataFrame(rows, "cell_id long, x double, y double" + (", sample string" if sample else ""))


def brute(xy, k, sample=None):
    out = set()
    for i, p in enumerate(xy):
        near = sorted((math.sqrt((q[0] - p[0]) ** 2 + (q[1] - p[1]) ** 2), j) for j, q in enumerate(xy) if j != i and (not sample or sample[i] == sample[j]))
        out |= {(i, j) for _, j in near[:k]}
    return out


def edges_of(df):
    return {(r.src, r.dst) for r in df.select("src", "dst").collect()}


@pytest.mark.parametrize("seed,n,k", [(1, 900, 4), (2, 40, 6), (3, 5, 9)])
def test_knn_is_exact(spark, monkeypatch, seed, n, k):
    rng = np.random.default_rng(seed)
    xy = np.concatenate((rng.normal(0, 1, (n // 2, 2)), rng.normal(50, 0.01, (n - n // 2, 2)))).round(3)
    monkeypatch.setattr(spatial_index, "LEAF", 7)
    assert edges_of(graph.knn_graph(make_cells(spark, xy), k)) == brute(xy.tolist(), k)


def test_knn_with_piles_samples_and_nulls(spark, monkeypatch):
    monkeypatch.setattr(spatial_index, "LEAF", 2)
    monkeypatch.setattr(spatial_index, "QUERIES", 3)
    xy = [(0, 0)] * 30 + [(1, 1)] * 3 + [(9, 9)]
    sample = ["a", "b"] * 17
    assert edges_of(graph.knn_graph(make_cells(spark, xy, sample), 3)) == brute(xy, 3, sample)
    holes = make_cells(spark, xy).withColumn("x", F.when(F.col("cell_id") == 5, None).otherwise(F.col("x")))
    assert not any(5 in e for e in edges_of(graph.knn_graph(holes, 3)))
    assert graph.knn_graph(make_cells(spark, [(0, 0)]).limit(0), 3).count() == 0
    assert graph.knn_graph(make_cells(spark, [(1, 2)]), 3).count() == 0


def test_weights_add_up(spark):
    xy = np.random.default_rng(0).random((60, 2))
    c = make_cells(spark, xy)
    for decay in graph.DECAYS:
        w = graph.spatial_weights(c, 0, 5, decay).groupBy("src").agg(F.sum("w").alias("s")).collect()
        assert all(abs(r.s - 1) < 1e-12 for r in w)
    ones = c.select("cell_id", F.lit(0).alias("gene_id"), F.lit(3.0).alias("value"))
    assert all(abs(r.value - 3) < 1e-12 for r in augment.neighbour_mean(graph.spatial_weights(c, 0, 5), ones).collect())
    assert all(r.value < 1e-9 for r in augment.agf(graph.spatial_weights(c, 1, 5), ones, True).collect())
    with pytest.raises(ValueError):
        graph.spatial_weights(c, 0, 5, "unknown")
    with pytest.raises(ValueError):
        p_equiv_radius(1.5, 1)


def test_gradient_turns_with_the_plane(spark):
    rng = np.random.default_rng(4)
    xy, a = rng.random((50, 2)), 0.7
    turn = xy @ np.array([[math.cos(a), math.sin(a)], [-math.sin(a), math.cos(a)]])
    values = spark.createDataFrame([(i, 0, float(v)) for i, v in enumerate(rng.random(50))], "cell_id long, gene_id int, value double")
    one, two = ({r.cell_id: r.value for r in augment.agf(graph.spatial_weights(make_cells(spark, p), 1, 4), values).collect()} for p in (xy, turn))
    assert all(abs(one[i] - two[i]) < 1e-9 for i in one)


def test_zero_distance_and_zero_variance(spark):
    c = make_cells(spark, [(0, 0), (0, 0), (0, 0)])
    assert {r.w for r in graph.with_decay(graph.knn_graph(c, 2), "reciprocal", 2).collect()} == {None}
    flat = c.select("cell_id", F.lit(0).alias("gene_id"), F.lit(2.0).alias("value"))
    assert {r.value for r in augment.zscore(flat, 3).collect()} == {0.0}
    assert abs(sum(v * v for v in augment.block_scales(0.2, 2).values()) - 1) < 1e-12


def test_golden_labels(spark):
    one, two = ([1, 1, 1, 1, 2, 2, 2, 3, 3, 3, 3], [2, 2, 2, 1, 1, 1, 1, 5, 5, 5, 3])
    a, b = (spark.createDataFrame(list(enumerate(x)), "cell_id long, label int") for x in (one, two))
    assert {(r.a, r.b): r.n for r in lab.contingency(a, b).collect()} == {(1, 1): 1, (1, 2): 3, (2, 1): 3, (3, 3): 1, (3, 5): 3}
    assert lab.ari(a, a).first().ari == pytest.approx(1)
    assert lab.mcc(a, a).first().mcc == pytest.approx(1)
    assert lab.ami(a, a) == pytest.approx(1)
    m = lab.matching(a, b)
    assert (m[2], m[1], m[5]) == (1, 2, 3) and m[3] not in (1, 2, 3)
    assert lab.ari(a, lab.matched(a, b)).first().ari == pytest.approx(lab.ari(a, b).first().ari)
    out = lab.matched_series([a, b])
    assert lab.ari(out[0], a).first().ari == pytest.approx(1)
    assert lab.matched_series([a, b], least_first=False)[1].count() == 11
    assert lab.expanded_ids([3, 7, 8], 9) == {3: 0, 7: 6, 8: 9} and lab.expanded_ids([0, 1, 5, 9], 12) == {0: 0, 1: 2, 5: 7, 9: 12} and lab.expanded_ids([4], 9) == {4: 0}


def test_assignment_against_all_permutations():
    rng = np.random.default_rng(1)
    for _ in range(30):
        n, m = rng.integers(1, 5, 2)
        gain = rng.integers(0, 9, (n, m)).astype(float)
        got = sum(gain[i, j] for i, j in lab.assignment(gain))
        small, large = sorted((int(n), int(m)))
        g = gain if n <= m else gain.T
        assert got == max(sum(g[i, p[i]] for i in range(small)) for p in itertools.permutations(range(large), small))


def test_refinement(spark):
    c = make_cells(spark, [(i % 6, i // 6) for i in range(36)])
    e = graph.knn_graph(c, 6)
    same = c.select("cell_id", F.lit(3).alias("label"))
    out, entropy, n = lab.refined(same, e, "auto")
    assert {r.label for r in out.collect()} == {3} and entropy == 0 and n == 1
    odd = same.withColumn("label", F.when(F.col("cell_id") == 14, 1).otherwise(F.col("label")))
    assert {r.label for r in lab.refined_once(odd, e)[0].collect()} == {3}
    assert lab.refined_once(odd, e, percentile=0.5)[0].count() == 36
    # two neighbours are left, both of another label: two votes of three are enough
    three = spark.createDataFrame([(0, 1), (1, 2), (2, 2), (3, 1)], "cell_id long, label int")
    few = spark.createDataFrame([(0, 1, 1.0), (0, 2, 1.0), (0, 3, 9.0)], "src long, dst long, dist double")
    assert {r.cell_id: r.label for r in lab.refined_once(three, few, percentile=0.9)[0].collect()} == {0: 2, 1: 2, 2: 2, 3: 1}


def planted(rng, groups=4, each=30, inside=0.5, outside=0.01):
    n = groups * each
    return n, [(i, j) for i in range(n) for j in range(i + 1, n) if rng.random() < (inside if i // each == j // each else outside)]


def test_communities_are_recovered(spark):
    n, pairs = planted(np.random.default_rng(2))
    src, dst = np.array(pairs).T
    truth = np.arange(n) // 30
    cells = spark.range(n + 3).select(F.col("id").alias("cell_id"))  # the last three are alone
    edges = spark.createDataFrame([(int(a), int(b), 1.0) for a, b in pairs], "src long, dst long, w double")
    labels = cluster.leiden(cells, edges, 1.0)
    got = {r.cell_id: r.label for r in labels.collect()}
    assert len(got) == n + 3 and [got[n + i] for i in range(3)] == [4, 5, 6]
    assert len(set(zip(truth, [got[i] for i in range(n)]))) == 4
    assert lab.modularity(labels.where(f"cell_id < {n}"), edges).first().modularity == pytest.approx(cluster.quality(src, dst, np.ones(len(src)), truth))
    resolution, labels = cluster.find_resolution(cells.where(f"cell_id < {n}"), edges, 4)
    assert labels.select("label").distinct().count() == 4


def test_labels_are_the_same_in_one_task_and_over_tables(spark, monkeypatch):
    rng = np.random.default_rng(8)
    n, pairs = planted(rng, 3, 6, 0.7, 0.05)
    name = lambda i: i * 10**10 - 5
    cells = spark.createDataFrame([(name(i),) for i in range(n + 1)], "cell_id long")
    edges = spark.createDataFrame([(name(a), name(b), float(rng.random() + 0.5)) for a, b in pairs], "src long, dst long, w double")
    for name_, most in (("PASSES", 1), ("MOVES", 3), ("REFINES", 2)):
        monkeypatch.setattr(cluster, name_, most)
    one = {tuple(r) for r in cluster.leiden(cells, edges, 0.8).collect()}
    monkeypatch.setattr(cluster, "TASK_EDGES", 0)
    assert {tuple(r) for r in cluster.leiden(cells, edges, 0.8).collect()} == one
    assert len(one) == n + 1 and len({x for _, x in one}) >= 4


def test_cells_without_edges_keep_apart(spark):
    cells = spark.range(6).select(F.col("id").alias("cell_id"))
    edges = spark.createDataFrame([(2, 3, 1.0), (4, 5, 1.0)], "src long, dst long, w double")
    assert {r.cell_id: r.label for r in cluster.leiden(cells, edges).collect()} == {2: 0, 3: 0, 4: 1, 5: 1, 0: 2, 1: 3}
    assert {r.cell_id: r.label for r in cluster.leiden(cells, edges.limit(0)).collect()} == {i: i for i in range(6)}


def test_moments_of_large_means_and_sparse_rows(spark):
    x = np.array([0.0, 0.25, 0.5, 1.0]) + 1e9
    expr = spark.createDataFrame([(i, 0, float(v)) for i, v in enumerate(x)] + [(0, 1, 3.0), (1, 1, 5.0)], "cell_id long, gene_id int, value double")
    got = {r.gene_id: r for r in augment.feature_moments(expr, 4).collect()}
    assert got[0].std == pytest.approx(np.std([0, 0.25, 0.5, 1.0]), rel=1e-6)
    assert (got[1].mean, got[1].std) == (pytest.approx(2.0), pytest.approx(np.std([3, 5, 0, 0])))


def test_kept_tables_are_dropped(spark):
    """All that was kept goes at once; what is kept afterwards is there."""
    df = _scale.kept(spark.range(3))
    folder = df.inputFiles()[0].removeprefix("file:").rsplit("/", 2)[0]
    assert os.path.isdir(folder)
    _scale.drop_kept(spark)
    assert not os.path.exists(folder) and _scale.kept(spark.range(2)).count() == 2


def test_running_sums(spark):
    df = spark.createDataFrame([(i * 7919 % 1000, i) for i in range(1000)], "a int, v int")
    got = {r.a: r.before for r in running(df.repartition(5), [F.desc("a")], "v").collect()}
    values = {i * 7919 % 1000: i for i in range(1000)}
    assert got == {a: sum(v for b, v in values.items() if b > a) for a in values}
    assert running(df.limit(0), ["a"], "v").count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_knn_with_outliers_and_crowds(spark, monkeypatch, seed):
    monkeypatch.setattr(spatial_index, "LEAF", 12)
    monkeypatch.setattr(spatial_index, "FANOUT", 3)
    monkeypatch.setattr(spatial_index, "QUERIES", 20)
    rng = np.random.default_rng(seed)
    xy = np.concatenate((rng.random((700, 2)), [(1e4, 1e4), (-1e4, 3.0)], rng.normal(5, 1e-3, (200, 2)), np.stack((np.linspace(0, 50, 60), np.full(60, 7.0)), axis=1)))
    assert edges_of(graph.knn_graph(make_cells(spark, xy), 6)) == brute(xy.tolist(), 6)


def test_shared_neighbours_against_matrix(spark):
    xy = np.random.default_rng(7).random((40, 2))
    e = graph.knn_graph(make_cells(spark, xy), 5)
    a = np.zeros((40, 40))
    for i, j in edges_of(e):
        a[i, j] = 1
    s = a @ a.T
    assert all(r.n == s[r.src, r.dst] for r in cluster.shared_counts(e).collect())


def test_an_edge_stays_one_row_until_it_is_told(spark):
    """Neither shared neighbours nor neighbours' means move a row for each pair of an edge and a neighbour, or a value."""
    edges = spark.createDataFrame([(0, 1, 0.5), (0, 2, 0.25), (1, 0, 1.0), (1, 2, 1.0), (2, 9, 1.0)], "src long, dst long, w double")
    expr = spark.createDataFrame([(i, g, float(10 * i + g)) for i in range(3) for g in range(4) if (i, g) != (2, 3)], "cell_id long, gene_id int, value double")
    shared, mean = cluster.shared_graph(edges, False), augment.neighbour_mean(edges, expr)
    assert {(r.src, r.dst): r.n for r in cluster.shared_counts(edges).collect()} == {(0, 1): 1, (0, 2): 0, (1, 0): 1, (1, 2): 0, (2, 9): 0}
    assert {tuple(r) for r in shared.collect()} == {(0, 1, 0.5), (1, 0, 1.0)}
    got = {(r.cell_id, r.gene_id): r.value for r in mean.collect()}
    assert got == {**{(0, g): 0.5 * (10 + g) + (0.25 * (20 + g) if g < 3 else 0.0) for g in range(4)}, **{(1, g): g + (20.0 + g if g < 3 else 0.0) for g in range(4)}}
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert plan(shared).count("Join") == 2 and "LeftSemi" not in plan(shared)
    assert "RepartitionByExpression [src" in plan(mean)


def test_components_and_mixture(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 5)) @ np.diag([5, 3, 1, 0.5, 0.1]) + 7
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "cell_id long, features array<double>")
    z = np.array([r.pc for r in red.pca(df, 2).orderBy("cell_id").collect()])
    c = x - x.mean(axis=0)
    v = np.linalg.svd(c, full_matrices=False)[2][:2].T
    v *= np.sign(v[np.abs(v).argmax(axis=0), [0, 1]])
    assert np.allclose(z, c @ v, atol=1e-8)
    ratio = red.fit_pca(df, 5)[2]
    assert red.fit_pca(df, 0.9)[1].shape[1] == int(np.searchsorted(np.cumsum(ratio), 0.9, side="right")) + 1
    assert abs(red.remaining_variance(ratio)[-1]) < 1e-9
    assert np.allclose(red.singular_values(df), np.linalg.svd(c, compute_uv=False))
    # uncorrelated columns: a permutation's top singular value is near the longest column's
    far = spark.createDataFrame([(i, (r + 5).tolist()) for i, r in enumerate(rng.normal(size=(200, 3)))], "cell_id long, features array<double>")
    assert 13 < red.noise_floor(far, 3, together=2) < 18 and red.noise_floor(df, 2, "median") < 1.05 * red.singular_values(df)[0]
    one = df.select("cell_id", F.slice("features", 1, 1).alias("features"))
    assert red.noise_floor(one, 1) == pytest.approx(np.linalg.norm(c[:, 0]))
    two = np.concatenate((rng.normal(0, 1, (60, 2)), rng.normal(12, 1, (40, 2))))
    e = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(two)], "cell_id long, pc array<double>")
    got = {r.cell_id: r.label for r in cluster.gaussian_mixture(e, 2).collect()}
    assert [got[i] for i in range(100)] == [0] * 60 + [1] * 40


def test_quality_control(spark):
    cells = spark.range(3).select(F.col("id").alias("cell_id"))
    genes = spark.createDataFrame([(0, "A"), (1, "MT-B"), (2, "A")], "gene_id int, gene_name string")
    expr = spark.createDataFrame([(0, 0, 9.0), (0, 1, 1.0), (1, 0, 5.0)], "cell_id long, gene_id int, value double")
    got = {r.cell_id: r for r in qc.qc_cells(cells, genes, expr, (1,)).collect()}
    assert (got[0].total_counts, got[0].pct_counts_mt, got[0].pct_counts_in_top_1, got[2].total_counts) == (10, 10, 90, 0)
    assert [r.gene_name for r in qc.unique_names(genes).orderBy("gene_id").collect()] == ["A", "MT-B", "A-1"]
    assert qc.filter_cells(cells, genes, expr, 5, 20, 50, 2).count() == 2
    assert {r.value for r in augment.dense(cells, genes.where("gene_id = 2"), expr).collect()} == {0.0}
    assert {r.s for r in qc.normalize_total(expr).groupBy("cell_id").agg(F.sum("value").alias("s")).collect()} == {7.5}
    with pytest.raises(ValueError):
        qc.highly_variable(genes, expr, 3, 1, "other")
    both = qc.concatenated_samples({"p": cells, "q": cells.withColumn("extra", F.lit(1))})
    assert both.count() == 6 and both.where("extra is null").count() == 3
    assert [r.v for r in qc.mapped(spark.createDataFrame([("a",), ("b",)], "v string"), "v", {"a": "x"}, "other").collect()] == ["x", "other"]


def test_statistics(spark):
    rng = np.random.default_rng(5)
    x, g = rng.integers(0, 4, 50).astype(float), rng.integers(0, 2, 50)
    labels = spark.createDataFrame([(i, int(v)) for i, v in enumerate(g)], "cell_id long, label int")
    expr = spark.createDataFrame([(i, 0, float(v)) for i, v in enumerate(x)], "cell_id long, gene_id int, value double")
    ranks = np.array([(x < v).sum() + ((x == v).sum() + 1) / 2 for v in x])
    n1 = (g == 1).sum()
    z = (ranks[g == 1].sum() - n1 * 51 / 2) / math.sqrt(n1 * (50 - n1) * 51 / 12)
    got = {r.label: r.u_z for r in stats.wilcoxon(labels, expr).collect()}
    assert got[1] == pytest.approx(z)
    r = {r.label: r.r for r in stats.point_biserial(labels, expr.select("cell_id", "value")).collect()}
    assert r[1] == pytest.approx(np.corrcoef(g == 1, x)[0, 1])
    assert stats.t_p_value(2.228139, 10) == pytest.approx(0.05, abs=1e-6) and stats.t_p_value(0, 5) == 1
    assert [m[:2] for m in stats.dendrogram(np.array([[1, 2, 3.0], [1, 2, 3.1], [3, 1, 0]]))] == [(0, 1), (2, 3)]
    assert stats.top_genes(stats.wilcoxon(labels, expr), 1).count() == 2


def plain_harmony(z, b, y, rounds, steps, sigma=0.1, theta=2.0, ridge=1.0):
    """harmonised() from given centres, cell by cell in one matrix."""
    raw, z, n = z, z.copy(), len(z)
    phi = np.eye(b.max() + 1)[b]
    pen = np.zeros((len(y), phi.shape[1]))
    for _ in range(rounds):
        unit = z / np.linalg.norm(z, axis=1, keepdims=True)

        def share():
            w = np.exp(-2 * (1 - unit @ y.T) / sigma) * np.exp(pen)[:, b].T
            return w / w.sum(axis=1, keepdims=True)

        for _ in range(steps):
            r = share()
            y = r.T @ unit
            y /= np.linalg.norm(y, axis=1, keepdims=True)
            o = r.T @ phi
            pen = theta * np.log((np.outer(o.sum(axis=1), phi.mean(axis=0)) + 1) / (o + 1))
        r, x = share(), np.concatenate((np.ones((n, 1)), phi), axis=1)
        z = raw.copy()
        for k in range(len(y)):
            w = np.linalg.lstsq((x * r[:, [k]]).T @ x + np.diag([0] + [ridge] * phi.shape[1]), (x * r[:, [k]]).T @ raw, rcond=None)[0]
            z -= r[:, [k]] * (phi @ w[1:])
    return z


def test_harmony(spark):
    rng = np.random.default_rng(9)
    group, b = rng.integers(0, 3, 240), rng.integers(0, 2, 240)
    x = np.array([[6, 0, 0], [0, 6, 0], [0, 0, 6.0]])[group] + rng.normal(0, 0.4, (240, 3)) + b[:, None] * np.array([1.5, 1.0, -0.5])
    e = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "cell_id long, pc array<double>").repartition(3)
    batch = spark.createDataFrame([(i, "pq"[k]) for i, k in enumerate(b.tolist())], "cell_id long, batch string")
    s = red.Harmony(clusters=3, rounds=2, steps=2, tol=0.0)
    got = np.array([r.pc for r in red.harmonised(e, batch, s).orderBy("cell_id").collect()])
    gap = lambda z: max(np.linalg.norm(z[(group == g) & (b == 0)].mean(axis=0) - z[(group == g) & (b == 1)].mean(axis=0)) for g in range(3))
    assert gap(x) > 1.5 and gap(got) < 0.25 * gap(x)
    # the same centres as the operator draws: by the hash order of the cells
    order = [r.cell_id for r in e.orderBy(F.xxhash64("cell_id", F.lit(0)), "cell_id").collect()]
    unit = x[order] / np.linalg.norm(x[order], axis=1, keepdims=True)
    draw = np.random.default_rng(0)
    y = unit[[draw.integers(240)]]
    while len(y) < 3:
        d = np.maximum(1 - (unit @ y.T).max(axis=1), 0)
        y = np.concatenate((y, unit[[draw.choice(240, p=d / d.sum())]]))
    assert np.allclose(got, plain_harmony(x, b, y, 2, 2), atol=1e-8)
    alone = np.array([r.pc for r in red.harmonised(e, batch.withColumn("batch", F.lit(None).cast("string")), s).orderBy("cell_id").collect()])
    assert np.allclose(alone, x, atol=1e-8) and red.harmonised(e.limit(0), batch).count() == 0


def test_views_of_results(spark):
    assert plans.pca_dims(["reduced_pc_20", "reduced_pc_0.95", "reduced_pc_20_umap", "coord_xy"]) == [20, 0.95]
    rows = [(i, i % 2, d, l, 20, 0.7) for i in range(4) for d, l in (("scaled_gaussian", 0.2), ("nonspatial", 0.0))]
    stack = spark.createDataFrame(rows, "cell_id long, label int, decay string, lambda_param double, num_pcs int, resolution double")
    one, two = plans.spatial_and_nonspatial(stack, 20, 0.2, 0.7, {0: "a", 1: "b"}, {0: "c"})
    assert {r.cell_type for r in one.collect()} == {"a", "b"} and {r.cell_type for r in two.collect()} == {"c", None}
    with pytest.raises(KeyError):
        plans.looked_up(stack, "uniform", 0.2, 20, 0.7)
    told = spark.createDataFrame([(0, 0, 3.0), (0, 1, 40.0), (0, 2, None)], "label int, gene_id int, u_z double")
    got = [r.minus_log10_p for r in stats.volcano(told).orderBy("gene_id").collect()]
    assert got[0] == pytest.approx(-math.log10(math.erfc(3 / math.sqrt(2)))) and got[1] == pytest.approx(349.4370 - math.log10(2), abs=1e-3) and got[2] is None  # both sides
    a, b = (spark.createDataFrame(list(enumerate(x)), "cell_id long, label int") for x in ([0, 0, 1, 1], [0, 5, 1, 7]))
    m = lab.matching(a, b, "random", 3)
    assert len(set(m.values())) == 4 and set(m.values()) <= set(range(8)) and m == lab.matching(a, b, "random", 3)
    with pytest.raises(ValueError):
        lab.matching(a, b, "other")
    assert graph.labels_to_onehot(b.where("label <> 5"), gaps=False).count() == 3


def test_sources(spark, tmp_path):
    (tmp_path / "m.csv").write_text("gene,c1,c2\nG2,1,0\nG1,0,2.5\n")
    (tmp_path / "l.csv").write_text("id,xcoord,ycoord\nc1,1,2\nc2,3,4\n")
    cells, genes, expr = sources.load(spark, str(tmp_path / "m.csv"), str(tmp_path / "l.csv"))
    names = {r.cell_id: r.cell_name for r in cells.collect()}
    gene = {r.gene_id: r.gene_name for r in genes.collect()}
    assert {(names[r.cell_id], gene[r.gene_id], r.value) for r in expr.collect()} == {("c1", "G2", 1.0), ("c2", "G1", 2.5)}
    with pytest.raises(ValueError):
        sources.load(spark)
    (tmp_path / "w.mtx").write_text("%%MatrixMarket matrix coordinate real general\n% note\n3 2 2\n1 1 0.5\n3 2 1.5\n")
    assert {tuple(r) for r in sources.read_matrix_market(spark, str(tmp_path / "w.mtx")).collect()} == {(0, 0, 0.5), (2, 1, 1.5)}
    wide = spark.createDataFrame([(1, 2.0, 3.0, "r")], "id long, m1 double, m2 double, region string")
    obs, features, values = sources.split_wide(wide, 2, "id")
    assert obs.columns == ["id", "region"] and features.count() == 2 and values.count() == 2
    sources.write(values, str(tmp_path / "out.csv"), "csv")
    assert spark.read.csv(str(tmp_path / "out.csv"), header=True).count() == 2


def test_whole_analysis(spark):
    rng = np.random.default_rng(6)
    xy = np.concatenate((rng.normal(0, 1, (60, 2)), rng.normal(9, 1, (60, 2))))
    cells = make_cells(spark, xy)
    values = [(i, g, float(rng.normal() + 6 * ((i >= 60) == (g % 2)))) for i in range(120) for g in range(4)]
    expr = spark.createDataFrame(values, "cell_id long, gene_id int, value double")
    truth = cells.select("cell_id", (F.col("cell_id") >= 60).cast("int").alias("label"))
    s = plans.Settings(pcs=(3,), resolutions=(0.2,), k=5, feature_neighbours=20, refine="once", match=True)
    results, labels = plans.run(cells, expr, s, truth)
    rows = results.collect()
    assert len(rows) == 2 and max(r.ari for r in rows) > 0.9 and plans.stacked(labels).count() == 240
    with pytest.raises(ValueError):
        plans.run(cells, expr, plans.Settings(resolutions=None))
    balanced = plans.augmented(cells, expr, 0.2, 5, variance_balance=True)
    assert balanced.count() == 120 * 12


def test_feature_knn_takes_the_smallest_ids_of_equal_cells(spark):
    rng = np.random.default_rng(6)
    far = 1e6 + 1e-4 * rng.random((150, 3))  # a tight group far from the origin
    points = np.concatenate((np.tile([1.0, 2.0, 3.0], (300, 1)), far))
    ids = rng.permutation(len(points))
    e = spark.createDataFrame([(int(i), [float(x) for x in p]) for i, p in zip(ids, points)], "cell_id long, pc array<double>")
    got = {}
    for r in cluster.feature_knn(e, 5).collect():
        got.setdefault(r.src, {})[r.rk] = r.dst
    for i, p in zip(ids.tolist(), points):
        d = np.sqrt(((p - points) ** 2).sum(axis=1))
        d[ids == i] = np.inf
        assert [got[i][k] for k in range(1, 6)] == ids[np.lexsort((ids, d))[:5]].tolist()
