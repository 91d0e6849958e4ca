"""Leiden over parts: the labels are those of one task, whatever the number of parts, hubs and crowded communities included."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.operators import cluster, spread_graph


def planted(seed=8, groups=4, each=12, inside=0.6, outside=0.03):
    rng = np.random.default_rng(seed)
    n = groups * each
    pairs = [(i, j) for i in range(n) for j in range(i + 1, n) if rng.random() < (inside if i // each == j // each else outside)]
    return np.arange(n), pairs, rng.random(len(pairs)) + 0.5


def both(spark, name, pairs, weights, resolution, *parts):
    """Communities found in one task, and in parts, as whole numbers' weights ask for; here, where limits can be set."""
    ids, place = np.unique(np.array(pairs), return_inverse=True)
    src, dst = place.reshape(-1, 2).T
    w = np.round(np.array(weights) * 1000).astype(np.int64)
    edges = spark.createDataFrame([(int(name[a]), int(name[b]), int(x)) for (a, b), x in zip(pairs, w)], "src long, dst long, w long").persist()
    found = cluster.communities(cluster.LocalGraph(name[ids], src, dst, w, resolution, 7))
    one = dict(zip(name[ids].tolist(), found.tolist()))
    spread = [{r.id: r.c for r in cluster.communities(spread_graph.SpreadGraph(edges, resolution, 7, p)).collect()} for p in parts]
    edges.unpersist()
    return one, spread


@pytest.mark.parametrize("hub, parts", [(2**16, (4,)), (6, (1, 16))])
def test_labels_hang_on_no_number_of_parts(spark, monkeypatch, hub, parts):
    monkeypatch.setattr(spread_graph, "HUB", hub)
    monkeypatch.setattr(cluster, "PASSES", 1)
    n, pairs, w = planted(8, 4, 9)
    one, spread = both(spark, n * 10**10 - 5, pairs, w, 0.9, *parts)
    assert all(x == one for x in spread) and 3 <= len(set(one.values())) < len(n)


def test_stops_of_rounds_fall_where_they_do_in_one_task(spark, monkeypatch):
    for name, most in (("PASSES", 2), ("MOVES", 5), ("REFINES", 1)):
        monkeypatch.setattr(cluster, name, most)
    n, pairs, w = planted(3, 3, 8)
    one, spread = both(spark, n, pairs, w, 1.1, 4)
    assert spread == [one]


def test_star_and_community_of_all(spark, monkeypatch):
    """A third of all edges on one node, and a resolution at which everything is one community."""
    monkeypatch.setattr(spread_graph, "HUB", 10)
    monkeypatch.setattr(cluster, "PASSES", 1)
    pairs = [(0, i) for i in range(1, 41)] + [(i, i + 1) for i in range(1, 40)] + [(i, i + 2) for i in range(1, 39)] + [(42, 0), (42, 43)]
    one, spread = both(spark, np.arange(44), pairs, np.ones(len(pairs)), 0.0, 5)
    assert spread == [one] and len(set(one.values())) == 1


def test_hub_edges_stay_with_its_neighbours(spark, monkeypatch):
    monkeypatch.setattr(spread_graph, "HUB", 50)
    pairs = [(0, i) for i in range(1, 401)]
    edges = spark.createDataFrame([(a, b, 1) for a, b in pairs], "src long, dst long, w long")
    g = spread_graph.SpreadGraph(edges, 1.0, 1, parts=8)
    g.begin()
    held = [len(r.w) // 8 for r in g.packed.collect()]
    assert sum(held) == 400 and max(held) < 100  # each edge once, with the plain end
    said = g._round(None, None, 0, False)
    assert max(r.n for r in said.groupBy("part").agg(F.sum(F.length("a")).alias("n")).collect()) < 8 * 8 * 400


def test_planted_communities_are_as_good_as_the_truth(spark, monkeypatch):
    monkeypatch.setattr(cluster, "PASSES", 1)
    n, pairs, _ = planted(5, 5, 20, 0.5, 0.01)
    cells = spark.createDataFrame([(int(i),) for i in range(len(n) + 1)], "cell_id long")  # one more, without edges
    edges = spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "src long, dst long, w double")
    got = {r.cell_id: r.label for r in cluster.leiden(cells, edges, 1.0, parts=4).collect()}
    src, dst = np.array(pairs).T
    best = cluster.quality(src, dst, np.ones(len(src)), n // 20)
    assert cluster.quality(src, dst, np.ones(len(src)), np.array([got[i] for i in n])) >= 0.99 * best
    assert got[len(n)] == max(got.values())


def test_parts_and_coins_are_those_of_the_columns(spark):
    ids = np.array([0, 1, -5, 2**40, 2**62, -(2**63)])
    df = spark.createDataFrame([(int(i),) for i in ids], "id long")
    assert [x[0] for x in df.select(F.pmod(F.xxhash64("id"), F.lit(7)).cast("int")).collect()] == spread_graph.part_of(ids, 7).tolist()
    for r in (0, 3, -4):
        column = F.xxhash64(F.lit(1234).cast("long"), F.lit(r).cast("long"), F.col("id")).bitwiseAND(F.lit(1)) == 0
        assert [x[0] for x in df.select(column).collect()] == spread_graph.coin(1234, r, ids).tolist()


def test_rounds_judge_few_nodes_again(spark):
    """Who keeps to a community and has no neighbour that moved isn't judged again."""
    n, pairs, w = planted(11, 40, 25, 0.4, 0.002)
    src, dst = np.array(pairs).T
    judged = []

    class Counted(cluster.LocalGraph):
        def _judge(self, nodes, *rest):
            judged.append((len(nodes), len(self.ids)))
            super()._judge(nodes, *rest)

    cluster.communities(Counted(n, src, dst, np.round(w * 1000).astype(np.int64), 1.0, 7))
    assert sum(a for a, _ in judged) < 0.5 * sum(b for _, b in judged)
