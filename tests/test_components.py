"""Components: as by search, whatever the parts, chunks and signs; Leiden at resolution 0 deals out no edges."""

import numpy as np
from pyspark.sql import functions as F

from lattica.operators import cluster, components as comp


def by_search(pairs):
    near, out = {}, {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    for a in sorted(near):
        todo = [a] if a not in out else []
        while todo:
            x = todo.pop()
            if x not in out:
                out[x] = a
                todo += near[x]
    return out


def test_components_are_those_of_a_search(spark, monkeypatch):
    monkeypatch.setattr(comp, "CHUNK", 7)
    rng = np.random.default_rng(2)
    pairs = [(int(a) * 10**12 - 5, int(b) * 10**12 - 5) for a, b in rng.integers(0, 150, (110, 2))] + [(i, i + 1) for i in range(20, 60)]
    rows = [(a, b, 1.0) for a, b in pairs] + [(7, 8, 2.0), (8, 7, -1.0), (9, 7, 1.0), (7, 9, -1.0), (1, 2, 0.0), (3, 4, None)]
    found = {r.node: r.component for r in comp.components(spark.createDataFrame(rows, "src long, dst long, w double").repartition(5)).collect()}
    assert found == by_search([p for p in pairs if p[0] != p[1]] + [(7, 8)])


def test_leiden_at_resolution_0_deals_out_no_edges(spark, monkeypatch):
    """10,000 edges of 100 nodes: a task hands on a forest, and no round of moving runs."""
    monkeypatch.setattr(cluster, "communities", lambda *_: 1 / 0)
    handed = []
    monkeypatch.setattr(comp, "kept", lambda df, kept=comp.kept: handed.append(out := kept(df)) or out)
    n = spark.range(100).select(F.col("id").alias("src"))
    edges = n.crossJoin(n.withColumnRenamed("src", "dst")).where("src % 3 = dst % 3").withColumn("w", F.lit(1.0)).repartition(3)
    cells = spark.range(101).withColumnRenamed("id", "cell_id")
    got = {r.cell_id: r.label for r in cluster.leiden(cells, edges, 0.0).collect()}
    assert all(got[i] == i % 3 for i in range(100)) and got[100] == 3
    assert handed[0].count() <= 3 * 100
