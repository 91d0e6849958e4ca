"""Spatially variable genes: how much of a gene's variation is smooth over the neighbour graph.

With the graph's normalised Laplacian L = I - D^(-1/2) A D^(-1/2), whose eigenvalues from 0 to 2 are its frequencies, the smooth share of a centred
gene f is f' exp(-t L) f / f' f: 1 for a constant over each component, near 0 for what changes from cell to neighbour. It comes from a few
Lanczos steps from f, of all genes at once: each is one pass of sums over edges, and leaves two numbers a gene, whose tridiagonal matrix gives the share.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._scale import kept


def smooth_share(expr: DataFrame, edges: DataFrame, t: float = 4.0, steps: int = 10) -> DataFrame:
    """(gene_id, energy, share): f'f of the centred gene, and its smooth part. expr(cell_id, gene_id, value) is dense; edges(src, dst) any way round.

    Two cells are neighbours if either is the other's, once. A cell without neighbours is smooth by itself. A gene that is the same
    everywhere has energy 0 and no share. The table of numbers a gene is small: genes are few beside cells.
    """
    spark = expr.sparkSession
    pair = edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    both = kept(pair.unionByName(pair.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    degree = both.groupBy("a").agg(F.count("*").alias("n"))
    other = degree.select(F.col("a").alias("b"), F.col("n").alias("m"))
    weight = kept(both.join(degree, "a").join(other, "b").select(F.col("a").alias("cell_id"), F.col("b").alias("near"), (1 / F.sqrt(F.col("n") * F.col("m"))).alias("w")))
    linked = degree.select(F.col("a").alias("cell_id"), F.lit(1.0).alias("one"))

    mean = expr.groupBy("gene_id").agg(F.avg("value").alias("mean"))
    f = kept(expr.join(F.broadcast(mean), "gene_id").join(linked, "cell_id", "left").select("cell_id", "gene_id", (F.col("value") - F.col("mean")).alias("q"), F.coalesce("one", F.lit(0.0)).alias("one")))
    energy = {r.gene_id: r.e for r in f.groupBy("gene_id").agg(F.sum(F.col("q") * F.col("q")).alias("e")).collect()}  # a number a gene
    alpha: dict = {g: [] for g in energy}
    beta: dict = {g: [] for g in energy}
    norm = {g: float(np.sqrt(e)) for g, e in energy.items() if e > 1e-20}

    def table(values: dict, name: str) -> DataFrame:
        return F.broadcast(spark.createDataFrame([(g, float(v)) for g, v in values.items()], f"gene_id {dict(expr.dtypes)['gene_id']}, {name} double"))

    state = f.join(table(norm, "b"), "gene_id").select("cell_id", "gene_id", "one", (F.col("q") / F.col("b")).alias("q"), F.lit(0.0).alias("p"))
    for step in range(steps):
        if not norm:
            break
        # L q, less what of it lies in the step before
        near = state.select(F.col("cell_id").alias("near"), "gene_id", "q").join(weight, "near").groupBy("cell_id", "gene_id").agg(F.sum(F.col("w") * F.col("q")).alias("s"))
        back = table({g: beta[g][-1] if beta[g] else 0.0 for g in norm}, "b")
        told = state.join(near, ["cell_id", "gene_id"], "left").join(back, "gene_id")
        u = F.col("one") * F.col("q") - F.coalesce("s", F.lit(0.0)) - F.col("b") * F.col("p")
        told = kept(told.select("cell_id", "gene_id", "one", "q", u.alias("u")))
        for r in told.groupBy("gene_id").agg(F.sum(F.col("q") * F.col("u")).alias("a")).collect():
            alpha[r.gene_id].append(r.a)
        if step + 1 == steps:
            break
        here = table({g: alpha[g][-1] for g in norm}, "a")
        told = told.join(here, "gene_id").select("cell_id", "gene_id", "one", "q", (F.col("u") - F.col("a") * F.col("q")).alias("r"))
        left = {r.gene_id: float(np.sqrt(r.b)) for r in told.groupBy("gene_id").agg(F.sum(F.col("r") * F.col("r")).alias("b")).collect()}
        norm = {g: b for g, b in left.items() if b > 1e-9}  # else the gene's space is used up, and its numbers are exact
        for g, b in norm.items():
            beta[g].append(b)
        if norm:
            state = kept(told.join(table(norm, "b"), "gene_id").select("cell_id", "gene_id", "one", (F.col("r") / F.col("b")).alias("q"), F.col("q").alias("p")))
    rows = []
    for g, e in energy.items():
        share = None
        if alpha[g]:
            off = beta[g][: len(alpha[g]) - 1]
            values, vectors = np.linalg.eigh(np.diag(alpha[g]) + np.diag(off, 1) + np.diag(off, -1))
            share = float((vectors[0] ** 2 * np.exp(-t * values)).sum())
        rows.append((g, float(e), share))
    return spark.createDataFrame(rows, f"gene_id {dict(expr.dtypes)['gene_id']}, energy double, share double")


def spatially_variable(expr: DataFrame, edges: DataFrame, n_top: int, t: float = 4.0, steps: int = 10) -> DataFrame:
    """smooth_share()'s rows with `rank`, the smoothest first (equals by gene_id), and `spatially_variable` for the n_top first."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.orderBy(F.round("share", 10).desc_nulls_last(), "gene_id"))  # over genes, not cells
    return smooth_share(expr, edges, t, steps).withColumn("rank", rank).withColumn("spatially_variable", (F.col("rank") <= n_top) & F.col("share").isNotNull())


def selected(genes: DataFrame, *chosen: DataFrame) -> DataFrame:
    """The genes of any of several choices (gene_id), such as the highly and the spatially variable ones."""
    ids = None
    for c in chosen:
        ids = c.select("gene_id") if ids is None else ids.unionByName(c.select("gene_id"))
    return genes.join(F.broadcast(ids.distinct()), "gene_id", "left_semi")
