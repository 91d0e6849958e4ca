"""Neighbourhood features: weighted means, azimuthal gradients, scaling and concatenation.

expr(cell_id, gene_id, value) is long and sparse: an absent row is 0. Means divide by neighbours or cells, never by rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._scale import kept


def dense(cells: DataFrame, genes: DataFrame, expr: DataFrame) -> DataFrame:
    """expr with all its zeros. Fails on NaN and infinity."""
    grid = cells.select("cell_id").join(F.broadcast(genes.select("gene_id").distinct()))
    value = F.coalesce("value", F.lit(0.0))
    sound = F.assert_true(~F.isnan(value) & (F.abs(value) != float("inf")), "values must be finite")
    return grid.join(expr, ["cell_id", "gene_id"], "left").select("cell_id", "gene_id", value.alias("value")).where(sound.isNull())


def _told(edges: DataFrame, expr: DataFrame) -> DataFrame:
    """Edges with the values of dst, a row a value, dealt by src. A cell's values go round in one row, so that an edge is one row until it is there."""
    packed = expr.groupBy(F.col("cell_id").alias("dst")).agg(F.collect_list(F.struct("gene_id", "value")).alias("__x"))
    told = edges.join(packed, "dst").drop("dst").repartition("src").withColumn("__x", F.explode("__x"))
    return told.select("*", "__x.gene_id", "__x.value").drop("__x")


def neighbour_mean(edges: DataFrame, expr: DataFrame) -> DataFrame:
    """The weighted sum of the neighbours' values: W X, summed where a cell's edges are."""
    told = _told(edges.select("src", "dst", "w"), expr)
    return told.groupBy("src", "gene_id").agg(F.sum(F.col("w") * F.col("value")).alias("value")).withColumnRenamed("src", "cell_id")


def agf(edges: DataFrame, expr: DataFrame, center: bool = True) -> DataFrame:
    """Magnitude of sum_j w_ij exp(i m theta_ij) x_j; with center of x_j less the neighbours' plain mean.

    Centring is one pass: sum_j w (x - mean) = sum_j w x - mean sum_j w, with the mean over all neighbours, rows or not.
    """
    sums = _told(edges.select("src", "dst", "w_re", "w_im"), expr).groupBy("src", "gene_id").agg(
        F.sum(F.col("w_re") * F.col("value")).alias("re"), F.sum(F.col("w_im") * F.col("value")).alias("im"), F.sum("value").alias("total")
    )
    if center:
        row = edges.groupBy("src").agg(F.sum("w_re").alias("s_re"), F.sum("w_im").alias("s_im"), F.count("*").alias("n"))
        mean = F.col("total") / F.col("n")
        sums = sums.join(row, "src").withColumn("re", F.col("re") - mean * F.col("s_re")).withColumn("im", F.col("im") - mean * F.col("s_im"))
    return sums.select(F.col("src").alias("cell_id"), "gene_id", F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("value"))


def feature_moments(expr: DataFrame, n_cells: int, by: tuple[str, ...] = ("gene_id",)) -> DataFrame:
    """Mean and population standard deviation of each feature over all n_cells cells."""
    m = expr.groupBy(*by).agg(F.avg("value").alias("a"), F.var_pop("value").alias("v"), (F.count("value") / float(n_cells)).alias("p"))
    # cells without a row are zeros: their share 1 - p lies apart from the mean of the others; no square of a mean is taken off
    return m.select(*by, (F.col("p") * F.col("a")).alias("mean"), F.sqrt(F.greatest(F.col("p") * (F.col("v") + (1 - F.col("p")) * F.col("a") * F.col("a")), F.lit(0.0))).alias("std"))


def zscore(expr: DataFrame, n_cells: int, by: tuple[str, ...] = ("gene_id",)) -> DataFrame:
    """Population z-scores of a dense expr; a feature without variance is 0. Features are few, so moments go by broadcast."""
    m = kept(feature_moments(expr, n_cells, by))  # worked out once, for their number and their use
    m = F.broadcast(m) if m.limit(100_001).count() <= 100_000 else m
    z = F.coalesce(F.try_divide(F.col("value") - F.col("mean"), F.when(F.col("std") > 1e-12, F.col("std"))), F.lit(0.0))
    return expr.join(m, list(by)).withColumn("value", z).drop("mean", "std")


def block_scales(lam: float, max_m: int) -> dict[int, float]:
    """Factors of the blocks: -1 is the cell's own, k the neighbourhood of order k; their squares add up to 1."""
    total = sum(2.0 ** -(j + 1) for j in range(max_m + 1))
    return {-1: math.sqrt(1 - lam), **{k: math.sqrt(lam * 2.0 ** -(k + 1) / total) for k in range(max_m + 1)}}


def concatenated(blocks: dict[int, DataFrame], lam: float, n_cells: int) -> DataFrame:
    """(cell_id, gene_id, k, is_nbr, value): each dense block z-scored and scaled; k = -1 is the cell's own."""
    scales = block_scales(lam, max([*blocks, 0]))
    if set(blocks) == {-1}:
        scales[-1] = 1.0
    out = None
    for k, block in blocks.items():
        part = zscore(block, n_cells).select("cell_id", "gene_id", F.lit(k).alias("k"), F.lit(k >= 0).alias("is_nbr"), (F.col("value") * scales[k]).alias("value"))
        out = part if out is None else out.unionByName(part)
    return out


def weighted_concatenate(own: DataFrame, nbr: DataFrame, lam: float) -> DataFrame:
    """sqrt(1 - lam) of the cell's own values beside sqrt(lam) of the neighbours', as they are."""
    return own.select("cell_id", "gene_id", F.lit(False).alias("is_nbr"), (F.col("value") * math.sqrt(1 - lam)).alias("value")).unionByName(
        nbr.select("cell_id", "gene_id", F.lit(True).alias("is_nbr"), (F.col("value") * math.sqrt(lam)).alias("value"))
    )


def feature_names(genes: DataFrame, max_m: int) -> DataFrame:
    """(gene_id, k, is_nbr, feature): names of an augmented matrix's columns."""
    ks = F.explode(F.sequence(F.lit(-1), F.lit(max_m)))
    return genes.withColumn("k", ks).select("gene_id", "k", (F.col("k") >= 0).alias("is_nbr"), F.when(F.col("k") < 0, F.col("gene_name")).otherwise(F.concat_ws("_nbr_", "gene_name", F.col("k").cast("string"))).alias("feature"))


def self_features(augmented: DataFrame) -> DataFrame:
    return augmented.where(~F.col("is_nbr"))


def wide(augmented: DataFrame) -> DataFrame:
    """(cell_id, features array<double>) in order of block and gene."""
    pairs = F.array_sort(F.collect_list(F.struct("k", "gene_id", "value")))
    return augmented.groupBy("cell_id").agg(F.transform(pairs, lambda s: s["value"]).alias("features"))


def balance_factor(own: float, nbr: float) -> float:
    """The factor that gives a neighbour block, whose leading directions have variance nbr, the cell's own."""
    return math.sqrt(own / nbr) if nbr > 0 else 1.0
