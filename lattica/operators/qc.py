"""Quality control, filters, normalisation, feature selection, samples.

expr(cell_id, gene_id, value): absent rows are 0. genes(gene_id, gene_name). cells(cell_id, x, y, sample, ...).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def flag_mt(genes: DataFrame, prefix: str = "MT-") -> DataFrame:
    """Marks mitochondrial genes by their case-sensitive prefix."""
    return genes.withColumn("mt", F.col("gene_name").startswith(prefix))


def unique_names(df: DataFrame, name: str = "gene_name", join: str = "-", order: str = "gene_id") -> DataFrame:
    """Appends -1, -2, ... to the second and later uses of a name."""
    n = F.row_number().over(Window.partitionBy(name).orderBy(order)) - 1
    return df.withColumn("__n", n).withColumn(name, F.when(F.col("__n") > 0, F.concat_ws(join, name, F.col("__n").cast("string"))).otherwise(F.col(name))).drop("__n")


def qc_cells(cells: DataFrame, genes: DataFrame, expr: DataFrame, percent_top: tuple[int, ...] = (50, 100, 200, 500)) -> DataFrame:
    """total_counts, n_genes_by_counts, pct_counts_mt, pct_counts_in_top_N and log1p of the first two, for every cell."""
    marked = expr.join(F.broadcast(flag_mt(genes).select("gene_id", "mt")), "gene_id", "left")
    most = max(percent_top, default=0)
    rank = F.row_number().over(Window.partitionBy("cell_id").orderBy(F.desc("value"), "gene_id"))
    if most:
        marked = marked.withColumn("__r", rank)
    top = [F.sum(F.when(F.col("__r") <= n, F.col("value")).otherwise(0.0)).alias(f"__top{n}") for n in percent_top]
    sums = marked.groupBy("cell_id").agg(F.sum("value").alias("total_counts"), F.count_if(F.col("value") > 0).alias("n_genes_by_counts"), F.sum(F.when(F.col("mt"), F.col("value")).otherwise(0.0)).alias("__mt"), *top)
    pct = lambda c: F.coalesce(F.try_divide(100.0 * F.col(c), F.col("total_counts")), F.lit(0.0))
    out = cells.select("cell_id").join(sums, "cell_id", "left").fillna(0)
    shares = [pct(f"__top{n}").alias(f"pct_counts_in_top_{n}") for n in percent_top]
    return out.select("cell_id", "total_counts", "n_genes_by_counts", pct("__mt").alias("pct_counts_mt"), F.log1p("total_counts").alias("log1p_total_counts"), F.log1p(F.col("n_genes_by_counts").cast("double")).alias("log1p_n_genes_by_counts"), *shares)


def qc_genes(genes: DataFrame, expr: DataFrame, n_cells: int) -> DataFrame:
    """n_cells_by_counts, mean_counts, pct_dropout, total_counts of every gene."""
    sums = expr.groupBy("gene_id").agg(F.count_if(F.col("value") > 0).alias("n_cells_by_counts"), F.sum("value").alias("total_counts"))
    out = genes.select("gene_id").join(sums, "gene_id", "left").fillna(0)
    return out.select("gene_id", "n_cells_by_counts", (F.col("total_counts") / n_cells).alias("mean_counts"), (100.0 * (1 - F.col("n_cells_by_counts") / n_cells)).alias("pct_dropout_by_counts"), "total_counts")


def filter_cells(cells: DataFrame, genes: DataFrame, expr: DataFrame, min_count: float, max_count: float, mt_filter: float, gene_filter: int) -> DataFrame:
    """expr of cells with min <= total <= max and less mitochondrial per cent than mt_filter, then of genes that
    gene_filter or more of those cells have."""
    q = qc_cells(cells, genes, expr, ())
    kept = q.where(F.col("total_counts").between(min_count, max_count) & (F.col("pct_counts_mt") < mt_filter)).select("cell_id")
    left = expr.join(kept, "cell_id", "left_semi")
    seen = left.where("value > 0").groupBy("gene_id").agg(F.count("*").alias("n")).where(F.col("n") >= gene_filter).select("gene_id")
    return left.join(F.broadcast(seen), "gene_id", "left_semi")


def circle_filter(cells: DataFrame, cx: float, cy: float, radius: float) -> DataFrame:
    return cells.where(F.hypot(F.col("x") - cx, F.col("y") - cy) < radius)


def category_filter(cells: DataFrame, column: str, drop: str = "other") -> DataFrame:
    return cells.where(F.col(column).isNotNull() & (F.col(column) != drop))


def normalize_total(expr: DataFrame, target: float | None = None) -> DataFrame:
    """Scales each cell to the target total: the median of the totals over 0 by default.

    Values go round once, by cell, and are read again for the median. A total of rows without a cell counts for the median, but they aren't returned.
    """
    values, by = expr.select("cell_id", "gene_id", "value"), Window.partitionBy("cell_id")
    if target is None:
        # one row a cell, chosen by gene: so both sides read the same columns of one shuffle, sorted once
        sorted_by = by.orderBy("gene_id")
        whole = sorted_by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        totals = values.withColumns({"__t": F.sum("value").over(whole), "__i": F.row_number().over(sorted_by)})
        goal = totals.where("__i = 1 and __t > 0").agg(F.median("__t").alias("__g"))
    else:
        goal = expr.sparkSession.range(1).select(F.lit(float(target)).alias("__g"))
    # cells are counted after the shuffle: a filter on cell_id would be pushed below it and make it another one than the median's
    told = values.withColumns({"__t": F.sum("value").over(by), "__n": F.count("cell_id").over(by)}).where("__n > 0")
    scaled = told.join(F.broadcast(goal))  # one row
    return scaled.select("cell_id", "gene_id", F.coalesce(F.try_divide(F.col("value") * F.col("__g"), F.col("__t")), F.lit(0.0)).alias("value"))


def log1p(expr: DataFrame) -> DataFrame:
    return expr.withColumn("value", F.log1p("value"))


def value_range(expr: DataFrame, n_cells: int, n_genes: int) -> DataFrame:
    """One row: stored values, density, largest and smallest; absent rows count as 0."""
    a = expr.agg(F.count("*").alias("n"), F.max("value").alias("hi"), F.min("value").alias("lo"))
    sparse = F.col("n") < n_cells * n_genes
    return a.select(F.col("n").alias("n_stored"), (F.col("n") / float(n_cells * n_genes)).alias("density"), F.when(sparse, F.greatest("hi", F.lit(0.0))).otherwise(F.col("hi")).alias("max_value"), F.when(sparse, F.least("lo", F.lit(0.0))).otherwise(F.col("lo")).alias("min_value"))


def highly_variable(genes: DataFrame, expr: DataFrame, n_cells: int, n_top: int = 2000, flavor: str = "seurat", bins: int = 20) -> DataFrame:
    """(gene_id, mean, dispersion, norm, rank, highly_variable): the n_top genes by dispersion normalised within bins of mean.

    expr is not logged. seurat: log mean and log dispersion of the counts, z-scored in equal-width bins of the mean; a bin
    of one gene gives it 1. seurat_v3: variance of clipped standardised counts against a local regression of log variance on log mean.
    """
    if flavor == "seurat_v3":
        return _variable_v3(genes, expr, n_cells, n_top)
    if flavor != "seurat":
        raise ValueError(f"unknown flavor {flavor!r}")
    sums = expr.groupBy("gene_id").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("ss"))
    full = genes.select("gene_id").join(sums, "gene_id", "left").fillna(0.0, ["s", "ss"])
    mean = F.col("s") / n_cells
    var = (F.col("ss") - F.col("s") * mean) / max(n_cells - 1, 1)
    stats = full.select("gene_id", F.log1p(mean).alias("mean"), F.when((mean > 0) & (var > 0), F.ln(var / mean)).alias("dispersion"))
    ends = stats.agg(F.min("mean").alias("lo"), F.max("mean").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.least(F.floor(F.coalesce(F.try_divide(F.col("mean") - F.col("lo"), width), F.lit(0.0))), F.lit(bins - 1))
    by = Window.partitionBy("bin")
    told = stats.join(F.broadcast(ends)).withColumn("bin", at)
    m, sd = F.avg("dispersion").over(by), F.stddev_samp("dispersion").over(by)
    norm = F.when(sd.isNull() & F.col("dispersion").isNotNull(), F.lit(1.0)).otherwise(F.try_divide(F.col("dispersion") - m, F.nullif(sd, F.lit(0.0))))
    out = told.withColumn("norm", norm)
    rank = F.row_number().over(Window.orderBy(F.round("norm", 10).desc_nulls_last(), "gene_id"))  # over genes, not cells
    return out.withColumn("rank", rank).select("gene_id", "mean", "dispersion", "norm", "rank", (F.col("rank") <= n_top).alias("highly_variable"))


def _variable_v3(genes: DataFrame, expr: DataFrame, n_cells: int, n_top: int) -> DataFrame:
    import numpy as np

    sums = genes.select("gene_id").join(expr.groupBy("gene_id").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("ss")), "gene_id", "left").fillna(0.0).orderBy("gene_id").toPandas()
    mean = sums.s.to_numpy() / n_cells
    var = np.maximum((sums.ss.to_numpy() - n_cells * mean**2) / max(n_cells - 1, 1), 0)
    ok = (mean > 0) & (var > 0)
    std = np.ones(len(mean))
    if ok.sum() > 2:
        x, y = np.log10(mean[ok]), np.log10(var[ok])
        span = max(int(0.3 * len(x)), 3)
        fit = np.empty(len(x))
        for i in range(len(x)):  # local quadratic regression with tricube weights
            d = np.abs(x - x[i])
            near = np.argsort(d, kind="stable")[:span]
            w = (1 - np.minimum(d[near] / max(d[near].max(), 1e-12), 1) ** 3) ** 3 + 1e-9
            a = np.vander(x[near] - x[i], min(3, len(near)))
            fit[i] = np.linalg.lstsq(a * np.sqrt(w)[:, None], y[near] * np.sqrt(w), rcond=None)[0][-1]
        std[ok] = np.sqrt(10**fit)
    spark = genes.sparkSession
    ref = spark.createDataFrame([(int(g), float(m), float(s)) for g, m, s in zip(sums.gene_id, mean, std)], f"gene_id {dict(genes.dtypes)['gene_id']}, mean double, std double")
    top = n_cells**0.5
    z = F.least((F.col("value") - F.col("mean")) / F.col("std"), F.lit(top))
    zero = -F.col("mean") / F.col("std")
    got = expr.join(F.broadcast(ref), "gene_id").groupBy("gene_id").agg(F.sum(z * z).alias("ss"), F.count("*").alias("n"))
    full = ref.join(got, "gene_id", "left").fillna(0, ["ss", "n"])
    norm = (F.col("ss") + (n_cells - F.col("n")) * zero * zero) / max(n_cells - 1, 1)
    out = full.select("gene_id", "mean", (F.col("std") * F.col("std")).alias("dispersion"), norm.alias("norm"))
    rank = F.row_number().over(Window.orderBy(F.desc("norm"), "gene_id"))
    return out.withColumn("rank", rank).withColumn("highly_variable", F.col("rank") <= n_top)


def filter_genes(expr: DataFrame, chosen: DataFrame) -> DataFrame:
    return expr.join(F.broadcast(chosen.select("gene_id")), "gene_id", "left_semi")


def listed_genes(genes: DataFrame, names: DataFrame) -> DataFrame:
    """genes whose upper-cased name is in names(gene_name)."""
    wanted = names.select(F.upper("gene_name").alias("gene_name"))
    return genes.withColumn("gene_name", F.upper("gene_name")).join(wanted, "gene_name", "left_semi")


def scaled(expr: DataFrame) -> DataFrame:
    """Sample z-scores of each gene of a dense expr."""
    by = expr.groupBy("gene_id").agg(F.avg("value").alias("__m"), F.stddev_samp("value").alias("__s"))
    z = F.coalesce(F.try_divide(F.col("value") - F.col("__m"), F.nullif("__s", F.lit(0.0))), F.lit(0.0))
    return expr.join(F.broadcast(by), "gene_id").select("cell_id", "gene_id", z.alias("value"))


def staggered(cells: DataFrame, gap: float = 1.5) -> DataFrame:
    """Samples side by side: x less the sample's least, plus the sample's place times gap times the largest."""
    lows = cells.groupBy("sample").agg(F.min("x").alias("__lo"), F.max("x").alias("__hi"))
    place = F.row_number().over(Window.orderBy("sample")) - 1  # samples are few
    lows = lows.withColumn("__k", place)
    widest = lows.agg(F.max(F.col("__hi") - F.col("__lo")).alias("__w"))
    out = cells.join(F.broadcast(lows), "sample").join(F.broadcast(widest))
    return out.withColumn("x", F.col("x") - F.col("__lo") + F.col("__k") * gap * F.col("__w")).select(*cells.columns)


def concatenated_samples(samples: dict[str, DataFrame], id_column: str = "cell_id") -> DataFrame:
    """Tables of several samples, one under the other, ids suffixed by the sample; missing columns are null."""
    each = [df.withColumn(id_column, F.concat_ws("-", F.col(id_column).cast("string"), F.lit(s))).withColumn("sample", F.lit(s)) for s, df in samples.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), each)


def mapped(df: DataFrame, column: str, mapping: dict, default: str | Column | None = None) -> DataFrame:
    """Values by a small dictionary; those it lacks become the default, or stay."""
    m = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv]) if mapping else None
    other = F.col(column) if default is None else (F.lit(default) if isinstance(default, str) else default)
    return df.withColumn(column, other if m is None else F.coalesce(F.try_element_at(m, F.col(column)), other))
