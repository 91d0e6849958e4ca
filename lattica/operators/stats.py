"""Metagenes, correlations and differential expression."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._scale import running


def metagenes(cells: DataFrame, genes: DataFrame, expr: DataFrame, markers: DataFrame) -> DataFrame:
    """(cell_id, cell_type, value): the mean over those of a type's marker genes that exist. markers(cell_type, gene_name)."""
    there = markers.join(genes.select("gene_id", "gene_name"), "gene_name").select("cell_type", "gene_id")
    n = there.groupBy("cell_type").agg(F.count("*").alias("n"))
    sums = expr.join(F.broadcast(there), "gene_id").groupBy("cell_id", "cell_type").agg(F.sum("value").alias("s"))
    grid = cells.select("cell_id").join(F.broadcast(n))
    return grid.join(sums, ["cell_id", "cell_type"], "left").select("cell_id", "cell_type", (F.coalesce("s", F.lit(0.0)) / F.col("n")).alias("value"))


def metagene_difference(augmented: DataFrame, up: list[int], down: list[int], m: int = 0) -> DataFrame:
    """(cell_id, own, nbr): mean of the genes up less mean of the genes down, among own features and those of order m."""

    def part(k: int) -> F.Column:
        one = lambda ids: F.coalesce(F.sum(F.when((F.col("k") == k) & F.col("gene_id").isin(ids), F.col("value"))), F.lit(0.0)) / max(len(ids), 1)
        return one(up) - one(down)

    return augmented.groupBy("cell_id").agg(part(-1).alias("own"), part(m).alias("nbr"))


def composition(df: DataFrame, columns: list[str], name: str = "value") -> DataFrame:
    """Row sums over chosen columns."""
    return df.withColumn(name, sum((F.coalesce(F.col(c), F.lit(0.0)) for c in columns), F.lit(0.0)))


def self_vs_neighbour(augmented: DataFrame, lam: float, m: int = 0) -> DataFrame:
    """(cell_id, gene_id, own, nbr): sqrt(1 - lam) of own and sqrt(lam) of neighbours' values."""
    pick = lambda k, f: (F.max(F.when(F.col("k") == k, F.col("value"))) * f)
    return augmented.groupBy("cell_id", "gene_id").agg(pick(-1, math.sqrt(1 - lam)).alias("own"), pick(m, math.sqrt(lam)).alias("nbr"))


def point_biserial(labels: DataFrame, values: DataFrame) -> DataFrame:
    """(label, r, n, t): correlation of belonging to each label with values(cell_id, value), from one pass of sums."""
    both = labels.join(values, "cell_id").where("value is not null")
    total = both.agg(F.count("*").cast("double").alias("n"), F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("ss"))
    per = both.groupBy("label").agg(F.count("*").cast("double").alias("n1"), F.sum("value").alias("s1")).join(F.broadcast(total))
    cov = F.col("s1") / F.col("n") - F.col("n1") / F.col("n") * F.col("s") / F.col("n")
    var = (F.col("ss") / F.col("n") - F.col("s") / F.col("n") * F.col("s") / F.col("n")) * (F.col("n1") / F.col("n")) * (1 - F.col("n1") / F.col("n"))
    r = F.try_divide(cov, F.nullif(F.sqrt(F.greatest(var, F.lit(0.0))), F.lit(0.0)))
    return per.select("label", r.alias("r"), F.col("n").cast("long").alias("n")).withColumn("t", F.try_divide(F.col("r") * F.sqrt(F.col("n") - 2.0), F.sqrt(F.nullif(1 - F.col("r") * F.col("r"), F.lit(0.0)))))


def with_p_value(correlations: DataFrame) -> DataFrame:
    """point_biserial()'s rows, one a label, with the two-sided p of each t; null where t is."""
    rows = correlations.collect()
    out = [(*r, None if r.t is None else t_p_value(r.t, r.n - 2)) for r in rows]
    return correlations.sparkSession.createDataFrame(out, ", ".join(f"{c} {t}" for c, t in correlations.dtypes) + ", p double")


def minus_log10_p(z: F.Column) -> F.Column:
    """-log10 of the two-sided normal p of a z-score, also where p is too small for a double.

    The complementary error function: up to |z| = 2 one minus the series of the error function, beyond it a continued fraction.
    """
    t = F.abs(z) / math.sqrt(2)
    steps = F.sequence(F.lit(120), F.lit(1))
    series = F.aggregate(steps, F.lit(1.0), lambda s, n: 1 + s * 2 * t * t / (2 * n + 1)) * t * F.exp(-t * t) * (2 / math.sqrt(math.pi))
    fraction = F.aggregate(steps, t, lambda s, n: t + n / 2 / s)
    return F.when(t < math.sqrt(2), -F.log10(1 - series)).otherwise((t * t + 0.5 * math.log(math.pi) + F.ln(fraction)) / math.log(10))


def volcano(scores: DataFrame, score: str = "u_z") -> DataFrame:
    """scores with `minus_log10_p`, of the two-sided normal p of each z-score."""
    return scores.withColumn("minus_log10_p", minus_log10_p(F.col(score).cast("double")) + F.lit(0.0))


def t_p_value(t: float, df: float) -> float:
    """Two-sided p of Student's t, by the incomplete beta function's continued fraction."""
    x = df / (df + t * t)
    a, b = df / 2, 0.5

    def fraction(x: float, a: float, b: float) -> float:
        tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
        d = 1 / (d if abs(d) > tiny else tiny)
        h = d
        for m in range(1, 300):
            for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d, c = 1 + num * d, 1 + num / c
                d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
                h *= d * c
            if abs(d * c - 1) < 1e-14:
                break
        return h

    front = math.exp(a * math.log(x) + b * math.log1p(-x) - math.lgamma(a) - math.lgamma(b) + math.lgamma(a + b)) if 0 < x < 1 else 0.0
    if x >= 1:
        return 1.0
    return front * fraction(x, a, b) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(1 - x, b, a) / b


def wilcoxon(labels: DataFrame, expr: DataFrame) -> DataFrame:
    """(label, gene_id, u_z, n): rank-sum z-score of each label against the rest, per gene of a dense expr; ties share their mean rank.

    Ranks come from counts of distinct values, so equal values (many zeros) don't gather in a sort of cells; they are running sums
    over ranges of (gene, value), so no gene's values gather in one task either.
    """
    both = expr.where("value is not null").join(labels, "cell_id")
    by_value = both.groupBy("gene_id", "value", "label").agg(F.count("*").alias("c"))
    of_value = by_value.groupBy("gene_id", "value").agg(F.sum("c").alias("t"))
    placed = running(of_value, ["gene_id", "value"], "t")
    of_gene = placed.groupBy("gene_id").agg(F.min("before").alias("start"))  # values of genes before it
    ranked = placed.join(F.broadcast(of_gene), "gene_id").select("gene_id", "value", (F.col("before") - F.col("start") + (F.col("t") + 1) / 2.0).alias("rank"))
    sums = by_value.join(ranked, ["gene_id", "value"]).groupBy("gene_id", "label").agg(F.sum(F.col("c") * F.col("rank")).alias("w"))
    n = labels.groupBy("label").agg(F.count("*").cast("double").alias("n1"))
    total = n.agg(F.sum("n1").alias("n"))
    told = sums.join(F.broadcast(n), "label").join(F.broadcast(total))
    sd = F.sqrt(F.col("n1") * (F.col("n") - F.col("n1")) * (F.col("n") + 1) / 12.0)
    return told.select("label", "gene_id", F.coalesce(F.try_divide(F.col("w") - F.col("n1") * (F.col("n") + 1) / 2.0, F.nullif(sd, F.lit(0.0))), F.lit(0.0)).alias("u_z"), F.col("n1").cast("long").alias("n"))


def top_genes(scores: DataFrame, n: int = 20) -> DataFrame:
    """The n genes of each label with the largest scores."""
    by = Window.partitionBy("label").orderBy(F.desc("u_z"), "gene_id")
    return scores.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= n)


def dendrogram(means: np.ndarray) -> list[tuple[int, int, float]]:
    """Average-linkage merges (a, b, distance) of groups by 1 - correlation of their mean features; new groups are numbered on."""
    c = np.nan_to_num(np.corrcoef(means))
    dist = {(i, j): 1 - c[i, j] for i in range(len(means)) for j in range(i + 1, len(means))}
    size = {i: 1 for i in range(len(means))}
    out, new = [], len(means)
    while len(size) > 1:
        (a, b), d = min(((p, dist[p]) for p in dist if p[0] in size and p[1] in size), key=lambda x: (x[1], x[0]))
        for k in size:
            if k not in (a, b):
                one, two = dist[tuple(sorted((a, k)))], dist[tuple(sorted((b, k)))]
                dist[(k, new)] = (size[a] * one + size[b] * two) / (size[a] + size[b])
        size[new] = size.pop(a) + size.pop(b)
        out.append((a, b, float(d)))
        new += 1
    return out


def per_sample_ari(a: DataFrame, b: DataFrame, cells: DataFrame) -> DataFrame:
    """(sample, ari) of each sample."""
    t = a.select("cell_id", F.col("label").alias("a")).join(b.select("cell_id", F.col("label").alias("b")), "cell_id").join(cells.select("cell_id", "sample"), "cell_id").groupBy("sample", "a", "b").agg(F.count("*").alias("n"))
    pairs = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2.0)
    s = t.groupBy("sample").agg(pairs("n").alias("s"), F.sum("n").alias("n"))
    ra = t.groupBy("sample", "a").agg(F.sum("n").alias("n")).groupBy("sample").agg(pairs("n").alias("ra"))
    rb = t.groupBy("sample", "b").agg(F.sum("n").alias("n")).groupBy("sample").agg(pairs("n").alias("rb"))
    expected = F.try_divide(F.col("ra") * F.col("rb"), F.col("n") * (F.col("n") - 1) / 2.0)
    most = (F.col("ra") + F.col("rb")) / 2.0
    return s.join(ra, "sample").join(rb, "sample").select("sample", F.coalesce(F.try_divide(F.col("s") - expected, F.nullif(most - expected, F.lit(0.0))), F.lit(1.0)).alias("ari"))


def median_ari(per_sample: DataFrame, targets: DataFrame) -> DataFrame:
    """(target, median_ari, n): per_sample_ari()'s samples by the number of labels they should have, targets(sample, target)."""
    return per_sample.join(targets, "sample").groupBy("target").agg(F.median("ari").alias("median_ari"), F.count("*").alias("n"))


def group_means(labels: DataFrame, expr: DataFrame) -> tuple[list, np.ndarray]:
    """Labels and their mean of each gene of a dense expr, labels by genes: what dendrogram() joins."""
    rows = expr.join(labels, "cell_id").groupBy("label", "gene_id").agg(F.avg("value").alias("m")).collect()
    names, genes = sorted({r.label for r in rows}), sorted({r.gene_id for r in rows})
    out = np.zeros((len(names), len(genes)))
    for r in rows:
        out[names.index(r.label), genes.index(r.gene_id)] = r.m
    return names, out


def merges(labels: DataFrame, expr: DataFrame) -> DataFrame:
    """(step, a, b, distance) of the dendrogram of labels by their mean features; groups are numbered in order of labels, then on."""
    names, means = group_means(labels, expr)
    rows = [(i, a, b, d) for i, (a, b, d) in enumerate(dendrogram(means))] if names else []
    return labels.sparkSession.createDataFrame(rows, "step int, a int, b int, distance double")
