"""Whole analyses put together from the operators."""

from __future__ import annotations

import math
import re
import uuid
from dataclasses import dataclass, field
from functools import cache, reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import augment, cluster, graph, labels as lab, reduce as red
from ..operators._scale import kept
from ..operators.spatial_index import SpatialIndex


@dataclass(frozen=True)
class Spatial:
    """Neighbour weights of orders 0..max_m for one decay, lazy tables; and the edges of the largest order, kept."""

    decay: str
    weights: dict[int, DataFrame]
    edges: DataFrame


def initialize(cells: DataFrame, k: int = 15, decay: str = "scaled_gaussian", max_m: int = 1, index: SpatialIndex | None = None) -> Spatial:
    """Weights of each order from one neighbour search of the largest order's size, in an index of the cells if one is given."""
    widest = kept(graph.knn_graph(cells, k * (max_m + 1), index=index))  # each order reads it
    out = {}
    for m in range(max_m + 1):
        edges = widest.where(F.col("rk") <= k * (m + 1))
        w = graph.row_normalized(graph.with_decay(edges, decay, k * (m + 1)))
        out[m] = graph.modulated(w, m) if m else w
    return Spatial(decay, out, widest)


def neighbour_blocks(spatial: Spatial, expr: DataFrame, center: bool = False) -> dict[int, DataFrame]:
    """The cell's own values (-1), neighbour means (0) and gradients (1 and on) of a dense expr; kept, as moments are taken before they are scaled."""
    out = {-1: expr}
    for m, edges in spatial.weights.items():
        out[m] = kept(augment.neighbour_mean(edges, expr) if m == 0 else augment.agf(edges, expr, center))
    return out


def variance_balanced(blocks: dict[int, DataFrame], n_cells: int, top: int = 20) -> dict[int, DataFrame]:
    """Neighbour blocks z-scored and scaled to the own block's variance in the leading directions."""
    lead = {k: float((red.top_values(kept(augment.wide(augment.zscore(b, n_cells).withColumn("k", F.lit(k)))), top, center=False) ** 2).sum()) for k, b in blocks.items()}
    return {k: b if k < 0 else b.withColumn("value", F.col("value") * augment.balance_factor(lead[-1], lead[k])) for k, b in blocks.items()}


def augmented(cells: DataFrame, expr: DataFrame, lam: float, k: int = 15, decay: str = "scaled_gaussian", max_m: int = 1, center: bool = False, variance_balance: bool = False) -> DataFrame:
    """The augmented matrix in long form. Gradients are not centred unless asked, as in the standard pipeline."""
    n = cells.count()
    blocks = neighbour_blocks(initialize(cells, k, decay, max_m), expr, center)
    if variance_balance:
        blocks = variance_balanced(blocks, n)
    return augment.concatenated(blocks, float(lam), n)


def nonspatial(expr: DataFrame, n_cells: int) -> DataFrame:
    return augment.concatenated({-1: expr}, 0.0, n_cells)


@dataclass
class Settings:
    lambdas: tuple[float, ...] = (0.2,)
    pcs: tuple[int | float, ...] = (20,)
    resolutions: tuple[float, ...] | None = (0.7,)
    max_labels: int | None = None
    k: int = 15
    decay: str = "scaled_gaussian"
    max_m: int = 1
    center: bool = False
    variance_balance: bool = False
    add_nonspatial: bool = True
    algorithm: str = "leiden"
    feature_neighbours: int = 50
    shared_max_rank: int = 3
    shared_threshold: int = 5
    match: bool = False
    refine: str | None = None
    refine_neighbours: int = 6
    seed: int = 1234
    found: dict = field(default_factory=dict)


RESULTS = "decay string, lambda_param double, num_pcs int, resolution double, num_labels int, modularity double, ari double, refined_ari double, total_entropy_normalized double"


def _finished(spark: SparkSession, folder: str | None) -> dict[tuple, tuple]:
    """Rows of the results that an earlier run() committed in the folder, by (decay, lambda, wanted pcs, wanted resolution)."""
    if folder is None:
        return {}
    try:
        rows = spark.read.parquet(f"{folder}/results").collect()  # a row a setting
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return {}
    return {(r.decay, r.lambda_param, r.wanted_pcs, r.wanted): tuple(r)[:9] + (r.place,) for r in rows}


def run(cells: DataFrame, expr: DataFrame, s: Settings, annotations: DataFrame | None = None, folder: str | None = None) -> tuple[DataFrame, dict[tuple, DataFrame]]:
    """Every combination of lambda, components and resolution: a results table and labels by (decay, lambda, pcs, resolution).

    Keys are raw numbers, so close resolutions stay apart. Without resolutions each combination is searched for max_labels. The resolutions
    of one graph are clustered at once. With a folder every finished setting is committed there, its labels before its row of the
    results, and a run of the same settings that is started again takes over what it finds; a graph all of whose settings are there isn't built.
    """
    if s.resolutions is None and s.max_labels is None:
        raise ValueError("give resolutions, or max_labels to search for")
    spark, n, done = cells.sparkSession, cells.count(), _finished(cells.sparkSession, folder)
    mixture, search = s.algorithm == "mixture", s.resolutions is None
    wanted = [float("inf")] if mixture or search else [float(r) for r in s.resolutions]  # inf: found by the setting itself

    @cache
    def spatial() -> Spatial:
        return initialize(cells, s.k, s.decay, s.max_m)

    @cache
    def blocks() -> dict[int, DataFrame]:
        made = neighbour_blocks(spatial(), expr, s.center)
        return variance_balanced(made, n) if s.variance_balance else made

    @cache
    def near() -> DataFrame:
        if s.refine_neighbours <= s.k * (s.max_m + 1):  # the search for the weights found them
            return spatial().edges.where(F.col("rk") <= s.refine_neighbours)
        return kept(graph.knn_graph(cells, s.refine_neighbours))

    matrices = [(s.decay, float(lam), lambda lam=lam: augment.concatenated(blocks(), float(lam), n)) for lam in s.lambdas]
    if s.add_nonspatial:
        matrices.append(("nonspatial", 0.0, lambda: nonspatial(expr, n)))
    rows, out = [], {}
    for decay, lam, matrix in matrices:
        features = None
        for pcs in s.pcs:
            left = [r for r in wanted if (decay, lam, float(pcs), r) not in done]
            found, g, dims = {}, None, 0
            if left:
                features = kept(augment.wide(matrix())) if features is None else features
                scores = kept(red.pca(features, pcs))
                dims = len(scores.first().pc) if n else 0
                if mixture:
                    found[left[0]] = (float("nan"), cluster.gaussian_mixture(scores, s.max_labels or 8, s.seed))
                else:
                    knn = kept(cluster.feature_knn(scores, s.feature_neighbours))
                    g = kept(cluster.undirected(cluster.shared_graph(knn, True, s.shared_max_rank, s.shared_threshold)))
                    if search:
                        found[left[0]] = cluster.find_resolution(cells, g, s.max_labels, seed=s.seed)
                    else:
                        swept = kept(cluster.leiden_sweep(cells, g, left, seed=s.seed))
                        found = {r: (r, swept.where(F.col("setting") == i).select("cell_id", "label")) for i, r in enumerate(left)}
            for want in wanted:
                key = (decay, lam, float(pcs), want)
                if key in done:
                    *row, place = done[key]
                    labels = spark.read.parquet(place)
                else:
                    resolution, labels = found[want]
                    labels = kept(labels)
                    num = labels.select("label").distinct().count()
                    q = lab.modularity(labels, g).first()[0] if g is not None else None
                    agree = lab.ari(annotations, labels).first()[0] if annotations is not None else None
                    refined_ari = entropy = None
                    if s.refine:
                        better, e, _ = lab.refined(labels, near(), s.refine)
                        refined_ari = lab.ari(annotations, better).first()[0] if annotations is not None else -1.0
                        entropy = e / math.log(num) if num > 1 else 0.0
                        labels = better
                    row = [decay, lam, dims, float(resolution), num, q, agree, refined_ari, entropy]
                    if folder is not None:
                        place = f"{folder}/labels-{uuid.uuid4().hex}"
                        labels.write.parquet(place)
                        spark.createDataFrame([(*row, float(pcs), want, place)], f"{RESULTS}, wanted_pcs double, wanted double, place string").write.mode("append").parquet(f"{folder}/results")
                        labels = spark.read.parquet(place)
                rows.append(tuple(row))
                out[(row[0], row[1], row[2], row[3])] = labels
    if s.match and len(out) > 1:
        out = dict(zip(out, lab.matched_series(list(out.values()))))
    return spark.createDataFrame(rows, RESULTS).orderBy("decay", "lambda_param", "num_pcs", "resolution"), out


def stacked(out: dict[tuple, DataFrame]) -> DataFrame:
    """All label tables of run() under each other, with their parameters."""
    each = [df.select("cell_id", "label").withColumns({"decay": F.lit(k[0]), "lambda_param": F.lit(k[1]), "num_pcs": F.lit(k[2]), "resolution": F.lit(k[3])}) for k, df in out.items()]
    return reduce(DataFrame.unionByName, each)


def looked_up(stack: DataFrame, decay: str, lam: float, pcs: int, resolution: float) -> DataFrame:
    """(cell_id, label) of one setting among stacked() tables; raises if there is none."""
    out = stack.where((F.col("decay") == decay) & (F.col("lambda_param") == lam) & (F.col("num_pcs") == pcs) & (F.col("resolution") == resolution)).select("cell_id", "label")
    if out.isEmpty():
        raise KeyError((decay, lam, pcs, resolution))
    return out


def spatial_and_nonspatial(stack: DataFrame, pcs: int, lam: float, resolution: float, names: dict[int, str], plain_names: dict[int, str], decay: str = "scaled_gaussian") -> tuple[DataFrame, DataFrame]:
    """The labels of a spatial setting and of the nonspatial one, each with the cell type that its own dictionary gives a label; null where it has none."""

    def typed(df: DataFrame, names: dict[int, str]) -> DataFrame:
        m = F.create_map(*[F.lit(x) for kv in names.items() for x in kv]) if names else None
        return df.withColumn("cell_type", F.lit(None).cast("string") if m is None else F.try_element_at(m, F.col("label")))

    return typed(looked_up(stack, decay, lam, pcs, resolution), names), typed(looked_up(stack, "nonspatial", 0.0, pcs, resolution), plain_names)


def pca_dims(names: list[str]) -> list[int | float]:
    """The numbers of components, or shares of variance, that names of embeddings such as reduced_pc_20 or reduced_pc_0.95 tell."""
    found = [m for m in (re.search(r"reduced_pc_([0-9]+|0\.[0-9]+)$", x) for x in names) if m]
    return [float(m[1]) if "." in m[1] else int(m[1]) for m in found]


def sorted_results(results: DataFrame) -> tuple[DataFrame, int]:
    """run()'s results in order of their parameters, and the largest number of labels."""
    return results.orderBy("decay", "lambda_param", "num_pcs", "resolution"), results.agg(F.max("num_labels")).first()[0] or 0


def qc_histograms(qc: DataFrame, total_cutoff: float, genes_low: float, genes_high: float, bins: int | None = None) -> DataFrame:
    """(panel, bin, low, n): the four QC histograms, of total_counts and n_genes_by_counts, each as it is and within its bounds.

    Without bins their width is the smaller of Sturges' and Freedman and Diaconis' (the latter where it isn't 0).
    """
    t, g = F.col("total_counts").cast("double"), F.col("n_genes_by_counts").cast("double")
    panel = lambda name, x, ok: F.when(ok, F.struct(F.lit(name).alias("panel"), x.alias("x")))
    every = F.array(panel("total", t, t.isNotNull()), panel("total_bounded", t, t < total_cutoff), panel("genes", g, g.isNotNull()), panel("genes_bounded", g, (g < genes_high) & (g > genes_low)))
    long = qc.select(F.explode(F.array_compact(every)).alias("p")).select("p.panel", "p.x")
    ends = long.groupBy("panel").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("all"), F.percentile("x", F.array(F.lit(0.25), F.lit(0.75))).alias("q"))
    span = F.col("hi") - F.col("lo")
    if bins is None:
        n = F.col("all").cast("double")
        sturges, fd = span / (F.log2(n) + 1), 2 * (F.col("q")[1] - F.col("q")[0]) / F.cbrt(n)
        width = F.when(fd > 0, F.least(sturges, fd)).otherwise(sturges)
        many = F.greatest(F.ceil(F.coalesce(F.try_divide(span, width), F.lit(1.0))), F.lit(1))
    else:
        many = F.lit(bins)
    ends = ends.select("panel", "lo", many.cast("long").alias("many"), (span / many).alias("step"))
    at = F.least(F.floor(F.coalesce(F.try_divide(F.col("x") - F.col("lo"), F.col("step")), F.lit(0.0))), F.col("many") - 1).cast("int")
    return long.join(F.broadcast(ends), "panel").groupBy("panel", at.alias("bin"), (F.col("lo") + at * F.col("step")).alias("low")).agg(F.count("*").alias("n"))


def kept_positions(cells: DataFrame, left: DataFrame) -> DataFrame:
    """(cell_id, x, y, kept): where all cells were, and which are still in left(cell_id)."""
    still = left.select("cell_id").distinct().withColumn("kept", F.lit(True))
    return cells.select("cell_id", "x", "y").join(still, "cell_id", "left").fillna(False, ["kept"])


def labelled_positions(cells: DataFrame, labels: DataFrame) -> DataFrame:
    """(cell_id, x, y, label) of labelled cells."""
    return cells.select("cell_id", "x", "y").join(labels.select("cell_id", "label"), "cell_id")


def labelled_embedding(embedding: DataFrame, labels: DataFrame) -> DataFrame:
    """(cell_id, first, second, label): the first two components, to be drawn by label."""
    return embedding.select("cell_id", F.try_element_at("pc", F.lit(1)).alias("first"), F.try_element_at("pc", F.lit(2)).alias("second")).join(labels.select("cell_id", "label"), "cell_id")
