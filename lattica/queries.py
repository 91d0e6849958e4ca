"""The registered queries of the spatial operators, each with the same result in SQL where SQL can say it.

Two fixtures over the driver's tables. A: embeddings as cells (x, y are components 0 and 1, genes are components 2 to 9, dense).
B: customers as cells, part brands as genes, ordered quantities as sparse values; one brand plays the mitochondrial gene.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import plans, sources
from .functions import gaussian_weight_1d
from .operators import augment, cluster, graph, labels as lab, qc, reduce as red, spatial_genes, stats
from .operators._scale import kept, running, shared_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
GENES_A = range(2, 10)


def query(sql: str | None = None, name: str | None = None):
    def put(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            ORACLES[key] = sql
        return f

    return put


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def cells_a(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("cell_id"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"), F.col("label").alias("annotation"))


def expr_a(spark: SparkSession, d: str) -> DataFrame:
    pairs = F.explode(F.array(*[F.struct(F.lit(g).alias("gene_id"), F.col("embedding")[g].cast("double").alias("value")) for g in GENES_A]))
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("cell_id"), pairs.alias("p")).select("cell_id", "p.gene_id", "p.value")


def labels_a(spark: SparkSession, d: str, other: bool = False) -> DataFrame:
    c = cells_a(spark, d)
    label = F.when(F.col("cell_id") % 3 == 0, (F.col("annotation") + 1) % 10).otherwise(F.col("annotation")) if other else F.col("annotation")
    return c.select("cell_id", label.cast("int").alias("label"))


def cells_b(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    return c.select(F.col("c_custkey").cast("long").alias("cell_id"), F.col("c_acctbal").cast("double").alias("x"), ((F.col("c_custkey") * 7919) % 10007).cast("double").alias("y"), F.col("c_mktsegment").alias("sample"))


def genes_b(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    names = table(spark, d, "part").select("p_brand").distinct()
    place = (F.row_number().over(Window.orderBy("p_brand")) - 1).cast("int")
    return names.select(place.alias("gene_id"), F.when(F.col("p_brand") == "Brand#11", "MT-Brand#11").otherwise(F.col("p_brand")).alias("gene_name"), "p_brand")


def expr_b(spark: SparkSession, d: str) -> DataFrame:
    li, o, p = (table(spark, d, t) for t in ("lineitem", "orders", "part"))
    sums = li.join(o, li.l_orderkey == o.o_orderkey).join(p, li.l_partkey == p.p_partkey).groupBy(F.col("o_custkey").cast("long").alias("cell_id"), "p_brand").agg(F.sum(F.col("l_quantity").cast("double")).alias("value"))
    return sums.join(F.broadcast(genes_b(spark, d)), "p_brand").select("cell_id", "gene_id", "value")


A = """cells as (select vec_id as cell_id, embedding[1]::double as x, embedding[2]::double as y, label as annotation from embeddings),
expr as (select vec_id as cell_id, g.gene_id, embedding[g.gene_id + 1]::double as value from embeddings, (select unnest(range(2, 10)) as gene_id) g),
lab as (select vec_id as cell_id, label::int as label from embeddings),
lab2 as (select vec_id as cell_id, (case when vec_id % 3 = 0 then (label + 1) % 10 else label end)::int as label from embeddings)"""
PAIRS = "pairs as (select a.cell_id as src, b.cell_id as dst, b.x - a.x as dx, b.y - a.y as dy, sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) as dist from cells a join cells b on a.cell_id <> b.cell_id)"
B = """cells as (select c_custkey::bigint as cell_id, c_acctbal::double as x, ((c_custkey * 7919) % 10007)::double as y, c_mktsegment as sample from customer),
genes as (select (row_number() over (order by p_brand) - 1)::int as gene_id, case when p_brand = 'Brand#11' then 'MT-Brand#11' else p_brand end as gene_name, p_brand from (select distinct p_brand from part)),
expr as (select o_custkey::bigint as cell_id, gene_id, sum(l_quantity::double) as value from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey join genes using (p_brand) group by 1, 2)"""


def knn(k: int) -> str:
    return f"{A}, {PAIRS}, knn as (select *, row_number() over (partition by src order by dist, dst) as rk from pairs qualify rk <= {k})"


DECAY_SQL = {
    "uniform": "1.0",
    "reciprocal": "1.0 / nullif(dist, 0)",
    "reciprocal_squared": "1.0 / nullif(dist * dist, 0)",
    "scaled_gaussian": "exp(-(dist / median(dist) over (partition by src)) * (dist / median(dist) over (partition by src)))",
    "ranked": "exp(-(rk * 1.5 / {k}) * (rk * 1.5 / {k}))",
}


def weights(k: int, decay: str = "scaled_gaussian", m: int = 0) -> str:
    return f"{knn(k * (m + 1))}, raw as (select *, {DECAY_SQL[decay].format(k=k * (m + 1))} as w0, atan2(dy, dx) as theta from knn), w as (select *, w0 / sum(w0) over (partition by src) as w from raw), wc as (select *, w * cos({m} * theta) as w_re, w * sin({m} * theta) as w_im from w)"


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """F.round of the columns. It goes by way of decimal text; where no tie is near, the nearest whole number gives the same double sooner."""

    def one(c: str):
        x = F.col(c) * F.lit(10.0**digits)
        whole = F.floor(x + 0.5)
        clear = (F.abs(x) < 1e9) & (F.abs(x - F.floor(x) - 0.5) > 1e-6)
        return F.when(clear, whole.cast("double") / F.lit(10.0**digits)).otherwise(F.round(c, digits)) + F.lit(0.0)

    return df.withColumns({c: one(c) if dict(df.dtypes)[c] == "double" else F.round(c, digits) + F.lit(0.0) for c in columns})


def r(x: str, name: str | None = None) -> str:
    return f"round({x}, 6) + 0.0 as {name or x}"


# --- graphs and weights


@query(f"with {knn(15)} select src, dst, rk::bigint as rk, {r('dist')} from knn")
def knn_graph(spark, d):
    return rounded(graph.knn_graph(cells_a(spark, d), 15).select("src", "dst", F.col("rk").cast("long").alias("rk"), "dist"), "dist")


@query(f"with {B}, pairs as (select a.sample, a.cell_id as src, b.cell_id as dst, sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) as dist from cells a join cells b on a.sample = b.sample and a.cell_id <> b.cell_id) select sample, src, dst, {r('dist')} from pairs qualify row_number() over (partition by sample, src order by dist, dst) <= 6")
def knn_graph_by_sample(spark, d):
    return rounded(graph.knn_graph(cells_b(spark, d), 6).select("sample", "src", "dst", "dist"), "dist")


@query(f"with {knn(1)} select {r('median(dist)', 'median_dist')} from knn")
def nn1_median(spark, d):
    return rounded(graph.nearest_median(cells_a(spark, d)), "median_dist")


@query(f"with {A}, {PAIRS} select src, dst, {r('dist')} from pairs where dist <= 0.05")
def radius_graph(spark, d):
    return rounded(graph.radius_graph(cells_a(spark, d), 0.05).select("src", "dst", "dist"), "dist")


@query(f"with {knn(15)} select src, dst, {r('dist')} from knn where dist <= 0.05")
def knn_within_radius(spark, d):
    return rounded(graph.knn_graph(cells_a(spark, d), 15, max_radius=0.05).select("src", "dst", "dist"), "dist")


@query(f"with {knn(15)} select src, dst, {r('atan2(dy, dx)', 'theta')} from knn")
def edge_theta(spark, d):
    return rounded(graph.with_theta(graph.knn_graph(cells_a(spark, d), 15)).select("src", "dst", "theta"), "theta")


for _decay in graph.DECAYS:

    @query(f"with {weights(15, _decay)} select src, dst, {r('w')} from w", f"w_{_decay}")
    def _weights(spark, d, decay=_decay):
        return rounded(graph.spatial_weights(cells_a(spark, d), 0, 15, decay).select("src", "dst", "w"), "w")


_RADIUS = (-2 * 0.02**2 * math.log(0.05)) ** 0.5


@query(f"with {A}, {PAIRS}, g as (select *, exp(-dist * dist / (2 * 0.02 * 0.02)) / (2 * pi() * 0.02 * 0.02) as w0 from pairs where dist <= {_RADIUS!r}) select src, dst, {r('w0 / sum(w0) over (partition by src)', 'w')} from g")
def w_gaussian_radius(spark, d):
    return rounded(graph.radius_weights(cells_a(spark, d), 0.05, 0.02).select("src", "dst", "w"), "w")


@query(f"with {weights(15, m=1)} select src, dst, {r('w_re')}, {r('w_im')} from wc")
def w_complex_m1(spark, d):
    return rounded(graph.spatial_weights(cells_a(spark, d), 1, 15).select("src", "dst", "w_re", "w_im"), "w_re", "w_im")


@query(f"with {knn(5)} select src, dst, {r('exp(-dist * dist / (2 * 0.1 * 0.1)) / (0.1 * sqrt(2 * pi()))', 'g')} from knn")
def gaussian_1d(spark, d):
    e = graph.knn_graph(cells_a(spark, d), 5)
    return rounded(e.select("src", "dst", gaussian_weight_1d(F.col("dist"), 0.1).alias("g")), "g")


# --- neighbourhood features


@query(f"with {weights(15)} select src as cell_id, gene_id::int as gene_id, {r('sum(w * value)', 'value')} from w join expr on dst = cell_id group by src, gene_id")
def neighbour_mean(spark, d):
    w = graph.spatial_weights(cells_a(spark, d), 0, 15)
    return rounded(augment.neighbour_mean(w, expr_a(spark, d)), "value")


_AGF = "sums as (select src, gene_id, sum(w_re * value) as re, sum(w_im * value) as im, sum(value) as total, sum(w_re) as s_re, sum(w_im) as s_im, count(*) as n from wc join expr on dst = cell_id group by src, gene_id)"


@query(f"with {weights(15, m=1)}, {_AGF} select src as cell_id, gene_id::int as gene_id, {r('sqrt((re - total / n * s_re) * (re - total / n * s_re) + (im - total / n * s_im) * (im - total / n * s_im))', 'value')} from sums")
def agf_centered(spark, d):
    return rounded(augment.agf(graph.spatial_weights(cells_a(spark, d), 1, 15), expr_a(spark, d), True), "value")


@query(f"with {weights(15, m=1)}, {_AGF} select src as cell_id, gene_id::int as gene_id, {r('sqrt(re * re + im * im)', 'value')} from sums")
def agf_uncentered(spark, d):
    return rounded(augment.agf(graph.spatial_weights(cells_a(spark, d), 1, 15), expr_a(spark, d), False), "value")


_Z = "(value - avg(value) over (partition by gene_id)) / stddev_pop(value) over (partition by gene_id)"


@query(f"with {A} select cell_id, gene_id::int as gene_id, {r(_Z, 'value')} from expr")
def zscore(spark, d):
    return rounded(augment.zscore(expr_a(spark, d), cells_a(spark, d).count()), "value")


@query(f"with {A} select gene_id::int as gene_id, {r('avg(value)', 'mean')}, {r('stddev_pop(value)', 'std')} from expr group by gene_id")
def feature_std(spark, d):
    return rounded(augment.feature_moments(expr_a(spark, d), cells_a(spark, d).count()), "mean", "std")


def _augmented_sql(lam: float, center: bool) -> str:
    mag = "sqrt((re - total / n * s_re) * (re - total / n * s_re) + (im - total / n * s_im) * (im - total / n * s_im))" if center else "sqrt(re * re + im * im)"
    one, two = weights(15), weights(15, m=1)
    zero_part = one[one.index("knn as") :].replace("knn as", "knn0 as").replace("from knn)", "from knn0)").replace("raw as", "raw0 as").replace("from raw)", "from raw0)").replace(" w as (", " w0t as (").replace("wc as (", "wc0 as (").replace("from w)", "from w0t)")
    return f"""with {two}, {_AGF}, {zero_part}, blocks as (select -1 as k, cell_id, gene_id, value from expr
union all select 0, src, gene_id, sum(w * value) from w0t join expr on dst = cell_id group by src, gene_id union all select 1, src, gene_id, {mag} from sums)
select cell_id, gene_id::int as gene_id, k::int as k, {r(f"(value - avg(value) over (partition by k, gene_id)) / stddev_pop(value) over (partition by k, gene_id) * case k when -1 then sqrt(1 - {lam}) when 0 then sqrt({lam} * 2 / 3) else sqrt({lam} / 3) end", 'value')} from blocks"""


for _lam, _name, _center in ((0.2, "augmented_lambda02", False), (0.8, "augmented_lambda08", False), (0.2, "augmented_centered", True)):

    @query(_augmented_sql(_lam, _center), _name)
    def _augmented(spark, d, lam=_lam, center=_center):
        out = plans.augmented(cells_a(spark, d), expr_a(spark, d), lam, 15, "scaled_gaussian", 1, center)
        return rounded(out.select("cell_id", "gene_id", "k", "value"), "value")


@query(f"with {A} select cell_id, gene_id::int as gene_id, {r(_Z, 'value')} from expr")
def nonspatial(spark, d):
    return rounded(plans.nonspatial(expr_a(spark, d), cells_a(spark, d).count()).select("cell_id", "gene_id", "value"), "value")


@query(f"with {weights(15)} select cell_id, gene_id::int as gene_id, false as is_nbr, {r('value * sqrt(1 - 0.2)', 'value')} from expr union all select src, gene_id::int, true, {r('sum(w * value) * sqrt(0.2)', 'value')} from w join expr on dst = cell_id group by src, gene_id")
def weighted_concatenate(spark, d):
    e = expr_a(spark, d)
    return rounded(augment.weighted_concatenate(e, augment.neighbour_mean(graph.spatial_weights(cells_a(spark, d), 0, 15), e), 0.2), "value")


@query(f"with {B} select gene_id, k::int as k, k >= 0 as is_nbr, case when k < 0 then gene_name else gene_name || '_nbr_' || k end as feature from genes, (select unnest(range(-1, 2)) as k)")
def feature_names(spark, d):
    return augment.feature_names(genes_b(spark, d), 1)


# --- quality control and normalisation


@query(f"""with {B}, r as (select e.*, gene_name like 'MT-%' as mt, row_number() over (partition by cell_id order by value desc, e.gene_id) as rk from expr e join genes using (gene_id)),
s as (select cell_id, sum(value) as t, count(*) filter (value > 0) as n, sum(case when mt then value else 0 end) as m, sum(case when rk <= 5 then value else 0 end) as t5 from r group by 1)
select c.cell_id, coalesce(t, 0) as total_counts, coalesce(n, 0) as n_genes_by_counts, {r('coalesce(100.0 * m / t, 0)', 'pct_counts_mt')}, {r('ln(1 + coalesce(t, 0))', 'log1p_total_counts')}, {r('coalesce(100.0 * t5 / t, 0)', 'pct_counts_in_top_5')} from cells c left join s using (cell_id)""")
def qc_cell(spark, d):
    out = qc.qc_cells(cells_b(spark, d), genes_b(spark, d), expr_b(spark, d), (5,))
    return rounded(out.drop("log1p_n_genes_by_counts"), "pct_counts_mt", "log1p_total_counts", "pct_counts_in_top_5")


@query(f"with {B} select gene_id, count(*) filter (value > 0) as n_cells_by_counts, {r('sum(value) / (select count(*) from cells)', 'mean_counts')}, {r('100.0 * (1 - count(*) filter (value > 0) / (select count(*) from cells))', 'pct_dropout_by_counts')}, sum(value) as total_counts from expr group by gene_id")
def qc_gene(spark, d):
    return rounded(qc.qc_genes(genes_b(spark, d), expr_b(spark, d), cells_b(spark, d).count()), "mean_counts", "pct_dropout_by_counts")


_KEPT = """q as (select cell_id, sum(value) as t, sum(case when gene_name like 'MT-%' then value else 0 end) as m from expr join genes using (gene_id) group by 1),
kept as (select cell_id from q where t between 100 and 2000 and coalesce(100.0 * m / t, 0) < 8), left_over as (select * from expr where cell_id in (select cell_id from kept))"""


@query(f"with {B}, {_KEPT} select cell_id, gene_id, value from left_over where gene_id in (select gene_id from left_over where value > 0 group by 1 having count(*) >= 10)")
def filter_cells(spark, d):
    return qc.filter_cells(cells_b(spark, d), genes_b(spark, d), expr_b(spark, d), 100, 2000, 8, 10)


@query(f"with {B} select cell_id, sample from cells where sqrt((x - 4000) * (x - 4000) + (y - 5000) * (y - 5000)) < 2550")
def circle_filter(spark, d):
    return qc.circle_filter(cells_b(spark, d), 4000, 5000, 2550).select("cell_id", "sample")


@query(f"with {B}, t as (select cell_id, sum(value) as t from expr group by 1) select cell_id, gene_id, {r('value * (select median(t) from t where t > 0) / t', 'value')} from expr join t using (cell_id)")
def normalize_total(spark, d):
    return rounded(qc.normalize_total(expr_b(spark, d)), "value")


@query(f"with {B} select cell_id, gene_id, {r('ln(1 + value)', 'value')} from expr")
def log1p(spark, d):
    return rounded(qc.log1p(expr_b(spark, d)), "value")


@query(f"with {B} select count(*) as n_stored, {r('count(*) / ((select count(*) from cells) * 25)', 'density')}, max(value) as max_value, least(min(value), case when count(*) < (select count(*) from cells) * 25 then 0 else min(value) end) as min_value from expr")
def value_range(spark, d):
    return rounded(qc.value_range(expr_b(spark, d), cells_b(spark, d).count(), 25), "density")


@query(f"""with {B}, n as (select count(*)::double as n from cells), s as (select gene_id, sum(value) as s, sum(value * value) as ss from expr group by 1),
t as (select gene_id, s / n as mean0, (ss - s * (s / n)) / (n - 1) as var from s, n), u as (select gene_id, ln(1 + mean0) as mean, ln(var / mean0) as dispersion from t),
b as (select *, least(floor((mean - (select min(mean) from u)) / (((select max(mean) from u) - (select min(mean) from u)) / 20)), 19) as bin from u),
z as (select *, case when count(*) over w = 1 then 1.0 else (dispersion - avg(dispersion) over w) / nullif(stddev_samp(dispersion) over w, 0) end as norm from b window w as (partition by bin))
select gene_id, {r('mean')}, {r('dispersion')}, {r('norm')}, row_number() over (order by round(norm, 10) desc nulls last, gene_id) <= 10 as highly_variable from z""")
def hvg_seurat(spark, d):
    out = qc.highly_variable(genes_b(spark, d), expr_b(spark, d), cells_b(spark, d).count(), 10)
    return rounded(out.drop("rank"), "mean", "dispersion", "norm")


@query(f"""with {B}, n as (select count(*)::double as n from cells), t as (select gene_id, sum(value) / n as mean, (sum(value * value) - n * (sum(value) / n) * (sum(value) / n)) / (n - 1) as var from expr, n group by gene_id, n),
x as (select gene_id, mean, log10(mean) as x, log10(var) as y, greatest((0.3 * count(*) over ())::double // 1, 3) as span from t),
near as (select a.gene_id, b.x - a.x as u, b.y, abs(b.x - a.x) as dist from x a, x b qualify row_number() over (partition by a.gene_id order by abs(b.x - a.x), b.gene_id) <= a.span),
w as (select *, pow(1 - pow(least(dist / greatest(max(dist) over (partition by gene_id), 1e-12), 1), 3), 3) + 1e-9 as w from near),
s as (select gene_id, sum(w) as s0, sum(w * u) as s1, sum(w * u * u) as s2, sum(w * u * u * u) as s3, sum(w * u * u * u * u) as s4, sum(w * y) as t0, sum(w * u * y) as t1, sum(w * u * u * y) as t2 from w group by 1),
f as (select gene_id, pow(10, (t0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - s3 * t2) + s2 * (t1 * s3 - s2 * t2)) / (s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s3 * s2) + s2 * (s1 * s3 - s2 * s2))) as dispersion from s),
z as (select gene_id, mean, dispersion, (select coalesce(sum(pow(least((value - mean) / sqrt(dispersion), sqrt(n)), 2)), 0) + (n - count(*)) * mean * mean / dispersion from expr e where e.gene_id = f.gene_id) / (n - 1) as norm from f join x using (gene_id), n)
select gene_id, {r('mean')}, {r('dispersion')}, {r('norm')}, row_number() over (order by norm desc, gene_id) <= 10 as highly_variable from z""")  # a local quadratic by Cramer's rule
def hvg_seurat_v3(spark, d):
    return rounded(qc.highly_variable(genes_b(spark, d), expr_b(spark, d), cells_b(spark, d).count(), 10, "seurat_v3").drop("rank"), "mean", "dispersion", "norm")


@query(f"with {A} select cell_id, gene_id::int as gene_id, {r('(value - avg(value) over (partition by gene_id)) / stddev_samp(value) over (partition by gene_id)', 'value')} from expr")
def scale_samples(spark, d):
    return rounded(qc.scaled(expr_a(spark, d)), "value")


@query(f"with {B}, lo as (select sample, min(x) as lo, max(x) - min(x) as w, row_number() over (order by sample) - 1 as k from cells group by sample) select cell_id, sample, {r('x - lo + k * 1.5 * (select max(w) from lo)', 'x')}, y from cells join lo using (sample)")
def stagger(spark, d):
    return rounded(qc.staggered(cells_b(spark, d)).select("cell_id", "sample", "x", "y"), "x")


@query(f"with {B} select gene_id, case when n > 1 then gene_name || '-' || (n - 1) else gene_name end as gene_name from (select gene_id, left(gene_name, 7) as gene_name, row_number() over (partition by left(gene_name, 7) order by gene_id) as n from genes)")
def unique_names(spark, d):
    return qc.unique_names(genes_b(spark, d).select("gene_id", F.substring("gene_name", 1, 7).alias("gene_name")))


# --- graph algebra


@query(f"with {knn(15)} select src, dst, {r('dist')} from (select *, rank() over (partition by src order by dist desc) as k from knn) where k <= 3 or dist >= 0.08")
def rank_threshold_filter(spark, d):
    e = graph.knn_graph(cells_a(spark, d), 15)
    return rounded(graph.filter_by_rank_and_threshold(e, 3, 0.08, "dist").select("src", "dst", "dist"), "dist")


@query(f"with {knn(15)} select src, dst, {r('dist')} from knn where dist <= 0.04")
def remove_greater_than(spark, d):
    return rounded(graph.remove_greater_than(graph.knn_graph(cells_a(spark, d), 15), 0.04, "dist").select("src", "dst", "dist"), "dist")


_NEAR = f"{A}, {PAIRS}, near as (select * from pairs where dist <= 0.03)"


@query(f"with {_NEAR} select c.cell_id, count(n.src) as degree from cells c left join near n on src = cell_id group by 1")
def row_degree(spark, d):
    c = cells_a(spark, d)
    return graph.row_degree(c, graph.radius_graph(c, 0.03))


@query(f"with {_NEAR} select cell_id from cells where cell_id not in (select src from near)")
def empty_rows(spark, d):
    c = cells_a(spark, d)
    return graph.empty_rows(c, graph.radius_graph(c, 0.03))


@query(f"with {_NEAR} select distinct src as cell_id from near")
def nonempty_rows(spark, d):
    c = cells_a(spark, d)
    return graph.nonempty_rows(c, graph.radius_graph(c, 0.03))


@query(f"with {knn(5)} select src * 3 as src, dst from knn")
def insert_empty_rows(spark, d):
    return graph.insert_empty_rows(graph.knn_graph(cells_a(spark, d), 5), 2).select("src", "dst")


@query(f"with {A} select label, cell_id, {r('1.0 / count(*) over (partition by label)', 'v')} from lab where label <> 4 union all select 4, null, 0.0")
def onehot_norm(spark, d):
    return rounded(graph.labels_to_onehot(labels_a(spark, d).where("label <> 4")), "v")


@query(f"with {A} select cell_id, label from lab")
def onehot_to_labels(spark, d):
    return graph.onehot_to_labels(graph.labels_to_onehot(labels_a(spark, d), False))


@query(f"""with {knn(15)}, e as (select min(dist) as lo, max(dist) as hi, median(dist) as med from knn), h as (select least(floor((dist - lo) / ((hi - lo) / 100)), 99)::int as bin, count(*) as n from knn, e group by 1)
select bin, {r('lo + bin * ((hi - lo) / 100)', 'low')}, n, {r('med', 'median')}, {r('(select lo + bin * ((hi - lo) / 100) from h order by n desc, bin limit 1)', 'mode')} from h, e""")
def edge_histogram(spark, d):
    return rounded(graph.edge_histogram(graph.knn_graph(cells_a(spark, d), 15)), "low", "median", "mode")


_SNN = f"{knn(15)}, snn as (select e.src, e.dst, count(g.dst) as n from knn e left join knn f on f.src = e.dst left join knn g on g.src = e.src and g.dst = f.dst group by 1, 2)"


@query(f"with {_SNN} select src, dst, n from snn")
def snn_count(spark, d):
    return cluster.shared_counts(graph.knn_graph(cells_a(spark, d), 15))


_SNN_KEPT = "kept as (select * from (select *, rank() over (partition by src order by n desc) as k from snn where n > 0) where k <= 3 or n >= 5)"


@query(f"with {_SNN}, {_SNN_KEPT} select src, dst, n from kept")
def snn_filtered(spark, d):
    n = cluster.shared_counts(graph.knn_graph(cells_a(spark, d), 15)).where("n > 0")
    return graph.filter_by_rank_and_threshold(n, 3, 5, "n")


@query(f"with {_SNN}, {_SNN_KEPT} select k.src, k.dst, {r('1 / (1 + dist)', 'w')} from kept k join knn e on k.src = e.src and k.dst = e.dst")
def snn_weighted(spark, d):
    e = graph.knn_graph(cells_a(spark, d), 15).withColumn("w", 1 / (1 + F.col("dist")))
    return rounded(cluster.shared_graph(e), "w")


_FEATURES = f"{A}, pairs as (select a.vec_id as src, b.vec_id as dst, sqrt(list_sum(list_transform(range(3, 11), lambda i: (a.embedding[i]::double - b.embedding[i]::double) * (a.embedding[i]::double - b.embedding[i]::double)))) as dist from embeddings a join embeddings b on a.vec_id <> b.vec_id)"


@query(f"with {_FEATURES} select src, dst, {r('dist')}, {r('1 / (1 + dist)', 'w')} from pairs qualify row_number() over (partition by src order by dist, dst) <= 10")
def feature_knn(spark, d):
    wide = table(spark, d, "embeddings").select(F.col("vec_id").alias("cell_id"), F.array(*[F.col("embedding")[g].cast("double") for g in GENES_A]).alias("pc"))
    return rounded(cluster.feature_knn(wide, 10).select("src", "dst", "dist", "w"), "dist", "w")


# --- labels


@query(f"with {A} select label, count(*) as n from lab group by 1")
def label_counts(spark, d):
    return lab.label_counts(labels_a(spark, d))


_TABLE = f"{A}, t as (select a.label as a, b.label as b, count(*) as n from lab a join lab2 b using (cell_id) group by 1, 2)"


@query(f"with {_TABLE} select a, b, n from t")
def contingency(spark, d):
    return lab.contingency(labels_a(spark, d), labels_a(spark, d, True))


@query(f"""with {_TABLE}, s as (select sum(n * (n - 1) / 2) as s, sum(n) as n from t), ra as (select sum(n * (n - 1) / 2) as ra from (select sum(n) as n from t group by a)), rb as (select sum(n * (n - 1) / 2) as rb from (select sum(n) as n from t group by b))
select {r('(s - ra * rb / (n * (n - 1) / 2)) / ((ra + rb) / 2 - ra * rb / (n * (n - 1) / 2))', 'ari')} from s, ra, rb""")
def ari(spark, d):
    return rounded(lab.ari(labels_a(spark, d), labels_a(spark, d, True)), "ari")


@query(f"""with {_TABLE}, k as (select k, sum(t)::double as t, sum(p)::double as p from (select a as k, n as t, 0 as p from t union all select b, 0, n from t) group by 1),
s as (select sum(n)::double as s, sum(case when a = b then n else 0 end)::double as c from t), x as (select sum(t * p) as tp, sum(t * t) as tt, sum(p * p) as pp from k)
select {r('(c * s - tp) / sqrt((s * s - pp) * (s * s - tt))', 'mcc')} from s, x""")
def mcc(spark, d):
    return rounded(lab.mcc(labels_a(spark, d), labels_a(spark, d, True)), "mcc")


_UND = f"{knn(15)}, u as (select least(src, dst) as src, greatest(src, dst) as dst, sum(1 / (1 + dist)) as w from knn group by 1, 2)"


@query(f"with {_UND} select src, dst, {r('w')} from u")
def undirected_graph(spark, d):
    return rounded(cluster.undirected(graph.knn_graph(cells_a(spark, d), 15).withColumn("w", 1 / (1 + F.col("dist")))), "w")


@query(f"""with {_UND}, e as (select a.label as a, b.label as b, w from u join lab a on a.cell_id = src join lab b on b.cell_id = dst), m as (select sum(w) as m from e),
k as (select label, sum(w) as k from (select a as label, w from e union all select b, w from e) group by 1), i as (select a as label, sum(w) as i from e where a = b group by 1)
select {r('sum(coalesce(i, 0) / m - (k / (2 * m)) * (k / (2 * m)))', 'modularity')} from k left join i using (label), m""")
def modularity(spark, d):
    g = cluster.undirected(graph.knn_graph(cells_a(spark, d), 15).withColumn("w", 1 / (1 + F.col("dist"))))
    return rounded(lab.modularity(labels_a(spark, d), g), "modularity")


_CONN = f"{weights(15)}, n as (select label, count(*)::double as n from lab group by 1), c as (select a.label as a, b.label as b, sum(w) as s, count(*) as edges from w join lab a on a.cell_id = src join lab b on b.cell_id = dst group by 1, 2)"


@query(f"with {_CONN} select a, b, round(s / (x.n * y.n), 9) + 0.0 as v from c join n x on x.label = a join n y on y.label = b")
def connections(spark, d):
    out = lab.connections(labels_a(spark, d), graph.spatial_weights(cells_a(spark, d), 0, 15))
    return rounded(out, "v", digits=9)


@query(f"with {_CONN} select a, b, edges as n, {r('edges::double / max(case when a = b then edges end) over (partition by a)', 'ratio')} from c")
def connection_grid(spark, d):
    return rounded(lab.connection_grid(labels_a(spark, d), graph.spatial_weights(cells_a(spark, d), 0, 15)), "ratio")


def _vote(source: str, name: str) -> str:
    return f"""{name}v as (select src, own, label, count(*) as n from (select k.src, o.label as own, l.label from (select src, dst from knn union all select cell_id, cell_id from cells) k join {source} o on o.cell_id = k.src join {source} l on l.cell_id = k.dst) group by 1, 2, 3),
{name}t as (select src, own, arg_max(label, n * 1000 - label) as most, max(n) as top, sum(n) as total from {name}v group by 1, 2), {name} as (select src as cell_id, case when most <> own and top >= (total - 1) // 2 + 1 then most else own end as label from {name}t)"""


@query(f"with {knn(6)}, {_vote('lab', 'one')} select cell_id, label from one")
def refine_once(spark, d):
    return lab.refined_once(labels_a(spark, d), graph.knn_graph(cells_a(spark, d), 6))[0]


@query(f"with {knn(6)}, {_vote('lab', 'one')}, {_vote('one', 'two')} select cell_id, label from two")
def refine_two_rounds(spark, d):
    return lab.refined(labels_a(spark, d), graph.knn_graph(cells_a(spark, d), 6), "num_iter", 2)[0]


@query(f"with {knn(6)}, {_vote('lab', 'one')}, e as (select src, -sum(n / total * ln(n / total)) as e from onev join (select src, total from onet) using (src) group by 1) select {r('avg(e)', 'entropy')} from e")
def neigh_entropy(spark, d):
    return rounded(lab.refined_once(labels_a(spark, d), graph.knn_graph(cells_a(spark, d), 6))[1], "entropy")


@query(f"with {A} select label, coalesce(name, 'other') as name from (select distinct label from lab) left join (values (0, 'zero'), (3, 'three')) n(label, name) using (label)")
def pad_clusters(spark, d):
    return lab.padded(spark.createDataFrame([(0, "zero"), (3, "three")], "label int, name string"), labels_a(spark, d))


@query(f"with {A} select cell_id, label from lab2")  # most cells keep their label, so each label is matched to itself
def match_labels(spark, d):
    return lab.matched(labels_a(spark, d), labels_a(spark, d, True))


@query(f"with {A} select cell_id, (case when cell_id % 11 = 0 then 2 else label * 4 end)::int as label from lab")
def match_renamed_labels(spark, d):
    """Labels in another order and with gaps get their names back; a label too many goes into the middle of the first widest gap."""
    one, c = labels_a(spark, d), F.col("cell_id")
    return lab.matched(one.withColumn("label", F.col("label") * 4), one.withColumn("label", F.when(c % 11 == 0, 99).otherwise(50 - 3 * F.col("label")).cast("int")))


@query(f"with {A} select cell_id, (label * 2)::int as label, 0 as \"table\" from lab union all select cell_id, (label * 2)::int, 1 from lab2")
def match_series_renamed(spark, d):
    """The first table's ids start from 0 and keep their gaps; the second one's, which run backwards, follow them."""
    one, two = labels_a(spark, d), labels_a(spark, d, True)
    out = lab.matched_series([one.withColumn("label", (F.col("label") * 2 + 3).cast("int")), two.withColumn("label", (40 - F.col("label")).cast("int"))])
    return out[0].withColumn("table", F.lit(0)).unionByName(out[1].withColumn("table", F.lit(1)))


@query(f"with {A} select cell_id, (case label % 3 when 0 then 0 when 1 then 5 else 9 end)::int as label from lab")
def expanded_labels(spark, d):
    """Three ids beside a table of ten are spread over 0 to 9: seven free ids, four of them in the first gap."""
    one = labels_a(spark, d)
    return lab.matched_series([one.withColumn("label", (F.col("label") % 3).cast("int")), one])[0]


# --- metagenes and statistics

_MARKERS = [("one", "Brand#12"), ("one", "Brand#13"), ("one", "missing"), ("two", "Brand#21"), ("two", "Brand#22"), ("two", "Brand#23")]


@query(f"""with {B}, mk as (select * from (values {', '.join(map(str, _MARKERS))}) v(cell_type, gene_name) join genes using (gene_name)), n as (select cell_type, count(*)::double as n from mk group by 1)
select c.cell_id, n.cell_type, {r('coalesce(s, 0) / n', 'value')} from cells c cross join n left join (select cell_id, cell_type, sum(value) as s from expr join mk using (gene_id) group by 1, 2) x on x.cell_id = c.cell_id and x.cell_type = n.cell_type""")
def metagene(spark, d):
    markers = spark.createDataFrame(_MARKERS, "cell_type string, gene_name string")
    return rounded(stats.metagenes(cells_b(spark, d), genes_b(spark, d), expr_b(spark, d), markers), "value")


@query(f"""with {weights(15)}, nb as (select src as cell_id, gene_id, sum(w * value) as value from w join expr on dst = cell_id group by 1, 2)
select cell_id, {r('own')}, {r('nbr')} from (select cell_id, sum(case when gene_id in (2, 3) then value / 2 when gene_id in (4, 5, 6) then -value / 3 else 0 end) as own from expr group by 1) join (select cell_id, sum(case when gene_id in (2, 3) then value / 2 when gene_id in (4, 5, 6) then -value / 3 else 0 end) as nbr from nb group by 1) using (cell_id)""")
def metagene_diff(spark, d):
    e = expr_a(spark, d)
    nbr = augment.neighbour_mean(graph.spatial_weights(cells_a(spark, d), 0, 15), e)
    both = e.withColumn("k", F.lit(-1)).unionByName(nbr.withColumn("k", F.lit(0)))
    return rounded(stats.metagene_difference(both, [2, 3], [4, 5, 6]), "own", "nbr")


@query(f"with {A}, v as (select * from expr where gene_id = 2), l as (select distinct label from lab) select l.label, {r('corr((a.label = l.label)::int::double, value)', 'r')}, count(*) as n from lab a join v using (cell_id) cross join l group by 1")
def point_biserial(spark, d):
    values = expr_a(spark, d).where("gene_id = 2").select("cell_id", "value")
    return rounded(stats.point_biserial(labels_a(spark, d), values).select("label", "r", "n"), "r")


@query(f"""with {A}, k as (select e.*, l.label, rank() over (partition by gene_id order by value) + (count(*) over (partition by gene_id, value) - 1) / 2.0 as rk from expr e join lab l using (cell_id)), n as (select label, count(*)::double as n1 from lab group by 1), t as (select count(*)::double as n from lab)
select label, gene_id::int as gene_id, {r('(sum(rk) - any_value(n1) * (any_value(n) + 1) / 2) / sqrt(any_value(n1) * (any_value(n) - any_value(n1)) * (any_value(n) + 1) / 12)', 'u_z')} from k join n using (label), t group by label, gene_id""")
def wilcoxon_z(spark, d):
    return rounded(stats.wilcoxon(labels_a(spark, d), expr_a(spark, d)).select("label", "gene_id", "u_z"), "u_z")


@query(f"with {A} select a.gene_id::int as i, b.gene_id::int as j, {r('sum(a.value * b.value)', 'g')} from expr a join expr b using (cell_id) group by 1, 2")
def gram_matrix(spark, d):
    e = expr_a(spark, d)
    b = e.select("cell_id", F.col("gene_id").alias("j"), F.col("value").alias("v"))
    return rounded(e.join(b, "cell_id").groupBy(F.col("gene_id").alias("i"), "j").agg(F.sum(F.col("value") * F.col("v")).alias("g")), "g")


# --- lookups, samples and views of results


@query("select c_custkey::bigint as cell_id, c_mktsegment as sample from customer where c_mktsegment is not null and c_mktsegment <> 'BUILDING'")
def category_filter(spark, d):
    return qc.category_filter(cells_b(spark, d), "sample", "BUILDING").select("cell_id", "sample")


@query("select c_custkey::bigint as cell_id, case c_mktsegment when 'BUILDING' then 'b' when 'MACHINERY' then 'm' else 'other' end as sample from customer")
def map_categories(spark, d):
    return qc.mapped(cells_b(spark, d).select("cell_id", "sample"), "sample", {"BUILDING": "b", "MACHINERY": "m"}, "other")


@query(f"with {B} select gene_id, upper(gene_name) as gene_name from genes where upper(gene_name) in ('BRAND#12', 'BRAND#55')")
def listed_genes(spark, d):
    names = spark.createDataFrame([("brand#12",), ("Brand#55",), ("none",)], "gene_name string")
    return qc.listed_genes(genes_b(spark, d).select("gene_id", "gene_name"), names).select("gene_id", "gene_name")


@query(f"with {B} select cell_id || '-' || s as cell_id, x, s as sample, case when s = 'q' then y end as y from cells, (values ('p'), ('q')) v(s)")
def concat_samples(spark, d):
    c = cells_b(spark, d).drop("sample")
    return qc.concatenated_samples({"p": c.drop("y"), "q": c})


@query(f"with {knn(6)}, w as (select src, dst, 1 / (1 + dist) as w from knn) select src, dst, {r('a.x', 'x0')}, {r('a.y', 'y0')}, {r('b.x', 'x1')}, {r('b.y', 'y1')}, {r('w / (select max(w) from w)', 'rel_w')} from w join cells a on a.cell_id = src join cells b on b.cell_id = dst")
def edge_segments(spark, d):
    c = cells_a(spark, d)
    e = graph.knn_graph(c, 6).withColumn("w", 1 / (1 + F.col("dist")))
    return rounded(graph.edge_segments(e, c), "x0", "y0", "x1", "y1", "rel_w")


for _diagonal, _expr in (("zero", "case when a = b then 0 else v end"), ("scale", "v / max(case when a = b then v end) over (partition by a)")):

    @query(f"with {_CONN}, q as (select a, b, s / (x.n * y.n) as v from c join n x on x.label = a join n y on y.label = b) select a, b, round({_expr}, 6) + 0.0 as v from q", f"connections_{_diagonal}")
    def _connections(spark, d, diagonal=_diagonal):
        return rounded(lab.connections(labels_a(spark, d), graph.spatial_weights(cells_a(spark, d), 0, 15), diagonal=diagonal), "v")


@query(f"with {knn(6)}, cut as (select quantile_cont(dist, 0.9) as c from knn), near as (select src, dst from knn, cut where dist < c), {_vote('lab', 'one').replace('from knn union', 'from near union')} select cell_id, label from one")
def refine_percentile(spark, d):
    return lab.refined_once(labels_a(spark, d), graph.knn_graph(cells_a(spark, d), 6), percentile=0.9)[0]


@query(f"""with {weights(15)}, nb as (select src as cell_id, gene_id, sum(w * value) as value from w join expr on dst = cell_id group by 1, 2)
select e.cell_id, e.gene_id::int as gene_id, {r('e.value * sqrt(0.8)', 'own')}, {r('nb.value * sqrt(0.2)', 'nbr')} from expr e join nb using (cell_id, gene_id)""")
def self_vs_neighbour(spark, d):
    e = expr_a(spark, d)
    nbr = augment.neighbour_mean(graph.spatial_weights(cells_a(spark, d), 0, 15), e)
    both = e.withColumn("k", F.lit(-1)).unionByName(nbr.withColumn("k", F.lit(0)))
    return rounded(stats.self_vs_neighbour(both, 0.2), "own", "nbr")


@query("select vec_id as cell_id, round(embedding[3]::double + embedding[4]::double, 6) + 0.0 as value from embeddings")
def composition(spark, d):
    wide = table(spark, d, "embeddings").select(F.col("vec_id").alias("cell_id"), F.col("embedding")[2].cast("double").alias("p"), F.col("embedding")[3].cast("double").alias("q"))
    return rounded(stats.composition(wide, ["p", "q"]).select("cell_id", "value"), "value")


_RANKED = f"""with {A}, k as (select e.*, l.label, rank() over (partition by gene_id order by value) + (count(*) over (partition by gene_id, value) - 1) / 2.0 as rk from expr e join lab l using (cell_id)), n as (select label, count(*)::double as n1 from lab group by 1), t as (select count(*)::double as n from lab),
z as (select label, gene_id, (sum(rk) - any_value(n1) * (any_value(n) + 1) / 2) / sqrt(any_value(n1) * (any_value(n) - any_value(n1)) * (any_value(n) + 1) / 12) as u_z from k join n using (label), t group by label, gene_id)"""


@query(f"{_RANKED} select label, gene_id::int as gene_id, row_number() over (partition by label order by u_z desc, gene_id) as rank from z qualify rank <= 3")
def top_genes(spark, d):
    return stats.top_genes(stats.wilcoxon(labels_a(spark, d), expr_a(spark, d)), 3).select("label", "gene_id", F.col("rank").cast("long").alias("rank"))


@query(f"""with {A}, t as (select (vec_id % 2)::varchar as sample, a.label as a, b.label as b, count(*) as n from embeddings join lab a on a.cell_id = vec_id join lab2 b on b.cell_id = vec_id group by 1, 2, 3),
s as (select sample, sum(n * (n - 1) / 2) as s, sum(n) as n from t group by 1), ra as (select sample, sum(n * (n - 1) / 2) as ra from (select sample, sum(n) as n from t group by sample, a) group by 1), rb as (select sample, sum(n * (n - 1) / 2) as rb from (select sample, sum(n) as n from t group by sample, b) group by 1)
select sample, {r('(s - ra * rb / (n * (n - 1) / 2)) / ((ra + rb) / 2 - ra * rb / (n * (n - 1) / 2))', 'ari')} from s join ra using (sample) join rb using (sample)""")
def ari_by_sample(spark, d):
    samples = cells_a(spark, d).select("cell_id", (F.col("cell_id") % 2).cast("string").alias("sample"))
    return rounded(stats.per_sample_ari(labels_a(spark, d), labels_a(spark, d, True), samples), "ari")


@query(f"with {B} select cell_id, g.gene_id, coalesce(value, 0.0) as value from cells cross join genes g left join expr using (cell_id, gene_id)")
def dense_matrix(spark, d):
    return augment.dense(cells_b(spark, d), genes_b(spark, d), expr_b(spark, d))


@query(_augmented_sql(0.2, False))  # eight z-scored features have fewer directions than are balanced: every block's variance is theirs
def variance_balanced(spark, d):
    return rounded(plans.augmented(cells_a(spark, d), expr_a(spark, d), 0.2, variance_balance=True).select("cell_id", "gene_id", "k", "value"), "value")


@query(f"""with {weights(15)}, own as (select cell_id, gene_id, value from expr where gene_id in (2, 3)), nbr as (select src as cell_id, gene_id, sum(w * value) as value from w join own on cell_id = dst group by 1, 2),
f as (select sqrt((1 + abs((select corr(a.value, b.value) from own a join own b using (cell_id) where a.gene_id = 2 and b.gene_id = 3))) / (1 + abs((select corr(a.value, b.value) from nbr a join nbr b using (cell_id) where a.gene_id = 2 and b.gene_id = 3)))) as f)
select cell_id, gene_id::int as gene_id, -1 as k, {r('value')} from own union all select cell_id, gene_id::int, 0, {r('value * f', 'value')} from nbr, f""")  # of two z-scored features the first direction holds 1 + |correlation|
def variance_balanced_by_one_direction(spark, d):
    expr = expr_a(spark, d).where("gene_id in (2, 3)")
    blocks = plans.variance_balanced(plans.neighbour_blocks(plans.initialize(cells_a(spark, d), 15, max_m=0), expr), cells_a(spark, d).count(), top=1)
    return rounded(blocks[-1].withColumn("k", F.lit(-1)).unionByName(blocks[0].withColumn("k", F.lit(0))).select("cell_id", "gene_id", "k", "value"), "value")


_LF = lambda x: f"lgamma({x} + 1)"


@query(f"""with {_TABLE}, n as (select sum(n)::double as n from t), ra as (select a, sum(n)::double as x from t group by a), rb as (select b, sum(n)::double as y from t group by b),
mi as (select sum(t.n / n.n * ln(n.n * t.n / (x * y))) as mi from t join ra using (a) join rb using (b), n), ha as (select -sum(x / n * ln(x / n)) as ha from ra, n), hb as (select -sum(y / n * ln(y / n)) as hb from rb, n),
cells2 as (select x, y, n, unnest(range(greatest(1, x + y - n)::bigint, least(x, y)::bigint + 1))::double as k from ra, rb, n),
e as (select sum(k / n * ln(n * k / (x * y)) * exp({_LF('x')} + {_LF('y')} + {_LF('n - x')} + {_LF('n - y')} - {_LF('n')} - {_LF('k')} - {_LF('x - k')} - {_LF('y - k')} - {_LF('n - x - y + k')})) as e from cells2)
select {r('(mi - e) / ((ha + hb) / 2 - e)', 'ami')} from mi, ha, hb, e""")
def ami(spark, d):
    return rounded(spark.createDataFrame([(lab.ami(labels_a(spark, d), labels_a(spark, d, True)),)], "ami double"), "ami")


@query(f"with {A} select cell_id, label, 0 as \"table\" from lab union all select cell_id, label, 1 from lab2")  # ten labels from 0 to 9 are spread already
def match_series(spark, d):
    out = lab.matched_series([labels_a(spark, d), labels_a(spark, d, True)])
    return out[0].withColumn("table", F.lit(0)).unionByName(out[1].withColumn("table", F.lit(1)))


@query()
def remaining_variance(spark, d):
    ratio = red.fit_pca(_matrix(spark, d), 24)[2]
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(red.remaining_variance(ratio))], "component int, left double")


def _moments(n: int) -> str:
    """l{i} is L applied i times to the centred genes l0."""
    return ", ".join(f"l{i + 1} as materialized (select l.cell_id, l.gene_id, any_value(l.v) - sum(x.v / sqrt(a.n * b.n)) as v from l{i} l join e on e.a = l.cell_id join deg a on a.a = e.a join deg b on b.a = e.b join l{i} x on x.cell_id = e.b and x.gene_id = l.gene_id group by 1, 2)" for i in range(n))


_SHARE = f"""{knn(6)}, e as (select src as a, dst as b from knn union select dst, src from knn), deg as (select a, count(*)::double as n from e group by 1),
l0 as materialized (select cell_id, gene_id, value - avg(value) over (partition by gene_id) as v from expr), {_moments(16)},
mu as ({' union all '.join(f'select {j} as j, a.gene_id, sum(a.v * b.v) as mu from l{j // 2} a join l{(j + 1) // 2} b using (cell_id, gene_id) group by 2' for j in range(33))}),
share as (select gene_id, sum(pow(-4.0, j) / gamma(j + 1) * mu) / max(mu) filter (j = 0) as share, max(mu) filter (j = 0) as energy from mu group by 1)"""


@query(f"with {_SHARE} select gene_id::int as gene_id, {r('energy')}, {r('share')}, row_number() over (order by round(share, 10) desc, gene_id)::int as rank, row_number() over (order by round(share, 10) desc, gene_id) <= 3 as spatially_variable from share")
def spatially_variable_genes(spark, d):
    """The smooth share of each gene, which SQL takes from the series of exp(-4 L) in powers of the Laplacian."""
    return rounded(spatial_genes.spatially_variable(expr_a(spark, d), graph.knn_graph(cells_a(spark, d), 6), 3), "energy", "share")


# --- reduction and clustering: iterative, checked by tests instead of SQL


def _matrix(spark, d, lam: float = 0.2) -> DataFrame:
    return augment.wide(plans.augmented(cells_a(spark, d), expr_a(spark, d), lam))


@query()
def pca_scores(spark, d):
    return red.pca(_matrix(spark, d), 8)


@query()
def noise_floor(spark, d):
    e = augment.wide(expr_a(spark, d).withColumn("k", F.lit(-1)))
    return spark.createDataFrame([(red.noise_floor(e),)], "noise double")


def _graph(spark, d) -> DataFrame:
    return kept(cluster.shared_graph(kept(cluster.feature_knn(red.pca(_matrix(spark, d), 8), 15))))


@query()
def leiden_labels(spark, d):
    return cluster.leiden(cells_a(spark, d), _graph(spark, d), 0.7)


@query()
def gmm_labels(spark, d):
    return cluster.gaussian_mixture(red.pca(_matrix(spark, d), 4), 5)


@query()
def resolution_search(spark, d):
    resolution, labels = cluster.find_resolution(cells_a(spark, d), _graph(spark, d), 7)
    return labels.withColumn("resolution", F.lit(resolution))


@query()
def pipeline_results(spark, d):
    s = plans.Settings(lambdas=(0.2,), pcs=(8,), resolutions=(0.7,), feature_neighbours=15, refine="once")
    return plans.run(cells_a(spark, d), expr_a(spark, d), s, labels_a(spark, d))[0]


# --- the same where SQL can tell the result


@query(f"with recursive {_NEAR}, reach as (select src as a, dst as b from near union select r.a, n.dst from reach r join near n on n.src = r.b) select cell_id, least(cell_id, coalesce(min(b), cell_id)) as \"first\" from cells left join reach on a = cell_id group by cell_id")
def leiden_connected(spark, d):
    """At resolution 0 nothing holds communities apart: they are the graph's connected components."""
    c = cells_a(spark, d)
    labels = kept(cluster.leiden(c, graph.radius_graph(c, 0.03).withColumn("w", F.lit(1.0)), 0.0))
    return labels.join(labels.groupBy("label").agg(F.min("cell_id").alias("first")), "label").select("cell_id", "first")


_CENTRED = f"{A}, z as (select cell_id, gene_id, value - avg(value) over (partition by gene_id) as z from expr)"


@query(f"with {_CENTRED} select cell_id, {r('sum(z * z)', 'norm2')} from z group by cell_id")
def pca_norms(spark, d):
    """All components together keep each cell's distance from the mean."""
    scores = red.pca(augment.wide(expr_a(spark, d).withColumn("k", F.lit(-1))), 8)
    return rounded(scores.select("cell_id", F.aggregate("pc", F.lit(0.0), lambda s, x: s + x * x).alias("norm2")), "norm2")


def _power(matrix: str, out: str) -> str:
    """The direction that 3,000 steps of power iteration reach, its largest loading positive."""
    step = f"select n + 1 as n, m, list_transform(m, lambda row: list_dot_product(row, v)) as u from {out}_it where n < 3000"
    return f"""{out}_it(n, m, v) as (select 0, m, list_transform(m, lambda row, i: 1.0 + i / 7.0) from {matrix} union all select n, m, list_transform(u, lambda x: x / sqrt(list_dot_product(u, u))) from ({step})),
{out} as (select m, list_transform(v, lambda x: x * sign(list_first(list_reverse_sort(list_transform(v, lambda y: {{'a': abs(y), 's': y}}))).s)) as v from {out}_it where n = 3000)"""


@query(f"""with recursive {_CENTRED}, pairs as (select a.gene_id as i, b.gene_id as j, sum(a.z * b.z) as g from z a join z b using (cell_id) group by 1, 2),
m0 as (select list(g order by i) as m from (select i, list(g order by j) as g from pairs group by i)), {_power('m0', 'one')},
m1 as (select list_transform(m, lambda row, i: list_transform(row, lambda x, j: x - list_dot_product(list_transform(m, lambda q: list_dot_product(q, v)), v) * v[i] * v[j])) as m from one), {_power('m1', 'two')}
select cell_id, {r('sum(z * one.v[gene_id - 1])', 'first')}, {r('sum(z * two.v[gene_id - 1])', 'second')} from z, one, two group by cell_id""")
def pca_directions(spark, d):
    """The two leading components by the range finder, whose directions SQL finds by power iteration."""
    e = kept(augment.wide(expr_a(spark, d).withColumn("k", F.lit(-1))))
    _, mean, _, vectors, _ = red.leading(e, 2)
    pc = red.projected(e, mean, red.signed(vectors))
    return rounded(pc.select("cell_id", F.col("pc")[0].alias("first"), F.col("pc")[1].alias("second")), "first", "second")


_TWO = f"{_CENTRED}, m as (select sum(a.z * a.z) as p, sum(b.z * b.z) as q, sum(a.z * b.z) as c from z a join z b using (cell_id) where a.gene_id = 2 and b.gene_id = 3), v as (select (p + q + sqrt((p - q) * (p - q) + 4 * c * c)) / 2 as hi, (p + q - sqrt((p - q) * (p - q) + 4 * c * c)) / 2 as lo from m)"


def _two(spark, d) -> DataFrame:
    return augment.wide(expr_a(spark, d).where("gene_id in (2, 3)").withColumn("k", F.lit(-1)))


@query(f"with {_TWO} select 0 as component, {r('sqrt(hi)', 'value')} from v union all select 1, {r('sqrt(lo)', 'value')} from v")
def singular_values(spark, d):
    return rounded(spark.createDataFrame([(i, float(x)) for i, x in enumerate(red.singular_values(_two(spark, d)))], "component int, value double"), "value")


@query(f"with {_TWO} select 0 as component, {r('lo / (hi + lo)', 'left_over')} from v union all select 1, 0.0 from v")
def remaining_variance_of_two(spark, d):
    ratio = red.fit_pca(_two(spark, d), 2)[2]
    return rounded(spark.createDataFrame([(i, float(v)) for i, v in enumerate(red.remaining_variance(ratio))], "component int, left_over double"), "left_over")


@query(f"with {_CENTRED} select {r('sqrt(sum(z * z))', 'noise')} from z where gene_id = 2")
def noise_floor_of_one(spark, d):
    """A single column's singular value is the same in any order."""
    e = augment.wide(expr_a(spark, d).where("gene_id = 2").withColumn("k", F.lit(-1)))
    return rounded(spark.createDataFrame([(red.noise_floor(e, 3),)], "noise double"), "noise")


def _embedding(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("cell_id"), F.array(*[F.col("embedding")[g].cast("double") for g in GENES_A]).alias("pc"))


@query()
def harmony(spark, d):
    return red.harmonised(_embedding(spark, d), cells_a(spark, d).select("cell_id", (F.col("cell_id") % 3).cast("string").alias("batch")))


@query(f"with {A} select cell_id, {r('sum(value)', 'total')} from expr group by cell_id")
def harmony_one_batch(spark, d):
    """With one batch there is nothing to take off."""
    out = red.harmonised(_embedding(spark, d), cells_a(spark, d).select("cell_id", F.lit("all").alias("batch")))
    return rounded(out.select("cell_id", F.aggregate("pc", F.lit(0.0), lambda s, x: s + x).alias("total")), "total")


@query(f"with {A}, m as (select label, gene_id, avg(value) as m from expr join lab using (cell_id) group by 1, 2), p as (select dense_rank() over (order by label) - 1 as k, gene_id, m from m), c as (select a.k as a, b.k as b, 1 - corr(a.m, b.m) as dist from p a join p b on a.gene_id = b.gene_id and a.k < b.k group by 1, 2) select a::int as a, b::int as b, {r('dist', 'distance')} from c order by dist, a, b limit 1")
def dendrogram_first(spark, d):
    return rounded(stats.merges(labels_a(spark, d), expr_a(spark, d)).where("step = 0").select("a", "b", "distance"), "distance")


def _linkage(groups: int) -> str:
    """Average linkage step by step: d{i} the distances and s{i} the sizes before step i, m{i} the nearest pair."""
    out = []
    for i in range(groups - 1):
        out.append(f"m{i} as materialized (select a, b, dist from d{i} order by dist, a, b limit 1)")
        out.append(f"s{i + 1} as materialized (select k, n from s{i}, m{i} where k not in (a, b) union all select {groups + i}, sum(n) from s{i}, m{i} where k in (a, b))")
        out.append(
            f"""d{i + 1} as materialized (select d.a, d.b, d.dist from d{i} d, m{i} m where d.a not in (m.a, m.b) and d.b not in (m.a, m.b) union all
select case when d.a in (m.a, m.b) then d.b else d.a end, {groups + i}, sum(d.dist * s.n) / sum(s.n) from d{i} d, m{i} m, s{i} s where ((d.a in (m.a, m.b)) <> (d.b in (m.a, m.b))) and s.k = case when d.a in (m.a, m.b) then d.a else d.b end group by 1)"""
        )
    return ", ".join(out)


@query(f"""with {A}, m as (select label, gene_id, avg(value) as m from expr join lab using (cell_id) group by 1, 2), p as (select dense_rank() over (order by label) - 1 as k, gene_id, m from m),
d0 as materialized (select a.k as a, b.k as b, 1 - corr(a.m, b.m) as dist from p a join p b on a.gene_id = b.gene_id and a.k < b.k group by 1, 2), s0 as (select distinct k, 1 as n from p), {_linkage(10)}
{' union all '.join(f"select {i} as step, a::int as a, b::int as b, {r('dist', 'distance')} from m{i}" for i in range(9))}""")
def dendrogram(spark, d):
    return rounded(stats.merges(labels_a(spark, d), expr_a(spark, d)).select("step", "a", "b", "distance"), "distance")


# --- files: written to the shared folder and read again


def _folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _text(df: DataFrame, path: str, head: list[str] = []) -> None:
    """Lines of df(n, line) in order of n, in parts; lines that come before all others are a part of their own, the first."""
    if head:
        df.sparkSession.createDataFrame([(x,) for x in head], "line string").coalesce(1).write.text(path)
    df.repartitionByRange("n").sortWithinPartitions("n").select("line").write.mode("append").text(path)


@query(f"with {B}, s as (select o_custkey % 40 as k, gene_id, sum(l_quantity::double) as value from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey join genes using (p_brand) group by 1, 2) select 'c' || k as cell_name, gene_name, k::double as x, -k::double as y, value from s join genes using (gene_id)")
def load_csv(spark, d):
    """A gene-by-cell matrix of 40 groups of customers, and their places."""
    e = expr_b(spark, d).groupBy((F.col("cell_id") % 40).alias("k"), "gene_id").agg(F.sum("value").alias("value"))
    wide = e.join(F.broadcast(genes_b(spark, d)), "gene_id").groupBy(F.col("gene_name").alias("gene")).pivot("k", list(range(40))).agg(F.first("value"))
    matrix, places = _folder(spark, "matrix"), _folder(spark, "places")
    sources.write(wide.select("gene", *[F.coalesce(F.col(str(k)), F.lit(0.0)).alias(f"c{k}") for k in range(40)]), matrix, "csv")
    sources.write(spark.range(40).selectExpr("concat('c', id) as id", "cast(id as double) as xcoord", "cast(-id as double) as ycoord"), places, "csv")
    cells, genes, expr = sources.load(spark, matrix, places)
    return expr.join(cells, "cell_id").join(genes, "gene_id").select("cell_name", "gene_name", "x", "y", "value")


@query(f"with {B} select cell_id, sample, gene_name, value from expr join cells using (cell_id) join genes using (gene_id)")
def load_parquet(spark, d):
    folder = _folder(spark, "tables")
    for name, df in (("cells", cells_b(spark, d)), ("genes", genes_b(spark, d)), ("expr", expr_b(spark, d))):
        sources.write(df, f"{folder}/{name}.parquet")
    cells, genes, expr = sources.load(spark, parquet=folder)
    return expr.join(cells, "cell_id").join(genes, "gene_id").select("cell_id", "sample", "gene_name", "value")


@query("select 'b' || c_custkey as barcode, (c_custkey % 2)::int as x1, c_acctbal::double as x_pixel, case when c_custkey % 3 = 0 then c_mktsegment else 'other' end as layer from customer")
def tissue_positions(spark, d):
    c = table(spark, d, "customer").withColumn("barcode", F.concat(F.lit("b"), F.col("c_custkey").cast("string")))
    places, notes = _folder(spark, "positions"), _folder(spark, "notes")
    c.select("barcode", (F.col("c_custkey") % 2).cast("int"), F.lit(1), F.lit(2), F.col("c_acctbal").cast("double"), F.lit(0.5)).write.csv(places)
    c.where("c_custkey % 3 = 0").select("barcode", F.lit("151673"), "c_mktsegment").write.csv(notes, sep="\t")
    return sources.annotated(sources.read_positions(spark, places), sources.read_annotations(spark, notes)).select("barcode", "x1", "x_pixel", "layer")


@query(f"with {B} select cell_id as \"row\", gene_id::bigint as col, value from expr")
def matrix_market(spark, d):
    e, path = expr_b(spark, d), _folder(spark, "market")
    _text(e.select(F.col("cell_id").alias("n"), F.concat_ws(" ", F.col("cell_id") + 1, F.col("gene_id") + 1, "value").alias("line")), path, ["%%MatrixMarket matrix coordinate real general", "1000000 25 0"])
    return sources.read_matrix_market(spark, path)


@query(f"with {B} select 'b' || c as barcode, gene_name, value from (select row_number() over (order by cell_id) - 1 as at, cell_id as c from (select distinct cell_id from expr)) join expr on cell_id = c join genes using (gene_id)")
def read_10x(spark, d):
    e, folder = kept(expr_b(spark, d)), _folder(spark, "10x")
    cells = kept(running(e.select("cell_id").distinct(), ["cell_id"], F.lit(1), "at"))
    _text(cells.select(F.col("at").alias("n"), F.concat(F.lit("b"), F.col("cell_id").cast("string")).alias("line")), f"{folder}/barcodes.tsv")
    _text(genes_b(spark, d).select(F.col("gene_id").alias("n"), F.concat_ws("\t", "p_brand", "gene_name", F.lit("Gene Expression")).alias("line")), f"{folder}/features.tsv")
    _text(e.join(cells, "cell_id").select(F.col("at").alias("n"), F.concat_ws(" ", F.col("gene_id") + 1, F.col("at") + 1, "value").alias("line")), f"{folder}/matrix.mtx", ["%%MatrixMarket matrix coordinate real general", "25 1000000 0"])
    cells, genes, expr = sources.read_10x(spark, folder)
    return expr.join(cells, "cell_id").join(F.broadcast(genes), "gene_id").select("barcode", "gene_name", "value")


@query("select vec_id as cell_id, label, g.gene_id::int as gene_id, round(embedding[g.gene_id + 1]::double, 6) + 0.0 as value from embeddings, (select unnest(range(0, 3)) as gene_id) g where label in (1, 2)")
def wide_csv(spark, d):
    path = _folder(spark, "wide")
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), *[F.col("embedding")[i].cast("double").alias(f"m{i}") for i in range(3)], "label")
    sources.write(e, path, "csv")
    cells, _, expr = sources.split_wide(spark.read.csv(path, header=True, inferSchema=True), 3, "id")
    chosen = cells.where(F.col("label").isin(1, 2)).select(F.col("id").cast("long").alias("cell_id"), F.col("label").cast("long").alias("label"))
    return rounded(expr.withColumn("cell_id", F.col("cell_id").cast("long")).join(chosen, "cell_id").select("cell_id", "label", "gene_id", "value"), "value")


@query(f"with {B} select upper(gene_name) as gene_name from genes where gene_name like 'Brand#1%'")
def gene_list(spark, d):
    path = _folder(spark, "genes")
    sources.write_gene_list(genes_b(spark, d).where("gene_name like 'Brand#1%'"), path)
    return sources.read_gene_list(spark, path)


# --- views of results


@query(f"with {A} select cell_id, gene_id::int as gene_id, {r(f'{_Z} * sqrt(0.8)', 'value')} from expr")
def self_features(spark, d):
    return rounded(augment.self_features(plans.augmented(cells_a(spark, d), expr_a(spark, d), 0.2)).select("cell_id", "gene_id", "value"), "value")


@query(f"with {knn(15)} select src, dst, {r('degrees(atan2(dy, dx))', 'degrees')} from knn")
def theta_degrees(spark, d):
    return rounded(graph.theta_degrees(graph.knn_graph(cells_a(spark, d), 15)).select("src", "dst", "degrees"), "degrees")


@query(f"with {A} select label, cell_id, 1.0::double as v from lab where label <> 4")
def onehot_without_gaps(spark, d):
    return graph.labels_to_onehot(labels_a(spark, d).where("label <> 4"), False, gaps=False).withColumn("v", F.col("v").cast("double"))


_T = "exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(df * pi()) * (1 + u * u / df) ** (-(df + 1) / 2)"


@query(f"""with {A}, v as (select * from expr where gene_id = 2), l as (select distinct label from lab), c as (select l.label, corr((a.label = l.label)::int::double, value) as r, count(*) - 2.0 as df from lab a join v using (cell_id) cross join l group by 1),
t as (select label, r, df, abs(r) * sqrt(df / (1 - r * r)) as t from c), s as (select label, df, t, i, t * i / 4000 as u from t, (select unnest(range(0, 4001)) as i)), p as (select label, 1 - 2 * sum({_T} * case when i in (0, 4000) then 1 when i % 2 = 1 then 4 else 2 end * t / 12000) as p from s group by 1)
select label, {r('p')} from p""")  # by Simpson's rule
def point_biserial_p(spark, d):
    values = expr_a(spark, d).where("gene_id = 2").select("cell_id", "value")
    return rounded(stats.with_p_value(stats.point_biserial(labels_a(spark, d), values)).select("label", "p"), "p")


_RANKED = f"with {A}, rk as (select cell_id, gene_id, rank() over (partition by gene_id order by value) + (count(*) over (partition by gene_id, value) - 1) / 2.0 as rk from expr), n as (select count(*)::double as n from lab), "
_UZ = "select label, gene_id, (sum(rk) - count(*) * (n + 1) / 2) / sqrt(count(*) * (n - count(*)) * (n + 1) / 12) as u_z from rk join lab using (cell_id), n group by label, gene_id, n"


@query(f"""{_RANKED} u as ({_UZ}), t as (select label, gene_id, u_z, i, abs(u_z) + i * 12 / 4000.0 as x from u, (select unnest(range(0, 4001)) as i)),
p as (select label, gene_id, u_z, sum(exp(-x * x / 2) * case when i in (0, 4000) then 1 when i % 2 = 1 then 4 else 2 end) * (12 / 4000.0) / 3 / sqrt(2 * pi()) as p from t group by 1, 2, 3)
select label, gene_id::int as gene_id, {r('u_z')}, {r('-log10(2 * p)', 'minus_log10_p')} from p""")  # the tail by Simpson's rule
def volcano(spark, d):
    return rounded(stats.volcano(stats.wilcoxon(labels_a(spark, d), expr_a(spark, d)).select("label", "gene_id", "u_z")), "u_z", "minus_log10_p")


@query(f"""with {B}, q as (select c.cell_id, coalesce(sum(value), 0)::double as t, count(*) filter (value > 0)::double as g from cells c left join expr using (cell_id) group by 1),
l as (select 'total' as panel, t as x from q union all select 'total_bounded', t from q where t < 900 union all select 'genes', g from q union all select 'genes_bounded', g from q where g < 24 and g > 5),
e as (select panel, min(x) as lo, (max(x) - min(x)) / 20 as step from l group by 1)
select panel, least(floor((x - lo) / step), 19)::int as bin, round(lo + least(floor((x - lo) / step), 19) * step, 6) + 0.0 as low, count(*) as n from l join e using (panel) group by 1, 2, 3""")
def qc_histograms(spark, d):
    q = qc.qc_cells(cells_b(spark, d), genes_b(spark, d), expr_b(spark, d), ())
    return rounded(plans.qc_histograms(q, 900, 5, 24, bins=20), "low")


@query(f"with {B} select cell_id, x, y, sqrt((x - 4000) * (x - 4000) + (y - 5000) * (y - 5000)) < 2550 as kept from cells")
def kept_positions(spark, d):
    c = cells_b(spark, d)
    return plans.kept_positions(c, qc.circle_filter(c, 4000, 5000, 2550))


@query(f"with {A} select cell_id, {r('x')}, {r('y')}, label from cells join lab using (cell_id) where label <> 3")
def labelled_positions(spark, d):
    return rounded(plans.labelled_positions(cells_a(spark, d), labels_a(spark, d).where("label <> 3")), "x", "y")


@query('select vec_id as cell_id, round(embedding[3]::double, 6) + 0.0 as "first", round(embedding[4]::double, 6) + 0.0 as "second", label::int as label from embeddings')
def labelled_embedding(spark, d):
    return rounded(plans.labelled_embedding(_embedding(spark, d), labels_a(spark, d)), "first", "second")


def _stack(spark, d) -> DataFrame:
    one, two = labels_a(spark, d), labels_a(spark, d, True)
    keys = [("scaled_gaussian", 0.2, 20, 0.7), ("scaled_gaussian", 0.8, 20, 0.7), ("nonspatial", 0.0, 20, 0.7)]
    return plans.stacked(dict(zip(keys, (one, two, two))))


@query(f"with {A} select cell_id, label, case label when 0 then 'zero' when 1 then 'one' end as cell_type, true as spatial from lab union all select cell_id, label, case label when 1 then 'uno' end, false from lab2")
def spatial_and_nonspatial(spark, d):
    one, two = plans.spatial_and_nonspatial(_stack(spark, d), 20, 0.2, 0.7, {0: "zero", 1: "one"}, {1: "uno"})
    return one.withColumn("spatial", F.lit(True)).unionByName(two.withColumn("spatial", F.lit(False)))


@query("select 0 as at, 20.0::double as dims union all select 1, 0.95")
def pca_dims(spark, d):
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(plans.pca_dims(["reduced_pc_20", "coord_xy", "reduced_pc_0.95", "reduced_pc_20_umap"]))], "at int, dims double")


@query("with s as (select 'b' || (vec_id % 3) as decay, vec_id / 100.0 as lambda_param, (vec_id % 5)::int as num_pcs, label::int as num_labels from embeddings) select row_number() over (order by decay, lambda_param, num_pcs) as at, decay, lambda_param::double as lambda_param, (select max(num_labels) from s) as most from s")
def sorted_results(spark, d):
    e = table(spark, d, "embeddings").select(F.concat(F.lit("b"), (F.col("vec_id") % 3).cast("string")).alias("decay"), (F.col("vec_id") / 100).alias("lambda_param"), (F.col("vec_id") % 5).cast("int").alias("num_pcs"), F.lit(0.7).alias("resolution"), F.col("label").cast("int").alias("num_labels"))
    order = ["decay", "lambda_param", "num_pcs", "resolution"]
    rows, most = plans.sorted_results(e)
    return running(rows, order, F.lit(1), "at").select((F.col("at") + 1).cast("long").alias("at"), "decay", "lambda_param", F.lit(most).alias("most"))


@query(f"""with {A}, t as (select (vec_id % 4)::varchar as sample, a.label as a, b.label as b, count(*) as n from embeddings join lab a on a.cell_id = vec_id join lab2 b on b.cell_id = vec_id group by 1, 2, 3),
s as (select sample, sum(n * (n - 1) / 2) as s, sum(n) as n from t group by 1), ra as (select sample, sum(n * (n - 1) / 2) as ra from (select sample, sum(n) as n from t group by sample, a) group by 1), rb as (select sample, sum(n * (n - 1) / 2) as rb from (select sample, sum(n) as n from t group by sample, b) group by 1),
q as (select sample, (s - ra * rb / (n * (n - 1) / 2)) / ((ra + rb) / 2 - ra * rb / (n * (n - 1) / 2)) as ari from s join ra using (sample) join rb using (sample))
select case when sample = '0' then 5 else 7 end as target, {r('median(ari)', 'median_ari')}, count(*) as n from q group by 1""")
def ari_median(spark, d):
    samples = cells_a(spark, d).select("cell_id", (F.col("cell_id") % 4).cast("string").alias("sample"))
    targets = spark.createDataFrame([("0", 5), ("1", 7), ("2", 7), ("3", 7)], "sample string, target int")
    return rounded(stats.median_ari(stats.per_sample_ari(labels_a(spark, d), labels_a(spark, d, True), samples), targets), "median_ari")


_AUTO = ", ".join(f"{_vote(f'r{i}', f'r{i + 1}').replace('as (', 'as materialized (')}, e{i + 1} as materialized (select avg(e) as e from (select src, -sum(n / total * ln(n / total)) as e from r{i + 1}v join (select src, total from r{i + 1}t) using (src) group by 1))" for i in range(20))


@query(f"""with {knn(6)}, r0 as (select cell_id, label from lab), {_AUTO}, n as (select coalesce(min(i) filter (e * 100 <= 5), 20) as n from ({' union all '.join(f'select {i} as i, e from e{i}' for i in range(1, 21))})),
every as ({' union all '.join(f'select {i} as i, cell_id, label, e from r{i}, e{i}' for i in range(1, 21))})
select cell_id, label, {r('e', 'entropy')}, n::int as votes from every, n where i = n""")
def refine_auto(spark, d):
    labels, entropy, votes = lab.refined(labels_a(spark, d), kept(graph.knn_graph(cells_a(spark, d), 6)), "auto")
    return rounded(labels.withColumns({"entropy": F.lit(entropy), "votes": F.lit(votes)}), "entropy")
