"""A fitted neighbour search in the plane: a linear quadtree over cells, kept as tables, that other cells can be searched against.

Cells are sorted along a Z-shaped curve over their places in the marginal distributions (so neither scale nor outliers matter) and cut
into leaves of LEAF cells: crowded spots get small leaves, however small, by counts. Leaves have tight boxes; groups of FANOUT leaves,
and of groups, make the tree. A query is answered in its own leaf first; then it visits the other leaves that its k-th distance reaches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._scale import kept, met, running

#: Cells a leaf (it may hold twice as many), and leaves at most: with more cells than that allows leaves are larger, so the tree sent to all tasks stays under 100 MB.
LEAF, MOST_LEAVES = 2048, 1_000_000
FANOUT = 32
#: Queries of one leaf that go to one task; more are dealt over several, each with the leaf's cells.
QUERIES = 8192
BITS = 26


def _spread(v: np.ndarray) -> np.ndarray:
    """Bits of v at every second place."""
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        v = (v | (v << np.uint64(shift))) & np.uint64(mask)
    return v


@dataclass
class Tree:
    """cuts: ascending quantiles of x and of y. levels[0]: the leaves by (sample number, code); each level has (sid, sid, x, x, y, y), least and largest."""

    cuts: tuple[np.ndarray, np.ndarray]
    leaf: np.ndarray
    code: np.ndarray
    levels: list[np.ndarray]
    fanout: int = FANOUT

    @staticmethod
    def of(cuts: tuple[np.ndarray, np.ndarray], leaves: pa.Table) -> Tree:
        box = np.stack([leaves.column(c).to_numpy().astype(float) for c in ("sid", "sid", "x0", "x1", "y0", "y1")], axis=1).reshape(-1, 6)
        levels = [box]
        while len(levels[-1]) > FANOUT:
            at = np.arange(0, len(levels[-1]), FANOUT)
            levels.append(np.stack([(np.minimum if c % 2 == 0 else np.maximum).reduceat(levels[-1][:, c], at) for c in range(6)], axis=1))
        return Tree(cuts, leaves.column("leaf").to_numpy(), leaves.column("code").to_numpy(), levels, FANOUT)

    def codes(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        place = [(np.interp(v, c, np.linspace(0, 1, len(c))) * (2**BITS - 1)).astype(np.uint64) for v, c in zip((x, y), self.cuts)]
        return (_spread(place[0]) | (_spread(place[1]) << np.uint64(1))).astype(np.int64)

    def home(self, sid: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The number of a leaf near each point, -1 where its sample has none."""
        out, code = np.full(len(sid), -1, np.int64), self.codes(x, y)
        for s in np.unique(sid):
            lo, hi = np.searchsorted(self.levels[0][:, 0], [s, s + 1])
            if hi > lo:
                rows = sid == s
                out[rows] = lo + np.maximum(np.searchsorted(self.code[lo:hi], code[rows], side="right") - 1, 0)
        return out

    def reached(self, sid: np.ndarray, x: np.ndarray, y: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a point and the number of a leaf of its sample that comes as near as r to it."""
        at, to = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for lo in range(0, len(sid), 4096):
            p = np.repeat(np.arange(lo, min(lo + 4096, len(sid))), len(self.levels[-1]))
            node = np.tile(np.arange(len(self.levels[-1])), min(4096, len(sid) - lo))
            for k in range(len(self.levels) - 1, -1, -1):
                box = self.levels[k][node]
                dx = np.maximum(np.maximum(box[:, 2] - x[p], x[p] - box[:, 3]), 0)
                dy = np.maximum(np.maximum(box[:, 4] - y[p], y[p] - box[:, 5]), 0)
                some = (box[:, 0] <= sid[p]) & (sid[p] <= box[:, 1]) & (np.sqrt(dx * dx + dy * dy) <= r[p])
                p, node = p[some], node[some]
                if k:
                    many = np.minimum(self.fanout, len(self.levels[k - 1]) - node * self.fanout)
                    first = np.repeat(node * self.fanout - np.concatenate(([0], np.cumsum(many)[:-1])), many)
                    p, node = np.repeat(p, many), first + np.arange(len(first))
            at.append(p)
            to.append(node)
        return np.concatenate(at), np.concatenate(to)


def _columns(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table.column(c).to_numpy(zero_copy_only=False) if isinstance(table, pa.RecordBatch) else table.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in names]


def _near(src: np.ndarray, x: np.ndarray, y: np.ndarray, r: np.ndarray, dst: np.ndarray, px: np.ndarray, py: np.ndarray, k: int | None, same: bool):
    """(query, cell, distance) of the k nearest cells of each query that are no further than r; equals by ascending place of cells."""
    at, to, far = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    for lo in range(0, len(src) if len(dst) else 0, 256):
        dx, dy = px - x[lo : lo + 256, None], py - y[lo : lo + 256, None]
        d = np.sqrt(dx * dx + dy * dy)
        if same:
            d[src[lo : lo + 256, None] == dst] = np.inf
        top = r[lo : lo + 256]
        if k is not None and k < len(dst):
            top = np.minimum(top, np.partition(d, k - 1, axis=1)[:, k - 1])
        row, col = np.nonzero((d <= top[:, None]) & np.isfinite(d))
        dist = d[row, col]
        order = np.lexsort((col, dist, row))
        row, col, dist = row[order], col[order], dist[order]
        if k is not None:
            first = np.arange(len(row)) - np.searchsorted(row, row) < k
            row, col, dist = row[first], col[first], dist[first]
        at.append(row + lo)
        to.append(col)
        far.append(dist)
    return np.concatenate(at), np.concatenate(to), np.concatenate(far)


class SpatialIndex:
    """Cells fitted for neighbour searches by fit(), or read again by load() after save()."""

    def __init__(self, points: DataFrame, leaves: DataFrame, samples: DataFrame | None, cuts: tuple[np.ndarray, np.ndarray], most: int | None):
        self.points, self.leaves, self.samples, self.cuts, self.most = points, leaves, samples, cuts, most
        table = leaves.orderBy("sid", "code", "leaf").limit(2 * MOST_LEAVES).toArrow()  # as many leaves as LEAF allows
        self.tree = points.sparkSession.sparkContext.broadcast(Tree.of(cuts, table))

    @staticmethod
    def fit(cells: DataFrame, most: int | None = None) -> SpatialIndex:
        """Fits cells(cell_id, x, y[, sample]); those with a null coordinate are left out.

        most: the most neighbours that will be asked for. Of cells at one point of a sample only the most + 1 of smallest id are then kept, as
        no others can be among anyone's neighbours, and searches by radius alone aren't possible. None keeps all.
        """
        by = ["sample"] if "sample" in cells.columns else []
        base = cells.select(*by, "cell_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where("x is not null and y is not null and not isnan(x) and not isnan(y)")
        samples = None
        if by:
            samples = running(base.select("sample").distinct(), ["sample"], F.lit(1), "sid").select("sample", F.col("sid").cast("long").alias("sid"))
            base = base.join(samples, "sample").drop("sample")
        else:
            base = base.withColumn("sid", F.lit(0).cast("long"))
        if most is not None:
            spot = Window.partitionBy("sid", "x", "y").orderBy("cell_id")
            base = base.withColumn("__n", F.row_number().over(spot)).where(F.col("__n") <= most + 1).drop("__n")
        shares = F.array(*[F.lit(i / 512) for i in range(513)])
        n, qx, qy = base.agg(F.count("*"), F.percentile_approx("x", shares, 2000), F.percentile_approx("y", shares, 2000)).first()
        cuts = tuple(np.unique(np.array(q if q else [0.0], float)) for q in (qx, qy))
        size = max(LEAF, -(-n // MOST_LEAVES), 0 if most is None else most + 2)
        empty = Tree(cuts, np.zeros(0, np.int64), np.zeros(0, np.int64), [np.zeros((0, 6))])
        kind = dict(cells.dtypes)["cell_id"]

        def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(empty.codes(*_columns(b, "x", "y")))], names=[*b.schema.names, "code"])

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Leaves of the sorted cells of a range: of one sample, `size` cells or, the last, up to twice as many."""
            leaf, rest = TaskContext.get().partitionId() << 32, None
            put = lambda t, leaf: pa.Table.from_arrays([pa.array(np.full(t.num_rows, leaf)), *t.columns], names=["leaf", *t.schema.names]).to_batches()
            for b in batches:
                b = pa.Table.from_batches([b])
                rest = b if rest is None else pa.concat_tables([rest, b])
                while rest.num_rows:
                    sid = rest.column("sid").to_numpy()
                    own = int(np.searchsorted(sid, sid[0], side="right"))
                    if own == rest.num_rows and own < 2 * size:
                        break  # may go on
                    take = own if own < 2 * size else size
                    yield from put(rest.slice(0, take), leaf)
                    rest, leaf = rest.slice(take), leaf + 1
            if rest is not None and rest.num_rows:
                yield from put(rest, leaf)

        shape = f"sid long, cell_id {kind}, x double, y double, code long"
        ranged = base.select("sid", "cell_id", "x", "y").mapInArrow(coded, shape).repartitionByRange("sid", "code", "cell_id").sortWithinPartitions("sid", "code", "cell_id")
        points = kept(ranged.mapInArrow(cut, f"leaf long, {shape}"))
        ends = [f(c).alias(f"{c}{i}") for c in "xy" for i, f in enumerate((F.min, F.max))]
        leaves = kept(points.groupBy("leaf").agg(F.min("sid").alias("sid"), F.min("code").alias("code"), *ends))
        return SpatialIndex(points.select("leaf", "cell_id", "x", "y"), leaves, samples, cuts, most)

    def save(self, name: str, buckets: int | None = None) -> None:
        """Writes the index as tables: `name`, bucketed by leaf so that searches needn't shuffle it, and `name`_leaves, _samples, _about."""
        spark = self.points.sparkSession
        many = buckets or max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), self.leaves.count()))
        self.points.repartition(many, "leaf").write.bucketBy(many, "leaf").sortBy("leaf").saveAsTable(name)
        self.leaves.write.saveAsTable(f"{name}_leaves")
        if self.samples is not None:
            self.samples.write.saveAsTable(f"{name}_samples")
        about = [(self.most, self.cuts[0].tolist(), self.cuts[1].tolist())]
        spark.createDataFrame(about, "most int, cuts_x array<double>, cuts_y array<double>").write.saveAsTable(f"{name}_about")

    @staticmethod
    def load(spark: SparkSession, name: str) -> SpatialIndex:
        """The index that save() wrote; nothing is fitted again."""
        about = spark.table(f"{name}_about").first()
        samples = spark.table(f"{name}_samples") if spark.catalog.tableExists(f"{name}_samples") else None
        return SpatialIndex(spark.table(name), spark.table(f"{name}_leaves"), samples, (np.array(about.cuts_x), np.array(about.cuts_y)), about.most)

    def neighbours(self, queries: DataFrame, k: int | None, max_radius: float | None = None, same: bool = False) -> DataFrame:
        """([sample,] src, dst, rk, dist, dx, dy): the k nearest fitted cells of each of queries(cell_id, x, y[, sample]), exactly.

        Ties go to the smaller dst. With max_radius only those up to it, with k None all of these. same: queries are fitted
        cells themselves, and no cell is its own neighbour. Neighbours are of the query's own sample, if samples were fitted.
        """
        if k is None and (max_radius is None or self.most is not None):
            raise ValueError("without k there must be a radius, and an index that keeps all cells")
        if self.most is not None and k > self.most:
            raise ValueError(f"fitted for {self.most} neighbours at most")
        tree, kind, other = self.tree, dict(queries.dtypes)["cell_id"], dict(self.points.dtypes)["cell_id"]
        q = queries.select(*(["sample"] if self.samples is not None else []), "cell_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
        q = q.where("x is not null and y is not null and not isnan(x) and not isnan(y)")
        q = q.join(self.samples, "sample") if self.samples is not None else q.withColumn("sid", F.lit(0).cast("long"))
        limit = np.inf if max_radius is None else float(max_radius)
        visit = f"leaf long, sid long, src {kind}, x double, y double, r double"

        def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = tree.value
            for b in batches:
                sid, x, y = _columns(b, "sid", "x", "y")
                if k is None:
                    at, node = t.reached(sid, x, y, np.full(len(x), limit))
                else:
                    node = t.home(sid, x, y)
                    at, node = np.flatnonzero(node >= 0), node[node >= 0]
                leaf = t.leaf[node] if len(node) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(leaf), pa.array(sid[at]), b.column("cell_id").take(pa.array(at)), pa.array(x[at]), pa.array(y[at]), pa.array(np.full(len(at), limit))], names=["leaf", "sid", "src", "x", "y", "r"])

        def first(left: pa.Table, right: pa.Table) -> pa.Table:
            return _answered(left, right, k, same, tree.value if k is not None else None)

        def later(left: pa.Table, right: pa.Table) -> pa.Table:
            return _answered(left, right, k, same, None)

        shape = f"sid long, src {kind}, dst {other}, rk int, dist double, dx double, dy double, open boolean, leaf long, x double, y double, r double"
        asked = q.select("sid", "cell_id", "x", "y").mapInArrow(homes, visit)
        found = met(asked, self.points, first, shape, QUERIES, ["src", "x", "y"])
        edges = ["sid", "src", "dst", "rk", "dist", "dx", "dy"]
        if k is None:
            rank = F.row_number().over(Window.partitionBy("sid", "src").orderBy("dist", "dst"))
            out = found.withColumn("rk", rank).select(edges)
        else:
            found = kept(found)
            more = met(found.where("leaf is not null").select("leaf", "sid", "src", "x", "y", "r"), self.points, later, shape, QUERIES, ["src", "x", "y"])
            rank = F.row_number().over(Window.partitionBy("sid", "src").orderBy("dist", "dst"))
            again = found.where("leaf is null and open").select(edges).unionByName(more.select(edges)).withColumn("rk", rank).where(F.col("rk") <= k)
            out = found.where("leaf is null and not open").select(edges).unionByName(again)
        if self.samples is None:
            return out.drop("sid")
        return out.join(self.samples, "sid").select("sample", *edges[1:])


def _answered(left: pa.Table, right: pa.Table, k: int | None, same: bool, tree: Tree | None) -> pa.Table:
    """Edges of a leaf's queries; with the tree also the other leaves that each has to visit, as rows without dst."""
    right = right.sort_by("cell_id")
    sid, src, x, y, r = _columns(left, "sid", "src", "x", "y", "r")
    dst, px, py = _columns(right, "cell_id", "x", "y")
    at, to, dist = _near(src, x, y, r, dst, px, py, k, same)
    first = np.searchsorted(at, np.arange(len(src) + 1))
    goes, node, reach = np.zeros(0, np.int64), np.zeros(0, np.int64), r
    if tree is not None and len(src):
        full = np.diff(first) == k
        reach = r.copy()
        reach[full] = dist[first[1:][full] - 1]
        goes, node = tree.reached(sid, x, y, reach)
        away = tree.leaf[node] != left.column("leaf")[0].as_py()
        goes, node = goes[away], node[away]
    is_open = np.zeros(len(src), bool)
    is_open[goes] = True
    none, blank = pa.nulls(len(at)), pa.nulls(len(goes))
    edge = [
        pa.array(sid[at]), left.column("src").combine_chunks().take(pa.array(at)), right.column("cell_id").combine_chunks().take(pa.array(to)), pa.array((np.arange(len(at)) - first[at] + 1).astype(np.int32)),
        pa.array(dist), pa.array(px[to] - x[at]), pa.array(py[to] - y[at]), pa.array(is_open[at]), none.cast(pa.int64()), *[none.cast(pa.float64())] * 3,
    ]
    visit = [
        pa.array(sid[goes]), left.column("src").combine_chunks().take(pa.array(goes)), blank.cast(right.schema.field("cell_id").type), blank.cast(pa.int32()), *[blank.cast(pa.float64())] * 3, pa.array(np.ones(len(goes), bool)),
        pa.array(tree.leaf[node] if tree is not None else node), pa.array(x[goes]), pa.array(y[goes]), pa.array(reach[goes]),
    ]
    names = ["sid", "src", "dst", "rk", "dist", "dx", "dy", "open", "leaf", "x", "y", "r"]
    return pa.concat_tables([pa.Table.from_arrays(edge, names=names), pa.Table.from_arrays(visit, names=names)])
