"""Exact nearest neighbours in feature space by a tree of cuts: leaves with tight boxes, kept as a table.

The rows are cut at quantiles of the column that spreads most, and crowded parts again, until a leaf holds some LEAF rows. A row is compared
with its own leaf first. No row of another leaf is nearer than that leaf's box, so of the other leaves only those are visited whose
boxes are within the k-th distance found: a few near ones first, then what is left of the rest. Within a leaf its rows are cut
again, into blocks of BLOCK rows, and a row is compared with those blocks only whose boxes it reaches. So neither the leaves that a row visits nor
the rows it is compared with grow much with the table, with clusters or without, while there are few columns; with many columns and no structure all are visited.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._scale import kept, met

#: Rows of a leaf, parts that a part is cut into at once, leaves at most (with more rows than these make, leaves are larger).
LEAF, PIVOTS, MOST_LEAVES = 4096, 32, 200_000
#: Rows that cuts are chosen from: for each part, and all parts of a round together. Other leaves that are visited first.
SAMPLE, SAMPLES, NEAR = 8192, 1 << 17, 3
#: Rows that ask one leaf in one task.
QUERIES = 32_768
#: Rows of a block within a leaf; blocks at least that a row without a reach is compared with first; rows that ask at once.
BLOCK, FIRST, TURN = 64, 8, 4096


def _matrix(column: pa.Array | pa.ChunkedArray, rows: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1) if rows else np.zeros((0, 0))


def _lists(m: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array((np.arange(len(m) + 1) * m.shape[1]).astype(np.int32)), pa.array(np.ascontiguousarray(m).ravel()))


def _square(p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances by a matrix product, and for each row of p what rounding may make of them."""
    pp, qq = (p * p).sum(axis=1), (q * q).sum(axis=1)
    return pp[:, None] + qq - 2 * p @ q.T, 16 * (p.shape[1] + 8) * np.finfo(float).eps * (pp + qq.max(initial=0.0))


def _apart(p: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """What the distance of each row of p to anything in each box is at least, whatever was rounded."""
    out = np.zeros((len(p), len(low)))
    for x, a, b in zip(p.T, low.T, high.T):
        gap = np.maximum(a - x[:, None], x[:, None] - b)
        np.maximum(gap, 0, out=gap)
        gap *= gap
        out += gap
    return np.sqrt(out, out=out) * (1 - 1e-9)


#: A cut: column, value, what lies below it, what doesn't; or the number of a part.
Cut = tuple[int, float, "Cut", "Cut"] | int


def cuts_of(sample: np.ndarray, many: int, first: int = 0) -> tuple[Cut, int]:
    """A tree that cuts rows like the sample's into up to `many` parts of like size, numbered from first; and the next number."""
    spread = np.ptp(sample, axis=0) if len(sample) else np.zeros(1)
    if many < 2 or not spread.max(initial=0) > 0:
        return first, first + 1
    column = int(np.where(spread > 0, sample.std(axis=0), -1).argmax())
    x = np.sort(sample[:, column])
    # at the quantile, or at a wide gap about it, so that clusters stay whole
    middle = len(x) * (many // 2) // many
    a, b = max(1, middle - len(x) // 5), min(len(x), middle + len(x) // 5 + 1)
    gaps = np.diff(x[a - 1 : b])
    value = x[a + gaps.argmax()] if gaps.max(initial=0) > (x[-1] - x[0]) / 32 else x[middle]
    value = value if value > x[0] else x[np.searchsorted(x, x[0], side="right")]  # something lies below
    below = sample[:, column] < value
    left, first = cuts_of(sample[below], many // 2, first)
    right, first = cuts_of(sample[~below], many - many // 2, first)
    return (column, float(value), left, right), first


def dealt(p: np.ndarray, cut: Cut) -> np.ndarray:
    """The number of the part that each row lies in."""
    if isinstance(cut, int):
        return np.full(len(p), cut, np.int64)
    column, value, left, right = cut
    below = p[:, column] < value
    out = np.empty(len(p), np.int64)
    out[below], out[~below] = dealt(p[below], left), dealt(p[~below], right)
    return out


@dataclass
class Leaves:
    """Numbers of all leaves in ascending order, and their boxes."""

    leaf: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def visits(self, home: int, p: np.ndarray, r: np.ndarray, seen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (row, place of a leaf) of rows of the leaf `home` and the other leaves within their reach r.

        Without seen only the NEAR nearest of these; else all but those of which the row's numbers are in seen.
        """
        at, to = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        step = max(1, (1 << 22) // max(1, len(self.leaf)))
        for lo in range(0, len(p), step):
            part, reach = p[lo : lo + step], r[lo : lo + step]
            # first by leaves: a row is no nearer to another leaf than the box of all these rows
            gap = np.maximum(np.maximum(self.low - part.max(axis=0), part.min(axis=0) - self.high), 0)
            some = np.flatnonzero((np.sqrt((gap * gap).sum(axis=1)) * (1 - 1e-9) <= reach.max()) & (self.leaf != home))
            near = _apart(part, self.low[some], self.high[some])
            if seen is None:
                order = np.argsort(near, axis=1, kind="stable")[:, :NEAR]
                row, col = np.nonzero(np.take_along_axis(near, order, axis=1) <= reach[:, None])
                col = order[row, col]
            else:
                row, col = np.nonzero(near <= reach[:, None])
                new = ~(self.leaf[some[col], None] == seen[lo : lo + step][row]).any(axis=1)
                row, col = row[new], col[new]
            at.append(row + lo)
            to.append(some[col])
        return np.concatenate(at), np.concatenate(to)


def blocks_of(q: np.ndarray) -> list[np.ndarray]:
    """Places of q's rows in blocks of BLOCK at most, halved along the column that spreads most."""
    out, left = [], [np.arange(len(q))]
    while left:
        at = left.pop()
        if len(at) <= BLOCK:
            out.append(at)
        else:
            x, half = q[at], len(at) // 2
            order = np.argpartition(x[:, np.ptp(x, axis=0).argmax()], half)
            left += [at[order[:half]], at[order[half:]]]
    return out


def _near(p: np.ndarray, p_id: np.ndarray, r: np.ndarray, q: np.ndarray, q_id: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of p, row of q, distance): of each row of p the k nearest others of q that are no further than r; equals by smaller id."""
    at, to, far = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    blocks = blocks_of(q) if len(q) else []
    low, high = (np.array([f(q[b], axis=0) for b in blocks]).reshape(len(blocks), -1) for f in (np.min, np.max))
    for i in range(0, len(p) if blocks else 0, TURN):
        part, ids, reach = p[i : i + TURN], p_id[i : i + TURN], r[i : i + TURN].copy()
        least = _apart(part, low, high)
        wide = np.flatnonzero(np.isinf(reach))
        if len(wide):
            reach[wide] = _reach(part[wide], ids[wide], least[wide], q, q_id, blocks, k)
        row, col = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for b, some in zip(blocks, (least <= reach[:, None]).T):
            rows = np.flatnonzero(some)
            if len(rows):
                d, slack = _square(part[rows], q[b])
                # more than rounding can move a square and the k-th of them, so that no neighbour or tie is left out
                x, y = np.nonzero(d <= (reach[rows] ** 2 + 2 * slack)[:, None])
                row.append(rows[x])
                col.append(b[y])
        row, col = np.concatenate(row), np.concatenate(col)
        other = ids[row] != q_id[col]
        row, col = row[other], col[other]
        real = np.empty(len(row))
        for j in range(0, len(row), 1 << 18):
            real[j : j + (1 << 18)] = np.sqrt(((part[row[j : j + (1 << 18)]] - q[col[j : j + (1 << 18)]]) ** 2).sum(axis=1))
        some = real <= reach[row]
        row, col, real = row[some], col[some], real[some]
        order = np.lexsort((q_id[col], real, row))
        row, col, real = row[order], col[order], real[order]
        some = np.arange(len(row)) - np.searchsorted(row, row) < k
        at.append(row[some] + i)
        to.append(col[some])
        far.append(real[some])
    return np.concatenate(at), np.concatenate(to), np.concatenate(far)


def _reach(p: np.ndarray, p_id: np.ndarray, least: np.ndarray, q: np.ndarray, q_id: np.ndarray, blocks: list[np.ndarray], k: int) -> np.ndarray:
    """No less than each row's k-th distance to others of q: that in its nearest blocks; infinite where these hold fewer."""
    many = min(len(blocks), max(FIRST, -(-4 * k // BLOCK)))
    if many * BLOCK < k:
        return np.full(len(p), np.inf)
    first = np.argpartition(least, many - 1, axis=1)[:, :many]
    d = np.full((len(p), many, BLOCK), np.inf)
    for n, b in enumerate(blocks):
        rows, place = np.nonzero(first == n)
        if len(rows):
            square, slack = _square(p[rows], q[b])
            square += slack[:, None]
            square[p_id[rows, None] == q_id[b]] = np.inf
            d[rows, place, : len(b)] = square
    top = np.partition(d.reshape(len(p), -1), k - 1, axis=1)[:, k - 1]
    return np.sqrt(np.maximum(top, 0)) * (1 + 1e-9)


def parted(rows: DataFrame, n: int) -> DataFrame:
    """rows(cell_id, pc, shown) with the leaf of each: the number of the part that it lies in, after the round that made it."""
    size = max(LEAF, -(-n // MOST_LEAVES))
    rows = rows.withColumn("leaf", F.lit(0).cast("long"))
    tried, first = set(), 1
    while True:
        counts = rows.where("shown").groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") > 2 * size)
        large = {r.leaf: r.n for r in counts.collect() if r.leaf not in tried}  # fewer than n / 2 size, and MOST_LEAVES / 2
        if not large:
            return rows
        each = max(4, min(SAMPLE, SAMPLES // len(large)))
        chance = F.broadcast(rows.sparkSession.createDataFrame([(leaf, min(1.0, 4 * each / m)) for leaf, m in large.items()], "leaf long, chance double"))
        some = rows.where("shown").join(chance, "leaf").where(F.xxhash64("cell_id") / 2.0**64 + 0.5 < F.col("chance"))
        some = some.withColumn("__n", F.row_number().over(Window.partitionBy("leaf").orderBy(F.xxhash64("cell_id"), "cell_id"))).where(F.col("__n") <= each).select("leaf", "pc").toArrow()
        leaf, sample = some.column("leaf").to_numpy(), _matrix(some.column("pc"), some.num_rows)
        cuts: dict[int, Cut] = {}
        for one in sorted(large):
            tried.add(one)
            cut, after = cuts_of(sample[leaf == one], min(PIVOTS, -(-large[one] // size)), first)
            if after > first + 1:
                cuts[one], first = cut, after
        if not cuts:
            return rows
        shared = rows.sparkSession.sparkContext.broadcast(cuts)

        def deal(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                old, pc = b.column(3).to_numpy(), _matrix(b.column(1), b.num_rows)
                of = old.copy()
                for one in np.unique(old):
                    if one in shared.value:
                        rows_in = np.flatnonzero(old == one)
                        of[rows_in] = dealt(pc[rows_in], shared.value[one])
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(of)], names=["cell_id", "pc", "shown", "leaf"])

        rows = kept(rows.select("cell_id", "pc", "shown", "leaf").mapInArrow(deal, "cell_id long, pc array<double>, shown boolean, leaf long"))


def leaves_of(rows: DataFrame) -> Leaves:
    """Every leaf's box."""
    dims = rows.select(F.size("pc").alias("d")).first()
    ends = [F.array(*[f(F.col("pc")[i]) for i in range(dims.d if dims else 0)]).cast("array<double>").alias(name) for f, name in ((F.min, "low"), (F.max, "high"))]
    got = rows.where("shown").groupBy("leaf").agg(*ends).orderBy("leaf").toArrow()  # MOST_LEAVES at most
    return Leaves(got.column("leaf").to_numpy(), _matrix(got.column("low"), got.num_rows), _matrix(got.column("high"), got.num_rows))


def feature_knn(embedding: DataFrame, k: int = 50) -> DataFrame:
    """(src, dst, rk, dist, w): exact k nearest in feature space, w = 1 / (1 + dist); ties to the smaller id.

    Of rows with equal features only the k + 1 of smallest id can be among anyone's neighbours, so no more are compared. Rows with a null or
    non-finite component have no edges.
    """
    e = embedding.select(F.col("cell_id").cast("long").alias("cell_id"), F.col("pc").cast("array<double>").alias("pc"))
    e = e.where(F.forall("pc", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))))
    pile = F.row_number().over(Window.partitionBy(F.xxhash64("pc"), "pc").orderBy("cell_id"))
    e = kept(e.withColumn("shown", pile <= k + 1))
    rows = parted(e, e.count())
    found_leaves = leaves_of(rows)
    shared = rows.sparkSession.sparkContext.broadcast(found_leaves)
    points = rows.where("shown").select("leaf", F.col("cell_id").alias("near_id"), F.col("pc").alias("near_pc"))
    shape = "src long, dst long, dist double, open boolean, home long, leaf long, pc array<double>, r double"

    def answer(wave: int):
        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            n = left.num_rows
            src, p, r = left.column("src").to_numpy(), _matrix(left.column("pc"), n), left.column("r").to_numpy()
            at, to, dist = _near(p, src, r, _matrix(right.column("near_pc"), right.num_rows), right.column("near_id").to_numpy(), k)
            goes, node, reach = np.zeros(0, np.int64), np.zeros(0, np.int64), r
            home = left.column("leaf")[0].as_py() if n else 0
            if wave == 0 and n:
                first = np.searchsorted(at, np.arange(n + 1))
                full = np.diff(first) == k
                reach = r.copy()
                reach[full] = dist[first[1:][full] - 1]
                goes, node = shared.value.visits(home, p, reach)
            is_open = np.zeros(n, bool)
            is_open[goes] = True
            names = ["src", "dst", "dist", "open", "home", "leaf", "pc", "r"]
            a, b = pa.nulls(len(at)), pa.nulls(len(goes))
            edges = [pa.array(src[at]), right.column("near_id").combine_chunks().take(pa.array(to)), pa.array(dist), pa.array(is_open[at]), a.cast(pa.int64()), a.cast(pa.int64()), a.cast(pa.list_(pa.float64())), a.cast(pa.float64())]
            visit = [pa.array(src[goes]), b.cast(pa.int64()), b.cast(pa.float64()), pa.array(np.ones(len(goes), bool)), pa.array(np.full(len(goes), home)), pa.array(shared.value.leaf[node]), _lists(p[goes]), pa.array(reach[goes])]
            return pa.concat_tables([pa.Table.from_arrays(edges, names=names), pa.Table.from_arrays(visit, names=names)])

        return run

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of rows (src, pc, home, seen, r): the leaves still in reach of r, without those seen."""
        leaves = shared.value
        for b in batches:
            src, homes, p = b.column(0).to_numpy(), b.column(2).to_numpy(), _matrix(b.column(1), b.num_rows)
            r, some = b.column(4).to_numpy(), b.column(3)
            many = some.value_lengths().to_numpy()
            seen = np.full((len(src), NEAR), -1, np.int64)
            seen[np.arange(NEAR) < many[:, None]] = some.flatten().to_numpy()
            for home in np.unique(homes):
                mine = np.flatnonzero(homes == home)
                for lo in range(0, len(mine), 1024):
                    some = mine[lo : lo + 1024]
                    goes, node = leaves.visits(int(home), p[some], r[some], seen[some])
                    if len(goes):
                        yield pa.RecordBatch.from_arrays([pa.array(leaves.leaf[node]), pa.array(src[some][goes]), _lists(p[some][goes]), pa.array(r[some][goes])], names=["leaf", "src", "pc", "r"])

    edges = ["src", "dst", "dist"]
    asked = rows.select("leaf", F.col("cell_id").alias("src"), "pc", F.lit(float("inf")).alias("r"))
    one = kept(met(asked, points, answer(0), shape, QUERIES, ["src"]))
    rank = F.row_number().over(Window.partitionBy("src").orderBy("dist", "dst"))
    best = one.where("leaf is null and not open").select(edges)
    if len(found_leaves.leaf) > 1:
        two = met(one.where("leaf is not null").select("leaf", "src", "pc", "r"), points, answer(1), shape, QUERIES, ["src"])
        some = kept(one.where("leaf is null and open").select(edges).unionByName(two.select(edges)).withColumn("rk", rank).where(F.col("rk") <= k).drop("rk"))
        far = some.groupBy("src").agg(F.count("*").alias("many"), F.max("dist").alias("d"))
        again = one.where("leaf is not null").groupBy("src").agg(F.max("pc").alias("pc"), F.max("home").alias("home"), F.max("r").alias("old"), F.collect_list("leaf").alias("seen")).join(far, "src", "left")  # NEAR leaves at most
        again = again.select("src", "pc", "home", "seen", F.when(F.col("many") == k, F.col("d")).otherwise(F.col("old")).alias("r"))
        asked = kept(again.mapInArrow(rest, "leaf long, src long, pc array<double>, r double"))
        three = met(asked, points, answer(1), shape, QUERIES, ["src"])
        best = best.unionByName(some).unionByName(three.select(edges))
    return best.withColumn("rk", rank).where(F.col("rk") <= k).select("src", "dst", "rk", "dist", (1 / (1 + F.col("dist"))).alias("w"))
