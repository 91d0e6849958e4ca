"""Feature-space neighbour graphs, shared neighbours, and clustering on them."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._scale import kept, running
from .components import components
from .graph import filter_by_rank_and_threshold
from .metric_tree import feature_knn  # noqa: F401
from .spread_graph import SpreadGraph, coin

#: Up to so many edges a graph is clustered in one task; the steps, and the labels, are the same beyond.
TASK_EDGES = 5_000_000
#: Resolutions that a search tries at once.
SIDE = 8


def shared_counts(edges: DataFrame) -> DataFrame:
    """(src, dst, n): for each edge, how many neighbours its ends share. A row's neighbours are few."""
    return _with_shared(edges.select("src", "dst"))


def _with_shared(edges: DataFrame) -> DataFrame:
    """edges with n, how many neighbours their ends share. Lists of neighbours are told to each edge, a row each, and compared there."""
    own = edges.groupBy("src").agg(F.collect_list("dst").alias("__own"))
    told = edges.join(own.select(F.col("src").alias("dst"), F.col("__own").alias("__its")), "dst", "left").join(own, "src")
    n = F.coalesce(F.array_size(F.array_intersect("__own", "__its")), F.lit(0)).cast("long")
    return told.select(*edges.columns, n.alias("n"))


def shared_graph(edges: DataFrame, filtered: bool = True, max_rank: int = 3, threshold: int = 5, weighted: bool = True) -> DataFrame:
    """(src, dst, w) of edges with shared neighbours: w is the edge's own weight, or 1."""
    weight = F.col("w") if weighted else F.lit(1.0)
    n = _with_shared(edges.select("src", "dst", weight.alias("w"))).where("n > 0")
    n = filter_by_rank_and_threshold(n, max_rank, threshold, "n") if filtered else n
    return n.select("src", "dst", "w")


def undirected(edges: DataFrame) -> DataFrame:
    """Each pair of cells once; mutual edges add up."""
    return edges.where("src <> dst").groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.sum("w").alias("w"))


#: Rounds of moving and of refining at each level, at most, and passes over all levels.
MOVES, REFINES, PASSES = 60, 20, 10


def _grouped(key: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, each with its sum of w."""
    order = np.argsort(key)
    key = key[order]
    start = np.flatnonzero(np.concatenate(([len(key) > 0], key[1:] != key[:-1])))
    return key[start], np.add.reduceat(w[order], start).astype(float) if len(start) else np.zeros(0)


def _best(v: np.ndarray, to: np.ndarray, gain: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each v the row of the largest gain, of equals the smallest to; rows are in order of v and to."""
    if not len(v):
        return v, to, gain
    start = np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1])))
    top = np.repeat(np.maximum.reduceat(gain, start), np.diff(np.append(start, len(v))))
    at = np.flatnonzero(gain == top)
    at = at[np.concatenate(([True], v[at][1:] != v[at][:-1]))]
    return v[at], to[at], gain[at]


class LocalGraph:
    """A graph of one task. ids ascend; src, dst: each edge in both directions, by src; c: communities; node: of each cell.

    In a round only those nodes are judged again that may come out another way: who moved or has a neighbour that did, who wants to
    move, and who the sizes of groups have changed enough for, at most, since it was judged. So the labels are those of judging all.
    """

    def __init__(self, ids: np.ndarray, src: np.ndarray, dst: np.ndarray, w: np.ndarray, resolution: float, seed: int):
        src, dst = np.concatenate((src, dst)), np.concatenate((dst, src))
        order = np.argsort(src, kind="stable")
        self.first = (ids, src[order], dst[order], np.concatenate((w, w)).astype(np.int64)[order])
        self.k0 = np.bincount(src[order], self.first[3], minlength=len(ids))
        self.total, self.resolution, self.seed = float(self.k0.sum()), resolution, seed
        self.cells = ids.copy()

    def begin(self) -> None:
        self.ids, self.src, self.dst, self.w = self.first
        self.k, self.c, self.node = self.k0, self.cells, np.arange(len(self.ids))

    def _of(self, nodes: np.ndarray) -> np.ndarray:
        """Places of the nodes' edges."""
        many = self.starts[nodes + 1] - self.starts[nodes]
        return np.repeat(self.starts[nodes] - np.cumsum(many) + many, many) + np.arange(many.sum())

    def move(self, most: int) -> None:
        names, g = np.unique(self.c, return_inverse=True)
        n = len(self.ids)
        self.starts = np.searchsorted(self.src, np.arange(n + 1))
        size = np.bincount(g, self.k, minlength=len(names))
        again, to, want = np.arange(n), g.copy(), np.zeros(n, bool)
        spare, grown = np.zeros(n), 0.0  # how much sizes may have grown and shrunk in all before a node is judged again; how much they have
        for r in range(most):
            self._judge(again, g, size, to, want, spare, grown)
            asks = np.flatnonzero(want)
            if not len(asks):
                break
            goes = asks[coin(self.seed, r, self.ids[asks])]
            g[goes] = to[goes]
            before, size = size, np.bincount(g, self.k, minlength=len(names))
            grown += float(np.abs(size - before).max())
            due = want | (spare <= grown)
            due[goes] = True
            due[self.dst[self._of(goes)]] = True
            again = np.flatnonzero(due)
        self.c = names[g]

    def _judge(self, nodes: np.ndarray, g: np.ndarray, size: np.ndarray, to: np.ndarray, want: np.ndarray, spare: np.ndarray, grown: float) -> None:
        """Sets where each of the nodes would go, whether it wants to, and up to which growth of sizes that holds if it doesn't."""
        edges = slice(None) if len(nodes) == len(g) else self._of(nodes)
        src, group = self.src[edges], g[self.dst[edges]]
        own = group == g[src]
        k, push = self.k, lambda v, others: self.resolution * self.k[v] * others / self.total
        stay = np.bincount(src[own], self.w[edges][own], minlength=len(g))[nodes] - push(nodes, size[g[nodes]] - k[nodes])
        key, e = _grouped((src * len(size) + group)[~own], self.w[edges][~own])
        v, group = key // len(size), key % len(size)
        v, group, gain = _best(v, group, e - push(v, size[group]))
        best = np.full(len(g), -np.inf)
        best[v], to[v] = gain, group
        best = best[nodes]
        want[nodes] = best > stay
        rounding = 1e-9 * (np.abs(stay) + np.where(np.isfinite(best), np.abs(best), 0) + k[nodes])
        pull = 2 * abs(self.resolution) * k[nodes] / self.total
        spare[nodes] = grown + np.divide(stay - best - rounding, pull, out=np.full(len(nodes), np.inf), where=pull > 0)

    def refine(self, most: int) -> None:
        n = len(self.ids)
        self.f = np.arange(n)
        inside = self.c[self.src] == self.c[self.dst]
        src, dst, w = self.src[inside], self.dst[inside], self.w[inside]
        for r in range(most):
            alone = np.bincount(self.f, minlength=n) == 1
            some = alone[src]  # who isn't alone stays so
            src, dst, w = src[some], dst[some], w[some]
            key, e = _grouped(src * n + self.f[dst], w)
            v, to = key // n, key % n
            gain = e - self.resolution * self.k[v] * np.bincount(self.f, self.k, minlength=n)[to] / self.total
            some = gain > 0
            v, to, gain = v[some], to[some], gain[some]
            if not len(v):
                break
            turn = coin(self.seed, -1 - r, self.ids)
            may = turn[v] & ~turn[to]
            v, to, _ = _best(v[may], to[may], gain[may])
            self.f[v] = to

    def shrink(self) -> bool:
        names, of = np.unique(self.f, return_inverse=True)
        names = self.ids[names]
        if len(names) == len(self.ids):
            return False
        c = np.empty(len(names), np.int64)
        c[of] = self.c
        src, dst = of[self.src], of[self.dst]
        apart = src != dst
        key, inverse = np.unique(src[apart] * len(names) + dst[apart], return_inverse=True)
        self.w = np.bincount(inverse, self.w[apart], minlength=len(key)).astype(np.int64)
        self.src, self.dst = key // len(names), key % len(names)
        self.k, self.ids, self.c, self.node = np.bincount(of, self.k), names, c, of[self.node]
        return True

    def end(self) -> tuple[int, int]:
        """Communities of the cells; the weight inside them, each edge twice, and the sum of their squared strengths."""
        self.cells = self.c[self.node]
        _, src, dst, w = self.first
        inside = int(w[self.cells[src] == self.cells[dst]].sum())
        return inside, sum(int(x) ** 2 for x in np.bincount(np.unique(self.cells, return_inverse=True)[1], self.k0))


def communities(g: LocalGraph | SpreadGraph, iterations: int = -1):
    """Communities of the cells (g.cells), by rounds of moving, refining and shrinking; then again from what was found, until it is no better.

    Maximises the sum over communities of inside / 2m - resolution * (strength / 2m)**2. In a round all nodes whose turn comes by
    their coin go to the neighbouring community of the largest gain, the smaller of equals, at once. Refining parts each
    community again: nodes that are alone join groups of their community that don't move in that round. Weights are whole
    numbers, so neither the order of sums nor the number of parts changes a label.
    """
    best, found, done = None, g.cells, 0
    while g.total > 0 and done < (iterations if iterations >= 0 else PASSES):
        g.begin()
        while True:
            g.move(MOVES)
            g.refine(REFINES)
            if not g.shrink():
                break
        inside, squares = g.end()
        now = inside / g.total - g.resolution * squares / g.total**2
        done += 1
        if best is not None and now <= best + 1e-12:
            break
        best, found = now, g.cells
    return found


def quality(src: np.ndarray, dst: np.ndarray, w: np.ndarray, comm: np.ndarray, resolution: float = 1.0) -> float:
    total, size = w.sum(), int(comm.max()) + 1
    k = np.bincount(comm[src], w, minlength=size) + np.bincount(comm[dst], w, minlength=size)
    inside = float(w[comm[src] == comm[dst]].sum())
    return inside / total - resolution * float(((k / (2 * total)) ** 2).sum())


def _swept(edges: DataFrame, wanted: list[tuple[int, float]], iterations: int, seed: int, parts: int | None) -> DataFrame:
    """(setting, cell_id, c): communities of the cells with edges at each of the wanted (setting, resolution)."""
    g = kept(undirected(edges).where("w > 0"))
    many, top = g.agg(F.count("*"), F.max("w")).first()
    whole = g.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), F.greatest(F.floor(F.col("w") / F.lit(float(top or 1.0)) * 2**20 + 0.5), F.lit(1)).cast("long").alias("w"))
    settings = F.broadcast(edges.sparkSession.createDataFrame(wanted, "setting int, resolution double"))
    if many <= TASK_EDGES and parts is None:

        def run(table: pa.Table) -> pa.Table:
            src, dst, w = (table.column(c).to_numpy() for c in ("src", "dst", "w"))
            setting, resolution = table.column("setting")[0].as_py(), table.column("resolution")[0].as_py()
            names = np.unique(np.concatenate((src, dst)))
            found = communities(LocalGraph(names, np.searchsorted(names, src), np.searchsorted(names, dst), w, resolution, seed), iterations)
            return pa.table({"setting": np.full(len(names), setting, np.int32), "cell_id": names, "c": found})

        every = whole.join(settings)
        # a task for each setting: by its bytes a setting is small, so that several would share one
        every = every.repartitionByRange(4 * len(wanted), "setting") if len(wanted) > 1 else every
        found = every.groupBy("setting").applyInArrow(run, "setting int, cell_id long, c long")
    else:
        found = None
        for i, r in wanted:
            one = communities(SpreadGraph(whole, r, seed, parts), iterations).select(F.lit(i).alias("setting"), F.col("id").alias("cell_id"), "c")
            found = one if found is None else found.unionByName(one)
    return found


def leiden_sweep(cells: DataFrame, edges: DataFrame, resolutions: list[float], iterations: int = -1, seed: int = 1234, parts: int | None = None) -> DataFrame:
    """(setting, cell_id, label): leiden() at each of several resolutions of one graph, by their places in the list, all at once.

    A graph of up to TASK_EDGES edges is gone over in one task a resolution, side by side; a larger one in parts of bounded size
    (see SpreadGraph; `parts` asks for that, and for so many), one resolution after the other. The steps are the same, and so are the labels.
    """
    spark = cells.sparkSession
    ids = cells.select(F.col("cell_id").cast("long").alias("cell_id")).distinct()
    every = [(i, float(r)) for i, r in enumerate(resolutions)]
    settings = F.broadcast(spark.createDataFrame(every, "setting int, resolution double"))
    flat = [(i, r) for i, r in every if r <= 0 and iterations and parts is None]
    rest = [s for s in every if s not in flat]
    found = []
    if flat:  # nothing holds communities apart: the best are the connected components, for which edges need not be dealt out
        found.append(kept(components(edges)).crossJoin(settings.where(F.col("resolution") <= 0)).select("setting", F.col("node").alias("cell_id"), F.col("component").alias("c")))
    if rest:
        found.append(_swept(edges, rest, iterations, seed, parts))
    found = reduce(DataFrame.unionByName, found)
    every = kept(ids.join(settings).join(found, ["setting", "cell_id"], "left").select("setting", "cell_id", F.coalesce("c", "cell_id").alias("c")))
    sized = every.groupBy("setting", "c").agg(F.count("*").alias("n"), F.min("cell_id").alias("first"))
    number = running(sized, ["setting", F.desc("n"), "first"], F.lit(1), "at")
    start = F.broadcast(number.groupBy("setting").agg(F.min("at").alias("start")))  # a row a setting
    number = number.join(start, "setting").select("setting", "c", (F.col("at") - F.col("start")).cast("int").alias("label"))
    return every.join(number, ["setting", "c"]).select("setting", "cell_id", "label")


def leiden(cells: DataFrame, edges: DataFrame, resolution: float = 0.7, iterations: int = -1, seed: int = 1234, parts: int | None = None) -> DataFrame:
    """(cell_id, label) by Leiden on undirected edges: labels from the largest community down, equals by their smallest cell.

    Cells without edges are communities of their own. Weights count in millionths of the largest.
    """
    return leiden_sweep(cells, edges, [resolution], iterations, seed, parts).select("cell_id", "label")


#: Rows that a mixture's hierarchical start is made of, at most.
START = 600


def determinant_merges(x: np.ndarray, groups: int) -> np.ndarray:
    """Labels from 0 of model-based hierarchical clustering for groups of one shape (Banfield and Raftery, 1993; Fraley, 1998).

    Every row begins alone; each step merges the two groups that leave the smallest determinant of the scatter within groups W. As merging
    adds c v v' to it, v the difference of means, that is the pair with the smallest c v' W^-1 v. W begins as the scatter of one
    row, alike in all directions, so that the first steps follow the trace. Of equal pairs the first rows' are merged.
    """
    n, d = x.shape
    mean, size, label = x.copy(), np.ones(n), np.arange(n)
    total = float(((x - x.mean(axis=0)) ** 2).sum()) / max(n * d, 1)
    inverse = np.eye(d) / max(total, 1e-300)
    alive = np.arange(n)
    while len(alive) > groups:
        m, s = mean[alive], size[alive]
        z = m @ inverse
        own = np.einsum("ij,ij->i", z, m)
        cost = np.maximum(own[:, None] + own - 2 * z @ m.T, 0) * (s[:, None] * s / (s[:, None] + s))
        cost[np.tril_indices(len(alive))] = np.inf
        i, j = divmod(int(cost.argmin()), len(alive))
        a, b = alive[i], alive[j]
        c, v = size[a] * size[b] / (size[a] + size[b]), mean[a] - mean[b]
        turned = inverse @ v
        inverse -= np.outer(turned, turned) * (c / (1 + c * (v @ turned)))
        mean[a] = (size[a] * mean[a] + size[b] * mean[b]) / (size[a] + size[b])
        size[a] += size[b]
        label[label == b] = a
        alive = np.delete(alive, j)
    return np.unique(label, return_inverse=True)[1]


def _posterior(x: np.ndarray, weight: np.ndarray, mu: np.ndarray, cov: np.ndarray) -> tuple[np.ndarray, float]:
    """Each row's share in each component, and the rows' log-likelihood."""
    low = np.linalg.cholesky(cov)
    z = np.stack([((np.linalg.solve(low, (x - m).T)) ** 2).sum(axis=0) for m in mu], axis=1)
    logp = np.log(weight) - 0.5 * z - np.log(np.diag(low)).sum() - len(cov) / 2 * np.log(2 * np.pi)
    top = logp.max(axis=1, keepdims=True)
    p = np.exp(logp - top)
    total = p.sum(axis=1, keepdims=True)
    return p / total, float((np.log(total) + top).sum())


def fit_mixture(e: DataFrame, n_labels: int, seed: int = 1234, rounds: int = 100, tol: float = 1e-6) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[float]] | None:
    """Weights, means, the shared covariance and the log-likelihood before each round, of e(cell_id, pc); None without rows.

    Starts from determinant_merges() of at most START rows, those with the smallest hash; every round adds up bounded sums over all rows, and
    never lowers the log-likelihood.
    """
    sample = np.array([r.pc for r in e.orderBy(F.xxhash64("cell_id", F.lit(seed)), "cell_id").limit(START).collect()], float)
    if not len(sample):
        return None
    label, dims = determinant_merges(sample, n_labels), sample.shape[1]
    weight = np.bincount(label, minlength=n_labels) / len(sample)
    mu = np.stack([sample[label == g].mean(axis=0) if weight[g] else sample[0] for g in range(n_labels)])
    ridge = 1e-6 * max(float(sample.var(axis=0).mean()), 1e-300) * np.eye(dims)
    off = sample - mu[label]
    cov, weight = off.T @ off / len(sample) + ridge, np.maximum(weight, 1e-9)
    trace: list[float] = []
    for _ in range(rounds):
        shared = (weight, mu, cov)

        def step(batches, shared=shared):
            out = np.zeros(1 + n_labels + n_labels * dims + dims * dims)
            for batch in batches:
                if len(batch):
                    x = np.array(batch.column(1).flatten(), float).reshape(len(batch), -1)
                    p, ll = _posterior(x, *shared)
                    apart = (x - shared[1][0]).T @ (x - shared[1][0])  # about a mean, not about 0, which may be far
                    out += np.concatenate(([ll], p.sum(axis=0), (p.T @ (x - shared[1][0])).ravel(), apart.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(out))), pa.array(out)], names=["i", "v"])

        rows = e.mapInArrow(step, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").toPandas().v.to_numpy()
        nk = np.maximum(rows[1 : 1 + n_labels], 1e-9)
        trace.append(rows[0])
        if len(trace) > 1 and trace[-1] - trace[-2] < tol * abs(trace[-1]):
            break
        from_first = rows[1 + n_labels : 1 + n_labels + n_labels * dims].reshape(n_labels, dims) / nk[:, None]
        cov = (rows[-dims * dims :].reshape(dims, dims) - (from_first * nk[:, None]).T @ from_first) / nk.sum() + ridge
        mu, weight = mu[0] + from_first, nk / nk.sum()
    return (*shared, trace)


def gaussian_mixture(embedding: DataFrame, n_labels: int, seed: int = 1234, rounds: int = 100, tol: float = 1e-6) -> DataFrame:
    """(cell_id, label) of a Gaussian mixture with one shared covariance, by EM from a hierarchical start (see fit_mixture()).

    Labels run from the heaviest component down.
    """
    e = kept(embedding.select("cell_id", F.col("pc").cast("array<double>").alias("pc")))
    fitted = fit_mixture(e, n_labels, seed, rounds, tol)
    if fitted is None:
        return e.select("cell_id", F.lit(0).alias("label"))
    final = fitted[:3]
    rank = np.argsort(np.argsort(-final[0], kind="stable"), kind="stable")

    def name(batches):
        for batch in batches:
            if len(batch):
                x = np.array(batch.column(1).flatten(), float).reshape(len(batch), -1)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rank[_posterior(x, *final)[0].argmax(axis=1)].astype(np.int32))], names=["cell_id", "label"])

    return e.mapInArrow(name, f"cell_id {dict(embedding.dtypes)['cell_id']}, label int")


def find_resolution(cells: DataFrame, edges: DataFrame, n_labels: int, start: float = 0.6, step: float = 0.05, max_iter: int = 25, seed: int = 1234) -> tuple[float, DataFrame]:
    """Walks the resolution by a fixed step until the number of labels matches, or max_iter tries are over; counted in whole steps.

    What a resolution gives doesn't change, so none is tried twice; those that lie ahead are clustered at once, SIDE of them, where a task holds the graph.
    """
    edges, tried, at, resolution, labels = kept(undirected(edges)), {}, 0, start, None
    side = SIDE if edges.count() <= TASK_EDGES else 1
    for done in range(max_iter):
        if at not in tried:
            ahead = [at] if not done else [a for a in (at + i * way for i in range(min(side, max_iter - done))) if a not in tried]
            swept = kept(leiden_sweep(cells, edges, [start + a * step for a in ahead], seed=seed))
            counts = {r.setting: r.n for r in swept.groupBy("setting").agg(F.countDistinct("label").alias("n")).collect()}  # a row a setting
            tried |= {a: (counts.get(i, 0), swept.where(F.col("setting") == i).select("cell_id", "label")) for i, a in enumerate(ahead)}
        resolution, (n, labels) = start + at * step, tried[at]
        if n == n_labels:
            break
        way = 1 if n < n_labels else -1
        at += way
    return resolution, labels
