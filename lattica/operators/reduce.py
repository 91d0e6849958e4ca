"""Principal components of wide features. features(cell_id, features array<double>)."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._scale import kept, running

#: Columns up to which products of columns are added up; directions tried beside those asked for, and directions kept of a wide matrix.
GRAM, OVER, KEPT = 512, 10, 240
#: Numbers that are added up in one place at a time, and bytes of rows that a task looks at together.
CHUNK, BATCH_BYTES = 1 << 18, 64 << 20


def _clean() -> F.Column:
    return F.transform("features", lambda x: F.when(x.isNull() | F.isnan(x), F.lit(0.0)).otherwise(x))


def _wide(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def _lists(m: np.ndarray) -> pa.ListArray:
    """Rows of a matrix as lists, without a Python object a number."""
    m = np.ascontiguousarray(m, dtype=float)
    return pa.ListArray.from_arrays(pa.array((np.arange(len(m) + 1) * m.shape[1]).astype(np.int32)), pa.array(m.ravel()))


@contextmanager
def _batches(spark: SparkSession) -> Iterator[None]:
    """While it is open, rows go to Python in batches of at most BATCH_BYTES."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _spread(features: DataFrame) -> DataFrame:
    """The rows' vectors over as many tasks as run at once, each of which hands over one sum however many rows it has."""
    return features.select(_clean().alias("x")).coalesce(features.sparkSession.sparkContext.defaultParallelism)


def summed(features: DataFrame, work: Callable[[np.ndarray], np.ndarray]) -> np.ndarray | None:
    """The sum over batches of rows of work(rows by columns), a vector; None without rows.

    Tasks add up their batches, and CHUNK numbers of every task at a time are added up in one place.
    """

    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                v = work(_wide(batch.column(0), batch.num_rows))
                total = v if total is None else total + v
        for j in range(0, 0 if total is None else len(total), CHUNK):
            yield pa.RecordBatch.from_arrays([pa.array([j]), _lists(total[None, j : j + CHUNK])], names=["j", "v"])

    def add(table: pa.Table) -> pa.Table:
        total = None
        for v in table.column("v").chunks:
            v = _wide(v, len(v)).sum(axis=0)
            total = v if total is None else total + v
        return pa.table({"j": table.column("j")[:1], "v": _lists(total[None])})

    kind = "j long, v array<double>"
    with _batches(features.sparkSession):
        got = _spread(features).mapInArrow(run, kind).groupBy("j").applyInArrow(add, kind).toArrow().sort_by("j")
    return got.column("v").combine_chunks().flatten().to_numpy() if got.num_rows else None


def gram(features: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of rows, column sums and X'X, added up task by task: only features by features values come back."""
    got = summed(features, lambda x: np.concatenate(([len(x)], x.sum(axis=0), (x.T @ x).ravel())))
    if got is None:
        return 0, np.zeros(0), np.zeros((0, 0))
    d = math.isqrt(len(got) - 1)  # 1 + d + d * d numbers
    return int(got[0]), got[1 : 1 + d], got[1 + d :].reshape(d, d)


def qr_tree(features: DataFrame, shift: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """The triangular factor R of (X - shift) vectors, from a tree of QR factors: of batches, of tasks, of groups of tasks."""

    def stacked(parts: list[np.ndarray]) -> np.ndarray:
        return np.linalg.qr(np.concatenate(parts), mode="r")

    def run(batches):
        r = None
        for batch in batches:
            if batch.num_rows:
                y = (_wide(batch.column(0), batch.num_rows) - shift) @ vectors
                r = stacked([y] if r is None else [r, y])
        if r is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() // 32]), pa.array([len(r)]), _lists(r.reshape(1, -1))], names=["g", "n", "r"])

    def join(table: pa.Table) -> pa.Table:
        r = stacked([np.array(v, float).reshape(n, -1) for n, v in zip(table.column("n").to_pylist(), table.column("r").to_pylist())])
        return pa.table({"g": pa.array([table.column("g")[0].as_py() // 32]), "n": pa.array([len(r)]), "r": _lists(r.reshape(1, -1))})

    kind = "g long, n long, r array<double>"
    with _batches(features.sparkSession):
        got = _spread(features).mapInArrow(run, kind).groupBy("g").applyInArrow(join, kind).toArrow()
    return stacked([np.array(v, float).reshape(n, -1) for n, v in zip(got.column("n").to_pylist(), got.column("r").to_pylist())])


def leading(features: DataFrame, dims: int, center: bool = True, seed: int = 0, tol: float = 1e-11) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, float]:
    """Rows, column means (0 if not to be centred), the dims largest singular values, their directions (columns by dims) and the sum of all squares.

    A randomised range finder: a random block of dims + OVER directions is sent through the rows, (X - m)'(X - m) V, and what comes back widens
    the block Krylov space that the directions are taken from, until they change the matrix's action by no more than tol; the
    space is cut to its best directions when it has KEPT. Last, the values and the turn within the space come from a tree of QR factors,
    so no product of the matrix with itself limits their accuracy. A task holds a batch and columns by (dims + OVER) numbers; columns by
    columns are never made.
    """
    first = summed(features, lambda x: np.concatenate(([len(x)], x.sum(axis=0))))
    if first is None:
        return 0, np.zeros(0), np.zeros(0), np.zeros((0, 0)), 0.0
    n, d = int(first[0]), len(first) - 1
    shift = first[1:] / n if center else np.zeros(d)
    wide = min(d, dims + OVER)
    v = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, wide)))[0]
    basis, image, total = np.zeros((d, 0)), np.zeros((d, 0)), 0.0
    while True:

        def through(x: np.ndarray, v=v) -> np.ndarray:
            x = x - shift
            return np.concatenate(([(x * x).sum()], (x.T @ (x @ v)).ravel()))

        got = summed(features, through)
        total, w = got[0], got[1:].reshape(d, -1)
        basis, image = np.hstack((basis, v)), np.hstack((image, w))
        t = basis.T @ image
        values, turn = np.linalg.eigh((t + t.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        keep = min(dims, len(values))
        found = basis @ turn[:, :keep]
        off = np.linalg.norm(image @ turn[:, :keep] - found * values[:keep], axis=0).max(initial=0.0)
        if basis.shape[1] >= d or off <= tol * max(values[0], 1e-300):
            break
        for _ in range(2):  # twice is enough for orthogonality
            w = w - basis @ (basis.T @ w)
        u, s, _ = np.linalg.svd(w, full_matrices=False)
        v = u[:, s > 1e-13 * max(values[0], 1e-300)][:, : d - basis.shape[1]]
        v = np.linalg.qr(v - basis @ (basis.T @ v))[0]
        if not v.shape[1]:
            break
        if basis.shape[1] > max(KEPT, 4 * wide):
            basis, image = basis @ turn[:, :wide], image @ turn[:, :wide]
    _, s, turn = np.linalg.svd(qr_tree(features, shift, found))
    return n, shift, s[:keep], (found @ turn.T)[:, :keep], float(total)


def fit_pca(features: DataFrame, dims: int | float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means, components (features by dims) and explained ratios. A float asks for the fewest whose ratios add up to more.

    Up to GRAM columns the columns' products are added up, and all ratios come back; beyond, leading() finds the components asked
    for, and their ratios. Both agree to rounding.
    """
    row = features.select(F.size("features").alias("d")).first()
    if row is not None and row.d > GRAM:
        want = int(dims) if not isinstance(dims, float) else 32
        while True:
            n, mean, s, vectors, total = leading(features, want)
            ratio = s * s / total if total > 0 else s
            if not isinstance(dims, float) or ratio.sum() > dims or len(s) < want or want >= min(n, row.d):
                break
            want *= 2
    else:
        n, s, g = gram(features)
        mean = s / max(n, 1)
        values, vectors = np.linalg.eigh((g - n * np.outer(mean, mean)) / max(n - 1, 1))
        values, vectors = np.maximum(values[::-1], 0), vectors[:, ::-1]
        ratio = values / values.sum() if values.sum() > 0 else values
    if isinstance(dims, float):
        dims = int(np.searchsorted(np.cumsum(ratio), dims, side="right")) + 1
    dims = min(int(dims), len(ratio))
    return mean, signed(vectors[:, :dims]), ratio


def signed(vectors: np.ndarray) -> np.ndarray:
    """Directions turned so that each one's largest loading is positive."""
    if not vectors.size:
        return vectors
    lead = vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])]
    return vectors * np.where(lead < 0, -1, 1)


def projected(features: DataFrame, mean: np.ndarray, vectors: np.ndarray) -> DataFrame:
    """(cell_id, pc array<double>): (features - mean) along each direction."""
    shared = features.sparkSession.sparkContext.broadcast((mean, vectors))

    def run(batches):
        mean, vectors = shared.value
        for batch in batches:
            if len(batch):
                yield pa.RecordBatch.from_arrays([batch.column(0), _lists((_wide(batch.column(1), len(batch)) - mean) @ vectors)], names=["cell_id", "pc"])

    return features.select("cell_id", _clean().alias("x")).mapInArrow(run, f"cell_id {dict(features.dtypes)['cell_id']}, pc array<double>")


def pca(features: DataFrame, dims: int | float = 20) -> DataFrame:
    """(cell_id, pc array<double>): centred projections; each component's largest loading is positive."""
    features = kept(features)  # read several times
    mean, vectors, _ = fit_pca(features, dims)
    return projected(features, mean, vectors)


def remaining_variance(ratio: np.ndarray) -> np.ndarray:
    return 1 - np.cumsum(ratio)


def _centred(n: int, s: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Singular values of the matrix less its column means, largest first."""
    return np.sqrt(np.maximum(np.linalg.eigvalsh(g - np.outer(s, s) / max(n, 1))[::-1], 0))


def singular_values(features: DataFrame) -> np.ndarray:
    """Singular values of the centred matrix, largest first."""
    return _centred(*gram(features))


def top_values(features: DataFrame, top: int, center: bool = True) -> np.ndarray:
    """The `top` largest singular values, from products of columns where these are few, else by leading()."""
    row = features.select(F.size("features").alias("d")).first()
    if row is not None and row.d > GRAM:
        return leading(features, top, center)[2]
    n, s, g = gram(features)
    return _centred(n, s if center else 0 * s, g)[:top]


def noise_floor(features: DataFrame, permutations: int = 50, average: str = "mean", seed: int = 0, together: int = 10) -> float:
    """The average top singular value, centred, when each column is permuted on its own.

    A permutation orders a column's cells by a hash of (seed, permutation, column, cell), so it is the same wherever the rows
    stand; places in that order come from running sums over ranges, and rows are put together by place. So many permutations go together.
    """
    if average not in ("mean", "median"):
        raise ValueError("average must be mean or median")
    long = kept(features.select("cell_id", F.posexplode(_clean()).alias("i", "x")))
    n = features.count()
    tops = []
    for lo in range(0, permutations if n else 0, together):
        some = long.withColumn("p", F.explode(F.sequence(F.lit(lo), F.lit(min(lo + together, permutations) - 1))))
        some = some.withColumn("h", F.xxhash64(F.lit(seed), "p", "i", "cell_id"))
        placed = running(some, ["p", "i", "h", "cell_id"], F.lit(1), "place").withColumn("place", F.col("place") % n)  # each p, i has n rows
        rows = placed.groupBy("p", "place").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("s"))
        wide = kept(rows.select("p", F.transform("s", lambda s: s["x"]).alias("features")))
        tops += [top_values(wide.where(F.col("p") == p), 1)[0] for p in range(lo, min(lo + together, permutations))]
    if not tops:
        return 0.0
    return float(np.mean(tops) if average == "mean" else np.median(tops))


@dataclass(frozen=True)
class Harmony:
    """Settings of harmonised(): clusters, spread, the pull towards mixed clusters, the ridge, and rounds."""

    clusters: int | None = None
    sigma: float = 0.1
    theta: float = 2.0
    ridge: float = 1.0
    rounds: int = 10
    steps: int = 10
    tol: float = 1e-4
    seed: int = 0


def _shares(z: np.ndarray, batch: np.ndarray, centres: np.ndarray, penalty: np.ndarray, sigma: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Directions, cluster shares of each cell, and its distance to each cluster. penalty: clusters by batches."""
    unit = z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
    far = 2 * (1 - unit @ centres.T)
    weight = -far / sigma + penalty.T[batch]
    weight = np.exp(weight - weight.max(axis=1, keepdims=True))
    return unit, weight / weight.sum(axis=1, keepdims=True), far


def harmonised(embedding: DataFrame, batches: DataFrame, settings: Harmony = Harmony()) -> DataFrame:
    """(cell_id, pc) of embedding(cell_id, pc) with the batches of batches(cell_id, batch) mixed (Harmony, Korsunsky and others, 2019).

    Rounds of soft clustering on directions, where clusters that lack a batch draw it in, and of a ridge regression per
    cluster on the batch, whose batch terms are taken off. Cells are gone over in whole passes that add up sums of clusters by batches
    by components; shares are worked out again from the centres and sums of the pass before, never kept by cell. Cells without a batch are a batch.
    """
    spark = embedding.sparkSession
    told = embedding.select("cell_id", F.col("pc").cast("array<double>").alias("pc")).join(batches.select("cell_id", F.coalesce(F.col("batch").cast("string"), F.lit("")).alias("batch")), "cell_id", "left").fillna("", ["batch"])
    names = [r.batch for r in told.select("batch").distinct().orderBy("batch").collect()]  # batches are few
    number = F.array_position(F.array(*[F.lit(x) for x in names]), F.col("batch")).cast("int") - 1 if names else F.lit(0)
    z = kept(told.select("cell_id", F.col("pc"), F.col("pc").alias("raw"), number.alias("b")))
    n = z.count()
    if n == 0:
        return embedding.select("cell_id", "pc")
    many, b_many = settings.clusters or max(1, min(100, round(n / 30))), len(names)
    sample = np.array([r.pc for r in z.orderBy(F.xxhash64("cell_id", F.lit(settings.seed)), "cell_id").limit(10_000).collect()], float)
    dims = sample.shape[1]
    unit = sample / np.maximum(np.linalg.norm(sample, axis=1, keepdims=True), 1e-12)
    rng = np.random.default_rng(settings.seed)
    centres = unit[[rng.integers(len(unit))]]
    while len(centres) < many:  # k-means++ over the sample
        d = np.maximum(1 - (unit @ centres.T).max(axis=1), 0)
        centres = np.concatenate((centres, unit[[rng.choice(len(unit), p=d / d.sum()) if d.sum() > 0 else 0]]))
    sizes = np.zeros(b_many)
    for r in z.groupBy("b").count().collect():
        sizes[r.b] = r["count"]
    penalty = np.zeros((many, b_many))

    def passed(rows: DataFrame, work, size: int) -> np.ndarray:
        def run(parts):
            total = np.zeros(size)
            for part in parts:
                if part.num_rows:
                    wide = lambda k: part.column(k).flatten().to_numpy().reshape(part.num_rows, -1)
                    total += work(wide(0), wide(1), part.column(2).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], names=["i", "v"])

        return rows.select("pc", "raw", "b").mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").toArrow().column("v").to_numpy()

    before = np.inf
    for _ in range(settings.rounds):
        last = np.inf
        for _ in range(settings.steps):

            def cluster(pc, raw, b, centres=centres, penalty=penalty):
                unit, share, far = _shares(pc, b, centres, penalty, settings.sigma)
                here = np.stack([share[b == k].sum(axis=0) for k in range(b_many)], axis=1)
                cost = (share * far).sum() + settings.sigma * (share * np.log(np.maximum(share, 1e-300))).sum()
                return np.concatenate(([cost], here.ravel(), (share.T @ unit).ravel()))

            got = passed(z, cluster, 1 + many * b_many + many * dims)
            seen, sums = got[1 : 1 + many * b_many].reshape(many, b_many), got[1 + many * b_many :].reshape(many, dims)
            centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
            due = seen.sum(axis=1, keepdims=True) * sizes[None, :] / n
            penalty = settings.theta * np.log((due + 1) / (seen + 1))
            cost = got[0] - settings.sigma * float((seen * penalty).sum())
            if abs(last - cost) < settings.tol * abs(cost):
                break
            last = cost

        def regress(pc, raw, b, centres=centres, penalty=penalty):
            share = _shares(pc, b, centres, penalty, settings.sigma)[1]
            here = np.stack([share[b == k].sum(axis=0) for k in range(b_many)], axis=1)
            each = np.stack([share[b == k].T @ raw[b == k] for k in range(b_many)], axis=1)
            return np.concatenate((here.ravel(), each.ravel()))

        got = passed(z, regress, many * b_many * (1 + dims))
        seen, sums = got[: many * b_many].reshape(many, b_many), got[many * b_many :].reshape(many, b_many, dims)
        shift = np.zeros((many, b_many, dims))
        for k in range(many):
            left = np.diag(np.concatenate(([seen[k].sum()], seen[k] + settings.ridge)))
            left[0, 1:] = left[1:, 0] = seen[k]
            shift[k] = np.linalg.lstsq(left, np.concatenate((sums[k].sum(axis=0)[None], sums[k])), rcond=None)[0][1:]

        def correct(parts, centres=centres, penalty=penalty, shift=shift):
            for part in parts:
                if part.num_rows:
                    pc, raw = (part.column(k).flatten().to_numpy().reshape(part.num_rows, -1) for k in (1, 2))
                    b = part.column(3).to_numpy()
                    share = _shares(pc, b, centres, penalty, settings.sigma)[1]
                    better = raw - np.einsum("nk,nkd->nd", share, shift.transpose(1, 0, 2)[b])
                    cuts = pa.array((np.arange(len(better) + 1) * dims).astype(np.int32))
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(cuts, pa.array(better.ravel())), part.column(2), part.column(3)], names=["cell_id", "pc", "raw", "b"])

        z = kept(z.select("cell_id", "pc", "raw", "b").mapInArrow(correct, f"cell_id {dict(embedding.dtypes)['cell_id']}, pc array<double>, raw array<double>, b int"))
        if abs(before - cost) < settings.tol * 10 * abs(cost):
            break
        before = cost
    return z.select("cell_id", "pc")
