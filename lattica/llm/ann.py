"""Approximate nearest neighbours by largest inner product, over randomly rotated one-bit codes.

RaBitQ (Gao and Long, 2024): a vector less its block's centre is rotated at random and kept as one sign bit a dimension, packed,
with three scalars: its norm, its inner product with its own code and that with the centre. A query's inner product with the
codes then estimates that with the vectors without bias, with an error bound that shrinks as 1 / sqrt(dimensions). The vectors with the
best estimates give a score that the k-th nearest reaches at least; all whose upper bound reaches it too are reranked by exact
inner products in double precision.

Codes are made once, where the vectors are read, and kept in blocks beside them: nothing is shuffled for the index. Queries go to
the executors in slices of bounded size. A task goes through the codes of its blocks, with the k-th score that each query has so far as
its floor, looks up the full vectors of what may reach it, and sends on k rows a query at most. So full vectors stay where
they are, and what is shuffled doesn't depend on the number of candidates.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._cluster import parts, saved

#: Vectors in a block, at most; fewer where they are long, so that a block has a bounded size.
BLOCK_ROWS, BLOCK_BYTES = 8192, 16 << 20
#: Bytes of the queries that are sent out at once.
SLICE_BYTES = 32 << 20
#: Queries whose bounds are worked out together, and numbers looked up at once for exact scores.
CHUNK, PAIRS = 256, 1 << 22
#: The share of a block from which on its vectors are reranked by a matrix product.
DENSE = 1 / 32
#: Standard errors of the estimate that its bounds allow for.
EPSILON = 3.0
INDEX = "dims int, ids binary, vectors binary, bits binary, scalars binary, centre binary"


@lru_cache(maxsize=4)
def rotation(dims: int, seed: int = 7) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


class Codes:
    """The packed one-bit codes of a block of vectors, with their correction scalars and the block's centre."""

    def __init__(self, bits: np.ndarray, norm: np.ndarray, own: np.ndarray, with_centre: np.ndarray, centre: np.ndarray):
        self.bits, self.norm, self.own, self.with_centre, self.centre = bits, norm, own, with_centre, centre
        self.dims = len(centre)
        self.error = np.sqrt(np.maximum(1 - own**2, 0)) / own / np.sqrt(max(self.dims - 1, 1))

    @staticmethod
    def of(vectors: np.ndarray) -> Codes:
        centre = vectors.mean(axis=0)
        rest = vectors - centre
        turned = rest @ rotation(vectors.shape[1])
        norm = np.linalg.norm(turned, axis=1)
        unit = turned / np.where(norm > 0, norm, 1)[:, None]
        own = np.where(norm > 0, np.abs(unit).sum(axis=1) / np.sqrt(vectors.shape[1]), 1.0)
        return Codes(np.packbits(unit > 0, axis=1), norm, own, rest @ centre, centre)

    def signs(self) -> np.ndarray:
        return (np.unpackbits(self.bits, axis=1, count=self.dims).astype(np.float32) * 2 - 1) / np.float32(np.sqrt(self.dims))

    def bounds(self, queries: np.ndarray, epsilon: float, signs: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Estimates of the inner products, queries by vectors, and how far off they may be.

        <q, v> is <q, c> + <c, v - c> + <q - c, v - c>; only the last part is estimated.
        """
        turned = (queries - self.centre) @ rotation(self.dims)
        size = np.linalg.norm(turned, axis=1).astype(np.float32)
        middle = turned.astype(np.float32) @ (self.signs() if signs is None else signs).T
        middle *= (self.norm / self.own).astype(np.float32)
        middle += self.with_centre.astype(np.float32)
        middle += (queries @ self.centre).astype(np.float32)[:, None]
        return middle, size[:, None] * (epsilon * self.norm * self.error + 1e-6 * np.abs(self.norm)).astype(np.float32)

    def packed(self, vectors: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        blob = lambda x, kind: pa.array([np.ascontiguousarray(x, kind).tobytes()], pa.binary())
        scalars = np.stack((self.norm, self.own, self.with_centre))
        narrow = "<f4" if np.array_equal(vectors, vectors.astype(np.float32)) else "<f8"  # read back exactly
        return pa.RecordBatch.from_arrays([pa.array([self.dims], pa.int32()), blob(ids, "<i8"), blob(vectors, narrow), blob(self.bits, "u1"), blob(scalars, "<f8"), blob(self.centre, "<f8")], names=["dims", "ids", "vectors", "bits", "scalars", "centre"])

    @staticmethod
    def unpacked(dims: int, bits: bytes, scalars: bytes, centre: bytes) -> Codes:
        return Codes(np.frombuffer(bits, np.uint8).reshape(-1, -(-dims // 8)), *np.frombuffer(scalars, "<f8").reshape(3, -1), np.frombuffer(centre, "<f8"))


def vectors_of(blob: pa.Buffer, rows: int, dims: int) -> np.ndarray:
    return np.frombuffer(blob, f"<f{blob.size // (rows * dims)}").reshape(rows, dims).astype(float)


def exact(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Row by row inner products in double precision, the same for the same rows wherever they stand."""
    return (queries * vectors).sum(axis=1)


class Search:
    """The k best so far of each query, best first, ties to the smaller id."""

    def __init__(self, queries: np.ndarray, query_ids: np.ndarray, k: int, epsilon: float):
        self.queries, self.query_ids, self.k, self.epsilon = queries, query_ids, k, epsilon
        self.scores = np.full((len(queries), k), -np.inf)
        self.ids = np.full((len(queries), k), np.iinfo(np.int64).max)  # in empty places

    def _pairs(self, q: np.ndarray, v: np.ndarray, vectors: np.ndarray) -> np.ndarray:
        step = max(PAIRS // vectors.shape[1], 1)
        return np.concatenate([np.zeros(0), *(exact(self.queries[q[i : i + step]], vectors[v[i : i + step]]) for i in range(0, len(q), step))])

    def add(self, codes: Codes, vectors: np.ndarray, ids: np.ndarray) -> int:
        """Takes in a block; the number of exact scores that this took."""
        k, looked, signs = self.k, 0, codes.signs()
        for a in range(0, len(self.queries), CHUNK):
            some = np.arange(a, min(a + CHUNK, len(self.queries)))
            middle, slack = codes.bounds(self.queries[some], self.epsilon, signs)
            floor = self.scores[some, -1].copy()
            new = np.flatnonzero(floor == -np.inf)
            if len(new) and len(ids) > 4 * k:
                # k others that are likely near, scored exactly, are a first floor
                likely = np.argpartition(-middle[new], 4 * k - 1, axis=1)[:, : 4 * k]
                score = self._pairs(np.repeat(some[new], 4 * k), likely.ravel(), vectors).reshape(-1, 4 * k)
                score[ids[likely] == self.query_ids[some[new], None]] = -np.inf
                floor[new] = np.partition(score, -k, axis=1)[:, -k]
                looked += score.size
            # float32 keeps fewer digits than the exact floor
            low = np.nextafter(floor.astype(np.float32), np.float32(-np.inf)) - 1e-6 * np.abs(np.where(np.isfinite(floor), floor, 0)).astype(np.float32)
            slack += middle
            near = slack >= low[:, None]
            near &= ids[None, :] != self.query_ids[some, None]
            many = int(np.count_nonzero(near))
            looked += many
            if many > near.size * DENSE:
                # so many are cheaper in one matrix product; it may round otherwise, so those it leaves near the floor are scored again
                size = np.linalg.norm(self.queries[some], axis=1)[:, None] * np.linalg.norm(vectors, axis=1).max()
                near &= self.queries[some] @ vectors.T >= floor[:, None] - 1e-12 * vectors.shape[1] * size
            q, v = np.nonzero(near)
            score = self._pairs(some[q], v, vectors)
            keep = score >= floor[q]
            q, v, score = q[keep], v[keep], score[keep]
            if not len(q):
                continue
            of = np.concatenate((np.repeat(np.arange(len(some)), k), q))
            all_ids, all_scores = np.concatenate((self.ids[some].ravel(), ids[v])), np.concatenate((self.scores[some].ravel(), score))
            order = np.lexsort((all_ids, -all_scores, of))
            first = np.searchsorted(of[order], np.arange(len(some)))
            best = order[(first[:, None] + np.arange(k)).ravel()]
            self.ids[some], self.scores[some] = all_ids[best].reshape(-1, k), all_scores[best].reshape(-1, k)
        return looked


def indexed(vectors: DataFrame) -> DataFrame:
    """The blocks of clean vectors(vec_id, v) with their codes, kept."""

    def build(batches):
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def block(dims: int) -> pa.RecordBatch:
            ids, v = (np.concatenate(x) for x in zip(*held.pop(dims)))
            return Codes.of(v).packed(v, ids)

        for batch in batches:
            sizes, ids = pc.list_value_length(batch.column(1)), batch.column(0)
            for dims in pc.unique(sizes).to_pylist():
                mine = batch.filter(pc.equal(sizes, dims))
                ids, v = mine.column(0).to_numpy(), mine.column(1).flatten().to_numpy().reshape(-1, dims)
                most = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * dims)))
                while len(ids):
                    room = most - sum(len(x) for x, _ in held.get(dims, []))
                    held.setdefault(dims, []).append((ids[:room], v[:room]))
                    ids, v = ids[room:], v[room:]
                    if sum(len(x) for x, _ in held[dims]) == most:
                        yield block(dims)
        for dims in list(held):
            yield block(dims)

    return saved(vectors.mapInArrow(build, INDEX))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, epsilon: float = EPSILON) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k nearest of vectors(vec_id, embedding) by inner product.

    queries has the same columns; a query never finds rows with its own vec_id. Nearest first, ties to the smaller
    vec_id; fewer than k where there are fewer candidates. Vectors that are null, all zero, without vec_id or with null,
    NaN or infinite components take no part, as queries or as candidates; only vectors of equal length compare. Rows that share
    a vec_id are candidates each, and queries each: every query row, repeated ones included, gives its own ranks from 1.
    Empty tables give an empty result; other columns are ignored.
    """
    spark = vectors.sparkSession

    def clean(df: DataFrame) -> DataFrame:
        v = F.col("embedding").cast("array<double>")
        bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
        return df.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & (F.size("v") > 0) & ~F.exists("v", bad) & F.exists("v", lambda x: x != 0))

    asked = saved(clean(queries).groupBy("vec_id", "v").agg(F.count("*").alias("copies")))
    slices = parts(asked.agg(F.sum(8 * F.size("v"))).first()[0] or 0, SLICE_BYTES)
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if asked.isEmpty():
        return out
    index = indexed(clean(vectors))
    for s in range(slices):
        part = asked.where(F.pmod(F.xxhash64("vec_id", "v"), F.lit(slices)) == s).toArrow()
        if part.num_rows:
            out = out.unionByName(_searched(index, part, k, epsilon))
    return out


def _searched(index: DataFrame, asked: pa.Table, k: int, epsilon: float) -> DataFrame:
    sizes, by_dims = pc.list_value_length(asked.column("v")), {}
    for dims in pc.unique(sizes).to_pylist():
        at = np.flatnonzero(pc.equal(sizes, dims).to_numpy())
        mine = asked.take(pa.array(at))
        by_dims[dims] = (mine.column("v").combine_chunks().flatten().to_numpy().reshape(-1, dims), mine.column("vec_id").to_numpy(), at, mine.column("copies").to_numpy())
    shared = index.sparkSession.sparkContext.broadcast(by_dims)

    def run(batches):
        found: dict[int, Search] = {}
        for batch in batches:
            for dims, ids, v, *code in zip(*(c if i else c.to_pylist() for i, c in enumerate(batch.columns))):
                if dims in shared.value:
                    q, q_ids, *_ = shared.value[dims]
                    search = found.setdefault(dims, Search(q, q_ids, k, epsilon))
                    ids = np.frombuffer(ids.as_buffer(), "<i8")
                    search.add(Codes.unpacked(dims, *(x.as_buffer() for x in code)), vectors_of(v.as_buffer(), len(ids), dims), ids)
        for dims, search in found.items():
            _, q_ids, number, copies = shared.value[dims]
            for a in range(0, len(q_ids), 4096):
                real = search.scores[a : a + 4096] > -np.inf
                of = a + np.nonzero(real)[0]
                yield pa.RecordBatch.from_arrays([pa.array(number[of]), pa.array(q_ids[of]), pa.array(copies[of]), pa.array(search.ids[a : a + 4096][real]), pa.array(search.scores[a : a + 4096][real])], names=["number", "query_id", "copies", "vec_id", "score"])

    rows = index.mapInArrow(run, "number long, query_id long, copies long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("number").orderBy(F.desc("score"), "vec_id"))
    best = rows.withColumn("rank", rank).where(F.col("rank") <= k)
    return best.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
