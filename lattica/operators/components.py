"""Connected components: where edges are, those that close a cycle are dropped; what is left goes round by stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._scale import kept

#: Edges that a task looks at together.
CHUNK = 1 << 20


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node that it is linked with by these edges) of all nodes but these smallest."""
    names, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    root = np.arange(len(names))
    while len(a):
        least = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], least)
        np.minimum.at(root, root[b], least)
        while True:
            on = root[root]
            if np.array_equal(on, root):
                break
            root = on
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    more = np.flatnonzero(root != np.arange(len(names)))
    return names[more], names[root[more]]


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fewer edges of the same components: of a task at most one a node. A row of nulls tells that there was a negative weight."""
    a, b, held, negative = [], [], 0, False
    for batch in batches:
        src, dst, w = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        negative |= bool((w < 0).any())
        a.append(src[w > 0])
        b.append(dst[w > 0])
        held += len(a[-1])
        if held >= CHUNK:
            u, v = stars(np.concatenate(a), np.concatenate(b))
            a, b, held = [u], [v], 0
    u, v = stars(np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.int64),) * 2
    yield pa.RecordBatch.from_arrays([pa.array(u.tolist() + [None] * negative, pa.int64()), pa.array(v.tolist() + [None] * negative, pa.int64())], names=["u", "v"])


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes of edges(src, dst, w) with a weight above 0; component is the smallest node reachable.

    Weights of both directions add up, which only matters if some are negative. Edges stay where they are but for a task's forest, so what is
    dealt out follows the nodes. Then large-star and small-star rounds (Kiveris and others, 2014).
    """
    narrow = lambda df: df.where("src <> dst").select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), F.coalesce(F.col("w").cast("double"), F.lit(0.0)).alias("w"))
    e = kept(narrow(edges).mapInArrow(_forest, "u long, v long"))
    if not e.where("u is null").isEmpty():
        summed = narrow(edges).groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.sum("w").alias("w"))
        e = kept(summed.where("w > 0").mapInArrow(_forest, "u long, v long"))
    e, state = kept(e.distinct()), None  # v is the smaller
    while True:
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state or not now[0]:
            break
        state = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        e = kept(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
