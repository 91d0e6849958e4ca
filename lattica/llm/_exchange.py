"""Counting fingerprints over the whole corpus and handing each block the counts of its own.

Texts are dealt into blocks of a bounded size. A block sends its distinct fingerprints, one packed row
for each bucket of the fingerprint space; a bucket adds up what it gets and sends back, in the same order,
the totals. Blocks and buckets grow in number with the input, not in size, and a fingerprint counts once a block,
so neither a frequent text nor a frequent phrase makes a large group. The text itself crosses one shuffle, which
all passes of a plan share (ReusedExchange).

Narrow keys keep 32 bits inside a bucket. As buckets hold a bounded number of keys, two fingerprints of a bucket
share them with a probability that doesn't grow with the input; narrow totals may thus be too high, never too low.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES = 8 << 20
BUCKET_KEYS = 1_500_000
ENTRY = "block int, bucket int, keys binary, counts binary"
TOTAL = "block int, bucket int, counts binary"


def place(h: np.ndarray, buckets: int, narrow: bool) -> np.ndarray:
    """Sortable 64-bit places: the bucket is a monotone function of the place."""
    if not narrow:
        return h
    bucket = ((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    return (bucket << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))


def distinct(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct places in ascending order, and of each place its index in them, by one sort."""
    order = np.argsort(at)
    ranked = at[order]
    new = np.ones(len(at), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    inverse = np.empty(len(at), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return ranked[new], inverse


def bucket_of(at: np.ndarray, buckets: int, narrow: bool) -> np.ndarray:
    return (at >> np.uint64(32) if narrow else ((at >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def packed(keys: np.ndarray) -> bytes:
    """Ascending keys as differences, byte by byte: first all their lowest bytes, last the highest, which are zeros
    that the shuffle's compression takes away."""
    steps = np.diff(keys, prepend=keys.dtype.type(0))
    return steps.view(np.uint8).reshape(-1, keys.itemsize).T.tobytes()


def unpacked(blobs: list[bytes], kind: type) -> np.ndarray:
    """The keys of packed() blobs, one blob after the other."""
    size = np.dtype(kind).itemsize
    out = [np.zeros(0, kind)]
    for b in blobs:
        steps = np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(size, -1).T).view(kind).ravel()
        out.append(np.cumsum(steps, dtype=kind))
    return np.concatenate(out)


def plain(counts: np.ndarray) -> bytes:
    """Counts as bytes; wide ones byte by byte, as their upper bytes are mostly zeros that compression takes away."""
    return counts.tobytes() if counts.itemsize < 4 else np.ascontiguousarray(counts.view(np.uint8).reshape(-1, counts.itemsize).T).tobytes()


def counted(blobs: list[bytes], kind: str) -> np.ndarray:
    """The counts of plain() blobs, one blob after the other."""
    size = np.dtype(kind).itemsize
    if size < 4:
        return np.frombuffer(b"".join(blobs), kind)
    return np.concatenate([np.zeros(0, kind), *(np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(size, -1).T).view(kind).ravel() for b in blobs)])


def entry_rows(block: int, at: np.ndarray, counts: np.ndarray, buckets: int, narrow: bool) -> pa.RecordBatch:
    """at: distinct places in ascending order."""
    b = bucket_of(at, buckets, narrow)
    cut = np.flatnonzero(np.diff(b)) + 1
    firsts = np.concatenate(([0], cut)) if len(at) else np.zeros(0, np.int64)
    lasts = np.concatenate((cut, [len(at)])) if len(at) else firsts
    keys = (at & np.uint64(0xFFFFFFFF)).astype(np.uint32) if narrow else at
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(len(firsts), block, np.int32)),
            pa.array(b[firsts].astype(np.int32)) if len(firsts) else pa.array([], pa.int32()),
            pa.array([packed(keys[i:j]) for i, j in zip(firsts, lasts)], pa.binary()),
            pa.array([plain(counts[i:j]) for i, j in zip(firsts, lasts)], pa.binary()),
        ],
        names=["block", "bucket", "keys", "counts"],
    )


def totals(entries: DataFrame, narrow: bool, kind: str, cap: int, wide: str | None = None) -> DataFrame:
    """For each entry row, the totals of its keys over all rows, capped, as (block, bucket, counts).

    kind: numpy type of the counts; wide: that of the totals, if it is another. A capped total says "at least the cap".
    """
    key = np.uint32 if narrow else np.uint64

    def add(table: pa.Table) -> pa.Table:
        blobs = table.column("keys").to_pylist()
        keys = unpacked(blobs, key)
        counts = counted(table.column("counts").to_pylist(), kind)
        _, inverse = distinct(keys)
        total = np.minimum(np.bincount(inverse, weights=counts), cap).astype(wide or kind)[inverse]
        ends = np.cumsum([len(x) // keys.itemsize for x in blobs])
        out = [plain(total[i:j]) for i, j in zip(np.concatenate(([0], ends[:-1])), ends)]
        return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "counts": pa.array(out, pa.binary())})

    return entries.groupBy("bucket").applyInArrow(add, TOTAL)


def joined(table: pa.Table, kind: str) -> np.ndarray:
    """A block's totals in the order of its places."""
    if not table.num_rows:
        return np.zeros(0, kind)
    order = np.argsort(table.column("bucket").to_numpy(), kind="stable")
    blobs = table.column("counts").to_pylist()
    return counted([blobs[i] for i in order], kind)


def dealt(docs: DataFrame, blocks: int, *columns: str) -> DataFrame:
    """docs with `bh`, a hash of the row, and `block`, which it is dealt to. Rows with equal texts part by doc_id."""
    return docs.select(*columns, F.xxhash64(*columns).alias("bh")).withColumn("block", F.pmod("bh", F.lit(blocks)).cast("int"))
