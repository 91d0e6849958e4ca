"""Removal of long byte strings that occur more than once, by difference-cover blockwise suffix comparison.

Every byte that lies in a string of `length` bytes that also starts anywhere else is removed. Following the
difference-cover construction of suffix arrays (Burkhardt and Karkkainen, 2003), positions p with p mod v in a
difference cover D of v form the sample: for any two suffixes i and j there is a shift below v that puts both in the
sample. So equal strings of `length` bytes always hold a common sample suffix whose first length - v + 1 bytes are equal.

1. Sample suffixes get ranks: blocks send the fingerprints of their first length - v + 1 bytes, and one bucket of the
   fingerprint space at a time is sorted to see which ranks are shared.
2. Sample suffixes of shared rank are compared over `length` bytes, again bucket by bucket. In any long match their
   windows follow one another within v bytes, so they already cover the inside of every match.
3. What is left are the ends of matches, less than v bytes each: suffixes that reach a shared sample rank within v bytes
   and whose window isn't covered yet. For each shared rank, blocks say at which shifts before it they have such suffixes;
   every block with that rank then learns the shifts asked for.
4. The suffixes at those shifts, and no others, are compared over `length` bytes too.

A block holds a bounded number of bytes, a bucket a bounded number of suffixes, whatever repeats in them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import pieces, prefix_hash, span_hash, string_buffers
from ._cluster import parts, text_bytes
from ._exchange import BLOCK_BYTES, BUCKET_KEYS, ENTRY, TOTAL, dealt, distinct, entry_rows, joined, place, totals, unpacked

#: Perfect difference sets (each difference mod v occurs once).
COVERS = {
    7: (0, 1, 3),
    13: (0, 1, 3, 9),
    21: (0, 1, 4, 14, 16),
    31: (0, 1, 3, 8, 12, 18),
    57: (0, 1, 3, 13, 32, 36, 43, 52),
    73: (0, 1, 3, 7, 15, 31, 36, 54, 63),
    91: (0, 1, 3, 9, 27, 49, 56, 61, 77, 81),
    133: (0, 1, 3, 12, 20, 34, 38, 81, 88, 94, 104, 109),
}


def cover_for(length: int) -> tuple[int, tuple[int, ...]]:
    """The largest cover that leaves at least a third of the length for ranks."""
    v = max((v for v in COVERS if 3 * v <= 2 * length), default=7)
    if length < 10:
        raise ValueError("length must be 10 bytes at least")
    return v, COVERS[v]


class _Piece:
    """A piece of whole texts: its sample suffixes and windows, as positions in the piece."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, length: int):
        self.buf, self.offsets, self.length = buf, offsets, length
        self.v, cover = cover_for(length)
        self.reach = length - self.v + 1
        sizes = np.diff(offsets)
        most = int(sizes.max(initial=0))
        shifts = (np.arange(most // self.v + 1)[:, None] * self.v + np.array(cover)).ravel()
        many = np.where(sizes >= length, np.searchsorted(shifts, sizes - self.reach, side="right"), 0)
        which = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        self.sample = shifts[which] + np.repeat(offsets[:-1], many)
        edge = np.zeros(len(buf) + 1, np.int8)
        long = sizes >= length
        edge[offsets[:-1][long]] += 1
        edge[offsets[1:][long] - length + 1] -= 1
        self.starts = np.cumsum(edge[:-1], dtype=np.int8) > 0  # where a window fits in its text
        self._prefix: np.ndarray | None = None

    def prefix(self) -> np.ndarray:
        if self._prefix is None:
            self._prefix = prefix_hash(self.buf)
        return self._prefix

    def ranks(self) -> np.ndarray:
        return span_hash(self.prefix(), self.sample, self.sample + self.reach)

    def windows(self, at: np.ndarray) -> np.ndarray:
        return span_hash(self.prefix(), at, at + self.length)

    def first(self, shared: np.ndarray) -> np.ndarray:
        """Sample suffixes to compare in full; shared: which of the sample have a shared rank."""
        at = self.sample[shared]
        return at[self.starts[at]]

    def covered(self, at: np.ndarray) -> np.ndarray:
        d = np.zeros(len(self.buf) + 1, np.int32)
        np.add.at(d, at, 1)
        np.add.at(d, at + self.length, -1)
        return np.cumsum(d[:-1]) > 0

    def asks(self, shared: np.ndarray, found: np.ndarray) -> np.ndarray:
        """For each shared sample suffix the least and largest shift back to a window that isn't covered; 255, 0: none."""
        n, anchors = len(self.buf), self.sample[shared]
        near = np.zeros(n + 1, np.int32)
        near[anchors + 1] = 1
        near = np.cumsum(near)
        done = np.concatenate(([0], np.cumsum(self.covered(found), dtype=np.int32)))
        i = np.flatnonzero(self.starts)
        i = i[(near[i + self.v] > near[i]) & (done[i + self.length] - done[i] < self.length)]
        out = np.empty((len(anchors), 2), np.uint8)
        out[:] = 255, 0
        if len(i):
            lowest = np.maximum(anchors - self.v + 1, self.begins(anchors))
            before = np.searchsorted(i, anchors, side="right") - 1
            after = np.searchsorted(i, lowest)
            some = (before >= 0) & (i[before] >= lowest)
            out[some, 0] = (anchors - i[before])[some]
            out[some, 1] = (anchors[some] - i[after[some]])
        return out

    def begins(self, at: np.ndarray) -> np.ndarray:
        return self.offsets[np.searchsorted(self.offsets, at, side="right") - 1]

    def second(self, shared: np.ndarray, asked: np.ndarray) -> np.ndarray:
        """The suffixes at the shifts asked for."""
        anchors = self.sample[shared]
        some = asked[:, 0] <= asked[:, 1]
        anchors, asked = anchors[some], asked[some].astype(np.int64)
        lo = np.maximum(anchors - asked[:, 1], self.begins(anchors))
        hi = anchors - asked[:, 0] + 1
        ok = lo < hi
        d = np.zeros(len(self.buf) + 1, np.int32)
        np.add.at(d, lo[ok], 1)
        np.add.at(d, hi[ok], -1)
        return np.flatnonzero((np.cumsum(d[:-1]) > 0) & self.starts)


def _block(text: pa.Table, length: int):
    column = text.column("text")
    buf, offsets = string_buffers(column)
    for a, b in pieces(offsets):
        yield a, b, _Piece(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], length)


def _spread(h: list[np.ndarray], back: np.ndarray, buckets: int, narrow: bool) -> list[np.ndarray]:
    """For each piece's fingerprints, what came back for the block's distinct ones."""
    if not h:
        return []
    told = back[distinct(place(np.concatenate(h), buckets, narrow))[1]]
    return np.split(told, np.cumsum([len(x) for x in h[:-1]]))


class _Passes:
    """What a block works out from what came back to it so far."""

    def __init__(self, text: pa.Table, back: dict[int, np.ndarray], length: int, buckets: tuple[int, int]):
        self.cut = list(_block(text, length))
        self.pieces = [p for _, _, p in self.cut]
        self.back, self.buckets = back, buckets

    def ranks(self) -> list[np.ndarray]:
        return [p.ranks() for p in self.pieces]

    def shared(self, ranks: list[np.ndarray]) -> list[np.ndarray]:
        return [x > 1 for x in _spread(ranks, self.back[1], self.buckets[0], True)]

    def first(self, shared: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        at = [p.first(s) for p, s in zip(self.pieces, shared)]
        return at, [p.windows(x) for p, x in zip(self.pieces, at)]

    def found(self, shared: list[np.ndarray]) -> list[np.ndarray]:
        """The sample suffixes whose window occurs again."""
        at, h = self.first(shared)
        return [x[f > 1] for x, f in zip(at, _spread(h, self.back[2], self.buckets[1], False))]

    def second(self, shared: list[np.ndarray], ranks: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        asked = _spread([r[s] for r, s in zip(ranks, shared)], self.back[3].view(np.uint8).reshape(-1, 2), self.buckets[0], True)
        at = [p.second(s, a) for p, s, a in zip(self.pieces, shared, asked)]
        return at, [p.windows(x) for p, x in zip(self.pieces, at)]

    def covered(self) -> list[np.ndarray]:
        ranks = self.ranks()
        shared = self.shared(ranks)
        at, h = self.second(shared, ranks)
        more = _spread(h, self.back[4], self.buckets[1], False)
        return [p.covered(np.concatenate((x, y[m > 1]))) for p, x, y, m in zip(self.pieces, self.found(shared), at, more)]


def _widest(entries: DataFrame) -> DataFrame:
    """For each key the widest range of shifts that any block asks for."""

    def run(table: pa.Table) -> pa.Table:
        blobs = table.column("keys").to_pylist()
        keys = unpacked(blobs, np.uint32)
        asks = np.frombuffer(b"".join(table.column("counts").to_pylist()), np.uint8).reshape(-1, 2)
        order = np.argsort(keys, kind="stable")
        firsts = np.flatnonzero(np.concatenate(([True], np.diff(keys[order]) != 0)))
        group = np.cumsum(np.concatenate(([0], (np.diff(keys[order]) != 0).astype(np.int64))))
        best = np.stack((np.minimum.reduceat(asks[order, 0], firsts), np.maximum.reduceat(asks[order, 1], firsts)), axis=1)
        out = np.empty_like(asks)
        out[order] = best[group]
        ends = np.cumsum([len(x) // 4 for x in blobs])
        cuts = [out[i:j].tobytes() for i, j in zip(np.concatenate(([0], ends[:-1])), ends)]
        return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "counts": pa.array(cuts, pa.binary())})

    return entries.groupBy("bucket").applyInArrow(run, TOTAL)


def removed_bytes(docs: DataFrame, length: int = 200) -> DataFrame:
    """(doc_id, n_bytes, starts, ends, kept) of each row of docs(doc_id, text).

    starts and ends are the maximal runs of removed bytes, end exclusive; kept is the rest of the UTF-8 bytes,
    binary because a cut may part a character. A null text counts as empty; a text under `length` bytes keeps all.
    Strings are judged on the input, repeats may overlap or lie in one text, and matches never cross rows: repeated rows
    remove each other. Rows without doc_id and rows that share one are handled like others; other columns are ignored.
    """
    size = text_bytes(docs)
    blocks = parts(size, BLOCK_BYTES)
    v, cover = cover_for(length)
    buckets = (parts(size * len(cover) / v, BUCKET_KEYS), parts(size / 10, BUCKET_KEYS))
    text = dealt(docs.select("doc_id", "text"), blocks, "doc_id", "text").select("block", "doc_id", "text")
    by_block = text.groupBy("block")

    def known(right: pa.Table | None) -> dict[int, np.ndarray]:
        if right is None:
            return {}
        step = right.column("step").to_numpy()
        return {k: joined(right.filter(pa.array(step == k)), "u2" if k == 3 else "u1") for k in (1, 2, 3, 4)}

    def entries(left: pa.Table, h: list[np.ndarray], which: int) -> pa.Table:
        at, n = np.unique(place(np.concatenate(h) if h else np.zeros(0, np.uint64), buckets[which], which == 0), return_counts=True)
        return pa.Table.from_batches([entry_rows(left.column("block")[0].as_py(), at, np.minimum(n, 2).astype(np.uint8), buckets[which], which == 0)])

    def send_ranks(left: pa.Table) -> pa.Table:
        return entries(left, _Passes(left, {}, length, buckets).ranks(), 0)

    def send_first(left: pa.Table, right: pa.Table) -> pa.Table:
        p = _Passes(left, known(right), length, buckets)
        return entries(left, p.first(p.shared(p.ranks()))[1], 1)

    def send_asks(left: pa.Table, right: pa.Table) -> pa.Table:
        p = _Passes(left, known(right), length, buckets)
        ranks = p.ranks()
        shared = p.shared(ranks)
        at = place(np.concatenate([r[s] for r, s in zip(ranks, shared)] or [np.zeros(0, np.uint64)]), buckets[0], True)
        asks = np.concatenate([x.asks(s, f) for x, s, f in zip(p.pieces, shared, p.found(shared))] or [np.zeros((0, 2), np.uint8)])
        order = np.argsort(at, kind="stable")
        at, asks = at[order], asks[order]
        firsts = np.flatnonzero(np.concatenate(([len(at) > 0], at[1:] != at[:-1])))
        if len(at):
            asks = np.stack((np.minimum.reduceat(asks[:, 0], firsts), np.maximum.reduceat(asks[:, 1], firsts)), axis=1)
        return pa.Table.from_batches([entry_rows(left.column("block")[0].as_py(), at[firsts], np.ascontiguousarray(asks).view(np.uint16).reshape(-1), buckets[0], True)])

    def send_second(left: pa.Table, right: pa.Table) -> pa.Table:
        p = _Passes(left, known(right), length, buckets)
        ranks = p.ranks()
        return entries(left, p.second(p.shared(ranks), ranks)[1], 1)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        passes = _Passes(left, known(right), length, buckets)
        sizes, starts, ends, kept = [], [], [], []
        for p, c in zip(passes.pieces, passes.covered()):
            for lo, hi in zip(p.offsets[:-1], p.offsets[1:]):
                gone = c[lo:hi]
                edge = np.diff(np.concatenate(([0], gone.view(np.int8), [0])))
                sizes.append(hi - lo)
                starts.append(np.flatnonzero(edge == 1))
                ends.append(np.flatnonzero(edge == -1))
                kept.append((p.buf[lo:hi][~gone] if len(starts[-1]) else p.buf[lo:hi]).tobytes())
        long_list = pa.list_(pa.int64())
        return pa.table({"doc_id": left.column("doc_id"), "n_bytes": pa.array(sizes, pa.int64()), "starts": pa.array(starts, long_list), "ends": pa.array(ends, long_list), "kept": pa.array(kept, pa.binary())})

    step = lambda k, df: df.select("block", F.lit(k).alias("step"), "bucket", "counts")
    back = step(1, totals(by_block.applyInArrow(send_ranks, ENTRY), True, "u1", 2))
    for k, send in ((2, send_first), (3, send_asks), (4, send_second)):
        sent = by_block.cogroup(back.groupBy("block")).applyInArrow(send, ENTRY)
        back = back.unionByName(step(k, _widest(sent) if k == 3 else totals(sent, False, "u1", 2)))
    kind = dict(docs.dtypes)["doc_id"]
    return by_block.cogroup(back.groupBy("block")).applyInArrow(finish, f"doc_id {kind}, n_bytes long, starts array<long>, ends array<long>, kept binary")
