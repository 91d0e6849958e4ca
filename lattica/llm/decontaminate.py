"""Benchmark decontamination by spaced seeds that no passage can lack.

A spaced seed is a fixed mask over word positions: windows agree under it when they agree at the mask's positions, whatever
stands at the others. A family of masks is used that every passage of the asked length and density holds at least one of,
however its changed words lie; lossless() proves that by going through all arrangements. The masked windows of the benchmark
items are hashed, those of training texts are joined to them, and around each hit the diagonal is compared word by
word, allowing substitutions. Of hits that follow one another on a diagonal only the first counts, and the others aren't even
listed, so that a text and an item which both repeat themselves don't multiply. The benchmark is taken in slices of a bounded number
of words; each slice goes to the executors and the texts are scanned once per slice, so neither side is ever shuffled and
memory doesn't grow with either.
"""

from __future__ import annotations

from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import _STEPS, Words, mix, word_pieces

SLICE_WORDS = 2_000_000
MIN_WORDS, DENSITY = 12, 75
#: Items of fewer words are left out: they don't say where a text comes from.
LEAST_ITEM = 6
#: Hits, or words, that are compared at once.
CHUNK = 2_000_000
#: Families of masks, the most selective first; each is the positions that must agree.
FAMILIES = (
    ((0, 1, 2, 3, 4), (0, 1, 3, 4, 5), (0, 1, 3, 5, 6), (0, 1, 2, 3, 6)),
    ((0, 1, 2, 3), (0, 1, 2, 4)),
    ((0, 1, 2),),
    ((0, 1),),
    ((0,),),
)


def lossless(masks: tuple[tuple[int, ...], ...], min_words: int, density: int) -> bool:
    """Whether every run of words with min_words matches or more at that density agrees with one of the masks somewhere.

    Goes over all arrangements of matches without such a place, told apart by their last words, and keeps the most
    matches of each length. Past some lengths what they lack of the density only grows, by at least one mask's rate.
    """
    span = max(m[-1] for m in masks) + 1
    state = np.arange(1 << span)  # the lowest bit is the last word
    hit = np.zeros(1 << span, bool)
    for m in masks:
        bits = sum(1 << (m[-1] - k) for k in m)
        hit |= (state & bits) == bits
    most = np.full(1 << (span - 1), -np.inf)
    most[0] = 0
    lack = []
    for length in range(1, 8 * max(min_words, span) + 1):
        then = np.full(1 << span, -np.inf)
        for bit in (0, 1):
            then[bit::2] = most + bit
        then[hit] = -np.inf
        most = np.maximum(then[: 1 << (span - 1)], then[1 << (span - 1) :])
        best = most.max()
        if best >= min_words and 100 * best >= density * length:
            return False
        lack.append(density * length - 100 * best)
    return min(lack[-span:]) > max(0, max(lack[len(lack) // 2 - span : len(lack) // 2]))


def masks_for(min_words: int, density: int) -> tuple[tuple[int, ...], ...]:
    """The most selective family that no passage can lack."""
    return next((f for f in FAMILIES if lossless(f, max(min_words, 1), density)), FAMILIES[-1])


def windows(words: np.ndarray, row: np.ndarray, mask: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Positions whose window under the mask stays in its row, and its hash."""
    n = len(row) - mask[-1]
    at = np.flatnonzero(row[:n] == row[mask[-1] :]) if n > 0 else np.zeros(0, np.int64)
    out = np.zeros(len(at), np.uint64)
    for k in mask:
        out += words[at + k] * _STEPS[k]
    return at, mix(out + np.uint64(sum(1 << k for k in mask)))


def follows(at: np.ndarray, row: np.ndarray, h: np.ndarray, none: int) -> np.ndarray:
    """A hash of each window together with the one before it in its row; none: what stands for no window."""
    last = np.full(len(h), none, np.uint64)
    some = np.flatnonzero((at[1:] == at[:-1] + 1) & (row[at[1:]] == row[at[:-1]])) + 1
    last[some] = h[some - 1]
    return mix(h * _STEPS[0] + last)


_FILTER_BITS = 22
_LOW = np.uint64((1 << _FILTER_BITS) - 1)


class Seeds:
    """The windows of a slice's items under one mask, sorted by hash and, within it, by the window before."""

    def __init__(self, words: np.ndarray, item: np.ndarray, sizes: np.ndarray, mask: tuple[int, ...], least: int, most: int | None = None):
        self.mask = mask
        at, h = windows(words, item, mask)
        keep = sizes[item[at]] >= least
        if most is not None:
            keep &= sizes[item[at]] <= most
        chain = follows(at, item, h, 1)
        at, h, chain = at[keep], h[keep], chain[keep]
        order = np.lexsort((chain, h))
        self.at, self.hashes, chain = at[order], h[order], chain[order]
        # marks of the hashes' low bits pass most others by before the exact look-up
        self.marks = np.zeros(1 << _FILTER_BITS, bool)
        self.marks[(h & _LOW).astype(np.int64)] = True
        first = np.flatnonzero(np.concatenate(([len(chain) > 0], chain[1:] != chain[:-1])))
        last = np.append(first[1:], len(chain))
        by = np.argsort(chain[first], kind="stable")
        self.chains, self.chain_lo, self.chain_hi = chain[first][by], first[by], last[by]

    def ranges(self, words: np.ndarray, row: np.ndarray):
        """(at, lo, hi): windows of texts and ranges of those of items that agree with them, without those whose
        windows before agree as well."""
        at, h = windows(words, row, self.mask)
        chain = follows(at, row, h, 0)
        some = self.marks[(h & _LOW).astype(np.int64)]
        at, h, chain = at[some], h[some], chain[some]
        lo, hi = np.searchsorted(self.hashes, h, side="left"), np.searchsorted(self.hashes, h, side="right")
        some = lo < hi
        at, chain, lo, hi = at[some], chain[some], lo[some], hi[some]
        k = np.minimum(np.searchsorted(self.chains, chain), max(len(self.chains) - 1, 0))
        same = self.chains[k] == chain if len(self.chains) else np.zeros(0, bool)
        cut_lo, cut_hi = np.where(same, self.chain_lo[k], lo), np.where(same, self.chain_hi[k], lo)
        return np.concatenate((at, at)), np.concatenate((lo, cut_hi)), np.concatenate((cut_lo, hi))


class Slice:
    """A bounded part of the benchmark: its words' hashes and the seeds of its items."""

    def __init__(self, column: pa.Array, masks: tuple[tuple[int, ...], ...], least_item: int = LEAST_ITEM):
        words, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for _, _, w in word_pieces(column):
            words.append(w.hashes())
            sizes.append(w.counts)
        self.words = np.concatenate(words)
        sizes = np.concatenate(sizes)
        self.bounds = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
        self.item = np.repeat(np.arange(len(sizes)), sizes)
        solid = len(masks[0])
        self.seeds = [Seeds(self.words, self.item, sizes, m, least_item) for m in masks]
        # shorter items have to match whole
        self.seeds += [Seeds(self.words, self.item, sizes, tuple(range(n)), n, n) for n in range(max(least_item, 1), solid)]


def diagonals(words: np.ndarray, row: np.ndarray, part: Slice):
    """(row, item, shift) of diagonals with a hit, in turns of bounded size, in which each stands once; shift: text position less item position."""
    for seeds in part.seeds:
        at, lo, hi = seeds.ranges(words, row)
        n = hi - lo
        at, lo, n = at[n > 0], lo[n > 0], n[n > 0]
        total = np.concatenate(([0], np.cumsum(n)))
        a = 0
        while a < len(at):
            b = max(a + 1, int(np.searchsorted(total, total[a] + CHUNK, side="right")) - 1)
            src = np.repeat(at[a:b], n[a:b])
            dst = seeds.at[np.arange(total[a], total[b]) - np.repeat(total[a:b] - lo[a:b], n[a:b])]
            key = np.stack((row[src], part.item[dst], src - dst))
            key = key[:, np.lexsort(key[::-1])]
            yield key[:, np.concatenate(([True], (key[:, 1:] != key[:, :-1]).any(axis=0)))]
            a = b


def long_enough(words: np.ndarray, bounds: np.ndarray, found: np.ndarray, part: Slice, min_words: int) -> np.ndarray:
    """Rows (row, item, -matches, begin, end, shift) of the diagonals with as many matches in all as a passage needs, in that order; begin and end in words."""
    row, item, shift = found
    i0, i1 = part.bounds[item], part.bounds[item + 1]
    lo, hi = np.maximum(bounds[row], shift + i0), np.minimum(bounds[row + 1], shift + i1)
    size = hi - lo
    out, a, total = [np.zeros((0, 6), np.int64)], 0, np.concatenate(([0], np.cumsum(size)))
    while a < len(size):
        b = max(a + 1, int(np.searchsorted(total, total[a] + CHUNK, side="right")) - 1)
        at = np.arange(total[a], total[b]) - np.repeat(total[a:b] - lo[a:b], size[a:b])
        same = words[at] == part.words[at - np.repeat(shift[a:b], size[a:b])]
        many = np.add.reduceat(same, total[a:b] - total[a], dtype=np.int64)
        ok = many >= np.minimum(min_words, (i1 - i0)[a:b])
        out.append(np.stack((row[a:b], item[a:b], -many, lo[a:b], hi[a:b], shift[a:b]), axis=1)[ok])
        a = b
    rows = np.concatenate(out)
    return rows[np.lexsort(rows.T[::-1])]


def passages(w: Words, part: Slice, min_words: int, density: int) -> dict[tuple[int, int], tuple[int, int, int, int]]:
    """For each text and item with a passage the best: (matches, -span, item words, -first word in the text)."""
    words, row = w.hashes(), w.rows()
    best: dict[tuple[int, int], tuple[int, int, int, int]] = {}
    for found in diagonals(words, row, part):
        for r, item, minus, lo, hi, shift in long_enough(words, w.bounds, found, part, min_words).tolist():
            n, span, _, at = best.get((r, item), (0, 0, 0, 0))
            if -minus < n or (-minus == n == -span and lo - int(w.bounds[r]) >= -at):
                continue  # cannot be better
            size = int(part.bounds[item + 1] - part.bounds[item])
            n, s, e = best_run(words[lo:hi] == part.words[lo - shift : hi - shift], density)
            if n >= min(min_words, size):
                best[(r, item)] = max(best.get((r, item), (0, 0, 0, 0)), (n, -(e - s), size, -(lo + s - int(w.bounds[r]))))
    return best


def best_run(same: np.ndarray, density: int) -> tuple[int, int, int]:
    """(matches, begin, end) of the run with the most matches of which density per cent of its words match.

    Any run of that density begins and ends on a match in its best form; found over prefix sums of
    100 * match - density in one sweep of the running minima.
    """
    total = np.concatenate(([0], np.cumsum(np.where(same, 100 - density, -density))))
    count = np.concatenate(([0], np.cumsum(same)))
    low = np.flatnonzero(np.concatenate(([True], total[1:] < np.minimum.accumulate(total)[:-1])))
    # for each end the earliest begin whose prefix sum isn't larger: prefix minima fall strictly at `low`
    k = np.searchsorted(-total[low], -total, side="left")
    ok = k < len(low)
    begin = low[np.minimum(k, len(low) - 1)]
    begin = np.where(ok & (begin <= np.arange(len(total))), begin, np.arange(len(total)))
    gain = count - count[begin]
    end = int(np.argmax(gain))
    return int(gain[end]), int(begin[end]), end


def contaminated(docs: DataFrame, benchmark: DataFrame, min_words: int = MIN_WORDS, density: int = DENSITY, least_item: int = LEAST_ITEM) -> DataFrame:
    """(doc_id, item_id, n_matched, n_span, item_words, word_start) for each passage of docs(doc_id, text) that copies
    an item of benchmark(item_id, text): on one diagonal, a run of words of which density per cent or more match, with
    at least min(min_words, all words of the item) matches; the best run for each document and item: the most matches, then
    the shortest, then the first. Words are `[^\\x20\\x09-\\x0D]+`, lower-cased in A-Z; word_start counts the text's words from 0.

    Null or empty texts and items copy nothing; neither do items of under least_item words. Repeated rows each give their rows;
    an empty benchmark gives an empty result; other columns are ignored.
    """
    kinds = dict(docs.dtypes)["doc_id"], dict(benchmark.dtypes)["item_id"]
    out = docs.sparkSession.createDataFrame([], f"doc_id {kinds[0]}, item_id {kinds[1]}, n_matched long, n_span long, item_words long, word_start long")
    sized = benchmark.select("item_id", "text", F.octet_length(F.coalesce("text", F.lit(""))).alias("n"))
    total = sized.agg(F.sum("n")).first()[0] or 0
    slices = max(1, -(-total // (6 * SLICE_WORDS)))
    sized = sized.withColumn("slice", F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)))
    masks = masks_for(min_words, density)
    for k in range(slices):
        part = sized.where(F.col("slice") == k).select("item_id", "text").toArrow()
        if part.num_rows:
            out = out.unionByName(_scan(docs, Slice(part.column("text"), masks, least_item), part.column("item_id").combine_chunks(), min_words, density, kinds))
    return out


def _scan(docs: DataFrame, part: Slice, item_ids: pa.Array, min_words: int, density: int, kinds: tuple[str, str]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast((part, item_ids))

    def run(batches):
        part, item_ids = shared.value
        for batch in batches:
            for a, b, w in word_pieces(batch.column(1)):
                best = passages(w, part, min_words, density)
                if best:
                    rows = pa.array([r for r, _ in best])
                    vals = list(best.values())
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0)[a:b].take(rows), item_ids.take(pa.array([i for _, i in best])), pa.array([int(v[0]) for v in vals]), pa.array([int(-v[1]) for v in vals]), pa.array([int(v[2]) for v in vals]), pa.array([int(-v[3]) for v in vals])],
                        names=["doc_id", "item_id", "n_matched", "n_span", "item_words", "word_start"],
                    )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kinds[0]}, item_id {kinds[1]}, n_matched long, n_span long, item_words long, word_start long")


def decontaminated(docs: DataFrame, benchmark: DataFrame, min_words: int = MIN_WORDS, density: int = DENSITY) -> DataFrame:
    """docs without the documents that copy a benchmark passage. Rows without doc_id are kept if their text is clean."""
    row = next(name for name in (f"__row{i}" for i in count()) if name not in docs.columns)
    keyed = docs.withColumn(row, F.xxhash64("doc_id", "text"))
    bad = contaminated(keyed.select(F.col(row).alias("doc_id"), "text"), benchmark, min_words, density).select(F.col("doc_id").alias(row)).distinct()
    return keyed.join(bad, row, "left_anti").drop(row)
