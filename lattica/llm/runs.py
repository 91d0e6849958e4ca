"""Periodic runs of words, by Karp-Miller-Rosenberg naming.

Blocks of 2**k words get names, level by level: a block's name stands for the names of its two halves, so equal names mean
equal words and nothing is hashed. A block that occurs once in its document drops out and never meets another; a level
names only what is left, by one sort. The longest common extension of two places follows by descending levels.

A run of period q and length times * q holds (times - 1) * q places at which a word equals the one q further on, so some
block of 2**k words on the grid of that step, 2**(k + 1) - 1 <= (times - 1) * q, equals the block q further on. Each level thus
tests its grid against the few q that belong to it, some n tests a level; what is equal is extended both ways. Work is n log n
words of a document in any case, all words equal included.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Words that are named together, and pairs of places that are tested together. A longer document is a group of its own.
TOGETHER, TESTS = 1 << 18, 1 << 20
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def named(code: np.ndarray, ends: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each level the names of all places, and the ascending places whose names occur again.

    code: dense numbers of words, different from document to document; ends: where the document of each place ends. A name of
    n or more is its place's own.
    """
    n = len(code)
    own = np.arange(n, 2 * n)
    live = np.flatnonzero(np.bincount(code)[code] > 1) if n else np.zeros(0, np.int64)
    name = own.copy()
    name[live] = code[live]
    names, lives, half = [name], [live], 1
    while len(live):
        live = live[live + 2 * half <= ends[live]]
        live = live[name[live + half] < n]
        key = name[live] * n + name[live + half]
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        new = np.ones(len(key), bool)
        new[1:] = ranked[1:] != ranked[:-1]
        group = np.cumsum(new) - 1
        again = np.bincount(group, minlength=1)[group] > 1
        name = own.copy()
        name[live[order[again]]] = group[again]
        live = np.sort(live[order[again]])
        half *= 2
        if len(live):
            names.append(name)
            lives.append(live)
    return names, lives


def extended(names: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many words are equal from i and j on, and how many before them; i < j."""
    n, here, there, back = len(names[0]), i.copy(), j.copy(), i.copy()
    gap = j - i
    for k in range(len(names) - 1, -1, -1):
        name, step = names[k], 1 << k
        ok = (there < n) & (name[np.minimum(here, n - 1)] == name[np.minimum(there, n - 1)])
        here += ok * step
        there += ok * step
        before = np.maximum(back - step, 0)
        back -= ((back >= step) & (name[before] == name[before + gap])) * step
    return here - i, i - back


def found(code: np.ndarray, ends: np.ndarray, times: int, least: int) -> np.ndarray:
    """Rows (start, length, period) of all runs, by start, then period; see named() for the arguments."""
    names, lives = named(code, ends)
    n, rows = len(code), [np.zeros((0, 3), np.int64)]
    for k, live in enumerate(lives):
        name, step = names[k], 1 << k
        periods = np.arange(max(1, -(-(2 * step - 1) // (times - 1))), (4 * step - 2) // (times - 1) + 1)
        grid = live[live % step == 0]
        many = max(1, TESTS // max(1, len(periods)))
        for lo in range(0, len(grid) if len(periods) else 0, many):
            at = grid[lo : lo + many]
            far = at + periods[:, None]
            q, g = np.nonzero(name[np.minimum(far, n - 1)] == np.where(far < n, name[at], -1))
            # of blocks that follow one another at one period the first will do: they are in one run
            first = np.ones(len(q), bool)
            first[1:] = (q[1:] != q[:-1]) | (at[g[1:]] - at[g[:-1]] != step)
            i, period = at[g[first]], periods[q[first]]
            after, before = extended(names, i, i + period)
            run = np.stack((i - before, after + before + period, period), axis=1)
            rows.append(run[run[:, 1] >= np.maximum(least, times * period)])
    every = np.concatenate(rows)
    every = every[np.lexsort((every[:, 2], every[:, 1], every[:, 0]))]
    # a stretch that several periods fill has the smallest of them
    new = np.ones(len(every), bool)
    new[1:] = (every[1:, :2] != every[:-1, :2]).any(axis=1)
    every = every[new]
    return every[np.lexsort((every[:, 2], every[:, 0]))]


def _rows(ids: list, texts: list[list[bytes]], times: int, least: int, id_type: pa.DataType) -> pa.RecordBatch:
    sizes = np.array([len(t) for t in texts], np.int64)
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    code, so_far = np.empty(offsets[-1], np.int64), 0
    for words, lo in zip(texts, offsets):
        seen = dict.fromkeys(words)
        seen = dict(zip(seen, range(so_far, so_far + len(seen))))
        code[lo : lo + len(words)] = np.fromiter(map(seen.__getitem__, words), np.int64, len(words))
        so_far += len(seen)
    runs = found(code, np.repeat(offsets[1:], sizes), times, least)
    edge = np.bincount(runs[:, 0] + runs[:, 2], minlength=len(code) + 1) - np.bincount(runs[:, 0] + runs[:, 1], minlength=len(code) + 1)
    gone = np.cumsum(edge)[: len(code)] > 0
    cuts = np.searchsorted(runs[:, 0], offsets)
    start = runs[:, 0] - np.repeat(offsets[:-1], np.diff(cuts))
    kept = []
    for words, lo, hi in zip(texts, offsets, offsets[1:]):
        some = gone[lo:hi]
        kept.append(b" ".join([w for w, g in zip(words, some) if not g] if some.any() else words))
    spans = pa.StructArray.from_arrays([pa.array(start), pa.array(runs[:, 1]), pa.array(runs[:, 2])], fields=list(RUN))
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, id_type), pa.array(sizes), pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), spans), pa.array(kept, pa.binary()).cast(pa.string())],
        names=["doc_id", "n_words", "runs", "collapsed"],
    )


def periodic_runs(docs: DataFrame, times: int = 4, least: int = 6) -> DataFrame:
    """(doc_id, n_words, runs array<(start, length, period)>, collapsed) of each row of docs(doc_id, text).

    Words are what stands between white space (ASCII), numbered from 0. A run is a stretch of consecutive words of smallest
    period `period` and at least max(least, times * period) long that no neighbouring word extends at that period; runs may
    overlap, and are listed by start, then period. `collapsed` are the words, joined by one space, without those that a run holds
    after its first period. A null or empty text, or one of white space only, has no words, no runs and an empty `collapsed`.
    Each row is looked at alone: repeated rows and ids, and null ids, give a row each; an empty table gives none; other
    columns are ignored, whatever their names. A task holds one document, or a group of 2**18 words, some 200 bytes a word.
    """
    if times < 2 or least < 2:
        raise ValueError("times and least must be 2 or more")
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, words, id_type = [], [], 0, batch.column(0).type
            for one, text in zip(batch.column(0), batch.column(1)):
                cut = (text.as_buffer().to_pybytes() if text.is_valid else b"").split()
                if texts and words + len(cut) > TOGETHER:
                    yield _rows(ids, texts, times, least, id_type)
                    ids, texts, words = [], [], 0
                ids.append(one.as_py())
                texts.append(cut)
                words += len(cut)
            if texts:
                yield _rows(ids, texts, times, least, id_type)

    schema = f"doc_id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return docs.select("doc_id", "text").mapInArrow(run, schema)
