"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of every whole text are computed once with numpy, and written down. Trees are fitted on the driver to
at most `max_rows` labelled rows (the ones with the smallest hash of doc_id; the only bounded sample here) and flattened into
arrays, in which all rows walk all trees at once, level by level.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import Words, mix, pieces, shingles, sorted_sets, string_buffers
from ._cluster import saved

MAX_ROWS = 30_000
FEATURES = (
    "log_bytes", "log_words", "word_mean", "word_std", "word_max", "upper", "digit", "space", "newline", "wide", "stop", "comma", "bang", "pipe", "mark", "quote",
    "byte_entropy", "distinct_words", "distinct_pairs", "distinct_lines", "log_lines", "line_mean", "caps_words", "marked_words", "ended_words", "short_words", "top_word", "digit_words",
)


def _classes() -> np.ndarray:
    """The class of each byte: 0 other, 1 upper, 2 digit, 3 space, 4 newline, 5 wide, 6 stop, 7 comma, 8 bang, 9 pipe, 10 mark, 11 quote."""
    out = np.zeros(256, np.int64)
    for k, chars in ((1, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (2, b"0123456789"), (3, b" \t\r\v\f"), (4, b"\n"), (6, b".?"), (7, b",;:"), (8, b"!"), (9, b"|"), (10, b"#$%&*@^~=+<>_/\\[]{}"), (11, b"\"'`()-")):
        out[list(chars)] = k
    out[128:] = 5
    return out


_CLASS = _classes()


def _by_row(rows: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(rows, weights, minlength=n)[:n].astype(float)


def _distinct(values: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    return np.diff(sorted_sets(values, rows, n)[1]).astype(float)


def statistics(raw: np.ndarray, words: Words) -> np.ndarray:
    """The rows' statistics, rows by FEATURES. raw: the piece's bytes before lower-casing."""
    n = len(words.counts)
    size = np.diff(words.offsets).astype(float)
    rows = np.repeat(np.arange(n), np.diff(words.offsets))
    kinds = np.bincount(rows * 12 + _CLASS[raw], minlength=n * 12).reshape(n, 12) / np.maximum(size, 1)[:, None]
    hist = np.bincount(rows * 256 + words.buf, minlength=n * 256).reshape(n, 256) / np.maximum(size, 1)[:, None]
    entropy = -(hist * np.log2(np.where(hist > 0, hist, 1))).sum(axis=1)
    w_row, w_len, w_hash = words.rows(), (words.ends - words.starts).astype(float), words.hashes()
    many = words.counts.astype(float)
    some = np.maximum(many, 1)
    mean = _by_row(w_row, n, w_len) / some
    spread = np.sqrt(np.maximum(_by_row(w_row, n, w_len**2) / some - mean**2, 0))
    longest = np.zeros(n)
    np.maximum.at(longest, w_row, w_len)
    pairs, pair_row = shingles(words, 2)
    at = np.flatnonzero(raw == 10)
    cut = np.unique(np.concatenate((words.offsets[:-1], at + 1)))  # starts of lines
    cut = cut[cut < len(raw)]
    line_row = np.searchsorted(words.offsets, cut, side="right") - 1
    first = np.searchsorted(words.starts, cut)
    last = np.searchsorted(words.starts, np.concatenate((cut[1:], [len(raw)])))
    # a line's print: its words' hashes, summed
    plain = np.concatenate((np.zeros(1, np.uint64), np.cumsum(w_hash)))
    line_print = mix(plain[last] - plain[first])
    lines = _by_row(line_row, n)
    upper = np.concatenate(([0], np.cumsum(_CLASS[raw] == 1)))
    marks = np.concatenate(([0], np.cumsum((_CLASS[raw] == 10) | (_CLASS[raw] == 8))))
    digits = np.concatenate(([0], np.cumsum(_CLASS[raw] == 2)))
    inside = lambda c: c[words.ends] - c[words.starts]
    last_byte = _CLASS[raw[words.ends - 1]] if len(w_len) else np.zeros(0, int)
    ordered = np.lexsort((w_hash, w_row))
    run = np.flatnonzero(np.concatenate((np.ones(min(len(ordered), 1), bool), (np.diff(w_row[ordered]) != 0) | (w_hash[ordered][1:] != w_hash[ordered][:-1]))))
    top = np.zeros(n)
    if len(run):
        np.maximum.at(top, w_row[ordered][run], np.diff(np.concatenate((run, [len(ordered)]))))
    share = lambda flags: _by_row(w_row, n, flags.astype(float)) / some
    out = np.stack(
        [
            np.log1p(size), np.log1p(many), mean, spread, longest, *kinds[:, 1:].T,
            entropy, _distinct(w_hash, w_row, n) / some, _distinct(pairs, pair_row, n) / np.maximum(_by_row(pair_row, n), 1), _distinct(line_print, line_row, n) / np.maximum(lines, 1),
            np.log1p(lines), size / np.maximum(lines, 1), share((inside(upper) >= 2) & (inside(upper) * 2 >= w_len)), share(inside(marks) > 0), share((last_byte == 6) | (last_byte == 7)), share(w_len <= 3), top / some, share(inside(digits) > 0),
        ],
        axis=1,
    )
    return out


def column_statistics(column: pa.Array) -> np.ndarray:
    buf, offsets = string_buffers(column)
    out = [np.zeros((0, len(FEATURES)))]
    for a, b in pieces(offsets):
        raw = buf[offsets[a] : offsets[b]]
        out.append(statistics(raw, Words(raw, offsets[a : b + 1])))
    return np.concatenate(out)


def with_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, x array<double>) of each row of docs(doc_id, text): its FEATURES; a null text counts as empty."""

    def run(batches):
        for batch in batches:
            x = column_statistics(batch.column(1))
            cuts = pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(cuts, pa.array(x.reshape(-1)))], names=["doc_id", "x"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, x array<double>")


@dataclass
class Forest:
    """Complete binary trees as arrays, trees by nodes: go left where x[feature] <= threshold."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray  # trees by leaves
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of label 1 of each row."""
        total = np.full(len(x), self.base)
        depth = int(np.log2(self.value.shape[1])) if len(self.value) else 0
        trees = np.arange(len(self.value))[None, :]
        for a in range(0, len(x), 2048):
            part = x[a : a + 2048]
            rows = np.arange(len(part))[:, None]
            node = np.zeros((len(part), len(self.value)), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (part[rows, self.feature[trees, node]] > self.threshold[trees, node])
            total[a : a + 2048] += self.value[trees, node - (self.value.shape[1] - 1)].sum(axis=1)
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 120, depth: int = 4, rate: float = 0.1, bins: int = 64, l2: float = 2.0, least: float = 10.0) -> Forest:
    """Newton boosting of the logistic loss with histogram splits. Without rows, or with one label only, a constant."""
    n, p = x.shape
    mean = (y.sum() + 0.5) / (n + 1)
    base = float(np.log(mean / (1 - mean)))
    shape = (0, 2**depth - 1)
    if n == 0 or y.min() == y.max():
        return Forest(np.zeros(shape, np.int64), np.zeros(shape), np.zeros((0, 2**depth)), base)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(p)]
    code = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)  # x <= edges[k] iff code <= k
    flat = code + np.arange(p) * bins
    score = np.full(n, base)
    features, thresholds, values = [], [], []
    for _ in range(trees):
        prob = 1 / (1 + np.exp(-score))
        g, h = prob - y, prob * (1 - prob)
        node = np.zeros(n, np.int64)
        f, t = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf)
        for level in range(depth):
            many, first = 2**level, 2**level - 1
            at = ((node - first)[:, None] * (p * bins) + flat).ravel()
            hist = [np.bincount(at, np.repeat(w, p), minlength=many * p * bins).reshape(many, p, bins).cumsum(axis=2) for w in (g, h)]
            gl, hl = hist[0][:, :, :-1], hist[1][:, :, :-1]
            gt, ht = hist[0][:, :, -1:], hist[1][:, :, -1:]
            gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
            gain[(hl < least / 4) | (ht - hl < least / 4)] = -1
            for j, e in enumerate(edges):
                gain[:, j, len(e) :] = -1
            best = gain.reshape(many, -1).argmax(axis=1)
            for k in range(many):
                j, b = divmod(int(best[k]), bins - 1)
                if gain[k, j, b] > 1e-9:
                    f[first + k], t[first + k] = j, edges[j][b]
            node = 2 * node + 1 + (x[np.arange(n), f[node]] > t[node])
        leaf = node - (2**depth - 1)
        v = -rate * np.bincount(leaf, g, minlength=2**depth) / (np.bincount(leaf, h, minlength=2**depth) + l2)
        score += v[leaf]
        features.append(f)
        thresholds.append(t)
        values.append(v)
    return Forest(np.array(features), np.array(thresholds), np.array(values), base)


def held_out() -> F.Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0


def trained(x: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Forest:
    """A forest fitted to the rows of x(doc_id, x) that are labelled and not held out, at most max_rows of them.

    Of several rows of one doc_id the one with the smallest statistics counts, whatever their order.
    """
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    train = known.where(~held_out()).join(x.groupBy("doc_id").agg(F.min("x").alias("x")), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows).select("x", "quality").toArrow()
    rows = np.array(train.column("x").combine_chunks().flatten()).reshape(-1, len(FEATURES)) if train.num_rows else np.zeros((0, len(FEATURES)))
    return fit(rows, np.array(train.column("quality"), float))


def scored(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, max_rows: int = MAX_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of docs(doc_id, text), learnt from labels(doc_id, quality).

    Only labelled rows whose crc32(doc_id as text) mod 5 isn't 0 are learnt from, at most max_rows of them; scores see
    the text alone. Null and empty texts get a score like others. A row without doc_id isn't held out; null labels are left
    out, and of several labels of a doc_id the largest holds. With no labels to learn from, or only one kind, every score is the same
    and follows the labels' mean. Repeated rows each give their row; other columns are ignored.
    """
    x = saved(with_statistics(docs))
    forest = docs.sparkSession.sparkContext.broadcast(trained(x, labels, max_rows))

    def run(batches):
        for batch in batches:
            values = np.array(batch.column(2).flatten()).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(forest.value.score(values))], names=["doc_id", "held_out", "score"])

    kind = dict(docs.dtypes)["doc_id"]
    out = x.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "x").mapInArrow(run, f"doc_id {kind}, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, max_rows: int = MAX_ROWS) -> DataFrame:
    """docs, with all its columns, without the rows that the classifier scores below the threshold; see scored().

    The text is read twice, for the statistics of labelled rows and for the verdicts, and never shuffled.
    """
    marked = docs.join(F.broadcast(_labelled(labels)), "doc_id", "left_semi") if _is_small(labels) else docs
    forest = docs.sparkSession.sparkContext.broadcast(trained(with_statistics(marked), labels, max_rows))
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(forest.value.score(column_statistics(batch.column(at))) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def _labelled(labels: DataFrame) -> DataFrame:
    return labels.where("doc_id is not null and quality is not null").where(~held_out()).select("doc_id").distinct()


def _is_small(labels: DataFrame, rows: int = 1_000_000) -> bool:
    """Whether the labelled ids may be broadcast: at most `rows` of them, some 16 MB."""
    return labels.count() <= rows
