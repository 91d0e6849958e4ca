"""Language identification by hierarchical discrimination: the family first, then the languages within it.

A text is its letter n-grams (one to four, words marked off, case and everything but letters left out), hashed to DIMS bins, as the square
roots of their shares; such vectors have length 1. A softmax model tells the families apart. Within a family, each pair of
languages has a linear support vector machine, and the language that wins most pairs is predicted, of equals the one with the larger
sum of margins. Families are those of FAMILIES; a language that isn't listed there is a family of its own.

Models are fitted on the driver to at most `max_rows` rows of the training part, shared out evenly over its languages; which rows
follows from a hash of the row. Everything else covers every row and whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMS, ORDERS = 4096, 4
#: Training rows, all languages together, and languages; more of these raise an error.
MAX_ROWS, MAX_LANGUAGES = 8_000, 500
#: Code points that are looked at together; longer texts are gone through in parts that overlap by the longest n-gram.
PART = 1 << 18
#: Families of languages by ISO 639-1 code.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nl nn no sv yi",
    "romance": "ca co es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "celtic": "br cy ga gd",
    "indic": "bn gu hi mr ne pa si ur",
    "iranian": "fa ku ps tg",
    "turkic": "az kk ky tk tr tt uz",
    "uralic": "et fi hu",
    "semitic": "am ar he mt",
    "dravidian": "kn ml ta te",
    "austronesian": "id jv mg ms tl",
}
_FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes.split()}
_LETTER = np.zeros(0, bool)


def family(lang: str) -> str:
    """The family of a language tag (its first part counts, in any case), or the tag itself."""
    return _FAMILY.get(lang.replace("_", "-").split("-")[0].lower(), lang)


def _letters() -> np.ndarray:
    """For every code point whether it is a letter; made once a worker."""
    global _LETTER
    if not len(_LETTER):
        _LETTER = np.array([chr(c).isalpha() for c in range(0x110000)])
    return _LETTER


def _grams(text: str) -> Iterator[np.ndarray]:
    """Bins of all n-grams of a text, part by part; none for a text without letters. N-grams of one word, with a mark before and after it."""
    lower = text.lower()
    for lo in range(0, len(lower), PART):
        # a code point (a mark, at the text's start) and what the last n-grams reach come along; the mark is a start of its own
        piece = np.frombuffer(((lower[lo - 1] if lo else " ") + lower[lo : lo + PART + ORDERS]).encode("utf-32-le", "surrogatepass"), np.uint32)
        at = np.concatenate((np.where(_letters()[piece], piece, 0), np.zeros(ORDERS, np.uint32))).astype(np.uint64)
        word = at > 0
        first = 1 if lo else 0
        good = (word[:-1] | word[1:])[first : min(PART + 1, len(piece))]  # a mark starts an n-gram only where a word follows
        h = np.zeros(len(good), np.uint64)
        for n in range(ORDERS):
            this = at[first + n : first + n + len(good)]
            h = (h ^ (this + np.uint64(n + 1))) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            some = good & ((this > 0) if n == 0 else True)
            yield (h[some] >> np.uint64(20) & np.uint64(DIMS - 1)).astype(np.int64)
            # an n-gram ends with the mark after its word
            good = good & ((this > 0) | (n == 0))


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of square roots of n-gram shares, and which texts have a letter; the others' rows are 0."""
    x = np.zeros((len(texts), DIMS), np.float32)
    for row, text in zip(x, texts):
        for bins in _grams(text) if text else ():
            row += np.bincount(bins, minlength=DIMS)
    total = x.sum(axis=1, keepdims=True)
    return np.sqrt(x / np.maximum(total, 1)), total[:, 0] > 0


def softmax_fit(x: np.ndarray, y: np.ndarray, classes: int, rounds: int = 200, ridge: float = 1e-5) -> np.ndarray:
    """Weights (DIMS + 1 by classes) of a softmax model, by accelerated gradient steps; classes count alike."""
    share = (1 / np.maximum(np.bincount(y, minlength=classes), 1)[y] / max(1, len(np.unique(y)))).astype(x.dtype)
    w = last = np.zeros((x.shape[1] + 1, classes), x.dtype)
    told = np.eye(classes, dtype=x.dtype)[y]
    for r in range(rounds):
        v = w + np.float32(r / (r + 3)) * (w - last)
        z = x @ v[:-1] + v[-1]
        p = np.exp(z - z.max(axis=1, keepdims=True))
        g = (p / p.sum(axis=1, keepdims=True) - told) * share[:, None]
        last, w = w, v - np.float32(2) * (np.vstack((x.T @ g, g.sum(axis=0))) + np.float32(ridge) * v)
    return w


def svm_fit(x: np.ndarray, y: np.ndarray, cost: float = 10.0, rounds: int = 20, seed: int = 0) -> np.ndarray:
    """Weights (DIMS + 1) of a linear support vector machine for y of -1 and 1, by dual coordinate descent (Hsieh and others, 2008).

    The rarer side costs more, in proportion.
    """
    bound = np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y < 0).sum()))) * cost
    norm, alpha, w, free = 1 + np.einsum("ij,ij->i", x, x), np.zeros(len(y)), np.zeros(x.shape[1], x.dtype), 0.0
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(y)):
            new = min(max(alpha[i] - (y[i] * (float(x[i] @ w) + free) - 1) / norm[i], 0.0), bound[i])
            if new != alpha[i]:
                w += np.float32((new - alpha[i]) * y[i]) * x[i]
                free += (new - alpha[i]) * y[i]
                moved = max(moved, abs(new - alpha[i]) / bound[i])
                alpha[i] = new
        if moved < 1e-3:
            break
    return np.append(w, free)


@dataclass
class Model:
    """languages: of each family, its languages; stage: weights of the families; pairs: (family, i, j) -> weights, above 0 for i."""

    languages: list[list[str]]
    stage: np.ndarray
    pairs: dict[tuple[int, int, int], np.ndarray]

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Languages and scores: the family's probability times the language's within it. `und`, with score 0, where no letter is."""
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        x, some = features(texts)
        z = x @ self.stage[:-1] + self.stage[-1]
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        names, score = np.full(len(texts), "und", object), np.zeros(len(texts))
        for f, langs in enumerate(self.languages):
            rows = np.flatnonzero(some & (best == f))
            wins, sums, chance = (np.zeros((len(rows), len(langs))) for _ in range(3))
            for (of, i, j), w in self.pairs.items():
                if of == f and len(rows):
                    m = x[rows] @ w[:-1] + w[-1]
                    sure = 1 / (1 + np.exp(-2 * np.clip(m, -50, 50)))
                    for k, sign, c in ((i, 1, sure), (j, -1, 1 - sure)):
                        wins[:, k] += sign * m > 0
                        sums[:, k] += sign * m
                        chance[:, k] += c
            order = np.lexsort((sums, wins))[:, -1] if len(langs) > 1 and len(rows) else np.zeros(len(rows), np.int64)
            mine = chance[np.arange(len(rows)), order] / (len(langs) - 1) if len(langs) > 1 else 1.0
            names[rows], score[rows] = np.array(langs, object)[order], p[rows, f] * mine
        return names.tolist(), score


def fit(x: np.ndarray, langs: list[str]) -> Model:
    """A model of rows x of features() and their languages. Without rows it knows none."""
    families = sorted({family(g) for g in langs})
    languages = [sorted({g for g in langs if family(g) == f}) for f in families]
    if not families:
        return Model([], np.zeros((DIMS + 1, 0)), {})
    y, of = np.array(langs, object), np.array([families.index(family(g)) for g in langs])
    pairs = {}
    for f, names in enumerate(languages):
        for i in range(len(names)):
            for j in range(i + 1, len(names)):
                rows = (y == names[i]) | (y == names[j])
                pairs[f, i, j] = svm_fit(x[rows], np.where(y[rows] == names[i], 1.0, -1.0)).astype(np.float32)
    return Model(languages, softmax_fit(x, of, len(families)).astype(np.float32), pairs)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def trained(docs: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """A model of the rows of docs(doc_id, text, lang) that are not held out and have both a language and a letter.

    At most max_rows rows are fitted, those with the smallest hash of (doc_id, text) of their language; equal texts of one language count once.
    """
    rows = docs.where(~held_out()).where("lang is not null and text is not null")
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not sizes:
        return fit(np.zeros((0, DIMS), np.float32), [])
    each = max(2, max_rows // len(sizes))
    # of each language the share that makes its part of the rows; hashes are spread evenly
    share = F.create_map(*[x for g, n in sizes.items() for x in (F.lit(g), F.lit(min(1.0, each / n)))])
    place = F.xxhash64("doc_id", "text")
    chosen = rows.where((place / 2.0**64 + 0.5) < share[F.col("lang")]).select("lang", "text", place.alias("h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, some = features(batch.column(1).to_pylist())
            packed = pa.array([r.tobytes() for r in x.astype(np.float16)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), packed], names=["lang", "h", "x"]).filter(pa.array(some))

    got = chosen.mapInArrow(run, "lang string, h long, x binary").orderBy("h", "lang", "x").limit(2 * max_rows).toArrow()
    rows = dict.fromkeys(zip(got.column("lang").to_pylist(), got.column("x").to_pylist()))
    x = np.frombuffer(b"".join(b for _, b in rows), np.float16).reshape(-1, DIMS).astype(np.float32)
    return fit(x, [g for g, _ in rows])


def identified(docs: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of each row of docs(doc_id, text, lang), learnt from its own rows that aren't held out.

    Held out are rows whose crc32(doc_id as text) mod 3 is 1; a row without doc_id isn't. A prediction sees the whole text and nothing else; it is
    `und`, with score 0, where the text is null or has no letter, and everywhere if there is no row to learn from. With a single
    language to learn from, that is the prediction. Rows with a null lang aren't learnt from. Repeated rows each give their row; other columns are ignored.
    """
    docs = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    model = docs.sparkSession.sparkContext.broadcast(trained(docs, max_rows))
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                names, score = model.value.predict(part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(names, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
