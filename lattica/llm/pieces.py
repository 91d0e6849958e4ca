"""Encoding and decoding with the pieces of a SentencePiece model, by streaming Viterbi.

The best segmentation maximises the sum of the pieces' scores; a character that no piece of its own covers costs
the least score less 10 and is written as its UTF-8 bytes. Only as many end positions as the longest piece has
characters can still be extended, so the search holds that window; whenever the backpointer paths of all of them meet in one
boundary, the ids up to it are committed and forgotten. Spaces become U+2581, and one is put before the text.

Where the model has no piece with U+2581 after another character, every U+2581 that follows one is such
a boundary whatever comes next. Texts are cut there beforehand, and a bounded table keeps the ids of
cuts seen before.
"""

from __future__ import annotations

import codecs
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SPACE = "▁"
#: Cuts in each of a worker's two tables, the newer and the older, and the longest that it keeps, in characters.
TABLE_SIZE, TABLE_CHARS = 250_000, 48
UNKNOWN, CONTROL, BYTE, UNUSED = 2, 3, 6, 5


def _fields(data: bytes) -> Iterator[tuple[int, bytes | int]]:
    """The fields of a protocol-buffer message: number and value."""
    pos = 0

    def varint() -> int:
        nonlocal pos
        shift = value = 0
        while True:
            b = data[pos]
            pos += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while pos < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = varint() if kind == 2 else 8 if kind == 1 else 4
        yield key >> 3, data[pos : pos + size]
        pos += size


class Pieces:
    """A vocabulary with its scores, as a trie over characters."""

    def __init__(self, model: bytes):
        self.pieces: list[str] = []
        self.kinds: list[int] = []
        scores: list[float] = []
        for number, value in _fields(model):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece.get(1, b"").decode())
                scores.append(float(np.frombuffer(piece.get(2, bytes(4)), "<f4")[0]))
                self.kinds.append(int(piece.get(3, 1)))
        usable = [i for i, k in enumerate(self.kinds) if k in (1, 4)]
        self.bytes = {int(self.pieces[i][1:-1], 16): i for i, k in enumerate(self.kinds) if k == BYTE}
        self.unk = next((i for i, k in enumerate(self.kinds) if k == UNKNOWN), 0)
        self.penalty = min((scores[i] for i in usable if scores[i] > -1e8), default=0.0) - 10
        self.longest = max((len(self.pieces[i]) for i in usable), default=1)
        self.cuts = not any(SPACE in self.pieces[i].lstrip(SPACE) for i in usable)
        self.trie: dict = {}
        for i in usable:
            node = self.trie
            for c in self.pieces[i]:
                node = node.setdefault(c, {})
            if None not in node or scores[i] > node[None][1]:
                node[None] = (i, scores[i])
        self.wide = len(self.pieces) > 65_536
        #: what each id stands for in the text
        self.spelt = [bytes([int(p[1:-1], 16)]) if k == BYTE else b"" if k in (CONTROL, UNKNOWN) else p.replace(SPACE, " ").encode() for p, k in zip(self.pieces, self.kinds)]

    def characters(self, c: str) -> list[int]:
        """The ids of a character that no piece covers."""
        return [self.bytes.get(b, self.unk) for b in c.encode("utf-8", "replace")]

    def viterbi(self, text: Iterable[str]) -> Iterator[int]:
        """The ids of the best segmentation, committed as soon as no later character can change them.

        text: any stream of characters. Of equal sums the longer last piece wins.
        """
        keep = self.longest
        score: dict[int, float] = {0: 0.0}
        back: dict[int, tuple[int, int | str]] = {}
        open_at: list[tuple[int, dict]] = []
        done = end = 0
        for c in text:
            best, best_from, best_id = -np.inf, -1, None
            still = []
            open_at.append((end, self.trie))
            end += 1
            single = False
            for start, node in open_at:
                node = node.get(c)
                if node is None:
                    continue
                still.append((start, node))
                hit = node.get(None)
                if hit is not None:
                    single |= start == end - 1
                    if score[start] + hit[1] > best:
                        best, best_from, best_id = score[start] + hit[1], start, hit[0]
            if not single and score[end - 1] + self.penalty > best:
                best, best_from, best_id = score[end - 1] + self.penalty, end - 1, c
            open_at = still
            score[end], back[end] = best, (best_from, best_id)
            if not open_at or end - done >= 4 * keep:
                # paths that can go on end at `end` or where a piece has begun
                ends = {end, *(s for s, _ in open_at)}
                while len(ends) > 1:
                    last = max(ends)
                    ends.discard(last)
                    ends.add(back[last][0] if last > done else done)
                meet = ends.pop()
                if meet > done:
                    yield from self._path(back, done, meet)
                    floor = min([meet, *(s for s, _ in open_at)])
                    for k in [k for k in score if k < floor]:
                        del score[k]
                    for k in [k for k in back if k <= meet]:
                        del back[k]
                    done = meet
        yield from self._path(back, done, end)

    def _path(self, back: dict, begin: int, end: int) -> list[int]:
        out: list[int] = []
        while end > begin:
            end, what = back[end]
            out.extend(reversed(self.characters(what)) if isinstance(what, str) else (what,))
        return out[::-1]


class Encoder:
    """Encodes and decodes texts with one vocabulary; keeps a bounded table of cuts."""

    def __init__(self, model: bytes, table_size: int = TABLE_SIZE):
        self.vocabulary, self.table_size = Pieces(model), table_size
        self.kind = np.uint32 if self.vocabulary.wide else np.uint16
        self.table: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _cut(self, word: str) -> bytes:
        ids = self.older.get(word) or np.fromiter(self.vocabulary.viterbi(SPACE + word), self.kind).tobytes()
        if len(word) <= TABLE_CHARS:
            if len(self.table) >= self.table_size:
                self.older, self.table = self.table, {}
            self.table[word] = ids
        return ids

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, self.kind)
        if not self.vocabulary.cuts or SPACE in text:
            return np.fromiter(self.vocabulary.viterbi(SPACE + text.replace(" ", SPACE)), self.kind)
        words = text.split(" ")
        if "" in words:  # runs of spaces stay with the word after them
            joined, spaces = [], ""
            for w in words[:-1]:
                if w:
                    joined.append(spaces + w)
                    spaces = ""
                else:
                    spaces += SPACE
            words = [*joined, spaces + words[-1]]
        table, get = self.table, self._cut
        return np.frombuffer(b"".join([table[w] if w in table else get(w) for w in words]), self.kind)

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD."""
        text = b"".join(map(self.vocabulary.spelt.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text

    def decode_stream(self, ids: Iterable[int]) -> Iterator[str]:
        """The text of a stream of ids, as soon as its characters are whole."""
        decoder, first = codecs.getincrementaldecoder("utf-8")("replace"), True
        for i in ids:
            text = decoder.decode(self.vocabulary.spelt[i])
            if text:
                yield text[1:] if first and text[0] == " " else text
                first = False
        yield decoder.decode(b"", final=True)


def read_model(spark, path: str) -> bytes:
    """A model file by any path: the driver's own or one that Spark reads."""
    if "://" in path:
        return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
    with open(path, "rb") as f:
        return f.read()


def encoded(docs: DataFrame, model: bytes, check: bool = True) -> DataFrame:
    """docs(doc_id, text, ...) as (doc_id, n_ids, ids, round_trip): each whole text's ids, and whether they decode to it.

    A null or empty text has no ids. round_trip is false only where a text holds U+2581 itself (or check is off: null).
    Repeated rows and rows without doc_id each give their row; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        coder = _coder(shared.value)
        for batch in batches:
            column, row = batch.column(1), 0
            while row < len(column):
                ids, same, size, first = [], [], 0, row
                while row < len(column) and size < 1 << 20:
                    text = column[row].as_py() or ""
                    x = coder.encode(text)
                    ids.append(x)
                    same.append(coder.decode(x.tolist()) == text if check else None)
                    size += len(x)
                    row += 1
                cuts = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[first:row], pa.array(np.diff(cuts).astype(np.int64)), pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.concatenate(ids).astype(np.int32))), pa.array(same, pa.bool_())],
                    names=["doc_id", "n_ids", "ids", "round_trip"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_ids long, ids array<int>, round_trip boolean")


def decoded(rows: DataFrame, model: bytes) -> DataFrame:
    """rows(doc_id, ids) as (doc_id, text); null ids give a null text."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        coder = _coder(shared.value)
        for batch in batches:
            texts = [None if not x.is_valid else coder.decode(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, text string")


_CODERS: dict[int, Encoder] = {}


def _coder(model: bytes) -> Encoder:
    """One encoder a worker, so that its table outlives a task."""
    key = hash(model)
    if key not in _CODERS:
        _CODERS.clear()
        _CODERS[key] = Encoder(model)
    return _CODERS[key]
