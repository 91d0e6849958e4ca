"""Language-model scores of texts: a causal self-attention model over subword ids, with corpus word counts.

A text is its words, lower-cased in A-Z, and one end. Its subword ids come from a public vocabulary; every word begins an id.
The model (see attention) is learnt from the whole of every training text: classes of ids, the table of the last id, and the
attention weights. Texts are dealt into blocks by a hash of their rows and coded once, in the order of that hash; blocks are kept.
Weights are trained on each block from the same start, and averaged by the blocks' ids, so how many tasks there are, or what they
lose and do again, changes no score.

From the attention model's classes of the next id, a word is spelt out in ids (and has to end after them), or, where the
training texts know it, drawn as a whole: by the class of its first id, and its share of the words that begin with ids of that class. Both are
distributions over words, and so is their mixture; the first one's part follows from the share of training words that
occur once (Good and Turing's estimate of how many words are new). Windows overlap: each id is scored once, with at least CONTEXT ids before it where there are any.

Word counts are exact and cover the corpus: blocks of texts exchange the counts of their words (see _exchange).
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import attention as net
from ._bytes import Words, trim, word_pieces
from ._cluster import parts, saved, text_bytes
from ._exchange import BLOCK_BYTES, BUCKET_KEYS, counted, dealt, distinct, entry_rows, joined, totals, unpacked

#: Blocks whose weights are averaged together.
FAN_IN = 64
#: New words for each training word that occurs once: over 1, as copies of documents hide words that occur once otherwise.
NEW_PER_ONCE = 1.5
#: Least and largest part of words spelt out in the mixture.
NEW_WORDS = 0.005, 0.5
#: Fixed value: how the public vocabulary's authors cut text before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONG_WORD = 256


class Subwords:
    """Ids of whole texts by a byte-level vocabulary, given as its ranks file."""

    def __init__(self, ranks_file: bytes):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks_file.splitlines()) if a}
        self.coder = tiktoken.Encoding("subwords", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.begins = np.zeros(net.END + 1, bool)
        for piece, i in ranks.items():
            self.begins[i] = piece[:1] == b" "
        self.begins[net.END] = True

    def each(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words, one word after the other, and how many each has. A word is coded with a space before it,
        by itself, and exactly its first id begins a word."""
        ids, many = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for a in range(0, len(words), 4096):
            part = words[a : a + 4096]
            text = b" ".join(part).decode("utf-8", "replace")
            if max(map(len, part)) <= LONG_WORD and len(text.split()) == len(part):  # no other white space inside
                found = np.array(self.coder.encode_ordinary(" " + text), np.int64)
                first = np.flatnonzero(self.begins[found])
                if len(first) == len(part):
                    ids.append(found)
                    many.append(np.diff(first, append=len(found)))
                    continue
            found = [self._word(w) for w in part]
            ids.append(np.array([i for x in found for i in x], np.int64))
            many.append(np.array([len(x) for x in found], np.int64))
        return np.concatenate(ids), np.concatenate(many)

    def _word(self, word: bytes) -> list[int]:
        text = word.decode("utf-8", "replace")
        one = self.coder.encode_ordinary(" " + text[:LONG_WORD])
        for k in range(LONG_WORD, len(text), LONG_WORD):
            one += self.coder.encode_ordinary(text[k : k + LONG_WORD])
        if int(self.begins[one].sum()) != 1 or not self.begins[one[0]]:
            # an id inside begins with a space: single bytes, which don't
            one = [self.coder.encode_single_token(b" "), *(self.coder.encode_single_token(bytes([b])) for b in text.encode())]
        return one


def coded(cut: list[tuple[Words, np.ndarray]], coder: Subwords) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For pieces with their words' hashes: the ids of their distinct words, how many each has, and each word's index in them;
    the distinct hashes in ascending order, and each word's index in those."""
    h = np.concatenate([np.zeros(0, np.uint64), *(x for _, x in cut)])
    uniq, inverse = distinct(h)
    first = np.empty(len(uniq), np.int64)
    first[inverse[::-1]] = np.arange(len(h))[::-1]
    first.sort()
    spelt: list[bytes] = []
    done = 0
    for words, x in cut:
        data = words.buf.tobytes()
        at = first[np.searchsorted(first, done) : np.searchsorted(first, done + len(x))] - done
        spelt += [data[i:j] for i, j in zip(words.starts[at].tolist(), words.ends[at].tolist())]
        done += len(x)
    ids, many = coder.each(spelt)
    place = np.empty(len(uniq), np.int64)  # of the distinct hashes among the words spelt
    place[inverse[first]] = np.arange(len(first))
    return ids, many, place[inverse], uniq, inverse


_CODERS: dict[int, Subwords] = {}


def _coder(ranks_file: bytes) -> Subwords:
    key = hash(ranks_file)
    if key not in _CODERS:
        _CODERS[key] = Subwords(ranks_file)
    return _CODERS[key]


def words_of(text: bytes) -> list[bytes]:
    """The words `[^\\x20\\x09-\\x0D]+` of a text, lower-cased in A-Z."""
    return text.lower().split()


def held_out() -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 1, F.lit(False))


def spelt_out(spelt: np.ndarray, each: np.ndarray, index: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Of a piece whose words are index in coded()'s: its texts' ids, each text closed by an end, and how many each text has."""
    begin = np.cumsum(each) - each
    many, text = each[index], words.rows()
    ids = spelt[np.arange(many.sum()) + np.repeat(begin[index] - np.cumsum(many) + many, many)]
    sizes = np.bincount(text, many, minlength=len(words.counts)).astype(np.int64) + 1
    out = np.full(sizes.sum(), net.END)
    out[np.arange(len(ids)) + np.repeat(text, many)] = ids
    return out, sizes


def before(ids: np.ndarray) -> np.ndarray:
    """The input that stands before each of texts' closed ids: the id before it, or an end before a text's first."""
    return np.concatenate((np.full(min(len(ids), 1), net.END), ids[:-1]))


def coded_blocks(rows: DataFrame, ranks: bytes, blocks: int, buckets: int) -> DataFrame:
    """rows(doc_id, text, held_out) in blocks, kept: one row a block with, in one order, its rows' doc_id, held_out and number of ids,
    their ids, each word's index in the block's distinct words, entries of the counts of those in what is learnt, and counts of the ids there."""
    shared = rows.sparkSession.sparkContext.broadcast(ranks)
    kind = dict(rows.dtypes)["doc_id"]

    def code(left: pa.Table) -> pa.Table:
        left = left.sort_by("bh")
        coder = _coder(shared.value)
        cut = [(w, w.hashes()) for _, _, w in word_pieces(left.column("text"))]
        spelt, each, index, uniq, inverse = coded(cut, coder)
        ids, sizes, done = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        for words, h in cut:
            for to, x in zip((ids, sizes), spelt_out(spelt, each, index[done : done + len(h)], words)):
                to.append(x)
            done += len(h)
        ids, sizes = np.concatenate(ids), np.concatenate(sizes)
        held = left.column("held_out").to_numpy(zero_copy_only=False)
        learnt = np.repeat(~held, np.concatenate([w.counts for w, _ in cut]))
        block = left.column("block")[0].as_py()
        rows = entry_rows(block, uniq, np.bincount(inverse[learnt], minlength=len(uniq)).astype(np.uint32), buckets, False)
        seen = np.bincount(ids[np.repeat(~held, sizes)], minlength=net.END + 1)
        some = np.flatnonzero(seen)
        one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        blob = lambda x, as_: pa.array([x.astype(as_).tobytes()], pa.binary())
        small = zstandard.ZstdCompressor(level=1)
        out = pa.table(
            {
                "block": pa.array([block], pa.int32()),
                "doc_id": one(left.column("doc_id").combine_chunks()),
                "held_out": one(left.column("held_out").combine_chunks()),
                "sizes": blob(sizes, "<i8"),
                "ids": pa.array([small.compress(ids.astype("<u2").tobytes())], pa.binary()),
                "words": pa.array([small.compress(inverse.astype("<u4").tobytes())], pa.binary()),
                "entries": one(pa.StructArray.from_arrays(rows.columns[1:], names=rows.schema.names[1:])),
                "seen_ids": blob(some, "<u2"),
                "seen": blob(seen[some], "<i8"),
            }
        )
        del cut, rows
        trim()
        return out

    schema = f"block int, doc_id array<{kind}>, held_out array<boolean>, sizes binary, ids binary, words binary, entries array<struct<bucket int, keys binary, counts binary>>, seen_ids binary, seen binary"
    dealt_rows = dealt(rows, blocks, "doc_id", "text", "held_out").select("block", "bh", "doc_id", "text", "held_out")
    return saved(dealt_rows.groupBy("block").applyInArrow(code, schema))


def _wide(x: pa.BinaryScalar, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x.as_buffer()), kind)


_PARTS = ("block", "ids", "sizes", "held_out")


def _learnt(batch: pa.RecordBatch):
    """(block, ids, bounds) of each block's training texts; batch: the columns of _PARTS."""
    for k in range(batch.num_rows):
        ids, sizes = _wide(batch.column(1)[k], "<u2"), np.frombuffer(batch.column(2)[k].as_buffer(), "<i8")
        mine = ~batch.column(3)[k].values.to_numpy(zero_copy_only=False)
        yield batch.column(0)[k].as_py(), ids[np.repeat(mine, sizes)].astype(np.int64), np.concatenate(([0], np.cumsum(sizes[mine])))


def _summed(df: DataFrame, run, size: int) -> np.ndarray:
    """The sum of the counts by cell that run() gives for each partition of df; at most `size` rows come back, whatever df's size."""
    rows = df.mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size)
    out[rows.column("cell").to_numpy()] = rows.column("n").to_numpy()
    return out


def _cells(count: np.ndarray) -> pa.RecordBatch:
    some = np.flatnonzero(count)
    return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(count[some])], names=["cell", "n"])


def fitted(coded: DataFrame, begins: np.ndarray) -> tuple[net.Vocabulary, np.ndarray, dict[str, np.ndarray], int]:
    """The model of coded_blocks()' training texts: classes, table of the last id, attention weights; and the number of texts."""
    sc = coded.sparkSession.sparkContext

    def seen(batches):
        count = np.zeros(net.END + 1, np.int64)
        for batch in batches:
            for ids, n in zip(*batch.columns):
                count[np.frombuffer(ids.as_buffer(), "<u2")] += np.frombuffer(n.as_buffer(), "<i8")
        yield _cells(count)

    counts = _summed(coded.select("seen_ids", "seen"), seen, net.END + 1)
    texts = int(counts[net.END])
    single = np.full(net.END + 1, -1)
    single[net.by_frequency(counts)[: net.SINGLES]] = np.arange(net.SINGLES)
    singles = sc.broadcast(single)

    def nearby(batches):
        count = np.zeros((net.END + 1) * net.SINGLES, np.int64)
        for batch in batches:
            for _, ids, _ in _learnt(batch):
                count += np.bincount(ids * net.SINGLES + net.last_frequent(ids, singles.value), minlength=len(count))
        yield _cells(count)

    near = _summed(coded.select(*_PARTS), nearby, (net.END + 1) * net.SINGLES).reshape(-1, net.SINGLES)
    near[:, 0] = 0  # nothing frequent before
    vocabulary = net.Vocabulary.of(counts, begins, near)
    prior = np.bincount(vocabulary.group, counts + 0.01, minlength=net.CLASSES)
    shared = sc.broadcast(vocabulary)

    def pairs(batches):
        v = shared.value
        count = np.zeros(net.RANKS * net.CLASSES, np.int64)
        for batch in batches:
            for _, then, _ in _learnt(batch):
                count += np.bincount(v.rank[before(then)].astype(np.int64) * net.CLASSES + v.group[then], minlength=len(count))
        yield _cells(count)

    skip = net.skip_table(_summed(coded.select(*_PARTS), pairs, net.RANKS * net.CLASSES).reshape(net.RANKS, net.CLASSES), prior / prior.sum())
    model = sc.broadcast((vocabulary, skip))

    def learn(batches):
        v, skip = model.value
        for batch in batches:
            for block, then, bounds in _learnt(batch):
                if len(then):
                    w = net.train(net.fresh_weights(), skip, v.rank[before(then)], bounds, v.group[then])
                    yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([len(then)]), pa.array([net.packed(w).tolist()], pa.list_(pa.float32()))], names=["block", "n", "w"])
                    trim()

    def mean(table: pa.Table) -> tuple[int, np.ndarray]:
        table = table.sort_by("block")
        n = table.column("n").to_numpy()
        return int(n.sum()), sum(m * np.asarray(w.values, np.float64) for m, w in zip(n, table.column("w"))) / n.sum()

    def averaged(table: pa.Table) -> pa.Table:
        n, w = mean(table)
        return pa.table({"block": pa.array([table.column("block")[0].as_py() // FAN_IN], pa.int32()), "n": pa.array([n]), "w": pa.array([w.astype(np.float32).tolist()], pa.list_(pa.float32()))})

    learnt = coded.select(*_PARTS).mapInArrow(learn, "block int, n long, w array<float>")
    many = (coded.agg(F.max("block")).first()[0] or 0) + 1
    while many > FAN_IN:
        learnt = learnt.groupBy(F.floor(F.col("block") / FAN_IN)).applyInArrow(averaged, "block int, n long, w array<float>")
        many = parts(many, FAN_IN)
    got = learnt.toArrow()
    return vocabulary, skip, net.unpacked(mean(got)[1]) if got.num_rows else net.fresh_weights(), texts


def scored(docs: DataFrame, ranks: bytes) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row of docs(doc_id, text).

    Rows whose crc32(doc_id as text) mod 5 isn't 1 are learnt from. Tokens are the words and one end. base_score is the sum over tokens of
    log10((c + 0.5) / (N + 0.5 * (V + 1))): c the token's count, N that of all, V of distinct ones, in training tokens.
    score is the model's log10 probability of the text. A null or empty text has the end alone; a row without doc_id is
    learnt from; repeated rows each count and give their row; without training texts N and V are 0. Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), held_out().alias("held_out"))
    size = text_bytes(rows)
    blocks, buckets = parts(size, BLOCK_BYTES), parts(size / 40, BUCKET_KEYS)
    begins = _coder(ranks).begins
    coded = coded_blocks(rows, ranks, blocks, buckets)
    vocabulary, skip, weights, texts = fitted(coded, begins)
    model = spark.sparkContext.broadcast((begins, vocabulary, skip, weights))
    entries = coded.select("block", F.explode("entries").alias("e")).select("block", "e.bucket", "e.keys", "e.counts")
    back = totals(entries, False, "u4", 2**53, "u8")

    def sizes(table: pa.Table) -> pa.Table:
        keys = unpacked(table.column("keys").to_pylist(), np.uint64)
        n = counted(table.column("counts").to_pylist(), "u4")
        uniq, inverse = distinct(keys)
        each = np.bincount(inverse, weights=n, minlength=len(uniq))
        return pa.table({"n": pa.array([int(each.sum())]), "v": pa.array([int((each > 0).sum())]), "once": pa.array([int((each == 1).sum())])})

    sums = entries.groupBy("bucket").applyInArrow(sizes, "n long, v long, once long").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "v", "once")])
    told = spark.range(blocks).select(F.col("id").cast("int").alias("block")).join(F.broadcast(sums))  # one row
    right = back.select("block", "bucket", "counts", *[F.lit(0).cast("long").alias(c) for c in ("n", "v", "once")]).unionByName(told.select("block", F.lit(-1).alias("bucket"), F.lit(None).cast("binary").alias("counts"), "n", "v", "once"))

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return empty
        begins, v, skip, weights = model.value
        head = right.column("bucket").to_numpy() < 0
        n_all = int(np.asarray(right.column("n"))[head].sum()) + texts
        n_kinds = int(np.asarray(right.column("v"))[head].sum()) + (texts > 0)
        new = float(np.clip(NEW_PER_ONCE * np.asarray(right.column("once"))[head].sum() / max(n_all, 1), *NEW_WORDS))
        # what follows each input: the texts' ids, each text closed by an end
        then, cuts = _wide(left.column("ids")[0], "<u2").astype(np.int64), np.concatenate(([0], np.cumsum(np.frombuffer(left.column("sizes")[0].as_buffer(), "<i8"))))
        count = joined(right.filter(pa.array(~head)), "u8").astype(np.float64)[_wide(left.column("words")[0], "<u4")]
        # the words and ends of texts in order, and how often each was learnt
        units = np.flatnonzero(begins[then])
        is_end = then[units] == net.END
        of = np.cumsum(is_end) - is_end
        per = np.bincount(of, minlength=len(cuts) - 1)
        mine = np.full(len(units), float(texts))
        mine[~is_end] = count
        base = np.bincount(of, np.log10(mine + 0.5), minlength=len(per)) - per * np.log10(n_all + 0.5 * (n_kinds + 1))
        known = np.bincount(of, mine > 0, minlength=len(per)).astype(np.int64)
        logp, ends = net.scores(weights, skip, v.rank[before(then)], cuts, v.group[then], v.starts)
        p = logp.astype(np.float64) + v.share[then]
        # that a word ends belongs to it, not to what begins next; a text's first word needs nothing to end before it
        p[units] -= ends[units]
        whole = (logp[units] - ends[units]).astype(np.float64) - np.log(np.maximum(v.mass[v.group[then[units]]], 1))
        word = np.add.reduceat(p, units)
        after = np.flatnonzero(of[1:] == of[:-1])
        word[after] += ends[units[after + 1]]
        known_part = np.where(mine > 0, np.log(np.maximum((1 - new) * mine, 1e-300)) + whole, -np.inf)
        score = np.bincount(of, np.logaddexp(np.log(new) + word, known_part), minlength=len(per)) / np.log(10)
        values = lambda name: left.column(name).combine_chunks().flatten()
        out = pa.table({"doc_id": values("doc_id"), "held_out": values("held_out"), "n_tokens": pa.array(per), "n_known": pa.array(known), "train_tokens": pa.array(np.full(len(per), n_all)), "base_score": pa.array(base), "score": pa.array(score)})
        trim()
        return out

    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    empty = spark.createDataFrame([], schema).toArrow()
    left = coded.select("block", "doc_id", "held_out", "sizes", "ids", "words")
    return left.groupBy("block").cogroup(right.groupBy("block")).applyInArrow(finish, schema)
