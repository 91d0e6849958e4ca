"""The prefix trie of conversations, totals of subtrees by leaf-peeling message passing.

A node is a distinct sequence of first turns; it goes by its smallest conversation and its depth. Sequences are told apart by
128 bits: the exclusive or of what the turns' digests (SHA-256) and places hash to, so that a prefix's number follows from a running total.

Nodes hold a counter of the children that haven't reported and the exclusive or of their ids. In a round the nodes whose
counter is 0 leave, and send their subtree's totals, added up on the way, to their parents. A node that waits for one
last child knows it by what is left of the exclusive or, and waits for it directly: each round it takes over what that one has gathered
and waits for whom that one waits for, so a chain of n nodes takes log n rounds, and so does any tree. The root is the last.

No group is gathered: long conversations are cut into segments, copies of a conversation and the children of a node are
added up before the shuffle, and ids of equal conversations are hashed as a stream.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._cluster import shared_dir

#: Turns of a conversation whose prefixes are worked out together.
SEGMENT = 4096
#: What a word is, for counts of tokens.
WORD = r"[^\x20\x09-\x0D]+"
_KEY = ("depth", "fa", "fb")


def numbered(turns: DataFrame) -> DataFrame:
    """(conv_id, place, a, b, words) of turns(conv_id, turn, role, text): the place of each turn in its conversation, from 0.

    Turns go by turn (null first), then role, then text; a null role or text is empty; rows without conv_id are left out, repeated
    rows are turns of their own. a and b are 128 bits of the content's digest, words the count of the text's words.

    Rows are sorted in ranges, which part a long conversation; a range adds the turns of it in the ranges before.
    """
    rows = turns.where("conv_id is not null").select("conv_id", "turn", *[F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")])
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    digest = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    half = lambda k: F.conv(F.substring(digest, k, 16), 16, -10).cast("long")
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    cut = _kept(ranged.select("conv_id", F.monotonically_increasing_id().alias("at"), half(1).alias("a"), half(17).alias("b"), F.regexp_count("text", F.lit(WORD)).cast("long").alias("words")))
    cut = cut.withColumn("p", F.shiftright("at", 33))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("p").rowsBetween(Window.unboundedPreceding, -1))
    so_far = cut.groupBy("conv_id", "p").agg(F.count("*").alias("n")).withColumn("before", before).where("before > 0").select("conv_id", "p", "before")
    inside = F.row_number().over(Window.partitionBy("conv_id", "p").orderBy("at")) - 1
    told = cut.withColumn("inside", inside).join(F.broadcast(so_far), ["conv_id", "p"], "left")  # at most one row a range
    return told.select("conv_id", (F.col("inside") + F.coalesce("before", F.lit(0))).cast("long").alias("place"), "a", "b", "words")


def spliced(places: DataFrame, span: int, head: Column) -> tuple[DataFrame, DataFrame]:
    """numbered() turns of conversations that share openings, and the ids of all of them, also of those left without turns.

    The first `head` turns of each are replaced by as many first ones of the conversation with the next lower id divisible by span
    (all it has, if fewer; none, if it isn't there). head: a column over conv_id, below 4.
    """
    sizes = _kept(places.groupBy("conv_id").agg(F.count("*").alias("n")))
    lead = sizes.select(F.col("conv_id").alias("lead"), F.col("n").alias("given"))
    ids = sizes.select("conv_id", head.alias("h")).withColumn("lead", F.col("conv_id") - F.col("conv_id") % span)
    ids = ids.join(lead, "lead", "left").select("conv_id", "lead", "h", F.least("h", F.coalesce("given", F.lit(0))).alias("m"))
    first = places.where((F.col("conv_id") % span == 0) & (F.col("place") < 3)).withColumnRenamed("conv_id", "lead")
    taken = ids.join(first, "lead").where("place < h").select("conv_id", "place", "a", "b", "words")
    own = places.join(ids.select("conv_id", "h", "m"), "conv_id").where("place >= h").withColumn("place", F.col("place") - F.col("h") + F.col("m"))
    return taken.unionByName(own.select("conv_id", "place", "a", "b", "words")), sizes.select("conv_id")


def _kept(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again."""
    path = f"{shared_dir(df.sparkSession)}/trie-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _prefixes(places: DataFrame) -> DataFrame:
    """(conv_id, depth, fa, fb, pa, pb, words): the number of the first `depth` turns, and that of one turn fewer."""
    rows = places.withColumn("s", F.floor(F.col("place") / SEGMENT)).withColumn("ha", F.xxhash64("a", "b", "place")).withColumn("hb", F.xxhash64("place", "b", "a"))
    own, past = Window.partitionBy("conv_id", "s").orderBy("place"), Window.partitionBy("conv_id").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    whole = rows.groupBy("conv_id", "s").agg(F.bit_xor("ha").alias("xa"), F.bit_xor("hb").alias("xb"))
    long = whole.withColumn("xa", F.bit_xor("xa").over(past)).withColumn("xb", F.bit_xor("xb").over(past)).where("s > 0")
    told = rows.withColumn("ra", F.bit_xor("ha").over(own)).withColumn("rb", F.bit_xor("hb").over(own)).join(long, ["conv_id", "s"], "left")
    fa, fb = (F.col(f"r{c}").bitwiseXOR(F.coalesce(f"x{c}", F.lit(0))) for c in "ab")
    told = told.select("conv_id", (F.col("place") + 1).alias("depth"), fa.alias("fa"), fb.alias("fb"), "ha", "hb", "words")
    return told.select("conv_id", *_KEY, F.col("fa").bitwiseXOR(F.col("ha")).alias("pa"), F.col("fb").bitwiseXOR(F.col("hb")).alias("pb"), "words")


def _ends(last: DataFrame) -> DataFrame:
    """(depth, fa, fb, ends_sha256) of last(depth, fa, fb, conv_id): the digest of the ids of each key, ascending, comma-joined.

    Ids are put together range by range; then a key's pieces go through the hash one after the other, as SHA-256 must. So a key with
    very many ids is read by one task, by a thousandth of the rows and never as a whole.
    """

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, keys, ids = [], list(zip(*(batch.column(k).to_pylist() for k in range(3)))), batch.column(3).to_pylist()
            lo = 0
            for hi in range(1, len(ids) + 1):
                if hi == len(ids) or keys[hi] != keys[lo]:
                    rows.append((*keys[lo], ids[lo], ",".join(map(str, ids[lo:hi]))))
                    lo = hi
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=[*_KEY, "first", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = state = None
        for batch in batches:
            rows = []
            for *now, text in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2, 4))):
                if now != key:
                    if key:
                        rows.append((*key, state.hexdigest()))
                    key, state = now, hashlib.sha256(text.encode())
                else:
                    state.update(f",{text}".encode())
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=[*_KEY, "ends_sha256"])
        if key:
            yield pa.RecordBatch.from_arrays([*(pa.array([x], pa.int64()) for x in key), pa.array([state.hexdigest()])], names=[*_KEY, "ends_sha256"])

    kind = "depth long, fa long, fb long"
    rows = last.select(*_KEY, F.col("conv_id").cast("long").alias("conv_id"))
    pieces = rows.repartitionByRange(*_KEY, "conv_id").sortWithinPartitions(*_KEY, "conv_id").mapInArrow(joined, f"{kind}, first long, ids string")
    return pieces.repartition(*_KEY).sortWithinPartitions(*_KEY, "first").mapInArrow(hashed, f"{kind}, ends_sha256 string")


def _peeled(nodes: DataFrame) -> DataFrame:
    """nodes(conv_id, depth, parent_conv_id, n_children, x, leaves, saved, ...) with leaves and saved added up over subtrees.

    x: the exclusive or of the children's conv_id; leaves, saved: the node's own. In a round the nodes that are done leave, after
    those that wait for them have heard; then those that wait for a node that waits for one itself go on to that one.
    """
    other = [c for c in nodes.columns if c not in ("conv_id", "depth", "x", "leaves", "saved")]
    nothing, bound = F.lit(0).cast("long"), F.col("to_depth") >= 0  # who waits for nobody has the key (conv_id, -1), so that no key is common

    def bind(df: DataFrame) -> DataFrame:
        """Nodes that wait for one child, which they now know, wait for it directly and no longer for messages."""
        last = (F.col("waits") == 1) & ~bound
        return df.withColumn("to_conv", F.when(last, F.col("x")).otherwise(F.col("to_conv"))).withColumn("to_depth", F.when(last, F.col("depth") + 1).otherwise(F.col("to_depth")))

    def ahead(df: DataFrame, *more: Column) -> DataFrame:
        return df.select(F.col("conv_id").alias("to_conv"), F.col("depth").alias("to_depth"), F.col("leaves").alias("t_leaves"), F.col("saved").alias("t_saved"), *more)

    state, done = _kept(bind(nodes.withColumn("waits", F.col("n_children")).withColumn("to_conv", F.col("conv_id")).withColumn("to_depth", nothing - 1))), []
    while True:
        over, rest = state.where("waits = 0"), state.where("waits > 0")
        done.append(over)
        if rest.isEmpty():
            break
        mail = over.groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth"))
        mail = mail.agg(F.count("*").alias("k"), F.bit_xor("conv_id").alias("m_x"), F.sum("leaves").alias("m_leaves"), F.sum("saved").alias("m_saved"))
        told = rest.join(mail, ["conv_id", "depth"], "left").join(ahead(over), ["to_conv", "to_depth"], "left")
        got = lambda c: F.coalesce(F.when(bound, F.col(f"t_{c}")).otherwise(F.col(f"m_{c}")), nothing)
        waits = F.when(bound, F.when(F.col("t_leaves").isNotNull(), nothing).otherwise(nothing + 1)).otherwise(F.col("waits") - F.coalesce("k", nothing))
        told = told.select(
            "conv_id", "depth", *other, F.col("x").bitwiseXOR(F.when(bound, nothing).otherwise(F.coalesce("m_x", nothing))).alias("x"),
            (F.col("leaves") + got("leaves")).alias("leaves"), (F.col("saved") + got("saved")).alias("saved"), waits.alias("waits"), "to_conv", "to_depth",
        )
        state = _kept(bind(told))
        middle = state.where((F.col("waits") == 1) & bound)
        told = state.join(ahead(middle, F.col("to_conv").alias("t_conv"), F.col("to_depth").alias("t_depth")), ["to_conv", "to_depth"], "left")
        got = lambda c: F.when((F.col("waits") == 1) & F.col("t_conv").isNotNull(), F.col(f"t_{c}")).otherwise(nothing)
        state = _kept(
            told.select(
                "conv_id", "depth", *other, "x", (F.col("leaves") + got("leaves")).alias("leaves"), (F.col("saved") + got("saved")).alias("saved"), "waits",
                F.coalesce("t_conv", "to_conv").alias("to_conv"), F.coalesce("t_depth", "to_depth").alias("to_depth"),
            )
        )
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def trie_nodes(places: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of each node of the trie of numbered() turns.

    ids(conv_id): all conversations, if some have no turns; those end at the root. conv_id is the node's smallest conversation, n_convs
    how many start with its turns, n_leaves its subtree's nodes without children, itself included; saved_tokens adds up over the subtree, for
    each node, the words of its last turn times the conversations but one. ends_sha256 is over the ids of those that end there, ascending,
    comma-joined (of the empty string, where none does). Ids are whole numbers. Without conversations there are no nodes, not even a root.
    """
    rows = _kept(_prefixes(places.withColumn("conv_id", F.col("conv_id").cast("long"))))
    every = rows.select("conv_id").distinct() if ids is None else ids.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    every = _kept(every)
    root, many = every.agg(F.min("conv_id"), F.count("*")).first()
    zero = F.lit(0).cast("long")
    nodes = rows.groupBy(*_KEY).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("words").alias("words"), F.max("pa").alias("pa"), F.max("pb").alias("pb"))
    nodes = _kept(nodes)
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("fa").alias("pa"), F.col("fb").alias("pb"), F.col("conv_id").alias("parent_conv_id"))
    deep = nodes.where("depth > 1").join(above, ["depth", "pa", "pb"])
    told = deep.unionByName(nodes.where("depth = 1").withColumn("parent_conv_id", F.lit(root).cast("long")))
    told = _kept(told.select("conv_id", *_KEY, "parent_conv_id", "n_convs", ((F.col("n_convs") - 1) * F.col("words")).alias("saved")))
    top = every.agg(F.min("conv_id").alias("conv_id")).where("conv_id is not null")
    top = top.select("conv_id", zero.alias("depth"), zero.alias("fa"), zero.alias("fb"), F.lit(None).cast("long").alias("parent_conv_id"), F.lit(many).cast("long").alias("n_convs"), zero.alias("saved"))
    told = told.unionByName(top)
    below = told.where("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"), F.bit_xor("conv_id").alias("x"))
    full = told.drop("fa", "fb").join(below, ["conv_id", "depth"], "left").fillna(0, ["n_children", "x"])
    done = _peeled(full.withColumn("leaves", (F.col("n_children") == 0).cast("long")))

    last = rows.groupBy("conv_id").agg(F.max(F.struct(*_KEY)).alias("k")).select("conv_id", "k.*")
    without = every.join(last.select("conv_id"), "conv_id", "left_anti").select("conv_id", zero.alias("depth"), zero.alias("fa"), zero.alias("fb"))
    ends = told.select("conv_id", *_KEY).join(_ends(last.unionByName(without)), list(_KEY)).select("conv_id", "depth", "ends_sha256")
    return done.join(ends, ["conv_id", "depth"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def conversation_trie(turns: DataFrame) -> DataFrame:
    """trie_nodes() of turns(conv_id, turn, role, text), ordered as numbered() says. Other columns are ignored, whatever their names."""
    return trie_nodes(numbered(turns))
