"""N-gram Jaccard self-join of documents.

Rare-first prefix filtering (Bayardo and others, 2007; Xiao and others, PPJoin+, 2008) over word shingles:
each set is put in one global order, rarest shingle first; two sets that reach the threshold share a shingle within
their prefixes. Candidates come from an equi-join on prefix shingles under length and positional filters; a suffix
filter compares how the sets spread over fixed ranges of the token space; pairs left are verified once on the whole sets.

Scale: documents with the same set are one class, and only one of them goes on. Shingle frequencies come from a
blockwise exchange (see _exchange). Shingles that only one class has cannot join and are dropped from prefixes, and
classes with too few shared shingles leave early. Where one shingle is in the prefixes of many classes, the classes
are first compared with one centre each, the one whose shingles are the most shared; what those links connect needs no more comparing, so only classes of different
components are then paired, all of them. Every entry of a shingle carries its frequency, so both sides of a join agree on
how many parts of HOT entries it is split into: no key gets more rows than that, and pairs of parts meet one by one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import binary_rows, mix, shingles, sorted_sets, trim, word_pieces
from ._cluster import components, free_shuffles, parts, saved
from ._exchange import BLOCK_BYTES, BUCKET_KEYS, ENTRY, dealt, distinct, entry_rows, joined, place, totals

RANGES = 16
#: Entries of one shingle that are handled together.
HOT = 1024
LIVE = "fp long, n int, weight long, prefix array<long>, at array<int>, freq array<int>, spread array<int>, items binary"


def required(n: int, m: int, percent: int) -> int:
    """The least intersection of sets of n and m items with 100 * intersection >= percent * union."""
    return -(-percent * (n + m) // (100 + percent))


def _fingerprints(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(values))))
    return mix(sums[bounds[1:]] - sums[bounds[:-1]] + np.diff(bounds).astype(np.uint64)).view(np.int64)


def shingle_classes(docs: DataFrame, size: int = 5) -> DataFrame:
    """(doc_id, bh, n_bytes, n_shingles, fp): the size of each document's shingle set and its fingerprint."""
    rows = docs.select("doc_id", "text").select("doc_id", "text", F.xxhash64("doc_id", "text").alias("bh"))

    def run(batches):
        for batch in batches:
            text = batch.column(1)
            for a, b, words in word_pieces(text):
                values, bounds = sorted_sets(*shingles(words, size), b - a)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a:b], batch.column(2)[a:b], pa.array(np.diff(words.offsets)), pa.array(np.diff(bounds).astype(np.int64)), pa.array(_fingerprints(values, bounds))],
                    names=["doc_id", "bh", "n_bytes", "n_shingles", "fp"],
                )

    return rows.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, bh long, n_bytes long, n_shingles long, fp long")


def _block_sets(text: pa.Table, chosen: pa.Table, size: int):
    """The sets of a block's chosen rows: flat values, bounds, fingerprints."""
    want = np.unique(chosen.column("bh").to_numpy())
    bh = text.column("bh").to_numpy()
    rows = np.unique(bh, return_index=True)[1]
    rows = np.sort(rows[np.isin(bh[rows], want)])
    values, sizes = [], []
    for a, b, words in word_pieces(text.column("text").combine_chunks().take(pa.array(rows))):
        v, bounds = sorted_sets(*shingles(words, size), b - a)
        values.append(v)
        sizes.append(np.diff(bounds))
    values = np.concatenate(values) if values else np.zeros(0, np.uint64)
    bounds = np.concatenate(([0], np.cumsum(np.concatenate(sizes)))) if sizes else np.zeros(1, np.int64)
    return values, bounds.astype(np.int64), _fingerprints(values, bounds.astype(np.int64))


def _live_classes(docs: DataFrame, classes: DataFrame, size: int, percent: int) -> DataFrame:
    """Classes that may link: their prefix shingles that others have too (with positions), spread and sets."""
    reps = classes.where("n_shingles > 0").groupBy("fp").agg(F.min("bh").alias("bh"), F.max("n_shingles").alias("n"))
    n_bytes, n_items = classes.agg(F.sum("n_bytes"), F.sum("n_shingles")).first()
    blocks, buckets = parts(n_bytes or 0, BLOCK_BYTES), parts(n_items or 0, BUCKET_KEYS)
    text = dealt(docs.select("doc_id", "text"), blocks, "doc_id", "text").select("block", "bh", "text")
    chosen = reps.select(F.pmod("bh", F.lit(blocks)).cast("int").alias("block"), "bh")

    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        values, _, _ = _block_sets(left, right, size) if left.num_rows and right.num_rows else (np.zeros(0, np.uint64), None, None)
        at, n = np.unique(place(values, buckets, True), return_counts=True)
        trim()
        block = (left if left.num_rows else right).column("block")[0].as_py()
        return pa.Table.from_batches([entry_rows(block, at, n.astype(np.uint32), buckets, True)])

    entries = text.groupBy("block").cogroup(chosen.groupBy("block")).applyInArrow(send, ENTRY)
    back = totals(entries, True, "u4", 2**31 - 1)
    right = chosen.select("block", F.lit(-1).alias("bucket"), "bh", F.lit(None).cast("binary").alias("counts")).unionByName(back.select("block", "bucket", F.lit(None).cast("long").alias("bh"), "counts"))

    def prefixes(left: pa.Table, right: pa.Table) -> pa.Table:
        head = np.asarray(right.column("bucket").to_numpy()) < 0
        values, bounds, fps = _block_sets(left, right.filter(pa.array(head)), size) if left.num_rows and head.any() else (np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(0, np.int64))
        at = place(values, buckets, True)
        many = joined(right.filter(pa.array(~head)), "u4")[distinct(at)[1]] if len(at) else np.zeros(0, np.uint32)
        n = np.diff(bounds)
        rows = np.repeat(np.arange(len(n)), n)
        least = -(-percent * n // 100)
        live = (np.bincount(rows[many > 1], minlength=len(n)) >= least) & (n > 0)
        order = np.lexsort((values, many, rows))  # rarest first; the fingerprint settles ties for all sets alike
        pos = np.arange(len(order)) - bounds[rows]  # rows[order] == rows: sets stay together
        keep = (pos <= (n - least)[rows]) & (many[order] > 1) & live[rows]
        live &= np.bincount(rows[keep], minlength=len(n)) > 0
        keep &= live[rows]
        ids = np.flatnonzero(live)
        counts = np.bincount(rows[keep], minlength=len(n))[ids]
        cuts = pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32))
        inside = live[rows]
        part = (values[inside] >> np.uint64(60)).astype(np.int64)
        new_row = np.cumsum(live)[rows[inside]] - 1
        spread = np.bincount(new_row * RANGES + part, minlength=len(ids) * RANGES).astype(np.int32)
        sets = np.concatenate(([0], np.cumsum(n[ids])))
        trim()
        return pa.table(
            {
                "fp": pa.array(fps[ids]),
                "n": pa.array(n[ids].astype(np.int32)),
                "weight": pa.array(np.bincount(rows, weights=many, minlength=len(n))[ids].astype(np.int64)),
                "prefix": pa.ListArray.from_arrays(cuts, pa.array(values[order][keep].view(np.int64))),
                "at": pa.ListArray.from_arrays(cuts, pa.array(pos[keep].astype(np.int32))),
                "freq": pa.ListArray.from_arrays(cuts, pa.array(many[order][keep].astype(np.int32))),
                "spread": pa.ListArray.from_arrays(pa.array((np.arange(len(ids) + 1) * RANGES).astype(np.int32)), pa.array(spread)),
                "items": binary_rows(values[inside], sets),
            }
        )

    return text.groupBy("block").cogroup(right.groupBy("block")).applyInArrow(prefixes, LIVE)


def _may_reach(percent: int) -> str:
    """Length and positional filters on one shared prefix shingle; the first one that a true pair shares passes."""
    return f"(100 + {percent}) * least(a_n - a_at, b_n - b_at) >= {percent} * (a_n + b_n) and 100 * least(a_n, b_n) >= {percent} * greatest(a_n, b_n)"


def _verified(pairs: DataFrame, live: DataFrame, percent: int) -> DataFrame:
    """Of distinct pairs (a, b), those that link, by the suffix filter and then the whole sets."""
    meta = live.select("fp", "n", "spread")
    most = F.aggregate(F.zip_with("a_spread", "b_spread", lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)
    near = (
        pairs.join(meta.select(F.col("fp").alias("a"), F.col("n").alias("a_n"), F.col("spread").alias("a_spread")), "a")
        .join(meta.select(F.col("fp").alias("b"), F.col("n").alias("b_n"), F.col("spread").alias("b_spread")), "b")
        .where((100 + percent) * most >= percent * (F.col("a_n") + F.col("b_n")))
        .select("a", "b")
    )
    items = live.select("fp", "items")
    both = near.join(items.select(F.col("fp").alias("a"), F.col("items").alias("a_items")), "a").join(items.select(F.col("fp").alias("b"), F.col("items").alias("b_items")), "b")

    def check(batches):
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3)):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                z = np.sort(np.concatenate((p, q)), kind="stable")
                shared = int((z[1:] == z[:-1]).sum())
                ok.append(100 * shared >= percent * (len(p) + len(q) - shared))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return both.select("a", "b", "a_items", "b_items").mapInArrow(check, "a long, b long")


def _pairs(rows: DataFrame, percent: int) -> DataFrame:
    return rows.where(_may_reach(percent)).select(F.least("a_fp", "b_fp").alias("a"), F.greatest("a_fp", "b_fp").alias("b")).distinct()


def _parts_of(freq: str = "freq") -> F.Column:
    """How many parts the entries of a shingle are split into."""
    return F.ceil(F.col(freq) / F.lit(HOT)).cast("int")


def _for_parts(rows: DataFrame, *names: str) -> DataFrame:
    """rows once for each value of the named columns, which count the parts of their shingle."""
    for name in names:
        rows = rows.withColumn(name, F.explode(F.sequence(F.lit(0), _parts_of() - 1)))
    return rows


def class_links(live: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) between classes, enough to connect all that the join's links connect."""
    spark = live.sparkSession
    tokens = live.select("fp", "n", "weight", F.explode(F.arrays_zip("prefix", "at", "freq")).alias("x")).select("fp", "n", "weight", F.col("x.prefix").alias("token"), F.col("x.at").alias("at"), F.col("x.freq").alias("freq"))
    tokens = tokens.withColumn("part", F.pmod(F.xxhash64("fp"), _parts_of()).cast("int"))
    centre = tokens.groupBy("token").agg(F.max(F.struct("weight", "fp", "n", "at")).alias("c"), F.max("freq").alias("freq"), F.count("*").alias("many")).where("many > 1")
    near = tokens.join(_for_parts(centre.select("token", "c", "freq"), "part").drop("freq"), ["token", "part"]).where("fp <> c.fp")
    near = near.select(F.col("c.fp").alias("a_fp"), F.col("c.n").alias("a_n"), F.col("c.at").alias("a_at"), F.col("fp").alias("b_fp"), F.col("n").alias("b_n"), F.col("at").alias("b_at"))
    tried = saved(_pairs(near, percent))
    links = saved(_verified(tried, live, percent))
    comps = components(links)
    told = tokens.join(comps.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    # of shingles whose entries are still of several components, the one with the most of them
    many = told.groupBy("token", "component").agg(F.count("*").alias("n"), F.max("freq").alias("freq"))
    main = many.groupBy("token").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.count("*").alias("kinds"), F.max("freq").alias("freq")).where("kinds > 1")
    told = saved(told.join(_for_parts(main.select("token", "main", "freq"), "part").drop("freq"), ["token", "part"]))
    told = told.withColumn("is_main", F.col("component") == F.col("main"))
    side = lambda p, df: df.select("token", "i", "j", *[F.col(c).alias(f"{p}_{c}") for c in ("fp", "n", "at", "component", "is_main")])
    left, right = _for_parts(told.where("not is_main").withColumn("i", F.col("part")), "j"), _for_parts(told.withColumn("j", F.col("part")), "i")
    cross = side("a", left).join(side("b", right), ["token", "i", "j"]).where("a_component <> b_component and (b_is_main or a_fp < b_fp)")
    rest = saved(_pairs(cross, percent).join(tried, ["a", "b"], "left_anti"))
    free_shuffles(spark)
    return saved(links.unionByName(_verified(rest, live, percent)))


def jaccard_components(docs: DataFrame, size: int = 5, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of docs(doc_id, text).

    Words are `[^\\x20\\x09-\\x0D]+`, lower-cased in A-Z. A document's set holds its distinct shingles of `size` words;
    with fewer words the whole sequence is its one shingle. Two documents link when 100 * intersection >= percent * union.
    component_id is the smallest doc_id that links reach. A null or empty text, or one of white space only, has an
    empty set, links with nothing and is its own component. Rows are told apart even where they share a doc_id; a row
    without doc_id links like others, and its component_id is null where no member has a doc_id. Other columns are ignored.
    """
    classes = saved(shingle_classes(docs, size))
    live = saved(_live_classes(docs, classes, size, percent))
    free_shuffles(docs.sparkSession)
    comps = components(class_links(live, percent))
    reps = classes.where("n_shingles > 0").groupBy("fp").agg(F.min("doc_id").alias("first"))
    told = reps.join(comps.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = told.groupBy("component").agg(F.min("first").alias("component_id"))
    by_fp = told.join(least, "component").select("fp", "component_id")
    full = classes.where("n_shingles > 0").join(by_fp, "fp").select("doc_id", "n_shingles", "component_id")
    none = classes.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return full.unionByName(none)


def deduplicated(docs: DataFrame, size: int = 5, percent: int = 75) -> DataFrame:
    """docs with one document of each component kept, the one with the smallest doc_id; of equal rows with that id, one.

    Rows without doc_id cannot be named and are kept. See jaccard_components().
    """
    comp = saved(jaccard_components(docs.select("doc_id", "text"), size, percent))
    named = docs.where("doc_id is not null").join(comp.where("component_id = doc_id").select("doc_id").distinct(), "doc_id", "left_semi")
    many = saved(comp.where("component_id = doc_id").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if not many.isEmpty():  # only rows that share a doc_id are compared whole
        named = named.join(many, "doc_id", "left_anti").unionByName(named.join(many, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]))
    return named.unionByName(docs.where("doc_id is null"))
