"""A graph whose nodes lie in parts, for clustering in rounds: parts tell each other only what their borders need.

A node lies in the part that its hash names, with its edges. What doesn't change while a level is gone over (ids, strengths,
edges, which part hears of which node) is packed once, a row a part. A round is two exchanges of packed rows:

1. Every part moves its nodes by the labels and group sizes it knows. It tells other parts the labels of the nodes that
   border on them, and the home of each group (again by hash) its share of the group's size and which parts ask for it.
2. Homes add up the sizes and answer each part that asked.

ROUNDS rounds make one job, and only its end is written, so lineage stays short and a lost executor costs no more than the
exchanges it held. A round in which no node wants to move changes nothing, so rounds past the last one do no harm.

A node of HUB edges or more doesn't hold those to plain nodes: its neighbours' parts send it their weight summed by group, a
row a part and group. So neither a hub nor a community of most nodes makes one part larger than others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._scale import kept

#: Directed edges a part holds on average.
PART_EDGES = 2**20
#: From so many edges on a node's edges are summed up where its neighbours are.
HUB = 2**16
#: Rounds of one job.
ROUNDS = 4

PACKED = "part int, ids binary, k binary, c binary, src binary, dst binary, w binary, far binary, tell binary, hub binary"
SENT = "part int, kind int, a binary, b binary, d binary"
#: Kinds of rows: a part's own labels; labels of nodes beyond its border; shares of group sizes; who asks for a size; sizes;
#: weights of a hub by group; that a node wanted to move.
OWN, FAR, SHARE, ASK, SIZE, HUBS, WANT = range(7)


def _mix(values: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """What Spark's xxhash64 makes of 64-bit integers, one by one, from the hash so far."""
    one, two, three, four, five = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda x, n: (x << np.uint64(n)) | (x >> np.uint64(64 - n))
    with np.errstate(over="ignore"):
        h = (seed + five + np.uint64(8)) ^ (turn(values * two, 31) * one)
        h = turn(h, 27) * one + four
        h = (h ^ (h >> np.uint64(33))) * two
        h = (h ^ (h >> np.uint64(29))) * three
    return h ^ (h >> np.uint64(32))


def coin(seed: int, r: int, ids: np.ndarray) -> np.ndarray:
    """For each id whether its turn comes in round r."""
    h = np.full(len(ids), 42, np.uint64)
    for x in (np.full(len(ids), seed), np.full(len(ids), r), ids):
        h = _mix(x.astype(np.int64).view(np.uint64), h)
    return (h & np.uint64(1)) == 0


def part_of(ids: np.ndarray, parts: int) -> np.ndarray:
    """The part that each id lies in; the same as pmod(xxhash64(id), parts)."""
    return _mix(ids.astype(np.int64).view(np.uint64), np.full(len(ids), 42, np.uint64)).view(np.int64) % parts


def _pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs of a and b, by b and then a."""
    order = np.lexsort((a, b))
    a, b = a[order], b[order]
    new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) if len(a) else np.zeros(0, bool)
    return a[new], b[new]


def _summed(v: np.ndarray, to: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each distinct pair of v and to, by v and then to, with its sum of w."""
    order = np.lexsort((to, v))
    v, to, w = v[order], to[order], w[order]
    start = np.flatnonzero(np.concatenate(([True], (v[1:] != v[:-1]) | (to[1:] != to[:-1])))) if len(v) else np.zeros(0, int)
    return v[start], to[start], np.add.reduceat(w, start) if len(start) else w


def _best(v: np.ndarray, to: np.ndarray, gain: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each v the row of the largest gain, of equals the smallest to."""
    order = np.lexsort((to, -gain, v))
    first = order[np.concatenate(([True], v[order][1:] != v[order][:-1]))] if len(v) else order
    return v[first], to[first], gain[first]


def _rows(rows: list[tuple]) -> pa.Table:
    part, kind, *data = zip(*rows) if rows else ([],) * 5
    blobs = [pa.array([np.ascontiguousarray(x, np.int64).tobytes() for x in column], pa.binary()) for column in data]
    return pa.table([pa.array(part, pa.int32()), pa.array(kind, pa.int32()), *blobs], names=["part", "kind", "a", "b", "d"])


def _longs(blob) -> np.ndarray:
    return np.frombuffer(blob.as_py(), np.int64)


def _cuts(part: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Stretches of equal parts, which ascend."""
    edge = np.flatnonzero(np.concatenate(([len(part) > 0], part[1:] != part[:-1])))
    for lo, hi in zip(edge, np.append(edge[1:], len(part))):
        yield int(part[lo]), slice(lo, hi)


def _packed(part: int, nodes: pa.Table, edges: pa.Table, parts: int) -> pa.Table:
    """One part: its nodes in order; of its edges the places of both ends, own nodes first, then those beyond (far)."""
    ids, k, c, big = (nodes.column(x).to_numpy() for x in ("id", "k", "c", "big"))
    order = np.argsort(ids)
    ids, k, c, big = ids[order], k[order], c[order], big[order].astype(bool)
    src, dst, w, over = (edges.column(x).to_numpy() for x in ("src", "dst", "w", "over"))
    at, home = np.searchsorted(ids, src), part_of(dst, parts)
    far = np.unique(dst[home != part])
    to = np.where(home == part, np.searchsorted(ids, dst), len(ids) + np.searchsorted(far, dst))
    out = (home != part) & (over == 0)  # a hub learns nothing of its plain neighbours but their weights by group
    everywhere = np.flatnonzero(big)
    others = np.array([p for p in range(parts) if p != part], np.int64) if len(everywhere) else np.zeros(0, np.int64)
    tell, told = _pairs(np.concatenate((at[out], np.repeat(everywhere, len(others)))), np.concatenate((home[out], np.tile(others, len(everywhere)))))
    hub = np.flatnonzero(over)
    data = (ids, k, c, at, to, w, far, np.stack((tell, told)), np.stack((hub, home[hub])))
    return pa.table([pa.array([part], pa.int32()), *(pa.array([np.ascontiguousarray(x, np.int64).tobytes()], pa.binary()) for x in data)], names=[x.split()[0] for x in PACKED.split(", ")])


class _Part:
    """What one part knows in a round, and what it says."""

    def __init__(self, packed: pa.Table, sent: pa.Table | None, parts: int, fine: bool):
        self.part, self.parts, self.fine = packed.column("part")[0].as_py(), parts, fine
        self.ids, self.k, self.c, self.src, self.dst, self.w, self.far, tell, hub = (_longs(packed.column(i)[0]) for i in range(1, 10))
        self.tell, self.hub = tell.reshape(2, -1), hub.reshape(2, -1)
        self.f, far_c, far_f = self.ids, np.zeros(len(self.far), np.int64), np.zeros(len(self.far), np.int64)
        sizes, hubs = [np.zeros((3, 0), np.int64)], [np.zeros((3, 0), np.int64)]
        for kind, a, b, d in zip(*(sent.column(x) for x in ("kind", "a", "b", "d"))) if sent is not None else ():
            kind, a, b, d = kind.as_py(), _longs(a), _longs(b), _longs(d)
            if kind == OWN:
                self.c, self.f = b, d
            elif kind == FAR and len(self.far):
                i = np.minimum(np.searchsorted(self.far, a), len(self.far) - 1)
                here = self.far[i] == a
                far_c[i[here]], far_f[i[here]] = b[here], d[here]
            elif kind in (SIZE, HUBS):
                (sizes if kind == SIZE else hubs).append(np.stack((a, b, d)))
        self.near_c, self.near_f = np.concatenate((self.c, far_c)), np.concatenate((self.f, far_f))
        sizes = np.concatenate(sizes, axis=1)
        self.names, self.size, self.many = sizes[:, np.argsort(sizes[0])]
        hubs = np.concatenate(hubs, axis=1)
        self.hubs = (np.searchsorted(self.ids, hubs[0]), hubs[1], hubs[2])

    def _gains(self, v: np.ndarray, to: np.ndarray, w: np.ndarray, mine: np.ndarray, resolution: float, total: float) -> tuple:
        v, to, e = _summed(v, to, w)
        size = self.size[np.searchsorted(self.names, to)]
        return v, to, e.astype(float) - resolution * self.k[v] * (size - np.where(to == mine[v], self.k[v], 0)) / total

    def move(self, r: int, resolution: float, total: float, seed: int) -> int:
        every = np.arange(len(self.ids))
        v, to = np.concatenate((self.src, self.hubs[0], every)), np.concatenate((self.near_c[self.dst], self.hubs[1], self.c))
        v, to, gain = self._gains(v, to, np.concatenate((self.w, self.hubs[2], np.zeros(len(every), np.int64))), self.c, resolution, total)
        stay = np.empty(len(every))
        mine = to == self.c[v]
        stay[v[mine]] = gain[mine]
        v, to, gain = _best(v, to, gain)
        want = gain > stay[v]
        go = want & coin(seed, r, self.ids[v])
        self.c = self.c.copy()
        self.c[v[go]] = to[go]
        return int(want.sum())

    def refine(self, r: int, resolution: float, total: float, seed: int) -> int:
        alone = self.many[np.searchsorted(self.names, self.f)] == 1
        use = (self.c[self.src] == self.near_c[self.dst]) & (self.f[self.src] != self.near_f[self.dst]) & alone[self.src]
        hubs = alone[self.hubs[0]] & (self.f[self.hubs[0]] != self.hubs[1])
        v, to, w = (np.concatenate((x[use], y[hubs])) for x, y in zip((self.src, self.near_f[self.dst], self.w), self.hubs))
        v, to, gain = self._gains(v, to, w, self.f, resolution, total)
        some = gain > 0
        v, to, gain = v[some], to[some], gain[some]
        want = len(np.unique(v))
        may = coin(seed, -1 - r, self.ids[v]) & ~coin(seed, -1 - r, to)
        v, to, _ = _best(v[may], to[may], gain[may])
        self.f = self.f.copy()
        self.f[v] = to
        return want

    def says(self, want: int) -> pa.Table:
        none = np.zeros(0, np.int64)
        group = self.f if self.fine else self.c
        out = [(self.part, OWN, self.ids, self.c, self.f)] + [(self.part, WANT, none, none, none)] * (want > 0)
        v, to = self.tell
        for p, cut in _cuts(to):
            out.append((p, FAR, self.ids[v[cut]], self.c[v[cut]], self.f[v[cut]]))
        asks, who = [group, group[v]], [np.full(len(group), self.part), to]
        e, home = self.hub
        if self.fine:  # of its own community only
            same = self.c[self.src[e]] == self.near_c[self.dst[e]]
            e, home = e[same], home[same]
        order = np.argsort(home, kind="stable")
        e, home = e[order], home[order]
        near = np.concatenate((self.ids, self.far))
        for p, cut in _cuts(home):
            to_hub = _summed(near[self.dst[e[cut]]], group[self.src[e[cut]]], self.w[e[cut]])
            out.append((p, HUBS, *to_hub))
            asks.append(to_hub[1])
            who.append(np.full(len(to_hub[1]), p))
        names, of, many = np.unique(group, return_inverse=True, return_counts=True)
        share = np.zeros(len(names), np.int64)
        np.add.at(share, of, self.k)
        home = part_of(names, self.parts)
        order = np.argsort(home, kind="stable")
        for p, cut in _cuts(home[order]):
            at = order[cut]
            out.append((p, SHARE, names[at], share[at], many[at]))
        asks, who = _pairs(np.concatenate(asks), np.concatenate(who))
        home = part_of(asks, self.parts)
        order = np.argsort(home, kind="stable")
        for p, cut in _cuts(home[order]):
            out.append((p, ASK, asks[order[cut]], who[order[cut]], none))
        return _rows(out)


def _answers(sent: pa.Table) -> pa.Table:
    """Homes add up the shares of their groups and tell the sizes to the parts that ask; other rows go on as they are."""
    kind = sent.column("kind").to_numpy()
    rest = sent.filter(pa.array((kind != SHARE) & (kind != ASK)))
    shares, asks = sent.filter(pa.array(kind == SHARE)), sent.filter(pa.array(kind == ASK))
    if not len(shares):
        return rest
    name, size, many = (np.concatenate([_longs(x) for x in shares.column(c)]) for c in ("a", "b", "d"))
    names, of = np.unique(name, return_inverse=True)
    sizes, counts = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
    np.add.at(sizes, of, size)
    np.add.at(counts, of, many)
    asked, who = _pairs(*(np.concatenate([_longs(x) for x in asks.column(c)]) for c in ("a", "b")))
    at = np.searchsorted(names, asked)
    return pa.concat_tables([rest, _rows([(p, SIZE, asked[cut], sizes[at[cut]], counts[at[cut]]) for p, cut in _cuts(who)])])


class SpreadGraph:
    """A graph over parts: edges(src, dst, w), once each, w whole numbers. The steps are those of one task, and so are the labels."""

    def __init__(self, edges: DataFrame, resolution: float, seed: int, parts: int | None = None):
        both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
        self.first = kept(both)
        self.cells = kept(both.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("k")).withColumn("c", F.col("id")))
        many, total = self.first.agg(F.count("*"), F.sum("w")).first()
        self.parts = parts or max(1, -(-many // PART_EDGES))
        self.total, self.resolution, self.seed = float(total or 0), resolution, seed

    def begin(self) -> None:
        self.edges, self.nodes = self.first, self.cells
        self.node = self.cells.select(F.col("id").alias("cell_id"), F.col("id").alias("node"))
        self._pack()

    def _pack(self) -> None:
        """Deals the level's nodes and edges out to parts, as they are until it shrinks."""
        parts, here = self.parts, lambda c: F.pmod(F.xxhash64(c), F.lit(self.parts)).cast("int")
        big = self.edges.groupBy("src").agg(F.count("*").alias("n")).where(F.col("n") >= HUB).select(F.col("src").alias("id"), F.lit(1).alias("big"))
        nodes, edges = self.nodes.join(big, "id", "left").select("id", "k", "c", F.coalesce("big", F.lit(0)).alias("big")), self.edges.withColumn("over", F.lit(0))
        if not big.isEmpty():
            ends = [big.select(F.col("id").alias(c), F.col("big").alias(f"big_{c}")) for c in ("src", "dst")]
            edges = self.edges.join(ends[0], "src", "left").join(ends[1], "dst", "left").where("big_src is null or big_dst is not null")
            edges = edges.select("src", "dst", "w", F.when(F.col("big_src").isNull() & F.col("big_dst").isNotNull(), 1).otherwise(0).alias("over"))

        def pack(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
            return _packed(key[0].as_py(), left, right, parts)

        dealt = nodes.withColumn("part", here("id")).groupBy("part").cogroup(edges.withColumn("part", here("src")).groupBy("part"))
        self.packed = kept(dealt.applyInArrow(pack, PACKED))

    def _round(self, sent: DataFrame | None, does: str | None, r: int, fine: bool) -> DataFrame:
        parts, resolution, total, seed = self.parts, self.resolution, self.total, self.seed

        def run(left: pa.Table, right: pa.Table | None = None) -> pa.Table:
            if not len(left):
                return _rows([])  # told of a hub, but without nodes
            p = _Part(left, right, parts, fine)
            return p.says(getattr(p, does)(r, resolution, total, seed) if does else 0)

        packed = self.packed.groupBy("part")
        said = packed.applyInArrow(lambda t: run(t), SENT) if sent is None else packed.cogroup(sent.groupBy("part")).applyInArrow(run, SENT)
        return said.groupBy("part").applyInArrow(_answers, SENT)

    def _labels(self, sent: DataFrame) -> DataFrame:
        """(id, k, c, f) of the nodes, out of their parts' rows."""

        def run(batches):
            for batch in batches:
                for a, b, d in zip(*(batch.column(x) for x in ("a", "b", "d"))):
                    yield pa.RecordBatch.from_arrays([pa.array(_longs(x)) for x in (a, b, d)], names=["id", "c", "f"])

        told = sent.where(f"kind = {OWN}").select("a", "b", "d").mapInArrow(run, "id long, c long, f long")
        return kept(self.nodes.select("id", "k").join(told, "id"))

    def _rounds(self, does: str, most: int, fine: bool, start: DataFrame | None) -> DataFrame:
        sent = self._round(start, None, 0, fine)
        for r in range(0, most, ROUNDS):
            for i in range(r, min(r + ROUNDS, most)):
                sent = self._round(sent, does, i, fine)
            sent = kept(sent)
            if sent.where(f"kind = {WANT}").isEmpty():
                break
        return sent

    def move(self, most: int) -> None:
        self.sent = self._rounds("move", most, False, None)

    def refine(self, most: int) -> None:
        own = self.sent.where(f"kind = {OWN}").select("part", "kind", "a", "b", F.col("a").alias("d"))  # each node a group of its own
        far = self.sent.where(f"kind = {FAR}").select("part", "kind", "a", "b", F.col("a").alias("d"))
        self.fine = self._labels(self._rounds("refine", most, True, own.unionByName(far)))

    def shrink(self) -> bool:
        nodes = kept(self.fine.groupBy(F.col("f").alias("id")).agg(F.sum("k").alias("k"), F.max("c").alias("c")))
        if nodes.count() == self.fine.count():
            self.nodes = self.fine.select("id", "k", "c")
            return False
        of = self.fine.select("id", "f")
        ends = self.edges.join(of.select(F.col("id").alias("src"), F.col("f").alias("a")), "src").join(of.select(F.col("id").alias("dst"), F.col("f").alias("b")), "dst")
        self.edges = kept(ends.where("a <> b").groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.sum("w").alias("w")))
        self.node = kept(self.node.join(of.withColumnRenamed("id", "node"), "node").select("cell_id", F.col("f").alias("node")))
        self.nodes = nodes
        self._pack()
        return True

    def end(self) -> tuple[int, int]:
        """Communities of the cells; the weight inside them, each edge twice, and the sum of their squared strengths."""
        told = self.node.join(self.nodes.select(F.col("id").alias("node"), "c"), "node").select(F.col("cell_id").alias("id"), "c")
        self.cells = kept(self.cells.select("id", "k").join(told, "id"))
        a, b = (self.cells.select(F.col("id").alias(x), F.col("c").alias(f"c{x}")) for x in ("src", "dst"))
        inside = self.first.join(a, "src").join(b, "dst").where("csrc = cdst").agg(F.sum("w")).first()[0] or 0
        squares = self.cells.groupBy("c").agg(F.sum("k").cast("decimal(19,0)").alias("k")).agg(F.sum(F.col("k") * F.col("k"))).first()[0] or 0
        return int(inside), int(squares)
