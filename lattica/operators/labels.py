"""Label tables: counts, agreement, connections, refinement, matching. labels(cell_id, label)."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._scale import kept


def label_counts(labels: DataFrame) -> DataFrame:
    return labels.groupBy("label").agg(F.count("*").alias("n"))


def contingency(a: DataFrame, b: DataFrame) -> DataFrame:
    """(a, b, n): cells by their labels in both tables."""
    return a.select("cell_id", F.col("label").alias("a")).join(b.select("cell_id", F.col("label").alias("b")), "cell_id").groupBy("a", "b").agg(F.count("*").alias("n"))


def ari(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: the adjusted Rand index; 1 where both put all cells together or all apart."""
    t = contingency(a, b)
    pairs = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2.0)
    cells = t.agg(pairs("n").alias("s"), F.sum("n").alias("n"))
    rows = t.groupBy("a").agg(F.sum("n").alias("n")).agg(pairs("n").alias("ra"))
    cols = t.groupBy("b").agg(F.sum("n").alias("n")).agg(pairs("n").alias("rb"))
    one = cells.join(F.broadcast(rows)).join(F.broadcast(cols))
    expected = F.try_divide(F.col("ra") * F.col("rb"), F.col("n") * (F.col("n") - 1) / 2.0)
    most = (F.col("ra") + F.col("rb")) / 2.0
    return one.select(F.coalesce(F.try_divide(F.col("s") - expected, F.nullif(most - expected, F.lit(0.0))), F.lit(1.0)).alias("ari"))


def mcc(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: the multiclass Matthews correlation of true labels a and predicted labels b; 0 where undefined."""
    t = contingency(a, b)
    total = t.agg(F.sum("n").cast("double").alias("s"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).cast("double").alias("c"))
    per = t.select(F.col("a").alias("k"), F.col("n").alias("t"), F.lit(0).alias("p")).unionByName(t.select(F.col("b").alias("k"), F.lit(0).alias("t"), F.col("n").alias("p"))).groupBy("k").agg(F.sum("t").cast("double").alias("t"), F.sum("p").cast("double").alias("p"))
    sums = per.agg(F.sum(F.col("t") * F.col("p")).alias("tp"), F.sum(F.col("t") * F.col("t")).alias("tt"), F.sum(F.col("p") * F.col("p")).alias("pp"))
    s2 = F.col("s") * F.col("s")
    below = F.sqrt((s2 - F.col("pp")) * (s2 - F.col("tt")))
    return total.join(F.broadcast(sums)).select(F.coalesce(F.try_divide(F.col("c") * F.col("s") - F.col("tp"), F.nullif(below, F.lit(0.0))), F.lit(0.0)).alias("mcc"))


def _table(t: DataFrame) -> np.ndarray:
    rows = t.collect()  # labels by labels
    a, b = sorted({r.a for r in rows}), sorted({r.b for r in rows})
    out = np.zeros((len(a), len(b)))
    for r in rows:
        out[a.index(r.a), b.index(r.b)] = r.n
    return out


def _log_factorial(k: np.ndarray) -> np.ndarray:
    """ln k!, by Stirling's series ten places further on."""
    z = k + 1.0
    y = z + 10
    series = (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5)
    return series - sum(np.log(z + i) for i in range(10))


def ami(a: DataFrame, b: DataFrame) -> float:
    """Adjusted mutual information (mean of entropies), the expected value over hypergeometric tables.

    Only labels by labels come to the driver. Of each pair of labels those overlaps count that lie within 40 standard
    deviations of their mean, so the work grows with the root of the cells.
    """
    t = _table(contingency(a, b))
    n, ra, rb = t.sum(), t.sum(axis=1), t.sum(axis=0)
    if not t.size or t.shape == (1, 1):
        return 1.0
    ent = lambda r: -float((r[r > 0] / n * np.log(r[r > 0] / n)).sum())
    some = t > 0
    mi = float((t[some] / n * np.log(n * t[some] / np.outer(ra, rb)[some])).sum())
    lf, expected = _log_factorial, 0.0
    for x in ra:
        for y in rb:
            wide = 40 * math.sqrt(max(x * y / n * (1 - x / n) * (1 - y / n), 0.0)) + 40
            k = np.arange(max(1.0, x + y - n, math.floor(x * y / n - wide)), min(x, y, math.ceil(x * y / n + wide)) + 1)
            p = np.exp(lf(x) + lf(y) + lf(n - x) + lf(n - y) - lf(n) - lf(k) - lf(x - k) - lf(y - k) - lf(n - x - y + k))
            expected += float((k / n * np.log(n * k / (x * y)) * p).sum())
    below = (ent(ra) + ent(rb)) / 2 - expected
    return (mi - expected) / below if abs(below) > 1e-15 else 1.0


def modularity(labels: DataFrame, edges: DataFrame, resolution: float = 1.0, column: str = "w") -> DataFrame:
    """One row: modularity of an undirected weighted graph given by edges(src, dst, w), each edge once."""
    a = labels.select(F.col("cell_id").alias("src"), F.col("label").alias("a"))
    b = labels.select(F.col("cell_id").alias("dst"), F.col("label").alias("b"))
    told = edges.select("src", "dst", F.col(column).alias("w")).join(a, "src").join(b, "dst")
    ends = told.select(F.col("a").alias("label"), "w").unionByName(told.select(F.col("b").alias("label"), "w"))
    degree = ends.groupBy("label").agg(F.sum("w").alias("k"))
    inside = told.where("a = b").groupBy(F.col("a").alias("label")).agg(F.sum("w").alias("e"))
    total = told.agg(F.sum("w").alias("m"))
    per = degree.join(inside, "label", "left").join(F.broadcast(total))
    share = F.col("k") / (2 * F.col("m"))
    return per.agg(F.sum(F.coalesce("e", F.lit(0.0)) / F.col("m") - resolution * share * share).alias("modularity"))


def connections(labels: DataFrame, edges: DataFrame, column: str = "w", diagonal: str = "keep") -> DataFrame:
    """(a, b, v): summed weights from cells of a to cells of b over the product of their numbers.

    diagonal: keep, zero, or scale (rows over their own diagonal).
    """
    n = label_counts(labels)
    a = labels.select(F.col("cell_id").alias("src"), F.col("label").alias("a"))
    b = labels.select(F.col("cell_id").alias("dst"), F.col("label").alias("b"))
    sums = edges.join(a, "src").join(b, "dst").groupBy("a", "b").agg(F.sum(column).alias("s"))
    out = sums.join(F.broadcast(n.select(F.col("label").alias("a"), F.col("n").alias("na"))), "a").join(F.broadcast(n.select(F.col("label").alias("b"), F.col("n").alias("nb"))), "b")
    out = out.select("a", "b", (F.col("s") / (F.col("na") * F.col("nb"))).alias("v"))
    if diagonal == "zero":
        return out.withColumn("v", F.when(F.col("a") == F.col("b"), 0.0).otherwise(F.col("v")))
    if diagonal == "scale":
        own = F.max(F.when(F.col("a") == F.col("b"), F.col("v"))).over(Window.partitionBy("a"))
        return out.withColumn("v", F.try_divide("v", own))
    return out


def connection_grid(labels: DataFrame, edges: DataFrame, kinds: list | None = None) -> DataFrame:
    """(a, b, n, ratio): numbers of edges between labels, over the number within the row's own label."""
    a = labels.select(F.col("cell_id").alias("src"), F.col("label").alias("a"))
    b = labels.select(F.col("cell_id").alias("dst"), F.col("label").alias("b"))
    t = edges.join(a, "src").join(b, "dst").groupBy("a", "b").agg(F.count("*").alias("n"))
    if kinds is not None:
        t = t.where(F.col("a").isin(kinds) & F.col("b").isin(kinds))
    own = F.max(F.when(F.col("a") == F.col("b"), F.col("n"))).over(Window.partitionBy("a"))
    return t.withColumn("ratio", F.try_divide(F.col("n").cast("double"), own.cast("double")))


def refined_once(labels: DataFrame, edges: DataFrame, percentile: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Labels after one synchronous vote, and one row with the mean entropy of the votes.

    A cell takes the most frequent label of itself and its neighbours (the smallest of equals) where that has at least
    half as many votes as it has neighbours, rounded down, plus one. percentile drops edges as long as that quantile of distances, or
    longer; a cell that is left without neighbours keeps its label.
    """
    if percentile is not None:
        cut = edges.agg(F.percentile("dist", percentile).alias("__cut"))
        edges = edges.join(F.broadcast(cut)).where(F.col("dist") < F.col("__cut")).drop("__cut")
    best = _ballots(labels, edges)
    return best.select("cell_id", "label"), best.agg((F.sum("e") / F.count("*")).alias("entropy"))


def _ballots(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """(cell_id, label, e): of each cell the label that its vote gives it, and the vote's entropy. Votes are dealt out by the cell once they are told."""
    ends = edges.select("src", "dst", F.lit(False).alias("self")).unionByName(labels.select(F.col("cell_id").alias("src"), F.col("cell_id").alias("dst"), F.lit(True).alias("self")))
    told = ends.join(labels.select(F.col("cell_id").alias("dst"), "label"), "dst")
    each = told.groupBy("src", "label").agg(F.count("*").alias("n"), F.bool_or("self").alias("own"))
    one = each.groupBy("src").agg(F.collect_list(F.struct("label", "n", "own")).alias("v"), F.bool_or("own").alias("here"), F.sum("n").alias("total")).where("here")
    best = F.array_max(F.transform("v", lambda x: F.struct(x.n.alias("n"), (-x.label).alias("least"))))
    own = F.filter("v", lambda x: x.own)[0]["label"]
    share = lambda x: x.n / F.col("total")
    e = F.aggregate("v", F.lit(0.0), lambda s, x: s - share(x) * F.ln(share(x)))
    won = one.select(F.col("src").alias("cell_id"), own.alias("own"), best.alias("b"), "total", e.alias("e"))
    new = F.when((-F.col("b.least") != F.col("own")) & (F.col("b.n") >= F.floor((F.col("total") - 1) / 2) + 1), -F.col("b.least")).otherwise(F.col("own"))
    return won.select("cell_id", new.alias("label"), "e")


def refined(labels: DataFrame, edges: DataFrame, method: str = "once", iterations: int = 1) -> tuple[DataFrame, float, int]:
    """Labels, entropy and number of votes. once; num_iter (also iter_num): so many; auto: until entropy is at most 0.05, 19 more at most."""
    done, entropy = 0, math.inf
    most = {"once": 1, "num_iter": iterations, "iter_num": iterations, "auto": 20}[method]
    while done < most and (method != "auto" or entropy * 100 > 5):
        ballots = kept(_ballots(labels, edges))  # the vote is held once, for the labels and their entropy
        labels, entropy, done = ballots.select("cell_id", "label"), ballots.agg(F.sum("e") / F.count("*")).first()[0], done + 1
    return labels, entropy, done


def expanded_ids(ids: list[int], largest: int) -> dict[int, int]:
    """ids from 0 to largest: their own gaps, and what is left spread evenly between them, the first gaps wider by one."""
    ids = sorted(ids)
    if len(ids) == 1:
        return {ids[0]: 0}
    gap, extra = divmod(max(largest - (ids[-1] - ids[0]), 0), len(ids) - 1)
    return {i: i - ids[0] + k * gap + min(k, extra) for k, i in enumerate(ids)}


def relabelled(labels: DataFrame, mapping: dict[int, int]) -> DataFrame:
    if not mapping:
        return labels
    m = F.create_map(*[F.lit(int(x)) for kv in mapping.items() for x in kv])
    return labels.withColumn("label", F.coalesce(F.try_element_at(m, F.col("label").cast("int")), F.col("label").cast("int")))


def assignment(gain: np.ndarray) -> list[tuple[int, int]]:
    """The pairs of rows and columns with the largest sum, by shortest augmenting paths."""
    flip = gain.shape[0] > gain.shape[1]
    cost = -(gain.T if flip else gain)
    n, m = cost.shape
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], j = i, 0
        dist, back, used = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while match[j]:
            used[j] = True
            row = match[j]
            slack = cost[row - 1] - u[row] - v[1:]
            better = ~used[1:] & (slack < dist[1:])
            dist[1:][better], back[1:][better] = slack[better], j
            free = np.where(used, np.inf, dist)
            free[0] = np.inf
            nxt = int(np.argmin(free))
            delta = free[nxt]
            u[match[used]] += delta
            v[used] -= delta
            dist[~used] -= delta
            j = nxt
        while j:
            match[j], j = match[back[j]], back[j]
    return sorted((j - 1, match[j] - 1) if flip else (match[j] - 1, j - 1) for j in range(1, m + 1) if match[j])


def matching(a: DataFrame, b: DataFrame, extra: str = "greedy", seed: int = 0) -> dict[int, int]:
    """How labels of b are best renamed to those of a: by most shared cells, then extra labels.

    greedy: into the middle of the widest gaps; random: to ids that are free up to the largest of both, drawn by the seed.
    """
    if extra not in ("greedy", "random"):
        raise ValueError("extra must be greedy or random")
    rows = contingency(a, b).collect()  # labels by labels
    ids_a, ids_b = sorted({r.a for r in rows}), sorted({r.b for r in rows})
    gain = np.zeros((len(ids_a), len(ids_b)))
    for r in rows:
        gain[ids_a.index(r.a), ids_b.index(r.b)] = r.n
    out = {ids_b[j]: ids_a[i] for i, j in assignment(gain)}
    taken = set(out.values())
    top = max([*ids_a, *ids_b])
    left = [x for x in ids_b if x not in out]
    if extra == "random":
        free = np.array([i for i in range(top + 1) if i not in taken])
        return out | {x: int(i) for x, i in zip(left, np.random.default_rng(seed).permutation(free))}
    for x in left:
        used = sorted(taken)
        gaps = [(q - p, p) for p, q in zip(used, used[1:]) if q - p > 1]
        best = max(gaps, key=lambda g: (g[0], -g[1]), default=None)
        new = best[1] + best[0] // 2 if best else max(top, used[-1]) + 1
        out[x] = new
        taken.add(new)
    return out


def matched(a: DataFrame, b: DataFrame, extra: str = "greedy", seed: int = 0) -> DataFrame:
    return relabelled(b, matching(a, b, extra, seed))


def matched_series(tables: list[DataFrame], least_first: bool = True) -> list[DataFrame]:
    """Each table matched to the one before it, in order of their numbers of labels; returned in the given order."""
    sizes = [t.select("label").distinct().count() for t in tables]
    order = sorted(range(len(tables)), key=lambda i: (sizes[i] if least_first else -sizes[i], i))
    out = list(tables)
    first = order[0]
    ids = [r.label for r in tables[first].select("label").distinct().collect()]
    out[first] = relabelled(tables[first], expanded_ids(ids, max(max(sizes) - 1, len(ids) - 1)))
    for before, now in zip(order, order[1:]):
        out[now] = matched(out[before], tables[now])
    return out


def padded(names: DataFrame, labels: DataFrame, pad: str = "other") -> DataFrame:
    """(label, name) of every label; those without a name get the pad."""
    return labels.select("label").distinct().join(F.broadcast(names), "label", "left").select("label", F.coalesce("name", F.lit(pad)).alias("name"))
