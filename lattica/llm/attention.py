"""A small causal self-attention model in numpy, over classes of subword ids.

Inputs are subword ids in rank order of their corpus counts; the last rank holds all that are rarer. One attention layer
with a feed-forward layer gives the logits of the group of the next id's class and of the class in its group, added to a table of the
last id (a skip connection that corpus counts fill in). Attention has one head as wide as the inputs, so one matrix makes queries and one
what is seen; its weights are squares of products. The most frequent ids are classes of their own; the others share classes by
whether they begin a word, by what they stand near to (which tells languages and subjects apart) and by frequency, and within its
class an id has its share of the corpus counts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

WIDTH, HIDDEN = 16, 32
#: A window holds CONTEXT ids that only give context and FRESH ids that are scored.
CONTEXT, FRESH = 16, 32
RANKS, SINGLES, CLASSES = 2048, 64, 256
#: Classes stand in groups of SIZE; all of a group begin a word, or none does.
SIZE = 16
GROUPS = CLASSES // SIZE
#: So many of the most frequent ids are classes of their own.
OWN = 128
#: Clusters of ids by what they stand near to, among those that begin words and among the others.
KINDS = 5
END = 50_256


@dataclass
class Vocabulary:
    """Ranks and classes of subword ids, from counts over the training texts."""

    rank: np.ndarray
    group: np.ndarray
    share: np.ndarray  # natural log of an id's part of its class
    starts: np.ndarray  # classes whose ids begin a word, or end the text
    mass: np.ndarray  # how often the ids of each class occur

    @staticmethod
    def of(counts: np.ndarray, begins: np.ndarray, near: np.ndarray | None = None) -> Vocabulary:
        """counts: of each id; begins: whether the id begins a word (or is the end); near: how often each id has each of the
        SINGLES most frequent as the last of them before it."""
        n = len(counts)
        order = by_frequency(counts)
        rank = np.empty(n, np.int32)
        rank[order] = np.minimum(np.arange(n), RANKS - 1)
        smooth = counts + 0.1
        alone = np.zeros(n, bool)
        alone[order[:OWN]] = True
        sides = [order[side[order]] for side in (begins, ~begins)]
        # classes of the ids that begin words: whole groups, with room for the bands of either side
        first = int(alone[sides[0]].sum())
        first = min(-(-(first + (CLASSES - OWN) // 2) // SIZE) * SIZE, (CLASSES - (OWN - first) - KINDS) // SIZE * SIZE)
        group = np.empty(n, np.int32)
        for ids, low, many in zip(sides, (0, first), (first, CLASSES - first)):
            kin = clusters(near[ids], smooth[ids]) if near is not None else np.zeros(len(ids), int)
            own, mass = alone[ids], np.bincount(kin[~alone[ids]], smooth[ids][~alone[ids]], minlength=KINDS)
            # each cluster gets a band at least, and more by its mass; in it the frequent ids come first, those of their own class before all
            bands = many - own.sum()
            cut = np.where(mass > 0, 1 + np.floor(mass / max(mass.sum(), 1e-9) * (bands - KINDS)), 0).astype(int)
            cut[np.argmax(mass)] += bands - cut.sum()
            for c in range(KINDS):
                one, mine = ids[own & (kin == c)], ids[~own & (kin == c)]
                group[one] = low + np.arange(len(one))
                low += len(one)
                if len(mine):
                    done = np.cumsum(smooth[mine])
                    group[mine] = low + np.minimum((done / done[-1] * cut[c]).astype(int), cut[c] - 1)
                low += cut[c]
        total = np.bincount(group, smooth, minlength=CLASSES)
        share = (np.log(smooth) - np.log(total[group])).astype(np.float32)
        starts = np.arange(CLASSES) < first
        return Vocabulary(rank, group, share, starts, np.bincount(group, counts, minlength=CLASSES))


def by_frequency(counts: np.ndarray) -> np.ndarray:
    """The ids, the end first, then the most frequent; ties to the smaller id."""
    order = np.lexsort((np.arange(len(counts)), -counts))
    return np.concatenate(([END], order[order != END]))  # the end is always of its own class


def clusters(near: np.ndarray, weight: np.ndarray, rounds: int = 25) -> np.ndarray:
    """KINDS clusters of rows of counts by the angle between their square roots, from the farthest rows as first centres.

    Rare rows lean on the mean; the centres are weighted by the rows' weights.
    """
    if not len(near) or not near.sum():
        return np.zeros(len(near), int)
    x = np.sqrt(near + 6.0 * near.sum(axis=0) / near.sum())
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    centres = x[[int(np.argmax(weight))]]
    for _ in range(KINDS - 1):
        far = (1 - (x @ centres.T).max(axis=1)).clip(0)
        centres = np.concatenate((centres, x[[int(np.argmax(far * weight))]]))
    for _ in range(rounds):
        of = (x @ centres.T).argmax(axis=1)
        sums = np.stack([(x[of == c] * weight[of == c, None]).sum(axis=0) if (of == c).any() else centres[c] for c in range(KINDS)])
        centres = sums / np.linalg.norm(sums, axis=1, keepdims=True)
    return (x @ centres.T).argmax(axis=1)


def last_frequent(ids: np.ndarray, single: np.ndarray) -> np.ndarray:
    """For each of texts' closed ids the last of the frequent ids (single: their number by id, -1 for others) that stands before it in its text; 0: none."""
    of = single[ids]
    at = np.flatnonzero(of >= 0)  # an end's number is 0
    out = np.zeros(len(ids), np.int64)
    if len(at):
        out[at[0] + 1 :] = np.repeat(of[at], np.diff(at, append=len(ids)))[:-1]
    return out


def skip_table(cells: np.ndarray, prior: np.ndarray, weight: float = 50.0) -> np.ndarray:
    """Log probabilities of the next class after each rank: counts, drawn to the classes' overall shares."""
    p = (cells + weight * prior) / (cells.sum(axis=1, keepdims=True) + weight)
    return np.log(np.maximum(p, 1e-17)).astype(np.float32)  # a class may have no ids


SHAPES = {"E": (RANKS, WIDTH), "P": (CONTEXT + FRESH, WIDTH), "Q": (WIDTH, WIDTH), "A": (WIDTH, WIDTH), "F": (WIDTH, HIDDEN), "G": (HIDDEN, WIDTH), "S": (WIDTH, GROUPS), "O": (GROUPS, WIDTH, SIZE)}


def fresh_weights(seed: int = 5) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    out = {k: (rng.standard_normal(s) * (0.5 if k in "EP" else s[0] ** -0.5)).astype(np.float32) for k, s in SHAPES.items()}
    out["S"][:] = out["O"][:] = 0
    return out


def windows(bounds: np.ndarray, a: int = 0, b: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For texts whose inputs are at bounds[r]..bounds[r + 1]: the inputs of each window, or of windows a to b, -1 where there is none.

    Windows step by FRESH and look back CONTEXT, so each input is fresh in one window. The second result says where fresh.
    """
    total = np.concatenate(([0], np.cumsum(-(-np.diff(bounds) // FRESH))))
    number = np.arange(a, total[-1] if b is None else min(b, total[-1]))
    text = np.searchsorted(total, number, side="right") - 1
    lo, hi = bounds[text][:, None], bounds[text + 1][:, None] if len(bounds) > 1 else np.zeros((0, 1), np.int64)
    at = lo + (number - total[text])[:, None] * FRESH - CONTEXT + np.arange(CONTEXT + FRESH)
    at = np.where((at < lo) | (at >= hi), -1, at)
    return at, at[:, CONTEXT:] >= 0


def how_many(bounds: np.ndarray) -> int:
    return int((-(-np.diff(bounds) // FRESH)).sum())


#: Windows that are laid out at once.
TURN = 8192
#: Each fresh input's weight for those that it may look at, by how many these are.
_CAUSE = (np.tri(FRESH, CONTEXT + FRESH, CONTEXT) / np.arange(CONTEXT + 1, CONTEXT + FRESH + 1)[:, None]).astype(np.float32)
_CELLS = np.arange(RANKS * WIDTH).reshape(RANKS, WIDTH)
_ONES = np.ones(max(SIZE, GROUPS), np.float32)


def levels(skip: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A table of the last id in two levels: log probabilities of the groups after each rank, and of the classes within each group."""
    x = skip.reshape(RANKS, GROUPS, SIZE)
    top = x.max(axis=2, keepdims=True)
    whole = np.log(np.exp(x - top).sum(axis=2, keepdims=True)) + top
    whole -= whole.max(axis=1, keepdims=True)
    return np.ascontiguousarray(whole[..., 0]), (x - top).reshape(-1, SIZE)


def _layers(w: dict[str, np.ndarray], r: np.ndarray, there: np.ndarray):
    """What the layers make of windows of ranks: inputs, the fresh ones and their queries, attention's weights and their halved slopes, what is seen, and the sums after each layer.

    An input looks back by the squares of products, over the number of inputs that it may look at; where there is none, nothing is weighed.
    """
    x = np.take(w["E"], r, axis=0, mode="clip")
    x += w["P"]
    if not there.all():
        x[~there] = 0
    xq = x[:, CONTEXT:].reshape(-1, WIDTH)
    q = (xq @ w["Q"]).reshape(len(r), FRESH, WIDTH)
    s = np.matmul(q, x.transpose(0, 2, 1))
    root = s * _CAUSE
    s *= root
    c = np.matmul(s, x).reshape(-1, WIDTH)
    h = c @ w["A"]
    h += xq
    f = h @ w["F"]
    np.maximum(f, 0, out=f)
    z = f @ w["G"]
    z += h
    return x, xq, q, s, root, c, h, f, z


def _exp(logits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exponentials and their sums by row; where these would leave the range, the logits are shifted by row, in place."""
    if logits.size and not logits.max() < 60:
        logits -= logits.max(axis=1, keepdims=True)
    e = np.exp(logits)
    total = e @ _ONES[: e.shape[1]]
    if total.size and not total.min() > 1e-30:
        logits -= logits.max(axis=1, keepdims=True)
        e = np.exp(logits)
        total = e @ _ONES[: e.shape[1]]
    return e, total


def forward(w: dict[str, np.ndarray], skip: np.ndarray, ranks: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Log probabilities of the classes after each fresh input, windows by FRESH by classes (flattened)."""
    r = ranks[np.maximum(at, 0)]
    z = _layers(w, r, at >= 0)[-1]
    first, second = (x[r[:, CONTEXT:].reshape(-1)] for x in (levels(skip)[0], levels(skip)[1].reshape(RANKS, GROUPS, SIZE)))
    out = []
    for x in (z @ w["S"] + first, np.einsum("nw,gws->ngs", z, w["O"]) + second):
        x -= x.max(axis=-1, keepdims=True)
        out.append(x - np.log(np.exp(x).sum(axis=-1, keepdims=True)))
    return (out[0][..., None] + out[1]).reshape(-1, CLASSES)


def _by_group(target: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
    """An order of classes by their groups, the groups in that order, and (group, begin, end) of each that occurs."""
    group = (target // SIZE).astype(np.uint8)
    order = np.argsort(group, kind="stable")
    ends = np.cumsum(np.bincount(group, minlength=GROUPS)).tolist()
    return order, group[order].astype(np.int64), [(g, a, b) for g, (a, b) in enumerate(zip([0, *ends], ends)) if a < b]


def _exponentials(w: dict[str, np.ndarray], tables: tuple[np.ndarray, np.ndarray], z: np.ndarray, rank: np.ndarray, group: np.ndarray, runs: list[tuple[int, int, int]], target: np.ndarray):
    """For rows in the order of their targets' groups: exponentials over groups and over the classes of the target's group, the
    sums of both, and the target's two logits added up."""
    one = z @ w["S"]
    one += np.take(tables[0], rank, axis=0, mode="clip")
    two = np.take(tables[1], rank * np.int64(GROUPS) + group, axis=0, mode="clip")
    for g, a, b in runs:
        two[a:b] += z[a:b] @ w["O"][g]
    (e_one, all_one), (e_two, all_two), row = _exp(one), _exp(two), np.arange(len(z))
    return e_one, e_two, all_one, all_two, one[row, group] + two[row, target % SIZE]


def scores(w: dict[str, np.ndarray], skip: np.ndarray, ranks: np.ndarray, bounds: np.ndarray, target: np.ndarray, starts: np.ndarray, batch: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """After each input: the log probability of the class that follows, and that of any class that ends the word.

    What forward() gives, with the classes of the following one's group alone.
    """
    logp, ends = np.empty(len(ranks), np.float32), np.empty(len(ranks), np.float32)
    tables = levels(skip)
    begins = starts.reshape(GROUPS, SIZE)
    pure, begins = bool((begins.all(axis=1) == begins.any(axis=1)).all()), begins.any(axis=1).astype(np.float32)
    for part in (at[k : k + batch] for a in range(0, how_many(bounds), TURN) for at in windows(bounds, a, a + TURN)[:1] for k in range(0, len(at), batch)):
        r = ranks[np.maximum(part, 0)]
        z = _layers(w, r, part >= 0)[-1]
        fresh = part[:, CONTEXT:].reshape(-1)
        real = np.flatnonzero(fresh >= 0)
        t = target[fresh[real]]
        order, group, runs = _by_group(t)
        real, t = real[order], t[order]
        to = fresh[real]
        one, _, all_one, all_two, own = _exponentials(w, tables, z[real], ranks[to], group, runs, t)
        logp[to] = own - np.log(all_one) - np.log(all_two)
        ends[to] = np.log(np.maximum(one @ begins, np.float32(1e-30))) - np.log(all_one)
        if not pure or not np.isfinite(logp[to]).all():
            safe = forward(w, skip, ranks, part)[real]
            logp[to] = safe[np.arange(len(to)), t]
            ends[to] = np.log(np.maximum(np.exp(safe) @ starts.astype(np.float32), np.float32(1e-30)))
    return logp, ends


def gradients(w: dict[str, np.ndarray], skip: np.ndarray, ranks: np.ndarray, at: np.ndarray, target: np.ndarray, tables: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[float, dict[str, np.ndarray]]:
    """Mean loss over fresh inputs, and its gradients. target: class after each input; tables: levels(skip), if they are there."""
    there = at >= 0
    fresh = at[:, CONTEXT:].reshape(-1)
    real = np.flatnonzero(fresh >= 0)
    r = ranks[np.maximum(at, 0)]
    x, xq, q, s, root, c, h, f, z = _layers(w, r, there)
    t = target[fresh[real]]
    order, group, runs = _by_group(t)
    real, t = real[order], t[order]
    y, row, n = z[real], np.arange(len(real)), np.float32(max(len(real), 1))
    one, two, all_one, all_two, own = _exponentials(w, tables or levels(skip), y, r[:, CONTEXT:].reshape(-1)[real], group, runs, t)
    loss = float((np.log(all_one) + np.log(all_two) - own).sum()) / float(n)
    one *= (1 / (n * all_one))[:, None]
    one[row, group] -= 1 / n
    two *= (1 / (n * all_two))[:, None]
    two[row, t % SIZE] -= 1 / n
    g = {"S": y.T @ one, "O": np.zeros_like(w["O"])}
    dy = one @ w["S"].T
    for k, a, b in runs:
        g["O"][k] = y[a:b].T @ two[a:b]
        dy[a:b] += two[a:b] @ w["O"][k].T
    dh = np.zeros_like(z)
    dh[real] = dy
    g["G"] = f.T @ dh
    df = dh @ w["G"].T
    df *= f > 0
    g["F"] = h.T @ df
    dh += df @ w["F"].T
    g["A"] = c.T @ dh
    dc = (dh @ w["A"].T).reshape(q.shape)
    ds = np.matmul(dc, x.transpose(0, 2, 1))
    ds *= root  # the slope of a square is twice this
    dq = np.matmul(ds, x).reshape(-1, WIDTH)
    dq *= 2
    dx = np.matmul(s.transpose(0, 2, 1), dc)
    q *= 2
    dx += np.matmul(ds.transpose(0, 2, 1), q)
    g["Q"] = xq.T @ dq
    dh += dq @ w["Q"].T
    dx[:, CONTEXT:] += dh.reshape(q.shape)
    if not there.all():
        dx[~there] = 0
    g["P"] = dx.sum(axis=0)
    g["E"] = np.bincount(np.take(_CELLS, r.reshape(-1), axis=0, mode="clip").reshape(-1), dx.reshape(-1), minlength=_CELLS.size).astype(np.float32).reshape(RANKS, WIDTH)
    return loss, g


def train(w: dict[str, np.ndarray], skip: np.ndarray, ranks: np.ndarray, bounds: np.ndarray, target: np.ndarray, steps: int = 200, passes: int = 8, batch: int = 128, rate: float = 3e-3) -> dict[str, np.ndarray]:
    """Adam over all windows once, and again, up to `passes` times, while there are fewer than `steps` steps."""
    flat = packed(w)
    w = unpacked(flat, own=False)
    m, u = np.zeros_like(flat), np.zeros_like(flat)
    tables = levels(skip)
    many = how_many(bounds)
    rng = np.random.default_rng(many)
    done = 0
    for _ in range(passes):
        for a in range(0, many, TURN):
            at, _ = windows(bounds, a, a + TURN)
            for ids in np.array_split(rng.permutation(len(at)), -(-len(at) // batch)):
                done += 1
                g = packed(gradients(w, skip, ranks, at[ids], target, tables)[1])
                m += np.float32(0.1) * (g - m)
                g *= g
                g -= u
                g *= np.float32(0.01)
                u += g
                step = np.sqrt(u * np.float32(1 / (1 - 0.99**done)))
                step += np.float32(1e-8)
                np.divide(m, step, out=step)
                step *= np.float32(rate / (1 - 0.9**done))
                flat -= step
        if done >= steps:
            break
    return w


def packed(w: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([w[k].ravel() for k in SHAPES])


def unpacked(flat: np.ndarray, own: bool = True) -> dict[str, np.ndarray]:
    """The weights of packed(), as copies of their own or as views of flat (of single precision)."""
    out, at = {}, 0
    for k, s in SHAPES.items():
        n = int(np.prod(s))
        out[k] = flat[at : at + n].reshape(s).astype(np.float32, copy=own)
        at += n
    return out
