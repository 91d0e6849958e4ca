import collections
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.llm import attention as net
from lattica.llm import lm
from lattica.llm._exchange import counted, plain
from lattica.llm.queries import SUBWORD_RANKS


@pytest.fixture(scope="module")
def ranks():
    with open(SUBWORD_RANKS, "rb") as f:
        return f.read()


def random_net(seed=1):
    rng = np.random.default_rng(seed)
    w = {k: x + rng.normal(0, 0.2, x.shape).astype(np.float32) for k, x in net.fresh_weights().items()}
    return w, rng.normal(0, 1, (net.RANKS, net.CLASSES)).astype(np.float32), rng


def test_gradients_and_windows():
    w, skip, rng = random_net()
    bounds = np.array([0, 7, 107, 107, 200])
    ranks, target = rng.integers(0, net.RANKS, 200), rng.integers(0, net.CLASSES, 200)
    at, fresh = net.windows(bounds)
    assert sorted(at[:, net.CONTEXT :][fresh]) == list(range(200))  # each scored once
    loss, g = net.gradients(w, skip, ranks, at, target)
    for k in net.SHAPES:
        i = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        up, down = ({n: x.copy() for n, x in w.items()} for _ in range(2))
        up[k][i] += 1e-2
        down[k][i] -= 1e-2
        slope = (net.gradients(up, skip, ranks, at, target)[0] - net.gradients(down, skip, ranks, at, target)[0]) / 2e-2
        assert slope == pytest.approx(g[k][i], rel=0.05, abs=1e-4)
    starts = rng.random(net.CLASSES) < 0.5
    logp, ends = net.scores(w, skip, ranks, bounds, target, starts)
    full = net.forward(w, skip, ranks, at)
    where = at[:, net.CONTEXT :].reshape(-1)
    ok = where >= 0
    assert np.allclose(full[ok, target[where[ok]]], logp[where[ok]], atol=1e-4)
    assert np.allclose(np.log(np.exp(full[ok])[:, starts].sum(axis=1)), ends[where[ok]], atol=1e-4)
    trained = net.train(w, skip, ranks, bounds, target, steps=30)
    assert net.gradients(trained, skip, ranks, at, target)[0] < loss


def test_attention_is_causal():
    w, skip, rng = random_net(2)
    ranks, target, bounds = rng.integers(0, net.RANKS, 90), rng.integers(0, net.CLASSES, 90), np.array([0, 90])
    starts = np.ones(net.CLASSES, bool)
    one = net.scores(w, skip, ranks, bounds, target, starts)[0]
    later = ranks.copy()
    later[60:] = rng.integers(0, net.RANKS, 30)
    assert np.array_equal(one[:60], net.scores(w, skip, later, bounds, target, starts)[0][:60])


def test_every_word_begins_one_id(ranks):
    coder = lm.Subwords(ranks)
    words = [w.encode() for w in ("the", "oier###", "a b", " ", "é" * 700, "x" * 900, "|", "don't", "漢字", "+1-2")] + [b"\xff\xfe"]
    ids, many = coder.each(words)
    begins = np.flatnonzero(coder.begins[ids])
    assert len(begins) == len(words) and list(np.diff(np.append(begins, len(ids)))) == list(many)
    one = [coder.each([w])[0].tolist() for w in words]
    assert sum(one, []) == ids.tolist()


def test_scores(spark, ranks, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK_BYTES", 4000)
    rnd = random.Random(1)
    vocab = ["".join(rnd.choice(["th", "er", "on", "in"]) for _ in range(rnd.randint(1, 4))) for _ in range(60)]
    texts = [" ".join(rnd.choice(vocab) for _ in range(rnd.randint(0, 80))).capitalize() for _ in range(150)] + [None, "", " \n", "New word", "y" * 3000]
    docs = spark.createDataFrame([*enumerate(texts), (3, texts[3]), (None, "theron")], "doc_id long, text string").selectExpr("*", "1 as n", "'z' as block", "2 as score")
    got = lm.scored(docs, ranks).collect()
    assert len(got) == len(texts) + 2
    rows = [*enumerate(texts), (3, texts[3]), (None, "theron")]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    count, n_texts = collections.Counter(), 0
    for i, t in rows:
        if not held(i):
            count.update(lm.words_of((t or "").encode()))
            n_texts += 1
    n, v = sum(count.values()) + n_texts, len(count) + 1
    for r in got:
        words = lm.words_of((("theron" if r.doc_id is None else texts[r.doc_id]) or "").encode())
        cs = [count[w] for w in words] + [n_texts]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(cs), sum(c > 0 for c in cs), n)
        assert r.base_score == pytest.approx(sum(math.log10((c + 0.5) / (n + 0.5 * (v + 1))) for c in cs), rel=1e-9)
        assert r.score < 0 and math.isfinite(r.score)
    assert lm.scored(docs.limit(0), ranks).collect() == []
    out = [r for r in lm.scored(docs.where(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 1), ranks).collect()]
    assert out and all(r.train_tokens == 0 and r.n_known == 0 and math.isfinite(r.score) for r in out)


def test_mixture_is_a_distribution(ranks):
    """The first id's probabilities add up to 1, and so do those of what follows it."""
    w, skip, _ = random_net(3)
    v = net.Vocabulary.of(np.arange(net.END + 1, dtype=float) % 17, lm.Subwords(ranks).begins)
    at, _ = net.windows(np.array([0, 1]))
    p = np.exp(net.forward(w, skip, np.array([v.rank[net.END]]), at)[0])
    assert (p[v.group] * np.exp(v.share)).sum() == pytest.approx(1, abs=1e-4)


def fit(spark, texts, ranks, parts=1):
    rows = spark.createDataFrame([(t,) for t in texts], "text string").selectExpr("cast(null as long) as doc_id", "coalesce(text, '') as text", "false as held_out")
    return lm.fitted(lm.coded_blocks(rows.repartition(parts), ranks, 1, 1), lm.Subwords(ranks).begins)


def test_all_of_a_text_is_learnt(spark, ranks):
    """Texts that begin alike and hold the same words and pairs of words, in another order after their first 200 bytes."""
    head, n = "the start of it " * 15, 60
    one, two = head + "on in on th " * n, head + "on in " * n + "on th " * n
    (_, skip, weights, texts), (_, same, others, _) = (fit(spark, [x] * 4, ranks) for x in (one, two))
    assert texts == 4 and np.array_equal(skip, same)
    assert not np.allclose(net.packed(weights), net.packed(others))


def test_tables_count_whole_texts(spark, ranks):
    texts = ["the start of it " * 20 + f"on in {i} th " * 700 for i in range(3)] + ["", None]
    v, skip, _, _ = fit(spark, texts, ranks, 3)
    coder, counts, cells = lm.Subwords(ranks), np.zeros(net.END + 1), np.zeros((net.RANKS, net.CLASSES))
    every = [[net.END, *coder.each(lm.words_of((t or "").encode()))[0], net.END] for t in texts]
    for ids in every:
        for a, b in zip(ids[:-1], ids[1:]):
            counts[b] += 1
            cells[v.rank[a], v.group[b]] += 1
    prior = np.bincount(v.group, counts + 0.01, minlength=net.CLASSES)
    assert np.allclose(skip, net.skip_table(cells, prior / prior.sum()), atol=1e-5)
    # the classes come from what stands before ids, counted by hand
    frequent = net.by_frequency(counts)[: net.SINGLES].tolist()
    near = np.zeros((net.END + 1, net.SINGLES))
    for ids in every:
        last = 0
        for i in ids[1:]:
            near[i, last] += last > 0
            last = frequent.index(i) if i in frequent else last
    assert np.array_equal(v.group, net.Vocabulary.of(counts, coder.begins, near).group)


def test_classes_follow_what_stands_near():
    rng = np.random.default_rng(4)
    side = rng.integers(0, 2, 400)
    near = rng.poisson(np.where(side[:, None] == np.arange(10)[None, :] % 2, 8.0, 0.3))
    of = net.clusters(near.astype(float), np.ones(400))
    assert all(len(set(side[of == c])) <= 1 for c in range(net.KINDS))


def prose(n, seed=7):
    """Texts in two made-up languages, whose words keep together."""
    rnd = random.Random(seed)
    tongues = [["".join(rnd.choice(parts) for _ in range(rnd.randint(1, 3))) for _ in range(300)] for parts in (["th", "er", "on", "in", "an"], ["eau", "ch", "qu", "ment", "re"])]
    return [" ".join(rnd.choices(t, weights=[1 / (i + 1) for i in range(300)], k=rnd.randint(20, 120))) for t in (rnd.choice(tongues) for _ in range(n))]


def test_scores_do_not_hang_on_partitions_and_beat_word_counts(spark, ranks, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK_BYTES", 60_000)
    monkeypatch.setattr(lm, "FAN_IN", 3)
    docs = spark.createDataFrame([*enumerate(prose(900))], "doc_id long, text string")
    one, two = ({r.doc_id: r for r in lm.scored(d, ranks).collect()} for d in (docs, docs.repartition(7)))
    assert one == two
    held = [r for r in one.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_score_against_a_plain_reading(spark, ranks):
    """score, text by text and id by id, from the model's full distributions."""
    texts = [*prose(60, 8), "Zyx unheard-of eau", "", "on in th"]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in lm.scored(docs, ranks).collect()}
    coder = lm.Subwords(ranks)
    rows = docs.select("doc_id", "text", lm.held_out().alias("held_out"))
    v, skip, w, n_texts = lm.fitted(lm.coded_blocks(rows, ranks, 1, 1), coder.begins)
    count = collections.Counter(x for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 5 != 1 for x in lm.words_of(t.encode()))
    total = sum(count.values()) + n_texts
    new = min(max(lm.NEW_PER_ONCE * sum(c == 1 for c in count.values()) / total, lm.NEW_WORDS[0]), lm.NEW_WORDS[1])
    for i, t in enumerate(texts):
        words = [coder.each([x])[0].tolist() for x in lm.words_of(t.encode())] + [[net.END]]
        ids = [net.END, *sum(words, [])]
        at, _ = net.windows(np.array([0, len(ids) - 1]))
        p = np.exp(net.forward(w, skip, v.rank[np.array(ids[:-1])], at).astype(float))[: len(ids) - 1]  # classes after each input
        score, k = 0.0, 0
        for x, word in zip([*lm.words_of(t.encode()), None], words):
            first = p[k][v.group[word[0]]] / p[k][v.starts].sum()
            spelt = first * math.exp(v.share[word[0]])
            for j, piece in enumerate(word[1:], 1):
                spelt *= p[k + j][v.group[piece]] * math.exp(v.share[piece])
            k += len(word)
            if x is not None:
                spelt *= p[k][v.starts].sum()  # the word ends
            c = n_texts if x is None else count[x]
            score += math.log10(new * spelt + (1 - new) * c * first / max(v.mass[v.group[word[0]]], 1))
        assert got[i].score == pytest.approx(score, rel=2e-4)


@pytest.mark.parametrize("kind", ["u1", "u2", "u4", "u8"])
def test_counts_come_back_as_they_went(kind):
    top = np.iinfo(kind).max
    parts = [np.array(x, kind) for x in ([], [0], [1, 2, 3], [top, 0, top - 1], np.arange(200) % 251)]
    for some in ([], parts, parts[::-1]):
        got = counted([plain(x) for x in some], kind)
        assert got.dtype == np.dtype(kind)
        assert got.tolist() == [v for x in some for v in x.tolist()]


def test_exponentials_of_two_levels_only(monkeypatch):
    """Each id costs exponentials over the groups and over one group's classes, in training and in scoring, not over all classes."""
    w, skip, rng = random_net(6)
    bounds, ranks, target = np.array([0, 6400]), rng.integers(0, net.RANKS, 6400), rng.integers(0, net.CLASSES, 6400)
    at, _ = net.windows(bounds)
    starts, exp, made = np.arange(net.CLASSES) < net.CLASSES // 2, np.exp, []
    monkeypatch.setattr(np, "exp", lambda x, **kw: made.append(np.size(x)) or exp(x, **kw))
    tables = net.levels(skip)
    made.clear()
    net.gradients(w, skip, ranks, at, target, tables)
    assert sum(made) <= 6400 * (net.GROUPS + net.SIZE)
    made.clear()
    net.scores(w, skip, ranks, bounds, target, starts)
    assert sum(made) <= 6400 * (net.GROUPS + net.SIZE) + skip.size


def test_a_group_begins_words_or_does_not(ranks):
    begins, rng = lm.Subwords(ranks).begins, np.random.default_rng(5)
    for counts in (np.zeros(net.END + 1), rng.zipf(1.3, net.END + 1).clip(0, 10**6) * begins, rng.zipf(1.3, net.END + 1).clip(0, 10**6) * ~begins, rng.integers(0, 99, net.END + 1)):
        v = net.Vocabulary.of(counts.astype(float), begins, rng.poisson(1.0, (net.END + 1, net.SINGLES)).astype(float))
        assert v.group.min() >= 0 and v.group.max() < net.CLASSES and np.isfinite(v.share).all()
        assert len(set(v.group[net.by_frequency(counts)[: net.OWN]])) == net.OWN
        assert np.array_equal(v.starts[v.group], begins)
        sides = v.starts.reshape(net.GROUPS, net.SIZE)
        assert np.array_equal(sides.all(axis=1), sides.any(axis=1))
