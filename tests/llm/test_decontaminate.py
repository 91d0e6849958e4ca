import random

import numpy as np
from pyspark.sql import functions as F

from lattica.llm import decontaminate as d


def test_best_run_against_all_runs():
    rnd = random.Random(1)
    for _ in range(800):
        same = [rnd.random() < rnd.choice([0.3, 0.7, 0.9]) for _ in range(rnd.randint(1, 24))]
        n, a, b = d.best_run(np.array(same), 75)
        most = max((sum(same[i:j]) for i in range(len(same)) for j in range(i + 1, len(same) + 1) if 100 * sum(same[i:j]) >= 75 * (j - i)), default=0)
        assert n == most == sum(same[a:b]) and 100 * n >= 75 * (b - a)


def make(spark, rows, key):
    return spark.createDataFrame(rows, f"{key} long, text string").withColumn("slice", F.lit("clash")).withColumn("n", F.lit(1))


def test_finds_copies_with_substitutions_and_leaves_others(spark, monkeypatch):
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    items = [[word() for _ in range(n)] for n in (14, 25, 40, 7, 4)]
    docs, want = [], set()
    for i in range(60):
        w = [word() for _ in range(rnd.randint(0, 200))]
        if i % 3 == 0:
            k = rnd.randrange(4)
            copy = list(items[k])
            for x in rnd.sample(range(len(copy)), len(copy) // 8):
                copy[x] = word()
            at = rnd.randint(0, len(w))
            w[at:at] = copy
            want.add((i, k))
        docs.append((i, "\t".join(x.upper() for x in w)))
    docs += [(100, None), (101, ""), (0, docs[0][1]), (102, "x " * 20000)]
    bench = [(k, " ".join(x)) for k, x in enumerate(items)] + [(9, None), (8, "")]
    a, b = make(spark, docs, "doc_id"), make(spark, bench, "item_id")
    got = d.contaminated(a, b).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and sum(r.doc_id == 0 for r in got) == 2
    monkeypatch.setattr(d, "SLICE_WORDS", 15)
    assert {(r.doc_id, r.item_id) for r in d.contaminated(a, b).collect()} == want
    left = d.decontaminated(a, b)
    assert left.columns == a.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted(i for i, _ in docs if i not in {x for x, _ in want})


def test_empty_tables(spark):
    docs, bench = make(spark, [(1, "a b")], "doc_id"), make(spark, [], "item_id")
    assert d.contaminated(docs, bench).collect() == [] and d.decontaminated(docs, bench).count() == 1
    assert d.contaminated(docs.limit(0), make(spark, [(1, "a b c d e f g")], "item_id")).collect() == []


def test_finds_every_arrangement_of_substitutions(spark):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(8))
    items = {n: [word() for _ in range(n)] for n in (15, 16, 18, 20, 40)}
    docs = []
    for n, item in items.items():
        changed = [tuple(range(3, n, 4))] + [tuple(rnd.sample(range(n), {15: 3, 16: 4, 18: 4, 20: 4, 40: 6}[n])) for _ in range(60)]
        for gone in changed:
            copy = [word() if i in gone else x for i, x in enumerate(item)]
            same = np.array([i not in gone for i in range(n)])
            if d.best_run(same, 75)[0] >= 12:
                docs.append((1000 * n + len(docs), " ".join([word(), *copy, word()])))
    bench = make(spark, [(n, " ".join(x)) for n, x in items.items()], "item_id")
    got = {(r.doc_id, r.item_id) for r in d.contaminated(make(spark, docs, "doc_id"), bench).collect()}
    assert len(docs) > 200 and got == {(i, i // 1000) for i, _ in docs}


def brute(text, item, min_words=12, density=75):
    """The best run over all diagonals, each compared in full."""
    best = (0, 0, 0)
    for shift in range(-len(item) + 1, len(text)):
        lo, hi = max(0, shift), min(len(text), shift + len(item))
        same = [text[i] == item[i - shift] for i in range(lo, hi)]
        for i in range(len(same)):
            if same[i]:
                for j in range(i + 1, len(same) + 1):
                    m = sum(same[i:j])
                    if same[j - 1] and m >= min(min_words, len(item)) and 100 * m >= density * (j - i):
                        best = max(best, (m, i - j, -(lo + i)))
    return (best[0], -best[1], -best[2]) if best[0] else None


def pieces_of(texts):
    import pyarrow as pa

    return next(d.word_pieces(pa.array(texts)))[2]


def test_passages_against_all_diagonals(monkeypatch):
    import pyarrow as pa

    rnd = random.Random(4)
    texts, items = ([" ".join(rnd.choice("abcd") for _ in range(n)) for n in sizes] for sizes in ((0, 2, 30, 9, 25, 14, 18, 3), (5, 7, 12, 20, 13)))
    texts += ["a " * 25, "a b " * 14, items[3] + " x " + items[3]]
    items += ["a " * 14, "a b " * 7]
    for item in items[2:5] * 8:
        w = item.split()
        for i in rnd.sample(range(len(w)), len(w) // 6):
            w[i] = "z"
        texts.append(" ".join([rnd.choice("abcd") for _ in range(rnd.randint(0, 9))] + w))
    want = {(r, i): brute(t.split(), x.split()) for r, t in enumerate(texts) for i, x in enumerate(items) if len(x.split()) >= 6}
    want = {k: v for k, v in want.items() if v}
    part = d.Slice(pa.array(items), d.masks_for(12, 75))
    for size in (2_000_000, 1, 7, 100):
        monkeypatch.setattr(d, "CHUNK", size)
        got = {k: (n, -span, -at) for k, (n, span, _, at) in d.passages(pieces_of(texts), part, 12, 75).items()}
        assert got == want and len(want) > 10


def test_families_hold_what_they_promise():
    assert d.masks_for(12, 75) == d.FAMILIES[0] and len(d.masks_for(12, 60)[0]) < 5 and d.masks_for(1, 1) == d.FAMILIES[-1]
    assert not d.lossless(d.FAMILIES[0][:3], 12, 75) and not d.lossless(((0, 1, 2, 3),), 12, 75)
    rnd = random.Random(5)
    for _ in range(3000):
        n = rnd.randint(12, 40)
        gone = set(rnd.sample(range(n), rnd.randint(0, n // 4)))
        same = [i not in gone for i in range(n)]
        if sum(same) >= 12:
            assert any(all(same[i + k] for k in m) for m in d.FAMILIES[0] for i in range(n - m[-1]))


def test_repetitive_texts_stay_linear():
    import time

    import pyarrow as pa

    part = d.Slice(pa.array(["y " * 800, "y z " * 300]), d.masks_for(12, 75))
    began = time.time()
    got = d.passages(pieces_of(["y " * 20_000, "y z " * 4000]), part, 12, 75)
    assert time.time() - began < 5
    assert {k: v[:2] for k, v in got.items()} == {(0, 0): (800, -800), (1, 1): (600, -600)}


def test_short_items_match_whole(spark):
    docs = make(spark, [(1, "a b c d"), (2, "x c d"), (3, "c")], "doc_id")
    bench = make(spark, [(1, "c d"), (2, "c"), (3, "a b c d")], "item_id")
    got = {(r.doc_id, r.item_id, r.word_start) for r in d.contaminated(docs, bench, least_item=1).collect()}
    assert got == {(1, 1, 2), (2, 1, 1), (1, 2, 2), (2, 2, 1), (3, 2, 0), (1, 3, 0)}
    assert d.contaminated(docs, bench).collect() == []
