import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.llm import jaccard


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(texts):
    sets = [shingle_set(t) for t in texts]
    root = list(range(len(texts)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and 100 * n >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return [(len(s), top(i)) for i, s in enumerate(sets)]


def texts(seed, n=160):
    rng = np.random.default_rng(seed)
    vocab = [f"w{i}" for i in range(400)]
    base = [list(rng.choice(vocab, rng.integers(1, 90))) for _ in range(25)]
    out = []
    for _ in range(n):
        w = list(base[rng.integers(len(base))])
        for _ in range(int(rng.integers(0, 4)) * len(w) // 40):
            w[rng.integers(len(w))] = vocab[rng.integers(400)]
        out.append((" " if rng.random() < 0.8 else "\n").join(x.upper() if rng.random() < 0.3 else x for x in w))
    return out


@pytest.mark.parametrize("seed,hot", [(1, 1024), (2, 3)])
def test_same_as_brute_force(spark, monkeypatch, seed, hot):
    monkeypatch.setattr(jaccard, "HOT", hot)
    t = [*texts(seed), None, "", " \t\n", "one two", "ONE  two", "é É", "x " * 5000]
    df = spark.createDataFrame(list(enumerate(t)), "doc_id long, text string").withColumn("fp", F.lit(1)).withColumn("block", F.lit("x")).withColumn("n", F.lit(None).cast("int"))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df).collect()}
    assert [got[i] for i in range(len(t))] == brute(t)


def test_copies_at_the_threshold(spark):
    a = [f"a{i}" for i in range(11)]  # seven shingles; six shared of eight: exactly 0.75
    rows = [(1, " ".join(a)), (2, " ".join([*a[:10], "z"])), (3, " ".join([*a[:9], "y", "z"]))]
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_large_group_and_repeated_rows(spark):
    words = [f"c{i}" for i in range(60)]
    rows = []
    for i in range(300):
        w = list(words)
        w[i % 60] = f"n{i}"
        rows.append((i, " ".join(w)))
    rows += [(500, "same text here it is"), (500, "same text here it is"), (None, "same text here it is")]
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.component_id for r in got if r.doc_id is not None and r.doc_id < 300} == set(c for _, c in brute([t for _, t in rows[:300]]))
    assert [r.component_id for r in got if r.doc_id is None or r.doc_id == 500] == [500] * 3


def test_deduplicated_keeps_one_of_each(spark):
    rows = [(3, "a b c d e f", "x"), (1, "A b c d e f", "y"), (2, "", None), (4, None, "z"), (2, "", None), (None, "q", "r")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = jaccard.deduplicated(df)
    assert out.columns == df.columns
    assert sorted(out.collect(), key=str) == sorted([r for r in df.dropDuplicates().collect() if r.doc_id != 3], key=str)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.jaccard_components(df).collect() == [] and jaccard.deduplicated(df).count() == 0
