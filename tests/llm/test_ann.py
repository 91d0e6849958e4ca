import numpy as np
from pyspark.sql import functions as F

from lattica.llm import ann


def brute(ids, x, query_ids, k):
    out = {}
    for q in query_ids:
        s = [(-float((x[i] * x[q]).sum()), int(ids[i])) for i in range(len(ids)) if ids[i] != ids[q]]
        out[int(ids[q])] = [(v, -d) for d, v in sorted(s)[:k]]
    return out


def test_recall_and_scores(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 200)
    monkeypatch.setattr(ann, "SLICE_BYTES", 8 * 64 * 20)
    monkeypatch.setattr(ann, "CHUNK", 7)
    monkeypatch.setattr(ann, "PAIRS", 640)
    rng = np.random.default_rng(1)
    x = (rng.normal(size=(900, 64)) + 0.3).astype(np.float32).astype(float)
    x[700:720] = x[5]  # ties
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").withColumn("dims", F.lit("clash")).withColumn("vb", F.lit(1))
    got = {}
    for r in ann.nearest(df, df.where("vec_id % 20 = 0"), 20).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    want = brute(np.arange(900), x, range(0, 900, 20), 20)
    assert set(got) == set(want) and all(sorted(v) == list(range(1, 21)) for v in got.values())
    found = [got[q][k + 1] for q in want for k in range(20)]
    truth = [p for q in want for p in want[q]]
    assert sum(a[0] == b[0] for a, b in zip(found, truth)) >= 0.99 * len(truth)
    assert all(abs(a[1] - b[1]) < 1e-9 for a, b in zip(found, truth) if a[0] == b[0])


def test_odd_vectors(spark):
    rows = [(0, [1.0, 2.0]), (20, None), (40, [0.0, 0.0]), (60, [float("nan"), 1.0]), (80, [1.0, None]), (1, [3.0, 1.0]), (2, [float("inf"), 0.0]), (3, [1.0]), (None, [1.0, 1.0]), (1, [3.0, 1.0]), (100, [-1.0, 0.5]), (4, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in ann.nearest(df, df.where("vec_id % 20 = 0"), 20).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 5.0), (0, 2, 1, 5.0), (0, 3, 100, 0.0), (100, 1, 0, 0.0), (100, 2, 1, -2.5), (100, 3, 1, -2.5)]
    assert ann.nearest(df.limit(0), df.limit(0), 20).collect() == []


def test_query_rows_that_share_an_id(spark):
    rows = [(20, [1.0, 0.0]), (20, [0.0, 1.0]), (20, [0.0, 1.0]), (1, [2.0, 1.0]), (2, [1.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in ann.nearest(df, df.where("vec_id % 20 = 0"), 20).collect())
    assert got == sorted([(20, 1, 1, 2.0), (20, 2, 2, 1.0)] + 2 * [(20, 1, 2, 3.0), (20, 2, 1, 1.0)])


def test_bounds_hold_mostly():
    rng = np.random.default_rng(2)
    x, q = rng.normal(size=(500, 64)) + 2.0, rng.normal(size=(40, 64)) + 1.5
    turn = ann.rotation(64)
    assert np.allclose(turn @ turn.T, np.eye(64))
    codes = ann.Codes.of(x)
    assert codes.bits.shape == (500, 8)
    middle, slack = codes.bounds(q, 3.0)
    real = q @ x.T
    assert (np.abs(real - middle) <= slack).mean() > 0.99
    assert abs((middle - real).mean()) < 0.1 * slack.mean()
    assert np.corrcoef((middle - middle.mean(axis=1)[:, None]).ravel(), (real - real.mean(axis=1)[:, None]).ravel())[0, 1] > 0.75


def test_most_vectors_are_not_looked_up():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 64))
    x = centres[rng.integers(0, 40, 8000)] + 0.2 * rng.normal(size=(8000, 64))
    search = ann.Search(x[:50], np.arange(50), 20, 3.0)
    looked = sum(search.add(ann.Codes.of(x[a : a + 2000]), x[a : a + 2000], np.arange(a, a + 2000)) for a in range(0, 8000, 2000))
    assert looked < 0.25 * 50 * 8000
    want = brute(np.arange(8000), x, range(50), 20)
    assert np.mean([len({*search.ids[q]} & {i for i, _ in want[q]}) for q in range(50)]) >= 0.99 * 20
