"""Components of wide matrices against numpy, and the memory that they take."""

import resource

import numpy as np
import pyarrow as pa
import pytest

from lattica.operators import reduce as red


def features(spark, x, parts=5):
    rows = spark.createDataFrame(pa.table({"cell_id": pa.array(range(len(x))), "features": pa.array(list(x))}))
    return rows.repartition(parts)


def planted(n, d, seed=0, shift=0.0):
    rng = np.random.default_rng(seed)
    strong = rng.normal(size=(n, 12)) * np.geomspace(30, 3, 12)
    return strong @ np.linalg.qr(rng.normal(size=(d, 12)))[0].T + 0.3 * rng.normal(size=(n, d)) + shift


def scores(x, dims):
    c = x - x.mean(axis=0)
    v = np.linalg.svd(c, full_matrices=False)[2][:dims].T
    return c @ red.signed(v)


@pytest.mark.parametrize("n,d,shift", [(400, 700, 5.0), (30, 520, 0.0), (600, 40, 1e4)])
def test_scores_equal_numpys(spark, monkeypatch, n, d, shift):
    monkeypatch.setattr(red, "GRAM", 8)
    monkeypatch.setattr(red, "CHUNK", 501)
    x = planted(n, d, shift=shift)
    got = {r.cell_id: r.pc for r in red.pca(features(spark, x), 10).collect()}
    assert np.allclose(np.array([got[i] for i in range(n)]), scores(x, 10), atol=1e-6)
    _, _, s, _, total = red.leading(features(spark, x), 10)
    c = x - x.mean(axis=0)
    assert np.allclose(s, np.linalg.svd(c, compute_uv=False)[:10]) and total == pytest.approx((c * c).sum())


def test_shares_of_variance_and_restarts(spark, monkeypatch):
    """A flat spectrum needs a large space, which is cut again and again; a share asks for as many components as it needs."""
    monkeypatch.setattr(red, "GRAM", 8)
    monkeypatch.setattr(red, "KEPT", 30)
    x = np.random.default_rng(1).normal(size=(200, 90)) * np.linspace(2, 1, 90)
    df = features(spark, x).persist()
    assert np.allclose(red.leading(df, 3, tol=1e-9)[2], np.linalg.svd(x - x.mean(axis=0), compute_uv=False)[:3])
    ratio = np.linalg.svd(x - x.mean(axis=0), compute_uv=False) ** 2
    monkeypatch.setattr(red, "KEPT", 240)
    assert red.fit_pca(df, 0.6)[1].shape[1] == int(np.searchsorted(np.cumsum(ratio / ratio.sum()), 0.6, side="right")) + 1
    df.unpersist()


def test_few_rows_and_none(spark, monkeypatch):
    monkeypatch.setattr(red, "GRAM", 2)
    assert red.pca(features(spark, np.ones((1, 5))), 3).count() == 1
    assert red.pca(spark.createDataFrame([], "cell_id long, features array<double>"), 3).count() == 0
    got = np.array([r.pc for r in red.pca(features(spark, np.ones((4, 5))), 3).collect()])
    assert np.allclose(got, 0)


def test_memory_of_six_thousand_columns(spark):
    """A task stays under 1 GB with 2,000 genes and neighbourhoods up to order 1."""
    df = features(spark, planted(1500, 6000), 4).persist()
    mean, vectors, ratio = red.fit_pca(df, 20)
    assert vectors.shape == (6000, 20) and ratio[:12].sum() > 0.5

    def most(batches):
        for b in batches:
            pass
        yield pa.RecordBatch.from_arrays([pa.array([resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024])], names=["mb"])

    assert max(r.mb for r in df.select("cell_id").mapInArrow(most, "mb double").collect()) < 1000
    df.unpersist()
