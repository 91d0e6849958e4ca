"""Every registered query with SQL gives the same rows in DuckDB; the others run."""

import duckdb
import pytest

from lattica import queries as q

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(q.ORACLES))
def test_same_rows_as_sql(spark, duck, name):
    df = q.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    rel = duck.sql(q.ORACLES[name])
    assert columns == sorted(rel.columns)
    mine = [tuple(r[c] for c in columns) for r in df.collect()]
    theirs = [tuple(dict(zip(rel.columns, r))[c] for c in columns) for r in rel.fetchall()]
    assert sorted(mine, key=str) == sorted(theirs, key=str)


@pytest.mark.parametrize("name", ["match_labels", "hvg_seurat_v3", "pca_scores", "noise_floor", "leiden_labels", "gmm_labels"])
def test_runs(spark, name):
    assert q.QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
