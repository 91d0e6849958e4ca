"""The registered queries, and the pipeline against the stages' own brute forces, on the smallest tables."""

import duckdb
import pytest

from lattica.llm import queries as q

DATA = "/root/testdata/sf0.001"
pipeline = pytest.importorskip("corpus_pipeline")


@pytest.mark.parametrize("name", sorted(q.QUERIES))
def test_queries_cover_their_tables(spark, name):
    df = q.QUERIES[name](spark, DATA)
    rows = df.collect()
    docs, pages = (spark.read.parquet(f"{DATA}/{t}.parquet").count() for t in ("documents", "pages"))
    if name in ("op2_url_filter", "op9_html_text"):
        assert len(rows) == pages
    elif name not in ("op6_decontaminate", "op7_ann", "op12_conversation_trie"):
        assert len(rows) == docs and {r.doc_id for r in rows} == {r.doc_id for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id").collect()}


@pytest.mark.parametrize("name", sorted(q.ORACLES))
def test_same_rows_as_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "labels", "benchmark", "conversations"):
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df, rel = q.QUERIES[name](spark, DATA), c.sql(q.ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(rel.columns)
    mine = sorted((tuple(r[x] for x in columns) for r in df.collect()), key=str)
    theirs = sorted((tuple(dict(zip(rel.columns, r))[x] for x in columns) for r in rel.fetchall()), key=str)
    assert mine == theirs


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = docs
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, kept, DATA)
        assert out.columns == docs.columns, name
        out = out.checkpoint()
        assert 0 < out.count() <= kept.count()
        kept = out
    ids = pipeline.STAGES[-1][1](spark, kept, DATA).collect()
    assert {r.doc_id for r in ids} == {r.doc_id for r in kept.select("doc_id").collect()} and all(r.round_trip for r in ids)
    assert sorted((r.doc_id, r.n_ids) for r in pipeline.run(spark, DATA).collect()) == sorted((r.doc_id, r.n_ids) for r in ids)


def test_clashing_columns_stay(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(20).selectExpr("*", "1 as __row", "2 as __row0", "3 as __row1")
    out = pipeline.drop_benchmark_copies(spark, docs, DATA)
    assert out.columns == docs.columns and 0 < out.count() <= 20
