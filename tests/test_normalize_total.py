"""Totals of cells: values go round once for the totals and their median, and odd rows come out as by a join with the totals."""

import pytest
from pyspark.sql import functions as F

from lattica.operators import qc

SHAPE = "cell_id long, gene_id int, value double"
ROWS = [(1, 0, 1.0), (1, 1, 3.0), (2, 0, 5.0), (2, 0, 5.0), (2, None, 2.0), (3, 0, 0.0), (3, 1, None), (4, 2, None), (5, 1, 6.0), (5, 2, -7.0), (None, 0, 9.0), (None, 1, None)]


def scaled(spark, rows, target=None):
    return sorted((tuple(r) for r in qc.normalize_total(spark.createDataFrame(rows, SHAPE), target).collect()), key=str)


def expected(rows, goal):
    totals = {}
    for cell, _, v in rows:
        totals[cell] = v if totals.get(cell) is None else totals[cell] + (v or 0.0)
    out = [(cell, gene, v * goal / totals[cell] if goal is not None and v is not None and totals[cell] else 0.0) for cell, gene, v in rows if cell is not None]
    return sorted(out, key=str)


def test_values_go_round_once(spark):
    was = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # so that the plan shows what is read again
    try:
        expr = spark.createDataFrame(ROWS, SHAPE).groupBy("cell_id", "gene_id").agg(F.sum("value").alias("value"))
        plan = qc.normalize_total(expr)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", was)
    lines = plan.splitlines()
    assert sum("Exchange hashpartitioning(" in x and "Reused" not in x for x in lines) == 2, plan  # expr's own, and by cell
    assert sum("ReusedExchange" in x for x in lines) == 1


def test_odd_rows(spark):
    # totals are 4, 12, 0, none, -1, and 9 of rows without a cell: the median of those over 0 is 9
    assert scaled(spark, ROWS) == expected(ROWS, 9.0)
    assert scaled(spark, ROWS, 100.0) == expected(ROWS, 100.0)


@pytest.mark.parametrize("rows", [[], [(1, 0, 0.0), (2, 1, None)], [(None, 0, 2.0)]])
def test_without_totals_over_0(spark, rows):
    assert scaled(spark, rows) == expected(rows, None)
