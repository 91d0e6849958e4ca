"""Scalar functions, as column expressions or plain Python."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def gaussian_weight_1d(distance: Column, sigma: float) -> Column:
    return F.exp(-distance * distance / (2 * sigma * sigma)) / (sigma * math.sqrt(2 * math.pi))


def gaussian_weight_2d(distance: Column, sigma: float) -> Column:
    return F.exp(-distance * distance / (2 * sigma * sigma)) / (2 * math.pi * sigma * sigma)


def p_equiv_radius(p: float, sigma: float) -> float:
    """The distance at which a two-dimensional Gaussian has fallen to the part p of its peak."""
    if not 0 < p < 1:
        raise ValueError("p must lie between 0 and 1")
    return math.sqrt(-2 * sigma * sigma * math.log(p))


def entropy(counts: Column) -> Column:
    """Natural entropy of an array of counts."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return F.aggregate(counts, F.lit(0.0), lambda a, x: a - F.when(x > 0, x / total * F.ln(x / total)).otherwise(0.0))


def category_code(value: Column) -> Column:
    """The position of a value among the sorted distinct ones; -1 for null. Over the whole table: for small dimensions."""
    from pyspark.sql import Window

    return F.when(value.isNull(), -1).otherwise(F.dense_rank().over(Window.orderBy(value.asc_nulls_last())) - 1)


def param_name(decay: str, lam: float, pcs: int, resolution: float) -> str:
    """A readable key; raw doubles stay in their columns, since two decimals don't tell close settings apart."""
    return f"{decay}_pc{pcs}_nc{lam:0.2f}_r{resolution:0.2f}"
