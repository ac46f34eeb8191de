"""Probabilities, costs and log arithmetic as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(x: Column, digits: int = 6) -> Column:
    """Rounded, without a negative zero."""
    return F.round(x, digits) + F.lit(0.0)


def clamped_probability(p: Column) -> Column:
    """Two decimals, within 0.01 and 0.99."""
    return F.greatest(F.lit(0.01), F.least(F.lit(0.99), F.round(p, 2)))


def floored(x: Column, floor: float = 0.01) -> Column:
    return F.greatest(F.lit(floor), x)


def neg_log(p: Column) -> Column:
    """-ln p; infinite for zero."""
    return F.when(p > 0, -F.ln(p)).otherwise(F.lit(float("inf")))


def pron_cost(p: Column) -> Column:
    """The cost of a pronunciation: its probability floored at 0.01, none where unknown."""
    return F.coalesce(-F.ln(floored(p)), F.lit(0.0))


def correction_cost(c: Column) -> Column:
    """-ln of a correction; none where it is unknown or zero, null (infinite) below."""
    return F.when(F.coalesce(c, F.lit(0.0)) == 0, F.lit(0.0)).when(c > 0, -F.ln(c))


def after_costs(own: Column, usual: float) -> tuple[Column, Column]:
    """What silence, and none, cost after a pronunciation: by its own probability, else the usual one; null is infinite."""
    p = F.when(F.coalesce(own, F.lit(0.0)) != 0, own).otherwise(F.lit(float(usual)))
    return F.when(p > 0, -F.ln(p)), F.when(p <= 0, F.lit(0.0)).when(p < 1, -F.ln(1 - p))


def log_sum_exp(x: Column, highest: Column) -> Column:
    """An aggregate: ln of the sum of exp, with the group's maximum at hand."""
    return F.first(highest) + F.ln(F.sum(F.exp(x - highest)))


def gaussian_constant(mean: Column, var: Column, weight: Column) -> Column:
    """ln weight - (d ln 2 pi + sum ln var + sum mean^2 / var) / 2 of a diagonal Gaussian."""
    zero = F.lit(0.0)
    logs = F.aggregate(var, zero, lambda s, v: s + F.ln(v))
    squares = F.aggregate(F.zip_with(mean, var, lambda m, v: m * m / v), zero, lambda s, v: s + v)
    return F.ln(weight) - 0.5 * (F.size(mean) * math.log(2 * math.pi) + logs + squares)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
