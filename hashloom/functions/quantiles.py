"""The quantile conventions in use, each by its own name."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def q_linear(v: Column, q: float) -> Column:
    """Linear interpolation between neighbours."""
    return F.percentile(v, F.lit(q))


def q_linear_int(v: Column, q: float) -> Column:
    """Linear interpolation, fraction dropped."""
    return F.percentile(v, F.lit(q)).cast("bigint")


def _at(v: Column, index) -> Column:
    values = F.array_sort(F.collect_list(v))
    return F.get(values, index(F.size(values) - 1).cast("int"))


def q_floor(v: Column, q: float) -> Column:
    """Element floor(q (n - 1)). The group's values are gathered: for per-bucket or per-class tables, not for rows."""
    return _at(v, lambda last: F.floor(F.lit(q) * last))


def q_round(v: Column, q: float) -> Column:
    """Element round(q (n - 1)), halves to even."""
    return _at(v, lambda last: F.rint(F.lit(q) * last))


def q_half_up(v: Column, q: float) -> Column:
    """Element floor(q (n - 1) + 0.5)."""
    return _at(v, lambda last: F.floor(F.lit(q) * last + F.lit(0.5)))
