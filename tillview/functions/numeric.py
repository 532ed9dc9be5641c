"""Exact decimal arithmetic for ratios, averages and percentages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(12,2)"
TOTAL = "decimal(24,2)"
COUNT = "decimal(14,0)"


def money(col: Column | str) -> Column:
    return _c(col).cast(MONEY)


def ratio(num: Column | str, den: Column | str, digits: int, times: int = 1) -> Column:
    """``ROUND(times * num / den, digits)``; ``den`` is a row count, NULL when it is 0.

    The quotient keeps 13 or more decimals, so the half-up rounding sees the
    exact tie and not the nearest binary fraction of it.
    """
    return F.round(F.try_divide(_c(num).cast(TOTAL) * F.lit(times), _c(den).cast(COUNT)), digits)


def money_ratio(num: Column | str, den: Column | str, digits: int, times: int = 1) -> Column:
    """As :func:`ratio` for a divisor that is an amount."""
    return F.round(F.try_divide(_c(num).cast(TOTAL) * F.lit(times), _c(den).cast(TOTAL)), digits)


def mean(col: Column | str) -> Column:
    """Unrounded AVG of an amount from an exact decimal sum; NULL without rows."""
    return F.try_divide(F.sum(col).cast("double"), F.count(col))


def mean_of_sums(total: Column | str, count: Column | str) -> Column:
    """As :func:`mean`, from partial sums and counts."""
    return F.try_divide(F.sum(total).cast("double"), F.sum(count))


def distinct_if(condition: Column, col: Column | str) -> Column:
    return F.countDistinct(F.when(condition, _c(col)))


def sum_if(condition: Column, col: Column | str) -> Column:
    return F.sum(F.when(condition, _c(col)))


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col
