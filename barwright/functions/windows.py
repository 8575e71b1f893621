"""Window expressions that indicators are made of, with the null rules of rolling statistics.

A rolling value is null until its window holds as many non-null values as it needs; comparisons with a null are false
before any logic is applied to them.
"""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def by_time() -> WindowSpec:
    """Bars of one ticker in time."""
    return Window.partitionBy("ticker").orderBy("ts")


def to_now() -> WindowSpec:
    """All bars of a ticker up to this one."""
    return by_time().rowsBetween(Window.unboundedPreceding, 0)


def over(w: WindowSpec, low: int, high: int = 0) -> WindowSpec:
    return w.rowsBetween(low, high)


def rolling(agg, x: Column, n: int, w: WindowSpec | None = None, high: int = 0) -> Column:
    """agg(x) over the n rows up to row `high` (0: this one, -1: the one before), null unless all n are there."""
    frame = (w or by_time()).rowsBetween(high - n + 1, high)
    return F.when(F.count(x).over(frame) >= n, agg(x).over(frame))


def lag(x: Column, n: int = 1, w: WindowSpec | None = None) -> Column:
    return F.lag(x, n).over(w or by_time())


def is_true(c: Column) -> Column:
    """c with null as false."""
    return F.coalesce(c, F.lit(False))


def fresh(c: Column, w: WindowSpec | None = None) -> Column:
    """True where c is true and was not in the row before; the first row counts as new."""
    return is_true(c) & ~F.coalesce(F.lag(is_true(c)).over(w or by_time()), F.lit(False))


def crossed_over(a: Column, b: Column, w: WindowSpec | None = None) -> Column:
    return fresh(a > b, w)


def crossed_under(a: Column, b: Column, w: WindowSpec | None = None) -> Column:
    return fresh(a < b, w)


def position_in(x: Column, w: WindowSpec | None = None) -> Column:
    """The number of earlier non-null values of x: 0 at the first one."""
    return F.count(x).over((w or by_time()).rowsBetween(Window.unboundedPreceding, 0)) - 1


def average_rank_pct(x: Column, w: WindowSpec, total: Column) -> Column:
    """The average rank of x among `total` rows, as a share: (rank + last rank of its peers) / 2 / total.

    w orders by x, nulls where the caller wants them.
    """
    peers = F.count(F.lit(1)).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    return (F.rank().over(w) + peers) / F.lit(2.0) / total
