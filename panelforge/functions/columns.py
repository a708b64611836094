"""Column helpers shared by all operators."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

PRECEDING, FOLLOWING = Window.unboundedPreceding, Window.unboundedFollowing


def div(a, b) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a if isinstance(a, Column) else F.col(a), b if isinstance(b, Column) else F.col(b))


def trailing(spec, n: int, skip: int = 0):
    """The last n rows, the current one included unless ``skip`` rows are left out."""
    return spec.rowsBetween(-(n - 1) - skip, -skip)


def enough(x: Column, frame, n: int, value: Column) -> Column:
    """``value`` where the frame holds at least n values of x, else null."""
    return F.when(F.count(x).over(frame) >= n, value)


def pct_rank(x: str, by: list[str]) -> Column:
    """Average rank of x as a share of its group's values."""
    part = Window.partitionBy(*by)
    ties = F.count(x).over(Window.partitionBy(*by, x))
    return F.when(F.col(x).isNotNull(), (F.rank().over(part.orderBy(F.col(x).asc_nulls_last())) + (ties - 1) / 2) / F.count(x).over(part))


def avg_rank(x: str, by: list[str]) -> Column:
    """Average rank of x within its group (all values present)."""
    return F.rank().over(Window.partitionBy(*by).orderBy(x)) + (F.count(x).over(Window.partitionBy(*by, x)) - 1) / 2.0


def qcut_bin(r: Column, n: Column, q: int) -> Column:
    """Quantile bin of the row with first-rank r of n, from 0."""
    return F.greatest(F.ceil(div((r - 1) * q, n - 1)) - 1, F.lit(0)).cast("int")


def floor_bin(r: Column, n: Column, q: int) -> Column:
    return F.least(F.floor((r - 1) * q / n), F.lit(q - 1)).cast("int")


def edge_bin(x: Column, edges: Column) -> Column:
    """Number of edges below x: the bin i with edge[i-1] < x <= edge[i]."""
    return F.size(F.filter(edges, lambda e: e < x)).cast("int")

