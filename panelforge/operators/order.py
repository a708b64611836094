"""Exact order statistics of large groups, without sorting a group in one task.

Mergeable summaries give each group some values that cut it into buckets of about equal size. One aggregate counts the
rows of each bucket; cumulative counts tell which bucket holds a wanted rank and which place it has there; only rows of
these buckets are sorted, each bucket by itself. A value that is itself a cut is a bucket of its own, so ties never make
a bucket large: where ties have an order, such a bucket is counted again by the first tie column (a session), else its
value is known without sorting. Windows run over counts of buckets, never over a group's rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 64
ACCURACY = 10_000


def cuts(rows: DataFrame, by: list[str], value: str, buckets: int) -> DataFrame:
    """(by, n, cuts): rows of each group, and values that lie near its quantiles."""
    at = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.array_distinct(F.percentile_approx(F.col(value).cast("double"), at, ACCURACY)).alias("cuts"))


def bucketed(rows: DataFrame, groups: DataFrame, by: list[str], value: str, first: Column) -> DataFrame:
    """Rows with the bucket of their value (odd: the value is a cut) and, in odd buckets, ``first`` as ``sub``."""
    x = F.col(value).cast("double")
    below, on = F.size(F.filter("cuts", lambda c: c < x)), F.array_contains("cuts", x)
    out = rows.join(groups, by).withColumn("bucket", 2 * below + on.cast("int"))
    return out.withColumn("sub", F.when(F.col("bucket") % 2 == 1, first.cast("string")).otherwise(F.lit(""))).drop("cuts", "n")


def located(held: DataFrame, groups: DataFrame, by: list[str], ranks: Callable[[Column], Column]) -> DataFrame:
    """(by, bucket, sub, i, k): in which bucket the i-th wanted rank lies, and at which place there."""
    cell = [*by, "bucket", "sub"]
    counts = held.groupBy(*cell).agg(F.count(F.lit(1)).alias("rows"))
    upto = F.sum("rows").over(Window.partitionBy(*by).orderBy("bucket", "sub"))
    counts = counts.withColumn("upto", upto)
    asked = groups.select(*by, F.posexplode(ranks(F.col("n"))).alias("i", "rank"))
    met = counts.join(asked, by).where((F.col("rank") <= F.col("upto")) & (F.col("rank") > F.col("upto") - F.col("rows")))
    return met.select(*cell, "i", (F.col("rank") - F.col("upto") + F.col("rows")).alias("k"))


def at_ranks(rows: DataFrame, by: list[str], value: str, ties: list[str], ranks: Callable[[Column], Column], buckets: int = BUCKETS) -> DataFrame:
    """(by, i, at): the row at each rank ``ranks(n)`` (from 1) in the order of value and ties, as a struct of these."""
    groups = cuts(rows, by, value, buckets)
    cell = [*by, "bucket", "sub"]
    held = bucketed(rows, groups, by, value, F.col(ties[0]))
    place = located(held, groups, by, ranks)
    inside = held.join(place.select(*cell).distinct(), cell, "left_semi")
    at = F.struct(F.col(value).cast("double").alias("x"), *ties)
    inside = inside.select(*cell, at.alias("at"), F.row_number().over(Window.partitionBy(*cell).orderBy(F.col(value).cast("double"), *ties)).alias("k"))
    return inside.join(place, [*cell, "k"]).select(*by, "i", "at")


def quantiles(rows: DataFrame, by: list[str], value: str, shares: list[float], buckets: int = BUCKETS) -> DataFrame:
    """(by, n, quantiles): interpolated quantiles of each group's values (no nulls), as an array in the order of ``shares``."""
    groups = cuts(rows, by, value, buckets)
    cell = [*by, "bucket", "sub"]
    held = bucketed(rows, groups, by, value, F.lit(""))

    def ranks(n: Column) -> Column:
        low = [F.floor(F.lit(q) * (n - 1)) for q in shares]
        return F.array(*[v for x in low for v in (x + 1, F.least(x + 2, n))]).cast("array<long>")

    place = located(held, groups, by, ranks)
    wanted = place.select(*cell).distinct()
    x = F.col(value).cast("double")
    values = held.join(wanted, cell, "left_semi").groupBy(*cell, x.alias("x")).agg(F.count(F.lit(1)).alias("rows"))
    upto = F.sum("rows").over(Window.partitionBy(*cell).orderBy("x"))
    met = values.withColumn("upto", upto).join(place, cell).where((F.col("k") <= F.col("upto")) & (F.col("k") > F.col("upto") - F.col("rows")))
    found = met.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("i", "x"))).alias("at")).join(groups.select(*by, "n"), by)
    parts = []
    for i, q in enumerate(shares):
        h = F.lit(q) * (F.col("n") - 1)
        low, high = F.col("at")[2 * i], F.col("at")[2 * i + 1]
        parts.append(low + (high - low) * (h - F.floor(h)))
    return found.select(*by, "n", F.array(*parts).alias("quantiles"))


def bins(rows: DataFrame, by: list[str], value: str, ties: list[str], last: Callable[[Column], list[Column]], name: str = "bin", buckets: int = BUCKETS) -> DataFrame:
    """``rows`` with the number of the bin of their rank; ``last(n)`` are the last ranks of all bins but one."""
    found = at_ranks(rows, by, value, ties, lambda n: F.array(*[c.cast("long") for c in last(n)]), buckets)
    edges = found.groupBy(*by).agg(F.collect_list("at").alias("edges"))
    at = F.struct(F.col(value).cast("double").alias("x"), *ties)
    out = rows.join(edges, by)
    return out.withColumn(name, F.size(F.filter("edges", lambda e: e < at)).cast("int")).drop("edges")


def qcut_last(q: int) -> Callable[[Column], list[Column]]:
    """Last ranks of q quantile bins whose edges are interpolated between first and last rank."""
    return lambda n: [F.floor(F.lit(k + 1) * (n - 1) / q) + 1 for k in range(q - 1)]


def floor_last(q: int) -> Callable[[Column], list[Column]]:
    """Last ranks of q bins of equal numbers of rows."""
    return lambda n: [F.greatest(F.ceil(F.lit(k + 1) * n / q), F.lit(1)) for k in range(q - 1)]


def average_ranks(rows: DataFrame, by: list[str], value: str, name: str, buckets: int = BUCKETS) -> DataFrame:
    """``rows`` with the average rank of their value: what lies in lower buckets, plus what lies below within the bucket.

    Equal values are counted before they are ranked, so a window holds the distinct values of a bucket."""
    groups = cuts(rows, by, value, buckets)
    held = bucketed(rows, groups, by, value, F.lit("")).withColumn("x_", F.col(value).cast("double"))
    cell = [*by, "bucket"]
    values = held.groupBy(*cell, "x_").agg(F.count(F.lit(1)).alias("same"))
    totals = values.groupBy(*cell).agg(F.sum("same").alias("rows"))
    before = F.coalesce(F.sum("rows").over(Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = totals.select(*cell, before.alias("before"))
    within = F.sum("same").over(Window.partitionBy(*cell).orderBy("x_"))
    ranked = values.withColumn("within", within).join(totals, cell).select(*cell, "x_", (F.col("before") + F.col("within") - (F.col("same") - 1) / 2.0).alias(name))
    return held.join(ranked, [*cell, "x_"]).drop("bucket", "sub", "x_")


def approximate_ranks(rows: DataFrame, by: list[str], value: str, name: str, buckets: int = 4 * BUCKETS) -> DataFrame:
    """``rows`` with the average rank of their bucket in place of their value's own: nothing is sorted within a bucket. Ranks
    are exact for a value that is a cut, so in groups of fewer distinct values than buckets, and else off by less than a bucket."""
    held = bucketed(rows, cuts(rows, by, value, buckets), by, value, F.lit(""))
    counts = held.groupBy(*by, "bucket").agg(F.count(F.lit(1)).alias("same"))
    upto = F.sum("same").over(Window.partitionBy(*by).orderBy("bucket"))
    ranked = counts.select(*by, "bucket", (upto - (F.col("same") - 1) / 2.0).alias(name))
    return held.join(ranked, [*by, "bucket"]).drop("bucket", "sub")
