"""Features that combine two parents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.columns import div


def condition(x: Column, comparator: str, threshold: float) -> Column:
    """Null where x is null."""
    return {"ge": x >= threshold, "gt": x > threshold, "le": x <= threshold, "lt": x < threshold, "eq": x == threshold}[comparator]


def intersection(a: Column, b: Column) -> Column:
    """1 where both hold, 0 where not, null where either is unknown."""
    return F.when(a.isNotNull() & b.isNotNull(), (a & b).cast("int"))


def gated(anchor: Column, gate: Column) -> Column:
    return F.when(gate, anchor)


def aligned(a: Column, b: Column, up_a: int = 1, up_b: int = 1) -> Column:
    """Mean of two ranks centred at 0 and turned to the same direction."""
    return (up_a * (2 * a - 1) + up_b * (2 * b - 1)) / 2


def persistent(now: Column, spec, at: str, steps: int = 1) -> Column:
    """The condition now and exactly ``steps`` bars before, in the same session."""
    before = F.when(F.lag(at, steps).over(spec) == F.col(at) - steps, F.lag(now, steps).over(spec))
    return intersection(now, before)


def features(ranked: DataFrame) -> DataFrame:
    w = Window.partitionBy("symbol", "session").orderBy("slot")
    ra, rb = F.col("ra"), F.col("rb")
    return ranked.select("symbol", "session", "slot", intersection(condition(ra, "ge", 0.6), condition(rb, "ge", 0.6)).alias("joint"), gated(F.col("ret_1"), condition(rb, "ge", 0.6)).alias("gated"), aligned(ra, rb, 1, -1).alias("aligned"), persistent(condition(ra, "ge", 0.5), w, "slot").alias("persistent"))


def parent_correlation(wide: DataFrame, names: tuple) -> DataFrame:
    """Pearson correlation of every two features over rows with both: one pass, no self-join."""
    pairs = [(a, b) for i, a in enumerate(sorted(names)) for b in sorted(names)[i + 1 :]]
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")) for a, b in pairs])
    out = wide.select(F.explode(rows).alias("p")).select("p.*").where("x is not null and y is not null")
    return out.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), div(F.covar_pop("x", "y"), F.sqrt(F.var_pop("x") * F.var_pop("y"))).alias("corr"))
