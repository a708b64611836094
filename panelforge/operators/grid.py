"""Every feature against every target of a dense panel, session by session: ranks, bins, daily series, and tests of
their means with errors for overlapping horizons.

A session is one group, of at most all securities. Its task ranks each feature once and meets all targets in blocks, so
the shuffle moves the panel once, and what leaves a task is a row for each pair, not for each security and pair. Tests
then run over series of one row a session, keyed by (feature, target, test): a window whose range is exactly k places
back finds the value k sessions before, or nothing where the calendar has a gap, for all pairs at once."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.columns import div
from panelforge.operators.bulk import matrix
from panelforge.operators.screening import normal_p

TESTS = ("rank_ic", "top_minus_bottom_decile", "top_decile_minus_middle", "middle_minus_bottom_decile")
VALUES = (*TESTS, "quintile_spread", "ic_size", "top_coverage", "middle_coverage", "bottom_coverage")
KEY = ["feature", "target", "test_type"]


@dataclass(frozen=True)
class Gates:
    """What a session needs: securities to rank and to bin, distinct values, valid outcomes in outer bins and shares of them."""

    ranked: int = 50
    decile: int = 80
    quintile: int = 50
    ic: int = 50
    extreme: int = 5
    quintile_extreme: int = 8
    coverage: float = 0.5
    middle_coverage: float = 0.75


def average_rank(x: np.ndarray) -> np.ndarray:
    """Ranks from 1 of values without gaps; equal values share their mean rank."""
    order = np.argsort(x, kind="stable")
    new = np.concatenate(([True], x[order][1:] != x[order][:-1]))
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(x)))
    out = np.empty(len(x))
    out[order] = np.repeat(first + (size + 1) / 2, size)
    return out


def binned(x: np.ndarray, ids: np.ndarray, q: int) -> np.ndarray:
    """Bins of equal numbers by value, then id; earlier bins take what is left over. -1 where there is no value."""
    out = np.full(len(x), -1)
    held = np.flatnonzero(~np.isnan(x))
    order = held[np.lexsort((ids[held], x[held]))]
    out[order] = np.repeat(np.arange(q), [len(order) // q + (i < len(order) % q) for i in range(q)])
    return out


def correlation(x: np.ndarray, y: np.ndarray) -> float:
    a, b = average_rank(x), average_rank(y)
    a, b = a - a.mean(), b - b.mean()
    scale = np.sqrt((a @ a) * (b @ b))
    return float(a @ b / scale) if scale > 0 else np.nan


def session_values(x: np.ndarray, y: np.ndarray, ids: np.ndarray, g: Gates) -> np.ndarray:
    """(VALUES, targets) of one feature in one session."""
    out = np.full((len(VALUES), y.shape[1]), np.nan)
    held = ~np.isnan(x)
    n, distinct = held.sum(), len(np.unique(x[held]))
    here = ~np.isnan(y)
    filled = np.where(here, y, 0.0)
    if n >= g.ranked and distinct >= 2:
        for j in range(y.shape[1]):
            both = held & here[:, j]
            out[5, j] = both.sum()
            if both.sum() >= g.ic and len(np.unique(x[both])) >= 2 and len(np.unique(y[both, j])) >= 2:
                out[0, j] = correlation(x[both], y[both, j])
    else:
        out[5] = 0

    def part(mask: np.ndarray, least: int, share: float) -> tuple:
        count = mask.astype(float) @ here
        with np.errstate(divide="ignore", invalid="ignore"):
            cover = count / mask.sum()
            return np.where((count >= least) & (cover >= share), (mask.astype(float) @ filled) / count, np.nan), cover

    if n >= g.decile and distinct >= 10:
        d = binned(x, ids, 10)
        top, out[6] = part(d == 9, g.extreme, g.coverage)
        middle, out[7] = part((d >= 1) & (d <= 8), g.extreme, g.middle_coverage)
        bottom, out[8] = part(d == 0, g.extreme, g.coverage)
        out[1], out[2], out[3] = top - bottom, top - middle, middle - bottom
    if n >= g.quintile and distinct >= 5:
        q = binned(x, ids, 5)
        out[4] = part(q == 4, g.quintile_extreme, g.coverage)[0] - part(q == 0, g.quintile_extreme, g.coverage)[0]
    return out


def daily_series(panel: DataFrame, features: list[str], targets: list[str], gates: Gates = Gates()) -> DataFrame:
    """One row a session (t), feature and target with VALUES, from a panel of security, session, t and all columns."""

    def run(table: pa.Table) -> pa.Table:
        batch = table.combine_chunks().to_batches()[0]
        x, y = matrix(batch, tuple(features)), matrix(batch, tuple(targets))
        ids = batch.column(batch.schema.get_field_index("security")).to_numpy(zero_copy_only=False)
        found = np.stack([session_values(x[:, i], y, ids, gates) for i in range(len(features))])  # feature, value, target
        flat = found.transpose(1, 0, 2).reshape(len(VALUES), -1)
        t = batch.column(batch.schema.get_field_index("t"))[0].as_py()
        columns = {"t": pa.array(np.full(flat.shape[1], t, np.int32)), "feature": pa.array(np.repeat(features, len(targets)).tolist()), "target": pa.array(targets * len(features))}
        return pa.table(columns | {n: pa.array(v, mask=np.isnan(v)) for n, v in zip(VALUES, flat, strict=True)})

    shape = "t int, feature string, target string, " + ", ".join(f"{n} double" for n in VALUES)
    return panel.select("security", F.col("t").cast("int"), *features, *targets).groupBy("t").applyInArrow(run, shape)


def mean_tests(series: DataFrame, by: list[str], x: str, lag: Column, most: int, sessions: int) -> DataFrame:
    """Mean of each keyed series with a Newey-West error of ``lag`` places (at most ``most``), by the calendar of ``sessions``
    places: a lag's covariance is the mean over the places that have both values. Too short, or negative variance: null."""
    part = Window.partitionBy(*by)
    s = series.where(F.col(x).isNotNull()).withColumn("lag", F.least(lag, F.lit(sessions - 1))).withColumn("d", F.col(x) - F.avg(x).over(part))
    at = part.orderBy("t")
    before = [F.sum("d").over(at.rangeBetween(-k, -k)) for k in range(1, most + 1)]
    s = s.select("*", *[(F.col("d") * b).alias(f"g{k}") for k, b in enumerate(before, 1)])
    e = F.col(x)
    g = s.groupBy(*by, "lag").agg(
        F.count(F.lit(1)).alias("n"), F.avg(e).alias("effect"), F.median(e).alias("median"), F.stddev_samp(e).alias("std"), F.avg((e > 0).cast("double")).alias("positive_fraction"),
        F.avg(F.col("d") * F.col("d")).alias("g0"), *[F.avg(f"g{k}").alias(f"g{k}") for k in range(1, most + 1)],
    )
    v = F.col("g0")
    for k in range(1, most + 1):
        v = v + 2 * F.greatest(1 - F.lit(k) / (F.col("lag") + 1), F.lit(0.0)) * F.coalesce(f"g{k}", F.lit(0.0))
    ok = (F.col("n") >= F.greatest(F.lit(20), F.col("lag") + 5)) & (v >= -1e-12)
    se = F.when(ok, F.sqrt(F.greatest(v, F.lit(0.0)) / F.col("n")))
    kept = [F.when(ok, F.col(c)).alias(c) for c in ("effect", "median", "std", "positive_fraction")]
    out = g.select(*by, "n", *kept, se.alias("se"), div(F.col("effect"), F.when(se > 0, se)).alias("t"))
    return out.withColumn("p", normal_p("t"))


def overlap(target: Column, horizons: dict[str, int]) -> Column:
    """Places by which a target's intervals overlap: its horizon, five at least."""
    return F.greatest(F.lit(5), F.create_map(*[F.lit(v) for kv in horizons.items() for v in kv])[target])


def pair_grid(panel: DataFrame, daily: DataFrame, features: list[str], horizons: dict[str, int], sessions: int) -> DataFrame:
    """One row a feature, target and test: dates, mean, error, t, p, with the pair's sizes, coverages, quintile spread and
    distinct securities. ``horizons``: targets with their sessions; ``sessions``: places of the calendar."""
    values = F.array(*[F.struct(F.lit(t).alias("test_type"), F.col(t).alias("e")) for t in TESTS])
    series = daily.select("t", "feature", "target", F.explode(values).alias("v")).select("t", "feature", "target", "v.*")
    found = mean_tests(series, KEY, "e", overlap(F.col("target"), horizons), max(5, *horizons.values()), sessions)
    every = daily.select("feature", "target").distinct().crossJoin(F.broadcast(series.sparkSession.createDataFrame([(t,) for t in TESTS], "test_type string")))
    more = daily.groupBy("feature", "target").agg(F.avg("quintile_spread").alias("quintile_spread"), F.avg("ic_size").alias("mean_ic_size"), *[F.avg(c).alias(f"mean_{c}") for c in VALUES[6:]])
    held = panel.select("security", *[F.col(f).isNotNull().alias(f) for f in features], *[F.col(t).isNotNull().alias(t) for t in horizons])
    met = F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(t).alias("target"), F.max((F.col(f) & F.col(t)).cast("int")).alias("met")) for f in features for t in horizons])
    seen = held.groupBy("security").agg(met.alias("p")).select(F.explode("p").alias("p")).select("p.*").groupBy("feature", "target").agg(F.sum("met").alias("distinct_securities"))
    return every.join(found, KEY, "left").withColumn("n", F.coalesce("n", F.lit(0))).join(more, ["feature", "target"]).join(seen, ["feature", "target"])


def fold_tests(daily: DataFrame, panel: DataFrame, cuts: dict[str, tuple[int, int]], horizons: dict[str, int], expected: DataFrame, least: int = 20) -> DataFrame:
    """Effects within folds (name: first place, first place after), of decisions whose entry (the next place) and exit (the
    horizon on) lie in the fold too, and whether the sign of ``expected`` (feature, target, test_type, effect) is kept by
    at least ``least`` values. A recent window is a fold that ends with the calendar."""
    last = panel.agg(F.max("t")).first()[0]
    values = F.array(*[F.struct(F.lit(t).alias("test_type"), F.col(t).alias("e")) for t in TESTS])
    s = daily.select("t", "feature", "target", F.explode(values).alias("v")).select("t", "feature", "target", "v.*")
    horizon = F.create_map(*[F.lit(v) for kv in horizons.items() for v in kv])[F.col("target")]
    inside = [F.when((F.col("t") >= a) & (F.col("t") < b) & (F.col("t") + horizon < b) & (F.col("t") + horizon <= last), F.lit(name)) for name, (a, b) in cuts.items()]
    s = s.where("e is not null").withColumn("fold", F.explode(F.array(*inside))).where("fold is not null")
    f = s.groupBy(*KEY, "fold").agg(F.count(F.lit(1)).alias("n"), F.avg("e").alias("fold_effect"))
    kept = (F.col("n") >= least) & (F.signum("fold_effect") == F.signum("effect"))
    return f.join(expected.select(*KEY, "effect"), KEY).select(*KEY, "fold", "n", "fold_effect", F.coalesce(kept, F.lit(False)).alias("sign_kept"))
