"""Screens of every feature against every target, with clustered errors, coverage and false-discovery control."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelforge.functions.columns import FOLLOWING, avg_rank, div, pct_rank
from panelforge.operators import order
from panelforge.sources.shared import cut

FEATURES = ("ret_1", "vol_3", "range_pos_3", "rel_vol_3")
TARGETS = ("fwd_1", "fwd_2")
PAIR = ["feature", "target"]


def long_pairs(features: DataFrame, targets: DataFrame, names: tuple = FEATURES, goals: tuple = TARGETS) -> DataFrame:
    """One row for each row key, feature and target with both values present: an equi-join on keys, then two unpivots."""
    both = features.join(targets, ["symbol", "session", "slot"])
    x = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in names])
    y = F.array(*[F.struct(F.lit(t).alias("target"), F.col(t).cast("double").alias("y")) for t in goals])
    out = both.select("symbol", "session", "slot", F.explode(x).alias("f"), y.alias("ys")).where("f.x is not null")
    return out.select("symbol", "session", "slot", "f.feature", "f.x", F.explode("ys").alias("t")).select("symbol", "session", "slot", "feature", "x", "t.target", "t.y").where("y is not null")


def moments(pairs: DataFrame) -> DataFrame:
    vx, vy, cov = F.var_pop("x"), F.var_pop("y"), F.covar_pop("x", "y")
    mx = F.avg("x")
    out = pairs.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("n"), mx.alias("mean_x"), F.avg("y").alias("mean_y"), vx.alias("var_x"), vy.alias("var_y"), div(cov, F.sqrt(vx * vy)).alias("pearson"), F.regr_slope("y", "x").alias("slope"))
    return out.withColumn("status", F.when(F.col("var_x") < 1e-14, "constant_feature").when(F.col("n") < 30, "insufficient_data").otherwise("screened"))


def coverage(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("session").alias("n_sessions"), F.countDistinct("symbol").alias("n_symbols"), F.countDistinct("session", "slot").alias("n_decisions"))


def cell_scores(pairs: DataFrame) -> DataFrame:
    """One row a pair, session and symbol: its rows, and their part s of the score of the pair's slope.

    The rows are read once. A cell keeps central moments, and only cells are moved to the pair's means, so a feature far
    from zero or of any unit loses no digits; both clusterings are sums of cells."""
    n = F.count(F.lit(1))
    g = pairs.groupBy(*PAIR, "session", "symbol").agg(n.alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), (n * F.var_pop("x")).alias("sxx"), (n * F.covar_pop("x", "y")).alias("sxy"))
    w = Window.partitionBy(*PAIR)  # cells of a pair, not its rows
    mean = lambda c: F.sum(F.col("n") * F.col(c)).over(w) / F.sum("n").over(w)
    g = g.withColumn("dx", F.col("mx") - mean("mx")).withColumn("dy", F.col("my") - mean("my"))
    g = g.withColumn("cxx", F.col("sxx") + F.col("n") * F.col("dx") * F.col("dx")).withColumn("cxy", F.col("sxy") + F.col("n") * F.col("dx") * F.col("dy"))
    g = g.withColumn("t_xx", F.sum("cxx").over(w)).withColumn("slope", div(F.sum("cxy").over(w), F.col("t_xx")))
    return g.select(*PAIR, "session", "symbol", "n", "slope", F.col("t_xx").alias("cxx"), (F.col("cxy") - F.col("slope") * F.col("cxx")).alias("s"))


def clustered(cells: DataFrame, by: list[str]) -> DataFrame:
    """Squared scores of clusters, summed over a pair."""
    g = cells.groupBy(*PAIR, *by).agg(F.sum("s").alias("s"), F.sum("n").alias("n"), F.first("slope").alias("slope"), F.first("cxx").alias("cxx"))
    return g.groupBy(*PAIR).agg(F.first("slope").alias("slope"), F.first("cxx").alias("cxx"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("g"), F.sum(F.col("s") * F.col("s")).alias("q"))


def one_way(pairs: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    s = clustered(cell_scores(pairs) if cells is None else cells, ["session"])
    se = div(F.sqrt("q"), F.col("cxx"))
    return s.select(*PAIR, "n", F.col("g").alias("n_clusters"), "slope", se.alias("se"), div(F.col("slope"), se).alias("t"))


def two_way(pairs: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """Session plus symbol minus their meet, each with its small-sample factor; what is left of less than a billionth of
    the three is rounding noise and no variance, whatever the unit of the feature."""
    cells, parts = cut(cell_scores(pairs)) if cells is None else cells, None
    for name, by in (("d", ["session"]), ("s", ["symbol"]), ("x", ["session", "symbol"])):
        c = clustered(cells, by)
        v = div(F.col("g"), F.col("g") - 1) * div(F.col("n") - 1, F.col("n") - 2) * div(F.col("q"), F.col("cxx") * F.col("cxx"))
        c = c.select(*PAIR, *(["slope", "n"] if name == "d" else []), v.alias(f"v_{name}"))
        parts = c if parts is None else parts.join(c, PAIR)
    total, all_ = F.col("v_d") + F.col("v_s") - F.col("v_x"), F.col("v_d") + F.col("v_s") + F.col("v_x")
    se = F.when(total.isNotNull(), F.sqrt(F.when(total > 1e-9 * all_, total).otherwise(F.lit(0.0))))
    return parts.select(*PAIR, "n", "slope", se.alias("se"), div(F.col("slope"), se).alias("t"))


def clustered_screen(pairs: DataFrame) -> DataFrame:
    """A pair's slope with both kinds of errors, and the two-sided normal p of each t."""
    cells = cut(cell_scores(pairs))  # three groupings of these: the rows are read once
    both = one_way(pairs, cells).join(two_way(pairs, cells).select(*PAIR, F.col("se").alias("se_two_way"), F.col("t").alias("t_two_way")), PAIR)
    return both.withColumn("p", normal_p("t")).withColumn("p_two_way", normal_p("t_two_way"))


def binary_effect(pairs: DataFrame) -> DataFrame:
    on, off = F.col("x") == 1, F.col("x") == 0
    out = pairs.groupBy(*PAIR).agg(F.count_if(on).alias("n_on"), F.count_if(off).alias("n_off"), F.count_if(~F.col("x").isin(0.0, 1.0)).alias("n_bad"), F.avg(F.when(on, F.col("y"))).alias("mean_on"), F.avg(F.when(off, F.col("y"))).alias("mean_off"), F.countDistinct(F.when(on, F.col("session"))).alias("on_sessions"), F.countDistinct(F.when(off, F.col("session"))).alias("off_sessions"))
    return out.withColumn("effect", F.col("mean_on") - F.col("mean_off")).withColumn("activation", div(F.col("n_on"), F.col("n_on") + F.col("n_off")))


TIES = ["session", "slot", "symbol"]


def quantile_table(pairs: DataFrame, q: int = 10, name: str = "bin") -> DataFrame:
    """``pairs`` with their quantile bin (``floor``: bins of equal numbers) by first-ranks in a total order; a pair's rows
    are never sorted in one task. They are read three times, so they are computed once."""
    return order.bins(cut(pairs), PAIR, "x", TIES, order.floor_last(q) if name == "floor" else order.qcut_last(q), name)


def bin_means(pairs: DataFrame, q: int = 10) -> DataFrame:
    return quantile_table(pairs, q).groupBy(*PAIR, "bin").agg(F.avg("y").alias("m"), F.count(F.lit(1)).alias("n"))


def spread_of(means: DataFrame) -> DataFrame:
    """Last bin's mean less the first's, for pairs of at least 20 rows, from ``bin_means``."""
    t = means.groupBy(*PAIR).agg((F.max(F.when(F.col("bin") == 9, F.col("m"))) - F.max(F.when(F.col("bin") == 0, F.col("m")))).alias("spread"), F.sum("n").alias("n"))
    return t.withColumn("spread", F.when(F.col("n") >= 20, F.col("spread")))


def monotonicity_of(means: DataFrame) -> DataFrame:
    t = means.withColumn("r", avg_rank("m", PAIR))  # ten rows a pair
    b = F.col("bin").cast("double")
    return t.groupBy(*PAIR).agg(div(F.covar_pop(b, "r"), F.sqrt(F.var_pop(b) * F.var_pop("r"))).alias("monotonicity"))


def decile_spread(pairs: DataFrame) -> DataFrame:
    return spread_of(bin_means(pairs))


def monotonicity(pairs: DataFrame) -> DataFrame:
    return monotonicity_of(bin_means(pairs))


def rank_ic(pairs: DataFrame, least: int = 5) -> DataFrame:
    """Rank correlation within each decision, for decisions with enough rows."""
    by = [*PAIR, "session", "slot"]
    out = pairs.withColumn("rx", avg_rank("x", by)).withColumn("ry", avg_rank("y", by))
    return out.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), div(F.covar_pop("rx", "ry"), F.sqrt(F.var_pop("rx") * F.var_pop("ry"))).alias("ic")).where(f"n >= {least}")


def hac(series: DataFrame, by: list[str], at: str, x: str, lag: int | None = None) -> DataFrame:
    """Bartlett-weighted variance of a mean, values compacted in order: arrays of one series' length, one a group."""
    s = series.where(F.col(x).isNotNull()).groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct(at, x))), lambda e: e[x]).alias("v"))
    n = F.size("v")
    s = s.withColumn("n", n).withColumn("mean", F.aggregate("v", F.lit(0.0), lambda a, e: a + e) / F.col("n")).withColumn("d", F.transform("v", lambda e: e - F.col("mean")))
    L = F.lit(lag) if lag is not None else F.greatest(F.lit(1), F.floor(4 * F.pow(F.col("n") / 100.0, F.lit(2.0 / 9))).cast("int"))
    s = s.withColumn("lag", L)

    def gamma(k: Column) -> Column:
        left = F.slice("d", 1, F.greatest(F.col("n") - k, F.lit(0)))
        right = F.slice("d", k + 1, F.greatest(F.col("n") - k, F.lit(0)))
        return F.aggregate(F.zip_with(left, right, lambda a, b: a * b), F.lit(0.0), lambda a, e: a + e) / F.col("n")

    tail = F.aggregate(F.transform(F.sequence(F.lit(1), F.col("lag")), lambda k: (1 - k / (F.col("lag") + 1.0)) * gamma(k)), F.lit(0.0), lambda a, e: a + e)
    se = F.sqrt(F.greatest(gamma(F.lit(0)) + 2 * tail, F.lit(0.0)) / F.col("n"))
    return s.select(*by, "n", "lag", "mean", se.alias("se"), div(F.col("mean"), se).alias("t"))


# Coefficients of a rational Chebyshev fit of erfc (Numerical Recipes), relative error below 1.2e-7.
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def normal_p(t: str | Column) -> Column:
    """Two-sided normal tail probability of a statistic, by arithmetic alone; null for null."""
    z = F.abs(F.col(t) if isinstance(t, str) else t) / math.sqrt(2)
    u = 1 / (1 + 0.5 * z)
    fit = F.lit(ERFC[-1])
    for c in reversed(ERFC[:-1]):
        fit = F.lit(c) + u * fit
    return u * F.exp(-z * z + fit)


def normal_p_sql(t: str) -> str:
    """The same as SQL text."""
    z = f"(abs({t}) / sqrt(2.0::double))"
    u = f"(1 / (1 + 0.5::double * {z}))"
    fit = f"({ERFC[-1]}::double)"
    for c in reversed(ERFC[:-1]):
        fit = f"({c}::double + {u} * {fit})"
    return f"{u} * exp(-{z} * {z} + {fit})"


def bh(rows: DataFrame, p: str, by: list[str], out: str = "fdr") -> DataFrame:
    """Benjamini-Hochberg within a family: the least of p m / rank over this and all later ranks."""
    w = Window.partitionBy(*by).orderBy(F.col(p).asc_nulls_last(), *[c for c in PAIR if c not in by])
    m = F.count(p).over(Window.partitionBy(*by))
    ranked = rows.withColumn("__q", F.when(F.col(p).isNotNull(), F.col(p) * m / F.row_number().over(w)))
    return ranked.withColumn(out, F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.min("__q").over(w.rowsBetween(0, FOLLOWING))))).drop("__q")


def bootstrap(series: DataFrame, by: list[str], x: str, draws: int = 200, seed: int = 20260714) -> DataFrame:
    """Percentile interval of the mean of a group's values (one value a session: a group is small)."""
    fields = ", ".join(f"{c} {t}" for c, t in series.select(*by).dtypes)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        v = np.sort(g[x].dropna().to_numpy())
        means = np.random.default_rng(seed).choice(v, (draws, len(v))).mean(1) if len(v) else np.array([np.nan])
        return pd.DataFrame([[*g.iloc[0][by], len(v), *np.quantile(means, [0.025, 0.975])]], columns=[*by, "n", "low", "high"])

    return series.groupBy(*by).applyInPandas(run, f"{fields}, n long, low double, high double")


def wald(pairs: DataFrame, category: str) -> DataFrame:
    """Chi-square of equal category means with errors clustered by session: category sums in Spark, a small system a pair."""
    sums = pairs.groupBy(*PAIR, "session", category).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("sy"))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        n, y = g.pivot_table(index="session", columns=category, values="n", fill_value=0), g.pivot_table(index="session", columns=category, values="sy", fill_value=0)
        mean = y.sum() / n.sum()
        score = (y - n * mean) / n.sum()
        cov = score.T.to_numpy() @ score.to_numpy()
        k = len(mean)
        c = np.hstack([np.eye(k - 1), -np.ones((k - 1, 1))]) if k > 1 else np.zeros((0, k))
        d = c @ mean.to_numpy()
        stat = float(d @ np.linalg.pinv(c @ cov @ c.T) @ d) if k > 1 else np.nan
        return pd.DataFrame({"feature": [g.feature.iloc[0]], "target": [g.target.iloc[0]], "k": [k], "wald": [stat], "range": [float(mean.max() - mean.min())]})

    return sums.groupBy(*PAIR).applyInPandas(run, "feature string, target string, k long, wald double, range double")


#: Family of each screened feature.
FAMILIES = {"ret_1": "price", "range_pos_3": "price", "vol_3": "volatility", "rel_vol_3": "volume"}


def finalised(screen: DataFrame, families: dict[str, str] = FAMILIES) -> DataFrame:
    """Families, global and family FDR, and an anomaly score from spread, FDR and monotonicity. Screen rows, one a pair."""
    named = F.coalesce(F.create_map(*[F.lit(x) for kv in families.items() for x in kv])[F.col("feature")], F.lit("other"))
    s = bh(bh(screen.withColumn("family", named), "p", ["one"], "global_fdr"), "p", ["family", "target"], "family_fdr")
    s = s.withColumn("size", F.abs("spread")).withColumn("rank", pct_rank("size", ["one"]))
    return s.withColumn("score", 0.4 * F.col("rank") + 0.35 * (1 - F.col("global_fdr")) + 0.25 * F.abs("monotonicity")).drop("size", "rank")


def capped(rows: DataFrame, by: list[str], order: list[Column], most: int) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("place") <= most)


def recent_periods(pairs: DataFrame, cuts: dict[str, str]) -> DataFrame:
    """Slopes over periods that start at given sessions; a row belongs to every period that it reaches."""
    labels = F.array(*[F.when(F.col("session") >= start, F.lit(name)) for name, start in cuts.items()])
    return pairs.withColumn("period", F.explode(labels)).where("period is not null").groupBy(*PAIR, "period").agg(F.count(F.lit(1)).alias("n"), F.regr_slope("y", "x").alias("slope"))


def recency_weighted(pairs: DataFrame, last: str, half_life: float = 10.0) -> DataFrame:
    w = F.exp(-math.log(2) * F.datediff(F.lit(last).cast("date"), F.to_date("session")) / half_life)
    p = pairs.withColumn("w", w)
    return p.groupBy(*PAIR).agg(div(F.sum(F.col("w") * F.col("y")), F.sum("w")).alias("weighted_mean"), div(F.sum("w") * F.sum("w"), F.sum(F.col("w") * F.col("w"))).alias("effective_n"))


def concentration(pairs: DataFrame) -> DataFrame:
    """Shares of symbols in a pair's absolute effect: largest, top three, Herfindahl."""
    s = pairs.groupBy(*PAIR, "symbol").agg(F.abs(F.sum(F.col("x") * F.col("y"))).alias("e"))
    s = s.withColumn("share", div(F.col("e"), F.sum("e").over(Window.partitionBy(*PAIR)))).withColumn("r", F.row_number().over(Window.partitionBy(*PAIR).orderBy(F.desc("share"), "symbol")))
    return s.groupBy(*PAIR).agg(F.max("share").alias("best_share"), F.sum(F.when(F.col("r") <= 3, F.col("share"))).alias("top3_share"), F.sum(F.col("share") * F.col("share")).alias("hhi"))


def by_label(pairs: DataFrame, label: Column, name: str) -> DataFrame:
    return pairs.withColumn(name, label).groupBy(*PAIR, name).agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean_y"), F.regr_slope("y", "x").alias("slope"))


def historical_folds(pairs: DataFrame, cut: str, q: int = 4) -> DataFrame:
    """Bins of later rows by the quantile edges of earlier rows only."""
    edges = pairs.where(F.col("session") < cut).groupBy(*PAIR).agg(F.percentile("x", F.array(*[F.lit(i / q) for i in range(1, q)])).alias("edges"))
    later = pairs.where(F.col("session") >= cut).join(edges, PAIR)
    return later.withColumn("bin", F.size(F.filter("edges", lambda e: e <= F.col("x")))).groupBy(*PAIR, "bin").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean_y"))


def regimes(pairs: DataFrame, context: DataFrame, column: str) -> DataFrame:
    """Pair statistics by a label of the decision; ``context`` has one row a decision."""
    return pairs.join(context, ["session", "slot"], "left").withColumn(column, F.coalesce(F.col(column), F.lit("unknown"))).groupBy(*PAIR, column).agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean_y"), F.regr_slope("y", "x").alias("slope"))


def against_parents(screen: DataFrame, child: str, parents: list[str]) -> DataFrame:
    """A composed feature's spread against the better of its parents', by target."""
    best = screen.where(F.col("feature").isin(*parents)).groupBy("target").agg(F.max(F.abs("spread")).alias("best_parent"))
    own = screen.where(F.col("feature") == child).select("target", F.abs("spread").alias("own"))
    return own.join(best, "target").select("target", "own", "best_parent", (F.col("own") - F.col("best_parent")).alias("increment"), div(F.col("own"), F.col("best_parent")).alias("ratio"))
