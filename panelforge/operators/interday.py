"""Interday operators over a dense panel of security and session; absent values are null, row frames count sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.columns import PRECEDING, div, enough, trailing


def W():
    return Window.partitionBy("security").orderBy("t")


def returns(panel: DataFrame) -> DataFrame:
    return panel.withColumn("ret", div("c", F.lag("c").over(W())) - 1)


def liquidity(panel: DataFrame, n: int = 12, least: int = 6) -> DataFrame:
    """Median dollars of the n sessions before."""
    f = W().rowsBetween(-n, -1)
    return panel.select("security", "session", F.when(F.count("dollars").over(f) >= least, F.percentile("dollars", F.lit(0.5)).over(f)).alias("prior_median_dollars"))


def action_index(panel: DataFrame, actions: DataFrame) -> DataFrame:
    """Cumulative split factor A and dividends C = sum of A times cash."""
    x = panel.select("security", "session", "t", "c").join(actions, ["security", "session"], "left")
    run = W().rowsBetween(PRECEDING, 0)
    x = x.withColumn("a", F.product(F.coalesce("ratio", F.lit(1.0))).over(run))
    return x.withColumn("cum_dividend", F.sum(F.col("a") * F.coalesce("cash", F.lit(0.0))).over(run)).withColumnRenamed("a", "split_index")


def total_return(index: DataFrame, k: int = 3) -> DataFrame:
    """Return from now to k sessions on: shares held grow by splits, dividends are added."""
    w = W()
    ax, cx, px = F.lead("split_index", k).over(w), F.lead("cum_dividend", k).over(w), F.lead("c", k).over(w)
    value = ax / F.col("split_index") * px + (cx - F.col("cum_dividend")) / F.col("split_index")
    return index.select("security", "session", (div(value, F.col("c")) - 1).alias("total_return"))


def window_features(panel: DataFrame, n: int = 6) -> DataFrame:
    p, w = returns(panel), trailing(W(), n)
    c, ret, v = F.col("c"), F.col("ret"), F.col("v")
    hi, lo, sma = (enough(c, w, n, f(c).over(w)) for f in (F.max, F.min, F.avg))
    full = F.count(ret).over(w) >= n
    path = F.sum(F.abs(ret)).over(w)
    out = p.withColumn("hi", hi).withColumn("lo", lo)
    return out.select(
        "security", "session", F.when(full, div(c, F.lag("c", n).over(W())) - 1).alias("ret_n"), F.when(full, F.avg((ret > 0).cast("double")).over(w)).alias("positive_fraction"), F.when(full, div(F.abs(F.sum(ret).over(w)), path)).alias("path_efficiency"),
        (div("c", "hi") - 1).alias("drawdown"), (div("c", "lo") - 1).alias("distance_low"), div(c - F.col("lo"), F.col("hi") - F.col("lo")).alias("range_position"), (div(c, sma) - 1).alias("distance_sma"), F.when(full, F.stddev_pop(ret).over(w)).alias("realised_vol"),
        enough(v, w, n, div(v, F.avg(v).over(w))).alias("relative_volume"), enough(v, w, n, div(v - F.avg(v).over(w), F.stddev_pop(v).over(w))).alias("volume_z"),
    )


def trend(panel: DataFrame, n: int = 6) -> DataFrame:
    w, x = trailing(W(), n), F.col("t").cast("double") / ((n - 1) / 2)
    ok = F.count("c").over(w) >= n
    return panel.select("security", "session", F.when(ok, F.regr_slope(F.ln("c"), x).over(w)).alias("trend_slope"), F.when(ok, F.regr_r2(F.ln("c"), x).over(w)).alias("trend_r2"))


def atr(panel: DataFrame, n: int = 6) -> DataFrame:
    pc, w = F.lag("c").over(W()), trailing(W(), n)
    p = panel.withColumn("pc", pc).withColumn("tr", F.when(F.col("pc").isNotNull() & F.col("h").isNotNull(), F.greatest(F.col("h") - F.col("l"), F.abs(F.col("h") - F.col("pc")), F.abs(F.col("l") - F.col("pc")))))
    return p.select("security", "session", enough(F.col("tr"), w, n, div(F.avg("tr").over(w), "c")).alias("atr_pct"))


def prior_beta(panel: DataFrame, n: int = 12, least: int = 8) -> DataFrame:
    """Beta to the equal-weighted market on the n sessions before, on rows with both."""
    p = returns(panel).withColumn("m", F.avg("ret").over(Window.partitionBy("session")))
    both = F.col("ret").isNotNull() & F.col("m").isNotNull()
    y, m, f = F.when(both, F.col("ret")), F.when(both, F.col("m")), W().rowsBetween(-n, -1)
    out = p.withColumn("beta", F.when(F.count(y).over(f) >= least, F.when(F.var_pop(m).over(f) > 1e-12, F.covar_pop(y, m).over(f) / F.var_pop(m).over(f))))
    return out.select("security", "session", "beta", (F.col("ret") - F.col("beta") * F.col("m")).alias("residual"))


def leave_one_out(panel: DataFrame, sectors: DataFrame, least: int = 3) -> DataFrame:
    p = returns(panel).join(sectors, "security")
    w = Window.partitionBy("session", "sector")
    n = F.count("ret").over(w) - 1
    loo = F.when(F.col("ret").isNotNull() & (n >= least), (F.sum("ret").over(w) - F.col("ret")) / n)
    return p.select("security", "session", "sector", loo.alias("sector_return"), (F.col("ret") - loo).alias("sector_excess"))


def gap_fill(panel: DataFrame, least: float = 0.001) -> DataFrame:
    p = panel.withColumn("gap", div("o", F.lag("c").over(W())) - 1)
    return p.select("security", "session", "gap", F.when(F.abs("gap") >= least, F.signum(-F.col("gap")) * (div("c", "o") - 1) / F.abs("gap")).alias("gap_fill"))


def since_extreme(panel: DataFrame, n: int = 6) -> DataFrame:
    """Sessions since the highest and lowest close of the frame; of ties the latest."""
    w = trailing(W(), n)
    ok = F.count("c").over(w) >= n
    high, low = F.max(F.struct("c", "t")).over(w)["t"], F.max(F.struct((-F.col("c")).alias("c"), "t")).over(w)["t"]
    return panel.select("security", "session", F.when(ok, F.col("t") - high).alias("since_high"), F.when(ok, F.col("t") - low).alias("since_low"))


def streaks(panel: DataFrame) -> DataFrame:
    p = returns(panel).withColumn("up", (F.col("ret") > 0).cast("int"))
    p = p.withColumn("b", F.sum(F.when(F.col("up") == 1, 0).otherwise(1)).over(W().rowsBetween(PRECEDING, 0)))
    return p.select("security", "session", F.when(F.col("ret").isNotNull(), F.sum(F.coalesce("up", F.lit(0))).over(Window.partitionBy("security", "b").orderBy("t").rowsBetween(PRECEDING, 0))).alias("up_streak"))


def targets(panel: DataFrame, k: int = 3) -> DataFrame:
    """Entry at the next session's open, exit at the close k sessions on; the first reason that applies says why there is none."""
    w = W()
    p = panel.withColumn("entry", F.lead("o").over(w)).withColumn("exit", F.lead("c", k).over(w)).withColumn("last", F.lead("t", k).over(w))
    reason = F.when(F.col("c").isNull(), "no_bar").when(F.col("last").isNull(), "beyond_calendar").when(F.col("entry").isNull(), "no_entry").when(F.col("exit").isNull(), "no_exit").otherwise("ok")
    return p.select("security", "session", "t", reason.alias("reason"), F.when(reason == "ok", div("exit", "entry") - 1).alias("target"))


def rank_bins(values: DataFrame, x: str = "x", least: int = 10) -> DataFrame:
    """(rank - 0.5) / n and deterministic deciles of a session, ties by security; needs enough distinct values."""
    part = Window.partitionBy("session")
    v = values.where(F.col(x).isNotNull())
    n = F.count(x).over(part)
    ties = F.count(x).over(Window.partitionBy("session", x))
    v = v.withColumn("n", n).withColumn("ra", F.rank().over(part.orderBy(x)) + (ties - 1) / 2.0).withColumn("d", F.dense_rank().over(part.orderBy(x)))
    ok = (F.col("n") >= least) & (F.max("d").over(part) >= 10)
    return v.select("security", "session", "t", x, F.when(ok, (F.col("ra") - 0.5) / F.col("n")).alias("pct"), F.when(ok, F.ntile(10).over(part.orderBy(x, "security")) - 1).alias("decile"))


def persistence(ranked: DataFrame, lag: int = 1) -> DataFrame:
    """Correlation of ranks now and ``lag`` sessions later, both ranked again among the securities that have both."""
    later = ranked.select("security", (F.col("t") - lag).alias("t"), F.col("pct").alias("q"))
    both = ranked.join(later, ["security", "t"]).where("pct is not null and q is not null")
    part = Window.partitionBy("t")
    for c in ("pct", "q"):
        both = both.withColumn(f"r_{c}", F.rank().over(part.orderBy(c)) + (F.count(c).over(Window.partitionBy("t", c)) - 1) / 2.0)
    return both.groupBy("t").agg(F.count(F.lit(1)).alias("n"), div(F.covar_pop("r_pct", "r_q"), F.sqrt(F.var_pop("r_pct") * F.var_pop("r_q"))).alias("persistence"))


def turnover(ranked: DataFrame, panel: DataFrame, decile: int = 9) -> DataFrame:
    """Half the summed change of equal weights in a tail; absent is 0, the first session null."""
    tail = ranked.where(F.col("decile") == decile)
    tail = tail.withColumn("w", 1.0 / F.count(F.lit(1)).over(Window.partitionBy("session"))).select("security", "session", "w")
    dense = panel.select("security", "session", "t").join(tail, ["security", "session"], "left").withColumn("w", F.coalesce("w", F.lit(0.0)))
    moved = dense.withColumn("d", F.abs(F.col("w") - F.lag("w").over(W())))
    return moved.groupBy("session").agg((F.sum("d") / 2).alias("turnover"))


def daily_pairs(ranked: DataFrame, goals: DataFrame) -> DataFrame:
    """Per session: rank correlation on paired rows, and spreads between deciles."""
    p = ranked.join(goals.select("security", "session", "target"), ["security", "session"]).where("pct is not null and target is not null")
    part = Window.partitionBy("session")
    for c in ("pct", "target"):
        p = p.withColumn(f"r_{c}", F.rank().over(part.orderBy(c)) + (F.count(c).over(Window.partitionBy("session", c)) - 1) / 2.0)
    top, mid, low = (F.avg(F.when(cond, F.col("target"))) for cond in (F.col("decile") == 9, F.col("decile").isin(4, 5), F.col("decile") == 0))
    return p.groupBy("session").agg(F.count(F.lit(1)).alias("n"), div(F.covar_pop("r_pct", "r_target"), F.sqrt(F.var_pop("r_pct") * F.var_pop("r_target"))).alias("ic"), (top - low).alias("top_bottom"), (top - mid).alias("top_middle"), (mid - low).alias("middle_bottom"))


def newey_west(series: DataFrame, x: str, lag: int = 5) -> DataFrame:
    """Over one dense series (t, x): gaps keep their place, each lag's covariance is the mean over pairs present."""
    s = series.withColumn("d", F.col(x) - F.avg(x).over(Window.partitionBy()))
    w = Window.orderBy("t")  # one row a session: the calendar alone
    for k in range(1, lag + 1):
        s = s.withColumn(f"p{k}", F.col("d") * F.lag("d", k).over(w))
    g = s.agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.avg(F.col("d") * F.col("d")).alias("g0"), *[F.avg(f"p{k}").alias(f"g{k}") for k in range(1, lag + 1)])
    v = F.col("g0")
    for k in range(1, lag + 1):
        v = v + 2 * (1 - k / (lag + 1)) * F.coalesce(f"g{k}", F.lit(0.0))
    se = F.sqrt(F.greatest(v, F.lit(0.0)) / F.col("n"))
    ok = (F.col("n") >= max(20, lag + 5)) & (v >= -1e-12)
    return g.select("n", "mean", F.when(ok, se).alias("se"), F.when(ok, div(F.col("mean"), se)).alias("t"))


def neighbours(profile: DataFrame, effect: str = "effect", least: float = 0.5) -> DataFrame:
    """Whether the horizons beside a horizon keep at least half its effect with the same sign."""
    w = Window.orderBy("horizon")
    e = F.col(effect)
    keep = lambda other: F.when(other.isNotNull(), (div(other, e) >= least).cast("int"))
    return profile.select("horizon", effect, keep(F.lag(effect).over(w)).alias("before"), keep(F.lead(effect).over(w)).alias("after"))


def return_components(panel: DataFrame, n: int = 6) -> DataFrame:
    """Overnight and regular parts of the n-session return, the return that ends a session earlier, and its risk forms."""
    prior = F.lag("c").over(W())
    p = returns(panel).withColumn("night", div("o", prior) - 1).withColumn("day", div("c", "o") - 1)
    w, half = trailing(W(), n), max(n // 2, 1)
    grown = lambda x: enough(F.col(x), w, n, F.expm1(F.sum(F.log1p(x)).over(w)))
    down = F.col("ret").isNotNull().cast("int") * F.pow(F.least("ret", F.lit(0.0)), F.lit(2.0))
    p = p.withColumn("vol", enough(F.col("ret"), w, n, F.stddev_pop("ret").over(w)))
    ago = lambda k: F.lag("c", k).over(W())
    return p.select(
        "security", "session", grown("night").alias("overnight_n"), grown("day").alias("regular_n"), (grown("night") - grown("day")).alias("overnight_minus_regular"),
        enough(F.col("night"), w, n, F.avg((F.col("night") > 0).cast("double")).over(w)).alias("positive_overnight"),
        enough(F.col("ret"), W().rowsBetween(-n, -1), n, div(ago(1), ago(n + 1)) - 1).alias("return_skip1"),
        div(enough(F.col("ret"), w, n, div("c", ago(n)) - 1), F.lag("vol").over(W())).alias("vol_scaled"),
        enough(F.col("ret"), w, max(3, int(0.75 * n)), F.sqrt(F.avg(F.when(F.col("ret").isNotNull(), down)).over(w))).alias("downside_vol"),
        ((div("c", ago(half)) - 1) - (div(ago(half), ago(2 * half)) - 1)).alias("acceleration"),
    )


def flow_features(panel: DataFrame, n: int = 6) -> DataFrame:
    """What prices moved for the money that moved them: illiquidity, volume trend, volume of rising and falling sessions."""
    p, w, before = returns(panel), trailing(W(), n), W().rowsBetween(-n, -1)
    ret, v = F.col("ret"), F.col("v")
    p = p.withColumn("impact", div(F.abs(ret), F.col("dollars"))).withColumn("both", F.when(ret.isNotNull(), v)).withColumn("range", div(F.col("h") - F.col("l"), F.col("c")))
    share = lambda test: enough(F.col("both"), w, n, div(F.sum(F.when(test, F.col("both")).otherwise(0.0)).over(w), F.sum("both").over(w)))
    spread = F.stddev_pop("dollars").over(before)
    return p.select(
        "security", "session", enough(F.col("impact"), w, n, F.avg("impact").over(w) * 1e6).alias("amihud_millions"), (enough(v, before, n, div(v, F.avg(v).over(before))) - 1).alias("volume_trend"),
        share(ret > 0).alias("up_volume_share"), share(ret < 0).alias("down_volume_share"),
        enough(F.col("dollars"), before, n, div(F.col("dollars") - F.avg("dollars").over(before), spread)).alias("dollar_z"),
        enough(F.col("range"), before, max(3, int(0.75 * n)), div("range", F.avg("range").over(before))).alias("range_shock"),
    )


def risk_features(panel: DataFrame, n: int = 12, least: int = 8) -> DataFrame:
    """Correlation with the equal-weighted market, beta over the falling sessions before, and shocks against earlier ones."""
    p = returns(panel).withColumn("m", F.avg("ret").over(Window.partitionBy("session"))).withColumn("gap", div("o", F.lag("c").over(W())) - 1)
    w, before = trailing(W(), n), W().rowsBetween(-n, -1)
    both = F.col("ret").isNotNull() & F.col("m").isNotNull()
    p = p.withColumn("y", F.when(both, F.col("ret"))).withColumn("x", F.when(both, F.col("m")))
    p = p.withColumn("fy", F.when(F.col("x") < 0, F.col("y"))).withColumn("fx", F.when(F.col("x") < 0, F.col("x")))
    spread = F.sqrt(F.var_pop("x").over(w) * F.var_pop("y").over(w))
    falling = F.when(F.var_pop("fx").over(before) > 1e-12, F.covar_pop("fy", "fx").over(before) / F.var_pop("fx").over(before))
    return p.select(
        "security", "session", enough(F.col("y"), w, least, div(F.covar_pop("y", "x").over(w), spread)).alias("market_correlation"), enough(F.col("fy"), before, max(3, least // 2), falling).alias("downside_beta"),
        enough(F.col("gap"), before, least, div("gap", F.stddev_pop("gap").over(before))).alias("gap_shock"),
        enough(F.col("ret"), before, least, div(F.col("y") - F.col("x"), F.stddev_pop("ret").over(before))).alias("residual_shock"),
    )


TESTS = ("ic", "top_bottom", "top_middle", "middle_bottom")


def pair_tests(series: DataFrame, feature: str, target: str) -> DataFrame:
    """The daily series of a pair as one hypothesis a test: dates, effect and t of the mean."""
    values = F.array(*[F.struct(F.lit(t).alias("test_type"), F.col(t).alias("e")) for t in TESTS])
    rows = series.select(F.explode(values).alias("v")).select("v.*").where("e is not null")
    out = rows.groupBy("test_type").agg(F.count(F.lit(1)).alias("valid_dates"), F.avg("e").alias("effect"), div(F.avg("e"), F.stddev_samp("e") / F.sqrt(F.count(F.lit(1)))).alias("t"))
    return out.select(F.lit(feature).alias("feature"), F.lit(target).alias("target"), "test_type", "valid_dates", "effect", "t")


def horizon_shape(profile: DataFrame, by: list[str], effect: str = "effect") -> DataFrame:
    """Peak of a profile over horizons, what its neighbours keep of it, sign changes and the area under it."""
    w = Window.partitionBy(*by).orderBy("horizon")
    e, h = F.col(effect), F.col("horizon")
    p = profile.withColumn("e0", F.lag(e).over(w)).withColumn("e1", F.lead(e).over(w)).withColumn("h0", F.lag(h).over(w))
    area = F.sum((e + F.col("e0")) / 2 * (h - F.col("h0")))
    flips = F.count_if(F.signum(e) != F.signum("e0"))
    top = F.max_by(F.struct(h.alias("h"), e.alias("e"), "e0", "e1"), F.struct(F.abs(e), -h))
    out = p.where(e.isNotNull()).groupBy(*by).agg(top.alias("p"), area.alias("area"), flips.alias("sign_changes"))
    kept = F.signum("p.e") * F.greatest(F.signum("p.e") * F.col("p.e0"), F.signum("p.e") * F.col("p.e1")) / F.col("p.e")
    return out.select(*by, F.col("p.h").alias("peak_horizon"), F.col("p.e").alias("peak_effect"), kept.alias("retention"), "sign_changes", "area")


def cost_sensitivity(spreads: DataFrame, turnovers: DataFrame, costs: tuple = (1.0, 3.0, 5.0)) -> DataFrame:
    """Mean spread after a cost a side is paid on what turns over; sessions without turnover pay nothing."""
    rows = spreads.join(turnovers, "session", "left").withColumn("bps", F.explode(F.array(*[F.lit(c) for c in costs])))
    paid = 2 * F.col("bps") / 1e4 * F.coalesce("turnover", F.lit(0.0))
    return rows.where("spread is not null").groupBy("bps").agg(F.count(F.lit(1)).alias("n"), F.avg("spread").alias("gross"), F.avg(F.col("spread") - paid).alias("net"))
