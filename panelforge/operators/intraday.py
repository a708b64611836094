"""Intraday operators: preparation, point-in-time features, strictly forward targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.columns import FOLLOWING, PRECEDING, div, enough, pct_rank, trailing

BENCHMARK = "S0"


def Y():
    """Rows of a symbol."""
    return Window.partitionBy("symbol").orderBy("session", "slot")


def D():
    """Rows of a symbol's session."""
    return Window.partitionBy("symbol", "session").orderBy("slot")


def S():
    """Rows of a session without a gap between."""
    return Window.partitionBy("symbol", "session", "seg").orderBy("slot")


def segments(bars: DataFrame) -> DataFrame:
    """Adds seg: how many gaps in the bar grid lie before a bar of its session."""
    gap = F.coalesce((F.col("slot") - F.lag("slot").over(D()) != 1).cast("int"), F.lit(0))
    return bars.withColumn("gap", gap).withColumn("seg", F.sum("gap").over(D())).drop("gap")


def completeness(bars: DataFrame, expected: int = 12, most_missing: int = 2) -> DataFrame:
    out = bars.groupBy("symbol", "session").agg(F.countDistinct("slot").alias("n_bars"))
    missing = F.greatest(F.lit(expected) - F.col("n_bars"), F.lit(0))
    return out.select("symbol", "session", "n_bars", missing.alias("missing"), (missing <= most_missing).alias("grid_ok"))


def shape(bars: DataFrame) -> DataFrame:
    o, h, low, c = (F.col(x) for x in "ohlc")
    return bars.select(
        "symbol", "session", "slot", div(h - low, o).alias("range_pct"), div(F.abs(c - o), h - low).alias("body_to_range"), div(h - F.greatest(o, c), h - low).alias("upper_wick"),
        div(F.least(o, c) - low, h - low).alias("lower_wick"), div(c - low, h - low).alias("close_location"), (div(c, o) - 1).alias("bar_return"), F.ln(div(c, o)).alias("bar_log_return"),
    )


def running(bars: DataFrame) -> DataFrame:
    upto, whole = D().rowsBetween(PRECEDING, 0), Window.partitionBy("symbol", "session").orderBy("slot").rowsBetween(PRECEDING, FOLLOWING)
    vwap = div(F.sum(F.col("c") * F.col("v")).over(upto), F.sum("v").over(upto))
    high, low = F.max("h").over(upto), F.min("l").over(upto)
    out = bars.withColumn("svwap", vwap).withColumn("hi", high).withColumn("lo", low)
    return out.select(
        "symbol", "session", "slot", (div(F.col("c"), F.first("o").over(whole)) - 1).alias("return_since_open"), (div("c", "svwap") - 1).alias("distance_vwap"), (div("c", "hi") - 1).alias("distance_high"),
        (div("c", "lo") - 1).alias("distance_low"), div(F.col("c") - F.col("lo"), F.col("hi") - F.col("lo")).alias("range_position"), F.sum("v").over(upto).alias("cumulative_volume"), div(F.col("v"), F.sum("v").over(upto)).alias("volume_share"),
    )


def flags(bars: DataFrame) -> DataFrame:
    """Comparisons with the bar before in the same segment; null without one."""
    out = segments(bars).withColumn("ph", F.lag("h").over(S())).withColumn("pl", F.lag("l").over(S()))
    named = {"inside_bar": "h < ph and l > pl", "outside_bar": "h > ph and l < pl", "higher_high": "h > ph", "higher_low": "l > pl", "lower_high": "h < ph", "lower_low": "l < pl"}
    return out.select("symbol", "session", "slot", *[F.expr(f"cast({e} as int)").alias(n) for n, e in named.items()])


def run_lengths(bars: DataFrame) -> DataFrame:
    """Length of the current run of rising and of falling bars, 0 outside one."""
    out = segments(bars).withColumn("r", div("c", F.lag("c").over(S())) - 1)
    out = out.withColumn("up", F.coalesce((F.col("r") > 0).cast("int"), F.lit(0))).withColumn("down", F.coalesce((F.col("r") < 0).cast("int"), F.lit(0)))
    for side in ("up", "down"):
        out = out.withColumn(f"{side}_break", F.sum(1 - F.col(side)).over(S().rowsBetween(PRECEDING, 0)))
        within = Window.partitionBy("symbol", "session", "seg", f"{side}_break").orderBy("slot").rowsBetween(PRECEDING, 0)
        out = out.withColumn(f"{side}_run", F.sum(side).over(within))
    return out.select("symbol", "session", "slot", "up_run", "down_run")


def vwap_cross(bars: DataFrame) -> DataFrame:
    upto = D().rowsBetween(PRECEDING, 0)
    out = segments(bars.withColumn("svwap", div(F.sum(F.col("c") * F.col("v")).over(upto), F.sum("v").over(upto)))).withColumn("side", F.signum(F.col("c") - F.col("svwap")))
    out = out.withColumn("before", F.lag("side").over(S()))
    return out.select("symbol", "session", "slot", (F.col("svwap") - F.lag("svwap").over(S())).alias("vwap_slope"), (F.col("side") != F.col("before")).cast("int").alias("vwap_cross"))


def calendar(bars: DataFrame) -> DataFrame:
    d = F.to_date("session")
    part = F.lit(2 * 3.141592653589793) * (F.col("slot") + 1) / 12
    return bars.select("symbol", "session", "slot", ((F.col("slot") + 1) * 120).alias("minutes_since_open"), F.weekday(d).alias("day_of_week"), F.month(d).alias("month"), F.quarter(d).alias("quarter"), F.sin(part).alias("time_sin"), F.cos(part).alias("time_cos"))


def lookback(bars: DataFrame, n: int) -> DataFrame:
    """The family of features over the last n bars of a segment."""
    out = segments(bars).withColumn("r", div("c", F.lag("c").over(S())) - 1)
    w, half, prior = trailing(S(), n), trailing(S(), max(1, n // 2)), trailing(S(), n, 1)
    r = F.col("r")
    least = max(1, min(n, max(2, n // 3)))
    neg, pos = F.when(r < 0, r), F.when(r > 0, r)
    vol = enough(r, w, n, F.stddev_samp(r).over(w))
    vmean = enough(F.col("v"), prior, n, F.avg("v").over(prior))
    hi, lo = enough(F.col("h"), w, n, F.max("h").over(w)), enough(F.col("l"), w, n, F.min("l").over(w))
    dv = F.col("c") * F.col("v")
    out = out.withColumn("hi", hi).withColumn("lo", lo)
    ret = div("c", F.lag("c", n).over(S())) - 1
    return out.select(
        "symbol", "session", "slot", ret.alias("ret_n"), F.log1p(ret).alias("log_ret_n"), vol.alias("vol_n"), enough(neg, w, least, F.stddev_samp(neg).over(w)).alias("down_vol"), enough(pos, w, least, F.stddev_samp(pos).over(w)).alias("up_vol"),
        div(ret, vol).alias("ret_vol_ratio"), div(r, vol).alias("outlier_score"), F.when(F.count(F.lit(1)).over(w) >= n, F.avg(F.coalesce((r > 0).cast("double"), F.lit(0.0))).over(w)).alias("consistency"),
        enough(r, w, n, F.sum(F.greatest(r, F.lit(0.0))).over(w)).alias("pos_sum"), enough(r, w, n, F.sum(F.least(r, F.lit(0.0))).over(w)).alias("neg_sum"), enough(F.col("v"), w, n, F.sum("v").over(w)).alias("volume_sum"), vmean.alias("volume_mean"),
        div(F.col("v"), vmean).alias("rel_volume"), enough(dv, w, n, F.avg(dv).over(w)).alias("dollar_mean"), enough(r, w, n, F.max(r).over(w)).alias("largest_up"), enough(r, w, n, F.min(r).over(w)).alias("largest_down"), (div("c", "hi") - 1).alias("dist_high"),
        (div("c", "lo") - 1).alias("dist_low"), div(F.col("c") - F.col("lo"), F.col("hi") - F.col("lo")).alias("range_pos"), F.when(F.lag("hi").over(S()).isNotNull(), F.greatest(div("c", F.lag("hi").over(S())) - 1, F.lit(0.0))).alias("breakout"),
        (div(enough(F.col("v"), half, max(1, n // 2), F.avg("v").over(half)), vmean) - 1).alias("volume_accel"), (div(F.col("c"), div(enough(dv, w, n, F.sum(dv).over(w)), F.sum("v").over(w))) - 1).alias("rolling_vwap_dist"),
    )


def base_features(bars: DataFrame) -> DataFrame:
    """The features that the screens use: ret_1, vol_3, range_pos_3, rel_vol_3, up (0 or 1)."""
    out = segments(bars).withColumn("ret_1", div("c", F.lag("c").over(S())) - 1)
    w, prior = trailing(S(), 3), trailing(S(), 3, 1)
    hi, lo = enough(F.col("h"), w, 3, F.max("h").over(w)), enough(F.col("l"), w, 3, F.min("l").over(w))
    return out.select("symbol", "session", "slot", "o", "c", "v", "ret_1", enough(F.col("ret_1"), w, 3, F.stddev_samp("ret_1").over(w)).alias("vol_3"), div(F.col("c") - lo, hi - lo).alias("range_pos_3"), div(F.col("v"), enough(F.col("v"), prior, 3, F.avg("v").over(prior))).alias("rel_vol_3"), (F.col("ret_1") > 0).cast("double").alias("up"))


BASE_SQL = """seg0 as (select *, coalesce(cast(slot - lag(slot) over d <> 1 as int), 0) as gap from bars window d as (partition by symbol, session order by slot)),
segs as (select * exclude gap, sum(gap) over (partition by symbol, session order by slot) as seg from seg0),
seg1 as (select *, c / nullif(lag(c) over s, 0) - 1 as ret_1 from segs window s as (partition by symbol, session, seg order by slot)),
feat as (select symbol, session, slot, o, c, v, ret_1, case when count(ret_1) over w >= 3 then stddev_samp(ret_1) over w end as vol_3,
 case when count(h) over w >= 3 then (c - min(l) over w) / nullif(max(h) over w - min(l) over w, 0) end as range_pos_3, case when count(v) over p >= 3 then v / nullif(avg(v) over p, 0) end as rel_vol_3, cast(ret_1 > 0 as int)::double as up
 from seg1 window w as (partition by symbol, session, seg order by slot rows between 2 preceding and current row), p as (partition by symbol, session, seg order by slot rows between 3 preceding and 1 preceding))"""


def ends_after(h: int):
    return lambda bar: bar["slot"] + 1 >= F.col("entry.slot") + h


def forward_returns(bars: DataFrame, horizons: tuple[int, ...] = (1, 2)) -> DataFrame:
    """Entry at the first bar that starts when the decision's bar has ended, exit at the first bar that ends ``h`` bars after
    the entry's start, within the session. The bars of a session (at most twelve) travel as one sorted array."""
    session = bars.groupBy("symbol", "session").agg(F.sort_array(F.collect_list(F.struct("slot", "o", "c"))).alias("path"))
    out = bars.select("symbol", "session", "slot").join(session, ["symbol", "session"])
    out = out.withColumn("entry", F.get(F.filter("path", lambda b: b["slot"] >= F.col("slot") + 1), F.lit(0)))
    for h in horizons:
        out = out.withColumn(f"exit_{h}", F.get(F.filter("path", ends_after(h)), F.lit(0)))
    last = F.element_at("path", -1)
    cols = [(div(F.col(f"exit_{h}.c"), F.col("entry.o")) - 1).alias(f"fwd_{h}") for h in horizons]
    return out.select("symbol", "session", "slot", F.col("entry.slot").alias("entry_slot"), *cols, F.when(F.col("entry").isNotNull(), div(last["c"], F.col("entry.o")) - 1).alias("fwd_eod"))


TARGET_SQL = """ent as (select b.symbol, b.session, b.slot, min(e.slot) as entry_slot from bars b left join bars e on e.symbol = b.symbol and e.session = b.session and e.slot >= b.slot + 1 group by all),
ext as (select n.*, (select min(x.slot) from bars x where x.symbol = n.symbol and x.session = n.session and x.slot + 1 >= n.entry_slot + 1) as x1, (select min(x.slot) from bars x where x.symbol = n.symbol and x.session = n.session and x.slot + 1 >= n.entry_slot + 2) as x2, (select max(x.slot) from bars x where x.symbol = n.symbol and x.session = n.session) as xe from ent n),
tgt as (select t.symbol, t.session, t.slot, t.entry_slot, a.c / e.o - 1 as fwd_1, b2.c / e.o - 1 as fwd_2, case when e.o is not null then z.c / e.o - 1 end as fwd_eod from ext t left join bars e on e.symbol = t.symbol and e.session = t.session and e.slot = t.entry_slot
 left join bars a on a.symbol = t.symbol and a.session = t.session and a.slot = t.x1 left join bars b2 on b2.symbol = t.symbol and b2.session = t.session and b2.slot = t.x2 left join bars z on z.symbol = t.symbol and z.session = t.session and z.slot = t.xe)"""


def benchmark_adjusted(targets: DataFrame, benchmark: str = BENCHMARK) -> DataFrame:
    """Own return minus the benchmark's at the same decision."""
    b = targets.where(F.col("symbol") == benchmark).select("session", "slot", F.col("fwd_1").alias("b_1"))
    return targets.join(b, ["session", "slot"], "left").select("symbol", "session", "slot", (F.col("fwd_1") - F.col("b_1")).alias("adj_1"))


def session_returns(bars: DataFrame) -> DataFrame:
    day = bars.groupBy("symbol", "session").agg(F.min_by("o", "slot").alias("so"), F.max_by("c", "slot").alias("sc"))
    w = Window.partitionBy("symbol").orderBy("session")
    p = F.lag("sc").over(w)
    return day.select("symbol", "session", (div(p, F.lag("sc", 2).over(w)) - 1).alias("previous_session_return"), (div(F.col("so"), p) - 1).alias("overnight_gap"), (div(p, F.lag("sc", 3).over(w)) - 1).alias("session_return_2"), (div(F.col("sc"), p) - 1).alias("day_return"))


def session_betas(bars: DataFrame, window: int = 10, least: int = 5) -> DataFrame:
    """Beta to the benchmark from session returns of the ``window`` sessions before: the covariance over sessions with both
    returns, the variance over all of the benchmark's."""
    r = session_returns(bars).select("symbol", "session", "day_return")
    b = r.where(F.col("symbol") == BENCHMARK).select("session", F.col("day_return").alias("m"))
    w = Window.partitionBy("symbol").orderBy("session").rowsBetween(-window, -1)
    both = r.join(b, "session", "left")
    pair = F.col("day_return").isNotNull() & F.col("m").isNotNull()
    y, m = F.when(pair, F.col("day_return")), F.when(pair, F.col("m"))
    return both.select("symbol", "session", F.when((F.count(y).over(w) >= least) & (F.count("m").over(w) >= least), div(F.covar_samp(y, m).over(w), F.var_samp("m").over(w))).alias("beta"))


def cross_section(features: DataFrame) -> DataFrame:
    by = ["session", "slot"]
    part = Window.partitionBy(*by)
    ranks = features.where(F.col("symbol") != BENCHMARK)
    return ranks.select("symbol", *by, pct_rank("ret_1", by).alias("ret_rank"), pct_rank("rel_vol_3", by).alias("volume_rank"), F.avg((F.col("ret_1") > 0).cast("double")).over(part).alias("breadth"), F.stddev_samp("ret_1").over(part).alias("dispersion"))


def market_relative(features: DataFrame) -> DataFrame:
    """The benchmark's return at the same decision, also lagged along the decisions, and its volatility regime."""
    m = features.where(F.col("symbol") == BENCHMARK).select("session", "slot", F.col("ret_1").alias("market"), F.col("vol_3").alias("market_vol"))
    w = Window.orderBy("session", "slot")  # one row a decision: the benchmark alone
    m = m.withColumn("market_lag_1", F.lag("market").over(w)).withColumn("median_vol", F.when(F.count("market_vol").over(w.rowsBetween(PRECEDING, 0)) >= 10, F.percentile("market_vol", F.lit(0.5)).over(w.rowsBetween(PRECEDING, 0))))
    out = features.join(m, ["session", "slot"], "left")
    return out.select("symbol", "session", "slot", "market", (F.col("ret_1") - F.col("market")).alias("minus_market"), "market_lag_1", F.when(F.col("market_vol").isNotNull(), F.coalesce((F.col("market_vol") > F.col("median_vol")).cast("int"), F.lit(0))).alias("high_vol"))


def time_of_day(bars: DataFrame, k: int = 10) -> DataFrame:
    """Volume against the mean of the same slot in the k sessions before."""
    w = Window.partitionBy("symbol", "slot").orderBy("session").rowsBetween(-k, -1)
    return bars.select("symbol", "session", "slot", F.when(F.count("v").over(w) >= max(5, k // 4), div(F.col("v"), F.avg("v").over(w))).alias("tod_relative_volume"))


def normalised(features: DataFrame, w: int = 40, least: int = 10) -> DataFrame:
    """A feature against mean, deviation and median of the symbol's earlier rows."""
    f = Y().rowsBetween(-w, -1)
    x = F.col("ret_1")
    ok = F.count(x).over(f) >= least
    return features.select("symbol", "session", "slot", F.when(ok, div(x - F.avg(x).over(f), F.stddev_samp(x).over(f))).alias("ret_z"), F.when(ok, x - F.percentile(x, F.lit(0.5)).over(f)).alias("ret_median_diff"), F.when(F.count("rel_vol_3").over(f) >= least, div(F.col("rel_vol_3"), F.avg("rel_vol_3").over(f))).alias("volume_mean_ratio"))


def opening(bars: DataFrame, m: int = 3) -> DataFrame:
    """The first m slots of a session, visible from then on, if none is missing."""
    part = Window.partitionBy("symbol", "session")
    early = F.col("slot") < m
    whole = F.count(F.when(early, 1)).over(part) == m
    hi, lo = F.max(F.when(early, F.col("h"))).over(part), F.min(F.when(early, F.col("l"))).over(part)
    first, last = F.max(F.when(F.col("slot") == 0, F.col("o"))).over(part), F.max(F.when(F.col("slot") == m - 1, F.col("c"))).over(part)
    seen = whole & (F.col("slot") >= m - 1)
    return bars.select("symbol", "session", "slot", F.when(seen, div(last, first) - 1).alias("opening_return"), F.when(seen, div(hi - lo, first)).alias("opening_range"), F.when(seen, F.sum(F.when(early, F.col("v"))).over(part)).alias("opening_volume"), F.when(seen, (F.col("c") > hi).cast("int")).alias("opening_breakout"))


def split_factors(bars: DataFrame, actions: DataFrame) -> DataFrame:
    """Product of the ratios with an ex-date after the session; 1 without any."""
    days = bars.select("symbol", "session").distinct()
    hit = days.join(actions, "symbol").where(F.col("ex_date") > F.col("session")).groupBy("symbol", "session").agg(F.product("ratio").alias("f"))
    return days.join(hit, ["symbol", "session"], "left").select("symbol", "session", F.coalesce("f", F.lit(1.0)).alias("split_factor"))


def dividend_factors(bars: DataFrame, dividends: DataFrame) -> DataFrame:
    """Product of 1 - cash / last close before the ex-date, over the dividends after a session."""
    day = bars.groupBy("symbol", "session").agg(F.max_by("c", "slot").alias("sc"))
    prior = dividends.join(day, "symbol").where(F.col("session") < F.col("ex_date")).groupBy("symbol", "ex_date", "cash").agg(F.max_by("sc", "session").alias("close_before"))
    prior = prior.where(F.col("close_before") > F.col("cash")).select("symbol", "ex_date", (1 - F.col("cash") / F.col("close_before")).alias("k"))
    hit = day.join(prior, "symbol").where(F.col("ex_date") > F.col("session")).groupBy("symbol", "session").agg(F.product("k").alias("f"))
    return day.join(hit, ["symbol", "session"], "left").select("symbol", "session", F.coalesce("f", F.lit(1.0)).alias("dividend_factor"))


def valid_at(rows: DataFrame, spans: DataFrame, key: str, at: str) -> DataFrame:
    """Effective-dated join: valid_from <= at < valid_to."""
    return rows.join(spans, key).where((F.col("valid_from") <= F.col(at)) & (F.col("valid_to").isNull() | (F.col(at) < F.col("valid_to"))))


def holdout_guard(rows: DataFrame, column: str, boundary: str) -> DataFrame:
    """How many rows lie at or beyond a sealed boundary; more than none is a failure for the caller."""
    return rows.agg(F.count_if(F.col(column) >= boundary).alias("sealed_rows"), F.max(column).alias("last_seen"))


def pit_violations(features: DataFrame, targets: DataFrame) -> DataFrame:
    """Counts of point-in-time violations; all must be zero."""
    both = features.join(targets, ["symbol", "session", "slot"], "left")
    return both.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("entry_slot") <= F.col("slot")).alias("entry_before_decision"), F.count_if(F.col("c") <= 0).alias("bad_price"), F.count_if(F.col("v") < 0).alias("bad_volume"), F.count_if(F.col("entry_slot").isNull() & F.col("fwd_1").isNotNull()).alias("target_without_entry"))


def provenance(rows: DataFrame, by: str) -> DataFrame:
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n_rows"), F.min("session").alias("first_session"), F.max("session").alias("last_session"), F.countDistinct("session").alias("n_sessions"))


def lead_lag(features: DataFrame, k: int = 1) -> DataFrame:
    """The market's last move and changes of breadth and dispersion along the decisions, and what a symbol has not followed.

    The series of decisions has one row a decision: an aggregate, joined back by decision."""
    x = F.col("ret_1")
    d = features.groupBy("session", "slot").agg(F.max(F.when(F.col("symbol") == BENCHMARK, x)).alias("m"), F.avg(F.when(F.col("symbol") != BENCHMARK, (x > 0).cast("double"))).alias("b"), F.stddev_samp(F.when(F.col("symbol") != BENCHMARK, x)).alias("s"))
    w = Window.orderBy("session", "slot")
    d = d.select("session", "slot", F.lag("m", k).over(w).alias("lag_market"), (F.lag("b", k).over(w) - F.lag("b", k + 1).over(w)).alias("lag_breadth_change"), (F.lag("s", k).over(w) - F.lag("s", k + 1).over(w)).alias("lag_dispersion_change"))
    out = features.join(d, ["session", "slot"])
    return out.select("symbol", "session", "slot", "lag_market", "lag_breadth_change", "lag_dispersion_change", (F.col("lag_market") - F.lag("ret_1", k).over(Y())).alias("unreacted"))


def volatility_acceleration(bars: DataFrame, n: int = 4) -> DataFrame:
    """Deviation of the last half of a window over that of the whole, less 1."""
    out = segments(bars).withColumn("r", div("c", F.lag("c").over(S())) - 1)
    w, half = trailing(S(), n), trailing(S(), n // 2)
    r = F.col("r")
    return out.select("symbol", "session", "slot", (div(enough(r, half, n // 2, F.stddev_samp(r).over(half)), enough(r, w, n, F.stddev_samp(r).over(w))) - 1).alias("vol_accel"))


def checkpoints(bars: DataFrame, slots: tuple[int, ...] = (2, 5, 8)) -> DataFrame:
    """Per session: the vwap of the bar that ends at each checkpoint, and volumes of the first and last quarter."""
    at = [F.max(F.when(F.col("slot") == s, F.col("vwap"))).alias(f"vwap_{s}") for s in slots]
    return bars.groupBy("symbol", "session").agg(*at, F.sum(F.when(F.col("slot") < 3, F.col("v"))).alias("first_volume"), F.sum(F.when(F.col("slot") >= 9, F.col("v"))).alias("last_volume"), F.max("v").alias("largest_volume"))


def calendar_join(bars: DataFrame, schedule: DataFrame) -> DataFrame:
    """Bars on the grid of their session: the schedule gives first and last slot; others are dropped. ``missing`` counts the
    session's absent bars. Sessions are few beside bars, so Spark broadcasts the schedule where its size allows."""
    b = bars.join(schedule, "session").where(F.col("slot").between(F.col("opens"), F.col("closes")))
    expected = F.col("closes") - F.col("opens") + 1
    return b.withColumn("missing", F.greatest(expected - F.count("slot").over(Window.partitionBy("symbol", "session")), F.lit(0))).withColumn("from_open", F.col("slot") - F.col("opens"))


def high_volatility(features: DataFrame, least: int = 20) -> DataFrame:
    """1 where the benchmark's volatility exceeds its median so far, else 0, also while the history is short."""
    m = features.where(F.col("symbol") == BENCHMARK).select("session", "slot", "vol_3")
    w = Window.orderBy("session", "slot").rowsBetween(PRECEDING, 0)  # one row a decision: the benchmark alone
    middle = F.when(F.count("vol_3").over(w) >= least, F.percentile("vol_3", F.lit(0.5)).over(w))
    m = m.select("session", "slot", F.coalesce((F.col("vol_3") > middle).cast("int"), F.lit(0)).alias("high_market_vol"))
    return features.select("symbol", "session", "slot").join(m, ["session", "slot"], "left")


def dispersion_bucket(features: DataFrame, least: int = 20) -> DataFrame:
    """Each decision's return dispersion against the median of the decisions before it; unknown while these are few."""
    by = features.where(F.col("symbol") != BENCHMARK).groupBy("session", "slot").agg(F.stddev_samp("ret_1").alias("dispersion"))
    w = Window.orderBy("session", "slot").rowsBetween(PRECEDING, -1)  # one row a decision, after the aggregate
    prior = F.when(F.count("dispersion").over(w) >= least, F.percentile("dispersion", F.lit(0.5)).over(w))
    label = F.when(F.col("dispersion") >= F.col("prior"), "high_dispersion").otherwise("low_dispersion")
    return by.withColumn("prior", prior).select("session", "slot", "dispersion", "prior", F.when(F.col("prior").isNotNull(), label).alias("bucket"))


def beta_residual_returns(features: DataFrame, n: int = 20, least: int = 10) -> DataFrame:
    """A bar's return minus its beta times the benchmark's; beta from the symbol's n rows before, on rows with both."""
    m = features.where(F.col("symbol") == BENCHMARK).select("session", "slot", F.col("ret_1").alias("m"))
    f = features.select("symbol", "session", "slot", "ret_1").join(m, ["session", "slot"], "left")
    both = F.col("ret_1").isNotNull() & F.col("m").isNotNull()
    y, x, w = F.when(both, F.col("ret_1")), F.when(both, F.col("m")), Y().rowsBetween(-n, -1)
    beta = F.when(F.count(y).over(w) >= least, div(F.covar_samp(y, x).over(w), F.var_samp(x).over(w)))
    return f.withColumn("beta", beta).select("symbol", "session", "slot", "beta", (F.col("ret_1") - F.col("beta") * F.col("m")).alias("residual"))
