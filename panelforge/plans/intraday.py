"""Queries of the intraday group."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelforge.operators import intraday as op
from panelforge.sources import views as v

from .registry import Registry

R = Registry()
K = "symbol session slot"
B = f"with {v.BARS_SQL}"
SEG = op.BASE_SQL.split("seg1 as")[0].rstrip().rstrip(",")
ALL = f"{B}, {op.BASE_SQL}, {op.TARGET_SQL}"


def bars(s, d):
    return v.bars(v.read(s, d, "events"))


def feats(s, d):
    return op.base_features(bars(s, d))


def targets(s, d):
    return op.forward_returns(bars(s, d))


def actions(s, d):
    """Invented actions by rule: a symbol's sessions on the 10th and 20th split by 2 and 3 where its digit is even."""
    days = bars(s, d).select("symbol", "session").distinct()
    day, even = F.substring("session", 9, 2), F.substring("symbol", 2, 1).cast("int") % 2 == 0
    return days.where(day.isin("10", "20") & even).select("symbol", F.col("session").alias("ex_date"), F.when(day == "10", 2.0).otherwise(3.0).alias("ratio"), F.lit(1.5).alias("cash"))


ACTIONS = "acts as (select distinct symbol, session as ex_date, case when substr(session, 9, 2) = '10' then 2.0::double else 3.0::double end as ratio, 1.5::double as cash from bars where substr(session, 9, 2) in ('10', '20') and cast(substr(symbol, 2, 1) as int) % 2 = 0)"

R.add("bars_build", K, "v", "o h l c vwap", bars, f"{B}\nselect * from bars")
R.add("dedupe_latest", "l_orderkey l_linenumber", "l_partkey", "l_extendedprice", lambda s, d: v.latest(v.read(s, d, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"]),
      "\nselect * from lineitem qualify row_number() over (partition by l_orderkey, l_linenumber order by l_shipdate desc, l_partkey desc, l_suppkey desc, l_extendedprice desc) = 1")
R.add("gap_segment", K, "seg", "", lambda s, d: op.segments(bars(s, d)), f"{B}, {SEG}\nselect * from segs")
R.add("session_completeness", "symbol session grid_ok", "n_bars missing", "", lambda s, d: op.completeness(bars(s, d)), f"{B}\nselect symbol, session, count(distinct slot) as n_bars, greatest(12 - count(distinct slot), 0) as missing, greatest(12 - count(distinct slot), 0) <= 2 as grid_ok from bars group by all")
R.add("bar_shape", K, "", "range_pct body_to_range upper_wick lower_wick close_location bar_return bar_log_return", lambda s, d: op.shape(bars(s, d)),
      f"{B}\nselect symbol, session, slot, (h - l) / o as range_pct, abs(c - o) / nullif(h - l, 0) as body_to_range, (h - greatest(o, c)) / nullif(h - l, 0) as upper_wick, (least(o, c) - l) / nullif(h - l, 0) as lower_wick, (c - l) / nullif(h - l, 0) as close_location, c / o - 1 as bar_return, ln(c / o) as bar_log_return from bars")
RUN = "run as (select *, sum(c * v) over w / sum(v) over w as svwap, max(h) over w as hi, min(l) over w as lo, sum(v) over w as cv, first_value(o) over w as so from bars window w as (partition by symbol, session order by slot))"
R.add("session_running", K, "cumulative_volume", "return_since_open distance_vwap distance_high distance_low range_position volume_share", lambda s, d: op.running(bars(s, d)),
      f"{B}, {RUN}\nselect symbol, session, slot, c / so - 1 as return_since_open, c / svwap - 1 as distance_vwap, c / hi - 1 as distance_high, c / lo - 1 as distance_low, (c - lo) / nullif(hi - lo, 0) as range_position, cv as cumulative_volume, v / cv as volume_share from run")
R.add("lag_flags", K, "inside_bar outside_bar higher_high higher_low lower_high lower_low", "", lambda s, d: op.flags(bars(s, d)),
      f"{B}, {SEG}, lf as (select *, lag(h) over w as ph, lag(l) over w as pl from segs window w as (partition by symbol, session, seg order by slot))\nselect symbol, session, slot, (h < ph and l > pl)::int as inside_bar, (h > ph and l < pl)::int as outside_bar, (h > ph)::int as higher_high, (l > pl)::int as higher_low, (h < ph)::int as lower_high, (l < pl)::int as lower_low from lf")
ISL = "isl as (select *, coalesce((ret_1 > 0)::int, 0) as up, coalesce((ret_1 < 0)::int, 0) as down from seg1), isl2 as (select *, sum(1 - up) over w as ub, sum(1 - down) over w as db from isl window w as (partition by symbol, session, seg order by slot))"
R.add("run_length", K, "up_run down_run", "", lambda s, d: op.run_lengths(bars(s, d)),
      f"{B}, {op.BASE_SQL}, {ISL}\nselect symbol, session, slot, sum(up) over (partition by symbol, session, seg, ub order by slot) as up_run, sum(down) over (partition by symbol, session, seg, db order by slot) as down_run from isl2")
R.add("vwap_slope_cross", K, "vwap_cross", "vwap_slope", lambda s, d: op.vwap_cross(bars(s, d)),
      f"{B}, {RUN}, {SEG}, vs as (select r.*, g.seg, sign(r.c - svwap) as side from run r join segs g using (symbol, session, slot))\nselect symbol, session, slot, svwap - lag(svwap) over w as vwap_slope, (side <> lag(side) over w)::int as vwap_cross from vs window w as (partition by symbol, session, seg order by slot)")
R.add("calendar_feats", K, "minutes_since_open day_of_week month quarter", "time_sin time_cos", lambda s, d: op.calendar(bars(s, d)),
      f"{B}\nselect symbol, session, slot, (slot + 1) * 120 as minutes_since_open, isodow(session::date) - 1 as day_of_week, month(session::date) as month, quarter(session::date) as quarter, sin(2 * 3.141592653589793::double * (slot + 1) / 12) as time_sin, cos(2 * 3.141592653589793::double * (slot + 1) / 12) as time_cos from bars")
LOOK = """look as (select *, case when ret_1 < 0 then ret_1 end as neg, case when ret_1 > 0 then ret_1 end as pos, c / lag(c, 4) over s - 1 as ret_n, case when count(h) over w >= 4 then max(h) over w end as hi, case when count(l) over w >= 4 then min(l) over w end as lo,
 case when count(ret_1) over w >= 4 then stddev_samp(ret_1) over w end as vol_n, case when count(v) over p >= 4 then avg(v) over p end as volume_mean, case when count(*) over w >= 4 then avg(coalesce((ret_1 > 0)::int, 0)::double) over w end as consistency,
 case when count(ret_1) over w >= 4 then sum(greatest(ret_1, 0.0::double)) over w end as pos_sum0, case when count(ret_1) over w >= 4 then sum(least(ret_1, 0.0::double)) over w end as neg_sum0, case when count(v) over w >= 4 then sum(v) over w end as volume_sum, case when count(v) over w >= 4 then avg(c * v) over w end as dollar_mean,
 case when count(ret_1) over w >= 4 then max(ret_1) over w end as largest_up, case when count(ret_1) over w >= 4 then min(ret_1) over w end as largest_down, case when count(v) over f >= 2 then avg(v) over f end as half_mean, case when count(v) over w >= 4 then sum(c * v) over w / sum(v) over w end as rvwap
 from seg1 window s as (partition by symbol, session, seg order by slot), w as (partition by symbol, session, seg order by slot rows between 3 preceding and current row), f as (partition by symbol, session, seg order by slot rows between 1 preceding and current row), p as (partition by symbol, session, seg order by slot rows between 4 preceding and 1 preceding)),
look2 as (select *, case when count(neg) over w >= 2 then stddev_samp(neg) over w end as down_vol, case when count(pos) over w >= 2 then stddev_samp(pos) over w end as up_vol, lag(hi) over (partition by symbol, session, seg order by slot) as phi,
 case when largest_up is not null then (select 1) end as some from look window w as (partition by symbol, session, seg order by slot rows between 3 preceding and current row))"""
SUMS = "case when pos_sum0 is null then null else pos_sum0 end as pos_sum, case when neg_sum0 is null then null else neg_sum0 end as neg_sum"
for name, cols in {
    "rolling_returns": "ret_n log_ret_n pos_sum neg_sum largest_up largest_down consistency", "rolling_vol_split": "vol_n down_vol up_vol ret_vol_ratio outlier_score",
    "rolling_volume": "volume_sum volume_mean rel_volume dollar_mean rolling_vwap_dist volume_accel", "range_breakout": "dist_high dist_low range_pos breakout",
}.items():
    R.add(name, K, "", cols, lambda s, d: op.lookback(bars(s, d), 4),
          f"{B}, {op.BASE_SQL}, {LOOK}\nselect symbol, session, slot, ret_n, ln(1 + ret_n) as log_ret_n, {SUMS}, largest_up, largest_down, consistency, vol_n, down_vol, up_vol, ret_n / nullif(vol_n, 0) as ret_vol_ratio, ret_1 / nullif(vol_n, 0) as outlier_score, volume_sum, volume_mean, v / nullif(volume_mean, 0) as rel_volume, dollar_mean, c / rvwap - 1 as rolling_vwap_dist, half_mean / nullif(volume_mean, 0) - 1 as volume_accel, c / hi - 1 as dist_high, c / lo - 1 as dist_low, (c - lo) / nullif(hi - lo, 0) as range_pos, case when phi is not null then greatest(c / phi - 1, 0) end as breakout from look2")
R.add("base_features", K, "", "ret_1 vol_3 range_pos_3 rel_vol_3 up", feats, f"{B}, {op.BASE_SQL}\nselect * from feat")
R.add("fwd_return_asof", K, "entry_slot", "fwd_1 fwd_2", targets, f"{B}, {op.TARGET_SQL}\nselect * from tgt")
R.add("fwd_eod", K, "", "fwd_eod", targets, f"{B}, {op.TARGET_SQL}\nselect * from tgt")
R.add("benchmark_adjusted", K, "", "adj_1", lambda s, d: op.benchmark_adjusted(targets(s, d)), f"{B}, {op.TARGET_SQL}\nselect t.symbol, t.session, t.slot, t.fwd_1 - b.fwd_1 as adj_1 from tgt t left join tgt b on b.symbol = 'S0' and b.session = t.session and b.slot = t.slot")
DAYS = """dd as (select symbol, session, arg_min(o, slot) as so, arg_max(c, slot) as sc from bars group by all), sr as (select symbol, session, lag(sc) over w / lag(sc, 2) over w - 1 as previous_session_return, so / lag(sc) over w - 1 as overnight_gap, lag(sc) over w / lag(sc, 3) over w - 1 as session_return_2, sc / lag(sc) over w - 1 as day_return from dd window w as (partition by symbol order by session)),
bt0 as (select a.symbol, a.session, case when m.day_return is not null then a.day_return end as y, case when a.day_return is not null then m.day_return end as m, m.day_return as every from sr a left join sr m on m.symbol = 'S0' and m.session = a.session), bt as (select symbol, session, case when count(y) over w >= 5 and count(every) over w >= 5 then covar_samp(y, m) over w / nullif(var_samp(every) over w, 0) end as beta from bt0 window w as (partition by symbol order by session rows between 10 preceding and 1 preceding))"""
R.add("prior_session_return", "symbol session", "", "previous_session_return overnight_gap session_return_2", lambda s, d: op.session_returns(bars(s, d)), f"{B}, {DAYS}\nselect * from sr")
R.add("rolling_beta", "symbol session", "", "beta", lambda s, d: op.session_betas(bars(s, d)), f"{B}, {DAYS}\nselect * from bt")
R.add("beta_residual", K, "", "resid_1", lambda s, d: (t := targets(s, d)).join(t.where("symbol = 'S0'").select("session", "slot", F.col("fwd_1").alias("b_1")), ["session", "slot"], "left").join(op.session_betas(bars(s, d)), ["symbol", "session"], "left").withColumn("resid_1", F.col("fwd_1") - F.col("beta") * F.col("b_1")),
      f"{B}, {op.TARGET_SQL}, {DAYS}\nselect t.symbol, t.session, t.slot, t.fwd_1 - bt.beta * b.fwd_1 as resid_1 from tgt t left join tgt b on b.symbol = 'S0' and b.session = t.session and b.slot = t.slot left join bt on bt.symbol = t.symbol and bt.session = t.session")
XS = "xs as (select *, case when ret_1 is not null then (rank() over (partition by session, slot order by ret_1 nulls last) + (count(ret_1) over (partition by session, slot, ret_1) - 1) / 2.0) / count(ret_1) over p end as ret_rank, case when rel_vol_3 is not null then (rank() over (partition by session, slot order by rel_vol_3 nulls last) + (count(rel_vol_3) over (partition by session, slot, rel_vol_3) - 1) / 2.0) / count(rel_vol_3) over p end as volume_rank, avg((ret_1 > 0)::int) over p as breadth, stddev_samp(ret_1) over p as dispersion from feat where symbol <> 'S0' window p as (partition by session, slot))"
R.add("xs_rank_pct", K, "", "ret_rank volume_rank", lambda s, d: op.cross_section(feats(s, d)), f"{B}, {op.BASE_SQL}, {XS}\nselect * from xs")
R.add("breadth_dispersion", K, "", "breadth dispersion", lambda s, d: op.cross_section(feats(s, d)), f"{B}, {op.BASE_SQL}, {XS}\nselect * from xs")
MK = "mk as (select session, slot, ret_1 as market, vol_3 as mvol, lag(ret_1) over w as market_lag_1, case when count(vol_3) over w >= 10 then quantile_cont(vol_3, 0.5) over w end as mm from feat where symbol = 'S0' window w as (order by session, slot rows between unbounded preceding and current row))"
R.add("market_relative", K, "high_vol", "market minus_market market_lag_1", lambda s, d: op.market_relative(feats(s, d)), f"{B}, {op.BASE_SQL}, {MK}\nselect f.symbol, f.session, f.slot, market, ret_1 - market as minus_market, market_lag_1, case when mvol is not null then coalesce((mvol > mm)::int, 0) end as high_vol from feat f left join mk using (session, slot)")
R.add("tod_relative_volume", K, "", "tod_relative_volume", lambda s, d: op.time_of_day(bars(s, d)), f"{B}\nselect symbol, session, slot, case when count(v) over w >= 5 then v / avg(v) over w end as tod_relative_volume from bars window w as (partition by symbol, slot order by session rows between 10 preceding and 1 preceding)")
R.add("norm_z_median", K, "", "ret_z ret_median_diff volume_mean_ratio", lambda s, d: op.normalised(feats(s, d)),
      f"{B}, {op.BASE_SQL}\nselect symbol, session, slot, case when count(ret_1) over w >= 10 then (ret_1 - avg(ret_1) over w) / nullif(stddev_samp(ret_1) over w, 0) end as ret_z, case when count(ret_1) over w >= 10 then ret_1 - quantile_cont(ret_1, 0.5) over w end as ret_median_diff, case when count(rel_vol_3) over w >= 10 then rel_vol_3 / nullif(avg(rel_vol_3) over w, 0) end as volume_mean_ratio from feat window w as (partition by symbol order by session, slot rows between 40 preceding and 1 preceding)")
R.add("opening_window", K, "opening_volume opening_breakout", "opening_return opening_range", lambda s, d: op.opening(bars(s, d)),
      f"{B}, og as (select symbol, session, count(*) as n, max(h) as hi, min(l) as lo, sum(v) as ov, arg_min(o, slot) as fo, arg_max(c, slot) as lc from bars where slot < 3 group by all)\nselect b.symbol, b.session, b.slot, lc / fo - 1 as opening_return, (hi - lo) / fo as opening_range, ov as opening_volume, case when og.n is not null then (c > hi)::int end as opening_breakout from bars b left join og on og.symbol = b.symbol and og.session = b.session and og.n = 3 and b.slot >= 2")
R.add("split_factor", "symbol session", "", "split_factor", lambda s, d: op.split_factors(bars(s, d), actions(s, d)), f"{B}, {ACTIONS}\nselect x.symbol, x.session, coalesce((select product(ratio) from acts where acts.symbol = x.symbol and ex_date > x.session), 1.0) as split_factor from (select distinct symbol, session from bars) x")
R.add("dividend_factor", "symbol session", "", "dividend_factor", lambda s, d: op.dividend_factors(bars(s, d), actions(s, d)),
      f"{B}, {ACTIONS}, dc as (select symbol, session, arg_max(c, slot) as sc from bars group by all), kk as (select a.symbol, a.ex_date, 1 - cash / arg_max(sc, session) as k from acts a join dc on dc.symbol = a.symbol and session < ex_date group by a.symbol, a.ex_date, cash having arg_max(sc, session) > cash)\nselect x.symbol, x.session, coalesce((select product(k) from kk where kk.symbol = x.symbol and ex_date > x.session), 1.0) as dividend_factor from dc x")


def master(s, d):
    """Invented effective dates: each symbol changes its identity on the 16th of a month."""
    one = bars(s, d).select("symbol", F.concat(F.substring("session", 1, 8), F.lit("01")).alias("m")).distinct()
    half = F.concat(F.substring("m", 1, 8), F.lit("16"))
    both = one.select("symbol", F.concat("symbol", F.lit("-a")).alias("identity"), F.col("m").alias("valid_from"), half.alias("valid_to"))
    return both.unionByName(one.select("symbol", F.concat("symbol", F.lit("-b")).alias("identity"), half.alias("valid_from"), F.concat(F.substring("m", 1, 8), F.lit("99")).alias("valid_to")))


R.add("interval_join_master", "symbol session slot identity", "", "c", lambda s, d: op.valid_at(bars(s, d), master(s, d), "symbol", "session"), f"{B}\nselect symbol, session, slot, c, symbol || case when substr(session, 9, 2) < '16' then '-a' else '-b' end as identity from bars")
R.add("pit_membership", "symbol session slot role", "", "c", lambda s, d: (m := bars(s, d)).join(m.groupBy("symbol").agg(F.sum("v").alias("tv")).where("symbol <> 'S9'").select("symbol", F.lit(True).alias("is_member")), "symbol", "left").withColumn("role", F.when(F.col("symbol") == "S0", "benchmark").when(F.coalesce("is_member", F.lit(False)), "tradable").otherwise("ineligible")).where("role <> 'ineligible'"),
      f"{B}\nselect symbol, session, slot, c, case when symbol = 'S0' then 'benchmark' else 'tradable' end as role from bars where symbol <> 'S9'")
R.add("eligibility", "symbol session eligible", "n", "", lambda s, d: bars(s, d).join(op.completeness(bars(s, d)), ["symbol", "session"]).groupBy("symbol", "session", (F.col("grid_ok") & (F.col("symbol") != "S0")).alias("eligible")).agg(F.count(F.lit(1)).alias("n")),
      f"{B}\nselect symbol, session, greatest(12 - count(distinct slot), 0) <= 2 and symbol <> 'S0' as eligible, count(*) as n from bars group by symbol, session")
R.add("pit_validation_counts", "", "n_rows entry_before_decision bad_price bad_volume target_without_entry", "", lambda s, d: op.pit_violations(feats(s, d), targets(s, d)), f"{ALL}\nselect count(*) as n_rows, count(*) filter (entry_slot <= slot) as entry_before_decision, count(*) filter (c <= 0) as bad_price, count(*) filter (v < 0) as bad_volume, count(*) filter (entry_slot is null and fwd_1 is not null) as target_without_entry from feat left join tgt using (symbol, session, slot)")
R.add("holdout_guard", "last_seen", "sealed_rows", "", lambda s, d: op.holdout_guard(bars(s, d), "session", "2100-01-01"), f"{B}\nselect count(*) filter (session >= '2100-01-01') as sealed_rows, max(session) as last_seen from bars")
R.add("source_provenance", "symbol first_session last_session", "n_rows n_sessions", "", lambda s, d: op.provenance(bars(s, d), "symbol"), f"{B}\nselect symbol, count(*) as n_rows, min(session) as first_session, max(session) as last_session, count(distinct session) as n_sessions from bars group by symbol")
LL = "ld as (select session, slot, max(ret_1) filter (symbol = 'S0') as m, avg((ret_1 > 0)::int) filter (symbol <> 'S0') as b, stddev_samp(ret_1) filter (symbol <> 'S0') as sd from feat group by all), ll as (select session, slot, lag(m) over w as lag_market, lag(b) over w - lag(b, 2) over w as lag_breadth_change, lag(sd) over w - lag(sd, 2) over w as lag_dispersion_change from ld window w as (order by session, slot))"
R.add("lead_lag", K, "", "lag_market lag_breadth_change lag_dispersion_change unreacted", lambda s, d: op.lead_lag(feats(s, d)), f"{B}, {op.BASE_SQL}, {LL}\nselect symbol, session, slot, lag_market, lag_breadth_change, lag_dispersion_change, lag_market - lag(ret_1) over (partition by symbol order by session, slot) as unreacted from feat join ll using (session, slot)")
R.add("acceleration", K, "", "vol_accel", lambda s, d: op.volatility_acceleration(bars(s, d)), f"{B}, {op.BASE_SQL}\nselect symbol, session, slot, case when count(ret_1) over f >= 2 then stddev_samp(ret_1) over f end / nullif(case when count(ret_1) over w >= 4 then stddev_samp(ret_1) over w end, 0) - 1 as vol_accel from seg1 window w as (partition by symbol, session, seg order by slot rows between 3 preceding and current row), f as (partition by symbol, session, seg order by slot rows between 1 preceding and current row)")
R.add("checkpoint_vwap", "symbol session", "first_volume last_volume largest_volume", "vwap_2 vwap_5 vwap_8", lambda s, d: op.checkpoints(bars(s, d)), f"{B}\nselect symbol, session, max(vwap) filter (slot = 2) as vwap_2, max(vwap) filter (slot = 5) as vwap_5, max(vwap) filter (slot = 8) as vwap_8, sum(v) filter (slot < 3) as first_volume, sum(v) filter (slot >= 9) as last_volume, max(v) as largest_volume from bars group by symbol, session")


def schedule(s, d):
    """Invented by rule: sessions run from slot 2 to 10, to 7 on days that end in 5."""
    days = bars(s, d).select("session").distinct()
    return days.select("session", F.lit(2).alias("opens"), F.when(F.substring("session", 10, 1) == "5", 7).otherwise(10).alias("closes"))


R.add("calendar_join", K, "missing from_open", "c", lambda s, d: op.calendar_join(bars(s, d), schedule(s, d)), f"{B}, sd as (select *, 2 as opens, case when substr(session, 10, 1) = '5' then 7 else 10 end as closes from bars)\nselect *, closes - opens + 1 - count(*) over (partition by symbol, session) as missing, slot - opens as from_open from sd where slot between opens and closes")
R.add(
    "high_vol_expanding_median", K, "high_market_vol", "", lambda s, d: op.high_volatility(feats(s, d)),
    f"""{B}, {op.BASE_SQL}, hv as (select session, slot, coalesce((vol_3 > case when count(vol_3) over w >= 20 then quantile_cont(vol_3, 0.5) over w end)::int, 0) as high_market_vol from feat where symbol = 'S0' window w as (order by session, slot rows between unbounded preceding and current row))
select f.symbol, f.session, f.slot, high_market_vol from feat f left join hv using (session, slot)""",
)
R.add(
    "dispersion_bucket", "session slot bucket", "", "dispersion prior", lambda s, d: op.dispersion_bucket(feats(s, d)),
    f"""{B}, {op.BASE_SQL}, ds0 as (select session, slot, stddev_samp(ret_1) as dispersion from feat where symbol <> 'S0' group by all), ds1 as (select *, case when count(dispersion) over w >= 20 then quantile_cont(dispersion, 0.5) over w end as prior from ds0 window w as (order by session, slot rows between unbounded preceding and 1 preceding))
select *, case when prior is null then null when dispersion >= prior then 'high_dispersion' else 'low_dispersion' end as bucket from ds1""",
)
R.add(
    "rolling_beta_residual", K, "", "beta residual", lambda s, d: op.beta_residual_returns(feats(s, d)),
    f"""{B}, {op.BASE_SQL}, be0 as (select f.symbol, f.session, f.slot, f.ret_1, g.ret_1 as m, case when g.ret_1 is not null then f.ret_1 end as y, case when f.ret_1 is not null then g.ret_1 end as x from feat f left join feat g on g.symbol = 'S0' and g.session = f.session and g.slot = f.slot), be as (select *, case when count(y) over w >= 10 then covar_samp(y, x) over w / nullif(var_samp(x) over w, 0) end as beta from be0 window w as (partition by symbol order by session, slot rows between 20 preceding and 1 preceding))
select *, ret_1 - beta * m as residual from be""",
)
