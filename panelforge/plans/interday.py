"""Queries of the interday group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from panelforge.operators import actions as ca
from panelforge.operators import grid
from panelforge.operators import interday as op
from panelforge.operators import selection
from panelforge.operators.screening import normal_p, normal_p_sql
from panelforge.sources import views as v
from panelforge.sources.shared import cut

from .registry import Registry

R = Registry()
K = "security session"
D = f"with {v.DAILY_SQL}, {v.DENSE_SQL}, dr as (select *, c / lag(c) over (partition by security order by t) - 1 as ret from daily)"


def panel(s, d):
    return v.densify(v.daily(v.read(s, d, "lineitem")))


def q(name, longs, doubles, fn, select, keys=K):
    R.add(name, keys, longs, doubles, lambda s, d: fn(panel(s, d)), f"{D}{select}")


BY = "partition by security order by t"
W6 = f"w as ({BY} rows between 5 preceding and current row)"
q("daily_panel", "t n", "o h l c v dollars", lambda p: p, "\nselect * from daily")
q("liquidity_median", "", "prior_median_dollars", op.liquidity, f"\nselect security, session, case when count(dollars) over w >= 6 then quantile_cont(dollars, 0.5) over w end as prior_median_dollars from daily window w as ({BY} rows between 12 preceding and 1 preceding)")
ACT = "act as (select security, session, case when security % 3 = 0 then 2.0::double else 1.0::double end as ratio, case when security % 2 = 0 then 0.5::double else 0.0::double end as cash from daily where t % 12 = 6), ai as (select d.security, d.session, t, c, exp(sum(ln(coalesce(ratio, 1))) over (partition by d.security order by t)) as split_index, coalesce(cash, 0) as cash from daily d left join act using (security, session)), ax as (select *, sum(split_index * cash) over (partition by security order by t) as cum_dividend from ai)"


def actions(p):
    """Invented by rule: in every twelfth session a third of the securities splits and half pay."""
    return p.where("t % 12 = 6").select("security", "session", F.when(F.col("security") % 3 == 0, 2.0).otherwise(1.0).alias("ratio"), F.when(F.col("security") % 2 == 0, 0.5).otherwise(0.0).alias("cash"))


q("action_index", "", "split_index cum_dividend", lambda p: op.action_index(p, actions(p)), f", {ACT}\nselect * from ax")
q("interval_total_return", "", "total_return", lambda p: op.total_return(op.action_index(p, actions(p))), f", {ACT}\nselect security, session, (lead(split_index, 3) over w / split_index * lead(c, 3) over w + (lead(cum_dividend, 3) over w - cum_dividend) / split_index) / c - 1 as total_return from ax window w as ({BY})")
q("window_features", "", "ret_n positive_fraction path_efficiency drawdown distance_low range_position distance_sma realised_vol relative_volume volume_z", op.window_features,
  f", wf as (select *, count(ret) over w >= 6 as full_, count(c) over w >= 6 as cf, count(v) over w >= 6 as vf, max(c) over w as hi, min(c) over w as lo, avg(c) over w as sma, avg((ret > 0)::int) over w as pf, sum(ret) over w as sr, sum(abs(ret)) over w as sa, stddev_pop(ret) over w as sdev, avg(v) over w as mv, stddev_pop(v) over w as sv, lag(c, 6) over ({BY}) as c6 from dr window {W6})\nselect security, session, case when full_ then c / c6 - 1 end as ret_n, case when full_ then pf end as positive_fraction, case when full_ then abs(sr) / nullif(sa, 0) end as path_efficiency, case when cf then c / hi - 1 end as drawdown, case when cf then c / lo - 1 end as distance_low, case when cf then (c - lo) / nullif(hi - lo, 0) end as range_position, case when cf then c / sma - 1 end as distance_sma, case when full_ then sdev end as realised_vol, case when vf then v / nullif(mv, 0) end as relative_volume, case when vf then (v - mv) / nullif(sv, 0) end as volume_z from wf")
q("trend_ols", "", "trend_slope trend_r2", op.trend, f"\nselect security, session, case when count(c) over w >= 6 then regr_slope(ln(c), t / 2.5::double) over w end as trend_slope, case when count(c) over w >= 6 then regr_r2(ln(c), t / 2.5::double) over w end as trend_r2 from daily window {W6}")
q("atr", "", "atr_pct", op.atr, f", tr as (select *, lag(c) over ({BY}) as pc from daily), tr2 as (select *, case when pc is not null and h is not null then greatest(h - l, abs(h - pc), abs(l - pc)) end as tr from tr)\nselect security, session, case when count(tr) over w >= 6 then avg(tr) over w / c end as atr_pct from tr2 window {W6}")
q("prior_beta", "", "beta residual", op.prior_beta, f", mk as (select *, avg(ret) over (partition by session) as m from dr), pb as (select *, case when count(ret) over w >= 8 then covar_pop(ret, case when ret is not null then m end) over w / nullif(var_pop(case when ret is not null then m end) over w, 0) end as beta from mk window w as ({BY} rows between 12 preceding and 1 preceding))\nselect security, session, beta, ret - beta * m as residual from pb")
R.add("leave_one_out", K + " sector", "", "sector_return sector_excess", lambda s, d: op.leave_one_out(panel(s, d), v.sectors(v.read(s, d, "supplier"), v.read(s, d, "nation"))),
      f"{D}, {v.SECTORS_SQL}, lo as (select security, session, sector, ret, case when ret is not null and count(ret) over w - 1 >= 3 then (sum(ret) over w - ret) / (count(ret) over w - 1) end as sector_return from dr join sectors using (security) window w as (partition by session, sector))\nselect *, ret - sector_return as sector_excess from lo")
q("gap_fill", "", "gap gap_fill", op.gap_fill, f", gp as (select *, o / lag(c) over ({BY}) - 1 as gap from daily)\nselect security, session, gap, case when abs(gap) >= 0.001 then sign(-gap) * (c / o - 1) / abs(gap) end as gap_fill from gp")
q("days_since_extreme", "since_high since_low", "", op.since_extreme, f", se as (select *, max({{'c': c, 't': t}}) filter (c is not null) over w as mh, max({{'c': -c, 't': t}}) filter (c is not null) over w as ml, count(c) over w as k from daily window {W6})\nselect security, session, case when k >= 6 then t - mh.t end as since_high, case when k >= 6 then t - ml.t end as since_low from se")
q("streaks", "up_streak", "", op.streaks, f", st as (select *, sum(case when ret > 0 then 0 else 1 end) over ({BY}) as b from dr)\nselect security, session, case when ret is not null then sum(coalesce((ret > 0)::int, 0)) over (partition by security, b order by t) end as up_streak from st")
TG = f"tg0 as (select *, lead(o) over w as en, lead(c, 3) over w as ex, lead(t, 3) over w as lt from daily window w as ({BY})), tg as (select security, session, t, case when c is null then 'no_bar' when lt is null then 'beyond_calendar' when en is null then 'no_entry' when ex is null then 'no_exit' else 'ok' end as reason, case when c is not null and lt is not null then ex / en - 1 end as target from tg0)"
q("targets_lead", "", "target", op.targets, f", {TG}\nselect * from tg")
q("reason_codes", "n", "", lambda p: op.targets(p).groupBy("reason").agg(F.count(F.lit(1)).alias("n")), f", {TG}\nselect reason, count(*) as n from tg group by all", keys="reason")


def ranked(p):
    return op.rank_bins(op.returns(p).withColumn("x", F.col("ret")))


RB = "rb0 as (select security, session, t, ret as x, count(*) over (partition by session) as n, rank() over (partition by session order by ret) + (count(*) over (partition by session, ret) - 1) / 2.0 as ra, dense_rank() over (partition by session order by ret) as dn, ntile(10) over (partition by session order by ret, security) - 1 as nt from dr where ret is not null), rb as (select security, session, t, case when n >= 10 and max(dn) over (partition by session) >= 10 then (ra - 0.5) / n end as pct, case when n >= 10 and max(dn) over (partition by session) >= 10 then nt end as decile from rb0)"
q("rank_bins", "decile", "pct", ranked, f", {RB}\nselect * from rb")
q("rank_persistence", "n", "persistence", lambda p: op.persistence(ranked(p)), f", {RB}, rp as (select a.t, a.pct, b.pct as q from rb a join rb b on a.security = b.security and b.t = a.t + 1 where a.pct is not null and b.pct is not null), rp2 as (select t, rank() over (partition by t order by pct) + (count(*) over (partition by t, pct) - 1) / 2.0 as x, rank() over (partition by t order by q) + (count(*) over (partition by t, q) - 1) / 2.0 as y from rp)\nselect t, count(*) as n, covar_pop(x, y) / nullif(sqrt(var_pop(x) * var_pop(y)), 0) as persistence from rp2 group by t", keys="t")
q("tail_turnover", "", "turnover", lambda p: op.turnover(ranked(p), p), f", {RB}, tw as (select security, session, 1.0::double / count(*) over (partition by session) as w from rb where decile = 9), tv as (select d.session, abs(coalesce(w, 0) - lag(coalesce(w, 0)) over (partition by d.security order by t)) as dv from daily d left join tw using (security, session))\nselect session, sum(dv) / 2 as turnover from tv group by session", keys="session")
DP = f"{TG}, {RB}, dp0 as (select session, decile, target, rank() over (partition by session order by pct) + (count(*) over (partition by session, pct) - 1) / 2.0 as x, rank() over (partition by session order by target) + (count(*) over (partition by session, target) - 1) / 2.0 as y from rb join tg using (security, session) where pct is not null and target is not null), dp as (select session, count(*) as n, covar_pop(x, y) / nullif(sqrt(var_pop(x) * var_pop(y)), 0) as ic, avg(target) filter (decile = 9) - avg(target) filter (decile = 0) as top_bottom, avg(target) filter (decile = 9) - avg(target) filter (decile in (4, 5)) as top_middle, avg(target) filter (decile in (4, 5)) - avg(target) filter (decile = 0) as middle_bottom from dp0 group by session)"
q("daily_pair_series", "n", "ic top_bottom top_middle middle_bottom", lambda p: op.daily_pairs(ranked(p), op.targets(p)), f", {DP}\nselect * from dp", keys="session")


def ic_series(p):
    return p.select("session", "t").distinct().join(op.daily_pairs(ranked(p), op.targets(p)).select("session", "ic"), "session", "left")


LAGS = ", ".join(f"avg(dv * lag{k}) as g{k}" for k in range(1, 6))
NW = f"nw0 as (select c.t, ic, ic - avg(ic) over () as dv from cal c left join dp using (session)), nw1 as (select *, {', '.join(f'lag(dv, {k}) over (order by t) as lag{k}' for k in range(1, 6))} from nw0), nw2 as (select count(ic) as n, avg(ic) as mean, avg(dv * dv) as g0, {LAGS} from nw1), nw3 as (select n, mean, sqrt(greatest(g0 + {' + '.join(f'2 * (1 - {k} / 6.0::double) * coalesce(g{k}, 0)' for k in range(1, 6))}, 0) / n) as se from nw2)"
q("newey_west", "n", "mean se t", lambda p: op.newey_west(ic_series(p), "ic"), f", {DP}, {NW}\nselect n, mean, case when n >= 20 then se end as se, case when n >= 20 then mean / nullif(se, 0) end as t from nw3", keys="")


def profile(p):
    """Mean target by horizon."""
    rows = [op.targets(p, k).agg(F.avg("target").alias("effect")).select(F.lit(k).alias("horizon"), "effect") for k in range(1, 6)]
    return reduce(lambda a, b: a.unionByName(b), rows)


HZ = "hz as (" + " union all ".join(f"select {k} as horizon, avg(x) as effect from (select case when c is not null then lead(c, {k}) over w / lead(o) over w - 1 end as x from daily window w as ({BY}))" for k in range(1, 6)) + ")"
q("horizon_profile", "", "effect", profile, f", {HZ}\nselect * from hz", keys="horizon")
q("neighbor_support", "before after", "effect", lambda p: op.neighbours(profile(p)), f", {HZ}\nselect horizon, effect, (lag(effect) over w / effect >= 0.5)::int as before, (lead(effect) over w / effect >= 0.5)::int as after from hz window w as (order by horizon)", keys="horizon")

FULL = f"w as ({BY} rows between 5 preceding and current row), b as ({BY} rows between 6 preceding and 1 preceding), s as ({BY})"
q(
    "return_components", "", "overnight_n regular_n overnight_minus_regular positive_overnight return_skip1 vol_scaled downside_vol acceleration", op.return_components,
    f""", rc0 as (select *, o / lag(c) over ({BY}) - 1 as night, c / o - 1 as day from dr), rc1 as (select *, case when count(ret) over w >= 6 then stddev_pop(ret) over w end as vol,
case when count(night) over w >= 6 then exp(sum(ln(1 + night)) over w) - 1 end as overnight_n, case when count(day) over w >= 6 then exp(sum(ln(1 + day)) over w) - 1 end as regular_n, case when count(night) over w >= 6 then avg((night > 0)::int) over w end as positive_overnight,
case when count(ret) over b >= 6 then lag(c) over s / lag(c, 7) over s - 1 end as return_skip1, case when count(ret) over w >= 6 then c / lag(c, 6) over s - 1 end as ret_n, case when count(ret) over w >= 4 then sqrt(avg(pow(case when ret < 0 then ret when ret >= 0 then 0 end, 2)) over w) end as downside_vol,
c / lag(c, 3) over s - lag(c, 3) over s / lag(c, 6) over s as acceleration from rc0 window {FULL})
select *, overnight_n - regular_n as overnight_minus_regular, ret_n / nullif(lag(vol) over ({BY}), 0) as vol_scaled from rc1""",
)
q(
    "flow_features", "", "amihud_millions volume_trend up_volume_share down_volume_share dollar_z range_shock", op.flow_features,
    f""", fl as (select *, abs(ret) / nullif(dollars, 0) as impact, case when ret is not null then v end as bv, (h - l) / nullif(c, 0) as rg from dr)
select security, session, case when count(impact) over w >= 6 then avg(impact) over w * 1e6 end as amihud_millions, case when count(v) over b >= 6 then v / nullif(avg(v) over b, 0) - 1 end as volume_trend, case when count(bv) over w >= 6 then sum(case when ret > 0 then bv else 0 end) over w / nullif(sum(bv) over w, 0) end as up_volume_share, case when count(bv) over w >= 6 then sum(case when ret < 0 then bv else 0 end) over w / nullif(sum(bv) over w, 0) end as down_volume_share, case when count(dollars) over b >= 6 then (dollars - avg(dollars) over b) / nullif(stddev_pop(dollars) over b, 0) end as dollar_z, case when count(rg) over b >= 4 then rg / nullif(avg(rg) over b, 0) end as range_shock from fl window {FULL}""",
)
q(
    "risk_features", "", "market_correlation downside_beta gap_shock residual_shock", op.risk_features,
    f""", rk0 as (select *, avg(ret) over (partition by session) as m, o / lag(c) over ({BY}) - 1 as gap from dr), rk1 as (select *, ret as y, case when ret is not null then m end as x from rk0), rk as (select *, case when x < 0 then y end as fy, case when x < 0 then x end as fx from rk1)
select security, session, case when count(y) over w >= 8 then covar_pop(y, x) over w / nullif(sqrt(var_pop(x) over w * var_pop(y) over w), 0) end as market_correlation, case when count(fy) over b >= 4 then case when var_pop(fx) over b > 1e-12 then covar_pop(fy, fx) over b / var_pop(fx) over b end end as downside_beta, case when count(gap) over b >= 8 then gap / nullif(stddev_pop(gap) over b, 0) end as gap_shock, case when count(ret) over b >= 8 then (y - x) / nullif(stddev_pop(ret) over b, 0) end as residual_shock from rk window w as ({BY} rows between 11 preceding and current row), b as ({BY} rows between 12 preceding and 1 preceding)""",
)


def tested(p):
    """Hypotheses of one pair with the normal p of their t, their rates, securities and neighbouring horizons, and whether they pass small gates."""
    series = op.daily_pairs(ranked(p), op.targets(p))
    rows = op.pair_tests(series, "ret", "target_3").withColumn("raw_p", normal_p("t")).withColumn("fdr_family", F.lit("all")).withColumn("feature_family", F.when(F.col("test_type") == "ic", "rank").otherwise("spread"))
    rows = selection.interday_fdr(rows).withColumn("test_type", F.when(F.col("test_type") == "ic", "rank_ic").otherwise(F.col("test_type")))
    paired = ranked(p).join(op.targets(p).select("security", "session", "target"), ["security", "session"]).where("pct is not null and target is not null")
    seen = paired.agg(F.countDistinct("security").alias("distinct_symbols")).withColumn("horizon", F.lit(3))
    beside = op.neighbours(profile(p)).select("horizon", (F.coalesce(F.greatest("before", "after"), F.lit(0)) == 1).alias("neighbor_supported"))
    rows = rows.withColumn("horizon", F.lit(3)).join(seen, "horizon").join(beside, "horizon")
    return selection.interday_gates(rows, fdr=0.9, ic_dates=20, decile_dates=20, symbols=10)


TS = """ts0 as (select unnest(['rank_ic', 'top_bottom', 'top_middle', 'middle_bottom']) as test_type, unnest([ic, top_bottom, top_middle, middle_bottom]) as e from dp), ts1 as (select test_type, count(*) as valid_dates, avg(e) as effect, avg(e) / nullif(stddev_samp(e) / sqrt(count(*)), 0) as t from ts0 where e is not null group by test_type),
ts2 as (select *, @P as raw_p, test_type = 'rank_ic' as fam from ts1), ts3 as (select *, raw_p * count(*) over () / row_number() over (order by raw_p, test_type) as q1, raw_p * count(*) over (partition by fam) / row_number() over (partition by fam order by raw_p, test_type) as q2 from ts2),
ts as (select *, least(1, min(q1) over (order by raw_p, test_type rows between current row and unbounded following)) as global_fdr, least(1, min(q2) over (partition by fam order by raw_p, test_type rows between current row and unbounded following)) as feature_family_fdr from ts3)""".replace("@P", normal_p_sql("t"))
q("interday_fdr", "valid_dates", "effect raw_p global_fdr feature_family_fdr", tested, f", {DP}, {TS}\nselect * from ts", keys="test_type")
q("interday_gates", "", "effect", tested, f", {DP}, {TS}, {HZ}, nb0 as (select horizon, (lag(effect) over w / effect >= 0.5)::int as before, (lead(effect) over w / effect >= 0.5)::int as after from hz window w as (order by horizon)), nb as (select coalesce(greatest(before, after), 0) = 1 as beside from nb0 where horizon = 3), ny as (select count(distinct security) as symbols from rb join tg using (security, session) where pct is not null and target is not null)\nselect *, (select symbols from ny) >= 10 and (select beside from nb) and global_fdr <= 0.9 and valid_dates >= 20 and abs(effect) >= case when test_type = 'rank_ic' then 0.01 else 12.0::double / 1e4 end as passes from ts", keys="test_type passes")
q(
    "horizon_shape", "peak_horizon sign_changes", "peak_effect retention area", lambda p: op.horizon_shape(profile(p).withColumn("one", F.lit(1)), ["one"]),
    f""", {HZ}, hs0 as (select *, lag(effect) over (order by horizon) as e0, lead(effect) over (order by horizon) as e1, lag(horizon) over (order by horizon) as h0 from hz), hs1 as (select sum((effect + e0) / 2 * (horizon - h0)) as area, count(*) filter (sign(effect) <> sign(e0)) as sign_changes from hs0), hs2 as (select horizon as peak_horizon, effect as peak_effect, greatest(sign(effect) * e0, sign(effect) * e1) / abs(effect) as retention from hs0 order by abs(effect) desc, horizon limit 1)
select * from hs2 cross join hs1""", keys="",
)
q(
    "cost_sensitivity", "n", "bps gross net", lambda p: op.cost_sensitivity(op.daily_pairs(ranked(p), op.targets(p)).select("session", F.col("top_bottom").alias("spread")), op.turnover(ranked(p), p)),
    f""", {DP}, tw as (select security, session, 1.0::double / count(*) over (partition by session) as w from rb where decile = 9), tv as (select d.session, abs(coalesce(w, 0) - lag(coalesce(w, 0)) over (partition by d.security order by d.t)) as m from daily d left join tw using (security, session)), to2 as (select session, sum(m) / 2 as turnover from tv group by session)
select bps, count(*) as n, avg(top_bottom) as gross, avg(top_bottom - 2 * bps / 1e4 * coalesce(turnover, 0)) as net from dp left join to2 using (session) cross join (select unnest([1.0::double, 3.0::double, 5.0::double]) as bps) where top_bottom is not null group by bps""", keys="",
)


def events(p):
    """Invented by rule, so that every kind and status occurs: splits and dividends twice a year, some without a ratio, an
    amount or a known kind; mergers, delistings with and without a value; one sequence given twice."""
    t, s = F.col("t"), F.col("security")
    none = F.lit(None).cast("double")

    def one(test, kind, split=none, cash=none, terminal=none, reference=none, back=none, seq=0):
        return F.when(test, F.struct(F.lit(seq).alias("action_sequence"), F.lit(kind).alias("action_type"), split.alias("split_ratio"), cash.alias("cash_amount"), terminal.alias("cash_out_value"), reference.alias("reference_price_before_delisting"), back.alias("delisting_return_from_reference")))

    made = F.array(
        one((t % 12 == 6) & (s % 3 == 0), "split", split=F.when(s % 33 == 0, none).otherwise(1.5)),
        one((t % 12 == 6) & (s % 2 == 0), "cash_dividend", cash=F.when(s % 26 == 0, none).otherwise(0.5), seq=1),
        one((t % 12 == 9) & (s % 17 == 0), "rename", seq=2),
        one((t == 30) & (s % 7 == 1), "cash_merger", terminal=F.lit(900.0), seq=3),
        one((t == 40) & (s % 7 == 2), "delisting", reference=F.lit(1000.0), back=F.lit(-0.3), seq=3),
        one((t == 50) & (s % 7 == 3), "delisting", reference=F.lit(1000.0), seq=3),
        one((t == 60) & (s % 19 == 4), "cash_merger", terminal=F.lit(10.0), seq=4),
        one((t == 60) & (s % 19 == 4), "cash_merger", terminal=F.lit(20.0), seq=4),
    )
    return p.select("security", "session", F.explode(made).alias("e")).where("e is not null").select("security", "session", "e.*")


EV = """ev0 as (select security, session, t, unnest([
 case when t % 12 = 6 and security % 3 = 0 then {'n': 0, 'k': 'split', 'r': case when security % 33 <> 0 then 1.5::double end, 'd': null::double, 'x': null::double, 'p': null::double, 'b': null::double} end,
 case when t % 12 = 6 and security % 2 = 0 then {'n': 1, 'k': 'cash_dividend', 'r': null, 'd': case when security % 26 <> 0 then 0.5::double end, 'x': null, 'p': null, 'b': null} end,
 case when t % 12 = 9 and security % 17 = 0 then {'n': 2, 'k': 'rename', 'r': null, 'd': null, 'x': null, 'p': null, 'b': null} end,
 case when t = 30 and security % 7 = 1 then {'n': 3, 'k': 'cash_merger', 'r': null, 'd': null, 'x': 900.0::double, 'p': null, 'b': null} end,
 case when t = 40 and security % 7 = 2 then {'n': 3, 'k': 'delisting', 'r': null, 'd': null, 'x': null, 'p': 1000.0::double, 'b': -0.3::double} end,
 case when t = 50 and security % 7 = 3 then {'n': 3, 'k': 'delisting', 'r': null, 'd': null, 'x': null, 'p': 1000.0::double, 'b': null} end,
 case when t = 60 and security % 19 = 4 then {'n': 4, 'k': 'cash_merger', 'r': null, 'd': null, 'x': 10.0::double, 'p': null, 'b': null} end,
 case when t = 60 and security % 19 = 4 then {'n': 4, 'k': 'cash_merger', 'r': null, 'd': null, 'x': 20.0::double, 'p': null, 'b': null} end]) as e from daily),
ev1 as (select security, session, t, e.n as action_sequence, e.k as action_type, e.r as split_ratio, case when e.k = 'cash_dividend' then e.d when e.k in ('cash_merger', 'delisting') then coalesce(e.x, e.p * (1 + e.b)) end as cash from ev0 where e is not null),
ev as (select *, case when count(*) over (partition by security, session, action_sequence) > 1 then 'duplicate_action_sequence' when action_type not in ('split', 'cash_dividend', 'cash_merger', 'delisting') then 'unknown_action_type' when action_type = 'split' and coalesce(split_ratio, 0) <= 0 then 'invalid_split_ratio' when action_type in ('cash_merger', 'delisting') and cash is null then 'unresolved_terminal_value' else 'valid' end as status from ev1)"""
UNTIL = "1998-06"


def sound(p):
    """Events that ``normalised`` lets through."""
    return ca.normalised(events(p).where("action_sequence not in (2, 4) and not (action_type = 'split' and split_ratio is null)"), UNTIL)


def indexed(name, doubles, fn, select, longs=""):
    q(name, longs, doubles, lambda p: fn(ca.index(p, sound(p))), f", {EV}, {IX}{select}")


IX = f"""ok as (select * from ev where session <= '{UNTIL}' and status in ('valid', 'unresolved_terminal_value') and action_sequence not in (2, 4)),
ey as (select security, session, product(split_ratio) filter (action_type = 'split') as ds, sum(cash) filter (action_type = 'cash_dividend') as dd, max(cash) filter (action_type in ('cash_merger', 'delisting')) as terminal_cash, max((action_type in ('cash_merger', 'delisting') and cash is null)::int) as un, max((action_type <> 'split' and cash is null)::int) as broken from ok group by all),
ix0 as (select d.*, terminal_cash, coalesce(un, 0) = 1 as unresolved, coalesce(broken, 0) as broken, coalesce(dd, 0) as dd, product(coalesce(ds, 1)) over ({BY}) as split_index from daily d left join ey using (security, session)),
ix as (select *, sum(split_index * dd) over ({BY}) as dividend_index, max(broken) over ({BY}) = 0 as action_valid from ix0)"""
q("corporate_action_status", "n", "", lambda p: ca.canonical(events(p), UNTIL).groupBy("action_type", "status").agg(F.count(F.lit(1)).alias("n")), f", {EV}\nselect action_type, status, count(*) as n from ev where session <= '{UNTIL}' group by all", keys="action_type status")
indexed("corporate_action_index", "split_index dividend_index terminal_cash", lambda x: x, "\nselect security, session, split_index, dividend_index, terminal_cash, unresolved::int as unresolved, action_valid::int as action_valid from ix", "unresolved action_valid")
FW = """fw0 as (select *, lead(c, 6) over w as ex, lead(split_index, 6) over w as ax, lead(dividend_index, 6) over w as cx, lead(action_valid, 6) over w as vx from ix window w as (partition by security order by t)),
fw as (select f.*, (select arg_min({'t': i.t, 'k': i.terminal_cash, 'a': i.split_index, 'c': i.dividend_index}, i.t) from ix i where i.security = f.security and i.t > f.t and i.t <= f.t + 6 and i.terminal_cash is not null) as te, (select min(i.t) from ix i where i.security = f.security and i.t > f.t and i.t <= f.t + 6 and i.unresolved) as ut from fw0 f)"""
GOOD = "ax is not null and action_valid and vx and not (ut is not null and (te is null or ut <= te.t))"
indexed("corporate_action_returns", "total_return price_return", lambda x: ca.forward(x, 6), f""", {FW}
select security, session, case when {GOOD} and c > 0 then (case when te is not null then (te.k * te.a + te.c - dividend_index) / split_index when ex > 0 then (ax * ex + cx - dividend_index) / split_index end) / c - 1 end as total_return, case when {GOOD} and c > 0 and te is null and ex > 0 then ax * ex / split_index / c - 1 end as price_return, (ax is not null and (not (action_valid and vx) or (c > 0 and ut is not null and (te is null or ut <= te.t))))::int as unresolved_interval from fw""", "unresolved_interval")
indexed("adjusted_daily_prices", "split_adjusted_open split_adjusted_high split_adjusted_low split_adjusted_close split_adjusted_volume daily_total_return overnight_total_return regular_session_return total_return_index", ca.adjusted, f""", ad0 as (select *, split_index / last_value(split_index) over (partition by security order by t rows between unbounded preceding and unbounded following) as adj, lag(c) over w as pc, lag(split_index) over w as ae, lag(dividend_index) over w as ce, lag(action_valid) over w as ve from ix window w as ({BY})),
ad1 as (select *, case when ae is not null and ve and action_valid and pc > 0 then (case when terminal_cash is not null then (terminal_cash * split_index + dividend_index - ce) / ae when c > 0 then (split_index * c + dividend_index - ce) / ae end) / pc - 1 end as daily_total_return, case when ae is not null and ve and action_valid and pc > 0 then (case when terminal_cash is not null then (terminal_cash * split_index + dividend_index - ce) / ae when o > 0 then (split_index * o + dividend_index - ce) / ae end) / pc - 1 end as overnight_total_return from ad0)
select security, session, o * adj as split_adjusted_open, h * adj as split_adjusted_high, l * adj as split_adjusted_low, c * adj as split_adjusted_close, v / adj as split_adjusted_volume, daily_total_return, overnight_total_return, case when o > 0 then c / o - 1 end as regular_session_return, case when count(*) filter (t > 1 and daily_total_return is null) over w = 0 then product(case when t = 1 then 1 else coalesce(1 + daily_total_return, 1) end) over w end as total_return_index from ad1 window w as ({BY})""")


GRID = ["ret", "ret_n", "realised_vol", "relative_volume"]
HORIZONS = {"target_1": 1, "target_3": 3, "target_7": 7}
GATES = grid.Gates(ranked=10, decile=10, quintile=10, ic=5, extreme=1, quintile_extreme=1)
FOLDS = {"first_half": (1, 43), "second_half": (43, 84), "last_24": (60, 84)}


def grid_panel(p):
    """Features and targets of the grid, one row a security and session."""
    made = op.returns(p).select("security", "session", "t", "ret").join(op.window_features(p).select("security", "session", *GRID[1:]), ["security", "session"])
    for name, k in HORIZONS.items():
        made = made.join(op.targets(p, k).select("security", "session", F.col("target").alias(name)), ["security", "session"])
    return cut(made)


def gridded(p):
    g = grid_panel(p)
    daily = cut(grid.daily_series(g, GRID, list(HORIZONS), GATES))
    return g, daily, grid.pair_grid(g, daily, GRID, HORIZONS, g.agg(F.max("t")).first()[0])


GS = f"""gp as (select f.security, f.session, d.t, d.ret, f.ret_n, f.realised_vol, f.relative_volume{''.join(f", case when d.c is not null then lead(d.c, {k}) over (partition by d.security order by d.t) / lead(d.o) over (partition by d.security order by d.t) - 1 end as {n}" for n, k in HORIZONS.items())} from ({R.plain['window_features']}) f join dr d using (security, session)),
gx as (select * from (select security, t, unnest({GRID}) as feature, unnest([{', '.join(GRID)}]) as x from gp) where x is not null), gy as (select * from (select security, t, unnest({list(HORIZONS)}) as target, unnest([{', '.join(HORIZONS)}]) as y from gp) where y is not null),
gb0 as (select *, count(*) over w as n, dense_rank() over (partition by t, feature order by x) as dn, ntile(10) over (partition by t, feature order by x, security) - 1 as d0, ntile(5) over (partition by t, feature order by x, security) - 1 as q0 from gx window w as (partition by t, feature)),
gb as (select *, n >= 10 and max(dn) over (partition by t, feature) >= 2 as ranked, case when n >= 10 and max(dn) over (partition by t, feature) >= 10 then d0 end as d, case when n >= 10 and max(dn) over (partition by t, feature) >= 5 then q0 end as q from gb0),
ga as (select t, feature, {', '.join(f"count(*) filter ({c}) as {a}" for a, c in (('a9', 'd = 9'), ('a5', 'd between 1 and 8'), ('a0', 'd = 0'), ('b4', 'q = 4'), ('b0', 'q = 0')))} from gb group by all),
gj as (select b.*, target, y, rank() over (partition by b.t, feature, target order by x) + (count(*) over (partition by b.t, feature, target, x) - 1) / 2.0::double as rx, rank() over (partition by b.t, feature, target order by y) + (count(*) over (partition by b.t, feature, target, y) - 1) / 2.0::double as ry from gb b join gy using (security, t)),
gd0 as (select t, feature, target, case when any_value(ranked) and count(*) >= 5 then covar_pop(rx, ry) / nullif(sqrt(var_pop(rx) * var_pop(ry)), 0) end as ic, case when any_value(ranked) then count(*) else 0 end as size, {', '.join(f"avg(y) filter ({c}) as m_{a}, count(*) filter ({c}) as n_{a}" for a, c in (('a9', 'd = 9'), ('a5', 'd between 1 and 8'), ('a0', 'd = 0'), ('b4', 'q = 4'), ('b0', 'q = 0')))} from gj group by all),
gd as (select t, feature, target, ic, size, {', '.join(f"case when n_{a} >= 1 and n_{a}::double / nullif({a}, 0) >= {s} then m_{a} end as v_{a}" for a, s in (('a9', 0.5), ('a5', 0.75), ('a0', 0.5), ('b4', 0.5), ('b0', 0.5)))}, {', '.join(f"coalesce(n_{a}, 0)::double / nullif({a}, 0) as c_{a}" for a in ('a9', 'a5', 'a0'))} from ga cross join (select unnest({list(HORIZONS)}) as target) left join gd0 using (t, feature, target)),
gs as (select t, feature, target, unnest({list(grid.TESTS)}) as test_type, unnest([ic, v_a9 - v_a0, v_a9 - v_a5, v_a5 - v_a0]) as e from gd),
gn0 as (select *, e - avg(e) over (partition by feature, target, test_type) as dv, case target when 'target_7' then 7 else 5 end as lag from gs where e is not null),
gn1 as (select *, {', '.join(f"dv * sum(dv) over (partition by feature, target, test_type order by t range between {k} preceding and {k} preceding) as g{k}" for k in range(1, 8))} from gn0),
gn2 as (select feature, target, test_type, lag, count(*) as n, avg(e) as effect, median(e) as median, stddev_samp(e) as std, avg((e > 0)::int) as positive_fraction, avg(dv * dv){''.join(f" + 2 * greatest(1 - {k} / (lag + 1.0::double), 0) * coalesce(avg(g{k}), 0)" for k in range(1, 8))} as lv from gn1 group by feature, target, test_type, lag),
gn3 as (select *, n >= greatest(20, lag + 5) and lv >= -1e-12 as ok, sqrt(greatest(lv, 0) / n) as se from gn2),
gw as (select feature, target, avg(v_b4 - v_b0) as quintile_spread, avg(c_a9) as mean_top_coverage, avg(c_a5) as mean_middle_coverage, avg(c_a0) as mean_bottom_coverage from gd group by all),
gk as (select feature, target, count(distinct security) as distinct_securities from gj group by all)"""
GT = f"gt as (select k.feature, k.target, x.test_type, coalesce(n, 0) as n, case when ok then effect end as effect, case when ok then median end as median, case when ok then positive_fraction end as positive_fraction, case when ok then se end as se, case when ok and se > 0 then effect / se end as t, quintile_spread, mean_top_coverage, mean_middle_coverage, mean_bottom_coverage, distinct_securities from gk k cross join (select unnest({list(grid.TESTS)}) as test_type) x left join gn3 using (feature, target, test_type) join gw using (feature, target))"
GK = "feature target test_type"
q("interday_pair_grid", "n distinct_securities", "effect median positive_fraction se t p quintile_spread mean_top_coverage mean_middle_coverage mean_bottom_coverage", lambda p: gridded(p)[2], f", {GS}, {GT}\nselect *, {normal_p_sql('t')} as p from gt", keys=GK)


def folds(p):
    g, daily, found = gridded(p)
    return grid.fold_tests(daily, g, FOLDS, HORIZONS, found, least=10)


q("interday_folds", "n", "fold_effect", folds, f""", {GS}, {GT}, gf0 as (select unnest({list(FOLDS)}) as fold, unnest({[a for a, _ in FOLDS.values()]}) as a, unnest({[b for _, b in FOLDS.values()]}) as b),
gf as (select feature, target, test_type, fold, count(*) as n, avg(e) as fold_effect from gs join gf0 on t >= a and t < b and t + substr(target, 8)::int < b and t + substr(target, 8)::int <= (select max(t) from gp) where e is not null group by all)
select f.*, coalesce(f.n >= 10 and sign(fold_effect) = sign(effect), false) as sign_kept from gf f join gt using (feature, target, test_type)""", keys=f"{GK} fold sign_kept")
