"""Queries of the screening, diagnostics and two-factor groups."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelforge.functions.columns import pct_rank
from panelforge.operators import dual, outliers
from panelforge.operators import screening as op
from panelforge.sources.shared import cut

from .intraday import ALL, feats, targets
from .registry import Registry

R = Registry()
P = "feature target"


def pairs(s, d, names=op.FEATURES):
    return op.long_pairs(feats(s, d), targets(s, d), names)


LONG = f"""{ALL}, fx as (select symbol, session, slot, unnest(['ret_1', 'vol_3', 'range_pos_3', 'rel_vol_3', 'up']) as feature, unnest([ret_1, vol_3, range_pos_3, rel_vol_3, up]) as x from feat),
ty as (select symbol, session, slot, unnest(['fwd_1', 'fwd_2']) as target, unnest([fwd_1, fwd_2]) as y from tgt), pu as (select symbol, session, slot, feature, x, target, y from fx join ty using (symbol, session, slot) where x is not null and y is not null), p as (select * from pu where feature <> 'up')"""
R.add("pair_moments", f"{P} status", "n", "mean_x mean_y var_x var_y pearson slope", lambda s, d: op.moments(pairs(s, d)), f"{LONG}\nselect feature, target, count(*) as n, avg(x) as mean_x, avg(y) as mean_y, var_pop(x) as var_x, var_pop(y) as var_y, covar_pop(x, y) / nullif(sqrt(var_pop(x) * var_pop(y)), 0) as pearson, regr_slope(y, x) as slope, case when var_pop(x) < 1e-14 then 'constant_feature' when count(*) < 30 then 'insufficient_data' else 'screened' end as status from p group by all")
R.add("pair_coverage", P, "n n_sessions n_symbols n_decisions", "", lambda s, d: op.coverage(pairs(s, d)), f"{LONG}\nselect feature, target, count(*) as n, count(distinct session) as n_sessions, count(distinct symbol) as n_symbols, count(distinct (session, slot)) as n_decisions from p group by all")


def score_sql(name, by):
    return f"""{name}0 as (select feature, target, {by}, count(*) as n, sum((x - mx) * (y - my)) as sxy, sum((x - mx) * (x - mx)) as sxx from cen group by all), {name} as (select feature, target, any_value(b) as slope, any_value(cxx) as cxx, sum(n) as n, count(*) as g, sum((sxy - b * sxx) * (sxy - b * sxx)) as q from {name}0 join ols using (feature, target) group by all)"""


OLS = f"{LONG}, mm as (select feature, target, avg(x) as mx, avg(y) as my from p group by all), cen as (select p.*, mx, my from p join mm using (feature, target)), ols as (select feature, target, sum((x - mx) * (x - mx)) as cxx, sum((x - mx) * (y - my)) / nullif(sum((x - mx) * (x - mx)), 0) as b from cen group by all)"
R.add("clustered_se_one_way", P, "n n_clusters", "slope se t", lambda s, d: op.one_way(pairs(s, d)), f"{OLS}, {score_sql('sd', 'session')}\nselect feature, target, n, g as n_clusters, slope, sqrt(q) / cxx as se, slope / nullif(sqrt(q) / cxx, 0) as t from sd")
V = "g::double / nullif(g - 1, 0) * (n - 1) / nullif(n - 2, 0) * q / nullif(cxx * cxx, 0)"
R.add("clustered_se_two_way", P, "n", "slope se t", lambda s, d: op.two_way(pairs(s, d)), f"{OLS}, {score_sql('sd', 'session')}, {score_sql('ss', 'symbol')}, {score_sql('sx', 'session, symbol')}, vv as (select a.feature, a.target, a.n, a.slope, case when a.v + b.v - c.v > 1e-9 * (a.v + b.v + c.v) then sqrt(a.v + b.v - c.v) when a.v + b.v - c.v is not null then 0.0 end as se from (select *, {V} as v from sd) a join (select *, {V} as v from ss) b using (feature, target) join (select *, {V} as v from sx) c using (feature, target))\nselect *, slope / nullif(se, 0) as t from vv")
TWO = f"{OLS}, {score_sql('sd', 'session')}, {score_sql('ss', 'symbol')}, {score_sql('sx', 'session, symbol')}, vv as (select a.feature, a.target, a.n, a.g, a.slope, sqrt(a.q) / a.cxx as se, case when a.v + b.v - c.v > 1e-9 * (a.v + b.v + c.v) then sqrt(a.v + b.v - c.v) when a.v + b.v - c.v is not null then 0.0 end as se2 from (select *, {V} as v from sd) a join (select *, {V} as v from ss) b using (feature, target) join (select *, {V} as v from sx) c using (feature, target)), v2 as (select *, g as n_clusters, slope / nullif(se, 0) as t, se2 as se_two_way, slope / nullif(se2, 0) as t_two_way from vv)"
R.add("screen_clustered_ols", P, "n n_clusters", "slope se t p se_two_way t_two_way p_two_way", lambda s, d: op.clustered_screen(pairs(s, d)), f"{TWO}\nselect *, {op.normal_p_sql('t')} as p, {op.normal_p_sql('t_two_way')} as p_two_way from v2")


def far_pairs(s, d):
    """The pairs with a feature far from zero and in a large unit: slopes and t must not depend on either."""
    return pairs(s, d).withColumn("x", 1e6 * F.col("x") + 1e9)


R.add("screen_far_from_zero", P, "n", "scaled t t_two_way", lambda s, d: op.clustered_screen(far_pairs(s, d)).select("feature", "target", "n", (1e6 * F.col("slope")).alias("scaled"), F.round("t", 4).alias("t"), F.round("t_two_way", 4).alias("t_two_way")), f"{TWO}\nselect feature, target, n, slope as scaled, round(t, 4) as t, round(t_two_way, 4) as t_two_way from v2")
R.add("binary_effect", P, "n_on n_off n_bad on_sessions off_sessions", "mean_on mean_off effect activation", lambda s, d: op.binary_effect(pairs(s, d, ("up",))), f"{LONG}\nselect feature, target, count(*) filter (x = 1) as n_on, count(*) filter (x = 0) as n_off, count(*) filter (x not in (0, 1)) as n_bad, count(distinct session) filter (x = 1) as on_sessions, count(distinct session) filter (x = 0) as off_sessions, avg(y) filter (x = 1) as mean_on, avg(y) filter (x = 0) as mean_off, avg(y) filter (x = 1) - avg(y) filter (x = 0) as effect, count(*) filter (x = 1)::double / count(*) as activation from pu where feature = 'up' group by all")
R.add("category_means", f"{P} slot", "n", "mean_y slope", lambda s, d: op.by_label(pairs(s, d), F.col("slot"), "slot"), f"{LONG}\nselect feature, target, slot, count(*) as n, avg(y) as mean_y, regr_slope(y, x) as slope from p group by all")
QT = f"{LONG}, q0 as (select *, row_number() over (partition by feature, target order by x, session, slot, symbol) as r, count(*) over (partition by feature, target) as n from p), q as (select *, greatest(ceil((r - 1) * 10.0::double / (n - 1)) - 1, 0)::int as bin, least(floor((r - 1) * 10.0::double / n), 9)::int as fbin from q0)"
R.add("quantile_table", f"{P} bin", "n", "mean_y", lambda s, d: op.bin_means(pairs(s, d)).withColumnRenamed("m", "mean_y"), f"{QT}\nselect feature, target, bin, count(*) as n, avg(y) as mean_y from q group by all")
R.add("floor_bins", f"{P} floor", "n", "mean_y", lambda s, d: op.quantile_table(pairs(s, d), name="floor").groupBy("feature", "target", "floor").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean_y")), f"{QT}\nselect feature, target, fbin as floor, count(*) as n, avg(y) as mean_y from q group by all")
DS = f"{QT}, dt as (select feature, target, bin, avg(y) as m, count(*) as n from q group by all), ds as (select feature, target, case when sum(n) >= 20 then max(m) filter (bin = 9) - max(m) filter (bin = 0) end as spread, sum(n) as n from dt group by all), mo0 as (select *, rank() over (partition by feature, target order by m) + (count(*) over (partition by feature, target, m) - 1) / 2.0 as r from dt), mo as (select feature, target, covar_pop(bin, r) / nullif(sqrt(var_pop(bin) * var_pop(r)), 0) as monotonicity from mo0 group by all)"
R.add("decile_spread", P, "n", "spread", lambda s, d: op.decile_spread(pairs(s, d)), f"{DS}\nselect * from ds")
R.add("monotonicity", P, "", "monotonicity", lambda s, d: op.monotonicity(pairs(s, d)), f"{DS}\nselect * from mo")
IC = f"{LONG}, i0 as (select *, rank() over (partition by feature, target, session, slot order by x) + (count(*) over (partition by feature, target, session, slot, x) - 1) / 2.0 as rx, rank() over (partition by feature, target, session, slot order by y) + (count(*) over (partition by feature, target, session, slot, y) - 1) / 2.0 as ry from p), ic as (select feature, target, session, slot, count(*) as n, covar_pop(rx, ry) / nullif(sqrt(var_pop(rx) * var_pop(ry)), 0) as ic from i0 group by all having count(*) >= 5), idy as (select feature, target, session, avg(ic) as ic from ic where ic is not null group by all)"
R.add("cross_sectional_ic", f"{P} session slot", "n", "ic", lambda s, d: op.rank_ic(pairs(s, d)), f"{IC}\nselect * from ic")


def daily_ic(s, d):
    return op.rank_ic(pairs(s, d)).where("ic is not null").groupBy("feature", "target", "session").agg(F.avg("ic").alias("ic"))


HAC = "h0 as (select *, row_number() over (partition by feature, target order by session) as i, count(*) over (partition by feature, target) as n, ic - avg(ic) over (partition by feature, target) as dv from idy), h1 as (select feature, target, any_value(n) as n, greatest(1, floor(4 * pow(any_value(n) / 100.0, 2.0 / 9)))::int as lag, avg(ic) as mean, sum(dv * dv) / any_value(n) as g0 from h0 group by all), h2 as (select a.feature, a.target, sum(2 * (1 - (b.i - a.i) / (lag + 1.0)) * a.dv * b.dv / a.n) as tail from h0 a join h0 b on a.feature = b.feature and a.target = b.target and b.i > a.i join h1 on h1.feature = a.feature and h1.target = a.target and b.i - a.i <= lag group by all), h3 as (select feature, target, n, lag, mean, sqrt(greatest(g0 + coalesce(tail, 0), 0) / n) as se from h1 left join h2 using (feature, target))"
R.add("hac_mean", P, "n lag", "mean se t", lambda s, d: op.hac(daily_ic(s, d), ["feature", "target"], "session", "ic"), f"{IC}, {HAC}\nselect *, mean / nullif(se, 0) as t from h3")
R.add("outlier_variants", f"{P} variant", "n", "slope", lambda s, d: outliers.slopes(pairs(s, d)),
      f"{LONG}, e as (select *, quantile_cont(x, 0.01) over w as xl, quantile_cont(x, 0.99) over w as xh, quantile_cont(y, 0.01) over w as yl, quantile_cont(y, 0.99) over w as yh, row_number() over (partition by feature, target order by abs(y) desc, session, slot, symbol) as r from p window w as (partition by feature, target)), vr as (select feature, target, 'all' as variant, x, y from e union all select feature, target, 'winsor_x', greatest(least(x, xh), xl), y from e union all select feature, target, 'winsor_y', x, greatest(least(y, yh), yl) from e union all select feature, target, 'winsor_both', greatest(least(x, xh), xl), greatest(least(y, yh), yl) from e union all select feature, target, 'drop_top_10', x, y from e where r > 10 union all select feature, target, 'trim_1pct', x, y from e where y between yl and yh)\nselect feature, target, variant, count(*) as n, regr_slope(y, x) as slope from vr group by all")


def screen(s, d):
    return finished(pairs(s, d))


def finished(p):
    """One-way tests, decile spread and monotonicity of pairs: a row each."""
    t = op.one_way(p).withColumn("p", op.normal_p("t")).withColumn("one", F.lit(1))
    means = cut(op.bin_means(p))
    return cut(t.join(op.spread_of(means).select("feature", "target", "spread"), ["feature", "target"]).join(op.monotonicity_of(means), ["feature", "target"]))


SCR = f"{DS}, mm as (select feature, target, avg(x) as mx, avg(y) as my from p group by all), cen as (select p.*, mx, my from p join mm using (feature, target)), ols as (select feature, target, sum((x - mx) * (x - mx)) as cxx, sum((x - mx) * (y - my)) / nullif(sum((x - mx) * (x - mx)), 0) as b from cen group by all), {score_sql('sd', 'session')}, sc as (select feature, target, slope / nullif(sqrt(q) / cxx, 0) as t from sd), scr as (select feature, target, t, {op.normal_p_sql('t')} as p, spread, monotonicity from sc join ds using (feature, target) join mo using (feature, target)), f0 as (select *, case feature when 'ret_1' then 'price' when 'range_pos_3' then 'price' when 'vol_3' then 'volatility' when 'rel_vol_3' then 'volume' else 'other' end as family, row_number() over (order by p, feature, target) as r, count(*) over () as m from scr), f1 as (select *, p * m / r as q1, p * count(*) over (partition by family, target) / row_number() over (partition by family, target order by p, feature) as q2 from f0), f2 as (select *, least(1, min(q1) over (order by p, feature, target rows between current row and unbounded following)) as global_fdr, least(1, min(q2) over (partition by family, target order by p, feature rows between current row and unbounded following)) as family_fdr, case when spread is not null then (rank() over (order by abs(spread) nulls last) + (count(*) over (partition by abs(spread)) - 1) / 2.0::double) / count(spread) over () end as sr from f1), fin as (select *, 0.4 * sr + 0.35 * (1 - global_fdr) + 0.25 * abs(monotonicity) as score from f2)"
R.add("bh_fdr", P, "", "p fdr", lambda s, d: op.bh(screen(s, d), "p", ["one"]), f"{SCR}\nselect feature, target, p, global_fdr as fdr from fin")
R.add("screen_finalize", f"{P} family", "", "global_fdr family_fdr score", lambda s, d: op.finalised(screen(s, d)), f"{SCR}\nselect * from fin")
R.add("candidate_caps", f"{P} family", "place", "score", lambda s, d: op.capped(op.finalised(screen(s, d)), ["family"], [F.desc("score"), F.col("feature"), F.col("target")], 2), f"{SCR}\nselect *, row_number() over (partition by family order by score desc, feature, target) as place from fin qualify place <= 2")
R.add("pvalue_erfc", P, "", "p_normal", lambda s, d: op.one_way(pairs(s, d)).withColumn("p_normal", op.normal_p("t")), f"{OLS}, {score_sql('sd', 'session')}, ot as (select feature, target, slope / nullif(sqrt(q) / cxx, 0) as t from sd)\nselect feature, target, {op.normal_p_sql('t')} as p_normal from ot")
R.add("bootstrap_ci", P, "n", "low high", lambda s, d: op.bootstrap(daily_ic(s, d), ["feature", "target"], "ic"))
R.add("wald_test", P, "k", "wald range", lambda s, d: op.wald(pairs(s, d), "slot"))
# diagnostics
CUTS = {"full": "0000-00-00", "last_half": "2024-01-16", "last_third": "2024-01-21"}
R.add("recent_periods", f"{P} period", "n", "slope", lambda s, d: op.recent_periods(pairs(s, d), CUTS), f"{LONG}, c as (select unnest({list(CUTS)}) as period, unnest({list(CUTS.values())}) as start)\nselect feature, target, period, count(*) as n, regr_slope(y, x) as slope from p join c on session >= start group by all")
R.add("recency_weighted", P, "", "weighted_mean effective_n", lambda s, d: op.recency_weighted(pairs(s, d), "2024-01-31"), f"{LONG}, w as (select *, exp(-ln(2) * datediff('day', session::date, date '2024-01-31') / 10.0) as w from p)\nselect feature, target, sum(w * y) / sum(w) as weighted_mean, sum(w) * sum(w) / sum(w * w) as effective_n from w group by all")
R.add("symbol_concentration", P, "", "best_share top3_share hhi", lambda s, d: op.concentration(pairs(s, d)), f"{LONG}, a as (select feature, target, symbol, abs(sum(x * y)) as e from p group by all), b as (select *, e / sum(e) over (partition by feature, target) as sh from a), c as (select *, row_number() over (partition by feature, target order by sh desc, symbol) as r from b)\nselect feature, target, max(sh) as best_share, sum(sh) filter (r <= 3) as top3_share, sum(sh * sh) as hhi from c group by all")
R.add("time_bucket", f"{P} bucket", "n", "mean_y slope", lambda s, d: op.by_label(pairs(s, d), F.when(F.col("slot") < 4, "early").when(F.col("slot") < 8, "middle").otherwise("late"), "bucket"), f"{LONG}\nselect feature, target, case when slot < 4 then 'early' when slot < 8 then 'middle' else 'late' end as bucket, count(*) as n, avg(y) as mean_y, regr_slope(y, x) as slope from p group by all")
R.add("exact_time", f"{P} slot", "n", "mean_y", lambda s, d: op.by_label(pairs(s, d), F.col("slot"), "slot"), f"{LONG}\nselect feature, target, slot, count(*) as n, avg(y) as mean_y from p group by all")
R.add("historical_folds", f"{P} bin", "n", "mean_y", lambda s, d: op.historical_folds(pairs(s, d), "2024-01-16"), f"{LONG}, e as (select feature, target, quantile_cont(x, [0.25, 0.5, 0.75]) as ed from p where session < '2024-01-16' group by all)\nselect feature, target, len([z for z in ed if z <= x])::int as bin, count(*) as n, avg(y) as mean_y from p join e using (feature, target) where session >= '2024-01-16' group by all")
R.add("scope_table", f"{P} symbol", "n", "mean_y slope", lambda s, d: op.by_label(pairs(s, d), F.col("symbol"), "symbol"), f"{LONG}\nselect feature, target, symbol, count(*) as n, avg(y) as mean_y, regr_slope(y, x) as slope from p group by all")
# two-factor features
DU = f"{ALL}, dr as (select *, case when ret_1 is not null then (rank() over (partition by session, slot order by ret_1 nulls last) + (count(ret_1) over (partition by session, slot, ret_1) - 1) / 2.0) / count(ret_1) over p end as ra, case when rel_vol_3 is not null then (rank() over (partition by session, slot order by rel_vol_3 nulls last) + (count(rel_vol_3) over (partition by session, slot, rel_vol_3) - 1) / 2.0) / count(rel_vol_3) over p end as rb from feat window p as (partition by session, slot)), dx as (select *, case when ra is not null and rb is not null then (ra >= 0.6 and rb >= 0.6)::int end as joint, case when rb is not null and rb >= 0.6 then ret_1 end as gated, (2 * ra - 1 - (2 * rb - 1)) / 2 as aligned, case when lag(slot) over w = slot - 1 and lag(ra) over w is not null and ra is not null then (ra >= 0.5 and lag(ra) over w >= 0.5)::int end as persistent from dr window w as (partition by symbol, session order by slot))"


def dual_features(s, d):
    f = feats(s, d)
    f = f.withColumn("ra", pct_rank("ret_1", ["session", "slot"])).withColumn("rb", pct_rank("rel_vol_3", ["session", "slot"]))
    return dual.features(f)


for name, longs, doubles in (("dual_intersection", "joint", ""), ("dual_gated_anchor", "", "gated"), ("dual_aligned_rank", "", "aligned"), ("dual_persistence", "persistent", "")):
    R.add(name, "symbol session slot", longs, doubles, dual_features, f"{DU}\nselect * from dx")
R.add("pair_coverage_corr", "a b", "n", "corr", lambda s, d: dual.parent_correlation(feats(s, d), op.FEATURES), f"{ALL}, fx as (select symbol, session, slot, unnest(['ret_1', 'vol_3', 'range_pos_3', 'rel_vol_3']) as f, unnest([ret_1, vol_3, range_pos_3, rel_vol_3]) as x from feat)\nselect a.f as a, b.f as b, count(*) as n, covar_pop(a.x, b.x) / nullif(sqrt(var_pop(a.x) * var_pop(b.x)), 0) as corr from fx a join fx b using (symbol, session, slot) where a.f < b.f and a.x is not null and b.x is not null group by all")
R.add("parent_scores", "feature", "place", "score", lambda s, d: op.finalised(screen(s, d)).groupBy("feature").agg(F.max("score").alias("score")).withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "feature"))), f"{SCR}, ps as (select feature, max(score) as score from fin group by all)\nselect *, row_number() over (order by score desc, feature) as place from ps")
R.add("systematic_fdr", P, "", "fdr", lambda s, d: op.bh(screen(s, d), "p", ["target"], "fdr"), f"{SCR}, sf as (select feature, target, p, p * count(*) over (partition by target) / row_number() over (partition by target order by p, feature) as q from scr)\nselect feature, target, least(1, min(q) over (partition by target order by p, feature rows between current row and unbounded following)) as fdr from sf")


def market_context(s, d):
    return feats(s, d).where("symbol = 'S0' and ret_1 is not null").select("session", "slot", F.when(F.col("ret_1") > 0, "up").otherwise("down").alias("market"))


R.add("regime_table", f"{P} market", "n", "mean_y slope", lambda s, d: op.regimes(pairs(s, d), market_context(s, d), "market"), f"{LONG}, mc as (select session, slot, case when ret_1 > 0 then 'up' else 'down' end as market from feat where symbol = 'S0' and ret_1 is not null)\nselect feature, target, coalesce(market, 'unknown') as market, count(*) as n, avg(y) as mean_y, regr_slope(y, x) as slope from p left join mc using (session, slot) group by all")
R.add("parent_comparison", "target", "", "own best_parent increment ratio", lambda s, d: op.against_parents(op.decile_spread(pairs(s, d)), "range_pos_3", ["ret_1", "vol_3"]), f"{DS}, pc as (select target, max(abs(spread)) filter (feature = 'range_pos_3') as own, max(abs(spread)) filter (feature in ('ret_1', 'vol_3')) as best_parent from ds group by target)\nselect *, own - best_parent as increment, own / nullif(best_parent, 0) as ratio from pc")
