"""Queries over all built features and targets at once, and over order statistics of pairs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from panelforge.operators import bulk as op
from panelforge.operators import categories, generation, intraday, manifest, order, outliers, screening, selection
from panelforge.sources.shared import cut

from . import generation as gen
from .intraday import SEG, B, K, bars, feats, targets
from .intraday import R as BUILT
from .registry import Registry
from .screening import DS, HAC, SCR, TWO, P, V, finished, pairs, score_sql
from .screening import LONG as PAIRS

R = Registry()
KEY = K.split()
#: Queries of the intraday group whose columns are screened together, with those columns.
PARTS = {
    "bar_shape": "range_pct body_to_range upper_wick lower_wick close_location bar_return bar_log_return",
    "session_running": "cumulative_volume return_since_open distance_vwap distance_high distance_low range_position volume_share",
    "rolling_returns": "ret_n log_ret_n pos_sum neg_sum largest_up largest_down consistency",
    "rolling_vol_split": "vol_n down_vol up_vol ret_vol_ratio outlier_score",
    "rolling_volume": "volume_sum volume_mean rel_volume dollar_mean rolling_vwap_dist volume_accel",
    "range_breakout": "dist_high dist_low range_pos breakout",
    "run_length": "up_run down_run",
    "vwap_slope_cross": "vwap_slope",
    "base_features": "ret_1 vol_3 range_pos_3 rel_vol_3",
    "calendar_feats": "minutes_since_open day_of_week time_sin time_cos",
    "tod_relative_volume": "tod_relative_volume",
    "lookback_extras": "range_mean range_ratio breakdown rel_volume_inclusive volume_range_ratio return_volume_product body_pct",
}
FEATURES = [c for cols in PARTS.values() for c in cols.split()]
TARGETS = ["fwd_1", "fwd_2", "fwd_eod", "adj_1"]
LEAST = op.Least(rows=100, sessions=5, symbols=3, decisions=10)


def wide(s, d):
    """All features and targets by key. The bars are computed once; a part is one select over windows of a symbol's session."""
    b = cut(bars(s, d))
    look, base = intraday.lookback(b, 4), intraday.base_features(b)
    made = {
        "bar_shape": intraday.shape(b), "session_running": intraday.running(b), "rolling_returns": look, "rolling_vol_split": look, "rolling_volume": look, "range_breakout": look, "run_length": intraday.run_lengths(b),
        "vwap_slope_cross": intraday.vwap_cross(b), "base_features": base, "calendar_feats": intraday.calendar(b), "tod_relative_volume": intraday.time_of_day(b), "lookback_extras": generation.lookback_extras(b),
    }
    by_frame = {}
    for name, cols in PARTS.items():
        by_frame.setdefault(id(made[name]), (made[name], []))[1].extend(cols.split())
    goal = intraday.benchmark_adjusted(intraday.forward_returns(b)).select(*KEY, "adj_1")
    frames = [f.select(*KEY, *cols) for f, cols in by_frame.values()]
    frames += [intraday.forward_returns(b).select(*KEY, "fwd_1", "fwd_2", "fwd_eod"), goal]
    return cut(reduce(lambda x, y: x.join(y, KEY), frames))


WIDE = "wide as (select * from (select symbol, session, slot from (" + BUILT.plain["bars_build"] + "))" + "".join(
    f" join (select symbol, session, slot, {', '.join(cols.split())} from ({(BUILT.plain | gen.R.plain)[name]})) using (symbol, session, slot)" for name, cols in [*PARTS.items(), ("fwd_return_asof", "fwd_1 fwd_2"), ("fwd_eod", "fwd_eod"), ("benchmark_adjusted", "adj_1")]
) + ")"
LONG = f"""with {WIDE}, fx as (select symbol, session, slot, unnest({FEATURES}) as feature, unnest([{', '.join(f'{c}::double' for c in FEATURES)}]) as x from wide), ty as (select symbol, session, slot, unnest({TARGETS}) as target, unnest([{', '.join(TARGETS)}]) as y from wide),
ql as (select feature as name, x as v from fx where x is not null union all select target, y from ty where y is not null), qe as (select name, list_distinct(quantile_cont(v, [{', '.join(f'{i}/100.0::double' for i in range(1, 100))}])) as edges from ql group by name),
fb as (select fx.*, len(list_filter(edges, lambda e: e < x)) as bx from fx join qe on name = feature where x is not null), tb as (select ty.*, len(list_filter(edges, lambda e: e < y)) as by_ from ty join qe on name = target where y is not null),
p as materialized (select symbol, session, slot, feature, target, x, y, bx, by_ from fb join tb using (symbol, session, slot)),
sd as (select feature, var_pop(x) as vc from fx group by feature), mm as (select feature, target, count(*) as n, count(distinct session) as n_sessions, count(distinct symbol) as n_symbols, count(distinct (session, slot)) as n_decisions, count(distinct session[1:4]) as n_years, avg(x) as mx, avg(y) as my, var_pop(x) as vx, var_pop(y) as vy, covar_pop(x, y) as cv, covar_pop(bx, by_) / nullif(sqrt(var_pop(bx) * var_pop(by_)), 0) as spearman from p group by all),
ols as (select mm.*, vc, case when vx / nullif(vc, 0) > 1e-14 then case when n < 100 or n_sessions < 5 or n_symbols < 3 or n_decisions < 10 then 'insufficient_data' else 'screened' end else 'constant_feature' end as status, cv / nullif(vx, 0) as b from mm join sd using (feature)),
sc as (select feature, target, session, symbol, sum((x - mx) * (y - my - b * (x - mx))) as s from p join ols using (feature, target) group by all),
cl as (select feature, target, 'd' as k, count(*) as g, sum(s * s) as q from (select feature, target, session, sum(s) as s from sc group by all) group by all union all select feature, target, 's', count(*), sum(s * s) from (select feature, target, symbol, sum(s) as s from sc group by all) group by all union all select feature, target, 'x', count(*), sum(s * s) from sc group by all),
cv as (select feature, target, max(q) filter (k = 'd') as qd, {', '.join(f"max(g / nullif(g - 1.0::double, 0) * q) filter (k = '{k}') as v{k}" for k in 'dsx')} from cl group by all),
er as (select ols.*, sqrt(qd) / nullif(n * vx, 0) as se, case when vd + vs - vx_ > 1e-9 * (vd + vs + vx_) then sqrt((vd + vs - vx_) * (n - 1) / nullif(n - 2.0::double, 0)) / nullif(n * vx, 0) when vd + vs - vx_ is not null then 0.0 end as se2 from ols join (select feature, target, qd, vd, vs, vx as vx_ from cv) using (feature, target)),
de as (select feature, target, least(bx, 99) // 10 as d, avg(y) as m from p group by all), dr as (select *, rank() over (partition by feature, target order by m) + (count(*) over (partition by feature, target, m) - 1) / 2.0::double as rm, rank() over (partition by feature, target order by d) as rd from de),
mo as (select feature, target, max(m) filter (d = 9) - max(m) filter (d = 0) as spread, case when count(*) >= 3 then covar_pop(rd, rm) / nullif(sqrt(var_pop(rd) * var_pop(rm)), 0) end as monotonicity from dr group by all),
bk as (select feature, target, status, n, n_sessions, n_symbols, n_decisions, n_years, {', '.join(f"case when status = 'screened' then {v} end as {a}" for a, v in (('pearson', 'cv / nullif(sqrt(vx * vy), 0)'), ('spearman', 'spearman'), ('spread', 'spread'), ('monotonicity', 'monotonicity'), ('slope', 'b'), ('scaled_slope', 'b * sqrt(vc)'), ('t', 'b / nullif(se, 0)'), ('t_two_way', 'b / nullif(se2, 0)'), ('scaled_se', 'se * sqrt(vc)'), ('scaled_se_two_way', 'se2 * sqrt(vc)')))} from er join mo using (feature, target))"""


def whole_screen(s, d):
    """The screen with exact edges; slopes and errors are those of the feature in units of its own deviation."""
    w = wide(s, d)
    found = op.screen(w, FEATURES, TARGETS, edges=op.exact_edges(w, FEATURES + TARGETS), least=LEAST, tasks=4)
    unit = w.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in FEATURES])).alias("v")).groupBy("v.feature").agg(F.stddev_pop("v.x").alias("unit"))
    return found.join(unit, "feature").select("*", *[(F.col(c) * F.col("unit")).alias(f"scaled_{c}") for c in ("slope", "se", "se_two_way")])


SHAPE = "case when status = 'screened' then case when monotonicity >= 0.7 then 'positive_monotonic' when monotonicity <= -0.7 then 'negative_monotonic' else 'no_stable_shape' end end as shape"
R.add("screen_all_pairs", f"{P} status shape", "n n_sessions n_symbols n_decisions n_years", "pearson spearman spread monotonicity scaled_slope scaled_se t p scaled_se_two_way t_two_way p_two_way", whole_screen, f"{LONG}\nselect *, {SHAPE}, {screening.normal_p_sql('t')} as p, {screening.normal_p_sql('t_two_way')} as p_two_way from bk")


def approximate(s, d):
    """The correlation of ranks of buckets, cut by mergeable summaries of each pair's own rows, beside the one of exact ranks."""
    pairs = cut(screening.long_pairs(feats(s, d), targets(s, d)))
    by = screening.PAIR

    def correlated(ranks, name):
        ranked = ranks(ranks(pairs, by, "x", "rx"), by, "y", "ry")
        return ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.corr("rx", "ry").alias(name))

    exact = correlated(order.average_ranks, "spearman")
    found = correlated(order.approximate_ranks, "approximate").drop("n").join(exact, by)
    near = F.coalesce(F.abs(F.col("approximate") - F.col("spearman")) < 0.02, F.lit(False))
    return found.withColumn("within", near | F.col("approximate").eqNullSafe(F.col("spearman")))


R.add("rank_correlation_approximate", f"{P} within", "n", "spearman", approximate, f"{PAIRS}, rk as (select *, rank() over (partition by feature, target order by x) + (count(*) over (partition by feature, target, x) - 1) / 2.0::double as rx, rank() over (partition by feature, target order by y) + (count(*) over (partition by feature, target, y) - 1) / 2.0::double as ry from p)\nselect feature, target, true as within, count(*) as n, covar_pop(rx, ry) / nullif(sqrt(var_pop(rx) * var_pop(ry)), 0) as spearman from rk group by all")


BIN = "greatest(ceil((r - 1) * 10.0::double / nullif(n - 1, 0)) - 1, 0)::int"
KINDS = {
    "all": "x y true", "winsor_x": "greatest(least(x,ex[2]),ex[1]) y true", "winsor_y": "x greatest(least(y,ey[4]),ey[3]) true", "winsor_both": "greatest(least(x,ex[2]),ex[1]) greatest(least(y,ey[4]),ey[3]) true",
    "trim_01pct": "x y y>=ey[1]&y<=ey[6]", "trim_05pct": "x y y>=ey[2]&y<=ey[5]", "trim_1pct": "x y y>=ey[3]&y<=ey[4]", "drop_top_10": "x y top>10", "drop_best_day": "x y coalesce(day,9)>1", "drop_best_5_days": "x y coalesce(day,9)>5", "drop_best_symbol": "x y best&is&null",
}
EACH = ", ".join(f"case when {ok.replace('&is&', ' is ').replace('&', ' and ')} then {{'k': '{k}', 'x': {x}, 'y': {y}}} end" for k, (x, y, ok) in ((k, v.split()) for k, v in KINDS.items()))
OV = f"""ovs as (select feature, target, case when spread < 0 then -1.0::double else 1.0::double end as sg from ds),
ovd1 as (select feature, target, session, avg(y) filter (b = 9) - avg(y) filter (b = 0) as s from (select *, {BIN} as b from (select *, row_number() over (partition by feature, target, session order by x, session, slot, symbol) as r, count(*) over (partition by feature, target, session) as n from p) where n >= 20) group by all),
ovd as (select feature, target, session, row_number() over (partition by feature, target order by s * sg desc, session) as day from ovd1 join ovs using (feature, target) where s is not null),
ovy1 as (select feature, target, symbol, avg(y) filter (b = 9) - avg(y) filter (b = 0) as s from (select *, {BIN} as b from (select *, row_number() over (partition by feature, target, symbol order by x, session, slot, symbol) as r, count(*) over (partition by feature, target, symbol) as n from p) where n >= 20) group by all),
ovy as (select feature, target, symbol, 1 as best from ovy1 join ovs using (feature, target) where s is not null qualify row_number() over (partition by feature, target order by s * sg desc, symbol) = 1),
ove as (select feature, target, quantile_cont(x, [0.01, 0.99]) as ex, quantile_cont(y, [0.001, 0.005, 0.01, 0.99, 0.995, 0.999]) as ey from p group by all),
ovp as (select p.feature, p.target, p.session, p.slot, p.symbol, p.x, p.y, ex, ey, day, best, row_number() over (partition by p.feature, p.target order by abs(p.y) desc, p.session, p.slot, p.symbol) as top from p join ove using (feature, target) left join ovd using (feature, target, session) left join ovy using (feature, target, symbol)),
ovr as materialized (select feature || '|' || v.k as feature, target, session, slot, symbol, v.x as x, v.y as y from (select feature, target, session, slot, symbol, unnest([{EACH}]) as v from ovp) where v is not null),
ovb as (select *, {BIN} as b from (select *, row_number() over (partition by feature, target order by x, session, slot, symbol) as r, count(*) over (partition by feature, target) as n, rank() over (partition by feature, target order by x) + (count(*) over (partition by feature, target, x) - 1) / 2.0::double as rx, rank() over (partition by feature, target order by y) + (count(*) over (partition by feature, target, y) - 1) / 2.0::double as ry, avg(x) over (partition by feature, target) as mx, avg(y) over (partition by feature, target) as my from ovr)),
ovm as (select feature, target, count(*) as n, covar_pop(rx, ry) / nullif(sqrt(var_pop(rx) * var_pop(ry)), 0) as spearman, avg(y) filter (b = 9) - avg(y) filter (b = 0) as spread, sum((x - mx) * (x - mx)) as cxx, sum((x - mx) * (y - my)) / nullif(sum((x - mx) * (x - mx)), 0) as slope from ovb group by all),
ovq as (select feature, target, sum(s * s) as q from (select feature, target, session, sum((x - mx) * (y - my - slope * (x - mx))) as s from ovb join ovm using (feature, target) group by all) group by all),
idy as (select * from (select feature, target, session, avg(y) filter (b = 9) - avg(y) filter (b = 0) as ic from ovb group by all) where ic is not null), {HAC},
ov as (select split_part(m.feature, '|', 1) as feature, m.target, split_part(m.feature, '|', 2) as variant, m.n, spearman, spread, slope / nullif(sqrt(q) / nullif(cxx, 0), 0) as t, case when h3.n >= 3 then 1.96::double * h3.se end as half from ovm m join ovq using (feature, target) left join h3 using (feature, target)),
ow as (select ov.feature, target, variant, ov.n, case when ov.n >= 10 then sg * spearman end as spearman, case when ov.n >= 10 then sg * spread end as spread, case when ov.n >= 10 then sg * t end as t, case when ov.n >= 10 then sg * spread - half end as low, case when ov.n >= 10 then sg * spread + half end as high from ov join ovs using (feature, target)),
ox as (select feature, target, min(spread) filter (variant <> 'all') as worst_spread, greatest(max(spread) filter (variant = 'all') - min(spread) filter (variant <> 'all'), max(spread) filter (variant <> 'all') - max(spread) filter (variant = 'all'), min(spread) filter (variant <> 'all') - max(spread) filter (variant = 'all')) as change from ow group by all)"""
R.add("outlier_sensitivity", f"{P} variant", "n", "spearman spread t low high", lambda s, d: outliers.sensitivity(pairs(s, d)), f"{DS}, {OV}\nselect * from ow")
R.add("outlier_worst", P, "", "worst_spread change", lambda s, d: outliers.worst(outliers.sensitivity(pairs(s, d))), f"{DS}, {OV}\nselect * from ox")


def related(s, d):
    """The pairs with a relation put into two features, so that the strongest class has members."""
    return pairs(s, d).withColumn("y", F.col("y") + F.when(F.col("feature").isin("ret_1", "range_pos_3"), 0.2 * F.col("x")).otherwise(0.0))


def robust(s, d):
    """Classes with every input measured: two-way p, breadth, years, concentration of symbols, the worst of ten variants."""
    p = cut(related(s, d))
    rows = screening.finalised(finished(p)).drop("n").join(selection.symbol_breadth(p).select(*screening.PAIR, F.col("breadth").alias("symbol_breadth")), screening.PAIR).join(selection.year_consistency(p), screening.PAIR)
    cover = screening.coverage(p).select(*screening.PAIR, "n", F.col("n_sessions").alias("valid_sessions"), F.col("n_symbols").alias("valid_symbols"))
    tests = screening.two_way(p).select(*screening.PAIR, screening.normal_p("t").alias("two_way_cluster_p"))
    share = screening.concentration(p).select(*screening.PAIR, F.when(F.col("best_share") > 0.5, "single_symbol_dominated").when(F.col("top3_share") > 0.8, "highly_concentrated").otherwise("diversified").alias("concentration"))
    bad = outliers.worst(outliers.sensitivity(p)).select(*screening.PAIR, F.col("worst_spread").alias("outlier_worst_signed_spread"))
    for more in (cover, tests, share, bad):
        rows = rows.join(more, screening.PAIR)
    return selection.classify(rows.withColumn("status", F.lit("screened")).withColumn("top_bottom_spread", F.col("spread")))


PUT = "p as (select * replace (y + case when feature in ('ret_1', 'range_pos_3') then 0.2::double * x else 0.0::double end as y) from pu where feature <> 'up')"
R.add(
    "candidate_classes_robust", f"{P} evidence", "", "global_fdr outlier_worst_signed_spread", robust,
    f"""{SCR.replace("p as (select * from pu where feature <> 'up')", PUT)}, {OV}, {score_sql('ss', 'symbol')}, {score_sql('sx', 'session, symbol')}, tw as (select a.feature, a.target, a.slope / nullif(case when a.v + b.v - c.v > 1e-9 * (a.v + b.v + c.v) then sqrt(a.v + b.v - c.v) when a.v + b.v - c.v is not null then 0.0 end, 0) as t2 from (select *, {V} as v from sd) a join (select *, {V} as v from ss) b using (feature, target) join (select *, {V} as v from sx) c using (feature, target)),
rw as (select feature, target, regr_slope(y, x) as slope, count(*) as n, count(distinct session) as ns, count(distinct symbol) as ny from p group by all), ry0 as (select feature, target, session[1:4] as k, regr_slope(y, x) as own from p group by all having count(*) >= 5), rs0 as (select feature, target, symbol as k, regr_slope(y, x) as own from p group by all having count(*) >= 5),
ryc as (select feature, target, avg((sign(own) = sign(slope))::int) as years from ry0 join rw using (feature, target) group by all), rsc as (select feature, target, avg((sign(own) = sign(slope))::int) as breadth from rs0 join rw using (feature, target) group by all),
rc0 as (select feature, target, symbol, abs(sum(x * y)) as e from p group by all), rc1 as (select *, e / sum(e) over (partition by feature, target) as sh, row_number() over (partition by feature, target order by e desc, symbol) as r from rc0), rc2 as (select feature, target, case when max(sh) > 0.5 then 'single_symbol_dominated' when sum(sh) filter (r <= 3) > 0.8 then 'highly_concentrated' else 'diversified' end as label from rc1 group by all),
re as (select f.feature, f.target, global_fdr, worst_spread as outlier_worst_signed_spread, global_fdr < 0.05 as found, coalesce({screening.normal_p_sql('t2')} < 0.05, false) as exact, n >= 30 and ns >= 5 and ny >= 3 and abs(spread) >= 0.5 / 1e4 as fit, breadth >= 0.6 and years >= 0.6 as same, abs(monotonicity) >= 0.5 as shaped, worst_spread > 0 as firm, label = 'diversified' as wide from fin f join rw using (feature, target) join ryc using (feature, target) join rsc using (feature, target) join rc2 using (feature, target) join tw using (feature, target) join ox using (feature, target))
select *, case when found and exact and fit and same and shaped and firm and wide then 'robust_phase1_anomaly_candidate' when found and exact and fit and same then 'stable_anomaly_candidate' when found then 'statistically_significant_discovery' when exact then 'exploratory_relationship' else 'no_meaningful_relationship' end as evidence from re""",
)


def bucketed(s, d):
    """Rows of one feature with the time of day as their category."""
    part = F.when(F.col("slot") < 4, "early").when(F.col("slot") < 8, "middle").otherwise("late")
    return pairs(s, d, ("ret_1",)).withColumn("feature", F.lit("time_bucket")).withColumn("category", part)


def tail_sql(x):
    """Chi-square tail with two degrees."""
    return f"least(1, exp(-greatest({x}, 0) / 2))"


CT = f"""{PAIRS}, ct as (select *, case when slot < 4 then 'early' when slot < 8 then 'middle' else 'late' end as c from p where feature = 'ret_1'), cm as (select target, c, count(*) as n, avg(y) as m from ct group by all), cs as (select ct.target, session, symbol, c, sum(y - m) / any_value(n) as s from ct join cm using (target, c) group by all),
{', '.join(f"c{k}0 as (select target, {by}, sum(s) filter (c = 'early') as e, sum(s) filter (c = 'late') as l, sum(s) filter (c = 'middle') as i from cs group by all), c{k} as (select target, count(*) / (count(*) - 1.0::double) as f, sum((coalesce(l, 0) - coalesce(e, 0)) * (coalesce(l, 0) - coalesce(e, 0))) as v11, sum((coalesce(l, 0) - coalesce(e, 0)) * (coalesce(i, 0) - coalesce(e, 0))) as v12, sum((coalesce(i, 0) - coalesce(e, 0)) * (coalesce(i, 0) - coalesce(e, 0))) as v22 from c{k}0 group by target)" for k, by in (('d', 'session'), ('s', 'symbol'), ('x', 'session, symbol')))},
ck as (select target, sum(n) as n, max(m) - min(m) as range, max(m) filter (c = 'late') - max(m) filter (c = 'early') as b1, max(m) filter (c = 'middle') - max(m) filter (c = 'early') as b2 from cm group by target),
cw as (select k.*, (n - 1) / (n - 3.0::double) as h, cd.f * cd.v11 as p11, cd.f * cd.v12 as p12, cd.f * cd.v22 as p22, cd.f * cd.v11 + cs_.f * cs_.v11 - cx.f * cx.v11 as q11, cd.f * cd.v12 + cs_.f * cs_.v12 - cx.f * cx.v12 as q12, cd.f * cd.v22 + cs_.f * cs_.v22 - cx.f * cx.v22 as q22 from ck k join cd using (target) join cs_ using (target) join cx using (target)),
cz as (select target, n, range, (b1 * b1 * p22 - 2 * b1 * b2 * p12 + b2 * b2 * p11) / (p11 * p22 - p12 * p12) / h as wald, (b1 * b1 * q22 - 2 * b1 * b2 * q12 + b2 * b2 * q11) / (q11 * q22 - q12 * q12) / h as wald_two_way from cw)""".replace("cs0 as", "cs_0 as").replace("from cs0 group", "from cs_0 group").replace("cs as (select target, count(*) /", "cs_ as (select target, count(*) /")
R.add("categorical_screen", P, "n k", "range wald wald_two_way p p_two_way", lambda s, d: categories.screen(bucketed(s, d)), f"{CT}\nselect 'time_bucket' as feature, target, n, 3 as k, range, wald, wald_two_way, {tail_sql('wald')} as p, {tail_sql('wald_two_way')} as p_two_way from cz")
BI = TWO.replace("p as (select * from pu where feature <> 'up')", "p as (select * from pu where feature = 'up')")
R.add(
    "binary_screen", f"{P} status", "n_on n_off on_sessions off_sessions", "mean_on mean_off effect activation t p t_two_way p_two_way direction", lambda s, d: categories.binary_rows(pairs(s, d, ("up",))),
    f"""{BI}, be as (select feature, target, count(*) filter (x = 1) as n_on, count(*) filter (x = 0) as n_off, count(distinct session) filter (x = 1) as on_sessions, count(distinct session) filter (x = 0) as off_sessions, avg(y) filter (x = 1) as mean_on, avg(y) filter (x = 0) as mean_off, avg(x) as activation from p group by all)
select be.*, 'binary_screened' as status, mean_on - mean_off as effect, sign(mean_on - mean_off) as direction, t, {screening.normal_p_sql('t')} as p, t_two_way, {screening.normal_p_sql('t_two_way')} as p_two_way from be join v2 using (feature, target)""",
)


def f(name, op_, inputs, n=0, edge=0.0):
    return manifest.Feature(name, op_, tuple(inputs.split()), n, edge)


#: Features of several depths and windows; again_1 and again_2 repeat the content of others under other names.
MANIFEST = [
    f("r1", "return", "c", 1), f("r3", "return", "c", 3), f("vol", "std", "r1", 3), f("mv", "mean", "v", 3), f("rv", "ratio", "v mv"), f("hi", "max", "h", 3), f("lo", "min", "l", 3), f("span", "difference", "hi lo"),
    f("up_r", "difference", "c lo"), f("place", "ratio", "up_r span"), f("k_r", "rank", "r1"), f("k_v", "rank", "rv"), f("k_p", "rank", "place"), f("cr", "centred", "k_r"), f("cv", "centred", "k_v"), f("pair", "aligned_mean", "cr cv"),
    f("hot", "above", "k_r", edge=0.6), f("busy", "above", "k_v", edge=0.6), f("quiet", "below", "k_v", edge=0.4), f("joint", "intersection", "hot busy"), f("gate", "gated", "r1 busy"), f("lasting", "persistence", "hot", 2), f("flow", "sum", "gate", 1),
    f("before", "lag", "pair", 1), f("again_1", "return", "c", 1), f("again_2", "mean", "again_1", 2), f("calm", "mean", "r1", 2), f("scaled", "product", "r1 rv"),
]


def manifest_sql():
    """One step a feature, in the order of the list."""
    w = "partition by symbol, session, seg order by slot"
    steps, last = [f"{B}, {SEG}"], "segs"
    for i, x in enumerate(MANIFEST):
        a, b = (*x.inputs, "")[:2]
        frame = f"({w} rows between {max(x.n - 1, 0)} preceding and current row)"
        roll = lambda g: f"case when count({a}) over {frame} >= {x.n} then {g}({a}) over {frame} end"  # noqa: E731, B023
        text = {
            "lag": f"lag({a}, {x.n}) over ({w})", "return": f"{a} / nullif(lag({a}, {x.n}) over ({w}), 0) - 1", "mean": roll("avg"), "std": roll("stddev_samp"), "sum": roll("sum"), "max": roll("max"), "min": roll("min"), "persistence": roll("min"),
            "rank": f"case when {a} is not null then (rank() over (partition by session, slot order by {a} nulls last) + (count({a}) over (partition by session, slot, {a}) - 1) / 2.0::double) / count({a}) over (partition by session, slot) end",
            "ratio": f"{a} / nullif({b}, 0)", "difference": f"{a} - {b}", "product": f"{a} * {b}", "centred": f"2 * {a} - 1", "above": f"({a} >= {x.edge}::double)::int::double", "below": f"({a} <= {x.edge}::double)::int::double", "intersection": f"{a} * {b}", "gated": f"case when {b} = 1 then {a} end", "aligned_mean": f"({a} + {b}) / 2",
        }[x.op]
        steps.append(f"mf{i} as (select *, {text} as {x.name} from {last})")
        last = f"mf{i}"
    return ", ".join(steps) + f"\nselect symbol, session, slot, {', '.join(x.name for x in MANIFEST)} from {last}"


R.add("feature_manifest", K, "", " ".join(x.name for x in MANIFEST), lambda s, d: manifest.run(bars(s, d), MANIFEST), manifest_sql())
