"""Queries of the candidate selection group."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelforge.operators import screening
from panelforge.operators import selection as op

from .intraday import ALL, feats
from .registry import Registry
from .screening import LONG, SCR, P, V, pairs, score_sql, screen

R = Registry()
NAMES, PAIR = screening.FEATURES, screening.PAIR
LISTED = ", ".join(f"'{n}'" for n in NAMES)

BR = """br0 as (select feature, target, symbol, regr_slope(y, x) as own from p group by all having count(*) >= 5),
br1 as (select feature, target, regr_slope(y, x) as slope from p group by all),
br as (select feature, target, count(own) as n_symbols, avg((sign(own) = sign(slope))::int) as breadth from br0 join br1 using (feature, target) group by all)"""
R.add("symbol_breadth", P, "n_symbols", "breadth", lambda s, d: op.symbol_breadth(pairs(s, d)), f"{LONG}, {BR}\nselect * from br")

R.add(
    "leave_top_out", P, "n_rest", "slope slope_rest retention", lambda s, d: op.without_top(pairs(s, d)),
    f"""{LONG}, br1 as (select feature, target, regr_slope(y, x) as slope from p group by all),
tp as (select feature, target, symbol from (select feature, target, symbol, abs(sum(x * y)) as e from p group by all) qualify row_number() over (partition by feature, target order by e desc, symbol) <= 2),
rs as (select feature, target, regr_slope(y, x) as slope_rest, count(*) as n_rest from p anti join tp using (feature, target, symbol) group by all)
select *, slope_rest / nullif(slope, 0) as retention from br1 left join rs using (feature, target)""",
)


R.add(
    "year_consistency", P, "n_years", "year_consistency", lambda s, d: op.year_consistency(pairs(s, d)),
    f"""{LONG}, yc0 as (select feature, target, session[1:4] as year, regr_slope(y, x) as own from p group by all having count(*) >= 5), br1 as (select feature, target, regr_slope(y, x) as slope from p group by all)
select feature, target, count(own) as n_years, avg((sign(own) = sign(slope))::int) as year_consistency from yc0 join br1 using (feature, target) group by all""",
)


def evidence(s, d):
    """The screen's rows with what the classes ask for; there is no outlier spread among it, so the robust class needs more."""
    p = pairs(s, d)
    rows = screening.finalised(screen(s, d)).drop("n").join(op.symbol_breadth(p), PAIR).join(op.year_consistency(p), PAIR)
    cover = screening.coverage(p).select(*PAIR, "n", F.col("n_sessions").alias("valid_sessions"), F.col("n_symbols").alias("valid_symbols"))
    tests = screening.two_way(p).select(*PAIR, screening.normal_p("t").alias("two_way_cluster_p"))
    rows = rows.join(cover, PAIR).join(tests, PAIR).withColumn("status", F.lit("screened"))
    return rows.withColumn("top_bottom_spread", F.col("spread")).withColumn("symbol_breadth", F.col("breadth"))


R.add(
    "candidate_classes", f"{P} evidence", "", "global_fdr breadth", lambda s, d: op.classify(evidence(s, d), {"discovered": (op.Gate("global_fdr", "<", 0.8),)}),
    f"""{SCR}, {BR}, {score_sql('ss', 'symbol')}, {score_sql('sx', 'session, symbol')}, tw as (select a.feature, a.target, a.slope / nullif(case when a.v + b.v - c.v > 1e-9 * (a.v + b.v + c.v) then sqrt(a.v + b.v - c.v) when a.v + b.v - c.v is not null then 0.0 end, 0) as t2 from (select *, {V} as v from sd) a join (select *, {V} as v from ss) b using (feature, target) join (select *, {V} as v from sx) c using (feature, target)),
yc0 as (select feature, target, session[1:4] as year, regr_slope(y, x) as own from p group by all having count(*) >= 5), yc as (select feature, target, avg((sign(own) = sign(slope))::int) as years from yc0 join br1 using (feature, target) group by all),
cv as (select feature, target, count(*) as n, count(distinct session) as ns, count(distinct symbol) as ny from p group by all),
ev as (select *, global_fdr < 0.8 as found, coalesce({screening.normal_p_sql('t2')} < 0.05, false) as exact, n >= 30 and ns >= 5 and ny >= 3 and abs(spread) >= 0.5 / 1e4 as fit from fin join br using (feature, target) join yc using (feature, target) join cv using (feature, target) join tw using (feature, target))
select *, case when found and exact and fit and breadth >= 0.6 and years >= 0.6 then 'stable_anomaly_candidate' when found then 'statistically_significant_discovery' when exact then 'exploratory_relationship' else 'no_meaningful_relationship' end as evidence from ev""",
)

RC = f"""fw as (select symbol, session, slot, unnest([{LISTED}]) as f, unnest([{', '.join(NAMES)}]) as x from feat),
rc0 as (select i.f as a, j.f as b, symbol, session, i.x as x, j.x as y from fw i join fw j using (symbol, session, slot) where i.f < j.f and i.x is not null and j.x is not null),
rc1 as (select *, rank() over (partition by a, b order by x) + (count(*) over (partition by a, b, x) - 1) / 2.0 as rx, rank() over (partition by a, b order by y) + (count(*) over (partition by a, b, y) - 1) / 2.0 as ry from rc0),
rc as (select a, b, count(*) as n, count(distinct session) as sessions, count(distinct symbol) as symbols, covar_pop(rx, ry) / nullif(sqrt(var_pop(rx) * var_pop(ry)), 0) as corr from rc1 group by all)"""
R.add("parent_rank_correlation", "a b", "n sessions symbols", "corr", lambda s, d: op.rank_correlations(feats(s, d), NAMES), f"{ALL}, {RC}\nselect * from rc")


def feature_clusters(s, d):
    names = s.createDataFrame([(n,) for n in NAMES], "name string")
    return op.clusters(names, op.rank_correlations(feats(s, d), NAMES).where("abs(corr) >= 0.3"))


R.add(
    "feature_clusters", "name cluster", "", "", feature_clusters,
    f"""{ALL.replace('with ', 'with recursive ', 1)}, {RC}, ed as (select a, b from rc where abs(corr) >= 0.3 union select b, a from rc where abs(corr) >= 0.3),
walk as (select unnest([{LISTED}]) as name, unnest([{LISTED}]) as seen union select walk.name, ed.b from walk join ed on ed.a = walk.seen)
select name, min(seen) as cluster from walk group by name""",
)


def scores(s, d):
    rows = screening.finalised(screen(s, d))
    return rows.groupBy("feature", "family").agg(F.max("score").alias("score"))


R.add(
    "parent_pairs", "a b bucket rejection_reason", "n", "corr pair_score", lambda s, d: op.parent_pairs(op.rank_correlations(feats(s, d), NAMES), scores(s, d), most=0.6, least=(100, 10, 5), cap=2, total=3),
    f"""{SCR}, {RC}, sf as (select feature, family, max(score) as score from fin group by all),
pp0 as (select a, b, least(i.family, j.family) || '::' || greatest(i.family, j.family) as bucket, n, corr, 0.4 * i.score + 0.4 * j.score + 0.2 * coalesce(1 - abs(corr), 0) as pair_score, case when abs(corr) >= 0.6 then 'parent_correlation' when n < 100 then 'insufficient_joint_observations' when sessions < 10 then 'insufficient_joint_sessions' when symbols < 5 then 'insufficient_joint_symbols' end as why from rc join sf i on i.feature = a join sf j on j.feature = b),
pp1 as (select * exclude why, coalesce(why, case when row_number() over (partition by bucket, why is null order by pair_score desc, a, b) > 2 then 'family_pair_cap' end) as why from pp0)
select *, coalesce(why, case when row_number() over (partition by why is null order by pair_score desc, a, b) > 3 then 'total_pair_cap' end, '') as rejection_reason from pp1""",
)

EDGES = ", ".join(f"{i / 20}" for i in range(1, 20))
R.add(
    "percentile_edge_bins", f"{P} bin", "n", "mean_y", lambda s, d: op.edge_bins(pairs(s, d)),
    f"{LONG}, eb as (select feature, target, list_distinct(quantile_cont(x, [{EDGES}])) as ed from p group by all)\nselect feature, target, len([z for z in ed if z < x])::int as bin, count(*) as n, avg(y) as mean_y from p join eb using (feature, target) group by all",
)
R.add(
    "feature_coverage_report", "feature", "n_rows n_values", "least greatest median p99", lambda s, d: op.coverage_report(feats(s, d), NAMES),
    f"{ALL}, fw as (select unnest([{LISTED}]) as feature, unnest([{', '.join(NAMES)}]) as x from feat)\nselect feature, count(*) as n_rows, count(x) as n_values, min(x) as least, max(x) as greatest, quantile_cont(x, 0.5) as median, quantile_cont(x, 0.99) as p99 from fw group by feature",
)
R.add("diagnostic_cube", f"{P} symbol slot", "n", "mean_y", lambda s, d: op.diagnostic_cube(pairs(s, d)), f"{LONG}\nselect feature, target, symbol, slot, count(*) as n, avg(y) as mean_y from p group by grouping sets ((feature, target, symbol), (feature, target, slot), (feature, target))")
