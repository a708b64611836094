"""Queries of parents, operator plans, rates by several groupings, exact effects and small helpers."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelforge.operators import generation as op
from panelforge.operators import screening
from panelforge.operators import selection
from panelforge.sources import views as v

from .intraday import ALL, B, K, SEG, bars, feats
from .registry import Registry
from .screening import LONG, SCR, TWO, P, pairs, screen
from .selection import NAMES, RC

R = Registry()
PAIR = screening.PAIR

GROUPS = {"fdr_all": [], "fdr_target": ["target"], "fdr_family": ["family"], "fdr_family_target": ["family", "target"], "fdr_feature": ["feature"]}


RATES = ", ".join(f"row_number() over ({f'partition by {", ".join(by)} ' if by else ''}order by {', '.join(['p', *[c for c in PAIR if c not in by]])}) as r_{o}, count(p) over ({f'partition by {", ".join(by)}' if by else ''}) as m_{o}" for o, by in GROUPS.items())
LAST = ", ".join(f"least(1, min(p * m_{o} / r_{o}) over ({f'partition by {", ".join(by)} ' if by else ''}order by {', '.join(['p', *[c for c in PAIR if c not in by]])} rows between current row and unbounded following)) as {o}" for o, by in GROUPS.items())
R.add("fdr_groupings", P, "", " ".join(GROUPS), lambda s, d: op.rates(screening.finalised(screen(s, d)), "p", GROUPS), f"{SCR}, g0 as (select feature, target, family, p from fin), g1 as (select *, {RATES} from g0)\nselect feature, target, {LAST} from g1")

RULES = op.ParentRules(rows=100, sessions=5, symbols=3, decisions=10, fdr=0.8, bps=0.0, fill_family=1, fill_horizon=1, per_family=2, per_redundancy=1, total=2)


def parent_rows(s, d):
    """The screen's rows with coverage; a target's horizon is its bars of 120 minutes, a family is one redundancy group but
    for prices, which have none."""
    rows = screening.finalised(screen(s, d)).drop("n").join(screening.coverage(pairs(s, d)), PAIR)
    minutes = F.substring("target", 5, 1).cast("int") * 120
    redundancy = F.when(F.col("family") != "price", F.col("family"))
    return rows.select(*PAIR, "family", redundancy.alias("redundancy"), op.horizon_family(minutes).alias("horizon"), F.col("global_fdr").alias("fdr"), F.col("spread").alias("effect"), "score", "n", "n_sessions", "n_symbols", "n_decisions")


PS = """cv as (select feature, target, count(*) as n, count(distinct session) as ns, count(distinct symbol) as ny, count(distinct (session, slot)) as nd from p group by all),
pr0 as (select fin.feature, fin.target, family, case when family <> 'price' then family end as redundancy, case when substr(fin.target, 5, 1) = '1' then 'medium' else 'long_intraday' end as horizon, global_fdr as fdr, spread as effect, score from fin join cv using (feature, target) where n >= 100 and ns >= 5 and ny >= 3 and nd >= 10 and global_fdr is not null and spread is not null),
pr1 as (select *, fdr <= 0.8 as passes, max((fdr <= 0.8)::int) over (partition by feature) = 1 as hit from pr0), pr2 as (select *, case when passes or not hit then abs(effect) end as asked from pr1), pr3 as (select *, case when asked = max(asked) over (partition by feature) then sign(effect) end as sg from pr2),
sm as (select feature, family, redundancy, min(fdr) as best_fdr, max(abs(effect)) as best_effect, max(coalesce(score, 0)) as best_score, count(*) as targets, count(distinct horizon) as horizons, list(distinct horizon) as names, bool_or(hit) as strict, case when min(sg) = max(sg) then min(sg) else 0 end::int as orientation from pr3 group by all),
ff as (select feature from sm where not strict qualify row_number() over (partition by family order by best_effect desc, best_fdr, feature) <= 1), fh as (select feature from (select *, unnest(names) as h from sm where not strict) qualify row_number() over (partition by h order by best_effect desc, best_fdr, feature) <= 1),
s1 as (select *, feature in (select feature from ff union all select feature from fh) as backfill, -log10(greatest(best_fdr, 1e-300)) as weight from sm),
a0 as (select *, 0.4 * (rank() over (order by weight) + (count(*) over (partition by weight) - 1) / 2.0::double) / count(*) over () + 0.3 * (rank() over (order by best_effect) + (count(*) over (partition by best_effect) - 1) / 2.0::double) / count(*) over () + 0.2 * (rank() over (order by best_score) + (count(*) over (partition by best_score) - 1) / 2.0::double) / count(*) over () + 0.1 * (rank() over (order by horizons) + (count(*) over (partition by horizons) - 1) / 2.0::double) / count(*) over () as parent_score from s1 where strict or backfill),
a1 as (select *, redundancy is null or row_number() over (partition by redundancy order by parent_score desc, feature) <= 1 as room0 from a0), a2 as (select *, room0 and coalesce(sum(room0::int) over (partition by family order by parent_score desc, feature rows between unbounded preceding and 1 preceding), 0) < 2 as room from a1),
a3 as (select *, room and coalesce(sum(room::int) over (order by parent_score desc, feature rows between unbounded preceding and 1 preceding), 0) < 2 as selected from a2),
a4 as (select *, case when selected then '' when coalesce(sum(selected::int) over (partition by family order by parent_score desc, feature rows between unbounded preceding and 1 preceding), 0) >= 2 then 'feature_family_cap' when redundancy is not null and coalesce(sum(selected::int) over (partition by redundancy order by parent_score desc, feature rows between unbounded preceding and 1 preceding), 0) >= 1 then 'redundancy_group_cap' else 'total_parent_cap' end as why from a3),
pa as (select s1.feature, s1.family, s1.orientation, s1.strict, s1.backfill, s1.targets, s1.horizons, s1.best_fdr, s1.best_effect, a4.parent_score, coalesce(a4.selected, false) as selected, coalesce(why, 'fdr_or_effect_threshold') as rejection_reason from s1 left join a4 using (feature))"""
R.add("parent_selection", "feature family strict backfill selected rejection_reason", "orientation targets horizons", "best_fdr best_effect parent_score", lambda s, d: op.parents(parent_rows(s, d), RULES), f"{SCR}, {PS}\nselect * from pa")


def planned(s, d):
    """The plan over all pairs of covered features, strongest pairs first."""
    p = op.parents(parent_rows(s, d), RULES).select("feature", "orientation", F.coalesce("parent_score", F.lit(0.0)).alias("score"))
    corr = selection.rank_correlations(feats(s, d), NAMES).select("a", "b", "corr")
    both = corr.join(p.toDF("a", "orientation_a", "score_a"), "a").join(p.toDF("b", "orientation_b", "score_b"), "b")
    return op.operator_plan(both.withColumn("pair_score", F.round(0.4 * F.col("score_a") + 0.4 * F.col("score_b") + 0.2 * F.coalesce(1 - F.abs("corr"), F.lit(0.0)), 9)), most=10)


R.add(
    "operator_plan", "a b operator anchor other", "n direction", "anchor_edge other_edge pair_score", planned,
    f"""{SCR}, {PS}, {RC}, pp as (select a, b, i.orientation as oa, j.orientation as ob, coalesce(i.parent_score, 0) >= coalesce(j.parent_score, 0) as fst, round(0.4 * coalesce(i.parent_score, 0) + 0.4 * coalesce(j.parent_score, 0) + 0.2 * coalesce(1 - abs(corr), 0), 9) as pair_score from rc join pa i on i.feature = a join pa j on j.feature = b where i.orientation <> 0 and j.orientation <> 0),
op0 as (select a, b, pair_score, 0 as place, 'aligned_rank_mean' as operator, a as anchor, b as other, null::double as anchor_edge, null::double as other_edge, 1 as direction from pp
union all select a, b, pair_score, 1, 'intersection', a, b, case when oa > 0 then case when fst then 0.9 else 0.75 end else case when fst then 0.1 else 0.25 end end, case when ob > 0 then case when fst then 0.75 else 0.9 end else case when fst then 0.25 else 0.1 end end, 1 from pp
union all select a, b, pair_score, 2, 'gated_anchor', case when fst then a else b end, case when fst then b else a end, null, case when (case when fst then ob else oa end) > 0 then 0.75 else 0.25 end, case when fst then oa else ob end from pp)
select *, row_number() over (order by pair_score desc, a, b, place) as n from op0 qualify n <= 10""",
)

def queue(s, d):
    from .selection import feature_clusters

    rows = screening.finalised(screen(s, d)).withColumn("horizon", op.horizon_family(F.substring("target", 5, 1).cast("int") * 120))
    rows = rows.withColumnRenamed("global_fdr", "fdr")
    return op.candidate_queue(rows, feature_clusters(s, d), top=6, fdr=0.05, per_family=3, per_cluster=2, per_horizon=4, limit=6)


R.add(
    "candidate_queue", f"{P} family horizon candidate_cluster", "place", "cluster_fdr", queue,
    f"""{SCR.replace('with ', 'with recursive ', 1)}, {RC}, ed as (select a, b from rc where abs(corr) >= 0.3 union select b, a from rc where abs(corr) >= 0.3), walk as (select unnest([{", ".join(f"'{n}'" for n in NAMES)}]) as name, unnest([{", ".join(f"'{n}'" for n in NAMES)}]) as seen union select walk.name, ed.b from walk join ed on ed.a = walk.seen), fc as (select name, min(seen) as cluster from walk group by name),
cq0 as (select feature, target, family, p, global_fdr as fdr, score, monotonicity, case when substr(target, 5, 1) = '1' then 'medium' else 'long_intraday' end as horizon, row_number() over (order by global_fdr nulls last, score desc, feature, target) as pl from fin where p is not null),
cq1 as (select * from (select * from cq0 where pl <= 6 or fdr < 0.05) qualify row_number() over (partition by family order by pl) <= 3),
cq2 as (select cq1.*, cluster || '__' || horizon || '__response_' || sign(coalesce(monotonicity, 0))::int as candidate_cluster, length(feature) - length(replace(feature, '_', '')) + coalesce(nullif(regexp_extract(feature, '_([0-9]+)m?$', 1), '')::double, 0) / 1000 as cx from cq1 join fc on fc.name = feature),
cq3 as (select *, p * count(p) over (partition by candidate_cluster) / row_number() over (partition by candidate_cluster order by p, feature, target) as qv, min(pl) over (partition by candidate_cluster) as head, row_number() over (partition by candidate_cluster order by pl) as best, row_number() over (partition by candidate_cluster order by cx, pl) as simple from cq2),
cq4 as (select *, least(1, min(qv) over (partition by candidate_cluster order by p, feature, target rows between current row and unbounded following)) as cluster_fdr, case when best = 1 then 1 when simple = 1 then 2 when best = 2 then 3 end as turn from cq3),
cq5 as (select * from cq4 where turn is not null qualify row_number() over (partition by candidate_cluster order by turn) <= 2), cq6 as (select * from cq5 qualify row_number() over (partition by horizon order by head, turn) <= 4)
select *, row_number() over (order by head, turn) as place from cq6 qualify place <= 6""",
)

R.add(
    "exact_effects", f"{P} scope label", "n", "mean_y slope", lambda s, d: op.exact_effects(pairs(s, d)),
    f"{LONG}\nselect feature, target, 'year' as scope, session[1:4] as label, count(*) as n, avg(y) as mean_y, regr_slope(y, x) as slope from p group by all union all select feature, target, 'symbol', symbol, count(*), avg(y), regr_slope(y, x) from p group by all union all select feature, target, 'slot', slot::varchar, count(*), avg(y), regr_slope(y, x) from p group by all",
)
R.add("exact_intervals", P, "n", "slope low high low_two_way high_two_way", lambda s, d: op.intervals(screening.clustered_screen(pairs(s, d))), f"{TWO}\nselect feature, target, n, slope, slope - 1.959963984540054::double * se as low, slope + 1.959963984540054::double * se as high, slope - 1.959963984540054::double * se2 as low_two_way, slope + 1.959963984540054::double * se2 as high_two_way from v2")
R.add("pair_skewness", P, "n", "skew_x skew_y", lambda s, d: op.skewness(pairs(s, d)), f"{LONG}, sk0 as (select *, avg(x) over w as mx, avg(y) over w as my from p window w as (partition by feature, target))\nselect feature, target, count(*) as n, case when var_pop(x) > 0 then avg((x - mx) ** 3) / var_pop(x) ** 1.5 end as skew_x, case when var_pop(y) > 0 then avg((y - my) ** 3) / var_pop(y) ** 1.5 end as skew_y from sk0 group by all")
R.add(
    "lookback_extras", K, "", "range_mean range_ratio breakdown rel_volume_inclusive volume_range_ratio return_volume_product body_pct", lambda s, d: op.lookback_extras(bars(s, d)),
    f"""{B}, {SEG}, le0 as (select *, (h - l) / nullif(c, 0) as rg, c / nullif(lag(c) over s, 0) - 1 as ret from segs window s as (partition by symbol, session, seg order by slot)),
le1 as (select *, case when count(l) over w >= 4 then min(l) over w end as lo, case when count(rg) over w >= 4 then avg(rg) over w end as range_mean, case when count(v) over w >= 4 then avg(v) over w end as vm from le0 window w as (partition by symbol, session, seg order by slot rows between 3 preceding and current row))
select symbol, session, slot, range_mean, rg / nullif(range_mean, 0) as range_ratio, case when lag(lo) over s is not null then greatest(1 - c / nullif(lag(lo) over s, 0), 0) end as breakdown, v / nullif(vm, 0) as rel_volume_inclusive, v / nullif(vm, 0) / nullif(rg / nullif(range_mean, 0), 0) as volume_range_ratio, ret * (v / nullif(vm, 0)) as return_volume_product, (c - o) / nullif(o, 0) as body_pct from le1 window s as (partition by symbol, session, seg order by slot)""",
)
R.add("every_kth_row", K, "", "c", lambda s, d: op.every_kth(bars(s, d), ["symbol"], ["session", "slot"], 7), f"{B}\nselect symbol, session, slot, c from bars qualify (row_number() over (partition by symbol order by session, slot) - 1) % 7 = 0")
R.add("latest_state", "c_custkey o_orderdate o_orderstatus", "", "", lambda s, d: op.latest_state(v.read(s, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderdate").cast("string").alias("o_orderdate"), "o_orderstatus"), "c_custkey", "o_orderdate", "o_orderstatus"), "\nselect o_custkey as c_custkey, o_orderdate::varchar as o_orderdate, o_orderstatus from orders qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderstatus desc) = 1")
R.add("semi_join_keys", "o_orderkey", "o_custkey", "", lambda s, d: v.read(s, d, "orders").join(v.read(s, d, "lineitem").where("l_quantity >= 49").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi"), "\nselect o_orderkey, o_custkey from orders where o_orderkey in (select l_orderkey from lineitem where l_quantity >= 49)")
R.add("key_sets", "k kept", "", "", lambda s, d: (a := v.read(s, d, "orders").select(F.col("o_custkey").alias("k"))).intersect(b := v.read(s, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k"))).withColumn("kept", F.lit("both")).unionByName(b.exceptAll(a.distinct()).withColumn("kept", F.lit("second"))), "\nselect k, 'both' as kept from (select o_custkey as k from orders intersect select c_custkey from customer where c_acctbal > 0) union all select k, 'second' from (select c_custkey as k from customer where c_acctbal > 0 except select o_custkey from orders)")


def identities(s, d):
    """Invented by rule: a symbol is "-a" until the 16th and "-b" from then on, known from the start; on the 11th it is
    learnt that odd symbols were "-c" from the first day on. A symbol that ends in 9 has no identity before the 6th."""
    one = bars(s, d).select("symbol", F.substring("session", 1, 8).alias("m")).distinct()
    day = lambda n: F.concat("m", F.lit(f"{n:02d}"))
    start = F.when(F.substring("symbol", 2, 1) == "9", day(6)).otherwise(day(1))
    span = lambda name, begin, end, known, test=F.lit(True): one.where(test).select("symbol", F.concat("symbol", F.lit(name)).alias("identity"), begin.alias("valid_from"), end.alias("valid_to"), known.alias("known_at"))
    odd = F.substring("symbol", 2, 1).cast("int") % 2 == 1
    return span("-a", start, day(16), day(1)).unionByName(span("-b", day(16), F.lit(None).cast("string"), day(1))).unionByName(span("-c", start, day(16), day(11), odd))


def twice(s, d):
    """Bars, those of slot 0 given twice."""
    b = bars(s, d).select("symbol", "session", "slot", "c")
    return b.unionAll(b.where("slot = 0"))


R.add(
    "bitemporal_identity", f"{K} identity", "", "c", lambda s, d: op.bitemporal(twice(s, d), identities(s, d), "symbol", "session", "session"),
    f"""{B}, tw as (select symbol, session, slot, c from bars union all select symbol, session, slot, c from bars where slot = 0)
select symbol, session, slot, c, symbol || case when symbol[2:2] = '9' and session[9:10] < '06' then null when session[9:10] >= '16' then '-b' when symbol[2:2]::int % 2 = 1 and session[9:10] >= '11' then '-c' else '-a' end as identity from tw""",
)


def copied(s, d):
    """The built features with copies among them: equal columns, one that is equal but for a null, one that is but for a value."""
    f = feats(s, d)
    return f.select(*K.split(), "o", "c", "ret_1", "vol_3", "range_pos_3", "rel_vol_3", "up", F.col("ret_1").alias("a_ret"), (F.col("vol_3") * 2 / 2).alias("b_vol"), F.when(F.col("slot") != 5, F.col("ret_1")).alias("no_fifth"), F.when(F.col("slot") == 5, -F.col("c")).otherwise(F.col("c")).alias("turned"), F.lit(None).cast("double").alias("none_1"), F.lit(None).cast("double").alias("none_2"))


CC = ["o", "c", "ret_1", "vol_3", "range_pos_3", "rel_vol_3", "up", "a_ret", "b_vol", "no_fifth", "turned", "none_1", "none_2"]
R.add(
    "content_classes", "name same_as", "n_values", "", lambda s, d: op.content_classes(copied(s, d), K.split(), CC),
    f"""{ALL}, cc0 as (select *, ret_1 as a_ret, vol_3 * 2 / 2 as b_vol, case when slot <> 5 then ret_1 end as no_fifth, case when slot = 5 then -c else c end as turned, null::double as none_1, null::double as none_2 from feat), cc1 as (select symbol, session, slot, unnest({CC}) as name, unnest([{', '.join(CC)}]) as x from cc0),
cc2 as (select a.name, b.name as other from cc1 a join cc1 b using (symbol, session, slot) group by all having bool_and(a.x is not distinct from b.x))
select cc2.name, min(other) as same_as, any_value(n) as n_values from cc2 join (select name, count(x) as n from cc1 group by name) using (name) group by cc2.name""",
)
