"""Queries of the strategy and execution group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from panelforge.operators import asof
from panelforge.operators import trading as op
from panelforge.sources import views as v

from .intraday import ALL, bars, feats, targets
from .registry import Registry

R = Registry()


def signals(s, d):
    """One decision a session: the fifth slot's return against the return that follows."""
    return feats(s, d).join(targets(s, d), ["symbol", "session", "slot"]).where("slot = 5 and ret_1 is not null and fwd_1 is not null").select("symbol", "session", F.col("ret_1").alias("signal"), F.col("fwd_1").alias("ret"))


SG = f"{ALL}, sg as (select symbol, session, ret_1 as signal, fwd_1 as ret from feat join tgt using (symbol, session, slot) where slot = 5 and ret_1 is not null and fwd_1 is not null)"
TOP = f"{SG}, tp as (select * from (select *, case when row_number() over (partition by session order by signal desc, symbol) <= 1 then 1 when row_number() over (partition by session order by signal, symbol desc) <= 1 then -1 end as side from sg) where side is not null)"
PF = f"{TOP}, pf as (select session, count(*) as trades, avg(ret) filter (side = 1) as long_leg, avg(ret) filter (side = -1) as short_leg, (avg(ret) filter (side = 1) - avg(ret) filter (side = -1)) / 2 as gross from tp group by session)"
R.add("strat_topn", "symbol session", "side", "signal ret", lambda s, d: op.select_top(signals(s, d)), f"{TOP}\nselect * from tp")
R.add("strat_quantile", "symbol session", "side", "signal ret", lambda s, d: op.select_quantile(signals(s, d)), f"{SG}, sq as (select *, row_number() over (partition by session order by signal, symbol)::double / count(*) over (partition by session) as sh from sg)\nselect *, case when sh > 1 - 0.2::double then 1 else -1 end as side from sq where sh > 1 - 0.2::double or sh <= 0.2::double")
R.add("portfolio", "session", "trades", "long_leg short_leg gross", lambda s, d: op.portfolio(op.select_top(signals(s, d))), f"{PF}\nselect * from pf")
AD = "ad as (select session, long_leg, short_leg, case when count(long_leg) over w >= 5 then case when avg(long_leg) over w >= avg(-short_leg) over w then 1 else -1 end end as choice from pf window w as (order by session rows between unbounded preceding and 1 preceding))"
R.add("strat_adaptive", "session", "choice", "adaptive", lambda s, d: op.adaptive(op.portfolio(op.select_top(signals(s, d)))), f"{PF}, {AD}\nselect session, choice, case choice when 1 then long_leg when -1 then -short_leg end as adaptive from ad")


def net(s, d):
    return op.cost_grid(op.portfolio(op.select_top(signals(s, d))), bars(s, d).select("session").distinct())


CG = f"{PF}, cg as (select session, bps, coalesce(gross - 2 * bps / 1e4, 0) as net from (select distinct session from bars) cross join (select unnest([0.0::double, 1.0::double, 5.0::double]) as bps) left join pf using (session))"
R.add("cost_grid", "session", "", "bps net", net, f"{CG}\nselect * from cg")
R.add("equity_metrics", "", "n", "bps total max_drawdown win_rate break_even_bps ratio", lambda s, d: op.metrics(net(s, d)), f"{CG}, eq as (select *, exp(sum(ln(1 + net)) over (partition by bps order by session)) as equity from cg), dd as (select *, equity / max(equity) over (partition by bps order by session) - 1 as dd from eq)\nselect bps, arg_max(equity, session) - 1 as total, min(dd) as max_drawdown, avg((net > 0)::int) as win_rate, avg(net) / 2 * 1e4 as break_even_bps, avg(net) / nullif(stddev_samp(net), 0) as ratio, count(*) as n from dd group by bps")


def sweep(s, d):
    """Every selection size at every cost, in one plan."""
    base, days = signals(s, d), bars(s, d).select("session").distinct()
    parts = [op.metrics(op.cost_grid(op.portfolio(op.select_top(base, n)), days)).withColumn("size", F.lit(n)) for n in (1, 2, 3)]
    return reduce(lambda a, b: a.unionByName(b), parts)


SW = f"{SG}, sz as (select unnest([1, 2, 3]) as size), sr as (select *, row_number() over (partition by session order by signal desc, symbol) as u, row_number() over (partition by session order by signal, symbol desc) as dn from sg), sp as (select size, session, (avg(ret) filter (u <= size) - avg(ret) filter (u > size and dn <= size)) / 2 as gross from sr cross join sz group by all), sn as (select z.size, d.session, bps, coalesce(gross - 2 * bps / 1e4, 0) as net from (select distinct session from bars) d cross join sz z cross join (select unnest([0.0::double, 1.0::double, 5.0::double]) as bps) left join sp on sp.size = z.size and sp.session = d.session)"
R.add("param_sweep", "size", "n", "bps total win_rate", sweep, f"{SW}\nselect size, bps, exp(sum(ln(1 + net))) - 1 as total, avg((net > 0)::int) as win_rate, count(*) as n from sn group by all")


def quotes(s, d):
    b = bars(s, d)
    return b.select("symbol", "session", F.col("slot").alias("at"), F.col("c").alias("bid"), (F.col("c") * 1.0005).alias("ask"))


def orders(s, d):
    return op.select_quantile(signals(s, d)).select(F.concat_ws("-", "symbol", "session").alias("order_id"), "symbol", "session", "side", F.lit(6).alias("entry"), F.lit(9).alias("exit"))


OQ = f"{SG}, sq as (select *, row_number() over (partition by session order by signal, symbol)::double / count(*) over (partition by session) as sh from sg), od as (select symbol || '-' || session as order_id, symbol, session, case when sh > 1 - 0.2::double then 1 else -1 end as side from sq where sh > 1 - 0.2::double or sh <= 0.2::double), qt as (select symbol, session, slot as tq, c as bid, c * 1.0005::double as ask from bars), oe as (select od.*, (select min(tq) from qt where qt.symbol = od.symbol and qt.session = od.session and tq between 6 and 8) as ea, (select min(tq) from qt where qt.symbol = od.symbol and qt.session = od.session and tq between 9 and 11) as xa from od), oj as (select oe.*, e.bid as eb, e.ask as ek, x.bid as xb, x.ask as xk from oe left join qt e on e.symbol = oe.symbol and e.session = oe.session and e.tq = ea left join qt x on x.symbol = oe.symbol and x.session = oe.session and x.tq = xa), rp as (select *, case when ea is null then 'missing_quote' when xa is null then 'missing_path' else 'filled' end as status, case when ea is not null and xa is not null then side * (case when side = 1 then xb / ek else xk / eb end - 1) end as gross_return from oj)"
R.add("quote_replay", "order_id symbol session status", "side", "gross_return", lambda s, d: op.replay(orders(s, d), quotes(s, d)), f"{OQ}\nselect * from rp")
R.add("fill_status", "status", "n", "mean", lambda s, d: op.replay(orders(s, d), quotes(s, d)).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.avg("gross_return").alias("mean")), f"{OQ}\nselect status, count(*) as n, avg(gross_return) as mean from rp group by status")
R.add("passive_fill", "order_id status", "side filled_at", "limit_price", lambda s, d: op.passive(orders(s, d), quotes(s, d)).withColumnRenamed("limit", "limit_price"),
      f"{OQ}, pl as (select order_id, symbol, session, side, ea, case when side = 1 then eb else ek end as limit_price from oj where ea is not null), pz as (select *, (select min(tq) from qt where qt.symbol = pl.symbol and qt.session = pl.session and tq > ea and tq <= ea + 3 and case when side = 1 then ask <= limit_price else bid >= limit_price end) as filled_at from pl)\nselect *, case when filled_at is null then 'unfilled' else 'filled' end as status from pz")
R.add("overlap_jaccard", "a b", "shared", "jaccard", lambda s, d: op.overlap(op.select_quantile(signals(s, d)).select(F.col("symbol"), F.col("session")), "symbol", "session"),
      f"{OQ}, sz as (select symbol, count(*) as n from od group by symbol), bo as (select x.symbol as a, y.symbol as b, count(*) as shared from od x join od y on x.session = y.session and x.symbol < y.symbol group by all)\nselect a, b, shared, shared::double / (p.n + q.n - shared) as jaccard from bo join sz p on p.symbol = a join sz q on q.symbol = b")
R.add("events_by_minute", "event_type", "n", "total", lambda s, d: v.read(s, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")), "\nselect event_type, count(*) as n, sum(value) as total from events group by event_type")


def slot_signals(s, d):
    """A decision at every bar: the bar's return."""
    return feats(s, d).where("ret_1 is not null").select("symbol", "session", "slot", F.col("ret_1").alias("signal"), "rel_vol_3", "range_pos_3")


CUT = "2024-01-11"
XT = f"""{ALL}, ss as (select symbol, session, slot, ret_1 as signal, rel_vol_3, range_pos_3 from feat where ret_1 is not null), th as (select slot, quantile_cont(abs(signal), 0.6) as threshold, count(*) as train_rows from ss where session < '{CUT}' group by slot),
xo0 as (select *, sign(signal)::int as side from ss join th using (slot) where abs(signal) >= threshold and threshold > 0), xo1 as (select * from xo0 qualify row_number() over (partition by session, slot, side order by abs(signal) desc, symbol) <= 3),
xo2 as (select *, row_number() over (partition by session, slot, side order by abs(signal) desc, symbol) as place, least(count(*) filter (side = 1) over (partition by session, slot), count(*) filter (side = -1) over (partition by session, slot)) as keep from xo1), xo as (select *, side * 0.5::double / keep as weight from xo2 where place <= keep)"""
R.add("extreme_thresholds", "slot", "train_rows", "threshold", lambda s, d: op.thresholds(slot_signals(s, d), CUT, 0.6), f"{XT}\nselect * from th")
R.add("balanced_orders", "symbol session slot", "side", "signal weight", lambda s, d: op.extreme(slot_signals(s, d), CUT, 0.6), f"{XT}\nselect * from xo")


def fills(s, d):
    return op.market_fill(op.extreme(slot_signals(s, d), CUT, 0.6), quotes(s, d), 2)


MF = f"{XT}, qn as (select symbol, session, slot, c as bid, c * 1.0005::double as ask from bars), mf as (select xo.*, case when side = 1 then z.bid / n.ask - 1 else n.bid / z.ask - 1 end as raw from xo join qn n using (symbol, session, slot) left join qn z on z.symbol = xo.symbol and z.session = xo.session and z.slot = xo.slot + 2)"
R.add("market_fill", "symbol session slot", "side", "raw", fills, f"{MF}\nselect * from mf")


def masks():
    return {"all": F.lit(True), "strong_move": F.abs("signal") >= 0.2, "high_volume": F.col("rel_vol_3") >= 1.25, "range_agree": F.col("side") * (F.col("range_pos_3") - 0.5) > 0}


def refined(s, d):
    """Every mask's fills, balanced again within the mask."""
    rows = op.balanced(op.refinements(fills(s, d).where("raw is not null"), masks()), 3, ("session", "slot", "filter"))
    return rows.groupBy("filter").agg(F.count(F.lit(1)).alias("n"), F.avg("raw").alias("mean_raw"))


R.add(
    "refinement_filters", "filter", "n", "mean_raw", refined,
    f"""{MF}, mk as (select *, unnest(list_filter(['all', case when abs(signal) >= 0.2 then 'strong_move' end, case when rel_vol_3 >= 1.25 then 'high_volume' end, case when side * (range_pos_3 - 0.5) > 0 then 'range_agree' end], lambda z: z is not null)) as filter from mf where raw is not null),
mk1 as (select filter, side, raw, row_number() over (partition by session, slot, filter, side order by abs(signal) desc, symbol) as place, least(count(*) filter (side = 1) over (partition by session, slot, filter), count(*) filter (side = -1) over (partition by session, slot, filter)) as keep from mk)
select filter, count(*) as n, avg(raw) as mean_raw from mk1 where place <= keep group by filter""",
)

PERIODS = {"train": ("2024-01-01", "2024-01-10"), "development": ("2024-01-11", "2024-01-20"), "recent": ("2024-01-21", "2024-01-31"), "full": ("2024-01-01", "2024-12-31")}
SPANS = ", ".join(f"('{n}', '{a}', '{b}')" for n, (a, b) in PERIODS.items())
PS = f"""{CG}, pr(period, a, b) as (values {SPANS}), ps0 as (select *, product(1 + net) over (partition by bps, period order by session) as equity from cg join pr on session between a and b),
ps1 as (select *, equity / greatest(1, max(equity) over (partition by bps, period order by session)) - 1 as dd from ps0), ps as (select bps, period, count(*) as n, arg_max(equity, session) - 1 as total, min(dd) as max_drawdown, sqrt(252) * avg(net) / nullif(stddev_samp(net), 0) as sharpe from ps1 group by all)"""
R.add("period_stats", "period", "n", "bps total max_drawdown sharpe", lambda s, d: op.period_stats(net(s, d), PERIODS), f"{PS}\nselect * from ps")


def leverage_rows(s, d):
    rows = op.leveraged(net(s, d).where("bps = 1")).withColumn("bps", F.col("leverage"))
    return op.period_stats(rows, {"full": PERIODS["full"]}).withColumnRenamed("bps", "leverage")


R.add(
    "leverage_metrics", "", "n", "leverage total max_drawdown sharpe", leverage_rows,
    f"""{CG}, lv0 as (select session, leverage, net * leverage as net from cg cross join (select unnest([1.0::double, 2.0::double, 4.0::double]) as leverage) where bps = 1), lv1 as (select *, product(1 + net) over (partition by leverage order by session) as equity from lv0), lv as (select *, equity / greatest(1, max(equity) over (partition by leverage order by session)) - 1 as dd from lv1)
select leverage, count(*) as n, arg_max(equity, session) - 1 as total, min(dd) as max_drawdown, sqrt(252) * avg(net) / nullif(stddev_samp(net), 0) as sharpe from lv group by leverage""",
)


def entries(s, d):
    return bars(s, d).where("slot = 5").select("symbol", "session", "slot", F.col("c").alias("entry"))


R.add(
    "path_metrics", "symbol session", "mfe_slot mae_slot", "mfe mae terminal giveback", lambda s, d: op.path_metrics(entries(s, d), bars(s, d)),
    f"""{ALL}, pm as (select e.symbol, e.session, b.slot, b.c / e.c - 1 as r from bars e join bars b on b.symbol = e.symbol and b.session = e.session and b.slot > 5 where e.slot = 5)
select symbol, session, max(r) as mfe, min(r) as mae, arg_max(slot, {{'r': r, 's': -slot}}) as mfe_slot, arg_min(slot, {{'r': r, 's': slot}}) as mae_slot, arg_max(r, slot) as terminal, max(r) - arg_max(r, slot) as giveback from pm group by all""",
)


def variants(s, d):
    """Selection sizes as variants of one mechanism, judged at 1 bp and under stress at 5 bp."""
    base, days, out = signals(s, d), bars(s, d).select("session").distinct(), []
    for n in (1, 2, 3):
        stats = op.period_stats(op.cost_grid(op.portfolio(op.select_top(base, n)), days), PERIODS)
        fold, whole = (F.col("bps") == 1) & (F.col("period") != "full"), F.col("period") == "full"
        out.append(stats.agg(F.max(F.when(whole & (F.col("bps") == 1), F.col("total"))).alias("total"), F.max(F.when(whole & (F.col("bps") == 5), F.col("total"))).alias("stress"), F.max(F.when(whole & (F.col("bps") == 1), F.col("max_drawdown"))).alias("max_drawdown"), F.count_if(fold & (F.col("total") > 0)).alias("positive_periods"), F.min(F.when(fold, F.col("total"))).alias("worst_period")).withColumn("size", F.lit(n)))
    return op.best_variant(reduce(lambda a, b: a.unionByName(b), out).withColumn("mechanism", F.lit("continuation")), "mechanism", "size")


R.add("best_variant", "mechanism status", "size positive_periods", "total stress max_drawdown worst_period quality", variants)
R.add("trade_counts", "counts", "", "", lambda s, d: op.most_frequent(op.select_quantile(signals(s, d)), "symbol"), f"{OQ}, tc as (select symbol, count(*) as n from od group by symbol order by n desc, symbol limit 20)\nselect '{{' || string_agg('\"' || symbol || '\":' || n, ',' order by n desc, symbol) || '}}' as counts from tc")


def tape(s, d):
    """Quotes by minute of the day from the events themselves; every seventh has no spread and is unusable, others have up to 30 bp."""
    e = v.read(s, d, "events")
    bid = F.lit(100.0) + F.col("value")
    at = F.hour("ts") * 60 + F.minute("ts")
    return e.select(F.concat(F.lit("S"), (F.col("user_id") % 10).cast("string")).alias("symbol"), F.to_date("ts").cast("string").alias("session"), at.alias("at"), bid.alias("bid"), (bid * (1 + (F.col("event_id") % 7) * 0.0005)).alias("ask"))


def tape_orders(s, d):
    """Three orders a symbol and session, held for three hours; sides alternate."""
    slots = F.explode(F.array(F.lit(1), F.lit(4), F.lit(7))).alias("slot")
    o = bars(s, d).select("symbol", "session").distinct().select("symbol", "session", slots)
    side = F.when((F.col("slot") + F.substring("symbol", 2, 1).cast("int")) % 2 == 0, 1).otherwise(-1)
    return o.select(F.concat_ws("-", "symbol", "session", "slot").alias("order_id"), "symbol", "session", F.concat_ws("-", "session", "slot").alias("bucket"), side.alias("side"), (F.col("slot") * 120 + 7).alias("entry"), (F.col("slot") * 120 + 187).alias("exit"))


def taped(passive):
    return lambda s, d: asof.replay(tape_orders(s, d), tape(s, d), by=["symbol", "session"], path=120, delay=20, passive=passive, most_bps=25.0, width=64.0)


def tape_sql(passive):
    pick = lambda side, at, end: f"(select min({{'a': q.at, 'b': q.bid, 'k': q.ask}}) from tq q where q.symbol = o.symbol and q.session = o.session and q.at >= {at} and q.at <= {end}) as {side}"
    fill = "(select min(q.at) from tq q where q.symbol = o.symbol and q.session = o.session and q.at >= e.a and q.at <= entry + 120 and case when side = 1 then q.ask <= e.b else q.bid >= e.k end)" if passive else "e.a"
    price = "case when side = 1 then e.b else e.k end" if passive else "case when side = 1 then e.k else e.b end"
    return f"""with {v.BARS_SQL}, tq as (select 'S' || cast(user_id % 10 as varchar) as symbol, cast(cast(ts as date) as varchar) as session, hour(ts) * 60 + minute(ts) as at, 100.0::double + value as bid, (100.0::double + value) * (1 + (event_id % 7) * 0.0005::double) as ask from events where event_id % 7 between 1 and 5),
oo as (select symbol || '-' || session || '-' || slot as order_id, symbol, session, session || '-' || slot as bucket, case when (slot + symbol[2:2]::int) % 2 = 0 then 1 else -1 end as side, slot * 120 + 7 as entry, slot * 120 + 187 as exit from (select distinct symbol, session from bars) cross join (select unnest([1, 4, 7]) as slot)),
o1 as (select *, {pick('ep', 'entry', 'entry + 120')}, {pick('xp', 'exit', 'exit + 120')}, {pick('e', 'entry + 20', 'entry + 120')}, {pick('x', 'exit + 20', 'exit + 120')} from oo o),
o2 as (select *, {fill} as filled_at from o1 o), o3 as (select *, case when ep is null or xp is null then 'missing_path' when e is null or x is null then 'missing_quote' when filled_at is null then 'unfilled' else 'filled' end as st, side * (case when side = 1 then x.b else x.k end / ({price}) - 1) as gross from o2),
o4 as (select *, row_number() over (partition by bucket, side, st order by symbol, session, order_id) as r, least(count(*) filter (st = 'filled' and side = 1) over (partition by bucket), count(*) filter (st = 'filled' and side = -1) over (partition by bucket)) as keep from o3)
select order_id, symbol, session, bucket, side, filled_at, case when st = 'filled' and r > keep then 'cancelled_unpaired' else st end as status, case when st = 'filled' and r <= keep then gross end as gross_return from o4"""


for name, passive in (("quote_replay_market", False), ("quote_replay_passive", True)):
    R.add(name, "order_id status", "side filled_at", "gross_return", taped(passive), tape_sql(passive))
