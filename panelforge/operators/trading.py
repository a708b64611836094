"""Evaluation of selection strategies, costs, and replay of orders against quotes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.columns import PRECEDING, div

COSTS = (0.0, 1.0, 5.0)


def select_top(rows: DataFrame, n: int = 1) -> DataFrame:
    """The n highest signals long and the n lowest short in each session; equal signals by symbol."""
    part = Window.partitionBy("session")
    r = rows.withColumn("up", F.row_number().over(part.orderBy(F.desc("signal"), "symbol"))).withColumn("down", F.row_number().over(part.orderBy("signal", F.desc("symbol"))))
    return r.withColumn("side", F.when(F.col("up") <= n, 1).when(F.col("down") <= n, -1)).where("side is not null")


def select_quantile(rows: DataFrame, q: float = 0.2) -> DataFrame:
    part = Window.partitionBy("session")
    share = F.row_number().over(part.orderBy("signal", "symbol")) / F.count(F.lit(1)).over(part)
    return rows.withColumn("share", share).withColumn("side", F.when(F.col("share") > 1 - q, 1).when(F.col("share") <= q, -1)).where("side is not null")


def portfolio(trades: DataFrame) -> DataFrame:
    """Half the difference of the legs' means; needs both legs."""
    long, short = F.avg(F.when(F.col("side") == 1, F.col("ret"))), F.avg(F.when(F.col("side") == -1, F.col("ret")))
    return trades.groupBy("session").agg(F.count(F.lit(1)).alias("trades"), long.alias("long_leg"), short.alias("short_leg"), ((long - short) / 2).alias("gross"))


def adaptive(days: DataFrame, least: int = 5) -> DataFrame:
    """Trades the leg that was better on average in the sessions before."""
    w = Window.orderBy("session").rowsBetween(PRECEDING, -1)  # one row a session
    lm, sm = F.avg("long_leg").over(w), F.avg(-F.col("short_leg")).over(w)
    side = F.when(F.count("long_leg").over(w) >= least, F.when(lm >= sm, 1).otherwise(-1))
    return days.withColumn("choice", side).select("session", "choice", F.when(F.col("choice") == 1, F.col("long_leg")).when(F.col("choice") == -1, -F.col("short_leg")).alias("adaptive"))


def cost_grid(days: DataFrame, sessions: DataFrame, costs: tuple = COSTS) -> DataFrame:
    """Every session at every cost; sessions without trades earn 0."""
    grid = sessions.withColumn("bps", F.explode(F.array(*[F.lit(c) for c in costs])))
    d = grid.join(days.select("session", "gross"), "session", "left")
    return d.select("session", "bps", F.coalesce(F.col("gross") - 2 * F.col("bps") / 1e4, F.lit(0.0)).alias("net"))


def metrics(net: DataFrame) -> DataFrame:
    """Compounded return, drawdown, win rate and break-even cost of each cost level."""
    w = Window.partitionBy("bps").orderBy("session").rowsBetween(PRECEDING, 0)
    e = net.withColumn("equity", F.exp(F.sum(F.log1p("net")).over(w)))
    e = e.withColumn("dd", F.col("equity") / F.max("equity").over(w) - 1)
    return e.groupBy("bps").agg((F.max_by("equity", "session") - 1).alias("total"), F.min("dd").alias("max_drawdown"), F.avg((F.col("net") > 0).cast("double")).alias("win_rate"), (F.avg("net") / 2 * 1e4).alias("break_even_bps"), div(F.avg("net"), F.stddev_samp("net")).alias("ratio"), F.count(F.lit(1)).alias("n"))


def first_quote(orders: DataFrame, quotes: DataFrame, at: str, prefix: str, within: int = 2) -> DataFrame:
    """The first quote of the symbol and session at or after a time, at most ``within`` later."""
    q = quotes.select("symbol", "session", F.col("at").alias("q_at"), "bid", "ask")
    met = orders.select("order_id", "symbol", "session", F.col(at).alias("want")).join(q, ["symbol", "session"]).where((F.col("q_at") >= F.col("want")) & (F.col("q_at") <= F.col("want") + within))
    best = met.groupBy("order_id").agg(F.min_by(F.struct("q_at", "bid", "ask"), "q_at").alias("q"))
    return orders.join(best, "order_id", "left").withColumn(f"{prefix}_at", F.col("q.q_at")).withColumn(f"{prefix}_bid", F.col("q.bid")).withColumn(f"{prefix}_ask", F.col("q.ask")).drop("q")


def replay(orders: DataFrame, quotes: DataFrame) -> DataFrame:
    """Market orders cross the spread on entry and exit; a status says what became of each."""
    o = first_quote(first_quote(orders, quotes, "entry", "entry"), quotes, "exit", "exit")
    status = F.when(F.col("entry_at").isNull(), "missing_quote").when(F.col("exit_at").isNull(), "missing_path").otherwise("filled")
    buy, sell = F.when(F.col("side") == 1, F.col("entry_ask")).otherwise(F.col("entry_bid")), F.when(F.col("side") == 1, F.col("exit_bid")).otherwise(F.col("exit_ask"))
    return o.select("order_id", "symbol", "session", "side", status.alias("status"), F.when(status == "filled", F.col("side") * (div(sell, buy) - 1)).alias("gross_return"))


def passive(orders: DataFrame, quotes: DataFrame, wait: int = 3) -> DataFrame:
    """A resting order at the entry's bid (or ask) fills when a later quote within ``wait`` trades through it."""
    o = first_quote(orders, quotes, "entry", "entry").where("entry_at is not null")
    limit = F.when(F.col("side") == 1, F.col("entry_bid")).otherwise(F.col("entry_ask"))
    o = o.withColumn("limit", limit)
    later = o.select("order_id", "symbol", "session", "side", "limit", "entry_at").join(quotes, ["symbol", "session"]).where((F.col("at") > F.col("entry_at")) & (F.col("at") <= F.col("entry_at") + wait))
    through = F.when(F.col("side") == 1, F.col("ask") <= F.col("limit")).otherwise(F.col("bid") >= F.col("limit"))
    hit = later.where(through).groupBy("order_id").agg(F.min("at").alias("filled_at"))
    return o.join(hit, "order_id", "left").select("order_id", "symbol", "session", "side", "limit", "filled_at", F.when(F.col("filled_at").isNotNull(), "filled").otherwise("unfilled").alias("status"))


def overlap(sets: DataFrame, name: str, key: str) -> DataFrame:
    """Jaccard similarity of the key sets of every two names (names are few: variants of a sweep)."""
    d = sets.select(name, key).distinct()
    size = d.groupBy(name).agg(F.count(F.lit(1)).alias("n"))
    both = d.alias("a").join(d.alias("b"), key).where(F.col(f"a.{name}") < F.col(f"b.{name}")).groupBy(F.col(f"a.{name}").alias("a"), F.col(f"b.{name}").alias("b")).agg(F.count(F.lit(1)).alias("shared"))
    both = both.join(size.withColumnRenamed(name, "a").withColumnRenamed("n", "na"), "a").join(size.withColumnRenamed(name, "b").withColumnRenamed("n", "nb"), "b")
    return both.select("a", "b", "shared", (F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))).alias("jaccard"))


def balanced(rows: DataFrame, most: int, by: tuple[str, ...] = ("session",), cohort: int = 1) -> DataFrame:
    """Equally many orders on both sides of a decision, the strongest first (equal ones by symbol); weights of a side sum to
    a half, shared by ``cohort`` overlapping holdings."""
    side = Window.partitionBy(*by, "side").orderBy(F.abs("signal").desc(), "symbol")
    r = rows.withColumn("place", F.row_number().over(side)).where(F.col("place") <= most)
    part = Window.partitionBy(*by)
    keep = F.least(F.count_if(F.col("side") == 1).over(part), F.count_if(F.col("side") == -1).over(part))
    return r.withColumn("keep", keep).where(F.col("place") <= F.col("keep")).withColumn("weight", F.col("side") * 0.5 / F.col("keep") / cohort)


def thresholds(rows: DataFrame, until: str, q: float, by: tuple[str, ...] = ("slot",)) -> DataFrame:
    """The quantile of absolute signals over sessions before ``until`` alone."""
    return rows.where(F.col("session") < until).groupBy(*by).agg(F.percentile(F.abs("signal"), F.lit(q)).alias("threshold"), F.count(F.lit(1)).alias("train_rows"))


def extreme(rows: DataFrame, until: str, q: float, most: int = 3, by: tuple[str, ...] = ("slot",)) -> DataFrame:
    """Orders in the signal's direction where it reaches a threshold that was frozen on the sessions before ``until``."""
    strong = rows.join(thresholds(rows, until, q, by), list(by)).where((F.abs("signal") >= F.col("threshold")) & (F.col("threshold") > 0))
    return balanced(strong.withColumn("side", F.signum("signal").cast("int")), most, ("session", *by))


def market_fill(orders: DataFrame, quotes: DataFrame, h: int) -> DataFrame:
    """Crosses the spread at the decision and again exactly ``h`` steps later: a join of the quotes with themselves, shifted."""
    now = quotes.select("symbol", "session", F.col("at").alias("slot"), "bid", "ask")
    later = quotes.select("symbol", "session", (F.col("at") - h).alias("slot"), F.col("bid").alias("bid_later"), F.col("ask").alias("ask_later"))
    met = orders.join(now, ["symbol", "session", "slot"]).join(later, ["symbol", "session", "slot"], "left")
    raw = F.when(F.col("side") == 1, div("bid_later", "ask") - 1).otherwise(div("bid", "ask_later") - 1)
    return met.withColumn("raw", raw)


def refinements(fills: DataFrame, masks: dict) -> DataFrame:
    """Fills under each named mask: one pass that gives a row once for every mask it meets."""
    met = F.array(*[F.when(test, F.lit(name)) for name, test in masks.items()])
    return fills.withColumn("filter", F.explode(met)).where("filter is not null")


def period_stats(net: DataFrame, periods: dict[str, tuple[str, str]]) -> DataFrame:
    """Compounded return, drawdown against a peak that starts at 1, and yearly Sharpe ratio, by cost and period; periods may overlap."""
    inside = F.array(*[F.when(F.col("session").between(a, b), F.lit(name)) for name, (a, b) in periods.items()])
    rows = net.withColumn("period", F.explode(inside)).where("period is not null")
    w = Window.partitionBy("bps", "period").orderBy("session").rowsBetween(PRECEDING, 0)
    rows = rows.withColumn("equity", F.product(1 + F.col("net")).over(w))
    rows = rows.withColumn("dd", F.col("equity") / F.greatest(F.lit(1.0), F.max("equity").over(w)) - 1)
    return rows.groupBy("bps", "period").agg(F.count(F.lit(1)).alias("n"), (F.max_by("equity", "session") - 1).alias("total"), F.min("dd").alias("max_drawdown"), (F.sqrt(F.lit(252.0)) * div(F.avg("net"), F.stddev_samp("net"))).alias("sharpe"))


def leveraged(net: DataFrame, levels: tuple = (1.0, 2.0, 4.0)) -> DataFrame:
    """The same net series held several times over; ``bps`` names the cost, ``leverage`` the level."""
    return net.withColumn("leverage", F.explode(F.array(*[F.lit(x) for x in levels]))).withColumn("net", F.col("net") * F.col("leverage"))


def path_metrics(entries: DataFrame, bars: DataFrame) -> DataFrame:
    """Best and worst return on the way from an entry price to the session's end, when they came first, and what the end
    gave back of the best."""
    path = entries.select("symbol", "session", F.col("slot").alias("from"), "entry").join(bars.select("symbol", "session", "slot", "c"), ["symbol", "session"]).where(F.col("slot") > F.col("from"))
    r = path.withColumn("r", div("c", "entry") - 1)
    out = r.groupBy("symbol", "session", "from").agg(F.max("r").alias("mfe"), F.min("r").alias("mae"), F.max_by("slot", F.struct("r", -F.col("slot"))).alias("mfe_slot"), F.min_by("slot", F.struct("r", "slot")).alias("mae_slot"), F.max_by("r", "slot").alias("terminal"))
    return out.withColumn("giveback", F.col("mfe") - F.col("terminal"))


def best_variant(rows: DataFrame, mechanism: str, variant: str) -> DataFrame:
    """Of each mechanism the variant that passes its gate and has the highest quality; ``rows``: total, stress, max_drawdown,
    positive_periods, worst_period. Equal ones by variant."""
    # fixed values: the limits of the gate and the weights of the quality
    gate = (F.col("total") > 0) & (F.col("stress") >= -0.002) & (F.col("positive_periods") >= 2) & (F.col("max_drawdown") >= -0.05)
    r = rows.withColumn("gate", F.coalesce(gate, F.lit(False))).withColumn("quality", F.col("total") / (F.abs("max_drawdown") + 0.0025) + F.col("worst_period"))
    place = F.row_number().over(Window.partitionBy(mechanism).orderBy(F.desc("gate"), F.desc_nulls_last("quality"), variant))
    return r.withColumn("place", place).where("place = 1").withColumn("status", F.when(F.col("gate"), "execution_qualified_discovery").otherwise("rejected"))


def most_frequent(rows: DataFrame, column: str, k: int = 20) -> DataFrame:
    """A JSON object of the k most frequent values and their counts, equal counts by value."""
    top = rows.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column).limit(k)
    listed = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), F.col(column).cast("string").alias("v"))))
    return top.agg(F.to_json(F.map_from_entries(F.transform(listed, lambda e: F.struct(e["v"], -e["m"])))).alias("counts"))
