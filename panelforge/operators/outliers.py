"""What a pair's relation owes to extreme values, days, symbols or rows: ten variants of its rows and their statistics.

Edges of the variants are exact order statistics (``order``), the boundary of the largest targets too, so no task sorts
a pair. Rows carry a mark of the variants that keep them and are unpivoted once; all statistics follow from aggregates by
pair and variant."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.columns import div, qcut_bin
from panelforge.operators import order
from panelforge.operators.screening import PAIR, TIES, bin_means, hac, one_way, spread_of
from panelforge.sources.shared import cut

X_SHARES, Y_SHARES = (0.01, 0.99), (0.001, 0.005, 0.01, 0.99, 0.995, 0.999)


def directions(pairs: DataFrame) -> DataFrame:
    """(PAIR, sign): 1 where the last decile's mean target is not below the first's, else -1."""
    return spread_of(bin_means(pairs)).select(*PAIR, F.when(F.col("spread") < 0, -1.0).otherwise(1.0).alias("sign"))


def best_days(pairs: DataFrame, signs: DataFrame) -> DataFrame:
    """(PAIR, session, day): places of the sessions by their own signed spread; a session needs 20 rows."""
    part = Window.partitionBy(*PAIR, "session")
    rows = pairs.withColumn("n", F.count(F.lit(1)).over(part)).withColumn("r", F.row_number().over(part.orderBy("x", *TIES))).withColumn("bin", qcut_bin(F.col("r"), F.col("n"), 10))
    mean = lambda b: F.avg(F.when(F.col("bin") == b, F.col("y")))
    days = rows.where("n >= 20").groupBy(*PAIR, "session").agg((mean(9) - mean(0)).alias("spread")).join(signs, PAIR)
    place = F.row_number().over(Window.partitionBy(*PAIR).orderBy((F.col("spread") * F.col("sign")).desc(), "session"))
    return days.where("spread is not null").select(*PAIR, "session", place.alias("day"))


def best_symbols(pairs: DataFrame, signs: DataFrame) -> DataFrame:
    """(PAIR, symbol): the symbol of the greatest own signed spread; a symbol's rows may be many, so its bins are counted."""
    by = [*PAIR, "symbol"]
    t = order.bins(pairs, by, "x", TIES, order.qcut_last(10)).groupBy(*by, "bin").agg(F.avg("y").alias("m"), F.count(F.lit(1)).alias("n"))
    mean = lambda b: F.max(F.when(F.col("bin") == b, F.col("m")))
    own = t.groupBy(*by).agg((mean(9) - mean(0)).alias("spread"), F.sum("n").alias("n")).where("n >= 20 and spread is not null").join(signs, PAIR)
    place = F.row_number().over(Window.partitionBy(*PAIR).orderBy((F.col("spread") * F.col("sign")).desc(), "symbol"))
    return own.withColumn("place", place).where("place = 1").select(*by, F.lit(True).alias("best_symbol"))


def variant_rows(pairs: DataFrame, signs: DataFrame | None = None, names: tuple = ()) -> DataFrame:
    """Rows of all variants (or of ``names``) with their values, and ``variant``; "all" is the pair as it is."""
    wanted = lambda *some: not names or set(some) & set(names)
    rows = pairs
    ex = order.quantiles(pairs, PAIR, "x", list(X_SHARES)).select(*PAIR, F.col("quantiles").alias("ex"))
    ey = order.quantiles(pairs, PAIR, "y", list(Y_SHARES)).select(*PAIR, F.col("quantiles").alias("ey"))
    last = order.at_ranks(pairs.withColumn("size", -F.abs("y")), PAIR, "size", TIES, lambda n: F.array(F.least(n, F.lit(10)).cast("long"))).select(*PAIR, F.col("at").alias("tenth"))
    rows = rows.join(ex.join(ey, PAIR).join(last, PAIR), PAIR)
    if wanted("drop_best_day", "drop_best_5_days"):
        rows = rows.join(best_days(pairs, signs), [*PAIR, "session"], "left")
    if wanted("drop_best_symbol"):
        rows = rows.join(best_symbols(pairs, signs), [*PAIR, "symbol"], "left")
    x, y = F.col("x"), F.col("y")
    clip = lambda c, e, lo, hi: F.greatest(F.least(c, F.get(e, F.lit(hi))), F.get(e, F.lit(lo)))
    within = lambda lo, hi: (y >= F.get("ey", F.lit(lo))) & (y <= F.get("ey", F.lit(hi)))
    wx, wy = clip(x, "ex", 0, 1), clip(y, "ey", 2, 3)
    kinds = {
        "all": (x, y, F.lit(True)), "winsor_x": (wx, y, F.lit(True)), "winsor_y": (x, wy, F.lit(True)), "winsor_both": (wx, wy, F.lit(True)),
        "trim_01pct": (x, y, within(0, 5)), "trim_05pct": (x, y, within(1, 4)), "trim_1pct": (x, y, within(2, 3)),
        "drop_top_10": (x, y, F.struct((-F.abs(y)).alias("x"), *TIES) > F.col("tenth")),
    }
    if wanted("drop_best_day", "drop_best_5_days"):
        kinds |= {f"drop_best_{n}": (x, y, F.coalesce(F.col("day") > k, F.lit(True))) for n, k in (("day", 1), ("5_days", 5))}
    if wanted("drop_best_symbol"):
        kinds["drop_best_symbol"] = (x, y, F.col("best_symbol").isNull())
    made = F.array(*[F.when(ok, F.struct(F.lit(k).alias("variant"), a.alias("x"), b.alias("y"))) for k, (a, b, ok) in kinds.items() if wanted(k)])
    return rows.select(*PAIR, *TIES, F.explode(made).alias("v")).where("v is not null").select(*PAIR, *TIES, "v.*")


SIMPLE = ("all", "winsor_x", "winsor_y", "winsor_both", "trim_1pct", "drop_top_10")


def slopes(pairs: DataFrame) -> DataFrame:
    """Rows and slope of the variants that need no direction."""
    return variant_rows(pairs, names=SIMPLE).groupBy(*PAIR, "variant").agg(F.count(F.lit(1)).alias("n"), F.regr_slope("y", "x").alias("slope"))


def sensitivity(pairs: DataFrame) -> DataFrame:
    """One row a pair and variant: rows, rank correlation, decile spread, session-clustered t, and the spread's interval from
    the daily spreads' HAC error, all along the pair's direction. A variant of fewer than ten rows has none."""
    signs = cut(directions(pairs))
    own = F.concat_ws("|", "feature", "variant")  # a variant of a pair is a pair of its own to the screens' operators
    rows = cut(variant_rows(pairs, signs).withColumn("feature", own).drop("variant"))
    binned = order.bins(rows, PAIR, "x", TIES, order.qcut_last(10))
    cells = cut(binned.where("bin in (0, 9)").groupBy(*PAIR, "session", "bin").agg(F.sum("y").alias("y"), F.count(F.lit(1)).alias("n")))
    mean = lambda b: div(F.sum(F.when(F.col("bin") == b, F.col("y"))), F.sum(F.when(F.col("bin") == b, F.col("n"))))
    spread = cells.groupBy(*PAIR).agg((mean(9) - mean(0)).alias("spread"))
    daily = cells.groupBy(*PAIR, "session").agg((mean(9) - mean(0)).alias("d")).where("d is not null")
    errors = hac(daily, PAIR, "session", "d").select(*PAIR, F.when(F.col("n") >= 3, F.col("se")).alias("se"))
    ranked = order.average_ranks(order.average_ranks(rows, PAIR, "x", "rx"), PAIR, "y", "ry")
    rho = ranked.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("n"), div(F.covar_pop("rx", "ry"), F.sqrt(F.var_pop("rx") * F.var_pop("ry"))).alias("spearman"))
    out = rho.join(spread, PAIR, "left").join(errors, PAIR, "left").join(one_way(rows).select(*PAIR, "t"), PAIR, "left")
    parts = F.split("feature", "\\|")
    out = out.select(F.element_at(parts, 1).alias("feature"), "target", F.element_at(parts, 2).alias("variant"), "n", "spearman", "spread", "t", "se").join(signs, PAIR)
    held = lambda c: F.when(F.col("n") >= 10, F.col("sign") * F.col(c))
    out = out.select(*PAIR, "variant", "n", *[held(c).alias(c) for c in ("spearman", "spread", "t")], (1.96 * F.col("se")).alias("half"))
    return out.withColumn("low", F.col("spread") - F.col("half")).withColumn("high", F.col("spread") + F.col("half")).drop("half")


def worst(found: DataFrame) -> DataFrame:
    """(PAIR, worst_spread, change): the least signed spread of the ten variants, and the largest departure from the pair's."""
    ten = F.when(F.col("variant") != "all", F.col("spread"))
    base = F.max(F.when(F.col("variant") == "all", F.col("spread")))
    out = found.groupBy(*PAIR).agg(base.alias("base"), F.min(ten).alias("worst_spread"), F.max(ten).alias("best_spread"))
    return out.select(*PAIR, "worst_spread", F.greatest(F.abs(F.col("base") - F.col("worst_spread")), F.abs(F.col("base") - F.col("best_spread"))).alias("change"))
