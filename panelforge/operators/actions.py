"""Corporate actions of a dense panel (security, session, place t): normal form, cumulative indices with terminal and
unresolved events, interval returns, adjusted prices.

Events are folded along a security by windows over its sessions: running products and sums for shares and cash, a
running flag that an unresolved event sets for good, and the first event after a row by a minimum over the frame that
the interval covers. A security's rows are one partition; a day's rows never meet in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.columns import PRECEDING, div

from .generation import require

#: Kinds of events, and what a kind's event can be found to be.
TYPES = ("split", "cash_dividend", "cash_merger", "delisting")
STATUS = ("valid", "unresolved_terminal_value", "invalid_split_ratio", "duplicate_action_sequence", "unknown_action_type")
ALIASES = {"cash_amount": "cash_dividend_per_share", "cash_out_value": "terminal_cash_per_share"}
NUMBERS = ("split_ratio", "cash_dividend_per_share", "terminal_cash_per_share", "reference_price_before_delisting", "delisting_return_from_reference")


def W():
    return Window.partitionBy("security").orderBy("t")


def finite(c: str) -> Column:
    x = F.col(c)
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def canonical(actions: DataFrame, until: str) -> DataFrame:
    """Every event up to ``until`` with all columns, other names of them included, and its ``status``."""
    for old, new in ALIASES.items():
        actions = actions.withColumnRenamed(old, new) if new not in actions.columns else actions
    have = set(actions.columns)
    known = F.col("known_at_ts").cast("timestamp") if "known_at_ts" in have else F.lit(None).cast("timestamp")
    sequence = F.coalesce(F.expr("try_cast(action_sequence as int)"), F.lit(0)) if "action_sequence" in have else F.lit(0)
    out = actions.select(
        F.col("security"), F.col("session").cast("string").alias("session"), sequence.alias("action_sequence"), F.col("action_type"),
        *[F.expr(f"try_cast({c} as double)").alias(c) if c in have else F.lit(None).cast("double").alias(c) for c in NUMBERS], known.alias("known_at_ts"),
    )
    out = out.where(F.col("session") <= until)
    twice = F.count(F.lit(1)).over(Window.partitionBy("security", "session", "action_sequence")) > 1
    cash = F.coalesce(finite("terminal_cash_per_share"), finite("reference_price_before_delisting") * (1 + finite("delisting_return_from_reference")))
    kind = F.col("action_type")
    out = out.withColumn("cash", F.when(kind == "cash_dividend", finite("cash_dividend_per_share")).when(kind.isin("cash_merger", "delisting"), cash))
    status = F.when(twice, STATUS[3]).when(kind.isNotNull() & ~kind.isin(*TYPES), STATUS[4]).when((kind == "split") & ~F.coalesce(F.col("split_ratio") > 0, F.lit(False)), STATUS[2])
    return out.withColumn("status", status.when(kind.isin("cash_merger", "delisting") & F.col("cash").isNull(), STATUS[1]).otherwise(STATUS[0]))


def normalised(actions: DataFrame, until: str) -> DataFrame:
    """``canonical`` events; repeated sequences, unknown kinds and bad split ratios raise, which reads the events once."""
    found = canonical(actions, until)
    require(found.agg(*[F.count_if(F.col("status") == s).alias(s) for s in STATUS[2:]]), *STATUS[2:])
    return found


def index(panel: DataFrame, events: DataFrame) -> DataFrame:
    """``panel`` with split_index A (shares that one share became), dividend_index C (sum of A times cash), terminal_cash,
    unresolved (a terminal event without a value in this session) and action_valid (no unresolved event so far).

    Events on sessions or of securities that the panel does not have change nothing. Of several terminal values in a
    session the last of the sequence counts."""
    kind = F.col("action_type")
    terminal = kind.isin("cash_merger", "delisting")
    day = events.groupBy("security", "session").agg(
        F.product(F.when(kind == "split", F.col("split_ratio"))).alias("day_split"),
        F.sum(F.when(kind == "cash_dividend", F.col("cash"))).alias("day_cash"),
        F.max_by(F.when(terminal, F.col("cash")), F.when(terminal & F.col("cash").isNotNull(), F.col("action_sequence"))).alias("terminal_cash"),
        F.max((terminal & F.col("cash").isNull()).cast("int")).alias("unresolved"),
        F.max(((terminal | (kind == "cash_dividend")) & F.col("cash").isNull()).cast("int")).alias("broken"),
    )
    run = W().rowsBetween(PRECEDING, 0)
    x = panel.join(day, ["security", "session"], "left")
    x = x.withColumn("split_index", F.product(F.coalesce("day_split", F.lit(1.0))).over(run))
    x = x.withColumn("dividend_index", F.sum(F.col("split_index") * F.coalesce("day_cash", F.lit(0.0))).over(run))
    x = x.withColumn("action_valid", F.coalesce(F.max("broken").over(run), F.lit(0)) == 0).withColumn("unresolved", F.coalesce("unresolved", F.lit(0)) == 1)
    return x.drop("day_split", "day_cash", "broken")


def interval(indexed: DataFrame, entry: str, exit_: str, back: int, ahead: int, prefix: str = "") -> DataFrame:
    """Adds total_return, price_return and unresolved_interval from ``back`` sessions before a row to ``ahead`` after it.

    ``entry`` and ``exit_`` are columns of the row. Shares held grow by splits and earn dividends; the first terminal event
    after the entry replaces the exit by its cash. An event without a value makes the interval unresolved, as does one
    before it; an interval that leaves the panel has no value and is not unresolved."""
    w = W()
    at = lambda c, k: F.lag(c, -k).over(w) if k < 0 else F.lead(c, k).over(w) if k else F.col(c)
    frame = w.rowsBetween(1 - back, ahead)
    value = F.col("terminal_cash").isNotNull()
    first = F.min(F.when(value, F.struct("t", "terminal_cash", "split_index", "dividend_index"))).over(frame)
    missing = F.min(F.when(F.col("unresolved"), F.col("t"))).over(frame)
    x = indexed
    for name, col in (("ae", at("split_index", -back)), ("ce", at("dividend_index", -back)), ("ve", at("action_valid", -back)), ("ax", at("split_index", ahead)), ("cx", at("dividend_index", ahead)), ("vx", at("action_valid", ahead)), ("ev", first), ("un", missing)):
        x = x.withColumn(f"__{name}", col)
    inside = F.col("__ae").isNotNull() & F.col("__ax").isNotNull()
    sound = F.col("__ve") & F.col("__vx")
    e = F.when(F.col(entry) > 0, F.col(entry))
    lost = F.col("__un").isNotNull() & (F.col("__ev").isNull() | (F.col("__un") <= F.col("__ev.t")))
    cash = (F.col("__ev.terminal_cash") * F.col("__ev.split_index") + F.col("__ev.dividend_index") - F.col("__ce")) / F.col("__ae")
    price = F.when(F.col(exit_) > 0, F.col("__ax") / F.col("__ae") * F.col(exit_))
    ok = inside & sound & ~lost
    total = F.when(ok, div(F.when(F.col("__ev").isNotNull(), cash).otherwise(price + (F.col("__cx") - F.col("__ce")) / F.col("__ae")), e) - 1)
    plain = F.when(ok & F.col("__ev").isNull(), div(price, e) - 1)
    unresolved = F.coalesce(inside & (~sound | (lost & e.isNotNull())), F.lit(False))
    x = x.withColumn(f"{prefix}total_return", total).withColumn(f"{prefix}price_return", plain).withColumn(f"{prefix}unresolved_interval", unresolved)
    return x.drop(*[c for c in x.columns if c.startswith("__")])


def forward(indexed: DataFrame, k: int) -> DataFrame:
    """Returns from a session's close to the close k sessions on."""
    return interval(indexed.withColumn("exit_price", F.lead("c", k).over(W())), "c", "exit_price", 0, k)


def adjusted(indexed: DataFrame) -> DataFrame:
    """Prices and volume in shares of the security's last session, daily and overnight total returns, the regular
    session's return, and an index of daily total returns that starts at 1 and ends for good at the first gap."""
    w = W()
    last = F.last("split_index").over(w.rowsBetween(PRECEDING, Window.unboundedFollowing))
    x = indexed.withColumn("adjustment", F.col("split_index") / last).withColumn("prior_close", F.lag("c").over(w))
    x = interval(x, "prior_close", "c", 1, 0, "daily_")
    x = interval(x, "prior_close", "o", 1, 0, "overnight_")
    first = F.min("t").over(w.rowsBetween(PRECEDING, Window.unboundedFollowing))
    step = F.when(F.col("t") == first, F.lit(1.0)).otherwise(1 + F.col("daily_total_return"))
    x = x.withColumn("step", step)
    run = w.rowsBetween(PRECEDING, 0)
    whole = F.count("step").over(run) == F.count(F.lit(1)).over(run)
    x = x.withColumn("total_return_index", F.when(whole, F.product(F.coalesce("step", F.lit(1.0))).over(run)))
    regular = div(F.col("c"), F.when(F.col("o") > 0, F.col("o"))) - 1
    return x.select(
        "security", "session", "t", *[(F.col(c) * F.col("adjustment")).alias(f"split_adjusted_{n}") for c, n in (("o", "open"), ("h", "high"), ("l", "low"), ("c", "close"))],
        F.when(F.col("adjustment") > 0, F.col("v") / F.col("adjustment")).alias("split_adjusted_volume"), "daily_total_return", "total_return_index", "overnight_total_return", regular.alias("regular_session_return"),
    )
