"""First quote at or after a time, and replays of orders on quotes, for symbols of any activity.

Requests and quotes meet in one sorted stream, cut into buckets of time: within a bucket a window looks ahead for the
next quote; where a bucket has none left, the first quote of the next bucket that has any stands in, found in a table of
one row a bucket. So a busy symbol is dealt over as many tasks as it has buckets, and no request meets quotes pair by
pair. A search that depends on the order (a price to be crossed) joins by bucket, over the one or two its span reaches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.columns import div


def usable(quotes: DataFrame, most_bps: float) -> DataFrame:
    """Quotes with a positive bid below the ask and a spread of at most ``most_bps`` of their middle."""
    spread = div((F.col("ask") - F.col("bid")) * 2e4, F.col("ask") + F.col("bid"))
    return quotes.where((F.col("bid") > 0) & (F.col("ask") > F.col("bid")) & (spread <= most_bps))


def next_quote(requests: DataFrame, quotes: DataFrame, by: list[str], at: Column, within: float, width: float, prefix: str) -> DataFrame:
    """``requests`` with ``prefix``_at, _bid and _ask of the first quote (at, bid, ask) of the same ``by`` at or after ``at``,
    at most ``within`` later. Of quotes at one time the lowest bid, then ask, comes first. ``width``: time of a bucket."""
    seen, stay = f"__{prefix}", requests.columns
    bucket = lambda t: F.floor(t / width).cast("long")
    q = quotes.select(*by, F.col("at").alias("__t"), F.struct("at", "bid", "ask").alias(seen)).withColumn("__kind", F.lit(1))
    r = requests.select("*", at.alias("__t")).withColumn("__kind", F.lit(0))
    both = r.unionByName(q, allowMissingColumns=True).withColumn("__bucket", bucket(F.col("__t")))
    cell = Window.partitionBy(*by, "__bucket").orderBy("__t", "__kind", seen)
    both = both.withColumn("__in", F.first(seen, ignorenulls=True).over(cell.rowsBetween(0, Window.unboundedFollowing)))
    heads = q.groupBy(*by, bucket(F.col("__t")).alias("__bucket")).agg(F.min(seen).alias("__head"))
    asked = r.select(*by, bucket(F.col("__t")).alias("__bucket")).distinct()
    later = Window.partitionBy(*by).orderBy("__bucket").rowsBetween(1, Window.unboundedFollowing)
    carried = asked.join(heads, [*by, "__bucket"], "full").withColumn("__next", F.first("__head", ignorenulls=True).over(later)).select(*by, "__bucket", "__next")
    out = both.where("__kind = 0").join(carried, [*by, "__bucket"], "left")
    found = F.coalesce("__in", "__next")
    found = F.when(found["at"] <= F.col("__t") + within, found)
    return out.select(*stay, *[found[c].alias(f"{prefix}_{c}") for c in ("at", "bid", "ask")])


def first_crossing(orders: DataFrame, quotes: DataFrame, by: list[str], width: float) -> DataFrame:
    """(order_id, filled_at): the first quote from ``entry_at`` to ``path_end`` whose other side reaches ``limit``."""
    bucket = lambda t: F.floor(t / width).cast("long")
    span = orders.where("entry_at is not null").withColumn("__bucket", F.explode(F.sequence(bucket(F.col("entry_at")), bucket(F.col("path_end")))))
    met = span.select("order_id", *by, "side", "limit", "entry_at", "path_end", "__bucket").join(quotes.withColumn("__bucket", bucket(F.col("at"))), [*by, "__bucket"])
    hit = (F.col("at") >= F.col("entry_at")) & (F.col("at") <= F.col("path_end")) & F.when(F.col("side") == 1, F.col("ask") <= F.col("limit")).otherwise(F.col("bid") >= F.col("limit"))
    return met.where(hit).groupBy("order_id").agg(F.min("at").alias("filled_at"))


def replay(orders: DataFrame, quotes: DataFrame, *, by: list[str], path: float, delay: float = 0, passive: bool = False, most_bps: float = 25.0, width: float = 64.0) -> DataFrame:
    """What became of every order (order_id, ``by``, bucket, side, entry, exit): its status and gross return.

    ``missing_path``: no usable quote from the entry's or the exit's time for ``path`` on; ``missing_quote``: none after
    ``delay`` either; ``unfilled``: a passive order's price is not reached on its path; ``cancelled_unpaired``: of the filled
    orders of a bucket the longer side loses its last by symbol, so both sides are equal; else ``filled``."""
    q = usable(quotes, most_bps)
    o = orders
    for side in ("entry", "exit"):
        o = next_quote(o, q, by, F.col(side), path, width, f"{side}_path")
        o = next_quote(o, q, by, F.col(side) + delay, path - delay, width, side)
    o = o.withColumn("path_end", F.col("entry") + path)
    own, other = F.when(F.col("side") == 1, F.col("entry_bid")).otherwise(F.col("entry_ask")), F.when(F.col("side") == 1, F.col("entry_ask")).otherwise(F.col("entry_bid"))
    o = o.withColumn("limit", own)
    o = o.join(first_crossing(o, q, by, width), "order_id", "left") if passive else o.withColumn("filled_at", F.col("entry_at"))
    price = F.col("limit") if passive else other
    leave = F.when(F.col("side") == 1, F.col("exit_bid")).otherwise(F.col("exit_ask"))
    status = F.when(F.col("entry_path_at").isNull() | F.col("exit_path_at").isNull(), "missing_path").when(F.col("entry_at").isNull() | F.col("exit_at").isNull(), "missing_quote").when(F.col("filled_at").isNull(), "unfilled").otherwise("filled")
    o = o.withColumn("status", status).withColumn("gross_return", F.when(F.col("status") == "filled", F.col("side") * (div(leave, price) - 1)))
    filled = F.col("status") == "filled"
    side = Window.partitionBy("bucket", "side", "status").orderBy(*by, "order_id")
    count = lambda s: F.count(F.when(filled & (F.col("side") == s), 1)).over(Window.partitionBy("bucket"))
    o = o.withColumn("__r", F.row_number().over(side)).withColumn("__keep", F.least(count(1), count(-1)))
    lost = filled & (F.col("__r") > F.col("__keep"))
    return o.select("order_id", *by, "bucket", "side", "filled_at", F.when(lost, "cancelled_unpaired").otherwise(F.col("status")).alias("status"), F.when(~lost, F.col("gross_return")).alias("gross_return"))
