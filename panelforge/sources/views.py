"""Derived panels over event and order tables, and their readers and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(events: DataFrame) -> DataFrame:
    """Two-hour bars: symbol, session, slot (0 to 11), open, high, low, close, volume, vwap."""
    price, at = F.lit(100.0) + F.col("value"), F.struct("ts", "event_id")
    keyed = events.select(F.concat(F.lit("S"), (F.col("user_id") % 10).cast("string")).alias("symbol"), F.to_date("ts").cast("string").alias("session"), F.floor(F.hour("ts") / 2).cast("int").alias("slot"), price.alias("price"), at.alias("at"))
    return keyed.groupBy("symbol", "session", "slot").agg(F.min_by("price", "at").alias("o"), F.max("price").alias("h"), F.min("price").alias("l"), F.max_by("price", "at").alias("c"), F.count(F.lit(1)).alias("v"), F.avg("price").alias("vwap"))


BARS_SQL = """bars as (select 'S' || cast(user_id % 10 as varchar) as symbol, cast(cast(ts as date) as varchar) as session, cast(floor(hour(ts) / 2) as integer) as slot,
 arg_min(100.0::double + value, {'a': ts, 'b': event_id}) as o, max(100.0::double + value) as h, min(100.0::double + value) as l, arg_max(100.0::double + value, {'a': ts, 'b': event_id}) as c, count(*) as v, avg(100.0::double + value) as vwap from events group by 1, 2, 3)"""


def daily(lineitem: DataFrame) -> DataFrame:
    """Monthly panel of suppliers: security, session (yyyy-mm), open, high, low, close, volume, dollars, vwap, n."""
    price = F.col("l_extendedprice") / F.col("l_quantity")
    at = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")
    keyed = lineitem.select(F.col("l_suppkey").alias("security"), F.date_format("l_shipdate", "yyyy-MM").alias("session"), price.alias("price"), F.col("l_quantity").alias("q"), at.alias("at"))
    return keyed.groupBy("security", "session").agg(F.min_by("price", "at").alias("o"), F.max("price").alias("h"), F.min("price").alias("l"), F.max_by("price", "at").alias("c"), F.sum("q").alias("v"), F.sum(F.col("price") * F.col("q")).alias("dollars"), F.count(F.lit(1)).alias("n"))


_AT = "{'a': l_shipdate, 'b': l_orderkey, 'c': l_linenumber, 'd': l_partkey, 'e': l_extendedprice, 'f': l_quantity}"
DAILY_SQL = f"""daily0 as (select l_suppkey as security, strftime(l_shipdate, '%Y-%m') as session, arg_min(l_extendedprice / l_quantity, {_AT}) as o, max(l_extendedprice / l_quantity) as h, min(l_extendedprice / l_quantity) as l,
 arg_max(l_extendedprice / l_quantity, {_AT}) as c, sum(l_quantity) as v, sum(l_extendedprice / l_quantity * l_quantity) as dollars, count(*) as n from lineitem group by 1, 2)"""


def densify(panel: DataFrame, entity: str = "security", session: str = "session") -> DataFrame:
    """One row for every entity and every session that any entity has, with the session's place; absent values null.

    Both key sets are aggregates; the sessions (a calendar) are counted and broadcast only when few."""
    calendar = panel.select(session).distinct().withColumn("t", F.row_number().over(Window.orderBy(session)))
    calendar = F.broadcast(calendar) if calendar.count() <= 50_000 else calendar
    return panel.select(entity).distinct().crossJoin(calendar).join(panel, [entity, session], "left")


DENSE_SQL = """cal as (select session, row_number() over (order by session) as t from (select distinct session from daily0)), daily as (select s.security, k.session, k.t, d.o, d.h, d.l, d.c, d.v, d.dollars, d.n from (select distinct security from daily0) s cross join cal k left join daily0 d on d.security = s.security and d.session = k.session)"""


def sectors(supplier: DataFrame, nation: DataFrame) -> DataFrame:
    return supplier.join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("security"), F.col("n_regionkey").alias("sector"))


SECTORS_SQL = "sectors as (select s_suppkey as security, n_regionkey as sector from supplier join nation on s_nationkey = n_nationkey)"


def latest(rows: DataFrame, keys: list[str], newest: list[str]) -> DataFrame:
    """Of rows with equal keys the one that is last in a total order."""
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in newest]))
    return rows.withColumn("__r", last).where("__r = 1").drop("__r")


def write_sorted(df: DataFrame, path: str, by: list[str], files: int = 8) -> None:
    """ZSTD Parquet in key order; the committer makes it visible only when whole."""
    df.repartitionByRange(files, *by).sortWithinPartitions(*by).write.mode("overwrite").option("compression", "zstd").parquet(path)


def read_journal(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; a truncated last line is left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def missing_pairs(wanted: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What a resumed run still has to do."""
    return wanted.join(done.select(*keys).distinct(), keys, "left_anti")
