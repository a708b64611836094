"""Mixing sources to target weights by Pareto order sampling, with DataFrame operations only.

Each source gets a target of words: the weights share ``budget`` times all words, a target stops at ``cap`` times the
words of its source, and what is above goes to the others by weight. Within a source a document is to be taken
``e = min(cap, rate * size ** -1/4)`` times on average, so that long texts are repeated a little less often than short
ones; the rate makes the expected words meet the target. The whole part of ``e`` is certain. For the rest ``p`` the
documents are ranked by the odds of a random number over the odds of ``p`` (Rosén's Pareto sampling) and taken in that
order while the target allows: a sample of fixed size, measured in words. One more document, the one nearest in size to
what is then missing, closes the gap if it is at most twice as large.

The random number is a hash of the id (of the text where the id is null), so reruns agree. Rows that share source, size and
hash are numbered, and each number has a draw of its own. Which row has which number matters only to rows of one id and
size with other texts; these are numbered by their texts. The numbering is counted by partition, so that a group of
copies never meets in one task.

Order statistics of a source are never gathered in one task: ranks are counted in buckets first, and only the bucket
that holds the boundary is sorted. The number of buckets follows the number of rows. Tables by source are broadcast
when they are checked to be small.

Defined cases: a null or empty text has size 0 and is never taken; null sources form one source, last in order; rows
that repeat id and size each have a draw of their own; an empty table gives an empty mix; texts of any length are only
counted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, without

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SMALL = 50_000
OUT = ("size", "source_size", "target", "copies", "taken")


def word_count(text: str = "text"):
    return F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(WORD)), F.lit(0)).cast("long")


def ticket(key: str, text: str):
    """32 hex digits that stand for a row in the draw."""
    return F.md5(F.coalesce(F.col(f"`{key}`").cast("string"), F.col(f"`{text}`"), F.lit("")))


def told_apart(rows: DataFrame, repeated: DataFrame) -> DataFrame:
    """``rows`` with a ticket of its own for each of the rows that share one (``repeated``: their keys), without the columns same and words."""
    alone = rows.join(repeated, "same", "left_anti")
    place, at = "__place", "__at"
    many = cut(rows.join(repeated, "same", "left_semi").withColumn(place, F.spark_partition_id()).withColumn(at, F.monotonically_increasing_id()))
    heap = ["same", "words", place]
    before = Window.partitionBy("same").orderBy("words", place).rowsBetween(Window.unboundedPreceding, -1)
    base = many.groupBy(*heap).agg(F.count(F.lit(1)).alias("n")).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    number = F.row_number().over(Window.partitionBy(*heap).orderBy(at)) - 1 + F.col("base")
    many = many.join(base, heap).withColumn("number", number).withColumn("ticket", F.when(F.col("number") == 0, F.col("ticket")).otherwise(F.md5(F.concat_ws(":", "ticket", "number"))))
    return alone.unionByName(many.select(*alone.columns)).drop("same", "words")


def small(df: DataFrame) -> DataFrame:
    """``df``, broadcast if it is counted to have few rows."""
    return F.broadcast(df) if df.count() <= SMALL else df


def targets(sizes: DataFrame, *, weights: tuple = WEIGHTS, budget: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size, target) from rows of (source, size)."""
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    at = F.row_number().over(order) - 1
    by = by.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (at % len(weights) + 1).cast("int")))
    by = by.withColumn("limit", F.col("source_size") * cap)
    # sources in the order in which a rising level fills them: the level is the least that holds from some source on
    fill = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    after = fill.rowsBetween(0, Window.unboundedFollowing)
    left = F.sum("source_size").over(Window.partitionBy()) * budget - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    by = by.withColumn("level", left / F.sum("weight").over(after))
    good = F.when(F.col("level") * F.col("weight") <= F.col("limit"), F.col("level"))
    level = F.first(good, ignorenulls=True).over(fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return by.select("source", "source_size", F.when(level.isNull(), F.col("limit")).otherwise(F.least("limit", level * F.col("weight"))).alias("target"))


def share(size: str = "size"):
    """Relative inclusion of a document by its size."""
    return F.lit(1.0) / F.sqrt(F.sqrt(F.col(size).cast("double")))


def rates(slim: DataFrame, goal: DataFrame, cap: float) -> DataFrame:
    """(source, source_size, target, rate); rate is null where every document is taken ``cap`` times."""
    by = slim.where("size > 0").groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("source", "s")
    by = by.join(small(goal), F.col("s").eqNullSafe(F.col("source"))).withColumn("w", share()).withColumn("words", F.col("n") * F.col("size"))
    order = Window.partitionBy("source").orderBy("size")
    full = F.coalesce(F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) * cap
    rest = F.sum(F.col("words") * F.col("w")).over(order.rowsBetween(0, Window.unboundedFollowing))
    by = by.withColumn("rate", (F.col("target") - full) / rest)
    found = by.where(F.col("rate") * F.col("w") < cap).groupBy("source").agg(F.min_by("rate", "size").alias("rate")).withColumnRenamed("source", "s")
    return goal.join(found, F.col("s").eqNullSafe(F.col("source")), "left").select("source", "source_size", "target", "rate")


def placed(rows: DataFrame, rate: DataFrame, cap: float, buckets: int) -> DataFrame:
    """Rows with certain copies, the Pareto rank ``q`` (null: not in the draw) and its bucket."""
    e = F.when(F.col("size") > 0, F.when(F.col("rate").isNull(), F.lit(cap)).otherwise(F.least(F.lit(cap), F.col("rate") * share())))
    u = (F.conv(F.substring("ticket", 1, 13), 16, 10).cast("long").cast("double") + 0.5) / float(1 << 52)
    out = rows.join(rate.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    out = out.withColumn("e", F.coalesce(e, F.lit(0.0))).withColumn("certain", F.floor("e").cast("long")).withColumn("p", F.col("e") - F.col("certain"))
    out = out.withColumn("q", F.when(F.col("p") > 0, (u / (1 - u)) / (F.col("p") / (1 - F.col("p")))))
    return out.withColumn("bucket", F.least(F.lit(buckets - 1), F.floor(F.col("q") / (1 + F.col("q")) * buckets)).cast("long"))


def plan(slim: DataFrame, *, weights: tuple = WEIGHTS, budget: float = 1.5, cap: float = 2.0) -> tuple[DataFrame, int]:
    """From rows of (source, size, ticket) to one row of decisions for each source, and the number of buckets."""
    count = slim.count()
    buckets = max(1024, count // 65536)
    goal = cut(targets(slim, weights=weights, budget=budget, cap=cap))
    rate = cut(rates(slim, goal, cap))
    rows = placed(slim, small(rate), cap, buckets)
    sums = rows.groupBy("source").agg(F.sum(F.col("certain") * F.col("size")).alias("sure")).withColumnRenamed("source", "s")
    missing = rate.join(sums, F.col("s").eqNullSafe(F.col("source")), "left").drop("s").withColumn("missing", F.col("target") - F.coalesce("sure", F.lit(0)))
    missing = cut(missing.drop("sure"))
    hist = rows.where("q is not null").groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    hist = hist.withColumn("upto", F.sum("words").over(Window.partitionBy("source").orderBy("bucket"))).withColumnRenamed("source", "s")
    edge = hist.join(small(missing), F.col("s").eqNullSafe(F.col("source"))).where(F.col("upto") > F.col("missing"))
    edge = edge.groupBy("source").agg(F.min_by(F.struct("bucket", (F.col("upto") - F.col("words")).alias("base")), "bucket").alias("b")).select(F.col("source").alias("s"), "b.bucket", "b.base")
    edge = cut(missing.join(edge, F.col("s").eqNullSafe(F.col("source")), "left").select("source", "source_size", "target", "rate", "missing", F.col("bucket").alias("edge"), "base"))
    inside = placed(slim, small(edge.drop("source_size", "target")), cap, buckets).where("bucket = edge")
    inside = inside.withColumn("upto", F.col("base") + F.sum("size").over(Window.partitionBy("source").orderBy("q", "ticket")))
    last = inside.where("upto <= missing").groupBy("source").agg(F.max(F.struct("q", "ticket", "upto")).alias("t")).select(F.col("source").alias("s"), F.col("t.q").alias("last_q"), F.col("t.ticket").alias("last_ticket"), F.col("t.upto").alias("reached"))
    decided = edge.join(last, F.col("s").eqNullSafe(F.col("source")), "left").drop("s")
    decided = cut(decided.withColumn("gap", F.when(F.col("edge").isNotNull(), F.col("missing") - F.coalesce("reached", "base"))))
    free = chosen(placed(slim, small(decided.drop("source_size", "target")), cap, buckets)).where(~F.col("drawn") & F.col("q").isNotNull() & (F.col("size") <= 2 * F.col("gap")))
    order = F.struct(F.abs(F.col("size") - F.col("gap")), F.col("q"), F.col("ticket"))
    extra = free.groupBy("source").agg(F.min_by(F.struct("ticket", "size"), order).alias("x")).select(F.col("source").alias("s"), F.col("x.ticket").alias("extra"), F.col("x.size").alias("extra_size"))
    decided = decided.join(extra, F.col("s").eqNullSafe(F.col("source")), "left").drop("s")
    return cut(decided), buckets


def chosen(rows: DataFrame) -> DataFrame:
    """Adds ``drawn``: the row's rank lies before the boundary of its source."""
    within = (F.col("bucket") < F.col("edge")) | ((F.col("bucket") == F.col("edge")) & F.coalesce(F.struct("q", "ticket") <= F.struct(F.col("last_q").alias("q"), F.col("last_ticket").alias("ticket")), F.lit(False)) & F.col("last_q").isNotNull())
    return rows.withColumn("drawn", F.col("q").isNotNull() & F.when(F.col("edge").isNull(), F.lit(True)).otherwise(F.coalesce(within, F.lit(False))))


def mix(docs: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple = WEIGHTS, budget: float = 1.5, cap: float = 2.0, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with size, source_size, target (double), copies and taken (words)."""
    docs = without(docs, *OUT)
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in OUT]
    hidden = {c: f"__c{i}" for i, c in enumerate(kept)}
    own = [F.col(f"`{source}`").alias("source"), word_count(text).alias("size"), ticket(key, text).alias("ticket"), F.xxhash64(f"`{text}`").alias("words")]
    same = F.concat_ws("|", "ticket", "size", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))).alias("same")
    slim = cut(docs.select(*own, *([F.col(f"`{c}`").alias(h) for c, h in hidden.items()] if keep is not None else [])).select("*", same))
    repeated = cut(slim.groupBy("same").count().where("count > 1").select("same"))
    some = repeated.count() > 0
    slim = cut(told_apart(slim, repeated)) if some else slim
    decided, buckets = plan(slim.select("source", "size", "ticket"), weights=weights, budget=budget, cap=cap)
    # with few columns the cut rows serve again; whole documents are read a second time instead of being copied
    rows = slim
    if keep is None:
        rows = docs.select(*own, *[F.col(f"`{c}`").alias(h) for c, h in hidden.items()]).select("*", same)
        rows = told_apart(rows, repeated) if some else rows
    rows = chosen(placed(rows, small(decided), cap, buckets))
    more = F.coalesce((F.col("ticket") == F.col("extra")) & (F.col("size") == F.col("extra_size")) & F.col("q").isNotNull() & ~F.col("drawn"), F.lit(False))
    rows = rows.withColumn("copies", F.col("certain") + F.col("drawn").cast("long") + more.cast("long"))
    return rows.select(*[F.col(h).alias(c) for c, h in hidden.items()], "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


#: DuckDB SQL for doc_id, size, source_size, target and taken.
ORACLE = r"""
with d0 as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size, md5(coalesce(cast(doc_id as varchar), text, '')) as t0 from documents),
d1 as (select *, row_number() over (partition by source, size, t0) - 1 as number from d0), d as (select doc_id, source, size, case when number = 0 then t0 else md5(t0 || ':' || number) end as ticket from d1),
s as (select source, sum(size)::bigint as source_size, [5.0::double, 2.0::double, 1.0::double][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] as weight from d group by source),
f as (select *, ((select sum(source_size) from s) * 1.5::double - coalesce(sum(source_size * 2.0::double) over (o rows between unbounded preceding and 1 preceding), 0)) / sum(weight) over (o rows between current row and unbounded following) as level from s window o as (order by source_size * 2.0::double / weight, source nulls last)),
lv as (select arg_min(level, source_size * 2.0::double / weight) as level from f where level * weight <= source_size * 2.0::double),
t as (select source, source_size, case when level is null then source_size * 2.0::double else least(source_size * 2.0::double, level * weight) end as target from s, lv),
z as (select source, size, count(*) as n, 1.0::double / sqrt(sqrt(size::double)) as w from d where size > 0 group by source, size),
r0 as (select z.source, z.size, w, (target - coalesce(sum(n * z.size) over (o rows between unbounded preceding and 1 preceding), 0)::double * 2.0::double) / sum((n * z.size)::double * w) over (o rows between current row and unbounded following) as rate from z join t on z.source is not distinct from t.source window o as (partition by z.source order by z.size)),
r as (select source, arg_min(rate, size) as rate from r0 where rate * w < 2 group by source),
p0 as (select d.*, source_size, target, case when size = 0 then 0 when rate is null then 2.0::double else least(2.0::double, rate * (1.0::double / sqrt(sqrt(size::double)))) end as e, (('0x' || substr(ticket, 1, 13))::bigint::double + 0.5) / 4503599627370496.0::double as u from d join t on d.source is not distinct from t.source left join r on d.source is not distinct from r.source),
p as (select *, floor(e)::bigint as certain, case when e > floor(e) then (u / (1 - u)) / ((e - floor(e)) / (1 - (e - floor(e)))) end as q from p0),
m as (select source, any_value(target) - sum(certain * size)::double as missing from p group by source),
c as (select p.*, missing, sum(size) over (partition by p.source order by q, ticket)::double as upto, sum(size) over (partition by p.source)::double as every from p join m on p.source is not distinct from m.source where q is not null),
g as (select source, any_value(missing) - coalesce(max(upto) filter (where upto <= missing), 0) as gap, any_value(every) > any_value(missing) as open from c group by source),
x as (select c.source, arg_min({'ticket': ticket, 'size': size}, {'a': abs(size - gap), 'q': q, 't': ticket}) as x from c join g on c.source is not distinct from g.source where open and upto > missing and size <= 2 * gap group by c.source)
select p.doc_id, p.size, p.source_size, p.target, (p.size * (certain + case when q is not null and c2.upto <= c2.missing then 1 else 0 end + case when q is not null and c2.upto > c2.missing and x.x.ticket = p.ticket and x.x.size = p.size then 1 else 0 end))::bigint as taken
from p left join (select distinct source, ticket, size, upto, missing from c) c2 on p.source is not distinct from c2.source and p.ticket = c2.ticket and p.size = c2.size
left join x on p.source is not distinct from x.source
"""
