"""From screen rows to generated features: parents, the plan of operators over their pairs, and rates by several groupings.

Everything here works on screen rows, one a feature and target, or on features: few rows, declared as windows over them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.columns import pct_rank

from .screening import PAIR, bh

HORIZONS = ((15, "very_short"), (45, "short"), (120, "medium"))


def horizon_family(minutes: Column) -> Column:
    """Name of the span that a target's horizon in minutes falls into; null counts as the longest."""
    out = F.lit("long_intraday")
    for last, name in reversed(HORIZONS):
        out = F.when(minutes <= last, name).otherwise(out)
    return out


def rates(rows: DataFrame, p: str, groupings: dict[str, list[str]]) -> DataFrame:
    """A false-discovery rate for each grouping; values that are no probability take no part and get none."""
    rows = rows.withColumn("__p", F.when(F.col(p).between(0, 1), F.col(p))).withColumn("__all", F.lit(1))
    for out, by in groupings.items():
        rows = bh(rows, "__p", by or ["__all"], out)
    return rows.drop("__p", "__all")


# Limits of parents, and below the weights of their score, the edges of planned features and the caps of the queue.
@dataclass(frozen=True)
class ParentRules:
    """What a parent must show, and how many there may be."""

    rows: int = 250_000
    sessions: int = 750
    symbols: int = 75
    decisions: int = 10_000
    fdr: float = 0.05
    bps: float = 0.5
    fill_family: int = 2
    fill_horizon: int = 5
    per_family: int = 12
    per_redundancy: int = 3
    total: int = 100


def summaries(rows: DataFrame, rules: ParentRules) -> DataFrame:
    """One row a feature, over its targets with enough coverage: best rate, effect and score, horizons, whether a target
    passes rate and effect, and the sign of the largest effect (of the passing ones, if any): 0 where equal ones disagree."""
    covered = rows.where((F.col("n") >= rules.rows) & (F.col("n_sessions") >= rules.sessions) & (F.col("n_symbols") >= rules.symbols) & (F.col("n_decisions") >= rules.decisions) & F.col("fdr").isNotNull() & F.col("effect").isNotNull())
    size = F.abs("effect")
    passes = (F.col("fdr") <= rules.fdr) & (size >= rules.bps / 1e4)
    w = Window.partitionBy("feature")
    marked = covered.withColumn("passes", passes).withColumn("any", F.max(passes.cast("int")).over(w) == 1)
    marked = marked.withColumn("asked", F.when(F.col("passes") | ~F.col("any"), size))
    sign = F.when(F.col("asked") == F.max("asked").over(w), F.signum("effect"))
    found = marked.withColumn("sign", sign).groupBy("feature", "family", "redundancy").agg(
        F.min("fdr").alias("best_fdr"), F.max(size).alias("best_effect"), F.max(F.coalesce("score", F.lit(0.0))).alias("best_score"), F.count(F.lit(1)).alias("targets"),
        F.countDistinct("horizon").alias("horizons"), F.array_sort(F.collect_set("horizon")).alias("names"), F.max("any").alias("strict"), F.min("sign").alias("low"), F.max("sign").alias("high"),
    )
    return found.withColumn("orientation", F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(0.0).cast("int")).drop("low", "high")


def parents(rows: DataFrame, rules: ParentRules = ParentRules()) -> DataFrame:
    """One row a covered feature: whether it is chosen, and if not why.

    Candidates are the features that pass, and for diversity the best others of each family and of each horizon. They
    are taken by score as long as their family, their redundancy group (which lies within one family) and the whole have
    room. Taking turns by score is a count within a window: what is before a row in its redundancy group, then what of
    that is before it in its family, then in all."""
    s = summaries(rows, rules)
    best = [F.desc("best_effect"), F.col("best_fdr"), F.col("feature")]
    other = s.where(~F.col("strict"))
    of_family = other.withColumn("r", F.row_number().over(Window.partitionBy("family").orderBy(*best))).where(F.col("r") <= rules.fill_family).select("feature")
    of_horizon = other.withColumn("h", F.explode("names")).withColumn("r", F.row_number().over(Window.partitionBy("h").orderBy(*best))).where(F.col("r") <= rules.fill_horizon).select("feature")
    fill = of_family.unionAll(of_horizon).distinct().withColumn("backfill", F.lit(True))
    s = s.join(fill, "feature", "left").withColumn("backfill", F.coalesce("backfill", F.lit(False))).withColumn("one", F.lit(1))
    asked = s.where("strict or backfill").withColumn("weight", -F.log10(F.greatest("best_fdr", F.lit(1e-300))))
    parts = (("weight", 0.4), ("best_effect", 0.3), ("best_score", 0.2), ("horizons", 0.1))
    for c, _ in parts:
        asked = asked.withColumn(f"r_{c}", pct_rank(c, ["one"]))
    asked = asked.withColumn("parent_score", sum((share * F.col(f"r_{c}") for c, share in parts[1:]), parts[0][1] * F.col("r_weight")))
    turn = [F.desc("parent_score"), F.col("feature")]

    def before(by: str, test: Column) -> Column:
        return F.coalesce(F.sum(test.cast("int")).over(Window.partitionBy(by).orderBy(*turn).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    grouped = F.col("redundancy").isNotNull()  # a feature without a redundancy group has no such cap
    a = asked.withColumn("room", ~grouped | (before("redundancy", F.lit(True)) < rules.per_redundancy))
    a = a.withColumn("room", F.col("room") & (before("family", F.col("room")) < rules.per_family))
    a = a.withColumn("selected", F.col("room") & (before("one", F.col("room")) < rules.total))
    why = F.when(before("family", F.col("selected")) >= rules.per_family, "feature_family_cap").when(grouped & (before("redundancy", F.col("selected")) >= rules.per_redundancy), "redundancy_group_cap").otherwise("total_parent_cap")
    a = a.withColumn("rejection_reason", F.when(F.col("selected"), "").otherwise(why))
    out = s.join(a.select("feature", "parent_score", "selected", "rejection_reason"), "feature", "left")
    return out.select("feature", "family", "orientation", "strict", "backfill", "targets", "horizons", "best_fdr", "best_effect", "parent_score", F.coalesce("selected", F.lit(False)).alias("selected"), F.coalesce("rejection_reason", F.lit("fdr_or_effect_threshold")).alias("rejection_reason"))


def operator_plan(pairs: DataFrame, most: int = 15_000) -> DataFrame:
    """The features to generate for pairs of parents (a, b, orientation_a, orientation_b, score_a, score_b, pair_score): the mean
    of both ranks along their signs, both strong at once (the better parent at a tenth, the other at a quarter), and the
    better parent where the other is in its quarter. A parent without a sign has no direction, so its pair has none."""
    first = F.col("score_a") >= F.col("score_b")
    edge = lambda sign, strong: F.when(sign > 0, F.when(strong, 0.90).otherwise(0.75)).otherwise(F.when(strong, 0.10).otherwise(0.25))
    a, b = F.col("orientation_a"), F.col("orientation_b")
    none = F.lit(None).cast("double")
    gate = F.when(first, b).otherwise(a)

    def one(place: int, name: str, anchor: Column, other: Column, at: Column, other_at: Column, direction: Column) -> Column:
        return F.struct(F.lit(place).alias("place"), F.lit(name).alias("operator"), anchor.alias("anchor"), other.alias("other"), at.alias("anchor_edge"), other_at.alias("other_edge"), direction.cast("int").alias("direction"))

    kinds = F.array(
        one(0, "aligned_rank_mean", F.col("a"), F.col("b"), none, none, F.lit(1)),
        one(1, "intersection", F.col("a"), F.col("b"), edge(a, first), edge(b, ~first), F.lit(1)),
        one(2, "gated_anchor", F.when(first, F.col("a")).otherwise(F.col("b")), F.when(first, F.col("b")).otherwise(F.col("a")), none, edge(gate, F.lit(False)), F.when(first, a).otherwise(b)),
    )
    made = pairs.where((a != 0) & (b != 0)).select("a", "b", "pair_score", F.explode(kinds).alias("k")).select("a", "b", "pair_score", "k.*")
    turn = F.row_number().over(Window.orderBy(F.desc("pair_score"), "a", "b", "place"))  # one row a feature to make
    return made.withColumn("n", turn).where(F.col("n") <= most).drop("place")


def complexity(feature: Column) -> Column:
    """How involved a feature's name is: its parts, then the lookback that it ends in."""
    last = F.regexp_extract(feature, r"_([0-9]+)m?$", 1)
    return F.length(feature) - F.length(F.replace(feature, F.lit("_"))) + F.coalesce(F.nullif(last, F.lit("")).cast("double"), F.lit(0.0)) / 1000


def candidate_queue(rows: DataFrame, clusters: DataFrame, *, top: int = 100, fdr: float = 0.10, per_family: int = 30, per_cluster: int = 3, per_horizon: int = 40, limit: int = 250) -> DataFrame:
    """Which screen rows (feature, target, family, horizon, p, fdr, score, monotonicity) go to exact tests, with their place.

    The best by rate and the significant ones, capped by family, fall into clusters: alike features (``clusters``: name,
    cluster), one horizon family, one sign of response. A cluster sends its best row, its simplest feature and the
    neighbour of its best, in this order; then horizons and the whole are capped. ``cluster_fdr`` is the rate within
    the cluster."""
    order = [F.col("fdr").asc_nulls_last(), F.desc("score"), F.col("feature"), F.col("target")]
    place = lambda by, *o: F.row_number().over(Window.partitionBy(*by).orderBy(*o))
    r = rows.where(F.col("p").isNotNull()).withColumn("one", F.lit(1)).withColumn("at", place(["one"], *order))
    r = r.where((F.col("at") <= top) | (F.col("fdr") < fdr))
    r = r.withColumn("f", place(["family"], "at")).where(F.col("f") <= per_family)
    r = r.join(clusters.withColumnRenamed("name", "feature"), "feature")
    sign = F.signum(F.coalesce("monotonicity", F.lit(0.0))).cast("int").cast("string")
    r = bh(r.withColumn("candidate_cluster", F.concat_ws("__", "cluster", "horizon", F.concat(F.lit("response_"), sign))), "p", ["candidate_cluster"], "cluster_fdr")
    c = ["candidate_cluster"]
    r = r.withColumn("head", F.min("at").over(Window.partitionBy(*c))).withColumn("best", place(c, "at")).withColumn("simple", place(c, complexity(F.col("feature")), F.col("at")))
    turn = F.when(F.col("best") == 1, 1).when(F.col("simple") == 1, 2).when(F.col("best") == 2, 3)
    r = r.withColumn("turn", turn).where("turn is not null").withColumn("c", place(c, "turn")).where(F.col("c") <= per_cluster)
    r = r.withColumn("h", place(["horizon"], "head", "turn")).where(F.col("h") <= per_horizon)
    return r.withColumn("place", place(["one"], "head", "turn")).where(F.col("place") <= limit).select(*PAIR, "family", "horizon", "candidate_cluster", "cluster_fdr", "place")


def exact_effects(pairs: DataFrame) -> DataFrame:
    """The exact scan's effects of a pair by year, by symbol and by slot: one pass by grouping sets."""
    rows = pairs.withColumn("year", F.substring("session", 1, 4))
    out = rows.groupingSets([[*PAIR, "year"], [*PAIR, "symbol"], [*PAIR, "slot"]], *PAIR, "year", "symbol", "slot").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean_y"), F.regr_slope("y", "x").alias("slope"))
    scope = F.when(F.col("year").isNotNull(), "year").when(F.col("symbol").isNotNull(), "symbol").otherwise("slot")
    return out.select(*PAIR, scope.alias("scope"), F.coalesce("year", "symbol", F.col("slot").cast("string")).alias("label"), "n", "mean_y", "slope")


def intervals(screen: DataFrame, z: float = 1.959963984540054) -> DataFrame:
    """95% intervals of a slope under both clusterings; no width where an error is null."""
    s = F.col("slope")
    return screen.select(*PAIR, "n", "slope", *[(s + sign * z * F.col(se)).alias(name) for se, names in (("se", ("low", "high")), ("se_two_way", ("low_two_way", "high_two_way"))) for sign, name in zip((-1, 1), names, strict=True)])


def skewness(pairs: DataFrame) -> DataFrame:
    """Third standardised moment of each feature's values and of its target's; null without variance."""
    g = lambda c: F.when(F.var_pop(c) > 0, F.skewness(c))
    return pairs.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("n"), g("x").alias("skew_x"), g("y").alias("skew_y"))


def every_kth(rows: DataFrame, by: list[str], order: list[str], k: int) -> DataFrame:
    """The first and then every k-th row of each group, in order."""
    r = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("__r", r).where((F.col("__r") - 1) % k == 0).drop("__r")


def require(counts: DataFrame, *names: str) -> DataFrame:
    """``counts`` (one row) if all the named counts are 0, an error that names the others if not."""
    row = counts.select(*names).first()
    bad = {n: row[n] for n in names if row[n]}
    if bad:
        raise ValueError(f"violations: {bad}")
    return counts


def screen_violations(screen: DataFrame) -> DataFrame:
    """How many screen rows repeat a pair, have a p outside [0, 1], a negative count, or p without t."""
    p = F.col("p")
    repeated = screen.groupBy(*PAIR).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("repeated_pairs"))
    return screen.agg(F.count_if(~p.between(0, 1)).alias("p_outside"), F.count_if(F.col("n") < 0).alias("negative_counts"), F.count_if(p.isNotNull() & F.col("t").isNull()).alias("p_without_t")).join(repeated)


def bitemporal(rows: DataFrame, spans: DataFrame, key: str, at: str, known: str) -> DataFrame:
    """Every row with the span that held at its time, by what was known then: valid_from <= at < valid_to and known_at <= known.
    Of spans with one valid_from the last known counts; two spans that hold at once are an error. A row without a span that
    holds stays, with nulls, whether or not its key has spans; rows that repeat each other stay too."""
    own = "__row"
    right = spans.withColumnRenamed(key, "__key")
    holds = (F.col("valid_from") <= F.col(at)) & (F.col("valid_to").isNull() | (F.col(at) < F.col("valid_to"))) & (F.col("known_at") <= F.col(known))
    met = rows.withColumn(own, F.monotonically_increasing_id()).join(right, (F.col(key) == F.col("__key")) & holds, "left")
    order = Window.partitionBy(own, "valid_from").orderBy(F.desc("known_at"))
    last = met.withColumn("__r", F.row_number().over(order)).where("__r = 1")
    many = F.count("valid_from").over(Window.partitionBy(own))
    overlap = F.raise_error(F.concat(F.lit("two spans hold at once for "), F.col(key).cast("string")))
    found = last.withColumn("valid_from", F.when(many > 1, overlap.cast(dict(spans.dtypes)["valid_from"])).otherwise(F.col("valid_from")))
    return found.drop(own, "__key", "__r")


def latest_state(rows: DataFrame, key: str, at: str, state: str) -> DataFrame:
    """The last known state of each key; of equal times the greater state."""
    return rows.groupBy(key).agg(F.max(at).alias(at), F.max_by(state, F.struct(at, state)).alias(state))


def lookback_extras(bars: DataFrame, n: int = 4) -> DataFrame:
    """Range statistics over the last n bars of a segment: mean range, this bar's against it, breakdown, volume against a
    mean that includes it, volume per range, return times volume."""
    from panelforge.functions.columns import div, enough, trailing

    from .intraday import S, segments

    w = trailing(S(), n)
    out = segments(bars).withColumn("range", div(F.col("h") - F.col("l"), F.col("c"))).withColumn("ret", div("c", F.lag("c").over(S())) - 1)
    out = out.withColumn("lo", enough(F.col("l"), w, n, F.min("l").over(w))).withColumn("range_mean", enough(F.col("range"), w, n, F.avg("range").over(w))).withColumn("v_mean", enough(F.col("v"), w, n, F.avg("v").over(w)))
    below = F.lag("lo").over(S())
    return out.select(
        "symbol", "session", "slot", "range_mean", div("range", "range_mean").alias("range_ratio"), F.when(below.isNotNull(), F.greatest(1 - div(F.col("c"), below), F.lit(0.0))).alias("breakdown"),
        div("v", "v_mean").alias("rel_volume_inclusive"), div(div("v", "v_mean"), div("range", "range_mean")).alias("volume_range_ratio"), (F.col("ret") * div("v", "v_mean")).alias("return_volume_product"), div(F.col("c") - F.col("o"), F.col("o")).alias("body_pct"),
    )


def content_classes(wide: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """(name, same_as, n_values): the first name whose column holds the same values at the same keys, itself if none comes before.

    One aggregate for all columns: each row's key and value (or that there is none) are hashed together twice and the hashes
    added up, so the order of rows does not matter; two columns are one class if both sums and the counts agree."""

    def prints(c: str) -> Column:
        x = F.col(c).cast("double") + 0.0  # one zero
        h = [F.xxhash64(*keys, x, x.isNull(), F.lit(seed)).cast("decimal(38,0)") for seed in (1, 2)]
        return F.struct(F.lit(c).alias("name"), F.sum(h[0]).alias("a"), F.sum(h[1]).alias("b"), F.count(x).alias("n_values")).alias(c)

    one = wide.agg(*[prints(c) for c in names])
    rows = one.select(F.explode(F.array(*names)).alias("p")).select("p.*")
    return rows.select("name", F.min("name").over(Window.partitionBy("a", "b", "n_values")).alias("same_as"), "n_values")
