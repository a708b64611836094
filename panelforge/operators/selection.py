"""From screen rows to candidates: evidence classes, gates, correlated clusters, pairs of parents and their caps.

Screen rows are few (one a feature and target), so windows over all of them are small; whatever touches data rows is an
aggregate before it gets here.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.columns import div, edge_bin
from panelforge.operators import order
from panelforge.sources.shared import cut

from .screening import PAIR, bh

#: Lowest absolute effect in basis points up to each horizon in sessions; 25 beyond.
EFFECT_FLOORS = ((2, 8.0), (5, 12.0), (10, 18.0), (14, 22.0))


@dataclass(frozen=True)
class Gate:
    """A test that rows must pass: a column, or ``of`` with the column in it, against a limit. An unknown value fails."""

    column: str
    holds: str  # "<", "<=", ">", ">=", "in" or "out"
    limit: object
    of: str = "{}"

    def test(self, known: set[str], slack: float = 0.0) -> Column:
        """False for every row where the column is absent. Limits that may be met exactly get ``slack``."""
        if self.column not in known:
            return F.lit(False)
        v = F.expr(self.of.format(self.column))
        tests = {"<": lambda: v < self.limit, ">": lambda: v > self.limit, "<=": lambda: v <= self.limit + slack, ">=": lambda: v >= self.limit - slack, "in": lambda: v.isin(*self.limit), "out": lambda: ~v.isin(*self.limit)}
        return yes(tests[self.holds]())


def passed(groups: dict[str, tuple[Gate, ...]], known: set[str], slack: float = 0.0) -> dict[str, Column]:
    """For each group of gates whether all of them hold."""
    out = {}
    for name, gates in groups.items():
        ok = F.lit(True)
        for g in gates:
            ok = ok & g.test(known, slack)
        out[name] = ok
    return out


def first_label(choices: tuple[tuple[str, tuple[str, ...]], ...], holds: dict[str, Column]) -> Column:
    """The first label all of whose groups hold; the last one asks for none."""
    label = F.lit(choices[-1][0])
    for name, groups in reversed(choices[:-1]):
        ok = F.lit(True)
        for g in groups:
            ok = ok & holds[g]
        label = F.when(ok, F.lit(name)).otherwise(label)
    return label


# What evidence asks for, and the labels from the strongest down with the groups that each needs.
EVIDENCE = {
    "unusable": (Gate("status", "in", ("constant_feature", "insufficient_data")),),
    "discovered": (Gate("global_fdr", "<", 0.05),),
    "confirmed": (Gate("two_way_cluster_p", "<", 0.05),),
    "covered": (Gate("n", ">=", 30), Gate("valid_sessions", ">=", 5), Gate("valid_symbols", ">=", 3)),
    "consistent": (Gate("year_consistency", ">=", 0.6), Gate("symbol_breadth", ">=", 0.6)),
    "large": (Gate("top_bottom_spread", ">=", 0.5, "abs({}) * 1e4"),),
    "ordered": (Gate("monotonicity", ">=", 0.5, "abs({})"),),
    "binary": (Gate("scan_kind", "in", ("binary",)),),
    "outliers": (Gate("outlier_worst_signed_spread", ">", 0.0),),
    "dispersed": (Gate("concentration", "out", ("highly_concentrated", "single_symbol_dominated", "insufficient_evidence")),),
    "recommended": (Gate("recommendation", "in", ("advance",), "substring({}, 1, 7)"),),
    "recent": (Gate("recent_effect", ">", 0.0),),
}
SOLID = ("discovered", "confirmed", "covered", "large")
LABELS = (
    ("robust_phase1_anomaly_candidate", (*SOLID, "consistent", "shaped", "outliers", "dispersed")),
    ("requires_phase2_testing", (*SOLID, "recommended")),
    ("stable_anomaly_candidate", (*SOLID, "consistent")),
    ("recently_relevant_anomaly_candidate", (*SOLID, "recent")),
    ("statistically_significant_discovery", ("discovered",)),
    ("exploratory_relationship", ("confirmed",)),
    ("no_meaningful_relationship", ()),
)
#: What a generated feature must show, by what it shows; effects are signed means of the target.
PROMOTION = {
    "stable": (Gate("recent_ratio", "<=", 2.50),),
    "significant": (Gate("fdr", "<=", 0.05), Gate("p_two_way", "<=", 0.05), Gate("effect", ">=", 1.0, "abs({}) * 1e4")),
    "broad": (Gate("agreeing_symbols", ">=", 0.55), Gate("symbol_hhi", "<=", 0.02), Gate("top5_share", "<=", 0.25)),
    "lasting": (Gate("positive_folds", ">=", 0.60), Gate("worst_fold", ">", 0.0), Gate("recent_ratio", ">=", 0.50)),
    "not a few names": (Gate("effect_rest", ">=", 0.0, "abs({}) - 0.50 * abs(effect)"),),
    "more than a parent": (Gate("parent_effect", ">=", 0.0, "abs(effect) - 1.25 * abs({})"), Gate("parent_effect", ">=", 0.25, "(abs(effect) - abs({})) * 1e4")),
}
PROMOTION_INPUTS = ("fdr", "p_two_way", "effect", "parent_effect", "positive_folds", "worst_fold", "recent_ratio", "agreeing_symbols", "symbol_hhi", "top5_share", "effect_rest")
OWN_MERIT = ("stable", "significant", "broad", "lasting", "not a few names")
PROMOTED = (
    ("systematic_interaction_requires_more_diagnostics", ("unknown",)),
    ("recently_emerged_high_instability", ("unstable",)),
    ("exploratory_generated_interaction_candidate", (*OWN_MERIT, "more than a parent")),
    ("significant_but_not_incremental_to_parent", OWN_MERIT),
    ("systematic_interaction_not_robust", ()),
)


def yes(test: Column) -> Column:
    """A test that an unknown value fails."""
    return F.coalesce(test, F.lit(False))


def year_consistency(pairs: DataFrame, least: int = 5) -> DataFrame:
    """Share of the years whose own slope has the sign of the pair's."""
    own = pairs.groupBy(*PAIR, F.substring("session", 1, 4).alias("year")).agg(F.regr_slope("y", "x").alias("own"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    whole = pairs.groupBy(*PAIR).agg(F.regr_slope("y", "x").alias("slope"))
    agrees = (F.signum("own") == F.signum("slope")).cast("double")
    return own.join(whole, PAIR).groupBy(*PAIR).agg(F.count("own").alias("n_years"), F.avg(agrees).alias("year_consistency"))


def symbol_breadth(pairs: DataFrame, least: int = 5) -> DataFrame:
    """Share of the symbols whose own slope has the sign of the pair's."""
    own = pairs.groupBy(*PAIR, "symbol").agg(F.regr_slope("y", "x").alias("own"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    whole = pairs.groupBy(*PAIR).agg(F.regr_slope("y", "x").alias("slope"))
    agrees = (F.signum("own") == F.signum("slope")).cast("double")
    return own.join(whole, PAIR).groupBy(*PAIR).agg(F.count("own").alias("n_symbols"), F.avg(agrees).alias("breadth"))


def without_top(pairs: DataFrame, k: int = 2) -> DataFrame:
    """Slope with all symbols, and without the k that carry most of the effect (equal ones by name)."""
    effect = pairs.groupBy(*PAIR, "symbol").agg(F.abs(F.sum(F.col("x") * F.col("y"))).alias("e"))
    top = effect.withColumn("r", F.row_number().over(Window.partitionBy(*PAIR).orderBy(F.desc("e"), "symbol"))).where(F.col("r") <= k)
    rest = pairs.join(top.select(*PAIR, "symbol"), [*PAIR, "symbol"], "left_anti").groupBy(*PAIR).agg(F.regr_slope("y", "x").alias("slope_rest"), F.count(F.lit(1)).alias("n_rest"))
    return pairs.groupBy(*PAIR).agg(F.regr_slope("y", "x").alias("slope")).join(rest, PAIR, "left").withColumn("retention", div("slope_rest", "slope"))


def classify(rows: DataFrame, limits: dict[str, tuple[Gate, ...]] | None = None) -> DataFrame:
    """The strongest evidence label that a screen row earns, as ``evidence``; ``limits`` replaces groups of EVIDENCE. Inputs
    that are absent or null earn nothing, but an absent spread is no obstacle. Recency alone never promotes to the robust
    label."""
    groups, known = EVIDENCE | (limits or {}), set(rows.columns)
    holds = passed(groups, known)
    if "top_bottom_spread" not in known:
        holds["large"] = F.lit(True)
    holds["shaped"] = holds["ordered"] | holds["binary"]
    label = first_label(LABELS, holds)
    return rows.withColumn("evidence", F.when(holds["unusable"], F.col("status")).otherwise(label) if "status" in known else label)


def promote(rows: DataFrame, gates: dict[str, tuple[Gate, ...]] = PROMOTION) -> DataFrame:
    """Class of a generated two-factor feature, as ``promotion``: the groups of gates that it passes decide; ``failed`` lists
    those that it does not."""
    holds = passed(gates, set(rows.columns), slack=1e-11)
    finite = F.forall(F.array(*[F.col(c).cast("double") for c in PROMOTION_INPUTS]), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    holds |= {"unknown": ~finite, "unstable": ~holds["stable"]}
    failed = F.array_compact(F.array(*[F.when(~holds[g], F.lit(g)) for g in gates]))
    return rows.withColumn("promotion", first_label(PROMOTED, holds)).withColumn("failed", failed)


def interday_fdr(tests: DataFrame) -> DataFrame:
    """False-discovery rates over all tests of a family together, and within each feature family; repeated hypotheses raise."""
    keys = ["feature", "target", "test_type"]
    repeated = tests.groupBy(*keys).count().where("count > 1")
    if repeated.limit(1).count():
        raise ValueError("a hypothesis is listed twice")
    one = tests.withColumn("__feature", F.col("feature")).withColumn("feature", F.concat_ws("/", "feature", "test_type"))
    both = bh(bh(one, "raw_p", ["fdr_family"], "global_fdr"), "raw_p", ["fdr_family", "feature_family"], "feature_family_fdr")
    return both.withColumn("feature", F.col("__feature")).drop("__feature")


def effect_floor(horizon: Column) -> Column:
    out = F.when(horizon.isNull(), EFFECT_FLOORS[0][1])
    for last, bps in EFFECT_FLOORS:
        out = out.when(horizon <= last, bps)
    return out.otherwise(25.0)


def interday_gates(rows: DataFrame, *, fdr: float = 0.05, ic_dates: int = 750, decile_dates: int = 500, symbols: int = 50, ic: float = 0.01) -> DataFrame:
    """Whether a tested row may go on: rate, dates, size for its horizon, symbols and a neighbouring horizon, as ``passes``."""
    ranked = (F.col("valid_dates") >= ic_dates) & (F.abs("effect") >= ic)
    spread = (F.col("valid_dates") >= decile_dates) & (F.abs("effect") >= effect_floor(F.col("horizon")) / 1e4)
    ok = (F.col("global_fdr") <= fdr) & F.when(F.col("test_type") == "rank_ic", ranked).otherwise(spread) & (F.col("distinct_symbols") >= symbols) & F.col("neighbor_supported")
    return rows.withColumn("passes", yes(ok))


def rank_correlations(wide: DataFrame, names: tuple[str, ...], keys: tuple[str, ...] = ("symbol", "session", "slot")) -> DataFrame:
    """(a, b, n, sessions, symbols, corr): rank correlation of every two features over rows with both. A row carries its
    pairs; their ranks come from counts of buckets (``order``), so no task sorts all rows of a pair."""
    sorted_names = sorted(names)
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")) for i, a in enumerate(sorted_names) for b in sorted_names[i + 1 :]])
    rows = wide.select(*keys, F.explode(pairs).alias("p")).select(*keys, "p.*").where("x is not null and y is not null")
    rows = cut(rows)
    for c in "xy":
        rows = order.average_ranks(rows, ["a", "b"], c, f"r{c}")
    return rows.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("session").alias("sessions"), F.countDistinct("symbol").alias("symbols"), div(F.covar_pop("rx", "ry"), F.sqrt(F.var_pop("rx") * F.var_pop("ry"))).alias("corr"))


def clusters(names: DataFrame, links: DataFrame) -> DataFrame:
    """(name, cluster): the least name reachable over links (a, b). Names are features of a screen, so few; each round is
    one join and one aggregate, and rounds end when no name changes."""
    both = cut(links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    state = cut(names.select("name", F.col("name").alias("cluster")).distinct())
    while True:
        near = both.join(state.withColumnRenamed("name", "b"), "b").groupBy("a").agg(F.min("cluster").alias("c"))
        after = cut(state.join(near, F.col("name") == F.col("a"), "left").select("name", F.least("cluster", "c").alias("cluster")))
        if not after.exceptAll(state).limit(1).count():
            return after
        state = after


def parent_pairs(corr: DataFrame, scores: DataFrame, *, most: float = 0.90, least: tuple[int, int, int] = (250_000, 750, 75), cap: int = 500, total: int = 5_000) -> DataFrame:
    """Every two parents with their score and, where they are not chosen, why. ``scores``: (feature, family, score)."""
    s = scores.select("feature", "family", "score")
    p = corr.join(s.toDF("a", "family_a", "score_a"), "a").join(s.toDF("b", "family_b", "score_b"), "b")
    strength = F.abs("corr")
    why = F.when(strength >= most, "parent_correlation").when(F.col("n") < least[0], "insufficient_joint_observations").when(F.col("sessions") < least[1], "insufficient_joint_sessions").when(F.col("symbols") < least[2], "insufficient_joint_symbols")
    p = p.withColumn("why", why).withColumn("pair_score", 0.4 * F.col("score_a") + 0.4 * F.col("score_b") + 0.2 * F.coalesce(1 - strength, F.lit(0.0)))
    p = p.withColumn("bucket", F.concat_ws("::", F.least("family_a", "family_b"), F.greatest("family_a", "family_b")))
    turn = [F.desc("pair_score"), F.col("a"), F.col("b")]
    p = p.withColumn("place", F.row_number().over(Window.partitionBy("bucket", F.col("why").isNull()).orderBy(*turn)))
    p = p.withColumn("why", F.coalesce("why", F.when(F.col("place") > cap, "family_pair_cap")))
    # what the family cap turned away does not count towards the total
    p = p.withColumn("place", F.row_number().over(Window.partitionBy(F.col("why").isNull()).orderBy(*turn)))
    p = p.withColumn("why", F.coalesce("why", F.when(F.col("place") > total, "total_pair_cap")))
    return p.select("a", "b", "bucket", "n", "corr", "pair_score", F.coalesce("why", F.lit("")).alias("rejection_reason"))


def edge_bins(pairs: DataFrame, edges: int = 19) -> DataFrame:
    """Mean target by the bin between exact percentile edges of the feature; equal values share a bin."""
    pairs = cut(pairs)
    found = order.quantiles(pairs, PAIR, "x", [i / (edges + 1) for i in range(1, edges + 1)])
    cuts = found.select(*PAIR, F.array_distinct("quantiles").alias("edges"))
    binned = pairs.join(cuts, PAIR).withColumn("bin", edge_bin(F.col("x"), F.col("edges")))
    return binned.groupBy(*PAIR, "bin").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean_y"))


def coverage_report(wide: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Rows, values, range and middle of each feature: one unpivot, one aggregate."""
    x = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in names])
    rows = wide.select(F.explode(x).alias("f")).select("f.*")
    return rows.groupBy("feature").agg(F.count(F.lit(1)).alias("n_rows"), F.count("x").alias("n_values"), F.min("x").alias("least"), F.max("x").alias("greatest"), F.percentile("x", F.lit(0.5)).alias("median"), F.percentile("x", F.lit(0.99)).alias("p99"))


def diagnostic_cube(pairs: DataFrame) -> DataFrame:
    """Mean target by symbol, by slot, and over all, in one pass by grouping sets."""
    out = pairs.groupingSets([[*PAIR, "symbol"], [*PAIR, "slot"], PAIR], *PAIR, "symbol", "slot")
    return out.agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean_y"))
