import math

import pytest

from panelforge.operators import selection as op

GOOD = {"status": "screened", "n": 500, "valid_sessions": 60, "valid_symbols": 20, "two_way_cluster_p": 0.01, "global_fdr": 0.01, "year_consistency": 0.8, "symbol_breadth": 0.8, "top_bottom_spread": 0.002, "monotonicity": 0.9, "outlier_worst_signed_spread": 0.001, "concentration": "broad", "recommendation": "", "recent_effect": -1.0}
SCHEMA = "status string, n long, valid_sessions long, valid_symbols long, two_way_cluster_p double, global_fdr double, year_consistency double, symbol_breadth double, top_bottom_spread double, monotonicity double, outlier_worst_signed_spread double, concentration string, recommendation string, recent_effect double"


@pytest.mark.parametrize(
    "change, label",
    [
        ({}, "robust_phase1_anomaly_candidate"),
        ({"status": "constant_feature"}, "constant_feature"),
        ({"monotonicity": 0.1}, "stable_anomaly_candidate"),
        ({"monotonicity": 0.1, "recommendation": "advance_all"}, "requires_phase2_testing"),
        ({"symbol_breadth": 0.1}, "statistically_significant_discovery"),
        ({"symbol_breadth": 0.1, "recent_effect": 0.1}, "recently_relevant_anomaly_candidate"),
        ({"global_fdr": 0.5}, "exploratory_relationship"),
        ({"global_fdr": None}, "exploratory_relationship"),
        ({"global_fdr": 0.5, "two_way_cluster_p": None}, "no_meaningful_relationship"),
        ({"n": 1}, "statistically_significant_discovery"),
        ({"concentration": None}, "stable_anomaly_candidate"),
    ],
)
def test_evidence_classes(spark, change, label):
    rows = spark.createDataFrame([tuple((GOOD | change).values())], SCHEMA)
    assert op.classify(rows).first().evidence == label


def test_classes_without_optional_columns(spark):
    rows = spark.createDataFrame([("screened", 0.01)], "status string, global_fdr double")
    assert op.classify(rows).first().evidence == "statistically_significant_discovery"


FIT = dict(zip(op.PROMOTION_INPUTS, (0.05, 0.05, 0.0002, 0.0001, 0.6, 1e-6, 0.5, 0.55, 0.02, 0.25, 0.0001), strict=True))


@pytest.mark.parametrize(
    "change, label",
    [
        ({}, "exploratory_generated_interaction_candidate"),
        ({"fdr": 0.0501}, "systematic_interaction_not_robust"),
        ({"parent_effect": 0.00019}, "significant_but_not_incremental_to_parent"),
        ({"positive_folds": 0.59}, "systematic_interaction_not_robust"),
        ({"worst_fold": 0.0}, "systematic_interaction_not_robust"),
        ({"recent_ratio": 2.51}, "recently_emerged_high_instability"),
        ({"symbol_hhi": 0.021}, "systematic_interaction_not_robust"),
        ({"top5_share": 0.26}, "systematic_interaction_not_robust"),
        ({"effect_rest": 0.00009}, "systematic_interaction_not_robust"),
        ({"p_two_way": None}, "systematic_interaction_requires_more_diagnostics"),
        ({"p_two_way": math.nan}, "systematic_interaction_requires_more_diagnostics"),
        ({"p_two_way": math.inf}, "systematic_interaction_requires_more_diagnostics"),
    ],
)
def test_promotion_changes_one_step_past_each_limit(spark, change, label):
    rows = spark.createDataFrame([tuple((FIT | change).values())], ", ".join(f"{c} double" for c in op.PROMOTION_INPUTS))
    assert op.promote(rows).first().promotion == label


TESTS = "feature string, target string, test_type string, fdr_family string, feature_family string, raw_p double"


def test_interday_rates_cover_all_tests_of_a_family(spark):
    rows = [("f", "t", f"k{i}", "all", "a", p) for i, p in enumerate((0.01, 0.02, 0.03, 0.04, None))]
    got = {r.test_type: (r.feature, r.global_fdr) for r in op.interday_fdr(spark.createDataFrame(rows, TESTS)).collect()}
    assert got["k4"] == ("f", None) and all(math.isclose(got[f"k{i}"][1], 0.04) for i in range(4))


def test_repeated_hypotheses_raise(spark):
    with pytest.raises(ValueError, match="twice"):
        op.interday_fdr(spark.createDataFrame([("f", "t", "k", "all", "a", 0.1)] * 2, TESTS))


def test_interday_gates(spark):
    rows = [
        ("rank_ic", 750, 0.01, 1, 0.05, 50, True, True),
        ("rank_ic", 749, 0.01, 1, 0.05, 50, True, False),
        ("top_bottom", 500, -0.0012, 5, 0.05, 50, True, True),
        ("top_bottom", 500, -0.0012, 6, 0.05, 50, True, False),
        ("top_bottom", 500, 0.0025, 20, 0.05, 50, True, True),
        ("top_bottom", 500, 0.0025, 20, 0.051, 50, True, False),
        ("top_bottom", 500, 0.0025, 20, None, 50, True, False),
        ("top_bottom", 500, 0.0025, 20, 0.05, 49, True, False),
        ("top_bottom", 500, 0.0025, 20, 0.05, 50, None, False),
    ]
    df = spark.createDataFrame(rows, "test_type string, valid_dates long, effect double, horizon int, global_fdr double, distinct_symbols long, neighbor_supported boolean, want boolean")
    assert all(r.passes == r.want for r in op.interday_gates(df).collect())


def test_clusters_follow_chains(spark):
    names = spark.createDataFrame([(c,) for c in "abcdef"], "name string")
    links = spark.createDataFrame([("f", "e"), ("d", "e"), ("c", "d"), ("a", "b")], "a string, b string")
    assert {r.name: r.cluster for r in op.clusters(names, links).collect()} == dict(zip("abcdef", "aacccc", strict=True))
    assert op.clusters(names, links.limit(0)).where("name != cluster").count() == 0
