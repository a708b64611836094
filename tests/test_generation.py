import random

import pytest
from pyspark.sql import functions as F

from panelforge.operators import generation as op
from panelforge.operators import screening


def greedy(rows, rules):
    """Taking turns by score, one row after the other."""
    families, groups, chosen, why = {}, {}, 0, {}
    for name, family, group, _ in sorted(rows, key=lambda r: (-r[3], r[0])):
        if families.get(family, 0) >= rules.per_family:
            why[name] = "feature_family_cap"
        elif groups.get(group, 0) >= rules.per_redundancy:
            why[name] = "redundancy_group_cap"
        elif chosen >= rules.total:
            why[name] = "total_parent_cap"
        else:
            chosen, families[family], groups[group], why[name] = chosen + 1, families.get(family, 0) + 1, groups.get(group, 0) + 1, ""
    return why


@pytest.mark.parametrize("seed", range(4))
def test_parents_take_turns(spark, seed):
    r = random.Random(seed)
    rules = op.ParentRules(rows=1, sessions=1, symbols=1, decisions=1, fdr=0.9, bps=0.0, per_family=4, per_redundancy=2, total=9)
    rows = []
    for i in range(40):
        family = r.choice("abcd")
        group = f"{family}{r.randrange(3)}"
        rows += [(f"f{i:02d}", f"t{j}", family, group, r.choice(["short", "medium"]), r.random() * 0.8, r.uniform(-1, 1), r.random(), 9, 9, 9, 9) for j in range(2)]
    df = spark.createDataFrame(rows, "feature string, target string, family string, redundancy string, horizon string, fdr double, effect double, score double, n long, n_sessions long, n_symbols long, n_decisions long")
    got = {x.feature: x for x in op.parents(df, rules).collect()}
    want = greedy([(f, got[f].family, next(x[3] for x in rows if x[0] == f), got[f].parent_score) for f in got], rules)
    assert {f: x.rejection_reason for f, x in got.items()} == want and len(set(want.values())) >= 3
    assert all(x.selected == (want[f] == "") for f, x in got.items())
    for f, x in got.items():
        passing = [y for y in rows if y[0] == f]
        assert x.orientation == (1 if max(passing, key=lambda y: abs(y[6]))[6] > 0 else -1)


def test_parents_without_a_sign_and_backfill(spark):
    base = [("a", "t1", "x", "x", "short", 0.5, 0.2), ("a", "t2", "x", "x", "short", 0.5, -0.2), ("b", "t1", "x", "x", "short", 0.5, 0.1), ("c", "t1", "y", "y", "short", 0.01, 0.3), ("d", "t1", "y", "y", "long", None, 0.3)]
    df = spark.createDataFrame([(*b, 1.0, 9, 9, 9, 9) for b in base], "feature string, target string, family string, redundancy string, horizon string, fdr double, effect double, score double, n long, n_sessions long, n_symbols long, n_decisions long")
    got = {x.feature: x for x in op.parents(df, op.ParentRules(rows=1, sessions=1, symbols=1, decisions=1, fill_family=1, fill_horizon=1)).collect()}
    assert set(got) == {"a", "b", "c"} and got["a"].orientation == 0 and got["c"].strict and got["a"].backfill and got["b"].rejection_reason == "fdr_or_effect_threshold"


def test_rates_leave_out_what_is_no_probability(spark):
    df = spark.createDataFrame([("f", str(i), p) for i, p in enumerate((0.01, 0.02, 1.5, -0.1, None))], "feature string, target string, p double")
    got = [x.q for x in op.rates(df, "p", {"q": []}).orderBy("target").collect()]
    assert got == [0.02, 0.02, None, None, None]


SPANS = "k string, valid_from int, valid_to int, known_at int, name string"


def test_bitemporal(spark):
    rows = spark.createDataFrame([("a", 5, 9), ("a", 5, 1), ("b", 5, 9)], "k string, t int, seen int")
    spans = [("a", 0, 6, 1, "old"), ("a", 0, 6, 4, "mended"), ("a", 6, None, 1, "next")]
    got = {(r.k, r.seen): r.name for r in op.bitemporal(rows, spark.createDataFrame(spans, SPANS), "k", "t", "seen").collect()}
    assert got == {("a", 9): "mended", ("a", 1): "old", ("b", 9): None}
    with pytest.raises(Exception, match="two spans"):
        op.bitemporal(rows, spark.createDataFrame([*spans, ("a", 4, 9, 1, "again")], SPANS), "k", "t", "seen").collect()


def test_violations_raise(spark):
    df = spark.createDataFrame([("f", "t", 0.1, 1.0, 5), ("f", "t", 0.1, 1.0, 5), ("f", "u", 1.2, None, -1)], "feature string, target string, p double, t double, n long")
    found = op.screen_violations(df)
    assert found.first().asDict() == {"p_outside": 1, "negative_counts": 1, "p_without_t": 1, "repeated_pairs": 1}
    with pytest.raises(ValueError, match="p_outside"):
        op.require(found, "p_outside", "repeated_pairs")
    assert op.require(op.screen_violations(df.limit(1)), *found.columns).count() == 1


@pytest.mark.parametrize("scale, shift", [(1.0, 0.0), (1e6, 0.0), (1.0, 1e9), (1e-6, 0.0)])
def test_clustered_errors_do_not_depend_on_unit_or_origin(spark, scale, shift):
    r = random.Random(1)
    rows = [("f", "y", f"2024-01-{1 + i % 20:02d}", f"S{i % 7}", i, r.gauss(0, 1)) for i in range(2000)]
    df = spark.createDataFrame(rows, "feature string, target string, session string, symbol string, slot int, x0 double").withColumn("y", F.col("x0") * 0.1 + F.sin(F.col("slot") * 7.0))
    got = screening.clustered_screen(df.withColumn("x", F.col("x0") * scale + shift)).first()
    want = screening.clustered_screen(df.withColumn("x", F.col("x0"))).first()
    assert got.t == pytest.approx(want.t, rel=1e-5) and got.t_two_way == pytest.approx(want.t_two_way, rel=1e-4) and got.slope * scale == pytest.approx(want.slope, rel=1e-5)


def test_normal_p(spark):
    import math

    t = [0.0, 0.5, -1.96, 3.0, 8.0, 20.0, None]
    got = [x.p for x in spark.createDataFrame([(v,) for v in t], "t double").select(screening.normal_p("t").alias("p")).collect()]
    assert got[-1] is None and all(g == pytest.approx(math.erfc(abs(v) / math.sqrt(2)), rel=2e-7) for g, v in zip(got[:-1], t[:-1]))


def test_bitemporal_keeps_equal_rows_and_rows_outside_every_span(spark):
    rows = spark.createDataFrame([("a", 5, 9), ("a", 5, 9), ("a", 99, 9), ("b", 5, 9)], "k string, t int, seen int")
    spans = spark.createDataFrame([("a", 1, 10, 1, "x")], SPANS)
    got = sorted((r.k, r.t, r.name) for r in op.bitemporal(rows, spans, "k", "t", "seen").collect())
    assert got == [("a", 5, "x"), ("a", 5, "x"), ("a", 99, None), ("b", 5, None)]


def test_parents_without_a_redundancy_group_have_no_such_cap(spark):
    rows = [(f"f{i}", "t", f"fam{i}", None, "h", 0.01, 0.01 * (i + 1), 1.0, 9, 9, 9, 9) for i in range(6)]
    df = spark.createDataFrame(rows, "feature string, target string, family string, redundancy string, horizon string, fdr double, effect double, score double, n long, n_sessions long, n_symbols long, n_decisions long")
    rules = op.ParentRules(rows=1, sessions=1, symbols=1, decisions=1, fdr=0.9, bps=0.0, per_family=4, per_redundancy=2, total=9)
    assert all(r.selected for r in op.parents(df, rules).collect())
