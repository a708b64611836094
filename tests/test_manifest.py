"""Compiling a manifest: order, shared content, hashes, errors, and sorts of the plan."""

import pytest

from panelforge.operators import manifest as m
from panelforge.plans.bulk import MANIFEST

COLUMNS = {"symbol", "session", "slot", "o", "h", "l", "c", "v"}


def f(name, op, *inputs, **more):
    return m.Feature(name, op, inputs, **more)


def test_order_does_not_matter_and_equal_content_is_made_once():
    a, b = m.compiled(MANIFEST, COLUMNS), m.compiled(MANIFEST[::-1], COLUMNS)
    assert a.hashes == b.hashes and a.mark == b.mark
    assert a.stands["again_1"] == "r1" and a.stands["again_2"] == "again_2" and a.stands["calm"] == "again_2"
    made = [x.name for _, stage in a.stages for x in stage]
    assert len(made) == len(set(made)) == len(MANIFEST) - 2
    seen = set(COLUMNS)
    for _, stage in a.stages:
        assert all(a.stands.get(i, i) in seen for x in stage for i in x.inputs)
        seen |= {x.name for x in stage}


def test_names_do_not_matter_to_content():
    one = m.compiled([f("x", "return", "c", n=1), f("y", "mean", "x", n=3)], COLUMNS)
    two = m.compiled([f("p", "return", "c", n=1), f("q", "mean", "p", n=3)], COLUMNS)
    other = m.compiled([f("p", "return", "c", n=2), f("q", "mean", "p", n=3)], COLUMNS)
    assert one.hashes["y"] == two.hashes["q"] != other.hashes["q"]


@pytest.mark.parametrize(
    "features, what",
    [
        ([f("x", "lag", "y", n=1), f("y", "lag", "x", n=1)], "circle"), ([f("x", "lag", "gone", n=1)], "nothing makes"), ([f("x", "lag", "c"), f("x", "lag", "o")], "twice"),
        ([f("c", "lag", "o", n=1)], "twice"), ([f("x", "unheard", "c")], "unheard"), ([f("x", "ratio", "c")], "1 inputs"),
    ],
)
def test_errors(features, what):
    with pytest.raises(ValueError, match=what):
        m.compiled(features, COLUMNS)


def test_no_more_sorts_than_windows(spark):
    rows = [("S1", "2024-01-01", i, 1.0, 2.0, 0.5, 1.5, 3) for i in range(12)]
    bars = spark.createDataFrame(rows, "symbol string, session string, slot int, o double, h double, l double, c double, v long")
    plan = m.run(bars, MANIFEST)._jdf.queryExecution().executedPlan().toString()
    count = lambda word: sum(word in line for line in plan.splitlines())
    assert count("Sort [") <= count("Window [")
    series = [line for line in plan.splitlines() if "Sort [" in line and "seg" in line]
    assert len(series) <= 3  # once before the ranks, once after, and once for the lag of what ranks made
    assert count("Window [") < len(MANIFEST)
