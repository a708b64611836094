"""Corporate actions against hand-computed cases of every status."""

import pytest
from pyspark.sql import functions as F

from panelforge.operators import actions as ca

UNTIL = "2025-12-31"


def panel(spark, prices):
    rows = [(s, f"2025-01-{t:02d}", t, p, p, p, p, 100.0) for s, ps in prices.items() for t, p in enumerate(ps, 1)]
    return spark.createDataFrame(rows, "security string, session string, t int, o double, h double, l double, c double, v double")


def events(spark, rows):
    return spark.createDataFrame([tuple(r.get(c) for c in COLUMNS) for r in rows], "security string, session string, action_sequence string, action_type string, split_ratio double, cash_amount double, cash_out_value double, reference_price_before_delisting double, delisting_return_from_reference double")


COLUMNS = ("security", "session", "action_sequence", "action_type", "split_ratio", "cash_amount", "cash_out_value", "reference_price_before_delisting", "delisting_return_from_reference")


def at(day, kind, security="X", **more):
    return {"security": security, "session": f"2025-01-{day:02d}", "action_type": kind, **more}


def returns(spark, prices, rows, k=3):
    found = ca.forward(ca.index(panel(spark, {"X": prices}), ca.normalised(events(spark, rows), UNTIL)), k)
    return {r.t: (r.total_return, r.price_return, r.unresolved_interval) for r in found.collect()}


def test_split_and_dividend(spark):
    got = returns(spark, [10.0, 5.0, 6.0, 6.0], [at(2, "split", split_ratio=2.0), at(3, "cash_dividend", cash_amount=1.0)])
    assert got[1] == (pytest.approx((12 + 2) / 10 - 1), pytest.approx(0.2), False)
    assert got[2] == (None, None, False)


def test_terminal_value_ends_the_interval(spark):
    got = returns(spark, [10.0, 5.0, None, None, None], [at(2, "split", split_ratio=2.0), at(3, "cash_merger", cash_out_value=7.0)])
    assert got[1] == (pytest.approx(0.4), None, False) and got[2] == (pytest.approx(0.4), None, False)
    got = returns(spark, [10.0, 5.0, 4.0, 4.0], [at(3, "delisting", reference_price_before_delisting=8.0, delisting_return_from_reference=-0.5)])
    assert got[1] == (pytest.approx(-0.6), None, False)


def test_unresolved_poisons_what_follows(spark):
    got = returns(spark, [10.0, 10.0, 10.0, 10.0, 10.0, 10.0], [at(4, "delisting", reference_price_before_delisting=8.0)], k=2)
    assert got[1] == (pytest.approx(0), pytest.approx(0), False)
    assert got[2] == got[3] == got[4] == (None, None, True)
    got = returns(spark, [10.0, 10.0, 10.0, 10.0], [at(2, "cash_dividend")], k=1)
    assert got[1] == got[2] == got[3] == (None, None, True)
    # a value before the unresolved event is lost too, since the interval's end is not sound
    got = returns(spark, [10.0, 10.0, 10.0, 10.0], [at(2, "cash_merger", cash_out_value=9.0), at(3, "delisting")], k=3)
    assert got[1] == (None, None, True)


def test_bad_events_raise(spark):
    for rows, what in (
        ([at(2, "split", split_ratio=0.0)], "invalid_split_ratio"),
        ([at(2, "split")], "invalid_split_ratio"),
        ([at(2, "spinoff")], "unknown_action_type"),
        ([at(2, "split", split_ratio=2.0), at(2, "cash_dividend", cash_amount=1.0)], "duplicate_action_sequence"),
    ):
        with pytest.raises(ValueError, match=what):
            ca.normalised(events(spark, rows), UNTIL)
    assert ca.normalised(events(spark, [at(2, "split", split_ratio=0.0)]), "2025-01-01").count() == 0
    found = ca.canonical(events(spark, [at(2, "delisting", action_sequence="x"), at(2, "cash_merger", action_sequence="1", cash_out_value=3.0)]), UNTIL)
    assert {(r.action_sequence, r.status, r.cash) for r in found.collect()} == {(0, "unresolved_terminal_value", None), (1, "valid", 3.0)}


def test_adjusted_prices(spark):
    p = panel(spark, {"X": [10.0, 5.0, None, 6.0], "Y": [1.0, 2.0, 3.0, 4.0]})
    rows = [at(2, "split", split_ratio=2.0), at(9, "split", split_ratio=3.0), at(2, "split", "Z", split_ratio=3.0)]
    got = {(r.security, r.t): r for r in ca.adjusted(ca.index(p, ca.normalised(events(spark, rows), UNTIL))).collect()}
    assert got["X", 1].split_adjusted_close == 5 and got["X", 1].split_adjusted_volume == 200 and got["X", 4].split_adjusted_close == 6
    assert got["X", 2].daily_total_return == pytest.approx(0) and got["X", 3].daily_total_return is None
    assert [got["X", t].total_return_index for t in (1, 2, 3, 4)] == [1, pytest.approx(1), None, None]
    assert got["Y", 4].total_return_index == pytest.approx(4) and got["Y", 1].overnight_total_return is None
    empty = ca.index(p, ca.normalised(events(spark, []), UNTIL))
    assert empty.where(F.col("action_valid") & (F.col("split_index") == 1) & F.col("terminal_cash").isNull()).count() == 8
