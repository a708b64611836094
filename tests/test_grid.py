"""The pair grid against series and errors computed one by one."""

import numpy as np
import pandas as pd
import pytest

from panelforge.operators import grid


def newey_west(values, lag):
    s = np.asarray(values, float)
    ok = np.isfinite(s)
    n = ok.sum()
    if n < max(20, lag + 5):
        return None
    d = s - s[ok].mean()
    lag = min(lag, len(s) - 1)
    v = np.nanmean(d * d)
    for k in range(1, lag + 1):
        both = d[k:] * d[:-k]
        if np.isfinite(both).any():
            v += 2 * (1 - k / (lag + 1)) * np.nanmean(both)
    if v < -1e-12:
        return None
    se = np.sqrt(max(v, 0) / n)
    return s[ok].mean(), se


def test_errors_by_calendar_with_gaps(spark):
    g = np.random.default_rng(0)
    rows, want = [], {}
    for name, keep, lag in (("whole", 1.0, 5), ("gaps", 0.6, 5), ("long", 0.8, 12), ("short", 0.2, 5)):
        s = np.where(g.random(70) < keep, g.normal(size=70).cumsum() / 5, np.nan)
        rows += [(name, t + 1, None if np.isnan(v) else float(v), lag) for t, v in enumerate(s)]
        want[name] = newey_west(s, lag)
    df = spark.createDataFrame(rows, "k string, t int, e double, lag int")
    for k, lag in (("whole", 5), ("gaps", 5), ("long", 12), ("short", 5)):
        r = grid.mean_tests(df.where(f"k = '{k}'"), ["k"], "e", grid.F.lit(lag), 12, 70).first()
        if want[k] is None:
            assert r.effect is None and r.t is None and r.p is None
        else:
            assert (r.effect, r.se) == (pytest.approx(want[k][0]), pytest.approx(want[k][1]))


def test_series_of_a_pair(spark):
    g = np.random.default_rng(1)
    n = 60
    rows = []
    for t in range(1, 4):
        x, y = g.normal(size=n).round(1), g.normal(size=n)
        y[: 10 * t] = np.nan if t > 1 else y[: 10 * t]
        rows += [(i, t, float(a), None if np.isnan(b) else float(b)) for i, (a, b) in enumerate(zip(x, y))]
    rows += [(i, 4, 1.0, 2.0) for i in range(n)] + [(i, 5, float(i), 1.0) for i in range(4)]
    df = spark.createDataFrame(rows, "security long, t int, x double, y double").repartition(3)
    gates = grid.Gates(ranked=10, decile=20, quintile=20, ic=10, extreme=2, quintile_extreme=2)
    found = {r.t: r for r in grid.daily_series(df, ["x"], ["y"], gates).collect()}
    p = pd.DataFrame(rows, columns=["security", "t", "x", "y"])
    for t in (1, 2, 3):
        d = p[p.t == t].sort_values(["x", "security"]).reset_index(drop=True)
        d["bin"], d["fifth"] = d.index // 6, d.index // 12
        both = d.dropna()
        assert found[t].rank_ic == pytest.approx(both.x.rank().corr(both.y.rank()))
        cover = both.groupby("bin").size().reindex(range(10), fill_value=0) / 6
        mean = both.groupby("bin").y.mean()
        ok = cover[0] >= 0.5 and cover[9] >= 0.5
        assert found[t].top_coverage == pytest.approx(cover[9]) and found[t].bottom_coverage == pytest.approx(cover[0])
        assert found[t].top_minus_bottom_decile == (pytest.approx(mean[9] - mean[0]) if ok else None)
        middle = both[both.bin.between(1, 8)]
        middle_ok = len(middle) / 48 >= 0.75
        assert found[t].top_decile_minus_middle == (pytest.approx(mean[9] - middle.y.mean()) if middle_ok and cover[9] >= 0.5 else None)
    assert found[4].rank_ic is None and found[4].top_minus_bottom_decile is None and found[4].quintile_spread is None
    assert found[5].rank_ic is None and found[5].ic_size == 0
