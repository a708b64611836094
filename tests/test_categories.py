"""The categorical test against one pair by hand, and the tail against known values."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelforge.operators import categories as op

#: Upper 5 % and 1 % points of chi-square, from printed tables.
POINTS = {1: (3.841459, 6.634897), 2: (5.991465, 9.210340), 3: (7.814728, 11.344867), 4: (9.487729, 13.276704), 5: (11.070498, 15.086272), 10: (18.307038, 23.209251), 11: (19.675138, 24.724970), 30: (43.772972, 50.892181)}


def test_chi_square_tail(spark):
    rows = [(k, x, q) for k, xs in POINTS.items() for x, q in zip(xs, (0.05, 0.01))] + [(3, 0.0, 1.0), (4, -2.0, 1.0), (2, None, None), (0, 1.0, None)]
    df = spark.createDataFrame(rows, "k int, x double, want double")
    for r in df.withColumn("p", op.chi_square_p("x", "k")).collect():
        assert r.p == (pytest.approx(r.want, rel=2e-6) if r.want is not None else None), r


def by_hand(p, clusters):
    names = sorted(p.category.unique())
    k, n = len(names), len(p)
    d = np.column_stack([np.ones(n), *[(p.category == c).astype(float) for c in names[1:]]])
    bread = np.linalg.pinv(d.T @ d)
    beta = bread @ d.T @ p.y.to_numpy()
    res = p.y.to_numpy() - d @ beta
    out = []

    def cov(code):
        s = pd.DataFrame(d * res[:, None]).groupby(code).sum().to_numpy()
        g = len(s)
        return g / (g - 1) * (n - 1) / (n - k) * bread @ (s.T @ s) @ bread

    one = cov(p.session.to_numpy())
    both = one + cov(p.symbol.to_numpy()) - cov((p.session + p.symbol).to_numpy())
    for v in (one, both):
        out.append(beta[1:] @ np.linalg.pinv(v[1:, 1:]) @ beta[1:])
    return out


@pytest.mark.parametrize("k", [2, 4])
def test_wald_by_hand(spark, k):
    g = np.random.default_rng(k)
    n = 720
    p = pd.DataFrame({"feature": "f", "target": "t", "session": [f"d{i:02d}" for i in g.integers(0, 30, n)], "symbol": [f"s{i}" for i in g.integers(0, 8, n)], "category": [f"c{i}" for i in g.integers(0, k, n)], "y": g.normal(size=n)})
    p["y"] += p.session.map({s: v for s, v in zip(sorted(p.session.unique()), g.normal(size=30))})
    only = p.assign(feature="one", category="c0")
    none = p.head(9).assign(feature="nothing", category=None)
    found = {r.feature: r for r in op.screen(spark.createDataFrame(pd.concat([p, only])).unionByName(spark.createDataFrame(none, "feature string, target string, session string, symbol string, category string, y double"))).collect()}
    one, two = by_hand(p, None)
    assert found["f"].wald == pytest.approx(one, rel=1e-8) and found["f"].wald_two_way == pytest.approx(two, rel=1e-8) and found["f"].k == k
    assert found["one"].wald is None and found["one"].p is None and "nothing" not in found


def test_binary_statuses(spark):
    rows = []
    for name, values in (("good", [0, 1]), ("odd", [0, 1, 2]), ("same", [1])):
        rows += [(name, "t", f"d{i % 9}", f"s{i % 4}", i % 5, float(values[(i * 7 // 3) % len(values)]), float(i % 11)) for i in range(200)]
    rows += [("rare", "t", f"d{i % 9}", f"s{i % 4}", i % 5, float(i < 3), float(i % 11)) for i in range(200)]
    rows += [("one_day", "t", f"d{i // 60}", f"s{i % 4}", i % 5, float(i < 60), float(i % 11)) for i in range(180)]
    df = spark.createDataFrame(rows, "feature string, target string, session string, symbol string, slot int, x double, y double")
    got = {r.feature: r for r in op.binary_rows(df).collect()}
    assert {k: r.status for k, r in got.items()} == {"good": "binary_screened", "odd": "not_binary", "same": "constant_feature", "rare": "insufficient_data", "one_day": "insufficient_sessions"}
    assert got["good"].t is not None and got["odd"].t is None and got["good"].direction in (-1, 1)
