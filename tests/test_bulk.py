"""The screen of all pairs against a pair-by-pair computation, and order statistics against sorting."""

import numpy as np
import pandas as pd
import pytest

from panelforge.operators import bulk, order


def panel(n=1500, seed=0):
    g = np.random.default_rng(seed)
    at = pd.DataFrame({"symbol": np.where(g.random(n) < 0.4, "HOT", [f"S{i}" for i in g.integers(0, 9, n)]), "session": [f"{2020 + i // 20}-01-{i % 20 + 1:02d}" for i in g.integers(0, 50, n)], "slot": g.integers(0, 12, n)})
    at["a"] = g.normal(size=n)
    at["b"] = 1e9 + 1e6 * g.normal(size=n)
    at["c"] = 5.0
    at["few"] = np.where(np.arange(n) < 20, g.normal(size=n), np.nan)
    at["ties"] = g.integers(0, 3, n).astype(float)
    at["y"] = 0.3 * at.a + g.normal(size=n)
    at["z"] = 1e-6 * g.normal(size=n)
    at.loc[::7, "a"], at.loc[::11, "y"], at.loc[5, "b"] = np.nan, np.nan, np.inf
    return at


def by_pair(at, x, y):
    p = at[np.isfinite(at[x]) & np.isfinite(at[y])]
    dx, dy = p[x] - p[x].mean(), p[y] - p[y].mean()
    b = (dx * dy).sum() / (dx * dx).sum()
    p = p.assign(s=dx * (dy - b * dx))
    n, v = len(p), {}
    for name, by in (("d", ["session"]), ("s", ["symbol"]), ("x", ["session", "symbol"])):
        s = p.groupby(by).s.sum()
        v[name] = len(s) / (len(s) - 1) * (n - 1) / (n - 2) * (s**2).sum() / (dx * dx).sum() ** 2
        if name == "d":
            se = np.sqrt((s**2).sum()) / (dx * dx).sum()
    two = np.sqrt(max(v["d"] + v["s"] - v["x"], 0))
    return {"n": n, "slope": b, "t": b / se, "t_two_way": b / two, "pearson": p[x].corr(p[y]), "n_sessions": p.session.nunique(), "n_symbols": p.symbol.nunique(), "n_decisions": len(p[["session", "slot"]].drop_duplicates()), "n_years": p.session.str[:4].nunique()}


@pytest.fixture(scope="module")
def found(spark):
    at = panel()
    wide = spark.createDataFrame(at.where(at.notna(), None)).repartition(5)
    names, goals = ["a", "b", "c", "few", "ties"], ["y", "z"]
    out = bulk.screen(wide, names, goals, edges=bulk.exact_edges(wide, names + goals), tasks=3, salts=3)
    return at, wide, {(r.feature, r.target): r for r in out.collect()}


def test_pairs_equal_one_by_one(found):
    at, _, rows = found
    assert len(rows) == 10
    for x in ("a", "b", "ties"):
        for y in ("y", "z"):
            want, r = by_pair(at, x, y), rows[x, y]
            assert r.status == "screened"
            for k, v in want.items():
                assert r[k] == pytest.approx(v, rel=1e-7), (x, y, k)
    for y in ("y", "z"):
        assert rows["c", y].status == "constant_feature" and rows["c", y].t is None
        assert rows["few", y].status == "insufficient_data" and rows["few", y].n <= 20


def test_deciles_and_rank_correlation(found):
    at, _, rows = found
    for x, y in (("a", "y"), ("ties", "z")):
        edges = {c: np.unique(np.quantile(at[c][np.isfinite(at[c])], np.arange(1, 100) / 100)) for c in (x, y)}
        p = at[np.isfinite(at[x]) & np.isfinite(at[y])]
        bx, by = np.searchsorted(edges[x], p[x]), np.searchsorted(edges[y], p[y])
        assert rows[x, y].spearman == pytest.approx(np.corrcoef(bx, by)[0, 1], abs=1e-9)
        means = p[y].groupby(np.minimum(bx, 99) // 10).mean()
        if {0, 9} <= set(means.index):
            assert rows[x, y].spread == pytest.approx(means[9] - means[0], rel=1e-9)
        if len(means) >= 3:
            assert rows[x, y].monotonicity == pytest.approx(pd.Series(means.index).rank().corr(means.reset_index(drop=True).rank()), abs=1e-9)


def test_merges_in_two_levels_and_any_dealing(found, spark):
    at, wide, rows = found
    out = bulk.screen(wide.repartition(40), ["a", "b"], ["y"], tasks=40, salts=1)
    for r in out.collect():
        assert r.t == pytest.approx(rows[r.feature, "y"].t, rel=1e-9) and r.t_two_way == pytest.approx(rows[r.feature, "y"].t_two_way, rel=1e-9)


def test_no_row_is_made_for_a_pair(found):
    _, wide, _ = found
    c = bulk.described(wide, ["a", "b"], ["y", "z"])
    plan = bulk.pair_sums(wide, c, 3)._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("MapInArrow") :]
    assert "Generate" not in below


def test_approximate_edges_are_near_exact_ranks(found):
    at, wide, _ = found
    edges = bulk.approximate_edges(wide, ["a", "b"])
    for c in ("a", "b"):
        x = np.sort(at[c][np.isfinite(at[c])])
        rank = np.searchsorted(x, edges[c], side="right") / len(x)
        assert np.abs(rank - np.arange(1, 100) / 100).max() < 0.005


def test_empty(spark):
    wide = spark.createDataFrame([], "symbol string, session string, slot int, a double, y double")
    assert bulk.screen(wide, ["a"], ["y"], edges=bulk.exact_edges(wide, ["a", "y"]), tasks=2).count() == 0
    with pytest.raises(ValueError):
        bulk.described(wide, ["a"] * 3000, ["y"] * 2000)


def test_order_statistics(spark):
    g = np.random.default_rng(0)
    rows = []
    for name, n, kind in (("one", 1, 0), ("two", 2, 0), ("seven", 7, 0), ("many", 3000, 0), ("ties", 2500, 1), ("same", 1200, 2)):
        x = g.normal(size=n) if kind == 0 else g.integers(0, 3, n).astype(float) if kind == 1 else np.zeros(n)
        rows += [(name, float(v), f"s{int(g.integers(40)):02d}", i) for i, v in enumerate(x)]
    p = pd.DataFrame(rows, columns=["g", "x", "session", "k"]).sort_values(["g", "x", "session", "k"])
    df = spark.createDataFrame(p).repartition(5)
    p["r"], p["n"] = p.groupby("g").cumcount() + 1, p.groupby("g").x.transform("size")
    p["want"] = np.where(p.n > 1, np.maximum(np.ceil((p.r - 1) * 10 / np.maximum(p.n - 1, 1)) - 1, 0), 0).astype(int)
    m = p.merge(order.bins(df, ["g"], "x", ["session", "k"], order.qcut_last(10)).toPandas(), on=["g", "x", "session", "k"])
    assert len(m) == len(p) and (m.bin == m.want).all()
    p["want"] = np.minimum(np.floor((p.r - 1) * 10 / p.n), 9).astype(int)
    m = p.merge(order.bins(df, ["g"], "x", ["session", "k"], order.floor_last(10)).toPandas(), on=["g", "x", "session", "k"])
    assert (m.bin == m.want).all()
    shares = [0.0, 0.001, 0.01, 0.25, 0.5, 0.99, 1.0]
    for r in order.quantiles(df, ["g"], "x", shares).collect():
        assert np.allclose(r.quantiles, np.quantile(p[p.g == r.g].x, shares), rtol=1e-12, atol=1e-12)
    a = order.average_ranks(df, ["g"], "x", "rx").toPandas()
    assert (a.groupby("g").x.rank() == a.rx).all()


def test_approximate_ranks_are_exact_in_small_groups(spark):
    g = np.random.default_rng(3)
    rows = [(name, float(x), float(0.3 * x + y)) for name, n in (("one", 1), ("three", 3), ("four", 4), ("thirty", 30), ("many", 20_000)) for x, y in g.normal(size=(n, 2))]
    rows += [("ties", float(x), float(y)) for x, y in g.integers(0, 4, (5000, 2))] + [("same", 1.0, float(y)) for y in range(9)]
    df = spark.createDataFrame(rows, "g string, x double, y double").repartition(5)
    got = order.approximate_ranks(order.approximate_ranks(df, ["g"], "x", "rx"), ["g"], "y", "ry").toPandas()
    assert len(got) == len(rows)
    for name, part in got.groupby("g"):
        off = (part.x.rank() - part.rx).abs().max()
        assert off < 0.01 * len(part) if name == "many" else off == 0, name
        if name not in ("one", "same"):
            assert abs(part.rx.corr(part.ry) - part.x.rank().corr(part.y.rank())) < (0.001 if name == "many" else 1e-9), name


def test_no_window_over_a_group(spark):
    df = spark.createDataFrame([("a", 1.0, "s", 1)], "g string, x double, session string, k int")
    plan = order.bins(df, ["g"], "x", ["session", "k"], order.qcut_last(10))._jdf.queryExecution().optimizedPlan().toString()
    for line in (w for w in plan.splitlines() if "Window [" in w):
        assert "bucket" in line, line
