"""Whether a category of rows tells targets apart: Wald test of equal means under one-way and two-way clustered errors.

Rows are summed once to cells of session, symbol and category. An error's cluster sums of a pair are products of its
categories' scores, so Spark adds up one small matrix a pair and clustering; only its inverse is taken by a helper."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.columns import div
from panelforge.operators.screening import PAIR, normal_p


def chi_square_p(x: str, k: str) -> Column:
    """Upper tail of chi-square with a whole number k of degrees: the regularised incomplete gamma function, which is a finite
    sum for whole and half orders. 1 at and below 0, null without x or for k < 1."""
    v, n = F.greatest(F.col(x), F.lit(0.0)), F.col(k)
    odd = n % 2 == 1
    tail = F.when(v > 0, normal_p(F.sqrt(v))).otherwise(1.0)
    # terms: h^i / i! for even k; h^(i - 1/2) / gamma(i + 1/2) for odd k, each from the one before
    h = v / 2
    first = F.when(odd, 2 * F.sqrt(h / math.pi)).otherwise(F.lit(1.0))
    steps = F.when(n >= 4, F.sequence(F.lit(1), F.floor(n / 2).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    total = F.aggregate(
        steps, F.struct(first.alias("term"), first.alias("sum")),
        lambda s, i: F.struct((s.term * h / F.when(odd, i + 0.5).otherwise(i)).alias("term"), (s.sum + s.term * h / F.when(odd, i + 0.5).otherwise(i)).alias("sum")), lambda s: s.sum,
    )
    rest = F.when(n == 1, F.lit(0.0)).otherwise(F.exp(-h) * total)
    return F.when(F.col(x).isNotNull() & (n >= 1), F.least(F.lit(1.0), F.when(odd, tail + rest).otherwise(rest)))


def score_products(cells: DataFrame, by: list[str], name: str) -> DataFrame:
    """(PAIR, a, b, name): sums over clusters of the products of two categories' scores, with the clusters' correction."""
    s = cells.groupBy(*PAIR, *by, "category").agg(F.sum("score").alias("score"))
    groups = s.groupBy(*PAIR, *by).agg(F.collect_list(F.struct("category", "score")).alias("c"))
    both = groups.select(*PAIR, F.explode("c").alias("x"), "c").select(*PAIR, "x", F.explode("c").alias("y"))
    products = both.groupBy(*PAIR, F.col("x.category").alias("a"), F.col("y.category").alias("b")).agg(F.sum(F.col("x.score") * F.col("y.score")).alias(name))
    count = groups.groupBy(*PAIR).agg(F.count(F.lit(1)).alias(f"g_{name}"))
    return products.join(count, PAIR)


def screen(pairs: DataFrame, category: str = "category") -> DataFrame:
    """A row a pair: rows, categories, range of means, and both statistics with their p. One category gives nulls."""
    base = pairs.where(F.col(category).isNotNull()).withColumn("category", F.col(category).cast("string"))
    cells = base.groupBy(*PAIR, "session", "symbol", "category").agg(F.count(F.lit(1)).alias("m"), F.sum("y").alias("sy"))
    part = Window.partitionBy(*PAIR, "category")
    cells = cells.withColumn("total", F.sum("m").over(part)).withColumn("mean", F.sum("sy").over(part) / F.col("total"))
    cells = cells.withColumn("score", (F.col("sy") - F.col("m") * F.col("mean")) / F.col("total"))
    means = cells.groupBy(*PAIR, "category").agg(F.max("total").alias("m"), F.max("mean").alias("mean"))
    parts = [score_products(cells, by, n) for n, by in (("d", ["session"]), ("s", ["symbol"]), ("x", ["session", "symbol"]))]
    entries = parts[0]
    for p in parts[1:]:
        entries = entries.join(p, [*PAIR, "a", "b"], "full")
    entries = entries.join(means.select(*PAIR, F.col("category").alias("a"), F.col("m").alias("n_a"), "mean"), [*PAIR, "a"])

    def solve(g: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(g.a) | set(g.b))
        at = {c: i for i, c in enumerate(names)}
        k = len(names)
        own = g.drop_duplicates("a").set_index("a")
        mean, n = own["mean"][names].to_numpy(), int(own["n_a"].sum())
        v = {}
        for c in "dsx":
            m = np.zeros((k, k))
            m[g.a.map(at), g.b.map(at)] = g[c].fillna(0.0)
            groups = float(g[f"g_{c}"].max())
            v[c] = m * (groups / (groups - 1) * (n - 1) / (n - k) if groups > 1 and n > k else 1.0)
        contrast = np.hstack([-np.ones((k - 1, 1)), np.eye(k - 1)])
        effect = contrast @ mean
        wald = [float(effect @ np.linalg.pinv(contrast @ m @ contrast.T) @ effect) if k > 1 else None for m in (v["d"], v["d"] + v["s"] - v["x"])]
        return pd.DataFrame({"feature": [g.feature.iloc[0]], "target": [g.target.iloc[0]], "n": [n], "k": [k], "range": [float(mean.max() - mean.min())], "wald": wald[:1], "wald_two_way": wald[1:]})

    out = entries.groupBy(*PAIR).applyInPandas(solve, "feature string, target string, n long, k long, range double, wald double, wald_two_way double")
    out = out.withColumn("df", F.col("k") - 1)
    return out.withColumn("p", chi_square_p("wald", "df")).withColumn("p_two_way", chi_square_p("wald_two_way", "df"))


def binary_rows(pairs: DataFrame, sessions: int = 2, least: int = 30) -> DataFrame:
    """The binary screen: on and off means, both clusterings' t and p, and why a pair is not screened: values other than 0 and
    1, too few rows on or off, or too few sessions on either side."""
    from panelforge.operators.screening import binary_effect, clustered_screen

    e = binary_effect(pairs)
    status = F.when(F.col("n_bad") > 0, "not_binary").when((F.col("n_on") == 0) | (F.col("n_off") == 0), "constant_feature").when((F.col("n_on") < least) | (F.col("n_off") < least), "insufficient_data").when((F.col("on_sessions") < sessions) | (F.col("off_sessions") < sessions), "insufficient_sessions").otherwise("binary_screened")
    t = clustered_screen(pairs).select(*PAIR, "se", "t", "p", "se_two_way", "t_two_way", "p_two_way")
    out = e.withColumn("status", status).join(t, PAIR, "left")
    ok = F.col("status") == "binary_screened"
    return out.select(*PAIR, "status", "n_on", "n_off", "on_sessions", "off_sessions", "mean_on", "mean_off", *[F.when(ok, F.col(c)).alias(c) for c in ("effect", "activation", "se", "t", "p", "se_two_way", "t_two_way", "p_two_way")], F.when(ok, div("effect", F.abs("effect"))).alias("direction"))
