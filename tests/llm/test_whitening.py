"""Whitening held against exact rational arithmetic on small tables."""

import math
from fractions import Fraction

import numpy as np

from panelforge.llm import queries, whitening
from panelforge.llm.common import table

SF = "/root/testdata/sf0.001"


def plain(vectors, most=16):
    """(n, deviation, |whitened|, explained) by rational sums and one decomposition."""
    x = [[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors]
    fit = sorted(set(map(tuple, x)))
    n, d = len(fit), len(fit[0])
    sums = [sum(r[i] for r in fit) for i in range(d)]
    cov = np.array([[float(Fraction(sum((n * r[i] - sums[i]) * (n * r[j] - sums[j]) for r in fit), n**3)) for j in range(d)] for i in range(d)])
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:most], u[:, ::-1][:, :most]
    centred = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(r, sums)] for r in x])
    return n, [sum((n * c - s) ** 2 for c, s in zip(r, sums)) for r in x], centred @ u / np.sqrt(e), e / np.trace(cov)


def by_row(df, key="vec_id"):
    out = {}
    for r in df.collect():
        out.setdefault(r[key], {})[r.component] = r
    return out


def check(found, keys, vectors):
    n, deviation, white, explained = plain(vectors)
    signs = {}
    assert set(found) == set(keys)
    for k, dev, w in zip(keys, deviation, white):
        rows = found[k]
        assert len(rows) == len(w)
        for c, value in enumerate(w, 1):
            r = rows[c]
            assert (r.n, r.deviation) == (n, dev) and r.identity_error <= 1e-9
            assert abs(r.explained - explained[c - 1]) <= 1e-9 * explained[c - 1]
            if abs(value) > 1e-3:
                signs.setdefault(c, np.sign(r.whitened * value))
            assert abs(r.whitened * signs.get(c, 1) - value) < 1e-6


def test_query_equals_rational_sums(spark):
    rows = table(spark, SF, "embeddings").collect()
    check(by_row(queries.op12_residue_whitening(spark, SF)), [r.vec_id for r in rows], [r.embedding for r in rows])


def test_odd_rows(spark):
    g = np.random.default_rng(1)
    vectors = [[float(a), float(3 * b + a), float(c) / 9] for a, b, c in g.normal(size=(60, 3))]
    rows = [(i, v, "x") for i, v in enumerate(vectors)] + [(100 + i, vectors[0], "x") for i in range(200)]
    odd = [None, [], [1.0, None, 2.0], [1.0, float("nan"), 2.0], [float("inf"), 1.0, 2.0], [1.0, 2.0], [1e300, 0.0, 0.0]]
    rows += [(1000 + i, v, "x") for i, v in enumerate(odd)] + [(None, vectors[3], None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n string").repartition(7)
    out = whitening.whiten(df)
    assert out.columns == ["vec_id", "embedding", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    good = [r for r in rows if r[0] is None or r[0] < 1000]
    check(by_row(out), [r[0] for r in good], [r[1] for r in good])
    assert whitening.whiten(df.where("vec_id >= 1000 and vec_id < 1004")).count() == 0
    assert whitening.whiten(df.limit(0)).count() == 0


def test_without_variance(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 4.0]), (3, [1.0, 4.0])], "vec_id long, embedding array<float>")
    found = by_row(whitening.whiten(df))
    assert all(r[2].whitened is None and r[2].explained == 0 and abs(abs(r[1].whitened) - 1) < 1e-12 for r in found.values())
    one = whitening.whiten(df.where("vec_id = 1")).collect()
    assert len(one) == 2 and all(r.whitened is None and r.deviation == 0 and r.n == 1 for r in one)


def test_large_entries_stay_exact(spark):
    """Entries of 50 bits: sums of squares leave 64 bits, the scatter does not round."""
    g = np.random.default_rng(2)
    vectors = [[float(2**44 + a * 1000), float(b)] for a, b in g.normal(size=(300, 2))]
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>").repartition(5)
    found = by_row(whitening.whiten(df))
    n, deviation, white, _ = plain(vectors)
    for i, (dev, w) in enumerate(zip(deviation, white)):
        assert found[i][1].deviation == (dev if dev < 2**63 else None) and found[i][1].n == n
        assert abs(abs(found[i][1].whitened) - abs(w[0])) < 1e-6


def test_primes_cover_the_range():
    for bits in (1, 20, 60, 61, 126, 170):
        found = whitening.primes(bits)
        assert math.prod(found) > 2 ** (bits + 1) and max(found) ** 2 * whitening.BLOCK + max(found) < 2**53
        assert all(p % d for p in found for d in range(2, 1 + math.isqrt(p)))
