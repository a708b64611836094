"""Whitening of embeddings from an exact scatter matrix in residue numbers.

Components become integers, so the scatter is a sum of integer products. Every partition multiplies its block, reduced
by several primes, in double precision: the primes are so small that no sum of a block's products leaves the 53 bits a
double holds exactly. The sums of the residues meet in one aggregate, and Chinese remaindering gives the exact integers,
whose range the row count and the largest entry bound. A column of ones rides along, so counts and sums come out of the
same product. The centred covariance is then one exact integer fraction an entry, rounded once to a double.

Its eigenvectors come from a decomposition in double precision. ``identity_error`` is measured on the exact covariance.

What reaches the driver is a row for each prime and matrix entry, bounded by the dimension alone (``LARGEST_DIMENSION``).

Defined cases: rows without a vector, with an empty one, or with a null or non-finite component take no part, nor do
rows with a component whose integer leaves 62 bits, nor vectors of another length than most distinct vectors have (of
equally frequent ones the longest); without rows the result is empty; a component without variance (fewer distinct vectors than
dimensions, constant columns) has ``whitened`` null and no part in ``identity_error``; ``deviation`` is null where it
leaves 64 bits; repeated rows each get their rows but count once in the fit; clashing columns of the input are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, without

LARGEST_DIMENSION = 2048
BLOCK = 4096
PRIME_BITS = 20
OUT = ("component", "n", "deviation", "whitened", "explained", "identity_error")


def primes(bits_wanted: int) -> list[int]:
    """The largest primes below 2**20, as many as a product of more than ``bits_wanted`` bits needs."""
    out, at = [], (1 << PRIME_BITS) - 1
    while prod(out).bit_length() <= bits_wanted + 1:
        if all(at % d for d in range(3, int(at**0.5) + 1, 2)):
            out.append(at)
        at -= 2
    return out


def quantised(vector: str, scale: int, shift: int) -> Column:
    """floor(scale * c) + shift for every component, as longs; null for vectors that take no part."""
    limit = float(2**62)
    v = F.col(vector)
    good = v.isNotNull() & (F.size(v) > 0) & F.coalesce(F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double") * scale) < limit)), F.lit(False))
    return F.when(good, F.transform(v, lambda c: F.floor(c.cast("double") * scale).cast("long") + shift))


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as a matrix of longs."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def residues(moduli: list[int], d: int):
    """A mapper of Arrow batches: for each prime the upper half of [1 x]'[1 x] modulo it, once a partition."""
    i, j = (k.astype(np.int32) for k in np.triu_indices(d + 1))

    def run(batches):
        sums = {p: np.zeros((d + 1, d + 1)) for p in moduli}
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = matrix(batch.column(0).slice(at, BLOCK))
                for p in moduli:
                    r = np.concatenate((np.ones((len(part), 1)), np.mod(part, p)), axis=1)
                    sums[p] = np.mod(sums[p] + r.T @ r, p)  # at most 4,096 products below 2**40 and one sum: exact
        for p, s in sums.items():
            if s[0, 0] or s.any():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), p)), pa.array(i), pa.array(j), pa.array(s[i, j].astype(np.int64))], names=["p", "i", "j", "r"])

    return run


def scatter(distinct: DataFrame, moduli: list[int], d: int) -> np.ndarray:
    """[1 x]'[1 x] summed over all rows, exactly: residues of partitions are added, then joined by Chinese remaindering."""
    parts = distinct.mapInArrow(residues(moduli, d), "p long, i int, j int, r long")
    found = parts.groupBy("p", "i", "j").agg(F.sum("r").alias("r")).toArrow()
    of, i, j, r = (found.column(c).to_numpy() for c in ("p", "i", "j", "r"))
    whole = prod(moduli)
    out = np.zeros((d + 1, d + 1), object)
    for p in moduli:
        here = of == p
        out[i[here], j[here]] += (r[here] % p).astype(object) * (whole // p * pow(whole // p, -1, p))
    out %= whole
    out = np.where(2 * out > whole, out - whole, out)
    return np.triu(out) + np.triu(out, 1).T


@dataclass(frozen=True)
class Fit:
    """What every row needs: count, sums, the rows of the whitening map, and what the components explain."""

    n: int
    sums: tuple
    rows: np.ndarray
    explained: np.ndarray
    identity_error: float


def solve(total: np.ndarray, most: int) -> Fit:
    """The whitening of the ``most`` leading components of an exact scatter."""
    n, sums = total[0, 0], total[0, 1:]
    d = len(sums)
    v = ((n * total[1:, 1:] - np.outer(sums, sums)) / (n * n)).astype(float)
    e, u = np.linalg.eigh(v)
    top = max(float(e[-1]), 0.0)
    order = [k for k in range(d - 1, -1, -1) if e[k] > top * d * 2.0**-45][:most]
    rows = np.full((min(most, d), d), np.nan)
    rows[: len(order)] = (u[:, order] / np.sqrt(e[order])).T
    held = rows[: len(order)]
    error = float(np.abs(held @ v @ held.T - np.eye(len(order))).max()) if len(order) else 0.0
    trace = float(np.trace(v))
    explained = np.zeros(len(rows))
    explained[: len(order)] = e[order] / trace if trace else 0.0
    return Fit(n, tuple(sums), rows, explained, error)


def deviations(x: np.ndarray, n: int, sums: tuple) -> list:
    """sum((n * x - S)**2) of every row, exactly; null beyond a long."""
    top = max(n * abs(int(x.max())) + max(map(abs, sums)), n * abs(int(x.min())) + max(map(abs, sums)))
    if top < 2**62:
        gap = n * x - np.array(sums, np.int64)
        largest = int(np.abs(gap).max())
        if largest * largest * x.shape[1] < 2**63:
            return (gap * gap).sum(axis=1).tolist()
        gap = gap.astype(object)
    else:
        gap = n * x.astype(object) - np.array(sums, object)
    return [v if v < 2**63 else None for v in (gap * gap).sum(axis=1).tolist()]


def whiten(rows: DataFrame, *, vector: str = "embedding", keep: list[str] | None = None, most: int = 16, scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """A row for every row of ``rows`` that takes part and every component: ``keep`` (or all columns) with ``OUT``."""
    rest = without(rows, *OUT)
    kept = rest.columns if keep is None else [c for c in keep if c.lower() not in OUT]
    x = quantised(vector, scale, shift)
    distinct = cut(rows.select(x.alias("x")).where("x is not null").distinct())
    entry = F.aggregate("x", F.lit(0).cast("long"), lambda a, c: F.greatest(a, F.abs(c)))
    lengths = distinct.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.max(entry).alias("top"))
    usual = lengths.orderBy(F.desc("n"), F.desc("d")).first()
    shape = T.StructType([*rest.select(*[f"`{c}`" for c in kept]).schema.fields, *[T.StructField(c, t) for c, t in zip(OUT, (T.IntegerType(), T.LongType(), T.LongType(), T.DoubleType(), T.DoubleType(), T.DoubleType()))]])
    if usual is None:
        return rows.sparkSession.createDataFrame([], shape)
    d, n, top = usual
    if d > LARGEST_DIMENSION:
        raise ValueError(f"vectors of more than {LARGEST_DIMENSION} components")
    moduli = primes((n * max(top, 1) ** 2).bit_length() + 1)
    fit = solve(scatter(distinct.where(F.size("x") == d), moduli, d), most)

    def run(batches):
        mean = np.array([s // fit.n for s in fit.sums]), np.array([(s % fit.n) / fit.n for s in fit.sums])
        m = len(fit.rows)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                x = matrix(part.column(part.num_columns - 1))
                out = ((x - mean[0]) - mean[1]) @ fit.rows.T
                each = np.repeat(np.arange(len(x)), m)
                deviation = pa.array(deviations(x, fit.n, fit.sums), pa.int64()).take(pa.array(each))
                white = out.ravel()
                columns = [pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), len(x))), pa.array(np.full(len(each), fit.n)), deviation, pa.array(white, mask=np.isnan(white)), pa.array(np.tile(fit.explained, len(x))), pa.array(np.full(len(each), fit.identity_error))]
                yield pa.RecordBatch.from_arrays([*[c.take(pa.array(each)) for c in part.columns[:-1]], *columns], names=[*kept, *OUT])

    source = rows.select(*[F.col(f"`{c}`") for c in kept], x.alias("__x")).where(F.size("__x") == d)
    return source.mapInArrow(run, shape)
