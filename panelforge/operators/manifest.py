"""Declared features compiled to one plan: a manifest names features, each an operation on columns or other features.

Compiling checks the graph, gives every feature a hash of what it computes (its operation, parameters and the hashes of
its inputs, so names do not matter), computes equal ones once, and orders the rest in stages. A stage adds all features
whose inputs are there and that need the same window, so Spark sorts a window's rows once for all of them, and features
that build on each other within a series stay on rows that are sorted already."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.functions.columns import div, enough, pct_rank, trailing

from .intraday import S, segments

DECISION = ["session", "slot"]


@dataclass(frozen=True)
class Feature:
    """``op`` of ``inputs`` with whole-number or real parameters; ``name`` is the column that it becomes."""

    name: str
    op: str
    inputs: tuple[str, ...]
    n: int = 0
    edge: float = 0.0


def _rolling(f):
    return lambda x, p: enough(x[0], trailing(S(), p.n), p.n, f(x[0]).over(trailing(S(), p.n)))


def _held(x: Column, n: int) -> Column:
    """1 where a condition held on each of the last n rows of its series, 0 where not, null where one is unknown."""
    w = trailing(S(), n)
    return F.when(F.count(x).over(w) >= n, F.min(x).over(w))


#: Kind of window ("" none, "series" along a segment, "decision" across symbols), number of inputs, and the expression.
OPERATIONS = {
    "lag": ("series", 1, lambda x, p: F.lag(x[0], p.n).over(S())),
    "return": ("series", 1, lambda x, p: div(x[0], F.lag(x[0], p.n).over(S())) - 1),
    "mean": ("series", 1, _rolling(F.avg)), "std": ("series", 1, _rolling(F.stddev_samp)), "sum": ("series", 1, _rolling(F.sum)), "max": ("series", 1, _rolling(F.max)), "min": ("series", 1, _rolling(F.min)),
    "persistence": ("series", 1, lambda x, p: _held(x[0], p.n)),
    "rank": ("decision", 1, None),
    "ratio": ("", 2, lambda x, p: div(x[0], x[1])), "difference": ("", 2, lambda x, p: x[0] - x[1]), "product": ("", 2, lambda x, p: x[0] * x[1]),
    "centred": ("", 1, lambda x, p: 2 * x[0] - 1),
    "above": ("", 1, lambda x, p: (x[0] >= p.edge).cast("double")), "below": ("", 1, lambda x, p: (x[0] <= p.edge).cast("double")),
    "intersection": ("", 2, lambda x, p: F.when(x[0].isNotNull() & x[1].isNotNull(), x[0] * x[1])),
    "gated": ("", 2, lambda x, p: F.when(x[1] == 1, x[0])),
    "aligned_mean": ("", 2, lambda x, p: (x[0] + x[1]) / 2),
}


@dataclass(frozen=True)
class Compiled:
    """Stages of (window, features to compute), the column that stands for each name, the features' hashes and the whole's."""

    stages: tuple[tuple[str, tuple[Feature, ...]], ...]
    stands: dict[str, str]
    hashes: dict[str, str]
    mark: str


def compiled(features: list[Feature], columns: set[str]) -> Compiled:
    """Raises on repeated or unknown names, unknown operations, wrong numbers of inputs and circles."""
    by_name = {f.name: f for f in features}
    if len(by_name) < len(features) or columns & set(by_name):
        raise ValueError("a name is given twice")
    hashes: dict[str, str] = {}

    def visit(name: str, above: tuple) -> str:
        if name in columns:
            return name
        if name not in by_name:
            raise ValueError(f"{above[-1]} asks for {name}, which nothing makes")
        if name in above:
            raise ValueError(f"a circle: {' <- '.join((*above, name))}")
        if name not in hashes:
            f = by_name[name]
            if f.op not in OPERATIONS or len(f.inputs) != OPERATIONS[f.op][1]:
                raise ValueError(f"{name}: {f.op} of {len(f.inputs)} inputs")
            parts = [f.op, f.n, f.edge, [visit(i, (*above, name)) for i in f.inputs]]
            hashes[name] = hashlib.sha256(json.dumps(parts).encode()).hexdigest()
        return hashes[name]

    for f in features:
        visit(f.name, ())
    first: dict[str, str] = {}
    stands = {f.name: first.setdefault(hashes[f.name], f.name) for f in features}
    waiting = [by_name[n] for n in dict.fromkeys(stands.values())]
    ready, stages, kind = set(columns), [], ""
    while waiting:
        open_ = [f for f in waiting if all(stands.get(i, i) in ready for i in f.inputs)]
        kinds = [OPERATIONS[f.op][0] for f in open_]
        # what needs no window first, then more of the window at hand, then the other
        kind = "" if "" in kinds else kind if kind in kinds else kinds[0]
        now = tuple(f for f, k in zip(open_, kinds, strict=True) if k == kind)
        stages.append((kind, now))
        ready |= {f.name for f in now}
        waiting = [f for f in waiting if f not in now]
    mark = hashlib.sha256(json.dumps(sorted(hashes.items())).encode()).hexdigest()
    return Compiled(tuple(stages), stands, hashes, mark)


def run(bars: DataFrame, features: list[Feature]) -> DataFrame:
    """The features of bars by key, in one plan; a name that repeats another's content is a copy of its column."""
    rows = segments(bars)
    plan = compiled(features, set(bars.columns))
    for _, stage in plan.stages:
        made = []
        for f in stage:
            inputs = [plan.stands.get(i, i) for i in f.inputs]
            made.append((pct_rank(inputs[0], DECISION) if f.op == "rank" else OPERATIONS[f.op][2]([F.col(i) for i in inputs], f)).alias(f.name))
        rows = rows.select("*", *made)
    return rows.select("symbol", *DECISION, *[F.col(plan.stands[f.name]).alias(f.name) for f in features])
