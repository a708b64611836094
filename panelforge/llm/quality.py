"""Quality: a sparse ensemble of rules over text statistics.

Statistics of every whole text come from vectorised byte counts. On a bounded sample of labelled documents small
regression trees are boosted over quantile bins; every path from a root to a node is a conjunctive rule. A logistic
regression with a lasso penalty weighs the rules (standardised, by accelerated proximal gradient), most weights become
zero, and what remains is compiled to one Spark column expression, so scoring is a projection.

Defined cases: a null or empty text has statistics of zero and is scored by the same rules; a document is read whole
whatever its length; with no labelled document, or labels of one kind only, every score is the share of that label
(0.5 without any); clashing columns of the input are replaced; repeated rows score alike.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytewords import Slice, slices, text_bytes
from .common import without
from .labelled import fitted, training_sample

#: Byte classes of the statistics: members of each class.
CLASSES = {
    "upper": bytes(range(0x41, 0x5B)),
    "lower": bytes(range(0x61, 0x7B)),
    "digit": bytes(range(0x30, 0x3A)),
    "stop": b".?",
    "comma": b",;:",
    "bang": b"!",
    "mark": b"#$%&*@^~_=+<>/\\",
    "bar": b"|",
    "quote": b"\"'()[]{}-",
    "high": bytes(range(0x80, 0x100)),
}
STATS = (
    "chars", "words", "lines", *(f"{c}_rate" for c in CLASSES), "word_length", "longest_word", "short_words", "line_words", "longest_line",
    "short_lines", "distinct_words", "top_word", "distinct_lines", "adjacent_repeats", "marked_words", "capital_words", "stopped_lines", "entropy",
)
OUT = ("score", "predicted")


def _rates(s: Slice, raw: np.ndarray) -> np.ndarray:
    """Statistics of the documents of a slice, one row each. ``raw``: the bytes before white space was folded."""
    docs, bounds = s.docs, s.bounds
    size = np.diff(bounds).astype(np.float64)
    full = np.flatnonzero(size)
    out = np.zeros((docs, len(STATS)))
    col = {n: i for i, n in enumerate(STATS)}
    if not len(full):
        return out
    at = bounds[:-1][full]

    def per_doc(x, dtype=np.int64):
        v = np.zeros(docs)
        v[full] = np.add.reduceat(x, at, dtype=dtype)
        return v

    safe = np.maximum(size, 1)
    cont = per_doc((raw & 0xC0) == 0x80)
    chars = size - cont
    out[:, col["chars"]] = chars
    for c, members in CLASSES.items():
        table = np.zeros(256, bool)
        table[list(members)] = True
        out[:, col[f"{c}_rate"]] = per_doc(table[raw]) / safe
    words = s.words.astype(np.float64)
    wsafe = np.maximum(words, 1)
    length = s.ends - s.starts
    out[:, col["words"]] = words
    newline = raw == 0x0A
    lines = per_doc(newline) + (size > 0)
    out[:, col["lines"]] = lines
    has = np.flatnonzero(s.words)
    wat = s.cuts[:-1][has]

    def per_word(x, ufunc=np.add):
        v = np.zeros(docs)
        if len(has):
            v[has] = ufunc.reduceat(x, wat, dtype=np.int64)
        return v

    out[:, col["word_length"]] = per_word(length) / wsafe
    out[:, col["longest_word"]] = per_word(length, np.maximum)
    out[:, col["short_words"]] = per_word(length <= 3) / wsafe
    first, last = raw[s.starts], raw[s.ends - 1]
    letter = np.zeros(256, bool)
    letter[list(CLASSES["upper"] + CLASSES["lower"] + CLASSES["digit"] + CLASSES["stop"] + CLASSES["comma"] + CLASSES["quote"] + CLASSES["high"])] = True
    out[:, col["marked_words"]] = per_word(~letter[last] | ~letter[first]) / wsafe
    out[:, col["capital_words"]] = per_word((first >= 0x41) & (first <= 0x5A)) / wsafe
    own, h = s.owners(), s.hashes()[0]
    repeats = np.zeros(len(h), bool)
    repeats[1:] = (h[1:] == h[:-1]) & (own[1:] == own[:-1])
    out[:, col["adjacent_repeats"]] = per_word(repeats) / wsafe
    order = np.lexsort((h, own))
    ho, oo = h[order], own[order]
    start = np.flatnonzero(np.concatenate(([True], (ho[1:] != ho[:-1]) | (oo[1:] != oo[:-1])))) if len(h) else np.zeros(0, int)
    count = np.diff(np.concatenate((start, [len(h)])))
    if len(start):
        who = oo[start]
        out[:, col["distinct_words"]] = np.bincount(who, minlength=docs) / wsafe
        top = np.zeros(docs)
        np.maximum.at(top, who, count)
        out[:, col["top_word"]] = top / wsafe
        p = count / wsafe[who]
        out[:, col["entropy"]] = np.bincount(who, -p * np.log(p), docs)
    # lines: a hash of each from the sums over bytes, and its words
    begins = np.concatenate((bounds[:-1][full], np.flatnonzero(newline) + 1))
    begins = np.unique(begins[begins < len(raw)]) if len(raw) else begins
    finish = np.concatenate((begins[1:], [len(raw)]))
    sums, down = s.sums()
    lh = (sums[finish] - sums[begins]) * down[begins]
    lo = np.searchsorted(bounds, begins, "right") - 1
    in_line = np.searchsorted(s.starts, finish) - np.searchsorted(s.starts, begins)
    lcount = np.maximum(np.bincount(lo, minlength=docs), 1)
    pairs = np.unique(np.stack((lo.astype(np.uint64), lh)), axis=1)
    out[:, col["distinct_lines"]] = np.bincount(pairs[0].astype(np.int64), minlength=docs) / lcount
    out[:, col["line_words"]] = words / np.maximum(lines, 1)
    long = np.zeros(docs)
    np.maximum.at(long, lo, in_line)
    out[:, col["longest_line"]] = long
    out[:, col["short_lines"]] = np.bincount(lo, in_line < 4, docs) / lcount
    ended = raw[np.maximum(finish - 1, 0)] == 0x0A
    tail = raw[np.maximum(finish - 1 - ended, 0)]
    out[:, col["stopped_lines"]] = np.bincount(lo, np.isin(tail, np.frombuffer(CLASSES["stop"], np.uint8)), docs) / lcount
    return out


def statistics(column: pa.Array) -> np.ndarray:
    """One row of STATS for each text."""
    data, offsets = text_bytes(column)
    parts = [_rates(s, data[offsets[s.first] : offsets[s.first + s.docs]]) for s in slices(column)]
    return np.concatenate(parts) if parts else np.zeros((0, len(STATS)))


Condition = tuple[int, bool, float]  # statistic, True for "at most" (else "above"), bound


def edges_of(x: np.ndarray, bins: int = 32) -> list[np.ndarray]:
    return [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(x.shape[1])]


def grow(codes: np.ndarray, edges: list[np.ndarray], g: np.ndarray, h: np.ndarray, columns: np.ndarray, depth: int, least: int, path: tuple = (), rows: np.ndarray | None = None):
    """A tree over binned statistics; returns (value per row, list of paths to nodes)."""
    rows = np.arange(len(g)) if rows is None else rows
    value = np.zeros(len(g))
    G, H = g[rows].sum(), h[rows].sum()
    leaf = -G / (H + 1.0)
    found = [path] if path else []
    best = (1e-6, None)
    if len(path) < depth and len(rows) >= 2 * least:
        for j in columns:
            k = len(edges[j]) + 1
            if k < 2:
                continue
            c = codes[rows, j]
            gs, hs, ns = np.cumsum(np.bincount(c, g[rows], k))[:-1], np.cumsum(np.bincount(c, h[rows], k))[:-1], np.cumsum(np.bincount(c, minlength=k))[:-1]
            ok = (ns >= least) & (len(rows) - ns >= least)
            gain = np.where(ok, gs**2 / (hs + 1) + (G - gs) ** 2 / (H - hs + 1) - G**2 / (H + 1), -1)
            i = int(gain.argmax())
            if gain[i] > best[0]:
                best = (gain[i], (j, i))
    if best[1] is None:
        value[rows] = leaf
        return value, found
    j, i = best[1]
    left = codes[rows, j] <= i
    for part, at_most in ((rows[left], True), (rows[~left], False)):
        v, p = grow(codes, edges, g, h, columns, depth, least, (*path, (int(j), at_most, float(edges[j][i]))), part)
        value[part] = v[part]
        found += p
    return value, found


def holds(rule: tuple[Condition, ...], x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for j, at_most, bound in rule:
        out &= (x[:, j] <= bound) == at_most
    return out


def simplified(rule: tuple[Condition, ...]) -> tuple[Condition, ...]:
    """The tightest bound of each statistic and direction, in a fixed order."""
    bounds: dict[tuple[int, bool], float] = {}
    for j, at_most, b in rule:
        old = bounds.get((j, at_most), b)
        bounds[j, at_most] = min(old, b) if at_most else max(old, b)
    return tuple(sorted((j, m, b) for (j, m), b in bounds.items()))


def lasso_logistic(z: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and intercept of an L1-penalised logistic regression on standardised columns."""
    n, k = z.shape
    w, b, u, ub, t = np.zeros(k), 0.0, np.zeros(k), 0.0, 1.0
    limit = 0.25 * (np.linalg.norm(z, 2) ** 2 / n + 1)
    for _ in range(steps):
        r = 1 / (1 + np.exp(-np.clip(z @ u + ub, -30, 30))) - y
        nw = u - (z.T @ r) / n / limit
        nw = np.sign(nw) * np.maximum(np.abs(nw) - penalty / limit, 0)
        nb = ub - r.mean() / limit
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        u, ub = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return w, float(b)


@dataclass
class Rules:
    """Rules with weights, and the intercept; a score is the logistic of the sum."""

    rules: list[tuple[tuple[Condition, ...], float]]
    intercept: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for rule, w in self.rules:
            z += w * holds(rule, x)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def column(self) -> Column:
        """The score as an expression over the columns STATS."""
        z = F.lit(self.intercept)
        for rule, w in self.rules:
            test = F.lit(True)
            for j, at_most, bound in rule:
                c = F.col(STATS[j])
                test = test & (c <= F.lit(bound) if at_most else c > F.lit(bound))
            z = z + F.when(test, F.lit(w)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))


def fit(x: np.ndarray, y: np.ndarray, *, trees: int = 40, depth: int = 3, rate: float = 0.2, penalty: float = 0.002, seed: int = 11) -> Rules:
    if not len(y) or y.min() == y.max():
        share = float(np.clip(y.mean() if len(y) else 0.5, 1e-6, 1 - 1e-6))
        return Rules([], float(np.log(share / (1 - share))))
    rng, edges = np.random.default_rng(seed), edges_of(x)
    codes = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1)
    z, paths, least = np.full(len(y), np.log(y.mean() / (1 - y.mean()))), [], max(2, len(y) // 400)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        some = np.sort(rng.choice(x.shape[1], max(2, x.shape[1] * 2 // 3), replace=False))
        rows = np.sort(rng.choice(len(y), max(2, len(y) * 2 // 3), replace=False))
        step, found = grow(codes, edges, p - y, p * (1 - p), some, depth, least, rows=rows)
        full = np.zeros(len(y))
        full[rows] = step[rows]
        rest = np.setdiff1d(np.arange(len(y)), rows, assume_unique=True)
        leaves = [r for r in found if not any(o[: len(r)] == r and len(o) > len(r) for o in found)]
        for r in leaves:
            inside = holds(r, x)
            known = rows[inside[rows]]
            if len(known):
                full[rest[inside[rest]]] = step[known[0]]
        z += rate * full
        paths += found
    rules = sorted({simplified(r) for r in paths})
    fire = np.stack([holds(r, x) for r in rules], axis=1).astype(np.float64)
    mean, std = fire.mean(0), fire.std(0)
    good = std > 0
    rules, fire, mean, std = [r for r, g in zip(rules, good, strict=True) if g], fire[:, good], mean[good], std[good]
    w, b = lasso_logistic((fire - mean) / std, y, penalty)
    kept = [(r, float(v / s)) for r, v, s in zip(rules, w, std, strict=True) if v]
    return Rules(kept, b - float((w * mean / std).sum()))


def train(sample: pa.Table) -> Rules:
    """Rules from (text, label) rows."""
    return fit(statistics(sample.column("text")), np.asarray(sample.column("label").to_pylist(), np.float64))


def with_statistics(docs: DataFrame, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with the columns STATS."""
    names = {n.lower() for n in STATS}
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in names]
    source = docs.select(*[f"`{c}`" for c in dict.fromkeys([*kept, text])])
    place = source.columns.index(text)
    shape = T.StructType([*docs.select(*[f"`{c}`" for c in kept]).schema.fields, *[T.StructField(n, T.DoubleType()) for n in STATS]])

    def run(batches):
        for b in batches:
            x = statistics(b.column(place))
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in kept), *[pa.array(x[:, j]) for j in range(len(STATS))]], names=[*kept, *STATS])

    return source.mapInArrow(run, shape)


def learn(docs: DataFrame, labels: DataFrame, *, label: str = "quality", most: int = 6_000) -> Rules:
    return fitted(training_sample(docs, labels, label, most=most), train)


def scored(docs: DataFrame, rules: Rules, *, text: str = "text", keep: list[str] | None = None, threshold: float = 0.3) -> DataFrame:
    """``docs`` (or its columns ``keep``) with score and predicted (1 from the threshold on)."""
    docs = without(docs, *OUT)
    hidden = {c: f"__c{i}" for i, c in enumerate(docs.columns if keep is None else keep) if c.lower() not in OUT}
    own = docs.select(F.col(f"`{text}`").alias("__text"), *[F.col(f"`{c}`").alias(h) for c, h in hidden.items()])
    found = with_statistics(own, text="__text", keep=list(hidden.values())).withColumn("score", rules.column())
    return found.select(*[F.col(h).alias(c) for c, h in hidden.items()], "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
