"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

Every word has the hashes of itself and of its first 5 to 8 bytes; each picks a row of a table of embeddings, and the
rows side by side are the word's vector. Filters over one, two and three words, max pooling over the whole document and
a logistic layer follow. The first embedding component starts at the log-odds of the label among training documents
that hold the hash; all parameters are then trained by gradient descent.

Thresholds are calibrated by language on a part of the sample that training does not see. The language is guessed from
the text alone, by common words, so the label, lang, source and id of a document never reach its score. The score is
the logistic of the distance to the threshold of the guessed language: 0.5 is the boundary in each.

Defined cases: a null or empty text scores as a document without words; a document of any length is read whole; with
no labelled document, or labels of one kind only, every score is the share of that label (0 without any); clashing
columns of the input are replaced; repeated rows score alike.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .bytewords import Slice, slices
from .common import without
from .labelled import fitted, training_sample

SEPARATORS = bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
PREFIXES = (5, 6, 7, 8)
KINDS, BUCKETS, DIMS = 1 + len(PREFIXES), 1 << 16, 2
WIDTHS, FILTERS = (1, 2, 3), 4
#: Frequent function words of four languages.
COMMON = {
    "en": "the and of to in is that it for with as was on are be this by have from or an not",
    "de": "der die und das ist nicht mit den von sich ein eine auf für zu im dem auch als es an",
    "fr": "le la les et des de est que dans qui pour une un du au avec sur par ne pas ce en",
    "es": "el los las del que y se por con una para es su al lo como más pero sus le ya",
}
OUT = ("score", "predicted", "language")


def columns_of(s: Slice) -> np.ndarray:
    """Rows of the embedding table for each word and kind; the row BUCKETS is zero."""
    hashes = s.hashes(PREFIXES)
    out = np.empty((len(s.starts), KINDS), np.int32)
    for k, h in enumerate(hashes):
        out[:, k] = np.where(h == 0, BUCKETS, h >> np.uint64(48)) if k else h >> np.uint64(48)
    return out


def language_table() -> np.ndarray:
    votes = np.zeros((BUCKETS + 1, len(COMMON)), np.float32)
    for i, words in enumerate(COMMON.values()):
        for s in slices(pa.array([words]), SEPARATORS, True):
            votes[columns_of(s)[:, 0], i] = 1
    return votes


@dataclass
class Net:
    table: np.ndarray
    filters: list[np.ndarray]
    bias: list[np.ndarray]
    out: np.ndarray
    c: float = 0.0
    cut: np.ndarray = field(default_factory=lambda: np.zeros(len(COMMON) + 1))

    @classmethod
    def start(cls, seed: int = 7) -> Net:
        rng = np.random.default_rng(seed)
        table = (rng.standard_normal((KINDS, BUCKETS + 1, DIMS)) * 0.02).astype(np.float32)
        table[:, BUCKETS] = 0
        filters = [(rng.standard_normal((w, KINDS, DIMS, FILTERS)) * 0.1).astype(np.float32) for w in WIDTHS]
        for f in filters:
            f[:, :, 0] += 0.2 / len(f)
        return cls(table, filters, [np.full(FILTERS, -0.5, np.float32) for _ in WIDTHS], np.full(FILTERS * len(WIDTHS), 0.4, np.float32), -2.0)

    def vectors(self, cols: np.ndarray) -> np.ndarray:
        return np.concatenate([self.table[k][cols[:, k]] for k in range(KINDS)], axis=1)

    def convolve(self, x: np.ndarray, own: np.ndarray) -> list[np.ndarray]:
        """Filter responses at each word; words beyond the end of a document count as zero."""
        weights = np.concatenate([f.reshape(w, KINDS * DIMS, FILTERS)[j] for f, w in zip(self.filters, WIDTHS, strict=True) for j in range(w)], axis=1)
        z, at, out = x @ weights, 0, []
        for w in WIDTHS:
            r = z[:, at : at + FILTERS].copy()
            for j in range(1, w):
                same = (own[j:] == own[:-j])[:, None]
                r[:-j] += z[j:, at + j * FILTERS : at + (j + 1) * FILTERS] * same
            out.append(r)
            at += w * FILTERS
        return out

    def logits(self, cols: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """One logit for each document of ``counts`` words."""
        out = np.full(len(counts), self.c, np.float64)
        full = np.flatnonzero(counts)
        if not len(full):
            return out
        own, cuts = np.repeat(np.arange(len(counts)), counts), np.concatenate(([0], np.cumsum(counts[full])[:-1]))
        best = np.concatenate([np.maximum.reduceat(r, cuts) + b for r, b in zip(self.convolve(self.vectors(cols), own), self.bias, strict=True)], axis=1)
        out[full] += np.maximum(best, 0) @ self.out
        return out


def languages(cols: np.ndarray, counts: np.ndarray, votes: np.ndarray) -> np.ndarray:
    """Place in COMMON of each document's likeliest language; one past the end without any common word."""
    out = np.full(len(counts), len(COMMON))
    full = np.flatnonzero(counts)
    if len(full):
        cuts = np.concatenate(([0], np.cumsum(counts[full])[:-1]))
        sums = np.add.reduceat(votes[cols[:, 0]], cuts)
        out[full] = np.where(sums.max(1) > 0, sums.argmax(1), len(COMMON))
    return out


def log_odds(net: Net, cols: np.ndarray, counts: np.ndarray, y: np.ndarray, strength: float = 30.0) -> None:
    """Starts the first component at smoothed log-odds of the label given the hash."""
    own = np.repeat(np.arange(len(counts)), counts)
    share = y.mean()
    for k in range(KINDS):
        pairs = np.unique(own.astype(np.int64) * (BUCKETS + 1) + cols[:, k])
        doc, row = pairs // (BUCKETS + 1), pairs % (BUCKETS + 1)
        on, n = np.bincount(row, y[doc], BUCKETS + 1), np.bincount(row, minlength=BUCKETS + 1)
        z = np.log((on + strength * share) / (n - on + strength * (1 - share))) - np.log(share / (1 - share))
        net.table[k, :, 0] = np.clip(z, -2, 5)
        net.table[k, BUCKETS] = 0


def fit(cols: np.ndarray, counts: np.ndarray, y: np.ndarray, *, epochs: int = 6, batch: int = 64, rate: float = 0.02, seed: int = 7) -> Net:
    """Minibatch training: Adam for filters and the last layer, Adagrad for the rows of the table that max pooling chose."""
    net, rng = Net.start(seed), np.random.default_rng(seed)
    log_odds(net, cols, counts, y)
    ends = np.cumsum(counts)
    starts = ends - counts
    params = [*net.filters, *net.bias, net.out]
    m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    speed, c_v = np.full(net.table.shape[:2], 1e-2, np.float32), 1e-2
    docs = np.flatnonzero(counts)
    for _ in range(epochs):
        for chosen in np.array_split(rng.permutation(docs), max(1, len(docs) // batch)):
            step += 1
            size = counts[chosen]
            at = np.repeat(starts[chosen] - np.cumsum(size) + size, size) + np.arange(size.sum())
            c, own = cols[at], np.repeat(np.arange(len(chosen)), size)
            x = net.vectors(c)
            bounds = np.concatenate(([0], np.cumsum(size)))
            responses = net.convolve(x, own)
            best = [np.stack([r[a:b].argmax(0) + a for a, b in zip(bounds[:-1], bounds[1:], strict=True)]) for r in responses]
            pooled = np.concatenate([np.take_along_axis(r, i, 0) + b for r, i, b in zip(responses, best, net.bias, strict=True)], axis=1)
            h = np.maximum(pooled, 0)
            p = 1 / (1 + np.exp(-np.clip(h @ net.out + net.c, -30, 30)))
            g = ((p - y[chosen]) / len(chosen)).astype(np.float32)
            dh = g[:, None] * net.out * (pooled > 0)
            grads_f, grads_b, rows, values = [], [], [], []
            for n, w in enumerate(WIDTHS):
                d = dh[:, n * FILTERS : (n + 1) * FILTERS]
                gf = np.zeros_like(net.filters[n])
                for j in range(w):
                    pos = best[n] + j
                    ok = pos < bounds[1:, None]
                    pos = np.where(ok, pos, 0)
                    dj = d * ok
                    xv = x[pos].reshape(*pos.shape, KINDS, DIMS)
                    gf[j] = np.einsum("df,dfkm->kmf", dj, xv)
                    rows.append(c[pos].reshape(-1, KINDS))
                    values.append(np.einsum("df,kmf->dfkm", dj, net.filters[n][j]).reshape(-1, KINDS, DIMS))
                grads_f.append(gf)
                grads_b.append(d.sum(0))
            for i, (q, gr) in enumerate(zip(params, [*grads_f, *grads_b, h.T @ g], strict=True)):
                m[i] = 0.9 * m[i] + 0.1 * gr
                v[i] = 0.99 * v[i] + 0.01 * gr * gr
                q -= rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-6)
            c_v += float(g.sum()) ** 2
            net.c -= 0.1 * float(g.sum()) / np.sqrt(c_v)
            r, val = np.concatenate(rows), np.concatenate(values)
            for k in range(KINDS):
                speed_k = speed[k]
                np.add.at(speed_k, r[:, k], (val[:, k] ** 2).sum(1))
                np.subtract.at(net.table[k], r[:, k], 0.05 * val[:, k] / np.sqrt(speed_k[r[:, k]])[:, None])
                net.table[k, BUCKETS] = 0
    return net


def best_cut(z: np.ndarray, y: np.ndarray) -> float:
    """The logit in the middle of the widest gap among those that make the fewest errors."""
    order = np.argsort(z)
    z, y = z[order], y[order]
    errors = np.concatenate(([0], np.cumsum(y))) + np.concatenate((np.cumsum((1 - y)[::-1])[::-1], [0]))
    edges = np.concatenate(([z[0] - 2], (z[1:] + z[:-1]) / 2, [z[-1] + 2]))
    gap = np.concatenate(([0.5], z[1:] - z[:-1], [0.5]))
    return float(edges[np.lexsort((-gap, errors))[0]])


def calibrate(net: Net, z: np.ndarray, y: np.ndarray, lang: np.ndarray, least: int = 15) -> None:
    every = best_cut(z, y) if len(z) else 0.0
    net.cut[:] = every
    for i in range(len(COMMON)):
        own = lang == i
        if y[own].sum() >= least and (1 - y[own]).sum() >= least:
            net.cut[i] = best_cut(z[own], y[own])


def train(sample: pa.Table, *, calibration: float = 0.3, steps: int = 700) -> Net | float:
    """A net from (text, label) rows, or the share of the label where there is nothing to learn."""
    y = np.asarray(sample.column("label").to_pylist() or [], np.float32)
    if not len(y) or y.min() == y.max():
        return float(y.mean()) if len(y) else 0.0
    parts = [(columns_of(s), s.words) for s in slices(sample.column("text"), SEPARATORS, True, most=1_000_000)]
    n = max(1, round(len(y) * (1 - calibration)))
    if y[:n].min() == y[:n].max():
        n = len(y)
    cols, counts = np.concatenate([c for c, _ in parts]), np.concatenate([k for _, k in parts])
    net = fit(cols[: int(counts[:n].sum())], counts[:n], y[:n], epochs=min(40, max(4, round(steps * 64 / n))))
    del cols
    votes = language_table()
    z = np.concatenate([net.logits(*p) for p in parts])  # slice by slice: the vectors of all words at once would not be small
    lang = np.concatenate([languages(*p, votes) for p in parts])
    rest = slice(n, None) if n < len(y) and y[n:].min() != y[n:].max() else slice(0, None)
    calibrate(net, z[rest], y[rest], lang[rest])
    return net


def score_texts(net: Net | float, column: pa.Array, votes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores and guessed languages of a column of whole texts."""
    scores, langs = [], []
    for s in slices(column, SEPARATORS, True):
        cols = columns_of(s)
        lang = languages(cols, s.words, votes)
        if isinstance(net, float):
            scores.append(np.full(s.docs, net))
        else:
            scores.append(1 / (1 + np.exp(-np.clip(net.logits(cols, s.words) - net.cut[lang], -30, 30))))
        langs.append(lang)
    return np.concatenate(scores or [np.zeros(0)]), np.concatenate(langs or [np.zeros(0, int)])


def _scored(docs: DataFrame, net: Net | float, text: str, kept: list[str], shape: T.StructType, only_clean: bool, threshold: float) -> DataFrame:
    source = docs.select(*[f"`{c}`" for c in dict.fromkeys([*kept, text])])
    place, model, names = source.columns.index(text), docs.sparkSession.sparkContext.broadcast(net), [*COMMON, None]

    def run(batches):
        votes = language_table()
        for b in batches:
            score, lang = score_texts(model.value, b.column(place), votes)
            own = [b.column(b.schema.get_field_index(c)) for c in kept]
            if only_clean:
                yield pa.RecordBatch.from_arrays(own, names=kept).filter(pa.array(score < threshold))
            else:
                found = [pa.array(score), pa.array((score >= threshold).astype(np.int32)), pa.array([names[i] for i in lang], pa.string())]
                yield pa.RecordBatch.from_arrays([*own, *found], names=[*kept, *OUT])

    return source.mapInArrow(run, shape)


def scored(docs: DataFrame, net: Net | float, *, text: str = "text", keep: list[str] | None = None, threshold: float = 0.5) -> DataFrame:
    """``docs`` (or its columns ``keep``) with score, predicted and the guessed language."""
    docs = without(docs, *OUT)
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in OUT]
    shape = T.StructType([*docs.select(*[f"`{c}`" for c in kept]).schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("language", T.StringType())])
    return _scored(docs, net, text, kept, shape, False, threshold)


def clean(docs: DataFrame, net: Net | float, *, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The documents that score below the threshold, with their own columns only."""
    return _scored(docs, net, text, docs.columns, docs.schema, True, threshold)


def learn(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", most: int = 6_000) -> Net | float:
    return fitted(training_sample(docs, labels, label, most=most), train)
