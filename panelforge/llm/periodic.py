"""All runs (maximal repetitions) of the word sequences of documents.

The documents of an Arrow batch are laid one after another, each word numbered within its document and each document
closed by a sign of its own, so that one suffix array serves them all and nothing matches across documents. Prefix
doubling gives the array and, on the way, a class for every stretch of 2**k words; two stretches are equal if their
classes are, so the longest common extension of two places, to the right or to the left, takes one comparison a level.

Extensions of neighbours in the suffix array are the LCP array; a stack over it gives the longest-previous-factor
array, whose greedy walk gives the LZ blocks. A run that touches no border of blocks lies inside a block, which has
occurred before, so it is a copy. The others end in a block k and have a period below the lengths of blocks k - 1 and
k together (else block k - 1 would be longer), so for each border that many periods are tried: the extensions of the
border against the place one period on, and one period back, give the run. Copies follow from left to right by
buckets of starts, also within a block that overlaps its own source.

A run of length l and exponent x repeats l * (1 - 1 / x) words, so documents without a repeat as long as the least
wanted run needs are done after the doubling; nothing else is skipped, and all steps behave alike at every length.

Defined cases: null and empty texts have no words and no runs, and collapse to the empty text; a text is taken whole
in one task (about 150 bytes a word); a null key leaves ``made_periodic`` without effect; of equal stretches the
smallest period names the run; repeated rows each get a row; clashing columns of the input are replaced.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import let, without

RUN = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))
SLICE_WORDS = 1 << 17


def words_of(text: str = "text") -> Column:
    """The words between ASCII white space; none for null."""
    return F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def made_periodic(words: Column, key: str = "doc_id") -> Column:
    """Words of every tenth document (by crc32 of its key), from a place that the key chooses, as repeats of a stretch."""
    code = F.crc32(F.col(key).cast("string").cast("binary"))
    g = F.floor(code / 10)

    def repeated(w):
        n = F.greatest(F.size(w), F.lit(1))
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.when(code % 10 == 0, F.transform(w, lambda x, i: F.when(i >= a, F.get(w, (a + (i - a) % p).cast("int"))).otherwise(x))).otherwise(w)

    return let(words, repeated)


class Layout:
    """Documents laid one after another: ``symbols`` tells words apart, within and across documents."""

    def __init__(self, codes: np.ndarray, sizes: np.ndarray):
        """``codes``: numbers of all words; ``sizes``: words of each document."""
        self.sizes = sizes.astype(np.int64)
        self.first = np.cumsum(self.sizes + 1) - self.sizes - 1  # where a document begins; its closing sign is at first + size
        self.last = self.first + self.sizes
        n, width = int(self.sizes.sum() + len(sizes)), int(codes.max(initial=0)) + 2
        self.owner = np.repeat(np.arange(len(sizes)), self.sizes + 1)
        symbols = np.zeros(n, np.int64)
        inside = np.ones(n, bool)
        inside[self.last] = False
        symbols[inside] = codes.astype(np.int64) + 1
        self.levels = doubled(symbols + self.owner * width)

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How far the text from i and the text from another place j agree."""
        i, j = i.copy(), j.copy()
        start = i.copy()
        for k in range(len(self.levels) - 2, -1, -1):
            step = (self.levels[k][i] == self.levels[k][j]).astype(np.int64) << k
            i += step
            j += step
        return i - start

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How far the text before i and the text before another place j agree."""
        i, j = i.copy(), j.copy()
        start = i.copy()
        for k in range(len(self.levels) - 2, -1, -1):
            a, b = i - (1 << k), j - (1 << k)
            step = ((a >= 0) & (b >= 0) & (self.levels[k][np.maximum(a, 0)] == self.levels[k][np.maximum(b, 0)])).astype(np.int64) << k
            i -= step
            j -= step
        return start - i

    def repeating(self, least: int) -> np.ndarray:
        """The documents where some stretch of at least ``least`` words may occur twice (judged at the power of two below)."""
        k = max(least, 1).bit_length() - 1
        if k >= len(self.levels) - 1:
            return np.zeros(0, np.int64)
        held = np.bincount(self.levels[k], minlength=len(self.owner))
        return np.unique(self.owner[held[self.levels[k]] > 1])

    def previous(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The longest previous factor of every place of ``docs``, and where it occurs before."""
        n = len(self.owner)
        length, source = np.zeros(n, np.int64), np.full(n, -1, np.int64)
        wanted = np.zeros(len(self.sizes), bool)
        wanted[docs] = True
        order = np.empty(n, np.int64)
        order[self.levels[-1]] = np.arange(n)
        order = order[wanted[self.owner[order]]]
        lcp = np.concatenate(([0], self.ahead(order[:-1], order[1:]))) if len(order) else order
        held = (lcp > 0) | np.append(lcp[1:], 0).astype(bool)
        stack = [(-1, 0)]  # places in rising order, each with what it shares with the one below
        for place, shared in zip([*order[held].tolist(), -2], [*lcp[held].tolist(), 0]):
            while stack[-1][0] > place and len(stack) > 1:
                top, below = stack.pop()
                if below >= shared:
                    length[top], source[top], shared = below, stack[-1][0], shared
                else:
                    length[top], source[top], shared = shared, place, below
            stack.append((place, shared))
        return length, source


def doubled(symbols: np.ndarray) -> list[np.ndarray]:
    """Level k: for every place the rank, in suffix order, of the first stretch equal to its 2**k symbols; the last level has no equals.

    The last symbol of every document is unique, so a stretch that occurs twice never reaches the end."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    new = np.concatenate(([True], symbols[order][1:] != symbols[order][:-1]))
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    levels, width = [rank], 1
    active = np.flatnonzero(np.bincount(rank, minlength=n)[rank] > 1)
    while len(active):
        rank = levels[-1]
        key = rank[active] * n + rank[active + width]
        turn = np.argsort(key, kind="stable")
        active, key = active[turn], key[turn]
        group = key // n
        count = np.arange(len(active))
        opened = np.concatenate(([True], group[1:] != group[:-1]))
        place = group + count - np.maximum.accumulate(np.where(opened, count, 0))
        new = np.concatenate(([True], key[1:] != key[:-1]))
        rank = rank.copy()
        rank[active] = place[np.maximum.accumulate(np.where(new, count, 0))]
        levels.append(rank)
        width *= 2
        alone = new & np.append(new[1:], True)
        active = active[~alone]
    return levels


def blocks(length: np.ndarray, first: int, last: int) -> list[int]:
    """The borders of the LZ blocks of one document, its begin and end included."""
    out, at, steps = [first], first, length[first:last].tolist()
    while at < last:
        at += max(1, steps[at - first])
        out.append(at)
    return out


def touching(layout: Layout, borders: list[list[int]], least: int, exponent: float) -> np.ndarray:
    """(start, end, period) of the runs that touch a border of blocks, found by extending the border to both sides."""
    at = np.array([b for bs in borders for b in bs[1:]], np.int64)
    left = np.array([y - x for bs in borders for x, y in zip(bs, bs[1:])], np.int64)
    right = np.array([d for bs in borders for d in [*[y - x for x, y in zip(bs[1:], bs[2:])], 0]], np.int64)
    tries = np.maximum(left + right - 1, 0)
    out, step = [np.zeros((0, 3), np.int64)], 1 << 20
    ends = np.cumsum(tries)
    for low in range(0, int(ends[-1]) if len(ends) else 0, step):
        t = np.arange(low, min(low + step, int(ends[-1])))
        which = np.searchsorted(ends, t, side="right")
        q = t - (ends[which] - tries[which]) + 1
        for i in (at[which], at[which] - q):
            doc = layout.owner[np.maximum(at[which] - 1, 0)]
            fits = (i >= layout.first[doc]) & (i + q <= layout.last[doc])
            x, p = i[fits], q[fits]
            same = layout.levels[0]
            near = (same[x] == same[x + p]) | ((x > 0) & (same[x - 1] == same[x + p - 1]))
            x, p = x[near], p[near]
            back, on = layout.behind(x, x + p), layout.ahead(x, x + p)
            run = np.stack([x - back, x + p + on, p], axis=1)
            out.append(run[wanted(run[:, 1] - run[:, 0], p, least, exponent)])
    found = np.concatenate(out)
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    once = np.concatenate((np.ones(min(1, len(found)), bool), (found[1:, :2] != found[:-1, :2]).any(axis=1)))
    return found[once]  # the smallest period of a stretch comes first


def wanted(length, period, least: int, exponent: float):
    return (length >= least) & (length >= exponent * period) & (length >= 2 * period)


def copied(found: dict, borders: list[int], source: np.ndarray, least: int) -> None:
    """Adds to ``found`` (start: {end: period}) the runs inside blocks, each copied from where the block occurred before."""
    for begin, end in zip(borders, borders[1:]):
        if end - begin < max(least, 2) + 2:
            continue
        shift = begin - int(source[begin])
        for start in range(begin + 1, end - max(least, 2)):
            for e, p in list(found.get(start - shift, {}).items()):
                if e + shift < end:
                    found.setdefault(start, {})[e + shift] = p


def runs_of(codes: np.ndarray, sizes: np.ndarray, least: int = 2, exponent: float = 2.0) -> tuple[np.ndarray, np.ndarray]:
    """(start, length, period) of all runs of a batch of documents, by document, start and period; and runs a document."""
    counts = np.zeros(len(sizes), np.int64)
    if not len(codes):
        return np.zeros((0, 3), np.int64), counts
    layout = Layout(codes, sizes)
    docs = layout.repeating(max(1, math.ceil(least * (1 - 1 / max(exponent, 2.0)))))
    if not len(docs):
        return np.zeros((0, 3), np.int64), counts
    length, source = layout.previous(docs)
    borders = [blocks(length, int(layout.first[d]), int(layout.last[d])) for d in docs]
    by_doc = {}
    for s, e, p in touching(layout, borders, least, exponent).tolist():
        by_doc.setdefault(int(layout.owner[s]), {}).setdefault(s, {})[e] = p
    out = []
    for d, border in zip(docs.tolist(), borders):
        found = by_doc.get(d)
        if found:
            copied(found, border, source, least)
            rows = sorted((s - int(layout.first[d]), p, e - s) for s, ends in found.items() for e, p in ends.items())
            out.extend((s, n, p) for s, p, n in rows)
            counts[d] = len(rows)
    return np.array(out, np.int64).reshape(-1, 3), counts


def kept_words(runs: np.ndarray, counts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Which words stay when of every run only the first period does."""
    begin = np.repeat(np.cumsum(sizes) - sizes, counts)
    edge = np.zeros(int(sizes.sum()) + 1, np.int64)
    np.add.at(edge, begin + runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, begin + runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edge)[:-1] == 0


def slices(batch: pa.RecordBatch, place: int):
    """Parts of a batch of about ``SLICE_WORDS`` words, one document at least."""
    sizes = pc.fill_null(pc.list_value_length(batch.column(place)), 0).to_numpy(zero_copy_only=False)
    at, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if held and held + n > SLICE_WORDS:
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += n + 1
    if at < batch.num_rows:
        yield batch.slice(at)


def periodic_runs(docs: DataFrame, *, words: str = "words", keep: list[str] | None = None, least: int = 24, exponent: float = 3.0) -> DataFrame:
    """``docs`` (or its columns ``keep``) with ``runs`` (start, length, period; of at least ``least`` words and ``exponent``
    periods, by start and period) and ``collapsed``, the text of the words outside the later periods of all runs."""
    rest = without(docs, "runs", "collapsed")
    kept = rest.columns if keep is None else [c for c in keep if c.lower() not in ("runs", "collapsed")]
    columns = [*[F.col(f"`{c}`") for c in kept], F.col(f"`{words}`").alias("__words")]
    shape = T.StructType([*rest.select(*[f"`{c}`" for c in kept]).schema.fields, T.StructField("runs", RUN), T.StructField("collapsed", T.StringType())])
    kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))

    def run(batches):
        for batch in batches:
            for part in slices(batch, batch.num_columns - 1):
                *own, column = part.columns
                sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                flat = column.flatten()
                codes = flat.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
                found, counts = runs_of(codes, sizes, least, exponent)
                stays = kept_words(found, counts, sizes)
                left = np.concatenate(([0], np.cumsum(stays)))[np.concatenate(([0], np.cumsum(sizes)))].astype(np.int32)
                collapsed = pc.binary_join(pa.ListArray.from_arrays(pa.array(left), flat.fill_null("").filter(pa.array(stays))), " ")
                items = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(found[:, i])) for i in range(3)], names=["start", "length", "period"])
                runs = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), items)
                yield pa.RecordBatch.from_arrays([*own, runs.cast(kind), collapsed.cast(pa.string())], names=[*kept, "runs", "collapsed"])

    return docs.select(*columns).mapInArrow(run, shape)


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """The number of runs, the one of the greatest exponent, and SHA-256 of all runs and of the collapsed text."""
    more = lambda a, b: a.length * b.period > b.length * a.period
    best = F.reduce("runs", F.get("runs", F.lit(0)), lambda a, b: F.when(more(b, a), b).otherwise(a))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r.start, F.lit(","), r.length, F.lit(","), r.period, F.lit("\n"))), "")
    out = found.select(key, F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return out.select(key, "n_runs", "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
