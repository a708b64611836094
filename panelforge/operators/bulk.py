"""Screen of every feature against every target of a wide table, without a row for each pair.

Rows stay wide. Tasks read them in Arrow batches, and a block of rows adds to all pairs at once by products of masked
matrices (features by rows times rows by targets): counts, sums, squares and products over the rows where both are
present. Only these sums leave a task, as arrays of one feature against all targets, and are merged in two levels, so
the work is rows times pairs multiplications and the shuffle is tasks times pairs, never rows times pairs.

Columns are shifted by their means and scaled by their deviations before the products, so neither the unit nor the
distance from zero costs digits; results are scaled back. Clustered errors need the sums of a pair's scores by cluster.
They come from a second reading with the pairs' means and slopes at hand, a table of pairs that every task gets
(``LARGEST_PAIRS`` bounds it): once dealt by session, where the meets of session and symbol are whole too, and once by
symbol, salted, since one symbol may hold a third of all rows; partial scores of a salted symbol add up before they are
squared.

Deciles and the approximate rank correlation use one small table of edges for each column, of exact order statistics
(``panelforge.operators.order``) or of mergeable summaries (``approximate_edges``).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.functions.columns import div
from panelforge.operators.generation import require, screen_violations
from panelforge.operators.order import quantiles
from panelforge.operators.screening import normal_p
from panelforge.sources.shared import cut

KEYS = ("symbol", "session", "slot")
LARGEST_PAIRS = 4_000_000
ROWS = 4096
DECILES, BINS = 10, 100
#: Sums of a pair that one reading gathers.
SUMS = ("n", "x", "y", "xx", "yy", "xy", "rx", "ry", "rxx", "ryy", "rxy", *[f"n{d}" for d in range(DECILES)], *[f"y{d}" for d in range(DECILES)])


@dataclass(frozen=True)
class Columns:
    """Names of a wide table's columns, and by what each is shifted and scaled."""

    features: tuple
    targets: tuple
    shift: np.ndarray
    scale: np.ndarray
    edges: tuple = ()

    @property
    def all(self) -> tuple:
        return (*self.features, *self.targets)


def finite(c: str) -> Column:
    """A column as double; null where it is not finite."""
    x = F.col(c).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def described(wide: DataFrame, features: list[str], targets: list[str], edges: dict | None = None) -> Columns:
    """Means and deviations of all columns in one aggregate; ``edges``: the inner quantile edges of each column."""
    if len(features) * len(targets) > LARGEST_PAIRS:
        raise ValueError(f"more than {LARGEST_PAIRS} pairs: screen the features in blocks")
    names = [*features, *targets]
    row = wide.agg(*[F.struct(F.avg(finite(c)), F.stddev_pop(finite(c))).alias(c) for c in names]).first()
    shift = np.array([row[c][0] or 0.0 for c in names])
    scale = np.array([row[c][1] or 1.0 for c in names])
    return Columns(tuple(features), tuple(targets), shift, scale, tuple(np.asarray(edges[c], float) for c in names) if edges else ())


def approximate_edges(wide: DataFrame, names: list[str], accuracy: int = 10_000) -> dict:
    """The inner percentiles of all columns from mergeable summaries in one pass; a rank is off by less than n / accuracy rows."""
    at = F.array(*[F.lit(i / BINS) for i in range(1, BINS)])
    row = wide.agg(*[F.percentile_approx(finite(c), at, accuracy).alias(c) for c in names]).first()
    return {c: sorted(set(row[c] or [])) for c in names}


def exact_edges(wide: DataFrame, names: list[str]) -> dict:
    """The inner percentiles of all columns, interpolated between exact order statistics: one small row a column comes back."""
    values = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), finite(c).alias("x")) for c in names])).alias("v")
    rows = wide.select(values).select("v.*").where("x is not null")
    found = quantiles(rows, ["name"], "x", [i / BINS for i in range(1, BINS)])
    edges = {r["name"]: sorted(set(r["quantiles"])) for r in found.toLocalIterator()}
    return {c: edges.get(c, []) for c in names}


def matrix(batch: pa.RecordBatch, names: tuple) -> np.ndarray:
    """Columns of a batch as doubles, NaN where null or not finite."""
    out = np.stack([batch.column(batch.schema.get_field_index(c)).cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False) for c in names], axis=1)
    out[~np.isfinite(out)] = np.nan
    return out


def split(z: np.ndarray, c: Columns) -> tuple:
    """Shifted and scaled features and targets with 0 for missing values, and both masks."""
    z = (z - c.shift) / c.scale
    held = ~np.isnan(z)
    z = np.where(held, z, 0.0)
    k = len(c.features)
    return z[:, :k], z[:, k:], held[:, :k].astype(float), held[:, k:].astype(float)


def gathered(raw: np.ndarray, c: Columns, out: np.ndarray) -> None:
    """Adds a block of rows to the sums (SUMS, features, targets)."""
    x, y, mx, my = split(raw, c)
    pairs = [(mx, my), (x, my), (mx, y), (x * x, my), (mx, y * y), (x, y)]
    if c.edges:
        k = len(c.features)
        bin_ = np.stack([np.searchsorted(e, raw[:, i], side="left") for i, e in enumerate(c.edges)], axis=1)
        rank = bin_ / BINS - 0.5  # about centred; what is missing is masked
        rx, ry = rank[:, :k] * mx, rank[:, k:] * my
        pairs += [(rx, my), (mx, ry), (rx * rx, my), (mx, ry * ry), (rx, ry)]
        tenth = np.minimum(bin_[:, :k], BINS - 1) // (BINS // DECILES)
        here = [(tenth == d) * mx for d in range(DECILES)]
        pairs += [(h, my) for h in here] + [(h, y) for h in here]
    for i, (a, b) in enumerate(pairs):
        out[i] += a.T @ b


def as_rows(part: int, names: tuple, sums: np.ndarray) -> pa.RecordBatch:
    """One row a feature: the sums against all targets."""
    n, features, targets = sums.shape
    flat = pa.array(np.ascontiguousarray(sums.transpose(1, 0, 2)).ravel())
    lists = pa.FixedSizeListArray.from_arrays(flat, n * targets).cast(pa.list_(pa.float64()))
    return pa.RecordBatch.from_arrays([pa.array(np.full(features, part, np.int32)), pa.array(list(names), pa.string()), lists], names=["part", "feature", "sums"])


PARTIAL = "part int, feature string, sums array<double>"


def added(partial: DataFrame, *keys: str) -> DataFrame:
    """Arrays with equal keys added element by element."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        flat = pc.list_flatten(table.column("sums")).to_numpy().reshape(table.num_rows, -1).sum(axis=0)
        lists = pa.FixedSizeListArray.from_arrays(pa.array(flat), len(flat)).cast(pa.list_(pa.float64()))
        return pa.table({**{k: pa.array([v.as_py()]).cast(table.schema.field(k).type) for k, v in zip(keys, key, strict=True)}, "sums": lists})

    kinds = dict(partial.dtypes)
    return partial.groupBy(*keys).applyInArrow(run, ", ".join([*[f"{k} {kinds[k]}" for k in keys], "sums array<double>"]))


def pair_sums(wide: DataFrame, c: Columns, tasks: int) -> DataFrame:
    """(feature, target, SUMS) over all rows: one reading by ``tasks`` tasks, arrays merged in two levels."""
    shape = (len(SUMS) if c.edges else 6, len(c.features), len(c.targets))

    def run(batches):
        from pyspark import TaskContext

        sums, some = np.zeros(shape), False
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                gathered(matrix(batch.slice(at, ROWS), c.all), c, sums)
                some = True
        if some:
            yield as_rows(TaskContext.get().partitionId() % 32, c.features, sums)

    partial = wide.select(*c.all).coalesce(tasks).mapInArrow(run, PARTIAL)
    if tasks > 32:
        partial = added(partial, "part", "feature")
    return unpacked(added(partial, "feature"), c.targets, SUMS[: shape[0]])


def unpacked(arrays: DataFrame, targets: tuple, names: tuple) -> DataFrame:
    """One row a feature and target from arrays of sums (name by name, each over all targets)."""
    at = lambda i, t: F.get("sums", F.lit(i * len(targets)) + t)
    out = arrays.select("feature", "sums", F.posexplode(F.array(*[F.lit(t) for t in targets])).alias("t", "target"))
    return out.select("feature", "target", *[at(i, F.col("t")).alias(f"s_{n}") for i, n in enumerate(names)])


@dataclass(frozen=True)
class Lines:
    """Means and slopes of all pairs in shifted and scaled units."""

    mean_x: np.ndarray
    mean_y: np.ndarray
    slope: np.ndarray


def lines(sums: DataFrame, c: Columns) -> Lines:
    """The pairs' lines, collected: at most ``LARGEST_PAIRS`` rows of four numbers."""
    found = sums.select("feature", "target", "s_n", "s_x", "s_y", "s_xx", "s_xy").toArrow()
    at = pc.index_in(found["feature"], pa.array(list(c.features))).to_numpy(), pc.index_in(found["target"], pa.array(list(c.targets))).to_numpy()
    n, x, y, xx, xy = (np.zeros((len(c.features), len(c.targets))) for _ in range(5))
    for name, out in zip(("s_n", "s_x", "s_y", "s_xx", "s_xy"), (n, x, y, xx, xy), strict=True):
        out[at] = found[name].to_numpy()
    with np.errstate(divide="ignore", invalid="ignore"):
        mx, my = x / n, y / n
        slope = (xy - x * my) / (xx - x * mx)
    return Lines(*[np.nan_to_num(v, posinf=0.0, neginf=0.0) for v in (mx, my, slope)])


def scores(raw: np.ndarray, c: Columns, line: Lines) -> tuple[np.ndarray, np.ndarray]:
    """Of a block of rows the counts of all pairs and the sums of their scores (x - mean) times residual."""
    x, y, mx, my = split(raw, c)
    n, sx, sy, sxx, sxy = mx.T @ my, x.T @ my, mx.T @ y, (x * x).T @ my, x.T @ y
    a = sxy - line.mean_x * sy - line.mean_y * sx + n * line.mean_x * line.mean_y
    b = sxx - 2 * line.mean_x * sx + n * line.mean_x**2
    return n, a - line.slope * b


def grouped(batches, key: tuple):
    """The rows of sorted batches as one batch for each run of equal keys; a run may reach over batches."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(batch.schema.get_field_index(k)) for k in key]
        change = np.zeros(batch.num_rows - 1, bool)
        for c in columns:
            code = c.dictionary_encode().indices.to_numpy(zero_copy_only=False)
            change |= code[1:] != code[:-1]
        bounds = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for start, end in zip(bounds, bounds[1:]):
            now = tuple(c[start].as_py() for c in columns)
            if held and now != last:
                yield last, pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
            held.append(batch.slice(start, end - start))
            last = now
    if held:
        yield last, pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def by_session(wide: DataFrame, c: Columns, line: Lines) -> DataFrame:
    """(feature, target) with squared score sums and counts of sessions and of meets of session and symbol, of decisions
    and a bit for each year. Sessions are dealt whole; a task holds one session at a time."""
    names = ("q_session", "g_session", "q_meet", "g_meet", "decisions")

    def run(batches):
        from pyspark import TaskContext

        out, years = np.zeros((len(names), len(c.features), len(c.targets))), {}
        for (session,), rows in grouped(batches, ("session",)):
            raw = matrix(rows, c.all)
            symbols = rows.column(rows.schema.get_field_index("symbol")).dictionary_encode().indices.to_numpy()
            slots = rows.column(rows.schema.get_field_index("slot")).to_numpy()
            whole_n, whole_s = np.zeros(out.shape[1:]), np.zeros(out.shape[1:])
            for part in np.split(np.arange(len(raw)), np.flatnonzero(np.diff(symbols)) + 1):
                n, s = scores(raw[part], c, line)
                out[2] += s * s
                out[3] += n > 0
                whole_n += n
                whole_s += s
            out[0] += whole_s * whole_s
            out[1] += whole_n > 0
            held = ~np.isnan(raw)
            for slot in np.unique(slots):
                m = held[slots == slot].astype(float)
                out[4] += m[:, : len(c.features)].T @ m[:, len(c.features) :] > 0
            year = years.setdefault(session[:4], np.zeros(out.shape[1:], bool))
            year |= whole_n > 0
        if years:
            bits = sum((v.astype(np.int64) << (int(y) % 50) for y, v in years.items()), np.zeros(out.shape[1:], np.int64))
            yield as_rows(TaskContext.get().partitionId(), c.features, np.concatenate((out, bits[None].astype(float))))

    sorted_rows = wide.select(*KEYS, *c.all).repartition("session").sortWithinPartitions("session", "symbol", "slot")
    rows = unpacked(sorted_rows.mapInArrow(run, PARTIAL), c.targets, (*names, "years"))
    years = F.bit_count(F.bit_or(F.col("s_years").cast("long")))
    return rows.groupBy("feature", "target").agg(*[F.sum(f"s_{n}").alias(n) for n in names], years.alias("years"))


def by_symbol(wide: DataFrame, c: Columns, line: Lines, salts: int) -> DataFrame:
    """(feature, target, q_symbol, g_symbol): each salted part of a symbol sends its score sums, which add up by symbol first."""

    def run(batches):
        from pyspark import TaskContext

        for (symbol, _), rows in grouped(batches, ("symbol", "salt")):
            n, s = np.zeros((2, len(c.features), len(c.targets)))
            raw = matrix(rows, c.all)
            for at in range(0, len(raw), ROWS):
                more = scores(raw[at : at + ROWS], c, line)
                n, s = n + more[0], s + more[1]
            batch = as_rows(TaskContext.get().partitionId(), c.features, np.stack((n, s)))
            yield pa.RecordBatch.from_arrays([pa.array([symbol] * batch.num_rows, pa.string()), *batch.columns[1:]], names=["symbol", "feature", "sums"])

    salt = F.pmod(F.xxhash64("session"), F.lit(salts)).cast("int").alias("salt")
    rows = wide.select("symbol", salt, *c.all).repartition("symbol", "salt").sortWithinPartitions("symbol", "salt")
    partial = rows.mapInArrow(run, "symbol string, feature string, sums array<double>")
    whole = added(partial, "symbol", "feature")
    found = unpacked(whole, c.targets, ("n", "score"))
    return found.groupBy("feature", "target").agg(F.sum(F.col("s_score") * F.col("s_score")).alias("q_symbol"), F.count_if(F.col("s_n") > 0).alias("g_symbol"))


@dataclass(frozen=True)
class Least:
    """What a pair needs to be screened: rows, sessions, symbols, decisions, years."""

    rows: int = 30
    sessions: int = 2
    symbols: int = 2
    decisions: int = 2
    years: int = 1


def screen(wide: DataFrame, features: list[str], targets: list[str], *, edges: dict | None = None, least: Least = Least(), tasks: int | None = None, salts: int = 8) -> DataFrame:
    """One row a pair: coverage, moments, slope with one-way and two-way clustered errors, p, and with ``edges`` also the
    correlation of ranks among the edges, the spread of the outer deciles, their monotonicity and its shape.

    A pair whose rows give its feature less than 1e-14 of the column's variance is ``constant_feature``, one below
    ``least`` is ``insufficient_data``; both have coverage only. A session is a string that begins with its year. A result with
    repeated pairs, p outside 0 to 1 or without t, or negative counts raises."""
    c = described(wide, features, targets, edges)
    tasks = tasks or 4 * wide.sparkSession.sparkContext.defaultParallelism
    sums = cut(pair_sums(wide, c, tasks))
    line = lines(sums, c)
    clusters = by_session(wide, c, line).join(by_symbol(wide, c, line, salts), ["feature", "target"])
    table = [(n, float(s), float(k)) for n, s, k in zip(c.all, c.shift, c.scale, strict=True)]
    units = F.create_map(*[F.lit(v) for n, s, k in table for v in (n, s)]), F.create_map(*[F.lit(v) for n, s, k in table for v in (n, k)])
    n = F.col("s_n")
    r = sums.join(clusters, ["feature", "target"])
    r = r.withColumn("kx", units[1][F.col("feature")]).withColumn("ky", units[1][F.col("target")]).withColumn("ax", units[0][F.col("feature")]).withColumn("ay", units[0][F.col("target")])
    r = r.withColumn("cxx", F.col("s_xx") - F.col("s_x") * F.col("s_x") / n).withColumn("cyy", F.col("s_yy") - F.col("s_y") * F.col("s_y") / n).withColumn("cxy", F.col("s_xy") - F.col("s_x") * F.col("s_y") / n)
    status = F.when((n == 0) | (F.col("cxx") / n <= 1e-14), "constant_feature").when((n < least.rows) | (F.col("g_session") < least.sessions) | (F.col("g_symbol") < least.symbols) | (F.col("decisions") < least.decisions) | (F.col("years") < least.years), "insufficient_data").otherwise("screened")
    r = r.withColumn("status", F.coalesce(status, F.lit("constant_feature")))
    ok = lambda v: F.when(F.col("status") == "screened", v)
    unit = F.col("ky") / F.col("kx")
    slope = div(F.col("cxy"), F.col("cxx"))

    def variance(q: str, g: str):
        return div(F.col(g), F.col(g) - 1) * div(n - 1, n - 2) * div(F.col(q), F.col("cxx") * F.col("cxx"))

    parts = variance("q_session", "g_session"), variance("q_symbol", "g_symbol"), variance("q_meet", "g_meet")
    total, every = parts[0] + parts[1] - parts[2], parts[0] + parts[1] + parts[2]
    two = F.when(total.isNotNull(), F.sqrt(F.when(total > 1e-9 * every, total).otherwise(F.lit(0.0))))
    one = div(F.sqrt("q_session"), F.col("cxx"))
    extra = []
    if edges:
        rxx, ryy, rxy = (F.col(f"s_r{a}{b}") - F.col(f"s_r{a}") * F.col(f"s_r{b}") / n for a, b in ("xx", "yy", "xy"))
        means = F.array(*[div(F.col(f"s_y{d}"), F.col(f"s_n{d}")) for d in range(DECILES)])
        r = r.withColumn("means", means)
        spread = (F.get("means", F.lit(DECILES - 1)) - F.get("means", F.lit(0))) * F.col("ky")
        extra = [ok(div(rxy, F.sqrt(rxx * ryy))).alias("spearman"), ok(spread).alias("spread"), ok(rising("means")).alias("monotonicity")]
    out = r.select(
        "feature", "target", "status", n.cast("long").alias("n"), F.col("g_session").cast("long").alias("n_sessions"), F.col("g_symbol").cast("long").alias("n_symbols"), F.col("decisions").cast("long").alias("n_decisions"), F.col("years").cast("long").alias("n_years"),
        ok(F.col("ax") + F.col("kx") * F.col("s_x") / n).alias("mean_x"), ok(F.col("ay") + F.col("ky") * F.col("s_y") / n).alias("mean_y"), ok(F.col("cxx") / n * F.col("kx") * F.col("kx")).alias("var_x"), ok(F.col("cyy") / n * F.col("ky") * F.col("ky")).alias("var_y"),
        ok(div(F.col("cxy"), F.sqrt(F.col("cxx") * F.col("cyy")))).alias("pearson"), ok(slope * unit).alias("slope"), ok(one * unit).alias("se"), ok(div(slope, one)).alias("t"), ok(two * unit).alias("se_two_way"), ok(div(slope, two)).alias("t_two_way"), *extra,
    )
    out = out.withColumn("p", normal_p("t")).withColumn("p_two_way", normal_p("t_two_way"))
    if edges:
        m = F.col("monotonicity")
        out = out.withColumn("shape", F.when(F.col("status") == "screened", F.when(m >= 0.7, "positive_monotonic").when(m <= -0.7, "negative_monotonic").otherwise("no_stable_shape")))
    out = cut(out)
    require(screen_violations(out), "repeated_pairs", "p_outside", "negative_counts", "p_without_t")
    return out


def rising(means: str):
    """Rank correlation of the deciles that have rows with their means; null below three."""
    pairs = F.filter(F.transform(F.col(means), lambda m, i: F.struct(i.alias("i"), m.alias("m"))), lambda e: e.m.isNotNull())
    rank = lambda e, all_, by: F.size(F.filter(all_, lambda o: o[by] < e[by])) + (F.size(F.filter(all_, lambda o: o[by] == e[by])) - 1) / 2.0

    def corr(all_):
        n = F.size(all_)
        both = F.transform(all_, lambda e: F.struct(rank(e, all_, "i").cast("double").alias("a"), rank(e, all_, "m").cast("double").alias("b")))
        centre = (n - 1) / 2.0
        total = lambda f: F.aggregate(both, F.lit(0.0), lambda s, e: s + f(e))
        xy, xx, yy = total(lambda e: (e.a - centre) * (e.b - centre)), total(lambda e: (e.a - centre) * (e.a - centre)), total(lambda e: (e.b - centre) * (e.b - centre))
        return F.when(n >= 3, div(xy, F.sqrt(xx * yy)))

    return F.get(F.transform(F.array(pairs), corr), F.lit(0))
