"""SimHash near-duplicates through a segment-popcount embedding.

A fingerprint is cut into 32 segments of two bits. The bit counts of the segments are its place in a 32-dimensional
grid, kept in one long with each count in unary (00, 01, 11), so the Manhattan distance of two places is the number
of differing bits of their codes. It never exceeds the Hamming distance of the fingerprints. The axes are dealt to
``radius + 3`` groups; a pair within Manhattan distance ``radius`` has the same place on at least three groups, so the
range join is an equi-join on the cells of every choice of three groups. Within a cell the Manhattan distance discards
pairs first and the exact Hamming distance decides. Only distinct fingerprints are compared: copies share one row.

A cell yields a spanning forest of its links, never all pairs; a cell of more than ``cell_rows`` fingerprints is dealt
to pairs of chunks, so that no task holds it whole and no link is lost.

Defined cases: a null text counts as empty; without words the fingerprint is zero, which links like any other; fewer
words than a shingle give one shingle of all words; a null doc_id never is a component's name while another id is
there; repeated rows each get a row; texts of any length are taken whole, their hashes held at once; clashing columns of the
input are replaced, and ``keep_one`` passes columns of any name through.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytewords import SPACE, fold_table
from .common import cut, fresh, text_key, without
from .union import components

FOLD = fold_table(SPACE, lower=True)
EVEN = 0x5555555555555555


def shingle_hashes(text: bytes | None, width: int = 3, seed: int = 42) -> np.ndarray:
    """XXH64 of every run of ``width`` words, repeats included."""
    words = text.translate(FOLD).split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    norm, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(norm, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-width] + 1)).tolist()
    return np.array([digest(norm[s:e], seed) for s, e in zip(starts, ends[width - 1 :].tolist())], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is set if it is set in more than half of the hashes."""
    ones, step = np.zeros(64, np.int64), 1 << 16
    for i in range(0, len(hashes), step):
        ones += np.unpackbits(hashes[i : i + step].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(ones * 2 > len(hashes), bitorder="little") if len(hashes) else np.zeros(8, np.uint8)
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, *, text: str = "text", width: int = 3, seed: int = 42, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with the long ``fingerprint``."""
    docs = without(docs, "fingerprint")
    kept = docs.columns if keep is None else keep
    source = docs.select(*[f"`{c}`" for c in dict.fromkeys([*kept, text])])
    place = source.columns.index(text)
    schema = T.StructType([*docs.select(*[f"`{c}`" for c in kept]).schema.fields, T.StructField("fingerprint", T.LongType())])

    def run(batches):
        for batch in batches:
            found = [fingerprint(shingle_hashes(x.as_py(), width, seed)) for x in batch.column(place).cast(pa.large_binary())]
            columns = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found, pa.int64())], names=[*kept, "fingerprint"])

    return source.mapInArrow(run, schema)


def grid_masks(radius: int) -> list[int]:
    """For each choice of three groups of axes, the bits of their unary codes."""
    groups = radius + 3
    masks = [0] * groups
    for segment in range(32):
        masks[segment * groups // 32] |= 3 << (2 * segment)
    return [a | b | c for a, b, c in combinations(masks, 3)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def unary_place(column: str = "fingerprint"):
    """The grid place of a fingerprint as a Column."""
    x = F.col(column)
    up = F.shiftrightunsigned(x, 1)
    return x.bitwiseOR(up).bitwiseAND(F.lit(EVEN)).bitwiseOR(F.shiftleft(x.bitwiseAND(up).bitwiseAND(F.lit(EVEN)), 1))


def _places(x: np.ndarray) -> np.ndarray:
    even, one = np.uint64(EVEN), np.uint64(1)
    up = x >> one
    return ((x | up) & even) | ((x & up & even) << one)


def forest(x: np.ndarray, radius: int, left: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect just what the links within ``x`` connect. With ``left`` (a mask), only links across count."""
    place, rest = _places(x), np.arange(1, len(x))
    frontier, a, b = [0], [], []
    while len(rest):
        if not frontier:
            frontier, rest = [int(rest[0])], rest[1:]
            continue
        at = frontier.pop()
        near = rest if left is None else rest[left[rest] != left[at]]
        near = near[np.bitwise_count(place[near] ^ place[at]) <= radius]
        near = near[np.bitwise_count(x[near] ^ x[at]) <= radius]
        if len(near):
            a.append(np.full(len(near), x[at]))
            b.append(x[near])
            frontier += near.tolist()
            rest = rest[~np.isin(rest, near, assume_unique=True)]
    none = np.zeros(0, np.uint64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def _cell_links(x: np.ndarray, starts: np.ndarray, ends: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of many small cells: rows one apart, two apart and so on, each compared at once."""
    own, size = np.repeat(np.arange(len(starts)), ends - starts), ends - starts
    a, b = [], []
    for d in range(1, int(size.max(initial=1))):
        i = np.flatnonzero(own[d:] == own[:-d])
        p, q = x[i], x[i + d]
        near = np.bitwise_count(_places(p) ^ _places(q)) <= radius
        p, q = p[near], q[near]
        near = np.bitwise_count(p ^ q) <= radius
        a.append(p[near])
        b.append(q[near])
    none = [np.zeros(0, np.uint64)]
    return np.concatenate(a or none), np.concatenate(b or none)


def link_sorted(batches, radius: int, small: int = 12):
    """From batches sorted by (choice, cell) to links; a cell may run over several batches."""
    held: list[pa.RecordBatch] = []

    def solve(choice, cell, x, left=None):
        edges = (choice[1:] != choice[:-1]) | (cell[1:] != cell[:-1])
        cuts = np.concatenate(([0], np.flatnonzero(edges) + 1, [len(x)]))
        size = np.diff(cuts)
        few = (size > 1) & (size <= small)
        take = np.repeat(few, size)
        ends = np.cumsum(size[few])
        a, b = _cell_links(x[take], ends - size[few], ends, radius)
        yield a, b
        for i in np.flatnonzero(size > small):
            yield forest(x[cuts[i] : cuts[i + 1]], radius)

    def flush(table):
        choice, cell, x = (table.column(c).to_numpy() for c in ("choice", "cell", "fingerprint"))
        found = list(solve(choice, cell, x.view(np.uint64)))
        a, b = (np.concatenate([f[k] for f in found]).view(np.int64) for k in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        choice, cell = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("choice", "cell"))
        last = np.flatnonzero((choice != choice[-1]) | (cell != cell[-1]))
        at = int(last[-1]) + 1 if len(last) else 0
        head = held[-1].slice(held[-1].num_rows - 1) if held else None
        if at == 0 and head is not None and (head.column(0)[0].as_py(), head.column(1)[0].as_py()) == (int(choice[0]), int(cell[0])):
            held.append(batch)
            continue
        done = [*held, batch.slice(0, at)]
        held = [batch.slice(at)]
        if sum(b.num_rows for b in done):
            yield flush(pa.Table.from_batches([b for b in done if b.num_rows]))
    if held:
        yield flush(pa.Table.from_batches(held))


def fingerprint_links(distinct: DataFrame, *, radius: int = 3, cell_rows: int = 20_000) -> DataFrame:
    """Links (a, b) of a table of distinct fingerprints, enough to connect all that lie within ``radius``."""
    masks = grid_masks(radius)
    place = unary_place()
    cells = distinct.select("fingerprint", F.explode(F.array(*[F.struct(F.lit(i).alias("choice"), place.bitwiseAND(F.lit(signed(m))).alias("cell")) for i, m in enumerate(masks)])).alias("g"))
    cells = cells.select("g.choice", "g.cell", "fingerprint")
    hot = cut(cells.groupBy("choice", "cell").count().where(F.col("count") > cell_rows))
    crowded = hot.count()
    schema = "a long, b long"
    usual = cells.join(hot, ["choice", "cell"], "left_anti") if crowded else cells
    links = usual.repartition("choice", "cell").sortWithinPartitions("choice", "cell").mapInArrow(lambda it: link_sorted(it, radius), schema)
    if crowded:
        chunks = F.ceil(F.col("count") / (cell_rows // 2)).cast("int")
        dealt = cells.join(hot, ["choice", "cell"]).withColumn("own", F.pmod(F.xxhash64("fingerprint"), chunks).cast("int"))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
        pair = [F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q")]
        dealt = dealt.select("choice", "cell", *pair, "own", "fingerprint")

        def block(table: pa.Table) -> pa.Table:
            p, q, own = (table.column(c).to_numpy() for c in ("p", "q", "own"))
            x = table.column("fingerprint").to_numpy().view(np.uint64)
            a, b = forest(x, radius) if p[0] == q[0] else across(x, own == p[0], radius)
            return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

        links = links.unionAll(dealt.groupBy("choice", "cell", "p", "q").applyInArrow(block, schema))
    return links


def across(x: np.ndarray, left: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For each fingerprint of one chunk, a link to every component of the other chunk that it touches, found by a forest of links across."""
    return forest(x, radius, left)


def classes(prints: DataFrame, *, radius: int = 3, cell_rows: int = 20_000) -> DataFrame:
    """(fingerprint, root) for every fingerprint that has a near one."""
    return components(fingerprint_links(prints.select("fingerprint").distinct(), radius=radius, cell_rows=cell_rows))


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", radius: int = 3) -> DataFrame:
    """One row per document: its key, fingerprint (16 hex digits) and component_id, the smallest key of its component."""
    prints = cut(fingerprints(docs, text=text, keep=[key]))
    low = prints.groupBy("fingerprint").agg(F.min(key).alias("low"))
    roots = cut(classes(low, radius=radius))
    member = low.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    named = member.groupBy("root").agg(F.min("low").alias("component_id"))
    ids = member.join(named, "root").select("fingerprint", "component_id")
    code = F.lower(F.lpad(F.hex("fingerprint"), 16, "0"))
    return prints.join(ids, "fingerprint").select(key, code.alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, *, key: str = "doc_id", text: str = "text", radius: int = 3) -> DataFrame:
    """The documents without near-duplicates: of each component the row with the smallest key stays, of equal keys the least text hash."""
    own, count, *names = fresh(docs, "__id", "__n", "__k1", "__k2")
    mark = [c.alias(n) for c, n in zip(text_key(f"`{text}`"), names)]
    keyed = docs.select(F.col(f"`{key}`").alias(own), F.col(f"`{text}`").alias("text"), *mark)
    prints = cut(fingerprints(keyed, keep=[own, *names]))
    roots = cut(classes(prints, radius=radius)).withColumnRenamed("node", "fingerprint")
    order = F.struct(F.col(own).isNull().alias("null"), *[F.col(c) for c in (own, *names)])
    first = prints.join(roots, "fingerprint", "left").groupBy(F.coalesce("root", "fingerprint").alias("root")).agg(F.min(order).alias("f"))
    first = first.select(*[F.col(f"f.{c}").alias(f"first_{i}") for i, c in enumerate((own, *names))])
    hidden = {c: f"__c{i}" for i, c in enumerate(docs.columns)}
    marked = docs.select(*[F.col(f"`{c}`").alias(h) for c, h in hidden.items()], F.col(f"`{key}`").alias(own), *mark)
    kept = marked.join(first, F.col(own).eqNullSafe(F.col("first_0")) & (F.col(names[0]) == F.col("first_1")) & (F.col(names[1]) == F.col("first_2")), "left_semi")
    one = F.row_number().over(Window.partitionBy(*names, own).orderBy(own))
    return kept.withColumn(count, one).where(F.col(count) == 1).select(*[F.col(h).alias(c) for c, h in hidden.items()])
