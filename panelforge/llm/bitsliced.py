"""Exact top-k inner-product search with a bit-sliced index.

Each component of a vector becomes an integer. A block of rows is an index of bitmaps: slice b of attribute d holds bit
b of that attribute (plus a constant that makes it non-negative) for every row. A query adds the slices of each
attribute, weighted by the bits of its own component, into a bit-sliced sum with carry-save bitmap adders; positive and
negative weights go to two sums of which one is subtracted. The rows are then selected from the most significant slice
downward: a slice splits the rows still open, those above the boundary are taken, and the rows that end on the
boundary are ordered exactly by id.

Rows are dealt to blocks at random, so that rows which repeat an id are spread, and queries to groups; both hold at most
``cells`` numbers on average. Every pair of a block and a group is one task of bounded memory, which makes the block's
index once for all the group's queries and returns k rows a query; the best k of all blocks are taken at the end. The
work is queries times rows, as asked; making a block's index costs as much as a few of its thousands of queries.

Defined cases: vectors that are null, or hold null or non-finite components or one that times ``scale`` does not fit a long,
take no part; of vectors with another length than the query only those of equal length are compared, empty ones with
score 0; a score among the best of a block that does not fit a long is an error; a null id takes no part; ties go to the smaller
id; rows that repeat an id are each a candidate (but not for a query of their own id), and share one list of k if the id is a query; k rows
or all there are; an empty table gives no rows; columns other than key and vector are not read, whatever their names; vectors of
any length are taken whole, in smaller blocks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut


def quantised(vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding", scale: int = 64) -> DataFrame:
    """(id, v): components as whole numbers, floor(scale * x). Rows without an id or a vector, with a component that is null or
    not finite, or with one whose whole number does not fit a long are left out."""
    x = F.col(f"`{vector}`")
    limit = float(1 << 63)
    fine = x.isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double") * scale) < limit))
    v = F.transform(x, lambda e: F.floor(e.cast("double") * scale).cast("long"))
    return vectors.where(F.col(f"`{key}`").isNotNull() & F.coalesce(fine, F.lit(False))).select(F.col(f"`{key}`").cast("long").alias("id"), v.alias("v"))


def pack(bits: np.ndarray) -> np.ndarray:
    """A bitmap of 64 rows a word from booleans of the rows."""
    n = -len(bits) % 64
    return np.packbits(np.concatenate((bits, np.zeros(n, bits.dtype))), bitorder="little").view(np.uint64)


class SlicedSum:
    """Counts in bit slices: ``add(level, bitmap)`` adds 2**level to every row of the bitmap, three at a time."""

    def __init__(self, words: int):
        self.words, self.waiting = words, {}

    def add(self, level: int, bitmap: np.ndarray) -> None:
        queue = self.waiting.setdefault(level, [])
        queue.append(bitmap)
        if len(queue) == 3:
            a, b, c = queue
            half = a ^ b
            self.waiting[level] = [half ^ c]
            carry = a & b
            half &= c
            carry |= half
            self.add(level + 1, carry)

    def slices(self) -> list[np.ndarray]:
        """The sum, least significant slice first."""
        level, out = 0, []
        while self.waiting:
            queue = self.waiting.pop(level, [])
            while len(queue) > 1:
                a, b = queue.pop(), queue.pop()
                queue.append(a ^ b)
                self.waiting.setdefault(level + 1, []).append(a & b)
                while len(self.waiting[level + 1]) > 2:
                    a, b, c = (self.waiting[level + 1].pop() for _ in range(3))
                    half = a ^ b
                    self.waiting[level + 1].append(half ^ c)
                    self.waiting.setdefault(level + 2, []).append((a & b) | (half & c))
            out.append(queue[0] if queue else np.zeros(self.words, np.uint64))
            level += 1
        return out or [np.zeros(self.words, np.uint64)]


class BitSlicedIndex:
    """Rows of whole numbers (n, d), sorted by id, as bitmaps."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, rows = ids[order], rows[order]
        self.n, self.low = len(ids), rows.min(0)
        up = (rows - self.low).astype(np.uint64)
        self.words = (self.n + 63) // 64
        self.attributes = []
        for d in range(rows.shape[1]):
            x, slices, b = up[:, d], [], 0
            top = int(x.max())
            while top >> b:
                slices.append(pack((x >> np.uint64(b)) & np.uint64(1)))
                b += 1
            self.attributes.append(slices)
        self.all = pack(np.ones(self.n, bool))

    def scores(self, query: np.ndarray) -> tuple[list[np.ndarray], int]:
        """Slices of the inner products plus a constant, and that constant."""
        plus = SlicedSum(self.words)
        shift, below = 0, 0
        for d, q in enumerate(query.tolist()):
            shift += q * int(self.low[d])
            slices = self.attributes[d]
            m = abs(q)
            if q < 0:  # -m * x = m * (top - x) - m * top, and top - x flips every slice
                below += m * ((1 << len(slices)) - 1)
            for w in range(m.bit_length()):
                if m >> w & 1:
                    for b, s in enumerate(slices):
                        plus.add(w + b, s if q > 0 else s ^ self.all)
        return plus.slices(), shift - below

    def top(self, query: np.ndarray, k: int, without_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows, best first."""
        slices, constant = self.scores(query)
        open_ = self.all
        if without_id is not None:
            i, j = np.searchsorted(self.ids, [without_id, without_id + 1])
            if i < j:
                own = np.zeros(self.n, bool)
                own[i:j] = True
                open_ = open_ & ~pack(own)
        taken, need = np.zeros(self.words, np.uint64), k
        if int(np.bitwise_count(open_).sum()) <= k:
            taken, need = open_, 0
        else:
            for s in reversed(slices):  # the boundary lies among the rows still open
                ones = open_ & s
                count = int(np.bitwise_count(ones).sum())
                if count <= need:
                    taken, need, open_ = taken | ones, need - count, open_ & ~s
                    if not need:
                        break
                else:
                    open_ = ones
        rows = self.positions(taken)
        if need:  # rows on the boundary are equal: the smallest ids
            rows = np.concatenate((rows, self.first(open_, need)))
        wide = len(slices) > 62 or abs(constant) >> 62  # Python's integers where sums need more than 63 bits
        value = np.zeros(len(rows), object if wide else np.int64)
        for b, s in enumerate(slices):
            bit = ((s[rows >> 6] >> (rows & 63).astype(np.uint64)) & np.uint64(1)).astype(value.dtype)
            value = value + bit * (1 << b)
        ids = self.ids[rows]
        order = np.array(sorted(range(len(rows)), key=lambda i: (-value[i], ids[i])), np.int64) if wide else np.lexsort((ids, -value))
        return ids[order], (value + constant)[order]

    @staticmethod
    def positions(bitmap: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(bitmap)
        bits = np.unpackbits(bitmap[at].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        r, c = np.nonzero(bits)
        return at[r] * 64 + c

    @classmethod
    def first(cls, bitmap: np.ndarray, need: int) -> np.ndarray:
        at = np.flatnonzero(bitmap)
        upto = np.searchsorted(np.cumsum(np.bitwise_count(bitmap[at]).astype(np.int64)), need) + 1
        kept = np.zeros_like(bitmap)
        kept[at[:upto]] = bitmap[at[:upto]]
        return cls.positions(kept)[:need]


def _grid(table: pa.Table, width: int) -> np.ndarray:
    column = table.column("v").combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().reshape(-1, width)


def search(vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding", k: int = 20, every: int = 20, scale: int = 64, block_rows: int = 65_536, cells: int = 4 << 20) -> DataFrame:
    """For each row whose id is divisible by ``every``: query_id, rank from 1, vec_id, score of its k best other rows."""
    rows = cut(quantised(vectors, key=key, vector=vector, scale=scale).withColumn("d", F.size("v")))
    spark = rows.sparkSession
    n, width = rows.agg(F.count(F.lit(1)), F.coalesce(F.max("d"), F.lit(1))).first()
    most = max(64, min(block_rows, cells // width))
    blocks = max(1, math.ceil(n / most))
    slots = max(1, spark.sparkContext.defaultParallelism) * 2
    groups = max(1, min(math.ceil(n / every / 64), max(math.ceil(n / every / most), math.ceil(slots / blocks))))
    place = F.xxhash64(F.monotonically_increasing_id())  # of rows in the checkpoint, so another try gives the same
    dealt = rows.where("d > 0").withColumn("block", F.pmod(place, F.lit(blocks)).cast("int")).withColumn("group", F.pmod(F.shiftright(place, 32), F.lit(groups)).cast("int"))
    data = dealt.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    ask = dealt.where(F.col("id") % every == 0).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        out = ([], [], [])
        if left.num_rows and right.num_rows:
            width = left.column("d")[0].as_py()
            index = BitSlicedIndex(right.column("id").to_numpy(), _grid(right, width))
            for query, values in zip(left.column("id").to_pylist(), _grid(left, width), strict=True):
                ids, scores = index.top(values, k, query)
                for o, v in zip(out, (np.full(len(ids), query), ids, scores), strict=True):
                    o.append(np.asarray(v, np.int64))
        return pa.table({n: np.concatenate(o) if o else np.zeros(0, np.int64) for n, o in zip(("query_id", "vec_id", "score"), out, strict=True)})

    found = ask.groupBy("d", "block", "group").cogroup(data.groupBy("d", "block", "group")).applyInArrow(solve, "query_id long, vec_id long, score long")
    # vectors without components: every score is 0, so the smallest ids win
    empty = rows.where("d = 0").select("id")
    first = F.broadcast(empty.distinct().orderBy("id").limit(k + 1).select(F.col("id").alias("vec_id")))
    zero = empty.where(F.col("id") % every == 0).select(F.col("id").alias("query_id")).join(first, F.col("query_id") != F.col("vec_id")).select("query_id", "vec_id", F.lit(0).cast("long").alias("score"))
    found = found.unionAll(zero)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: DuckDB SQL for the same rows.
ORACLE = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(x::double * 64)::bigint) as v from embeddings where embedding is not null and vec_id is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, list_inner_product(q.v::double[], c.v::double[])::bigint as score from v q join v c on q.vec_id % 20 = 0 and q.vec_id <> c.vec_id)
select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::integer as rank, vec_id, score from s qualify rank <= 20
"""
