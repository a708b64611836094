"""Benchmark decontamination by Wu-Manber search over words.

Texts and test items are lower-cased (A-Z) and cut into words of digits, ASCII letters and non-ASCII characters.
The patterns are all runs of ``window`` words of every item; an item of fewer words is one pattern of its own
length. For each pattern length there is one table set: the shift table says for a block of two words how far the
search may skip, a block with shift 0 is the suffix of patterns, whose bucket is keyed once more by the first block, and
a direct comparison of the words confirms an occurrence.

The items are read in blocks of ``block_bytes``. Each block travels as text and is compiled by the workers to flat tables
of about ten times its size (shifts and marks by hashed place, buckets as sorted arrays); it adds its findings to the
rows passing through. At most ``at_once`` blocks are searched in one stage, then the rows are written out, so the memory
of an executor is bounded whatever the size of the benchmark. Nothing is shuffled.

Defined cases: a null or empty text has no words and is clean; items without words match nothing; a null item_id
is reported as the empty string; items that repeat an id count once; an empty benchmark leaves every document
clean; columns of the input named like an output column are replaced; repeated rows are judged one by one; very long
texts and items are searched whole.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytewords import fold_table
from .common import stored, without

SEPARATORS = bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
FOLD = fold_table(SEPARATORS, lower=True)
OUT = ("n_words", "spans", "item_ids")
SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(FOLD).split() if text else []


class WuManber:
    """Patterns of one length: ``places`` are their starts in the list ``words``, ``owners`` the items that hold them."""

    def __init__(self, length: int, words: list[bytes], places: list[int], owners: list[int]):
        self.length = m = length
        self.words, self.block = words, min(2, m)
        b = self.block
        self.skip = min(m - b + 1, 255)
        self.mask = (1 << max(10, (4 * len(places)).bit_length())) - 1
        self.shift = bytearray([self.skip]) * (self.mask + 1)
        self.marks = bytearray(self.mask + 1)
        keys = np.empty(len(places), np.int64)
        for n, at in enumerate(places):
            # every block but an item's first ones ends a pattern; two blocks in one slot only make the search skip less
            for end in range(b if n == 0 or owners[n] != owners[n - 1] else m, m + 1):
                slot = hash(tuple(words[at + end - b : at + end])) & self.mask
                if m - end < self.shift[slot]:
                    self.shift[slot] = m - end
            keys[n] = key = hash((tuple(words[at : at + b]), tuple(words[at + m - b : at + m])))
            self.marks[key & self.mask] = 1
        order = np.argsort(keys, kind="stable")
        self.keys, self.places, self.owners = keys[order], np.asarray(places, np.int64)[order], np.asarray(owners, np.int64)[order]

    def find(self, words: list[bytes]) -> Iterator[tuple[int, list[int]]]:
        """Starts of the occurrences, in order, each with its items."""
        m, b, shift, mask, marks = self.length, self.block, self.shift, self.mask, self.marks
        end, n = m, len(words)
        while end <= n:
            suffix = tuple(words[end - b : end])
            step = shift[hash(suffix) & mask]
            if step:
                end += step
                continue
            start = end - m
            key = hash((tuple(words[start : start + b]), suffix))
            if marks[key & mask]:
                i, j = np.searchsorted(self.keys, key, "left"), np.searchsorted(self.keys, key, "right")
                here = words[start:end]
                items = [int(self.owners[x]) for x in range(i, j) if self.words[(at := self.places[x]) : at + m] == here]
                if items:
                    yield start, items
            end += 1


def compile_items(items: list[tuple[str, bytes | None]], window: int) -> list[WuManber]:
    """One searcher for each pattern length; patterns refer to items by place."""
    words: list[bytes] = []
    one: dict[bytes, bytes] = {}
    by_length: dict[int, tuple[list[int], list[int]]] = {}
    for at, (_, text) in enumerate(items):
        w = [one.setdefault(x, x) for x in words_of(text)]
        size = min(window, len(w))
        if size:
            places, owners = by_length.setdefault(size, ([], []))
            places += range(len(words), len(words) + len(w) - size + 1)
            owners += [at] * (len(w) - size + 1)
            words += w
    return [WuManber(size, words, *found) for size, found in sorted(by_length.items(), reverse=True)]


_COMPILED: dict[str, list[WuManber]] = {}


def compiled(name: str, items: list[tuple[str, bytes | None]], window: int) -> list[WuManber]:
    """The searchers of a block, made once in a worker, which forgets those of the block before."""
    if name not in _COMPILED:
        _COMPILED.clear()
        _COMPILED[name] = compile_items(items, window)
    return _COMPILED[name]


def blocks_of(benchmark: DataFrame, item_id: str, text: str, block_bytes: int) -> Iterator[list[tuple[str, bytes | None]]]:
    rows = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")), F.col(text)).toLocalIterator()
    block, held = [], 0
    for key, body in rows:
        body = body.encode() if body is not None else None
        block.append((key, body))
        held += len(body or b"")
        if held >= block_bytes:
            yield block
            block, held = [], 0
    if block:
        yield block


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans that neither overlap nor touch."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            if e > out[-1][1]:
                out[-1] = (out[-1][0], e)
        else:
            out.append((s, e))
    return out


def find_items(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, block_bytes: int = 8 << 20, at_once: int = 2, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with n_words, spans of hit words as (start, end), and item_ids as sorted strings."""
    spark = docs.sparkSession
    docs = without(docs, *OUT)
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in OUT]
    schema = T.StructType([*docs.select(*[f"`{c}`" for c in kept]).schema.fields, T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))), T.StructField("item_ids", T.ArrayType(T.StringType()))])
    source = docs.select(*[f"`{c}`" for c in dict.fromkeys([*kept, text])])

    passing = source.columns

    def scan(table, name: str, final: bool, first: bool):
        def run(batches):
            items = table.value
            ids, searchers = [k for k, _ in items], compiled(name, items, window)
            for batch in batches:
                body = batch.column(batch.schema.get_field_index(text)).cast(pa.large_binary())
                before = None if first else (batch.column("spans").to_pylist(), batch.column("item_ids").to_pylist())
                counts, spans, found = [], [], []
                for row, raw in enumerate(body):
                    words = words_of(raw.as_py())
                    hit, found_items = ([], set()) if before is None else ([(x["start"], x["end"]) for x in before[0][row]], set(before[1][row]))
                    for s in searchers:
                        for start, at in s.find(words):
                            end = start + s.length
                            if hit and hit[-1][0] <= start <= hit[-1][1] <= end:
                                hit[-1] = (hit[-1][0], end)
                            else:
                                hit.append((start, end))
                            found_items.update(ids[i] for i in at)
                    counts.append(len(words))
                    spans.append([{"start": s, "end": e} for s, e in merge(hit)])
                    found.append(sorted(found_items, key=str.encode))
                names = kept if final else passing
                yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names), pa.array(counts, pa.int64()), pa.array(spans, SPANS), pa.array(found, pa.list_(pa.string()))], names=[*names, *OUT])

        return run

    blocks = blocks_of(benchmark, item_id, item_text, block_bytes)
    pending, current, n = next(blocks, []), source, 0
    while pending is not None:
        after = next(blocks, None)
        shape = schema if after is None else T.StructType([*source.schema.fields, *schema.fields[-3:]])
        current = current.mapInArrow(scan(spark.sparkContext.broadcast(pending), uuid.uuid4().hex, after is None, n == 0), shape)
        pending, n = after, n + 1
        if pending is not None and n % at_once == 0:
            current = stored(current, "searched")
    return current


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """The contract's columns: counts of hit words and items, and a hash of the item list."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return found.select(
        key, "n_words", hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without any word of a test item's window, with their own columns only."""
    hidden = {c: f"__in_{i}" for i, c in enumerate(docs.columns) if c.lower() in OUT}
    found = find_items(docs.withColumnsRenamed(hidden), benchmark, **options).where(F.size("spans") == 0)
    return found.select(*[F.col(f"`{hidden.get(c, c)}`").alias(c) for c in docs.columns])


#: DuckDB SQL for ``digest``; words, windows of every needed length, then the hit words.
ORACLE = r"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select coalesce(cast(item_id as varchar), '') as id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
bw as (select distinct id, least(len(w), 10) as k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') as p from b, unnest(range(1, len(w) - least(len(w), 10) + 2)) as t(i) where len(w) > 0),
ks as (select distinct k from bw),
dw as (select r, i, k, array_to_string(w[i:i + k - 1], ' ') as p from d, ks, unnest(range(1, len(w) - k + 2)) as t(i)),
hits as (select dw.r, dw.i, dw.k, bw.id from dw join bw on dw.p = bw.p and dw.k = bw.k),
hw as (select r, count(distinct j) as n_hit from (select r, unnest(range(i, i + k)) as j from hits) group by r),
hi as (select r, count(distinct id) as n_items, array_to_string(list_sort(list_distinct(list(id))), ',') as ids from hits group by r)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(hw.n_hit, 0)::bigint as n_hit, coalesce(hi.n_items, 0)::bigint as n_items, sha256(coalesce(hi.ids, '')) as items_sha256, coalesce(hw.n_hit, 0) > 0 as contaminated
from d left join hw on d.r = hw.r left join hi on d.r = hi.r
"""
