"""Exact removal of repeated passages with a log-structured index of window fingerprints.

A window is ``window`` consecutive words. Its fingerprint is the least hash among the runs of ``gram`` words inside it
(a minimizer), so equal windows have equal fingerprints and neighbouring windows mostly share one: a document has
about one fingerprint for ten words. The index holds immutable runs, each a Parquet table of (anchor, k, n) sorted by
anchor: fingerprint, document (a hash of its text) and how often it holds it. Documents come in batches; each batch
becomes a run, and is merge-joined with all earlier runs. Fingerprints that an earlier run holds, or the batch itself
twice, make their windows candidates. When there are more than ``fanout`` runs they are compacted to one. An index that
is passed in also keeps the documents of a call (compressed, by k), so that a later call can verify against them: of the
earlier documents only those that share a fingerprint are read again.

Candidates are verified by content: first whole chunks (all neighbouring windows of a document under one fingerprint,
with every word they cover) by a 64-bit hash beneath the 64-bit fingerprint, then, where chunks differ, every single
window by a 64-bit hash of its words. The hashes of words have no algebraic structure that texts could meet by pattern.
Copies of a chunk count once in the second step, so a passage that sits in a third of all documents costs one row a
document. Rows meet by key through joins whose large side is splittable; no group is ever gathered in one task. Texts
travel compressed.

Defined cases: a null or empty text has no words; a document shorter than a window loses nothing; a repeated row is a
copy, so its windows are repeated; a document that an earlier call has put into the index is one more occurrence of its
windows, also if it comes again; very long texts are taken whole; ids are not looked at; an empty table gives no rows;
columns of the input named like an output are replaced.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytewords import SPACE, BASES, _POWERS, fold_table, mix, slices, windows_of, word_codes
from .common import bit_held, bit_table, shared_dir, stored, without

FOLD = fold_table(SPACE, lower=False)
LOW = np.uint64(0xFFFFFFFF)
OUT = ("n_words", "n_removed", "removed", "kept")
RUN = "anchor long, k long, n long"


def chunks_of(words: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From word hashes to chunks: fingerprint, first window, number of windows."""
    if len(words) < window:
        none = np.zeros(0, np.int64)
        return none.view(np.uint64), none, none
    grams = windows_of(words, gram)
    # ordered by the upper half of the hash, then by place: equal windows choose the same gram, and two equal windows
    # of one document choose different places, so they never share a chunk
    key = (grams & ~LOW) | np.arange(len(grams), dtype=np.uint64)
    least, have, span = key, 1, window - gram + 1
    while have < span:  # minima over runs of doubling length
        step = min(have, span - have)
        least = np.minimum(least[: len(least) - step], least[step:])
        have += step
    first = np.concatenate(([0], np.flatnonzero(least[1:] != least[:-1]) + 1))
    return grams[(least[first] & LOW).astype(np.int64)], first, np.diff(np.concatenate((first, [len(least)])))


def chunk_hashes(words: np.ndarray, anchor: np.ndarray, first: np.ndarray, count: np.ndarray, window: int) -> np.ndarray:
    """A hash of all words that the windows of a chunk cover, and of its fingerprint and length."""
    up, down = _POWERS[1].to(len(words) + 1)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[: len(words)], out=sums[1:])
    body = (sums[first + count + window - 1] - sums[first]) * down[first]
    return mix(body ^ mix(anchor + count.astype(np.uint64) * np.uint64(BASES[0])))


def documents_of(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """Row and word hashes of each text."""
    for s in slices(column):
        h = word_codes(s)
        for d in range(s.docs):
            yield s.first + d, h[s.cuts[d] : s.cuts[d + 1]]


def _longs(*columns: np.ndarray, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in columns], names=names)


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def anchors(texts: DataFrame, window: int, gram: int) -> DataFrame:
    """(anchor, k, n) of (k, text): each fingerprint of a document, and how often it has a chunk of its own there."""

    def run(batches):
        for batch in batches:
            k, out = batch.column(0).to_numpy(), ([], [], [])
            for row, words in documents_of(batch.column(1)):
                a, n = np.unique(chunks_of(words, window, gram)[0], return_counts=True)
                for o, v in zip(out, (a, np.full(len(a), k[row]).view(np.uint64), n), strict=True):
                    o.append(v)
            yield _longs(*map(_joined, out), names=["anchor", "k", "n"])

    return texts.mapInArrow(run, RUN)


JOURNAL = "at long, kind string, path string, held boolean"


class FingerprintIndex:
    """Runs of (anchor, k, n), and documents (k, packed), under a folder that all machines share.

    With a ``folder`` the index outlives its object: a journal beside the folder, one small row appended for each table that
    joins or leaves, tells what it holds, and a new object on the folder goes on from there. A table counts once its row is
    written, which is after it is whole; what a lost driver left unfinished is not in the journal and is never read. One
    writer at a time."""

    def __init__(self, spark: SparkSession, folder: str | None = None, *, fanout: int = 8):
        self.spark, self.fanout = spark, fanout
        self.lasting = folder is not None
        self.folder = folder or f"{shared_dir(spark).rstrip('/')}/index-{uuid.uuid4().hex}"
        self.journal = f"{self.folder.rstrip('/')}.journal"
        self.runs: list[str] = []
        self.texts: list[str] = []
        self.at = 0
        if self.lasting and self._there(self.journal):
            for at, kind, path, held in spark.read.schema(JOURNAL).parquet(self.journal).orderBy("at", "held").toLocalIterator():
                tables = self.runs if kind == "run" else self.texts
                (tables.append if held else tables.remove)(path)
                self.at = at + 1

    def _place(self, path: str):
        """The file system of a path, as Spark knows it, and the path there."""
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def _there(self, path: str) -> bool:
        system, place = self._place(path)
        return system.exists(place)

    def _note(self, *changes: tuple[str, str, bool]) -> None:
        """Appends (kind, path, held) rows to the journal, all or none."""
        if self.lasting:
            rows = [(self.at, *c) for c in changes]
            self.spark.createDataFrame(rows, JOURNAL).coalesce(1).write.mode("append").parquet(self.journal)
            self.at += 1

    def _write(self, df: DataFrame, kind: str) -> str:
        path = f"{self.folder}/{kind}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return path

    def read(self, paths: list[str], schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def add(self, found: DataFrame) -> DataFrame:
        """A batch's fingerprints (anchor, k, n) as one more sorted run, read from there."""
        summed = found.groupBy("anchor", "k").agg(F.sum("n").alias("n"))
        self.runs.append(self._write(summed.sortWithinPartitions("anchor", "k"), "run"))
        self._note(("run", self.runs[-1], True))
        return self.read(self.runs[-1:], RUN)

    def known(self, found: DataFrame, runs: list[str]) -> DataFrame:
        """The fingerprints of a batch that earlier runs hold, by a merge join with them."""
        earlier = self.read(runs, RUN).select("anchor").hint("merge")
        return found.select("anchor").distinct().join(earlier, "anchor", "left_semi")

    def keep(self, packed: DataFrame) -> None:
        """Documents (k, packed) that later batches are verified against."""
        self.texts.append(self._write(packed.groupBy("k").agg(F.min("packed").alias("packed")), "texts"))
        self._note(("texts", self.texts[-1], True))

    def documents(self, runs: list[str], wanted: DataFrame) -> DataFrame:
        """(k, packed, cands) of the kept documents that hold one of the fingerprints ``wanted`` in ``runs``."""
        holders = self.read(runs, RUN).join(wanted, "anchor", "left_semi").groupBy("k").agg(F.collect_list("anchor").alias("cands"))
        # a bitmap of the holders' keys keeps the texts of other documents from being shuffled
        kept = bit_held(self.read(self.texts, "k long, packed binary"), "k", bit_table(holders.select("k"), "k"))
        return kept.join(holders, "k").groupBy("k").agg(F.min("packed").alias("packed"), F.first("cands").alias("cands"))

    def compact(self) -> None:
        """All runs become one; the old ones are removed after the new one is whole."""
        if len(self.runs) > self.fanout:
            old = self.runs
            summed = self.read(old, RUN).groupBy("anchor", "k").agg(F.sum("n").alias("n"))
            self.runs = [self._write(summed.sortWithinPartitions("anchor", "k"), "run")]
            self._note(("run", self.runs[0], True), *[("run", path, False) for path in old])
            for path in old:
                system, place = self._place(path)
                system.delete(place, True)


def cover(n: int, starts: np.ndarray, window: int) -> np.ndarray:
    """Which of n words lie in a window that starts at one of ``starts``."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + window, n), -1)
    return np.cumsum(edge[:n]) > 0


def spans_of(mask: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0]))))
    return [(int(a), int(b)) for a, b in edge.reshape(-1, 2)]


def render(body: bytes, mask: np.ndarray | None) -> tuple[int, int, list[tuple[int, int]], bytes]:
    """Words, removed words, spans of them, and the kept words joined by one space."""
    words = body.translate(FOLD).split()
    if mask is None or not mask.any():
        return len(words), 0, [], b" ".join(words)
    return len(words), int(mask.sum()), spans_of(mask), b" ".join([words[i] for i in np.flatnonzero(~mask)])


def repeated_spans(docs: DataFrame, *, text: str = "text", window: int = 35, gram: int = 16, batches: int = 2, finish: str = "text", keep: list[str] | None = None, index: FingerprintIndex | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with n_words, n_removed, the removed spans of words as (start, end), and ``kept``:
    the kept words joined by one space, or with finish="sha256" the hash of that text.

    The documents go through the index in ``batches`` by a hash of their text, as a corpus would arrive. A window counts as
    repeated by what all batches of this call and, where ``index`` is passed, all earlier calls hold."""
    spark = docs.sparkSession
    docs = without(docs, *OUT)
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in OUT]
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    hidden = {c: f"__c{i}" for i, c in enumerate(kept)}
    texts = docs.select(F.xxhash64(whole).alias("k"), whole.alias("text"))
    lasting, index = index is not None, index or FingerprintIndex(spark)
    earlier, found = list(index.runs), []
    for i in range(batches):
        part = texts.where(F.pmod(F.shiftright("k", 8), F.lit(batches)) == i) if batches > 1 else texts
        before = list(index.runs)
        run = index.add(anchors(part, window, gram))
        found.append(run.groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor"))
        if before:
            found.append(index.known(run, before))
    again = found[0]
    for more in found[1:]:
        again = again.unionAll(more)
    again = stored(again.distinct(), "anchors")
    cands = index.read(index.runs[len(earlier) :], RUN).join(again, "anchor", "left_semi").groupBy("k").agg(F.collect_list("anchor").alias("cands"))

    own = docs.select(*[F.col(f"`{c}`").alias(h) for c, h in hidden.items()], F.xxhash64(whole).alias("k"), whole.alias("text"))
    fields = own.schema.fields[:-2]
    span_type = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    spans_arrow = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    result = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("removed", span_type), T.StructField("kept", T.StringType())]
    names = list(hidden.values())

    def finished(rows: list) -> list[pa.Array]:
        import hashlib

        last = [None if r is None else hashlib.sha256(r[3]).hexdigest() if finish == "sha256" else r[3].decode() for r in rows]
        return [pa.array([r and r[0] for r in rows], pa.int64()), pa.array([r and r[1] for r in rows], pa.int64()), pa.array([r and [{"start": a, "end": b} for a, b in r[2]] for r in rows], spans_arrow), pa.array(last, pa.string())]

    def pack(batches):
        for b in batches:
            z = zstandard.ZstdCompressor(level=3)
            body = pa.array([z.compress(x.as_py()) for x in b.column("text").cast(pa.large_binary())], pa.binary())
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), b.column("k"), body], names=[*names, "k", "packed"])

    def pack_texts(batches):
        for b in batches:
            z = zstandard.ZstdCompressor(level=3)
            yield pa.RecordBatch.from_arrays([b.column("k"), pa.array([z.compress(x.as_py()) for x in b.column("text").cast(pa.large_binary())], pa.binary())], names=["k", "packed"])

    packed = own.mapInArrow(pack, T.StructType([*fields, T.StructField("k", T.LongType()), T.StructField("packed", T.BinaryType())]))
    history = index.documents(earlier, again) if earlier else None
    joined = packed.join(cands, "k", "left").select(*names, "k", "packed", "cands")

    def settle(batches):
        """Documents without a candidate are done; the others keep their text."""
        for b in batches:
            z, rows, body = zstandard.ZstdDecompressor(), [], []
            cand = b.column("cands")
            for p, none in zip(b.column("packed"), cand.is_null().to_pylist(), strict=True):
                p = p.as_py()
                rows.append(render(z.decompress(p), None) if none else None)
                body.append(None if none else p)
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), b.column("k"), pa.array(body, pa.binary()), cand, *finished(rows)], names=[*names, "k", "packed", "cands", *OUT])

    shape = T.StructType([*fields, T.StructField("k", T.LongType()), T.StructField("packed", T.BinaryType()), T.StructField("cands", T.ArrayType(T.LongType())), *result])
    halfway = stored(joined.mapInArrow(settle, shape), "passages")
    done = halfway.where("packed is null").select(*names, *OUT)
    open_ = halfway.where("packed is not null")
    compared = open_.select("k", "packed", "cands")
    if history is not None:
        compared = compared.unionAll(stored(history, "history"))

    def opened(b: pa.RecordBatch):
        """Row, word hashes, and the candidate chunks (fingerprint, first window, windows, hash) of each document."""
        z = zstandard.ZstdDecompressor()
        column = pa.array([z.decompress(x.as_py()) for x in b.column("packed")], pa.large_binary()).cast(pa.large_string())
        for row, words in documents_of(column):
            a, first, count = chunks_of(words, window, gram)
            chosen = np.isin(a, np.asarray(b.column("cands")[row].values.to_numpy(zero_copy_only=False)).view(np.uint64))
            a, first, count = a[chosen], first[chosen], count[chosen]
            yield row, words, a, first, count, chunk_hashes(words, a, first, count, window)

    def chunk_rows(batches):
        for b in batches:
            k, out = b.column("k").to_numpy(), ([], [], [], [])
            for row, _, a, _, _, h in opened(b):
                _, first, n = np.unique(h, return_index=True, return_counts=True)  # a chunk's hash covers its fingerprint
                for o, v in zip(out, (np.full(len(n), k[row]).view(np.uint64), a[first], h[first], n), strict=True):
                    o.append(v)
            yield _longs(*map(_joined, out), names=["k", "anchor", "chunk", "n"])

    chunks = compared.mapInArrow(chunk_rows, "k long, anchor long, chunk long, n long")
    variants = stored(chunks.groupBy("anchor", "chunk").agg(F.sum("n").alias("n"), F.min("k").alias("k")), "chunks")
    copied = chunks.join(variants.where("n > 1").select("anchor", "chunk"), ["anchor", "chunk"], "left_semi").select("k", "chunk").distinct()
    copied = copied.groupBy("k").agg(F.collect_list("chunk").alias("copied"))
    # fingerprints with a chunk seen once beside other chunks: their windows are compared one by one
    mixed = variants.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), F.min("n").alias("least")).where("kinds > 1 and least = 1").select("anchor")
    asked = variants.join(mixed, "anchor", "left_semi").groupBy("k").agg(F.collect_list(F.when(F.col("n") == 1, F.col("chunk"))).alias("single"), F.collect_list(F.when(F.col("n") > 1, F.col("chunk"))).alias("many"))

    def members(array, values):
        return np.isin(values, np.asarray(array.values.to_numpy(zero_copy_only=False)).view(np.uint64)) if array.is_valid else np.zeros(len(values), bool)

    def window_rows(batches):
        for b in batches:
            k, out, single = b.column("k").to_numpy(), ([], []), []
            seen: set[tuple[int, int]] = set()
            for row, words, _, first, count, h in opened(b):
                one, more = members(b.column("single")[row], h), members(b.column("many")[row], h)
                values = windows_of(words, window, 1) if one.any() or more.any() else None
                for i in np.flatnonzero(one | more):
                    if more[i] and (int(k[row]), int(h[i])) in seen:
                        continue
                    seen.add((int(k[row]), int(h[i])))
                    w = values[first[i] : first[i] + count[i]]
                    out[0].append(np.full(len(w), k[row]).view(np.uint64))
                    out[1].append(w)
                    single.append(np.full(len(w), bool(one[i])))
            flag = np.concatenate(single) if single else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([pa.array(_joined(out[0]).view(np.int64)), pa.array(_joined(out[1]).view(np.int64)), pa.array(flag)], names=["k", "w", "single"])

    singles = stored(compared.join(asked, "k").mapInArrow(window_rows, "k long, w long, single boolean"), "windows")
    twice = singles.groupBy("w").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("w")
    shared = singles.where("single").join(twice, "w", "left_semi").select("k", "w").distinct().groupBy("k").agg(F.collect_list("w").alias("shared"))

    def close(batches):
        for b in batches:
            z, rows = zstandard.ZstdDecompressor(), [None] * b.num_rows
            for row, words, _, first, count, h in opened(b):
                starts = [np.zeros(0, np.int64)]
                whole_chunk = members(b.column("copied")[row], h)
                starts += [np.arange(f, f + c) for f, c in zip(first[whole_chunk], count[whole_chunk], strict=True)]
                if b.column("shared")[row].is_valid:
                    hit = members(b.column("shared")[row], windows_of(words, window, 1))
                    starts.append(np.flatnonzero(hit))
                rows[row] = render(z.decompress(b.column("packed")[row].as_py()), cover(len(words), np.concatenate(starts), window))
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), *finished(rows)], names=[*names, *OUT])

    if lasting:
        index.keep(texts.mapInArrow(pack_texts, "k long, packed binary"))
        index.compact()
    marked = open_.select(*names, "k", "packed", "cands").join(copied, "k", "left").join(shared, "k", "left")
    closed = marked.mapInArrow(close, T.StructType([*fields, *result]))
    return done.unionAll(closed).select(*[F.col(h).alias(c) for c, h in hidden.items()], *OUT)


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    return found.select(key, "n_words", "n_removed", F.col("kept").alias("kept_sha256"))


#: DuckDB SQL for the contract's columns.
ORACLE = r"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
win as (select r, i, md5(array_to_string(w[i:i + 34], ' ')) as h from d, unnest(range(1, len(w) - 33)) as t(i) where len(w) >= 35),
rep as (select r, i from win where h in (select h from win group by h having count(*) > 1)),
gone as (select r, list(distinct j) as js from (select r, unnest(range(i, i + 35)) as j from rep) group by r)
select d.doc_id, len(w)::bigint as n_words, coalesce(len(js), 0)::bigint as n_removed,
  sha256(array_to_string(case when js is null then w else [w[j] for j in range(1, len(w) + 1) if not list_contains(js, j)] end, ' ')) as kept_sha256
from d left join gone on d.r = gone.r
"""
