"""Models fitted on a bounded sample of labelled documents, in one task of an executor."""

from __future__ import annotations

import pickle
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import held_out, stored

EMPTY = pa.table({"text": pa.array([], pa.string()), "label": pa.array([], pa.int32())})


def training_sample(docs: DataFrame, labels: DataFrame, label: str, *, key: str = "doc_id", text: str = "text", most: int = 6_000, most_bytes: int = 32 << 20) -> DataFrame:
    """(h, id, text, label) of at most ``most`` labelled documents with at most ``most_bytes`` bytes of text in all, chosen
    and ordered by a hash of the id; whole texts, and the first one whatever its length.

    Rows that are held out, or without an id or label, never take part; of rows that repeat an id the first text by
    code point counts, null as empty. The ids are bounded by ``most``, so they are broadcast to the documents.
    """
    ids = labels.where(~held_out(key) & F.col(label).isNotNull()).groupBy(F.col(f"`{key}`").alias("id")).agg(F.max(f"`{label}`").cast("int").alias("label"))
    ids = ids.withColumn("h", F.xxhash64("id", F.lit(label))).orderBy("h", "id").limit(most)
    found = docs.select(F.col(f"`{key}`").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).join(F.broadcast(ids), "id")
    found = stored(found.groupBy("h", "id").agg(F.min("text").alias("text"), F.max("label").alias("label")), "sample")
    total = F.sum(F.octet_length("text").cast("long")).over(Window.orderBy("h", "id"))  # over ``most`` lengths, not texts
    sizes = found.select("h", "id", total.alias("total"), F.row_number().over(Window.orderBy("h", "id")).alias("place"))
    inside = sizes.where((F.col("total") <= most_bytes) | (F.col("place") == 1)).select("h", "id")
    return found.join(F.broadcast(inside), ["h", "id"]).select("h", "id", "text", "label")


def fitted(sample: DataFrame, train: Callable[[pa.Table], object]) -> object:
    """What ``train`` makes of the (text, label) rows of a sample, in order. It runs in one task, so that neither texts nor
    what training needs ever are on the driver, and a lost executor only means another try."""

    def run(batches):
        rows = list(batches)
        if rows:
            table = pa.Table.from_batches(rows).sort_by([("h", "ascending"), ("id", "ascending")]).select(["text", "label"])
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(table))], pa.binary())], names=["model"])

    found = sample.repartition(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(found[0].model) if found else train(EMPTY)
