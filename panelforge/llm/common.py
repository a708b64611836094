"""Helpers shared by the text operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SETTING = "spark.checkpoint.dir"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. A temporary one only where the setting is absent and Spark runs in one
    process (tests); on a cluster each machine would write to a disk of its own, so that is an error."""
    found = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING, None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError(f"set {SETTING} to a folder that all machines share")
        found = tempfile.mkdtemp(prefix="panelforge-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once into the shared folder, so that what follows survives a lost executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once: as a lambda's variable it is neither computed nor copied again."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def bit_table(keys: DataFrame, column: str, words: int = 1 << 20) -> DataFrame:
    """(word, bits): a bitmap of the last bits of long keys, of ``words`` times 64 bits at most, so it may be broadcast."""
    word, bit = F.pmod(F.shiftright(column, 6), F.lit(words)).cast("int"), F.expr(f"shiftleft(1L, int(`{column}` & 63))")
    return keys.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits"))


def bit_held(df: DataFrame, column: str, table: DataFrame, words: int = 1 << 20) -> DataFrame:
    """The rows of ``df`` whose key has its bit in a table of ``bit_table``: all rows with one of its keys, and some others."""
    word, bit = F.pmod(F.shiftright(column, 6), F.lit(words)).cast("int"), F.col(column).bitwiseAND(F.lit(63)).cast("int")
    found = df.withColumn("word", word).join(F.broadcast(table), "word").where(F.getbit("bits", bit) == 1)
    return found.select(*df.columns)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until no column of ``df`` has it, whatever its case."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        out.append(n)
    return out


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns that an operator is about to write, whatever their case."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def held_out(column: str = "doc_id", parts: int = 5):
    """True where crc32 of the id as text leaves no remainder; rows without an id are held out."""
    code = F.crc32(F.col(column).cast("string").cast("binary"))
    return F.coalesce(code % parts == 0, F.lit(True))


def text_key(text: str = "text") -> list:
    """128 bits that stand for a text, as two longs; equal texts have equal keys."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return [F.xxhash64(whole).alias("k1"), F.xxhash64(whole, F.length(whole), F.lit("k2")).alias("k2")]


DISK = StorageLevel.DISK_ONLY
