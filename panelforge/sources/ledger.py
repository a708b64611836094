"""What a run leaves beside its tables: fingerprints, key checks, a stage ledger, and reports of small results."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEDGER = "run string, stage string, fingerprint string, n_rows long, status string"


def fingerprint(config: dict, *schemas: str) -> str:
    """SHA-256 of a configuration and the schemas it reads, the same whatever the order of its keys."""
    text = json.dumps([config, list(schemas)], sort_keys=True, default=str)
    return hashlib.sha256(text.encode()).hexdigest()


def digest(rows: DataFrame, keys: list[str]) -> dict:
    """Rows, distinct keys and an order-free sum of key hashes: one aggregate, whatever the partitioning."""
    hashed = rows.select(F.xxhash64(*keys).alias("h"), F.struct(*keys).alias("k"))
    r = hashed.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("k").alias("n_keys"), F.sum(F.col("h").cast("decimal(38,0)")).alias("sum")).first()
    return {"n_rows": r.n_rows, "n_keys": r.n_keys, "key_hash": str(r["sum"] or 0), "schema": hashlib.sha256(rows.schema.json().encode()).hexdigest()}


def check_aligned(a: DataFrame, b: DataFrame, keys: list[str]) -> None:
    """Raises where two tables do not hold the same keys once each."""
    x, y = digest(a, keys), digest(b, keys)
    if x["n_rows"] != x["n_keys"] or y["n_rows"] != y["n_keys"]:
        raise ValueError("a key is repeated")
    if (x["n_rows"], x["key_hash"]) != (y["n_rows"], y["key_hash"]):
        raise ValueError("the tables hold different keys")


def finished(spark: SparkSession, path: str, run: str, stage: str, mark: str) -> bool:
    """Whether the ledger says that this stage is done with this fingerprint; another fingerprint under the run raises."""
    try:
        rows = spark.read.schema(LEDGER).parquet(path).where((F.col("run") == run) & (F.col("stage") == stage))
        marks = {r.fingerprint for r in rows.where("status = 'done'").select("fingerprint").distinct().limit(2).collect()}
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(e):
            return False
        raise
    if marks - {mark}:
        raise ValueError(f"run {run} finished {stage} with other inputs")
    return mark in marks


def record(spark: SparkSession, path: str, run: str, stage: str, mark: str, n_rows: int, status: str = "done") -> None:
    """Appends one row; the committer makes it visible only when whole."""
    spark.createDataFrame([(run, stage, mark, n_rows, status)], LEDGER).coalesce(1).write.mode("append").parquet(path)


def run_stage(spark: SparkSession, folder: str, run: str, stage: str, config: dict, build) -> DataFrame:
    """The stage's table, built and recorded unless the ledger has it already with the same configuration."""
    mark, table, ledger = fingerprint(config), f"{folder}/{run}/{stage}", f"{folder}/ledger"
    if not finished(spark, ledger, run, stage, mark):
        build().write.mode("overwrite").option("compression", "zstd").parquet(table)
        record(spark, ledger, run, stage, mark, spark.read.parquet(table).count())
    return spark.read.parquet(table)


def markdown(rows: DataFrame, most: int = 200) -> str:
    """A report table of a small result; a result of more than ``most`` rows raises, so nothing large reaches the driver."""
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"a report holds {most} rows at most")
    cell = lambda v: "" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v).replace("|", "\\|").replace("\n", " ")
    lines = [rows.columns, ["---"] * len(rows.columns), *[[cell(v) for v in r] for r in found]]
    return "\n".join("| " + " | ".join(line) + " |" for line in lines)
