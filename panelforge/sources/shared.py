"""Where intermediate results go that must outlive the executor that made them."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once into the folder of spark.checkpoint.dir. A temporary folder stands in only where Spark runs in one
    process (tests); on a cluster each machine would write to a disk of its own, so that is an error."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        found = context.getConf().get("spark.checkpoint.dir", None)
        if not found and (not context.master.startswith("local") or context.master.startswith("local-cluster")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        context.setCheckpointDir(found or tempfile.mkdtemp(prefix="panelforge-"))
    return df.checkpoint(eager=True)
