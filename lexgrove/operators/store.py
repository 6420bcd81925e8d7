"""Cutting lineage, and what may be broadcast."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The most rows, and bytes of their JSON, of a table that is broadcast.
ROWS, BYTES = 1_000_000, 64_000_000


def small(df: DataFrame, rows: int = ROWS) -> bool:
    """Whether df has few rows, and few bytes in these."""
    found = df.limit(rows + 1).agg(F.count("*").alias("n"), F.sum(F.length(F.to_json(F.struct("*")))).alias("size")).first()
    return found["n"] <= rows and (found["size"] or 0) <= BYTES


def folder(df: DataFrame) -> str:
    """spark.checkpoint.dir, or where that is unset and Spark runs on one machine (tests), a temporary folder; on a cluster that is an error."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        found = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not found:
            if not re.match(r"local(\[|$)", context.master):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            found = tempfile.mkdtemp(prefix="lexgrove-")
        context.setCheckpointDir(found)
    return context.getCheckpointDir()


def kept(df: DataFrame) -> DataFrame:
    """df, computed and checkpointed in the folder that driver and executors share, so a lost executor costs no more than its own tasks."""
    folder(df)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """df, computed and written to that folder as compressed columns, which take a fraction of a checkpoint's bytes and stay until the folder's owner removes them."""
    path = f"{folder(df)}/rows-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
