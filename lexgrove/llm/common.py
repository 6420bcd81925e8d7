"""What the corpus operators share: tables, the shared folder and prefix sums that no single task has to hold."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words of the contracts: runs of bytes that are none of the six ASCII spaces.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset and Spark runs on one machine (tests), a temporary one;
    on a cluster that is an error, as each executor would write to its own disk."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="lexgrove-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def columns(df: DataFrame) -> list[Column]:
    """All columns of df by their quoted names, as names may hold dots."""
    return [F.col("`" + x.replace("`", "``") + "`") for x in df.columns]


def materialise(df: DataFrame, name: str) -> DataFrame:
    """df, written once to the shared folder and read back: later jobs neither recompute it nor depend on an executor that may be lost."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: The most rows, and bytes of their JSON, of a table that is broadcast.
BROADCAST_ROWS = 10_000
BROADCAST_BYTES = 16_000_000


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether df has few rows, and few bytes in these."""
    found = df.limit(rows + 1).agg(F.count("*").alias("n"), F.sum(F.length(F.to_json(F.struct("*")))).alias("size")).first()
    return found["n"] <= rows and (found["size"] or 0) <= BROADCAST_BYTES


def with_small(df: DataFrame, small: DataFrame, on, how: str = "inner") -> DataFrame:
    """Join with a table that is broadcast if it is small; else Spark joins by shuffle and splits skewed partitions."""
    return df.join(F.broadcast(small) if is_small(small) else small, on, how)


#: The most narrow rows of keys that are broadcast, as their reader is wide.
BROADCAST_KEYS = 400_000


def with_few(df: DataFrame, keys: DataFrame, on, how: str = "inner") -> DataFrame:
    """Join wide rows with narrow rows of numbers and digests, which are broadcast if they are few; beyond, df is shuffled."""
    few = keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    return df.join(F.broadcast(keys) if few else keys, on, how)


def running_sum(df: DataFrame, group: str, order: list[str], value: str, bucket: str, out: str) -> DataFrame:
    """df with out: the sum of value over the rows of its group that come before it by (bucket, *order).

    bucket must not decrease along order; group and bucket are not null. Rows are only brought together by (group, bucket); one row for each of
    these is summed by group, so a group that holds most of the rows is still spread over its buckets.
    """
    sums = df.groupBy(group, bucket).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(F.col(group).alias("_g"), F.col(bucket).alias("_b"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).cast("long").alias("_below"))
    inner = Window.partitionBy(group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = df.withColumn("_inside", F.coalesce(F.sum(value).over(inner), F.lit(0)).cast("long"))
    joined = inside.join(base, (inside[group] == base["_g"]) & (inside[bucket] == base["_b"]))
    return joined.withColumn(out, F.col("_below") + F.col("_inside")).drop("_g", "_b", "_below", "_inside")


def map_arrow(df: DataFrame, make, schema) -> DataFrame:
    """df through make(), which gives a function from a record batch to record batches; batches are of few rows, as texts may be long."""

    def run(batches):
        call = make()
        for batch in batches:
            yield from call(batch)
        give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """At a task's end: return to the system what it no longer holds, as Python workers stay for later tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)
