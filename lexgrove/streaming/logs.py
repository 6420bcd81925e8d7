"""Append-only logs: the order of their records, however they are split, and merges that a replayed batch doesn't change."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def ordered(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with `at`, by which records compare as they were appended: files by the time they were last written and by name, within a file by
    the block that a task read and by the place there. A block's lines are read in order by one task, so the running id orders them."""
    lines = spark.read.schema(schema).json(path)
    meta = F.col("_metadata")
    at = F.struct(meta["file_modification_time"].alias("t"), meta["file_path"].alias("file"), meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("n"))
    return lines.withColumn("at", at)


def last_of(rows: DataFrame, keys: list[str], at: str = "at") -> DataFrame:
    """The last record of each key; whole rows are compared by `at` in the tasks before they are shuffled."""
    columns = [c for c in rows.columns if c != at]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*[F.col(c) for c in columns if c not in keys]), F.col(at)).alias("_x")).select(*keys, "_x.*")


def append_batches(stream: DataFrame, sink: str, checkpoint: str, keys: list[str], order: list[str]) -> None:
    """Run what there is of a stream into sink: of each micro-batch, the last record of each key by order, in a folder named by the batch. A batch that is
    replayed writes the same folder again, so it changes nothing."""

    def write(batch: DataFrame, number: int) -> None:
        merge_batch(batch, number, sink, keys, order)

    stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start().awaitTermination()


def merge_batch(batch: DataFrame, number: int, sink: str, keys: list[str], order: list[str]) -> None:
    last = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    batch.withColumn("_r", F.row_number().over(last)).filter("_r = 1").drop("_r").write.mode("overwrite").parquet(f"{sink}/batch={number}")


def merged(spark: SparkSession, sink: str, keys: list[str]) -> DataFrame:
    """The record of each key from its last batch."""
    return last_of(spark.read.parquet(sink), keys, "batch")
