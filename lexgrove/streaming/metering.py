"""Usage metering and rate limits, on tables and on streams alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def usage(calls: DataFrame, client: str, tool: str, allowed: Column) -> DataFrame:
    """(client, tool, n_allowed, n_denied); nobody's calls are anonymous."""
    return calls.groupBy(F.coalesce(F.col(client).cast("string"), F.lit("anonymous")).alias("client"), F.col(tool).alias("tool")).agg(
        F.count(F.when(allowed, 1)).alias("n_allowed"), F.count(F.when(~F.coalesce(allowed, F.lit(False)), 1)).alias("n_denied")
    )


def per_minute(calls: DataFrame, ts: str, client: str, late: str | None = None) -> DataFrame:
    """(minute, client, n) by tumbling windows. With `late`, a watermark lets state go and drops later events; ts without a zone is UTC."""
    timed = calls.withColumn("_ts", F.col(ts).cast("timestamp"))
    timed = timed.withWatermark("_ts", late) if late is not None else timed
    counted = timed.groupBy(F.window("_ts", "1 minute"), F.col(client).alias("client")).agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("minute"), "client", "n")


def violations(calls: DataFrame, ts: str, client: str, limit: int) -> DataFrame:
    return per_minute(calls, ts, client).filter(F.col("n") > limit)


def sliding(calls: DataFrame, ts: str, length: str, slide: str, late: str | None = None) -> DataFrame:
    timed = calls.withColumn("_ts", F.col(ts).cast("timestamp"))
    timed = timed.withWatermark("_ts", late) if late is not None else timed
    counted = timed.groupBy(F.window("_ts", length, slide)).agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n")


def sessions(calls: DataFrame, ts: str, client: str, gap: str, late: str | None = None) -> DataFrame:
    timed = calls.withColumn("_ts", F.col(ts).cast("timestamp"))
    timed = timed.withWatermark("_ts", late) if late is not None else timed
    counted = timed.groupBy(F.session_window("_ts", gap).alias("w"), F.col(client).alias("client")).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "client", "n")


def event_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """Parquet event files as a stream."""
    return spark.readStream.schema(schema).parquet(path)


def drain(stream: DataFrame, sink: str, checkpoint: str, mode: str = "append") -> None:
    """Run what there is of a stream into a Parquet sink, resuming from the checkpoint."""
    stream.writeStream.format("parquet").outputMode(mode).option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def drain_latest(stream: DataFrame, sink: str, checkpoint: str) -> None:
    """Run a stream of updated rows into batches of JSON lines, each row with its batch, from which the latest is taken on reading."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").json(f"{sink}/batch={number}")

    stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start().awaitTermination()


def undone(units: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What a resumed run still has to do."""
    return units.join(done.select(key).distinct(), key, "left_anti")
