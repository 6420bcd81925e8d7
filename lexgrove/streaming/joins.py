"""Joins of two timed tables or streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str, after: str, late: str | None = None) -> DataFrame:
    """Pairs of equal keys in which right comes no earlier than left and no later than `after` it. right's columns but the keys are prefixed with r_.

    The same on tables and on streams: with `late`, both sides have watermarks, from which Spark knows when a row's partners can't come any more and
    drops its state; rows that come later than that are dropped.
    """
    a = left.withColumn("_lt", F.col(left_ts).cast("timestamp"))
    b = right.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(right_ts).cast("timestamp").alias("_rt"), *[F.col(c).alias(f"r_{c}") for c in right.columns if c not in keys])
    if late is not None:
        a, b = a.withWatermark("_lt", late), b.withWatermark("_rt", late)
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & (F.col(k) == F.col(f"_k{i}"))
    joined = a.join(b, same & (F.col("_rt") >= F.col("_lt")) & (F.col("_rt") <= F.col("_lt") + F.expr(f"interval {after}")))
    return joined.drop("_lt", "_rt", *[f"_k{i}" for i in range(len(keys))])
