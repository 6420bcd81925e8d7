"""Ordered operators; every one names its order in full."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexgrove.operators.store import kept, small

def carried(df: DataFrame, groups: list[str], order: list, value: Column, out: str) -> DataFrame:
    """The last value that isn't null up to each row."""
    w = Window.partitionBy(*groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.last(value, ignorenulls=True).over(w))


def next_of_rank(df: DataFrame, groups: list[str], order: list, rank: str, position: str, ranks: list[int], end: Column, out: str) -> DataFrame:
    """Position of the next row of equal or higher rank (a lower number is higher), else end: where a nested span closes."""
    w = Window.partitionBy(*groups).orderBy(*order).rowsBetween(1, Window.unboundedFollowing)
    found = F.lit(None)
    for r in ranks:
        found = F.when(F.col(rank) == r, F.min(F.when(F.col(rank) <= r, F.col(position))).over(w)).otherwise(found)
    return df.withColumn(out, F.coalesce(found, end))


def first_per_group(df: DataFrame, groups: list[str], order: list, n: int = 1, rank: str = "_rank") -> DataFrame:
    """The first n rows of each group; Spark cuts each task's rows to n before it shuffles them."""
    w = Window.partitionBy(*groups).orderBy(*order)
    out = df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)
    return out.drop(rank) if rank == "_rank" else out


def capped(df: DataFrame, groups: list[str], order: list, n: int, total: str, rank: str) -> DataFrame:
    """The first n rows of each group with the group's whole count, which is aggregated apart and joined."""
    totals = df.groupBy(*groups).agg(F.count("*").alias(total))
    return first_per_group(df, groups, order, n, rank).join(totals, groups)


def hash_sample(df: DataFrame, strata: list[str], key: str, sizes: DataFrame) -> DataFrame:
    """Of each stratum the rows of the least sha256(key), as many as sizes (strata, k) says."""
    hashed = df.withColumn("_h", F.sha2(F.col(key).cast("string").cast("binary"), 256))
    w = Window.partitionBy(*strata).orderBy("_h")
    return hashed.join(F.broadcast(sizes) if small(sizes) else sizes, strata).withColumn("_r", F.row_number().over(w)).filter("_r <= k").drop("_h", "_r", "k")


def positions(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """df with out: each row's place from 0 in the whole order. Rows are sorted by ranges and counted range by range, so no task sees all of them;
    what is summed in one place is a row for each range."""
    ranged = kept(df.orderBy(*order).select("*", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().alias("_m")))
    counts = ranged.groupBy("_p").agg(F.count("*").alias("_c"), F.min("_m").alias("_least"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("_p", "_least", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_base"))
    return ranged.join(F.broadcast(base), "_p").withColumn(out, F.col("_base") + F.col("_m") - F.col("_least")).drop("_p", "_m", "_least", "_base")


def allocate(sizes: dict, total: int, least: int) -> dict:
    """Sample sizes by stratum: floors of the proportional quotas but at least `least` (or all), repaired by largest remainders, keys
    breaking ties. The strata are few; their sizes are counted in Spark."""
    population = sum(sizes.values())
    quota = {k: total * n / population for k, n in sizes.items()} if population else {}
    out = {k: min(sizes[k], max(least, int(q))) for k, q in quota.items()}
    remainder = lambda k: quota[k] - int(quota[k])
    while (gap := min(total, population) - sum(out.values())) != 0:
        if gap > 0:
            open_ = sorted((k for k in out if out[k] < sizes[k]), key=lambda k: (-remainder(k), k))
        else:
            open_ = sorted((k for k in out if out[k] > min(least, sizes[k])), key=lambda k: (-(out[k] - quota[k]), k))
        if not open_:
            break
        out[open_[0]] += 1 if gap > 0 else -1
        quota[open_[0]] = float(int(quota[open_[0]])) if gap > 0 else quota[open_[0]]
    return out
