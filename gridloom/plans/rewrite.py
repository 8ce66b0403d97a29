"""Rewrites that are stated, not left to the optimizer: reduce each branch, then merge."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

Step = Callable[[DataFrame], DataFrame]


def reduce_then_merge(branches: dict[str, DataFrame], partial: Step, final: Step) -> DataFrame:
    """Applies `partial` to each branch below the union, tagged source_region, and `final` above it."""
    return final(reduce(DataFrame.unionByName, [partial(df).withColumn("source_region", F.lit(name)) for name, df in branches.items()]))


def distinct_below_union(branches: dict[str, DataFrame]) -> DataFrame:
    """Distinct in each branch, then over all: duplicates don't cross the boundary."""
    return reduce(DataFrame.union, [df.distinct() for df in branches.values()]).distinct()


def topk_below_union(branches: dict[str, DataFrame], order: list, k: int) -> DataFrame:
    """The k first of all branches: each branch keeps its own k first, task by task, before they meet."""
    return reduce(DataFrame.unionByName, [df.withColumn("source_region", F.lit(name)).orderBy(*order).limit(k) for name, df in branches.items()]).orderBy(*order).limit(k)


def ranked_by_hash(df: DataFrame, digest: str, tie: str) -> DataFrame:
    """df with `place`, 1.. by a hex digest: rows are ranked within the digest's first three digits, and 4,096 counts place these."""
    bucketed = df.withColumn("bucket_", F.substring(digest, 1, 3))
    counts = bucketed.groupBy("bucket_").agg(F.count(F.lit(1)).alias("n_"))
    before = F.coalesce(F.sum("n_").over(Window.orderBy("bucket_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(Window.partitionBy("bucket_").orderBy(digest, tie))
    placed = bucketed.join(F.broadcast(counts.select("bucket_", before.alias("before_"))), "bucket_")
    return placed.withColumn("place", (F.col("before_") + own).cast("long")).drop("bucket_", "before_")


def counted_up_to(df: DataFrame, value: str, buckets: int = 1024) -> DataFrame:
    """df with `up_to`, the rows whose value is at most the row's own, and `total`: equal ranges of values are summed first."""
    edges = df.agg(F.min(value).alias("low_"), F.max(value).alias("high_"), F.count(F.lit(1)).alias("total"))
    width = (F.col("high_") - F.col("low_")) / buckets
    bucketed = df.join(F.broadcast(edges)).withColumn("bucket_", F.when(width > 0, F.least(F.floor((F.col(value) - F.col("low_")) / width), F.lit(buckets - 1))).otherwise(F.lit(0)))
    counts = bucketed.groupBy("bucket_").agg(F.count(F.lit(1)).alias("n_"))
    before = F.coalesce(F.sum("n_").over(Window.orderBy("bucket_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.count(F.lit(1)).over(Window.partitionBy("bucket_").orderBy(value).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    placed = bucketed.join(F.broadcast(counts.select("bucket_", before.alias("before_"))), "bucket_")
    return placed.withColumn("up_to", F.col("before_") + own).drop("low_", "high_", "bucket_", "before_")


def fenced(df: DataFrame, path: str) -> DataFrame:
    """A materialised common table: written once, read by all who use it."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)
