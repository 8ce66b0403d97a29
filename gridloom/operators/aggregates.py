"""Aggregates that the evidence and intervention layers use, as columns for groupBy().agg() or as whole steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions import exprs as X


def spread(x: Column, prefix: str) -> list[Column]:
    """Sum, extremes, mean, CV, largest share, imbalance, smallest over largest and share of positive members."""
    n, total, top = F.count(x), F.sum(X.exact(x)).cast("double"), F.max(x)
    share = X.safe_divide(top, total)
    made = {
        "sum": total, "min": F.min(x), "max": top, "mean": F.round(total / F.nullif(n, F.lit(0)), 6), "cv": F.round(X.population_cv(x), 6), "max_share": F.round(share, 6),
        "isf": F.round(share * n, 6), "isf_norm": F.round(X.imbalance_normalized(share * n, n), 6), "cv_norm": F.round(X.cv_normalized(X.population_cv(x), n), 6),
        "min_max_ratio": F.round(X.safe_divide(F.min(x), top), 6), "active_share": F.round(F.count_if(x > 0) / F.nullif(n, F.lit(0)), 6),
    }
    return [c.alias(f"{prefix}_{name}") for name, c in made.items()]


def complete(x: Column, value: Column) -> Column:
    """The value only where every row of the group has an observation."""
    return F.when(F.count(x) == F.count(F.lit(1)), value)


def largest_signed(x: Column) -> Column:
    """The value of the largest magnitude; a positive one wins a tie."""
    return F.max(F.struct(F.abs(x).alias("magnitude"), x.alias("signed")))["signed"]


def mode(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """The most frequent value a group, the least of those that tie; NULLs aren't counted."""
    counted = df.filter(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count(F.lit(1)).alias("times"))
    return counted.groupBy(*keys).agg(F.min(F.struct((-F.col("times")).alias("t"), column))[column].alias("mode"), F.max("times").alias("times"))


def nearest_rank(x: Column, p: float) -> Column:
    """The value at place ceil(p * n) in order; values of a group are sorted where they are gathered."""
    found = F.array_sort(F.collect_list(x))
    return F.element_at(found, F.greatest(F.ceil(F.size(found) * F.lit(p)), F.lit(1)).cast("int"))


def nearest_rank_of(df: DataFrame, keys: list[str], column: str, p: float) -> DataFrame:
    """nearest_rank without gathering: two counts a value, for groups of any size."""
    counted = df.filter(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*keys)
    placed = counted.withColumn("upto", F.sum("n").over(w.orderBy(column))).withColumn("all", F.sum("n").over(w))
    return placed.filter(F.col("upto") >= F.ceil(F.col("all") * p)).groupBy(*keys).agg(F.min(column).alias("value"))


def robust_dispersion(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Median, median absolute deviation, and 1.4826 * MAD over the median's magnitude."""
    centers = df.groupBy(*keys).agg(F.median(column).alias("median"))
    joined = df.join(centers, keys)
    out = joined.groupBy(*keys, "median").agg(F.median(F.abs(F.col(column) - F.col("median"))).alias("mad"))
    return out.withColumn("dispersion", F.round(F.lit(1.4826) * F.col("mad") / F.nullif(F.abs("median"), F.lit(0.0)), 6))


def weighted_median(df: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """The least value up to which the weights reach half of their sum."""
    w = Window.partitionBy(*keys)
    placed = df.withColumn("cum", F.sum(weight).over(w.orderBy(value).rangeBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("total", F.sum(weight).over(w))
    return placed.filter(F.col("cum") >= F.col("total") / 2).groupBy(*keys).agg(F.min(value).alias("weighted_median"))


def weighted_moments(value: Column, weight: Column) -> tuple[Column, Column]:
    """Weighted mean and population deviation."""
    total = F.nullif(F.sum(weight), F.lit(0.0))
    mean = F.sum(weight * value) / total
    return mean, F.sqrt(F.greatest(F.sum(weight * value * value) / total - mean * mean, F.lit(0.0)))


def effective_sample_size(weight: Column) -> Column:
    return F.sum(weight) * F.sum(weight) / F.nullif(F.sum(weight * weight), F.lit(0.0))


def harmonic_mean(x: Column) -> Column:
    """Of the positive values."""
    positive = F.when(x > 0, 1.0 / x)
    return F.count(positive) / F.nullif(F.sum(positive), F.lit(0.0))


def sample_deviation(x: Column) -> Column:
    """Sample deviation, 0 for one value."""
    return F.when(F.count(x) == 1, F.lit(0.0)).otherwise(F.stddev_samp(x))


def joined_set(x: Column) -> Column:
    return F.array_join(F.array_sort(F.collect_set(x)), ",")


def merged_counters(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Sums of JSON counter maps: one row a group and name."""
    parsed = df.select(*keys, F.explode(F.from_json(column, "map<string,double>")).alias("name", "n"))
    return parsed.groupBy(*keys, "name").agg(F.sum("n").alias("total"))


def one_hot(df: DataFrame, column: str, categories: list[str]) -> DataFrame:
    """A 0/1 column a category; NULL stays NULL in all of them."""
    return df.withColumns({f"{column}__{c}": F.when(F.col(column).isNotNull(), (F.col(column) == c).cast("int")) for c in categories})


def average_rank(x: str, window) -> Column:
    """Rank with ties at their mean place."""
    same = Window.partitionBy(*window, x)
    return F.rank().over(Window.partitionBy(*window).orderBy(x)) + (F.count(F.lit(1)).over(same) - 1) / 2.0


def quantile_bin(df: DataFrame, column: str, bins: int) -> DataFrame:
    """bin 0..bins-1 by quantile edges of the whole column; equal values share a bin."""
    edges = df.agg(F.percentile(column, F.array(*[F.lit(i / bins) for i in range(1, bins)])).alias("edges"))
    return df.join(F.broadcast(edges)).withColumn("bin", F.aggregate("edges", F.lit(0), lambda s, e: s + F.when(F.col(column) > e, 1).otherwise(0))).drop("edges")
