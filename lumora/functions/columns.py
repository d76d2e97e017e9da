"""Columns and windows used by several operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ndcg(rank: Column, k: int) -> Column:
    """1 / log2(rank + 1) within the first k ranks, else 0."""
    return F.when(rank <= k, 1 / F.log2(rank + 1)).otherwise(0.0)


def hit(rank: Column, k: int) -> Column:
    return F.when(rank <= k, 1.0).otherwise(0.0)


def percent_rank_average(df: DataFrame, value: str, name: str) -> DataFrame:
    """df with the percentile rank of `value`, ties at their mean rank, divided by the number of rows.

    Counts by value are made first, so what goes through the single running sum is one row a distinct value.
    """
    counts = df.groupBy(value).agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("_n").over(Window.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    ranks = counts.withColumn(name, (upto - (F.col("_n") - 1) / 2) / total).select(value, name)
    return df.join(ranks, value)


def zscore(value: str, keys: list[str]) -> Column:
    """The value less its mean over the population deviation of its row (1e-8 at least)."""
    w = Window.partitionBy(*keys)
    return (F.col(value) - F.avg(value).over(w)) / F.greatest(F.stddev_pop(value).over(w), F.lit(1e-8))


def half_life(age: Column, half: float) -> Column:
    """0.5 ** (age / half), or 1 without a half life."""
    return F.pow(F.lit(0.5), age / half) if half else F.lit(1.0)


def gini(df: DataFrame, value: str) -> DataFrame:
    """One row with the Gini coefficient of a nonnegative column, from counts by value; 0 if all are zero or there are none.

    Of the values in ascending order, a run of n equal ones after m smaller ones has ranks m + 1 to m + n.
    """
    counts = df.groupBy(value).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = counts.withColumn("ranks", F.col("n") * before + F.col("n") * (F.col("n") + 1) / 2)
    sums = ranked.agg(F.sum(F.col(value) * F.col("ranks")).alias("weighted"), F.sum(F.col(value) * F.col("n")).alias("total"), F.sum("n").alias("rows"))
    return sums.select(F.coalesce(F.try_divide(2 * F.col("weighted") - (F.col("rows") + 1) * F.col("total"), F.col("rows") * F.col("total")), F.lit(0.0)).alias("gini"))
