"""Percentiles in the spellings that reports use, and gate verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wiretally.operators import order


def nearest_rank(value: str, q: float) -> Column:
    """v[ceil(q * n) - 1] of the sorted values: the smallest value with at least that share at or below it.

    As an aggregate it holds a group's distinct values; order.exact_percentiles takes groups of any size.
    """
    return F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {value})")


def rounded_rank(df: DataFrame, value: str, p: float, *keys: str) -> DataFrame:
    """keys, value: v[round(p * (n - 1))], halves to even; by global ranks, so no group is gathered anywhere."""
    return order.at_ranks(df, value, {"value": F.bround((F.col("n") - 1) * F.lit(p))}, *keys)


def median_spread(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """Median, and the range as a percentage of it; the median by global ranks."""
    ends = df.groupBy(*keys).agg(F.max(value).alias("_hi"), F.min(value).alias("_lo"))
    out = ends.join(order.interpolated_percentiles(df, value, {"median": 0.5}, *keys), list(keys))
    return out.withColumn("spread", F.when(F.col("median") != 0, (F.col("_hi") - F.col("_lo")) / F.col("median") * 100)).drop("_hi", "_lo")


def gate(df: DataFrame, delta: str, tolerance: float, least: int, *keys: str) -> DataFrame:
    """Whether a group has enough samples and its 90th percentile of absolute deltas is within tolerance."""
    samples = df.groupBy(*keys).agg(F.count("*").alias("samples"))
    out = samples.join(order.exact_percentiles(df.withColumn("_d", F.abs(delta)), "_d", {"p90": 0.9}, *keys), list(keys), "left")
    return out.withColumn("ok", (F.col("samples") >= least) & F.coalesce(F.col("p90") <= tolerance, F.lit(False)))
