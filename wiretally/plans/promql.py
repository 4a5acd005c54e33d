"""PromQL-like functions over a scrape table (ts in epoch seconds, name, labels map, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wiretally.operators import hist


def label(name: str) -> Column:
    return F.col("labels")[name]


def series_key() -> Column:
    """Labels in a canonical spelling, since maps can be no grouping keys."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries("labels"))))


def select(scrapes: DataFrame, name: str, **matchers: str) -> DataFrame:
    """The series of a metric; a matcher starting with ~ is an anchored regular expression."""
    out = scrapes.where(F.col("name") == name)
    for k, v in matchers.items():
        out = out.where(label(k).rlike(f"^(?:{v[1:]})$") if v.startswith("~") else label(k) == v)
    return out


def increase(series: DataFrame) -> DataFrame:
    """Scrapes with delta: the growth since the scrape before, a smaller value counting from zero again."""
    w = Window.partitionBy("name", "_series").orderBy("ts")
    prev = F.lag("value").over(w)
    return series.withColumn("_series", series_key()).withColumn("delta", F.when(F.col("value") < prev, F.col("value")).otherwise(F.col("value") - prev))


def rate(series: DataFrame, window_s: int, step_s: int | None = None) -> DataFrame:
    """name, labels, at, rate: increases in (at - window, at] over the window's length, without extrapolation to its edges. at is every
    multiple of the step that has a scrape in its window; without a step, of the window.

    A scrape counts in as many windows as hold it, so rows grow by window / step and not with the range of time.
    """
    step = step_s or window_s
    first = F.ceil(F.col("ts") / step) * step
    at = F.explode(F.sequence(first, first + F.floor((F.col("ts") + window_s - 1 - first) / step) * step, F.lit(step).cast("long")))
    grown = increase(series).where(F.col("delta").isNotNull()).where(first < F.col("ts") + window_s)
    return grown.withColumn("at", at).groupBy("name", "_series", "at").agg(F.first("labels").alias("labels"), (F.sum("delta") / window_s).alias("rate")).drop("_series")


def sum_by(rates: DataFrame, value: str, *labels: str) -> DataFrame:
    return rates.groupBy("at", *(label(x).alias(x) for x in labels)).agg(F.sum(value).alias("value"))


def max_by(rates: DataFrame, value: str, *labels: str) -> DataFrame:
    return rates.groupBy("at", *(label(x).alias(x) for x in labels)).agg(F.max(value).alias("value"))


def histogram_quantile(bucket_rates: DataFrame, phi: float, *labels: str) -> DataFrame:
    """at, labels, quantile from rates of cumulative buckets with an le label."""
    le = F.when(label("le") == "+Inf", F.lit(float("inf"))).otherwise(label("le").cast("double"))
    cum = bucket_rates.groupBy("at", *(label(x).alias(x) for x in labels), le.alias("le")).agg(F.sum("rate").alias("cumulative"))
    return hist.quantile_from_cumulative(cum, phi, "at", *labels)


def ratio(numerator: Column, denominator: Column, least: float) -> Column:
    """num / clamp_min(den, least)."""
    return numerator / F.greatest(denominator, F.lit(float(least)))


def or_zero(values: DataFrame, value: str = "value") -> DataFrame:
    """One row with the sum, 0 when there is nothing."""
    return values.agg(F.coalesce(F.sum(value), F.lit(0.0)).alias(value))


def label_values(scrapes: DataFrame, name: str, key: str) -> DataFrame:
    return select(scrapes, name).select(label(key).alias(key)).where(F.col(key).isNotNull()).distinct()


def instant(scrapes: DataFrame) -> DataFrame:
    """The last value of every series."""
    return scrapes.withColumn("_series", series_key()).groupBy("name", "_series").agg(
        F.max_by("labels", "ts").alias("labels"), F.max_by("value", "ts").alias("value")
    ).drop("_series")


def mean_rate(sums: DataFrame, counts: DataFrame, *labels: str) -> DataFrame:
    """rate(_sum) / rate(_count) by labels; null where nothing was counted."""
    a = sum_by(sums, "rate", *labels).withColumnRenamed("value", "s")
    b = sum_by(counts, "rate", *labels).withColumnRenamed("value", "c")
    return a.join(b, ["at", *labels]).select("at", *labels, F.when(F.col("c") != 0, F.col("s") / F.col("c")).alias("mean"))
