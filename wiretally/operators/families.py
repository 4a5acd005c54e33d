"""Metric families: counters and histograms of reduced observations, by slot, labels and protocol.

Everything is one hash aggregation over narrow keys, so Spark's partial aggregation carries the load.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wiretally import schema as S
from wiretally.operators import hist
from wiretally.operators.reduce import has

DIMS = ("db", "user", "proto")


def queries_total(red: DataFrame) -> DataFrame:
    """Every database observation, timed or not."""
    return red.where(F.col("proto").isin("pg", "mysql")).groupBy(*DIMS, "kind", F.col("outcome").alias("code")).agg(F.count("*").alias("value"))


def requests_total(red: DataFrame) -> DataFrame:
    """HTTP and S3 by status class, Redis by code; untimed ones included."""
    return red.where(~F.col("proto").isin("pg", "mysql")).groupBy("slot", *DIMS, F.col("outcome").alias("code")).agg(F.count("*").alias("value"))


def errors_total(red: DataFrame) -> DataFrame:
    """By error label; there is no slot among the keys."""
    return red.where(F.col("error").isNotNull()).groupBy("error", *DIMS).agg(F.count("*").alias("value"))


def rows_total(red: DataFrame) -> DataFrame:
    return red.where(F.col("proto").isin("pg", "mysql")).groupBy("slot", *DIMS).agg(F.sum("rows").alias("value"))


def bytes_total(red: DataFrame) -> DataFrame:
    sums = red.where(~F.col("proto").isin("pg", "mysql")).groupBy("slot", *DIMS).agg(F.sum("bytes_in").alias("in"), F.sum("bytes_out").alias("out"))
    return sums.unpivot(["slot", *DIMS], ["in", "out"], "direction", "value")


def redirects_total(red: DataFrame) -> DataFrame:
    """MOVED and ASK replies by kind."""
    return red.where(F.col("err_name").isin("MOVED", "ASK")).groupBy(F.lower("err_name").alias("redirect"), "proto").agg(F.count("*").alias("value"))


def plain_totals(red: DataFrame) -> DataFrame:
    """Counters without labels: truncated, other, internal."""
    return red.agg(
        F.count_if(has(S.TEXT_TRUNC)).alias("truncated"), F.count_if("force_other").alias("other"), F.count_if("internal").alias("internal")
    )


def slot(limit_to: Column | None = None) -> Column:
    """The identity of an observation: statement label or route, or other."""
    name = F.when(F.col("proto").isin("pg", "mysql"), F.col("label")).otherwise(F.col("route"))
    known = ~F.col("force_other") if limit_to is None else (~F.col("force_other") & limit_to)
    return F.when(known, name).otherwise(S.OTHER)


def latency(red: DataFrame, value: str = "dur_s", *keys: str) -> DataFrame:
    return hist.latency_cells(red, value, *(keys or ("slot", *DIMS)))


def series_count(red: DataFrame) -> DataFrame:
    """Distinct live keys."""
    return red.select("slot", *DIMS, "outcome").distinct().agg(F.count("*").alias("value"))


def conservation(red: DataFrame) -> DataFrame:
    """Counted observations against all observations: both columns must agree."""
    per = red.groupBy("slot", *DIMS, "outcome").agg(F.count("*").alias("n"))
    return per.agg(F.sum("n").alias("counted")).crossJoin(red.agg(F.count("*").alias("total")))
