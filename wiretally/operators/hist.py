"""Histograms: latency buckets at quarter powers of two, size octaves, classic exposition and quantiles.

Cells are sparse rows (key, bucket, n), so merging is a sum and an empty bucket costs nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets lie between 2 ** (LOW / 4) and 2 ** (HIGH / 4) seconds.
LOW, HIGH = -53, 24
#: Marks for values outside.
UNDER, OVER = LOW - 1, HIGH
#: Classic exposition bounds 2 ** j.
CLASSIC = range(-13, 6)
#: Size grids: exponent of the first bound, number of cells.
GRIDS = {"http": (6, 25), "s3": (10, 31), "redis": (3, 21), "depth": (0, 9)}


def bounds() -> list[float]:
    """Lower bounds of all buckets and the upper bound of the last; exact at whole powers of two."""
    roots = [1.0, 2**0.25, 2**0.5, 2**0.75]
    return [roots[k % 4] * 2.0 ** (k // 4) for k in range(LOW, HIGH + 1)]


def bucket(value: Column) -> Column:
    """Bucket number; UNDER for values below the first bound, at most 0 or NaN, OVER above the last. Null stays null.

    Counting bounds no greater than the value is exact; a logarithm isn't. A candidate from the logarithm is put
    right by comparing with its two neighbouring bounds, so each value costs three comparisons and not 78.
    """
    table = F.array(*(F.lit(b) for b in bounds()))
    guess = F.greatest(F.lit(LOW), F.least(F.lit(HIGH - 1), F.floor(F.log2(value) * 4))).cast("int")
    at = guess - LOW + 1
    right = F.when(value < F.element_at(table, at), guess - 1).when(value >= F.element_at(table, at + 1), guess + 1).otherwise(guess)
    return F.when(value.isNull(), None).when(F.isnan(value) | (value <= 0) | (value < bounds()[0]), UNDER).when(value >= bounds()[-1], OVER).otherwise(right)


def counted(value: Column) -> Column:
    """What the value adds to a histogram's sum: nothing if not positive, NaN or infinite."""
    return F.when((value > 0) & ~F.isnan(value) & (value < float("inf")), value).otherwise(0.0)


def latency_cells(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """keys, bucket, n, sum, nonpos: one row for each bucket that has a value."""
    v = F.col(value)
    # Null values are dropped after counting: a filter before would compute the value twice, here and at the scan.
    return (
        df.groupBy(*keys, bucket(v).alias("bucket"))
        .agg(F.count(v).alias("n"), F.sum(counted(v)).alias("sum"), F.count_if(F.isnan(v) | (v <= 0)).alias("nonpos"))
        .where("n > 0")
    )


def merge_cells(cells: DataFrame, *keys: str) -> DataFrame:
    return cells.groupBy(*keys, "bucket").agg(F.sum("n").alias("n"), F.sum("sum").alias("sum"), F.sum("nonpos").alias("nonpos"))


def classic_cumulative(cells: DataFrame, *keys: str) -> DataFrame:
    """keys, j, le, cumulative: counts below 2 ** j (strictly), values under the grid included; j null is +Inf."""
    per_key = cells.groupBy(*keys).agg(
        *(F.sum(F.when(F.col("bucket") < 4 * j, F.col("n")).otherwise(0)).alias(f"c{j - CLASSIC[0]}") for j in CLASSIC),
        F.sum("n").alias("total"),
    )
    rows = [F.struct(F.lit(j).alias("j"), F.lit(2.0**j).alias("le"), F.col(f"c{j - CLASSIC[0]}").alias("cumulative")) for j in CLASSIC]
    rows.append(F.struct(F.lit(None).cast("int").alias("j"), F.lit(float("inf")).alias("le"), F.col("total").alias("cumulative")))
    return per_key.select(*keys, F.inline(F.array(*rows)))


def octave(size: Column, grid: str) -> Column:
    """Cell of a size: bounds are powers of two, upper-inclusive; 0 is in cell 0; the grid's length means overflow."""
    low, cells = GRIDS[grid]
    s = size.cast("long")
    # The number of bits of size - 1 is the exponent of the next power of two.
    bits = F.when(s <= 1, 0).otherwise(F.length(F.bin(s - 1)))
    return F.when(s.isNotNull(), F.least(F.greatest(bits - low, F.lit(0)), F.lit(cells)))


def size_cells(df: DataFrame, size: str, grid: str, *keys: str) -> DataFrame:
    s = F.col(size)
    return df.groupBy(*keys, octave(s, grid).alias("cell")).agg(F.count(s).alias("n"), F.sum(s).alias("sum")).where("n > 0")


def quantile_from_cumulative(rows: DataFrame, phi: float, *keys: str) -> DataFrame:
    """keys, quantile: first bucket whose cumulative count reaches the rank, interpolated; +Inf gives the last finite bound.

    rows: keys, le, cumulative (double). No observations: null.
    """
    w = Window.partitionBy(*keys).orderBy("le")
    whole = Window.partitionBy(*keys)
    x = rows.withColumns(
        {
            "below": F.coalesce(F.lag("cumulative").over(w), F.lit(0.0)),
            "low": F.coalesce(F.lag("le").over(w), F.lit(0.0)),
            "rank": F.max("cumulative").over(whole) * phi,
        }
    )
    hit = (F.col("cumulative") >= F.col("rank")) & (F.col("cumulative") > 0)
    inside = F.col("low") + (F.col("le") - F.col("low")) * (F.col("rank") - F.col("below")) / (F.col("cumulative") - F.col("below"))
    at = F.when(F.col("le") == float("inf"), F.col("low")).when(F.col("cumulative") == F.col("below"), F.col("low")).otherwise(inside)
    return x.groupBy(*keys).agg(F.min_by(F.when(hit, at), F.when(hit, F.col("le"))).alias("quantile"))
