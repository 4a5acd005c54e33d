"""Global order without one big task: ranks of all rows, and exact percentiles from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wiretally.session import cut

#: Bits of monotonically_increasing_id() below the partition number (its documented layout).
LOCAL_BITS = 33


def in_global_order(df: DataFrame, *keys: Column) -> DataFrame:
    """df range-partitioned and sorted by keys, materialised, with _pid and _idx (place within the partition).

    (_pid, _idx) ascends with the keys: a row's global rank is its _idx plus the rows of earlier partitions.
    """
    out = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_mid", F.monotonically_increasing_id())
    out = cut(out)
    local = F.col("_mid").bitwiseAND(F.lit((1 << LOCAL_BITS) - 1))
    return out.withColumns({"_pid": F.shiftrightunsigned("_mid", LOCAL_BITS), "_idx": local}).drop("_mid")


def with_place(df: DataFrame, *keys: Column) -> DataFrame:
    """df with place: every row's rank in the order of keys, from 1. What is broadcast is one row for each partition."""
    rows = in_global_order(df, *keys)
    parts = rows.groupBy("_pid").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("_pid", before.alias("_before"))
    return rows.join(F.broadcast(parts), "_pid").withColumn("place", F.col("_before") + F.col("_idx") + 1).drop("_pid", "_idx", "_before")


def ntile(df: DataFrame, n: int, *keys: Column) -> DataFrame:
    """df with tile: n groups of as many rows in the order of keys, the first ones with one more, as SQL's ntile has them. By global
    ranks, so no task sorts all rows."""
    rows = with_place(df, *keys)
    total = F.broadcast(rows.agg(F.count("*").alias("_total")))
    rows = rows.crossJoin(total)  # one row
    small, larger = F.floor(F.col("_total") / n), F.col("_total") % n
    edge = (small + 1) * larger
    at = F.col("place") - 1
    tile = F.when(at < edge, F.floor(at / (small + 1))).otherwise(larger + F.floor((at - edge) / F.greatest(small, F.lit(1)))) + 1
    return rows.withColumn("tile", tile.cast("int")).drop("place", "_total")


def interpolated_percentiles(df: DataFrame, value: str, quantiles: dict[str, float], *keys: str) -> DataFrame:
    """Percentiles between the two nearest ranks, as SQL's percentile_cont has them, for groups of any size."""
    ranks = {}
    for k, q in quantiles.items():
        at = (F.col("n") - 1) * F.lit(q)
        ranks |= {f"{k}_lo": F.floor(at), f"{k}_hi": F.ceil(at)}
    found = at_ranks(df, value, ranks, *keys)
    sizes = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"))
    out = found.join(sizes, list(keys))
    share = {k: (F.col("n") - 1) * F.lit(q) - F.floor((F.col("n") - 1) * F.lit(q)) for k, q in quantiles.items()}
    return out.select(*keys, *((F.col(f"{k}_lo") + (F.col(f"{k}_hi") - F.col(f"{k}_lo")) * share[k]).alias(k) for k in quantiles))


def at_ranks(df: DataFrame, value: str, ranks: dict[str, Column], *keys: str) -> DataFrame:
    """keys and one column for each rank: the value at that place (from 0) of the key's sorted non-null values.

    ranks are expressions of n, the key's count. A hot key is spread over as many tasks as its rows need; what
    is joined back is one row for each key and rank.
    """
    tie = F.xxhash64(F.monotonically_increasing_id())
    rows = in_global_order(df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"), tie.alias("_tie")), *map(F.col, (*keys, "_v", "_tie")))
    parts = rows.groupBy(*keys, "_pid").agg(F.count("*").alias("_n"), F.min("_idx").alias("_first"))
    w = Window.partitionBy(*keys)
    parts = parts.withColumns(
        {
            "_before": F.coalesce(F.sum("_n").over(w.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
            "n": F.sum("_n").over(w),
        }
    )
    wanted = F.array(*(F.struct(F.lit(k).alias("name"), c.cast("long").alias("rank")) for k, c in ranks.items()))
    parts = parts.select(*keys, "_pid", "_n", "_first", "_before", F.inline(wanted))
    parts = parts.where((F.col("rank") >= F.col("_before")) & (F.col("rank") < F.col("_before") + F.col("_n")))
    places = parts.select("name", F.col("_pid").alias("p"), (F.col("_first") + F.col("rank") - F.col("_before")).alias("i"))
    hit = rows.join(places, (F.col("_pid") == F.col("p")) & (F.col("_idx") == F.col("i")))
    return hit.groupBy(*keys).agg(*(F.max(F.when(F.col("name") == k, F.col("_v"))).alias(k) for k in ranks))


def exact_percentiles(df: DataFrame, value: str, quantiles: dict[str, float], *keys: str) -> DataFrame:
    """Nearest-rank percentiles, v[ceil(q * n) - 1], for groups of any size."""
    return at_ranks(df, value, {k: F.greatest(F.ceil(F.col("n") * F.lit(q)) - 1, F.lit(0)) for k, q in quantiles.items()}, *keys)
