"""Orders, limits and set operations of the metric tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wiretally import schema as S


def exposition_order(rows: DataFrame, *keys: str) -> DataFrame:
    """Byte order of the keys; strings of Spark compare as UTF-8 bytes."""
    return rows.orderBy(*keys)


def other_last(column: str) -> list[Column]:
    """Sort keys that put the folded row after all named ones."""
    return [F.col(column) == S.OTHER, F.col(column)]


def scalar_order(rows: DataFrame) -> DataFrame:
    return rows.orderBy("name", "label1", "label2")


def top(rows: DataFrame, k: int, by: str, *ties: str) -> DataFrame:
    """The k rows of highest value; one small heap per task and one final merge."""
    return rows.orderBy(F.desc(by), *ties).limit(k)


def top_by(rows: DataFrame, k: int, by: str, within: tuple[str, ...], *ties: str) -> DataFrame:
    w = Window.partitionBy(*within).orderBy(F.desc(by), *ties)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def bounded_fifo(rows: DataFrame, limit: int, tick: Column) -> DataFrame:
    """What a queue of `limit` takes in each tick: the first ones; later ones are dropped and counted.

    Returns tick, taken, dropped, watermark (whether the queue was three quarters full).
    """
    per = rows.groupBy(tick.alias("tick")).agg(F.count("*").alias("n"))
    taken = F.least(F.col("n"), F.lit(limit))
    return per.select("tick", taken.alias("taken"), (F.col("n") - taken).alias("dropped"), (taken * 4 >= limit * 3).alias("watermark"))


def drain(rows: DataFrame, limit: int, tick: Column) -> DataFrame:
    """The rows themselves that the queue hands out, in their total order (schema.ORDER); turn is a row's place in its tick.

    The rank limit is applied in every task before rows of one tick meet.
    """
    w = Window.partitionBy("tick").orderBy(*(c for c in S.ORDER if c in rows.columns))
    return rows.withColumn("tick", tick).withColumn("turn", F.row_number().over(w)).where(F.col("turn") <= limit)


def set_changes(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """key, change: what to add and what to delete to come from one set to the other."""
    a, b = before.select(key).distinct(), after.select(key).distinct()
    return b.join(a, key, "left_anti").withColumn("change", F.lit("add")).unionByName(a.join(b, key, "left_anti").withColumn("change", F.lit("del")))
