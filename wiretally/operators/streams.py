"""Window forms of the ordered operators: what a lossless or already decoded stream needs no state machine for."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sequence_gaps(events: DataFrame, conn: str = "conn", seq: str = "seq", order: str = "ts_ns") -> DataFrame:
    """events with lost: how many numbers are missing before each event; steps back lose nothing."""
    before = Window.partitionBy(conn).orderBy(order, seq).rowsBetween(Window.unboundedPreceding, -1)
    return events.withColumn("lost", F.greatest(F.col(seq) - F.max(seq).over(before) - 1, F.lit(0))).fillna(0, ["lost"])


def idle_sessions(events: DataFrame, gap_s: int = 600, conn: str = "conn", order: str = "ts_ns") -> DataFrame:
    """conn, first, last, n of each run of events without a pause of gap_s: what an idle sweep would keep as one."""
    w = Window.partitionBy(conn).orderBy(order)
    new = F.coalesce((F.col(order) - F.lag(order).over(w) >= gap_s * 1_000_000_000).cast("int"), F.lit(0))
    runs = events.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w.rangeBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(conn, "_run").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n")).drop("_run")


def batch_depth(commands: DataFrame, conn: str = "conn", call: str = "call") -> DataFrame:
    """Commands of one system call: each command's pipeline depth."""
    return commands.withColumn("depth", F.count("*").over(Window.partitionBy(conn, call)))


def carried_label(events: DataFrame, label: str, conn: str = "conn", order: str = "seq", unknown: str = "?") -> DataFrame:
    """The label in force at each event: the last one set before it, unknown before the first."""
    before = Window.partitionBy(conn).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return events.withColumn("in_force", F.coalesce(F.last(label, ignorenulls=True).over(before), F.lit(unknown)))


def transaction_islands(states: DataFrame, conn: str = "conn", order: str = "seq", ts: str = "ts_ns") -> DataFrame:
    """conn, start_ns, end_ns, aborted: from the state that leaves idle to the one that comes back to it; aborted if
    the last state before was failed. Transactions that never end aren't reported."""
    w = Window.partitionBy(conn).orderBy(order)
    x = states.withColumn("_prev", F.lag("status").over(w)).withColumn("_at", F.lag(ts).over(w))
    idle = F.col("status") == "I"
    was_idle = F.coalesce(F.col("_prev") == "I", F.lit(True))
    opens = (~idle & was_idle).cast("int")
    x = x.withColumn("_txn", F.sum(opens).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inside = x.where(~idle | ~was_idle)
    g = inside.groupBy(conn, "_txn").agg(
        F.min(ts).alias("start_ns"),
        F.max(F.when(idle, F.col(ts))).alias("end_ns"),
        F.max_by(F.col("_prev"), F.when(idle, F.col(order))).alias("_last"),
    )
    return g.where(F.col("end_ns").isNotNull()).select(conn, "start_ns", "end_ns", (F.col("_last") == "E").alias("aborted"))


def last_session(events: DataFrame, label: str, conn: str = "conn", order: str = "seq") -> DataFrame:
    """The exact last label of each connection."""
    return events.groupBy(conn).agg(F.max_by(label, F.when(F.col(label).isNotNull(), F.col(order))).alias(label))


def tls_sequence_gaps(events: DataFrame, conn: str = "conn", seq: str = "seq", order: str = "ts_ns", decrypted: str = "decrypted") -> DataFrame:
    """As sequence_gaps, with decrypted events numbered apart: the first of either kind only seeds its counter."""
    before = Window.partitionBy(conn, decrypted).orderBy(order, seq).rowsBetween(Window.unboundedPreceding, -1)
    return events.withColumn("lost", F.greatest(F.col(seq) - F.max(seq).over(before) - 1, F.lit(0))).fillna(0, ["lost"])


def chunk_holes(chunks: DataFrame, conn: str = "conn", order: str = "seq") -> DataFrame:
    """Bytes missing before each chunk of a call (total_len, off, cap_len): the gap to the chunk before it, or the
    unseen tail of the call before; anomaly if the offset steps back, passes the total or the total changes."""
    w = Window.partitionBy(conn, "dir").orderBy(order)
    x = chunks.withColumns({"_end": F.lag(F.col("off") + F.col("cap_len")).over(w), "_total": F.lag("total_len").over(w)})
    starts = F.col("off") == 0
    gap = F.when(F.col("_end").isNull(), F.col("off")).when(starts, F.col("_total") - F.col("_end")).otherwise(F.col("off") - F.col("_end"))
    odd = (gap < 0) | (F.col("off") + F.col("cap_len") > F.col("total_len")) | (~starts & (F.col("_total") != F.col("total_len")))
    return x.withColumn("hole", F.greatest(gap, F.lit(0))).withColumn("anomaly", F.coalesce(odd, F.lit(False))).drop("_end", "_total")
