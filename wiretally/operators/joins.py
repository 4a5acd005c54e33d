"""Joins of observations with external logs, for accuracy checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def join_logs(log: DataFrame, seen: DataFrame, key: str = "label") -> DataFrame:
    """Full outer on the normalised label: key, log_n, seen_n, side (log-only, seen-only, both)."""
    a = log.groupBy(key).agg(F.count("*").alias("log_n"))
    b = seen.groupBy(key).agg(F.count("*").alias("seen_n"))
    side = F.when(F.col("seen_n").isNull(), "log-only").when(F.col("log_n").isNull(), "seen-only").otherwise("both")
    return a.join(b, key, "full_outer").withColumn("side", side)


def join_legs(access: DataFrame, front: DataFrame, upstream: DataFrame, key: str = "req_id") -> DataFrame:
    """An access log's requests with their front and upstream observations; requests without either stay."""
    f = front.select(key, F.col("dur_s").alias("front_s"))
    u = upstream.select(key, F.col("dur_s").alias("upstream_s"))
    return access.join(f, key, "left").join(u, key, "left")


def join_trace(trace: DataFrame, obs: DataFrame, aliases: DataFrame, key: str = "req_id") -> DataFrame:
    """A server's trace with observations by request id; operation names agree directly or through the alias table, which
    is a fixed list and therefore broadcast."""
    out = trace.join(obs.select(key, F.col("op").alias("seen_op"), "dur_s"), key, "left")
    out = out.join(F.broadcast(aliases.select(F.col("api").alias("op"), F.col("name").alias("alias"))), "op", "left")
    return out.withColumn("agrees", F.coalesce((F.col("seen_op") == F.col("op")) | (F.col("seen_op") == F.col("alias")), F.lit(False)))


def pair_kth(left: DataFrame, right: DataFrame, key: str, order: str) -> DataFrame:
    """The k-th of one side with the k-th of the other, for keys that both have equally often.

    Counts are compared first, so rows of unequal keys never reach the windows.
    """
    n = left.groupBy(key).agg(F.count("*").alias("n")).join(right.groupBy(key).agg(F.count("*").alias("m")), key)
    equal = n.where("n = m").select(key)
    w = Window.partitionBy(key).orderBy(order)
    a = left.join(equal, key, "left_semi").withColumn("k", F.row_number().over(w))
    b = right.join(equal, key, "left_semi").withColumn("k", F.row_number().over(w))
    return a.alias("a").join(b.alias("b"), [key, "k"]).select(key, "k", F.col(f"a.{order}").alias("left_at"), F.col(f"b.{order}").alias("right_at"))


def accumulate_phases(log: DataFrame, session: str = "session", order: str = "seq") -> DataFrame:
    """Parse and bind times are added to the next execute of their session; an error resets what has gathered.

    Returns the execute rows with total_s. Rows between two ends (execute or error) are one group.
    """
    ends = F.col("phase").isin("execute", "error").cast("int")
    w = Window.partitionBy(session).orderBy(order)
    group = F.coalesce(F.sum(ends).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    g = log.withColumn("_group", group).groupBy(session, "_group").agg(
        F.sum("dur_s").alias("total_s"), F.max_by("phase", order).alias("last"), F.max(order).alias(order)
    )
    return g.where("last = 'execute'").select(session, order, "total_s")


def pair_in_order(commands: DataFrame, replies: DataFrame, conn: str = "conn", order: str = "seq") -> DataFrame:
    """Oldest unanswered command with the next reply, where nothing was lost: equal ranks on a connection."""
    w = Window.partitionBy(conn).orderBy(order)
    a = commands.withColumn("k", F.row_number().over(w)).select(conn, "k", F.col(order).alias("command"))
    b = replies.withColumn("k", F.row_number().over(w)).select(conn, "k", F.col(order).alias("reply"))
    return a.join(b, [conn, "k"])


def observed(log: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """How many log rows were observed and how many weren't."""
    hit = log.join(seen, key, "left_semi").agg(F.count("*").alias("matched"))
    miss = log.join(seen, key, "left_anti").agg(F.count("*").alias("missed"))
    return hit.crossJoin(miss)
