"""Observations and related tables derived from the driver's tables, so that every operator runs on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wiretally import schema as S


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


TYPES = ("view", "click", "signup", "purchase", "error")
PROTOS = ("http", "redis", "mysql", "pg", "pg")
CODES = (404, 503, 301, *[200] * 7)
CYCLE = 30


def flags_of(kind: str, m: int) -> int:
    """The flags of an event by its type and its number modulo CYCLE."""
    out = 0
    if kind == "view":
        code = CODES[m % 10]
        out |= S.ERROR if code >= 500 else S.CLIENT_ERR if code >= 400 else 0
        out |= (S.BODY_UNSEEN if m == 23 else 0) | (S.EXPECT_CONT if m % 5 == 0 else 0)
    elif kind == "click":
        out |= S.QUEUED if m % 7 == 0 else S.BLOCKING if m % 7 == 1 else 0
        out |= S.ERROR if m % 11 == 0 else 0
    else:
        out |= (S.ERROR if kind == "error" else 0) | (S.ABORTED if m % 13 == 0 else 0) | (S.PIPELINED if m % 3 == 0 else 0)
        out |= (S.NO_TEXT if m == 17 else 0) | (S.TEXT_TRUNC if m == 19 else 0)
    return out


FLAGS = [flags_of(t, m) for t in TYPES for m in range(CYCLE)]


def pick(values, at):
    """The element of a constant array at a place counted from 0: one lookup, however often it is computed."""
    return F.element_at(F.array(*(F.lit(v) for v in values)), (at + 1).cast("int"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One observation for each event: the protocol from the event's type, timings and sizes from its value.

    Columns are cheap expressions, since Catalyst computes them anew wherever it pushes a filter down to the scan.
    """
    e, kind = F.col("event_id"), F.col("event_type")
    k, m = (e * 7 + F.col("user_id")) % 100, e % CYCLE
    start = F.unix_micros(F.col("ts").cast("timestamp")) * 1000
    took = F.floor(F.col("value") * 1_000_000)
    number = F.array_position(F.array(*map(F.lit, TYPES)), kind) - 1
    db = number >= 2
    route = F.concat(F.lit("/api/v1/view/"), k.cast("string"))
    return table(spark, sf_dir, "events").select(
        e.alias("seq"),
        F.col("user_id").alias("conn"),
        pick(PROTOS, number).alias("proto"),
        F.when(kind == "view", "request").when(kind == "click", "command").when(m == 29, "cancel").when(e % 2 == 0, "simple").otherwise("extended").alias("kind"),
        pick(FLAGS, number * CYCLE + m).alias("flags"),
        F.concat(F.lit("db"), (F.col("user_id") % 7).cast("string")).alias("db"),
        F.concat(F.lit("u"), (F.col("user_id") % 11).cast("string")).alias("user"),
        start.alias("ts_start_ns"),
        F.when(kind == "view", start + F.floor(took / 4)).alias("ts_req_done_ns"),
        F.when(e % 4 != 0, start + F.floor(took / 2)).alias("ts_first_row_ns"),
        (start + took).alias("ts_complete_ns"),
        (start + took + F.when(e % 6 == 0, 0).otherwise(5000)).alias("ts_ready_ns"),
        F.when(m != 21, F.concat(F.lit("SELECT * FROM t"), (k % 10).cast("string"), F.lit(" WHERE id = "), e.cast("string"))).alias("text"),
        F.when(kind == "view", pick(("GET", "PUT", "POST"), k % 3)).alias("op"),
        F.when(kind == "view", route).when(kind == "click", F.concat(F.lit("CMD"), (k % 20).cast("string"))).alias("route"),
        k.alias("rows"),
        F.floor(F.col("value") * 100).alias("bytes_in"),
        F.floor(F.col("value") * 1000).alias("bytes_out"),
        F.when(kind == "error", pick(("23505", "40001", "57014"), k % 3)).alias("sqlstate"),
        F.when(kind == "view", pick(CODES, m % 10)).alias("err_code"),
        F.when((kind == "click") & (m % 11 == 0), pick(("ERR", "WRONGTYPE", "MOVED"), e % 3)).alias("err_name"),
        F.when(kind == "click", k % 16 + 1).alias("depth"),
        k.alias("k"),
        F.lit(None).cast("long").alias("obj_bytes"),
    )


#: The same table for DuckDB, in front of every oracle query that reads observations.
OBS_SQL = f"""obs0 AS (
    SELECT *, (event_id * 7 + user_id) % 100 AS k, event_id % {CYCLE} AS m, epoch_us(ts) * 1000 AS st, CAST(floor(value * 1000000) AS BIGINT) AS took,
        list_position({list(TYPES)}, event_type) - 1 AS num, event_type IN ('purchase', 'signup', 'error') AS isdb
    FROM events
), obs AS (
    SELECT event_id AS seq, user_id AS conn, ({list(PROTOS)})[num + 1] AS proto,
        CASE WHEN event_type = 'view' THEN 'request' WHEN event_type = 'click' THEN 'command'
            WHEN m = 29 THEN 'cancel' WHEN event_id % 2 = 0 THEN 'simple' ELSE 'extended' END AS kind,
        ({FLAGS})[num * {CYCLE} + m + 1] AS flags,
        'db' || (user_id % 7) AS db, 'u' || (user_id % 11) AS "user", st AS ts_start_ns,
        CASE WHEN event_type = 'view' THEN st + took // 4 END AS ts_req_done_ns,
        CASE WHEN event_id % 4 <> 0 THEN st + took // 2 END AS ts_first_row_ns,
        st + took AS ts_complete_ns, st + took + CASE WHEN event_id % 6 = 0 THEN 0 ELSE 5000 END AS ts_ready_ns,
        CASE WHEN m <> 21 THEN 'SELECT * FROM t' || (k % 10) || ' WHERE id = ' || event_id END AS text,
        CASE WHEN event_type = 'view' THEN (['GET', 'PUT', 'POST'])[k % 3 + 1] END AS op,
        CASE WHEN event_type = 'view' THEN '/api/v1/view/' || k WHEN event_type = 'click' THEN 'CMD' || (k % 20) END AS route,
        k AS rows, CAST(floor(value * 100) AS BIGINT) AS bytes_in, CAST(floor(value * 1000) AS BIGINT) AS bytes_out,
        CASE WHEN event_type = 'error' THEN (['23505', '40001', '57014'])[k % 3 + 1] END AS sqlstate,
        CASE WHEN event_type = 'view' THEN ({list(CODES)})[m % 10 + 1] END AS err_code,
        CASE WHEN event_type = 'click' AND m % 11 = 0 THEN (['ERR', 'WRONGTYPE', 'MOVED'])[event_id % 3 + 1] END AS err_name,
        CASE WHEN event_type = 'click' THEN k % 16 + 1 END AS depth, k, NULL::BIGINT AS obj_bytes
    FROM obs0
), red AS (
    SELECT *,
        CASE WHEN proto = 'http' THEN CASE WHEN err_code BETWEEN 100 AND 599 THEN (err_code // 100) || 'xx' ELSE 'other' END
            WHEN kind = 'cancel' THEN 'canceled' WHEN flags & 64 <> 0 THEN 'aborted' WHEN flags & 1 <> 0 THEN 'error' ELSE 'ok' END AS outcome,
        CASE WHEN proto = 'http' THEN greatest(ts_complete_ns - ts_req_done_ns, 0) / 1e9
            WHEN proto = 'redis' THEN CASE WHEN flags & 12288 = 0 THEN greatest(ts_complete_ns - ts_start_ns, 0) / 1e9 END
            WHEN kind <> 'cancel' AND flags & 64 = 0 THEN
                greatest((CASE WHEN flags & 128 <> 0 THEN ts_complete_ns WHEN ts_ready_ns > ts_start_ns THEN ts_ready_ns ELSE ts_complete_ns END) - ts_start_ns, 0) / 1e9
            END AS dur_s,
        CASE WHEN proto = 'http' THEN CASE WHEN ts_first_row_ns > ts_req_done_ns THEN (ts_first_row_ns - ts_req_done_ns) / 1e9 END
            WHEN proto <> 'redis' AND kind <> 'cancel' AND flags & 64 = 0 AND ts_first_row_ns > ts_start_ns THEN (ts_first_row_ns - ts_start_ns) / 1e9 END AS first_s,
        CASE WHEN proto = 'http' AND flags & 1024 = 0 AND ts_req_done_ns > ts_start_ns THEN (ts_req_done_ns - ts_start_ns) / 1e9 END AS upload_s,
        CASE WHEN proto = 'redis' AND flags & 8192 <> 0 AND flags & 4096 = 0 THEN greatest(ts_complete_ns - ts_start_ns, 0) / 1e9 END AS blocking_s,
        CASE WHEN proto = 'http' THEN CASE WHEN err_code >= 400 THEN CAST(err_code AS VARCHAR) END
            WHEN flags & 1 = 0 THEN NULL WHEN proto = 'redis' THEN err_name ELSE sqlstate END AS error,
        CASE WHEN proto = 'http' THEN flags & 512 = 0 WHEN proto = 'redis' THEN bytes_out > 0 AND flags & 4096 = 0 ELSE FALSE END AS sized,
        flags & 4 <> 0 OR kind = 'cancel' OR (CASE WHEN proto IN ('pg', 'mysql') THEN text IS NULL ELSE route IS NULL END) AS force_other
    FROM obs
)"""


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQL texts in several spellings, few of them different once normalised: seq, text."""
    o = F.col("o_orderkey")
    n = o % 6
    lit = o.cast("string")
    text = (
        F.when(n == 0, F.concat(F.lit("SELECT * FROM orders WHERE o_orderkey = "), lit))
        .when(n == 1, F.concat(F.lit("select  *  from Orders where o_orderkey = $1;")))
        .when(n == 2, F.concat(F.lit("select * from orders where o_orderpriority in ('"), F.col("o_orderpriority"), F.lit("', 'x', 'y')")))
        .when(n == 3, F.concat(F.lit("INSERT INTO t (a, b) VALUES ("), lit, F.lit(", 2), (3, "), lit, F.lit(")")))
        .when(n == 4, F.concat(F.lit("update t set total = "), F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit(" where id="), lit))
        .otherwise(F.concat(F.lit("DELETE FROM orders WHERE o_custkey > "), F.col("o_custkey").cast("string")))
    )
    return table(spark, sf_dir, "orders").select(o.alias("seq"), text.alias("text"))


STATEMENTS_SQL = """statements AS (
    SELECT o_orderkey AS seq, CASE o_orderkey % 6
        WHEN 0 THEN 'SELECT * FROM orders WHERE o_orderkey = ' || o_orderkey
        WHEN 1 THEN 'select  *  from Orders where o_orderkey = $1;'
        WHEN 2 THEN 'select * from orders where o_orderpriority in (''' || o_orderpriority || ''', ''x'', ''y'')'
        WHEN 3 THEN 'INSERT INTO t (a, b) VALUES (' || o_orderkey || ', 2), (3, ' || o_orderkey || ')'
        WHEN 4 THEN 'update t set total = ' || CAST(CAST(o_totalprice AS DECIMAL(18, 2)) AS VARCHAR) || ' where id=' || o_orderkey
        ELSE 'DELETE FROM orders WHERE o_custkey > ' || o_custkey END AS text
    FROM orders
)"""


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of connection states: conn, seq, ts_ns, status (I idle, T in a transaction, E failed)."""
    status = F.when(F.col("o_orderstatus") == "O", "T").when(F.col("o_orderstatus") == "F", "I").otherwise("E")
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("conn"),
        F.col("o_orderkey").alias("seq"),
        (F.unix_micros(F.col("o_orderdate").cast("timestamp")) * 1000 + F.col("o_orderkey")).alias("ts_ns"),
        status.alias("status"),
    )


TRANSACTIONS_SQL = """txn AS (
    SELECT o_custkey AS conn, o_orderkey AS seq, epoch_us(o_orderdate) * 1000 + o_orderkey AS ts_ns,
        CASE o_orderstatus WHEN 'O' THEN 'T' WHEN 'F' THEN 'I' ELSE 'E' END AS status
    FROM orders
)"""


def scrapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative counters as a scraper sees them: ts (epoch seconds), name, labels, value; one reset in each series."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events")
    hour = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000) * 3600
    per = e.groupBy(hour.alias("ts"), "event_type").agg(F.count("*").alias("n"), F.sum(F.floor(F.col("value") * 100)).alias("v"))
    # A restart each 40 hours of absolute time empties the counters.
    w = Window.partitionBy("event_type", F.floor(F.col("ts") / 144000)).orderBy("ts")
    cum = per.withColumn("n", F.sum("n").over(w)).withColumn("v", F.sum("v").over(w))
    labels = F.create_map(F.lit("kind"), F.col("event_type"))
    rows = F.array(
        F.struct(F.lit(f"{S.PREFIX}_requests_total").alias("name"), F.col("n").cast("double").alias("value")),
        F.struct(F.lit(f"{S.PREFIX}_bytes_total").alias("name"), F.col("v").cast("double").alias("value")),
    )
    return cum.select("ts", labels.alias("labels"), F.inline(rows)).select("ts", "name", "labels", "value")


SCRAPES_SQL = f"""per AS (
    SELECT CAST(floor(epoch_us(ts) / 3600000000) AS BIGINT) * 3600 AS ts, event_type, count(*) AS n, sum(CAST(floor(value * 100) AS BIGINT)) AS v
    FROM events GROUP BY 1, 2
), cum AS (
    SELECT ts, event_type, sum(n) OVER w AS n, sum(v) OVER w AS v FROM per
    WINDOW w AS (PARTITION BY event_type, ts // 144000 ORDER BY ts)
), scrapes AS (
    SELECT ts, '{S.PREFIX}_requests_total' AS name, event_type AS kind, CAST(n AS DOUBLE) AS value FROM cum
    UNION ALL SELECT ts, '{S.PREFIX}_bytes_total', event_type, CAST(v AS DOUBLE) FROM cum
)"""
