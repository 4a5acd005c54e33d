"""The registered queries: each runs one operator over the driver's tables, with SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wiretally import schema as S
from wiretally.functions import redis, route, s3, sql_text, url
from wiretally.operators import cardinality, expose, families, filters, hist, identity, joins, order, ordering, percentiles, reduce, streams
from wiretally.plans import adapters as A
from wiretally.plans import olap, promql, spans, wire
from wiretally.sources import recordings
from wiretally.streaming import observe

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with its oracle."""

    def keep(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return keep


def red(spark: SparkSession, sf: str) -> DataFrame:
    """Reduced observations with label and slot."""
    return identity.with_slot(reduce.reduce_observations(A.observations(spark, sf)))


OBS = f"WITH {A.OBS_SQL}"
RED = f"""WITH {A.OBS_SQL}, slots AS (
    SELECT *, CASE WHEN force_other THEN 'other' WHEN proto IN ('pg', 'mysql') THEN 'select * from t' || (k % 10) || ' where id = ?'
        ELSE route END AS slot FROM red
)"""
# Quarter powers of two, as the engine that checks computes them.
BOUNDS = "list_transform(range(-53, 25), lambda k: pow(2.0::DOUBLE, k / 4.0::DOUBLE))"


def rounded(df: DataFrame, *columns: str, digits: int = 9) -> DataFrame:
    """Floating sums depend on their order in the last bits; results are compared after rounding."""
    return df.withColumns({c: F.round(c, digits) for c in columns})


def bucket_sql(v: str) -> str:
    """How many bounds are at or below the value, counted; -54 below the first, 24 from the last on."""
    return f"CASE WHEN isnan({v}) OR {v} < pow(2.0::DOUBLE, -13.25) THEN -54 WHEN {v} >= 64 THEN 24 ELSE CAST(len(list_filter({BOUNDS}, lambda b: b <= {v})) AS INTEGER) - 54 END"


# --- projections -----------------------------------------------------------------------------------------------------


@query(f"{OBS} SELECT seq, dur_s, first_s, upload_s, blocking_s FROM red")
def prj1_prj2_prj3_durations(spark, sf):
    return reduce.reduce_observations(A.observations(spark, sf)).select("seq", "dur_s", "first_s", "upload_s", "blocking_s")


@query(f"{OBS} SELECT seq, outcome, error FROM red")
def prj4_prj5_prj7_outcomes(spark, sf):
    return reduce.reduce_observations(A.observations(spark, sf)).select("seq", "outcome", "error")


@query(f"{OBS} SELECT seq, CASE WHEN err_code >= 500 THEN 1 WHEN err_code >= 400 THEN 256 ELSE 0 END AS bits FROM obs WHERE proto = 'http'")
def prj6_http_error_split(spark, sf):
    o = A.observations(spark, sf).where("proto = 'http'")
    return o.select("seq", reduce.http_error_flags(F.col("err_code")).alias("bits"))


@query(f"{OBS} SELECT seq, sized, force_other FROM red")
def prj8_prj10_eligibility(spark, sf):
    return reduce.reduce_observations(A.observations(spark, sf)).select("seq", "sized", "force_other")


@query(f"{OBS} SELECT seq, coalesce(nullif(CASE WHEN k % 3 = 0 THEN k ELSE 0 END, 0), nullif(CASE WHEN k % 2 = 0 THEN bytes_in ELSE 0 END, 0), bytes_out) AS size FROM obs")
def prj9_object_size(spark, sf):
    o = A.observations(spark, sf)
    decoded, sent = F.when(F.col("k") % 3 == 0, F.col("k")).otherwise(0), F.when(F.col("k") % 2 == 0, F.col("bytes_in")).otherwise(0)
    return o.select("seq", reduce.object_size(decoded, sent, F.col("bytes_out")).alias("size"))


@query("""
    WITH c AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g') AS t FROM documents),
    n AS (SELECT doc_id, t, (SELECT max(i) FROM range(0, 41) r(i) WHERE strlen(substring(t, 1, CAST(i AS INTEGER))) <= 40) AS i FROM c)
    SELECT doc_id, substring(t, 1, CAST(i AS INTEGER)) AS label FROM n
""")
def prj11_label_clip(spark, sf):
    t = F.regexp_replace(F.coalesce("text", F.lit("")), r"[ \t\n\r\f\x0B]+", " ")
    return A.table(spark, sf, "documents").select("doc_id", reduce.clip_label(t, 40).alias("label"))


@query(f"{OBS} SELECT seq, ts_start_ns + 1700000000000000000 - 1600000000000000000 AS wall_ns FROM obs")
def prj12_wall_clock(spark, sf):
    return A.observations(spark, sf).select("seq", reduce.wall_ns(F.col("ts_start_ns"), F.lit(100000000000000000)).alias("wall_ns"))


@query(f"{OBS} SELECT (seq % 37 = 0) AS internal, count(*) AS n FROM obs WHERE proto = 'http' GROUP BY 1")
def prj13_internal_split(spark, sf):
    o = A.observations(spark, sf).where("proto = 'http'").withColumn("proto", F.lit("s3"))
    o = o.withColumn("flags", F.when(F.col("seq") % 37 == 0, F.col("flags").bitwiseOR(S.INTERNAL)).otherwise(F.col("flags")))
    return reduce.reduce_observations(o).groupBy("internal").agg(F.count("*").alias("n"))


# --- filters ---------------------------------------------------------------------------------------------------------


@query("SELECT event_id, event_type FROM events WHERE user_id % 5 IN (1, 3)")
def flt1_ports(spark, sf):
    e = A.table(spark, sf, "events")
    return e.where(filters.port_filter(F.col("user_id") % 5, [1, 3])).select("event_id", "event_type")


@query("SELECT event_id, event_type FROM events WHERE event_type = 'view' OR event_type LIKE 'cl%'")
def flt2_comm(spark, sf):
    e = A.table(spark, sf, "events")
    return e.where(filters.name_filter(F.col("event_type"), ["view", "cl*"])).select("event_id", "event_type")


@query("SELECT page_id, url FROM pages WHERE regexp_matches(url, '^https://[^/]*/.*e[^/]*$')")
def flt3_cgroup_globs(spark, sf):
    return A.table(spark, sf, "pages").where(filters.cgroup_filter(F.col("url"), ["https://*/**e*"])).select("page_id", "url")


@query("SELECT event_id, CASE user_id % 5 WHEN 0 THEN 'http' WHEN 1 THEN 'redis' WHEN 2 THEN 'mysql' ELSE 'pg' END AS proto FROM events")
def flt4_port_protocols(spark, sf):
    ports = [(0, "http"), (1, "redis"), (2, "mysql"), (1, "http")]
    return A.table(spark, sf, "events").select("event_id", filters.proto_of_port(F.col("user_id") % 5, ports).alias("proto"))


@query("SELECT event_id FROM events WHERE user_id % 5 = 1 AND event_type LIKE 'c%' AND value > 100")
def flt5_all_filters(spark, sf):
    e = A.table(spark, sf, "events")
    return filters.all_of(e, filters.port_filter(F.col("user_id") % 5, [1]), filters.name_filter(F.col("event_type"), ["c*"]), F.col("value") > 100).select("event_id")


@query(f"""{OBS} SELECT seq, coalesce(CASE WHEN seq % 10 = 0 THEN 4096 END, least(CASE proto WHEN 'http' THEN 2048 WHEN 's3' THEN 2048
    WHEN 'redis' THEN 512 END, 1024), 1024) AS budget FROM obs""")
def flt6_capture_budget(spark, sf):
    o = A.observations(spark, sf)
    return o.select("seq", filters.capture_budget(F.col("proto"), F.when(F.col("seq") % 10 == 0, 4096), 1024).alias("budget"))


@query(f"{OBS} SELECT conn, count(*) AS dropped FROM obs WHERE conn % 3 = 0 AND seq % 2 = 0 GROUP BY conn")
def flt7_ciphertext_drops(spark, sf):
    o = A.observations(spark, sf).withColumn("tls", F.col("conn") % 3 == 0).withColumn("decrypted", F.col("seq") % 2 == 1)
    return filters.drop_ciphertext(o)[1]


@query(f"{OBS} SELECT CASE WHEN conn % 2 = 0 THEN 'h2' ELSE 'upgrade' END AS reason, count(*) AS discarded FROM obs WHERE conn % 10 < 2 GROUP BY 1")
def flt8_blind_drops(spark, sf):
    o = A.observations(spark, sf)
    blind = o.where(F.col("conn") % 10 < 2).select("conn", F.when(F.col("conn") % 2 == 0, "h2").otherwise("upgrade").alias("reason")).distinct()
    return filters.drop_blind(o, blind)[1]


# --- aggregations ----------------------------------------------------------------------------------------------------


@query(f"""{OBS} SELECT db, "user", proto, kind, outcome AS code, count(*) AS value FROM red WHERE proto IN ('pg', 'mysql') GROUP BY ALL""")
def agg1_queries_total(spark, sf):
    return families.queries_total(red(spark, sf))


def _cells(value: str, keys: str = 'slot, db, "user", proto') -> str:
    return f"""{RED} SELECT {keys}, {bucket_sql(value)} AS bucket, count(*) AS n,
        round(sum(CASE WHEN {value} > 0 AND isfinite({value}) THEN {value} ELSE 0 END), 9) AS sum,
        count(*) FILTER (WHERE {value} <= 0 OR isnan({value})) AS nonpos
        FROM slots WHERE {value} IS NOT NULL GROUP BY ALL"""


@query(_cells("dur_s"))
def agg2_latency_histogram(spark, sf):
    return rounded(families.latency(red(spark, sf)), "sum")


@query(f"""{RED}, c AS (SELECT proto, {bucket_sql('dur_s')} AS bucket FROM slots WHERE dur_s IS NOT NULL)
    SELECT proto, j::INTEGER AS j, pow(2.0, j) AS le, count(*) FILTER (WHERE bucket < 4 * j) AS cumulative FROM c, range(-13, 6) r(j) GROUP BY proto, j
    UNION ALL SELECT proto, NULL, 'inf'::DOUBLE, count(*) FROM c GROUP BY proto""")
def agg2_classic_buckets(spark, sf):
    return hist.classic_cumulative(hist.latency_cells(red(spark, sf), "dur_s", "proto"), "proto")


@query(_cells("dur_s", "proto"))
def agg3_histogram_merge(spark, sf):
    return rounded(hist.merge_cells(families.latency(red(spark, sf)), "proto"), "sum")


@query(f"""{RED} SELECT slot, db, "user", proto, CAST(sum(rows) AS BIGINT) AS value FROM slots WHERE proto IN ('pg', 'mysql') GROUP BY ALL""")
def agg4_rows_total(spark, sf):
    return families.rows_total(red(spark, sf))


@query(_cells("first_s", "slot, proto").replace("WHERE first_s IS NOT NULL", "WHERE first_s IS NOT NULL AND proto IN ('pg', 'mysql')"))
def agg5_first_row_histogram(spark, sf):
    return rounded(families.latency(red(spark, sf).where("proto IN ('pg', 'mysql')"), "first_s", "slot", "proto"), "sum")


@query(_cells("first_s", "slot, proto").replace("WHERE first_s IS NOT NULL", "WHERE first_s IS NOT NULL AND proto = 'http'"))
def agg6_ttfb_histogram(spark, sf):
    return rounded(families.latency(red(spark, sf).where("proto = 'http'"), "first_s", "slot", "proto"), "sum")


@query(_cells("upload_s", "slot, op"))
def agg7_upload_histogram(spark, sf):
    return rounded(families.latency(red(spark, sf), "upload_s", "slot", "op"), "sum")


@query(_cells("blocking_s", "slot, db"))
def agg8_blocking_histogram(spark, sf):
    return rounded(families.latency(red(spark, sf), "blocking_s", "slot", "db"), "sum")


@query(f"""{RED} SELECT slot, db, "user", proto, outcome AS code, count(*) AS value FROM slots WHERE proto NOT IN ('pg', 'mysql') GROUP BY ALL""")
def agg9_requests_total(spark, sf):
    return families.requests_total(red(spark, sf))


@query(f"""{OBS} SELECT error, db, "user", proto, count(*) AS value FROM red WHERE error IS NOT NULL GROUP BY ALL""")
def agg10_errors_total(spark, sf):
    return families.errors_total(red(spark, sf))


@query(f"""{RED}, s AS (SELECT slot, db, "user", proto, CAST(sum(bytes_in) AS BIGINT) AS i, CAST(sum(bytes_out) AS BIGINT) AS o FROM slots WHERE proto NOT IN ('pg', 'mysql') GROUP BY ALL)
    SELECT slot, db, "user", proto, 'in' AS direction, i AS value FROM s UNION ALL SELECT slot, db, "user", proto, 'out', o FROM s""")
def agg11_bytes_total(spark, sf):
    return families.bytes_total(red(spark, sf))


def _sizes(grid: str, source: str, value: str) -> str:
    low, n = hist.GRIDS[grid]
    return f"""{source} SELECT CAST(least((SELECT count(*) FROM range(0, {n}) r(i) WHERE {value} > pow(2, {low} + i)), {n}) AS INTEGER) AS cell, count(*) AS n,
        CAST(sum({value}) AS BIGINT) AS sum FROM t GROUP BY 1"""


def _line_sizes(scale: int) -> str:
    return f"WITH t AS (SELECT CAST(floor(l_extendedprice * {scale}) AS BIGINT) AS v FROM lineitem)"


def _lineitem_sizes(spark, sf, scale: int, grid: str):
    t = A.table(spark, sf, "lineitem").select(F.floor(F.col("l_extendedprice") * scale).alias("v"))
    return hist.size_cells(t, "v", grid)


@query(_sizes("http", _line_sizes(100), "v"))
def agg12_sizes_http(spark, sf):
    return _lineitem_sizes(spark, sf, 100, "http")


@query(_sizes("s3", _line_sizes(10000), "v"))
def agg12_sizes_s3(spark, sf):
    return _lineitem_sizes(spark, sf, 10000, "s3")


@query(_sizes("redis", _line_sizes(1), "v"))
def agg12_sizes_redis(spark, sf):
    return _lineitem_sizes(spark, sf, 1, "redis")


@query(_sizes("depth", f"WITH {A.OBS_SQL}, t AS (SELECT depth AS v FROM obs WHERE depth IS NOT NULL)", "v"))
def agg13_pipeline_depth(spark, sf):
    return hist.size_cells(A.observations(spark, sf).select(F.col("depth").alias("v")), "v", "depth")


@query(f"{OBS} SELECT lower(err_name) AS redirect, proto, count(*) AS value FROM obs WHERE err_name IN ('MOVED', 'ASK') GROUP BY ALL")
def agg14_redirects_total(spark, sf):
    return families.redirects_total(red(spark, sf))


TXN_ISLANDS = f"""WITH {A.TRANSACTIONS_SQL}, x AS (
    SELECT *, lag(status) OVER w AS prev FROM txn WINDOW w AS (PARTITION BY conn ORDER BY seq)
), y AS (
    SELECT *, sum(CASE WHEN status <> 'I' AND coalesce(prev = 'I', TRUE) THEN 1 ELSE 0 END) OVER (PARTITION BY conn ORDER BY seq) AS t FROM x
), islands AS (
    SELECT conn, min(ts_ns) AS start_ns, max(ts_ns) FILTER (WHERE status = 'I') AS end_ns,
        arg_max(prev, seq) FILTER (WHERE status = 'I') = 'E' AS aborted
    FROM y WHERE status <> 'I' OR coalesce(prev, 'I') <> 'I' GROUP BY conn, t HAVING end_ns IS NOT NULL
)"""


@query(f"""{TXN_ISLANDS}, d AS (SELECT CASE WHEN aborted THEN 'aborted' ELSE 'ok' END AS status, (end_ns - start_ns) / 1e9 AS s FROM islands)
    SELECT status, {bucket_sql('s')} AS bucket, count(*) AS n, count(*) FILTER (WHERE s <= 0) AS nonpos FROM d GROUP BY ALL""")
def agg15_txn_histogram(spark, sf):
    t = streams.transaction_islands(A.transactions(spark, sf))
    t = t.select(F.when(F.col("aborted"), "aborted").otherwise("ok").alias("status"), ((F.col("end_ns") - F.col("start_ns")) / 1e9).alias("s"))
    return hist.latency_cells(t, "s", "status").drop("sum")


@query(f"{OBS} SELECT count(*) FILTER (WHERE flags & 2 <> 0) AS truncated, count(*) FILTER (WHERE force_other) AS other, count(*) FILTER (WHERE proto = 's3' AND flags & 2048 <> 0) AS internal FROM red")
def agg16_plain_totals(spark, sf):
    return families.plain_totals(red(spark, sf))


@query(f"""{RED} SELECT count(*) AS value FROM (SELECT DISTINCT slot, db, "user", proto, outcome FROM slots)""")
def agg17_series_count(spark, sf):
    return families.series_count(red(spark, sf))


@query(f"""{OBS}, l AS (SELECT *, greatest(seq - max(seq) OVER (PARTITION BY conn ORDER BY ts_start_ns, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 1, 0) AS lost FROM obs)
    SELECT proto, CAST(coalesce(sum(lost), 0) AS BIGINT) AS lost, count(*) FILTER (WHERE lost > 0) AS gaps FROM l GROUP BY proto""")
def agg18_loss_counters(spark, sf):
    o = streams.sequence_gaps(A.observations(spark, sf), order="ts_start_ns")
    return o.groupBy("proto").agg(F.sum("lost").alias("lost"), F.count_if(F.col("lost") > 0).alias("gaps"))


@query(f"""{RED} SELECT (SELECT CAST(sum(n) AS BIGINT) FROM (SELECT count(*) AS n FROM slots GROUP BY slot, db, "user", proto, outcome)) AS counted, (SELECT count(*) FROM events) AS total""")
def agg19_conservation(spark, sf):
    return families.conservation(red(spark, sf))


# --- cardinality -----------------------------------------------------------------------------------------------------


@query(f"""{RED}, f AS (SELECT db, "user", row_number() OVER (ORDER BY min(seq)) AS r FROM obs GROUP BY db, "user")
    SELECT CASE WHEN f.r <= 20 THEN s.db ELSE 'other' END AS db, CASE WHEN f.r <= 20 THEN s."user" ELSE 'other' END AS "user", count(*) AS n
    FROM slots s JOIN f ON s.db = f.db AND s."user" = f."user" GROUP BY ALL""")
def car4_dim_cap(spark, sf):
    return cardinality.cap_dims(A.observations(spark, sf), 20).groupBy("db", "user").agg(F.count("*").alias("n"))


@query(f"""{OBS}, f AS (SELECT proto, error, row_number() OVER (PARTITION BY proto ORDER BY min(seq), error) AS r FROM red WHERE error IS NOT NULL GROUP BY proto, error)
    SELECT red.proto, CASE WHEN red.error IS NULL THEN NULL WHEN f.r <= 2 THEN red.error ELSE 'other' END AS error, count(*) AS n
    FROM red LEFT JOIN f ON red.proto = f.proto AND red.error = f.error GROUP BY 1, 2""")
def car5_error_cap(spark, sf):
    return cardinality.cap_errors(red(spark, sf), 2).groupBy("proto", "error").agg(F.count("*").alias("n"))


@query(f"""{OBS}, f AS (SELECT proto, row_number() OVER (ORDER BY min(seq)) AS r FROM obs GROUP BY proto)
    SELECT CASE WHEN f.r <= 3 THEN o.proto ELSE 'other' END AS proto, count(*) AS n FROM obs o JOIN f USING (proto) GROUP BY 1""")
def car6_proto_cap(spark, sf):
    return cardinality.cap_protos(A.observations(spark, sf), 3).groupBy("proto").agg(F.count("*").alias("n"))


@query(f"""{RED} SELECT CASE WHEN proto IN ('pg', 'mysql') THEN 'query' ELSE proto END AS profile, count(DISTINCT slot) FILTER (WHERE slot <> 'other') AS slots,
    count(*) FILTER (WHERE slot = 'other') AS other FROM slots GROUP BY 1""")
def car7_profile_isolation(spark, sf):
    profile = F.when(F.col("proto").isin("pg", "mysql"), "query").otherwise(F.col("proto"))
    return red(spark, sf).groupBy(profile.alias("profile")).agg(
        F.count_distinct(F.when(F.col("slot") != S.OTHER, F.col("slot"))).alias("slots"), F.count_if(F.col("slot") == S.OTHER).alias("other")
    )


# --- sorts, limits, sets, joins --------------------------------------------------------------------------------------


@query(f"""{RED}, c AS (SELECT proto, slot, db, "user", count(*) AS value FROM slots GROUP BY ALL)
    SELECT *, row_number() OVER (ORDER BY proto NULLS FIRST, slot NULLS FIRST, db NULLS FIRST, "user" NULLS FIRST) AS place FROM c""")
def srt1_exposition_order(spark, sf):
    c = red(spark, sf).groupBy("proto", "slot", "db", "user").agg(F.count("*").alias("value"))
    return order.with_place(c, *map(F.col, ("proto", "slot", "db", "user")))


@query(f"""{RED}, c AS (SELECT CASE WHEN error IS NULL THEN 'other' ELSE error END AS code, count(*) AS n FROM slots GROUP BY 1)
    SELECT code, n, row_number() OVER (ORDER BY code = 'other', code) AS place FROM c""")
def srt2_other_last(spark, sf):
    from pyspark.sql import Window

    c = red(spark, sf).groupBy(F.coalesce("error", F.lit(S.OTHER)).alias("code")).agg(F.count("*").alias("n"))
    return c.withColumn("place", F.row_number().over(Window.orderBy(*ordering.other_last("code"))))


@query(f"""{OBS}, c AS (SELECT 'total' AS name, proto AS label1, kind AS label2, count(*) AS value FROM obs GROUP BY ALL)
    SELECT *, row_number() OVER (ORDER BY name NULLS FIRST, label1 NULLS FIRST, label2 NULLS FIRST) AS place FROM c""")
def srt3_scalar_order(spark, sf):
    c = A.observations(spark, sf).groupBy(F.lit("total").alias("name"), F.col("proto").alias("label1"), F.col("kind").alias("label2")).agg(F.count("*").alias("value"))
    return order.with_place(c, *map(F.col, ("name", "label1", "label2")))


@query(f"""{OBS}, t AS (SELECT ts_start_ns // 86400000000000 AS tick, count(*) AS n FROM obs GROUP BY 1)
    SELECT tick, least(n, 300) AS taken, n - least(n, 300) AS dropped, least(n, 300) * 4 >= 900 AS watermark FROM t""")
def lim1_bounded_fifo(spark, sf):
    return ordering.bounded_fifo(A.observations(spark, sf), 300, F.floor(F.col("ts_start_ns") / 86400000000000))


@query(f"{RED} SELECT slot, count(*) AS n FROM slots WHERE slot <> 'other' GROUP BY slot ORDER BY n DESC, slot LIMIT 10")
def lim2_top_k(spark, sf):
    c = red(spark, sf).where(F.col("slot") != S.OTHER).groupBy("slot").agg(F.count("*").alias("n"))
    return ordering.top(c, 10, "n", "slot")


@query(f"""{OBS} SELECT tick, seq, turn FROM (SELECT ts_start_ns // 86400000000000 AS tick, seq,
    row_number() OVER (PARTITION BY ts_start_ns // 86400000000000 ORDER BY seq) AS turn FROM obs) WHERE turn <= 20""")
def lim3_drain(spark, sf):
    return ordering.drain(A.observations(spark, sf), 20, F.floor(F.col("ts_start_ns") / 86400000000000)).select("tick", "seq", "turn")


@query(f"""{OBS} SELECT 'requests' AS name, proto, count(*) AS value FROM obs GROUP BY proto
    UNION ALL SELECT 'rows', proto, CAST(sum(rows) AS BIGINT) FROM obs GROUP BY proto""")
def set1_tee(spark, sf):
    o = A.observations(spark, sf)
    a = o.groupBy(F.lit("requests").alias("name"), "proto").agg(F.count("*").alias("value"))
    return a.unionByName(o.groupBy(F.lit("rows").alias("name"), "proto").agg(F.sum("rows").alias("value")))


@query("""WITH e AS (SELECT user_id || '/' || CAST(ts AS DATE) AS user_day, event_type FROM events),
    a AS (SELECT DISTINCT user_day FROM e WHERE event_type = 'view'), b AS (SELECT DISTINCT user_day FROM e WHERE event_type = 'click')
    SELECT user_day, 'add' AS change FROM b WHERE user_day NOT IN (SELECT user_day FROM a)
    UNION ALL SELECT user_day, 'del' FROM a WHERE user_day NOT IN (SELECT user_day FROM b)""")
def set2_set_changes(spark, sf):
    """Days of users: over whole tables nearly every user has events of all types."""
    day = F.concat(F.col("user_id").cast("string"), F.lit("/"), F.col("ts").cast("date").cast("string"))
    e = A.table(spark, sf, "events").select(day.alias("user_day"), "event_type")
    return ordering.set_changes(e.where("event_type = 'view'"), e.where("event_type = 'click'"), "user_day")


@query("""SELECT user_id, a.n AS log_n, b.n AS seen_n, CASE WHEN b.n IS NULL THEN 'log-only' WHEN a.n IS NULL THEN 'seen-only' ELSE 'both' END AS side
    FROM (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY 1) a
    FULL JOIN (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1) b USING (user_id)""")
def set3_keyed_union(spark, sf):
    e = A.table(spark, sf, "events")
    return joins.join_logs(e.where("event_type = 'view'"), e.where("event_type = 'error'"), "user_id")


@query(f"""{OBS}, l AS (SELECT 'select * from t' || (k % 10) || ' where id = ?' AS label, seq, k FROM obs WHERE text IS NOT NULL AND proto IN ('pg', 'mysql'))
    SELECT label, a.n AS log_n, b.n AS seen_n, CASE WHEN b.n IS NULL THEN 'log-only' WHEN a.n IS NULL THEN 'seen-only' ELSE 'both' END AS side
    FROM (SELECT label, count(*) AS n FROM l WHERE k % 10 < 8 GROUP BY label) a FULL JOIN (SELECT label, count(*) AS n FROM l WHERE k % 10 > 2 GROUP BY label) b USING (label)""")
def join1_log_and_seen(spark, sf):
    l = red(spark, sf).where("text IS NOT NULL AND proto IN ('pg', 'mysql')").select("label", "k")
    return joins.join_logs(l.where("k % 10 < 8"), l.where("k % 10 > 2"))


@query(f"""{OBS}, h AS (SELECT seq, seq // 2 AS req_id, dur_s FROM red WHERE proto = 'http')
    SELECT a.req_id, f.dur_s AS front_s, u.dur_s AS upstream_s FROM (SELECT DISTINCT req_id FROM h) a
    LEFT JOIN (SELECT req_id, dur_s FROM h WHERE seq % 2 = 0) f USING (req_id) LEFT JOIN (SELECT req_id, dur_s FROM h WHERE seq % 2 = 1) u USING (req_id)""")
def join2_two_legs(spark, sf):
    h = red(spark, sf).where("proto = 'http'").withColumn("req_id", F.floor(F.col("seq") / 2))
    return joins.join_legs(h.select("req_id").distinct(), h.where("seq % 2 = 0"), h.where("seq % 2 = 1"))


@query(f"""{OBS}, t AS (SELECT seq AS req_id, CASE op WHEN 'GET' THEN 'get' ELSE op END AS op FROM red WHERE proto = 'http'),
    o AS (SELECT seq AS req_id, op AS seen_op, dur_s FROM red WHERE proto = 'http' AND seq % 3 <> 0)
    SELECT t.req_id, t.op, o.seen_op, o.dur_s, CASE WHEN t.op = 'get' THEN 'GET' END AS alias,
        coalesce(o.seen_op = t.op OR o.seen_op = CASE WHEN t.op = 'get' THEN 'GET' END, FALSE) AS agrees FROM t LEFT JOIN o USING (req_id)""")
def join3_trace_aliases(spark, sf):
    h = red(spark, sf).where("proto = 'http'").withColumn("req_id", F.col("seq"))
    trace = h.select("req_id", F.when(F.col("op") == "GET", "get").otherwise(F.col("op")).alias("op"))
    aliases = spark.createDataFrame([("get", "GET")], "api string, name string")
    return joins.join_trace(trace, h.where("seq % 3 <> 0"), aliases)


@query("""WITH a AS (SELECT user_id, event_id FROM events WHERE event_type = 'view'), b AS (SELECT user_id, event_id FROM events WHERE event_type = 'click'),
    eq AS (SELECT user_id FROM (SELECT user_id, count(*) AS n FROM a GROUP BY 1) JOIN (SELECT user_id, count(*) AS n FROM b GROUP BY 1) USING (user_id, n)),
    ra AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM a), rb AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM b)
    SELECT user_id, k, ra.event_id AS left_at, rb.event_id AS right_at FROM ra JOIN rb USING (user_id, k) JOIN eq USING (user_id)""")
def join4_kth_to_kth(spark, sf):
    e = A.table(spark, sf, "events").select("user_id", "event_id", "event_type")
    return joins.pair_kth(e.where("event_type = 'view'"), e.where("event_type = 'click'"), "user_id", "event_id")


@query("""WITH l AS (SELECT user_id AS session, event_id AS seq, CASE event_type WHEN 'purchase' THEN 'execute' WHEN 'error' THEN 'error' ELSE 'parse' END AS phase, value AS dur_s FROM events),
    g AS (SELECT *, coalesce(sum(CASE WHEN phase IN ('execute', 'error') THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM l)
    SELECT session, max(seq) AS seq, round(sum(dur_s), 6) AS total_s FROM g GROUP BY session, g HAVING arg_max(phase, seq) = 'execute'""")
def join5_phase_accumulation(spark, sf):
    phase = F.when(F.col("event_type") == "purchase", "execute").when(F.col("event_type") == "error", "error").otherwise("parse")
    l = A.table(spark, sf, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), phase.alias("phase"), F.col("value").alias("dur_s"))
    return rounded(joins.accumulate_phases(l), "total_s", digits=6)


@query("""WITH a AS (SELECT user_id AS conn, event_id AS command, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events WHERE event_type = 'view'),
    b AS (SELECT user_id AS conn, event_id AS reply, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events WHERE event_type = 'click')
    SELECT conn, k, command, reply FROM a JOIN b USING (conn, k)""")
def join6_fifo_pairing(spark, sf):
    e = A.table(spark, sf, "events").select(F.col("user_id").alias("conn"), F.col("event_id").alias("seq"), "event_type")
    return joins.pair_in_order(e.where("event_type = 'view'"), e.where("event_type = 'click'"))


@query("""SELECT count(*) FILTER (WHERE user_id IN (SELECT user_id FROM events WHERE value > 480)) AS matched,
    count(*) FILTER (WHERE user_id NOT IN (SELECT user_id FROM events WHERE value > 480)) AS missed FROM events""")
def join7_semi_anti(spark, sf):
    e = A.table(spark, sf, "events").select("user_id", "value")
    return joins.observed(e, e.where("value > 480"), "user_id")


# --- windows on ordered streams --------------------------------------------------------------------------------------


@query("""SELECT user_id AS conn, event_id AS seq, coalesce(greatest(event_id - max(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 1, 0), 0) AS lost FROM events""")
def str2_sequence_gaps(spark, sf):
    e = A.table(spark, sf, "events").select(F.col("user_id").alias("conn"), F.col("event_id").alias("seq"), F.col("ts").alias("ts_ns"))
    return streams.sequence_gaps(e).select("conn", "seq", "lost")


@query("""SELECT user_id AS conn, event_id AS seq, coalesce(greatest(event_id - max(event_id) OVER (PARTITION BY user_id, event_id % 2 = 0 ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 1, 0), 0) AS lost FROM events""")
def str3_tls_sequence_gaps(spark, sf):
    e = A.table(spark, sf, "events").select(F.col("user_id").alias("conn"), F.col("event_id").alias("seq"), F.col("ts").alias("ts_ns"), (F.col("event_id") % 2 == 0).alias("decrypted"))
    return streams.tls_sequence_gaps(e).select("conn", "seq", "lost")


@query("""WITH e AS (SELECT user_id AS conn, epoch_us(ts) * 1000 AS ts_ns FROM events), x AS (SELECT *, CASE WHEN ts_ns - lag(ts_ns) OVER w >= 36000000000000 THEN 1 ELSE 0 END AS nw FROM e WINDOW w AS (PARTITION BY conn ORDER BY ts_ns)),
    y AS (SELECT *, sum(nw) OVER (PARTITION BY conn ORDER BY ts_ns RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS r FROM x)
    SELECT conn, min(ts_ns) AS first, max(ts_ns) AS last, count(*) AS n FROM y GROUP BY conn, r""")
def str5_idle_sessions(spark, sf):
    e = A.table(spark, sf, "events").select(F.col("user_id").alias("conn"), (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("ts_ns"))
    return streams.idle_sessions(e, 36000)


@query("""WITH c AS (SELECT user_id AS conn, 0 AS dir, event_id AS seq, event_id % 3 * 100 AS off, CAST(floor(value / 2) AS BIGINT) AS cap_len, 300 + event_id % 2 * 100 AS total_len FROM events),
    x AS (SELECT *, lag(off + cap_len) OVER w AS e, lag(total_len) OVER w AS t FROM c WINDOW w AS (PARTITION BY conn, dir ORDER BY seq)),
    y AS (SELECT *, CASE WHEN e IS NULL THEN off WHEN off = 0 THEN t - e ELSE off - e END AS gap FROM x)
    SELECT conn, seq, greatest(gap, 0) AS hole, coalesce(gap < 0 OR off + cap_len > total_len OR (off <> 0 AND t <> total_len), FALSE) AS anomaly FROM y""")
def str6_chunk_holes(spark, sf):
    e = F.col("event_id")
    c = A.table(spark, sf, "events").select(
        F.col("user_id").alias("conn"), F.lit(0).alias("dir"), e.alias("seq"), (e % 3 * 100).alias("off"),
        F.floor(F.col("value") / 2).alias("cap_len"), (300 + e % 2 * 100).alias("total_len"),
    )
    return streams.chunk_holes(c).select("conn", "seq", "hole", "anomaly")


@query("SELECT l_orderkey AS conn, l_linenumber AS seq, l_suppkey % 3 AS call, count(*) OVER (PARTITION BY l_orderkey, l_suppkey % 3) AS depth FROM lineitem")
def str22_batch_depth(spark, sf):
    c = A.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("conn"), F.col("l_linenumber").alias("seq"), (F.col("l_suppkey") % 3).alias("call"))
    return streams.batch_depth(c)


@query("""SELECT user_id AS conn, event_id AS seq, coalesce(last_value(CASE WHEN event_type = 'signup' THEN 'db' || (event_id % 4) END IGNORE NULLS) OVER
    (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '?') AS in_force FROM events""")
def str23_str24_carried_label(spark, sf):
    set_to = F.when(F.col("event_type") == "signup", F.concat(F.lit("db"), (F.col("event_id") % 4).cast("string")))
    e = A.table(spark, sf, "events").select(F.col("user_id").alias("conn"), F.col("event_id").alias("seq"), set_to.alias("label"))
    return streams.carried_label(e, "label").select("conn", "seq", "in_force")


@query(f"{TXN_ISLANDS} SELECT * FROM islands")
def str25_transaction_islands(spark, sf):
    return streams.transaction_islands(A.transactions(spark, sf))


@query(f"{OBS} SELECT conn, arg_max(sqlstate, seq) FILTER (WHERE sqlstate IS NOT NULL) AS label FROM obs GROUP BY conn")
def str30_last_session(spark, sf):
    return streams.last_session(A.observations(spark, sf).withColumn("label", F.col("sqlstate")), "label")


# --- PromQL ----------------------------------------------------------------------------------------------------------

SCR = f"""WITH {A.SCRAPES_SQL}, inc AS (
    SELECT *, CASE WHEN value < lag(value) OVER w THEN value ELSE value - lag(value) OVER w END AS delta FROM scrapes WINDOW w AS (PARTITION BY name, kind ORDER BY ts)
), rates AS (
    SELECT name, kind, ((ts - 1) // 21600 + 1) * 21600 AS "at", sum(delta) / 21600 AS rate FROM inc WHERE delta IS NOT NULL GROUP BY ALL
)"""
WINDOW_S = 21600
REQUESTS, BYTES = f"{S.PREFIX}_requests_total", f"{S.PREFIX}_bytes_total"


def _rates(spark, sf, name: str) -> DataFrame:
    return promql.rate(promql.select(A.scrapes(spark, sf), name), WINDOW_S)


@query(f"""{SCR} SELECT name, kind, "at", rate FROM rates WHERE name = '{REQUESTS}'""")
def pql1_rate(spark, sf):
    return _rates(spark, sf, REQUESTS).select("name", promql.label("kind").alias("kind"), "at", "rate")


@query(f"""{SCR} SELECT "at", kind, sum(rate) AS value FROM rates WHERE name = '{REQUESTS}' AND kind <> 'view' GROUP BY ALL""")
def pql2_sum_by(spark, sf):
    return promql.sum_by(_rates(spark, sf, REQUESTS).where(promql.label("kind") != "view"), "rate", "kind")


QUANTILE = f"""{RED}, c AS (SELECT proto, {bucket_sql('dur_s')} AS bucket FROM slots WHERE dur_s IS NOT NULL),
    cum AS (SELECT proto, pow(2.0, j) AS le, count(*) FILTER (WHERE bucket < 4 * j) AS n FROM c, range(-13, 6) r(j) GROUP BY proto, j
        UNION ALL SELECT proto, 'inf'::DOUBLE, count(*) FROM c GROUP BY proto),
    w AS (SELECT *, coalesce(lag(n) OVER v, 0) AS below, coalesce(lag(le) OVER v, 0) AS low, max(n) OVER (PARTITION BY proto) * PHI AS rank FROM cum WINDOW v AS (PARTITION BY proto ORDER BY le)),
    q AS (SELECT proto, arg_min(CASE WHEN isinf(le) OR n = below THEN low ELSE low + (le - low) * (rank - below) / (n - below) END, le) AS quantile FROM w WHERE n >= rank AND n > 0 GROUP BY proto)"""


def _quantile(spark, sf, phi: float) -> DataFrame:
    cum = hist.classic_cumulative(hist.latency_cells(red(spark, sf), "dur_s", "proto"), "proto")
    return hist.quantile_from_cumulative(cum.withColumn("cumulative", F.col("cumulative").cast("double")), phi, "proto")


@query(QUANTILE.replace("PHI", "0.95") + " SELECT proto, round(quantile, 9) AS quantile FROM q")
def pql3_histogram_quantile(spark, sf):
    return rounded(_quantile(spark, sf, 0.95), "quantile")


TOP_QUANTILE = f"""{RED}, c AS (SELECT slot, {bucket_sql('dur_s')} AS bucket FROM slots WHERE dur_s IS NOT NULL AND slot <> 'other'),
    cum AS (SELECT slot, pow(2.0, j) AS le, count(*) FILTER (WHERE bucket < 4 * j) AS n FROM c, range(-13, 6) r(j) GROUP BY slot, j
        UNION ALL SELECT slot, 'inf'::DOUBLE, count(*) FROM c GROUP BY slot),
    w AS (SELECT *, coalesce(lag(n) OVER v, 0) AS below, coalesce(lag(le) OVER v, 0) AS low, max(n) OVER (PARTITION BY slot) * 0.99 AS rank FROM cum WINDOW v AS (PARTITION BY slot ORDER BY le)),
    q AS (SELECT slot, arg_min(CASE WHEN isinf(le) OR n = below THEN low ELSE low + (le - low) * (rank - below) / (n - below) END, le) AS quantile FROM w WHERE n >= rank AND n > 0 GROUP BY slot)
    SELECT slot, round(quantile, 9) AS quantile FROM q ORDER BY 2 DESC, slot LIMIT 10"""


@query(TOP_QUANTILE)
def pql4_top_p99(spark, sf):
    """Ten identities of highest 99th percentile: the flagship."""
    cum = hist.classic_cumulative(hist.latency_cells(red(spark, sf).where(F.col("slot") != S.OTHER), "dur_s", "slot"), "slot")
    q = hist.quantile_from_cumulative(cum.withColumn("cumulative", F.col("cumulative").cast("double")), 0.99, "slot")
    return rounded(q, "quantile").orderBy(F.desc("quantile"), "slot").limit(10)


@query(f"""{SCR} SELECT "at", sum(rate) FILTER (WHERE kind = 'error') / greatest(sum(rate), 0.001) AS ratio FROM rates WHERE name = '{REQUESTS}' GROUP BY "at" """)
def pql5_error_ratio(spark, sf):
    r = _rates(spark, sf, REQUESTS)
    per = r.groupBy("at").agg(F.sum(F.when(promql.label("kind") == "error", F.col("rate"))).alias("e"), F.sum("rate").alias("t"))
    return per.select("at", promql.ratio(F.col("e"), F.col("t"), 0.001).alias("ratio"))


@query(f"{SCR} SELECT coalesce(sum(rate), 0.0) AS value FROM rates WHERE kind = 'nothing'")
def pql6_or_zero(spark, sf):
    return promql.or_zero(_rates(spark, sf, REQUESTS).where(promql.label("kind") == "nothing"), "rate").withColumnRenamed("rate", "value")


@query(f"""{SCR} SELECT "at", kind FROM rates WHERE name = '{REQUESTS}' AND rate > 0.001""")
def pql7_degraded(spark, sf):
    return _rates(spark, sf, REQUESTS).where("rate > 0.001").select("at", promql.label("kind").alias("kind"))


@query(f"WITH {A.SCRAPES_SQL} SELECT ts, kind, value FROM scrapes WHERE name = '{BYTES}' AND regexp_full_match(kind, 'v.*|cl.ck')")
def pql8_matchers(spark, sf):
    return promql.select(A.scrapes(spark, sf), BYTES, kind="~v.*|cl.ck").select("ts", promql.label("kind").alias("kind"), "value")


@query("SELECT DISTINCT event_type AS kind FROM events")
def pql9_label_values(spark, sf):
    return promql.label_values(A.scrapes(spark, sf), REQUESTS, "kind")


@query(f"""{SCR} SELECT b."at", b.kind, CASE WHEN r.rate <> 0 THEN b.rate / r.rate END AS mean FROM rates b JOIN rates r USING ("at", kind)
    WHERE b.name = '{BYTES}' AND r.name = '{REQUESTS}'""")
def pql10_mean(spark, sf):
    return promql.mean_rate(_rates(spark, sf, BYTES), _rates(spark, sf, REQUESTS), "kind")


@query(f"""{SCR} SELECT "at", kind, sum(rate) AS value FROM rates WHERE name = '{BYTES}' GROUP BY ALL""")
def pql11_total_rate(spark, sf):
    return promql.sum_by(_rates(spark, sf, BYTES), "rate", "kind")


@query(f"WITH {A.SCRAPES_SQL} SELECT sum(v) AS value FROM (SELECT kind, arg_max(value, ts) AS v FROM scrapes WHERE name = '{REQUESTS}' GROUP BY kind)")
def pql12_instant_sum(spark, sf):
    return promql.instant(promql.select(A.scrapes(spark, sf), REQUESTS)).agg(F.sum("value").alias("value"))


# --- percentiles, sampling -------------------------------------------------------------------------------------------


@query("SELECT event_type, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.5) AS p50 FROM events GROUP BY event_type")
def pct1_nearest_rank(spark, sf):
    return order.exact_percentiles(A.table(spark, sf, "events"), "value", {"p95": 0.95, "p50": 0.5}, "event_type")


@query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
    SELECT event_type, value FROM r WHERE i = round_even((n - 1) * 0.9, 0)""")
def pct2_rounded_rank(spark, sf):
    return percentiles.rounded_rank(A.table(spark, sf, "events"), "value", 0.9, "event_type")


@query(f"""{OBS}, v AS (SELECT proto, dur_s, ({BOUNDS})[list_position(list_transform({BOUNDS}, lambda b: b > dur_s), TRUE)] AS up FROM red WHERE dur_s > 0)
    SELECT proto, round(quantile_disc(up, 0.95), 9) AS p95_grid FROM v GROUP BY proto""")
def pct3_grid_percentile(spark, sf):
    r = reduce.reduce_observations(A.observations(spark, sf)).where("dur_s > 0")
    table = F.array(*(F.lit(b) for b in hist.bounds()))
    at = hist.bucket(F.col("dur_s")) - hist.LOW + 2
    up = r.withColumn("up", F.get(table, at - 1))
    return rounded(order.exact_percentiles(up, "up", {"p95_grid": 0.95}, "proto"), "p95_grid")


@query("SELECT o_orderpriority, round(median(o_totalprice), 6) AS median, round((max(o_totalprice) - min(o_totalprice)) / median(o_totalprice) * 100, 6) AS spread FROM orders GROUP BY 1")
def pct4_median_spread(spark, sf):
    return rounded(percentiles.median_spread(A.table(spark, sf, "orders"), "o_totalprice", "o_orderpriority"), "median", "spread", digits=6)


@query("""SELECT event_type, count(*) AS samples, quantile_disc(abs(value - 250), 0.9) AS p90, count(*) >= 50 AND quantile_disc(abs(value - 250), 0.9) <= 220 AS ok
    FROM events GROUP BY event_type""")
def pct5_gates(spark, sf):
    e = A.table(spark, sf, "events").withColumn("delta", F.col("value") - 250)
    return percentiles.gate(e, "delta", 220.0, 50, "event_type")


@query(f"""{OBS} SELECT seq, CASE WHEN ts_complete_ns <= ts_start_ns THEN FALSE
    WHEN ts_complete_ns - coalesce(ts_req_done_ns, ts_start_ns) >= 200000000 AND flags & 8192 = 0 THEN TRUE
    WHEN seq % 3 = 0 THEN seq % 2 = 1 ELSE TRUE END AS sampled FROM obs""")
def smp1_should_sample(spark, sf):
    o = A.observations(spark, sf).withColumn("trace_flags", F.when(F.col("seq") % 3 == 0, (F.col("seq") % 2).cast("int")))
    return o.select("seq", spans.should_sample(1.0, slow_s=0.2).alias("sampled"))


@query(f"""{OBS} SELECT seq, sha256('0/' || conn || '/' || ts_start_ns)[1:32] AS trace_id, sha256('0/' || conn || '/' || ts_start_ns)[33:48] AS span_id FROM obs""")
def smp3_trace_ids(spark, sf):
    trace, span = spans.trace_ids(0)
    return A.observations(spark, sf).select("seq", trace.alias("trace_id"), span.alias("span_id"))


# --- normalisation ---------------------------------------------------------------------------------------------------

_SIMPLE = r"""regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(lower(text),
    '''[^'']*''|\$[0-9]+|\b[0-9]+(\.[0-9]+)?\b', '?', 'g'), '([(),;=*+<>.])', ' \1 ', 'g'), '\s+', ' ', 'g')), '( ;)+$', ''),
    '\( \?( , \?)+ \)', '( ? )', 'g'), '\( \? \)( , \( \? \))+', '( ? )', 'g')"""


@query(f"WITH {A.STATEMENTS_SQL} SELECT {_SIMPLE} AS label, count(*) AS n FROM statements GROUP BY 1")
def fn1_norm_sql(spark, sf):
    """The exact lexer; the oracle's regular expressions agree on these statements."""
    out = A.statements(spark, sf).select(sql_text.norm_sql(F.col("text"))["label"].alias("label"))
    return out.groupBy("label").agg(F.count("*").alias("n"))


@query(f"WITH {A.STATEMENTS_SQL} SELECT {_SIMPLE} AS label, count(*) AS n FROM statements GROUP BY 1")
def fn1_norm_sql_simple(spark, sf):
    out = A.statements(spark, sf).select(sql_text.norm_sql_simple(F.col("text")).alias("label"))
    return out.groupBy("label").agg(F.count("*").alias("n"))


def _opaque_sql(x: str) -> str:
    return (
        f"(strlen({x}) > 0 AND (regexp_matches({x}, '[\\x00-\\x1f\\x7f]') OR regexp_matches({x}, '^[0-9]+$') OR strlen({x}) > 24 OR regexp_matches({x}, '^[0-9A-Fa-f]{{8,}}$')"
        f" OR regexp_matches({x}, '^[0-9A-Fa-f]{{8}}(-[0-9A-Fa-f]{{4}}){{3}}-[0-9A-Fa-f]{{12}}$') OR regexp_matches({x}, '^[0-9A-HJKMNP-TV-Za-hjkmnp-tv-z]{{26}}$') OR regexp_matches({x}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$')"
        f" OR (regexp_matches({x}, '^[A-Za-z0-9+/=_-]{{16,}}$') AND regexp_matches({x}, '[A-Z]') AND regexp_matches({x}, '[a-z]') AND regexp_matches({x}, '[0-9]'))"
        f" OR (strlen({x}) >= 6 AND length(regexp_replace({x}, '[^0-9]', '', 'g')) * 10 > strlen({x}) * 4)))"
    )


_EXT = r"'\.([A-Za-z0-9]{1,8})$'"
_SEGMENT = (
    f"CASE WHEN regexp_matches(regexp_extract(s, {_EXT}, 1), '[A-Za-z]') AND length(s) > length(regexp_extract(s, {_EXT}, 1)) + 1 THEN"
    f" CASE WHEN len(list_filter(string_split(s[:length(s) - length(regexp_extract(s, {_EXT}, 1)) - 1], '.'), lambda x: {_opaque_sql('x')})) > 0"
    f" THEN '{{file}}.' || regexp_extract(s, {_EXT}, 1) ELSE s END WHEN {_opaque_sql('s')} THEN '{{id}}' ELSE s END"
)


@query(f"""WITH p AS (SELECT page_id, regexp_replace(regexp_replace(url, '#.*$', ''), '^https?://[^/]*', '') AS target FROM pages),
    q AS (SELECT page_id, target, CASE WHEN regexp_replace(target, '\\?.*$', '') = '' THEN '/' ELSE regexp_replace(target, '\\?.*$', '') END AS path FROM p)
    SELECT page_id, '/' || array_to_string(list_transform(string_split(path, '/')[2:9], lambda s: {_SEGMENT}), '/') || CASE WHEN len(string_split(path, '/')) - 1 > 8 THEN '/...' ELSE '' END AS route FROM q""")
def fn3_route_templates(spark, sf):
    p = A.table(spark, sf, "pages").select("page_id", F.regexp_replace(F.regexp_replace("url", "#.*$", ""), "^https?://[^/]*", "").alias("target"))
    p = p.withColumn("target", F.when(F.col("target") == "", "/").when(F.col("target").startswith("?"), F.concat(F.lit("/"), F.col("target"))).otherwise(F.col("target")))
    return p.select("page_id", route.route(F.lit("GET"), F.col("target")).alias("route"))


@query("""SELECT event_id, CASE WHEN event_type = 'view' THEN '/api/{kind}/{id}' WHEN event_type = 'click' AND user_id % 2 = 0 THEN '/api/click/{n}' ELSE '/api/' || event_type || '/{id}' END AS route FROM events""")
def fn3_route_map(spark, sf):
    patterns, _ = route.parse_map("GET /api/{kind}/{id}\nPOST /api/click/{n}\n")
    method = F.when(F.col("event_type") == "view", "GET").when(F.col("user_id") % 2 == 0, "POST").otherwise("PUT")
    target = F.concat(F.lit("/api/"), F.col("event_type"), F.lit("/"), (F.col("event_id") + 100000).cast("string"))
    return A.table(spark, sf, "events").select("event_id", route.route(method, target, patterns).alias("route"))


@query("""SELECT event_id, '/search?kind=' || event_type || '&u=' || CASE WHEN user_id >= 0 THEN '{id}' END AS route FROM events""")
def fn3_query_promotion(spark, sf):
    target = F.concat(F.lit("/search?secret=x&u="), F.col("user_id").cast("string"), F.lit("&kind="), F.col("event_type"))
    return A.table(spark, sf, "events").select("event_id", route.route(F.lit("GET"), target, keys=["kind", "u"]).alias("route"))


@query("""
    WITH c AS (SELECT doc_id, regexp_replace(text, '[\\x00-\\x1f\\x7f]', '', 'g') AS t FROM documents),
    n AS (SELECT doc_id, t, (SELECT max(i) FROM range(0, 256) r(i) WHERE strlen(substring(t, 1, CAST(i AS INTEGER))) <= 255) AS i FROM c)
    SELECT doc_id, substring(t, 1, CAST(i AS INTEGER)) AS route FROM n
""")
def fn4_given_route(spark, sf):
    return A.table(spark, sf, "documents").select("doc_id", route.given(F.col("text")).alias("route"))


@query("""SELECT event_id, '/p/token/7?page=' || event_id || CASE WHEN event_type = 'view' THEN '&' ELSE ';' END || 'X-Amz-Signature=***&api_key=***#x' AS url FROM events""")
def fn5_url_redact(spark, sf):
    sep = F.when(F.col("event_type") == "view", "&").otherwise(";")
    target = F.concat(F.lit("/p/token/7?page="), F.col("event_id").cast("string"), sep, F.lit("X-Amz-Signature=ab"), F.col("user_id").cast("string"), F.lit("&api_key="))
    return A.table(spark, sf, "events").select("event_id", F.concat(url.redact(target), F.lit("#x")).alias("url"))


@query("SELECT doc_id, regexp_matches(source, '^[a-z0-9][a-z0-9.-]{1,61}[a-z0-9]$') AND NOT contains(source, '..') AS valid FROM documents")
def fn7_bucket_names(spark, sf):
    return A.table(spark, sf, "documents").select("doc_id", s3.bucket_valid(F.col("source")).alias("valid"))


@query("SELECT event_id, 'b' || (user_id % 9) || 'kt' AS bucket, CASE WHEN event_id % 2 = 0 THEN 'k/' || event_id ELSE '' END AS key, event_id % 3 = 0 AS vhost FROM events")
def fn6_s3_addresses(spark, sf):
    bucket = F.concat(F.lit("b"), (F.col("user_id") % 9).cast("string"), F.lit("kt"))
    key = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("k/"), F.col("event_id").cast("string"))).otherwise("")
    virtual = F.col("event_id") % 3 == 0
    host = F.when(virtual, F.concat(bucket, F.lit(".s3.example.com:9000"))).otherwise("store:9000")
    path = F.when(virtual, F.concat(F.lit("/"), key)).otherwise(F.concat(F.lit("/"), bucket, F.lit("/"), key))
    a = A.table(spark, sf, "events").select("event_id", s3.address(host, path, ("s3.example.com",)).alias("a"))
    return a.select("event_id", "a.bucket", "a.key", "a.vhost")


# The operations that the requests of fn8 can be, written out.
S3_ROWS = """('service', '', 'GET', NULL, 'ListBuckets'),
    ('bucket', 'acl', 'GET', NULL, 'GetBucketAcl'), ('bucket', 'acl', 'PUT', NULL, 'PutBucketAcl'), ('bucket', 'uploads', 'GET', NULL, 'ListMultipartUploads'),
    ('bucket', 'tagging', 'GET', NULL, 'GetBucketTagging'), ('bucket', 'tagging', 'PUT', NULL, 'PutBucketTagging'), ('bucket', 'tagging', 'DELETE', NULL, 'DeleteBucketTagging'),
    ('bucket', 'versions', 'GET', NULL, 'ListObjectVersions'), ('bucket', '', 'GET', NULL, 'ListObjects'), ('bucket', '', 'PUT', NULL, 'CreateBucket'),
    ('bucket', '', 'DELETE', NULL, 'DeleteBucket'), ('bucket', '', 'HEAD', NULL, 'HeadBucket'), ('bucket', '', 'POST', NULL, 'PostObject'),
    ('object', 'acl', 'GET', NULL, 'GetObjectAcl'), ('object', 'acl', 'PUT', NULL, 'PutObjectAcl'), ('object', 'uploads', 'POST', NULL, 'CreateMultipartUpload'),
    ('object', 'uploadId', 'PUT', TRUE, 'UploadPartCopy'), ('object', 'uploadId', 'PUT', FALSE, 'UploadPart'), ('object', 'uploadId', 'GET', NULL, 'ListParts'),
    ('object', 'uploadId', 'POST', NULL, 'CompleteMultipartUpload'), ('object', 'uploadId', 'DELETE', NULL, 'AbortMultipartUpload'),
    ('object', 'tagging', 'GET', NULL, 'GetObjectTagging'), ('object', 'tagging', 'PUT', NULL, 'PutObjectTagging'), ('object', 'tagging', 'DELETE', NULL, 'DeleteObjectTagging'),
    ('object', '', 'GET', NULL, 'GetObject'), ('object', '', 'HEAD', NULL, 'HeadObject'), ('object', '', 'PUT', TRUE, 'CopyObject'), ('object', '', 'PUT', FALSE, 'PutObject'),
    ('object', '', 'DELETE', NULL, 'DeleteObject')"""


@query(f"""WITH t(level, sub, method, copy, op) AS (VALUES {S3_ROWS}),
    r AS (SELECT event_id, ['GET', 'PUT', 'POST', 'DELETE', 'HEAD'][event_id % 5 + 1] AS method, ['', 'acl', 'uploads', 'uploadId', 'tagging', 'versions', 'nope'][event_id % 7 + 1] AS sub,
        user_id % 2 = 0 AS copy, ['service', 'bucket', 'object'][user_id % 3 + 1] AS level FROM events)
    SELECT event_id, coalesce(op, 'other') AS op FROM r LEFT JOIN t ON r.level = t.level AND r.method = t.method AND (t.copy IS NULL OR r.copy = t.copy) AND CASE WHEN r.sub = 'nope' THEN '' ELSE r.sub END = t.sub""")
def fn8_s3_operations(spark, sf):
    pick = lambda values, i: F.element_at(F.array(*map(F.lit, values)), (i + 1).cast("int"))
    e, u = F.col("event_id"), F.col("user_id")
    r = A.table(spark, sf, "events").select(
        "event_id", pick(["GET", "PUT", "POST", "DELETE", "HEAD"], e % 5).alias("method"),
        F.concat(F.lit("x=1&"), pick(["", "acl", "uploads", "uploadId=7", "tagging=", "versions", "nope"], e % 7)).alias("q"),
        (u % 2 == 0).alias("copy"), pick(["/", "/bkt", "/bkt/a/b.txt"], u % 3).alias("path"),
    )
    return s3.with_operation(r, "method", "path", "q", "copy").select("event_id", F.col("s3_op").alias("op"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'NoSuchKey' WHEN 1 THEN 'other' END AS code FROM events")
def fn9_fn11_s3_errors(spark, sf):
    body = F.when(F.col("event_id") % 3 == 0, "<Error><Code>NoSuchKey</Code></Error>").when(F.col("event_id") % 3 == 1, "<Code>Mine</Code><Code>NoSuchKey</Code>").otherwise("<Error/>")
    return A.table(spark, sf, "events").select("event_id", s3.error_code(body).alias("code"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'AK' || user_id WHEN 1 THEN 'V2' || user_id WHEN 2 THEN 'PS' || user_id ELSE '-' END AS k FROM events")
def fn10_access_keys(spark, sf):
    e, u = F.col("event_id") % 4, F.col("user_id").cast("string")
    auth = F.when(e == 0, F.concat(F.lit("AWS4-HMAC-SHA256 Credential=AK"), u, F.lit("/2024/r/s3, Signature=zz"))).when(e == 1, F.concat(F.lit("AWS V2"), u, F.lit(":sig="))).otherwise("")
    q = F.when(e == 2, F.concat(F.lit("a=b&X-Amz-Credential=PS"), u, F.lit("%2F2024&c=d"))).otherwise("")
    return A.table(spark, sf, "events").select("event_id", s3.access_key(auth, q).alias("k"))


@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'GET' WHEN 1 THEN 'CONFIG|GET' WHEN 2 THEN 'CONFIG|other' WHEN 3 THEN 'other' WHEN 4 THEN 'CLIENT' ELSE 'XREAD' END AS cmd FROM events""")
def fn12_redis_commands(spark, sf):
    e = F.col("event_id") % 6
    words = F.when(e == 0, "get k").when(e == 1, "Config get x").when(e == 2, "CONFIG zap").when(e == 3, "nope a").when(e == 4, "client").otherwise("xread")
    return A.table(spark, sf, "events").select("event_id", redis.command_label(F.split(words, " ")).alias("cmd"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'WRONGTYPE' WHEN 1 THEN 'MOVED' WHEN 2 THEN 'other' ELSE 'ERR' END AS err FROM events")
def fn15_redis_errors(spark, sf):
    e = F.col("event_id") % 4
    line = F.when(e == 0, "WRONGTYPE Operation against a key").when(e == 1, "MOVED 3999 127.0.0.1:6381").when(e == 2, "wrongtype x").otherwise("ERR")
    return A.table(spark, sf, "events").select("event_id", redis.error_label(line).alias("err"))


@query("""SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN event_id END AS n FROM events""")
def fn17_tag_rows(spark, sf):
    from wiretally.streaming.postgres import tag_rows_column

    verb = F.when(F.col("event_type") == "view", "SELECT ").when(F.col("event_type") == "click", "INSERT 0 ").when(F.col("event_type") == "error", "CREATE TABLE ").otherwise("SELECT x")
    return A.table(spark, sf, "events").select("event_id", tag_rows_column(F.concat(verb, F.col("event_id").cast("string"))).alias("n"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN lower(lpad(to_hex(event_id + 1), 32, '0')) END AS trace_id, CASE WHEN event_id % 3 = 0 THEN CAST(event_id % 2 AS INTEGER) END AS trace_flags FROM events""")
def fn18_traceparent(spark, sf):
    e = F.col("event_id")
    head = F.concat(F.when(e % 3 == 1, "01-").otherwise("00-"), F.lpad(F.lower(F.hex(e + 1)), 32, "0"), F.lit("-00000000000000aa-"), F.when(e % 3 == 2, "zz").when(e % 2 == 0, "00").otherwise("01"))
    t = A.table(spark, sf, "events").select("event_id", url.traceparent(head).alias("t"))
    return t.select("event_id", F.lower("t.trace_id").alias("trace_id"), "t.trace_flags")


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'u' || user_id END AS usr FROM events")
def fn19_basic_user(spark, sf):
    e, u = F.col("event_id"), F.concat(F.lit("u"), F.col("user_id").cast("string"))
    head = F.concat(F.when(e % 2 == 0, "Basic ").otherwise("Bearer "), F.base64(F.encode(F.concat(u, F.lit(":pw:x")), "UTF-8")))
    return A.table(spark, sf, "events").select("event_id", url.basic_user(head).alias("usr"))


@query("""SELECT page_id, regexp_extract(url, '^https?://([^/?]*)', 1) AS host, CASE WHEN regexp_replace(regexp_replace(url, '^https?://[^/?]*', ''), '\\?.*$', '') = '' THEN '/'
    ELSE regexp_replace(regexp_replace(url, '^https?://[^/?]*', ''), '\\?.*$', '') END AS path, CASE WHEN contains(url, '?') THEN url[instr(url, '?') + 1:] ELSE '' END AS query FROM pages""")
def fn20_split_targets(spark, sf):
    p = A.table(spark, sf, "pages").select("page_id", url.split_target(F.col("url")).alias("t"))
    return p.select("page_id", "t.host", "t.path", "t.query")


@query("""SELECT doc_id, replace(replace(replace(text, '\\', '\\\\'), '"', '\\"'), chr(10), '\\n') AS label FROM documents""")
def fn22_label_escape(spark, sf):
    return A.table(spark, sf, "documents").select("doc_id", url.label_escape(F.col("text")).alias("label"))


@query("SELECT event_id, replace('CONFIG|GET', '|', ' ') || repeat(' ?', CAST(least(user_id % 40, 32) AS INTEGER)) || CASE WHEN user_id % 40 > 32 THEN ' ...' ELSE '' END AS shown FROM events")
def fn23_redis_text(spark, sf):
    return A.table(spark, sf, "events").select("event_id", redis.shown(F.lit("CONFIG|GET"), F.col("user_id") % 40).alias("shown"))


@query("""SELECT event_id, '/a?u=' || repeat('*', length(CAST(user_id AS VARCHAR))) || '&flag&t=**' AS shown FROM events""")
def fn24_masked_in_place(spark, sf):
    t = F.concat(F.lit("/a?u="), F.col("user_id").cast("string"), F.lit("&flag&t=xy"))
    return A.table(spark, sf, "events").select("event_id", url.masked_in_place(t).alias("shown"))


# --- sinks -----------------------------------------------------------------------------------------------------------


@query(f"""{OBS}, c AS (SELECT db, "user", proto, kind, outcome AS code, count(*) AS n FROM red WHERE proto IN ('pg', 'mysql') GROUP BY ALL)
    SELECT '{S.PREFIX}_queries_total{{db="' || db || '",user="' || "user" || '",proto="' || proto || '",kind="' || kind || '",code="' || code || '"}} ' || n AS line FROM c
    UNION ALL SELECT '# HELP {S.PREFIX}_queries_total Finished statements.' || chr(10) || '# TYPE {S.PREFIX}_queries_total counter'""")
def snk1_exposition_text(spark, sf):
    rows = families.queries_total(red(spark, sf))
    return expose.counter_lines(rows, f"{S.PREFIX}_queries_total", "Finished statements.", "db", "user", "proto", "kind", "code").select("line")


@query(f"""{RED}, c AS (SELECT proto, dur_s, {bucket_sql('dur_s')} AS bucket FROM slots WHERE dur_s IS NOT NULL)
    SELECT proto, count(*) FILTER (WHERE bucket < 0) AS below_second, count(*) AS n FROM c GROUP BY proto""")
def snk1_histogram_text(spark, sf):
    """Buckets read back from the exposition lines."""
    cells = hist.latency_cells(red(spark, sf), "dur_s", "proto")
    lines = expose.histogram_lines(cells, f"{S.PREFIX}_duration_seconds", "Durations.", "proto")
    part = lambda p: F.regexp_extract("line", p, 1)
    one = lines.where(F.col("line").rlike('_bucket.*le="(1|\\+Inf)"'))
    return one.groupBy(part('proto="([^"]*)"').alias("proto")).agg(
        F.max(F.when(part('le="([^"]*)"') == "1", part(" ([0-9]+)$").cast("long"))).alias("below_second"),
        F.max(F.when(part('le="([^"]*)"') == "+Inf", part(" ([0-9]+)$").cast("long"))).alias("n"),
    )


@query(f"""{OBS} SELECT '{S.PREFIX}_errors_total' AS name, 'counter' AS type, error, proto, CAST(count(*) AS DOUBLE) AS value FROM red WHERE error IS NOT NULL GROUP BY error, proto""")
def snk2_long_format(spark, sf):
    rows = families.errors_total(red(spark, sf)).groupBy("error", "proto").agg(F.sum("value").alias("value"))
    out = expose.long_format(rows, f"{S.PREFIX}_errors_total", "counter", "error", "proto")
    return out.select("name", "type", F.col("labels")["error"].alias("error"), F.col("labels")["proto"].alias("proto"), "value")


# --- parsers ---------------------------------------------------------------------------------------------------------


@query("""SELECT user_id AS conn, event_id % 1 AS bad, CASE WHEN event_type = 'signup' THEN 'SELECT' ELSE 'GET' END AS route,
    CASE WHEN event_type = 'error' THEN 'WRONGTYPE' END AS err_name, coalesce(last_value(CASE WHEN event_type = 'signup' THEN CAST(event_id % 4 AS VARCHAR) END IGNORE NULLS) OVER
    (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '0') AS db, CAST(floor(value * 1000) AS BIGINT) AS took FROM events""")
def str1_str19_str20_redis_units(spark, sf):
    """Redis commands parsed from their bytes; labels follow SELECT from the next command on."""
    o = observe.observations(observe.parse(wire.redis_events(spark, sf), default="redis"))
    return o.select("conn", F.lit(0).cast("long").alias("bad"), "route", "err_name", "db", (F.col("ts_complete_ns") - F.col("ts_start_ns")).alias("took"))


@query("""SELECT user_id AS conn, '/api/' || event_type || '/' || event_id || '?token=x' AS text, CASE event_type WHEN 'error' THEN 503 WHEN 'click' THEN 404 ELSE 200 END AS err_code,
    event_id % 50 AS bytes_out, 'r' || event_id AS req_id, 'shop' AS db FROM events""")
def str15_str16_str17_http_units(spark, sf):
    o = observe.observations(observe.parse(wire.http_events(spark, sf), default="http"))
    return o.select("conn", "text", "err_code", "bytes_out", "http.req_id", "db")


@query("""SELECT user_id AS conn, 'SELECT * FROM t' || (event_id % 5) || ' WHERE id = ' || event_id AS text, CASE WHEN event_type = 'error' THEN 0 ELSE event_id % 9 END AS rows,
    CASE WHEN event_type = 'error' THEN '40001' END AS sqlstate, 'shop' AS db, 'app' AS "user"
    FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) > 1""")
def str9_str10_str12_postgres_units(spark, sf):
    o = observe.observations(observe.parse(wire.postgres_events(spark, sf), default="pg"))
    return o.select("conn", "text", "rows", "sqlstate", "db", "user")


@query("""WITH r AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events)
    SELECT 'lost_events' AS name, 'redis' AS proto, '' AS reason, count(*) AS n FROM r WHERE k % 10 = 0
    UNION ALL SELECT 'dropped', 'redis', 'resync', count(*) FROM r WHERE k % 10 = 0
    UNION ALL SELECT 'resyncs', 'redis', '', 2 * count(*) FROM r WHERE k % 10 = 0""")
def str2_str27_loss_honesty(spark, sf):
    """Every tenth reply is lost: nothing is reported for its command, and the loss is counted."""
    events = wire.redis_events(spark, sf).where(~((F.col("dir") == recordings.SEND) & (F.col("type") == recordings.DATA) & (F.floor(F.col("seq") / 2) % 10 == 0)))
    # The last command of a connection may go without a follower; an event after it shows the loss.
    last = events.groupBy("conn_id").agg(F.max("seq").alias("m"), F.max("ts_ns").alias("t"))
    tail = last.select(F.col("conn_id"), F.col("t").alias("ts_ns"), (F.floor(F.col("m") / 2) * 2 + 2).alias("seq"))
    tail = tail.withColumns({"type": F.lit(recordings.CLOSE), "dir": F.lit(0), "flags": F.lit(0), "decode_status": F.lit("conn")})
    closed = events.unionByName(tail, allowMissingColumns=True)
    return observe.counts(observe.parse(closed, default="redis"))


@query("SELECT count(*) AS records, count(*) FILTER (WHERE TRUE) AS decoded, CAST(sum(event_id) AS BIGINT) AS sum_conn FROM events")
def src2_src3_record_round_trip(spark, sf):
    """Records written as a recording has them, joined into files and decoded again."""
    import pandas as pd

    e = A.table(spark, sf, "events").select(
        F.col("event_id").alias("conn_id"), F.lit(1000).cast("long").alias("ts_ns"), F.lit(1).cast("long").alias("seq"), F.lit(recordings.DATA).alias("type"), F.lit(recordings.RECV).alias("dir"),
        F.lit(0).alias("flags"), F.lit(None).cast(S.TUPLE).alias("tuple"), F.octet_length("props").cast("long").alias("total_len"), F.lit(0).cast("long").alias("off"), F.col("props").cast("binary").alias("payload"),
    )

    def gather(frames):
        for f in frames:
            yield pd.DataFrame({"path": ["part"], "content": [recordings.join([bytes(r) for r in f["record"]])]})

    files = recordings.record(e).mapInPandas(gather, "path string, content binary")
    rows = recordings.decode_files(files)
    return rows.agg(F.count("*").alias("records"), F.count_if(F.col("decode_status") == "data").alias("decoded"), F.sum("conn_id").alias("sum_conn"))


@query("SELECT user_id % 3 + 50 AS port, event_id % 2 AS dir, count(*) AS packets, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS bytes FROM events GROUP BY ALL")
def src12_udp_volume(spark, sf):
    from wiretally.sources import logs

    e = A.table(spark, sf, "events")
    c = e.select((F.col("user_id") % 3 + 50).alias("port"), (F.col("event_id") % 2).alias("dir"), F.lit(1).cast("long").alias("packets"), F.floor("value").alias("bytes"))
    return logs.udp_volume(c)


def _prometheus_text(e: DataFrame) -> DataFrame:
    from wiretally.sources import logs

    line = F.concat(F.lit('wt_x_total{kind="'), F.col("event_type"), F.lit('",odd="a\\"b\\\\"} '), F.col("event_id").cast("string"))
    out = logs.exposition(e.select(line.alias("value")))
    return out.select("name", F.col("labels")["kind"].alias("kind"), F.col("labels")["odd"].alias("odd"), "value")


@query("SELECT 'wt_x_total' AS name, event_type AS kind, 'a\"b\\' AS odd, CAST(event_id AS DOUBLE) AS value FROM events")
def src9_prometheus_text(spark, sf):
    return _prometheus_text(A.table(spark, sf, "events"))


def _command_stats(e: DataFrame) -> DataFrame:
    from wiretally.sources import logs

    line = F.concat(F.lit("cmdstat_c"), (F.col("event_id") % 9).cast("string"), F.lit(":calls="), F.col("event_id").cast("string"), F.lit(",usec="), F.col("user_id").cast("string"), F.lit(",usec_per_call=0.25"))
    return logs.command_stats(e.select(line.alias("value")).union(e.select(F.lit("# other"))))


@query("SELECT 'c' || (event_id % 9) AS name, event_id AS calls, user_id AS usec, 0.25 AS usec_per_call FROM events")
def src8_command_stats(spark, sf):
    return _command_stats(A.table(spark, sf, "events"))


def _observation_lines(e: DataFrame) -> DataFrame:
    from wiretally.sources import logs

    n = F.col("event_id").cast("string")
    line = F.concat(F.lit("http conn="), n, F.lit(" method=GET status=200 dur="), F.col("user_id").cast("string"), F.lit("ns ttfb=1ns upload=0ns in=0 out=13 obj=0 host=shop user=- flags=0x0 err=- reqid=r route=/x target=/x/"), n)
    out = logs.obs_lines(e.select(line.alias("value")))
    return out.select(F.col("conn").cast("long").alias("conn"), "method", "status", "dur_ns", "host", "target")


@query("SELECT event_id AS conn, 'GET' AS method, 200 AS status, user_id AS dur_ns, 'shop' AS host, '/x/' || event_id AS target FROM events")
def src7_observation_lines(spark, sf):
    return _observation_lines(A.table(spark, sf, "events"))


# --- the observed workload's own statements --------------------------------------------------------------------------


def _olap(name: str) -> None:
    def run(spark, sf):
        return olap.run(spark, sf, name)

    run.__name__ = name
    query(olap.oracle(name))(run)


for _name in olap.STATEMENTS:
    _olap(_name)


# --- more parsers ----------------------------------------------------------------------------------------------------


@query("""SELECT user_id AS conn, 'UPDATE t' || (event_id % 5) || ' SET a = ' || event_id AS text, CASE WHEN event_type = 'error' THEN 0 ELSE event_id % 200 END AS rows,
    CASE WHEN event_type = 'error' THEN '42000' END AS sqlstate, CASE WHEN event_type = 'error' THEN 1064 END AS err_code, (event_type = 'error')::INT AS flags FROM events""")
def str14_mysql_units(spark, sf):
    """MySQL statements of connections that are taken up in the middle."""
    o = observe.observations(observe.parse(wire.mysql_events(spark, sf), default="mysql"))
    return o.select("conn", "text", "rows", "sqlstate", "err_code", "flags")


@query("""SELECT user_id AS conn, CASE event_type WHEN 'purchase' THEN 'PutObject' WHEN 'signup' THEN 'DeleteObject' ELSE 'GetObject' END AS op, 'bucket' || (event_id % 3) AS db,
    'AK' || (user_id % 5) AS "user", CASE WHEN event_type = 'error' THEN 'NoSuchKey' END AS err_name,
    CASE event_type WHEN 'error' THEN 37 WHEN 'signup' THEN 0 ELSE event_id % 40 END AS size FROM events""")
def str18_s3_units(spark, sf):
    o = observe.observations(observe.parse(wire.s3_events(spark, sf), default="s3"))
    return o.select("conn", F.col("route").alias("op"), "db", "user", "err_name", F.col("obj_bytes").alias("size"))


def _tumbling_counts(spark: SparkSession, sf: str) -> DataFrame:
    o = A.observations(spark, sf).withColumn("at", F.timestamp_micros(F.floor(F.col("ts_complete_ns") / 1000)))
    g = o.groupBy("proto", F.window("at", "1 hour").alias("win")).agg(F.count("*").alias("n"))
    return g.select("proto", F.col("win.start").cast("timestamp_ntz").alias("w"), "n")


@query(f"""{OBS}, c AS (SELECT proto, date_trunc('hour', make_timestamp(ts_complete_ns // 1000)) AS w, count(*) AS n FROM obs GROUP BY ALL)
    SELECT *, row_number() OVER (ORDER BY n DESC, w, proto) AS place FROM c""")
def win1_tumbling_counts(spark, sf):
    return order.with_place(_tumbling_counts(spark, sf), F.desc("n"), F.col("w"), F.col("proto"))


from wiretally import file_queries, panel_queries, wire_queries  # noqa: E402, F401  they register their queries here
