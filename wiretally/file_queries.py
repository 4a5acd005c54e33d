"""Registered queries of sinks and files: what is written is read back, decoded and compared."""

from __future__ import annotations

from uuid import uuid4

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wiretally import schema as S
from wiretally.functions import redis, sql_text
from wiretally.operators import expose, families, hist
from wiretally.plans import adapters as A
from wiretally.plans import spans, wire
from wiretally.queries import _SIMPLE, OBS, RED, bucket_sql, query, red
from wiretally.session import shared_folder
from wiretally.sources import live, logs, recordings

NOW, START = 2_000_000_000, 1_000_000_000


def decoded(messages: DataFrame, read, schema: str) -> DataFrame:
    """Rows (dicts) that `read` finds in each message."""

    def run(frames):
        names = [c.split()[0] for c in schema.split(",")]
        for f in frames:
            yield pd.DataFrame([r for m in f["message"] for r in read(bytes(m))], columns=names, dtype=object)

    return messages.select("message").mapInPandas(run, schema)


def scratch(spark) -> str:
    return f"{shared_folder(spark)}/files-{uuid4().hex}"


# --- sinks -----------------------------------------------------------------------------------------------------------


def sum_points(message: bytes) -> list[dict]:
    m = expose.read(message)
    body = expose.read(m[7][0])
    out = []
    for p in map(expose.read, body[1]):
        out.append(expose.attributes(p[7]) | {"name": m[1][0].decode(), "cumulative": body[2][0] == 2 and body[3][0] == 1, "span": p[3][0] - p[2][0], "value": expose.real(p[4][0])})
    return out


@query(f"""{OBS} SELECT '{S.PREFIX}_errors_total' AS name, error, db, "user", proto, TRUE AS cumulative, {NOW - START} AS span, CAST(count(*) AS DOUBLE) AS value FROM red WHERE error IS NOT NULL GROUP BY error, db, "user", proto""")
def snk3_snk9_otlp_metrics(spark, sf):
    """Sums as protobuf messages, decoded again."""
    rows = expose.long_format(families.errors_total(red(spark, sf)), f"{S.PREFIX}_errors_total", "counter", "error", "db", "user", "proto")
    return decoded(expose.encode_counters(rows, NOW, START), sum_points, "name string, error string, db string, user string, proto string, cumulative boolean, span long, value double")


def bucket_points(message: bytes) -> list[dict]:
    m = expose.read(message)
    out = []
    for p in map(expose.read, expose.read(m[10][0])[1]):
        tags = expose.attributes(p[1])
        positive = expose.read(p[8][0])
        unfold = lambda x: (x >> 1) ^ -(x & 1)
        first, counts, at = unfold(positive[1][0]), [], 0
        packed = positive[2][0]
        while at < len(packed):
            x = shift = 0
            while True:
                byte = packed[at]
                at += 1
                x |= (byte & 0x7F) << shift
                shift += 7
                if byte < 0x80:
                    break
            counts.append(x)
        rows = [(first + i, c) for i, c in enumerate(counts) if c] + ([(-999, p[7][0])] if p.get(7, [0])[0] else [])
        out += [tags | {"scale": unfold(p[6][0]), "bucket": b, "n": c, "total": p[4][0]} for b, c in rows]
    return out


@query(f"""{RED}, c AS (SELECT db, proto, {bucket_sql('dur_s')} AS bucket FROM slots WHERE dur_s IS NOT NULL),
    b AS (SELECT db, proto, CASE WHEN bucket = {hist.UNDER} THEN -999 ELSE least(bucket, {hist.HIGH - 1}) END AS bucket, count(*) AS n FROM c GROUP BY ALL)
    SELECT db, proto, 2 AS scale, bucket, n, CAST(sum(n) OVER (PARTITION BY db, proto) AS BIGINT) AS total FROM b""")
def snk3_otlp_histograms(spark, sf):
    """Exponential histograms, decoded again: buckets by number, -999 the count of zeros."""
    cells = hist.latency_cells(red(spark, sf), "dur_s", "db", "proto")
    messages = expose.encode_latency(cells, f"{S.PREFIX}_duration_seconds", NOW, START, "db", "proto")
    return decoded(messages, bucket_points, "db string, proto string, scale int, bucket int, n long, total long")


SPANS = f"""{RED}, s AS (SELECT *, sha256('0/' || conn || '/' || ts_start_ns) AS h, CASE WHEN text IS NOT NULL AND proto IN ('pg', 'mysql') THEN 'select * from t' || (k % 10) || ' where id = ?' END AS label FROM slots WHERE ts_complete_ns > ts_start_ns)
    SELECT h[1:32] AS trace_id, h[33:48] AS span_id, CASE WHEN proto IN ('pg', 'mysql') THEN coalesce(label, '') WHEN proto = 'redis' THEN route ELSE op || ' ' || route END AS name,
        CASE WHEN proto = 'http' THEN 'server' ELSE 'client' END AS kind, ts_start_ns AS start_ns, ts_complete_ns AS end_ns, flags & 1 <> 0 AS error"""


def built(spark, sf) -> DataFrame:
    o = red(spark, sf).withColumns({"trace_flags": F.lit(None).cast("int"), "trace_id": F.lit(None).cast("string"), "parent_id": F.lit(None).cast("string")})
    return spans.build_spans(o.where(spans.should_sample(1.0)))


@query(SPANS + " FROM s")
def smp2_smp3_spans(spark, sf):
    return built(spark, sf).select("trace_id", "span_id", F.coalesce("name", F.lit("")).alias("name"), "kind", "start_ns", "end_ns", "error")


def span_rows(message: bytes) -> list[dict]:
    m = expose.read(message)
    kind = {2: "server", 3: "client"}[m[6][0]]
    return [{"trace_id": m[1][0].hex(), "span_id": m[2][0].hex(), "name": m[5][0].decode(), "kind": kind, "start_ns": m[7][0], "end_ns": m[8][0], "error": 15 in m}]


@query(SPANS + " FROM s")
def snk4_otlp_spans(spark, sf):
    """Spans as protobuf messages, decoded again."""
    return decoded(expose.encode_spans(built(spark, sf)), span_rows, "trace_id string, span_id string, name string, kind string, start_ns long, end_ns long, error boolean")


@query("""WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events), x AS (SELECT *, 'key:' || event_id AS key FROM e)
    SELECT user_id AS conn_id, 2 * k AS seq, 'data' AS decode_status, 1 AS dir, CASE WHEN event_type = 'signup' THEN '*2' || chr(13) || chr(10) || '$6' || chr(13) || chr(10) || 'SELECT' || chr(13) || chr(10) || '$1' || chr(13) || chr(10) || (event_id % 4) || chr(13) || chr(10)
        ELSE '*2' || chr(13) || chr(10) || '$3' || chr(13) || chr(10) || 'get' || chr(13) || chr(10) || '$' || length(key) || chr(13) || chr(10) || key || chr(13) || chr(10) END AS payload FROM x
    UNION ALL SELECT user_id, 2 * k + 1, 'data', 0, CASE event_type WHEN 'signup' THEN '+OK' WHEN 'error' THEN '-WRONGTYPE no' WHEN 'click' THEN '$-1' ELSE '$5' || chr(13) || chr(10) || 'value' END || chr(13) || chr(10) FROM x
    UNION ALL SELECT DISTINCT user_id, 1, 'conn', 0, NULL FROM x""")
def src2_src3_snk7_recordings(spark, sf):
    """Events recorded, written as files in the recording format, read by the file source and decoded: every byte of every record."""
    path = scratch(spark)

    def files(frames):
        for f in frames:
            yield pd.DataFrame({"content": [recordings.join([bytes(r) for r in f["record"]])]})

    # The content of a file as one row, which Spark's reader of recordings takes as it takes a file.
    made = recordings.record(wire.redis_events(spark, sf)).select("record").mapInPandas(files, "content binary")
    made.write.parquet(path)
    held = spark.read.parquet(path).select(F.xxhash64("content").cast("string").alias("path"), "content")
    rows = recordings.decode_files(held)
    return rows.select("conn_id", "seq", "decode_status", "dir", F.when(F.col("decode_status") == "data", F.col("payload").cast("string")).alias("payload"))


@query(f"""{OBS} SELECT proto || ' conn=' || conn || ' method=' || coalesce(op, '-') || ' status=' || coalesce(err_code, 0) || ' dur=' || (ts_complete_ns - ts_start_ns) || 'ns in=' || bytes_in || ' out=' || bytes_out
    || ' db=' || db || ' user=' || "user" || ' flags=0x' || lower(to_hex(flags)) || ' route=' || coalesce(route, '-') AS line FROM obs""")
def snk8_debug_lines(spark, sf):
    return expose.debug_lines(A.observations(spark, sf))


# --- names -----------------------------------------------------------------------------------------------------------


@query(f"WITH {A.STATEMENTS_SQL} SELECT {_SIMPLE} AS label, count(*) AS n, 1 AS fingerprints FROM statements GROUP BY 1")
def fn2_fingerprints(spark, sf):
    """A label has one fingerprint, and no two labels have the same: unequal ones would show as a second row."""
    out = A.statements(spark, sf).select(sql_text.norm_sql(F.col("text")).alias("s")).select("s.fp", "s.label")
    per = out.groupBy("fp").agg(F.min("label").alias("label"), F.max("label").alias("other"), F.count("*").alias("n"))
    return per.groupBy("label").agg(F.sum("n").alias("n"), F.count(F.when(F.col("label") == F.col("other"), 1)).cast("int").alias("fingerprints"))


@query("""SELECT event_id, event_id % 8 IN (1, 2) AS blocking, CASE event_id % 8 WHEN 4 THEN 'select' WHEN 5 THEN 'auth' ELSE '' END AS kind,
    CASE WHEN event_id % 8 = 4 THEN CASE WHEN user_id <= 1024 THEN CAST(user_id AS VARCHAR) ELSE '?' END END AS db, CASE WHEN event_id % 8 = 5 THEN 'u' || user_id END AS usr,
    CASE event_id % 8 WHEN 5 THEN '2' WHEN 6 THEN '3' WHEN 7 THEN '8' ELSE '' END AS hidden FROM events""")
def fn13_fn14_fn16_redis_arguments(spark, sf):
    """What a command may wait for, does to its session, and which of its arguments must not be shown."""
    e, u = F.col("event_id") % 8, F.col("user_id").cast("string")
    text = (
        F.when(e == 0, "GET k").when(e == 1, "blpop a 0").when(e == 2, "XREAD BLOCK 5 STREAMS a 0").when(e == 3, "xread STREAMS block 0").when(e == 4, F.concat(F.lit("select "), u))
        .when(e == 5, F.concat(F.lit("auth u"), u, F.lit(" pw"))).when(e == 6, F.concat(F.lit("config set requirepass p"), u)).otherwise("migrate h 1 k 0 5 AUTH2 u pw")
    )
    argv = F.split(text, " ")
    s = redis.session_change(argv)
    return A.table(spark, sf, "events").select(
        "event_id", redis.may_block(argv).alias("blocking"), s["kind"].alias("kind"), s["db"].alias("db"), s["user"].alias("usr"),
        F.array_join(F.transform(redis.secret_places(argv), lambda i: i.cast("string")), ",").alias("hidden"),
    )


# --- files -----------------------------------------------------------------------------------------------------------


@query("""SELECT 'u' || user_id AS "user", CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'LOG' END AS severity, CASE WHEN event_type <> 'error' THEN event_id / 1000.0 END AS dur_s, CASE WHEN event_type <> 'error' THEN 'execute' END AS phase
    FROM events WHERE event_type <> 'view'""")
def src4_csvlog(spark, sf):
    """A server log with quotes, commas and line breaks in its messages, written and read; local connections are left out."""
    kind = F.col("event_type")
    message = F.when(kind == "error", 'relation "x, y" is\nmissing').otherwise(F.concat(F.lit("duration: "), F.col("event_id").cast("string"), F.lit('.000 ms  execute <unnamed>: select "a",\n1')))
    conn = F.when(kind == "view", "[local]").otherwise("10.0.0.1:5")
    held = {1: F.concat(F.lit("u"), F.col("user_id").cast("string")), 2: F.lit("db"), 4: conn, 5: F.lit("s"), 11: F.when(kind == "error", "ERROR").otherwise("LOG"), 12: F.lit("00000"), 13: message}
    rows = A.table(spark, sf, "events").select(*(held.get(i, F.lit("")).alias(f"c{i}") for i in range(logs.CSVLOG_COLUMNS)))
    path = scratch(spark)
    rows.write.csv(path, quote='"', escape='"', quoteAll=True)
    return logs.csvlog(spark, path).select("user", "severity", "dur_s", "phase")


@query("""SELECT 'r' || event_id AS id, 200 + event_id % 300 AS status, value AS rt, CASE WHEN event_id % 3 <> 0 THEN value END AS urt, event_id AS bs FROM events""")
def src5_access_log(spark, sf):
    """JSON lines of a proxy, written and read, with broken lines between them."""
    e = F.col("event_id")
    value = F.col("value").cast("string")
    line = F.to_json(F.struct(F.concat(F.lit("r"), e.cast("string")).alias("id"), (200 + e % 300).cast("string").alias("status"), F.lit("GET").alias("method"), F.lit("/").alias("uri"), value.alias("rt"), F.when(e % 3 == 0, "-").otherwise(value).alias("urt"), e.cast("string").alias("bs")))
    path = scratch(spark)
    rows = A.table(spark, sf, "events")
    rows.select(line.alias("value")).union(rows.select(F.lit("{broken").alias("value"))).write.text(path)
    return logs.access_log(spark, path).where("id IS NOT NULL").select("id", "status", "rt", "urt", "bs")


@query("""SELECT 's3.' || event_type AS api, event_id AS duration, user_id AS tx FROM events""")
def src6_object_trace(spark, sf):
    """Objects that follow each other without line breaks, and rubbish between them, written and read."""
    one = F.to_json(F.struct(F.lit("s3").alias("type"), F.concat(F.lit("s3."), F.col("event_type")).alias("api"), F.lit("/b/{k}").alias("path"), F.struct(F.col("event_id").alias("duration"), F.col("user_id").alias("tx")).alias("callStats")))
    path = scratch(spark)
    A.table(spark, sf, "events").select(F.concat(one, F.lit("{rubbish}")).alias("value")).write.option("lineSep", " ").text(path)
    return logs.object_trace(spark, path).select("api", "callStats.duration", "callStats.tx")


@query("""SELECT event_type AS workload, user_id AS pair, value AS tps, event_id AS queries FROM events""")
def src10_bench_table(spark, sf):
    """Tab-separated results with a header, written and read."""
    held = {"workload": F.col("event_type"), "config": F.lit("C"), "pair": F.col("user_id"), "role": F.lit("on"), "valid": F.lit(1), "dropped": F.lit(0), "resync": F.lit(0), "queries": F.col("event_id"), "reason": F.lit("")}
    names = [c.split()[0] for c in logs.BENCH_DDL.split(",")]
    path = scratch(spark)
    A.table(spark, sf, "events").select(*(held.get(n, F.col("value")).alias(n) for n in names)).write.csv(path, sep="\t", header=True)
    return logs.bench_table(spark, path).select("workload", "pair", "tps", "queries")


@query("""SELECT CASE event_id % 3 WHEN 0 THEN 'Sets' WHEN 1 THEN 'Gets' ELSE 'Totals' END AS kind, CAST(event_id AS DOUBLE) AS ops, CAST(user_id AS DOUBLE) AS p99_ms FROM events""")
def src8_memtier_totals(spark, sf):
    e = F.col("event_id")
    kind = F.when(e % 3 == 0, "Sets").when(e % 3 == 1, "Gets").otherwise("Totals")
    line = F.concat(kind, F.lit("   "), e.cast("string"), F.lit(".00  ---  ---  1.5  1.25  "), F.col("user_id").cast("string"), F.lit(".0"))
    rows = A.table(spark, sf, "events").select(line.alias("value"))
    return logs.memtier(rows.union(rows.select(F.lit("----")))).select("kind", "ops", "p99_ms")


@query("SELECT 3 AS stats, TRUE AS positive")
def src13_self_stats(spark, sf):
    """CPU seconds, resident bytes and start of the driver's process: three numbers above zero."""
    rows = logs.self_stats(spark)
    return rows.agg(F.count("*").alias("stats"), F.min(F.col("value") > 0).alias("positive"))


@query("SELECT count(*) AS events, count(*) // 2 AS commands FROM events")
def src1_generated_stream(spark, sf):
    """As many generated raw events as there are events, through a stream into files, parsed."""
    n = A.table(spark, sf, "events").count()
    path = scratch(spark)
    stream = live.generated(spark, rows=n, rowsPerBatch=max(1, n // 2), conns=10)
    q = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/ck").start()
    try:
        q.processAllAvailable()
        q.processAllAvailable()
        q.processAllAvailable()
    finally:
        q.stop()
    held = spark.read.schema(S.RAW_EVENT).parquet(f"{path}/out")
    from wiretally.streaming import observe

    seen = observe.observations(observe.parse(held, default="redis")).where("route = 'PING'").agg(F.count("*").alias("commands"))
    return held.agg(F.count("*").alias("events")).crossJoin(seen)
