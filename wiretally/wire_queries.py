"""Registered queries from raw bytes: protocols beyond their simplest exchange, loss, and bytes to metrics end to end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wiretally import schema as S
from wiretally.operators import cardinality, expose, families, hist, identity, reduce
from wiretally.plans import wire
from wiretally.queries import bucket_sql, query
from wiretally.sources.recordings import DATA, DECRYPTED, RECV, SEND
from wiretally.streaming import observe

#: Events of a connection numbered from 1, as wire.conversation numbers them.
NUMBERED = "WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events)"


def columns() -> tuple[Column, ...]:
    """Of an event: its number, its number in its connection, whether it is the first there, the connection and the type."""
    k = F.col("_k")
    return F.col("event_id"), k, k == 1, F.col("user_id"), F.col("event_type")


def units(spark, sf, proto: str, *steps) -> DataFrame:
    return observe.observations(observe.parse(wire.conversation(spark, sf, list(steps)), default=proto))


def text_of(*parts) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


# --- HTTP ------------------------------------------------------------------------------------------------------------


def chunked(body):
    return F.concat(F.lower(F.hex(F.length(body))), F.lit("\r\n"), body, F.lit("\r\n"))


@query("SELECT user_id AS conn, event_id % 9 + 1 AS bytes_in, 3 + event_id % 30 + 1 AS bytes_out, 200 AS err_code FROM events")
def str15_chunked_bodies(spark, sf):
    """Requests in one chunk, responses in two with a trailer; each response in two calls."""
    e, _, _, _, _ = columns()
    sent, second = F.repeat(F.lit("q"), (e % 9 + 1).cast("int")), F.repeat(F.lit("r"), (e % 30 + 1).cast("int"))
    request = F.concat(F.lit("POST /c HTTP/1.1\r\nTransfer-Encoding: chunked\r\n\r\n"), chunked(sent), F.lit("0\r\n\r\n"))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n"), chunked(F.lit("abc")))
    rest = F.concat(chunked(second), F.lit("0\r\nX-Sum: 1\r\n\r\n"))
    return units(spark, sf, "http", (RECV, request), (SEND, head), (SEND, rest)).select("conn", "bytes_in", "bytes_out", "err_code")


@query(f"""{NUMBERED} SELECT user_id AS conn, '/b/' || event_id AS text FROM e
    UNION ALL SELECT user_id, '/a/' || event_id FROM e WHERE k % 5 <> 0""")
def str28_one_response_lost(spark, sf):
    """Of two pipelined requests the first one's response has a hole in each fifth call: only that one is lost."""
    e, k, _, _, _ = columns()
    request = text_of("GET /a/", e, " HTTP/1.1\r\n\r\nGET /b/", e, " HTTP/1.1\r\n\r\n")
    whole, cut = "HTTP/1.1 200 OK\r\nContent-Length: 2\r\n\r\nok", "HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n5\r\nab"
    first = F.when(k % 5 == 0, cut).otherwise(whole)
    total = F.when(k % 5 == 0, len(cut) + 40).otherwise(len(whole))
    return units(spark, sf, "http", (RECV, request), (SEND, first, 0, total), (SEND, F.lit("HTTP/1.1 204 X\r\n\r\n"))).select("conn", "text")


# --- PostgreSQL ------------------------------------------------------------------------------------------------------


@query(f"""{NUMBERED} SELECT user_id AS conn, 'SELECT ' || event_id AS text, event_id % 9 AS rows FROM e WHERE k > 1""")
def str7_split_messages(spark, sf):
    """Requests that arrive in three calls, cut inside the header and inside the text."""
    e, _, first, _, _ = columns()
    ask = wire.pg_message("Q", text_of("SELECT ", e, "\0"))
    part = lambda a, b: F.when(first, F.lit(None).cast("string") if a > 1 else wire.pg_startup()).otherwise(F.substring(ask, a, b))
    reply = F.when(first, wire.pg_welcome()).otherwise(F.concat(wire.pg_message("C", text_of("SELECT ", e % 9, "\0")), F.lit("Z\0\0\0\x05I")))
    # A step that didn't happen is no loss: the first row has one step for the three.
    steps = [(RECV, part(1, 3)), (RECV, part(4, 5)), (RECV, part(9, 200)), (SEND, reply)]
    events = wire.conversation(spark, sf, steps)
    w = F.row_number().over(Window.partitionBy("conn_id").orderBy("seq"))
    return observe.observations(observe.parse(events.withColumn("seq", w.cast("long")), default="pg")).select("conn", "text", "rows")


@query(f"""{NUMBERED} SELECT user_id AS conn, 'extended' AS kind, 'SELECT $1, ' || user_id AS text, CASE WHEN event_type = 'error' THEN 0 ELSE event_id % 7 END AS rows, CASE WHEN event_type = 'error' THEN '22012' END AS sqlstate,
    CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS flags FROM e WHERE k > 1""")
def str11_str12_prepared_statements(spark, sf):
    """One statement of a connection is parsed once and bound by name in every later exchange."""
    e, k, first, u, kind = columns()
    named = wire.pg_message("P", text_of("s", u, "\0SELECT $1, ", u, "\0\0\0"))
    bound = F.concat(wire.pg_message("B", text_of("\0s", u, "\0")), F.lit("E\0\0\0\x09\0\0\0\0\0S\0\0\0\x04"))
    ask = F.when(first, wire.pg_startup()).when(k == 2, F.concat(named, bound)).otherwise(bound)
    done = F.when(kind == "error", wire.pg_message("E", F.lit("C22012\0\0"))).otherwise(wire.pg_message("C", text_of("SELECT ", e % 7, "\0")))
    done = F.concat(F.when(k == 2, "1\0\0\0\x04").otherwise(""), F.lit("2\0\0\0\x04"), done, F.lit("Z\0\0\0\x05I"))
    out = units(spark, sf, "pg", (RECV, ask), (SEND, F.when(first, wire.pg_welcome()).otherwise(done)))
    return out.select("conn", "kind", "text", "rows", "sqlstate", "flags")


@query(f"""{NUMBERED} SELECT user_id AS conn, CASE WHEN event_id % 2 = 0 THEN 'copy_in' ELSE 'copy_out' END AS kind, event_id % 40 AS bytes, event_id % 5 AS rows FROM e WHERE k > 1""")
def str13_copies(spark, sf):
    """COPY in either direction: the bytes of its data and the rows of its tag."""
    e, _, first, _, _ = columns()
    into = e % 2 == 0
    data = F.concat(wire.pg_message("d", F.repeat(F.lit("x"), (e % 40).cast("int"))), F.lit("c\0\0\0\x04"))
    done = F.concat(wire.pg_message("C", text_of("COPY ", e % 5, "\0")), F.lit("Z\0\0\0\x05I"))
    ask = F.when(first, wire.pg_startup()).otherwise(wire.pg_message("Q", F.when(into, "COPY t FROM STDIN\0").otherwise("COPY t TO STDOUT\0")))
    answer = F.when(first, wire.pg_welcome()).when(into, "G\0\0\0\x07\0\0\0").otherwise(F.concat(F.lit("H\0\0\0\x07\0\0\0"), data, done))
    nothing = F.lit("").cast("string")
    more = (RECV, F.when(~first & into, data).otherwise(nothing)), (SEND, F.when(~first & into, done).otherwise(nothing))
    return units(spark, sf, "pg", (RECV, ask), (SEND, answer), *more).select("conn", "kind", "bytes", "rows")


@query(f"""{NUMBERED} SELECT user_id AS conn, 'SELECT ' || event_id AS text FROM e WHERE k > 1 AND k % 7 > 1""")
def str8_resync_after_lost_replies(spark, sf):
    """Each seventh reply is lost: its statement yields nothing, the next reply is where the server's side is found again."""
    e, k, first, _, _ = columns()
    ask = F.when(first, wire.pg_startup()).otherwise(wire.pg_message("Q", text_of("SELECT ", e, "\0")))
    reply = F.when(first, wire.pg_welcome()).when(k % 7 != 0, F.concat(wire.pg_message("C", F.lit("SELECT 1\0")), F.lit("Z\0\0\0\x05I")))
    return units(spark, sf, "pg", (RECV, ask), (SEND, reply)).select("conn", "text")


@query(f"""{NUMBERED} SELECT user_id AS conn, 'SELECT ' || event_id AS text FROM e WHERE k > 1""")
def str29_tls_adopted(spark, sf):
    """Each connection asks for TLS first; ciphertext is dropped, and the decrypted bytes, numbered apart, take over."""
    e, _, first, _, _ = columns()
    ask = F.when(first, wire.pg_startup()).otherwise(wire.pg_message("Q", text_of("SELECT ", e, "\0")))
    reply = F.when(first, wire.pg_welcome()).otherwise(F.concat(wire.pg_message("C", F.lit("SELECT 1\0")), F.lit("Z\0\0\0\x05I")))
    events = wire.conversation(spark, sf, [(RECV, ask, DECRYPTED), (SEND, reply, DECRYPTED)])
    cipher = events.where((F.col("type") == DATA)).withColumns(
        {"flags": F.lit(0), "payload": F.when((F.col("dir") == RECV) & (F.col("seq") == 2), F.unhex(F.lit("0000000804D2162F"))).when(F.col("seq") == 3, F.lit("S").cast("binary")).otherwise(F.concat(F.unhex(F.lit("170303")), F.col("payload")))}
    )
    size = F.octet_length("payload").cast("long")
    # The request for TLS and its answer come before all else; other ciphertext a moment before its plain bytes.
    early = F.when(F.col("seq") <= 3, F.col("seq")).otherwise(F.col("seq"))
    cipher = cipher.withColumns({"total_len": size, "cap_len": size, "seq": early})
    plain = events.withColumn("seq", F.when(F.col("type") == DATA, F.col("seq") + 2).otherwise(F.col("seq")))
    return observe.observations(observe.parse(plain.unionByName(cipher), default="pg")).select("conn", "text")


# --- MySQL -----------------------------------------------------------------------------------------------------------


@query("""SELECT user_id AS conn, 'SELECT a FROM t' || (event_id % 5) AS text, CASE WHEN event_type = 'error' THEN 0 ELSE event_id % 4 END AS rows FROM events""")
def str14_mysql_result_sets(spark, sf):
    """Result sets of one column with up to three rows, closed by an EOF-like OK; connections taken up in the middle."""
    e, _, _, _, kind = columns()
    request = wire.packet(0, wire.raw(b"\x03", text_of("SELECT a FROM t", e % 5)))
    n = e % 4
    head = wire.raw(b"\x01\0\0\x01\x01", b"\x04\0\0\x02\x03def")
    rows = [F.when(n > i, F.lit(bytearray(b"\x02\0\0" + bytes([3 + i]) + b"\x01v"))).otherwise(F.lit(bytearray())) for i in range(3)]
    tail = wire.raw(b"\x07\0\0", wire.byte(3 + n), b"\xfe\0\0\x02\0\0\0")
    failed = wire.packet(1, wire.raw(b"\xff\x28\x04#42000", F.lit("bad")))
    whole = F.concat(head, *rows, tail)
    events = wire.conversation(spark, sf, [(RECV, request), (SEND, F.when(kind == "error", failed).otherwise(whole))]).where(f"type = {DATA}")
    return observe.observations(observe.parse(events, default="mysql")).select("conn", "text", "rows")


# --- Redis -----------------------------------------------------------------------------------------------------------


@query("""SELECT user_id AS conn, event_type = 'error' AS aborted, CAST(floor(value * 1000) AS BIGINT) AS took FROM events""")
def str26_redis_transactions(spark, sf):
    """MULTI, two commands and EXEC; a null reply to EXEC is an aborted transaction."""
    e, _, _, _, kind = columns()
    request = F.concat(wire.words("MULTI"), wire.words("SET", text_of("k", e), "v"), wire.words("INCR", "n"), wire.words("EXEC"))
    end = F.when(kind == "error", "*-1\r\n").otherwise("*2\r\n+OK\r\n:1\r\n")
    result = observe.parse(wire.conversation(spark, sf, [(RECV, request), (SEND, F.concat(F.lit("+OK\r\n+QUEUED\r\n+QUEUED\r\n"), end))]), default="redis")
    t = observe.transactions(result)
    return t.select("conn", "aborted", (F.col("end_ns") - F.col("start_ns")).alias("took"))


@query("""SELECT 'observed' AS name, count(*) AS n FROM events UNION ALL SELECT 'pushes', 2 * count(*) FILTER (WHERE event_type = 'click') FROM events""")
def str21_pushes_answer_nothing(spark, sf):
    """Invalidations come before the replies of some commands; every command keeps its own reply."""
    e, _, _, _, kind = columns()
    reply = F.concat(F.when(kind == "click", ">2\r\n+invalidate\r\n*1\r\n$1\r\nk\r\n" * 2).otherwise(""), text_of(":", e, "\r\n"))
    result = observe.parse(wire.conversation(spark, sf, [(RECV, wire.words("GET", text_of("k", e))), (SEND, reply)]), default="redis")
    seen = observe.observations(result).where((F.col("route") == "GET") & F.col("err_name").isNull()).agg(F.lit("observed").alias("name"), F.count("*").alias("n"))
    pushes = observe.counts(result).where("name = 'pushes'").select("name", "n")
    return seen.select("name", "n").unionByName(pushes)


@query(f"""{NUMBERED} SELECT user_id AS conn, CAST(floor(value * 1000) AS BIGINT) AS took, CASE WHEN event_type = 'error' THEN 'ERR' END AS err_name FROM e WHERE k % 6 <> 0 AND k % 10 <> 3""")
def str20_lost_commands(spark, sf):
    """Each sixth command is lost and its reply comes all the same, some replies are lost: what is reported is paired rightly."""
    e, k, _, _, kind = columns()
    ask = F.when(k % 6 != 0, wire.words("GET", text_of("k", e)))
    reply = F.when(k % 10 != 3, F.when(kind == "error", "-ERR no\r\n").otherwise("+OK\r\n"))
    out = units(spark, sf, "redis", (RECV, ask), (SEND, reply))
    return out.select("conn", (F.col("ts_complete_ns") - F.col("ts_start_ns")).alias("took"), "err_name")


# --- bytes to metrics ------------------------------------------------------------------------------------------------


def lines(events: DataFrame, proto: str) -> DataFrame:
    """The exposition of raw events: requests or statements, errors, rows or bytes, and latency counts."""
    r = identity.identified(observe.observations(observe.parse(events, default=proto)))
    m = S.PREFIX
    errors = expose.counter_lines(families.errors_total(r), f"{m}_errors_total", "Errors.", "error", "db", "user")
    per = families.latency(r, "dur_s", "slot").groupBy("slot").agg(F.sum("n").alias("value"))
    counts = expose.counter_lines(per, f"{m}_duration_seconds_count", "Timed.", "slot")
    if proto in ("pg", "mysql"):
        main = expose.counter_lines(families.queries_total(r), f"{m}_queries_total", "Statements.", "db", "user", "kind", "code")
        volume = expose.counter_lines(families.rows_total(r), f"{m}_rows_total", "Rows.", "slot")
    else:
        main = expose.counter_lines(families.requests_total(r), f"{m}_requests_total", "Requests.", "slot", "db", "user", "code")
        volume = expose.counter_lines(families.bytes_total(r), f"{m}_bytes_total", "Bytes.", "slot", "db", "direction")
    return main.unionByName(errors).unionByName(counts).unionByName(volume).where("ord <> ''").select("line")


def lines_sql(obs: str, db: bool) -> str:
    """The same lines of rows with slot, db, usr, code, error, kind, timed and the volumes."""
    m = S.PREFIX
    label = lambda *keys: " || ',' || ".join(f"'{k}=\"' || {c} || '\"'" for k, c in keys)
    line = lambda name, value, *keys: f"'{m}_{name}{{' || {label(*keys)} || '}} ' || {value} AS line"
    out = f"{obs}"
    if db:
        out += f" SELECT {line('queries_total', 'count(*)', ('db', 'db'), ('user', 'usr'), ('kind', 'kind'), ('code', 'code'))} FROM o GROUP BY db, usr, kind, code"
        out += f" UNION ALL SELECT {line('rows_total', 'CAST(sum(rows) AS BIGINT)', ('slot', 'slot'))} FROM o GROUP BY slot, db, usr"
    else:
        out += f" SELECT {line('requests_total', 'count(*)', ('slot', 'slot'), ('db', 'db'), ('user', 'usr'), ('code', 'code'))} FROM o GROUP BY slot, db, usr, code"
        for way, c in (("in", "bytes_in"), ("out", "bytes_out")):
            volume = line("bytes_total", f"CAST(sum({c}) AS BIGINT)", ("slot", "slot"), ("db", "db"), ("direction", f"'{way}'"))
            out += f" UNION ALL SELECT {volume} FROM o GROUP BY slot, db, usr"
    out += f" UNION ALL SELECT {line('errors_total', 'count(*)', ('error', 'error'), ('db', 'db'), ('user', 'usr'))} FROM o WHERE error IS NOT NULL GROUP BY error, db, usr"
    return out + f" UNION ALL SELECT {line('duration_seconds_count', 'count(*)', ('slot', 'slot'))} FROM o WHERE timed GROUP BY slot"


@query(lines_sql("""WITH o AS (SELECT CASE WHEN event_type = 'signup' THEN 'SELECT' ELSE 'GET' END AS slot, 'default' AS usr, CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS code,
    coalesce(last_value(CASE WHEN event_type = 'signup' THEN CAST(event_id % 4 AS VARCHAR) END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '0') AS db,
    CASE WHEN event_type = 'error' THEN 'WRONGTYPE' END AS error, TRUE AS timed,
    CASE WHEN event_type = 'signup' THEN 23 ELSE 18 + length('key:' || event_id) + length(CAST(length('key:' || event_id) AS VARCHAR)) END AS bytes_in,
    CASE event_type WHEN 'signup' THEN 5 WHEN 'error' THEN 15 WHEN 'click' THEN 5 ELSE 11 END AS bytes_out FROM events)""", False))
def e2e_redis_metrics(spark, sf):
    return lines(wire.redis_events(spark, sf), "redis")


@query(lines_sql("""WITH o AS (SELECT '/api/' || event_type || '/{id}' AS slot, 'shop' AS db, '-' AS usr, CASE event_type WHEN 'error' THEN '5xx' WHEN 'click' THEN '4xx' ELSE '2xx' END AS code,
    CASE event_type WHEN 'error' THEN '503' WHEN 'click' THEN '404' END AS error, TRUE AS timed, 0 AS bytes_in, event_id % 50 AS bytes_out FROM events)""", False))
def e2e_http_metrics(spark, sf):
    return lines(wire.http_events(spark, sf), "http")


@query(lines_sql("""WITH o AS (SELECT CASE event_type WHEN 'purchase' THEN 'PutObject' WHEN 'signup' THEN 'DeleteObject' ELSE 'GetObject' END AS slot, 'bucket' || (event_id % 3) AS db, 'AK' || (user_id % 5) AS usr,
    CASE WHEN event_type = 'error' THEN '4xx' ELSE '2xx' END AS code, CASE WHEN event_type = 'error' THEN 'NoSuchKey' END AS error, TRUE AS timed,
    CASE WHEN event_type = 'purchase' THEN event_id % 40 ELSE 0 END AS bytes_in, CASE event_type WHEN 'error' THEN 37 WHEN 'purchase' THEN 0 WHEN 'signup' THEN 0 ELSE event_id % 40 END AS bytes_out FROM events)""", False))
def e2e_s3_metrics(spark, sf):
    return lines(wire.s3_events(spark, sf), "s3")


@query(lines_sql("""WITH o AS (SELECT 'select * from t' || (event_id % 5) || ' where id = ?' AS slot, 'shop' AS db, 'app' AS usr, 'simple' AS kind, CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS code,
    CASE WHEN event_type = 'error' THEN '40001' END AS error, TRUE AS timed, CASE WHEN event_type = 'error' THEN 0 ELSE event_id % 9 END AS rows
    FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) > 1)""", True))
def e2e_postgres_metrics(spark, sf):
    return lines(wire.postgres_events(spark, sf), "pg")


@query(lines_sql("""WITH o AS (SELECT 'update t' || (event_id % 5) || ' set a = ?' AS slot, '?' AS db, '?' AS usr, 'simple' AS kind, CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS code,
    CASE WHEN event_type = 'error' THEN '42000' END AS error, TRUE AS timed, CASE WHEN event_type = 'error' THEN 0 ELSE event_id % 200 END AS rows FROM events)""", True))
def e2e_mysql_metrics(spark, sf):
    return lines(wire.mysql_events(spark, sf), "mysql")


@query("SELECT proto, n AS observed, n AS counted, n AS places FROM (SELECT count(*) AS n FROM events), (VALUES ('http'), ('redis'), ('s3')) t(proto)")
def e2e_conservation(spark, sf):
    """Of each protocol: observations, what all its series sum to when few identities have a slot, and distinct places."""
    out = None
    for proto, events in (("http", wire.http_events), ("redis", wire.redis_events), ("s3", wire.s3_events)):
        obs = observe.observations(observe.parse(events(spark, sf), default=proto))
        r = identity.identified(obs, slots=2, dims=3, errors=1)
        per = r.groupBy("slot", *families.DIMS, "outcome").agg(F.count("*").alias("n")).agg(F.sum("n").alias("counted"))
        one = per.crossJoin(obs.agg(F.count("*").alias("observed"), F.count_distinct(*S.ORDER).alias("places")))
        one = one.select(F.lit(proto).alias("proto"), "observed", "counted", "places")
        out = one if out is None else out.unionByName(one)
    return out


@query("""WITH o AS (SELECT CASE event_type WHEN 'purchase' THEN 'PutObject' ELSE 'GetObject' END AS slot, event_id % 40 AS size FROM events WHERE event_type NOT IN ('error', 'signup'))
    SELECT slot, CAST(0 AS INTEGER) AS cell, count(*) AS n, CAST(sum(size) AS BIGINT) AS sum FROM o WHERE size > 0 GROUP BY slot""")
def agg12_object_sizes(spark, sf):
    """Sizes of objects that parsed S3 requests moved, by operation: neither failed requests nor deletions count."""
    r = reduce.reduce_observations(observe.observations(observe.parse(wire.s3_events(spark, sf), default="s3")))
    return hist.size_cells(r.where("sized"), "obj_bytes", "s3", "route").withColumnRenamed("route", "slot")


@query(f"""WITH t AS (SELECT CASE WHEN event_type = 'error' THEN 'aborted' ELSE 'ok' END AS status, CAST(floor(value * 1000) AS BIGINT) / 1e9 AS s FROM events)
    SELECT 'redis' AS proto, '0' AS db, 'default' AS "user", status, {bucket_sql("s")} AS bucket, count(*) AS n, round(sum(s), 9) AS sum, count(*) FILTER (WHERE s <= 0) AS nonpos FROM t GROUP BY ALL""")
def agg15_parsed_transactions(spark, sf):
    """Durations of parsed transactions by protocol, labels and how they ended."""
    request = F.concat(wire.words("MULTI"), wire.words("EXEC"))
    end = F.when(F.col("event_type") == "error", "*-1\r\n").otherwise("*0\r\n")
    result = observe.parse(wire.conversation(spark, sf, [(RECV, request), (SEND, F.concat(F.lit("+OK\r\n"), end))]), default="redis")
    t = observe.transactions(result).withColumns({"status": F.when(F.col("aborted"), "aborted").otherwise("ok"), "s": (F.col("end_ns") - F.col("start_ns")) / 1e9})
    return hist.latency_cells(t, "s", "proto", "db", "user", "status").withColumn("sum", F.round("sum", 9))


# --- cardinality -----------------------------------------------------------------------------------------------------

SLOTS, DOORS = 6, 16


@query(f"""WITH RECURSIVE r AS (SELECT row_number() OVER (ORDER BY event_id) AS i, CASE WHEN event_id % 5 < 3 THEN user_id % 4 + 1 ELSE user_id % 40 + 1 END AS fp FROM events),
    st(i, held, doors) AS (
        SELECT 0::BIGINT, []::STRUCT(fp BIGINT, since BIGINT)[], list_transform(range({DOORS}), lambda x: 0::BIGINT)
        UNION ALL
        SELECT r.i,
            CASE WHEN len(list_filter(held, lambda h: h.fp = r.fp)) > 0 THEN list_concat(list_filter(held, lambda h: h.fp <> r.fp), list_filter(held, lambda h: h.fp = r.fp))
                WHEN len(held) < {SLOTS} THEN list_append(held, {{'fp': r.fp, 'since': r.i}})
                WHEN doors[r.fp % {DOORS} + 1] = r.fp THEN list_append(held[2:], {{'fp': r.fp, 'since': r.i}}) ELSE held END,
            CASE WHEN len(list_filter(held, lambda h: h.fp = r.fp)) > 0 OR len(held) < {SLOTS} THEN doors
                ELSE list_transform(doors, lambda d, j: CASE WHEN j <> r.fp % {DOORS} + 1 THEN d WHEN d = r.fp THEN 0 ELSE r.fp END) END
        FROM st JOIN r ON r.i = st.i + 1
    ), h AS (SELECT unnest(held) AS h FROM st ORDER BY i DESC LIMIT {SLOTS})
    SELECT CASE WHEN h.fp IS NULL THEN 'other' ELSE 'id' || r.fp END AS slot, count(*) AS value FROM r LEFT JOIN (SELECT h.fp AS fp, h.since AS since FROM h) h ON h.fp = r.fp AND r.i >= h.since GROUP BY 1""")
def car1_car2_car3_top_k_fold(spark, sf):
    """Few slots and many identities: what is evicted, knocks once or comes back counts for other until it is admitted anew."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    fp = F.when(F.col("event_id") % 5 < 3, F.col("user_id") % 4 + 1).otherwise(F.col("user_id") % 40 + 1)
    out = cardinality.admit(e.select(F.col("event_id").alias("seq"), fp.alias("fp")), slots=SLOTS, doors=DOORS)
    return out.groupBy(F.when(F.col("admitted"), F.concat(F.lit("id"), F.col("fp").cast("string"))).otherwise(S.OTHER).alias("slot")).agg(F.count("*").alias("value"))
