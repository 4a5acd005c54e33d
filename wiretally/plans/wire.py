"""Raw events made of the driver's tables, so that the parsers run in queries: one command and one reply for each event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wiretally import schema as S
from wiretally.plans import adapters as A
from wiretally.sources import recordings


def exchange(spark: SparkSession, sf_dir: str, request: Column, reply: Column, where: str = "TRUE") -> DataFrame:
    """Two raw events for each row of events: what the server receives and what it sends, in order on each connection."""
    return conversation(spark, sf_dir, [(recordings.RECV, request), (recordings.SEND, reply)], where)


def conversation(spark: SparkSession, sf_dir: str, steps: list[tuple], where: str = "TRUE") -> DataFrame:
    """Raw events for each row of events, in order on each connection: steps of a direction and bytes, and optionally flags and the
    length of the whole call if only its beginning was captured. A step of null bytes didn't happen, but has its number.

    The first event of a connection opens it and has number 1; step i of its _k-th row has len(steps) * _k + i. All steps but
    the first come value microseconds after it.
    """
    e = A.table(spark, sf_dir, "events").where(where)
    # _k numbers the events of a connection from 1; steps may refer to it.
    e = e.withColumn("_k", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long"))
    ns = F.unix_micros(F.col("ts").cast("timestamp")) * 1000
    n, parts = len(steps), []
    for i, (way, payload, *more) in enumerate(steps):
        flags, total = (*more, None, None)[:2]
        size = F.octet_length(payload.cast("binary")).cast("long")
        parts.append(
            F.struct(
                F.lit(way).alias("dir"), (F.col("_k") * n + i + (2 - n)).alias("seq"), (ns if not i else ns + F.floor(F.col("value") * 1000)).alias("ts_ns"), payload.cast("binary").alias("payload"),
                (F.lit(flags) if flags is not None else F.lit(0)).alias("flags"), (total if total is not None else size).cast("long").alias("total_len"),
            )
        )
    said = e.select(F.col("user_id").alias("conn_id"), F.inline(F.array(*parts))).where("payload IS NOT NULL")
    first = e.groupBy("user_id").agg(F.min(ns).alias("ts_ns"))
    opened = first.select(
        F.col("user_id").alias("conn_id"), F.lit(0).alias("dir"), F.lit(1).cast("long").alias("seq"), "ts_ns", F.lit(None).cast("binary").alias("payload"), F.lit(0).alias("flags"), F.lit(None).cast("long").alias("total_len")
    )
    rows = said.union(opened)
    held = {"type": F.when(F.col("payload").isNull(), recordings.OPEN).otherwise(recordings.DATA), "off": F.lit(0).cast("long"), "cap_len": F.octet_length("payload").cast("long")}
    held["decode_status"] = F.when(F.col("payload").isNull(), "conn").otherwise("data")
    rows = rows.withColumns({f.name: held.get(f.name, F.lit(None)).cast(f.dataType) for f in S.RAW_EVENT.fields if f.name not in rows.columns})
    return rows.select(*S.RAW_EVENT.names)


def bulk(word: Column) -> Column:
    return F.concat(F.lit("$"), F.octet_length(word).cast("string"), F.lit("\r\n"), word, F.lit("\r\n"))


def redis_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GET and SELECT commands with values, errors and redirects as replies."""
    k, e = F.col("event_type"), F.col("event_id")
    key = F.concat(F.lit("key:"), e.cast("string"))
    request = F.when(k == "signup", F.concat(F.lit("*2\r\n"), bulk(F.lit("SELECT")), bulk((e % 4).cast("string")))).otherwise(F.concat(F.lit("*2\r\n"), bulk(F.lit("get")), bulk(key)))
    reply = F.when(k == "signup", "+OK\r\n").when(k == "error", F.lit("-WRONGTYPE no\r\n")).when(k == "click", F.lit("$-1\r\n")).otherwise(bulk(F.lit("value")))
    return exchange(spark, sf_dir, request, reply)


def http_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, e = F.col("event_type"), F.col("event_id")
    request = F.concat(F.lit("GET /api/"), k, F.lit("/"), e.cast("string"), F.lit("?token=x HTTP/1.1\r\nHost: shop\r\nX-Request-Id: r"), e.cast("string"), F.lit("\r\n\r\n"))
    body = F.repeat(F.lit("x"), (e % 50).cast("int"))
    code = F.when(k == "error", "503 Busy").when(k == "click", "404 Gone").otherwise("200 OK")
    reply = F.concat(F.lit("HTTP/1.1 "), code, F.lit("\r\nContent-Length: "), F.length(body).cast("string"), F.lit("\r\n\r\n"), body)
    return exchange(spark, sf_dir, request, reply)


def packed(n: Column, size: int = 4) -> Column:
    """A big-endian number as characters below 128: good for lengths up to 127."""
    return F.concat(F.repeat(F.lit("\0"), size - 1), F.char(n))


def postgres_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Simple queries; each connection's first event is its startup."""
    k, e = F.col("event_type"), F.col("event_id")
    text = F.concat(F.lit("SELECT * FROM t"), (e % 5).cast("string"), F.lit(" WHERE id = "), e.cast("string"))
    startup = "\0\0\0\x19\0\x03\0\0user\0app\0database\0shop\0\0"
    first = F.col("_k") == 1
    request = F.when(first, F.lit(startup[:3] + chr(len(startup)) + startup[4:])).otherwise(F.concat(F.lit("Q"), packed(F.length(text) + 5), text, F.lit("\0")))
    tag = F.concat(F.lit("SELECT "), (e % 9).cast("string"), F.lit("\0"))
    done = F.concat(F.lit("C"), packed(F.length(tag) + 4), tag)
    failed = F.concat(F.lit("E"), packed(F.lit(13)), F.lit("C40001\0\0\0"))
    ready = F.lit("Z\0\0\0\x05I")
    reply = F.when(first, F.concat(F.lit("R\0\0\0\x08\0\0\0\0"), ready)).otherwise(F.concat(F.when(k == "error", failed).otherwise(done), ready))
    return exchange(spark, sf_dir, request, reply)


def raw(*parts: bytes | Column) -> Column:
    """Bytes and columns, one after the other."""
    return F.concat(*(F.lit(bytearray(p)) if isinstance(p, bytes) else p.cast("binary") for p in parts))


def byte(n: Column) -> Column:
    return F.unhex(F.lpad(F.hex(n), 2, "0"))


def packet(number: int, body: Column) -> Column:
    """A MySQL packet of less than 256 bytes."""
    return raw(byte(F.octet_length(body)), b"\0\0" + bytes([number]), body)


def mysql_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements with affected rows or errors; connections are taken up in the middle, so their labels are unknown."""
    k, e = F.col("event_type"), F.col("event_id")
    text = F.concat(F.lit("UPDATE t"), (e % 5).cast("string"), F.lit(" SET a = "), e.cast("string"))
    request = packet(0, raw(b"\x03", text))
    done = packet(1, raw(b"\0", byte(e % 200), b"\0\x02\0\0\0"))
    failed = packet(1, raw(b"\xff\x28\x04#42000", F.lit("bad")))
    return exchange(spark, sf_dir, request, F.when(k == "error", failed).otherwise(done)).where("type <> 1")


def s3_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Object reads and writes of buckets, some of them failing with an error body."""
    k, e = F.col("event_type"), F.col("event_id")
    put = k == "purchase"
    size = e % 40
    verb = F.when(put, "PUT").when(k == "signup", "DELETE").otherwise("GET")
    head = F.concat(verb, F.lit(" /bucket"), (e % 3).cast("string"), F.lit("/dir/"), e.cast("string"), F.lit(" HTTP/1.1\r\nHost: store\r\nAuthorization: AWS4-HMAC-SHA256 Credential=AK"), (F.col("user_id") % 5).cast("string"), F.lit("/20240101/r/s3/aws4_request, SignedHeaders=host\r\n"))
    request = F.concat(head, F.when(put, F.concat(F.lit("Content-Length: "), size.cast("string"), F.lit("\r\n\r\n"), F.repeat(F.lit("x"), size.cast("int")))).otherwise("\r\n"))
    body = F.when(k == "error", "<Error><Code>NoSuchKey</Code></Error>").when(put | (k == "signup"), "").otherwise(F.repeat(F.lit("y"), size.cast("int")))
    reply = F.concat(F.lit("HTTP/1.1 "), F.when(k == "error", "404 N").otherwise("200 OK"), F.lit("\r\nContent-Length: "), F.length(body).cast("string"), F.lit("\r\n\r\n"), body)
    return exchange(spark, sf_dir, request, reply)


def words(*parts: str | Column) -> Column:
    """A Redis command."""
    return F.concat(F.lit(f"*{len(parts)}\r\n"), *(bulk(F.lit(p) if isinstance(p, str) else p) for p in parts))


def pg_message(kind: str, body: Column) -> Column:
    """A PostgreSQL message of less than 120 bytes."""
    return F.concat(F.lit(kind), packed(F.octet_length(body) + 4), body)


def pg_startup() -> Column:
    """The first step of a connection."""
    head = "\0\0\0\x19\0\x03\0\0user\0app\0database\0shop\0\0"
    return F.lit(head[:3] + chr(len(head)) + head[4:])


def pg_welcome() -> Column:
    return F.lit("R\0\0\0\x08\0\0\0\0Z\0\0\0\x05I")
