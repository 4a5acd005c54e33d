"""External logs as tables: server logs, access logs, traces, metric dumps and bench results."""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import batched

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Places of the server log's columns that are used.
CSVLOG = {"user": 1, "db": 2, "conn": 4, "session": 5, "severity": 11, "sqlstate": 12, "message": 13, "query": 19}
CSVLOG_COLUMNS = 26


def csvlog(spark: SparkSession, path: str) -> DataFrame:
    """A PostgreSQL csvlog: LOG and ERROR rows of network clients, with a duration and a phase where the message has one."""
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(CSVLOG_COLUMNS)])
    rows = spark.read.csv(path, schema=schema, multiLine=True, quote='"', escape='"', mode="PERMISSIVE")
    out = rows.select(*(F.col(f"c{i}").alias(n) for n, i in CSVLOG.items()))
    out = out.where(F.col("severity").isin("LOG", "ERROR") & (F.col("conn") != "[local]"))
    ms = F.regexp_extract("message", r"^duration: ([0-9]+\.[0-9]+) ms", 1)
    phase = F.regexp_extract("message", r"^duration: [0-9.]+ ms +(parse|bind|execute|statement)", 1)
    return out.withColumn("dur_s", ms.try_cast("double") / 1000).withColumn("phase", F.nullif(phase, F.lit("")))


def access_log(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of a proxy; lines that aren't JSON are dropped. A time of - is null."""
    schema = "id string, status string, method string, uri string, rt string, urt string, bs string"
    rows = spark.read.schema(schema).json(path, mode="DROPMALFORMED")
    number = lambda c, t: F.expr(f"try_cast(nullif({c}, '-') AS {t})").alias(c)
    return rows.select("id", number("status", "int"), "method", "uri", number("rt", "double"), number("urt", "double"), number("bs", "bigint"))


#: Characters that are decoded at a time, those at the end of a part whose errors a longer part may mend, and objects of a batch.
PART, EDGE, OBJECTS = 1 << 14, 16, 1 << 13


def json_objects(text: str) -> Iterator[str]:
    """The top-level objects of a text in which they follow each other; what isn't one is skipped.

    A failure costs as much as there is text before it, since the decoder counts its lines. So it is given a part of the text; if
    what it finds wrong may be the end of the part, the part is made twice as long.
    """
    decoder, at, start, part = json.JSONDecoder(), 0, 0, text[:PART]
    while (at := text.find("{", at)) >= 0:
        if at - start >= PART // 2:
            start, part = at, text[at : at + PART]
        try:
            value, end = decoder.raw_decode(part, at - start)
        except json.JSONDecodeError as e:
            if start + len(part) < len(text) and (e.pos >= len(part) - EDGE or e.msg.startswith("Unterminated")):
                start, part = at, text[at : at + 2 * max(len(part), PART)]
            else:
                at += 1
            continue
        yield json.dumps(value)
        at = start + end


TRACE_DDL = (
    "type string, api string, path string, request struct<method:string>,"
    " response struct<statusCode:int, headers:map<string,string>>, callStats struct<duration:bigint, timeToFirstByte:bigint, rx:bigint, tx:bigint>"
)


def object_trace(spark: SparkSession, path: str) -> DataFrame:
    """A storage server's trace: concatenated JSON objects, split on the executors, then typed by from_json."""
    files = spark.read.text(path, wholetext=True)

    def run(frames):
        for f in frames:
            for text in f["value"]:
                for some in batched(json_objects(text), OBJECTS):
                    yield pd.DataFrame({"object": some}, dtype=object)

    return files.mapInPandas(run, "object string").select(F.from_json("object", TRACE_DDL).alias("o")).select("o.*").where("api IS NOT NULL")


OBS_LINE = (
    r"^http conn=(\S+) method=(\S+) status=(\d+) dur=(\d+)ns ttfb=(\d+)ns upload=(\d+)ns in=(\d+) out=(\d+)(?: obj=\d+)? host=(\S+)"
    r"(?: user=(\S+))?(?: flags=(\S+))?(?: err=\S+)?(?: reqid=(\S+))?(?: route=(\S+))?(?: target=(.*))?$"
)
OBS_FIELDS = ("conn", "method", "status", "dur_ns", "ttfb_ns", "upload_ns", "bytes_in", "bytes_out", "host", "user", "flags", "req_id", "route", "target")
OBS_NUMBERS = ("dur_ns", "ttfb_ns", "upload_ns", "bytes_in", "bytes_out")


def obs_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Printed observations back as rows; other lines are dropped."""
    hit = lines.where(F.col(column).rlike(OBS_LINE))
    found = [F.regexp_extract(column, OBS_LINE, i + 1).alias(n) for i, n in enumerate(OBS_FIELDS)]
    out = hit.select(*found).withColumn("status", F.col("status").try_cast("int"))
    return out.withColumns({n: F.col(n).try_cast("long") for n in OBS_NUMBERS})


def command_stats(lines: DataFrame, column: str = "value") -> DataFrame:
    """cmdstat_NAME:calls=N,usec=N,usec_per_call=F as name, calls, usec, usec_per_call."""
    pattern = r"^cmdstat_([^:]+):calls=(\d+),usec=(\d+),usec_per_call=([0-9.]+)"
    hit = lines.where(F.col(column).rlike(pattern))
    part = lambda i: F.regexp_extract(column, pattern, i)
    return hit.select(part(1).alias("name"), part(2).try_cast("long").alias("calls"), part(3).try_cast("long").alias("usec"), part(4).try_cast("double").alias("usec_per_call"))


def memtier(lines: DataFrame, column: str = "value") -> DataFrame:
    """The totals table of a memtier report: kind, ops, avg_ms, p50_ms, p99_ms."""
    pattern = r"^(Sets|Gets|Waits|Totals)\s+([0-9.]+)\s+(?:\S+\s+\S+\s+)?([0-9.]+)\s+([0-9.]+)\s+([0-9.]+)"
    hit = lines.where(F.col(column).rlike(pattern))
    names = ("kind", "ops", "avg_ms", "p50_ms", "p99_ms")
    out = hit.select(*(F.regexp_extract(column, pattern, i + 1).alias(n) for i, n in enumerate(names)))
    return out.withColumns({n: F.col(n).try_cast("double") for n in names[1:]})


SAMPLE = r'^([A-Za-z_:][A-Za-z0-9_:]*)(?:\{(.*)\})?\s+(\S+)(?:\s+\d+)?$'


def metric_value(text: Column) -> Column:
    return F.when(text == "+Inf", float("inf")).when(text == "-Inf", float("-inf")).otherwise(text.try_cast("double"))


def exposition(lines: DataFrame, column: str = "value") -> DataFrame:
    """Prometheus text as name, labels, value. Labels are found by expression; escapes are undone last."""
    hit = lines.where(F.col(column).rlike(SAMPLE))
    body = F.regexp_extract(column, SAMPLE, 2)
    pair = r'([A-Za-z_][A-Za-z0-9_]*)="((?:[^"\\]|\\.)*)"'
    keys = F.regexp_extract_all(body, F.lit(pair), F.lit(1))
    raw = F.regexp_extract_all(body, F.lit(pair), F.lit(2))

    def plain(v: Column) -> Column:
        # A doubled backslash is set aside while the other escapes are undone.
        v = F.replace(v, F.lit("\\\\"), F.lit("\x00"))
        v = F.replace(F.replace(v, F.lit('\\"'), F.lit('"')), F.lit("\\n"), F.lit("\n"))
        return F.replace(v, F.lit("\x00"), F.lit("\\"))

    labels = F.map_from_arrays(keys, F.transform(raw, plain))
    return hit.select(F.regexp_extract(column, SAMPLE, 1).alias("name"), labels.alias("labels"), metric_value(F.regexp_extract(column, SAMPLE, 3)).alias("value"))


BENCH_DDL = (
    "workload string, config string, pair int, role string, valid int, tps double, lat_avg_ms double, p50_ms double, p95_ms double,"
    " wall_s double, agent_cpu_s double, agent_cores double, pg_cores double, dropped bigint, resync bigint, queries bigint, reason string"
)


def bench_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BENCH_DDL).csv(path, sep="\t", header=True)


def slowlog(spark: SparkSession, path: str) -> DataFrame:
    """SLOWLOG entries, one JSON array a line: [id, unix time, microseconds, [words], address, name]."""
    lines = spark.read.text(path)
    item = lambda i: F.get_json_object("value", f"$[{i}]")
    return lines.select(
        item(0).cast("long").alias("id"), item(1).cast("long").alias("at"), item(2).cast("long").alias("usec"),
        F.from_json(item(3), "array<string>").alias("argv"), item(4).alias("addr"), item(5).alias("name"),
    ).where("id IS NOT NULL")


def udp_volume(counters: DataFrame) -> DataFrame:
    """Packets and bytes by port and direction, summed over processors."""
    return counters.groupBy("port", "dir").agg(F.sum("packets").alias("packets"), F.sum("bytes").alias("bytes"))


def self_stats(spark: SparkSession, prefix: str = "wt") -> DataFrame:
    """CPU seconds, resident bytes at present and start time of this driver process as gauge rows, from the kernel's tables."""
    import os

    with open("/proc/self/stat") as f:
        stat = f.read().rpartition(")")[2].split()  # fields from the third on; the name before may hold spaces
    with open("/proc/self/statm") as f:
        pages = int(f.read().split()[1])
    with open("/proc/stat") as f:
        boot = next(int(line.split()[1]) for line in f if line.startswith("btime"))
    ticks = os.sysconf("SC_CLK_TCK")
    rows = [
        (f"{prefix}_process_cpu_seconds_total", (int(stat[11]) + int(stat[12])) / ticks),
        (f"{prefix}_process_resident_memory_bytes", float(pages * os.sysconf("SC_PAGE_SIZE"))),
        (f"{prefix}_process_start_time_seconds", boot + int(stat[19]) / ticks),
    ]
    return spark.createDataFrame(rows, "name string, value double")
