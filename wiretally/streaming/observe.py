"""Running the parsers: over a table of raw events in batch, and over a stream with state for each connection.

Both use the same Connection classes. In batch, events are dealt by connection and sorted, and each task streams through
its connections one after the other, so memory is that of one connection's state. In a stream, the state is
kept between batches and an idle timer ends it.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from wiretally import schema as S
from wiretally.sources import recordings
from wiretally.streaming import core
from wiretally.streaming.http import S3, Http
from wiretally.streaming.mysql import MySql
from wiretally.streaming.postgres import Postgres
from wiretally.streaming.resp import Redis

#: The protocols that can be parsed; others are added here by their name.
HANDLERS = {"pg": Postgres, "mysql": MySql, "http": Http, "s3": S3, "redis": Redis}
PROFILES = {"pg": "query", "mysql": "query", "http": "http", "s3": "s3", "redis": "redis"}

#: A row of output is one of these: an observation, a transaction, a session, a message or a count.
RESULT = T.StructType(
    [
        T.StructField("record", T.StringType()),
        T.StructField("obs", S.OBSERVATION),
        T.StructField("txn", S.TRANSACTION),
        T.StructField("session", S.struct(conn=T.LongType(), proto=T.StringType(), user=T.StringType(), db=T.StringType(), app=T.StringType(), version=T.StringType())),
        T.StructField("message", S.struct(conn=T.LongType(), dir=T.IntegerType(), kind=T.StringType(), len=T.LongType(), cut=T.BooleanType())),
        T.StructField("count", S.struct(name=T.StringType(), proto=T.StringType(), reason=T.StringType(), n=T.LongType())),
    ]
)


def rows_of(report: core.Report) -> list[dict]:
    empty = dict.fromkeys(RESULT.names)
    out = [empty | {"record": "obs", "obs": o} for o in report.observations]
    out += [empty | {"record": "txn", "txn": t} for t in report.transactions]
    full = dict.fromkeys(("conn", "proto", "user", "db", "app", "version"))
    out += [empty | {"record": "session", "session": full | s} for s in report.sessions]
    out += [empty | {"record": "message", "message": m} for m in report.messages]
    out += [empty | {"record": "count", "count": {"name": n, "proto": p, "reason": r, "n": k}} for (n, p, r), k in sorted(report.counts.items())]
    return out


def batches_of(report: core.Report, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The same rows as Arrow batches, one for each kind of record; columns of other kinds are null."""
    full = dict.fromkeys(("conn", "proto", "user", "db", "app", "version"))
    counts = [{"name": n, "proto": p, "reason": r, "n": k} for (n, p, r), k in sorted(report.counts.items())]
    kinds = {"obs": report.observations, "txn": report.transactions, "session": [full | s for s in report.sessions], "message": report.messages, "count": counts}
    for kind, rows in kinds.items():
        if rows:
            n = len(rows)
            columns = [struct_array(rows, f.type) if f.name == kind else pa.nulls(n, f.type) for f in schema if f.name != "record"]
            yield pa.RecordBatch.from_arrays([pa.array([kind] * n), *columns], schema=schema)


def struct_array(rows: list[dict], kind: pa.StructType) -> pa.StructArray:
    """Dicts as a struct array, field by field, which is several times as fast as row by row."""
    fields = list(kind)
    return pa.StructArray.from_arrays([pa.array([r[f.name] for r in rows], f.type) for f in fields], fields=fields)


def proto_of(row: dict, ports: dict[int, str], default: str) -> str:
    t = row.get("tuple")
    return ports.get(t["sport"], default) if t else default


class Table:
    """Connections by id: opened by an open event, or lazily and without trust by the first data."""

    def __init__(self, ports: dict[int, str], default: str = "pg"):
        self.ports, self.default = ports, default
        self.held: dict[int, core.Connection] = {}

    def feed(self, row: dict, report: core.Report) -> None:
        if row["decode_status"] not in ("data", "conn"):
            report.count("bad_records", "", row["decode_status"] or "")
            return
        cid, opened = row["conn_id"], row["type"] == recordings.OPEN
        conn = self.held.get(cid)
        if conn is None:
            if row["type"] == recordings.CLOSE:
                return
            synthetic = not opened or bool((row["flags"] or 0) & recordings.SYNTHETIC)
            make = HANDLERS[proto_of(row, self.ports, self.default)]
            conn = self.held[cid] = core.Connection(cid, make, report, synthetic)
        conn.report = conn.handler.report = report
        before = len(report.observations)
        conn.feed(row)
        if len(report.observations) > before:
            conn.number(before)
        if row["type"] == recordings.CLOSE:
            del self.held[cid]


def arrow_schema() -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(RESULT)


def parse(events: DataFrame, ports: dict[int, str] | None = None, default: str = "pg", messages: bool = False) -> DataFrame:
    """RESULT rows of a table of raw events (schema.RAW_EVENT), ordered by seq on each connection.

    A hot connection is one task by the nature of its protocol; it is streamed, not gathered.
    """
    ports = ports or {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema()
        table, current = Table(ports, default), None
        for b in batches:
            report = core.Report(keeps_messages=messages)
            names = b.schema.names
            for values in zip(*(c.to_pylist() for c in b.columns), strict=True):
                row = dict(zip(names, values, strict=True))
                if row["conn_id"] != current and current is not None:
                    table.held.pop(current, None)
                current = row["conn_id"]
                table.feed(row, report)
            yield from batches_of(report, schema)

    # By a hash of the connection, as no events come dealt by that: a repartition by the connection itself is left out where events
    # are already dealt so, and what then coalesces or reads their shuffles (each side of a union by itself) may part a connection.
    dealt = events.select(*S.RAW_EVENT.names).repartition(F.xxhash64("conn_id")).sortWithinPartitions("conn_id", "seq", "ts_ns", "off")
    return dealt.mapInArrow(run, RESULT)


class Processor(StatefulProcessor):
    """State of a connection between micro-batches, and its idle timer."""

    def __init__(self, ports: dict[int, str], default: str, idle_ms: int):
        self.ports, self.default, self.idle_ms = ports, default, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("connection", T.StructType([T.StructField("pickled", T.BinaryType()), T.StructField("version", T.IntegerType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        table, report = self.load(key[0]), core.Report(keeps_messages=False)
        events = pd.concat(list(rows)).sort_values(["seq", "ts_ns", "off"], kind="stable")
        for row in events.to_dict("records"):
            table.feed(clean(row), report)
        self.save(key[0], table)
        for at in self.handle.listTimers():
            self.handle.deleteTimer(at)
        if table.held:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield frame(rows_of(report))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        table, report = self.load(key[0]), core.Report(keeps_messages=False)
        for conn in table.held.values():
            conn.report = conn.handler.report = report
            before = len(report.observations)
            conn.handler.close(conn.active_ns)
            conn.number(before)
        report.count("idle_closed", "", "", len(table.held))
        self.state.clear()
        yield frame(rows_of(report))

    def load(self, conn_id: int) -> Table:
        table = Table(self.ports, self.default)
        if self.state.exists():
            table.held[conn_id] = pickle.loads(self.state.get()[0])
        return table

    def save(self, conn_id: int, table: Table) -> None:
        conn = table.held.get(conn_id)
        if conn is None:
            self.state.clear()
            return
        conn.report = conn.handler.report = core.Report()
        self.state.update((pickle.dumps(conn), 1))

    def close(self) -> None:
        pass


def clean(row: dict) -> dict:
    """A pandas row with missing numbers as None."""
    return {k: None if isinstance(v, float) and v != v else int(v) if isinstance(v, float) else v for k, v in row.items()}


def frame(rows: list[dict]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=RESULT.names)


def parse_stream(events: DataFrame, ports: dict[int, str] | None = None, default: str = "pg", idle_ms: int = 600_000) -> DataFrame:
    """RESULT rows of a stream of raw events. Needs the RocksDB state store. Because of the idle timers there is always another
    batch to run, so the query goes on until it is stopped, whatever its trigger."""
    return events.groupBy("conn_id").transformWithStateInPandas(
        statefulProcessor=Processor(ports or {}, default, idle_ms), outputStructType=RESULT, outputMode="Append", timeMode="ProcessingTime"
    )


def windowed_counts(obs: DataFrame, late: str = "10 seconds", width: str = "1 minute") -> DataFrame:
    """Observations by event time: counts for each window and protocol; what is later than the watermark is dropped, and
    Spark's stream progress counts it."""
    at = F.timestamp_micros((F.col("ts_complete_ns") / 1000).cast("long"))
    return obs.withColumn("at", at).withWatermark("at", late).groupBy(F.window("at", width), "proto").agg(F.count("*").alias("n"))


def observations(result: DataFrame) -> DataFrame:
    return result.where("record = 'obs'").select("obs.*")


def transactions(result: DataFrame) -> DataFrame:
    return result.where("record = 'txn'").select("txn.*")


def counts(result: DataFrame) -> DataFrame:
    """Loss and state counters, summed: name, proto, reason, n."""
    return result.where("record = 'count'").groupBy("count.name", "count.proto", "count.reason").agg(F.sum("count.n").alias("n"))
