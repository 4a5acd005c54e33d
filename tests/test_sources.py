"""Recordings, logs and streams."""

import json
import struct
import time

import pytest
from pyspark.sql import functions as F
from wire import Wire, postgres, pg, ready, resp

from wiretally import schema as S
from wiretally.sources import live, logs, recordings
from wiretally.streaming import observe


def recording(rows):
    return recordings.join([recordings.encode(r) for r in rows])


def trace():
    w = Wire("redis")
    for i in range(5):
        w.recv(resp("GET", f"k{i}"))
        w.send(b"$1\r\nv\r\n")
    return w


def test_record_round_trip():
    rows = trace().rows
    back = [recordings.decode(r) for r in recordings.split(recording(rows))]
    assert [(r["seq"], r["payload"]) for r in back[1:]] == [(r["seq"], r["payload"]) for r in rows[1:]]
    assert back[0]["decode_status"] == "conn"


def test_damaged_records():
    assert recordings.decode(b"x")["decode_status"] == "short"
    head = recordings.HEADER.pack(1, 2, 3, 9, 0, 0)
    assert recordings.decode(head)["decode_status"] == "unknown"
    assert recordings.decode(recordings.HEADER.pack(1, 2, 3, 0, 7, 0) + bytes(16))["decode_status"] == "unknown"
    cut = recordings.HEADER.pack(1, 2, 3, 0, 1, 0) + struct.pack("<IIII", 100, 0, 100, 0) + b"abc"
    assert recordings.decode(cut)["cap_len"] == 3
    with pytest.raises(ValueError):
        list(recordings.split(b"nope"))


def test_read_and_parse_files(spark, tmp_path):
    (tmp_path / "a.rec").write_bytes(recording(trace().rows))
    (tmp_path / "b.rec").write_bytes(recording(trace().rows)[:-3])
    rows = recordings.read(spark, str(tmp_path))
    assert rows.where("decode_status LIKE 'rejected%'").count() == 1
    good = rows.where("path LIKE '%a.rec'")
    o = observe.observations(observe.parse(good, default="redis"))
    assert o.count() == 5 and {r[0] for r in o.select("route").collect()} == {"GET"}


def test_protocol_by_port(spark):
    w = postgres()
    w.recv(pg("Q", b"SELECT 1\0"))
    w.send(pg("C", b"SELECT 1\0") + ready())
    rows = [r | {"tuple": {"family": 2, "netns": 1, "saddr": b"", "daddr": b"", "sport": 5432, "dport": 1}} if r["type"] == 1 else r for r in w.rows]
    df = spark.createDataFrame([tuple(r[n] if n != "payload" or r[n] is None else bytearray(r[n]) for n in S.RAW_EVENT.names) for r in rows], S.RAW_EVENT)
    assert observe.observations(observe.parse(df, {5432: "pg"}, default="redis")).count() == 1


def events_frame(spark, w):
    rows = [tuple(bytearray(r[n]) if n == "payload" and r[n] is not None else r[n] for n in S.RAW_EVENT.names) for r in w.rows]
    return spark.createDataFrame(rows, S.RAW_EVENT)


def drain(stream, name, checkpoint):
    q = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", str(checkpoint)).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return q


def test_stream_equals_batch_over_a_restart(spark, tmp_path):
    """State of a connection survives between micro-batches and between runs."""
    w = trace()
    w.recv(resp("SELECT", "5"))
    half = len(w.rows)
    w.send(b"+OK\r\n")
    w.recv(resp("GET", "z"))
    w.send(b"$-1\r\n")
    batch = observe.observations(observe.parse(events_frame(spark, w), default="redis"))
    want = sorted((r["route"], r["db"], r["ts_start_ns"]) for r in batch.collect())
    folder, got = tmp_path / "in", []
    for part in (slice(None, half), slice(half, None)):
        one = Wire("redis")
        one.rows = w.rows[part]
        events_frame(spark, one).coalesce(1).write.mode("append").parquet(str(folder))
        sink = str(tmp_path / "out")
        stream = observe.parse_stream(live.parquet_events(spark, str(folder)), default="redis").where("record = 'obs'").select("obs.route", "obs.db", "obs.ts_start_ns")
        q = stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", str(tmp_path / "ck")).start()
        # With idle timers there is always another batch, without data: the query is stopped when its rows are through.
        done, until = {}, time.monotonic() + 90
        while sum(done.values()) < len(w.rows[part]) and time.monotonic() < until:
            done |= {p["batchId"]: p["numInputRows"] for p in q.recentProgress}
            time.sleep(0.3)
        q.stop()
    got = sorted((r["route"], r["db"], r["ts_start_ns"]) for r in spark.read.parquet(sink).collect())
    assert got == want


def test_generated_stream(spark, tmp_path):
    events = live.generated(spark, rows=200, rowsPerBatch=100, conns=4)
    q = events.writeStream.format("memory").queryName("gen").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        q.processAllAvailable()
        q.processAllAvailable()
        assert spark.table("gen").count() == 200
    finally:
        q.stop()


def test_windowed_counts(spark, tmp_path):
    rows = [(i, "pg", 1_700_000_000_000_000_000 + i * 1_000_000_000) for i in range(200)]
    path = str(tmp_path / "obs")
    spark.createDataFrame(rows, "seq long, proto string, ts_complete_ns long").write.parquet(path)
    stream = spark.readStream.schema("seq long, proto string, ts_complete_ns long").parquet(path)
    drain(observe.windowed_counts(stream), "win", tmp_path / "ck")
    assert sum(r["n"] for r in spark.table("win").collect()) > 0


def test_csvlog(spark, tmp_path):
    def line(user, conn, severity, state, message):
        f = [""] * 26
        f[1], f[2], f[4], f[5], f[11], f[12], f[13] = user, "db", conn, "s1", severity, state, '"' + message.replace('"', '""') + '"'
        return ",".join(f)

    text = [line("u", "1.2.3.4:5", "LOG", "00000", 'duration: 12.500 ms  execute <unnamed>: select "a",\n1'), line("u", "[local]", "LOG", "00000", "x"), line("u", "1.2.3.4:5", "ERROR", "42601", "bad")]
    (tmp_path / "log.csv").write_text("\n".join(text) + "\n")
    rows = logs.csvlog(spark, str(tmp_path / "log.csv")).orderBy("severity").collect()
    assert [(r["severity"], r["dur_s"], r["phase"]) for r in rows] == [("ERROR", None, None), ("LOG", 0.0125, "execute")]


def test_access_log_and_trace(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id":"1","status":"200","rt":"0.5","urt":"-","bs":"7"}\nnot json\n{"id":"2","status":"404","rt":"1","urt":"0.25","bs":"0"}\n')
    rows = {r["id"]: r for r in logs.access_log(spark, str(tmp_path / "a.json")).where("id IS NOT NULL").collect()}
    assert rows["1"]["urt"] is None and rows["2"]["urt"] == 0.25
    one = {"type": "s3", "api": "s3.GetObject", "path": "/b/k", "request": {"method": "GET"}, "response": {"statusCode": 200, "headers": {"X-Amz-Request-Id": "r"}}, "callStats": {"duration": 5, "timeToFirstByte": 2, "rx": 1, "tx": 9}}
    (tmp_path / "t.json").write_text(json.dumps(one, indent=1) + "{broken}" + json.dumps(one | {"api": "s3.PutObject"}))
    rows = logs.object_trace(spark, str(tmp_path / "t.json")).collect()
    assert [(r["api"], r["callStats"]["tx"]) for r in rows] == [("s3.GetObject", 9), ("s3.PutObject", 9)]


def test_slowlog_memtier_bench(spark, tmp_path):
    (tmp_path / "slow").write_text('[1, 1700000000, 15, ["GET", "k"], "a:1", "n"]\n')
    assert logs.slowlog(spark, str(tmp_path / "slow")).first()["argv"] == ["GET", "k"]
    lines = spark.createDataFrame([("Sets 100.5 --- --- 1.2 1.0 3.5",), ("Totals 9.0 1 2 0.5 0.4 0.9",), ("x",)], "value string")
    assert {r["kind"]: r["p99_ms"] for r in logs.memtier(lines).collect()} == {"Sets": 3.5, "Totals": 0.9}
    header = "\t".join(x.split()[0] for x in logs.BENCH_DDL.split(","))
    (tmp_path / "b.tsv").write_text(header + "\n" + "\t".join(["select", "C", "1", "on", "1"] + ["1.5"] * 8 + ["0", "0", "9", ""]) + "\n")
    assert logs.bench_table(spark, str(tmp_path / "b.tsv")).first()["queries"] == 9


def test_self_stats(spark):
    got = {r["name"]: r["value"] for r in logs.self_stats(spark).where(F.col("value") > 0).collect()}
    assert len(got) == 3 and 0 <= time.time() - got["wt_process_start_time_seconds"] < 3600
    assert 1e6 < got["wt_process_resident_memory_bytes"] < 1e11


def test_trace_objects_in_parts(monkeypatch):
    """Parts that end anywhere, also inside of strings, numbers and escapes, give the objects of the whole text."""
    text = '{rubbish}{"a": -12.5e3, "b": "x{\\u00e9\\"}"} {"c": {"d": [true, null, {"e": "' + "y" * 99 + '"}]}}{"open": "{"f": 1}{{"g": NaN}{"h": ['
    want = ['{"a": -12500.0, "b": "x{\\u00e9\\"}"}', '{"c": {"d": [true, null, {"e": "' + "y" * 99 + '"}]}}', '{"f": 1}', '{"g": NaN}']
    for part in range(2, 80):
        monkeypatch.setattr(logs, "PART", part)
        assert list(logs.json_objects(text)) == want


def test_trace_time_follows_its_length():
    """Rubbish late in a long text costs no more than rubbish at its beginning."""
    text = "".join(f'{{"api":"s3.view","path":"/b/{{k}}","callStats":{{"duration":{i},"tx":5}}}}{{rubbish}} ' for i in range(40_000))
    began = time.process_time()
    assert sum(1 for _ in logs.json_objects(text)) == 40_000
    assert time.process_time() - began < 5
