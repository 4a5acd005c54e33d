"""Recordings of raw events: a magic, then each record behind its 32-bit size.

The magic is a parameter, since it names the recording program. Files are read whole as binary rows and split on the
executors, so a recorder must start a new file before 2 GB; a damaged record becomes a row with a status, never an error.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wiretally import schema as S

# Fixed value: the four bytes that a recording starts with.
MAGIC = b"LKT1"
# Record types, directions and flags as they are recorded, little-endian.
DATA, OPEN, CLOSE = 0, 1, 2
SEND, RECV = 0, 1
TRUNC, GAP, SYNTHETIC, DECRYPTED = 1, 2, 4, 8
HEADER = struct.Struct("<QQIBBH")
TUPLE = struct.Struct("<B3xI16s16sHH")
CHUNK = struct.Struct("<IIII")
CONN_BYTES = HEADER.size + TUPLE.size + 8


def decode(record: bytes) -> dict:
    """A row of schema.RAW_EVENT. decode_status: data, conn, short or unknown."""
    row = dict.fromkeys(S.RAW_EVENT.names)
    row["decode_status"] = "short"
    if len(record) < HEADER.size:
        return row
    row["conn_id"], row["ts_ns"], row["seq"], row["type"], row["dir"], row["flags"] = HEADER.unpack_from(record)
    row["conn_id"] = signed(row["conn_id"])
    if row["type"] in (OPEN, CLOSE):
        if len(record) >= CONN_BYTES:
            names = ("family", "netns", "saddr", "daddr", "sport", "dport")
            row["tuple"] = dict(zip(names, TUPLE.unpack_from(record, HEADER.size), strict=True))
            row["decode_status"] = "conn"
    elif row["type"] == DATA:
        start = HEADER.size + CHUNK.size
        if len(record) >= start:
            if row["dir"] > RECV:
                row["decode_status"] = "unknown"
                return row
            row["total_len"], row["off"], cap, _ = CHUNK.unpack_from(record, HEADER.size)
            row["cap_len"] = min(cap, len(record) - start)  # the record's own end is trusted over its field
            row["payload"] = record[start : start + row["cap_len"]]
            row["decode_status"] = "data"
    else:
        row["decode_status"] = "unknown"
    return row


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def encode(row: dict) -> bytes:
    """The record of a row: the recorder's side."""
    head = HEADER.pack(row["conn_id"] & (1 << 64) - 1, row["ts_ns"], row["seq"], row["type"], row["dir"], row["flags"])
    if row["type"] == DATA:
        payload = bytes(row["payload"] or b"")
        return head + CHUNK.pack(row["total_len"], row["off"], len(payload), 0) + payload
    t = row["tuple"] or {"family": 2, "netns": 0, "saddr": b"", "daddr": b"", "sport": 0, "dport": 0}
    return head + TUPLE.pack(t["family"], t["netns"], bytes(t["saddr"]), bytes(t["daddr"]), t["sport"], t["dport"]) + struct.pack("<II", 0, 0)


def split(data: bytes, magic: bytes = MAGIC) -> Iterator[bytes]:
    """The records of a recording; raises ValueError on a wrong magic or a cut record."""
    if not data.startswith(magic):
        raise ValueError("not a recording")
    at = len(magic)
    while at < len(data):
        if at + 4 > len(data):
            raise ValueError("cut size")
        (size,) = struct.unpack_from("<I", data, at)
        at += 4
        if at + size > len(data):
            raise ValueError("cut record")
        yield data[at : at + size]
        at += size


def join(records: list[bytes], magic: bytes = MAGIC) -> bytes:
    return magic + b"".join(struct.pack("<I", len(r)) + r for r in records)


ARROW = pa.schema(
    [("path", pa.string()), ("place", pa.int64())]
    + [
        ("conn_id", pa.int64()), ("ts_ns", pa.int64()), ("seq", pa.int64()), ("type", pa.int32()), ("dir", pa.int32()), ("flags", pa.int32()),
        ("tuple", pa.struct([("family", pa.int32()), ("netns", pa.int64()), ("saddr", pa.binary()), ("daddr", pa.binary()), ("sport", pa.int32()), ("dport", pa.int32())])),
        ("total_len", pa.int64()), ("off", pa.int64()), ("cap_len", pa.int64()), ("payload", pa.binary()), ("decode_status", pa.string()),
    ]
)
ROWS = 4096


def decode_files(files: DataFrame, magic: bytes = MAGIC) -> DataFrame:
    """Rows of recordings from a frame with path and content; place is the record's number in its file."""
    from pyspark.sql import types as T

    def run(batches):
        for b in batches:
            for path, content in zip(b.column("path"), b.column("content"), strict=True):
                rows, k = [], 0
                try:
                    for k, record in enumerate(split(content.as_py(), magic)):
                        rows.append({"path": path.as_py(), "place": k} | decode(record))
                        if len(rows) == ROWS:
                            yield pa.RecordBatch.from_pylist(rows, ARROW)
                            rows = []
                except ValueError as e:
                    rows.append({"path": path.as_py(), "place": k + 1, "decode_status": f"rejected: {e}"})
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, ARROW)

    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("place", T.LongType()), *S.RAW_EVENT.fields])
    return files.select("path", "content").mapInArrow(run, schema)


def read(spark: SparkSession, path: str, magic: bytes = MAGIC) -> DataFrame:
    """All recordings under a path or pattern, by Spark's own file reader: one task reads whole files."""
    return decode_files(spark.read.format("binaryFile").load(path), magic)


def read_stream(spark: SparkSession, path: str, magic: bytes = MAGIC) -> DataFrame:
    """New recordings as they appear in a folder."""
    files = spark.readStream.format("binaryFile").load(path)
    return decode_files(files, magic)


def record(events: DataFrame) -> DataFrame:
    """Each event's bytes as a recorder writes them, unchanged: conn_id, seq, record."""

    @F.pandas_udf("binary")
    def pack(frame):
        import pandas as pd

        return pd.Series([encode(r) for r in frame.to_dict("records")])

    names = ["conn_id", "ts_ns", "seq", "type", "dir", "flags", "tuple", "total_len", "off", "payload"]
    return events.select("conn_id", "seq", pack(F.struct(*names)).alias("record"))
