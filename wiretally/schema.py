"""The data model: raw records, observations, flags and label sentinels."""

from __future__ import annotations

from pyspark.sql import types as T

# Bits of an observation's flags.
ERROR, TEXT_TRUNC, NO_TEXT, MULTI_STMT, EMPTY, SUSPENDED, ABORTED, PIPELINED = (1 << i for i in range(8))
CLIENT_ERR, BODY_UNSEEN, EXPECT_CONT, INTERNAL, QUEUED, BLOCKING = (1 << i for i in range(8, 14))

# Kinds of a unit of work, by number.
KINDS = ("simple", "extended", "function", "copy_in", "copy_out", "cancel", "request", "command")

# Three labels that must stay apart.
ANONYMOUS, UNKNOWN, OTHER = "-", "?", "other"

#: Prefix of every metric name of this library.
PREFIX = "wt"

_L, _I, _S, _B = T.LongType(), T.IntegerType(), T.StringType(), T.BinaryType()


def struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


TUPLE = struct(family=_I, netns=_L, saddr=_B, daddr=_B, sport=_I, dport=_I)
RAW_EVENT = struct(
    conn_id=_L, ts_ns=_L, seq=_L, type=_I, dir=_I, flags=_I, tuple=TUPLE, total_len=_L, off=_L, cap_len=_L, payload=_B,
    decode_status=_S,
)
HTTP = struct(
    trace_id=_S, parent_id=_S, trace_flags=_I, tracestate=_S, req_id=_S, ctype=_S, version=_I, obj_version=_S, ts_interim_ns=_L
)
REDIS = struct(pipeline_depth=_I, txn_size=_I, argc=_I, redirect=_S)
#: (seq, conn, place) is a total order of observations: the time of the event that ended one, its connection, and how many that
#: connection had before. It doesn't depend on how connections are dealt to tasks or events to micro-batches.
ORDER = ("seq", "conn", "place")
OBSERVATION = struct(
    seq=_L, conn=_L, place=_L, proto=_S, kind=_S, flags=_I, db=_S, user=_S, app=_S, ts_start_ns=_L, ts_req_done_ns=_L,
    ts_first_row_ns=_L, ts_complete_ns=_L, ts_ready_ns=_L, text=_S, op=_S, route=_S, fp=_L, rows=_L, bytes=_L, bytes_in=_L,
    bytes_out=_L, obj_bytes=_L, sqlstate=_S, err_code=_I, err_name=_S, txn_status=_S, http=HTTP, redis=REDIS,
)
TRANSACTION = struct(conn=_L, proto=_S, db=_S, user=_S, start_ns=_L, end_ns=_L, aborted=T.BooleanType())
METRIC = T.StructType(
    [
        T.StructField("name", _S),
        T.StructField("type", _S),
        T.StructField("labels", T.MapType(_S, _S)),
        T.StructField("value", T.DoubleType()),
    ]
)
