"""From observations to measured values: durations, outcomes, sizes and labels, as plain column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wiretally import schema as S


def has(bit: int, flags: str = "flags") -> Column:
    return F.col(flags).bitwiseAND(bit) != 0


def seconds(ns: Column) -> Column:
    return ns / F.lit(1e9)


def duration_db() -> Column:
    """Ready minus start, for pipelined units complete minus start; complete if the end isn't after the start; never below 0."""
    start, done, ready = F.col("ts_start_ns"), F.col("ts_complete_ns"), F.col("ts_ready_ns")
    end = F.when(has(S.PIPELINED), done).otherwise(ready)
    end = F.when(F.coalesce(end > start, F.lit(False)), end).otherwise(done)
    return seconds(F.greatest(F.coalesce(end - start, F.lit(0)), F.lit(0)))


def duration_http() -> Column:
    start = F.coalesce("ts_req_done_ns", "ts_start_ns")
    return seconds(F.greatest(F.coalesce(F.col("ts_complete_ns") - start, F.lit(0)), F.lit(0)))


def first_byte_http() -> Column:
    first, done = F.col("ts_first_row_ns"), F.col("ts_req_done_ns")
    return F.when(first > done, seconds(first - done))


def upload_http() -> Column:
    done, start = F.col("ts_req_done_ns"), F.col("ts_start_ns")
    return F.when(~has(S.EXPECT_CONT) & (done > start), seconds(done - start))


def duration_redis() -> Column:
    """None for queued commands; blocking ones are measured by blocking_redis instead."""
    took = seconds(F.greatest(F.col("ts_complete_ns") - F.col("ts_start_ns"), F.lit(0)))
    return F.when(~has(S.QUEUED) & ~has(S.BLOCKING), took)


def blocking_redis() -> Column:
    took = seconds(F.greatest(F.col("ts_complete_ns") - F.col("ts_start_ns"), F.lit(0)))
    return F.when(has(S.BLOCKING) & ~has(S.QUEUED), took)


def outcome() -> Column:
    """First match wins: canceled, aborted, error, ok."""
    return (
        F.when(F.col("kind") == "cancel", "canceled").when(has(S.ABORTED), "aborted").when(has(S.ERROR), "error").otherwise("ok")
    )


def status_class(code: Column) -> Column:
    return F.when(code.between(100, 599), F.concat(F.floor(code / 100).cast("string"), F.lit("xx"))).otherwise(S.OTHER)


def http_error_flags(code: Column) -> Column:
    return F.when(code >= 500, S.ERROR).when(code >= 400, S.CLIENT_ERR).otherwise(0)


def http_error_label(code: Column) -> Column:
    """Both server and client errors count by exact code."""
    return F.when(code >= 400, code.cast("string"))


def s3_error_label() -> Column:
    failed = has(S.ERROR) | has(S.CLIENT_ERR)
    return F.when(failed, F.coalesce(F.nullif("err_name", F.lit("")), F.col("err_code").cast("string")))


# Operations that move object data.
S3_DATA_OPS = ("GetObject", "PutObject", "UploadPart", "CompleteMultipartUpload")


def size_eligible(data_ops: tuple[str, ...] = S3_DATA_OPS) -> Column:
    """Whether the observation's size enters a size histogram, by protocol."""
    http = ~has(S.BODY_UNSEEN)
    # The operation of an S3 request is its route; op is the method.
    s3 = http & (F.col("obj_bytes") > 0) & (F.col("err_code") < 400) & F.col("route").isin(*data_ops)
    redis = (F.col("bytes_out") > 0) & ~has(S.QUEUED)
    proto = F.col("proto")
    return F.coalesce(F.when(proto == "http", http).when(proto == "s3", s3).when(proto == "redis", redis), F.lit(False))


def object_size(decoded: Column, bytes_in: Column, bytes_out: Column) -> Column:
    return F.coalesce(F.nullif(decoded, F.lit(0)), F.nullif(bytes_in, F.lit(0)), bytes_out)


def force_other() -> Column:
    """Whether the observation has no identity of its own: no text, a cancel request, or no route."""
    db = F.col("proto").isin("pg", "mysql")
    nameless = F.when(db, F.col("text").isNull()).otherwise(F.col("route").isNull())
    return has(S.NO_TEXT) | (F.col("kind") == "cancel") | nameless


def clip_label(label: Column, limit: int = 255) -> Column:
    """The first `limit` bytes of a label, never cutting a character: Catalyst only.

    Of the first `limit` characters, the longest prefix that fits. Labels that fit, and ASCII ones, take the fast branches.
    """
    short = F.substring(label, 1, limit)
    fits = F.aggregate(
        F.split(short, ""),
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("k"), F.lit(False).alias("full")),
        lambda a, c: F.when(a["full"] | (a["n"] + F.octet_length(c) > limit), F.struct(a["n"].alias("n"), a["k"].alias("k"), F.lit(True).alias("full")))
        .otherwise(F.struct((a["n"] + F.octet_length(c)).alias("n"), (a["k"] + F.length(c)).alias("k"), F.lit(False).alias("full"))),
        lambda a: a["k"],
    )
    return F.when(F.octet_length(label) <= limit, label).when(F.octet_length(short) <= limit, short).otherwise(F.substring(label, F.lit(1), fits))


def wall_ns(mono: Column, offset_ns: Column) -> Column:
    return mono + offset_ns


def reduce_observations(obs: DataFrame) -> DataFrame:
    """The measured columns of every observation, by protocol; INTERNAL ones keep only their count."""
    proto = F.col("proto")
    http, redis = proto.isin("http", "s3"), proto == "redis"
    timed = ~F.col("outcome").isin("aborted", "canceled")
    return (
        obs.withColumn("internal", (proto == "s3") & has(S.INTERNAL))
        .withColumn("outcome", F.when(http, status_class(F.col("err_code"))).otherwise(outcome()))
        .withColumn("dur_s", F.when(http, duration_http()).when(redis, duration_redis()).when(timed, duration_db()))
        .withColumn("first_s", F.when(http, first_byte_http()).when(~redis & timed & (F.col("ts_first_row_ns") > F.col("ts_start_ns")), seconds(F.col("ts_first_row_ns") - F.col("ts_start_ns"))))
        .withColumn("upload_s", F.when(http, upload_http()))
        .withColumn("blocking_s", F.when(redis, blocking_redis()))
        .withColumn("error", F.when(proto == "s3", s3_error_label()).when(proto == "http", http_error_label(F.col("err_code"))).when(redis, F.when(has(S.ERROR), F.col("err_name"))).otherwise(F.when(has(S.ERROR), F.col("sqlstate"))))
        .withColumn("sized", size_eligible())
        .withColumn("force_other", force_other())
    )
