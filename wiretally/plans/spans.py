"""Sampling and building of spans from observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wiretally import schema as S
from wiretally.operators.reduce import has

SLOW_S = 1.0


def hash_below(ratio: float, seed: int, *columns: str) -> Column:
    """Whether the row's hash, as an unsigned 64-bit number, is below ratio * 2**64."""
    h = F.xxhash64(*columns, F.lit(seed))
    limit = int(ratio * 2**64) - 2**63
    if limit >= 2**63:
        return F.lit(True)
    # Shifted to signed: flipping the top bit keeps the unsigned order.
    return h.bitwiseXOR(F.lit(-(2**63))) < F.lit(limit)


def should_sample(ratio: float, slow_s: float = SLOW_S, seed: int = 0) -> Column:
    """Needs an end after the start; slow ones always (blocking waits aside); then an inherited decision; then the ratio."""
    start = F.when(F.col("proto").isin("http", "s3"), F.coalesce("ts_req_done_ns", "ts_start_ns")).otherwise(F.col("ts_start_ns"))
    valid = F.coalesce(F.col("ts_complete_ns") > F.col("ts_start_ns"), F.lit(False))
    slow = ((F.col("ts_complete_ns") - start) >= int(slow_s * 1e9)) & ~has(S.BLOCKING)
    chosen = F.lit(True) if ratio >= 1 else hash_below(ratio, seed, "ts_start_ns", "conn")
    inherited = F.col("trace_flags")
    return F.when(~valid, False).when(slow, True).when(inherited.isNotNull(), inherited.bitwiseAND(1) == 1).otherwise(chosen)


def trace_ids(seed: int = 0) -> tuple[Column, Column]:
    """Deterministic trace and span id of an observation without an inherited trace."""
    digest = F.sha2(F.concat_ws("/", F.lit(str(seed)), F.col("conn").cast("string"), F.col("ts_start_ns").cast("string")), 256)
    return F.substring(digest, 1, 32), F.substring(digest, 33, 16)


def build_spans(obs: DataFrame, seed: int = 0, masked: bool = True, text_max: int = 4096) -> DataFrame:
    """Spans of sampled observations: ids, name, kind, times and attributes; the text masked to its label unless asked."""
    trace, span = trace_ids(seed)
    db = F.col("proto").isin("pg", "mysql")
    name = F.when(db, F.substring("label", 1, 63)).when(F.col("proto") == "redis", F.col("route")).otherwise(F.concat_ws(" ", "op", "route"))
    system = F.create_map(*(F.lit(x) for x in ("pg", "postgresql", "mysql", "mysql", "redis", "redis")))
    text = F.col("label") if masked else F.col("text")
    attributes = F.when(
        F.col("proto").isin("http", "s3"),
        F.create_map(F.lit("http.request.method"), F.col("op"), F.lit("http.route"), F.col("route"), F.lit("http.response.status_code"), F.col("err_code").cast("string")),
    ).otherwise(
        F.create_map(F.lit("db.system"), system[F.col("proto")], F.lit("db.namespace"), F.col("db"), F.lit("db.user"), F.col("user"), F.lit("db.query.text"), F.substring(text, 1, text_max))
    )
    return obs.select(
        F.coalesce("trace_id", trace).alias("trace_id"),
        span.alias("span_id"),
        F.col("parent_id"),
        name.alias("name"),
        F.when(F.col("proto").isin("http", "s3"), "server").otherwise("client").alias("kind"),
        F.col("ts_start_ns").alias("start_ns"),
        F.col("ts_complete_ns").alias("end_ns"),
        F.map_filter(attributes, lambda k, v: v.isNotNull()).alias("attributes"),
        has(S.ERROR).alias("error"),
    )
