"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [HERE, os.environ.get("PYTHONPATH", "")]))

HEADLINES = [
    "pql4_top_p99", "agg1_queries_total", "agg2_latency_histogram", "agg10_errors_total", "agg12_sizes_http", "car4_dim_cap",
    "fn1_norm_sql", "fn1_norm_sql_simple", "fn3_route_templates", "pql1_rate", "str25_transaction_islands",
    "str1_str19_str20_redis_units", "str15_str16_str17_http_units", "olap1_tree_revenue", "olap9_monthly_rank", "e2e_redis_metrics",
    "panel_overview_p95",
]


def rates(spark, sf: str, seconds: dict[str, float], copies: int = 20) -> dict[str, int]:
    """Observations a second over a materialised table of `copies` times the events: the latency histogram alone, and with
    statements normalised exactly before it; and from raw bytes to the histogram, over Redis traffic on `conns` times the
    connections."""
    import shutil
    import tempfile

    from pyspark.sql import functions as F

    from wiretally.operators import hist, identity, reduce
    from wiretally.plans import adapters, wire
    from wiretally.streaming import observe

    folder = tempfile.mkdtemp(prefix="wiretally-bench-")
    try:
        rep = spark.range(copies).select(F.col("id").alias("rep"))
        adapters.observations(spark, sf).crossJoin(rep).drop("rep").repartition(16).write.mode("overwrite").parquet(f"{folder}/obs")
        obs = spark.read.parquet(f"{folder}/obs")
        n = obs.count()
        red = reduce.reduce_observations(obs)
        named = identity.with_slot(red)
        conns = 5
        raw = wire.redis_events(spark, sf).crossJoin(spark.range(conns).select(F.col("id").alias("rep")))
        raw.withColumn("conn_id", F.col("conn_id") * conns + F.col("rep")).drop("rep").repartition(16).write.mode("overwrite").parquet(f"{folder}/raw")
        raw = spark.read.parquet(f"{folder}/raw")
        parsed = identity.with_slot(reduce.reduce_observations(observe.observations(observe.parse(raw, default="redis"))))
        sizes = {"throughput_bytes_to_histogram": raw.where("dir = 1 AND type = 0").count()}
        plans = {
            "throughput_agg2": hist.latency_cells(red, "dur_s", "db", "user", "proto", "outcome"),
            "throughput_agg2_normalised": hist.latency_cells(named, "dur_s", "slot", "db", "user", "proto"),
            "throughput_bytes_to_histogram": hist.latency_cells(parsed, "dur_s", "slot", "db", "user", "proto"),
        }
        out = {}
        for name, plan in plans.items():
            best = float("inf")
            for _ in range(3):
                began = time.perf_counter()
                plan.write.format("noop").mode("overwrite").save()
                best = min(best, time.perf_counter() - began)
            seconds[name] = round(best, 3)
            out[name] = round(sizes.get(name, n) / best)
        return out
    finally:
        shutil.rmtree(folder, ignore_errors=True)


def main() -> None:
    from wiretally.queries import QUERIES
    from wiretally.session import local_session

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}
    for name in HEADLINES:
        best = float("inf")
        for _ in range(2):  # the first run compiles
            began = time.perf_counter()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - began)
        seconds[name] = round(best, 3)
    throughput = rates(spark, sf, seconds)
    print(
        json.dumps(
            {
                "metric": "headline queries, sum of the better of two runs", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
                "sf": sf.rsplit("sf", 1)[-1], "cpus": cpus, "observations_per_second": throughput,
            }
        )
    )


if __name__ == "__main__":
    main()
