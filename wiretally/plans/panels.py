"""Dashboard panels as named queries over a scrape table: (ts, name, labels, value).

Names and labels are those of our own exposition; each panel is a short composition of promql functions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wiretally import schema as S
from wiretally.plans import promql as P

M = S.PREFIX
WINDOW_S = 300


def rate(t: DataFrame, metric: str, window_s: int = WINDOW_S, **matchers: str) -> DataFrame:
    return P.rate(P.select(t, f"{M}_{metric}", **matchers), window_s)


def total(t: DataFrame, metric: str, *by: str, window_s: int = WINDOW_S, **matchers: str) -> DataFrame:
    return P.sum_by(rate(t, metric, window_s, **matchers), "rate", *by)


def quantile(t: DataFrame, metric: str, phi: float, *by: str, window_s: int = WINDOW_S, **matchers: str) -> DataFrame:
    return P.histogram_quantile(rate(t, f"{metric}_bucket", window_s, **matchers), phi, *by)


def share(t: DataFrame, part: DataFrame, whole: DataFrame, least: float) -> DataFrame:
    """part / clamp_min(whole, least) at each time."""
    a, b = part.withColumnRenamed("value", "a"), whole.withColumnRenamed("value", "b")
    return a.join(b, "at", "right").select("at", P.ratio(F.coalesce("a", F.lit(0.0)), F.col("b"), least).alias("value"))


def top(panel: DataFrame, k: int, value: str, *ties: str) -> DataFrame:
    """topk at each time."""
    from wiretally.operators.ordering import top_by

    return top_by(panel, k, value, ("at",), *ties)


def mean(t: DataFrame, metric: str, *by: str, window_s: int = WINDOW_S) -> DataFrame:
    return P.mean_rate(rate(t, f"{metric}_sum", window_s), rate(t, f"{metric}_count", window_s), *by)


def gauge(t: DataFrame, metric: str) -> DataFrame:
    return P.instant(P.select(t, f"{M}_{metric}")).agg(F.sum("value").alias("value"))


def degraded(t: DataFrame, window_s: int = WINDOW_S) -> DataFrame:
    """Times at which events were lost or connections resynced: the annotation."""
    lost = rate(t, "lost_events_total", window_s).unionByName(rate(t, "resyncs_total", window_s))
    return P.sum_by(lost, "rate").where("value > 0")


Panel = Callable[[DataFrame, int], DataFrame]

#: What the panels that show the first few rank.
UNRANKED: dict[str, Panel] = {
    "queries_top_p99": lambda t, w=WINDOW_S: quantile(t, "duration_seconds", 0.99, "slot", window_s=w),
    "queries_top_total_time": lambda t, w=WINDOW_S: total(t, "duration_seconds_sum", "slot", window_s=w),
    "queries_top_frequency": lambda t, w=WINDOW_S: total(t, "duration_seconds_count", "slot", window_s=w),
    "queries_top_errors": lambda t, w=WINDOW_S: total(t, "duration_seconds_count", "slot", code="error", window_s=w),
    "http_top_hosts": lambda t, w=WINDOW_S: total(t, "requests_total", "db", window_s=w),
}

#: Every panel by the board and name; all take the scrape table and the window of their rates.
PANELS: dict[str, Panel] = {
    # overview
    "overview_qps": lambda t, w=WINDOW_S: total(t, "queries_total", window_s=w),
    "overview_p50": lambda t, w=WINDOW_S: quantile(t, "duration_seconds", 0.50, window_s=w),
    "overview_p95": lambda t, w=WINDOW_S: quantile(t, "duration_seconds", 0.95, window_s=w),
    "overview_p99": lambda t, w=WINDOW_S: quantile(t, "duration_seconds", 0.99, window_s=w),
    "overview_error_rate": lambda t, w=WINDOW_S: share(t, total(t, "queries_total", code="error", window_s=w), total(t, "queries_total", window_s=w), 1),
    "overview_connections": lambda t, w=WINDOW_S: gauge(t, "connections"),
    "overview_throughput": lambda t, w=WINDOW_S: total(t, "rows_total", window_s=w),
    "overview_errors_by_state": lambda t, w=WINDOW_S: total(t, "errors_total", "error", window_s=w),
    "overview_txn_p95": lambda t, w=WINDOW_S: quantile(t, "txn_seconds", 0.95, "status", window_s=w),
    "overview_capture_degraded": degraded,
    # queries
    "queries_top_p99": lambda t, w=WINDOW_S: top(UNRANKED["queries_top_p99"](t, w), 10, "quantile", "slot"),
    "queries_top_total_time": lambda t, w=WINDOW_S: top(UNRANKED["queries_top_total_time"](t, w), 10, "value", "slot"),
    "queries_top_frequency": lambda t, w=WINDOW_S: top(UNRANKED["queries_top_frequency"](t, w), 10, "value", "slot"),
    "queries_top_errors": lambda t, w=WINDOW_S: top(UNRANKED["queries_top_errors"](t, w), 10, "value", "slot"),
    # http
    "http_rps": lambda t, w=WINDOW_S: total(t, "requests_total", window_s=w),
    "http_5xx_share": lambda t, w=WINDOW_S: share(t, total(t, "requests_total", code="5xx", window_s=w), total(t, "requests_total", window_s=w), 0.001),
    "http_by_status": lambda t, w=WINDOW_S: total(t, "requests_total", "code", window_s=w),
    "http_ttfb_p95": lambda t, w=WINDOW_S: quantile(t, "ttfb_seconds", 0.95, window_s=w),
    "http_upload_p95": lambda t, w=WINDOW_S: quantile(t, "upload_seconds", 0.95, window_s=w),
    "http_bytes": lambda t, w=WINDOW_S: total(t, "bytes_total", "direction", window_s=w),
    "http_top_hosts": lambda t, w=WINDOW_S: top(UNRANKED["http_top_hosts"](t, w), 5, "value", "db"),
    "http_other_share": lambda t, w=WINDOW_S: share(t, total(t, "requests_total", slot="other", window_s=w), total(t, "requests_total", window_s=w), 0.001),
    "http_blind_zones": lambda t, w=WINDOW_S: total(t, "blind_total", "reason", window_s=w),
    # health
    "health_events": lambda t, w=WINDOW_S: total(t, "events_total", window_s=w),
    "health_lost": lambda t, w=WINDOW_S: P.or_zero(total(t, "lost_events_total", window_s=w)),
    "health_series": lambda t, w=WINDOW_S: gauge(t, "series"),
    "health_cpu": lambda t, w=WINDOW_S: total(t, "process_cpu_seconds_total", window_s=w),
    "health_cost_per_event": lambda t, w=WINDOW_S: mean(t, "event_seconds", window_s=w),
}


def drilldown(t: DataFrame, slot: str) -> dict[str, DataFrame]:
    """The panels of one statement, chosen by an anchored pattern of its label. As on the board that these follow, the error
    rate has no statement among its labels and is that of all."""
    m = {"slot": f"~{slot}"}
    calls = total(t, "duration_seconds_count", **m)
    return {
        "qps": calls,
        "rows_per_query": share(t, total(t, "rows_total", **m), calls, 0.001),
        "error_rate": share(t, total(t, "errors_total"), total(t, "queries_total"), 1),
        "p95": quantile(t, "duration_seconds", 0.95, **m),
        "first_row_p95": quantile(t, "first_row_seconds", 0.95, **m),
        "rows": total(t, "rows_total", **m),
    }


def variables(t: DataFrame, metric: str, label: str) -> DataFrame:
    return P.label_values(t, f"{M}_{metric}", label)
