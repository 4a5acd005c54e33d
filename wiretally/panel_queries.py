"""Registered queries of every dashboard panel, over a scrape table made of the observations.

A metric is described once for both sides: its labels, what a scrape adds to each series, and which rows count. The SQL
starts from these increments, not from the scrape table, so it shares no step with the functions that are checked.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wiretally import schema as S
from wiretally.operators import hist
from wiretally.plans import panels, promql
from wiretally.queries import RED, query, red, rounded

WINDOW_S, STEP_S = 21600, 7200


@dataclass(frozen=True)
class Metric:
    """labels: name -> expression that both engines read; value: an aggregate; where: a condition."""

    labels: dict[str, str]
    value: str
    where: str = "TRUE"


DB, WEB = "proto IN ('pg', 'mysql')", "proto NOT IN ('pg', 'mysql')"
#: Counters by name. A histogram stands for its _sum and _count; its buckets follow from `timed`.
COUNTERS = {
    "queries_total": Metric({"proto": "proto", "code": "outcome"}, "count(*)", DB),
    "requests_total": Metric({"slot": "slot", "db": "db", "code": "CASE WHEN outcome = '5xx' OR outcome = 'error' THEN '5xx' ELSE outcome END"}, "count(*)", WEB),
    "errors_total": Metric({"error": "error"}, "count(*)", "error IS NOT NULL"),
    "rows_total": Metric({"slot": "slot"}, "sum(rows)", DB),
    "bytes_total": Metric({"slot": "slot", "direction": "CASE WHEN conn % 2 = 0 THEN 'in' ELSE 'out' END"}, "sum(bytes_out)", WEB),
    "blind_total": Metric({"reason": "CASE WHEN conn % 3 = 0 THEN 'h2' ELSE 'upgrade' END"}, "count(*)", "conn % 5 = 0"),
    "events_total": Metric({"proto": "proto"}, "count(*)"),
    "lost_events_total": Metric({"proto": "proto"}, "count(*)", "seq % 97 = 0"),
    "resyncs_total": Metric({"proto": "proto"}, "count(*)", "seq % 89 = 0"),
    "process_cpu_seconds_total": Metric({"job": "'one'"}, "sum(k)"),
    "event_seconds_sum": Metric({"job": "'one'"}, "sum(rows)"),
    "event_seconds_count": Metric({"job": "'one'"}, "count(*)"),
    "duration_seconds_sum": Metric({"slot": "slot", "code": "outcome"}, "sum(k)", f"{DB} AND dur_s IS NOT NULL"),
    "duration_seconds_count": Metric({"slot": "slot", "code": "outcome"}, "count(*)", f"{DB} AND dur_s IS NOT NULL"),
}
#: Histograms: labels, the measured column and its condition.
HISTOGRAMS = {
    "duration_seconds": Metric({"slot": "slot", "code": "outcome"}, "dur_s", f"{DB} AND dur_s IS NOT NULL"),
    "txn_seconds": Metric({"status": "CASE WHEN flags & 64 <> 0 THEN 'aborted' ELSE 'ok' END"}, "dur_s", "dur_s IS NOT NULL"),
    "ttfb_seconds": Metric({"db": "db"}, "first_s", "proto = 'http' AND first_s IS NOT NULL"),
    "upload_seconds": Metric({"db": "db"}, "upload_s", "upload_s IS NOT NULL"),
}
GAUGES = {"connections": Metric({"proto": "proto"}, "count(DISTINCT conn)"), "series": Metric({"proto": "proto"}, "count(DISTINCT slot)")}


def scrapes(spark, sf) -> DataFrame:
    """ts, name, labels, value: cumulative counters and buckets by hour, and gauges."""
    r = red(spark, sf).withColumn("ts", (F.floor(F.col("ts_start_ns") / 3_600_000_000_000) + 1) * 3600)

    def rows(name: str, m: Metric, values: dict, cumulative: bool = True) -> DataFrame:
        """One row for each of values: extra labels -> aggregate."""
        keys = [F.expr(x).alias(f"_{k}") for k, x in m.labels.items()]
        per = r.where(m.where).groupBy("ts", *keys).agg(*(v.cast("double").alias(f"v{i}") for i, v in enumerate(values.values())))
        tags = [x for k in m.labels for x in (F.lit(k), F.col(f"_{k}").cast("string"))]
        each = [F.struct(F.create_map(*tags, *(F.lit(x) for kv in extra for x in kv)).alias("labels"), F.col(f"v{i}").alias("value")) for i, extra in enumerate(values)]
        out = per.select("ts", F.lit(f"{S.PREFIX}_{name}").alias("name"), F.inline(F.array(*each)))
        if cumulative:
            w = Window.partitionBy("name", promql.series_key()).orderBy("ts")
            out = out.withColumn("value", F.sum("value").over(w))
        return out

    parts = [rows(n, m, {(): F.expr(m.value)}) for n, m in COUNTERS.items()]
    parts += [rows(n, m, {(): F.expr(m.value)}, False) for n, m in GAUGES.items()]
    for n, m in HISTOGRAMS.items():
        values = {(("le", repr(2.0**j)),): F.count_if(F.col(m.value) < 2.0**j) for j in hist.CLASSIC}
        parts.append(rows(f"{n}_bucket", m, values | {(("le", "+Inf"),): F.count("*")}))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


HOURS = f"{RED}, h AS (SELECT *, (ts_start_ns // 3600000000000 + 1) * 3600 AS ts FROM slots)"


def rate_sql(metric: str, where: str = "TRUE") -> str:
    """at, labels, rate of a counter: what scrapes add after the first of a series, by window."""
    m = COUNTERS[metric]
    keys = ", ".join(m.labels)
    named = ", ".join(f"{x} AS {k}" for k, x in m.labels.items())
    return f"""(SELECT ((ts - 1) // {WINDOW_S} + 1) * {WINDOW_S} AS "at", {keys}, sum(v) / {WINDOW_S} AS rate FROM (
        SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY ts) AS i FROM (SELECT ts, {keys}, {m.value} AS v FROM (SELECT * EXCLUDE ({', '.join(c for c in m.labels if c in ('proto', 'slot', 'db', 'error'))}), {named} FROM h WHERE {m.where}) GROUP BY ts, {keys})
    ) WHERE i > 1 AND {where} GROUP BY ALL)""".replace("* EXCLUDE ()", "*")


def total_sql(metric: str, by: str = "", where: str = "TRUE") -> str:
    keys = f", {by}" if by else ""
    return f'SELECT "at"{keys}, sum(rate) AS value FROM {rate_sql(metric, where)} GROUP BY "at"{keys}'


def share_sql(part: str, whole: str, least: float) -> str:
    return f'SELECT b."at", coalesce(a.value, 0) / greatest(b.value, {least}) AS value FROM ({part}) a RIGHT JOIN ({whole}) b ON a."at" = b."at"'


def top_sql(panel: str, k: int, value: str, tie: str) -> str:
    return f'SELECT *, CAST(row_number() OVER (PARTITION BY "at" ORDER BY {value} DESC, {tie}) AS INTEGER) AS rank FROM (SELECT * REPLACE (round({value}, 9) AS {value}) FROM ({panel})) QUALIFY rank <= {k}'


def quantile_sql(metric: str, phi: float, by: str = "") -> str:
    m = HISTOGRAMS[metric]
    keys = ", ".join(m.labels)
    named = ", ".join(f"{x} AS l_{k}" for k, x in m.labels.items())
    mine = ", ".join(f"l_{k}" for k in m.labels)
    group = f", {by}" if by else ""
    part = f'PARTITION BY "at"{group}'
    return f"""SELECT "at"{group}, quantile FROM (
        SELECT "at"{group}, arg_min(CASE WHEN isinf(le) OR n = below THEN low ELSE low + (le - low) * (rank - below) / (n - below) END, le) FILTER (WHERE n >= rank AND n > 0) AS quantile FROM (
            SELECT *, coalesce(lag(n) OVER v, 0) AS below, coalesce(lag(le) OVER v, 0) AS low, max(n) OVER ({part}) * {phi} AS rank FROM (
                SELECT "at"{group}, le, sum(c) / {WINDOW_S} AS n FROM (
                    SELECT ((ts - 1) // {WINDOW_S} + 1) * {WINDOW_S} AS "at", {', '.join(f'l_{k} AS {k}' for k in m.labels)}, le, c FROM (
                        SELECT *, dense_rank() OVER (PARTITION BY {mine} ORDER BY ts) AS i FROM (
                            SELECT ts, {mine}, le, count(*) FILTER (WHERE x < le) AS c FROM (SELECT ts, {m.value} AS x, {named} FROM h WHERE {m.where}),
                                (SELECT pow(2.0, j) AS le FROM range(-13, 6) r(j) UNION ALL SELECT 'inf'::DOUBLE) GROUP BY ts, {mine}, le
                        )) WHERE i > 1) GROUP BY "at"{group}, le) WINDOW v AS ({part} ORDER BY le))
        GROUP BY "at"{group})"""


def gauge_sql(metric: str) -> str:
    m = GAUGES[metric]
    return f"SELECT CAST(sum(v) AS DOUBLE) AS value FROM (SELECT proto, arg_max(v, ts) AS v FROM (SELECT ts, proto, {m.value} AS v FROM h GROUP BY ts, proto) GROUP BY proto)"


CALLS, ALL = "duration_seconds_count", "requests_total"
PANEL_SQL = {
    "overview_qps": total_sql("queries_total"),
    "overview_p50": quantile_sql("duration_seconds", 0.5),
    "overview_p95": quantile_sql("duration_seconds", 0.95),
    "overview_p99": quantile_sql("duration_seconds", 0.99),
    "overview_error_rate": share_sql(total_sql("queries_total", where="code = 'error'"), total_sql("queries_total"), 1),
    "overview_connections": gauge_sql("connections"),
    "overview_throughput": total_sql("rows_total"),
    "overview_errors_by_state": total_sql("errors_total", "error"),
    "overview_txn_p95": quantile_sql("txn_seconds", 0.95, "status"),
    "overview_capture_degraded": f'SELECT "at", sum(value) AS value FROM ({total_sql("lost_events_total")} UNION ALL {total_sql("resyncs_total")}) GROUP BY "at" HAVING sum(value) > 0',
    "queries_top_p99": top_sql(quantile_sql("duration_seconds", 0.99, "slot"), 10, "quantile", "slot"),
    "queries_top_total_time": top_sql(total_sql("duration_seconds_sum", "slot"), 10, "value", "slot"),
    "queries_top_frequency": top_sql(total_sql(CALLS, "slot"), 10, "value", "slot"),
    "queries_top_errors": top_sql(total_sql(CALLS, "slot", "code = 'error'"), 10, "value", "slot"),
    "http_rps": total_sql(ALL),
    "http_5xx_share": share_sql(total_sql(ALL, where="code = '5xx'"), total_sql(ALL), 0.001),
    "http_by_status": total_sql(ALL, "code"),
    "http_ttfb_p95": quantile_sql("ttfb_seconds", 0.95),
    "http_upload_p95": quantile_sql("upload_seconds", 0.95),
    "http_bytes": total_sql("bytes_total", "direction"),
    "http_top_hosts": top_sql(total_sql(ALL, "db"), 5, "value", "db"),
    "http_other_share": share_sql(total_sql(ALL, where="slot = 'other'"), total_sql(ALL), 0.001),
    "http_blind_zones": total_sql("blind_total", "reason"),
    "health_events": total_sql("events_total"),
    "health_lost": f"SELECT coalesce(sum(value), 0.0) AS value FROM ({total_sql('lost_events_total')})",
    "health_series": gauge_sql("series"),
    "health_cpu": total_sql("process_cpu_seconds_total"),
    "health_cost_per_event": f'SELECT a."at", a.value / b.value AS mean FROM ({total_sql("event_seconds_sum")}) a JOIN ({total_sql("event_seconds_count")}) b USING ("at")',
}


def _panel(name: str) -> None:
    panel = panels.PANELS[name]
    value = "quantile" if "quantile" in PANEL_SQL[name].split("FROM")[0] or name == "queries_top_p99" else "mean" if name.endswith("per_event") else "value"

    def run(spark, sf):
        t = scrapes(spark, sf)
        if name.startswith("queries_top") or name.startswith("http_top"):
            # Ranks go by rounded values, as floating sums differ in their last bits.
            inner = panels.UNRANKED[name](t, WINDOW_S)
            k, tie = (5, "db") if name == "http_top_hosts" else (10, "slot")
            return panels.top(rounded(inner, value), k, value, tie)
        return rounded(panel(t, WINDOW_S), value)

    run.__name__ = f"panel_{name}"
    query(f"{HOURS} SELECT * REPLACE (round({value}, 9) AS {value}) FROM ({PANEL_SQL[name]})")(run)


for _name in PANEL_SQL:
    _panel(_name)


@query(f"""{HOURS}, inc AS (SELECT ts, proto, v FROM (SELECT *, row_number() OVER (PARTITION BY proto ORDER BY ts) AS i FROM (SELECT ts, proto, count(*) AS v FROM h GROUP BY ts, proto)) WHERE i > 1),
    steps AS (SELECT CAST(unnest(range((SELECT min(ts) // {STEP_S} FROM inc), (SELECT (max(ts) + {WINDOW_S}) // {STEP_S} + 1 FROM inc))) * {STEP_S} AS BIGINT) AS "at")
    SELECT "at", proto, round(sum(v) / {WINDOW_S}, 9) AS rate FROM steps JOIN inc ON ts <= "at" AND ts > "at" - {WINDOW_S} GROUP BY "at", proto""")
def pql1_sliding_rate(spark, sf):
    """Windows that overlap: a step of a third of the window."""
    r = promql.rate(promql.select(scrapes(spark, sf), f"{S.PREFIX}_events_total"), WINDOW_S, STEP_S)
    return rounded(r.select("at", promql.label("proto").alias("proto"), "rate"), "rate")


@query(f"""{HOURS} SELECT "at", round(max(rate), 9) AS value FROM {rate_sql("events_total")} GROUP BY "at" """)
def pql2_max_by(spark, sf):
    return rounded(promql.max_by(promql.rate(promql.select(scrapes(spark, sf), f"{S.PREFIX}_events_total"), WINDOW_S), "rate"), "value")
