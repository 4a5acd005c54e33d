"""Exposition: metric rows as text, as protobuf messages and as JSON; and the batch sinks."""

from __future__ import annotations

import struct
import time
import urllib.error
import urllib.request

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wiretally import schema as S
from wiretally.functions.url import label_escape
from wiretally.operators import hist


def label_text(keys: tuple[str, ...]) -> Column:
    """{k="v",...} of columns, escaped; empty braces are left out."""
    parts = [F.concat(F.lit(f'{k}="'), label_escape(F.col(k).cast("string")), F.lit('"')) for k in keys]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")) if parts else F.lit("")


def number(v: Column) -> Column:
    """Whole numbers without a point, others in full."""
    whole = (v == F.floor(v)) & (F.abs(v) < 1e15)
    return F.when(v == float("inf"), "+Inf").when(whole, v.cast("long").cast("string")).otherwise(v.cast("string"))


def counter_lines(rows: DataFrame, name: str, help_text: str, *labels: str) -> DataFrame:
    """family, ord, line of a counter or gauge family; ord puts the two comment lines first and samples in label order."""
    samples = rows.select(
        F.lit(name).alias("family"), F.concat_ws("\x01", *labels).alias("ord"), F.concat(F.lit(name), label_text(labels), F.lit(" "), number(F.col("value").cast("double"))).alias("line")
    )
    return head_lines(rows, name, help_text, "counter").unionByName(samples)


def head_lines(rows: DataFrame, name: str, help_text: str, kind: str) -> DataFrame:
    head = [(name, "", f"# HELP {name} {help_text}\n# TYPE {name} {kind}")]
    return rows.sparkSession.createDataFrame(head, "family string, ord string, line string")


def histogram_lines(cells: DataFrame, name: str, help_text: str, *labels: str) -> DataFrame:
    """Classic buckets, sum and count; a series without observations prints nothing."""
    cum = hist.classic_cumulative(cells, *labels)
    le = F.when(F.col("j").isNull(), "+Inf").otherwise(number(F.col("le")))
    text = F.concat(F.lit(f"{name}_bucket{{"), F.concat_ws(",", *(F.concat(F.lit(f'{k}="'), label_escape(F.col(k)), F.lit('"')) for k in labels), F.concat(F.lit('le="'), le, F.lit('"'))), F.lit("} "), F.col("cumulative").cast("string"))
    place = F.concat_ws("\x01", *labels, F.format_string("%03d", F.coalesce(F.col("j") + 100, F.lit(200))))
    buckets = cum.select(F.lit(name).alias("family"), place.alias("ord"), text.alias("line"))
    totals = cells.groupBy(*labels).agg(F.sum("sum").alias("s"), F.sum("n").alias("c"))
    at = lambda tail: F.concat_ws("\x01", *labels, F.lit(tail))
    sums = totals.select(F.lit(name).alias("family"), at("300").alias("ord"), F.concat(F.lit(f"{name}_sum"), label_text(labels), F.lit(" "), number(F.col("s"))).alias("line"))
    counts = totals.select(F.lit(name).alias("family"), at("301").alias("ord"), F.concat(F.lit(f"{name}_count"), label_text(labels), F.lit(" "), F.col("c").cast("string")).alias("line"))
    return head_lines(cells, name, help_text, "histogram").unionByName(buckets).unionByName(sums).unionByName(counts)


def write_text(lines: DataFrame, path: str) -> None:
    """The whole exposition in order, as text files whose names ascend: each is a range of the order."""
    lines.orderBy("family", "ord").select("line").write.mode("overwrite").text(path)


def long_format(rows: DataFrame, name: str, kind: str, *labels: str) -> DataFrame:
    """schema.METRIC rows of a family."""
    pairs = [x for k in labels for x in (F.lit(k), F.col(k).cast("string"))]
    tags = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    return rows.select(F.lit(name).alias("name"), F.lit(kind).alias("type"), tags.alias("labels"), F.col("value").cast("double").alias("value"))


def debug_lines(obs: DataFrame) -> DataFrame:
    """Observations as printed lines."""
    return obs.select(
        F.format_string(
            "%s conn=%d method=%s status=%d dur=%dns in=%d out=%d db=%s user=%s flags=0x%x route=%s",
            "proto", "conn", F.coalesce("op", F.lit("-")), F.coalesce(F.col("err_code").cast("long"), F.lit(0)), F.col("ts_complete_ns") - F.col("ts_start_ns"),
            "bytes_in", "bytes_out", "db", "user", "flags", F.coalesce("route", F.lit("-")),
        ).alias("line")
    )


# Protobuf primitives: fields of a message as bytes.


def varint(x: int) -> bytes:
    x &= (1 << 64) - 1
    out = bytearray()
    while x > 0x7F:
        out.append(x & 0x7F | 0x80)
        x >>= 7
    out.append(x)
    return bytes(out)


def zigzag(x: int) -> bytes:
    return varint(x << 1 ^ x >> 63)


def tag(field: int, wire: int) -> bytes:
    return varint(field << 3 | wire)


def message(field: int, body: bytes) -> bytes:
    return tag(field, 2) + varint(len(body)) + body


def text(field: int, value: str) -> bytes:
    return message(field, value.encode())


def fixed64(field: int, value: int) -> bytes:
    return tag(field, 1) + struct.pack("<Q", value & (1 << 64) - 1)


def double(field: int, value: float) -> bytes:
    return tag(field, 1) + struct.pack("<d", value)


def attribute(field: int, key: str, value: str | int) -> bytes:
    held = tag(3, 0) + varint(value) if isinstance(value, int) else text(1, value)
    return message(field, text(1, key) + message(2, held))


def number_point(labels: dict[str, str], value: float, now: int, start: int | None = None) -> bytes:
    """A data point of a sum (with a start) or a gauge."""
    body = (fixed64(2, start) if start is not None else b"") + fixed64(3, now) + double(4, value)
    return message(1, body + b"".join(attribute(7, k, v) for k, v in labels.items()))


def exponential_point(labels: dict[str, str], cells: dict[int, int], total: float, now: int, start: int) -> bytes:
    """A latency histogram of scale 2: overflow goes to the top bucket, underflow to the zero count."""
    counts = [cells.get(k, 0) for k in range(hist.LOW, hist.HIGH)]
    counts[-1] += cells.get(hist.OVER, 0)
    body = fixed64(2, start) + fixed64(3, now) + fixed64(4, sum(cells.values())) + double(5, total) + tag(6, 0) + zigzag(2)
    body += fixed64(7, cells.get(hist.UNDER, 0))
    body += message(8, tag(1, 0) + zigzag(hist.LOW) + message(2, b"".join(map(varint, counts))))
    return message(1, body + double(14, hist.bounds()[0]) + b"".join(attribute(1, k, v) for k, v in labels.items()))


def size_point(labels: dict[str, str], cells: dict[int, int], total: float, grid: str, now: int, start: int) -> bytes:
    """A size histogram with explicit bounds."""
    low, n = hist.GRIDS[grid]
    counts = [cells.get(i, 0) for i in range(n + 1)]
    body = fixed64(2, start) + fixed64(3, now) + fixed64(4, sum(counts)) + double(5, total)
    body += message(6, b"".join(struct.pack("<Q", c) for c in counts))
    body += message(7, b"".join(struct.pack("<d", 2.0 ** (low + i)) for i in range(n)))
    return message(1, body + b"".join(attribute(9, k, v) for k, v in labels.items()))


CUMULATIVE = 2


def metric(name: str, help_text: str, kind: str, points: bytes) -> bytes:
    """A Metric message; kind: gauge, sum, histogram or exponential."""
    aggregation = tag(2, 0) + varint(CUMULATIVE)
    held = {"gauge": message(5, points), "sum": message(7, points + aggregation + tag(3, 0) + varint(1)), "histogram": message(9, points + aggregation), "exponential": message(10, points + aggregation)}[kind]
    return text(1, name) + text(2, help_text) + held


def span(row: dict) -> bytes:
    """A Span message of a row of build_spans."""
    kind = {"server": 2, "client": 3}[row["kind"]]
    body = message(1, bytes.fromhex(row["trace_id"])) + message(2, bytes.fromhex(row["span_id"]))
    body += message(4, bytes.fromhex(row["parent_id"])) if row.get("parent_id") else b""
    body += text(5, row["name"] or "") + tag(6, 0) + varint(kind) + fixed64(7, row["start_ns"]) + fixed64(8, row["end_ns"])
    body += b"".join(attribute(9, k, v) for k, v in (row["attributes"] or {}).items())
    return body + (message(15, tag(3, 0) + varint(2)) if row["error"] else b"")


def read(body: bytes) -> dict[int, list]:
    """The fields of a message: number -> values, integers or bytes as they stand."""
    out: dict[int, list] = {}
    at = 0

    def number_at() -> int:
        nonlocal at
        x = shift = 0
        while True:
            byte = body[at]
            at += 1
            x |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return x

    while at < len(body):
        key = number_at()
        wire = key & 7
        if wire == 0:
            value = number_at()
        else:
            n = {1: 8, 5: 4}.get(wire) or number_at()
            value = body[at : at + n]
            at += n
            value = struct.unpack("<Q", value)[0] if wire == 1 else value
        out.setdefault(key >> 3, []).append(value)
    return out


def real(x: int) -> float:
    """A fixed 64-bit field as the double that it is."""
    return struct.unpack("<d", struct.pack("<Q", x))[0]


def attributes(fields: list[bytes]) -> dict[str, str]:
    """Key and text of attribute messages."""
    out = {}
    for f in map(read, fields):
        value = read(f[2][0])
        out[f[1][0].decode()] = value[1][0].decode() if 1 in value else str(value[3][0])
    return out


#: Points of a message at most.
POINTS = 10_000


def encode_counters(rows: DataFrame, now: int, start: int) -> DataFrame:
    """name and message of the metrics of a long-format frame. A receiver merges messages of one name, so each task writes its own
    from the points that it has, at most POINTS in one; no family is gathered."""
    import pandas as pd

    def run(frames):
        for frame in frames:
            out = []
            for (name, kind), part in frame.groupby(["name", "type"], sort=True):
                kind = "sum" if kind == "counter" else "gauge"
                for at in range(0, len(part), POINTS):
                    few = part.iloc[at : at + POINTS]
                    points = b"".join(
                        number_point(dict(zip(k, v, strict=True)), float(x), now, start if kind == "sum" else None)
                        for k, v, x in zip(few["keys"], few["vals"], few["value"], strict=True)
                    )
                    out.append({"name": name, "message": metric(name, "", kind, points)})
            yield pd.DataFrame(out, columns=["name", "message"])

    flat = rows.select("name", "type", F.map_keys("labels").alias("keys"), F.map_values("labels").alias("vals"), "value")
    return flat.mapInPandas(run, "name string, message binary")


def encode_latency(cells: DataFrame, name: str, now: int, start: int, *labels: str) -> DataFrame:
    """One exponential-histogram metric of latency cells: labels of a series and its message."""
    import pandas as pd

    per = cells.groupBy(*labels).agg(F.map_from_entries(F.collect_list(F.struct("bucket", "n"))).alias("cells"), F.sum("sum").alias("total"))

    def run(frames):
        for f in frames:
            points = [
                exponential_point({k: r[k] for k in labels}, dict(r["cells"]), float(r["total"]), now, start) for r in f.to_dict("records")
            ]
            yield pd.DataFrame({**{k: f[k] for k in labels}, "message": [metric(name, "", "exponential", p) for p in points]})

    return per.mapInPandas(run, ", ".join(f"{k} string" for k in labels) + ", message binary")


def encode_sizes(cells: DataFrame, name: str, grid: str, now: int, start: int, *labels: str) -> DataFrame:
    """As encode_latency, for size cells of a grid: explicit bounds."""
    import pandas as pd

    per = cells.groupBy(*labels).agg(F.map_from_entries(F.collect_list(F.struct("cell", "n"))).alias("cells"), F.sum("sum").alias("total"))

    def run(frames):
        for f in frames:
            points = [
                size_point({k: r[k] for k in labels}, dict(r["cells"]), float(r["total"]), grid, now, start) for r in f.to_dict("records")
            ]
            yield pd.DataFrame({**{k: f[k] for k in labels}, "message": [metric(name, "", "histogram", p) for p in points]})

    return per.mapInPandas(run, ", ".join(f"{k} string" for k in labels) + ", message binary")


def encode_spans(spans: DataFrame) -> DataFrame:
    """Spans with their message and as JSON."""

    def run(frames):
        import pandas as pd

        for f in frames:
            yield pd.DataFrame({"span_id": f["span_id"], "message": [span(r) for r in f.to_dict("records")]})

    plain = spans.withColumn("attributes", F.col("attributes"))
    return plain.mapInPandas(run, "span_id string, message binary")


def spans_json(spans: DataFrame) -> DataFrame:
    return spans.select("span_id", F.to_json(F.struct(*spans.columns)).alias("json"))


#: Size of a pushed request, roughly.
REQUEST_BYTES = 1 << 20


class Push:
    """A foreachBatch sink that posts messages; a Retry-After pauses the signal."""

    def __init__(self, url: str, timeout_s: float = 5.0):
        self.url, self.timeout_s = url, timeout_s
        self.ok = self.failed = 0
        self.not_before = 0.0

    def send(self, body: bytes) -> bool:
        if time.monotonic() < self.not_before:
            return False
        request = urllib.request.Request(self.url, body, {"Content-Type": "application/x-protobuf"})
        try:
            with urllib.request.urlopen(request, timeout=self.timeout_s):
                self.ok += 1
                return True
        except urllib.error.HTTPError as e:
            if wait := e.headers.get("Retry-After", ""):
                self.not_before = time.monotonic() + (float(wait) if wait.isdigit() else 60.0)
        except OSError:
            pass
        self.failed += 1
        return False

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        """Messages are posted in requests of at most REQUEST_BYTES, as they come; the driver never holds more."""
        held, size = [], 0
        for r in batch.select("message").toLocalIterator():
            held.append(message(2, bytes(r["message"])))
            size += len(held[-1])
            if size >= REQUEST_BYTES:
                self.post(held)
                held, size = [], 0
        self.post(held)

    def post(self, held: list[bytes]) -> None:
        if held:
            self.send(message(1, message(2, b"".join(held))))


def table_sink(path: str):
    """A foreachBatch sink that keeps each batch once, by its number."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write
