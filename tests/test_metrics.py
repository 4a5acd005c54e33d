"""Histograms, cardinality control, exposition and scrapes."""

import math

import pytest
from pyspark.sql import functions as F

from wiretally.operators import cardinality, expose, hist
from wiretally.plans import promql
from wiretally.sources import logs


def buckets(spark, values):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i int, v double")
    return [r[0] for r in df.orderBy("i").select(hist.bucket(F.col("v"))).collect()]


def test_every_bound_and_its_predecessor(spark):
    b = hist.bounds()
    assert buckets(spark, b) == [*range(hist.LOW, hist.HIGH), hist.OVER]
    assert buckets(spark, [math.nextafter(x, 0) for x in b]) == [hist.UNDER, *range(hist.LOW, hist.HIGH)]


def test_odd_values(spark):
    assert buckets(spark, [0, -1, math.nan, math.inf, 1e-9, 100]) == [hist.UNDER] * 3 + [hist.OVER, hist.UNDER, hist.OVER]


def test_classic_bounds_are_strict(spark):
    df = spark.createDataFrame([(1.0,), (0.999,), (40.0,), (0.0,)], "v double")
    rows = {r["j"]: r["cumulative"] for r in hist.classic_cumulative(hist.latency_cells(df, "v")).collect()}
    assert rows[0] == 2 and rows[1] == 3 and rows[5] == 3 and rows[None] == 4


@pytest.mark.parametrize("grid", hist.GRIDS)
def test_octaves(spark, grid):
    low, n = hist.GRIDS[grid]
    values = [0, 1, 2**low, 2**low + 1, 2 ** (low + n - 1), 2 ** (low + n - 1) + 1]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v long")
    got = [r[0] for r in df.orderBy("i").select(hist.octave(F.col("v"), grid)).collect()]
    assert got == [0, 0, 0, 1, n - 1, n]


def test_quantile(spark):
    rows = [("a", 1.0, 0.0), ("a", 2.0, 10.0), ("a", float("inf"), 10.0), ("b", 1.0, 0.0), ("b", float("inf"), 5.0), ("c", 1.0, 0.0), ("c", float("inf"), 0.0)]
    df = spark.createDataFrame(rows, "k string, le double, cumulative double")
    got = {r["k"]: r["quantile"] for r in hist.quantile_from_cumulative(df, 0.5, "k").collect()}
    assert got == {"a": 1.5, "b": 1.0, "c": None}


def test_dictionary_admits_at_the_second_knock():
    d = cardinality.Dictionary(2)
    assert [d.offer(x) for x in (10, 10, 10, 20, 30, 30)] == [True, True, True, True, False, True]
    assert 10 not in d.held and 30 in d.held
    assert [d.offer(10), d.offer(10)] == [False, True] and 20 not in d.held


def test_one_shots_dont_displace():
    d = cardinality.Dictionary(2)
    d.offer(10), d.offer(20)
    assert not any(d.offer(1000 + i) for i in range(1000)) and set(d.held) == {10, 20}


def test_cardinality_ceiling():
    d = cardinality.Dictionary(64)
    seen = [d.offer(i) for i in range(1, 100_001)]
    assert len(d.held) == 64 and sum(map(bool, seen)) == 64


def test_admit(spark):
    fps = [10, 10, 10, 20, 30, 30, 10, 10]
    df = spark.createDataFrame(list(enumerate(fps)), "seq long, fp long")
    got = {r["seq"]: r["admitted"] for r in cardinality.admit(df, slots=2).collect()}
    # 10 is evicted and comes back, 20 is evicted: only the last epoch of 10 and that of 30 count.
    assert got == {0: False, 1: False, 2: False, 3: False, 4: False, 5: True, 6: False, 7: True}
    assert all(r["admitted"] for r in cardinality.admit(df, slots=3).collect())


def test_admit_against_one_pass(spark):
    """Random identities in any partitioning, with places that repeat: nothing is added or lost."""
    import random

    rng = random.Random(9)
    rows = [(i, 0, rng.choice((1, 2, 3, 4, 5)) if rng.random() < 0.6 else rng.randrange(100)) for i in range(3000)]
    epochs, d, now, taken = {}, cardinality.Dictionary(6, 64), {}, []
    for i, _, fp in rows:
        was = fp in d.held
        ok = d.offer(fp, i)
        if ok and not was:
            epochs[fp] = epochs.get(fp, 0) + 1
            now[fp] = epochs[fp]
        taken.append((i, fp, now[fp] if ok else 0))
    want = {i for i, fp, e in taken if e and fp in d.held and e == epochs[fp]}
    df = spark.createDataFrame(rows, "seq long, conn long, fp long")
    for n in (1, 4, 9):
        got = cardinality.admit(df.repartition(n), slots=6, doors=64).collect()
        assert len(got) == len(rows) and {r["seq"] for r in got if r["admitted"]} == want
    same = df.withColumn("seq", F.lit(1).cast("long"))
    assert cardinality.admit(same, slots=6).count() == len(rows)


def test_dim_cap(spark):
    df = spark.createDataFrame([(1, "a", "u"), (2, "b", "u"), (3, "c", "u"), (4, "a", "u")], "seq long, db string, user string")
    got = {r["seq"]: (r["db"], r["user"]) for r in cardinality.cap_dims(df, 2).collect()}
    assert got == {1: ("a", "u"), 2: ("b", "u"), 3: ("other", "other"), 4: ("a", "u")}


def test_exposition_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([('a"b\\c\nd', 3), ("z", 4)], "db string, value long")
    lines = expose.counter_lines(rows, "wt_x_total", "Help.", "db")
    path = str(tmp_path / "metrics")
    expose.write_text(lines, path)
    text = [r[0] for r in spark.read.text(path).collect()]
    assert text[0] == "# HELP wt_x_total Help." and text[2] == 'wt_x_total{db="a\\"b\\\\c\\nd"} 3'
    back = logs.exposition(spark.read.text(path)).collect()
    assert {(r["labels"]["db"], r["value"]) for r in back} == {('a"b\\c\nd', 3.0), ("z", 4.0)}


def test_protobuf_points():
    body = expose.number_point({"k": "v"}, 2.5, 7, 5)
    assert body == b"\n\x25\x11" + (5).to_bytes(8, "little") + b"\x19" + (7).to_bytes(8, "little") + b"\x21\0\0\0\0\0\0\x04@" + b"\x3a\x08\n\x01k\x12\x03\n\x01v"
    assert expose.zigzag(-53) == b"i" and expose.varint(300) == b"\xac\x02"
    point = expose.exponential_point({}, {hist.UNDER: 1, 0: 2, hist.OVER: 3}, 1.0, 2, 1)
    assert (6).to_bytes(8, "little") in point
    name = expose.metric("m", "", "sum", b"")
    assert name.startswith(b"\n\x01m")


def test_spans_encode(spark, sf):
    from wiretally.file_queries import built

    row = expose.encode_spans(built(spark, sf)).first()
    assert bytes(row["message"])[:2] == b"\n\x10" and expose.read(bytes(row["message"]))[1][0].hex()


def test_rate_with_reset(spark):
    rows = [(t, "c", {"k": "a"}, v) for t, v in ((10, 5.0), (20, 9.0), (30, 2.0), (40, 4.0))]
    df = spark.createDataFrame(rows, "ts long, name string, labels map<string,string>, value double")
    got = promql.rate(df, 40).collect()
    assert [(r["at"], r["rate"]) for r in got] == [(40, (4 + 2 + 2) / 40)]


def test_histogram_quantile(spark):
    rows = [(60, "b", {"le": le, "q": "x"}, r) for le, r in (("0.1", 1.0), ("0.5", 3.0), ("+Inf", 4.0))]
    df = spark.createDataFrame(rows, "at long, name string, labels map<string,string>, rate double")
    assert promql.histogram_quantile(df, 0.5, "q").first()["quantile"] == pytest.approx(0.3)


def test_push_pauses(monkeypatch):
    import urllib.error

    sink = expose.Push("http://127.0.0.1:9/v1/metrics")

    def refuse(*a, **k):
        raise urllib.error.HTTPError("u", 503, "busy", {"Retry-After": "30"}, None)

    monkeypatch.setattr(expose.urllib.request, "urlopen", refuse)
    assert not sink.send(b"x") and sink.failed == 1
    assert not sink.send(b"x") and sink.failed == 1  # paused: not even tried


def scrapes(spark):
    from wiretally.plans.panels import M

    rows = []
    for t in (60, 120, 180, 240, 300):
        v = float(t)
        for code in ("ok", "error", "5xx"):
            base = {"db": "shop", "slot": "s1", "code": code, "error": "E1", "status": "ok", "direction": "in", "reason": "h2"}
            names = ("queries_total", "requests_total", "errors_total", "rows_total", "bytes_total", "events_total", "lost_events_total", "resyncs_total", "blind_total", "process_cpu_seconds_total", "connections", "series")
            rows += [(t, f"{M}_{n}", base, v) for n in names]
            for h in ("duration_seconds", "txn_seconds", "ttfb_seconds", "upload_seconds", "first_row_seconds", "event_seconds"):
                rows += [(t, f"{M}_{h}_bucket", base | {"le": le}, v * k) for le, k in (("0.5", 1), ("1", 2), ("+Inf", 2))]
                rows += [(t, f"{M}_{h}_sum", base, v), (t, f"{M}_{h}_count", base, v * 2)]
    return spark.createDataFrame(rows, "ts long, name string, labels map<string,string>, value double")


def test_panels(spark):
    from wiretally.plans import panels

    t = scrapes(spark).cache()
    got = {name: panel(t).collect() for name, panel in panels.PANELS.items()}
    assert all(got.values()), [k for k, v in got.items() if not v]
    assert got["overview_error_rate"][0]["value"] == pytest.approx(0.8 / 2.4)
    assert got["overview_p50"][0]["quantile"] == pytest.approx(0.5)
    assert got["health_cost_per_event"][0]["mean"] == pytest.approx(0.5)
    assert all(v.collect() for v in panels.drilldown(t, "s.*").values())
    assert [r[0] for r in panels.variables(t, "queries_total", "db").collect()] == ["shop"]


def test_exact_percentiles_of_a_hot_group(spark):
    import random

    from wiretally.operators import order

    rng = random.Random(2)
    rows = [("hot", float(rng.randrange(50))) for _ in range(2000)] + [("one", 3.0), ("two", 1.0), ("two", 2.0), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(7)
    got = {r["k"]: (r["p50"], r["p99"], r["p0"]) for r in order.exact_percentiles(df, "v", {"p50": 0.5, "p99": 0.99, "p0": 0.0}, "k").collect()}
    hot = sorted(v for k, v in rows if k == "hot")
    assert got == {"hot": (hot[999], hot[1979], hot[0]), "one": (3.0,) * 3, "two": (1.0, 2.0, 1.0)}
