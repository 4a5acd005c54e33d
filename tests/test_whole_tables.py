"""Queries over whole tables: they take every row."""

import duckdb
import pytest

from wiretally.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", ["src7_observation_lines", "src8_command_stats", "src9_prometheus_text"])
def test_lines_of_all_events(spark, sf, name):
    n = spark.read.parquet(f"{sf}/events.parquet").count()
    assert QUERIES[name](spark, sf).count() == n


def test_sets_and_pairs_of_all_events(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    assert QUERIES["set2_set_changes"](spark, sf).groupBy("change").count().count() == 2
    seen = QUERIES["set3_keyed_union"](spark, sf).groupBy().sum("log_n", "seen_n").first()
    assert tuple(seen) == (e.where("event_type = 'view'").count(), e.where("event_type = 'error'").count())
    n = e.groupBy("user_id").agg({"*": "count"}).count()
    assert QUERIES["set3_keyed_union"](spark, sf).count() == n


def test_pairs_of_all_events(spark):
    """At a size at which some users have as many events of one type as of the other."""
    sf = "/root/testdata/sf0.01"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM '{sf}/events.parquet'")
    want = db.execute(f"SELECT user_id, k, left_at, right_at FROM ({ORACLE_SQL['join4_kth_to_kth']})").fetchall()
    got = QUERIES["join4_kth_to_kth"](spark, sf).select("user_id", "k", "left_at", "right_at").collect()
    assert sorted(map(tuple, got)) == sorted(want) and want


def test_given_route_of_whole_texts(spark, sf):
    """Every document has a row, and the clip at 255 bytes is reached, also inside a character."""
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    routes = [r["route"] for r in QUERIES["fn4_given_route"](spark, sf).collect()]
    sizes = [len(r.encode()) for r in routes if r is not None]
    assert len(routes) == n and max(sizes) == 255 and 254 in sizes


@pytest.mark.parametrize("name", ["srt1_exposition_order", "srt3_scalar_order", "win1_tumbling_counts"])
def test_places_of_all_groups(spark, sf, name):
    places = sorted(r["place"] for r in QUERIES[name](spark, sf).collect())
    assert places == list(range(1, len(places) + 1)) and places
