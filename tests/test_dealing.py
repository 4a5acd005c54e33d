"""Connections stay whole where the tables they come from are coalesced each by itself."""

import os

import duckdb
import pytest
from test_queries import plain

from wiretally.queries import ORACLE_SQL, QUERIES

#: Partitions of the events are left as they are, those of the few rows that open a connection become one.
COALESCED = {
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4kb",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1kb",
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
}


@pytest.fixture
def coalesced(spark):
    before = {k: spark.conf.get(k, None) for k in COALESCED}
    for k, v in COALESCED.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize(
    "name",
    [
        "agg15_parsed_transactions",
        "e2e_postgres_metrics",
        "str1_str19_str20_redis_units",
        "e2e_redis_metrics",
        "str9_str10_str12_postgres_units",
    ],
)
def test_connections_stay_whole(coalesced, sf, name):
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    db.execute(f"CREATE VIEW events AS SELECT * FROM '{os.path.join(sf, 'events.parquet')}'")
    df = QUERIES[name](coalesced, sf)
    res = db.execute(ORACLE_SQL[name])
    at = [[d[0] for d in res.description].index(c) for c in df.columns]
    want = sorted((tuple(plain(r[i]) for i in at) for r in res.fetchall()), key=repr)
    assert sorted((tuple(map(plain, r)) for r in df.collect()), key=repr) == want
