"""Live events: file streams, and a data source that generates a paced stream of raw events for tests and load runs."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from wiretally import schema as S
from wiretally.sources import recordings


class Span(InputPartition):
    def __init__(self, start: int, end: int, conns: int):
        self.start, self.end, self.conns = start, end, conns


class EventReader(DataSourceStreamReader):
    """Offsets are event numbers; each batch is one range, split over partitions."""

    def __init__(self, options: dict):
        self.rows, self.conns = int(options.get("rowsPerBatch", "1000")), int(options.get("conns", "10"))
        self.parts, self.last = int(options.get("partitions", "2")), int(options.get("rows", "10000"))
        self.at = 0

    def reached(self, offset: dict) -> None:
        """A new reader of a query that goes on learns from the offsets it is asked for where it left off."""
        self.at = max(self.at, offset["n"])

    def commit(self, end: dict) -> None:
        self.reached(end)

    def initialOffset(self) -> dict:
        return {"n": 0}

    def latestOffset(self) -> dict:
        self.at = min(self.at + self.rows, self.last)
        return {"n": self.at}

    def partitions(self, start: dict, end: dict) -> list[Span]:
        self.reached(start)
        self.reached(end)
        cuts = [start["n"] + (end["n"] - start["n"]) * i // self.parts for i in range(self.parts + 1)]
        return [Span(a, b, self.conns) for a, b in zip(cuts, cuts[1:], strict=False) if a < b]

    def read(self, partition: Span) -> Iterator[tuple]:
        for n in range(partition.start, partition.end):
            conn, k = n % partition.conns, n // partition.conns
            asks = k % 2 == 0
            payload = b"*1\r\n$4\r\nPING\r\n" if asks else b"+PONG\r\n"
            size = len(payload)
            way = recordings.RECV if asks else recordings.SEND
            yield (conn, n * 1000, k + 1, recordings.DATA, way, 0, None, size, 0, size, payload, "data")


class EventSource(DataSource):
    """spark.dataSource.register(EventSource); spark.readStream.format("wire_events")."""

    @classmethod
    def name(cls) -> str:
        return "wire_events"

    def schema(self):
        return S.RAW_EVENT

    def streamReader(self, schema) -> EventReader:
        return EventReader(self.options)


def generated(spark: SparkSession, **options) -> DataFrame:
    spark.dataSource.register(EventSource)
    return spark.readStream.format("wire_events").options(**options).load()


def parquet_events(spark: SparkSession, path: str) -> DataFrame:
    """Raw events that a collector drops into a folder as Parquet."""
    return spark.readStream.schema(S.RAW_EVENT).parquet(path)
