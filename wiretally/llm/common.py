"""Helpers shared by the corpus operators: null texts, ties and Arrow batches; lineage cuts and global order come from the library."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wiretally.operators.order import in_global_order
from wiretally.session import cut

__all__ = [
    "BATCH_BYTES", "blocks_for", "bytes_of", "cut", "hot_keys", "in_global_order", "key_table", "map_rows", "row_tie", "shuffle_partitions", "small_batches", "spread_join",
    "text_or_empty", "texts_of", "to_batch",
]

#: Output batches of Arrow functions are cut at about this many bytes.
BATCH_BYTES = 8 << 20
#: So many of the most frequent keys are spread over tasks by joins, if they have more than HOT_ROWS rows.
MOST_HOT, HOT_ROWS = 1000, 10_000


def small_batches(df: DataFrame) -> DataFrame:
    """df, with its session's Arrow batches held to 8 MB: a few long texts then don't fill a worker, whatever the row limit.

    It is a session setting, which Spark reads when a plan runs; every operator that hands texts to Python sets it.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
    return df


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def hot_keys(counts: DataFrame, key: str) -> DataFrame | None:
    """A broadcast table of the MOST_HOT most frequent keys of more than HOT_ROWS rows; None without any. Any other key has at
    most a thousandth of all rows, or HOT_ROWS. counts has each key once, and n, its number of rows; nothing is shuffled.
    """
    found = counts.where(F.col("n") > HOT_ROWS).orderBy(F.desc("n")).limit(MOST_HOT).collect()
    return key_table(counts, key, [r[key] for r in found])


def key_table(like: DataFrame, key: str, keys: list) -> DataFrame | None:
    """A few keys, of the type that they have in `like`, as spread_join takes them."""
    if not keys:
        return None
    rows = like.sparkSession.createDataFrame([(k,) for k in keys], like.select(key).schema)
    return F.broadcast(rows.withColumn("_hot", F.lit(True)))


def spread_join(left: DataFrame, right: DataFrame, key: str, how: str, hot: DataFrame | None, tie: Column) -> DataFrame:
    """left joined with right by a column of both, when right has each key once and left may have any key very often.

    Rows of left with a hot key (hot_keys) are dealt by a hash of `tie` (which must not change when a lost task is run
    again) to as many tasks as a shuffle has, and the few rows of right are repeated for each. The columns are those of
    left, then those of right without the key. Which keys are hot changes the work, never the result.
    """
    columns = [*left.columns, *(c for c in right.columns if c != key and how not in ("left_anti", "left_semi"))]
    if hot is None:
        return left.join(right, key, how).select(*columns)
    n = shuffle_partitions(left.sparkSession)
    salted = left.join(hot, key, "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(tie, F.lit(11)), F.lit(n))).otherwise(0).cast("int"))
    every = F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(n - 1))).otherwise(F.array(F.lit(0))))
    copies = right.join(hot, key, "left").withColumn("_salt", every).drop("_hot")
    return salted.drop("_hot").join(copies, [key, "_salt"], how).select(*columns)


def row_tie() -> Column:
    """A spread-out value per row, fixed for a given scan; only ever used between rows that agree in all else."""
    return F.xxhash64(F.monotonically_increasing_id())


def map_rows(
    df: DataFrame, make: Callable[[], Callable[[dict], Iterator[tuple]]], schema: str, arrow_schema: pa.Schema
) -> DataFrame:
    """mapInArrow with bounded output batches. make() is called once a task; what it returns gets a dict of
    column lists for each input batch and yields (output tuple, its approximate bytes)."""

    def run(batches):
        fn = make()
        for batch in batches:
            rows, held = [], 0
            for row, n_bytes in fn(batch):
                rows.append(row)
                held += n_bytes + 64
                if held >= BATCH_BYTES:
                    yield to_batch(rows, arrow_schema)
                    rows, held = [], 0
            if rows:
                yield to_batch(rows, arrow_schema)

    return small_batches(df).mapInArrow(run, schema)


def to_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema
    )


def texts_of(batch: pa.RecordBatch, name: str = "text") -> Iterator[str]:
    """The strings of a column one by one, null as empty, so that a batch is never held twice."""
    for x in batch.column(name):
        yield x.as_py() or ""


def bytes_of(batch: pa.RecordBatch, name: str = "text") -> Iterator[bytes]:
    col = batch.column(name)
    col = col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary())
    for x in col:
        yield x.as_py() or b""


def blocks_for(n_rows: int, per_block: int) -> int:
    return max(1, math.ceil(n_rows / per_block))
