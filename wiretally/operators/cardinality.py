"""Cardinality control: first-seen caps in set form, and the ordered top-K dictionary with its doorkeeper.

Caps need only the first place of each value in the total order (schema.ORDER), an aggregation. The dictionary depends on
order, but only where there are more identities than slots: then a narrow projection goes through one ordered fold. What
comes out of it is one row for each slot, so all aggregation after it is parallel again.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wiretally import schema as S
from wiretally.session import cut

SLOTS, DOORS = 500, 2048
DIM_CAP, DIM_CAP_S3, ERROR_CAP, PROTO_CAP = 32, 128, 64, 8


def order_of(df: DataFrame) -> Column:
    """The place of a row in the total order, of those columns of it that df has."""
    return F.struct(*(c for c in S.ORDER if c in df.columns))


def first_seen(df: DataFrame, cap: int, *keys: str, within: tuple[str, ...] = ()) -> DataFrame:
    """The first `cap` distinct keys (in each `within`), by their smallest place in the total order.

    Only the cap smallest of each task meet: a limited sort, or a window whose rank limit Spark applies before the shuffle.
    """
    seen = df.groupBy(*within, *keys).agg(F.min(order_of(df)).alias("_first"))
    if not within:
        return seen.orderBy("_first", *keys).limit(cap).drop("_first")
    w = Window.partitionBy(*within).orderBy("_first", *keys)
    return seen.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= cap).drop("_first", "_rank")


def cap_dims(obs: DataFrame, cap: int = DIM_CAP) -> DataFrame:
    """(db, user) pairs beyond the first `cap` become (other, other). The kept pairs are at most cap rows."""
    kept = first_seen(obs, cap, "db", "user").withColumn("_kept", F.lit(True))
    out = obs.join(F.broadcast(kept), ["db", "user"], "left")
    return out.withColumns({c: F.when(F.col("_kept"), F.col(c)).otherwise(S.OTHER) for c in ("db", "user")}).drop("_kept")


def cap_errors(obs: DataFrame, cap: int = ERROR_CAP, profile: str = "proto") -> DataFrame:
    """Error labels beyond the first `cap` of each profile become other."""
    kept = first_seen(obs.where(F.col("error").isNotNull()), cap, "error", within=(profile,)).withColumn("_kept", F.lit(True))
    out = obs.join(F.broadcast(kept), [profile, "error"], "left")
    return out.withColumn("error", F.when(F.col("_kept") | F.col("error").isNull(), F.col("error")).otherwise(S.OTHER)).drop("_kept")


def cap_protos(obs: DataFrame, cap: int = PROTO_CAP) -> DataFrame:
    kept = first_seen(obs, cap, "proto").withColumn("_kept", F.lit(True))
    out = obs.join(F.broadcast(kept), "proto", "left")
    return out.withColumn("proto", F.when(F.col("_kept"), F.col("proto")).otherwise(S.OTHER)).drop("_kept")


class Dictionary:
    """K slots by last use. Free slots admit at first sight; once full, a newcomer must knock twice, and then takes the slot
    of the identity used longest ago. An evicted identity that comes back is admitted anew."""

    def __init__(self, slots: int = SLOTS, doors: int = DOORS):
        self.slots, self.held = slots, OrderedDict()
        self.doors, self.knocked = doors, [None] * doors

    def offer(self, fp: int, at=None) -> bool:
        """Whether the observation at this place is taken into a slot; otherwise it counts for other."""
        if fp in self.held:
            self.held.move_to_end(fp)
            return True
        if len(self.held) >= self.slots:
            key = (fp & (1 << 64) - 1) or 1
            door = (key ^ key >> 17) % self.doors
            if self.knocked[door] != key:
                self.knocked[door] = key
                return False
            self.knocked[door] = None  # the door is free again
            self.held.popitem(last=False)
        self.held[fp] = at
        return True


def fold(rows: Iterable[tuple[int, tuple]], slots: int = SLOTS, doors: int = DOORS) -> list[tuple[int, tuple]]:
    """Of (fp, place) in order: the identities held at the end, and where each was admitted last. Holds the dictionary only."""
    d = Dictionary(slots, doors)
    for fp, at in rows:
        d.offer(fp, at)
    return list(d.held.items())


def admit(obs: DataFrame, slots: int = SLOTS, doors: int = DOORS, fp: str = "fp") -> DataFrame:
    """obs with `admitted`: whether its identity is still in the dictionary at the end, under the admission that took this row.
    What was folded when it was evicted, or never admitted, is other. Rows are neither added nor lost, whatever their order
    columns hold; rows with a null fp aren't admitted.

    An identity that is held at the end has been held since its last admission. So the fold returns one row for each slot,
    and a row is admitted if it isn't before that place. With no more identities than slots nothing is ordered.
    Otherwise the dictionary is a serial machine by its definition: one task sorts the narrow projection (spilling to disk)
    and reads it in order, without the rows of which neighbours in their range repeat an identity more than twice.
    """
    if obs.select(fp).where(F.col(fp).isNotNull()).distinct().limit(slots + 1).count() <= slots:
        return obs.withColumn("admitted", F.col(fp).isNotNull())
    keys = [c for c in S.ORDER if c in obs.columns]
    kinds = {f.name: f.dataType.simpleString() for f in obs.schema.fields}

    def run(batches):
        rows = ((r[0], r[1:]) for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        held = fold(rows, slots, doors)
        if held:
            columns = [[h[0] for h in held], *zip(*(h[1] for h in held), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["_fp", *(f"_{k}" for k in keys)])

    narrow = obs.where(F.col(fp).isNotNull()).select(F.col(fp).alias("_fp"), *(F.col(k).cast("long").alias(k) for k in keys))
    # Of a run of one identity the first two rows decide: the knock and the admission. Later ones only use the slot again.
    ranges = narrow.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(without_long_runs, narrow.schema)
    held = cut(ranges.repartition(1).sortWithinPartitions(*keys).mapInArrow(run, "_fp long, " + ", ".join(f"_{k} long" for k in keys)))
    since = F.struct(*(F.col(k).cast(kinds[k]) for k in keys)) >= F.struct(*(F.col(f"_{k}").cast(kinds[k]) for k in keys))
    out = obs.join(F.broadcast(held), F.col(fp) == F.col("_fp"), "left")
    return out.withColumn("admitted", F.col("_fp").isNotNull() & since).select(*obs.columns, "admitted")


def without_long_runs(batches):
    """Sorted rows without those that follow two of the same identity."""
    last = (None, None)
    for b in batches:
        fps = b.column(0).to_pylist()
        keep = []
        for fp in fps:
            keep.append(not (last[0] == fp == last[1]))
            last = (last[1], fp)
        yield b.filter(pa.array(keep, pa.bool_()))
