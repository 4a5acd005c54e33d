"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every row has a place on the ring, from its id and text. It belongs to the next virtual node
clockwise; rows that find a node's shard full go on clockwise to the next node, and so on. Capacities
add up to the number of rows and differ by one at most, so the law `rows` holds: counts are at most
one apart. A row moves between two layouts only where arcs or overflow change.

Rows that share an arc differ only in their place, so the walk is done on counts of arcs (bounded by
the virtual nodes), not on rows: the plan is a short list of rank intervals, and each row finds its
shard and slot from its global rank.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections import defaultdict
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wiretally.llm.common import cut, in_global_order, row_tie, text_or_empty

VIRTUAL_NODES = 128


def ring(n_shards: int, virtual_nodes: int = VIRTUAL_NODES) -> list[tuple[int, int]]:
    """(place, shard) of every virtual node, in ring order; places are signed 64-bit."""
    nodes = []
    for shard in range(n_shards):
        for v in range(virtual_nodes):
            digest = hashlib.blake2b(f"{shard}/{v}".encode(), digest_size=8).digest()
            nodes.append((int.from_bytes(digest, "big", signed=True), shard))
    return sorted(nodes)


def capacities(n_rows: int, n_shards: int) -> list[int]:
    """Loads that add up to n_rows and differ by one at most."""
    return [n_rows // n_shards + (s < n_rows % n_shards) for s in range(n_shards)]


def walk(arc_counts: list[int], shards: list[int], capacity: list[int]) -> list[tuple[int, int, int]]:
    """(first rank, shard, first slot) of intervals of rows, ascending.

    arc_counts[j] rows of consecutive ranks have node j as their next one; the last count is of rows past
    the last node, which wrap to the first. All rows knock at their own node first, then those that were
    refused at the next node, hop by hop; a node takes the rows of lowest rank that still fit.
    """
    n = len(shards)
    starts = [0, *accumulate(arc_counts)]
    waiting: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for j, count in enumerate(arc_counts):
        if count:
            waiting[j % n].append((starts[j], count))
    room, taken, plan = list(capacity), [0] * len(capacity), []
    while waiting:
        refused: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for node in sorted(waiting):
            shard = shards[node]
            for first, count in waiting[node]:
                fits = min(count, room[shard])
                if fits:
                    plan.append((first, shard, taken[shard]))
                    taken[shard] += fits
                    room[shard] -= fits
                if fits < count:
                    refused[(node + 1) % n].append((first + fits, count - fits))
        waiting = refused
    return sorted(plan)


def shard_documents(
    docs: DataFrame,
    n_shards: int = 16,
    virtual_nodes: int = VIRTUAL_NODES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Deal all rows to n_shards shards; one output row for each input row.

    Returns doc_id, size (UTF-8 bytes plus 1; a null text has none), text_crc32 (0 for a null text),
    shard (from 0) and slot (gapless from 0 in each shard). The ring place comes from id, size and
    checksum, so a null or repeated id doesn't pile up in one arc; rows equal in all three are
    interchangeable and are dealt by rank like any others, even when they are most of the table. An
    empty table gives an empty table. Further columns are ignored.
    """
    text = text_or_empty(text_col)
    rows = cut(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            (F.octet_length(text).cast("long") + 1).alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            row_tie().alias("_tie"),
        ).withColumn("_place", F.xxhash64("doc_id", "size", "text_crc32"))
    )
    rows = in_global_order(rows, *map(F.col, ("_place", "doc_id", "size", "text_crc32", "_tie")))
    nodes = ring(n_shards, virtual_nodes)
    places = np.array([p for p, _ in nodes], np.int64)

    @F.pandas_udf("int")
    def next_node(place: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(places, place.to_numpy(), "left").astype(np.int32))

    # At most (partitions + virtual nodes) groups: a partition is a range of the ring.
    counts = rows.groupBy("_pid", next_node("_place").alias("arc")).count().collect()
    of_pid, of_arc = defaultdict(int), [0] * (len(nodes) + 1)
    for r in counts:
        of_pid[r["_pid"]] += r["count"]
        of_arc[r["arc"]] += r["count"]
    pids = sorted(of_pid)
    first_rank = dict(zip(pids, accumulate([0, *(of_pid[p] for p in pids)]), strict=False))
    n_rows = sum(of_arc)
    plan = walk(of_arc, [s for _, s in nodes], capacities(n_rows, n_shards)) or [(0, 0, 0)]
    firsts, shards, slots = (np.array(x, np.int64) for x in zip(*plan, strict=True))
    base = np.zeros(max(pids, default=0) + 1, np.int64)
    for p, r in first_rank.items():
        base[p] = r

    def place_rows(batches):
        for b in batches:
            pid, idx = b.column("_pid").to_numpy(), b.column("_idx").to_numpy()
            rank = base[pid] + idx
            k = np.searchsorted(firsts, rank, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"),
                    b.column("size"),
                    b.column("text_crc32"),
                    pa.array(shards[k].astype(np.int32)),
                    pa.array(slots[k] + rank - firsts[k]),
                ],
                names=["doc_id", "size", "text_crc32", "shard", "slot"],
            )

    return rows.select("_pid", "_idx", "doc_id", "size", "text_crc32").mapInArrow(
        place_rows, "doc_id long, size long, text_crc32 long, shard int, slot long"
    )


def shard_of_place(place: int, nodes: list[tuple[int, int]]) -> int:
    """The shard that a lone row at this place would get."""
    return nodes[bisect_left(nodes, (place, -1)) % len(nodes)][1]
