"""Exact top-k inner products with an impact-ordered index, score at a time.

Vectors are integers. The postings of a block of vectors are kept by quantised impact, two levels to each doubling of a
component's magnitude, and by dimension: a segment (impact, dimension) lists the vectors with such a component and its values.
Segments are built and written once. They are processed by descending impact for all queries of a block, and add to running scores,
of which a vector's are a row. What a vector's lower impacts can still bring is bounded by their norm times the query's
(Cauchy-Schwarz), so after a wave of one impact every score has an upper bound. A vector is ruled out for a query only when that is
below the k-th best score known; a query stops when few vectors are left, and these are rescored exactly.

Blocks hold vectors by descending norm. The first block gives each query a k-th score, which goes with it to the others; and a
block whose largest norm can't reach it is left out before anything is sent to it.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wiretally.llm.common import blocks_for, cut, shuffle_partitions
from wiretally.operators.order import with_place

#: Vectors of an index block and queries of a query block: the memory of a task, not a limit on the search. Blocks get smaller,
#: down to LEAST_BLOCK, as long as there are fewer than tasks in a shuffle.
INDEX_BLOCK, QUERY_BLOCK, LEAST_BLOCK = 16384, 2048, 4096
#: Queries that are processed at once.
CHUNK = 256
#: Part of a block's vectors at which a query stops and rescores, and part of the postings before which that isn't asked.
FEW, ASK_FROM = 1 / 16, 0.5
NO_BAR = -(1 << 63)


class ImpactIndex:
    """Posting segments of a block of integer vectors (one row each)."""

    def __init__(self, vectors: np.ndarray):
        vectors = np.ascontiguousarray(vectors, np.int64)
        self.n, self.dims = vectors.shape
        self.most = max(int(vectors.max(initial=0)), -int(vectors.min(initial=0)))
        kind = next((t for t in (np.int8, np.int16, np.int32) if self.most <= np.iinfo(t).max), np.int64)
        self.vectors = vectors.astype(kind)
        size = np.abs(vectors.T.astype(np.float64)).ravel()  # by dimension
        held = np.flatnonzero(size)
        impact = np.floor(np.log2(size[held]) * 2).astype(np.int64)
        key = -impact * (self.dims + 1) + held // max(self.n, 1)
        order = np.argsort(key, kind="stable")
        key, held, impact = key[order], held[order], impact[order]
        self.ids = (held % max(self.n, 1)).astype(np.int32)
        self.values = self.vectors.T.ravel()[held]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, np.int64)
        self.first, self.dim = np.append(first, len(key)), held[first] // max(self.n, 1)
        # Waves of one impact: their first segments, and the norms of what is below them.
        levels = impact[first]
        self.waves = np.append(np.flatnonzero(np.concatenate(([True], levels[1:] != levels[:-1]))) if len(levels) else [], len(levels)).astype(np.int64)
        left, self.rest = (self.vectors.astype(np.float64) ** 2).sum(1), []
        for a, b in zip(self.waves, self.waves[1:], strict=False):
            part = slice(self.first[a], self.first[b])
            left -= np.bincount(self.ids[part], self.values[part].astype(np.float64) ** 2, self.n)
            # Rounding of large squares is made up for.
            self.rest.append(np.sqrt(np.maximum(left, 0) * (1 + 1e-9) + 1e-12 * float(self.most) ** 2 * self.dims * (self.most > 1 << 20)))
        if self.rest:
            self.rest[-1][:] = 0

    def search(self, queries: np.ndarray, k: int, known: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query number, places, scores) of every query: all vectors of its k highest scores, ties included, but for those below its
        `known`, a score that the k-th best of all blocks has at least. `multiplied` counts postings and components."""
        self.multiplied = 0
        largest = self.most * max(int(queries.max(initial=0)), -int(queries.min(initial=0))) * max(self.dims, 1)
        everything = np.arange(self.n)
        if largest >= 1 << 53 or self.n <= 2 * k:
            for i, q in enumerate(queries):
                yield i, everything, self.exact(everything, q, largest)
            return
        kind = np.float32 if largest < 1 << 24 else np.float64  # in which all sums are exact
        asked = np.ascontiguousarray(queries.T, kind)
        norms = np.sqrt((queries.astype(np.float64) ** 2).sum(1)) * (1 + 1e-9)
        pending, sums = np.arange(len(queries)), np.zeros((self.n, len(queries)), kind)
        bars = np.where(known == NO_BAR, -np.inf, known.astype(np.float64))
        for w, rest in enumerate(self.rest):
            for seg in range(self.waves[w], self.waves[w + 1]):
                a, b = self.first[seg], self.first[seg + 1]
                sums[self.ids[a:b]] += self.values[a:b, None].astype(kind) * asked[self.dim[seg]]
                self.multiplied += int(b - a) * len(pending)
            last = w == len(self.rest) - 1
            if not last and self.first[self.waves[w + 1]] < ASK_FROM * len(self.ids):
                continue
            slack = np.outer(rest, norms[pending])
            bar = bars[pending]
            if np.isinf(bar).any():
                bar = np.maximum(bar, np.partition(sums - slack, self.n - k, axis=0)[self.n - k])
            possible = sums + slack >= bar
            few = (possible.sum(0) <= max(2 * k, self.n * FEW)) | last
            for column in np.flatnonzero(few):
                at = np.flatnonzero(possible[:, column])
                yield pending[column], at, self.exact(at, queries[pending[column]], largest)
            pending, sums, asked = pending[~few], sums[:, ~few], np.ascontiguousarray(asked[:, ~few])
            if not len(pending):
                return
        for i in pending:  # vectors of zeros only
            yield i, everything, self.exact(everything, queries[i], largest)

    def exact(self, places: np.ndarray, q: np.ndarray, largest: int) -> np.ndarray:
        """Whole inner products; those beyond 64 bits are cut off there."""
        self.multiplied += len(places) * self.dims
        if largest < 1 << 62:
            return self.vectors[places].astype(np.int64) @ q
        products = self.vectors[places].astype(object) @ q.astype(object)
        return np.array([min(max(int(x), NO_BAR), (1 << 63) - 1) for x in products], np.int64)


def quantise(vectors: DataFrame, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """Usable rows: _rid, vec_id and the components floor(scale * x) as an array of long."""
    x = F.col(vector_col)
    good = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.where(good & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("vec_id"),
        F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")).cast("long")).alias("v"),
    )
    return cut(rows.withColumn("_rid", F.monotonically_increasing_id()))


def top_k(
    vectors: DataFrame,
    k: int = 20,
    scale: int = 64,
    every: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    index_block: int = INDEX_BLOCK,
    query_block: int = QUERY_BLOCK,
    least_block: int = LEAST_BLOCK,
) -> DataFrame:
    """For each row whose id is divisible by `every`, the k rows of highest integer inner product.

    Returns query_id, rank (from 1), vec_id, score; ties go to the smaller vec_id; all other rows if they are fewer
    than k. Rows whose vector is null or holds a null or non-finite component, or whose id is null, take no part.
    Vectors of different lengths are padded with zeros. Components and scores are 64-bit integers and are cut off there. A row is
    never its own neighbour; a repeated row is one, and each repetition of a query has its own ranks (rows of one
    query id then repeat). Further columns are ignored; an empty table gives an empty table.

    An index block goes to as many tasks as there are query blocks, a query to as many as there are index blocks that can
    reach its k-th score. At 10^8 vectors of 64 components that is 6104 index blocks of about 8 MB and 2442 query blocks.
    Only the k best of each pair go on, so identical vectors and hot ids cost nothing more.
    """
    rows = quantise(vectors, scale, id_col, vector_col)
    is_query = F.col("vec_id") % every == 0
    n, q = rows.agg(F.count("*"), F.count(F.when(is_query, 1))).first()
    parts = shuffle_partitions(vectors.sparkSession)
    n_index = max(blocks_for(n, index_block), min(blocks_for(n, least_block), parts))
    n_query = blocks_for(q, query_block)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    rows = with_place(rows.withColumn("norm", norm), F.desc("norm"), F.col("_rid"))
    rows = rows.withColumn("_b", F.floor((F.col("place") - 1) * F.lit(n_index) / F.lit(max(n, 1))).cast("int")).drop("place")

    def build(batches):
        held = [b for b in batches if b.num_rows]
        if held:
            table = pa.Table.from_batches(held)
            blob = pickle.dumps((table.column("_rid").to_numpy(), table.column("vec_id").to_numpy(), ImpactIndex(matrix_of(table))), protocol=5)
            yield pa.RecordBatch.from_arrays([pa.array([table.column("_b")[0].as_py()], pa.int32()), pa.array([blob], pa.binary())], names=["_b", "blob"])

    index = cut(rows.repartitionById(n_index, F.col("_b")).select("_rid", "vec_id", "v", "_b").mapInArrow(build, "_b int, blob binary"))
    # Queries are dealt by a hash of their row, so that no query block is fuller than another.
    queries = rows.where(is_query).withColumn("_q", F.pmod(F.xxhash64("_rid", F.lit(3)), F.lit(n_query)).cast("int"))
    queries = cut(queries.select("_rid", "vec_id", "v", "norm", "_q"))

    def best_of(held, asked):
        """The k best of a block for some of its queries: (row, id, components, bar) each."""
        own, names, block = held
        # A query of other length than the block's vectors: what one of them lacks counts as zero.
        matrix = np.zeros((len(asked), block.dims), np.int64)
        for i, (_, _, v, _) in enumerate(asked):
            matrix[i, : min(len(v), block.dims)] = v[: block.dims]
        bars = np.array([NO_BAR if x is None else x for *_, x in asked], np.int64)
        out = []
        for i, at, scores in block.search(matrix, k + 1, bars):  # one more: the query's own row may be there
            keep = (own[at] != asked[i][0]) & (scores >= bars[i])
            at, scores = at[keep], scores[keep]
            best = np.lexsort((names[at], -scores))[:k]
            out.append((np.full(len(best), asked[i][0]), np.full(len(best), asked[i][1]), names[at[best]], scores[best]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out, strict=True)], names=["_rid", "query_id", "vec_id", "score"])

    def search(batches):
        name, held, asked = None, None, []
        for b in batches:
            columns = [b.column(c).to_pylist() for c in ("_t", "_rid", "vec_id", "known")]
            for i, (pair, rid, vec_id, known) in enumerate(zip(*columns, strict=True)):
                blob = b.column("blob")[i]
                if asked and (blob.is_valid or pair != name or len(asked) == CHUNK):
                    yield best_of(held, asked)
                    asked = []
                if blob.is_valid:  # the index comes before its queries
                    name, held = pair, pickle.loads(blob.as_py())
                elif name == pair:
                    asked.append((rid, vec_id, b.column("v")[i].as_py(), known))
        if asked:
            yield best_of(held, asked)

    def wave(first_block: int, asked: DataFrame, n_pairs: int) -> DataFrame:
        """The best of each pair of an index block and a query of asked (with _b and known)."""
        left = index.where("_b >= 1" if first_block else "_b = 0").withColumn("_q", F.explode(F.sequence(F.lit(0), F.lit(n_query - 1))))
        pair = (F.col("_q") * F.lit(n_pairs // n_query).cast("long") + F.col("_b") - first_block).alias("_t")
        nothing = [F.lit(None).cast(t).alias(c) for c, t in (("_rid", "long"), ("vec_id", "long"), ("v", "array<long>"), ("known", "long"))]
        both = left.select(pair, F.lit(0).alias("_is"), "blob", *nothing)
        both = both.unionByName(asked.select(pair, F.lit(1).alias("_is"), F.lit(None).cast("binary").alias("blob"), "_rid", "vec_id", "v", "known"))
        tasks = max(1, min(n_pairs, max(parts, blocks_for(n_pairs, 4))))
        dealt = both.repartitionById(tasks, F.pmod(F.xxhash64("_t") if n_pairs > tasks else F.col("_t"), F.lit(tasks)).cast("int"))
        return dealt.sortWithinPartitions("_t", "_is").mapInArrow(search, "_rid long, query_id long, vec_id long, score long")

    first = cut(wave(0, queries.withColumn("_b", F.lit(0)).withColumn("known", F.lit(None).cast("long")), n_query))
    found = first
    if n_index > 1:
        bars = first.groupBy("_rid").agg(F.count("*").alias("c"), F.min("score").alias("s")).select("_rid", F.when(F.col("c") >= k, F.col("s")).alias("known"))
        asked = queries.join(bars, "_rid", "left").withColumn("_b", F.explode(F.sequence(F.lit(1), F.lit(n_index - 1))))
        # One row for each index block, at most a 16384th of the vectors or as many as a shuffle has tasks.
        asked = asked.join(F.broadcast(rows.groupBy("_b").agg(F.max("norm").alias("_reach"))), "_b")
        can = F.col("norm") * F.col("_reach") * (1 + 1e-9) >= F.col("known")
        asked = asked.where(F.col("known").isNull() | can | (F.abs("known") >= 1 << 53))
        found = first.unionAll(wave(1, asked, n_query * (n_index - 1)))
    w = Window.partitionBy("_rid").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def matrix_of(table: pa.Table) -> np.ndarray:
    lists = table.column("v").combine_chunks()
    return padded(lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists)


def padded(lists: pa.ListArray) -> np.ndarray:
    offsets = lists.offsets.to_numpy()
    values = lists.values.to_numpy()
    lengths = np.diff(offsets)
    width = int(lengths.max(initial=0))
    if (lengths == width).all():
        return values[offsets[0] : offsets[-1]].reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), np.int64)
    for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
        out[i, : b - a] = values[a:b]
    return out
