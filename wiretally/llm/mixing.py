"""Mixing sources to target weights by systematic sampling.

Each document of a source expects target / source size copies. Expected copies are prefix-summed
over the source's documents in order of size, one random offset is added, and the document is emitted once
for each integer boundary that its interval crosses. Order by size makes the words taken follow the target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wiretally.llm.common import cut, hot_keys, in_global_order, row_tie, shuffle_partitions, spread_join
from wiretally.operators.order import with_place

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
#: Offsets are multiples of 2^-20, so that adding them to whole copies is exact.
OFFSET_BITS = 20
#: A word is a run of other bytes than these.
WORD = r"[^\x20\x09-\x0D]+"
#: Repetitions of one row that a task emits at a time.
CHUNK = 10_000


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """sizes (source, source_size; one row each) with target, the words wanted from each source.

    Sources in order of code points, null last, have the weights in turn and share `share` of all words by weight; a target
    stops at `most` times its source's size and the excess is shared anew until none is above. That is water filling:
    those with the least size for their weight fill up first. So sources are ranked by that ratio, and the first one
    that doesn't fill up under the share left by all before it ends the filling. Sums run over ranges in global order:
    any number of sources is one sort, and what comes to the driver are two numbers.
    """
    placed = with_place(sizes, F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    ranked = placed.withColumn("weight", weight.cast("long")).withColumn("_ratio", F.col("source_size") / F.col("weight"))
    ranked = in_global_order(ranked, F.col("_ratio"), F.col("place"))
    parts = ranked.groupBy("_pid").agg(F.sum("source_size").alias("_s"), F.sum("weight").alias("_w"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    parts = parts.select("_pid", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}0") for c in ("_s", "_w")))
    inside = Window.partitionBy("_pid").orderBy("_idx").rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranked.join(F.broadcast(parts), "_pid")
    filled, taken = (F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.col(b) for c, b in (("source_size", "_s0"), ("weight", "_w0")))
    ranked = cut(ranked.select("source", "source_size", "weight", "_ratio", "place", filled.alias("_full"), taken.alias("_gone")))
    whole = ranked.agg(F.sum("source_size").alias("s"), F.sum("weight").alias("w")).first()
    words, heavy = whole["s"] or 0, whole["w"] or 0
    left, free = F.lit(share * words) - F.lit(most) * F.col("_full"), F.lit(heavy) - F.col("_gone")
    ends = left * F.col("weight") / free <= F.lit(most) * F.col("source_size")
    first = ranked.where(ends).select(F.struct("_ratio", "place", left.alias("left"), free.alias("free")).alias("x")).agg(F.min("x").alias("x")).first()["x"]
    full = F.lit(most) * F.col("source_size")
    if first is None:
        return ranked.select("source", "source_size", full.cast("double").alias("target"))
    early = (F.col("_ratio") < first["_ratio"]) | ((F.col("_ratio") == first["_ratio"]) & (F.col("place") < first["place"]))
    shared = F.lit(float(first["left"])) * F.col("weight") / F.lit(first["free"])
    return ranked.select("source", "source_size", F.when(early, full).otherwise(shared).cast("double").alias("target"))


def offset(seed: int, source: Column) -> Column:
    """One offset in [0, 1) for each source."""
    h = F.xxhash64(F.lit(seed), source.isNull(), F.coalesce(source, F.lit("")))
    return F.shiftrightunsigned(h, 64 - OFFSET_BITS) / F.lit(float(1 << OFFSET_BITS))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix_sources(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
    seed: int = 7,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """How often the mix emits each row: doc_id, source, text_crc32, size, source_size, target, copies, taken.

    size is the number of words of the text (null: 0), source_size their sum over the source, target the
    source's words wanted, taken = copies * size. A null source is a source, last in order. Null and
    repeated ids are allowed: rows are ordered by size, then a hash of id and text, and rows equal in all
    of them are interchangeable. A source without words has target 0 and no copies. An empty table gives an
    empty table. Reruns agree. A source may hold any part of the rows, as the order is global and split by range; and there may be
    any number of sources, as the recipe is a table with one row for each (range, source), joined and never gathered.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("_crc"),
        row_tie().alias("_tie"),
        word_count(F.col(text_col)).alias("size"),
    )
    rows = rows.withColumn("_at", F.xxhash64(F.lit(seed), "doc_id", "_crc"))
    rows = in_global_order(cut(rows), F.col("source").asc_nulls_last(), *map(F.col, ("size", "_at", "doc_id", "_crc", "_tie")))
    # Nulls as a name and a mark, so that joins are plain equality.
    rows = rows.withColumn("_null", F.col("source").isNull()).withColumn("_src", F.coalesce("source", F.lit("")))
    groups = cut(rows.groupBy("_pid", "_src", "_null").agg(F.count("*").alias("n"), F.sum("size").alias("words"), F.min("_idx").alias("_first")))
    name = F.when(~F.col("_null"), F.col("_src")).alias("source")
    wanted = targets(groups.groupBy("_src", "_null").agg(F.sum("words").alias("source_size")).select(name, "source_size"), weights, share, most)
    wanted = wanted.withColumn("_null", F.col("source").isNull()).withColumn("_src", F.coalesce("source", F.lit("")))
    # A row's rank in its source is its place in its range and the rows of the source in earlier ranges.
    seen = F.coalesce(F.sum("n").over(Window.partitionBy("_src", "_null").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    recipe = groups.withColumn("_shift", seen - F.col("_first")).join(wanted.drop("source"), ["_src", "_null"])
    recipe = cut(recipe.select("_pid", "_src", "_null", "_shift", "source_size", "target"))
    out = rows.join(recipe, ["_pid", "_src", "_null"])
    start, u = F.col("_idx") + F.col("_shift"), offset(seed, F.col("source"))
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    crossed = F.floor(u + (start + 1) * expected) - F.floor(u + start * expected)
    return out.withColumn("copies", crossed.cast("long")).select(
        "doc_id",
        "source",
        F.col("_crc").alias("text_crc32"),
        "size",
        "source_size",
        "target",
        "copies",
        (F.col("copies") * F.col("size")).alias("taken"),
    )


def emit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **recipe) -> DataFrame:
    """The mix itself: the rows of docs with all their columns, each as often as mix_sources says.

    Rows are told apart by id, source and checksum of the text; of rows equal in these any may be emitted. Very many
    rows that are equal so (without an id, say) are spread over many tasks.
    """
    plan = mix_sources(docs, id_col=id_col, text_col=text_col, source_col=source_col, **recipe)

    def key(i: Column, source: Column, crc: Column) -> Column:
        return F.struct(i.isNull().alias("no_id"), F.coalesce(i, F.lit(0)).alias("id"), source.isNull().alias("no_source"), F.coalesce(source, F.lit("")).alias("source"), crc.alias("crc")).alias("_key")

    plan = plan.groupBy(key(F.col("doc_id"), F.col("source"), F.col("text_crc32"))).agg(F.sum("copies").alias("_copies"), F.count("*").alias("n"))
    plan = cut(plan)
    counts = plan.where("n > 1").select("_key", "n")
    wanted = plan.where("_copies > 0").select("_key", "_copies", F.col("n").alias("_rows"))
    crc = F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    rows = docs.select(key(F.col(id_col).cast("long"), F.col(source_col).cast("string"), crc), row_tie().alias("_tie"), F.struct("*").alias("_row"))

    def times(found: DataFrame, n: Column) -> DataFrame:
        return found.withColumn("_n", n).where("_n > 0").withColumn("_k", F.explode(F.sequence(F.lit(1).cast("long"), "_n"))).select("_row")

    out = times(spread_join(rows, wanted, "_key", "inner", hot_keys(counts, "_key"), F.col("_tie")), F.floor(F.col("_copies") / F.col("_rows")))
    uneven = wanted.where("_copies % _rows > 0")  # of repeated rows some are emitted once more
    most = uneven.agg(F.max(F.col("_copies") % F.col("_rows"))).first()[0]
    if most:
        # One row stands for its equals; partial aggregation leaves one of each task.
        one = rows.join(uneven.select("_key"), "_key", "left_semi").groupBy("_key").agg(F.first("_row").alias("_row")).join(uneven, "_key")
        extra = F.col("_copies") % F.col("_rows")
        if most > CHUNK:
            begins = F.explode(F.sequence(F.lit(0).cast("long"), extra - 1, F.lit(CHUNK).cast("long")))
            one = one.withColumn("_extra", extra).withColumn("_from", begins).repartition(shuffle_partitions(docs.sparkSession), "_key", "_from")
            extra = F.least(F.col("_extra") - F.col("_from"), F.lit(CHUNK).cast("long"))
        out = out.unionAll(times(one, extra))
    return out.select("_row.*")
