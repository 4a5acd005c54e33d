"""Near-duplicates by bottom-k sketches of one hash function.

A document is the set of its distinct five-word shingles; documents link if 100 * |A and B| >= 75 * |A or B|.

1. Equal sets are one node, told apart by a 128-bit digest; copies never meet each other again.
2. A node's sketch is the SKETCH smallest hashes of its set. Two linked sets share many retained values (fewer than
   OVERLAP of them with a chance below 1e-9). So a value needs an inverted list only where it is among the
   rarest of its sketch: two sketches that share o values share one of their (size - o + 1) rarest ones. Lists of
   passages that many documents hold are thus left out by proof, not by a cap.
3. Each list pairs its members with one hub, the most central one. Pairs pass if the union sketch puts their
   similarity within reach of the threshold, then full sets are compared. Components of these links are found.
4. All lists of one hub are one star. Stars whose members are still in several components are left. They are cut
   into blocks, and each pair of blocks compares the full sets of different components in one task, which
   returns only links that join components. So near copies cost one pair each, and what is compared beyond that
   is never spelled out as rows.
5. A star of many blocks would cost their square: many unlike documents with much boilerplate in common. Its members get
   new lists instead, of the rarest quarter of their full sets, which is where two linked sets must share a value.
   Unlike members have values of their own there, so these lists are short; they go through steps 3 and 4.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from wiretally.llm.common import HOT_ROWS, MOST_HOT, bytes_of, cut, hot_keys, key_table, shuffle_partitions, small_batches, spread_join, text_or_empty

WORDS = 5
#: Similarity in hundredths from which documents link.
PERCENT = 75
SKETCH, OVERLAP = 64, 25
#: Documents and shingles of a block of a star, roughly.
BLOCK_DOCS, BLOCK_SHINGLES = 128, 200_000
#: Stars of more blocks get lists of their members' full sets first. Up to here a text is dealt to so many tasks at most, which
#: costs about what several shuffles of its postings do.
STAR_BLOCKS = 64
#: Members that are compared with one copy of their hub's text.
HUB_MEMBERS = 20_000
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_RNG = np.random.default_rng(20)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_PLACE = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_STEP = np.uint64(0x5851F42D4C957F2D)
_32, _29 = np.uint64(32), np.uint64(29)


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _32)
    x *= _PLACE[0]
    x ^= x >> _29
    x *= _PLACE[1]
    x ^= x >> _32
    return x


_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """_STEP ** 0 .. n-1, modulo 2**64."""
    global _powers
    if len(_powers) < n:
        out = np.full(max(n, 1 << 16), _STEP, np.uint64)
        out[0] = 1
        _powers = np.cumprod(out)
    return _powers[:n]


_INVERSE = np.uint64(pow(int(_STEP), -1, 1 << 64))
_inverses = np.ones(1, np.uint64)


def inverses(n: int) -> np.ndarray:
    global _inverses
    if len(_inverses) < n:
        out = np.full(max(n, 1 << 16), _INVERSE, np.uint64)
        out[0] = 1
        _inverses = np.cumprod(out)
    return _inverses[:n]


def shingles(data: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles (of all words as one, if there are fewer than `words`)."""
    raw = np.frombuffer(data.lower(), np.uint8)  # bytes.lower() changes A-Z only
    n = len(raw)
    if not n:
        return np.empty(0, np.uint64)
    space = _SPACE[raw]
    edge = np.flatnonzero(np.diff(space, prepend=True, append=True))
    start, end = edge[::2], edge[1::2]
    m = len(start)
    if not m:
        return np.empty(0, np.uint64)
    # A word's hash is the sum of its bytes' numbers times powers of a step, from prefix sums over the text.
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(_BYTE[raw] * powers(n), out=total[1:])
    word = mixed((total[end] - total[start]) * inverses(n)[start] + (end - start).astype(np.uint64))
    k = min(words, m)
    h = word[: m - k + 1] * _PLACE[0]
    for i in range(1, k):
        h ^= h >> _29
        h += word[i : m - k + 1 + i] * _PLACE[i % 5]
        h *= _STEP
    h = np.sort(mixed(h + np.uint64(k)))
    return h[np.concatenate(([True], h[1:] != h[:-1]))]


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether two sorted distinct sets are similar enough, on the full sets."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)) or not len(a) or not len(b):
        return False
    both = np.sort(np.concatenate((a, b)))
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * common >= percent * (len(a) + len(b) - common)


def within_reach(a: np.ndarray, b: np.ndarray, na: int, nb: int) -> bool:
    """The union sketch's verdict: the bottom values of both sketches' union, and how many both hold. A sketch that
    holds its whole set leaves no doubt beyond the other's cut."""
    if 100 * min(na, nb) < PERCENT * max(na, nb):
        return False
    both = np.sort(np.concatenate((a, b)))
    twice = both[1:] == both[:-1]
    size = len(both) - int(np.count_nonzero(twice))
    if size <= SKETCH or (len(a) == na and len(b) == nb):
        return 100 * int(np.count_nonzero(twice)) >= PERCENT * size
    # Values up to the smaller of the two cuts are known of both.
    cut_at = min((s[-1] for s, n in ((a, na), (b, nb)) if len(s) < n), default=both[-1])
    known = int(np.searchsorted(both, cut_at, "right"))
    common = int(np.count_nonzero(twice[: max(known - 1, 0)]))
    return common >= min_common(known - common)


def min_common(size: int) -> int:
    """Fewest of `size` union values that both must hold: seven standard deviations below what the threshold expects."""
    p = PERCENT / 100
    return max(0, math.floor(p * size - 7 * math.sqrt(size * p * (1 - p))))


def overlap_needed(n: int) -> int:
    """How many retained values a node of n shingles must share with any node that it links with.

    A node that is retained whole (n <= SKETCH) shares 75 % of its set with the other's full set, whose size is n / 0.75
    at most; of the common values at least SKETCH - n / 3 are within the other's sketch.
    """
    return min(-(-PERCENT * n // 100), 2 * SKETCH // 3) if n <= SKETCH else OVERLAP


def digest_of(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def sketch_rows(batches):
    for b in batches:
        ns, digests, sketches = [], [], []
        for data in bytes_of(b):
            s = shingles(data)
            ns.append(len(s))
            digests.append(digest_of(s))
            sketches.append(s[:SKETCH].tobytes())
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("text_hash"), pa.array(ns, pa.int64()), pa.array(digests, pa.binary()), pa.array(sketches, pa.binary())],
            names=["doc_id", "text_hash", "n_shingles", "digest", "sketch"],
        )


def postings(batches):
    """One row for each retained value of a node."""
    for b in batches:
        nodes, ns = b.column("node").to_numpy(), b.column("n").to_numpy()
        sketches = [np.frombuffer(x.as_py(), np.int64) for x in b.column("sketch")]
        if sketches:
            sizes = [len(s) for s in sketches]
            arrays = [pa.array(np.concatenate(sketches)), pa.array(np.repeat(nodes, sizes)), pa.array(np.repeat(ns, sizes))]
            yield pa.RecordBatch.from_arrays(arrays, names=["value", "node", "n"])


def full_sets(batches):
    """The nodes with all values of their sets, in the place of a sketch."""
    for b in batches:
        sets = [shingles(t) for t in bytes_of(b)]
        arrays = [b.column("node"), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())]
        yield pa.RecordBatch.from_arrays(arrays, names=["node", "n", "sketch"])


def confirm(batches):
    """Links among candidate pairs: those that the union sketch lets pass, confirmed on the full sets."""
    name, of_name = None, None
    for b in batches:
        keep = []
        for a, ta, tb in zip(b.column("a").to_pylist(), b.column("ta"), b.column("tb"), strict=True):
            if name != a:
                name, of_name = a, shingles(ta.as_py().encode())
            other = shingles(tb.as_py().encode())
            near = within_reach(of_name[:SKETCH], other[:SKETCH], len(of_name), len(other))
            keep.append(near and linked(of_name, other))
        yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def right_text(batches):
    """Rows whose text has the node's digest; another row may have the same id."""
    for b in batches:
        keep = [digest_of(shingles(t)) == d.as_py() for t, d in zip(bytes_of(b), b.column("digest"), strict=True)]
        yield b.select(["node", "text"]).filter(pa.array(keep, pa.bool_()))


def compare_blocks(batches):
    """Links that join components among the documents of each pair of blocks; rows are sorted by (hub, i, j)."""
    held: list[tuple] = []
    key = None
    for b in batches:
        columns = [b.column(c).to_pylist() for c in ("hub", "i", "j", "node", "comp")]
        for h, i, j, node, comp, text in zip(*columns, bytes_of(b), strict=True):
            if key != (h, i, j):
                yield from joining_links(held)
                key, held = (h, i, j), []
            held.append((node, comp, shingles(text)))
    yield from joining_links(held)


def joining_links(docs: list[tuple]):
    """docs: (node, comp, set). A forest of links between components, found on the full sets, as pairs of components."""
    if len({d[1] for d in docs}) < 2:
        return
    sizes = np.array([len(d[2]) for d in docs], np.int64)
    every = np.concatenate([d[2] for d in docs])
    owner = np.repeat(np.arange(len(docs)), sizes)
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    first = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1])))
    count = np.diff(np.append(first, len(every)))
    common = np.zeros((len(docs), len(docs)), np.float32)
    # Shared values a slice at a time: counts of common values are a product of 0/1 matrices, exact in float32.
    shared = np.flatnonzero(count > 1)
    for at in range(0, len(shared), 4096):
        part = shared[at : at + 4096]
        mark = np.zeros((len(docs), len(part)), np.float32)
        of_value = np.repeat(np.arange(len(part)), count[part])
        where = np.concatenate([np.arange(f, f + c) for f, c in zip(first[part], count[part], strict=True)])
        mark[owner[where], of_value] = 1
        common += mark @ mark.T
    both = common.astype(np.int64)
    hit = 100 * both >= PERCENT * (sizes[:, None] + sizes[None, :] - both)
    parent = {d[1]: d[1] for d in docs}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    found = []
    for x, y in np.argwhere(np.triu(hit, 1)):
        rx, ry = root(docs[x][1]), root(docs[y][1])
        if rx != ry:
            parent[rx] = ry
            found.append((docs[x][1], docs[y][1]))
    if found:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """node and comp (the smallest node that it reaches) for all nodes of the edges (a, b). Nodes of very many edges, and
    labels of very many nodes, are spread over tasks."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = cut(both.coalesce(shuffle_partitions(edges.sparkSession)))
    label = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("comp"), F.count("*").alias("n"))
    label = cut(label.withColumn("comp", F.least("node", "comp")))
    hubs = [r["node"] for r in label.where(F.col("n") > HOT_ROWS).orderBy(F.desc("n")).limit(MOST_HOT).collect()]
    crowded, label = key_table(both, "b", hubs), label.drop("n")
    while True:
        # The least label of the neighbours, then the label of that label. What hubs are labelled, their many neighbours are too.
        seen = spread_join(both, label.withColumnRenamed("node", "b"), "b", "inner", crowded, F.col("a")).groupBy("a").agg(F.min("comp").alias("near"))
        low = label.join(seen, label["node"] == seen["a"]).select("node", "comp", F.least("comp", "near").alias("low"))
        jump = label.select(F.col("node").alias("low"), F.col("comp").alias("far"))
        named = {r["comp"] for r in label.where(F.col("node").isin(hubs)).collect()} if hubs else set()
        common = key_table(jump, "low", sorted(named | set(hubs)))
        following = cut(spread_join(low, jump, "low", "inner", common, F.col("node")).select("node", F.least("low", "far").alias("next"), "comp"))
        changed = not following.where(F.col("next") != F.col("comp")).isEmpty()
        label = following.select("node", F.col("next").alias("comp"))
        if not changed:
            return label


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Component of every row: doc_id, n_shingles, component_id, kept; one row for each input row.

    component_id is the smallest doc_id reachable by links, itself included; kept says that it is the row's own. A null
    or blank text has no shingles and links with nothing. Rows with a null id have a null component_id, are kept and
    link nothing. Rows that repeat an id are separate nodes unless their sets are equal. Further columns are ignored; an
    empty table gives an empty table.
    """
    out = rows_in_components(docs, id_col, text_col)
    out = out.withColumn(
        "component_id", F.when(F.col("n_shingles") > 0, F.least("component_id", "doc_id")).otherwise(F.col("doc_id"))
    )
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")))
    return out.select(
        "doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept")
    )


def row_key(id_col: str = "doc_id", text_col: str = "text") -> list[Column]:
    """Rows of one id and text are one to the components; their key is the id and a hash of the text."""
    return [F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_or_empty(text_col)).alias("text_hash")]


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, but one row only of each component: one of smallest id. Rows without an id
    or without shingles stay."""
    rows = rows_in_components(docs, id_col, text_col).where("n_shingles > 0 AND doc_id IS NOT NULL")
    rows = cut(rows.select("comp", F.struct("doc_id", "digest", "text_hash").alias("row")))
    crowded = cut(rows.groupBy("comp").agg(F.min("row").alias("first"), F.count("*").alias("n")).where("n > 1"))
    others = spread_join(rows, crowded.drop("n"), "comp", "inner", hot_keys(crowded.select("comp", "n"), "comp"), F.col("row"))
    others = cut(others.groupBy("row", "first").agg(F.count("*").alias("n")))
    key = F.struct("doc_id", "text_hash").alias("_key")
    gone = others.where("row <> first").select(F.struct("row.doc_id", "row.text_hash").alias("_key"))
    left = docs.select(*row_key(id_col, text_col), F.struct("*").alias("_row")).select(key, "_row")
    again = others.where("row = first AND n > 1").select(F.struct("row.doc_id", "row.text_hash").alias("_key"))
    # Of repeated rows one stays: all of them go, and one of each comes back.
    kept = left.join(gone.unionAll(again), "_key", "left_anti").select("_row")
    if not again.isEmpty():
        once = left.join(again, "_key", "left_semi").groupBy("_key").agg(F.first("_row").alias("_row"))
        kept = kept.unionByName(once.select("_row"))
    return kept.select("_row.*")


def rows_in_components(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text_hash, n_shingles, digest, comp, component_id of every row. comp numbers the components, as two of them
    may have the same smallest id; it and component_id are null for rows without an id or shingles."""
    texts = small_batches(docs).select(*row_key(id_col, text_col), text_or_empty(text_col).alias("text"))
    rows = cut(texts.mapInArrow(sketch_rows, "doc_id long, text_hash long, n_shingles long, digest binary, sketch binary"))
    linkable = F.coalesce((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.lit(False))
    nodes = rows.where(linkable).groupBy("digest").agg(
        F.min("doc_id").alias("min_id"), F.max("n_shingles").alias("n"), F.first("sketch").alias("sketch"), F.count("*").alias("copies")
    )
    nodes = cut(nodes.withColumn("node", F.monotonically_increasing_id()))
    whole = F.least(F.ceil(F.col("n") * PERCENT / 100), F.lit(2 * SKETCH // 3))
    needed = F.when(F.col("n") <= SKETCH, whole).otherwise(OVERLAP)
    stars = stars_of(inverted_lists(nodes.select("node", "n", "sketch"), needed))

    # Whole texts of all members, gathered once. Rows that repeat id and text are one.
    named = stars.select("node").distinct().join(nodes.select("node", "min_id", "digest"), "node")
    members = texts.join(named, texts["doc_id"] == named["min_id"])
    members = members.dropDuplicates(["doc_id", "node", "text"]).select("node", "digest", "text")
    members = cut(members.mapInArrow(right_text, "node long, text string"))
    links = hub_links(stars, members)
    comp = components(links)
    left, split = unresolved(stars, comp)
    more = block_links(left, split.where(F.col("blocks") <= STAR_BLOCKS), members)
    large = split.where(F.col("blocks") > STAR_BLOCKS)
    if not large.isEmpty():
        crowd = left.join(large.select("hub"), "hub", "left_semi").select("node").distinct()
        sets = members.join(crowd, "node").mapInArrow(full_sets, "node long, n long, sketch binary")
        finer = stars_of(inverted_lists(sets, F.ceil(F.col("n") * PERCENT / 100)))
        # Ends of `more` are nodes too: a component goes by one of its own.
        links = links.unionAll(more).unionAll(hub_links(finer, members))
        comp = components(links)
        left, split = unresolved(finer, comp)
        more = block_links(left, split, members)
    comp = nodes.select("node").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    if not more.isEmpty():
        # Links between components: their components name the final ones. Of a component this has one row for each distinct
        # text; Spark splits one that is very large.
        again = components(more).select(F.col("node").alias("comp"), F.col("comp").alias("_last"))
        comp = comp.join(again, "comp", "left").select("node", F.coalesce("_last", "comp").alias("comp"))

    # Components by node number; their name is the smallest id of all their nodes.
    ids = cut(nodes.select("node", "digest", "min_id", "copies").join(comp, "node"))
    names = cut(ids.groupBy("comp").agg(F.min("min_id").alias("component_id"), F.count("*").alias("n")))
    named = spread_join(ids.select("comp", "digest", "copies"), names.drop("n"), "comp", "inner", hot_keys(names.select("comp", "n"), "comp"), F.col("digest"))
    named = cut(named)
    columns = ["doc_id", "text_hash", "n_shingles", "digest"]
    frequent = hot_keys(named.select("digest", F.col("copies").alias("n")), "digest")
    tie = F.struct("doc_id", "text_hash")
    out = spread_join(rows.where(linkable).select(*columns), named.drop("copies"), "digest", "inner", frequent, tie)
    alone = rows.where(~linkable).select(*columns, F.lit(None).cast("long").alias("comp"), F.lit(None).cast("long").alias("component_id"))
    return out.select(*columns, "comp", "component_id").unionByName(alone)


def inverted_lists(nodes: DataFrame, needed: Column) -> DataFrame:
    """value, node, n, central: each node under those of its shared values that are among its rarest. Two linked nodes have at
    least `needed` of each other's values in common, so they meet in one of these lists; central is how common a node's values are."""
    lists = nodes.mapInArrow(postings, "value long, node long, n long")
    shared = cut(lists.groupBy("value").agg(F.count("*").alias("df")).where("df > 1"))
    # Values of one sketch only are the rarest; the shared ones follow by frequency.
    w = Window.partitionBy("node")
    frequent = hot_keys(shared.select("value", F.col("df").alias("n")), "value")
    lists = spread_join(lists, shared, "value", "inner", frequent, F.col("node")).withColumns(
        {
            "place": F.row_number().over(w.orderBy("df", "value")),
            "common": F.count("*").over(w),
            "central": F.sum("df").over(w),
        }
    )
    return cut(lists.where(F.col("place") + needed - 1 <= F.col("common")).select("value", "node", "n", "central"))


def stars_of(lists: DataFrame) -> DataFrame:
    """hub, node, n, members: every node of a list with the list's hub, once for each hub; members is the size of the list."""
    hubs = lists.groupBy("value").agg(F.max_by("node", F.struct("central", -F.col("node"))).alias("hub"), F.count("*").alias("members"))
    hubs = cut(hubs.where("members > 1"))
    frequent = hot_keys(hubs.select("value", F.col("members").alias("n")), "value")
    stars = spread_join(lists.drop("central"), hubs, "value", "inner", frequent, F.col("node"))
    return cut(stars.groupBy("hub", "node").agg(F.first("n").alias("n"), F.max("members").alias("members")))


def hub_links(stars: DataFrame, members: DataFrame) -> DataFrame:
    """Links a, b between hubs and members, confirmed on the full sets. A hub's text is repeated for each HUB_MEMBERS members."""
    salt = F.pmod(F.xxhash64("node"), F.ceil(F.col("members") / HUB_MEMBERS)).alias("salt")
    pairs = stars.where("node <> hub").select(F.col("hub").alias("a"), salt, F.col("node").alias("b"))
    text = lambda x: members.select(F.col("node").alias(x), F.col("text").alias(f"t{x}"))
    hubs = pairs.select("a", "salt").distinct().join(text("a"), "a")
    pairs = pairs.join(text("b"), "b").join(hubs, ["a", "salt"]).sortWithinPartitions("a").select("a", "b", "ta", "tb")
    return cut(pairs.mapInArrow(confirm, "a long, b long"))


def unresolved(stars: DataFrame, comp: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stars with the components of their members; and of those with more than one: hub, blocks, members."""
    placed = cut(stars.drop("members").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node")))
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK_DOCS), F.ceil(F.sum("n") / BLOCK_SHINGLES))
    split = placed.groupBy("hub").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), blocks.cast("int").alias("blocks"), F.count("*").alias("members"))
    return placed, cut(split.where("c0 <> c1").select("hub", "blocks", "members"))


def block_links(placed: DataFrame, split: DataFrame, members: DataFrame) -> DataFrame:
    """Links a, b that join components, of all pairs of blocks of each star. A document goes to every pair that has its own."""
    frequent = hot_keys(split.select("hub", F.col("members").alias("n")), "hub")
    dealt = spread_join(placed, split.drop("members"), "hub", "inner", frequent, F.col("node"))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("hub", "node", "comp", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    dealt = dealt.join(members, "node").repartition("hub", "i", "j").sortWithinPartitions("hub", "i", "j")
    return cut(dealt.select("hub", "i", "j", "node", "comp", "text").mapInArrow(compare_blocks, "a long, b long"))
