"""Document fingerprints of closed syncmers.

A K-byte window of the text is an anchor if the smallest of its S-byte inner substrings (by hash) lies at
either edge. Whether a window is chosen depends on its own bytes alone, so the same passage has
the same anchors wherever it stands, and every K + (K - S) bytes hold at least one. A fingerprint is the anchors' short
hashes in text order. Two fingerprints are matched by position: what counts are pairs of neighbouring anchors that stand
the same distance apart in both texts.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_right

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wiretally.llm.common import BATCH_BYTES, blocks_for, cut, in_global_order, row_tie, shuffle_partitions, small_batches, text_or_empty, to_batch

#: Small enough that a line of text holds anchors; S bytes are one 64-bit word at most.
K, S = 16, 6
#: Bytes of an anchor's hash in a fingerprint; three make four characters of base64.
HASH_BYTES = 3
#: Text that a partition holds at most, roughly.
PARTITION_BYTES = 128 << 20
MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
HALF, MASK = np.uint64(32), np.uint64((1 << 8 * S) - 1)


def anchors(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte places and 64-bit hashes of the anchors, in order. A text too short to have one is an anchor as a whole;
    in a run of equal anchors only the first counts. No bytes: no anchors."""
    n = len(data)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    if n >= K:
        m = n - S + 1
        inner = np.empty(m, np.uint64)
        padded = data + bytes(8)
        for r in range(8):
            part = inner[r::8]
            part[:] = np.frombuffer(padded, "<u8", (n + 8 - r) // 8, r)[: len(part)]
        inner &= MASK
        inner *= MULTIPLIERS[0]
        inner ^= inner >> HALF
        inner *= MULTIPLIERS[1]
        inner ^= inner >> HALF
        w = K - S + 1
        least, width = inner, 1
        while width * 2 <= w:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < w:
            least = np.minimum(least[: m - w + 1], least[w - width :])
        at = np.flatnonzero((least == inner[: m - w + 1]) | (least == inner[w - 1 :]))
        if len(at):
            # The inner substrings at these places cover the whole window.
            h = inner[at] * MULTIPLIERS[1] + inner[at + S] * MULTIPLIERS[2] + inner[at + K - S] * MULTIPLIERS[3]
            h ^= h >> HALF
            h *= MULTIPLIERS[0]
            if len(at) > 1:
                new = np.empty(len(at), bool)
                new[0] = True
                np.not_equal(h[1:], h[:-1], out=new[1:])
                at, h = at[new], h[new]
            return at, h
    whole = int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "big")
    return np.zeros(1, np.int64), np.array([whole], np.uint64)


def short_hashes(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - 8 * HASH_BYTES)).astype(np.uint32)


def spell(short: np.ndarray) -> str:
    """The fingerprint: the hashes in order, each as HASH_BYTES bytes, in base64."""
    raw = short.astype(">u4").view(np.uint8).reshape(-1, 4)[:, 4 - HASH_BYTES :]
    return base64.b64encode(raw.tobytes()).decode()


def read(fingerprint: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(fingerprint), np.uint8).reshape(-1, HASH_BYTES).astype(np.uint32)
    return (raw[:, 0] << 16) | (raw[:, 1] << 8) | raw[:, 2]


def distinct(values: np.ndarray) -> np.ndarray:
    if len(values) < 2:
        return values
    s = np.sort(values)
    return s[np.concatenate(([True], s[1:] != s[:-1]))]


def steps(at: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Sorted distinct hashes of the steps from each anchor to the next: both anchors, in full, and the bytes between them. A
    text of one anchor has that one."""
    if len(h) < 2:
        return h
    x = h[:-1] * MULTIPLIERS[2] + np.diff(at).astype(np.uint64) * MULTIPLIERS[3]
    x ^= x >> HALF
    x = (x + h[1:]) * MULTIPLIERS[0]
    x ^= x >> HALF
    return distinct(x)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Twice the distinct steps in common, over those of both (sorted, distinct); 1 for two without any."""
    if not len(a) and not len(b):
        return 1.0
    both = np.sort(np.concatenate((a, b)))
    return 2.0 * float(np.count_nonzero(both[1:] == both[:-1])) / (len(a) + len(b))


def matching_spans(a: bytes, b: bytes) -> list[tuple[int, int, int]]:
    """(place in a, place in b, bytes) of passages that the two texts share by their anchors: those of one offset
    that follow each other closely are one passage."""
    (pa_, ha), (pb, hb) = anchors(a), anchors(b)
    where: dict[int, list[int]] = {}
    for p, h in zip(pb.tolist(), hb.tolist(), strict=True):
        where.setdefault(h, []).append(p)
    hits = sorted((q - p, p) for p, h in zip(pa_.tolist(), ha.tolist(), strict=True) for q in where.get(h, ()))
    out: list[list[int]] = []
    for shift, p in hits:
        if out and out[-1][1] - out[-1][0] == shift and p <= out[-1][0] + out[-1][2] + K:
            out[-1][2] = p + K - out[-1][0]
        else:
            out.append([p, p + shift, K])
    return [tuple(x) for x in out]


def fingerprint(text: str) -> str:
    return spell(short_hashes(anchors(text.encode())[1]))


def edited(text: str, following: str) -> str:
    """The last half of the text's characters replaced by as many (or all) of the next text's first ones."""
    h = len(text) // 2
    return text[: len(text) - h] + following[:h]


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of whole texts, of their edited texts, and how like they and the next document are.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, one row for each
    input row. The next document is the next in order of id (null ids last; rows of one id by a hash of their text; rows
    equal in both are interchangeable), after the last the first; a lone row follows itself. A null text
    counts as empty: no anchors, empty fingerprint. Further columns are ignored; an empty table gives an empty one.

    Texts are shuffled once, to ranges of ids; the first row of each range also goes to the range before it. Of very many rows
    that are equal in id and text one goes on and is returned as often as they came: each but the last follows itself.
    """
    spark = docs.sparkSession
    text = text_or_empty(text_col)
    rows = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("_h"), text.alias("text"))
    rows = rows.withColumn("_key", F.coalesce("doc_id", F.lit((1 << 63) - 1)))
    narrow = rows.select("_key", "_h", F.octet_length("text").alias("_bytes"), row_tie().alias("_tie"))
    order = in_global_order(narrow, *map(F.col, ("_key", "_h", "_tie")))
    total = order.agg(F.count("*").alias("n"), F.sum("_bytes").alias("b")).first()
    n_ranges = max(shuffle_partitions(spark), blocks_for(total["b"] or 0, PARTITION_BYTES))
    step = max(1, -(-total["n"] // n_ranges))
    # First keys of the ranges: as many as there are ranges, and one more for each partition.
    firsts = sorted({(r[0], r[1]) for r in order.where(F.col("_idx") % step == 0).select("_key", "_h").collect()}) or [(0, 0)]
    keys = np.array([k for k, _ in firsts], np.int64)
    # Rows that are equal in id and text and fill more than a range's share: fewer such keys than there are ranges. They
    # are first keys, since more rows than lie between two first rows are theirs.
    crowd = {(r[0], r[1]): r[2] for r in order.groupBy("_key", "_h").agg(F.count("*").alias("n")).where(F.col("n") > step).collect()}

    @F.pandas_udf("int")
    def range_of(key: pd.Series, h: pd.Series) -> pd.Series:
        """The number of the row's range; -1 - number if it is the range's first key."""
        k = key.to_numpy()
        last = np.searchsorted(keys, k, "right") - 1
        for i in np.flatnonzero(keys[np.maximum(last, 0)] == k):
            pair = (int(k[i]), int(h.iloc[i]))
            j = bisect_right(firsts, pair) - 1
            last[i] = -1 - j if j >= 0 and firsts[j] == pair else j
        return pd.Series(last.astype(np.int32))

    rows = rows.withColumn("_times", F.lit(1).cast("long"))
    if crowd:
        table = F.broadcast(spark.createDataFrame([(k, h, n) for (k, h), n in crowd.items()], "_key long, _h long, _n long"))
        rows = rows.join(table, ["_key", "_h"], "left")
        one = rows.where("_n IS NOT NULL").groupBy("_key", "_h").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.first("_n").alias("_times"))
        rows = rows.where("_n IS NULL").drop("_n").unionByName(one)
    n = len(firsts)
    at = F.col("_range")
    own = F.when(at < 0, -1 - at).otherwise(at)
    places = F.when(at < 0, F.array(F.struct(own.alias("r"), F.lit(False).alias("d")), F.struct(((own + n - 1) % n).alias("r"), F.lit(True).alias("d"))))
    places = places.otherwise(F.array(F.struct(own.alias("r"), F.lit(False).alias("d"))))
    dealt = rows.withColumn("_range", range_of("_key", "_h")).withColumn("_p", F.explode(places))
    dealt = dealt.select(F.col("_p.r").alias("_r"), F.col("_p.d").alias("_d"), "_key", "_h", "doc_id", "text", "_times")
    dealt = dealt.repartitionById(n, F.col("_r")).sortWithinPartitions("_d", "_key", "_h")
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string())]
        + [("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("_times", pa.int64())]
    )

    def run(batches):
        held, size, prev = [], 0, None
        for b in batches:
            columns = (b.column("doc_id").to_pylist(), b.column("text"), b.column("_d").to_pylist(), b.column("_times").to_pylist())
            for i, t, extra, times in zip(*columns, strict=True):
                t = t.as_py()
                at, h = anchors(t.encode())
                now = (i, t, short_hashes(h), steps(at, h))
                pairs = [(prev, now, 1)] if prev is not None else []
                if times > 1 and not extra:
                    pairs.append((now, now, times - 1))
                for one, following, n_times in pairs:
                    held.append((*compare(one, following), n_times))
                    size += len(held[-1][3]) + len(held[-1][4])
                    if size > BATCH_BYTES:
                        yield to_batch(held, schema)
                        held, size = [], 0
                prev = now
                if extra:  # the next range's first row ends this one
                    break
            if prev is not None and extra:
                break
        for _ in batches:
            pass
        if held:
            yield to_batch(held, schema)

    out = dealt.select("doc_id", "text", "_d", "_times").mapInArrow(
        run,
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string,"
        " near_edited double, near_next double, _times long",
    )
    if crowd:
        out = out.withColumn("_k", F.explode(F.sequence(F.lit(1).cast("long"), "_times"))).drop("_k")
    return out.drop("_times")


def compare(one: tuple, following: tuple) -> tuple:
    doc_id, text, short, own = one
    data = edited(text, following[1]).encode()
    at, h = anchors(data)
    return (
        doc_id,
        len(text),
        hashlib.sha256(data).hexdigest(),
        spell(short),
        spell(short_hashes(h)),
        likeness(own, steps(at, h)),
        likeness(own, following[3]),
    )
