"""Quality scores by a generalised additive model with pairwise interactions.

Each feature of a text is binned; cyclic boosting fits a shallow tree to one feature at a time and adds its steps to
that feature's lookup table, in turn over all features and rounds; then the pairs whose residuals promise most get
two-dimensional tables by shallow trees of one cut on each axis. A score is the sum of the table entries of the
document's bins, through the logistic function: vectorised additions, no tree at scoring time.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wiretally.llm.common import bytes_of, small_batches, text_or_empty

#: Labelled rows that the model is fitted on at most: the smallest by a hash of the id.
MOST_LABELLED = 20_000
HOLD_OUT = 5
THRESHOLD = 0.3

FEATURES = (
    "log_bytes", "log_words", "word_bytes", "upper", "digit", "space", "newline", "non_ascii", "comma_stop",
    "symbol", "bang", "bar", "distinct_words", "top_word", "stop_ends", "symbol_ends", "log_lines", "line_bytes",
    "distinct_lines", "short_lines", "distinct_pairs", "long_words", "one_byte_words", "links",
)
#: Class of each byte: 0 other, then upper case, digit, space, newline, above ASCII, comma or stop, symbol, mark, bar.
_CLASS = np.zeros(256, np.int64)
for _i, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\x0b\x0c\r", b"\n", bytes(range(128, 256)), b",.", b"#$%&*+=<>@^_~\\/{}[]`", b"!?", b"|"), 1):
    _CLASS[list(_chars)] = _i


def features(data: bytes) -> list[float]:
    """The features of one whole text (UTF-8), in the order of FEATURES; all are finite, also for an empty text."""
    n = len(data)
    of = np.bincount(_CLASS, np.bincount(np.frombuffer(data, np.uint8), minlength=256), 10) / max(n, 1)
    words = data.split()
    m = len(words)
    lines = [x for x in data.split(b"\n") if x.strip()]
    k = len(lines)
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    ends = b"".join([w[-1:] for w in words])
    stops = ends.count(b".") + ends.count(b",")
    end_class = np.bincount(_CLASS[np.frombuffer(ends, np.uint8)], minlength=10) if m else np.zeros(10)
    lengths = [*map(len, words)]
    return [
        math.log1p(n),
        math.log1p(m),
        (sum(lengths) / m) if m else 0.0,
        *of[[1, 2, 3, 4, 5, 6, 7, 8, 9]].tolist(),
        len(counts) / m if m else 0.0,
        max(counts.values()) / m if m else 0.0,
        stops / m if m else 0.0,
        (end_class[7] + end_class[8] + end_class[9]) / m if m else 0.0,
        math.log1p(k),
        sum(map(len, lines)) / k if k else 0.0,
        len(set(lines)) / k if k else 0.0,
        sum(len(x) < 40 for x in lines) / k if k else 0.0,
        len(set(zip(words, words[1:]))) / (m - 1) if m > 1 else 0.0,
        sum(x > 20 for x in lengths) / m if m else 0.0,
        lengths.count(1) / m if m else 0.0,
        data.count(b"://") / m if m else 0.0,
    ]


@dataclass
class Additive:
    """A fitted model: cuts of each feature, its table, and tables of pairs of features."""

    cuts: list[np.ndarray]
    base: float = 0.0
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], "right") for j, c in enumerate(self.cuts)], 1)

    def margin(self, bins: np.ndarray) -> np.ndarray:
        out = np.full(len(bins), self.base)
        for j, t in enumerate(self.tables):
            out += t[bins[:, j]]
        for (i, j), t in self.pairs.items():
            out += t[bins[:, i], bins[:, j]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.margin(self.bins(x)), -40, 40)))


def steps(gradient: np.ndarray, weight: np.ndarray, depth: int, least: float) -> np.ndarray:
    """A shallow tree over the bins of one feature: the value of each bin's leaf."""
    out = np.zeros(len(gradient))
    parts = [(0, len(gradient))]
    for _ in range(depth):
        cut = []
        for a, b in parts:
            g, w = np.cumsum(gradient[a:b]), np.cumsum(weight[a:b])
            left, right = w[:-1], w[-1] - w[:-1]
            gain = np.where(
                (left >= least) & (right >= least),
                g[:-1] ** 2 / (left + 1) + (g[-1] - g[:-1]) ** 2 / (right + 1) - g[-1] ** 2 / (w[-1] + 1),
                0.0,
            )
            k = int(np.argmax(gain)) if len(gain) else 0
            cut += [(a, a + k + 1), (a + k + 1, b)] if len(gain) and gain[k] > 1e-9 else [(a, b)]
        parts = cut
    for a, b in parts:
        out[a:b] = gradient[a:b].sum() / (weight[a:b].sum() + 1)
    return out


def quarters(gradient: np.ndarray, weight: np.ndarray, least: float) -> tuple[float, np.ndarray]:
    """The best tree of one cut on each axis over the bins of two features: its gain and the cells' values."""
    g, w = gradient.cumsum(0).cumsum(1), weight.cumsum(0).cumsum(1)
    gs, ws = [], []
    for table, out in ((g, gs), (w, ws)):
        a = table[:-1, :-1]
        top, left, total = table[:-1, -1:], table[-1:, :-1], table[-1, -1]
        out += [a, top - a, left - a, total - top - left + a]
    gain = sum(x**2 / (y + 1) for x, y in zip(gs, ws, strict=True))
    gain = np.where(np.minimum.reduce(ws) >= least, gain, 0.0)
    if not gain.size or gain.max() <= 1e-9:
        return 0.0, np.zeros_like(gradient)
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    out = np.empty_like(gradient)
    for k, (rows, cols) in enumerate(((slice(None, i + 1), slice(None, j + 1)), (slice(None, i + 1), slice(j + 1, None)), (slice(i + 1, None), slice(None, j + 1)), (slice(i + 1, None), slice(j + 1, None)))):
        out[rows, cols] = gs[k][i, j] / (ws[k][i, j] + 1)
    return float(gain[i, j]), out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 150, pair_rounds: int = 30, n_pairs: int = 6, n_bins: int = 32, rate: float = 0.1) -> Additive:
    """Cyclic boosting on logistic loss. Without rows, or with one class only, all tables are zero and the base
    is that of the smoothed share of ones."""
    cuts = []
    for j in range(x.shape[1]):
        c = np.unique(np.quantile(x[:, j], np.arange(1, n_bins) / n_bins)) if len(x) else np.empty(0)
        cuts.append(c)
    ones = float(y.sum())
    model = Additive(cuts, math.log((ones + 1) / (len(y) - ones + 1)))
    model.tables = [np.zeros(len(c) + 1) for c in cuts]
    if not 0 < ones < len(y):
        return model
    bins, margin, least = model.bins(x), np.full(len(y), model.base), max(5.0, len(y) / 2000)

    def residual() -> tuple[np.ndarray, np.ndarray]:
        p = 1.0 / (1.0 + np.exp(-margin))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for j, t in enumerate(model.tables):
            if len(t) < 2:
                continue
            r, h = residual()
            b = bins[:, j]
            counts = np.bincount(b, minlength=len(t))
            g, w = np.bincount(b, r, len(t)), np.bincount(b, h, len(t))
            step = rate * steps(g, np.maximum(w, 1e-3 * counts), 2, min(least, w.sum() / 20))
            t += step
            margin += step[b]
    # Pairs by the gain of one tree on what the single tables leave.
    r, h = residual()
    sizes = [len(t) for t in model.tables]

    def grid(i: int, j: int, v: np.ndarray) -> np.ndarray:
        return np.bincount(bins[:, i] * sizes[j] + bins[:, j], v, sizes[i] * sizes[j]).reshape(sizes[i], sizes[j])

    some = h.sum() / 100
    gains = {p: quarters(grid(*p, r), grid(*p, h), some)[0] for p in combinations(range(len(sizes)), 2) if min(sizes[p[0]], sizes[p[1]]) > 1}
    chosen = sorted(gains, key=lambda p: (-gains[p], p))[:n_pairs]
    model.pairs = {p: np.zeros((sizes[p[0]], sizes[p[1]])) for p in chosen if gains[p] > 0}
    for _ in range(pair_rounds):
        for (i, j), t in model.pairs.items():
            r, h = residual()
            step = rate * quarters(grid(i, j, r), grid(i, j, h), h.sum() / 100)[1]
            t += step
            margin += step[bins[:, i], bins[:, j]]
    return model


def extract(batches):
    """doc_id and a binary column of its features (64-bit floats); label columns pass through."""
    for b in batches:
        found = np.array([features(x) for x in bytes_of(b)], np.float64)
        rest = [n for n in b.schema.names if n != "text"]
        raw = pa.array([r.tobytes() for r in found], pa.binary())
        yield pa.RecordBatch.from_arrays([*(b.column(n) for n in rest), raw], names=[*rest, "features"])


def remainder(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % HOLD_OUT


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED, id_col: str = "doc_id", text_col: str = "text") -> Additive:
    """Fit on at most `most` labelled rows, none of them held out. Rows with a null id or label take no part; an id
    whose labels disagree is left out; of rows that repeat an id each counts."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = known.where("doc_id IS NOT NULL AND quality IS NOT NULL AND quality IN (0, 1)").where(remainder() != 0)
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("_most")).where("quality = _most")
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select("doc_id", "quality")
    texts = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    rows = texts.join(F.broadcast(known), "doc_id").mapInArrow(extract, "doc_id long, quality int, features binary")
    # Repeated ids could exceed the bound: then only the first by id and features stay.
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "features").limit(most).toArrow()
    x = np.frombuffer(b"".join(rows.column("features").to_pylist()), np.float64).reshape(-1, len(FEATURES))
    return fit(x, np.array(rows.column("quality").to_pylist(), np.float64))


def score_documents(docs: DataFrame, model: Additive, keep: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the columns in keep, and score for each row's whole text.

    A null text counts as empty and gets the score of an empty text. Null and repeated ids, repeated rows and
    further columns are allowed; an empty table gives an empty table. No shuffle; the model is some kilobytes.
    """
    text = text_or_empty(text_col)
    first = [F.col(id_col).cast("long").alias("doc_id")] if id_col not in keep else []
    rows = small_batches(docs).select(*first, *keep, text.alias("_text") if "text" in keep else text.alias("text"))
    name = "_text" if "text" in keep else "text"
    names = [f.name for f in rows.schema.fields if f.name != name]

    def run(batches):
        for b in batches:
            x = np.array([features(t) for t in bytes_of(b, name)], np.float64)
            s = model.score(x) if len(x) else np.empty(0)
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(s)], names=[*names, "score"])

    schema = rows.drop(name).withColumn("score", F.lit(0.0)).schema
    return rows.mapInArrow(run, schema)
