import random
import zlib

import numpy as np
import pytest
from odd import CLASH, ODD

from wiretally.llm import neardup, quality, topk

SCHEMA = "vec_id long, embedding array<float>"


def brute_top(rows, k, every=20):
    good = [(i, [int(np.floor(64 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for n, (i, q) in enumerate(good):
        if i % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, v)), j) for m, (j, v) in enumerate(good) if m != n)
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored[:k])]
    return sorted(out)


def as32(rows):
    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]


@pytest.mark.parametrize("blocks", [(4096, 512, 2048), (37, 5, 16), (100, 3, 100)])
def test_top_k_against_brute_force(spark, blocks):
    rng = random.Random(1)
    rows = as32([(i, [rng.gauss(0, 0.2) + 0.3 * (d == i % 7) for d in range(16)]) for i in range(300)])
    rows += as32([(300 + i, rows[5][1]) for i in range(60)])  # a very common vector
    df = spark.createDataFrame(rows, SCHEMA)
    got = topk.top_k(df, 20, index_block=blocks[0], query_block=blocks[1], least_block=blocks[2]).collect()
    assert sorted(map(tuple, got)) == brute_top(rows, 20)


def test_search_stops_on_proof(spark):
    """Fewer postings are multiplied than a plain product has, and no member of the k best is missed, with or without a bar."""
    v = [r["embedding"] for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").orderBy("vec_id").collect()]
    m = np.floor(64 * np.array([x for x in v if x], np.float64)).astype(np.int64)
    queries = m[::100]
    for scale in (1, 1000, 1 << 20, 1 << 23, 1 << 27):
        index, work = topk.ImpactIndex(m * scale), 0
        scores = queries @ (m * scale).T
        kth = np.sort(scores, axis=1)[:, -20]
        for known in (np.full(len(queries), topk.NO_BAR), kth, kth - 5):
            seen = 0
            for i, at, got in index.search(queries, 20, known):
                assert set(np.flatnonzero(scores[i] >= kth[i])) <= set(at.tolist()) and (got == scores[i][at]).all()
                seen += 1
            assert seen == len(queries)
            work += index.multiplied
        assert work < 0.85 * 3 * len(queries) * m.size
    zeros = topk.ImpactIndex(np.zeros((100, 3), np.int64))
    assert [len(at) for _, at, _ in zeros.search(np.ones((2, 3), np.int64), 5, np.array([topk.NO_BAR, 0]))] == [100, 100]


def test_products_beyond_64_bits(spark):
    rows = [(0, [1e30, 1.0]), (1, [1e30, 0.0]), (2, [-1e30, 0.0]), (3, [1.0, 1.0]), (20, [2e9, 2e9]), (4, [3e9, 1e9])]
    got = {(r[0], r[2]): r[3] for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 10).collect()}
    top = (1 << 63) - 1
    assert got[0, 1] == top and got[0, 2] == -top - 1 and got[0, 3] == top and got[20, 3] == int(64 * 2e9) * 64 * 2
    assert len(got) == 10


def test_odd_vectors(spark):
    rows = as32([(0, [1.0, 2.0]), (0, [1.0, 2.0]), (20, [0.5]), (1, None), (2, [float("nan"), 1.0]), (3, [None, 1.0]), (4, [float("inf"), 1.0]), (None, [1.0, 1.0]), (5, []), (40, [-3.0, 1e6])])
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(map(tuple, topk.top_k(df, 3).collect()))
    assert got == brute_top(rows, 3)
    assert not topk.top_k(spark.createDataFrame([], SCHEMA), 3).collect()
    assert not topk.top_k(spark.createDataFrame([(20, [1.0])], SCHEMA), 3).collect()


def brute_set(text):
    words = (text or "").encode().lower().split()
    if not words:
        return set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)}


def brute_components(rows):
    sets = [(i, brute_set(t)) for i, t in rows if i is not None]
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a + 1, len(sets)):
            n = len(sets[a][1] & sets[b][1])
            if n and 100 * n >= 75 * len(sets[a][1] | sets[b][1]):
                parent[root(a)] = root(b)
    least = {}
    for x, (i, _) in enumerate(sets):
        least[root(x)] = min(i, least.get(root(x), i))
    return sorted((i, len(s), least[root(x)], i == least[root(x)]) for x, (i, s) in enumerate(sets))


def near_copies(rng, n, size, rate):
    base = [f"w{rng.randrange(10**6)}" for _ in range(size)]
    return [" ".join(w if rng.random() > rng.random() * rate else f"z{rng.randrange(10**6)}" for w in base) for _ in range(n)]


@pytest.mark.parametrize("large", [False, True])
def test_near_duplicates_against_brute_force(make, monkeypatch, large):
    """Also with stars of more than one block, whose members get lists of their full sets."""
    if large:
        monkeypatch.setattr(neardup, "BLOCK_DOCS", 8)
        monkeypatch.setattr(neardup, "STAR_BLOCKS", 1)
        monkeypatch.setattr(neardup, "HUB_MEMBERS", 5)
    rng = random.Random(2)
    passage = [f"p{i}" for i in range(60)]
    texts = near_copies(rng, 60, 150, 0.12) + near_copies(rng, 40, 30, 0.2) + near_copies(rng, 20, 400, 0.06)
    for _ in range(60):  # one passage that many documents share
        own = [f"o{rng.randrange(10**6)}" for _ in range(rng.choice((10, 20, 60)))]
        texts.append(" ".join(own[:5] + passage + own[5:]))
    texts += ["Same TEXT here now ok", "same text here now ok", "one two", "One  two", "three"] + texts[:5]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    got = sorted(map(tuple, neardup.near_duplicates(make(rows)).collect()))
    assert got == brute_components(rows)


def test_hot_duplicates(make, as_large):
    """Nine tenths of the rows are one text, others blank, others unlike but with one long passage: all in place."""
    rng = random.Random(6)
    passage = " ".join(f"p{i}" for i in range(200))
    rows = [(i, "one two three four five six seven") for i in range(900)] + [(1000 + i, " ") for i in range(100)]
    rows += [(2000 + i, passage + " " + " ".join(f"o{rng.randrange(10**6)}" for _ in range(90))) for i in range(100)]
    got = sorted(map(tuple, neardup.near_duplicates(make(rows)).collect()))
    want = [(i, 3, 0, i == 0) for i in range(900)] + [(i, 0, i, True) for i in range(1000, 1100)]
    assert got[:1000] == want and got[1000:] == brute_components(rows[1000:])
    kept = neardup.one_of_each(make(rows))
    assert kept.count() == 1 + 100 + sum(r[3] for r in got[1000:])


def test_chains(make):
    """Links reach through documents that aren't near each other."""
    words = [f"w{i}" for i in range(400)]
    rows = [(100 - k, " ".join(words[k * 8 : k * 8 + 120])) for k in range(30)]
    got = sorted(map(tuple, neardup.near_duplicates(make(rows)).collect()))
    assert got == brute_components(rows) and len({g[2] for g in got}) == 1


def test_odd_duplicates(make):
    rows = neardup.near_duplicates(make(ODD, **CLASH)).collect()
    assert len(rows) == len(ODD)
    known = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert known[5]["component_id"] == 4 and not known[5]["kept"] and known[4]["kept"]
    assert all(known[i]["component_id"] == i and known[i]["n_shingles"] == 0 for i in (1, 2, 3))
    assert all(r["component_id"] is None and r["kept"] for r in rows if r["doc_id"] is None)
    assert not neardup.near_duplicates(make([])).collect()


def test_shingles_against_sets():
    rng = random.Random(4)
    for _ in range(200):
        text = " ".join(rng.choice(["a", "B", "é", "É", "cc", "d\t", "\n", "K"]) for _ in range(rng.randrange(30)))
        assert len(neardup.shingles(text.encode())) == len(brute_set(text)), text


def test_sketch_never_rules_out_a_link():
    rng = np.random.default_rng(6)
    for _ in range(500):
        n = int(rng.integers(1, 600))
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        keep = rng.random(len(a)) < rng.uniform(0.7, 1)
        b = np.unique(np.concatenate((a[keep], rng.integers(0, 1 << 63, int(rng.integers(0, n // 4 + 1)), dtype=np.uint64))))
        if neardup.linked(a, b):
            k = neardup.SKETCH
            assert neardup.within_reach(a[:k], b[:k], len(a), len(b))
            o = min(neardup.overlap_needed(len(a)), neardup.overlap_needed(len(b)))
            assert len(np.intersect1d(a[:k], b[:k])) >= o


def scored(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels)
    rows = {r["doc_id"]: r["score"] for r in quality.score_documents(docs, model).collect()}
    return rows, {r["doc_id"]: r["quality"] for r in labels.collect()}


def test_held_out_accuracy(spark):
    rows, labels = scored(spark, "/root/testdata/sf0.1")
    held = [(rows[i], y) for i, y in labels.items() if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 500
    assert np.mean([(s >= quality.THRESHOLD) == y for s, y in held]) > 0.98
    assert np.mean([s >= quality.THRESHOLD for s, y in held if y == 1]) > 0.995


def test_model_learns_interactions():
    rng = np.random.default_rng(3)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    with_pairs, without = quality.fit(x, y), quality.fit(x, y, n_pairs=0)
    assert (0, 1) in with_pairs.pairs
    hit = lambda m: np.mean((m.score(x) > 0.5) == (y > 0.5))
    assert hit(with_pairs) > 0.95 > hit(without)


def test_scores_are_table_sums():
    rng = np.random.default_rng(5)
    x, y = rng.random((500, 4)), rng.integers(0, 2, 500).astype(float)
    m = quality.fit(x, y, rounds=5)
    b = m.bins(x)
    for r in range(20):
        s = m.base + sum(t[b[r, j]] for j, t in enumerate(m.tables)) + sum(t[b[r, i], b[r, j]] for (i, j), t in m.pairs.items())
        assert m.score(x[r : r + 1])[0] == pytest.approx(1 / (1 + np.exp(-s)))


def test_odd_quality(spark, make):
    docs = make(ODD, **CLASH)
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0), (4, 0), (4, 1), (5, 1), (6, 0), (99, 1)], "doc_id long, quality int")
    for given in (labels, labels.limit(0)):
        rows = quality.score_documents(docs, quality.train(docs, given)).collect()
        assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
    model = quality.train(docs, labels)
    assert not quality.score_documents(make([]), model).collect()
    assert quality.score_documents(docs, model, keep=("doc_id", "text", "lang")).columns == ["doc_id", "text", "lang", "score"]
