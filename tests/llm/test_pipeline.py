import corpus_pipeline
import duckdb
import pytest

from wiretally.llm import mixing, quality
from wiretally.llm.queries import ORACLE_SQL, QUERIES


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    held = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        held[name] = (before, docs)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == list(corpus_pipeline.COLUMNS)
    before, after = held["quality"]
    model = quality.train(before, spark.read.parquet(f"{sf}/labels.parquet"))
    good = {r["doc_id"] for r in quality.score_documents(before, model).collect() if r["score"] >= quality.THRESHOLD}
    assert {r["doc_id"] for r in after.collect()} == good and 0 < len(good) < before.count()
    before, after = held["near_duplicates"]
    from test_search_dedup_quality import brute_components

    rows = [(r["doc_id"], r["text"]) for r in before.collect()]
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(i for i, _, _, kept in brute_components(rows) if kept)
    before, after = held["secrets"]
    from test_texts import brute_secrets

    assert before.count() == after.count() and not any(brute_secrets(r["text"]) for r in after.collect())
    before, after = held["mixing"]
    assert after.count() == sum(r["copies"] for r in mixing.mix_sources(before).collect())
    before, after = held["bpe"]
    assert before.count() == after.count() and "ids_sha256" in after.columns


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, sf, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    db = duckdb.connect()
    for t in ("documents", "embeddings"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    res = db.execute(ORACLE_SQL[name])
    names = [d[0] for d in res.description]
    want = sorted(tuple(r[names.index(c)] for c in columns) for r in res.fetchall())
    assert sorted(tuple(r[c] for c in columns) for r in df.collect()) == want


def test_odd_documents(spark, make, tmp_path):
    """Null and blank texts, null ids, repeated rows and a very long text go through all stages; so does an empty table."""
    from odd import ODD

    spark.createDataFrame([(4, 1, 0), (5, 1, 0), (6, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, rows in (("odd", ODD), ("empty", [])):
        docs = make(rows)
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = str(tmp_path / f"{name}{k}")
            stage(spark, docs, str(tmp_path)).write.parquet(out)
            docs = spark.read.parquet(out)
        assert (docs.count() > 0) == bool(rows)


def test_near_duplicates_of_repeated_ids(spark, sf, make):
    """Rows go by their own text: each component keeps one row, whatever else has its id."""
    a, b, c, d = (" ".join(f"{w}{i}" for i in range(30)) for w in "abcd")
    near = b.replace("b29", "b99")
    rows = [(3, a), (5, a), (5, b), (5, c), (9, c), (7, d), (7, d), (7, d), (5, near), (8, ""), (8, ""), (None, a)]
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_duplicates(spark, make(rows), sf).collect()]
    assert sorted(i or 0 for i, _ in got) == [0, 3, 5, 5, 7, 8, 8]
    assert (3, a) in got and (5, c) in got and (7, d) in got and ((5, b) in got) != ((5, near) in got)
