import pytest

#: Joins by shuffle and as many tasks as there are partitions, as for large tables.
AS_LARGE = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def make(spark):
    def build(rows, **extra):
        """rows of (doc_id, text[, source]); extra: columns with one value each."""
        from pyspark.sql import functions as F

        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) for r in rows]
        return spark.createDataFrame(full, SCHEMA).withColumns({k: F.lit(v) for k, v in extra.items()})

    return build


@pytest.fixture(scope="session")
def tokenizer():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture
def as_large(spark, monkeypatch):
    """Keys of more than 50 rows are hot, and plans are those of large tables."""
    monkeypatch.setattr("wiretally.llm.common.HOT_ROWS", 50)
    for k, v in AS_LARGE.items():
        spark.conf.set(k, v)
    yield
    for k in AS_LARGE:
        spark.conf.unset(k)
