"""A corpus pipeline of the operators in wiretally.llm: quality, near duplicates, secrets, mixing, BPE.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All but the last
return the columns of documents; docs are read from Parquet between stages. Null and blank texts, null and repeated ids,
repeated rows, further columns and empty tables go through every stage with the results that its operator defines; further
columns are dropped by the first.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wiretally.llm import bpe, mixing, neardup, quality, secrets
from wiretally.llm.queries import secret_ledger, tokenizer_path
from wiretally.session import remove, shared_folder

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (score below the threshold) go."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score_documents(docs, model, keep=COLUMNS).where(F.col("score") >= quality.THRESHOLD).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one document stays, of smallest id; documents without an id or without words stay."""
    return neardup.one_of_each(docs).select(*COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every finding is replaced by its kind in brackets; n_chars follows. All documents stay."""
    return secrets.redact_documents(docs, secret_ledger(spark)).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document is emitted as often as its source's target asks: not at all, once or twice."""
    return mixing.emit(docs).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (binary, little-endian 32-bit) of every emitted document, and a check that they decode."""
    out = bpe.encode_documents(docs, tokenizer_path())
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mixing", mix),
    ("bpe", encode),
]
#: Trained tables, sketches and BPE merges can't be told in SQL: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Every stage but the last is written to the shared folder and read again, as stages read
    their documents more than once; what a stage has read is removed when its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid4().hex}"
    before = None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            remove(spark, f"{folder}/{before}")
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
