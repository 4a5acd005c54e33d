"""The registered queries of the corpus operators: each applies one operator to its whole table."""

from __future__ import annotations

import os
from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wiretally.llm import bpe, licenses, mixing, neardup, quality, secrets, sharding, syncmers, token_counts, topk
from wiretally.session import shared_folder


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where the public vocabulary files are: $WIRETALLY_TOKENIZERS, or the public_tokenizers package."""
    if folder := os.environ.get("WIRETALLY_TOKENIZERS"):
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def secret_ledger(spark: SparkSession) -> secrets.Ledger:
    """The ledger that spark.wiretally.secretLedger names, which outlives a run; without the setting one of this run's own."""
    path = spark.conf.get("spark.wiretally.secretLedger", "") or f"{shared_folder(spark)}/secret-ledger-{uuid4().hex}"
    return secrets.Ledger(spark, path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_documents(documents(spark, sf_dir), n_shards=16)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op2_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.fingerprint_documents(documents(spark, sf_dir))


def op3_impact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = topk.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), k=20, scale=64, every=20)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op4_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.encode_documents(documents(spark, sf_dir), tokenizer_path())
    return out.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op5_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = quality.score_documents(docs, model)
    return out.select(
        "doc_id",
        F.coalesce(quality.remainder() == 0, F.lit(False)).alias("held_out"),  # a null id has no label to hold out
        "score",
        (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"),
    )


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses.scan_licenses(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir), tokenizer_path())


def op8_bottom_k_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, sf_dir))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets.scan_documents(documents(spark, sf_dir), secret_ledger(spark))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix_sources(documents(spark, sf_dir))
    return out.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ring_shards": op1_ring_shards,
    "op2_syncmer_fingerprints": op2_syncmer_fingerprints,
    "op3_impact_top_k": op3_impact_top_k,
    "op4_bpe_round_trip": op4_bpe_round_trip,
    "op5_quality_scores": op5_quality_scores,
    "op6_license_scan": op6_license_scan,
    "op7_token_counts": op7_token_counts,
    "op8_bottom_k_near_dups": op8_bottom_k_near_dups,
    "op9_secret_scan": op9_secret_scan,
    "op10_source_mix": op10_source_mix,
}

ORACLE_SQL: dict[str, str] = {
    "op8_bottom_k_near_dups": """
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x20\x09-\x0D]+') AS ws
            FROM documents
        ), s AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []
                WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
                ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g
            FROM w
        ), n AS (
            SELECT w.doc_id, count(s.g) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY w.doc_id
        ), common AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id
            GROUP BY a.doc_id, b.doc_id
        ), link AS (
            SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)
        ), edge AS (
            SELECT a, b FROM link UNION ALL SELECT b, a FROM link
        ), reach AS (
            SELECT doc_id, doc_id AS r FROM n UNION SELECT reach.doc_id, edge.b FROM reach JOIN edge ON edge.a = reach.r
        )
        SELECT n.doc_id, n.n AS n_shingles, min(reach.r) AS component_id, min(reach.r) = n.doc_id AS kept
        FROM n JOIN reach USING (doc_id) GROUP BY n.doc_id, n.n
    """,
    "op3_impact_top_k": """
        WITH parts AS (
            SELECT vec_id, len(embedding) AS n, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS d
            FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
        ), good AS (
            SELECT vec_id FROM parts GROUP BY vec_id, n HAVING count(*) FILTER (WHERE isfinite(x)) = n
        ), v AS (
            SELECT p.vec_id, p.d, CAST(floor(64 * p.x) AS BIGINT) AS x FROM parts p JOIN good g USING (vec_id)
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
            FROM v q JOIN v c ON q.d = c.d AND q.vec_id <> c.vec_id
            WHERE q.vec_id % 20 = 0 GROUP BY q.vec_id, c.vec_id
        ), r AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
        )
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
    """,
}
