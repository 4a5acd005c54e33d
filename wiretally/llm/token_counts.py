"""Token counts by the whole-token shortcut.

Offline, every vocabulary string that ends a word is merged once from its own bytes; those that come
out as one token are proved: a pre-token equal to such a string counts 1 with no merging. All other
pre-tokens are merged. The proved set is a part of the vocabulary, so its broadcast is bounded by it.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wiretally.llm.bpe import Memo, WordBpe, byte_symbols, load, plain_chunks, special_free
from wiretally.llm.common import map_rows, text_or_empty, texts_of


def prove_whole_tokens(bpe: WordBpe) -> frozenset[str]:
    """The pre-tokens that encode alone as exactly one token, each proved by a merge of its bytes."""
    to_byte = {c: b for b, c in enumerate(byte_symbols())}
    proved = set()
    for string, i in bpe.vocab.items():
        if not string.endswith(bpe.end) or len(string) == len(bpe.end):
            continue
        raw = bytes(to_byte[c] for c in string[: -len(bpe.end)])
        try:
            word = raw.decode()
        except UnicodeDecodeError:
            continue  # a part of a character can be no pre-token
        if bpe.merge(raw) == [i]:
            proved.add(word)
    return frozenset(proved)


def count_tokens(
    docs: DataFrame, tokenizer_path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """id_col, n_bytes (UTF-8), n_tokens and over_limit for each row's whole text.

    A null text counts as empty (0 bytes, 0 tokens). Null and repeated ids, repeated rows and further
    columns are allowed. An empty table gives an empty table. Special strings inside a text count as
    the library's default has it: one token each. No shuffle.
    """
    spark = docs.sparkSession
    proved = spark.sparkContext.broadcast(prove_whole_tokens(load(tokenizer_path)))
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))

    def make():
        bpe, whole = load(tokenizer_path), proved.value
        merged = Memo(lambda w: len(bpe.merge(w.encode())))

        def chunk(c: str) -> int:
            return sum(1 if w in whole else merged[w] for w in bpe.words(c))

        chunks = Memo(chunk)

        def rows(batch):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch), strict=True):
                if special_free(bpe, text):
                    n = sum([chunks[c] for c in plain_chunks(text)])
                else:
                    n = sum(1 if special else chunks[c] for special, c in bpe.chunks(text))
                yield (doc_id, len(text.encode()), n, n > limit), 0

        return rows

    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])
    return map_rows(docs, make, "doc_id long, n_bytes long, n_tokens long, over_limit boolean", schema)
