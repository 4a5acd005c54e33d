import random

import pytest
from odd import CLASH, LONG, ODD
from tokenizers import Tokenizer

from wiretally.llm import bpe, token_counts


@pytest.fixture(scope="module")
def library(tokenizer):
    return Tokenizer.from_file(tokenizer)


@pytest.fixture(scope="module")
def own(tokenizer):
    return bpe.load(tokenizer)


def check(own, library, texts):
    for text, e in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        ids = own.encode(text)
        assert ids == e.ids, text
        assert own.decode(ids) == library.decode(e.ids, skip_special_tokens=False)


def test_every_code_point(own, library):
    texts = [f"a{chr(c)}b {chr(c)}" for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for text, e in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert own.encode(text) == e.ids, hex(ord(text[1]))


def test_random_texts(own, library):
    rng = random.Random(5)
    letters = "abcdeé İΣςΟ 's'RE'll\x1c\x85́ﬁ129<|endoftext|>!?#‍漢字\U0001f600\n\t"
    check(own, library, ["".join(rng.choice(letters) for _ in range(rng.randrange(80))) for _ in range(3000)])
    check(own, library, ["<|endoftext|> x<|startoftext|>y", "", " ", LONG[:5000], "aaaaaaaaaaaa" * 50, "ΑΣ ΟΔΟΣ."])


def test_documents(spark, sf, own, library, tokenizer):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in bpe.encode_documents(docs, tokenizer).collect():
        want = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        got = [int.from_bytes(r["ids"][i : i + 4], "little") for i in range(0, len(r["ids"]), 4)]
        assert got == want and r["n_tokens"] == len(want) and r["decoded"] == library.decode(want, skip_special_tokens=False)


def test_odd_rows(make, library, tokenizer):
    docs = make(ODD, **CLASH)
    rows = bpe.encode_documents(docs, tokenizer).collect()
    counts = token_counts.count_tokens(docs, tokenizer).collect()
    want = sorted((i is None, i or 0, len(library.encode(t or "", add_special_tokens=False).ids), len((t or "").encode())) for i, t in ODD)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"]) for r in rows) == [w[:3] for w in want]
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], r["n_bytes"]) for r in counts) == want
    assert {r["doc_id"] for r in counts if r["over_limit"]} == {6}
    assert not bpe.encode_documents(make([]), tokenizer).collect() and not token_counts.count_tokens(make([]), tokenizer).collect()


def test_proved_tokens(own, library):
    proved = token_counts.prove_whole_tokens(own)
    assert len(proved) > 30_000
    sample = sorted(proved)[::37]
    for w in sample:
        assert len(own.merge(w.encode())) == 1


def test_memo_is_bounded():
    memo = bpe.Memo(len, entries=10)
    for i in range(100):
        assert memo[str(i)] == len(str(i))
    assert len(memo) <= 10
    assert memo["x" * 100] == 100 and "x" * 100 not in memo
