"""BPE encoding and decoding with a word-end vocabulary, as plain Python over Arrow batches.

A word is merged with a priority queue of merge ranks over a doubly linked list of symbols; queue
entries whose pair has changed meanwhile are stale and skipped. Decoding concatenates vocabulary
strings. Words repeat, so each task keeps a bounded memo of white-space chunks and words.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Callable
from functools import cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, normalizers, pre_tokenizers

from wiretally.llm.common import map_rows, text_or_empty, texts_of

#: Entries of a memo before it is emptied; bounds a task's memory whatever the corpus holds.
MEMO_ENTRIES = 500_000
#: Chunks longer than this are merged anew each time and not remembered.
MEMO_CHARS = 64
#: Unicode White_Space, which the tokenizer's regular expressions call \s.
WHITE_SPACE = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: No character below this is newer than Python's Unicode tables and has a lower case.
FIRST_LATE = re.compile("[\u1c80-\U0010ffff]").search
#: Characters that str.split() takes for white space and Unicode does not.
ONLY_PYTHON_SPACE = re.compile("[\x1c-\x1f]")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


@cache
def late_characters() -> tuple[dict[str, str], dict[int, str]]:
    """What Python's Unicode tables lack: by kind (L, N) the characters that only the regex module, not the
    tokenizers library, takes for that kind; and the lower case that only the library knows."""
    every = "".join(chr(c) for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000)
    newer, lower = {}, {}
    for kind in "LN":
        late = [c for c in regex.findall(rf"\p{{{kind}}}", every) if unicodedata.category(c) == "Cn"]
        split = pre_tokenizers.Split(Regex(rf"\p{{{kind}}}"), "removed", invert=True)
        known = {c for c, _ in split.pre_tokenize_str(" ".join(late))}
        newer[kind] = "".join(c for c in late if c not in known)
        low = normalizers.Lowercase().normalize_str("\n".join(late)).split("\n")
        lower |= {ord(a): b for a, b in zip(late, low, strict=True) if a.lower() != b}
    return newer, lower


def library_classes(pattern: str) -> str:
    r"""The pattern with \s, \p{L} and \p{N} as in the tokenizers library's version of Unicode."""
    cls = {k: rf"\p{{{k}}}" + (f"--[{regex.escape(v)}]" if v else "") for k, v in late_characters()[0].items()}
    pattern = pattern.replace(r"[^\s\p{L}\p{N}]", rf"[^{WHITE_SPACE}[{cls['L']}][{cls['N']}]]")
    pattern = pattern.replace(r"[\p{L}]", f"[{cls['L']}]").replace(r"[\p{N}]", f"[{cls['N']}]")
    return "(?V1)" + pattern


class WordBpe:
    """A tokenizers JSON file of the kind: NFC, white space dropped, lower case, pattern split, byte symbols, word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"]
        self.strings = {i: s for s, i in self.vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings |= {i: s for s, i in self.special.items()}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        #: left id << 20 | right id -> rank of the merge; rank -> merged id
        self.ranks: dict[int, int] = {}
        self.made: list[int] = []
        for rank, (a, b) in enumerate(pairs):
            self.ranks[self.vocab[a] << 20 | self.vocab[b]] = rank
            self.made.append(self.vocab[a + b])
        symbols = byte_symbols()
        self.inner = [self.vocab.get(c, -1) for c in symbols]
        self.last = [self.vocab.get(c + self.end, -1) for c in symbols]
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.exact_words = regex.compile(library_classes(pattern)).findall
        self.plain_words = regex.compile(pattern.replace(r"\s", WHITE_SPACE)).findall
        self.late = frozenset("".join(late_characters()[0].values()))
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")").split if self.special else None

    def words(self, text: str) -> list[str]:
        """The pre-tokens of normalised text; the slow exact pattern only where a late character occurs."""
        if text.isascii() or self.late.isdisjoint(text):
            return self.plain_words(text)
        return self.exact_words(text)

    def merge(self, word: bytes) -> list[int]:
        """The ids of one pre-token."""
        inner, rank_of, made = self.inner, self.ranks.get, self.made
        ids = [inner[b] for b in word]
        if word:
            ids[-1] = self.last[word[-1]]
        if min(ids, default=0) < 0:
            ids = [i for i in ids if i >= 0]
        n = len(ids)
        if n < 2:
            return ids
        # An entry is rank << 32 | place: the order is by rank, then place.
        queue = [
            r << 32 | i for i, (a, b) in enumerate(pairwise(ids)) if (r := rank_of(a << 20 | b)) is not None
        ]
        if not queue:
            return ids
        heapq.heapify(queue)
        push, pop = heapq.heappush, heapq.heappop
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        ids.append(-1)
        while queue:
            entry = pop(queue)
            rank, i = entry >> 32, entry & 0xFFFFFFFF
            left, j = ids[i], after[i]
            if left < 0 or rank_of(left << 20 | ids[j] if ids[j] >= 0 else -1) != rank:
                continue  # stale: one side has been merged meanwhile
            ids[i], ids[j], k = made[rank], -1, after[j]
            after[i] = k
            if k < n:
                before[k] = i
                if (r := rank_of(made[rank] << 20 | ids[k])) is not None:
                    push(queue, r << 32 | i)
            if (h := before[i]) >= 0 and (r := rank_of(ids[h] << 20 | made[rank])) is not None:
                push(queue, r << 32 | h)
        return [i for i in ids if i >= 0]

    def chunks(self, text: str) -> list[tuple[bool, str]]:
        """(special, chunk) in order; a chunk has no white space and holds whole pre-tokens."""
        out: list[tuple[bool, str]] = []
        parts = self.split_special(text) if self.split_special and "<" in text else [text]
        for k, part in enumerate(parts):
            if k % 2:
                out.append((True, part))
            else:
                out.extend((False, c) for c in plain_chunks(part))
        return out

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for special, chunk in self.chunks(text):
            if special:
                out.append(self.special[chunk])
            else:
                for w in self.words(chunk):
                    out += self.merge(w.encode())
        return out

    def decode(self, ids: list[int]) -> str:
        """Vocabulary strings, concatenated with the single space that a tokenizer without a decoder puts between."""
        return " ".join(self.strings[i] for i in ids if i in self.strings)


def normal(text: str) -> str:
    """NFC, then lower case one character at a time (no final sigma)."""
    if text.isascii():
        return text.lower()
    low = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
    return low.translate(late_characters()[1]) if FIRST_LATE(low) else low


def plain_chunks(text: str) -> list[str]:
    low = normal(text)
    if ONLY_PYTHON_SPACE.search(low):
        return [c for c in re.split(f"[{WHITE_SPACE}]+", low) if c]
    return low.split()


class Memo(dict):
    """word or chunk -> what `make` gives for it; emptied when full."""

    def __init__(self, make: Callable, entries: int = MEMO_ENTRIES):
        super().__init__()
        self.make, self.entries = make, entries

    def __missing__(self, key: str):
        value = self.make(key)
        if len(key) <= MEMO_CHARS:
            if len(self) >= self.entries:
                self.clear()
            self[key] = value
        return value


@cache
def load(path: str) -> WordBpe:
    return WordBpe(path)


def special_free(bpe: WordBpe, text: str) -> bool:
    return "<" not in text or not any(s in text for s in bpe.special)


def encode_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode whole texts and decode them again.

    Returns id_col, n_tokens, ids (binary: little-endian unsigned 32-bit) and decoded (string), one row
    for each input row. A null text counts as empty: no ids, empty decoded text. Null or repeated ids,
    repeated rows and further columns are allowed; each row is encoded by itself. An empty table gives
    an empty table. Long texts are held one at a time. No shuffle.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))

    def make():
        bpe = load(tokenizer_path)

        def word(w: str) -> tuple[bytes, str]:
            ids = bpe.merge(w.encode())
            return np.array(ids, "<u4").tobytes(), bpe.decode(ids)

        words = Memo(word)

        def chunk(c: str) -> tuple[bytes, str]:
            got = [words[w] for w in bpe.words(c)]
            return b"".join([g[0] for g in got]), " ".join([g[1] for g in got if g[1]])

        chunks = Memo(chunk)

        def rows(batch):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch), strict=True):
                if special_free(bpe, text):
                    got = [chunks[c] for c in plain_chunks(text)]
                else:
                    got = [
                        (np.array([bpe.special[c]], "<u4").tobytes(), c) if special else chunks[c]
                        for special, c in bpe.chunks(text)
                    ]
                ids, decoded = b"".join([g[0] for g in got]), " ".join([g[1] for g in got if g[1]])
                yield (doc_id, len(ids) // 4, ids, decoded), len(ids) + len(decoded)

        return rows

    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())])
    return map_rows(docs, make, "doc_id long, n_tokens long, ids binary, decoded string", schema)
